"""Substring dedup by a compressed FM-index: words inside any 35-word window that occurs
twice are removed.

Each shard of candidate segments (see ``repeats``) is indexed: the Burrows-Wheeler transform
of its words, as a wavelet matrix of packed bits with counts per 64. What documents hold of
that shard is streamed against it: backward search extends a match to the left as long as it
occurs at least twice, which gives the matching statistics; every place where a match has
reached the length of a window is reported. When a match can't be extended, the search
restarts from the last end that a window to the left could have. All segments of a shard are
searched side by side. Shards that split one anchor are merged by binary search.

Words are what stands between ASCII white space, unchanged. Their 64-bit hashes choose
anchors only; in a shard each word has its number in a dictionary, so windows are compared
by their words. Null has no words; a text of fewer words than a window loses nothing; equal
texts, repeated rows included, remove each other; white space is not kept: kept words are
joined by spaces. Columns of any name pass through; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from satchel.llm.repeats import LIMIT, Kind, Piece, removed, replaced, spans
from satchel.llm.shared import mix64

SIZE = 35
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BYTE = mix64(np.arange(1001, 1257, dtype=np.uint64))
_FACTOR = 0x9E3779B97F4A7C15


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte and end byte of every word; a row's end ends a word."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    start = inside & np.concatenate([[True], ~inside[:-1]]) | inside & edge[:-1]
    end = inside & np.concatenate([~inside[1:], [True]]) | inside & edge[1:]
    return np.flatnonzero(start), np.flatnonzero(end) + 1


def words_as_symbols(data: np.ndarray, offsets: np.ndarray):
    """Each word's hash: the sum of its mixed bytes times powers of an odd factor by place,
    taken from running sums, and mixed with its length. With it the rows' offsets in words and
    each word's first byte and end byte."""
    start, end = word_bounds(data, offsets)
    one = np.ones(1, np.uint64)
    powers = np.cumprod(np.concatenate([one, np.full(len(data), _FACTOR, np.uint64)]))
    inverse = np.cumprod(np.concatenate([one, np.full(len(data), pow(_FACTOR, -1, 2**64), np.uint64)]))
    run = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[data] * powers[:-1])])
    x = mix64((run[end] - run[start]) * inverse[start] ^ (end - start).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    return x, np.searchsorted(start, offsets, "left"), start, end


def split_words(data: np.ndarray, offsets: np.ndarray) -> Piece:
    """Words and their hashes; the bytes are those of all words, one space after each."""
    x, at, start, end = words_as_symbols(data, offsets)
    n = end - start
    first = np.cumsum(n + 1) - (n + 1)
    inside = np.flatnonzero(~_SPACE[data]) if len(data) else np.zeros(0, np.int64)
    raw = np.full(int((n + 1).sum()), 0x20, np.uint8)
    raw[np.arange(len(inside)) + np.repeat(np.arange(len(n)), n)] = data[inside]
    return Piece(x, at, raw.tobytes(), first, first + n)


def word_ids(segments: list[bytes]) -> list[np.ndarray]:
    """Each word's number in a dictionary of the shard's words."""
    known: dict[bytes, int] = {}
    return [np.array([known.setdefault(w, len(known)) for w in s.split(b" ")], np.int64) for s in segments]


def word_window(segment: Column, place: Column, size: int) -> Column:
    return F.slice(F.split(segment.cast("string"), " "), place + 1, F.lit(size))


class Bits:
    """A bit vector packed 64 to a word, with counts before each word."""

    def __init__(self, bits: np.ndarray):
        padded = np.concatenate([bits, np.zeros(-len(bits) % 64 + 64, bool)])
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        counts = np.bitwise_count(self.words)
        self.before = np.concatenate([[0], np.cumsum(counts[:-1], dtype=np.int64)])
        self.zeros = len(bits) - int(counts.sum())

    def ones(self, i: np.ndarray) -> np.ndarray:
        """Ones before ``i``."""
        k = i >> 6
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[k] + np.bitwise_count(self.words[k] & mask)


class FMIndex:
    """Backward search over symbols 0..n-1; ``order`` is the suffix array of ``text``."""

    def __init__(self, text: np.ndarray, order: np.ndarray):
        bwt = text[order - 1]
        self.n = len(text)
        self.depth = max(1, int(text.max()).bit_length())
        counts = np.bincount(text, minlength=int(text.max()) + 1)
        first = np.cumsum(counts) - counts
        self.levels, x = [], bwt
        for level in range(self.depth - 1, -1, -1):
            bit = (x >> level & 1).astype(bool)
            self.levels.append(Bits(bit))
            x = np.concatenate([x[~bit], x[bit]])
        # where each symbol begins on the last level, and what turns a place there into a row
        symbols = np.arange(len(counts))
        place = np.zeros(len(counts), np.int64)
        for level, bits in zip(range(self.depth - 1, -1, -1), self.levels, strict=True):
            place = self._down(bits, symbols >> level & 1, place)
        self.base = first - place

    @staticmethod
    def _down(bits: Bits, bit: np.ndarray, i: np.ndarray) -> np.ndarray:
        ones = bits.ones(i)
        return np.where(bit == 1, bits.zeros + ones, i - ones)

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows of ``symbol`` followed by what the rows [low, high) begin with."""
        n = len(low)
        i, s = np.concatenate([low, high]), np.concatenate([symbol, symbol])
        for level, bits in zip(range(self.depth - 1, -1, -1), self.levels, strict=True):
            i = self._down(bits, s >> level & 1, i)
        i = i + self.base[s]
        return i[:n], i[n:]


def suffix_array(text: np.ndarray) -> np.ndarray:
    """The suffix array by prefix doubling; groups of one are left alone."""
    n = len(text)
    sa = np.argsort(text, kind="stable")
    key = text[sa]
    head = np.concatenate([[True], key[1:] != key[:-1]])
    rank = np.zeros(n, np.int64)
    rank[sa] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    step = 1
    while True:
        r = rank[sa]
        same = r[1:] == r[:-1]
        act = np.flatnonzero(np.concatenate([same, [False]]) | np.concatenate([[False], same]))
        if not len(act):
            return sa
        p, k1 = sa[act], r[act]
        after = np.where(p + step < n, rank[np.minimum(p + step, n - 1)] + 1, 0)
        order = np.argsort(k1 << 32 | after)
        p, k1, after = p[order], k1[order], after[order]
        at = np.arange(len(act))
        new_group = np.concatenate([[True], k1[1:] != k1[:-1]])
        new_head = new_group | np.concatenate([[True], after[1:] != after[:-1]])
        sa[act] = p
        rank[p] = k1 + np.maximum.accumulate(np.where(new_head, at, 0)) - np.maximum.accumulate(np.where(new_group, at, 0))
        step *= 2


def repeated(segments: list[np.ndarray], size: int) -> list[np.ndarray]:
    """For each segment which of its windows occur more than once in all of them."""
    lengths = np.array([len(s) for s in segments])
    dense = np.concatenate(segments)
    # a separator of its own ends each segment and sorts before all words
    k = len(segments)
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    text = np.empty(int(ends[-1]) + 1, np.int64)
    inner = np.ones(len(text), bool)
    inner[ends] = False
    text[inner] = dense + k
    text[ends] = np.arange(k)
    order = suffix_array(text)
    text = np.maximum(text - (k - 1), 0)
    index = FMIndex(text, order)
    marks = np.zeros(len(text), bool)
    begin, end = starts, ends.copy()
    place, low, high = end.copy(), np.zeros(k, np.int64), np.full(k, index.n)
    while len(begin):
        a, z = index.extend(text[place - 1], low, high)
        good = z - a >= 2
        place = np.where(good, place - 1, place)
        marks[place[good & (end - place >= size)]] = True
        # no match through place - 1 up to end: the next end that a window could have
        end = np.where(good, end, np.minimum(end - 1, place - 1 + size))
        low, high = np.where(good, a, 0), np.where(good, z, index.n)
        place = np.where(good, place, end)
        live = (place > begin) & (end - begin >= size)
        begin, end, place, low, high = begin[live], end[live], place[live], low[live], high[live]
    return [marks[a : a + n] for a, n in zip(starts.tolist(), (lengths - size + 1).tolist(), strict=True)]


def kind_of(size: int) -> Kind:
    return Kind(size, 4, split_words, word_ids, repeated, word_window)


def keep_words(data: np.ndarray, offsets: np.ndarray, cover) -> list[pa.Array]:
    start, end = word_bounds(data, offsets)
    at = np.searchsorted(start, offsets, "left")
    out = cover(at)
    raw = data.tobytes()
    n, gone, runs, sha, kept = [], [], [], [], []
    for k, (a, z) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
        off = out[a:z]
        some = bool(off.any())
        if some:
            left = np.flatnonzero(~off) + a
            text = b" ".join(raw[i:j] for i, j in zip(start[left].tolist(), end[left].tolist(), strict=True))
        else:
            text = b" ".join(raw[offsets[k] : offsets[k + 1]].split())
        n.append(z - a)
        gone.append(int(off.sum()))
        runs.append(len(spans(off)[0]) if some else 0)
        sha.append(hashlib.sha256(text).hexdigest())
        kept.append(text.decode() if some else None)
    return [pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(runs, pa.int64()), pa.array(sha, pa.string()), pa.array(kept, pa.string())]


def deduplicated(docs: DataFrame, size: int = SIZE, limit: int = LIMIT) -> DataFrame:
    """``docs`` (text, other columns); a text with repeated windows becomes its kept words
    joined by spaces, others stay as they are."""
    return replaced(docs, kind_of(size), keep_words, limit)


def words_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4: all documents, 35 words."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return removed(docs, kind_of(SIZE), keep_words).select("row.doc_id", F.col("n_symbols").alias("n_words"), "n_removed", "kept_sha256")
