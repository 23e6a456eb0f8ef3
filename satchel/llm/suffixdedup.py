"""Suffix-array dedup: bytes inside any 200-byte string that occurs twice are removed.

Shards of candidate segments (see ``repeats``) get a suffix array by Larsson-Sadakane
refinement in numpy: suffixes start in groups of equal eight bytes, and groups are refined
by the ranks of the suffixes further on, doubling the depth, singletons left alone. Common
prefixes of neighbours follow in text order, each starting from the last one less one where
the neighbour moved along (Kasai), all segments of a shard side by side. A window whose
common prefix with a neighbour has full length is repeated. Shards that split one anchor are
merged by binary search.

The kept text is the bytes that are left; where a removal cut a character, its remaining
bytes are dropped from ``kept`` (the digest is of the bytes). Null is empty; a text shorter
than a window loses nothing; equal texts, repeated rows included, remove each other.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from satchel.llm.repeats import LIMIT, Kind, Piece, removed, replaced, spans

SIZE = 200


def split_bytes(data: np.ndarray, offsets: np.ndarray) -> Piece:
    return Piece(data, offsets, data.tobytes())


def byte_ids(segments: list[bytes]) -> list[np.ndarray]:
    return [np.frombuffer(s, np.uint8) for s in segments]


def byte_window(segment: Column, place: Column, size: int) -> Column:
    return F.substring(segment, place + 1, F.lit(size))


def packed8(text: np.ndarray) -> np.ndarray:
    """Eight bytes from each place on, first byte highest; zeros after the end."""
    t = np.concatenate([text, np.zeros(8, np.uint8)]).astype(np.uint64)
    x = t[:-1] << np.uint64(8) | t[1:]
    x = x[:-2] << np.uint64(16) | x[2:]
    return (x[:-4] << np.uint64(32) | x[4:])[: len(text)]


def suffix_order(first: np.ndarray, depth: int, local: np.ndarray, windows: np.ndarray, size: int) -> np.ndarray:
    """Places of all windows in the order of their ``size`` symbols. ``first`` ranks the
    ``depth`` symbols from each place; ``local`` is a place's distance from its segment's
    start and ``windows`` the number of windows of that segment."""
    sa = np.flatnonzero(local < windows + size - depth)
    sa = sa[np.argsort(first[sa], kind="stable")].astype(np.int32)
    key = first[sa]
    head = np.concatenate([[True], key[1:] != key[:-1]])
    rank = np.zeros(len(first), np.int32)
    rank[sa] = np.maximum.accumulate(np.where(head, np.arange(len(sa)), 0))
    while depth < size:
        deeper = min(2 * depth, size)
        sa = sa[local[sa] < windows[sa] + size - deeper]
        r = rank[sa]
        same = r[1:] == r[:-1]
        act = np.flatnonzero(np.concatenate([same, [False]]) | np.concatenate([[False], same]))
        if len(act):
            p, k1 = sa[act], r[act]
            key = k1.astype(np.uint64) << np.uint64(32) | rank[p + deeper - depth].astype(np.uint64)
            order = np.argsort(key)
            p, key, k1 = p[order], key[order], k1[order]
            at = np.arange(len(act))
            new_group = np.concatenate([[True], k1[1:] != k1[:-1]])
            new_head = np.concatenate([[True], key[1:] != key[:-1]])
            group_at = np.maximum.accumulate(np.where(new_group, at, 0))
            head_at = np.maximum.accumulate(np.where(new_head, at, 0))
            sa[act] = p
            rank[p] = k1 + (head_at - group_at)
        depth = deeper
    return sa


def common_prefixes(word: np.ndarray, before: np.ndarray, starts: np.ndarray, windows: np.ndarray, size: int) -> np.ndarray:
    """For each window the length of its common prefix with the suffix ``before`` it, up to
    ``size``; -1 where there is none. All segments advance together."""
    out = np.full(len(word), -1, np.int32)
    lane = np.argsort(-windows, kind="stable")
    starts, windows = starts[lane], windows[lane]
    last, length = np.full(len(starts), -2, np.int64), np.zeros(len(starts), np.int64)
    for j in range(int(windows[0]) if len(windows) else 0):
        n = int(np.searchsorted(-windows, -j, "left"))
        p = starts[:n] + j
        q = before[p]
        length[:n] = np.where((q >= 0) & (q == last[:n] + 1), np.maximum(length[:n] - 1, 0), 0)
        go = np.flatnonzero(q >= 0)
        while len(go):
            diff = word[p[go] + length[go]] ^ word[q[go] + length[go]]
            equal = np.full(len(go), 8)
            some = np.flatnonzero(diff)
            if len(some):
                equal[some] = sum(((diff[some] >> np.uint64(shift)) == 0).astype(np.int64) for shift in range(8, 64, 8))
            length[go] = np.minimum(length[go] + equal, size)
            go = go[(equal == 8) & (length[go] < size)]
        out[p] = np.where(q >= 0, length[:n], -1)
        last[:n] = q
    return out


def repeated(segments: list[np.ndarray], size: int) -> list[np.ndarray]:
    """For each segment which of its windows occur more than once in all of them."""
    lengths = np.array([len(s) for s in segments])
    text = np.concatenate(segments)
    starts = np.cumsum(lengths) - lengths
    windows = lengths - size + 1
    local = (np.arange(len(text)) - np.repeat(starts, lengths)).astype(np.int32)
    word = packed8(text)
    sa = suffix_order(word, 8, local, np.repeat(windows, lengths).astype(np.int32), size)
    before = np.full(len(text) + 8, -1, np.int32)
    before[sa[1:]] = sa[:-1]
    del local, sa
    full = common_prefixes(np.concatenate([word, np.zeros(8, np.uint64)]), before, starts, windows, size)[: len(text)] >= size
    marks = full.copy()
    marks[before[np.flatnonzero(full)]] = True
    return [marks[a : a + n] for a, n in zip(starts.tolist(), windows.tolist(), strict=True)]


def kind_of(size: int) -> Kind:
    return Kind(size, 32, split_bytes, byte_ids, repeated, byte_window)


def keep_bytes(data: np.ndarray, offsets: np.ndarray, cover) -> list[pa.Array]:
    out = cover(offsets)
    n, gone, runs, sha, kept = [], [], [], [], []
    for a, z in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        own, off = data[a:z], out[a:z]
        some = bool(off.any())
        left = own[~off].tobytes() if some else own.tobytes()
        n.append(len(own))
        gone.append(len(own) - len(left))
        runs.append(len(spans(off)[0]) if some else 0)
        sha.append(hashlib.sha256(left).hexdigest())
        kept.append(whole_characters(own, off) if some else None)
    return [pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(runs, pa.int64()), pa.array(sha, pa.string()), pa.array(kept, pa.string())]


def whole_characters(own: np.ndarray, out: np.ndarray) -> str:
    """The text of the characters none of whose bytes is out."""
    char = np.cumsum((own & 0xC0) != 0x80) - 1
    hit = np.bincount(char, weights=out, minlength=int(char[-1]) + 1) > 0
    return own[~hit[char]].tobytes().decode()


def deduplicated(docs: DataFrame, size: int = SIZE, limit: int = LIMIT) -> DataFrame:
    """``docs`` (text, other columns) with its repeated bytes removed from text."""
    return replaced(docs, kind_of(size), keep_bytes, limit)


def suffix_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1: all documents, 200 bytes."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return removed(docs, kind_of(SIZE), keep_bytes).select("row.doc_id", F.col("n_symbols").alias("n_bytes"), "n_removed", "n_spans", "kept_sha256")
