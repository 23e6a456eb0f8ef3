"""What both repeat removers share: finding the windows that occur more than once.

A window is ``size`` consecutive symbols of one document. Which windows could repeat is
narrowed without loss: each window picks the place of its smallest gram hash (its anchor),
equal windows pick the same place in them, so a window can only repeat if its anchor's hash
occurs twice. Consecutive windows with one anchor form a segment. Segments with repeated
anchors are dealt to shards by anchor hash, so equal windows always meet in one shard; there
an index (a suffix array, an FM-index) tells which windows occur more than once.

Equal rows are aggregated before they are shuffled, by their bytes: texts that several rows
hold (found by digest, then grouped by the text itself) and segments of equal content count
as repeated in every window, whatever else the index finds.

An anchor with more than ``LIMIT`` places is split over several shards. Each then hands on
its distinct windows in order, cut into ranges; the ranges of all shards are merged by
binary search, and windows found equal are compared symbol by symbol before they count (the
job fails if they differ), so what counts as equal never depends on the number of places.

Everything is done once per distinct text, whose digest is its key. Null and empty texts have
no windows; rows with equal text, repeated rows included, count as documents of their own;
doc_ids may repeat or be null; columns of any name pass through. The windows of a document
never reach into another. Sizes: a task holds one long text or a piece of PIECE bytes, a
shard holds about SHARD_BYTES, a merge group about as much as LIMIT segments; only lists of
keys of at most BROADCAST_BYTES are broadcast.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from satchel.llm.shared import arrow_groups, arrow_rows, bounded, byte_pieces, mix64, split_join, written

LIMIT = 1024
SHARD_BYTES = 1 << 20
PIECE = 1 << 18
PLACE_BITS = 26
#: Longer documents are scanned in blocks of as many windows.
BLOCK = 1 << 19


@dataclass
class Piece:
    """Symbols of some texts: ``x`` (bytes, or 64-bit hashes of words), ``at`` (offsets of the
    texts in symbols), and the bytes of all symbols, of which a run of symbols is a slice."""

    x: np.ndarray
    at: np.ndarray
    raw: bytes
    first: np.ndarray | None = None
    end: np.ndarray | None = None

    def slices(self, a: np.ndarray, z: np.ndarray) -> list[bytes]:
        if self.first is not None:
            a, z = self.first[a], self.end[z - 1]
        return [self.raw[i:j] for i, j in zip(a.tolist(), z.tolist(), strict=True)]


@dataclass(frozen=True)
class Kind:
    """``split`` makes a Piece of bytes and row offsets, ``ids`` exact symbols of segments (equal
    symbols, equal numbers), ``index`` marks the repeated windows of a shard, ``window`` is the
    window at a place of a segment as a column."""

    size: int
    gram: int
    split: Callable[[np.ndarray, np.ndarray], Piece]
    ids: Callable[[list[bytes]], list[np.ndarray]]
    index: Callable[[list[np.ndarray], int], list[np.ndarray]]
    window: Callable[[Column, Column, int], Column]


def grams(x: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """Hashes of all ``k`` consecutive symbols, ``k`` a power of two."""
    start = np.uint64(seed * 0x9E3779B97F4A7C15 % 2**64)
    h = mix64(np.arange(256, dtype=np.uint64) + start)[x] if x.dtype == np.uint8 else mix64(x.astype(np.uint64) + start)
    step = 1
    while step < k:
        h = h[:-step] * np.uint64(0xD6E8FEB86659FD93) + h[step:]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xFF51AFD7ED558CCD)
        step *= 2
    return h


def minima(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` consecutive values."""
    step = 1
    while 2 * step <= width:
        x = np.minimum(x[:-step], x[step:])
        step *= 2
    rest = width - step
    return np.minimum(x[:-rest], x[rest:]) if rest else x


def runs(x: np.ndarray, offsets: np.ndarray, size: int, gram: int) -> tuple[np.ndarray, ...]:
    """Of consecutive windows with one anchor: row, first window (from the row's start), number
    of windows, hash of the anchor, place of the anchor from the first window."""
    none = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.int64))
    if len(x) < size:
        return none
    if len(x) > BLOCK + size:  # blocks that share size - 1 symbols: every window is in one
        found = []
        for start in range(0, len(x) - size + 1, BLOCK):
            end = min(len(x), start + BLOCK + size - 1)
            row = int(np.searchsorted(offsets, start, "right")) - 1
            last = int(np.searchsorted(offsets, end, "left"))
            cut = np.clip(offsets[row : last + 1], start, end) - start
            r, p, n, h, off = runs(x[start:end], cut, size, gram)
            found.append((r + row, p + np.where(r == 0, start - offsets[row], 0), n, h, off))
        return tuple(np.concatenate(c) for c in zip(*found, strict=True))
    h = grams(x, gram)
    low = np.uint64((1 << PLACE_BITS) - 1)
    least = minima((h & ~low) | np.arange(len(h), dtype=np.uint64), size - gram + 1)
    ends = np.repeat(offsets[1:], np.diff(offsets))[: len(least)]
    at = np.flatnonzero(np.arange(len(least)) + size <= ends)
    if not len(at):
        return none
    anchor = (least[at] & low).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1)]))
    start = at[first]
    row = np.searchsorted(offsets, start, "right") - 1
    return row, start - offsets[row], np.diff(np.append(first, len(at))), h[anchor[first]], anchor[first] - start


def _anchors(kind: Kind):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, end, data, offsets in byte_pieces(b.column("text"), PIECE):
                piece = kind.split(data, offsets)
                row, start, n, h, off = runs(piece.x, piece.at, kind.size, kind.gram)
                own = b.column("key").slice(first, end - first)
                yield pa.RecordBatch.from_arrays([own.take(pa.array(row)), pa.array(h.view(np.int64)), *(pa.array(c.astype(np.int32)) for c in (start, n, off))], names=["key", "h", "start", "n", "off"])

    return run


def _segments(kind: Kind):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, end, data, offsets in byte_pieces(b.column("text"), PIECE):
                piece = kind.split(data, offsets)
                places = b.column("places").slice(first, end - first)
                flat, per = places.flatten(), np.diff(places.offsets.to_numpy())
                row = np.repeat(np.arange(end - first), per)
                start, n = flat.field("start").to_numpy(), flat.field("n").to_numpy()
                own = b.column("key").slice(first, end - first)
                for k in range(0, len(row), 2048):
                    part = slice(k, min(k + 2048, len(row)))
                    a = piece.at[row[part]] + start[part]
                    seg = piece.slices(a, a + n[part] + kind.size - 1)
                    sid = [hashlib.blake2b(s, digest_size=16).digest() for s in seg]
                    cut = flat.slice(k, len(seg))
                    yield pa.RecordBatch.from_arrays(
                        [own.take(pa.array(row[part])), *(cut.field(c) for c in ("start", "h", "times", "off")), pa.array(sid, pa.binary()), pa.array(seg, pa.binary())],
                        names=["key", "start", "h", "times", "off", "sid", "seg"],
                    )

    return run


def spans(marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    d = np.diff(np.concatenate([[0], marks.astype(np.int8), [0]]))
    return np.flatnonzero(d == 1), np.flatnonzero(d == -1)


_FOUND = "sid binary, starts array<int>, stops array<int>"
_OPEN = ", h long, part int, shard long, prints binary, owners array<binary>, places array<int>"
_PRINT = [("a", "<u8"), ("b", "<u8")]


def fingerprints(x: np.ndarray, size: int) -> np.ndarray:
    """128 bits of every window of ``x``, as one value to sort and search by."""
    k = 1 << (size.bit_length() - 1)
    out = np.empty(max(0, len(x) - size + 1), _PRINT)
    for f, seed in (("a", 1), ("b", 2)):
        g = grams(x, k, seed)
        out[f] = mix64(g[: len(out)] * np.uint64(0x9FB21C651E98DF25) ^ g[size - k : size - k + len(out)])
    return out


def half_keys(parts: list[np.ndarray], offs: np.ndarray, anchors: np.ndarray, size: int, gram: int) -> np.ndarray:
    """Which segments may share a window with another one. A window reaches at least half of its
    other symbols to the left or to the right of its anchor (at ``offs``), so equal windows have
    an equal left or an equal right half, anchor included; a segment with neither half
    elsewhere has no repeated window."""
    lengths = np.array([len(p) for p in parts])
    starts = np.cumsum(lengths) - lengths
    x = np.concatenate(parts)
    keep = np.zeros(len(parts), bool)
    left, right = (size - gram + 1) // 2, size - gram + 1 - (size - gram + 1) // 2
    for reach, begin, inside in ((left, offs - left, offs >= left), (right, offs, offs + gram + right <= lengths)):
        n = reach + gram
        k = 1 << (n.bit_length() - 1)
        who = np.flatnonzero(inside)
        if not len(who):
            continue
        b = starts[who] + begin[who]
        g = grams(x, k)
        key = mix64(g[b] * np.uint64(0x9FB21C651E98DF25) ^ g[b + n - k]) ^ mix64(anchors[who])
        _, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
        keep[who[count[inverse] > 1]] = True
    return keep


def _shard(kind: Kind, limit: int):
    """Index the segments of a shard; mark repeated windows. Segments whose anchor, or both of
    whose halves, are in no other segment here need no index."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("sid")
        sid, seg, h = table.column("sid").to_pylist(), table.column("seg").to_pylist(), table.column("h").to_numpy()
        copies, times, offs = (table.column(c).to_numpy() for c in ("copies", "times", "off"))
        _, inverse, count = np.unique(h, return_inverse=True, return_counts=True)
        hot = times > limit
        seen = np.flatnonzero((count[inverse] > 1) | (copies > 1) | hot)
        ids = dict(zip(seen.tolist(), kind.ids([seg[k] for k in seen.tolist()]), strict=True))
        marks: dict[int, np.ndarray] = {k: np.full(len(ids[k]) - kind.size + 1, copies[k] > 1) for k in seen.tolist()}
        chosen = np.flatnonzero(count[inverse] > 1)
        if len(chosen):
            chosen = chosen[half_keys([ids[k] for k in chosen.tolist()], offs[chosen], h[chosen].view(np.uint64), kind.size, kind.gram)]
        if len(chosen):
            for k, m in zip(chosen.tolist(), kind.index([ids[k] for k in chosen.tolist()], kind.size), strict=True):
                marks[k] |= m
        out = []
        for k, m in marks.items():
            if m.any():
                a, z = spans(m)
                out.append((sid[k], a.tolist(), z.tolist(), *[None] * 6))
        shard = table.column("shard")[0].as_py()
        for anchor in np.unique(h[hot]).tolist():
            members = np.flatnonzero(h == anchor).tolist()
            out += _open(kind, -(-int(times[members[0]]) // limit), anchor, shard, [sid[k] for k in members], [seg[k] for k in members])
        kinds = [pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.list_(pa.binary()), pa.list_(pa.int32())]
        names = ["sid", "starts", "stops", "h", "part", "shard", "prints", "owners", "places"]
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * len(names), kinds, strict=True)], names=names)

    return run


def _open(kind: Kind, n_parts: int, anchor: int, shard: int, sid: list[bytes], seg: list[bytes]) -> list[tuple]:
    """The distinct windows of one anchor in one of its shards, sorted and cut into ranges, each
    with the first segment that has it and its place there."""
    found = [fingerprints(kind.split(np.frombuffer(s, np.uint8), np.array([0, len(s)])).x, kind.size) for s in seg]
    owner = np.repeat(np.arange(len(found)), [len(f) for f in found])
    place = np.concatenate([np.arange(len(f)) for f in found])
    f = np.concatenate(found)
    order = np.lexsort((f["b"], f["a"]))
    f, owner, place = f[order], owner[order], place[order]
    keep = np.concatenate([[True], f[1:] != f[:-1]])
    f, owner, place = f[keep], owner[keep], place[keep]
    part = (f["a"] >> np.uint64(32)) * np.uint64(n_parts) >> np.uint64(32)
    edges = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]])).tolist()
    return [(None, None, None, anchor, int(part[a]), shard, f[a:z].tobytes(), [sid[k] for k in owner[a:z].tolist()], place[a:z].tolist()) for a, z in zip(edges[:-1], edges[1:], strict=True)]


def merge_sorted(parts: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each sorted list of distinct prints: which of them another list holds too, and where
    the first equal print stands (counted over all lists)."""
    both = np.concatenate(parts)
    order = np.lexsort((both["b"], both["a"]))
    a, b = both["a"][order], both["b"][order]
    heads = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
    size = np.zeros(len(a), np.int64)
    size[heads] = np.diff(np.append(heads, len(a)))
    out = []
    for f in parts:
        lo = np.searchsorted(a, f["a"], "left")
        while (other := b[lo] != f["b"]).any():  # equal first halves: step on to the second
            lo[other] += 1
        out.append((size[lo] > 1, order[lo]))
    return out


def _merge(table: pa.Table) -> pa.Table:
    """(sid, place, lsid, lplace): windows with the same print as the first one of all shards."""
    table = table.sort_by("shard")
    parts = [np.frombuffer(p, _PRINT) for p in table.column("prints").to_pylist()]
    owners = [o for row in table.column("owners").to_pylist() for o in row]
    places = np.concatenate([np.array(row, np.int32) for row in table.column("places").to_pylist()])
    at, who, leader = 0, [], []
    for f, (found, first) in zip(parts, merge_sorted(parts), strict=True):
        k = np.flatnonzero(found & (first != at + np.arange(len(f))))
        who.append(at + k)
        leader.append(first[k])
        at += len(f)
    w, d = np.concatenate(who), np.concatenate(leader)
    return pa.table([pa.array([owners[k] for k in w.tolist()], pa.binary()), pa.array(places[w]), pa.array([owners[k] for k in d.tolist()], pa.binary()), pa.array(places[d])], names=["sid", "place", "lsid", "lplace"])


def keyed(docs: DataFrame) -> DataFrame:
    """(row: all columns of ``docs``, text, key): null text is empty, the key is its digest."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.struct(*docs.columns).alias("row"), text.alias("text"), F.unhex(F.md5(text)).alias("key"))


def distinct_texts(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(copied, texts). copied: keys of texts that several rows hold; texts: (key, text), each
    once. Rows of one digest are grouped by their text, so copies are equal byte by byte."""
    n = rows.count()
    several = written(rows.groupBy("key").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1").select("key"), "several", rows=n)
    name = F.hex("key").alias("k_")
    same = rows.select("key", "text", name).join(bounded(several.select(name), 40), "k_", "left_semi").groupBy("key", "text").agg(F.count(F.lit(1)).alias("copies"))
    same = written(same, "copied", rows=20 * several.count())
    if same.count() != several.count():
        raise RuntimeError("two different texts have one digest")
    single = rows.select("key", "text").join(bounded(several, 24), "key", "left_anti")
    return several, single.unionByName(same.select("key", "text"))


def repeated_windows(rows: DataFrame, kind: Kind, limit: int = LIMIT) -> tuple[DataFrame, DataFrame]:
    """(copied, covered) of ``keyed`` rows. copied: keys of texts of several rows. covered: (key,
    windows array<struct<start, stop>>): first windows and ends of runs of repeated windows."""
    copied, texts = distinct_texts(rows)
    places = written(arrow_rows(texts, _anchors(kind), "key binary, h long, start int, n int, off int"), "places")
    times = places.groupBy("h").agg(F.count(F.lit(1)).alias("times")).where("times > 1")
    by_text = written(split_join(places, times, "h").groupBy("key").agg(F.collect_list(F.struct("start", "h", "times", "off", "n")).alias("places")), "again")
    wanted = bounded(by_text.select("key"), 24, otherwise=None)
    chosen = texts if wanted is None else texts.join(wanted, "key", "left_semi")
    segments = written(arrow_rows(chosen.join(by_text, "key"), _segments(kind), "key binary, start int, h long, times long, off int, sid binary, seg binary"), "segments")
    distinct, mean = segments.agg(F.approx_count_distinct("sid"), F.avg(F.length("seg"))).first()
    n = max(1, -(-int(distinct * (mean or 0)) // SHARD_BYTES))
    each = segments.groupBy("sid", "h", "times", "off", "seg").agg(F.count(F.lit(1)).alias("copies"))
    salted = F.xxhash64("h", F.pmod(F.xxhash64("sid"), F.ceil(F.col("times") / limit)))
    dealt = each.withColumn("shard", F.when(F.col("times") <= limit, F.pmod("h", F.lit(n))).otherwise(n + F.pmod(salted, F.lit(n))))
    indexed = written(arrow_groups(dealt, "shard", _shard(kind, limit), _FOUND + _OPEN), "indexed")
    found = indexed.where("sid IS NOT NULL").select("sid", "starts", "stops").unionByName(_merged(indexed, segments, kind, limit))
    hits = segments.select("sid", "key", "start").join(found, "sid")
    shifted = F.transform("starts", lambda a, i: F.struct((a + F.col("start")).alias("start"), (F.get("stops", i) + F.col("start")).alias("stop")))
    return copied, hits.groupBy("key").agg(F.flatten(F.collect_list(shifted)).alias("windows"))


def _merged(indexed: DataFrame, segments: DataFrame, kind: Kind, limit: int) -> DataFrame:
    """Windows of hot anchors that two shards hold, compared symbol by symbol."""
    opened = indexed.where("sid IS NULL").withColumn("g", F.xxhash64("h", "part"))
    pairs = arrow_groups(opened, "g", _merge, "sid binary, place int, lsid binary, lplace int")
    shift = F.col("place") - F.col("lplace")
    lines = pairs.groupBy("sid", "lsid", shift.alias("shift")).agg(F.array_sort(F.collect_set("place")).alias("places"))
    segs = segments.where(F.col("times") > limit).select("sid", "seg").dropDuplicates(["sid"])
    both = lines.join(segs, "sid").join(segs.select(F.col("sid").alias("lsid"), F.col("seg").alias("lseg")), "lsid")
    equal = F.forall("places", lambda p: kind.window(F.col("seg"), p, kind.size) == kind.window(F.col("lseg"), p - F.col("shift"), kind.size))
    sure = both.select("sid", "lsid", "shift", F.when(equal, F.col("places")).otherwise(F.raise_error(F.lit("two different windows have one print"))).alias("starts"))
    sides = sure.select("sid", "starts").unionByName(sure.select(F.col("lsid").alias("sid"), F.transform("starts", lambda p: p - F.col("shift")).alias("starts")))
    return sides.withColumn("stops", F.transform("starts", lambda p: p + 1))


def removed(docs: DataFrame, kind: Kind, keep: Callable, limit: int = LIMIT) -> DataFrame:
    """Per row of ``docs``: row (its columns) and what is left of its text without repeated
    windows: n_symbols, n_removed, n_spans, kept_sha256 and, where anything was removed, kept.
    ``keep(data, offsets, cover)`` gives these for a piece, where ``cover(offsets in symbols)``
    tells which symbols go."""
    rows = keyed(docs)
    copied, covered = repeated_windows(rows, kind, limit)
    covered = written(covered.join(bounded(copied, 24), "key", "left_anti"), "covered", rows=4 * rows.count())
    none = F.lit(None).cast("array<struct<start:int,stop:int>>")
    marked = rows.join(bounded(copied.withColumn("copied", F.lit(True)), 24), "key", "left").withColumn("copied", F.coalesce("copied", F.lit(False)))
    keys = bounded(covered.select("key"), 24, otherwise=None)
    if keys is None:
        joined = marked.join(covered, "key", "left")
    else:
        whole = marked.join(keys, "key", "left_anti").withColumn("windows", none)
        joined = whole.unionByName(marked.join(keys, "key", "left_semi").join(covered, "key"))
    joined = joined.select("row", "text", "copied", "windows")
    names = ["row", "n_symbols", "n_removed", "n_spans", "kept_sha256", "kept"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, end, data, offsets in byte_pieces(b.column("text"), PIECE):
                own = b.slice(first, end - first)
                out = keep(data, offsets, lambda at, own=own: covered_symbols(at, kind.size, own.column("copied"), own.column("windows")))
                yield pa.RecordBatch.from_arrays([own.column("row"), *out], names=names)

    fields = [T.StructField(c, T.LongType()) for c in names[1:4]] + [T.StructField(c, T.StringType()) for c in names[4:]]
    return arrow_rows(joined, run, T.StructType([rows.schema["row"], *fields]))


def replaced(docs: DataFrame, kind: Kind, keep: Callable, limit: int = LIMIT) -> DataFrame:
    """``docs`` (text, other columns) with the kept text where anything was removed."""
    out = removed(docs, kind, keep, limit)
    return out.select(*(F.coalesce("kept", "row.text").alias(c) if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns))


def covered_symbols(at: np.ndarray, size: int, copied: pa.Array, windows: pa.ListArray) -> np.ndarray:
    """Which symbols of some texts (offsets ``at``) a repeated window covers; a copied text goes
    whole if it has a window."""
    per = np.diff(at)
    edge = np.zeros(int(at[-1]) + 1, np.int64)
    flat = windows.flatten()
    if len(flat):
        counts = windows.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        base = np.repeat(at[:-1], counts)
        edge += np.bincount(base + flat.field("start").to_numpy(), minlength=len(edge))
        edge -= np.bincount(base + flat.field("stop").to_numpy() + size - 1, minlength=len(edge))
    return (np.cumsum(edge[:-1]) > 0) | np.repeat(copied.to_numpy(zero_copy_only=False) & (per >= size), per)
