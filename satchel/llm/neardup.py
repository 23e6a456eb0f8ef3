"""MinHash near-dedup with odd sketches.

A document's set is its distinct word shingles (``width`` words, A-Z lower-cased; a shorter
text is one shingle), as 64-bit hashes of the shingles' words. Equal sets are one class. A
class has SAMPLES MinHash values; BANDS groups of them are hashed, and classes that share a
band are candidates: a pair of similarity 0.8 shares none with a chance of three in a
million. All samples are folded into an odd sketch, a bitmap in which each sample flips one
bit; the population count of the XOR of two sketches estimates their similarity far above
chance, and candidates estimated under LOWEST (five deviations below 0.8) are let go. What
remains linked by estimates are clusters; inside each, links are confirmed on the full sets,
and components of the confirmed links are the result.

Buckets of more than ``block`` classes are split into blocks; every pair of blocks is a
task's group, so each pair of a bucket is compared somewhere, but a group only hands on a
spanning forest of its links, never all pairs. Clusters whose sets fit in BLOCK_BYTES are
confirmed in one group. In larger ones the links of the estimates are confirmed first, one
by one, which is linear; only where they leave a cluster in several parts are its sets
compared in pairs of blocks of BLOCK_BYTES. Groups are packed by bytes.

Null and empty texts have no shingles, link to nothing and are kept. doc_ids need not be
unique: classes have numbers of their own, and a component's id is the least doc_id of its
rows; a null doc_id is the least long. Repeated rows and equal texts are linked;
``kept_documents`` keeps one row of each component, of rows repeated under one doc_id too.
Columns of any name pass through it; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from satchel.llm.components import components
from satchel.llm.fmdedup import words_as_symbols
from satchel.llm.shared import arrow_groups, arrow_rows, bounded, byte_pieces, mix64, written

ROWS, BANDS = 5, 32
SAMPLES = ROWS * BANDS
SKETCH_BITS = 1024
LOWEST = 0.64
PERCENT = 80
BLOCK = 2048
#: Bytes of sets that are confirmed side by side, and of small groups that share a task's call.
BLOCK_BYTES = 8 << 20
PACK_BYTES = 1 << 20
PIECE = 1 << 18
#: Lower case for the bytes of A-Z alone.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_SEED = mix64(np.arange(1, SAMPLES + 1, dtype=np.uint64))
_XOR, _TIMES = _SEED.astype(np.uint32), (_SEED >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
#: Different bits of two sketches at most, for an estimate of LOWEST at least.
MOST_DIFFERENT = int(SKETCH_BITS / 2 * (1 - np.exp(-2 * (1 - LOWEST) * 2 * SAMPLES / SKETCH_BITS)))


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of every row."""
    x, at, _, _ = words_as_symbols(LOWER[data], offsets)
    h = mix64(x)
    for k in range(1, width):
        h = mix64(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + x[k:]) if len(h) > 1 else h[:0]
    out = []
    for a, z in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if z - a >= width:
            own = np.sort(h[a : z - width + 1])
            out.append(own[np.concatenate([[True], own[1:] != own[:-1]])])
        elif z > a:
            whole = np.uint64(z - a)
            one = np.array([whole])
            for v in x[a:z]:
                one = mix64(one * np.uint64(0xD6E8FEB86659FD93) + v)
            out.append(one)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signatures(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Of non-empty sets: band hashes (rows x BANDS) and odd sketches (rows x bytes)."""
    x = (mix64(np.concatenate(sets)) >> np.uint64(32)).astype(np.uint32)
    lengths = np.array([len(s) for s in sets])
    starts = np.cumsum(lengths) - lengths
    least = np.empty((SAMPLES, len(sets)), np.uint32)
    for k in range(SAMPLES):
        least[k] = np.minimum.reduceat((x ^ _XOR[k]) * _TIMES[k], starts)
    bands = np.empty((len(sets), BANDS), np.int64)
    for b in range(BANDS):
        h = np.full(len(sets), b + 1, np.uint64)
        for k in range(b * ROWS, (b + 1) * ROWS):
            h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + least[k])
        bands[:, b] = h.view(np.int64)
    bit = mix64(least.astype(np.uint64) | np.arange(1, SAMPLES + 1, dtype=np.uint64)[:, None] << np.uint64(32)) % np.uint64(SKETCH_BITS)
    flips = np.zeros((len(sets), SKETCH_BITS), np.uint8)
    for k in range(SAMPLES):
        flips[np.arange(len(sets)), bit[k].astype(np.int64)] ^= 1
    return bands, np.packbits(flips, axis=1)


def _described(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, len(b), 1024):
                part = b.slice(k, 1024)
                for first, end, data, offsets in byte_pieces(part.column("text"), PIECE):
                    sets = shingle_sets(data, offsets, width)
                    some = [k for k, s in enumerate(sets) if len(s)]
                    bands: list = [None] * len(sets)
                    sketch, digest = list(bands), list(bands)
                    if some:
                        for k, v, w in zip(some, *signatures([sets[k] for k in some]), strict=True):
                            bands[k], sketch[k], digest[k] = v, w.tobytes(), hashlib.blake2b(sets[k].tobytes(), digest_size=16).digest()
                    own = part.slice(first, end - first)
                    yield pa.RecordBatch.from_arrays(
                        [own.column("doc_id"), own.column("th"), pa.array([len(s) for s in sets], pa.int64()), pa.array(digest, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(sketch, pa.binary())],
                        names=["doc_id", "th", "n_shingles", "digest", "bands", "sketch"],
                    )

    return run


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, end, data, offsets in byte_pieces(b.column("text"), PIECE):
                own = b.slice(first, end - first)
                yield pa.RecordBatch.from_arrays([own.column("node"), own.column("cluster"), pa.array([s.tobytes() for s in shingle_sets(data, offsets, width)], pa.binary())], names=["node", "cluster", "value"])

    return run


def forest(n: int, linked: Callable[[int, np.ndarray], np.ndarray]) -> list[tuple[int, int]]:
    """A spanning forest of ``n`` members: ``linked(k, others)`` tells which of the others k is
    linked with; members reached are not compared with each other again."""
    left, out = np.arange(n), []
    while len(left):
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            k = queue.pop()
            found = linked(k, left)
            if found.any():
                reached = left[found].tolist()
                out += [(k, r) for r in reached]
                queue += reached
                left = left[~found]
    return out


def by_sketch(values: list[bytes]) -> list[tuple[int, int]]:
    x = np.frombuffer(b"".join(values), np.uint64).reshape(len(values), -1)
    return forest(len(values), lambda k, others: np.bitwise_count(x[k] ^ x[others]).sum(1, dtype=np.int64) <= MOST_DIFFERENT)


def by_set(values: list[bytes]) -> list[tuple[int, int]]:
    sets = [np.frombuffer(v, np.uint64) for v in values]
    n = np.array([len(s) for s in sets])
    if len(sets) == 2:
        both = len(np.intersect1d(*sets, assume_unique=True))
        return [(0, 1)] if 100 * both >= PERCENT * (n.sum() - both) else []
    unique, ids = np.unique(np.concatenate(sets), return_inverse=True)
    at = np.concatenate([[0], np.cumsum(n)])
    flag = np.zeros(len(unique), bool)
    now: dict = {"others": None}

    def linked(k: int, others: np.ndarray) -> np.ndarray:
        # the sets of the members that were left when they were last put side by side
        if now["others"] is None or len(others) < 0.7 * len(now["others"]):
            now["others"] = others
            now["ids"] = np.concatenate([ids[at[o] : at[o + 1]] for o in others.tolist()])
            now["at"] = np.cumsum(n[others]) - n[others]
        flag[ids[at[k] : at[k + 1]]] = True
        both = np.add.reduceat(flag[now["ids"]].astype(np.int32), now["at"])
        flag[ids[at[k] : at[k + 1]]] = False
        both = both[np.searchsorted(now["others"], others)]
        return 100 * both >= PERCENT * (n[k] + n[others] - both)

    return forest(len(sets), linked)


def _links(compare: Callable[[list[bytes]], list[tuple[int, int]]]):
    def run(table: pa.Table) -> pa.Table:
        group, node = table.column("g").to_numpy(), table.column("node").to_numpy()
        order = np.argsort(group, kind="stable")
        group, node = group[order], node[order]
        value = table.column("value").take(pa.array(order)).to_pylist()
        edge = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1], [True]])).tolist()
        a, b = [], []
        for i, j in zip(edge[:-1], edge[1:], strict=True):
            for k, m in compare(value[i:j]) if j - i > 1 else ():
                a.append(node[i + k])
                b.append(node[i + m])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def links(members: DataFrame, group: str, blocks: Column, width: Column | int, compare: Callable) -> DataFrame:
    """Forests of links inside each ``group`` of ``members`` (group, node, value), which is split
    into ``blocks``; ``width`` is the size of a value in bytes."""
    n = F.greatest(blocks.cast("int"), F.lit(1))
    paired = members.withColumn("own", F.pmod(F.xxhash64("node"), n).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), n - 1)))
    dealt = paired.select(F.xxhash64(group, F.least("own", "other"), F.greatest("own", "other")).alias("g"), "node", "value")
    size = members.agg(F.sum(n * (F.lit(width) if isinstance(width, int) else width))).first()[0] or 0
    packs = max(1, -(-int(size) // PACK_BYTES))
    return arrow_groups(dealt.withColumn("pack", F.pmod(F.xxhash64(F.lit(7), "g"), F.lit(packs))), "pack", _links(compare), "a long, b long").distinct()


def _confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        good = [bool(by_set([x.as_py(), y.as_py()])) for x, y in zip(b.column("x"), b.column("y"), strict=True)]
        yield b.select(["a", "b"]).filter(pa.array(good, pa.bool_()))


def confirmed(estimated: DataFrame, clusters: DataFrame, sets: DataFrame, block_bytes: int) -> DataFrame:
    """Links (a, b) of ``clusters`` (node, cluster) that hold on the full ``sets`` (node, cluster,
    value); ``estimated`` are the links (a, b) by which the clusters were found."""
    n = sets.count()
    sizes = written(sets.groupBy("cluster").agg(F.sum(F.length("value")).alias("bytes")), "cluster_sizes", rows=n)
    small = sizes.where(F.col("bytes") <= block_bytes).select("cluster")
    found = links(sets.join(small, "cluster"), "cluster", F.lit(1), F.length("value"), by_set)
    large = sizes.where(F.col("bytes") > block_bytes)
    if large.isEmpty():
        return found
    inside = sets.join(large.select("cluster"), "cluster", "left_semi")
    ends = estimated.join(clusters.join(large.select("cluster"), "cluster", "left_semi").select(F.col("node").alias("a")), "a", "left_semi")
    pairs = ends.join(inside.select(F.col("node").alias("a"), F.col("value").alias("x")), "a").join(inside.select(F.col("node").alias("b"), F.col("value").alias("y")), "b")
    sure = written(arrow_rows(pairs.select("a", "b", "x", "y"), _confirmed, "a long, b long"), "confirmed", rows=estimated.count())
    part = components(sure)
    parts = inside.select("node", "cluster").join(part, "node", "left").withColumn("part", F.coalesce("component", "node"))
    several = written(parts.groupBy("cluster").agg(F.min("part").alias("p"), F.max("part").alias("q")).where("p <> q").select("cluster").join(large, "cluster"), "open_clusters", rows=n)
    rest = links(inside.join(several, "cluster"), "cluster", F.ceil(F.col("bytes") / block_bytes), F.length("value"), by_set)
    return found.unionByName(sure).unionByName(rest)


def grouped(docs: DataFrame, width: int = 5, block: int = BLOCK, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per row of ``docs`` (doc_id long, text): doc_id, th (its text's hash), n_shingles and
    first, the least (doc_id, th) of its component; null without words."""
    rows = known(docs)
    each = written(arrow_rows(rows, _described(width), "doc_id long, th long, n_shingles long, digest binary, bands array<long>, sketch binary"), "signatures")
    distinct = each.where("digest IS NOT NULL").groupBy("digest", "bands", "sketch").agg(F.min(F.struct("doc_id", "th")).alias("r"))
    classes = written(distinct.select(F.monotonically_increasing_id().alias("node"), "digest", "bands", "sketch", "r"), "classes", rows=each.count())
    banded = classes.select("node", F.explode("bands").alias("band"))
    shared = banded.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    candidates = written(banded.join(shared, "band").join(classes.select("node", F.col("sketch").alias("value")), "node"), "candidates", rows=BANDS * classes.count())
    estimated = written(links(candidates, "band", F.ceil(F.col("n") / block), SKETCH_BITS // 8, by_sketch), "estimated", rows=candidates.count())
    n = 2 * estimated.count()
    tree = components(estimated)
    clusters = written(tree.select("node", F.col("component").alias("cluster")).unionByName(tree.select(F.col("component").alias("node"), F.col("component").alias("cluster")).distinct()), "members", rows=n)
    chosen = clusters.join(classes.select("node", F.col("r.doc_id").alias("doc_id"), F.col("r.th").alias("th")), "node")
    texts = rows.join(bounded(chosen, 48), ["doc_id", "th"]).select("node", "cluster", "text")
    sets = written(arrow_rows(texts, _sets(width), "node long, cluster long, value binary").dropDuplicates(["node", "cluster"]), "sets", rows=10 * n)
    found = components(written(confirmed(estimated, clusters, sets, block_bytes), "true_links", rows=n))
    of = classes.select("digest", "node", "r").join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    named = of.select("digest", "component").join(of.groupBy("component").agg(F.min("r").alias("first")), "component").select("digest", "first")
    return each.select("doc_id", "th", "n_shingles", "digest").join(named, "digest", "left").drop("digest")


def known(docs: DataFrame) -> DataFrame:
    """doc_id (null: the least long), text (null: empty) and th, its hash."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.coalesce("doc_id", F.lit(-(2**63))).alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("th"))


def near_duplicates(docs: DataFrame, width: int = 5, block: int = BLOCK, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per row of ``docs`` (doc_id long, text): doc_id, n_shingles and component_id, the least
    doc_id of its component."""
    return grouped(docs, width, block, block_bytes).select("doc_id", "n_shingles", F.coalesce("first.doc_id", "doc_id").alias("component_id"))


def kept_documents(docs: DataFrame, width: int = 5) -> DataFrame:
    """One row of ``docs`` (doc_id, text, other columns) of each component; all rows without words."""
    names = F.struct(*docs.columns).alias("row")
    rows = docs.select(names, F.coalesce("doc_id", F.lit(-(2**63))).alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"))
    told = written(grouped(docs.select("doc_id", "text"), width).where("first IS NOT NULL").groupBy("doc_id", "th").agg(F.first("first").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1 OR first.doc_id <> doc_id OR first.th <> th"), "told")
    own = (F.col("first.doc_id") == F.col("doc_id")) & (F.col("first.th") == F.col("th"))
    single = rows.join(bounded(told.select("doc_id", "th"), 32), ["doc_id", "th"], "left_anti")
    repeated = rows.join(bounded(told.where(own).select("doc_id", "th"), 32), ["doc_id", "th"], "left_semi").groupBy("doc_id", "th").agg(F.first("row").alias("row"))
    return single.select("row").unionByName(repeated.select("row")).select(*(F.col("row").getField(c).alias(c) for c in docs.columns))


def near_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9: all documents, four words."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicates(docs, width=4).withColumn("kept", F.col("doc_id") == F.col("component_id"))
