"""Hard negatives by Fagin's threshold algorithm.

Each component x of a vector becomes floor(scale * x), and a row's score for an anchor is the
integer inner product of the two. An anchor's positives are its first ``positives`` other
rows of its label; a positive's window are the scores from ``percent`` of the positive's to
the positive's, and its negatives are the first ``negatives`` rows of other labels in there.
Higher scores come first, ties by smaller id.

Candidate rows are dealt by ranges of (label, id) to lists of LIST_BYTES: a matrix of integers
and, per dimension, the order of its rows. Anchors come in chunks of CHUNK rows, which are
broadcast in parts of bounded size; every list meets every chunk whose labels it may answer.
For one anchor, the lists of all dimensions are read in step, each from its high end where
the anchor's component is positive and from its low end where it is negative (a component of
zero needs no list). Rows seen for the first time are scored whole (random access). The sum
of what the lists hold at the depth reached, times the anchor's components, is the threshold:
no row unseen scores more. A list is left when the threshold falls strictly below each
window's last score, once the window is full, or below the window. Depths double, so a step
reads as much as all before it. A task carries the windows of its chunks from list to list,
so later lists stop sooner; what tasks find is merged by ranking.

Rows with a null id, label or vector, or with a null or non-finite component, take no part.
Vectors of unequal length count as followed by zeros; an empty vector scores 0. Rows that
share the anchor's id aren't "other" rows. Rows of one id with the same score count once;
anchors of one id and different vectors are answered each. A window of a negative positive
score is empty. Scores beyond a long are cut to its ends. An anchor without positives, or a
positive whose window is empty, has no rows; empty tables give none. Other columns, of any
name, are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from satchel.llm.shared import arrow_rows, written
from satchel.session import in_blocks

SCALE, PERCENT, POSITIVES, NEGATIVES = 256, 80, 5, 5
#: Bytes of a list's matrix as 64-bit floats, and anchors of a chunk.
LIST_BYTES, CHUNK = 4 << 20, 512
#: Entries of each dimension's list that are read first.
DEPTH = 16
LEAST, MOST = -(2**63), 2**63 - 1
PACKED = "low long, high long, dims int, ids binary, labels binary, x binary, order binary"


def matrix_of(vectors: pa.Array, scale: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """(places of rows whose components are all there and finite, their integers as floats)."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    there = np.flatnonzero(vectors.is_valid().to_numpy(zero_copy_only=False))
    rows = vectors.take(pa.array(there))
    flat = rows.flatten()
    x = flat.fill_null(np.nan).to_numpy(zero_copy_only=False).astype(np.float64) if flat.null_count else flat.to_numpy(zero_copy_only=False).astype(np.float64)
    at = np.concatenate([[0], np.cumsum(rows.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))])
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(x))])
    good = np.flatnonzero(bad[at[1:]] == bad[at[:-1]])
    with np.errstate(invalid="ignore"):
        x = np.floor(scale * x)
    return there[good], [x[at[k] : at[k + 1]] for k in good.tolist()]


def padded(vectors: list[np.ndarray], dims: int) -> np.ndarray:
    out = np.zeros((len(vectors), dims))
    for k, v in enumerate(vectors):
        out[k, : len(v)] = v
    return out


def _packed(scale: int, most_rows: int, most_bytes: int, lists: bool):
    """Rows (id, label, vector) of a partition, sorted by label, into rows of PACKED, of at most
    so many rows and bytes each; ``order`` sorts each dimension of a list."""

    def pack(ids: list, labels: list, vectors: list) -> pa.RecordBatch:
        x = padded(vectors, max(map(len, vectors)))
        order = np.argsort(x.T, axis=1, kind="stable").astype("<i4").tobytes() if lists else b""
        cells = [min(labels), max(labels), x.shape[1], np.array(ids, "<i8").tobytes(), np.array(labels, "<i8").tobytes(), x.astype("<f8").tobytes(), order]
        return pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(cells, [pa.int64(), pa.int64(), pa.int32(), *[pa.binary()] * 4], strict=True)], names=["low", "high", "dims", "ids", "labels", "x", "order"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, labels, vectors, dims = [], [], [], 0
        for b in batches:
            rows, found = matrix_of(b.column("vector"), scale)
            for i, label, v in zip(b.column("id").take(pa.array(rows)).to_pylist(), b.column("label").take(pa.array(rows)).to_pylist(), found, strict=True):
                if ids and (len(ids) == most_rows or 8 * max(dims, len(v)) * (len(ids) + 1) > most_bytes):
                    yield pack(ids, labels, vectors)
                    ids, labels, vectors, dims = [], [], [], 0
                ids.append(i)
                labels.append(label)
                vectors.append(v)
                dims = max(dims, len(v))
        if ids:
            yield pack(ids, labels, vectors)

    return run


def scores(x: np.ndarray, a: np.ndarray, exact: bool) -> np.ndarray:
    """Integer inner products of the rows of ``x`` with ``a``; in floats where they are exact."""
    if exact:
        return (x @ a).astype(np.int64)
    big = [int(v) for v in a]
    return np.array([min(MOST, max(LEAST, sum(int(u) * v for u, v in zip(row, big, strict=True)))) for row in x.tolist()], np.int64)


@dataclass
class Windows:
    """Scores from ``low`` to ``high`` and the best rows found in there so far."""

    low: np.ndarray
    high: np.ndarray
    score: list[np.ndarray]
    row: list[np.ndarray]

    @staticmethod
    def of(low: np.ndarray, high: np.ndarray) -> Windows:
        none = [np.zeros(0, np.int64)] * len(low)
        return Windows(low, high, list(none), list(none))

    def take(self, s: np.ndarray, ids: np.ndarray, k: int) -> None:
        """Rows of ``ids`` with scores ``s`` enter the windows they fit; each keeps its first ``k``."""
        for w in range(len(self.low)):
            fit = (s >= max(self.low[w], self.least(w, k))) & (s <= self.high[w])
            if fit.any():
                both, rows = np.concatenate([self.score[w], s[fit]]), np.concatenate([self.row[w], ids[fit]])
                first = np.lexsort((rows, ~both))
                both, rows = both[first], rows[first]
                new = np.concatenate([[True], (both[1:] != both[:-1]) | (rows[1:] != rows[:-1])])
                self.score[w], self.row[w] = both[new][:k], rows[new][:k]

    def least(self, w: int, k: int) -> int:
        """The score that a row must have to enter window ``w``."""
        return int(self.score[w][-1]) if len(self.score[w]) == k else int(self.low[w])

    def done(self, threshold: float, k: int) -> bool:
        """Whether rows of at most ``threshold`` can't enter any window."""
        return all(self.low[w] > self.high[w] or threshold < self.least(w, k) for w in range(len(self.low)))


def threshold_algorithm(x: np.ndarray, order: np.ndarray, ids: np.ndarray, allowed: np.ndarray, a: np.ndarray, found: Windows, k: int, exact: bool, depth: int = DEPTH) -> int:
    """Let ``found`` take what rows ``x`` (``allowed``: a mask) hold for anchor ``a``; gives the
    depth at which the lists were left."""
    up, down = np.flatnonzero(a < 0), np.flatnonzero(a > 0)
    n, seen, done = len(x), np.zeros(len(x), bool), 0
    if not len(up) and not len(down):
        found.take(np.zeros(int(allowed.sum()), np.int64), ids[allowed], k)
        return n
    while done < n:
        end = min(n, max(depth, 2 * done))
        now = np.zeros(n, bool)
        now[order[up, done:end].ravel()] = True
        now[order[down, n - end : n - done].ravel()] = True
        now &= ~seen
        seen |= now
        rows = np.flatnonzero(now & allowed)
        found.take(scores(x[rows], a, exact), ids[rows], k)
        done = end
        if exact:
            threshold = float(a[up] @ x[order[up, end - 1], up] + a[down] @ x[order[down, n - end], down])
        else:
            threshold = sum(int(a[d]) * int(x[r, d]) for d, r in [*zip(up, order[up, end - 1], strict=True), *zip(down, order[down, n - end], strict=True)])
        if found.done(threshold, k) or seen.all():
            break
    return done


def _answered(k: int, same: bool):
    """Lists joined with chunks of anchors: per anchor and window the best rows of this task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict[int, tuple] = {}
        for b in batches:
            for row in b.to_pylist():
                n_dims = max(row["dims"], row["a_dims"])
                ids, labels = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["labels"], "<i8")
                x, order = np.frombuffer(row["x"], "<f8").reshape(len(ids), row["dims"]), np.frombuffer(row["order"], "<i4").reshape(row["dims"], len(ids))
                if row["chunk"] not in state:
                    keys, own, own_labels = (np.frombuffer(row[c], "<i8") for c in ("a_keys", "a_ids", "a_labels"))
                    anchors = np.frombuffer(row["a_x"], "<f8").reshape(len(keys), row["a_dims"])
                    low, high = (np.frombuffer(row[c], "<i8").reshape(len(keys), -1) for c in ("a_low", "a_high"))
                    state[row["chunk"]] = keys, own, own_labels, anchors, [Windows.of(*w) for w in zip(low, high, strict=True)]
                keys, own, own_labels, anchors, windows = state[row["chunk"]]
                d = min(row["dims"], row["a_dims"])
                top = np.abs(x).max(initial=0) * np.abs(anchors).max(initial=0) * n_dims
                exact = bool(top < 2**53)
                for i in range(len(keys)):
                    allowed = (labels == own_labels[i]) & (ids != own[i]) if same else labels != own_labels[i]
                    if allowed.any() and (windows[i].low <= windows[i].high).any():
                        threshold_algorithm(x[:, :d], order[:d], ids, allowed, anchors[i, :d], windows[i], k, exact)
        out = [(int(key), w, int(s), int(r)) for keys, _, _, _, windows in state.values() for key, own in zip(keys, windows, strict=True) for w in range(len(own.low)) for s, r in zip(own.score[w], own.row[w], strict=True)]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), [pa.int64(), pa.int32(), pa.int64(), pa.int64()], strict=True)], names=["key", "w", "score", "row"])

    return run


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, id, label, v, low, high) of a partition into chunks of CHUNK anchors."""
    from pyspark import TaskContext

    number = TaskContext.get().partitionId() << 32
    names = ["chunk", "a_min", "a_max", "a_dims", "a_keys", "a_ids", "a_labels", "a_x", "a_low", "a_high"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), *[pa.binary()] * 6]
    held: list[dict] = []

    def pack(rows: list[dict], number: int) -> pa.RecordBatch:
        vectors = [np.frombuffer(r["v"], "<f8") for r in rows]
        x = padded(vectors, max(map(len, vectors)))
        whole = lambda c: np.array([r[c] for r in rows], "<i8").tobytes()
        # as many windows for each: those that an anchor lacks are empty
        n = max(len(r["low"]) for r in rows)
        low = np.array([r["low"] + [1] * (n - len(r["low"])) for r in rows], "<i8").tobytes()
        high = np.array([r["high"] + [0] * (n - len(r["high"])) for r in rows], "<i8").tobytes()
        labels = [r["label"] for r in rows]
        cells = [number, min(labels), max(labels), x.shape[1], whole("key"), whole("id"), whole("label"), x.astype("<f8").tobytes(), low, high]
        return pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(cells, types, strict=True)], names=names)

    for b in batches:
        held += b.to_pylist()
        while len(held) >= CHUNK:
            yield pack(held[:CHUNK], number)
            held, number = held[CHUNK:], number + 1
    if held:
        yield pack(held, number)


CHUNKS = "chunk long, a_min long, a_max long, a_dims int, a_keys binary, a_ids binary, a_labels binary, a_x binary, a_low binary, a_high binary"


def answered(lists: DataFrame, anchors: DataFrame, k: int, same: bool) -> DataFrame:
    """(key, w, rank, score, row): the first ``k`` rows of each window of ``anchors`` (key, id,
    label, v, low, high), among rows of its label (``same``) or of others."""
    packed = written(arrow_rows(anchors.repartitionByRange("label", "key").sortWithinPartitions("label", "key"), _chunks, CHUNKS), "anchor_chunks")
    fits = (F.col("low") <= F.col("a_max")) & (F.col("high") >= F.col("a_min")) if same else (F.col("low") < F.col("high")) | (F.col("a_min") < F.col("a_max")) | (F.col("low") != F.col("a_min"))
    parts = in_blocks(packed, 128 + sum(F.length(c) for c in ("a_keys", "a_ids", "a_labels", "a_x", "a_low", "a_high")), "chunk")
    met = [arrow_rows(lists.join(F.broadcast(part), fits), _answered(k, same), "key long, w int, score long, row long") for part in parts]
    best = Window.partitionBy("key", "w").orderBy(F.col("score").desc(), "row")
    ranked = reduce(DataFrame.unionByName, met).withColumn("rank", F.dense_rank().over(best)).where(F.col("rank") <= k)
    return written(ranked.groupBy("key", "w", "rank").agg(F.first("score").alias("score"), F.first("row").alias("row")), "answered")


def _vectors(scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, found = matrix_of(b.column("vector"), scale)
            own = b.take(pa.array(rows))
            yield pa.RecordBatch.from_arrays([own.column("id"), own.column("label"), pa.array([v.astype("<f8").tobytes() for v in found], pa.binary())], names=["id", "label", "v"])

    return run


def hard_negatives(rows: DataFrame, is_anchor: Column, scale: int = SCALE, positives: int = POSITIVES, negatives: int = NEGATIVES, percent: int = PERCENT, list_bytes: int = LIST_BYTES) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for ``rows`` (id
    long, label long, vector array); ``is_anchor`` is a condition on them."""
    there = rows.where("id IS NOT NULL AND label IS NOT NULL AND vector IS NOT NULL").select("id", "label", "vector", F.coalesce(is_anchor, F.lit(False)).alias("anchor_"))
    spread = there.select("id", "label", "vector").repartitionByRange("label", "id").sortWithinPartitions("label", "id")
    lists = written(arrow_rows(spread, _packed(scale, list_bytes, list_bytes, True), PACKED), "lists")
    own = arrow_rows(there.where("anchor_").select("id", "label", "vector"), _vectors(scale), "id long, label long, v binary").distinct()
    anchors = written(own.select(F.monotonically_increasing_id().alias("key"), "id", "label", "v"), "anchors")
    anything = [F.array(F.lit(LEAST).cast("long")).alias("low"), F.array(F.lit(MOST)).alias("high")]
    first = answered(lists, anchors.select("*", *anything), positives, True)
    # the least score of the window, rounded up; a window of a score below 0 is empty
    floor = F.ceil(F.col("score").cast("decimal(20,0)") * percent / 100).cast("long")
    windows = first.where("score >= 0").groupBy("key").agg(F.array_sort(F.collect_list(F.struct("rank", floor.alias("low"), "score"))).alias("x"))
    asked = anchors.join(windows, "key").select("key", "id", "label", "v", F.col("x.low").alias("low"), F.col("x.score").alias("high"), F.col("x.rank").alias("ranks"))
    asked = written(asked, "asked")
    second = answered(lists, asked.drop("ranks"), negatives, False)
    positive = asked.select("key", F.col("id").alias("anchor_id"), F.posexplode("ranks").alias("w", "r")).join(first.select("key", F.col("rank").alias("r"), F.col("row").alias("positive_id"), F.col("score").alias("positive_score")), ["key", "r"]).drop("r")
    return second.join(positive, ["key", "w"]).select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("row").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def negatives_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op11: anchors are every hundredth vec_id; every seventh row's label moves on by one."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).cast("long")
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), moved.alias("label"), F.col("embedding").alias("vector"))
    return hard_negatives(rows, F.col("id") % 100 == 0)


NEGATIVES_SQL = """
WITH rows_ AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, r.vec_id AS other_id, a.label = r.label AS same,
         CAST(list_dot_product(a.v, r.v) AS BIGINT) AS score
  FROM rows_ a JOIN rows_ r ON r.vec_id <> a.vec_id WHERE a.vec_id % 100 = 0
), positives AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
)
SELECT p.anchor_id, p.positive_id,
       CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other_id) AS INT) AS rank,
       s.other_id AS negative_id, p.positive_score, s.score AS negative_score
FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.same
 AND 80 * p.positive_score <= 100 * s.score AND s.score <= p.positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other_id) <= 5
"""
