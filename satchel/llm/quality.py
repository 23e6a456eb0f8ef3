"""Quality classifier by positive-unlabelled learning.

Trusted positives are labelled documents of quality 1; unlabelled data is web text, whatever
its labels; labels of negative rows are never read. A logistic model on features of the
whole text minimises the non-negative unbiased risk: prior * R(positives as +) + max(0,
R(unlabelled as -) - prior * R(positives as -)). That is the largest of first part + k * second
part over k from 0 to 1, and with the logistic loss each of those is convex. So its least is
found exactly: Newton steps find the least for one k, and k is halved in on the one at whose
least the second part is zero (1, if it isn't below zero there); of all parameters tried,
those of the least risk are taken.

All unlabelled rows count in every step: their features are stored once, and loss, gradient
and curvature are sums over partitions, added up in two levels, the second by pieces of the
sum, so the driver gets one sum however many tasks there are. It holds the positives'
features once; each model takes its rows of them a block at a time. One documented bound is left, on labelled rows: about ``FIT_POSITIVES`` positives
are fitted, those whose hash is below a threshold that follows from their count.

The class prior is estimated from positives and all unlabelled rows alone: a classifier of
positives against unlabelled rows scores each fifth of them after learning from the rest;
of all score thresholds, the share of unlabelled rows above it over the share of positives
above it bounds the prior from above, and the bound is taken where it is lowest once its
sampling error is added (best-bin estimation; of that error, which holds for the worst of
all thresholds, a quarter is added).

Only text is a feature: shares of character classes and of repetition, and hashed two-byte
counts.

Null and empty texts are scored by the model's own value for no text; repeated rows and
equal texts have equal scores; labels of unknown documents are ignored; several labels of
one document count as its largest; one row of a doc_id is a positive, every row that isn't
held out is unlabelled (one of a null doc_id isn't held out); other columns pass through
``score`` unless named as an output; an empty table gives no rows; without positives or
unlabelled rows every score is the prior, 0.5 where nothing tells it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from satchel.llm.shared import append_columns, arrow_groups, arrow_rows, bounded, byte_pieces, free_name, written

FIT_POSITIVES = 8_000
HASHED = 256
PIECE = 1 << 20
DENSE = 24
#: Rows of features that the driver works on at once.
BLOCK_ROWS = 1024

_C = np.arange(256)
#: Classes of bytes: fixed ranges of ASCII, and what is beyond it.
CLASSES = [
    (_C >= 97) & (_C <= 122), (_C >= 65) & (_C <= 90), (_C >= 48) & (_C <= 57), _C >= 128, _C == 32, _C == 10,
    np.isin(_C, [44, 46]), np.isin(_C, [33, 63]), _C == 124, np.isin(_C, list(b"#$%&*@^~_=+")), np.isin(_C, list(b"()[]{}<>")), np.isin(_C, list(b"'\"`")), np.isin(_C, list(b":;/\\-")), _C < 32,
]
CLASS_OF = np.stack(CLASSES).astype(np.uint8)


def features(texts: pa.Array) -> np.ndarray:
    """A row of DENSE + HASHED numbers for each text."""
    out = [_features(data, offsets) for _, _, data, offsets in byte_pieces(texts, PIECE)]
    return np.concatenate(out) if out else np.zeros((0, DENSE + HASHED), np.float32)


def _features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    rows, n = len(offsets) - 1, np.diff(offsets)
    x = np.zeros((rows, DENSE + HASHED), np.float64)
    some = n > 0
    per = np.maximum(n, 1).astype(np.float64)
    owner = np.repeat(np.arange(rows, dtype=np.int32), n)
    counts = np.bincount(owner.astype(np.int64) * 256 + data, minlength=rows * 256).reshape(rows, 256)
    k = len(CLASSES)
    x[:, :k] = counts @ CLASS_OF.T / per[:, None]
    x[:, k] = np.log1p(n) / 10
    x[:, k + 1] = (counts > 0).sum(1) / 100
    p = counts / per[:, None]
    x[:, k + 2] = -(p * np.log(np.maximum(p, 1e-12))).sum(1) / 4
    space = (data == 32) | ((data >= 9) & (data <= 13))
    start = ~space
    if len(data):
        start[1:] &= space[:-1] | (owner[1:] != owner[:-1])
    words = np.bincount(owner[start], minlength=rows)
    x[:, k + 3] = words / per * 5
    if len(data) > 1:
        same = owner[1:] == owner[:-1]
        x[:, k + 4] = np.bincount(owner[1:][same & (data[1:] == data[:-1])], minlength=rows) / per * 5
        pair = (data[:-1].astype(np.uint32) << np.uint32(8) | data[1:]) * np.uint32(2654435761) >> np.uint32(24)
        hashed = np.bincount(owner[1:][same].astype(np.int64) * HASHED + pair[same] % HASHED, minlength=rows * HASHED).reshape(rows, HASHED)
        x[:, DENSE:] = np.sqrt(hashed / per[:, None]) * 3
    x[~some, k:] = 0
    return x.astype(np.float32)


@dataclass
class Model:
    """A logistic model on standardised features; ``w`` is None if there was nothing to learn from."""

    prior: float
    mean: np.ndarray | None = None
    scale: np.ndarray | None = None
    w: np.ndarray | None = None
    b: float = 0.0

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.w is None:
            return np.full(len(x), self.prior)
        return sigmoid(standard(x, self.mean, self.scale) @ np.append(self.w, self.b))


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def standard(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Standardised features and a last column of ones."""
    out = np.ones((len(x), x.shape[1] + 1))
    own = out[:, :-1]
    np.subtract(x, mean, out=own)
    np.divide(own, scale, out=own)
    np.clip(own, -8, 8, out=own)
    return out


def blocks(x: np.ndarray, of: np.ndarray | None = None, k: int = 0) -> Iterator[np.ndarray]:
    """The rows of ``x`` whose fold ``of`` isn't ``k`` (all rows, if None), a few at a time."""
    for a in range(0, len(x), BLOCK_ROWS):
        part = x[a : a + BLOCK_ROWS]
        yield part if of is None else part[of[a : a + BLOCK_ROWS] != k]


def moments(x: np.ndarray) -> np.ndarray:
    """Number of rows, sums and sums of squares of the features ``x``."""
    wide = x.astype(np.float64)
    return np.concatenate([[len(x)], wide.sum(0), (wide * wide).sum(0)])


def sums(x: np.ndarray, thetas: np.ndarray, of: np.ndarray | None = None) -> np.ndarray:
    """For each row of parameters ``thetas`` the number of standardised rows ``x``, their loss as
    negatives, its gradient and (half of, as it is symmetric) its curvature, all summed, in one
    flat array; the rows of model k are those whose fold ``of`` isn't k (all rows, if None)."""
    out, half = [], np.triu_indices(x.shape[1])
    for k, theta in enumerate(thetas):
        mine = x if of is None else x[of != k]
        z = (mine @ theta.astype(x.dtype)).astype(np.float64)
        s = sigmoid(z)
        out += [[len(mine), np.logaddexp(0, z).sum()], mine.T @ s.astype(x.dtype), (mine.T @ (mine * (s * (1 - s)).astype(x.dtype)[:, None]))[half]]
    return np.concatenate(out, dtype=np.float64)


def unpacked(total: np.ndarray, models: int, d: int) -> list[tuple[float, float, np.ndarray, np.ndarray]]:
    """(rows, loss, gradient, curvature) of each model in ``sums``."""
    out = []
    for e in total.reshape(models, size_of(d)):
        curve = np.zeros((d, d))
        curve[np.triu_indices(d)] = e[2 + d :]
        out.append((e[0], e[1], e[2 : 2 + d], curve + np.triu(curve, 1).T))
    return out


def size_of(d: int) -> int:
    """Numbers that ``sums`` gives for a model of ``d`` parameters."""
    return 2 + d + d * (d + 1) // 2


def risk_parts(zp: np.ndarray, n: float, loss: float, prior: float) -> tuple[float, float]:
    """The two parts of the unbiased risk: of positives as such, and of negatives, which is what
    ``n`` unlabelled rows as negatives (their ``loss``, summed) exceed positives as negatives by."""
    return prior * np.logaddexp(0, -zp).mean(), loss / n - prior * np.logaddexp(0, zp).mean()


#: Newton steps at most, the least change of a parameter that a further one is made for, and
#: halvings of the second part's weight.
STEPS, LEAST_STEP, HALVINGS = 10, 0.03, 6
Summed = Callable[[np.ndarray], np.ndarray]


def minimise(p: np.ndarray, of: np.ndarray | None, models: int, summed: Summed, prior: float, decay: float, k: float = 1.0, start: np.ndarray | None = None) -> tuple[np.ndarray, list[tuple[float, float]]]:
    """(parameters, non-negative risks with their second parts) at the least of first part + ``k`` * second part,
    of ``models`` models that share the passes of ``summed``; the positives of model m are the
    standardised rows ``p`` whose fold ``of`` isn't m (all, if None). A step that raises the risk
    is halved."""
    d = p.shape[1]
    flat = np.append(np.full(d - 1, decay), 1e-6)

    def at(m: int, theta: np.ndarray, n: float, loss: float, gradient: np.ndarray, curve: np.ndarray) -> tuple:
        scores, pull, bent = [], np.zeros(d), np.zeros((d, d))
        for rows in blocks(p, of, m):
            scores.append(rows @ theta)
            q = sigmoid(scores[-1])
            pull += (1 - q + k * q) @ rows
            if k < 1:
                bent += rows.T @ (rows * (q * (1 - q))[:, None])
        z = np.concatenate(scores)
        first, second = risk_parts(z, n, loss, prior)
        slope = k * gradient / n - prior * pull / len(z) + flat * theta
        # of a positive the loss as such less that as a negative is minus its score: no curvature
        bend = k * curve / n + prior * (1 - k) * bent / len(z) + np.diag(flat)
        weight = 0.5 * (flat * theta * theta).sum()
        return first + k * second + weight, slope, bend, (first + max(0.0, second) + weight, second)

    best = np.zeros((models, d)) if start is None else start.copy()
    now = [at(m, best[m], *found) for m, found in enumerate(unpacked(summed(best), models, d))]
    step = [-np.linalg.solve(bend, slope) for _, slope, bend, _ in now]
    for _ in range(STEPS):
        tried = best + np.stack(step)
        then = [at(m, tried[m], *found) for m, found in enumerate(unpacked(summed(tried), models, d))]
        for m in range(models):
            if then[m][0] <= now[m][0]:
                best[m], now[m] = tried[m], then[m]
                step[m] = -np.linalg.solve(now[m][2], now[m][1])
            else:
                step[m] = step[m] / 4
        if max(np.abs(x).max() for x in step) < LEAST_STEP:
            break
    return best, [parts for *_, parts in now]


def least_risk(p: np.ndarray, summed: Summed, prior: float, decay: float) -> np.ndarray:
    """The parameters of least non-negative risk (see above)."""
    found, ((risk, second),) = minimise(p, None, 1, summed, prior, decay)
    if second >= 0:
        return found[0]
    low, high, best, found = 0.0, 1.0, (risk, found[0]), np.zeros((1, p.shape[1]))
    for _ in range(HALVINGS):
        k = (low + high) / 2
        found, ((risk, second),) = minimise(p, None, 1, summed, prior, decay, k, found)
        best = min(best, (risk, found[0]), key=lambda x: x[0])
        low, high = (low, k) if second < 0 else (k, high)
    return best[1]


def best_bin(sp: np.ndarray, above: Callable[[np.ndarray], np.ndarray], n: float, slack: float = 0.01, delta: float = 0.1, share: float = 0.25) -> float:
    """The class prior from scores ``sp`` of positives and of ``n`` unlabelled rows (see above);
    ``above`` gives, for cuts, how many of those score as much at least."""
    cut = np.unique(sp)
    qp = 1 - np.searchsorted(np.sort(sp), cut) / len(sp)
    qu = above(cut) / n
    error = share * sum(np.sqrt(np.log(4 / delta) / (2 * m)) for m in (len(sp), n))
    k = int(np.argmin((qu + (1 + slack) * error) / qp))
    return float(min(1.0, qu[k] / qp[k]))


def held_out(doc_id) -> F.col:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def chosen(df: DataFrame, most: int, *of: str) -> DataFrame:
    """The rows of ``df`` whose hash of ``of`` is below a threshold that about ``most`` rows pass;
    all if there are no more."""
    n = df.count()
    place = F.xxhash64(F.lit("fit"), *of) / 2.0**64 + 0.5
    return df if n <= most else df.where(place < most / n)


#: Folds of the prior's models; weight decay of the model and of those.
FOLDS, DECAY, DECAY_OF_PRIOR = 5, 0.1, 0.1
#: Bytes of the tasks' sums that the driver takes at once; more are added up in groups first.
SUMS_BYTES = 4 << 20
#: Numbers of a piece of a sum, which groups are added up by.
SUM_PIECE = 1 << 15


def added(df: DataFrame, of: Callable[[np.ndarray, np.ndarray], np.ndarray], size: int) -> np.ndarray:
    """The sum of ``of`` (features, folds) over the batches of a stored table ``df`` (x binary, fold
    int): summed within tasks; where the tasks' sums exceed SUMS_BYTES, then in groups (as many as
    the root of the tasks), then over the groups by pieces of the sum, so one sum gets here. How
    rows are dealt to tasks may show in the last bits."""
    tasks = df.rdd.getNumPartitions()
    n_groups = max(1, int(np.sqrt(tasks)))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total = np.zeros(size)
        for b in batches:
            total += of(np.frombuffer(b"".join(b.column("x").to_pylist()), np.float32).reshape(len(b), -1), b.column("fold").to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId() % n_groups], pa.int32()), pa.array([total.tobytes()])], names=["g", "x"])

    def total_of(sums: list[bytes]) -> np.ndarray:
        total = np.frombuffer(sums[0]).copy()
        for x in sums[1:]:
            total += np.frombuffer(x)
        return total

    def groups(table: pa.Table) -> pa.Table:
        total = total_of(sorted(table.column("x").to_pylist()))
        cuts = range(0, size, SUM_PIECE)
        return pa.table({"piece": pa.array(range(len(cuts)), pa.int32()), "x": pa.array([total[k : k + SUM_PIECE].tobytes() for k in cuts])})

    def pieces(table: pa.Table) -> pa.Table:
        return pa.table({"piece": table.column("piece").slice(0, 1), "x": pa.array([total_of(sorted(table.column("x").to_pylist())).tobytes()])})

    each = arrow_rows(df.select("x", "fold"), rows, "g int, x binary")
    if 8 * size * tasks <= SUMS_BYTES:
        found = sorted(bytes(r.x) for r in each.select("x").collect())
        return total_of(found) if found else np.zeros(size)
    found = arrow_groups(arrow_groups(each, "g", groups, "piece int, x binary"), "piece", pieces, "piece int, x binary").collect()
    return np.concatenate([np.frombuffer(r.x) for r in sorted(found, key=lambda r: r.piece)])


def train(docs: DataFrame, labels: DataFrame, positives: int = FIT_POSITIVES) -> Model:
    """The model of ``docs`` (doc_id, text) and ``labels`` (doc_id, quality), from rows that
    are not held out."""
    ids = labels.where((F.col("quality") >= 1) & ~held_out("doc_id")).select("doc_id").distinct()
    ids = written(chosen(ids, positives, "doc_id"), "positive_ids")
    open_docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).where(~held_out("doc_id"))
    positive = open_docs.join(bounded(ids, 16), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in features(b.column("text"))], pa.binary()), b.column("fold")], names=["x", "fold"])

    def folded(df: DataFrame) -> DataFrame:
        fold = F.pmod(F.xxhash64(F.lit("fold"), "text"), F.lit(FOLDS)).cast("int")
        return arrow_rows(df.select("text", fold.alias("fold")), rows, "x binary, fold int")

    found = folded(positive).toArrow().sort_by([("x", "ascending"), ("fold", "ascending")])
    p, of = np.frombuffer(b"".join(found.column("x").to_pylist()), np.float32).reshape(-1, DENSE + HASHED), found.column("fold").to_numpy().astype(np.int64)
    del found
    u = written(folded(open_docs), "unlabelled_features")
    width = DENSE + HASHED
    m = added(u, lambda x, _: moments(x), 1 + 2 * width)
    if not len(p) or not m[0]:
        return Model(0.5)
    m = m + sum(map(moments, blocks(p)))
    mean = m[1 : 1 + width] / m[0]
    scale = np.sqrt(np.maximum(m[1 + width :] / m[0] - mean**2, 0)) + 1e-3
    sp = standard(p, mean, scale)
    del p
    prior = prior_of(u, sp, of, mean, scale)
    narrow = lambda x: standard(x, mean, scale).astype(np.float32)
    theta = least_risk(sp, lambda t: added(u, lambda x, _: sums(narrow(x), t), size_of(width + 1)), prior, DECAY)
    return Model(prior, mean, scale, theta[:-1], float(theta[-1]))


def prior_of(u: DataFrame, sp: np.ndarray, of: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> float:
    """The share of positives among the rows of ``u`` (x, fold), from standardised positives ``sp``
    and their folds; 0.5 where a fold of either has no rows."""
    counts = added(u, lambda _, f: np.bincount(f, minlength=FOLDS).astype(float), FOLDS)
    if min(*counts, *np.bincount(of, minlength=FOLDS)) < 1:
        return 0.5
    size = FOLDS * size_of(sp.shape[1])
    thetas = minimise(sp, of, FOLDS, lambda t: added(u, lambda x, f: sums(standard(x, mean, scale).astype(np.float32), t, f), size), 1.0, DECAY_OF_PRIOR)[0]
    score_of = lambda x, f: np.einsum("ij,ij->i", x, thetas[f])

    def above(cut: np.ndarray) -> np.ndarray:
        def higher(x: np.ndarray, f: np.ndarray) -> np.ndarray:
            at = np.bincount(np.searchsorted(cut, score_of(standard(x, mean, scale), f), side="right"), minlength=len(cut) + 1)
            return at[1:][::-1].cumsum()[::-1].astype(float)

        return added(u, higher, len(cut))

    return best_bin(score_of(sp, of), above, float(counts.sum()))


def score(docs: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with the score of every whole text."""
    return append_columns(docs, [text], [T.StructField(out, T.DoubleType())], lambda t: [pa.array(model.score(features(t)), pa.float64())])


THRESHOLD = 0.3


def accepted(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` with a score of at least ``threshold``, unchanged."""
    name = free_name(docs, "score")
    return score(docs, model, out=name).where(F.col(name) >= threshold).select(*docs.columns)


def quality_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6: every document's score."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model).select("doc_id", held_out("doc_id").alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))
