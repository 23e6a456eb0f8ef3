"""Vectors of row texts: a registry of embedders, a token-hash default, and the backlog job."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from satchel.functions import text as X
from satchel.operators.listing import pending_embeddings
from satchel.operators.state import store_embeddings
from satchel.operators.textsearch import spread
from satchel.session import written

#: Text that models of a family want before a query, not before a document (fixed values).
QUERY_PREFIX = {"local:bge-": "Represent this sentence for searching relevant passages: "}
#: Characters that an embedder gets at once: its memory follows them, not the rows of a batch.
CHUNK = 1 << 20
_embedders: dict[str, Callable[[list[str]], np.ndarray]] = {}


def register_embedder(model: str, embed: Callable[[list[str]], np.ndarray]) -> None:
    """``embed`` takes a batch of texts and gives one row of numbers for each."""
    _embedders[model] = embed


def token_hash(texts: list[str], dim: int = 64) -> np.ndarray:
    """Counts of word hashes in ``dim`` buckets, at length 1; a text without words is the first
    unit vector."""
    words = [re.findall("[a-z0-9_]+", t.lower(), re.ASCII) for t in texts]
    each, back = np.unique(np.array([w for ws in words for w in ws], dtype=object).astype("S"), return_inverse=True)
    letters = each.view(np.uint8).reshape(len(each), -1) if len(each) else np.zeros((0, 0), np.uint8)
    h = np.zeros(len(each), np.uint64)
    for column in letters.T:  # all distinct words side by side, a letter at a time
        h = np.where(column > 0, (h * np.uint64(31) + column) & np.uint64(0xFFFFFFFF), h)
    owner = np.repeat(np.arange(len(texts)), [len(ws) for ws in words])
    out = np.bincount(owner * dim + (h % np.uint64(dim)).astype(np.int64)[back.reshape(-1)], minlength=len(texts) * dim).reshape(len(texts), dim).astype(float)
    out[~out.any(1), 0] = 1
    return out / np.linalg.norm(out, axis=1, keepdims=True)


register_embedder("token-hash", token_hash)


def cuts(texts: list[str], most: int = CHUNK) -> Iterator[int]:
    """Where to cut a batch so that its parts have ``most`` characters, or a single text."""
    chars = 0
    for k, t in enumerate(texts):
        if chars and chars + len(t) > most:
            yield k
            chars = 0
        chars += len(t)
    if texts:
        yield len(texts)


def embedded(texts: DataFrame, model: str) -> DataFrame:
    """(id, vector) of ``texts`` (id, text), a batch at a time, in tasks of even size."""
    embed = _embedders[model]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            own, start = b.text.fillna("").tolist(), 0
            for stop in cuts(own):
                yield pd.DataFrame({"id": b.id[start:stop], "vector": list(embed(own[start:stop]).astype(np.float32))})
                start = stop

    return spread(texts.select("id", "text")).mapInPandas(run, "id long, vector array<float>")


def embed_backlog(items: DataFrame, row_text: Callable[[DataFrame], DataFrame], model: str) -> DataFrame:
    """``items`` with vectors for all live rows that have none of ``model``; run again, nothing
    is pending."""
    backlog = pending_embeddings(items, model)
    return store_embeddings(items, embedded(row_text(backlog), model), model)


def embed_in_slices(items: DataFrame, row_text: Callable[[DataFrame], DataFrame], model: str, folder: str, slices: int = 8) -> DataFrame:
    """What ``embed_backlog`` gives, newest ids first in ``slices`` jobs. Each leaves its vectors in
    ``folder``, which all executors share; a run that is stopped half-way keeps the slices it
    has finished, and the next one goes on from there. A vector counts for the text it was made
    of: a row whose text has changed meanwhile is embedded again. Ids are unique; null ids are
    not embedded."""
    spark = items.sparkSession
    texts = written(row_text(pending_embeddings(items, model)).where("id IS NOT NULL").select("id", "text", F.xxhash64("text").alias("h")), "pending_texts")
    left = texts.join(finished_vectors(spark, folder, model).select("id", "h"), ["id", "h"], "left_anti")
    cuts = sorted(set(left.approxQuantile("id", [k / slices for k in range(1, slices)], 0.01)), reverse=True)
    below = None
    for cut in [*cuts, None]:
        at = F.col("id").cast("double")
        mine = left if below is None else left.where(at < below)
        mine, below = mine if cut is None else mine.where(at >= cut), cut
        made = embedded(mine, model).join(mine.select("id", "h"), "id").withColumn("model", F.lit(model))
        made.select("id", "h", "model", "vector").write.parquet(f"{folder}/slice-{uuid.uuid4().hex}")
    vectors = texts.select("id", "h").join(finished_vectors(spark, folder, model), ["id", "h"]).dropDuplicates(["id"])
    return store_embeddings(items, vectors, model)


def finished_vectors(spark: SparkSession, folder: str, model: str) -> DataFrame:
    """(id, h, vector) of the slices in ``folder`` that were finished: those with a mark of success."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/slice-*/_SUCCESS")
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    paths = [f.getPath().getParent().toString() for f in found]
    schema = "id long, h long, model string, vector array<float>"
    every = spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)
    return every.where(F.col("model") == model).drop("model")


def query_text(query: Column, model: str) -> Column:
    for family, prefix in QUERY_PREFIX.items():
        if model.startswith(family):
            return F.concat(F.lit(prefix), query)
    return query


#: Collection names that say nothing of a row's topic (fixed values).
STOP_LABELS = ["upvoted", "watch later", "posts", "saved", "all bookmarks"]


def row_text(items: DataFrame) -> DataFrame:
    """(id, provider, text): what of a row is embedded."""
    labels = F.array_join(F.filter("collection", lambda n: ~F.lower(F.trim(n)).isin(STOP_LABELS)), ", ")
    joined = X.trim_all(F.concat_ws("\n", *(F.nullif(c, F.lit("")) for c in (F.col("title"), F.col("publication"), F.col("summary"), labels))))
    return items.select("id", "provider", F.substring(F.coalesce(F.nullif(joined, F.lit("")), F.nullif(X.trim_all(F.col("url")), F.lit("")), F.lit("Saved item")), 1, 1000).alias("text"))


def text_profile(texts: DataFrame) -> DataFrame:
    """Per provider of ``row_text``: rows, mean length, short ones and those without any text."""
    n = F.length("text")
    return texts.groupBy("provider").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(n), 4).alias("mean_chars"), F.count_if(n < 40).alias("short"), F.count_if(F.col("text") == "Saved item").alias("empty"))
