"""Cosine search in blocks, similarity floors, rank fusion and ranking quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from satchel.operators.tiles import BLOCK, above_goal, best_of, compared, tiles

#: Similarity bands by model prefix: factor of the top, least floor, greatest floor.
BANDS = {"": (0.5, 0.2, 0.35), "local:bge-": (0.8, 0.55, 0.6)}


def cosine_top(rows: DataFrame, queries: DataFrame, limit: int = 100, min_score: Column | float = 0.0, block: int = BLOCK) -> DataFrame:
    """(query_id, id, similarity, rank): for each query (query_id, vector, model, exclude,
    min_score) its best ``rows`` (id, vector, model) of the same model and length, self
    excluded; only of its provider where ``queries`` have one (null: any), ``rows`` theirs. Blocks
    of queries meet groups of rows in tiles, each of which hands on its best only. Similarities
    are rounded to 6 places, ties go by id."""
    kept = ["provider"] if "provider" in queries.columns else []
    q = queries.select(F.col("query_id").cast("long").alias("id"), "vector", "model", "exclude", F.col("min_score").cast("double").alias("min_score"), *kept)
    r = rows.select(F.col("id").cast("long").alias("id"), "vector", "model", *kept)
    found = compared(tiles(r, q, block), best_of(limit, bool(kept)), "query_id long, id long, similarity double")
    ranked = Window.partitionBy("query_id").orderBy(F.col("similarity").desc(), "id")
    return found.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= limit)


def band(model: Column, part: int) -> Column:
    out = F.lit(BANDS[""][part])
    for prefix, values in BANDS.items():
        if prefix:
            out = F.when(F.startswith(model, F.lit(prefix)), F.lit(values[part])).otherwise(out)
    return out


def floor_of(top: Column, model: Column) -> Column:
    """The query's own floor: a share of its top score within the model's band, never above it."""
    return F.least(top, F.greatest(band(model, 1), F.least(band(model, 2), band(model, 0) * top)))


def semantic(rows: DataFrame, queries: DataFrame, limit: int = 200) -> DataFrame:
    """``cosine_top`` from the band's least score, cut at each query's floor."""
    asked = queries.withColumn("min_score", band(F.col("model"), 1))
    top = cosine_top(rows, asked, limit).join(queries.select("query_id", "model"), "query_id")
    best = F.max("similarity").over(Window.partitionBy("query_id"))
    return top.withColumn("best_", best).where(F.col("similarity") >= floor_of(F.col("best_"), F.col("model"))).drop("best_", "model")


def similar(items: DataFrame, ids: DataFrame, limit: int = 20) -> DataFrame:
    """Neighbours of stored rows ``ids`` (id) under each row's own model; rows that are unknown or
    not embedded come back with an error and no neighbour."""
    stored = items.select("id", F.col("embedding").alias("vector"), F.col("embedding_model").alias("model"), "deleted_at")
    asked = ids.join(stored.withColumn("there", F.lit(True)), "id", "left")
    good = asked.where("vector IS NOT NULL AND model IS NOT NULL").select(F.col("id").alias("query_id"), "vector", "model", F.col("id").alias("exclude"))
    live = stored.where("deleted_at IS NULL AND vector IS NOT NULL")
    found = semantic(live, good, limit).withColumn("error", F.lit(None).cast("string"))
    bad = asked.where("vector IS NULL OR model IS NULL").select(
        F.col("id").alias("query_id"), F.lit(None).cast("long").alias("id"), F.lit(None).cast("double").alias("similarity"), F.lit(None).cast("int").alias("rank"),
        F.when(F.col("there").isNull(), "no such item").otherwise("not embedded yet").alias("error"),
    )
    return found.unionByName(bad)


def fuse(text: DataFrame, vector: DataFrame, limit: int = 200, k: int = 60) -> DataFrame:
    """Reciprocal rank fusion of two rankings (query_id, id, rank); ties by text rank, rows
    without one last, then vector order."""
    t = text.select("query_id", "id", F.col("rank").alias("t"))
    v = vector.select("query_id", "id", F.col("rank").alias("v"))
    both = t.join(v, ["query_id", "id"], "full_outer")
    score = F.coalesce(1 / (k + F.col("t")), F.lit(0.0)) + F.coalesce(1 / (k + F.col("v")), F.lit(0.0))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("t").asc_nulls_last(), F.col("v").asc_nulls_last())
    return both.withColumn("score", F.round(score, 9)).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).select("query_id", "id", "rank", "score")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def agreement(first: DataFrame, second: DataFrame) -> DataFrame:
    """Mean and least cosine of two embeddings (id, vector) of the same rows."""
    both = first.join(second.select("id", F.col("vector").alias("other")), "id").select(dot(F.col("vector"), F.col("other")).alias("c"))
    return both.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("c"), 6).alias("mean_cosine"), F.round(F.min("c"), 6).alias("min_cosine"))


def target_ranks(rows: DataFrame, queries: DataFrame, targets: DataFrame) -> DataFrame:
    """(query_id, id, similarity, rank): where each query's target (query_id, id) stands among all
    ``rows`` that ``cosine_top`` would rank. Rows above it are counted, not sorted."""
    q = queries.select("query_id", F.col("vector").alias("qv"), F.col("model").alias("qm"), "exclude")
    aim = q.join(targets, "query_id").join(rows.select("id", F.col("vector").alias("tv"), F.col("model").alias("tm")), "id").where("qm = tm")
    goal = F.round(dot(F.col("qv"), F.col("tv")), 6)
    asked = aim.select(F.col("query_id").cast("long").alias("id"), F.col("qv").alias("vector"), F.col("qm").alias("model"), "exclude", F.col("id").cast("long").alias("target"), goal.alias("goal"))
    whole = rows.where(~F.exists("vector", lambda x: x.isNull())).select(F.col("id").cast("long").alias("id"), "vector", "model")
    found = compared(tiles(whole, asked), above_goal(), "query_id long, id long, similarity double, above long")
    return found.groupBy("query_id", "id", "similarity").agg((F.sum("above") + 1).alias("rank"))


def random_pairs(vectors: DataFrame, sample: DataFrame) -> DataFrame:
    """Rows, mean similarity and mean of the best similarity of ``vectors`` (id, vector) against
    the few of ``sample``, each row's own left out."""
    few = sample.agg(F.collect_list(F.struct("id", "vector")).alias("s"))
    sims = vectors.join(F.broadcast(few), F.lit(True)).select(F.transform(F.filter("s", lambda x: x["id"] != F.col("id")), lambda x: F.round(dot(F.col("vector"), x["vector"]), 6)).alias("c"))
    mean = F.aggregate("c", F.lit(0.0), lambda a, x: a + x) / F.size("c")
    return sims.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(mean), 5).alias("mean_similarity"), F.round(F.avg(F.array_max("c")), 5).alias("mean_of_max"))


def label_ranks(rows: DataFrame, asked: DataFrame) -> DataFrame:
    """Per label of ``asked`` (label, id, vector), ranked against all ``rows`` (id, label, vector)
    but its own: rows of that label, their median rank and how many are in the top 50 and 200.
    Ranks are counted by narrow bands of similarity, so no task sorts all rows of a label."""
    q = asked.select(F.col("label").alias("asked"), F.col("id").alias("own_id"), F.col("vector").alias("qv"))
    scored = rows.join(q, rows.id != q.own_id).select("asked", "label", "id", F.round(dot(F.col("qv"), F.col("vector")), 6).alias("c"))
    scored = scored.withColumn("band", F.floor(F.col("c") * 1000))
    above = Window.partitionBy("asked").orderBy(F.col("band").desc()).rowsBetween(Window.unboundedPreceding, -1)
    base = scored.groupBy("asked", "band").agg(F.count(F.lit(1)).alias("n")).select("asked", "band", F.coalesce(F.sum("n").over(above), F.lit(0)).alias("base"))
    inside = F.row_number().over(Window.partitionBy("asked", "band").orderBy(F.col("c").desc(), "id"))
    ranked = scored.withColumn("in_", inside).join(base, ["asked", "band"]).where(F.col("label") == F.col("asked")).select("label", (F.col("base") + F.col("in_")).alias("rank"))
    return ranked.groupBy("label").agg(F.count(F.lit(1)).alias("labelled"), F.median("rank").alias("median_rank"), F.count_if(F.col("rank") <= 50).alias("in_50"), F.count_if(F.col("rank") <= 200).alias("in_200"))
