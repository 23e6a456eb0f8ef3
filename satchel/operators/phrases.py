"""Phrases, prefixes, column filters, nearness and boolean combinations over the postings of
``textsearch.postings``, for queries that are given as tables of parts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from satchel.operators.textsearch import meeting
from satchel.session import bounded


def phrase_hits(index: DataFrame, parts: DataFrame) -> DataFrame:
    """(query_id, part, id, uses) for ``parts`` (query_id, part, terms, field, prefix, first):
    rows where the terms stand side by side in one column. ``field`` keeps to one column, null
    is any; with ``prefix`` the last term may go on; with ``first`` the phrase opens its column.
    One word is a phrase of one; an empty phrase finds nothing."""
    words = parts.select("query_id", "part", F.size("terms").alias("n"), F.col("field").alias("only"), "prefix", "first", F.posexplode("terms").alias("k", "word"))
    words = words.withColumn("prefix", F.col("prefix") & (F.col("k") == F.col("n") - 1))
    found = meeting(index, words).where(F.col("only").isNull() | (F.col("only") == F.col("field")))
    starts = found.select("query_id", "part", "n", "first", "id", "field", F.explode(F.transform("places", lambda p: p - F.col("k"))).alias("start"))
    whole = starts.groupBy("query_id", "part", "n", "first", "id", "field", "start").agg(F.count(F.lit(1)).alias("got")).where("got = n AND (NOT first OR start = 0)")
    return whole.groupBy("query_id", "part", "id").agg(F.count(F.lit(1)).alias("uses"))


def near_hits(index: DataFrame, pairs: DataFrame) -> DataFrame:
    """(query_id, part, id) for ``pairs`` (query_id, part, left, right, gap): rows where both
    words stand in one column with at most ``gap`` words between them, in any order."""
    width = 64 + 4 * (F.length("left") + F.length("right"))
    a = index.join(bounded(pairs, width), F.col("term") == F.col("left")).select("query_id", "part", "gap", "right", "id", "field", F.col("places").alias("a"))
    # of the other word's postings only those that a pair asks for
    others = pairs.select(F.col("right").alias("term")).distinct()
    b = index.join(bounded(others, 64 + 4 * F.length("term")), "term").select("id", "field", F.col("term").alias("right"), F.col("places").alias("b"))
    close = F.exists("a", lambda x: F.exists("b", lambda y: (x != y) & (F.abs(x - y) - 1 <= F.col("gap"))))
    return a.join(b, ["id", "field", "right"]).where(close).select("query_id", "part", "id").distinct()


def combine(hits: DataFrame, roles: DataFrame) -> DataFrame:
    """(query_id, id): rows that have every part of role ``all``, a part of role ``any`` if the
    query has such parts, and no part of role ``none``; ``roles`` is (query_id, part, role)."""
    count = lambda role: F.count_if(F.col("role") == role)
    asked = roles.groupBy("query_id").agg(count("all").alias("n_all"), count("any").alias("n_any"))
    got = hits.select("query_id", "part", "id").distinct().join(roles, ["query_id", "part"]).groupBy("query_id", "id").agg(count("all").alias("g_all"), count("any").alias("g_any"), count("none").alias("g_none"))
    return got.join(asked, "query_id").where("g_all = n_all AND (n_any = 0 OR g_any > 0) AND g_none = 0 AND g_all + g_any > 0").select("query_id", "id")
