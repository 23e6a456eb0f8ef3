"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from satchel.llm.shared import split_join, written


def _stars(links: DataFrame, large: bool) -> DataFrame:
    """links has a > b. Large: every larger neighbour of a node is tied to the least of the
    node and its neighbours; small: every neighbour that is smaller, and the node itself."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else links
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    tied = split_join(both, least, "a")
    if large:
        out = tied.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = tied.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return out.where("a > b").distinct()


def components(links: DataFrame) -> DataFrame:
    """``links`` must be a stored table. (node, component): every node of ``links`` (a, b) that is not the least of its component,
    with the least. Rounds grow with the logarithm of the longest path; each is a written
    table, so lineage stays short. Self-links are ignored; no links, no rows."""
    n = links.count()
    now = written(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct(), "links", rows=n)
    state = None
    while True:
        now = written(_stars(_stars(now, True), False), "stars", rows=n)
        new = now.agg(F.count(F.lit(1)), F.sum(F.col("b").cast("decimal(38,0)")), F.bit_xor(F.xxhash64("a", "b"))).first()
        if state == tuple(new):
            return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
        state = tuple(new)
