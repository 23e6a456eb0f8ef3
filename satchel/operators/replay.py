"""Archived pages parsed again and merged into the item table, as one job over all pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from satchel.operators import parsing as P
from satchel.operators import state as M
from satchel.operators import sync as I
from satchel.operators import videos  # noqa: F401  (adds its parser)
from satchel.session import written

#: Places in a page that an arrival number leaves room for.
PLACES = 1_000_000


def chosen_pages(pages: DataFrame, everything: bool = False) -> DataFrame:
    """Pages that wait or have failed; all, if ``everything``."""
    return pages if everything else pages.where(F.col("status").isin("pending", "failed"))


def arrivals(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(items with their page's account, kind, run and anchor, in order ``seq``; outcomes) of
    ``pages`` (page_id, provider, account, kind, page, fetched_at, body, context). A run's
    anchor is its first page's time, whether that page could be parsed or not."""
    items, outcomes = P.parse_pages(pages, lambda parsed: written(parsed, "parsed"))
    runs = I.open_runs(pages.drop("body", "context")).select("page_id", "account", F.col("kind").alias("page_kind"), "run", "anchor")
    return items.join(runs, "page_id").withColumn("seq", F.col("page_id") * PLACES + F.col("pos")), outcomes


def replayed(items: DataFrame, pages: DataFrame, now_ms: int, everything: bool = False) -> tuple[DataFrame, DataFrame]:
    """(items, pages) after a replay: rows merge by key, new rows get keys that fall from their
    run's anchor, pages become ingested or failed. Doing it again changes nothing more."""
    rows, outcomes = arrivals(chosen_pages(pages, everything))
    keys = I.pickup_keys(rows.withColumn("kind", F.col("page_kind")), items.select("provider", "external_id").distinct())
    merged = M.upsert(items, rows.drop("run", "anchor", "page_kind", "page_id", "pos"), now_ms)
    new = keys.select("provider", "external_id", F.col("sort_key").alias("new_key"))
    merged = merged.join(new, ["provider", "external_id"], "left").withColumn("sort_key", F.coalesce("sort_key", "new_key")).select(*items.columns)
    return merged, I.mark_pages(pages, outcomes, now_ms)


def report(items: DataFrame, pages: DataFrame, everything: bool = False) -> DataFrame:
    """What a replay would do, per provider: pages, failed pages, rows, inserted and updated.
    Nothing is written, so this is the dry run too."""
    rows, outcomes = arrivals(chosen_pages(pages, everything))
    known = items.select("provider", "external_id").distinct()
    ids = rows.groupBy("provider", "external_id").agg(F.count(F.lit(1)).alias("n"))
    new = ids.join(known, ["provider", "external_id"], "left_anti").groupBy("provider").agg(F.count(F.lit(1)).alias("inserted"))
    total = ids.groupBy("provider").agg(F.sum("n").alias("rows"))
    per = outcomes.groupBy("provider").agg(F.count(F.lit(1)).alias("pages"), F.count_if(F.col("error").isNotNull()).alias("failed"))
    none = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return per.join(total, "provider", "left").join(new, "provider", "left").select("provider", "pages", "failed", none("rows"), none("inserted"), (F.coalesce("rows", F.lit(0)) - F.coalesce("inserted", F.lit(0))).alias("updated"))


def summed(reports: DataFrame, include: list[str] | None = None) -> DataFrame:
    """``reports`` of the included providers, and a row of their sums with provider null."""
    own = reports.where(F.col("provider").isin(*include)) if include is not None else reports
    numbers = [c for c in own.columns if c != "provider"]
    return own.unionByName(own.agg(F.lit(None).cast("string").alias("provider"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in numbers)))
