"""Incremental runs over ordered pages of ids, and the archive of raw pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def first_arrivals(rows: DataFrame) -> DataFrame:
    """One row per (run, external_id, collection) of ``rows`` (run, list, page, pos, ...): the one
    that came first. ``collection`` counts as a set of names."""
    w = Window.partitionBy("run", "external_id", F.array_sort("collection")).orderBy("list", "page", "pos")
    return rows.withColumn("n_", F.row_number().over(w)).where("n_ = 1").drop("n_")


def unseen_per_page(rows: DataFrame, known: DataFrame) -> DataFrame:
    """(run, list, page, kept, unseen): kept items, and those whose id is not in ``known``
    (provider, external_id)."""
    flagged = rows.join(known.select("provider", "external_id").distinct().withColumn("k_", F.lit(1)), ["provider", "external_id"], "left")
    return flagged.groupBy("run", "list", "page").agg(F.count(F.lit(1)).alias("kept"), F.sum(F.col("k_").isNull().cast("long")).alias("unseen"))


def pages_read(pages: DataFrame) -> DataFrame:
    """``pages`` (run, list, page, unseen, has_next, whole) up to and including the first of each
    list that has nothing new or no next page; a list with ``whole`` is walked to its end."""
    stop = ((F.col("unseen") == 0) & ~F.col("whole")) | ~F.col("has_next")
    w = Window.partitionBy("run", "list").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    return pages.withColumn("s_", F.coalesce(F.max(stop.cast("int")).over(w), F.lit(0))).where("s_ = 0").drop("s_")


def capped(pages: DataFrame, most: int) -> DataFrame:
    """``pages`` with unseen 0 from where the run's kept items reach ``most``, cut again: each
    later list still gives one page."""
    w = Window.partitionBy("run").orderBy("list", "page")
    return pages_read(pages.withColumn("unseen", F.when(F.sum("kept").over(w) >= most, F.lit(0)).otherwise(F.col("unseen"))))


def page_ids(rows: DataFrame) -> DataFrame:
    """(run, list, page, external_ids) in page order."""
    return rows.groupBy("run", "list", "page").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "external_id"))), lambda x: x["external_id"]).alias("external_ids"))


#: Page numbers of a range in which openings are counted first.
PAGE_RANGE = 1 << 16


def open_runs(pages: DataFrame) -> DataFrame:
    """``pages`` (page_id, provider, account, kind, page, fetched_at, ...) with the number of its
    run in its walk and the run's anchor: page 0, or a walk's first page, opens a run. Only
    page metadata is needed. Openings are counted by ranges of pages first, so a long walk is
    no single task; a page_id stands for one page of its walk."""
    walk = ["provider", "account", "kind"]
    opens = (F.col("page") == 0).cast("long")
    ranged = pages.withColumn("r_", F.floor(F.col("page_id") / PAGE_RANGE))
    earlier = Window.partitionBy(*walk).orderBy("r_").rowsBetween(Window.unboundedPreceding, -1)
    base = ranged.groupBy(*walk, "r_").agg(F.sum(opens).alias("o_")).select(*walk, "r_", F.coalesce(F.sum("o_").over(earlier), F.lit(0)).alias("b_"))
    inside = Window.partitionBy(*walk, "r_").orderBy("page_id")
    numbered = ranged.withColumn("i_", F.sum(opens).over(inside)).join(base, [*walk, "r_"]).withColumn("run", (F.col("b_") + F.col("i_")).cast("int"))
    anchors = numbered.groupBy(*walk, "run").agg(F.min_by("fetched_at", "page_id").alias("anchor"))
    return numbered.join(anchors, [*walk, "run"]).select(*pages.columns, "run", "anchor")


def run_report(pages: DataFrame) -> DataFrame:
    """Per run of ``pages`` (run, kept, unseen, error, stopped): status and counts."""
    failed = F.bool_or(F.col("error").isNotNull() | F.col("stopped"))
    landed = F.coalesce(F.sum("kept"), F.lit(0))
    return pages.groupBy("run").agg(F.when(~failed, "ok").when(landed > 0, "partial").otherwise("failed").alias("status"), F.count(F.lit(1)).alias("pages"), landed.alias("kept"), F.sum("unseen").alias("unseen"))


def raw_stats(pages: DataFrame) -> DataFrame:
    return pages.groupBy("provider", "status").agg(F.count(F.lit(1)).alias("pages"), F.sum(F.length("body")).alias("chars"))


def raw_select(pages: DataFrame, status: list[str] | None = None, provider: str | None = None, limit: int = 10_000) -> DataFrame:
    """Archived pages, oldest first."""
    out = pages.where(F.col("status").isin(*status)) if status else pages
    out = out.where(F.col("provider") == provider) if provider else out
    return out.orderBy("page_id").limit(limit)


def mark_pages(pages: DataFrame, outcomes: DataFrame, now_ms: int) -> DataFrame:
    """``pages`` with the result of ``outcomes`` (page_id, error): ingested with its time and no
    error, or failed with its error and no time; other pages, and all other columns, stay."""
    o = outcomes.select("page_id", F.col("error").alias("e_"), F.lit(True).alias("got_"))
    got, good = F.col("got_").isNotNull(), F.col("e_").isNull()
    old = lambda c, t: F.col(c) if c in pages.columns else F.lit(None).cast(t)
    changes = {
        "status": F.when(got, F.when(good, "ingested").otherwise("failed")).otherwise(F.col("status")),
        "ingested_at": F.when(got, F.when(good, F.lit(now_ms))).otherwise(old("ingested_at", "long")),
        "error": F.when(got, F.col("e_")).otherwise(old("error", "string")),
    }
    return pages.join(o, "page_id", "left").withColumns(changes).drop("e_", "got_")


def archive_ids(pages: DataFrame, fetched_before: int | None = None) -> DataFrame:
    """Ids of all archived pages, duplicates kept."""
    out = pages.where(F.col("fetched_at") <= fetched_before) if fetched_before else pages
    return out.select("provider", F.explode("external_ids").alias("external_id"))


def known_for_run(items: DataFrame, archive: DataFrame, sync_state: DataFrame) -> DataFrame:
    """(provider, external_id) that a run starts with: items created and archived ids fetched up
    to the provider's last good run; ``sync_state`` is (provider, synced_at), and a provider
    without one knows nothing. ``archive`` is (provider, fetched_at, external_ids)."""
    seen = items.select("provider", "external_id", F.col("created_at").alias("at"))
    seen = seen.unionByName(archive.select("provider", F.explode("external_ids").alias("external_id"), F.col("fetched_at").alias("at")))
    return seen.join(sync_state, "provider").where("at <= synced_at").select("provider", "external_id").distinct()


def key_start(runs: DataFrame, items: DataFrame, now_ms: int) -> DataFrame:
    """(provider, start): where keys of each of ``runs`` (provider, synced_at, started_at) begin:
    its own start after a good run, else below the least key of all, or now if there is none."""
    least = items.agg(F.min("sort_key").alias("least"))
    return runs.join(least, F.lit(True)).select("provider", F.when(F.col("synced_at").isNotNull(), F.col("started_at")).otherwise(F.coalesce(F.col("least") - 1, F.lit(now_ms))).alias("start"))


def watermarks(sync_state: DataFrame, runs: DataFrame) -> DataFrame:
    """``sync_state`` (provider, synced_at) moved to the last ok run of ``runs`` (provider, status,
    started_at); other runs leave it."""
    ok = runs.where("status = 'ok'").groupBy("provider").agg(F.max("started_at").alias("last"))
    return sync_state.join(ok, "provider", "full_outer").select("provider", F.coalesce("last", "synced_at").alias("synced_at"))


def resume_points(pages: DataFrame) -> DataFrame:
    """(walk, cursor): the next cursor after the last landed page of ``pages`` (walk, page, cursor,
    unseen, error, throttled); null where the walk has ended, met nothing new, or failed for
    another reason than being throttled."""
    last = pages.groupBy("walk").agg(
        F.max_by("cursor", F.when(F.col("error").isNull(), F.col("page"))).alias("cursor"),
        F.bool_or(F.col("error").isNull() & ((F.col("unseen") == 0) | F.col("cursor").isNull())).alias("ended"),
        F.bool_or(F.col("error").isNotNull() & ~F.col("throttled")).alias("broken"),
    )
    return last.select("walk", F.when(~F.col("ended") & ~F.col("broken"), F.col("cursor")).alias("cursor"))


def pickup_keys(arrivals: DataFrame, known: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """(provider, external_id, sort_key) of new rows: the anchor of the run less the new rows
    before it in the run. ``arrivals`` is (provider, account, kind, run, anchor, page_id, pos,
    external_id); new is what comes first by page and is not in ``known``. Pages are run up
    first, so that a long run is no single task. ``keep`` names more columns of the arrivals."""
    first = Window.partitionBy("provider", "external_id").orderBy("page_id", "pos")
    new = arrivals.withColumn("n_", F.row_number().over(first)).where("n_ = 1").drop("n_").join(known.select("provider", "external_id"), ["provider", "external_id"], "left_anti")
    per = new.groupBy("provider", "account", "kind", "run", "page_id").agg(F.count(F.lit(1)).alias("c"))
    earlier = Window.partitionBy("provider", "account", "kind", "run").orderBy("page_id").rowsBetween(Window.unboundedPreceding, -1)
    before = per.select("page_id", F.coalesce(F.sum("c").over(earlier), F.lit(0)).alias("before"))
    inside = new.withColumn("at", F.row_number().over(Window.partitionBy("page_id").orderBy("pos")) - 1)
    more = [c for c in keep or [] if c != "provider"]
    return inside.join(before, "page_id").select("provider", "external_id", *more, (F.col("anchor") - F.col("before") - F.col("at")).alias("sort_key"))


def reset_for_replay(items: DataFrame, pages: DataFrame, provider: str) -> tuple[DataFrame, DataFrame]:
    """Items without those of ``provider``, and pages with its own pending again."""
    own = F.col("provider").eqNullSafe(provider)
    return items.where(~own), pages.withColumn("status", F.when(own, "pending").otherwise(F.col("status")))


def clear_pages(pages: DataFrame, provider: str | None = None) -> DataFrame:
    """The archive without the pages of ``provider``, or without any."""
    return pages.where(~F.col("provider").eqNullSafe(provider)) if provider else pages.limit(0)
