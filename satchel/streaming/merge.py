"""Pages that arrive as a stream, merged batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from satchel.operators import replay as Y
from satchel.operators import state as M
from satchel.operators import sync as I
from satchel.sources.buckets import BucketTable

WALK = ["provider", "account", "kind"]


def merge_stream(stream: DataFrame, step: Callable[[DataFrame, DataFrame], DataFrame], start: DataFrame, folder: str) -> DataFrame:
    """The table after ``step(table, batch)`` for every batch that is there. Each batch writes the
    version of its own number from the one before, so a batch that is run twice gives the same
    table; ``folder`` is one that all executors share and holds versions and checkpoint."""
    spark = start.sparkSession

    def each(batch: DataFrame, n: int) -> None:
        own = batch.sparkSession
        old = own.read.schema(start.schema).parquet(f"{folder}/v{n - 1}") if n else start
        step(old, batch).write.mode("overwrite").parquet(f"{folder}/v{n}")
        own.range(n, n + 1).coalesce(1).write.mode("overwrite").parquet(f"{folder}/latest")

    q = stream.writeStream.foreachBatch(each).option("checkpointLocation", f"{folder}/log").trigger(availableNow=True).start()
    q.awaitTermination()
    n = spark.read.parquet(f"{folder}/latest").first()[0]
    return spark.read.schema(start.schema).parquet(f"{folder}/v{n}")


def merge_into(stream: DataFrame, table: BucketTable, step: Callable[[DataFrame, DataFrame], DataFrame], log: str, keep: int = 2) -> BucketTable:
    """``table`` after ``step(old, batch)`` for every batch that is there; a batch reads and
    rewrites the buckets it touches, and ``keep`` versions stay (two at least: a batch that is
    run twice starts from the version before its own). ``log`` is the checkpoint's folder."""
    if keep < 2:
        raise ValueError("the version before the last must stay")

    def each(batch: DataFrame, n: int) -> None:
        own = BucketTable(batch.sparkSession, table.folder, table.schema, table.slots)
        own.merge(step, batch, n + 1)
        own.expire(keep)

    stream.writeStream.foreachBatch(each).option("checkpointLocation", log).trigger(availableNow=True).start().awaitTermination()
    return table


def without_repeats(stream: DataFrame, keys: list[str], at: str, late: str = "1 day") -> DataFrame:
    """One row per ``keys`` of rows at most ``late`` apart by ``at`` (a timestamp); state is let go
    as the watermark passes."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


def first_of(table: DataFrame, batch: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """A merge step: of each key the row that comes first by ``order``, whichever batch had it."""
    rows = table.unionByName(batch.select(*table.columns))
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*table.columns), F.struct(*order)).alias("x")).select("x.*")


def followed_by(step: Callable[[DataFrame, DataFrame], DataFrame], after: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, DataFrame], DataFrame]:
    """A merge step whose merged table goes through ``after``, such as embedding the backlog."""
    return lambda table, batch: after(step(table, batch))


def merge_pages(stream: DataFrame, items: DataFrame, now_ms: int, folder: str) -> DataFrame:
    """The item table after every page of ``stream`` (page_id, provider, account, kind, page,
    fetched_at, body, context) that is there: each batch is parsed and merged before the next,
    and new rows get the keys that one job over all pages would give, falling from the time of
    their run's first page, whichever batch had it. ``folder`` holds, by batch number, the
    table's versions, the pages' metadata and how many new rows each run has had, so a batch
    that is run again gives the same; pages of a walk must arrive in order."""
    spark = items.sparkSession

    def each(batch: DataFrame, n: int) -> None:
        own = batch.sparkSession
        read = lambda name, schema: own.read.schema(schema).parquet(*(f"{folder}/{name}/{k}" for k in range(n)))
        old = own.read.schema(items.schema).parquet(f"{folder}/v/{n - 1}") if n else items
        meta = batch.select("page_id", *WALK, "page", "fetched_at")
        seen = read("meta", meta.schema).unionByName(meta) if n else meta
        rows, _ = Y.arrivals(batch)
        runs = I.open_runs(seen).select("page_id", F.col("run").alias("run_"), F.col("anchor").alias("anchor_"))
        rows = rows.join(runs, "page_id").withColumns({"run": F.col("run_"), "anchor": F.col("anchor_")}).drop("run_", "anchor_").withColumn("kind_of_item", F.col("kind"))
        placed = rows.withColumn("kind", F.col("page_kind"))
        keys = I.pickup_keys(placed, old.select("provider", "external_id").distinct(), keep=[*WALK, "run"])
        counts = keys.groupBy(*WALK, "run").agg(F.count(F.lit(1)).alias("n"))
        if n:
            before = read("new", counts.schema).groupBy(*WALK, "run").agg(F.sum("n").alias("earlier"))
            keys = keys.join(before, [*WALK, "run"], "left").withColumn("sort_key", F.col("sort_key") - F.coalesce("earlier", F.lit(0)))
        merged = M.upsert(old, rows.drop("run", "anchor", "page_kind", "page_id", "pos", "kind_of_item"), now_ms)
        new = keys.select("provider", "external_id", F.col("sort_key").alias("new_key"))
        merged.join(new, ["provider", "external_id"], "left").withColumn("sort_key", F.coalesce("sort_key", "new_key")).select(*items.columns).write.mode("overwrite").parquet(f"{folder}/v/{n}")
        counts.write.mode("overwrite").parquet(f"{folder}/new/{n}")
        meta.write.mode("overwrite").parquet(f"{folder}/meta/{n}")
        own.range(n, n + 1).coalesce(1).write.mode("overwrite").parquet(f"{folder}/latest")

    q = stream.writeStream.foreachBatch(each).option("checkpointLocation", f"{folder}/log").trigger(availableNow=True).start()
    q.awaitTermination()
    n = spark.read.parquet(f"{folder}/latest").first()[0]
    return spark.read.schema(items.schema).parquet(f"{folder}/v/{n}")
