"""Listing, counting and picking items. Items are rows of the item table; deleted rows stay in
it and are left out here unless the trash is asked for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def order_key() -> Column:
    return F.coalesce("sort_key", "created_at")


def visible(items: DataFrame, trash: bool = False, starred: bool = False, provider: str | None = None) -> DataFrame:
    out = items.where(F.col("deleted_at").isNotNull() if trash else F.col("deleted_at").isNull())
    if starred:
        out = out.where(F.col("starred_at").isNotNull())
    return out.where(F.col("provider") == provider) if provider else out


def list_items(items: DataFrame, limit: int = 1000, offset: int = 0, **which) -> DataFrame:
    """Newest pickup first, ties by id: a top-k, not a full sort."""
    return visible(items, **which).orderBy(order_key().desc(), F.col("id").asc()).offset(offset).limit(limit)


def list_after(items: DataFrame, key: int, id_: int, size: int = 200, **which) -> DataFrame:
    """The page after the row (key, id): keyset paging reads no earlier rows."""
    later = (order_key() < key) | ((order_key() == key) & (F.col("id") > id_))
    return visible(items, **which).where(later).orderBy(order_key().desc(), F.col("id").asc()).limit(size)


def page_numbers(items: DataFrame, size: int = 200, bucket_ms: int = 1 << 14, **which) -> DataFrame:
    """Every listed row with its 0-based rank per provider and its page. Rows are ranked in
    buckets of the key and buckets are summed up, so a large provider is many tasks."""
    rows = visible(items, **which).withColumn("k", order_key()).withColumn("b", F.floor(F.col("k") / bucket_ms))
    counts = rows.groupBy("provider", "b").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("provider").orderBy(F.col("b").desc()).rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("provider", "b", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    inside = Window.partitionBy("provider", "b").orderBy(F.col("k").desc(), "id")
    ranked = rows.withColumn("r", F.row_number().over(inside)).join(base, ["provider", "b"])
    return ranked.select("provider", "id", (F.col("base") + F.col("r") - 1).alias("rank")).withColumn("page", F.floor(F.col("rank") / size))


def count_items(items: DataFrame, **which) -> DataFrame:
    return visible(items, **which).agg(F.count(F.lit(1)).alias("n"))


def provider_stats(items: DataFrame) -> DataFrame:
    return visible(items).groupBy("provider").agg(F.count(F.lit(1)).alias("n"), F.max(order_key()).alias("max_key"))


def provider_status(providers: DataFrame, items: DataFrame, sync_state: DataFrame) -> DataFrame:
    """Every registered provider (id, label, enabled) with its counts and last good run."""
    return (
        providers.withColumnRenamed("id", "provider").join(provider_stats(items), "provider", "left").join(sync_state, "provider", "left")
        .select("provider", "label", "enabled", F.coalesce("n", F.lit(0)).alias("n"), "max_key", "synced_at")
    )


def sort_key_min(items: DataFrame) -> DataFrame:
    return items.agg(F.min("sort_key").alias("min_key"))


def known_ids(items: DataFrame, provider: str | None = None, created_before: int | None = None) -> DataFrame:
    """Ids a run need not fetch again: deleted rows count; a cutoff of 0 or none is no cutoff."""
    out = items.where(F.col("provider") == provider) if provider else items
    return (out.where(F.col("created_at") <= created_before) if created_before else out).select("provider", "external_id")


def fetch_by_ids(items: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows for ``ids`` (pos, id): missing ids are left out, repeated ones repeat."""
    return ids.join(items, "id")


def embedding_stats(items: DataFrame, model: str) -> DataFrame:
    done = F.col("embedding").isNotNull() & F.col("embedding_model").eqNullSafe(model)
    got = visible(items).agg(F.count(F.lit(1)).alias("total"), F.coalesce(F.sum(done.cast("long")), F.lit(0)).alias("embedded"))
    return got.withColumn("backlog", F.col("total") - F.col("embedded"))


def pending_embeddings(items: DataFrame, model: str, limit: int | None = None) -> DataFrame:
    """Live rows without a vector of this model and recipe; with ``limit`` the newest ids first."""
    pending = visible(items).where(F.col("embedding").isNull() | ~F.col("embedding_model").eqNullSafe(model))
    return pending if limit is None else pending.orderBy(F.col("id").desc()).limit(limit)


#: Names that readers of items know the columns by (fixed values).
READ_AS = {
    "external_id": "externalId", "poster_name": "posterName", "poster_handle": "posterHandle", "poster_bio": "posterBio",
    "bookmarked_at": "bookmarkedAt", "published_at": "publishedAt", "created_at": "createdAt", "deleted_at": "deletedAt", "starred_at": "starredAt",
}
JSON_COLUMNS = {"collection": "array<string>", "stats": "map<string,string>"}


def as_read(items: DataFrame) -> DataFrame:
    """Items as readers get them: columns renamed, JSON texts decoded, without the vector, its
    model and the pickup key."""
    kinds = dict(items.dtypes)
    out = []
    for c in items.columns:
        if c in ("embedding", "embedding_model", "sort_key"):
            continue
        value = F.from_json(c, JSON_COLUMNS[c]) if c in JSON_COLUMNS and kinds[c] == "string" else F.col(c)
        out.append(value.alias(READ_AS.get(c, c)))
    return items.select(*out)
