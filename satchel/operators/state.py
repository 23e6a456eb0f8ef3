"""Merging batches into the item table, and the marks that users set on rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ["provider", "account", "external_id"]
REPLACED = ["url", "title", "publication", "summary", "image", "kind", "duration", "poster_name", "poster_handle", "poster_bio", "stats"]
TEXT_OF_VECTOR = ["title", "publication", "summary"]
#: Rows of a bucket whose sums are run up before rows are.
BUCKET = 4096
#: Columns whose absent value is an empty text; zero stands for none in the numbers.
BLANK = ["url", "title", "publication", "summary", "image", "kind", "poster_name", "poster_handle", "poster_bio"]
ZERO_IS_NONE = ["duration", "bookmarked_at", "published_at"]


def coerced(batch: DataFrame) -> DataFrame:
    """Null texts become empty, zero durations and times become null."""
    changes = {c: F.coalesce(F.col(c), F.lit("")) for c in BLANK if c in batch.columns}
    changes |= {c: F.nullif(F.col(c), F.lit(0)) for c in ZERO_IS_NONE if c in batch.columns}
    return batch.withColumns(changes)


def union_names(ordered: Column) -> Column:
    """First spelling of each name in array order: trimmed, blanks dropped, case ignored."""
    names = F.filter(F.transform(ordered, lambda n: F.trim(n)), lambda n: n != "")
    low = F.transform(names, lambda n: F.lower(n))
    return F.filter(names, lambda n, i: F.array_position(low, F.lower(n)) == i + 1)


def united(batch: DataFrame, by: list[str]) -> DataFrame:
    """(by, incoming): ``union_names`` of all collections of a batch in arrival order ``seq``. Names
    are aggregated one by one, so a key's row holds its distinct names, however many copies it has."""
    each = batch.select(*by, "seq", F.posexplode("collection").alias("pos", "name")).withColumn("name", F.trim("name")).where("name <> ''")
    firsts = each.groupBy(*by, F.lower("name").alias("low")).agg(F.min(F.struct("seq", "pos", "name")).alias("x"))
    return firsts.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["name"]).alias("incoming"))


def collapse(batch: DataFrame, by: list[str] | None = None) -> DataFrame:
    """A batch in arrival order ``seq``, one row a key: last values, last non-null times, the
    united names of all collections, and whether every copy has the same vector text. ``by`` are
    columns that follow from the key."""
    b, key = coerced(batch), [*(by or []), *KEY]
    last = [F.max_by(F.col(c), "seq").alias(c) for c in REPLACED if c in b.columns]
    times = [F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c) for c in ("bookmarked_at", "published_at") if c in b.columns]
    same = F.struct(*TEXT_OF_VECTOR)
    rows = b.groupBy(*key).agg(*last, *times, F.min("seq").alias("first_seq"), F.count(F.lit(1)).alias("copies"), F.min(same).alias("text_min"), F.max(same).alias("text_max"))
    # both halves meet in a grouping, which finds keys with nulls too and is dealt out like any other by its key
    given = [c for c in rows.columns if c not in key]
    halves = rows.select(*key, F.struct(*given).alias("row")).unionByName(united(b, key), allowMissingColumns=True)
    both = halves.groupBy(*key).agg(F.first("row", ignorenulls=True).alias("row"), F.first("incoming", ignorenulls=True).alias("incoming"))
    return both.select(*key, "row.*", F.coalesce("incoming", F.array().cast("array<string>")).alias("incoming"))


def upsert(items: DataFrame, batch: DataFrame, now_ms: int, sort_key_start: int | None = None) -> DataFrame:
    """The table after ``batch`` (seq, item columns). Most columns are replaced; times keep the
    old value where the new one is null; collections are united; created_at, sort_key,
    deleted_at and starred_at are frozen; the vector stays only if title, publication and
    summary of every copy equal the stored ones. New rows get falling keys from
    ``sort_key_start`` in order of arrival; an id known under another account takes the next
    key without using it up."""
    new = collapse(batch)
    both = _stored(items, []).join(new, KEY, "full_outer")
    known = items.select("provider", "external_id").distinct().withColumn("known", F.lit(True))
    both = both.join(known, ["provider", "external_id"], "left")
    if sort_key_start is not None:
        both = both.join(_new_keys(both.where("stored IS NULL"), batch), KEY, "left")
    return both.select(*_merged(items.columns, new.columns, now_ms, sort_key_start))


def upsert_slots(items: DataFrame, batch: DataFrame, now_ms: int, sort_key_start: int | None = None) -> DataFrame:
    """What ``upsert`` gives, for rows with a column ``slot`` on both sides that is the same for
    all rows of one (provider, external_id). Stored rows and new ones take ways of their own,
    each joined by slot and key, so a table dealt by slot isn't moved; the batch is."""
    new = collapse(batch, ["slot"])
    updated = _stored(items, ["slot"]).join(new, ["slot", *KEY], "left")
    unstored = new.join(items.select("slot", *KEY), ["slot", *KEY], "left_anti")
    known = items.select("slot", "provider", "external_id").distinct().withColumn("known", F.lit(True))
    fresh = unstored.join(known, ["slot", "provider", "external_id"], "left")
    blank = {f"old_{f.name}": F.lit(None).cast(f.dataType) for f in items.schema if f.name not in (*KEY, "slot")}
    fresh = fresh.withColumns({**blank, "stored": F.lit(None).cast("boolean")})
    if sort_key_start is not None:
        updated = updated.withColumn("before", F.lit(None).cast("long"))
        fresh = fresh.join(_new_keys(fresh, batch), KEY, "left")
    out = _merged([c for c in items.columns if c != "slot"], new.columns, now_ms, sort_key_start)
    return updated.select(*out, "slot").unionByName(fresh.select(*out, "slot"))


def _stored(items: DataFrame, by: list[str]) -> DataFrame:
    """``items`` as the old side of a merge."""
    return items.select(*(F.col(c) if c in (*KEY, *by) else F.col(c).alias(f"old_{c}") for c in items.columns)).withColumn("stored", F.lit(True))


def _new_keys(fresh: DataFrame, batch: DataFrame) -> DataFrame:
    """(KEY, before): how many keys earlier new rows of the batch use up. Of several accounts of
    one new id the first to arrive counts as new."""
    ranked = fresh.select(*KEY, "first_seq", F.col("known").isNull().cast("long").alias("uses"))
    firsts = Window.partitionBy("provider", "external_id").orderBy("first_seq")
    ranked = ranked.withColumn("uses", F.when(F.row_number().over(firsts) == 1, F.col("uses")).otherwise(F.lit(0)))
    low, high, n = batch.agg(F.min("seq"), F.max("seq"), F.count(F.lit(1))).first()
    width = max(1, -(-(high - low + 1) * BUCKET // n)) if n else 1
    return running(ranked, "first_seq", "uses", width).select(*KEY, "before")


def _merged(columns: list[str], given: list[str], now_ms: int, sort_key_start: int | None) -> list[Column]:
    """The columns of the merged table, from old_ columns, those ``given`` by the batch, and the
    marks stored, first_seq and before."""
    touched, fresh = F.col("first_seq").isNotNull(), F.col("stored").isNull()
    keep_vector = F.col("text_min").eqNullSafe(F.col("text_max")) & F.col("text_max").eqNullSafe(F.struct(*(F.col(f"old_{c}").alias(c) for c in TEXT_OF_VECTOR)))
    out = [F.col(c) for c in KEY]
    for c in columns:
        if c in KEY:
            continue
        o = F.col(f"old_{c}")
        if c in REPLACED and c in given:
            v = F.when(touched, F.col(c)).otherwise(o)
        elif c in ("bookmarked_at", "published_at") and c in given:
            v = F.coalesce(F.col(c), o)
        elif c == "collection":
            v = F.when(touched, union_names(F.concat(F.coalesce(o, F.array().cast("array<string>")), F.coalesce("incoming", F.array().cast("array<string>"))))).otherwise(o)
        elif c == "created_at":
            v = F.when(fresh, F.lit(now_ms)).otherwise(o)
        elif c == "sort_key" and sort_key_start is not None:
            v = F.when(fresh, F.lit(sort_key_start) - F.col("before")).otherwise(o)
        elif c in ("embedding", "embedding_model"):
            v = F.when(~touched | (~fresh & keep_vector), o)
        else:
            v = o
        out.append(v.alias(c))
    return out


def running(rows: DataFrame, order: str, value: str, width: int = BUCKET) -> DataFrame:
    """``rows`` with ``before``: the sum of ``value`` over rows earlier by ``order``. Sums of
    buckets of ``width`` (chosen so that one holds about BUCKET rows) are run up first, so no
    task sees all rows."""
    b = rows.withColumn("b_", F.floor(F.col(order) / width))
    sums = b.groupBy("b_").agg(F.sum(value).alias("s"))
    base = sums.select("b_", F.coalesce(F.sum("s").over(Window.orderBy("b_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    inside = F.coalesce(F.sum(value).over(Window.partitionBy("b_").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return b.withColumn("in_", inside).join(base, "b_").withColumn("before", F.col("base") + F.col("in_")).drop("b_", "in_", "base")


def upsert_counts(items: DataFrame, batch: DataFrame) -> DataFrame:
    """inserted: ids of the batch not known to their provider; updated: all other copies."""
    known = items.select("provider", "external_id").distinct()
    ids = batch.groupBy("provider", "external_id").agg(F.count(F.lit(1)).alias("n"))
    total = ids.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    inserted = ids.join(known, ["provider", "external_id"], "left_anti").agg(F.count(F.lit(1)).alias("inserted"))
    return total.join(inserted, F.lit(True)).select("inserted", (F.col("total") - F.col("inserted")).alias("updated"))


def latest_marks(log: DataFrame, on: str, off: str) -> DataFrame:
    """The last of two opposite actions per item: (item_id, at_ms if it is on)."""
    last = log.where(F.col("action").isin(on, off)).groupBy("item_id").agg(F.max_by(F.struct("action", "at_ms"), F.struct("at_ms", "seq")).alias("x"))
    return last.select("item_id", F.when(F.col("x.action") == on, F.col("x.at_ms")).alias("mark"), F.lit(True).alias("set"))


def apply_marks(items: DataFrame, log: DataFrame, column: str, on: str, off: str) -> DataFrame:
    """``items`` with ``column`` set or cleared by the last action on each id."""
    marks = latest_marks(log, on, off)
    joined = items.join(marks, items.id == marks.item_id, "left")
    return joined.withColumn(column, F.when(F.col("set"), F.col("mark")).otherwise(F.col(column))).select(*items.columns)


def clear_items(items: DataFrame, provider: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(what is left, number cleared), deleted rows included."""
    match = F.col("provider").eqNullSafe(provider) if provider else F.lit(True)
    return items.where(~match), items.where(match).agg(F.count(F.lit(1)).alias("n"))


def store_embeddings(items: DataFrame, vectors: DataFrame, model: str) -> DataFrame:
    """``items`` with the vectors of ``vectors`` (id, vector) and their model."""
    v = vectors.select(F.col("id").alias("vid"), F.col("vector"))
    joined = items.join(v, items.id == v.vid, "left")
    got = F.col("vid").isNotNull()
    return joined.withColumn("embedding", F.when(got, F.col("vector")).otherwise(F.col("embedding"))).withColumn("embedding_model", F.when(got, F.lit(model)).otherwise(F.col("embedding_model"))).select(*items.columns)
