"""The item table in buckets against the merge of whole tables."""

import pytest
from pyspark.sql import functions as F

from satchel.operators import state as M
from satchel.plans.archive_queries import _folder
from satchel.sources.buckets import BucketTable, slot_of
from satchel.streaming.merge import merge_into
from tests.test_merge import BATCH, SCHEMA


def stored(spark, n=600):
    key = F.col("id").cast("string")
    text = F.concat(F.lit("t"), key)
    return spark.range(n).select(
        F.concat(F.lit("p"), (F.col("id") % 3).cast("string")).alias("provider"), F.lit("u").alias("account"), key.alias("external_id"), F.lit("").alias("url"), text.alias("title"), F.lit("").alias("publication"), F.lit("").alias("summary"),
        F.lit(None).cast("long").alias("bookmarked_at"), F.array(F.lit("X")).alias("collection"), F.lit(1).cast("long").alias("created_at"), F.col("id").alias("sort_key"), F.lit(None).cast("long").alias("deleted_at"), F.lit(None).cast("long").alias("starred_at"), F.array(F.lit(1.0).cast("float")).alias("embedding"), F.lit("m").alias("embedding_model"),
    ).to(spark.createDataFrame([], SCHEMA).schema)


def batch(spark, keys, first=0):
    rows = [(first + k, f"p{i % 3}", "v" if i % 50 == 0 else "u", str(i), "u", f"t{i}" if i % 2 else "new", None, "", 5, ["x ", "Y"]) for k, i in enumerate(keys)]
    return spark.createDataFrame(rows, BATCH)


def rows(df, drop=("slot",)):
    return sorted(map(repr, df.drop(*drop).collect()))


@pytest.fixture
def table(spark):
    items = stored(spark)
    return BucketTable(spark, _folder(spark, "t"), items.schema, 32).create(items)


def step(old, new):
    return M.upsert_slots(old, new, 100, 1000)


def test_merge_equals_upsert_and_writes_touched_buckets_only(spark, table):
    items, new = stored(spark), batch(spark, [5, 5, 50, 700, 701])
    touched = table.merge(step, new)
    assert touched == sorted({r[0] for r in new.select(slot_of(32)).collect()}) and len(touched) < 6
    assert rows(table.read()) == rows(M.upsert(items, new, 100, 1000).select(*items.columns))
    assert rows(table.read(0)) == rows(items)
    gens = table.manifest(1)
    assert sorted(s for s, g in gens.items() if g.startswith("1-")) == touched and len(gens) == 32


def test_no_exchange_above_the_table(spark, table):
    new = batch(spark, range(400, 900)).withColumn("slot", slot_of(32))
    old = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.requireAllClusterKeysForCoPartition", "spark.sql.adaptive.enabled")}
    try:
        for k, v in zip(old, ("-1", "false", "false"), strict=True):
            spark.conf.set(k, v)
        plan = M.upsert_slots(table.read(), new, 100, 1000)._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    depth = lambda line: len(line) - len(line.lstrip(" :+-*"))
    scans, above = 0, []
    for line in plan.splitlines():
        while above and above[-1][0] >= depth(line):
            above.pop()
        if "FileScan" in line and table.name in line:
            scans += 1
            assert "SortMergeJoin" in " ".join(x for _, x in above) and "Bucketed: true" in line
            first_join = max(k for k, (_, x) in enumerate(above) if "SortMergeJoin" in x)
            assert not [x for _, x in above[first_join:] if "Exchange" in x]
        above.append((depth(line), line))
    assert scans > 1


def test_new_session_failed_attempts_and_expiry(spark, table):
    for k in range(3):
        table.merge(step, batch(spark, [k, 900 + k], 10 * k))
    want = rows(table.read())
    # an attempt that dies before its manifest leaves files that nobody reads
    table.read().limit(3).withColumns({"gen": F.lit("9-dead"), "part": F.col("slot")}).write.partitionBy("gen", "part").mode("append").parquet(f"{table.folder}/data")
    assert table.expire(2) > 0 and table.versions() == [2, 3]
    other = BucketTable(spark.newSession(), table.folder, table.schema, 32)
    other.spark.sql(f"DROP TABLE {table.name}")
    assert rows(other.read()) == want and table.expire(2) == 0


def test_stream_and_batch_run_again(spark, table):
    path, log = _folder(spark, "arriving"), _folder(spark, "log")
    parts = [batch(spark, range(590, 620)), batch(spark, range(600, 640), 100), batch(spark, [3], 200)]
    for p in parts:
        p.coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(BATCH).option("maxFilesPerTrigger", 1).parquet(path)
    plain = lambda old, new: M.upsert_slots(old, new, 100)
    merge_into(stream, table, plain, log)
    want = M.upsert(stored(spark), parts[0].unionByName(parts[1]).unionByName(parts[2]), 100)
    assert rows(table.read()) == rows(want.select(*table.schema.names))
    before = table.versions()
    table.merge(plain, parts[2], before[-1])
    assert table.versions() == before and rows(table.read()) == rows(want.select(*table.schema.names))
    with pytest.raises(ValueError):
        merge_into(stream, table, plain, log, keep=1)


def test_empty_batch_and_empty_table(spark):
    empty = stored(spark, 0)
    table = BucketTable(spark, _folder(spark, "t"), empty.schema, 4).create(empty)
    assert table.merge(step, batch(spark, []).limit(0)) == [] and table.read().count() == 0
    table.merge(step, batch(spark, [1, 2]))
    assert table.read().count() == 2
