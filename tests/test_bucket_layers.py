"""A batch of few ids writes their rows over the table's slots; readers see the last of each."""

from pyspark.sql import functions as F

from satchel.operators import state as M
from satchel.sources.buckets import BucketTable
from tests.test_buckets import batch, rows, stored, table  # noqa: F401
from tests.test_merge import BATCH


def step(old, new):
    return M.upsert_slots(old, new, 100, 1000)


def no_ids(spark, seq):
    """Rows without an id or a part of it, which match nothing."""
    return spark.createDataFrame([(seq, None, "u", "5", "u", "n", None, "", 5, ["z"]), (seq + 1, "p1", "u", None, "u", "n", None, "", 5, ["z"])], BATCH)


def test_rows_written_are_those_of_the_batch(spark, table):  # noqa: F811
    table.merge(step, batch(spark, [5, 5, 50, 700, 701]))
    written = spark.read.parquet(f"{table.folder}/data").where("gen LIKE '1-%'")
    # 50 is stored under another account than it comes with
    assert sorted((r.external_id, r.account) for r in written.collect()) == [("5", "u"), ("50", "u"), ("50", "v"), ("700", "v"), ("701", "u")]
    assert table.read().count() == 603


def test_layers_then_whole_slots(spark, table):  # noqa: F811
    batches = [batch(spark, [3, 50, 700]).unionByName(no_ids(spark, 50)), batch(spark, [3, 4, 50, 701], 100).unionByName(no_ids(spark, 150)), batch(spark, [700, 700, 3], 200)]
    want, seen = stored(spark), []
    for b in batches:
        table.merge(step, b)
        want = M.upsert(want, b, 100, 1000).select(*table.schema.names).localCheckpoint()
        seen.append(rows(want))
        assert rows(table.read()) == seen[-1]
    assert rows(table.read(1)) == seen[0] and max(map(len, table.layers(3).values())) == 4
    # of the kept versions all layers stay
    assert table.expire(2) == 0 and rows(table.read(2)) == seen[1]
    big = batch(spark, range(0, 500), 300)
    touched = table.merge(step, big)
    assert len(touched) == 32 and all(len(of) == 1 for of in table.layers(4).values())
    want = rows(M.upsert(want, big, 100, 1000).select(*table.schema.names))
    assert rows(table.read()) == want
    assert table.expire(1) > 0
    assert rows(BucketTable(spark, table.folder, table.schema, 32).read()) == want
    assert spark.read.parquet(f"{table.folder}/data").agg(F.count_distinct("gen")).first()[0] == 1
