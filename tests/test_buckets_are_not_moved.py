"""A merge leaves the table where it is, however many shuffle partitions there are, and its slots grow with it."""

from satchel.operators import state as M
from satchel.sources.buckets import SLOT_BYTES, slots_for
from tests.test_buckets import batch, rows, stored, table  # noqa: F401


def test_table_of_fewer_buckets_than_partitions_stays(spark, table):  # noqa: F811
    plans, new = [], batch(spark, range(400, 900))

    def step(old, dealt):
        out = M.upsert_slots(old, dealt, 100, 1000)
        plans.append(out._jdf.queryExecution().executedPlan().toString())
        return out

    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "100"}
    old = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        table.merge(step, new)
        assert spark.conf.get("spark.sql.shuffle.partitions") == "100"
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    scans = [line for line in plans[0].splitlines() if "FileScan" in line and table.name in line]
    assert len(scans) > 1 and all("Bucketed: true" in line for line in scans)
    assert rows(table.read()) == rows(M.upsert(stored(spark), new, 100, 1000).select(*table.schema.names))


def test_slots_grow_with_the_table():
    assert slots_for(0, 16) == slots_for(16 * SLOT_BYTES, 16) == 16
    assert slots_for(100 * SLOT_BYTES, 16) == 128
