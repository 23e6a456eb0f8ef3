"""Snapshots compared by digests of buckets first."""

import collections

from satchel.operators import snapshots as D

SCHEMA = "k int, u string, v string, w double"


def test_equal_snapshots_move_no_rows(spark):
    rows = [(k % 50, f"a{k}", None if k % 3 else "x", k / 7) for k in range(300)] + [(1, None, None, None)] * 3
    df, shuffled = spark.createDataFrame(rows, SCHEMA).repartition(3), spark.createDataFrame(rows[::-1], SCHEMA).repartition(5)
    for key in (None, ["k"]):
        before, after = D.differing(df, shuffled, key)
        assert before.count() == after.count() == 0


def test_rows_repeats_and_moved_nulls_are_found(spark):
    rows = [(k, f"a{k}", "b", 1.0) for k in range(200)]
    other = [*rows[5:], (0, "a0", "changed", 1.0), rows[7], (500, None, "z", None)]
    one, two = [*rows, (600, "z", None, None)], [*other, (600, None, "z", None)]
    b, a = spark.createDataFrame(one, SCHEMA), spark.createDataFrame(two, SCHEMA)
    count = lambda x, y: sum(n != collections.Counter(y)[r] for r, n in collections.Counter(x).items())
    got = D.multiset_difference(*D.differing(b, a)).first()
    assert (got.only_before, got.only_after) == (count(one, two), count(two, one))
    before, after = D.differing(b, a, ["k"], 64)
    assert {(r.column, r.cells) for r in D.changed_cells(before, after, ["k"]).collect()} == {(r.column, r.cells) for r in D.changed_cells(b, a, ["k"]).collect()}
    assert before.count() < len(one)


def test_empty_snapshots(spark):
    empty, some = spark.createDataFrame([], SCHEMA), spark.createDataFrame([(1, "a", "b", 1.0)], SCHEMA)
    assert [df.count() for df in D.differing(empty, empty)] == [0, 0]
    assert [df.count() for df in D.differing(empty, some)] == [0, 1]
