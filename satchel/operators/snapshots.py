"""Comparing two versions of a table: rows as multisets, and cells by key."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from satchel.session import written


def common_columns(before: DataFrame, after: DataFrame) -> list[str]:
    return [c for c in before.columns if c in after.columns]


def schema_changed(before: DataFrame, after: DataFrame) -> bool:
    return [(f.name, f.dataType, f.nullable) for f in before.schema] != [(f.name, f.dataType, f.nullable) for f in after.schema]


def inventory(before: dict[str, DataFrame], after: dict[str, DataFrame]) -> DataFrame:
    """(table, before_rows, after_rows) of two snapshots; null where a table is missing."""
    out = None
    for name in sorted(before.keys() | after.keys()):
        sides = [s[name].agg(F.count(F.lit(1)).alias(c)) if name in s else None for s, c in ((before, "before_rows"), (after, "after_rows"))]
        there = next(s for s in sides if s is not None)
        row = sides[0].join(sides[1], F.lit(True)) if None not in sides else there
        row = row.select(F.lit(name).alias("table"), *(F.col(c) if c in row.columns else F.lit(None).cast("long").alias(c) for c in ("before_rows", "after_rows")))
        out = row if out is None else out.unionByName(row)
    return out


def schema_difference(before: DataFrame, after: DataFrame) -> DataFrame:
    """(column, before, after, before_cells, after_cells, changed) of every column of either
    side, in the order of ``before``: its place and type, or null, and how many values it has."""
    names = [*before.columns, *(c for c in after.columns if c not in before.columns)]
    told = lambda df, c: f"{df.columns.index(c)} {df.schema[c].dataType.simpleString()}" if c in df.columns else None
    cells = lambda df, side: df.agg(*(F.count(F.col(c) if c in df.columns else F.lit(None)).alias(f"{side}{i}") for i, c in enumerate(names)))
    both = cells(before, "b").join(cells(after, "a"), F.lit(True))
    rows = []
    for i, c in enumerate(names):
        x, y = told(before, c), told(after, c)
        changed = x != y or before.schema[c].nullable != after.schema[c].nullable
        rows.append(F.struct(F.lit(c).alias("column"), F.lit(x).cast("string").alias("before"), F.lit(y).cast("string").alias("after"), F.col(f"b{i}").alias("before_cells"), F.col(f"a{i}").alias("after_cells"), F.lit(changed).alias("changed")))
    return both.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def unique_keys(before: DataFrame, after: DataFrame, candidates: list[list[str]]) -> DataFrame:
    """(key, before_unique, after_unique) of ``candidates``: whether no side repeats or lacks one."""
    out = None
    for key in candidates:
        sides = []
        for df in (before, after):
            per = df.groupBy(*key).agg(F.count(F.lit(1)).alias("c")).select("c", F.greatest(*(F.col(k).isNull() for k in key), F.lit(False)).alias("null_"))
            sides.append(per.agg(~F.coalesce(F.bool_or((F.col("c") > 1) | F.col("null_")), F.lit(False))))
        row = sides[0].toDF("before_unique").join(sides[1].toDF("after_unique"), F.lit(True)).select(F.lit(",".join(key)).alias("key"), "before_unique", "after_unique")
        out = row if out is None else out.unionByName(row)
    return out


def chosen_key(before: DataFrame, after: DataFrame, explicit: list[str] | None = None, primary: list[str] | None = None, unique: dict[str, list[str]] | None = None) -> list[str] | None:
    """The key to compare by: the ``explicit`` one, whose columns both sides must have, else the
    ``primary`` one, else the first of the ``unique`` ones by name that both sides have."""
    shared = set(common_columns(before, after))
    if explicit:
        if lacking := [c for c in explicit if c not in shared]:
            raise ValueError(f"no such key column on both sides: {', '.join(lacking)}")
        return explicit
    if primary and shared.issuperset(primary):
        return primary
    return next((k for _, k in sorted((unique or {}).items()) if shared.issuperset(k)), None)


def row_counts(before: DataFrame, after: DataFrame) -> DataFrame:
    n = F.count(F.lit(1))
    return before.agg(n.alias("before_rows")).join(after.agg(n.alias("after_rows")), F.lit(True))


def multiset_difference(before: DataFrame, after: DataFrame) -> DataFrame:
    """Distinct rows-with-multiplicity that one side alone has; one shuffle on the row's cells."""
    cols = common_columns(before, after)
    tag = lambda df, s: df.select(*cols, F.lit(s).alias("side"))
    counts = tag(before, 0).unionByName(tag(after, 1)).groupBy(*cols).agg(F.sum(1 - F.col("side")).alias("b"), F.sum("side").alias("a"))
    differs = F.col("a") != F.col("b")
    count = lambda c: F.coalesce(F.sum((differs & (F.col(c) > 0)).cast("long")), F.lit(0))
    return counts.agg(count("b").alias("only_before"), count("a").alias("only_after"))


def differing(before: DataFrame, after: DataFrame, key: list[str] | None = None, buckets: int = 4096) -> tuple[DataFrame, DataFrame]:
    """The rows of both sides in buckets (by hash of ``key``, or of the whole row) whose contents
    differ. Each side sends a count and two sums of row hashes a bucket, whatever the order of
    rows and their repeats; buckets that agree in all three (128 bits of hash and the count)
    hold the same rows, and no row of theirs is moved. Both results have the common columns."""
    cols = common_columns(before, after)
    bucket = F.pmod(F.xxhash64(*(key or cols)), F.lit(buckets))
    # the hash passes over nulls, so where they are is hashed as well
    nulls = F.concat(*(F.when(F.col(c).isNull(), "1").otherwise("0") for c in cols))
    sums = lambda df: df.select(bucket.alias("bucket"), *(F.xxhash64(F.lit(s), nulls, *cols).cast("decimal(38,0)").alias(f"h{s}") for s in (1, 2))).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.sum("h1").alias("h1"), F.sum("h2").alias("h2"))
    both = sums(before).alias("b").join(sums(after).alias("a"), F.col("b.bucket") == F.col("a.bucket"), "full_outer")
    same = F.col("b.n").eqNullSafe(F.col("a.n")) & F.col("b.h1").eqNullSafe(F.col("a.h1")) & F.col("b.h2").eqNullSafe(F.col("a.h2"))
    open_ = written(both.where(~same).select(F.coalesce("b.bucket", "a.bucket").alias("bucket_")), "open_buckets", rows=buckets)
    rows = lambda df: df.select(*cols, bucket.alias("bucket_")).join(F.broadcast(open_), "bucket_", "left_semi").select(*cols)
    return rows(before), rows(after)


def surplus_keys(df: DataFrame, key: list[str]) -> DataFrame:
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("c")).agg(F.coalesce(F.sum(F.col("c") - 1), F.lit(0)).alias("surplus"))


def _same_key(key: list[str]) -> Column:
    return reduce(lambda x, y: x & y, (F.col(f"b.{k}").eqNullSafe(F.col(f"a.{k}")) for k in key))


def missing_rows(before: DataFrame, after: DataFrame, key: list[str]) -> DataFrame:
    """Rows without a partner by key: in ``before`` only and in ``after`` only."""
    n = F.count(F.lit(1))
    gone = before.alias("b").join(after.select(*key).alias("a"), _same_key(key), "left_anti").agg(n.alias("missing"))
    new = after.alias("a").join(before.select(*key).alias("b"), _same_key(key), "left_anti").agg(n.alias("new"))
    return gone.join(new, F.lit(True))


def changed_cells(before: DataFrame, after: DataFrame, key: list[str]) -> DataFrame:
    """(column, cells) with changed values among rows with equal keys, and ``*rows*`` for rows;
    columns without changes are left out. Without other columns than the key nothing can change."""
    cols = [c for c in common_columns(before, after) if c not in key]
    pairs = before.alias("b").join(after.alias("a"), _same_key(key))
    flags = pairs.select(*((~F.col(f"b.{c}").eqNullSafe(F.col(f"a.{c}"))).cast("long").alias(c) for c in cols))
    total = flags.withColumn("*rows*", F.greatest(*cols, F.lit(0).cast("long")) if cols else F.lit(0).cast("long")).agg(*(F.sum(c).alias(c) for c in [*cols, "*rows*"]))
    return total.unpivot([], [*cols, "*rows*"], "column", "cells").where("cells > 0")


def verdict(before: DataFrame, after: DataFrame) -> DataFrame:
    d = multiset_difference(before, after)
    return d.select(((F.col("only_before") + F.col("only_after") > 0) | F.lit(schema_changed(before, after))).alias("different"))
