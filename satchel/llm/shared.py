"""What the operators of this subpackage share: Arrow column appenders and text buffers."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

import satchel
from satchel.session import bounded, shared_folder, written

__all__ = ["append_columns", "arrow_groups", "arrow_rows", "bounded", "byte_pieces", "free_name", "mix64", "ship", "shared_folder", "split_join", "written"]

_shipped: set[str] = set()
#: Rows and bytes of an Arrow batch, so that a few long texts don't fill a worker.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20)}


def ship(spark: SparkSession) -> None:
    """Send this package's code to the executors, once per application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(satchel.__file__).parent
    path = os.path.join(tempfile.mkdtemp(prefix="spark-"), "satchel_code.zip")
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, f"satchel/{p.relative_to(root)}")
    spark.sparkContext.addPyFile(path)
    for key, value in BATCH.items():
        spark.conf.set(key, value)
    _shipped.add(app)


def arrow_rows(df: DataFrame, fn: Callable, schema: T.StructType | str) -> DataFrame:
    """``df`` through ``fn`` (record batches to record batches), within its partitions."""
    ship(df.sparkSession)
    return df.mapInArrow(fn, schema)


def arrow_groups(df: DataFrame, key: str, fn: Callable, schema: T.StructType | str) -> DataFrame:
    """``fn`` (table to table) for the rows of each ``key``; callers bound the size of a group."""
    ship(df.sparkSession)
    return df.groupBy(key).applyInArrow(fn, schema)


def split_join(rows: DataFrame, per_key: DataFrame, key: str) -> DataFrame:
    """``rows`` with the columns of ``per_key`` (aggregated by the integer ``key``). Joining on
    the key's complement gives both sides a shuffle of their own, so adaptive execution can
    split a hot key; straight after an aggregation by the key it can't."""
    k = F.bitwise_not(F.col(key))
    return rows.withColumn("k_", k).join(per_key.withColumn("k_", k).drop(key), "k_").drop("k_")


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or with underscores after it where ``df`` has such a column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def append_columns(df: DataFrame, inputs: list[str], fields: list[T.StructField], fn: Callable[..., list], drop: tuple[str, ...] = ()) -> DataFrame:
    """``df`` plus ``fields``, which ``fn`` computes from Arrow arrays of ``inputs``, a batch
    at a time. A column of ``df`` that has the name of a new one, in any case, is replaced."""
    names = {f.name.lower() for f in fields}
    keep = [c for c in df.columns if c.lower() not in names and c not in drop]
    schema = T.StructType([df.schema[c] for c in keep] + fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            new = fn(*(b.column(c) for c in inputs))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), *new], names=[*keep, *(f.name for f in fields)])

    return arrow_rows(df, run, schema)


def byte_pieces(texts: pa.Array, limit: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Consecutive rows (first, end, bytes, offsets from 0) of about ``limit`` bytes each;
    null is empty. A single row may be longer."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    a = texts.cast(pa.large_binary())
    if a.null_count:
        a = a.fill_null(b"")
    n = len(a)
    if not n:
        return
    _, off, data = a.buffers()
    offsets = np.frombuffer(off, np.int64)[a.offset : a.offset + n + 1]
    everything = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        end = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1)
        yield first, end, everything[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]
        first = end


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit integers (two multiply-xorshift rounds)."""
    x = x.astype(np.uint64, copy=True)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    x ^= x >> np.uint64(31)
    return x
