"""Session defaults and the shared folder every job writes its intermediate tables to."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The most that is broadcast, in bytes of rows.
BROADCAST_BYTES = 16 << 20


def session(master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session in UTC with adaptive execution; a cluster's own settings win where given."""
    b = SparkSession.builder.appName("satchel")
    if master:
        b = b.master(master)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return (
        b.config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; in local tests, where it
    is unset, a temporary folder of this machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: Rows of a file of a table whose number of rows is known to be small.
FILE_ROWS = 20_000


def written(df: DataFrame, name: str, partition_by: str | None = None, rows: int | None = None) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back: later steps start
    from files, so a lost executor costs one stage and nothing is computed twice. Where it is
    known to have at most ``rows`` rows, it goes to no more files than FILE_ROWS asks for."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    out = (df if rows is None else df.coalesce(max(1, -(-rows // FILE_ROWS)))).write
    if partition_by:
        out = out.partitionBy(partition_by)
    out.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bounded(df: DataFrame, width: int | Column, otherwise: str | None = "join") -> DataFrame | None:
    """``df`` marked for broadcast if its rows, of ``width`` bytes, are BROADCAST_BYTES at most.
    If not, ``df`` itself, to be joined by a shuffle, or None if ``otherwise`` is None."""
    size = df.agg(F.sum(F.lit(width) if isinstance(width, int) else width)).first()[0] or 0
    return F.broadcast(df) if size <= BROADCAST_BYTES else df if otherwise else None


def in_blocks(df: DataFrame, width: int | Column, key: str) -> list[DataFrame]:
    """``df`` in parts of at most about BROADCAST_BYTES each, dealt by ``key``, for joins without
    an equality in which every row of the other side meets every row of this one."""
    size = df.agg(F.sum(F.lit(width) if isinstance(width, int) else width)).first()[0] or 0
    n = max(1, -(-int(size) // BROADCAST_BYTES))
    return [df] if n == 1 else [df.where(F.pmod(F.xxhash64(key), F.lit(n)) == k) for k in range(n)]
