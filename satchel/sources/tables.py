"""Reading and writing the archive and the item table."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, FloatType, StructType


def append_pages(pages: DataFrame, path: str) -> None:
    """Raw pages added to the archive as pending, by provider."""
    pages.withColumn("status", F.lit("pending")).write.mode("append").partitionBy("provider").parquet(path)


def export_items(items: DataFrame, path: str) -> None:
    """The whole library with all columns, vectors included."""
    items.write.mode("errorifexists").parquet(path)


def brought_up_to(df: DataFrame, schema: StructType) -> DataFrame:
    """``df`` with the columns of ``schema`` that it lacks, as nulls; others are left alone."""
    return df.withColumns({f.name: F.lit(None).cast(f.dataType) for f in schema if f.name not in df.columns})


def fixture_files(pages: DataFrame) -> DataFrame:
    """(provider, ext, page_id, body, meta) of ``pages`` (provider, page_id, body, ...): one file a
    page, html where the body opens a tag and json where not, with all else as metadata."""
    ext = F.when(F.startswith(F.ltrim("body"), F.lit("<")), "html").otherwise("json")
    meta = F.to_json(F.struct(*(c for c in pages.columns if c != "body")))
    return pages.select("provider", ext.alias("ext"), "page_id", "body", meta.alias("meta"))


def dump_fixtures(pages: DataFrame, path: str) -> None:
    """``fixture_files`` by provider and extension; bodies and metadata side by side."""
    fixture_files(pages).write.mode("errorifexists").partitionBy("provider", "ext").json(path)


def register_views(items: DataFrame, pages: DataFrame) -> None:
    """Both tables under fixed names for ad-hoc SQL: saved_items and raw_data."""
    items.createOrReplaceTempView("saved_items")
    pages.createOrReplaceTempView("raw_data")


@F.pandas_udf(ArrayType(FloatType()))
def vector_of_blob(blobs: pd.Series) -> pd.Series:
    """Little-endian float32 bytes into a vector; null stays null, odd bytes at the end fall."""
    sizes = blobs.map(lambda b: -1 if b is None else len(b) // 4).to_numpy()
    flat = np.frombuffer(b"".join(b[: len(b) // 4 * 4] for b in blobs if b is not None), "<f4")
    ends = np.cumsum(np.maximum(sizes, 0))
    return pd.Series([None if n < 0 else flat[e - n : e] for n, e in zip(sizes.tolist(), ends.tolist(), strict=True)])


@F.pandas_udf(BinaryType())
def blob_of_vector(vectors: pd.Series) -> pd.Series:
    sizes = vectors.map(lambda v: -1 if v is None else len(v)).to_numpy()
    there = [v for v in vectors if v is not None]
    raw = np.concatenate(there).astype("<f4").tobytes() if there else b""
    ends = 4 * np.cumsum(np.maximum(sizes, 0))
    return pd.Series([None if n < 0 else raw[e - 4 * n : e] for n, e in zip(sizes.tolist(), ends.tolist(), strict=True)])
