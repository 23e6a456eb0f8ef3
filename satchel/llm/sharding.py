"""Sharding by a permutation-filled lookup table, in SQL functions only.

The table has a prime number of slots. Each shard has its own order of preference over all
slots (offset + j * skip, both from the shard's name); shards take turns, and at its turn a
shard claims the first slot of its order that is free. Shards get slot counts that differ
by one at most, and when a shard leaves, few other slots change hands. The size of the
table is a parameter, not a property of the data, so broadcasting it is bounded, and a row
finds its shard by one hash and one lookup.

A row's slot comes from the md5 of its key columns (null and empty keys differ), so equal
keys, repeated rows included, go to one shard; use a key with many values (a document id,
not its source) where shards must be even. Rows pass through whole; a column of the table
named as an output is replaced; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SHARDS, SLOTS = 32, 4099
#: The largest table that is broadcast.
MOST_SLOTS = 1 << 20


def hash60(text: Column) -> Column:
    """60 bits of the md5 of ``text`` as a long."""
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def shard_names(n: int) -> list[str]:
    return [f"shard-{i:05d}" for i in range(n)]


def lookup_table(spark: SparkSession, shards: list[str], slots: int = SLOTS) -> DataFrame:
    """(slot int, shard string) for every slot; ``slots`` must be a prime, at least as large
    as the number of shards. No shards: no rows. The turns depend on nothing but the two
    parameters, so they are taken while the plan is built; the table enters it as a literal."""
    if slots < 2 or any(slots % d == 0 for d in range(2, int(slots**0.5) + 1)):
        raise ValueError("slots must be a prime")
    if len(set(shards)) != len(shards) or len(shards) > slots or slots > MOST_SLOTS:
        raise ValueError("shards must be distinct and no more than slots; slots at most a million")
    owners = ",".join(map(str, claims(shards, slots)))
    listed = spark.range(1).select(F.posexplode(F.split(F.lit(owners), ",").cast("array<int>")).alias("slot", "i")) if shards else spark.range(0).select(F.lit(0).alias("slot"), F.lit(0).alias("i"))
    return listed.select("slot", F.get(F.split(F.lit("\n".join(shards)), "\n"), F.col("i")).alias("shard"))


def claims(shards: list[str], slots: int) -> list[int]:
    """For each slot the index of the shard that claims it."""
    drawn = lambda s, what: int(hashlib.md5(f"{s}/{what}".encode()).hexdigest()[:15], 16)
    at = [drawn(s, "offset") % slots for s in shards]
    step = [drawn(s, "skip") % (slots - 1) + 1 for s in shards]
    owner = [-1] * slots
    for turn in range(slots if shards else 0):
        i = turn % len(shards)
        while owner[at[i]] >= 0:
            at[i] = (at[i] + step[i]) % slots
        owner[at[i]] = i
    return owner


def place(df: DataFrame, keys: list[str], table: DataFrame, slots: int = SLOTS) -> DataFrame:
    """``df`` with ``slot`` and ``shard``, by broadcast of the bounded table."""
    key = F.to_json(F.array(*(F.col(k).cast("string") for k in keys)))
    rows = df.drop("slot", "shard").withColumn("slot", F.pmod(hash60(key), F.lit(slots)).cast("int"))
    return rows.join(F.broadcast(table), "slot", "inner").select(*(c for c in df.columns if c not in ("slot", "shard")), "slot", "shard")


def sharding_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3: the shard of every document, by doc_id."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id")
    return place(docs, ["doc_id"], lookup_table(spark, shard_names(SHARDS)))

