"""The item table in buckets: a merge reads the buckets its batch touches and writes their changes.

A row's slot is a hash of (provider, external_id), its id; ``slots`` is fixed when the table is
made, by its size (``slots_for``), so that no task has to hold much of a large one.
Data files lie under gen=<attempt>/part=<slot>, in as many hash buckets by slot as there are
slots, so Spark knows how a scan is dealt out: a join or an aggregation by slot and more needs
no exchange of the table, only of the batch. Spark moves a table of fewer buckets than it makes
shuffle partitions, or as many, all the same, so a merge makes fewer of these. Each version
has a manifest, (slot, gen, rows), that names the live files of every slot; files that no
manifest names, such as those of an attempt that failed, are never read. ``expire`` deletes
what only older versions name.

A batch of few ids writes the rows of its ids only, as a layer over each slot; a reader leaves
out rows whose id a later layer has. Touched slots are written whole, and lose their layers,
once these outgrow a share of them (``SHARE``) or are many (``LAYERS``).

A version is written under its number, so a batch that is run again gives the same table.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from satchel.session import bounded

SLOT_OF = ["provider", "external_id"]
SLOTS = 64
#: Bytes of rows that a slot is to hold: a task sorts a few slots when it writes them.
SLOT_BYTES = 32 << 20
#: Slots are written whole when the ids in layers over them pass this share of their rows.
SHARE = 0.25
#: The most layers over a slot.
LAYERS = 16
#: A join on slot and more columns is satisfied by buckets of the slot alone.
ALIGNED = "spark.sql.requireAllClusterKeysForCoPartition"
PARTITIONS = "spark.sql.shuffle.partitions"


def slot_of(slots: int, columns: list[str] = SLOT_OF) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(slots)).cast("int")


def slots_for(size: int, least: int = SLOTS) -> int:
    """The slots of a table of ``size`` bytes of rows: ``least``, doubled until they hold it."""
    n = least
    while n * SLOT_BYTES < size:
        n *= 2
    return n


def level(gen: str) -> int:
    """The version that a gen was written for."""
    return int(gen.split("-")[0])


def few_ids(ids: DataFrame) -> DataFrame:
    """``ids`` (slot, id) as the side of a join that is hashed, so that the table is not sorted."""
    width = F.lit(32)
    for c in SLOT_OF:
        width += F.coalesce(F.octet_length(c), F.lit(0))
    found = bounded(ids, width, None)
    return ids.hint("shuffle_hash") if found is None else found


class BucketTable:
    """Rows of ``schema`` in ``folder``, which all executors share."""

    def __init__(self, spark: SparkSession, folder: str, schema: T.StructType, slots: int = SLOTS):
        self.spark, self.folder, self.schema, self.slots = spark, folder.rstrip("/"), schema, slots
        self.name = f"satchel_{hashlib.md5(self.folder.encode()).hexdigest()}"

    def create(self, rows: DataFrame) -> BucketTable:
        """Version 0: ``rows``, each bucket written by one task."""
        self._write(rows.select(*self.schema.names).withColumn("slot", slot_of(self.slots)).repartition(self.slots, "slot"), 0, range(self.slots), {})
        return self

    def versions(self) -> list[int]:
        path, files = self._fs(f"{self.folder}/manifest")
        return sorted(int(f.getPath().getName()) for f in files.listStatus(path)) if files.exists(path) else []

    def layers(self, version: int) -> dict[int, list[tuple[str, int]]]:
        """(gen, rows) of each slot that has rows or had some, first to last: at most ``slots``
        times ``LAYERS`` and one entries."""
        found: dict[int, list[tuple[str, int]]] = {}
        for r in sorted(self.spark.read.schema("slot int, gen string, rows long").parquet(f"{self.folder}/manifest/{version}").collect(), key=lambda r: level(r.gen)):
            found.setdefault(r.slot, []).append((r.gen, r.rows))
        return found

    def manifest(self, version: int) -> dict[int, str]:
        """The last gen of each slot that has rows or had some."""
        return {slot: of[-1][0] for slot, of in self.layers(version).items()}

    def read(self, version: int | None = None, slots: list[int] | None = None) -> DataFrame:
        """The rows of a version (the last one, if None) with their slot; of some slots only."""
        version = self.versions()[-1] if version is None else version
        gens = {slot: [g for g, _ in of] for slot, of in self.layers(version).items() if slots is None or slot in slots}
        self._open()
        rows = self._files(gens)
        upper = {slot: of[1:] for slot, of in gens.items() if of[1:]}
        if not upper:
            return rows.select(*self.schema.names, "slot")
        own = F.split_part("gen", F.lit("-"), F.lit(1)).cast("int")
        last = few_ids(self._files(upper).groupBy("slot", *SLOT_OF).agg(F.max(own).alias("last_")))
        return rows.join(last, ["slot", *SLOT_OF], "left").where(F.col("last_").isNull() | (own == F.col("last_"))).select(*self.schema.names, "slot")

    def merge(self, step: Callable[[DataFrame, DataFrame], DataFrame], batch: DataFrame, version: int | None = None) -> list[int]:
        """Write version ``version`` (the next one, if None): ``step(old, batch)`` of the rows of the
        touched slots, which keep their column ``slot``; gives those slots. ``step`` leaves rows
        of other ids than the batch's as they are, may get none of them, and drops no id."""
        done = self.versions()
        version = done[-1] + 1 if version is None else version
        dealt = batch.withColumn("slot", slot_of(self.slots))
        ids = dealt.select("slot", *SLOT_OF).distinct()
        given = {r.slot: r.n for r in ids.groupBy("slot").agg(F.count(F.lit(1)).alias("n")).collect()}
        touched, before = sorted(given), self.layers(version - 1)
        over = sum(given.values()) + sum(n for slot in touched for _, n in before.get(slot, [])[1:])
        whole = over > SHARE * sum(before[slot][0][1] for slot in touched if slot in before) or any(len(before.get(slot, [])) > LAYERS for slot in touched)
        conf = {k: self.spark.conf.get(k) for k in (ALIGNED, PARTITIONS)}
        self.spark.conf.set(ALIGNED, "false")
        self.spark.conf.set(PARTITIONS, str(max(1, min(self.slots - 1, int(conf[PARTITIONS])))))
        try:
            old = self.read(version - 1, touched)
            if whole:
                self._write(step(old, dealt), version, touched, {s: of for s, of in before.items() if s not in given})
            else:
                old = old.join(few_ids(ids), ["slot", *SLOT_OF], "left_semi").select(*self.schema.names, "slot")
                self._write(step(old, dealt).repartition("slot"), version, touched, before)
        finally:
            for k, v in conf.items():
                self.spark.conf.set(k, v)
        return touched

    def expire(self, keep: int = 2) -> int:
        """Delete all but the last ``keep`` versions, and the files that none of those names; gives
        the number of folders of files deleted."""
        done = self.versions()
        live = {(gen, slot) for v in done[-keep:] for slot, of in self.layers(v).items() for gen, _ in of}
        path, files = self._fs(f"{self.folder}/data")
        gone = 0
        for gen in files.listStatus(path) if files.exists(path) else []:
            name = gen.getPath().getName()
            if not name.startswith("gen="):
                continue
            parts = files.listStatus(gen.getPath())
            dead = [p.getPath() for p in parts if (name[4:], int(p.getPath().getName()[5:])) not in live]
            for p in dead:
                files.delete(p, True)
            if len(dead) == len(parts):
                files.delete(gen.getPath(), True)
            gone += len(dead)
        for v in done[:-keep]:
            files.delete(self._fs(f"{self.folder}/manifest/{v}")[0], True)
        if gone and self.spark.catalog.tableExists(self.name):
            self.spark.catalog.refreshTable(self.name)
        return gone

    def _write(self, rows: DataFrame, version: int, touched, below: dict[int, list[tuple[str, int]]]) -> None:
        """``rows`` of the touched slots, over the layers ``below``."""
        gen = f"{version}-{uuid.uuid4().hex[:12]}"
        data = rows.select(*self.schema.names, "slot").withColumns({"gen": F.lit(gen), "part": F.col("slot")})
        self._open()
        out = data.write.format("parquet").mode("append").partitionBy("gen", "part").bucketBy(self.slots, "slot").option("path", f"{self.folder}/data")
        out.saveAsTable(self.name)
        n = {r.part: r.n for r in self.spark.table(self.name).where(F.col("gen") == gen).groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}
        live = [(slot, g, k) for slot, of in below.items() for g, k in of] + [(slot, gen, n.get(slot, 0)) for slot in touched]
        self.spark.createDataFrame(sorted(live), "slot int, gen string, rows long").coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/manifest/{version}")

    def _files(self, gens: dict[int, list[str]]) -> DataFrame:
        """The rows of some gens of each slot. They are partition columns, so other files are not
        even listed in the plan."""
        live: dict[str, list[int]] = {}
        for slot, of in gens.items():
            for gen in of:
                live.setdefault(gen, []).append(slot)
        where = F.lit(False)
        for gen, slots in sorted(live.items()):
            where |= (F.col("gen") == gen) & F.col("part").isin(slots)
        return self.spark.table(self.name).where(where)

    def _open(self) -> None:
        """Make the table known to this session's catalog, if files are there that it doesn't know."""
        path, files = self._fs(f"{self.folder}/data")
        if self.spark.catalog.tableExists(self.name) or not files.exists(path):
            return
        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self.schema)
        self.spark.sql(f"CREATE TABLE {self.name} ({fields}, slot INT, gen STRING, part INT) USING parquet PARTITIONED BY (gen, part) CLUSTERED BY (slot) INTO {self.slots} BUCKETS LOCATION '{self.folder}/data'")
        self.spark.catalog.recoverPartitions(self.name)

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())
