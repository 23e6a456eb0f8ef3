"""Merkle manifest of a dataset, with versions by path copying.

Each row is a leaf, the sha256 of its fields; each group's leaves, in order, are hashed by
runs of ``FAN`` to its subroot, and the subroots, in order of the groups, to the root. All
digests are lowercase hex and hashed as that text.

Leaves are numbered by a range sort and prefix sums of counts, so no task sees a whole group.
Blocks of FAN ** LEVELS consecutive leaves are aligned with the tree: a block's nodes are a
subtree, built in one task, and the roots of all blocks are the leaves of the tree above,
which is built the same way, block by block, until one node is left. The tree over the
subroots is one more such tree. A block learns its own way up (the digests beside it at each
level above) and hands it to its leaves.

The tree is persistent: nodes are never changed. A tampered leaf makes a version, a new root
of the block that copies only the leaf's ancestors there and shares all other nodes; versions
go on above the block one by one, each beside the same untouched nodes, in the task that made
them, so versions of a hot group are spread like its blocks. Folding a version up to the top
gives the root that the tampered dataset would have; it equals the root only if the leaf's
content is the same. ``proof`` is the digest of the nodes beside the leaf, level by level.

Defined cases: a null field counts as "-", other fields as their length in UTF-8 bytes, a
colon and the value. A null group comes first, then groups by their bytes; a null order key
comes first. Rows of equal order key go by their digest, so rows repeated whole take
consecutive places. A group of one row has its leaf as subroot, a single group its subroot as
root; an empty table gives no rows. Columns other than the named ones are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from satchel.llm.shared import arrow_groups, arrow_rows, bounded, written

FAN, LEVELS = 3, 8


def digest_of(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


class Tree:
    """A subtree over ``leaves``: as many levels as are asked for, or until one node is left. A
    node is (digest, children); versions share nodes."""

    def __init__(self, leaves: list[str], levels: int | None = None):
        self.rows = [[(d, ()) for d in leaves]]
        while len(self.rows[-1]) > 1 if levels is None else len(self.rows) <= levels:
            below = self.rows[-1]
            self.rows.append([self.node(tuple(below[k : k + FAN])) for k in range(0, len(below), FAN)])
        self.root = self.rows[-1][0]
        self.height = len(self.rows) - 1

    @staticmethod
    def node(children: tuple) -> tuple:
        return digest_of("".join(c[0] for c in children)), children

    def version(self, place: int, leaf: str) -> tuple:
        """The root of a version in which the leaf at ``place`` is ``leaf``; only its ancestors
        are new nodes."""

        def copied(node: tuple, level: int) -> tuple:
            if not level:
                return node if node[0] == leaf else (leaf, ())
            k = place // FAN ** (level - 1) % FAN
            child = copied(node[1][k], level - 1)
            return node if child is node[1][k] else self.node((*node[1][:k], child, *node[1][k + 1 :]))

        return copied(self.root, self.height)

    def beside(self, place: int) -> list[tuple[str, str]]:
        """Level by level the digests before and after the way up from ``place``."""
        out = []
        for row in self.rows[:-1]:
            first = place - place % FAN
            out.append(("".join(n[0] for n in row[first:place]), "".join(n[0] for n in row[place + 1 : first + FAN])))
            place //= FAN
        return out


def folded(digest: str, way: list[tuple[str, str]]) -> str:
    for before, after in way:
        digest = digest_of(before + digest + after)
    return digest


def _runs(values: list) -> Iterator[tuple[int, int]]:
    """(first, end) of runs of equal values."""
    first = 0
    for k in range(1, len(values) + 1):
        if k == len(values) or values[k] != values[first]:
            yield first, k
            first = k


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A partition sorted by tree, with its number and each row's place among its tree's rows."""
    from pyspark import TaskContext

    part, last, count = TaskContext.get().partitionId(), object(), 0
    for b in batches:
        places = np.empty(len(b), np.int64)
        trees = b.column("tree").to_pylist()
        for first, end in _runs(trees):
            if trees[first] != last:
                last, count = trees[first], 0
            places[first:end] = np.arange(count, count + end - first)
            count += end - first
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array([part] * len(b), pa.int64()), pa.array(places)], names=[*b.schema.names, "part", "local"])


def placed(nodes: DataFrame, order: list[str]) -> DataFrame:
    """``nodes`` (tree long, digest, ...) with ``place``, the number of a node in its tree by
    ``order``, and ``total``, the nodes of its tree."""
    ranged = nodes.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order)
    schema = ", ".join(f"`{c}` {t}" for c, t in [*nodes.dtypes, ("part", "long"), ("local", "long")])
    kept = written(arrow_rows(ranged, _numbered, schema), "numbered")
    counts = kept.groupBy("tree", "part").agg(F.count(F.lit(1)).alias("n"))
    by_tree = Window.partitionBy("tree")
    before = F.coalesce(F.sum("n").over(by_tree.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = written(counts.select("tree", "part", before.alias("base"), F.sum("n").over(by_tree).alias("total")), "bases")
    return kept.join(bounded(base, 40), ["tree", "part"]).withColumn("place", F.col("local") + F.col("base")).drop("part", "local", "base")


def in_packs(blocks: DataFrame, packs: int) -> DataFrame:
    """``blocks`` (tree, block, ...) with ``pack``: whole blocks are dealt to so many packs."""
    return blocks.withColumn("pack", F.pmod(F.xxhash64("tree", "block"), F.lit(packs)))


def _blocks(nodes: DataFrame, levels: int) -> tuple[DataFrame, int]:
    """``nodes`` (tree, place, total, ...) with ``block`` and ``pack``, and the number of packs,
    each of about as many rows as a block."""
    packs = max(1, -(-nodes.count() // FAN**LEVELS))
    return in_packs(nodes.withColumn("block", F.floor(F.col("place") / FAN**levels)), packs), packs


def _each_block(table: pa.Table, levels: int) -> Iterator[tuple[list[dict], Tree]]:
    """The blocks of a pack: their rows in order, and the tree over them."""
    rows = sorted(table.to_pylist(), key=lambda r: (r["tree"], r["place"]))
    for first, end in _runs([(r["tree"], r["block"]) for r in rows]):
        block = rows[first:end]
        yield block, Tree([r["digest"] for r in block], levels if block[0]["total"] > FAN**levels else None)


def _roots(table: pa.Table, levels: int) -> pa.Table:
    out = [(block[0]["tree"], block[0]["block"], tree.root[0], -(-block[0]["total"] // FAN**levels)) for block, tree in _each_block(table, levels)]
    return pa.table({n: pa.array(c, t) for n, c, t in zip(["tree", "place", "digest", "total"], zip(*out, strict=True), [pa.int64(), pa.int64(), pa.string(), pa.int64()], strict=True)})


def _ways(table: pa.Table, levels: int) -> pa.Table:
    """Of each node its block's root and its way up there."""
    out = []
    for block, tree in _each_block(table, levels):
        for k, r in enumerate(block):
            way = tree.beside(k)
            out.append((r["tree"], r["place"], r["block"], tree.root[0], [b for b, _ in way], [a for _, a in way]))
    types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.string()), pa.list_(pa.string())]
    return pa.table({n: pa.array(c, t) for n, c, t in zip(["tree", "place", "block", "root", "before", "after"], zip(*out, strict=True), types, strict=True)})


def ways_up(nodes: DataFrame, levels: int = LEVELS) -> DataFrame:
    """(tree, place, root, before, after) of ``nodes`` (tree, place, total, digest): the root of
    their tree and the digests beside their way up to it."""
    blocked, _ = _blocks(nodes.select("tree", "place", "total", "digest"), levels)
    own = written(arrow_groups(blocked, "pack", lambda t: _ways(t, levels), "tree long, place long, block long, root string, before array<string>, after array<string>"), "ways")
    if nodes.where(F.col("total") > FAN**levels).isEmpty():
        return own.drop("block")
    above = ways_up(block_roots(nodes, levels), levels).select("tree", F.col("place").alias("block"), F.col("root").alias("top"), F.col("before").alias("b"), F.col("after").alias("a"))
    return own.join(above, ["tree", "block"]).select("tree", "place", F.col("top").alias("root"), F.concat("before", "b").alias("before"), F.concat("after", "a").alias("after"))


def block_roots(nodes: DataFrame, levels: int = LEVELS) -> DataFrame:
    """(tree, place, digest, total): the roots of the blocks of ``nodes`` as nodes of the tree above."""
    blocked, _ = _blocks(nodes.select("tree", "place", "total", "digest"), levels)
    return written(arrow_groups(blocked, "pack", lambda t: _roots(t, levels), "tree long, place long, digest string, total long"), "block_roots")


def _versions(table: pa.Table, levels: int) -> pa.Table:
    """Leaves of whole blocks: each leaf's proof, and its version folded to the top. A row of
    the block itself (no digest) brings the block's way up."""
    is_way = pc.is_null(table.column("digest"))
    above = {(r["tree"], r["block"]): r for r in table.filter(is_way).select(["tree", "block", "root", "subroot", "before", "after"]).to_pylist()}
    leaves = table.filter(pc.invert(is_way)).drop_columns(["root", "subroot", "before", "after"])
    out = []
    for block, tree in _each_block(leaves, levels):
        up = above[block[0]["tree"], block[0]["block"]]
        way = list(zip(up["before"], up["after"], strict=True))
        rest = "".join(b + a for b, a in way)
        for k, r in enumerate(block):
            version = tree.version(k, r["digest"] if r["changed"] is None else r["changed"])
            proof = digest_of("".join(b + a for b, a in tree.beside(k)) + rest)
            out.append((r["id"], r["digest"], up["subroot"], up["root"], proof, folded(version[0], way)))
    types = [table.schema.field("id").type, *[pa.string()] * 5]
    return pa.table({n: pa.array(c, t) for n, c, t in zip(["id", "leaf", "subroot", "root", "proof", "folded_root"], zip(*out, strict=True) if out else [[]] * 6, types, strict=True)})


def field(c: Column) -> Column:
    """A field as it is hashed: its length in UTF-8 bytes, a colon, its value; null is "-"."""
    s = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def leaf_of(fields: list[Column]) -> Column:
    return F.sha2(F.concat(*(field(c) for c in fields)), 256)


def manifest(rows: DataFrame, levels: int = LEVELS) -> DataFrame:
    """id, leaf, subroot, root, proof, folded_root of ``rows`` (id long, grp string, digest string,
    changed string): ``digest`` is the row's leaf, ``changed`` the leaf of its tampered content,
    null where it has none."""
    rows = written(rows, "leaves")
    groups = written(rows.select("grp").distinct(), "groups")
    # groups in order are the leaves of the upper tree; their numbers name the trees below
    ordered = placed(groups.select(F.lit(0).cast("long").alias("tree"), "grp"), ["grp"])
    named = written(ordered.select(F.col("place").alias("tree"), "grp"), "group_numbers")
    own = rows.join(bounded(named, 32 + F.coalesce(F.length("grp"), F.lit(0))), rows.grp.eqNullSafe(named.grp)).select("tree", "id", "digest", "changed")
    leaves = placed(own, ["id", "digest"])
    roots = block_roots(leaves, levels)
    ways = written(ways_up(roots, levels), "ways_of_blocks")
    subroots = ways.where("place = 0").select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("place"), F.col("root").alias("digest"))
    top = ways_up(subroots.withColumn("total", F.lit(named.count()).cast("long")), levels)
    upper = top.select(F.col("place").alias("tree"), F.col("root").alias("r"), F.col("before").alias("b"), F.col("after").alias("a"))
    whole = ways.join(upper, "tree").select("tree", F.col("place").alias("block"), F.col("r").alias("root"), F.col("root").alias("subroot"), F.concat("before", "b").alias("before"), F.concat("after", "a").alias("after"))
    blocked, packs = _blocks(leaves, levels)
    members = blocked.unionByName(in_packs(whole, packs), allowMissingColumns=True)
    return arrow_groups(members, "pack", lambda t: _versions(t, levels), "id long, leaf string, subroot string, root string, proof string, folded_root string")


def manifest_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op12: documents by source; where crc32 of the doc_id is even, new lines are deleted."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    changed = F.when(tampered, leaf_of([*fields, F.replace("text", F.lit("\n"), F.lit(""))]))
    rows = docs.select(F.col("doc_id").alias("id"), F.col("source").alias("grp"), leaf_of([*fields, F.col("text")]).alias("digest"), changed.alias("changed"))
    found = manifest(rows)
    return found.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", F.col("proof").alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def _tree_sql(name: str, leaves: str) -> str:
    return f"""{name} AS (
  {leaves}
  UNION ALL
  SELECT tree, lvl + 1, pos // 3, sha256(string_agg(digest, '' ORDER BY pos)), (cnt + 2) // 3
  FROM {name} WHERE cnt > 1 GROUP BY tree, lvl, pos // 3, cnt)"""


def _fields_sql(text: str) -> str:
    each = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE concat(strlen(CAST({c} AS VARCHAR)), ':', {c}) END"
    return "sha256(concat(" + ", ".join(each(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + "))"


#: crc32 by its bits; 3988292384 is its polynomial, bits reversed.
_CRC_SQL = "xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"

MANIFEST_SQL = f"""
WITH RECURSIVE hashed AS (
  SELECT doc_id, coalesce('s' || source, 'n') AS tree, source, {_fields_sql("text")} AS leaf,
         CASE WHEN {_CRC_SQL} % 2 = 0 THEN {_fields_sql("replace(text, chr(10), '')")} END AS changed
  FROM documents
), leaves AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS cnt
  FROM hashed
), {_tree_sql("below", "SELECT tree, 0 AS lvl, pos, leaf AS digest, cnt FROM leaves")}
, subroots AS (
  SELECT b.tree, b.lvl, b.digest, row_number() OVER (ORDER BY s.source NULLS FIRST) - 1 AS pos, count(*) OVER () AS cnt
  FROM below b JOIN (SELECT DISTINCT tree, source FROM hashed) s ON s.tree = b.tree WHERE b.cnt = 1
), {_tree_sql("above", "SELECT 't' AS tree, 0 AS lvl, pos, digest, cnt FROM subroots")}
, every AS (SELECT * FROM below UNION ALL SELECT * FROM above)
, steps AS (
  SELECT n.tree, n.lvl, n.pos, coalesce(string_agg(o.digest, '' ORDER BY o.pos) FILTER (o.pos < n.pos), '') AS before_,
         coalesce(string_agg(o.digest, '' ORDER BY o.pos) FILTER (o.pos > n.pos), '') AS after_,
         n.tree AS ntree, n.lvl + 1 AS nlvl, n.pos // 3 AS npos, true AS hashes
  FROM every n JOIN every o ON o.tree = n.tree AND o.lvl = n.lvl AND o.pos // 3 = n.pos // 3
  WHERE n.cnt > 1 GROUP BY n.tree, n.lvl, n.pos
  UNION ALL SELECT tree, lvl, 0, '', '', 't', 0, pos, false FROM subroots
), walk AS (
  SELECT tree AS own, pos AS at, tree, 0 AS lvl, pos, coalesce(changed, leaf) AS digest, '' AS proof FROM leaves
  UNION ALL
  SELECT w.own, w.at, s.ntree, s.nlvl, s.npos, CASE WHEN s.hashes THEN sha256(concat(s.before_, w.digest, s.after_)) ELSE w.digest END,
         concat(w.proof, s.before_, s.after_)
  FROM walk w JOIN steps s ON s.tree = w.tree AND s.lvl = w.lvl AND s.pos = w.pos
), root_ AS (SELECT lvl, digest FROM above WHERE cnt = 1)
SELECT l.doc_id, l.leaf, b.digest AS subroot, r.digest AS root, sha256(w.proof) AS proof_sha256,
       w.digest AS folded_root, w.digest = r.digest AS verified
FROM leaves l JOIN subroots b ON b.tree = l.tree CROSS JOIN root_ r
JOIN walk w ON w.own = l.tree AND w.at = l.pos AND w.tree = 't' AND w.lvl = r.lvl
"""
