"""N-gram Jaccard self-join by adaptive multi-match prefixes.

A document's set is its distinct word shingles (``width`` words, A-Z lower-cased; a shorter
text is one shingle), as 64-bit hashes. Equal sets are one class. Tokens of the sets are put
in one order for all classes, rare ones first. If two sets must share t tokens, then whatever
l is, they share l tokens of their l-prefixes, the first n - t + l of their n tokens. A set
that links with one of at most its size shares PERCENT of its own tokens at least; one that
links with a set of at least its size shares 2 * PERCENT / (100 + PERCENT) of them. So a class
has two prefixes: a long one, in which it looks for smaller partners, and the front of it, by
which it is found by larger ones. Each class takes the l at which its prefix should cost
least: longer prefixes meet more postings, but each further token that must be shared leaves
fewer candidates to verify. A pair is a candidate if the long prefix of the larger set and
the front of the smaller one share as many tokens as the smaller of the two l asks for.

* Counts. Documents are dealt to packets. A packet sends each of its tokens once to the
  token's bucket, as 32 bits beside the bucket's number, with the number of its holders in
  the packet; the bucket sends back, to each packet, only tokens that some other class holds,
  with a code of their count. Tokens of one class alone come first in the order and can't be
  shared, so a class with more than n - t of them has no partner and is done. Different
  tokens that agree in bucket and 32 bits only count as shared; if one class has two such,
  its t falls by one, so no pair is lost.
* Candidates, without all pairs of a group. Of the classes that share a token one is the hub:
  first the one with the fewest tokens of its own, which is close to most in a group of near
  copies, in later rounds another one. Each class is verified on the full sets against the
  few hubs of other components that it shares most tokens with. This is linear and puts
  nearly all of a group of near copies into one component. Then components are paired where
  they share enough tokens by the union of their prefixes, and the sets of both are verified
  against each other until one link is found.

A pair of linked classes is either in one component after the first step or in two that the
second step pairs, so components are those of all links. Groups are dealt by bytes: large
components are cut into blocks of ``block_bytes`` and every block of one meets every block of
the other. Null and empty texts have no shingles and link to nothing. doc_ids need not be
unique: a component's id is the least doc_id of its rows, where a null doc_id is the least
long; an empty table gives no rows; other columns of any name are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from satchel.llm.components import components
from satchel.llm.neardup import PIECE, known, shingle_sets
from satchel.llm.shared import arrow_groups, arrow_rows, bounded, byte_pieces, split_join, written

WIDTH, PERCENT = 5, 80
#: Tokens of a packet of documents, and of a bucket of tokens.
PACKET_TOKENS, BUCKET_TOKENS = 1 << 20, 1 << 18
#: A packet's documents are numbered in 16 bits; the last number says that several hold a token.
SEVERAL = (1 << 16) - 1
#: The largest l that is tried.
LONGEST = 16
#: Cost of verifying a candidate in postings met: a fixed part and one a token of its set.
VERIFY, VERIFY_TOKEN = 4.0, 0.25
BLOCK_BYTES, PACK_BYTES = 8 << 20, 1 << 20
#: Rounds of hubs at most (the second and third only while links are found), and hubs that a
#: class is verified against in each.
ROUNDS, HUBS = 3, 3


def needed(n: np.ndarray | int):
    """Tokens that a set of ``n`` shares with any set that it links with."""
    return -(-n * PERCENT // 100)


def needed_by_smaller(n: np.ndarray | int):
    """Tokens that a set of ``n`` shares with any set of its size or more that it links with."""
    return -(-2 * n * PERCENT // (100 + PERCENT))


def digest_of(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def _described(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, end, data, offsets in byte_pieces(b.column("text"), PIECE):
                sets = shingle_sets(data, offsets, width)
                own = b.slice(first, end - first)
                digests = [digest_of(s) if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays([own.column("doc_id"), own.column("th"), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary())], names=["doc_id", "th", "n_shingles", "digest"])

    return run


PACKET = "bucket long, packet long, one binary, place binary, several binary, holders binary"


def _packet(number: int, digests: list[bytes], sets: list[np.ndarray], buckets: int) -> Iterator[tuple]:
    """Rows of PACKET: one a bucket (tokens of one holder with its place, tokens of several with
    their number), and one of the packet itself, under a bucket below 0: digests, sizes (the
    set's and that of its distinct tokens), and the holders of tokens of several."""
    h = np.concatenate(sets)
    doc = np.repeat(np.arange(len(sets), dtype=np.uint16), [len(s) for s in sets])
    key = ((h >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)) << np.uint64(32) | h & np.uint64(0xFFFFFFFF)
    order = np.lexsort((doc, key))
    key, doc = key[order], doc[order]
    new = np.concatenate([[True], (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])])
    key, doc = key[new], doc[new]
    start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    count = np.diff(np.append(start, len(key)))
    single, multi = start[count == 1], start[count > 1]
    many = count[count > 1]
    sizes = np.array([len(s) for s in sets], np.int64)
    held = np.repeat(count > 1, count)
    yield -1 - number, number, b"".join(digests), np.stack([sizes, np.bincount(doc, minlength=len(sets))]).astype("<i8").tobytes(), key[held].astype("<u8").tobytes(), doc[held].astype("<u2").tobytes()
    edges = np.arange(buckets + 1, dtype=np.uint64) << np.uint64(32)
    a, b = np.searchsorted(key[single], edges), np.searchsorted(key[multi], edges)
    one, place = key[single].astype("<u4"), doc[single].astype("<u2")
    several, holders = key[multi].astype("<u4"), np.minimum(many, 2**32 - 1).astype("<u4")
    for k in np.flatnonzero((np.diff(a) > 0) | (np.diff(b) > 0)).tolist():
        yield k, number, one[a[k] : a[k + 1]].tobytes(), place[a[k] : a[k + 1]].tobytes(), several[b[k] : b[k + 1]].tobytes(), holders[b[k] : b[k + 1]].tobytes()


def _rows(found: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64(), pa.int64(), *[pa.binary()] * 4]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), types, strict=True)], names=["bucket", "packet", "one", "place", "several", "holders"])


def _packets(width: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        digests, sets, size = [], [], 0
        seen: set[bytes] = set()
        for b in batches:
            for _, _, data, offsets in byte_pieces(b.column("text"), PIECE):
                for s in shingle_sets(data, offsets, width):
                    if not len(s) or (d := digest_of(s)) in seen:
                        continue
                    if sets and (size + len(s) > PACKET_TOKENS or len(sets) == SEVERAL):
                        yield _rows(list(_packet(number, digests, sets, buckets)))
                        number, digests, sets, size = number + 1, [], [], 0
                        seen.clear()
                    seen.add(d)
                    digests.append(d)
                    sets.append(s)
                    size += len(s)
        if sets:
            yield _rows(list(_packet(number, digests, sets, buckets)))

    return run


def _counted(table: pa.Table) -> pa.Table:
    """A bucket: what each packet sent comes back as tokens that several classes hold, with
    codes of their counts (8 log2) in place of holders; a packet's own row passes through."""
    if table.column("bucket")[0].as_py() < 0:
        return table
    read = lambda name, kind: [np.frombuffer(v, kind) for v in table.column(name).to_pylist()]
    one, place, several, holders = read("one", "<u4"), read("place", "<u2"), read("several", "<u4"), read("holders", "<u4")
    tokens = np.concatenate(one + several)
    weight = np.concatenate([np.ones(sum(map(len, one)), np.int64), *(h.astype(np.int64) for h in holders)])
    order = np.argsort(tokens)
    first = np.flatnonzero(np.concatenate([[True], tokens[order][1:] != tokens[order][:-1]]))
    df = np.add.reduceat(weight[order], first)
    codes = np.empty(len(tokens), np.uint8)
    codes[order] = np.repeat(np.minimum(np.round(8 * np.log2(df)), 255).astype(np.uint8), np.diff(np.append(first, len(tokens))))
    at_one = np.cumsum([0, *map(len, one)])
    at_several = np.cumsum([0, *map(len, several)]) + at_one[-1]
    out = []
    bucket, packets = table.column("bucket")[0].as_py(), table.column("packet").to_pylist()
    for k, packet in enumerate(packets):
        c, m = codes[at_one[k] : at_one[k + 1]], codes[at_several[k] : at_several[k + 1]]
        keep = c > 0
        if keep.any() or len(m):
            out.append((bucket, packet, one[k][keep].tobytes(), place[k][keep].tobytes(), several[k].tobytes(), np.concatenate([c[keep], m]).tobytes()))
    return pa.Table.from_batches([_rows(out)]) if out else table.slice(0, 0)


def _prefixes(table: pa.Table) -> pa.Table:
    """A packet: its documents that may have a partner, each with its l and its prefix."""
    bucket = table.column("bucket").to_pylist()
    own = int(np.argmin(bucket))
    cell = lambda name, k, kind: np.frombuffer(table.column(name)[k].as_py(), kind)
    sizes, distinct = cell("place", own, "<i8").reshape(2, -1)
    digests = table.column("one")[own].as_py()
    multi_key, multi_doc = cell("several", own, "<u8"), cell("holders", own, "<u2")
    keys, docs, codes, m_keys, m_codes = [], [], [], [], []
    for k, b in enumerate(bucket):
        if k == own:
            continue
        one, code, several, high = cell("one", k, "<u4"), cell("holders", k, np.uint8), cell("several", k, "<u4"), np.uint64(b << 32)
        keys.append(one.astype(np.uint64) | high)
        docs.append(cell("place", k, "<u2"))
        codes.append(code[: len(one)])
        m_keys.append(several.astype(np.uint64) | high)
        m_codes.append(code[len(one) :])
    fields = [("digest", pa.binary()), ("n", pa.int64()), ("ell", pa.int32()), ("front", pa.int32()), ("alone", pa.int64()), ("tokens", pa.list_(pa.int64()))]
    if not keys:
        return pa.table({f: pa.array([], t) for f, t in fields})
    listed, code_of = np.concatenate(m_keys), np.concatenate(m_codes)
    by = np.argsort(listed)
    key = np.concatenate([*keys, multi_key])
    doc = np.concatenate([*docs, multi_doc]).astype(np.int64)
    code = np.concatenate([*codes, code_of[by][np.searchsorted(listed[by], multi_key)]])
    shared = np.bincount(doc, minlength=len(sizes))
    alone = distinct - shared
    spare, spare_front = sizes - needed(sizes), sizes - needed_by_smaller(sizes)
    open_ = (alone <= spare) & (shared > 0)
    mine = open_[doc]
    key, doc, code = key[mine], doc[mine], code[mine]
    order = np.lexsort((key, code, doc))
    key, doc, code = key[order], doc[order], code[order]
    at = np.searchsorted(doc, np.arange(len(sizes) + 1))
    met = np.concatenate([[0.0], np.cumsum(2.0 ** (code / 8.0) - 1)])
    # the l of least cost, of the front where there is one; l can't exceed what must be shared,
    # less tokens that fell together
    found_by = alone <= spare_front
    costly = np.where(found_by, spare_front, spare)
    most = np.maximum(1, needed(sizes) - (sizes - distinct))
    best, ell = np.full(len(sizes), np.inf), np.ones(len(sizes), np.int32)
    for k in range(1, LONGEST + 1):
        length = np.minimum(np.maximum(costly + k - alone, 0), shared)
        postings = met[np.minimum(at[:-1] + length, at[1:])] - met[at[:-1]]
        cost = np.where(k <= most, postings * (1 + (VERIFY + VERIFY_TOKEN * sizes) / k), np.inf)
        ell = np.where(cost < best, k, ell)
        best = np.minimum(cost, best)
    rows = np.flatnonzero(open_)
    length = np.minimum(spare + ell - alone, shared)[rows]
    front = np.where(found_by, np.minimum(spare_front + ell - alone, shared), 0)[rows]
    token = key.view(np.int64)
    return pa.table({
        "digest": pa.array([digests[16 * k : 16 * k + 16] for k in rows.tolist()], pa.binary()), "n": pa.array(sizes[rows], pa.int64()), "ell": pa.array(ell[rows], pa.int32()), "front": pa.array(front, pa.int32()), "alone": pa.array(alone[rows], pa.int64()),
        "tokens": pa.array([token[at[k] : at[k] + m] for k, m in zip(rows.tolist(), length.tolist(), strict=True)], pa.list_(pa.int64())),
    })


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, end, data, offsets in byte_pieces(b.column("text"), PIECE):
                own = b.slice(first, end - first)
                sets = shingle_sets(data, offsets, width)
                yield pa.RecordBatch.from_arrays([own.column("node"), pa.array([digest_of(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["node", "own", "value"])

    return run


def _verified(table: pa.Table) -> pa.Table:
    """Of each group g a link of its left side to each part of its right side that has one."""
    group, part, node = (table.column(c).to_numpy() for c in ("g", "part", "node"))
    right = table.column("right").to_numpy(zero_copy_only=False)
    order = np.lexsort((node, part, right, group))
    group, part, node, right = group[order], part[order], node[order], right[order]
    value = table.column("value").take(pa.array(order)).to_pylist()
    edge = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1], [True]])).tolist()
    a, b = [], []
    for i, j in zip(edge[:-1], edge[1:], strict=True):
        cut = i + int(np.searchsorted(right[i:j], True))
        if i < cut < j:
            for k, m in linked([np.frombuffer(v, np.uint64) for v in value[i:cut]], [np.frombuffer(v, np.uint64) for v in value[cut:j]], part[cut:j]):
                a.append(node[i + k])
                b.append(node[cut + m])
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def linked(left: list[np.ndarray], right: list[np.ndarray], part: np.ndarray) -> Iterator[tuple[int, int]]:
    """Places (in ``left``, in ``right``) of sets of similarity PERCENT or more, one at least for
    each part of ``right`` that has any; parts found are not compared again."""
    n, m = np.array([len(s) for s in left]), np.array([len(s) for s in right])
    unique, ids = np.unique(np.concatenate([*left, *right]), return_inverse=True)
    at, at_right = np.cumsum([0, *n]), np.cumsum([0, *m])
    ids, others = ids[: at[-1]], ids[at[-1] :]
    flag, open_ = np.zeros(len(unique), bool), np.arange(len(right))
    for k in range(len(left)):
        if k == 0 or len(open_) < len(theirs):
            theirs = open_
            tokens = np.concatenate([others[at_right[t] : at_right[t + 1]] for t in theirs.tolist()])
            starts = np.cumsum(m[theirs]) - m[theirs]
        mine = ids[at[k] : at[k + 1]]
        flag[mine] = True
        both = np.add.reduceat(flag[tokens].astype(np.int64), starts)
        flag[mine] = False
        found = theirs[100 * both >= PERCENT * (n[k] + m[theirs] - both)]
        yield from ((k, t) for t in found.tolist())
        open_ = theirs[~np.isin(part[theirs], part[found])] if len(found) else theirs
        if not len(open_):
            break


def verified(left: DataFrame, right: DataFrame, sets: DataFrame, block_bytes: int) -> DataFrame:
    """Links (a, b) on full ``sets`` (node, value) from ``left`` (p, node) to each part of
    ``right`` (p, node, part) of the same p that has any. Sides of more than ``block_bytes`` are
    cut into blocks by hash of the node."""
    size = sets.select("node", F.length("value").alias("bytes"))
    sides = left.select("p", F.lit(False).alias("right"), "node", F.lit(0).cast("long").alias("part")).unionByName(right.select("p", F.lit(True).alias("right"), "node", "part"))
    sides = written(sides.join(size, "node"), "sides")
    blocks = lambda of: F.ceil(F.sum(F.when(of, F.col("bytes"))) / block_bytes).cast("int")
    cut = sides.groupBy("p").agg(blocks(~F.col("right")).alias("n0"), blocks(F.col("right")).alias("n1"))
    here, there = F.when(F.col("right"), F.col("n1")).otherwise(F.col("n0")), F.when(F.col("right"), F.col("n0")).otherwise(F.col("n1"))
    dealt = split_join(sides, cut, "p").withColumn("i", F.pmod(F.xxhash64("node"), here).cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), there - 1)))
    own = F.when(F.col("right"), F.xxhash64("p", "j", "i")).otherwise(F.xxhash64("p", "i", "j"))
    groups = written(dealt.select(own.alias("g"), "right", "node", "part", "bytes"), "groups")
    total = groups.agg(F.sum("bytes")).first()[0] or 0
    packs = max(1, -(-int(total) // PACK_BYTES))
    moved = groups.drop("bytes").join(sets.select("node", "value"), "node").withColumn("pack", F.pmod(F.xxhash64(F.lit(7), "g"), F.lit(packs)))
    return written(arrow_groups(moved, "pack", _verified, "a long, b long"), "verified_links")


def prefixes(rows: DataFrame, each: DataFrame, classes: DataFrame, width: int) -> DataFrame:
    """(node, n, ell, front, alone, tokens, r) of classes that may link with others; ``rows`` are ``known``
    documents, ``each`` their digests, ``classes`` (digest, n_shingles, r, rows)."""
    tokens = classes.agg(F.sum("n_shingles")).first()[0] or 0
    buckets = max(1, -(-int(tokens) // BUCKET_TOKENS))
    several = classes.where("rows > 1").select("digest", "r")
    copies = each.select("doc_id", "th", "digest").join(bounded(several, 64), "digest").where("doc_id <> r.doc_id OR th <> r.th").select("doc_id", "th").distinct()
    texts = rows.join(bounded(written(copies, "copies"), 32), ["doc_id", "th"], "left_anti").select("text")
    dealt = arrow_rows(texts, _packets(width, buckets), PACKET)
    known_counts = arrow_groups(dealt, "bucket", _counted, PACKET)
    found = arrow_groups(known_counts, "packet", _prefixes, "digest binary, n long, ell int, front int, alone long, tokens array<long>")
    listed = written(found, "prefixes")
    one = listed.groupBy("digest").agg(F.first(F.struct("n", "ell", "front", "alone", "tokens")).alias("x"))
    return written(one.join(classes.select("digest", "r"), "digest").select(F.monotonically_increasing_id().alias("node"), "digest", "x.*", "r"), "suspects")


def by_hub(members: DataFrame, turn: int) -> DataFrame:
    """Candidates (node, hub) of ``members`` (node, component, n, alone, tokens): each class with
    the HUBS hubs of other components that it shares most tokens with and may link with by size."""
    entries = members.select("node", "component", "n", "alone" if turn == 0 else F.xxhash64("node", F.lit(turn)).alias("alone"), F.explode("tokens").alias("token"))
    hubs = entries.groupBy("token").agg(F.min(F.struct("alone", "node", "component", "n")).alias("hub"), F.min("component").alias("c0"), F.max("component").alias("c1")).where("c0 < c1").select("token", "hub")
    met = split_join(entries.select("token", "node", "component", "n"), hubs, "token").where(F.col("component") != F.col("hub.component")).where(_sizes_allow("n", "n", "hub.n", "hub.n"))
    pairs = met.groupBy("node", F.col("hub.node").alias("hub")).agg(F.count(F.lit(1)).alias("shared"))
    best = Window.partitionBy("node").orderBy(F.col("shared").desc(), "hub")
    return pairs.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= HUBS).select("node", "hub")


def _sizes_allow(least: str, most: str, other_least: str, other_most: str) -> Column:
    return (100 * F.col(most) >= PERCENT * F.col(other_least)) & (100 * F.col(other_most) >= PERCENT * F.col(least))


def across(members: DataFrame) -> DataFrame:
    """Candidates (a, b) of components of ``members`` (node, component, n, ell, front, tokens):
    those that share, by the union of their prefixes, as many tokens as the least l of both
    asks for; a is the one with more tokens in its sets."""
    bounds = members.groupBy("component").agg(F.min("n").alias("least"), F.max("n").alias("most"), F.min("ell").alias("ell"), F.sum("n").alias("size"))
    entries = members.select("component", "front", F.posexplode("tokens").alias("place", "token")).groupBy("token", "component").agg(F.max(F.col("place") < F.col("front")).alias("fore"))
    entries = written(entries, "part_tokens")
    several = entries.groupBy("token").agg(F.count(F.lit(1)).alias("df"), F.max("fore").alias("fore")).where("df > 1 AND fore").select("token")
    shared = written(split_join(entries, several, "token"), "shared_tokens")
    found_by = shared.where("fore").select("token", F.col("component").alias("b"))
    pairs = shared.select("token", F.col("component").alias("a")).join(found_by, "token").where("a <> b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"))
    x = pairs.join(bounds.withColumnRenamed("component", "a"), "a")
    y = bounds.select(F.col("component").alias("b"), *(F.col(c).alias(f"{c}_") for c in ("least", "most", "ell", "size")))
    met = x.join(y, "b").where((F.col("shared") >= F.least("ell", "ell_")) & (F.col("most") >= F.col("least_")) & _sizes_allow("least", "most", "least_", "most_"))
    one, other = F.struct("size", "a"), F.struct("size_", "b")
    return met.select(F.when(one > other, F.col("a")).otherwise(F.col("b")).alias("a"), F.when(one > other, F.col("b")).otherwise(F.col("a")).alias("b")).distinct()


def links(suspects: DataFrame, sets: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Links (a, b) whose components are those of all links among ``suspects``."""
    found, members = None, suspects.withColumn("component", F.col("node"))
    for turn in range(ROUNDS):
        pairs = written(by_hub(members, turn), "hub_pairs")
        at_hub = verified(pairs.select(F.col("hub").alias("p"), F.col("hub").alias("node")).distinct(), pairs.select(F.col("hub").alias("p"), "node", F.col("node").alias("part")), sets, block_bytes)
        if found is not None and at_hub.isEmpty():
            break
        found = at_hub if found is None else written(found.unionByName(at_hub), "found_links")
        members = written(suspects.join(components(found), "node", "left").withColumn("component", F.coalesce("component", "node")), "parts")
    met = written(across(members), "part_pairs")
    of = members.select("component", "node")
    left = met.select(F.col("a").alias("p")).distinct().join(of, F.col("p") == of.component).select("p", "node")
    right = met.select(F.col("a").alias("p"), F.col("b").alias("component")).join(of, "component").select("p", "node", F.col("component").alias("part"))
    return found.unionByName(verified(left, right, sets, block_bytes))


def joined(docs: DataFrame, width: int = WIDTH, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per row of ``docs`` (doc_id long, text): doc_id, n_shingles and component_id, the least
    doc_id that links lead to, itself included."""
    rows = known(docs)
    each = written(arrow_rows(rows, _described(width), "doc_id long, th long, n_shingles long, digest binary"), "described")
    classes = written(each.where("digest IS NOT NULL").groupBy("digest", "n_shingles").agg(F.min(F.struct("doc_id", "th")).alias("r"), F.count(F.lit(1)).alias("rows")), "set_classes")
    suspects = prefixes(rows, each, classes, width)
    texts = rows.join(bounded(suspects.select("node", "digest", "r.doc_id", "r.th"), 64), ["doc_id", "th"]).select("node", "digest", "text")
    found = arrow_rows(texts.select("node", "text"), _sets(width), "node long, own binary, value binary")
    right = found.join(bounded(suspects.select("node", F.col("digest").alias("own")), 40), ["node", "own"])
    sets = written(right.select("node", "value").dropDuplicates(["node"]), "full_sets")
    part = components(links(suspects, sets, block_bytes))
    of = suspects.select("digest", "node", "r").join(part, "node", "left").withColumn("component", F.coalesce("component", "node"))
    first = of.groupBy("component").agg(F.min("r").alias("first"), F.count(F.lit(1)).alias("members")).where("members > 1").drop("members")
    by_link = of.join(first, "component").select("digest", "first.doc_id")
    by_copy = classes.where("rows > 1").select("digest", "r.doc_id").join(by_link.select("digest"), "digest", "left_anti")
    named = written(by_link.unionByName(by_copy).withColumnRenamed("doc_id", "first"), "named")
    return each.join(bounded(named, 48), "digest", "left").select("doc_id", "n_shingles", F.coalesce("first", "doc_id").alias("component_id"))


def jaccard_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op13: all documents, five words."""
    return joined(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
