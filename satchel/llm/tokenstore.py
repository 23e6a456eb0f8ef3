"""Token ids in a content-addressed store.

Format. ``chunks``: id streams, one per document, end id included, are cut where a rolling
hash says so; a chunk is its ids as unsigned 32-bit integers, low bytes first (all lowest
bytes, then all next ones), under the hash of its ids, and is stored once however many
documents hold it. A task sends each chunk once (as long as it remembers it), so a chunk
that many documents hold reaches its place in the store a few times only.
``recipes``: per document, in ascending doc_id order over all files, the ordered chunk
hashes, the number of ids and the Merkle root of the hashes. ``manifests``: per file of at
most about FILE_DOCS recipes the number of documents and ids and the Merkle root of its
documents' roots.

Reading back recomputes all of it: each chunk's hash from its stored bytes, each recipe's
root from its hashes, each file's root and sums from its recipes, and fails where one
differs or is missing. The checksum of a document is combined from those of its chunks (a
CRC of a whole is a linear function of the CRCs of its parts), so op5 verifies without
moving payload; ``reconstruct`` joins the ids themselves, and fails on a gap.

Null and empty texts hold only the end id. Repeated rows and repeated doc_ids are documents
of their own; ties in doc_id are ordered by the row's number in the input; a null doc_id
comes first. Other columns are not stored. An empty table gives empty files.
"""

from __future__ import annotations

import hashlib
import os
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from satchel.llm.chunks import cuts
from satchel.llm.shared import arrow_groups, arrow_rows, byte_pieces, mix64, written

LEAST, BITS, MOST = 128, 9, 4096
FILE_DOCS = 200_000
PIECE = 1 << 20
#: Bytes of pieces whose ids a worker keeps; beyond it, pieces are encoded anew each time.
CACHE_BYTES = 24 << 20
#: Longer pieces are not kept.
LONGEST = 48
#: Chunk hashes a task remembers so as not to send the same bytes twice.
CACHE_CHUNKS = 100_000
_WHITE = np.zeros(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True
#: After these bytes no cut is made: control characters that count as white space in places.
_UNSURE = _WHITE.copy()
_UNSURE[0x1C:0x20] = True
_BYTE = mix64(np.arange(501, 757, dtype=np.uint64))
_FACTOR = 0x9E3779B97F4A7C15


def pieces(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where texts (rows of ``data`` between ``offsets``) begin or can be cut: before ASCII white
    space after a character that is none. Byte-level pre-tokenisation always cuts there and
    doesn't look behind, so the ids of the pieces joined are the ids of the text."""
    n = len(data)
    cut = np.zeros(n, bool)
    cut[1:] = _WHITE[data[1:]] & ~_UNSURE[data[:-1]]
    far = np.flatnonzero(cut[2:] & (data[1:-1] >= 0x80)) + 2  # white space beyond ASCII may stand before
    p1, p2 = data[far - 1], data[far - 2]
    p3 = data[np.maximum(far - 3, 0)]
    cut[far[(p2 == 0xC2) & ((p1 == 0x85) | (p1 == 0xA0)) | (p3 == 0xE1) | (p3 == 0xE2) | (p3 == 0xE3) & (p2 == 0x80) & (p1 == 0x80)]] = False
    cut[offsets[:-1][np.diff(offsets) > 0]] = True
    return np.flatnonzero(cut)


def spread(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first, first + 1, ... (n of them) for each row, one after another."""
    ends = np.cumsum(n)
    return np.repeat(first - (ends - n), n) + np.arange(int(ends[-1]) if len(n) else 0)


class Grown:
    """An array that grows at its end."""

    def __init__(self, kind):
        self.n, self.room = 0, np.empty(1 << 12, kind)

    def add(self, x: np.ndarray) -> None:
        if self.n + len(x) > len(self.room):
            new = np.empty(max(2 * len(self.room), self.n + len(x)), self.room.dtype)
            new[: self.n] = self.room[: self.n]
            self.room = new
        self.room[self.n : self.n + len(x)] = x
        self.n += len(x)


class Encoder:
    """Ids of texts by a tokenizer file. Each distinct piece is asked of the library once, many
    new pieces in one text, and remembered with its bytes. Pieces are found again by a 64-bit
    hash and then compared byte by byte."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        n = self.tokenizer.get_vocab_size()
        # in byte-level vocabularies a space is written \u0120, a line feed \u010a
        self.opens = np.array([(self.tokenizer.id_to_token(i) or "?")[0] in "\u0120\u010a" for i in range(n)])
        self.forget()

    def forget(self) -> None:
        """Start with no known piece."""
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []  # sorted hashes and their entries
        self.bytes, self.ids = Grown(np.uint8), Grown(np.uint32)
        self.byte_at, self.byte_n, self.id_at, self.id_n = Grown(np.int64), Grown(np.int32), Grown(np.int64), Grown(np.int32)

    def whole(self, text: bytes) -> list[int]:
        return self.tokenizer.encode(text.decode(), add_special_tokens=False).ids

    def learn(self, raw: np.ndarray, n: np.ndarray) -> None:
        """New entries: pieces of ``n`` bytes each, one after another in ``raw``."""
        at = np.cumsum(n) - n
        second = raw[np.minimum(at + 1, len(raw) - 1)]
        simple = ((raw[at] == 0x20) | (raw[at] == 0x0A)) & (n > 1) & ~_UNSURE[second] & (second < 0xC0)
        simple |= ((raw[at] == 0x20) | (raw[at] == 0x0A)) & (n > 1) & (second >= 0xC3) & (second != 0xE1) & (second != 0xE2) & (second != 0xE3)
        if len(raw) > 1:  # what may be a special token is encoded by itself
            odd = np.flatnonzero((raw[:-1] == 0x3C) & (raw[1:] == 0x7C))
            simple[np.searchsorted(at, odd, "right") - 1] = False
        counts, done, flat = np.zeros(len(n), np.int32), [], []
        easy = np.flatnonzero(simple)
        for k in range(0, len(easy), 512):
            part = easy[k : k + 512]
            text = raw[spread(at[part], n[part])].tobytes().decode()
            got = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
            heads = np.flatnonzero(self.opens[got])
            if len(heads) == len(part):
                counts[part] = np.diff(np.append(heads, len(got)))
                done.append(part)
                flat.append(got)
        for i in np.setdiff1d(np.arange(len(n)), np.concatenate(done) if done else []).astype(int).tolist():
            flat.append(np.array(self.whole(raw[at[i] : at[i] + n[i]].tobytes()), np.uint32))
            counts[i] = len(flat[-1])
            done.append(np.array([i]))
        ids = np.empty(int(counts.sum()), np.uint32)
        which = np.concatenate(done)
        ids[spread((np.cumsum(counts) - counts)[which], counts[which])] = np.concatenate(flat)
        self.byte_at.add(self.bytes.n + at)
        self.id_at.add(self.ids.n + np.cumsum(counts) - counts)
        self.byte_n.add(n)
        self.id_n.add(counts)
        self.bytes.add(raw)
        self.ids.add(ids)

    def entries(self, hashes: np.ndarray) -> np.ndarray:
        """The entry of each distinct hash, -1 where there is none."""
        out = np.full(len(hashes), -1, np.int64)
        for known, entry in self.levels:
            k = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
            found = known[k] == hashes
            out[found] = entry[k[found]]
        return out

    def keep(self, hashes: np.ndarray, entry: np.ndarray) -> None:
        """Levels at least double in size, so each entry is sorted a few times only."""
        self.levels.append((hashes, entry))
        while len(self.levels) > 1 and len(self.levels[-2][0]) < 2 * len(self.levels[-1][0]):
            (h1, e1), (h2, e2) = self.levels.pop(), self.levels.pop()
            h, e = np.concatenate([h1, h2]), np.concatenate([e1, e2])
            order = np.argsort(h, kind="stable")
            self.levels.append((h[order], e[order]))

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets in ids) of texts."""
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        if self.bytes.n > CACHE_BYTES:
            self.forget()
        start = pieces(data, offsets)
        n = np.diff(np.append(start, len(data)))
        powers, inverse = _powers(len(data) + 1)
        run = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[data] * powers[:-1])])
        h = mix64((run[start + n] - run[start]) * inverse[start] ^ n.astype(np.uint64) << np.uint64(48))
        short = np.flatnonzero(n <= LONGEST)
        unique, first, back = np.unique(h[short], return_index=True, return_inverse=True)
        entry = self.entries(unique)
        new = np.flatnonzero(entry < 0)
        if len(new):
            which = short[first[new]]
            entry[new] = self.byte_n.n + np.arange(len(new))
            self.learn(data[spread(start[which], n[which])], n[which])
            self.keep(unique[new], entry[new])
        e = np.full(len(start), -1, np.int64)
        e[short] = entry[back]
        # known pieces must have the very bytes; long ones and others are encoded by themselves
        sure = (e >= 0) & (self.byte_n.room[e] == n)
        at = np.flatnonzero(sure)
        same = self.bytes.room[spread(self.byte_at.room[e[at]], n[at])] == (data if len(at) == len(start) else data[spread(start[at], n[at])])
        if not same.all():
            sure[at[np.unique(np.searchsorted(np.cumsum(n[at]), np.flatnonzero(~same), "right"))]] = False
        counts = np.where(sure, self.id_n.room[e], 0).astype(np.int64)
        others = {k: np.array(self.whole(data[start[k] : start[k] + n[k]].tobytes()), np.uint32) for k in np.flatnonzero(~sure).tolist()}
        for k, x in others.items():
            counts[k] = len(x)
        ends = np.cumsum(counts)
        at = np.flatnonzero(sure)
        known = self.ids.room[spread(self.id_at.room[e[at]], counts[at])]
        if others:
            out = np.empty(int(ends[-1]), np.uint32)
            out[spread((ends - counts)[at], counts[at])] = known
            for k, x in others.items():
                out[ends[k] - len(x) : ends[k]] = x
        else:
            out = known
        return out, np.concatenate([[0], ends])[np.searchsorted(start, offsets, "left")]


_cached: list[tuple[np.ndarray, np.ndarray]] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of an odd factor and of its inverse."""
    if not _cached or len(_cached[0][0]) < n:
        one = np.ones(1, np.uint64)
        of = lambda f: np.cumprod(np.concatenate([one, np.full(max(n, PIECE + 1) - 1, f, np.uint64)]))
        _cached[:] = [(of(_FACTOR), of(pow(_FACTOR, -1, 2**64)))]
    return _cached[0][0][:n], _cached[0][1][:n]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def merkle(hashes: list[bytes]) -> bytes:
    """Root of the binary tree over ``hashes``; an odd one moves up as it is; none: zeros."""
    level = list(hashes)
    while len(level) > 1:
        level = [hashlib.sha256(b"".join(level[k : k + 2])).digest() if k + 1 < len(level) else level[k] for k in range(0, len(level), 2)]
    return level[0] if level else bytes(32)


def name_of(ids: bytes) -> bytes:
    return hashlib.sha256(ids).digest()


def _stored(path: str, end_id: int):
    """For each text a recipe (under its row's number), and each new chunk with its bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[bytes] = set()
        for b in batches:
            for first, end, data, offsets in byte_pieces(b.column("text"), PIECE):
                yield rows(b.slice(first, end - first), data, offsets, sent)

    def rows(b: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray, sent: set[bytes]) -> pa.RecordBatch:
        ids, at = encoder(path).encode(data, offsets)
        ids = np.insert(ids, at[1:], np.uint32(end_id)).astype("<u4", copy=False)
        at = at + np.arange(len(at))
        raw = ids.tobytes()
        recipes, names, n, bodies = [], [], [], []
        for k, ends in enumerate(cuts(ids & np.uint32(0xFFFF), at, LEAST, BITS, MOST)):
            start, own = int(at[k]), []
            for i, e in zip([0, *ends[:-1]], ends, strict=True):
                part = raw[4 * (start + i) : 4 * (start + e)]
                h = name_of(part)
                own.append(h)
                if h not in sent:
                    names.append(h)
                    n.append(e - i)
                    bodies.append(packed(part))
                    if len(sent) < CACHE_CHUNKS:
                        sent.add(h)
            recipes.append(own)
        m = len(names)
        row, doc = b.column("row"), b.column("doc_id")
        key = [b"row %d" % r for r in row.to_pylist()]
        per = np.diff(at)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(["recipe"] * len(key) + ["chunk"] * m), pa.array(key + names, pa.binary()),
                pa.concat_arrays([row, pa.nulls(m, row.type)]), pa.concat_arrays([doc, pa.nulls(m, doc.type)]),
                pa.array(np.concatenate([per, np.array(n, np.int64)]).astype(np.int64)),
                pa.array(recipes + [None] * m, pa.list_(pa.binary())), pa.array([None] * len(key) + bodies, pa.binary()),
            ],
            names=["kind", "key", "row", "doc_id", "n_ids", "recipe", "bytes"],
        )

    return run


def packed(ids: bytes) -> bytes:
    """The low bytes of all ids, then the next ones, and so on: alike bytes side by side."""
    return np.frombuffer(ids, np.uint8).reshape(-1, 4).T.tobytes()


def unpacked(data: bytes) -> bytes:
    return np.frombuffer(data, np.uint8).reshape(4, -1).T.tobytes()


def write_store(docs: DataFrame, tokenizer_path: str, end_id: int = 0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(chunks, recipes, manifests) of ``docs`` (doc_id, text), each written and read back."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    made = arrow_rows(rows, _stored(tokenizer_path, end_id), f"kind string, key binary, row long, doc_id {kind}, n_ids long, recipe array<binary>, bytes binary")
    first = made.withColumn("k", F.row_number().over(Window.partitionBy("key").orderBy("kind"))).where("k = 1").drop("k")
    store = written(first, "store", partition_by="kind")
    chunks = store.where("kind = 'chunk'").select(F.col("key").alias("chunk"), "n_ids", "bytes")
    listed = store.where("kind = 'recipe'").select("row", "doc_id", F.col("n_ids").alias("n_tokens"), "recipe")
    files = max(1, -(-listed.count() // FILE_DOCS), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ordered = listed.repartitionByRange(files, F.col("doc_id").asc(), F.col("row").asc()).sortWithinPartitions("doc_id", "row")
    numbered = ordered.select(F.spark_partition_id().alias("file"), F.monotonically_increasing_id().alias("place"), "row", "doc_id", "n_tokens", "recipe")
    recipes = written(with_roots(numbered, "root"), "recipes")
    return chunks, recipes, written(_files(recipes, "root"), "manifests")


def with_roots(recipes: DataFrame, name: str) -> DataFrame:
    """``recipes`` with the Merkle root of each one's chunk hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.append_column(name, pa.array([merkle(r) for r in b.column("recipe").to_pylist()], pa.binary()))

    return arrow_rows(recipes, run, recipes.withColumn(name, F.lit(b"")).schema)


def _file(table: pa.Table) -> pa.Table:
    table = table.sort_by("place")
    sums = [table.column("file")[0].as_py(), table.num_rows, sum(table.column("n_tokens").to_pylist()), merkle(table.column("r").to_pylist())]
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.binary()]
    return pa.table([pa.array([x], t) for x, t in zip(sums, kinds, strict=True)], names=["file", "n_docs", "n_tokens", "root"])


def _files(recipes: DataFrame, root: str) -> DataFrame:
    """Per file: n_docs, n_tokens and the Merkle root of its documents' roots, in order."""
    return arrow_groups(recipes.select("file", "place", "n_tokens", F.col(root).alias("r")), "file", _file, "file int, n_docs long, n_tokens long, root binary")


#: The reversed polynomial of the usual CRC-32.
POLY = 0xEDB88320


def crc_times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of polynomials modulo POLY; coefficient of x**0 in the top bit."""
    a, b = a.astype(np.uint32), b.astype(np.uint32)
    out = np.zeros_like(a)
    for k in range(31, -1, -1):
        out ^= np.where((a >> np.uint32(k)) & np.uint32(1), b, np.uint32(0))
        b = np.where(b & np.uint32(1), (b >> np.uint32(1)) ^ np.uint32(POLY), b >> np.uint32(1))
    return out


def crc_shift(crc: np.ndarray, n_bytes: np.ndarray) -> np.ndarray:
    """What a part's CRC adds to that of a whole in which ``n_bytes`` follow the part."""
    power = np.full(len(crc), 1 << 23, np.uint32)  # x**8
    out, n = crc.astype(np.uint32), n_bytes.astype(np.int64).copy()
    while n.any():
        out = np.where(n & 1, crc_times(power, out), out)
        power = crc_times(power, power)
        n >>= 1
    return out


def _read_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        names, crc, n, good = [], [], [], []
        for h, data in zip(b.column("chunk").to_pylist(), b.column("bytes"), strict=True):
            ids = unpacked(data.as_py())
            names.append(h)
            crc.append(zlib.crc32(ids))
            n.append(len(ids) // 4)
            good.append(name_of(ids) == h)
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(crc, pa.int64()), pa.array(n, pa.int64()), pa.array(good, pa.bool_())], names=["chunk", "crc", "n", "good"])


def _shifted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        part = crc_shift(b.column("crc").to_numpy().astype(np.uint32), 4 * b.column("after").to_numpy())
        yield pa.RecordBatch.from_arrays([b.column("row"), b.column("n"), pa.array(part.astype(np.int64))], names=["row", "n", "part"])


def verified_recipes(recipes: DataFrame, manifests: DataFrame) -> DataFrame:
    """``recipes``; fails unless the roots recomputed from their hashes are those of the recipes
    and of the manifests, with as many documents and ids, and no file is missing."""
    again = with_roots(recipes.select("file", "place", "n_tokens", "root", "recipe"), "again").select("file", "place", "n_tokens", "root", "again")
    per = _files(again.withColumn("r", F.when(F.col("again") == F.col("root"), F.col("again")).otherwise(F.lit(b"differs"))), "r")
    both = manifests.select(F.struct("file", "n_docs", "n_tokens", "root").alias("m"), "file").join(per.select(F.struct("file", "n_docs", "n_tokens", "root").alias("p"), "file"), "file", "full")
    bad = both.where(~F.col("m").eqNullSafe(F.col("p"))).limit(1).collect()
    if bad:
        raise ValueError(f"recipes of file {bad[0].file} differ from its manifest")
    return recipes


def read_store(chunks: DataFrame, recipes: DataFrame, manifests: DataFrame) -> DataFrame:
    """Per document, from the files: doc_id, start (ids of all documents before it), n_tokens,
    ids_crc32, n_chunks. Fails where bytes, names, counts, recipes or manifests disagree."""
    recipes = verified_recipes(recipes, manifests)
    stored = arrow_rows(chunks.select("chunk", "bytes"), _read_chunks, "chunk binary, crc long, n long, good boolean")
    uses = recipes.select("row", F.posexplode("recipe").alias("seq", "chunk")).join(stored, "chunk", "left")
    sure = F.when(F.col("good"), F.col("n")).otherwise(F.raise_error(F.lit("a chunk is lost or differs from its name")))
    later = Window.partitionBy("row").orderBy(F.col("seq").desc()).rowsBetween(Window.unboundedPreceding, -1)
    parts = arrow_rows(uses.withColumn("n", sure).select("row", "crc", "n", F.coalesce(F.sum("n").over(later), F.lit(0)).alias("after")), _shifted, "row long, n long, part long")
    docs = parts.groupBy("row").agg(F.bit_xor("part").alias("ids_crc32"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_chunks"))
    before = manifests.select("file", F.coalesce(F.sum("n_tokens").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    within = F.coalesce(F.sum("n_tokens").over(Window.partitionBy("file").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = recipes.select("file", "row", "doc_id", "n_tokens", within.alias("within")).join(F.broadcast(before), "file")
    counted = F.when(F.col("n") == F.col("n_tokens"), F.col("n")).otherwise(F.raise_error(F.lit("a document's ids are not as many as its recipe says")))
    return placed.select("row", "doc_id", "n_tokens", (F.col("before") + F.col("within")).alias("start")).join(docs, "row", "left").select("doc_id", "start", counted.alias("n_tokens"), "ids_crc32", "n_chunks")


def reconstruct(chunks: DataFrame, recipes: DataFrame, manifests: DataFrame) -> DataFrame:
    """(row, doc_id, ids binary of little-endian unsigned 32-bit integers) of every document;
    fails where a chunk is lost or differs from its name, or recipes from manifests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for parts in b.column("parts").to_pylist():
                ids = [unpacked(p["bytes"] or b"") for p in parts]
                if any(name_of(x) != p["chunk"] for x, p in zip(ids, parts, strict=True)):
                    raise ValueError("a chunk is lost or differs from its name")
                out.append(b"".join(ids))
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("doc_id"), pa.array(out, pa.binary())], names=["row", "doc_id", "ids"])

    kind = recipes.schema["doc_id"].dataType.simpleString()
    uses = verified_recipes(recipes, manifests).select("row", "doc_id", F.posexplode("recipe").alias("seq", "chunk")).join(chunks.select("chunk", "bytes"), "chunk", "left")
    parts = uses.groupBy("row", "doc_id").agg(F.array_sort(F.collect_list(F.struct("seq", "chunk", "bytes"))).alias("parts"))
    return arrow_rows(parts, run, f"row long, doc_id {kind}, ids binary")


def token_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5: all documents, end id 0."""
    import public_tokenizers as P

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return read_store(*write_store(docs, P.path("byte_bpe_50k.json")))
