"""Media columns with content-defined payload chunking.

A payload is stored as the samples of an 8-bit mono WAV file: a fixed 44-byte head, then one
sample a byte, so any bytes are kept exactly. The file, head included, is cut by a rolling
gear hash; Spark joins on chunk digests tell which chunks are shared. A media row holds the
file's digest, its ordered chunk digests, and the bytes of chunks that are used in one place
only; a shared chunk is stored once, in a table of its own, and media rows hold its digest.
Equal payloads are one media row. Reading back puts each file's stored bytes together in
order, checks every chunk's digest and the file's, and computes the features from the
samples in the file; it fails where a chunk is lost or differs.

Null and empty texts are 64 zero bytes. Repeated rows give repeated results from one media
row; equal texts always have equal values; columns of any name pass through
``media_columns`` unless named as an output; an empty table gives empty tables. The payload
of one document is handled in one piece by a task; a chunk that many hold has one row a
media file in a join that adaptive execution can split.

Only files that hold shared chunks need to be told so when they are stored; that list is
broadcast if it is small (``bounded``) and joined by a shuffle if not.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from satchel.llm.chunks import cuts
from satchel.llm.repeats import distinct_texts, keyed
from satchel.llm.shared import arrow_rows, bounded, byte_pieces, written

LEAST, BITS, MOST = 256, 10, 8192
UNIT = 64
RATE = 8000
PIECE = 1 << 18


def wav_head(n: int) -> bytes:
    """The head of a WAV file of ``n`` (even) 8-bit mono samples (canonical fields in order)."""
    word = lambda x, k: int(x).to_bytes(k, "little")
    return b"RIFF" + word(36 + n, 4) + b"WAVEfmt " + word(16, 4) + word(1, 2) + word(1, 2) + word(RATE, 4) + word(RATE, 4) + word(1, 2) + word(8, 2) + b"data" + word(n, 4)


def samples_of(file: bytes) -> bytes:
    """The samples of such a file."""
    if file[:4] != b"RIFF" or file[8:16] != b"WAVEfmt " or file[34:36] != b"\x08\x00":
        raise ValueError("not an 8-bit WAV file")
    return file[44 : 44 + int.from_bytes(file[40:44], "little")]


def payload(text: bytes) -> bytes:
    return text + bytes((-len(text)) % UNIT if text else UNIT)


def media_file(text: bytes) -> bytes:
    p = payload(text)
    return wav_head(len(p)) + p


def _files(texts: pa.Array) -> Iterator[tuple[int, list[bytes], list[list[tuple[int, int]]]]]:
    """Of consecutive rows: the first row, media files, (start, end) of their chunks."""
    for first, _, data, offsets in byte_pieces(texts, PIECE):
        raw = data.tobytes()
        own = [media_file(raw[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        at = np.concatenate([[0], np.cumsum([len(p) for p in own])])
        ends = cuts(np.frombuffer(b"".join(own), np.uint8), at, LEAST, BITS, MOST)
        yield first, own, [list(zip([0, *x[:-1]], x, strict=True)) for x in ends]


def digest(chunk: bytes) -> bytes:
    return hashlib.sha256(chunk).digest()[:16]


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for _, own, spans in _files(b.column("text")):
            out += [b"".join(digest(p[s:e]) for s, e in x) for p, x in zip(own, spans, strict=True)]
        yield pa.RecordBatch.from_arrays([b.column("key"), pa.array(out, pa.binary())], names=["key", "digests"])


_STORED = "kind string, key binary, sha256 string, digests binary, lengths array<int>, away array<int>, data binary"


def _stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A media row for each file, and a row for each shared chunk that it owns. ``shared`` has
    the places of its shared chunks, ``owned`` those that are stored from here."""
    kinds = [pa.string(), pa.binary(), pa.string(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary()]
    for b in batches:
        shared, owned = b.column("shared").to_pylist(), b.column("owned").to_pylist()
        for first, files, spans in _files(b.column("text")):
            rows = []
            for k, (f, x) in enumerate(zip(files, spans, strict=True), first):
                away, mine = set(shared[k] or ()), owned[k] or ()
                rows += [("chunk", digest(f[x[i][0] : x[i][1]]), None, None, None, None, zlib.compress(f[x[i][0] : x[i][1]], 1)) for i in mine]
                inline = b"".join(f[s:e] for i, (s, e) in enumerate(x) if i not in away)
                rows.append(("media", b.column("key")[k].as_py(), hashlib.sha256(f).hexdigest(), b"".join(digest(f[s:e]) for s, e in x), [e - s for s, e in x], sorted(away), zlib.compress(inline, 1)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["kind", "key", "sha256", "digests", "lengths", "away", "data"])


def store(rows: DataFrame) -> DataFrame:
    """The media store of ``keyed`` rows: rows of kind media (key: the text's digest, sha256 of
    the file, digests and lengths of its chunks, ``away``: places of chunks that are kept
    elsewhere, data: the other chunks, deflated) and of kind chunk (key: its digest, data)."""
    _, texts = distinct_texts(rows)
    cut = written(arrow_rows(texts, _digests, "key binary, digests binary"), "digests")
    places = F.transform(F.sequence(F.lit(0), (F.length("digests") / 16 - 1).cast("int")), lambda i: F.struct(i.alias("seq"), F.substring("digests", i * 16 + 1, F.lit(16)).alias("digest")))
    uses = cut.select("key", F.explode(places).alias("p")).select("key", "p.*")
    several = written(uses.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("key", "seq")).alias("owner")).where("n > 1").select("digest", "owner"), "shared")
    held = uses.join(bounded(several, 64), "digest").groupBy("key").agg(F.collect_list("seq").alias("shared"), F.collect_list(F.when(F.col("owner") == F.struct("key", "seq"), F.col("seq"))).alias("owned"))
    told = written(held, "told")
    chosen = texts.join(bounded(told, 64 + 4 * (F.size("shared") + F.size("owned"))), "key", "left")
    return written(arrow_rows(chosen.select("key", "text", "shared", "owned"), _stored, _STORED), "media", partition_by="kind")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Files put together from stored bytes; digests and features."""
    kinds = [pa.binary(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    for b in batches:
        rows = []
        for key, sha, digests, lengths, data, parts in zip(*(b.column(c).to_pylist() for c in ("key", "sha256", "digests", "lengths", "data", "parts")), strict=True):
            inline, at, got = zlib.decompress(data), 0, []
            away = {p["seq"]: p["data"] for p in parts or ()}
            for i, n in enumerate(lengths):
                if i in away:
                    chunk = zlib.decompress(away[i]) if away[i] is not None else b""
                else:
                    chunk, at = inline[at : at + n], at + n
                if digest(chunk) != digests[16 * i : 16 * i + 16]:
                    raise ValueError("a stored chunk is lost or differs from its digest")
                got.append(chunk)
            file = b"".join(got)
            if hashlib.sha256(file).hexdigest() != sha:
                raise ValueError("a media file differs from its digest")
            p = samples_of(file)
            rows.append((key, len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-UNIT:]), len(file), sha, feature(p)))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 7, kinds, strict=True)], names=["key", *OUTPUTS[1:]])


def feature(samples: bytes) -> str:
    """Count, mean and deviation (thousandths), lowest, highest, and steps across 128."""
    x = np.frombuffer(samples, np.uint8)
    high = x >= 128
    return f"n={len(x)};mean={round(1000 * float(x.mean()))};dev={round(1000 * float(x.std()))};min={x.min()};max={x.max()};cross={int((high[1:] != high[:-1]).sum())}"


OUTPUTS = ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")


def read(media: DataFrame) -> DataFrame:
    """Per stored file: key and what was read back. Rows with chunks elsewhere fetch them."""
    rows = media.where("kind = 'media'").select("key", "sha256", "digests", "lengths", "away", "data")
    chunks = media.where("kind = 'chunk'").select(F.col("key").alias("digest"), "data")
    apart = rows.where(F.size("away") > 0)
    wanted = apart.select("key", "digests", F.explode("away").alias("seq")).select("key", "seq", F.substring("digests", F.col("seq") * 16 + 1, F.lit(16)).alias("digest"))
    parts = wanted.join(chunks, "digest", "left").groupBy("key").agg(F.collect_list(F.struct("seq", "data")).alias("parts"))
    whole = rows.where(F.size("away") == 0).withColumn("parts", F.lit(None).cast("array<struct<seq:int,data:binary>>"))
    both = whole.unionByName(apart.join(parts, "key").select(*whole.columns))
    return arrow_rows(both.drop("away"), _read, "key binary, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def media_columns(docs: DataFrame) -> DataFrame:
    """``docs`` (text, ...) with the columns of OUTPUTS in place of ``text``."""
    keep = [c for c in docs.columns if c not in (*OUTPUTS, "text")]
    rows = keyed(docs.select(*keep, "text"))
    listed = rows.select(F.struct(*(F.col("row").getField(c).alias(c) for c in keep)).alias("row") if keep else F.lit(None).alias("row"), F.octet_length("text").cast("long").alias("n_bytes"), "key")
    found = listed.join(read(store(rows)), "key")
    return found.select(*(F.col("row").getField(c).alias(c) for c in keep), *OUTPUTS)


def media_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2: all documents."""
    return media_columns(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
