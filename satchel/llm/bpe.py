"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

Long texts are cut before white space that follows a character which is none: no match of
the splitting pattern reaches across such a place and none looks behind it, so the ids of
the parts joined are the ids of the whole. A part begins with at most one run of white space
that is long; by the pattern all of it but its last character is one match (at the end of
the text, all of it), which is encoded without the pattern, whose matcher would go back
through the whole run on its stack. Decoding concatenates the raw bytes of the ids, so a
token that holds part of a character is decoded exactly.

Null and empty texts have no ids; equal texts have equal ids; there is no grouping, so
ties, repeated rows and hot keys cost nothing; output columns replace input columns of the
same name, all other columns pass through; an empty table gives an empty table.
"""

from __future__ import annotations

import base64
import hashlib
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from satchel.llm.shared import append_columns

#: Texts of more characters than this are encoded in parts of about this many.
PART_CHARS = 1 << 16
#: White space as the pattern's \s has it (Unicode's White_Space property, fixed values).
WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: A place where a text can be cut: the white space after it starts a match of its own.
SAFE = re.compile(f"(?<=[^{WHITE}])(?=[{WHITE}])")
RUN = re.compile(f"[{WHITE}]*")


@lru_cache(maxsize=4)
def encoder(rank_path: str, pattern: str):
    """The encoding of a rank file, once per Python worker."""
    import tiktoken

    with open(rank_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=4)
def decimal(rank_path: str, pattern: str) -> list[bytes]:
    return [b"%d" % i for i in range(encoder(rank_path, pattern).n_vocab + 1)]


def parts(text: str, limit: int = PART_CHARS) -> list[str]:
    """``text`` cut at safe places at least ``limit`` characters apart, and before every run of
    more white space than ``limit``, so that such a run only begins a part."""
    spots, start = [], 0
    while len(text) - start > limit:
        cut = SAFE.search(text, start + limit)
        if not cut:
            break
        start = cut.start()
        spots.append(start)
    long_run = re.compile(f"[{WHITE}]{{{limit + 1},}}")
    spots += [m.start() for m in long_run.finditer(text) if m.start()]
    edges = [0, *sorted(set(spots)), len(text)]
    return [text[a:z] for a, z in zip(edges[:-1], edges[1:], strict=True)]


def encode_part(part: str, enc) -> list[int]:
    """Ids of one of ``parts``. A long run at its start is split off by the pattern's own rule."""
    run = RUN.match(part).end()
    if run <= PART_CHARS:
        return enc.encode_ordinary(part)
    if run < len(part):
        run -= 1
    return enc._encode_single_piece(part[:run]) + enc.encode_ordinary(part[run:])


def encode_text(text: str | None, rank_path: str, pattern: str) -> list[int]:
    if not text:
        return []
    enc = encoder(rank_path, pattern)
    if len(text) <= PART_CHARS:
        return enc.encode_ordinary(text)
    return [i for p in parts(text) for i in encode_part(p, enc)]


def encode(df: DataFrame, rank_path: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``df`` with ``ids`` array<int> of ``text``."""

    def run(texts: pa.Array) -> list[pa.Array]:
        return [pa.array([encode_text(t, rank_path, pattern) for t in texts.to_pylist()], pa.list_(pa.int32()))]

    return append_columns(df, [text], [T.StructField(ids, T.ArrayType(T.IntegerType()))], run)


def decode(df: DataFrame, rank_path: str, pattern: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``df`` with the raw bytes of ``ids``; null ids are no bytes."""

    def run(rows: pa.Array) -> list[pa.Array]:
        enc = encoder(rank_path, pattern)
        return [pa.array([enc.decode_bytes(r or []) for r in rows.to_pylist()], pa.binary())]

    return append_columns(df, [ids], [T.StructField(out, T.BinaryType())], run)


def round_trip(df: DataFrame, rank_path: str, pattern: str, text: str = "text", keep_ids: bool = False) -> DataFrame:
    """``df`` with n_tokens, ids_sha256 (of decimal ids joined by commas) and decoded_sha256,
    and with the ids themselves if ``keep_ids``. One pass: ids don't leave the task for the
    digests."""

    def run(texts: pa.Array) -> list[pa.Array]:
        enc, strings = encoder(rank_path, pattern), decimal(rank_path, pattern)
        n, sha, decoded, kept = [], [], [], []
        for t in texts:
            ids = encode_text(t.as_py(), rank_path, pattern)
            n.append(len(ids))
            sha.append(hashlib.sha256(b",".join(map(strings.__getitem__, ids))).hexdigest())
            decoded.append(hashlib.sha256(enc.decode_bytes(ids)).hexdigest())
            if keep_ids:
                kept.append(ids)
        out = [pa.array(n, pa.int64()), pa.array(sha, pa.string()), pa.array(decoded, pa.string())]
        return [*out, pa.array(kept, pa.list_(pa.int32()))] if keep_ids else out

    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    if keep_ids:
        fields.append(T.StructField("ids", T.ArrayType(T.IntegerType())))
    return append_columns(df, [text], fields, run, drop=() if keep_ids else (text,))


def bpe_query(spark, sf_dir: str) -> DataFrame:
    """op7: every whole text of documents, by the multilingual rank file."""
    import public_tokenizers as P

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.col("text"))
    return round_trip(docs, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
