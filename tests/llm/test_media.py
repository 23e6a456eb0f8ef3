"""The media store: what is on disk are the files, and damage is found when they are read."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from satchel.llm import media
from satchel.llm.repeats import keyed

LONG = " ".join(f"word{k * k * k % 100003}" for k in range(3000))


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, LONG), (2, LONG + " tail"), (3, "head " + LONG), (4, None), (5, ""), (6, "short"), (7, LONG), (7, LONG), (None, "short")]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


@pytest.fixture(scope="module")
def stored(docs):
    return media.store(keyed(docs))


def test_stored_bytes_are_the_files(docs, stored):
    rows = {r.kind: [x for x in stored.collect() if x.kind == r.kind] for r in stored.select("kind").distinct().collect()}
    chunks = {bytes(r.key): zlib.decompress(r.data) for r in rows["chunk"]}
    assert len(chunks) == len(rows["chunk"]) > 3 and len(rows["media"]) == 5
    for r in rows["media"]:
        inline, out = zlib.decompress(r.data), b""
        for i, n in enumerate(r.lengths):
            if i in r.away:
                out += chunks[bytes(r.digests[16 * i : 16 * i + 16])]
            else:
                out, inline = out + inline[:n], inline[n:]
        assert hashlib.sha256(out).hexdigest() == r.sha256 and out[:4] == b"RIFF"
    wanted = {hashlib.md5((t or "").encode()).digest(): hashlib.sha256(media.media_file((t or "").encode())).hexdigest() for _, t in docs.collect()}
    assert {bytes(r.key): r.sha256 for r in rows["media"]} == wanted
    assert sum(map(len, chunks.values())) > len(LONG) / 2  # what files share is stored once


def test_lost_chunk_and_changed_digest_fail(spark, stored):
    lost = stored.where("kind = 'chunk'").orderBy("key").first().key
    with pytest.raises(Exception, match="lost or differs"):
        media.read(stored.where((F.col("kind") == "media") | (F.col("key") != F.lit(lost)))).collect()
    with pytest.raises(Exception, match="differs from its digest"):
        media.read(stored.withColumn("sha256", F.lit("0"))).collect()


def test_columns_pass_through(spark):
    docs = spark.createDataFrame([(1, "a", "k", "x", "r", "t1"), (2, "b", "l", "y", "s", None)], "doc_id long, key string, kind string, feature string, row string, text string")
    out = media.media_columns(docs)
    assert [(r.doc_id, r.key, r.kind, r.row) for r in sorted(out.collect())] == [(1, "a", "k", "r"), (2, "b", "l", "s")]
    assert out.where("feature IN ('x', 'y')").count() == 0
    assert media.media_columns(docs.limit(0)).columns == out.columns and media.media_columns(docs.limit(0)).count() == 0
    assert media.media_columns(docs.select("text")).columns == list(media.OUTPUTS)
