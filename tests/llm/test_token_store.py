"""The token store: ids of awkward texts, and every kind of damage is found when it is read."""

import random

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from satchel.llm import tokenstore

PATH = P.path("byte_bpe_50k.json")


@pytest.mark.parametrize("seed", range(6))
def test_ids_are_those_of_the_whole_text(seed):
    e, rng = tokenstore.encoder(PATH), random.Random(seed)
    pool = [" ", "\n", "\t", "a", "b", "é", "1", "'s", "!", "\x1c", "\u3000", "漢", "<|endoftext|>", "\xa0", "\x85", " the", "word", "…", "\r\n", "x" * 60]
    for _ in range(40):
        texts = ["".join(rng.choice(pool) * rng.choice([1, 1, 1, 2, 3]) for _ in range(rng.randint(0, 14))) for _ in range(20)]
        raw = [t.encode() for t in texts]
        ids, at = e.encode(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0] + [len(x) for x in raw]))
        for k, t in enumerate(texts):
            assert ids[at[k] : at[k + 1]].tolist() == e.tokenizer.encode(t, add_special_tokens=False).ids


def test_equal_hashes_are_told_apart_by_bytes(monkeypatch):
    monkeypatch.setattr(tokenstore, "mix64", lambda x: x.astype(np.uint64) & np.uint64(3))
    e = tokenstore.Encoder(PATH)
    text = "some words that all share four hashes, some twice: some words"
    for _ in range(2):
        ids, _ = e.encode(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text)]))
        assert ids.tolist() == e.tokenizer.encode(text, add_special_tokens=False).ids


def test_forgetting_changes_nothing(monkeypatch):
    monkeypatch.setattr(tokenstore, "CACHE_BYTES", 10)
    e = tokenstore.Encoder(PATH)
    for text in ("first words here", "other words there", "first words here"):
        ids, _ = e.encode(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text)]))
        assert ids.tolist() == e.tokenizer.encode(text, add_special_tokens=False).ids


@pytest.fixture(scope="module")
def store(spark):
    docs = spark.createDataFrame([(i, f"text {i} of a document " * (1 + 40 * (i % 3))) for i in range(40)] + [(None, None), (3, "")], "doc_id long, text string")
    return tokenstore.write_store(docs, PATH)


def damaged(spark, df, column, value, n=1):
    rows = df.orderBy(*df.columns[:2]).collect()
    rows = [r.asDict() for r in rows]
    for r in rows[:n]:
        r[column] = value(r[column])
    return spark.createDataFrame(rows, df.schema)


def test_whole_store_is_read(store):
    assert tokenstore.read_store(*store).count() == 42


def test_a_changed_chunk_fails(spark, store):
    chunks, recipes, manifests = store
    bad = damaged(spark, chunks, "bytes", lambda b: bytes([b[0] ^ 1]) + bytes(b[1:]))
    for read in (tokenstore.read_store, tokenstore.reconstruct):
        with pytest.raises(Exception, match="chunk is lost or differs"):
            read(bad, recipes, manifests).collect()


def test_a_lost_chunk_fails(store):
    chunks, recipes, manifests = store
    lost = chunks.orderBy("chunk").first().chunk
    for read in (tokenstore.read_store, tokenstore.reconstruct):
        with pytest.raises(Exception, match="chunk is lost or differs"):
            read(chunks.where(F.col("chunk") != F.lit(lost)), recipes, manifests).collect()


@pytest.mark.parametrize("how", ["recipe", "root", "n_tokens", "lost"])
def test_a_changed_recipe_fails(spark, store, how):
    chunks, recipes, manifests = store
    change = {"recipe": lambda r: [*r, r[0]], "root": lambda r: bytes(32), "n_tokens": lambda n: n + 1}
    bad = recipes.where("place > 0") if how == "lost" else damaged(spark, recipes, how, change[how])
    with pytest.raises(ValueError, match="manifest"):
        tokenstore.read_store(chunks, bad, manifests)


@pytest.mark.parametrize("how", ["root", "n_tokens", "n_docs", "lost"])
def test_a_changed_manifest_fails(spark, store, how):
    chunks, recipes, manifests = store
    change = {"root": lambda r: bytes(32), "n_tokens": lambda n: n + 1, "n_docs": lambda n: n - 1}
    bad = manifests.where("file > 0") if how == "lost" else damaged(spark, manifests, how, change[how])
    with pytest.raises(ValueError, match="manifest"):
        tokenstore.read_store(chunks, recipes, bad)
