"""Byte-level BPE of texts with long runs of white space: what the pattern's rule defines."""

import hashlib
import random

import public_tokenizers as P
import pytest

from satchel.llm import bpe

PATH = P.path("byte_bpe_multi_50k.tiktoken")
N = 2_000_000


@pytest.mark.parametrize("run", [" " * N, "\n" * N, " \n\t　" * (N // 4)])
def test_runs_longer_than_the_library_matches(run):
    enc = bpe.encoder(PATH, P.PATTERN)
    piece = enc._encode_single_piece
    assert bpe.encode_text(run, PATH, P.PATTERN) == piece(run)
    tail = enc.encode_ordinary(run[-1] + "b c")
    assert bpe.encode_text("a" + run + "b c", PATH, P.PATTERN) == enc.encode_ordinary("a") + piece(run[:-1]) + tail
    assert enc.decode(bpe.encode_text("a" + run + "b c", PATH, P.PATTERN)) == "a" + run + "b c"


@pytest.mark.parametrize("limit", [1, 2, 3, 5, 9])
def test_parts_give_the_ids_of_the_whole(limit, monkeypatch):
    monkeypatch.setattr(bpe, "PART_CHARS", limit)
    enc, rng = bpe.encoder(PATH, P.PATTERN), random.Random(limit)
    pool = [" ", "\n", "\t", "a", "b", "é", "1", "'s", "!", "\x1c", "　", "漢"]
    for _ in range(1500):
        text = "".join(rng.choice(pool) * rng.choice([1, 1, 1, 2, 7]) for _ in range(rng.randint(1, 14)))
        assert [i for p in bpe.parts(text, limit) for i in bpe.encode_part(p, enc)] == enc.encode_ordinary(text), text


def test_a_long_run_in_a_table(spark):
    text = "a" + " " * N + "\n" * N + "b"
    row = bpe.round_trip(spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string"), PATH, P.PATTERN).where("doc_id = 1").first()
    assert row.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
