"""Columns whose names the operators use themselves come back as they were."""

import pytest

from satchel.llm import decontaminate, fmdedup, neardup, quality, suffixdedup

NAMES = ["doc_id", "row", "key", "k_", "_md5", "_kept", "kept", "windows", "copied", "h", "times", "seg", "sid", "n_removed", "th", "md5", "node", "digest", "component", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "score", "score_", "wid", "token", "n", "held_out"]
TEXT = " ".join(f"word{k}" for k in range(60))


@pytest.fixture(scope="module")
def clashing(spark):
    rows = [tuple(f"{c}{i}" if c != "doc_id" else i for c in NAMES) + (t,) for i, t in enumerate([TEXT, TEXT + " more", None, "", "other text", "other text"])]
    return spark.createDataFrame(rows, ", ".join(f"{c} {'long' if c == 'doc_id' else 'string'}" for c in NAMES) + ", text string").repartition(3)


def same_but_text(before, after):
    assert after.columns == before.columns
    keep = {r.doc_id: r for r in after.collect()}
    for r in before.collect():
        if r.doc_id in keep:
            assert all(keep[r.doc_id][c] == r[c] for c in before.columns if c != "text")
    return {i: r.text for i, r in keep.items()}


def test_repeat_removers(clashing):
    text = same_but_text(clashing, suffixdedup.deduplicated(clashing))
    assert text[0] == "" and text[1] == " more" and text[2] is None and text[4] == "other text"
    text = same_but_text(clashing, fmdedup.deduplicated(clashing))
    assert text[0] == "" and text[1] == "more" and text[3] == ""


def test_filters(spark, clashing):
    items = spark.createDataFrame([("x", "word3 word4 word5 word6 word7 word8 word9 word10 word11 word12")], "item_id string, text string")
    text = same_but_text(clashing, decontaminate.decontaminate(clashing, items))
    assert set(text) == {2, 3, 4, 5}
    out = decontaminate.hits(clashing, items)
    assert {r.doc_id: r.n_hit for r in out.collect()} == {0: 10, 1: 10, 2: 0, 3: 0, 4: 0, 5: 0} and out.first().row is not None
    text = same_but_text(clashing, quality.accepted(clashing, quality.Model(0.7)))
    assert len(text) == 6
    text = same_but_text(clashing, neardup.kept_documents(clashing))
    assert set(text) == {0, 2, 3, 4}


def test_columns_that_differ_in_case_are_replaced(spark):
    docs = spark.createDataFrame([(1, "some text", "x", "y")], "doc_id long, text string, Score string, N_HIT string")
    out = quality.score(docs, quality.Model(0.7))
    assert out.columns == ["doc_id", "text", "N_HIT", "score"] and out.select("score").first().score == 0.7
    hits = decontaminate.hits(docs, spark.createDataFrame([("x", "some")], "item_id string, text string"))
    assert hits.select("n_hit").first().n_hit == 1 and "Score" in hits.columns
