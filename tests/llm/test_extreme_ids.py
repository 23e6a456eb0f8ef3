"""Null doc_ids and doc_ids near the ends of long, in near-dedup and its components."""

import pytest

from satchel.llm import neardup
from satchel.llm.components import components

LEAST, MOST = -(2**63), 2**63 - 1


def near(word, k):
    """Texts of one ``word`` and different k share over 80 of 100 shingles."""
    return " ".join([f"{word}{j}" for j in range(200)] + [f"edit{word}{k}"])


@pytest.mark.parametrize("ids", [[LEAST, -5, 7], [MOST, MOST - 1, MOST - 2, MOST - 3], [LEAST, LEAST + 1, LEAST + 2, 0, MOST - 1, MOST]])
def test_components_of_extreme_ids(spark, ids):
    links = spark.createDataFrame(list(zip(ids[1:], ids[:-1], strict=True)), "a long, b long")
    assert sorted(tuple(r) for r in components(links).collect()) == sorted((i, min(ids)) for i in ids if i != min(ids))


def test_near_duplicates_of_null_and_extreme_ids(spark):
    groups = {"a": [None, 3, 9], "b": [MOST, MOST - 1, MOST - 2, MOST - 3], "c": [LEAST + 1, LEAST + 2, LEAST + 3], "d": [12]}
    rows = [(i, near(w, k)) for w, ids in groups.items() for k, i in enumerate(ids)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    known = lambda i: LEAST if i is None else i
    want = sorted((known(i), min(map(known, ids))) for ids in groups.values() for i in ids)
    assert sorted((r.doc_id, r.component_id) for r in neardup.near_duplicates(docs).collect()) == want
    kept = [r.doc_id for r in neardup.kept_documents(docs).collect()]
    assert sorted(map(known, kept)) == sorted(min(map(known, ids)) for ids in groups.values()) and None in kept
