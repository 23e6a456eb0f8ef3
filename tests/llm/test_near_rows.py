"""Near-dedup where doc_ids are no keys, and clusters whose estimates and sets disagree."""

import numpy as np

from satchel.llm import neardup


def text(seed, n=120):
    rng = np.random.default_rng(seed)
    return " ".join(f"w{k}" for k in rng.integers(0, 10**6, n))


def test_rows_under_one_doc_id(spark):
    a, b = text(1), text(2)
    rows = [(1, a, 0), (1, b, 1), (1, b, 2), (2, a + " tail", 3), (3, b + " tail", 4), (None, None, 5), (None, "", 6), (4, text(3), 7), (4, text(3), 8), (None, text(4), 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n int").repartition(3)
    kept = sorted(r.n for r in neardup.kept_documents(docs).collect())
    assert len(kept) == 6 and {0, 5, 6, 9} <= set(kept) and len({1, 2} & set(kept)) == 1 and len({7, 8} & set(kept)) == 1
    found = {(r.doc_id, r.component_id) for r in neardup.near_duplicates(docs.select("doc_id", "text")).collect()}
    assert found == {(1, 1), (2, 1), (3, 1), (4, 4), (-(2**63), -(2**63))}


def test_a_chain_that_estimates_join_and_sets_do_not(spark):
    # neighbours share about 0.85 of their shingles, second neighbours 0.72; a few pairs fall between
    rng = np.random.default_rng(5)
    words = [f"w{k}" for k in rng.integers(0, 10**6, 1000)]
    rows = [(k, " ".join(words[s : s + 200])) for k, s in enumerate([0, 12, 24, 36, 70, 82, 94, 300, 322, 344, 360])]
    sets = [{tuple(t.split()[i : i + 5]) for i in range(196)} for _, t in rows]
    least = list(range(len(rows)))
    for _ in rows:
        for i, x in enumerate(sets):
            for j, y in enumerate(sets):
                if 100 * len(x & y) >= 80 * len(x | y):
                    least[i] = least[j] = min(least[i], least[j])
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for block_bytes in (1, 3000, 8 << 20):
        got = {r.doc_id: r.component_id for r in neardup.near_duplicates(docs, 5, 3, block_bytes).collect()}
        assert [got[k] for k in range(len(rows))] == least
