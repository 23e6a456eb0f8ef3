"""Vectors compared in tiles: against a plain comparison, with tiles of few rows."""

import numpy as np
import pytest

from satchel.operators import tiles as T
from satchel.operators import vectors as V

ROWS = "id long, vector array<float>, model string, provider string"
ASKED = "query_id long, vector array<float>, model string, exclude long, min_score double, provider string"


@pytest.fixture(autouse=True)
def small(monkeypatch):
    monkeypatch.setattr(T, "ROWS", 40)


def vectors():
    """150 rows of two models and two lengths, with equal vectors and dyadic products."""
    rng = np.random.default_rng(3)
    base = rng.integers(-8, 9, size=(50, 6)) / 8
    return [(k, [float(x) for x in base[k % 50][: 6 - 2 * (k % 7 == 0)]], "ab"[k % 3 == 0], "xy"[k % 2]) for k in range(150)]


def product(a, b):
    total = 0.0
    for x, y in zip(a, b, strict=True):
        total += x * y
    return total


def test_best_rows(spark):
    rows = vectors()
    asked = [(k, v, m, k if k % 4 else None, [-9.0, 0.25][k % 2], [None, "x", "z"][k % 3]) for k, v, m, _ in rows[:60]]
    got = V.cosine_top(spark.createDataFrame(rows, ROWS), spark.createDataFrame(asked, ASKED), 5, block=16)
    want = []
    for q, v, m, without, least, provider in asked:
        found = [(-float(np.round(product(v, w), 6)), k) for k, w, n, p in rows if n == m and len(w) == len(v) and k != without and provider in (None, p)]
        want += [(q, k, -c, r + 1) for r, (c, k) in enumerate(sorted(x for x in found if -x[0] >= least)[:5])]
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_no_task_holds_all_rows_of_a_block(spark):
    rows = spark.createDataFrame(vectors(), ROWS)
    dealt = T.tiles(rows.drop("provider"), rows.drop("provider"), 50)
    sizes = [len(part) for part in dealt.select("t_").rdd.glom().collect()]
    assert len(sizes) == 12 and max(sizes) < 2 * (50 + 40) and sum(sizes) == 150 * 4 + 150 * 3


def test_target_ranks(spark):
    rows = vectors()
    asked = [(k, v, m, k, -9.0, None) for k, v, m, _ in rows[:60]]
    aims = [(k, (k + 50) % 150) for k in range(60)]
    got = V.target_ranks(spark.createDataFrame(rows, ROWS), spark.createDataFrame(asked, ASKED), spark.createDataFrame(aims, "query_id long, id long"))
    half_up = lambda c: float(np.sign(c) * np.floor(abs(c) * 1e6 + 0.5) / 1e6)
    want = set()
    for (q, v, m, _, _, _), (_, t) in zip(asked, aims, strict=True):
        mates = {k: half_up(product(v, w)) for k, w, n, _ in rows if n == m and len(w) == len(v) and k != q}
        if t in mates:
            want.add((q, t, mates[t], 1 + sum(c > mates[t] or (c == mates[t] and k < t) for k, c in mates.items())))
    found = {tuple(r) for r in got.collect() if r.similarity is not None}
    assert found == want and len(want) > 10
