"""What the classifier's driver holds: one sum of the tasks, and the positives once."""

import tracemalloc

import numpy as np

from satchel.llm import quality


def test_driver_gets_one_sum_of_many_tasks(spark, monkeypatch):
    rows = spark.createDataFrame([(bytes(np.full(4, k, np.float32).tobytes()), 0) for k in range(50)], "x binary, fold int").repartition(25)
    size = 2 * quality.DENSE * 1000 + 3
    collected, collect = [], type(rows).collect
    monkeypatch.setattr(type(rows), "collect", lambda self: collected.append(collect(self)) or collected[-1])
    monkeypatch.setattr(quality, "SUMS_BYTES", 0)
    total = quality.added(rows, lambda x, _: np.arange(size) * len(x), size)
    assert np.array_equal(total, np.arange(size) * 50)
    assert sum(len(r.x) for found in collected for r in found) == 8 * size


def test_models_of_the_prior_share_the_positives(monkeypatch):
    rng = np.random.default_rng(0)
    ones = lambda x: np.hstack([x, np.ones((len(x), 1))])
    sp, of = ones(rng.normal(1, 1, (20_000, 30))), np.arange(20_000) % quality.FOLDS
    x, f = rng.normal(size=(100, 30)).astype(np.float32), np.arange(100) % quality.FOLDS
    monkeypatch.setattr(quality, "added", lambda u, of, size: of(x, f))
    tracemalloc.start()
    prior = quality.prior_of(None, sp, of, np.zeros(30), np.ones(30))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert 0 < prior <= 1 and peak < 2 * sp.nbytes
