"""An embedder gets bounded text at once, and every row its vector."""

import numpy as np

from satchel.operators import embedding as E


def test_batches_are_cut_by_their_text(spark):
    assert list(E.cuts([])) == [] and list(E.cuts(["", "", "abc", "d", "efgh", ""], 4)) == [4, 6] and list(E.cuts(["x" * 9, "y"], 4)) == [1, 2]

    def embed(texts):
        return np.array([[len(t), sum(map(len, texts))] for t in texts], float)

    E.register_embedder("sizes", embed)
    texts = spark.createDataFrame([(i, "z" * (300_000 + i) if i else None) for i in range(40)], "id long, text string").coalesce(1)
    got = {r.id: r.vector for r in E.embedded(texts, "sizes").collect()}
    assert all(got[i][0] == (300_000 + i if i else 0) and got[i][1] <= E.CHUNK for i in range(40)) and len(got) == 40
