"""A backlog job that is stopped keeps what it has finished."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from satchel.operators import embedding as E
from satchel.plans.archive_queries import _folder

SCHEMA = "id long, title string, deleted_at long, embedding array<float>, embedding_model string"


def rows(spark, texts):
    return spark.createDataFrame([(i, t, 1 if i == 7 else None, None, None) for i, t in texts.items()], SCHEMA)


def text_of(items):
    return items.select("id", F.col("title").alias("text"))


def fails_on(word):
    def embed(texts):
        if any(word in t for t in texts):
            raise ValueError(word)
        return np.array([[len(t), 1.0] for t in texts])

    return embed


def vectors(df):
    return {r.id: r.embedding for r in df.collect()}


def test_resumes_where_it_stopped(spark):
    texts = {i: f"text{i} " * (i % 5 + 1) for i in range(40)}
    items, folder = rows(spark, texts), _folder(spark, "vectors")
    E.register_embedder("m", fails_on("text3 "))
    with pytest.raises(Exception, match="text3"):
        E.embed_in_slices(items, text_of, "m", folder, 4)
    kept = {r.id for r in E.finished_vectors(spark, folder, "m").collect()}
    assert 20 <= len(kept) < 40 and 39 in kept and 3 not in kept
    # rows that are kept would fail now, were they embedded again
    E.register_embedder("m", fails_on("text39 "))
    done = E.embed_in_slices(items, text_of, "m", folder, 4)
    assert vectors(done) == {i: None if i == 7 else [float(len(t)), 1.0] for i, t in texts.items()}
    assert done.where("embedding_model = 'm'").count() == 39
    # a text that changes is embedded again; another model starts anew
    E.register_embedder("m", fails_on("text5 "))
    changed = E.embed_in_slices(rows(spark, texts | {4: "other"}), text_of, "m", folder, 2)
    assert vectors(changed)[4] == [5.0, 1.0] and vectors(changed)[5] == vectors(done)[5]
    assert E.finished_vectors(spark, folder, "n").count() == 0


def test_nothing_to_do(spark):
    E.register_embedder("m", fails_on("never"))
    assert E.embed_in_slices(rows(spark, {1: "a"}).limit(0), text_of, "m", _folder(spark, "vectors")).count() == 0
