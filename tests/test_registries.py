"""Adding services and embedders, choosing keys, and pages nothing can parse."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from satchel.operators import embedding as E
from satchel.operators import parsing as P
from satchel.operators import snapshots as D


@pytest.fixture
def service():
    def parse(pages):
        return pages.select("page_id", F.lit(0).alias("pos"), *P.item_columns(external_id=F.get_json_object("body", "$.id"), title=F.lit("new")))

    P.register_parser("example", parse, next_of=lambda pages: pages.select("page_id", F.get_json_object("body", "$.next").alias("cursor"), F.lit(True).alias("more")))
    P.register_parser("example", P.no_items, "names")
    yield
    del P._parsers["example", None], P._parsers["example", "names"]


def test_a_registered_service(spark, service):
    rows = [(1, "example", "items", '{"id":"a","next":"n"}'), (2, "example", "names", "{}"), (3, "example", None, '{"id":"b"}'), (4, "example", "other", "{}"), (5, None, "items", "{}"), (6, "example", "items", None)]
    pages = spark.createDataFrame(rows, "page_id long, provider string, kind string, body string").withColumn("context", F.lit(None).cast("string"))
    items, outcomes = P.parse_pages(pages)
    assert sorted((r.page_id, r.provider, r.external_id, r.title) for r in items.collect()) == [(1, "example", "a", "new"), (3, "example", "b", "new")]
    got = {r.page_id: (r.n_items, r.error, r.cursor, r.has_next) for r in outcomes.collect()}
    assert got[1] == (1, None, "n", True) and got[2] == (0, None, None, False) and got[3] == (1, None, None, False)
    assert got[4][1] == "No parser for pages of kind other" and got[5][1] == "No parser for null" and got[6][1] == "body is not JSON"


def test_an_unknown_provider_fails_its_page_only(spark):
    pages = spark.createDataFrame([(1, "nowhere", "{}", None), (2, "linkedin", '{"included":[]}', None)], "page_id long, provider string, body string, context string")
    got = {r.page_id: (r.n_items, r.error, r.has_next) for r in P.parse_pages(pages)[1].collect()}
    assert got == {1: (0, "No parser for nowhere", False), 2: (0, None, False)}


def test_a_registered_embedder(spark):
    E.register_embedder("lengths", lambda texts: np.array([[len(t), 1.0] for t in texts]))
    try:
        texts = spark.createDataFrame([(1, "abc"), (2, None)], "id long, text string")
        assert {r.id: list(r.vector) for r in E.embedded(texts, "lengths").collect()} == {1: [3.0, 1.0], 2: [0.0, 1.0]}
    finally:
        del E._embedders["lengths"]


def test_key_choice(spark):
    b, a = spark.createDataFrame([], "x int, y int, z int"), spark.createDataFrame([], "x int, y int")
    assert D.chosen_key(b, a, ["y"], ["x"]) == ["y"] and D.chosen_key(b, a, None, ["x"], {"k": ["y"]}) == ["x"]
    assert D.chosen_key(b, a, None, ["z"], {"n": ["y"], "m": ["x", "y"], "a": ["z"]}) == ["x", "y"]
    assert D.chosen_key(b, a) is None
    with pytest.raises(ValueError, match="z"):
        D.chosen_key(b, a, ["x", "z"])


def test_empty_vectors_and_blobs(spark):
    from satchel.sources import tables as T

    df = spark.createDataFrame([(1, [1.0, 2.5]), (2, None), (3, []), (4, [7.0])], "id int, v array<float>").coalesce(1)
    got = {r.id: (r.b and bytes(r.b), r.w) for r in df.select("id", T.blob_of_vector("v").alias("b")).withColumn("w", T.vector_of_blob("b")).collect()}
    assert got[1] == (np.array([1, 2.5], "<f4").tobytes(), [1.0, 2.5]) and got[2] == (None, None) and got[3][1] == [] and got[4][1] == [7.0]


def test_changed_cells_without_other_columns(spark):
    from satchel.operators import snapshots as D

    df = spark.createDataFrame([(1,), (2,)], "k int")
    assert D.changed_cells(df, df, ["k"]).collect() == []
