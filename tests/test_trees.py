"""Walks over pages of no fixed shape, entities, and what has no SQL."""

from pyspark.sql import functions as F

from satchel.functions import text as X
from satchel.functions import trees as W
from satchel.operators import parsing as P
from satchel.operators import videos as D


def row(i):
    return {"playlistVideoRenderer": {"videoId": i}}


def test_rows_stand_in_lists_outside_of_suggestions():
    inner = {"playlistVideoRenderer": {"videoId": "a", "menu": {"contents": [row("copy")]}}}
    page = {"x": {"contents": [inner, {"deep": {"continuationItems": [row("b")]}}]}, "shelfRenderer": {"contents": [row("s")]}, "loose": row("not in a list"), "y": [{"contents": [row("c"), None]}]}
    assert [r["videoId"] for r in W.walk(page, W.list_rows)] == ["a", "b", "c"]


def test_depth_has_an_end():
    page = {"contents": [row("deep")]}
    for _ in range(W.DEEPEST + 1):
        page = {"k": page}
    assert not list(W.walk(page, W.list_rows))


def test_token_of_suggestions_is_passed_over():
    more = lambda t: {"continuationItemRenderer": {"continuationEndpoint": {"continuationCommand": {"token": t}}}}
    batch = lambda *e: {"appendContinuationItemsAction": {"continuationItems": list(e)}}
    assert W.next_token({"sections": [row("a"), more("never")]}) is None
    assert W.next_token([batch(more("never")), batch(row("a"), more("next"))]) == "next"
    assert W.next_token({"playlistVideoListRenderer": {"contents": [row("a"), more("first")]}, "z": batch(row("a"), more("next"))}) == "first"


def test_image_is_the_first_with_a_usable_artifact():
    part = lambda w, s: {"width": w, "fileIdentifyingUrlPathSegment": s}
    assert W.image_in({"a": {"rootUrl": "r", "artifacts": []}, "b": [{"rootUrl": "q", "artifacts": [part(400, "x"), part(90, "y"), part(110, "z")]}]}) == "qy"
    assert W.image_in({"rootUrl": 1}) == "" and W.image_in(None) == ""


def test_entities(spark):
    texts = ["&#38;#60;", "&#x110000;&#xD800;&#99999999999999999999;", "&amp;lt; &copy;", "", None, "a&#X41;b&#0065;"]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").select("k", X.decode_entities(F.col("t")).alias("t")).orderBy("k").collect()
    assert [r.t for r in rows] == ["&#60;", texts[1], "&lt; &copy;", "", None, "aAbA"]


def test_broken_video_pages_have_no_rows(spark):
    pages = spark.createDataFrame([(1, None, None), (2, "{", "{}"), (3, "[]", "{}")], "page_id long, body string, context string")
    assert D.youtube(pages).count() == 0
    assert [tuple(r) for r in D.cursors(pages).orderBy("page_id").collect()] == [(1, None, False), (2, None, False), (3, None, False)]
    assert ("youtube", None) in P._parsers
