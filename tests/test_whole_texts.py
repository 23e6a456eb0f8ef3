"""Pages of parser and replay queries carry whole texts."""

import json

import pytest
from pyspark.sql import functions as F

from satchel.catalog import QUERIES
from satchel.operators import replay as Y
from satchel.plans import replay_queries as R

SF = "/root/testdata/sf0.001"


def texts(spark):
    return {str(r.doc_id): r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def test_replayed_items_have_the_whole_text(spark):
    known, body = texts(spark), {}
    for r in R._archive(spark, SF).where("page_id % 13 <> 0").collect():
        body |= {str(e["media"]["pk"]): e["media"]["caption"]["text"] for e in json.loads(r.body)["items"] if "pk" in e["media"]}
    assert body and body == {i: known[i] for i in body}
    items = Y.replayed(R._stored(spark, SF), R._archive(spark, SF), R.NOW, everything=True)[0].where(F.length("summary") > 0).collect()
    assert max(len(r.summary) for r in items) > 200
    assert all(r.summary.split() == known[r.external_id].split() for r in items)


@pytest.mark.parametrize("name", ["p2_hackernews_stories", "p3_hackernews_comments", "p5_instagram", "p7_twitter", "p8_videos", "p11_linkedin", "p13_facebook", "p14_substack"])
def test_parser_queries_over_whole_texts(spark, name):
    known = texts(spark)
    column = "title" if name in ("p2_hackernews_stories", "p8_videos") else "summary"
    found = [r[0] or "" for r in QUERIES[f"{name}_whole"](spark, SF).select(column).collect()]
    if name == "p14_substack":
        found += [r[0] for r in QUERIES["p14_substack_whole"](spark, SF).select("title").collect()]
    longest = max(known.values(), key=len)
    assert max(map(len, found)) > 1000 and sum(map(len, found)) > sum(map(len, known.values())) / 2
    assert len(longest) > 1000
