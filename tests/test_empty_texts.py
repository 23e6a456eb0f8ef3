"""Documents without text, and with white space before it, in the pages of parser queries."""

import duckdb
import pytest

from satchel.catalog import QUERIES, SQL
from satchel.operators import parsing as P

TEXTS = ["", " ", "\n two lines\nand an end ", "plain", "Untitled post", "~ marked"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("odd"))
    rows = [(k, TEXTS[k % len(TEXTS)], "en", "web", len(TEXTS[k % len(TEXTS)])) for k in range(120)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{d}/documents.parquet")
    return d


@pytest.mark.parametrize("name", ["p14_substack", "p14_substack_whole", "p7_twitter", "p7_twitter_whole"])
def test_empty_texts_equal_sql(spark, folder, name):
    got = QUERIES[name](spark, folder)
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    want = c.execute(SQL[name])
    columns = [x[0] for x in want.description]
    assert sorted(map(repr, map(tuple, got.select(*columns).collect()))) == sorted(map(repr, want.fetchall()))


def test_parser_still_names_a_post_without_title(spark):
    body = '{"items":[{"post":{"id":1,"title":""}},{"post":{"id":2}},{"post":{"id":3,"title":"x"}}]}'
    found = P.substack(spark.createDataFrame([(1, body, None)], "page_id long, body string, context string"))
    assert [r.title for r in found.orderBy("pos").collect()] == ["Untitled post", "Untitled post", "x"]


def test_parser_still_trims_a_post(spark):
    post = '{"content":{"itemContent":{"tweet_results":{"result":{"rest_id":"1","legacy":{"full_text":"\\n a b https://t.co/zz"}}}}}}'
    body = '{"data":{"bookmark_timeline_v2":{"timeline":{"instructions":[{"type":"TimelineAddEntries","entries":[' + post + "]}]}}}}"
    assert P.twitter(spark.createDataFrame([(1, body, None)], "page_id long, body string, context string")).first().summary == "a b"
