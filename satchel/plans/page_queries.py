"""Queries of page dispatch, cursors and kinds, and of replay over several services."""

from __future__ import annotations

from pyspark.sql import functions as F

from satchel import adapters as A
from satchel.functions import text as X
from satchel.operators import parsing as P
from satchel.operators import replay as Y
from satchel.plans import replay_queries as R
from satchel.plans.archive_queries import _folder
from satchel.plans.queries import _TRIM, NOW, _escaped, query
from satchel.session import written
from satchel.streaming import merge as G

#: Class of a page by its number modulo nine: provider and kind.
CLASSES = [("instagram", "items"), ("substack", "items"), ("twitter", "items"), ("linkedin", "items"), ("facebook", "connection"), ("hackernews", "stories"), ("hackernews", "comments"), ("nowhere", "items"), ("instagram", "odd")]


def _entry(k: int, doc):
    """An entry for a document (doc_id, text) in the shape of class ``k``; every fourth is none."""
    i, s, t = doc["doc_id"], doc["doc_id"].cast("string"), F.coalesce(doc["text"], F.lit(""))
    there = i % 4 != 0
    if k == 1:
        return F.struct(F.when(there, F.struct(i.alias("id"), F.lit("T").alias("title"), t.alias("subtitle"))).alias("post"))
    if k == 2:
        legacy = F.struct(t.alias("full_text"))
        return F.struct(F.struct(F.struct(F.struct(F.struct(F.when(there, s).alias("rest_id"), legacy.alias("legacy")).alias("result")).alias("tweet_results")).alias("itemContent")).alias("content"))
    if k == 3:
        kind = F.when(there, "com.linkedin.voyager.dash.search.EntityResultViewModel").otherwise("other")
        return F.struct(kind.alias("$type"), s.alias("entityUrn"), F.struct(t.alias("text")).alias("summary"))
    if k == 4:
        return F.struct(F.struct(F.when(there, s).alias("id"), F.struct(F.struct(t.alias("text")).alias("savable_description")).alias("savable")).alias("node"))
    if k == 5:
        link = F.when(there, F.concat(F.lit("<span class='titleline'><a href='x'>"), _escaped(t), F.lit("</a></span>"))).otherwise("")
        return F.concat(F.lit('<tr id="'), s, F.lit('" class="athing submission"><td>'), link, F.lit("</td></tr>"))
    if k == 6:
        body = F.when(there, F.concat(F.lit('<div class="commtext c00">'), _escaped(t), F.lit("</div>"))).otherwise("")
        return F.concat(F.lit("<tr class='athing comtr' id='"), s, F.lit("'>"), body, F.lit("</tr>"))
    return F.struct(F.when(there, i).alias("pk"), F.struct(t.alias("text")).alias("caption"))


def _body(k: int, a, cursor):
    """A page's body of its entries and the cursor of the next one."""
    if k == 1:
        return F.to_json(F.struct(a.alias("items"), cursor.alias("nextCursor")))
    if k == 2:
        end = F.struct(F.lit("TimelineTimelineCursor").alias("entryType"), F.lit("Bottom").alias("cursorType"), cursor.alias("value"))
        end = F.to_json(F.struct(end.alias("content")))
        entries = F.array_join(F.concat(F.transform(a, lambda e: F.to_json(e)), F.array(end)), ",")
        return F.concat(F.lit('{"data":{"bookmark_timeline_v2":{"timeline":{"instructions":[{"type":"TimelineAddEntries","entries":['), entries, F.lit("]}]}}}}"))
    if k == 3:
        token = F.to_json(F.struct(cursor.alias("paginationToken")))
        return F.concat(F.lit('{"included":'), F.to_json(a), F.lit(',"data":{"data":{"searchDashClustersByAll":{"metadata":'), token, F.lit("}}}}"))
    if k == 4:
        return F.to_json(F.struct(a.alias("edges"), F.struct(cursor.alias("end_cursor"), F.lit(True).alias("has_next_page")).alias("page_info")))
    if k in (5, 6):
        more = F.when(cursor.isNotNull(), F.concat(F.lit("<a href='?p="), cursor, F.lit("&amp;k=1' class='morelink' rel='next'>More</a>"))).otherwise("")
        return F.concat(F.lit("<table>"), F.array_join(a, "\n"), F.lit("</table>"), more)
    return F.to_json(F.struct(a.alias("items"), F.lit(True).alias("more_available"), cursor.alias("next_max_id")))


def service_pages(spark, d):
    """Pages of ten documents each, in seven shapes of six services, one of an unknown service and
    one of an unknown kind; every thirteenth JSON body is broken, even pages have a next one.
    They are put together once and written by provider, so each parser reads its own only."""
    n = F.col("page_id")
    docs = A.table(spark, d, "documents").groupBy(F.floor(F.col("doc_id") / 10).alias("page_id")).agg(F.array_sort(F.collect_list(F.struct("doc_id", "text"))).alias("x"))
    cursor = F.when(n % 2 == 0, F.concat(F.lit("c"), n.cast("string")))
    of = lambda values: F.element_at(F.array(*map(F.lit, values)), (n % 9 + 1).cast("int"))
    entries = lambda k: F.transform("x", lambda doc: _entry(k, doc))
    body = F.when((n % 13 == 0) & (n % 9 < 5), "{broken")
    for k in range(len(CLASSES)):
        body = body.when(n % 9 == k, _body(k, entries(k), cursor))
    pages = docs.select("page_id", of([p for p, _ in CLASSES]).alias("provider"), of([kind for _, kind in CLASSES]).alias("kind"), F.lit("u").alias("account"), (n % 27 < 9).cast("int").alias("first"), body.alias("body"), F.lit('{"url":"https://news.ycombinator.com/upvoted?id=me"}').alias("context"))
    return written(pages, "service_pages", "provider")


_PAGES = """WITH p AS (SELECT doc_id // 10 AS page_id, count(*) FILTER (doc_id % 4 <> 0) AS n FROM documents GROUP BY ALL),
k AS (SELECT page_id, ['instagram', 'substack', 'twitter', 'linkedin', 'facebook', 'hackernews', 'hackernews', 'nowhere', 'instagram'][page_id % 9 + 1] AS provider, page_id % 9 AS k, n,
 CASE WHEN page_id % 9 = 7 THEN 'No parser for nowhere' WHEN page_id % 9 = 8 THEN 'No parser for pages of kind odd' WHEN page_id % 13 = 0 AND page_id % 9 < 5 THEN 'body is not JSON' END AS error,
 CASE WHEN page_id % 2 = 0 THEN CASE WHEN page_id % 9 IN (5, 6) THEN concat('https://news.ycombinator.com/upvoted?p=c', page_id, '&k=1') ELSE concat('c', page_id) END END AS cursor FROM p)"""
_DOCS = f"""{_PAGES}, i AS (SELECT k.page_id, provider, CASE WHEN k = 1 THEN concat('post:', doc_id) ELSE CAST(doc_id AS VARCHAR) END AS external_id, md5({_TRIM.format("coalesce(text, '')")}) AS text
 FROM documents d JOIN k ON k.page_id = d.doc_id // 10 WHERE doc_id % 4 <> 0 AND error IS NULL)"""


@query(f"{_PAGES} SELECT page_id, provider, CASE WHEN error IS NULL THEN n ELSE 0 END AS n_items, error, CASE WHEN error IS NULL THEN cursor END AS cursor, error IS NULL AND CASE WHEN k IN (1, 2) THEN n > 0 AND cursor IS NOT NULL WHEN k = 3 THEN n > 0 ELSE cursor IS NOT NULL END AS has_next FROM k")
def p1_outcomes_and_cursors(spark, d):
    return P.parse_pages(service_pages(spark, d))[1].select("page_id", "provider", "n_items", "error", "cursor", "has_next")


def _text():
    return F.md5(X.trim_all(F.coalesce(F.nullif("summary", F.lit("")), "title"))).alias("text")


@query(f"{_DOCS} SELECT * FROM i")
def p1_items_of_all_services(spark, d):
    items, _ = P.parse_pages(service_pages(spark, d))
    title = F.when(F.col("external_id").startswith("post:"), "").otherwise(F.col("title"))
    return items.withColumn("title", title).select("page_id", "provider", "external_id", _text())


@query("""WITH n AS (SELECT doc_id // 10 AS page_id, concat('c', doc_id // 2) AS id, doc_id, text FROM documents WHERE coalesce(text, '') <> '' AND doc_id % 7 <> 0)
SELECT page_id, id, arg_max(text, doc_id) AS name FROM n GROUP BY page_id, id""")
def p6_collection_names(spark, d):
    docs = A.table(spark, d, "documents")
    entry = F.struct(F.when(F.col("doc_id") % 7 != 0, F.concat(F.lit("c"), F.floor(F.col("doc_id") / 2).cast("string"))).alias("collection_id"), F.col("text").alias("collection_name"))
    pages = docs.groupBy(F.floor(F.col("doc_id") / 10).alias("page_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", entry.alias("e")))), lambda x: x["e"]).alias("items"))
    return P.instagram_collections(pages.select("page_id", F.to_json(F.struct("items")).alias("body"), F.lit(None).cast("string").alias("context")))


# replay over all of them

def _archive(spark, d):
    n = F.col("page_id")
    status = F.when(n % 5 == 0, "ingested").when(n % 7 == 0, "failed").otherwise("pending")
    return service_pages(spark, d).withColumn("page", F.when(F.col("first") == 1, 0).otherwise(1)).withColumn("fetched_at", n * 1000 + 1700000000000).withColumn("status", status).withColumn("external_ids", F.array(n.cast("string")))


def _nothing(spark):
    return spark.createDataFrame([], R._ITEM)


@query(f"""{_DOCS} SELECT provider, external_id, text FROM i WHERE page_id % 5 <> 0""")
def i12_replay_of_all_services(spark, d):
    items, _ = Y.replayed(_nothing(spark), _archive(spark, d), NOW)
    title = F.when(F.col("external_id").startswith("post:"), "").otherwise(F.col("title"))
    return items.withColumn("title", title).select("provider", "external_id", _text())


@query(f"""{_PAGES} SELECT page_id, CASE WHEN page_id % 5 = 0 THEN 'ingested' WHEN error IS NULL THEN 'ingested' ELSE 'failed' END AS status, CASE WHEN page_id % 5 <> 0 THEN error END AS error,
CASE WHEN page_id % 5 <> 0 AND error IS NULL THEN {NOW} END AS ingested_at, CAST(page_id AS VARCHAR) AS ids FROM k""")
def i12_replayed_pages_of_all_services(spark, d):
    _, pages = Y.replayed(_nothing(spark), _archive(spark, d), NOW)
    return pages.select("page_id", "status", "error", "ingested_at", F.array_join("external_ids", ",").alias("ids"))


# the same as a stream of pages

@query(f"""{_DOCS}, w AS (SELECT page_id, provider, CASE WHEN k = 4 THEN 'connection' WHEN k = 5 THEN 'stories' WHEN k = 6 THEN 'comments' WHEN k = 8 THEN 'odd' ELSE 'items' END AS kind, page_id % 27 < 9 AS opens FROM k),
r AS (SELECT *, sum(opens::INT) OVER (PARTITION BY provider, kind ORDER BY page_id) AS run FROM w), a AS (SELECT *, first_value(1700000000000 + page_id * 1000) OVER (PARTITION BY provider, kind, run ORDER BY page_id) AS anchor FROM r)
SELECT i.provider, external_id, (anchor - row_number() OVER (PARTITION BY a.provider, kind, run ORDER BY i.page_id, CAST(replace(external_id, 'post:', '') AS BIGINT)) + 1)::BIGINT AS sort_key, text FROM i JOIN a USING (page_id)""")
def st1_st3_pages_parsed_and_merged(spark, d):
    pages = _archive(spark, d)
    path, folder = _folder(spark, "pages_arriving"), _folder(spark, "pages_merged")
    # batches in the order of their pages; what has arrived by then is one, in as many files as it has
    bounds = [0, *pages.approxQuantile("page_id", [0.4, 0.7], 0.01), float("inf")]
    for low, high in zip(bounds[:-1], bounds[1:], strict=True):
        pages.where((F.col("page_id") >= low) & (F.col("page_id") < high)).write.mode("append").parquet(path)
        items = G.merge_pages(spark.readStream.schema(pages.schema).parquet(path), _nothing(spark), NOW, folder)
    title = F.when(F.col("external_id").startswith("post:"), "").otherwise(F.col("title"))
    return items.withColumn("title", title).select("provider", "external_id", "sort_key", _text())
