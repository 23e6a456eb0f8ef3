"""Queries of replay, video pages, row-state parts, label retrieval and display lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from satchel import adapters as A
from satchel.functions import meta as L
from satchel.functions import text as X
from satchel.functions import trees as W
from satchel.operators import embedding as E
from satchel.operators import parsing as P
from satchel.operators import replay as Y
from satchel.operators import state as M
from satchel.operators import vectors as V
from satchel.operators import videos as D
from satchel.plans import queries as Q
from satchel.plans.archive_queries import _folder
from satchel.plans.queries import NOW, query
from satchel.streaming import merge as G

# replay

_ITEM = "id long, provider string, account string, external_id string, url string, title string, publication string, summary string, bookmarked_at long, collection array<string>, created_at long, sort_key long, deleted_at long, starred_at long, embedding array<float>, embedding_model string"


def _archive(spark, d):
    """Pages of ten documents each in one service's shape; every thirteenth is broken, every
    fifth was read before."""
    i, n = F.col("doc_id"), F.col("page_id")
    media = F.struct(F.when(i % 9 != 0, i).alias("pk"), F.struct(F.col("short").alias("text")).alias("caption"))
    pages = Q._bodies(spark, d, F.struct(media.alias("media")), whole=True)
    return pages.select(
        "page_id", F.lit("instagram").alias("provider"), F.lit("u").alias("account"), F.lit("items").alias("kind"), (n % 3).cast("int").alias("page"), (n * 1000 + 1700000000000).alias("fetched_at"),
        F.when(n % 5 == 0, "ingested").when(n % 7 == 0, "failed").otherwise("pending").alias("status"), F.when(n % 13 == 0, "{broken").otherwise(F.col("body")).alias("body"), "context",
    )


def _stored(spark, d):
    """Every fourth document is an item already."""
    docs = A.table(spark, d, "documents").where("doc_id % 4 = 0").select(F.col("doc_id").alias("sort_key"))
    given = {"provider": F.lit("instagram"), "account": F.lit("u"), "external_id": F.col("sort_key").cast("string"), "sort_key": F.col("sort_key"), "created_at": F.lit(1), "title": F.lit(""), "publication": F.lit(""), "summary": F.lit(""), "url": F.lit("")}
    return docs.select(*(given.get(c, F.lit(None)).cast(t).alias(c) for c, t in (x.split(" ") for x in _ITEM.split(", "))))


_READ = "doc_id % 9 <> 0 AND (doc_id // 10) % 13 <> 0"


@query(f"""WITH r AS (SELECT * FROM (SELECT DISTINCT doc_id // 10 AS page_id FROM documents) WHERE page_id % 5 <> 0), w AS (SELECT doc_id FROM documents WHERE {_READ} AND (doc_id // 10) % 5 <> 0)
SELECT 'instagram' AS provider, (SELECT count(*) FROM r) AS pages, (SELECT count(*) FROM r WHERE page_id % 13 = 0) AS failed, count(*) AS rows, count(*) FILTER (doc_id % 4 <> 0) AS inserted, count(*) FILTER (doc_id % 4 = 0) AS updated FROM w
UNION ALL SELECT NULL, (SELECT count(*) FROM r), (SELECT count(*) FROM r WHERE page_id % 13 = 0), count(*), count(*) FILTER (doc_id % 4 <> 0), count(*) FILTER (doc_id % 4 = 0) FROM w""")
def i11_i17_replay_report(spark, d):
    return Y.summed(Y.report(_stored(spark, d), _archive(spark, d)), ["instagram", "other"])


_KEYS = """WITH pg AS (SELECT DISTINCT doc_id // 10 AS page_id FROM documents), c AS (SELECT page_id, 1700000000000 + page_id * 1000 AS fetched_at, sum(CASE WHEN page_id % 3 = 0 THEN 1 ELSE 0 END) OVER (ORDER BY page_id) AS run FROM pg WHERE {pages}),
a AS (SELECT *, first_value(fetched_at) OVER (PARTITION BY run ORDER BY page_id) AS anchor FROM c),
n AS (SELECT doc_id, (anchor - row_number() OVER (PARTITION BY run ORDER BY doc_id) + 1)::BIGINT AS sort_key FROM documents d JOIN a ON a.page_id = d.doc_id // 10 WHERE {read} AND doc_id % 4 <> 0)
SELECT CAST(doc_id AS VARCHAR) AS external_id, sort_key FROM n UNION ALL SELECT CAST(doc_id AS VARCHAR), doc_id FROM documents WHERE doc_id % 4 = 0"""


@query(_KEYS.format(pages="page_id % 5 <> 0", read=_READ))
def i12_replay_items(spark, d):
    return Y.replayed(_stored(spark, d), _archive(spark, d), NOW)[0].select("external_id", "sort_key")


@query(_KEYS.format(pages="true", read=_READ))
def i13_replay_everything(spark, d):
    return Y.replayed(_stored(spark, d), _archive(spark, d), NOW, everything=True)[0].select("external_id", "sort_key")


@query("""SELECT page_id, CASE WHEN page_id % 5 = 0 THEN 'ingested' WHEN page_id % 13 = 0 THEN 'failed' ELSE 'ingested' END AS status, CASE WHEN page_id % 5 <> 0 AND page_id % 13 = 0 THEN 'body is not JSON' END AS error FROM (SELECT DISTINCT doc_id // 10 AS page_id FROM documents)""")
def i12_replay_pages(spark, d):
    return Y.replayed(_stored(spark, d), _archive(spark, d), NOW)[1].select("page_id", "status", "error")


@query("SELECT count(*) AS total, count(*) AS embedded FROM documents")
def st4_embed_after_merge(spark, d):
    rows = A.items(spark, d).select("id", "title", "publication", "summary", "url", "provider", "collection", F.lit(None).cast("long").alias("deleted_at"), F.lit(None).cast("array<float>").alias("embedding"), F.lit(None).cast("string").alias("embedding_model"))
    path, folder = _folder(spark, "arriving"), _folder(spark, "embedded")
    step = G.followed_by(lambda old, new: G.first_of(old, new, ["id"], ["id"]), lambda table: E.embed_backlog(table, Q.row_text, "token-hash"))
    # what has arrived by then is one batch, in as many files as it has
    for k in range(2):
        rows.where(F.pmod(F.xxhash64("id"), F.lit(2)) == k).write.mode("append").parquet(path)
        stream = spark.readStream.schema(rows.schema).parquet(path)
        done = G.merge_stream(stream, step, spark.createDataFrame([], rows.schema), folder)
    return done.agg(F.count(F.lit(1)).alias("total"), F.count_if((F.col("embedding_model") == "token-hash") & (F.size("embedding") == 64)).alias("embedded"))


# video pages

def _video_pages(spark, d, whole=False):
    i, s = F.col("doc_id"), F.col("doc_id").cast("string")
    node = lambda c: F.struct(c.alias("simpleText"))
    runs = lambda *c: F.struct(F.array(*(F.struct(x.alias("text")) for x in c)).alias("runs"))
    row = F.struct(
        F.concat(F.lit("v"), s).alias("videoId"), F.when(i % 9 == 0, False).alias("isPlayable"), node(F.concat(F.lit("t "), F.col("short" if whole else "source"))).alias("title"), runs(F.lit("by "), F.col("lang")).alias("shortBylineText"),
        runs(s, F.lit(" views"), F.lit(" • "), F.lit("2 days ago")).alias("videoInfo"), (i % 500).cast("string").alias("lengthSeconds"),
        F.when(i % 4 == 0, F.array(F.struct(F.struct(F.lit("SHORTS").alias("style")).alias("thumbnailOverlayTimeStatusRenderer")))).alias("thumbnailOverlays"),
    )
    menu = F.concat(F.lit('{"playlistVideoRenderer":'), F.to_json(row), F.lit(',"menu":{"contents":[{"playlistVideoRenderer":{"videoId":"copy"}}]}}'))
    more = '{"continuationItemRenderer":{"continuationEndpoint":{"continuationCommand":{"token":"next"}}}}'
    other = '{"itemSectionRenderer":{"header":{"itemSectionHeaderRenderer":{"titleStyle":"X_RECOMMENDATIONS"}},"contents":[{"playlistVideoRenderer":{"videoId":"suggested"}}]}},{"continuationItemRenderer":{"continuationEndpoint":{"continuationCommand":{"token":"never"}}}}'
    wrap = lambda a: F.concat(F.lit('{"tabs":[{"sections":{"contents":[{"playlistVideoListRenderer":{"contents":['), F.array_join(a, ","), F.when(F.col("page_id") % 2 == 0, "," + more).otherwise(""), F.lit("]}}," + other + "]}}]}"))
    pages = Q._bodies(spark, d, menu, wrap=wrap, whole=whole)
    return pages.withColumn("context", F.lit('{"collection":"List"}')).withColumn("fetched_at", F.lit(1_700_000_000_000))


@query("""SELECT doc_id // 10 AS page_id, concat('v', doc_id) AS external_id, concat('t ', source) AS title, concat('by ', lang) AS poster_name, concat(doc_id, ' views') AS views, CASE WHEN doc_id % 4 = 0 THEN 'short' ELSE 'video' END AS kind,
concat('https://www.youtube.com/', CASE WHEN doc_id % 4 = 0 THEN 'shorts/v' ELSE 'watch?v=v' END, doc_id) AS url, (doc_id % 500)::BIGINT AS duration, 'List' AS collection, 1699747200000 AS published_at FROM documents WHERE doc_id % 9 <> 0""")
def p8_videos(spark, d, whole=False):
    out = D.youtube(_video_pages(spark, d, whole))
    return out.select("page_id", "external_id", "title", "poster_name", F.col("stats")["views"].alias("views"), "kind", "url", "duration", F.array_join("collection", ",").alias("collection"), "published_at")


Q.whole_texts(p8_videos, ("concat('t ', source)", "concat('t ', text)"))


@query("SELECT DISTINCT doc_id // 10 AS page_id, CASE WHEN (doc_id // 10) % 2 = 0 THEN 'next' END AS cursor, (doc_id // 10) % 2 = 0 AS has_next FROM documents")
def p9_continuation(spark, d):
    return D.cursors(_video_pages(spark, d))


@query("""SELECT doc_id // 10 AS page_id, concat('p', doc_id) AS id, CASE WHEN doc_id % 2 = 0 THEN concat('lockup ', source) ELSE concat('p', doc_id) END AS title FROM documents UNION ALL SELECT DISTINCT doc_id // 10, 'WL', 'Watch later' FROM documents""")
def p10_playlists(spark, d):
    s = F.col("doc_id").cast("string")
    grid = F.concat(F.lit('{"gridPlaylistRenderer":{"playlistId":"p'), s, F.lit('"}}'))
    lockup = F.concat(F.lit(',{"x":{"lockupViewModel":{"contentId":"p'), s, F.lit('","contentType":"LOCKUP_CONTENT_TYPE_PLAYLIST","metadata":{"lockupMetadataViewModel":{"title":{"content":"lockup '), F.col("source"), F.lit('"}}}}}}'))
    entry = F.concat(grid, F.when(F.col("doc_id") % 2 == 0, lockup).otherwise(""))
    wrap = lambda a: F.concat(F.lit('{"a":['), F.array_join(a, ","), F.lit(',{"gridPlaylistRenderer":{"playlistId":"LL"}}]}'))
    pages = Q._bodies(spark, d, entry, wrap=wrap)
    return D.offered(D.playlists(pages), pages)


@query("SELECT doc_id AS id, CASE WHEN doc_id % 3 = 0 THEN '' ELSE concat('https://m/', doc_id, '/b') END AS url FROM documents")
def p12_nested_image(spark, d):
    s = F.col("doc_id").cast("string")
    image = F.concat(F.lit('{"attributes":[{"none":null},{"detail":{"vectorImage":{"rootUrl":"https://m/'), s, F.lit('/","artifacts":[{"width":800,"fileIdentifyingUrlPathSegment":"a"},{"width":110,"fileIdentifyingUrlPathSegment":"b"},{"width":90,"fileIdentifyingUrlPathSegment":"c"}]}}}]}'))
    return A.table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.coalesce(W.image_url(F.when(F.col("doc_id") % 3 != 0, image)), F.lit("")).alias("url"))


# parts of the merge

@query(f"WITH {Q._BATCH} SELECT seq, title, duration, bookmarked_at FROM batch", "state")
def m3_blank_values(spark, d):
    return M.coerced(Q._batch(spark, d)).select("seq", "title", "duration", "bookmarked_at")


@query(f"WITH {Q._BATCH} SELECT provider, account, external_id, arg_max(bookmarked_at, seq) FILTER (bookmarked_at IS NOT NULL) AS bookmarked_at FROM batch GROUP BY ALL", "state")
def m4_last_times(spark, d):
    return M.collapse(Q._batch(spark, d)).select("provider", "account", "external_id", "bookmarked_at")


@query(f"""WITH {Q._BATCH}, n AS (SELECT provider, account, external_id, seq, p, collection[p] AS x FROM (SELECT *, unnest([1, 2]) AS p FROM batch) WHERE collection[p] IS NOT NULL),
f AS (SELECT provider, account, external_id, arg_min(x, (seq, p)) AS x, min((seq, p)) AS place FROM n GROUP BY provider, account, external_id, lower(x))
SELECT provider, account, external_id, string_agg(x, '|' ORDER BY place) AS collection FROM f GROUP BY ALL""", "state")
def m5_united_names(spark, d):
    return M.collapse(Q._batch(spark, d)).select("provider", "account", "external_id", F.array_join(M.union_names(F.col("incoming")), "|").alias("collection"))


@query(f"SELECT provider, account, external_id, embedding_model FROM ({Q._UPSERT})", "items", "state")
def m6_kept_vectors(spark, d):
    out = M.upsert(A.items(spark, d), Q._batch(spark, d), NOW, NOW)
    return out.select("provider", "account", "external_id", "embedding_model")


# retrieval by label

@query("""WITH e AS (SELECT vec_id AS id, label, embedding::DOUBLE[] AS v FROM embeddings), q AS (SELECT label, min(id) AS qid, arg_min(v, id) AS qv FROM e WHERE label IS NOT NULL GROUP BY label),
r AS (SELECT q.label, e.label AS own, row_number() OVER (PARTITION BY q.label ORDER BY round(list_dot_product(qv, v), 6) DESC, id) AS rank FROM q JOIN e ON e.id <> qid)
SELECT label, count(*) AS labelled, median(rank)::DOUBLE AS median_rank, count(*) FILTER (rank <= 50) AS in_50, count(*) FILTER (rank <= 200) AS in_200 FROM r WHERE own = label GROUP BY label""")
def q2_label_retrieval(spark, d):
    e = A.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label", F.col("embedding").alias("vector"))
    asked = e.where("label IS NOT NULL").groupBy("label").agg(F.min_by(F.struct("id", "vector"), "id").alias("q")).select("label", "q.*")
    return V.label_ranks(e, asked)


# display and text

@query("""WITH m AS (SELECT id, CASE id % 3 WHEN 0 THEN 'youtube' WHEN 1 THEN 'hackernews' ELSE 'instagram' END AS p, CASE WHEN id % 2 = 0 THEN 'short' ELSE 'story' END AS kind, duration, label, id % 5 = 1 AS counted, CASE WHEN id % 7 = 0 THEN created_at ELSE 0 END AS b, 1749999999999 - (id % 14) * 86400000 AS made FROM items)
SELECT id, concat_ws(' · ', 'L', CASE WHEN kind = 'short' THEN 'Short' END,
 CASE WHEN duration >= 3600 THEN concat(duration // 3600, ':', lpad((duration % 3600 // 60)::VARCHAR, 2, '0'), ':', lpad((duration % 60)::VARCHAR, 2, '0')) WHEN duration > 0 THEN concat(duration // 60, ':', lpad((duration % 60)::VARCHAR, 2, '0')) END,
 '7 views', CASE WHEN p = 'youtube' AND b = 0 THEN NULL ELSE 'old' END, CASE WHEN p = 'hackernews' AND kind = 'story' AND counted THEN '1,204 points · 7 comments' END, CASE WHEN p <> 'hackernews' THEN label END,
 CASE WHEN b <> 0 THEN strftime(make_timestamp(b * 1000), '%b %-d, %Y') WHEN p = 'youtube' THEN concat('about ', CASE WHEN id % 14 = 0 THEN 'today' ELSE concat(id % 14, ' day', CASE WHEN id % 14 = 1 THEN '' ELSE 's' END, ' ago') END) ELSE strftime(make_timestamp(made * 1000), '%b %-d, %Y') END) AS text FROM m""", "items")
def f7_meta_line(spark, d):
    i = F.col("id")
    provider = F.when(i % 3 == 0, "youtube").when(i % 3 == 1, "hackernews").otherwise("instagram")
    stats = F.create_map(F.lit("views"), F.lit("7 views"), F.lit("age"), F.lit("old"))
    line = L.meta_line(F.lit("L"), provider, F.when(i % 2 == 0, "short").otherwise("story"), F.col("duration"), stats, F.col("collection"), F.when(i % 5 == 1, "1,204 points · 7 comments").otherwise("x"), F.when(i % 7 == 0, F.col("created_at")).otherwise(0), 1749999999999 - i % 14 * 86_400_000, F.lit(1750000000000))
    return A.items(spark, d).select("id", line.alias("text"))


@query("""SELECT doc_id AS id, concat(source, '<', lang, '&nbsp;AB€😀&#60;') AS text FROM documents""")
def x1_entities(spark, d):
    coded = F.concat("source", F.lit("&lt;"), "lang", F.lit("&nbsp;&#65;&#x42;&#8364;&#X1f600;&#38;#60;"))
    return A.table(spark, d, "documents").select(F.col("doc_id").alias("id"), X.decode_entities(coded).alias("text"))


@query("SELECT seq, CASE seq % 3 WHEN 0 THEN (at_ms // 1000) * 1000 WHEN 1 THEN 1783344537000 ELSE 0 END AS ms FROM state", "state")
def x3_age(spark, d):
    k = F.col("seq") % 3
    span = lambda t: F.concat(F.lit('<span class="age" title="'), t, F.lit('">1 day ago</span>'))
    chunk = F.when(k == 0, span(F.concat(F.lit("2026-07-06T13:28:57 "), F.floor(F.col("at_ms") / 1000).cast("string")))).when(k == 1, span(F.lit("2026-07-06T13:28:57"))).otherwise(span(F.lit("soon")))
    return A.state(spark, d).select("seq", P.age_ms(chunk).alias("ms"))


@query("SELECT doc_id AS id, CASE WHEN doc_id % 50 < 20 THEN concat('wide', doc_id) ELSE concat('first', doc_id) END AS url FROM documents")
def x5_nearest_image(spark, d):
    w, s = (F.col("doc_id") % 50).cast("int"), F.col("doc_id").cast("string")
    image = lambda width, name: F.struct(width.cast("int").alias("width"), F.concat(F.lit(name), s).alias("url"))
    images = F.array(image(F.lit(None), "none"), image(F.lit(80), "first"), image(100 + w, "wide"), image(F.lit(120), "tie"))
    return A.table(spark, d, "documents").select(F.col("doc_id").alias("id"), X.nearest_image(images).alias("url"))


@query("SELECT doc_id AS id, CASE doc_id % 4 WHEN 0 THEN source WHEN 1 THEN concat(source, lang) WHEN 2 THEN lang ELSE '' END AS text FROM documents")
def x6_node_text(spark, d):
    k = F.col("doc_id") % 4
    runs = F.when(k == 1, F.array(F.struct(F.col("source").alias("text")), F.struct(F.lit(None).cast("string").alias("text")), F.struct(F.col("lang").alias("text"))))
    node = F.struct(F.when(k == 0, F.col("source")).alias("simpleText"), runs.alias("runs"), F.when(k == 2, F.col("lang")).alias("content"))
    return A.table(spark, d, "documents").select(F.col("doc_id").alias("id"), D.node_text(node).alias("text"))


@query("SELECT doc_id AS id, concat('see https://long/', doc_id, ' and ', source) AS text FROM documents")
def x9_expand_links(spark, d):
    s = F.col("doc_id").cast("string")
    urls = F.array(F.struct(F.concat(F.lit("https://t.co/"), s).alias("url"), F.concat(F.lit("https://long/"), s).alias("expanded_url")))
    text = F.concat(F.lit("see https://t.co/"), s, F.lit(" and "), F.col("source"), F.lit(" https://t.co/zz https://t.co/yy"))
    return A.table(spark, d, "documents").select(F.col("doc_id").alias("id"), X.expand_links(text, urls).alias("text"))
