"""Queries of phrase search, runs and their keys, streams, sources and embedding."""

from __future__ import annotations

from pyspark.sql import functions as F

from satchel import adapters as A
from satchel.functions import text as X
from satchel.operators import embedding as E
from satchel.operators import parsing as P
from satchel.operators import phrases as H
from satchel.operators import state as M
from satchel.operators import sync as I
from satchel.operators import textsearch as S
from satchel.operators import vectors as V
from satchel.plans import queries as Q
from satchel.plans.queries import NOW, query
from satchel.session import shared_folder
from satchel.sources.buckets import BucketTable, slots_for
from satchel.sources import tables as T
from satchel.streaming import merge as G

# phrases

_PLACES = rf"""pp AS (SELECT id, field, unnest(w) AS term, generate_subscripts(w, 1) - 1 AS place FROM (SELECT id, field, {Q._TOK} AS w FROM (
 SELECT id, 'title' AS field, title AS t FROM items UNION ALL SELECT id, 'summary', summary FROM items UNION ALL SELECT id, 'collection', concat('["', label, '"]') FROM items UNION ALL SELECT id, 'kind', kind FROM items)))"""

#: part, terms, column, last term may go on, opens the column, role in the whole
PARTS = [
    (0, 0, "of the", None, False, False, "all"), (0, 1, "topic en", "collection", False, False, "none"), (1, 0, "the", "title", False, True, "any"), (1, 1, "de la", "summary", False, False, "any"),
    (2, 0, "in th", None, True, False, "all"), (2, 1, "e", "kind", True, False, "all"), (3, 0, "und", "summary", False, False, "all"), (3, 1, "der", None, False, False, "none"),
]


def _parts(spark):
    kind = "query_id long, part int, text string, field string, prefix boolean, first boolean, role string"
    return spark.createDataFrame(PARTS, kind).withColumn("terms", F.split("text", " "))


def _phrase_sql(part) -> str:
    q, p, text, field, prefix, first, _ = part
    words = text.split()
    term = lambda k: f"starts_with(p{k}.term, '{words[k]}')" if prefix and k == len(words) - 1 else f"p{k}.term = '{words[k]}'"
    joins = "".join(f" JOIN pp p{k} ON p{k}.id = p0.id AND p{k}.field = p0.field AND p{k}.place = p0.place + {k} AND {term(k)}" for k in range(1, len(words)))
    return f"SELECT {q}::BIGINT AS query_id, {p} AS part, p0.id, count(*) AS uses FROM pp p0{joins} WHERE {term(0)}" + (f" AND p0.field = '{field}'" if field else "") + (" AND p0.place = 0" if first else "") + " GROUP BY p0.id"


_PHRASES = "ph AS (" + " UNION ALL ".join(map(_phrase_sql, PARTS)) + ")"


@query(f"WITH {_PLACES}, {_PHRASES} SELECT * FROM ph", "items")
def s5_s6_s7_phrases(spark, d):
    return H.phrase_hits(S.postings(A.items(spark, d)), _parts(spark))


@query(f"""WITH {_PLACES}, {_PHRASES} SELECT 0::BIGINT AS query_id, id FROM ph WHERE query_id = 0 AND part = 0 AND id NOT IN (SELECT id FROM ph WHERE query_id = 0 AND part = 1)
UNION ALL SELECT DISTINCT 1::BIGINT, id FROM ph WHERE query_id = 1 UNION ALL (SELECT 2::BIGINT, id FROM ph WHERE query_id = 2 AND part = 0 INTERSECT SELECT 2::BIGINT, id FROM ph WHERE query_id = 2 AND part = 1)
UNION ALL SELECT 3::BIGINT, id FROM ph WHERE query_id = 3 AND part = 0 AND id NOT IN (SELECT id FROM ph WHERE query_id = 3 AND part = 1)""", "items")
def s8_boolean(spark, d):
    parts = _parts(spark)
    return H.combine(H.phrase_hits(S.postings(A.items(spark, d)), parts), parts.select("query_id", "part", "role"))


@query(f"""WITH {_PLACES} SELECT DISTINCT g::BIGINT AS query_id, 0 AS part, a.id FROM pp a JOIN pp b ON a.id = b.id AND a.field = b.field AND a.place <> b.place, (VALUES (2), (10)) AS v(g)
WHERE a.term = 'the' AND b.term = 'and' AND abs(a.place - b.place) - 1 <= g""", "items")
def s9_near(spark, d):
    pairs = spark.createDataFrame([(2, 0, "the", "and", 2), (10, 0, "the", "and", 10)], "query_id long, part int, left string, right string, gap int")
    return H.near_hits(S.postings(A.items(spark, d)), pairs)


# runs

_RUNS = f"""WITH {Q._IDS}, run AS (SELECT *, sum(CASE WHEN page = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY provider, account, kind ORDER BY page_id) AS run FROM walks),
anc AS (SELECT *, first_value(fetched_at) OVER (PARTITION BY provider, account, kind, run ORDER BY page_id) AS anchor FROM run),
known AS (SELECT DISTINCT provider, external_id FROM arr WHERE list % 3 = 0),
f AS (SELECT a.*, anchor, page_id, run FROM arr a JOIN anc ON anc.walk = a.list AND anc.page_no = a.page AND anc.provider = a.provider ANTI JOIN known k ON k.provider = a.provider AND k.external_id = a.external_id),
n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY provider, external_id ORDER BY page_id, pos) AS r FROM f) WHERE r = 1)"""


@query(_RUNS.replace("f AS (SELECT a.*, anchor, page_id, run FROM arr a JOIN anc ON anc.walk = a.list AND anc.page_no = a.page AND anc.provider = a.provider ANTI JOIN known k ON k.provider = a.provider AND k.external_id = a.external_id)",
 "f AS (SELECT a.*, anchor, page_id, run FROM arr a JOIN anc ON anc.walk = a.list AND anc.page_no = a.page AND anc.provider = a.provider WHERE (a.provider, a.external_id) NOT IN (SELECT (provider, external_id) FROM known))")
 + " SELECT provider, external_id, (anchor - row_number() OVER (PARTITION BY provider, run ORDER BY page_id, pos) + 1)::BIGINT AS sort_key FROM n", "walks")
def m7_i8_pickup_keys(spark, d):
    w = I.open_runs(A.walks(spark, d).drop("body"))
    rows = Q._arrivals(spark, d).select("provider", F.col("list").alias("walk"), F.col("page").alias("page_no"), "pos", "external_id")
    arrivals = rows.join(w.select("provider", "account", "kind", "walk", "page_no", "page_id", "run", "anchor"), ["provider", "walk", "page_no"])
    return I.pickup_keys(arrivals, rows.where("walk % 3 = 0").select("provider", "external_id").distinct())


@query("""WITH st AS (SELECT provider, max(created_at) - 100000 AS synced_at FROM items WHERE provider <> 'src5' GROUP BY provider)
SELECT DISTINCT provider, external_id FROM (SELECT provider, external_id, created_at AS t FROM items UNION ALL SELECT provider, concat('a', id), created_at FROM items WHERE id % 4 = 0) JOIN st USING (provider) WHERE t <= synced_at""", "items")
def i1_known_for_run(spark, d):
    items = A.items(spark, d)
    state = items.where("provider <> 'src5'").groupBy("provider").agg((F.max("created_at") - 100000).alias("synced_at"))
    archive = items.where("id % 4 = 0").select("provider", F.col("created_at").alias("fetched_at"), F.array(F.concat(F.lit("a"), F.col("id").cast("string"))).alias("external_ids"))
    return I.known_for_run(items, archive, state)


@query("SELECT provider, CASE WHEN provider <> 'src5' THEN max(created_at) ELSE (SELECT min(sort_key) FROM items) - 1 END AS start FROM items GROUP BY provider", "items")
def i7_key_start(spark, d):
    items = A.items(spark, d)
    runs = items.groupBy("provider").agg(F.max("created_at").alias("started_at")).withColumn("synced_at", F.when(F.col("provider") != "src5", F.lit(1)))
    return I.key_start(runs, items, NOW)


_STATUS = "CASE WHEN walk % 3 = 0 THEN 'failed' WHEN walk % 3 = 1 THEN 'ok' ELSE 'partial' END"


@query(f"""WITH s AS (SELECT DISTINCT provider, 5 AS synced_at FROM walks), r AS (SELECT provider, max(fetched_at) AS last FROM walks WHERE {_STATUS} = 'ok' AND provider <> 'p2' GROUP BY provider)
SELECT provider, coalesce(last, synced_at) AS synced_at FROM s FULL JOIN r USING (provider)""", "walks")
def i10_watermarks(spark, d):
    w = A.walks(spark, d).select("provider", F.expr(_STATUS).alias("status"), F.col("fetched_at").alias("started_at"))
    return I.watermarks(w.select("provider", F.lit(5).cast("long").alias("synced_at")).distinct(), w.where("provider <> 'p2'"))


@query("""WITH p AS (SELECT walk, page_no, CASE WHEN page_no < 5 THEN concat('c', page_no) END AS cur, CASE WHEN walk % 7 = 0 AND page_no = 2 THEN 'e' END AS error, walk % 2 = 0 AS throttled, walk % 5 AS unseen FROM walks)
SELECT walk, CASE WHEN NOT bool_or(error IS NULL AND (unseen = 0 OR cur IS NULL)) AND NOT bool_or(error IS NOT NULL AND NOT throttled) THEN arg_max(cur, CASE WHEN error IS NULL THEN page_no END) END AS cursor FROM p GROUP BY walk""", "walks")
def i16_resume_points(spark, d):
    n = F.col("page_no")
    p = A.walks(spark, d).select("walk", n.alias("page"), F.when(n < 5, F.concat(F.lit("c"), n.cast("string"))).alias("cursor"), F.when((F.col("walk") % 7 == 0) & (n == 2), "e").alias("error"), (F.col("walk") % 2 == 0).alias("throttled"), (F.col("walk") % 5).alias("unseen"))
    return I.resume_points(p)


@query("SELECT (SELECT count(*) FROM items WHERE provider <> 'src0') AS items_left, (SELECT count(*) FROM walks WHERE status = 'pending' OR provider = 'p1') AS pending", "items", "walks")
def m13_reset_for_replay(spark, d):
    items, _ = I.reset_for_replay(A.items(spark, d), A.walks(spark, d), "src0")
    _, pages = I.reset_for_replay(A.items(spark, d), A.walks(spark, d), "p1")
    return items.agg(F.count(F.lit(1)).alias("items_left")).join(pages.where("status = 'pending'").agg(F.count(F.lit(1)).alias("pending")), F.lit(True))


@query("SELECT provider, count(*) AS pages FROM walks WHERE provider <> 'p1' GROUP BY provider", "walks")
def m12_clear_pages(spark, d):
    return I.clear_pages(A.walks(spark, d), "p1").groupBy("provider").agg(F.count(F.lit(1)).alias("pages"))


# sources and sinks

def _folder(spark, name):
    import uuid

    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query("SELECT page_id, provider, 'pending' AS status FROM walks WHERE status <> 'failed' UNION ALL SELECT page_id, provider, 'pending' FROM walks WHERE status = 'failed'", "walks")
def src1_i15_append_pages(spark, d):
    w, path = A.walks(spark, d), _folder(spark, "archive")
    T.append_pages(w.where("status <> 'failed'"), path)
    T.append_pages(w.where("status = 'failed'"), path)
    return spark.read.schema("page_id long, provider string, status string").parquet(path)


@query("SELECT count(*) AS n, count(embedding) AS vectors, sum(len(summary))::BIGINT AS chars FROM items", "items")
def src5_export(spark, d):
    path = _folder(spark, "export")
    T.export_items(A.items(spark, d), path)
    return spark.read.parquet(path).agg(F.count(F.lit(1)).alias("n"), F.count("embedding").alias("vectors"), F.sum(F.length("summary")).alias("chars"))


@query("SELECT vec_id AS id, len(embedding)::BIGINT AS dim, round(list_sum(embedding::DOUBLE[]), 6) AS total FROM embeddings")
def src7_vector_blobs(spark, d):
    e = A.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), T.vector_of_blob(T.blob_of_vector(F.col("embedding").cast("array<float>"))).alias("v"))
    return e.select("id", F.size("v").cast("long").alias("dim"), F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


@query("SELECT id, title, NULL::BIGINT AS starred_at, NULL::VARCHAR AS embedding_model FROM items", "items")
def src8_add_columns(spark, d):
    items = A.items(spark, d)
    old = items.drop("starred_at", "embedding_model", "embedding")
    return T.brought_up_to(T.brought_up_to(old, items.schema), items.schema).select("id", "title", "starred_at", "embedding_model")


# streams

def _page_stream(spark, d):
    """Arrivals of all conversations, a file at a time."""
    path = _folder(spark, "pages")
    rows = Q._arrivals(spark, d).select("provider", "list", "page", "pos", "external_id", F.timestamp_millis(F.lit(1_700_000_000_000) + F.col("list") * 1000).alias("at"))
    rows.repartition(4, "list").write.parquet(path)
    return rows.schema, spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)


@query(f"WITH {Q._IDS} SELECT provider, external_id, list, page FROM (SELECT *, row_number() OVER (PARTITION BY provider, external_id ORDER BY list, page, pos) AS n FROM arr) WHERE n = 1", "walks")
def st1_st3_merge_stream(spark, d):
    schema, stream = _page_stream(spark, d)
    start = spark.createDataFrame([], schema)
    merged = G.merge_stream(stream, lambda old, new: G.first_of(old, new, ["provider", "external_id"], ["list", "page", "pos"]), start, _folder(spark, "merged"))
    return merged.select("provider", "external_id", "list", "page")


@query(f"WITH {Q._IDS} SELECT DISTINCT provider, external_id FROM arr", "walks")
def st2_stream_without_repeats(spark, d):
    _, stream = _page_stream(spark, d)
    path = _folder(spark, "unique")
    out = G.without_repeats(stream, ["provider", "external_id"], "at", "10000 days").select("provider", "external_id")
    out.writeStream.format("parquet").option("path", path).option("checkpointLocation", f"{path}-log").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(path)


# the item table in buckets

_BY_BUCKET = [c for c in Q.UPSERTED if c != "sort_key"]


def _bucket_table(spark, d):
    items = A.items(spark, d).withColumn("bookmarked_at", F.lit(None).cast("long"))
    size = A.table(spark, d, "documents").agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return BucketTable(spark, _folder(spark, "buckets"), items.schema, slots_for(size, 16)).create(items)


@query(Q._UPSERT, "items", "state")
def m1_upsert_into_buckets(spark, d):
    table = _bucket_table(spark, d)
    table.merge(lambda old, new: M.upsert_slots(old, new, Q.NOW, Q.NOW), Q._batch(spark, d))
    return Q.upserted(table.read())


@query(f"SELECT {', '.join(_BY_BUCKET)} FROM ({Q._UPSERT})", "items", "state")
def st1_stream_into_buckets(spark, d):
    table, batch, path = _bucket_table(spark, d), Q._batch(spark, d), _folder(spark, "batches")
    log, bounds = _folder(spark, "log"), [float("-inf"), *batch.approxQuantile("seq", [0.4, 0.7], 0.01), float("inf")]
    # what has arrived by then is one batch, in as many files as it has
    for low, high in zip(bounds[:-1], bounds[1:], strict=True):
        batch.where((F.col("seq") >= low) & (F.col("seq") < high)).write.mode("append").parquet(path)
        G.merge_into(spark.readStream.schema(batch.schema).parquet(path), table, lambda old, new: M.upsert_slots(old, new, Q.NOW), log)
    return Q.upserted(table.read()).select(*_BY_BUCKET)


# embedding

_HASH = "list_reduce(list_prepend(0::BIGINT, list_transform(string_split(w, ''), lambda c: ascii(c)::BIGINT)), lambda h, c: (h * 31 + c) % 4294967296) % 64"


@query(rf"""WITH w AS (SELECT id, unnest(regexp_extract_all(lower(title), '[a-z0-9_]+')) AS w FROM items), b AS (SELECT id, {_HASH} AS bucket, count(*) AS n FROM w GROUP BY ALL),
x AS (SELECT id, bucket, n FROM b UNION ALL SELECT id, 0, 1 FROM items WHERE id NOT IN (SELECT id FROM w))
SELECT id, bucket::BIGINT AS bucket, round((n / sqrt(sum(n * n) OVER (PARTITION BY id)))::FLOAT::DOUBLE, 5) AS value FROM x""", "items")
def e2_token_hash(spark, d):
    v = E.embedded(A.items(spark, d).select("id", F.col("title").alias("text")), "token-hash")
    return v.select("id", F.posexplode("vector").alias("bucket", "value")).where("value <> 0").select("id", F.col("bucket").cast("long").alias("bucket"), F.round(F.col("value").cast("double"), 5).alias("value"))


@query(rf"""WITH w AS (SELECT id, unnest(regexp_extract_all(lower(summary), '[a-z0-9_]+')) AS w FROM items), b AS (SELECT id, {_HASH} AS bucket, count(*) AS n FROM w GROUP BY ALL),
x AS (SELECT id, bucket, n FROM b UNION ALL SELECT id, 0, 1 FROM items WHERE id NOT IN (SELECT id FROM w))
SELECT id, bucket::BIGINT AS bucket, round((n / sqrt(sum(n * n) OVER (PARTITION BY id)))::FLOAT::DOUBLE, 5) AS value FROM x""", "items")
def e2_token_hash_rows(spark, d):
    v = E.embedded(A.items(spark, d).select("id", F.col("summary").alias("text")), "token-hash")
    return v.select("id", F.posexplode("vector").alias("bucket", "value")).where("value <> 0").select("id", F.col("bucket").cast("long").alias("bucket"), F.round(F.col("value").cast("double"), 5).alias("value"))


@query("SELECT count(*) AS total, count(*) FILTER (deleted_at IS NULL) AS embedded FROM items", "items")
def e3_embed_backlog(spark, d):
    done = E.embed_backlog(A.items(spark, d), Q.row_text, "token-hash")
    return done.agg(F.count(F.lit(1)).alias("total"), F.count_if((F.col("embedding_model") == "token-hash") & (F.size("embedding") == 64)).alias("embedded"))


@query("SELECT count(*) AS total, count(*) FILTER (deleted_at IS NULL) AS embedded FROM items", "items")
def e3_embed_in_slices(spark, d):
    done = E.embed_in_slices(A.items(spark, d), Q.row_text, "token-hash", _folder(spark, "vectors"), 3)
    return done.agg(F.count(F.lit(1)).alias("total"), F.count_if((F.col("embedding_model") == "token-hash") & (F.size("embedding") == 64)).alias("embedded"))


@query("SELECT id, concat('Represent this sentence for searching relevant passages: ', title) AS text FROM items WHERE title <> ''", "items")
def e4_query_text(spark, d):
    return A.items(spark, d).where("title <> ''").select("id", E.query_text(F.col("title"), Q.MODEL).alias("text"))


@query(Q._SEMANTIC.replace("id % 50 = 0 AND ", "").join(["WITH ", " SELECT query_id, id, similarity, rank FROM r WHERE rank <= 20 AND similarity >= least(top, greatest(lo, least(hi, f * top)))"]), "items")
def v6_all_neighbours(spark, d):
    items = A.items(spark, d)
    return V.similar(items, items.where("embedding IS NOT NULL AND embedding_model IS NOT NULL").select("id")).select("query_id", "id", "similarity", "rank")


@query("""WITH s AS (SELECT vec_id AS sid, embedding::DOUBLE[] AS sv FROM embeddings ORDER BY vec_id * 7919 % 100003, vec_id LIMIT 200),
c AS (SELECT vec_id, round(list_dot_product(embedding::DOUBLE[], sv), 6) AS c FROM embeddings, s WHERE vec_id <> sid)
SELECT count(*) AS n, round(avg(m), 5) AS mean_similarity, round(avg(x), 5) AS mean_of_max FROM (SELECT vec_id, avg(c) AS m, max(c) AS x FROM c GROUP BY vec_id)""")
def q4_random_pairs(spark, d):
    e = A.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return V.random_pairs(e, e.orderBy(F.col("id") * 7919 % 100003, "id").limit(200))


@query("""WITH t AS (SELECT q.vec_id AS query_id, round(list_dot_product(q.embedding::DOUBLE[], i.embedding::DOUBLE[]), 6) AS c, i.vec_id AS id FROM embeddings q JOIN embeddings i ON i.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY c DESC, id) AS rank FROM t) SELECT query_id, rank, c AS similarity FROM r WHERE id = query_id + 1""")
def q5_target_rank(spark, d):
    e = A.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), F.lit("m").alias("model"))
    q = e.where("id % 50 = 0").select(F.col("id").alias("query_id"), "vector", "model", F.col("id").alias("exclude"), F.lit(-2.0).alias("min_score"))
    return V.target_ranks(e, q, q.select("query_id", (F.col("query_id") + 1).alias("id"))).select("query_id", "rank", "similarity")


# text expressions

@query("SELECT page_id, concat('https://n/up?p=', page_id, '&k=1') AS next FROM pages WHERE page_id % 3 = 0 UNION ALL SELECT page_id, concat('https://n/x/rel', page_id) FROM pages WHERE page_id % 3 = 1 UNION ALL SELECT page_id, NULL FROM pages WHERE page_id % 3 = 2")
def p4_next_page(spark, d):
    k, n = F.col("page_id") % 3, F.col("page_id").cast("string")
    link = F.when(k == 0, F.concat(F.lit("<a href='/up?p="), n, F.lit("&amp;k=1' class='morelink' rel=next>"))).when(k == 1, F.concat(F.lit('<a href="rel'), n, F.lit('" class="morelink">'))).otherwise("<a href='x'>")
    return A.table(spark, d, "pages").select("page_id", P.next_page(F.concat(F.col("html"), link), F.lit("https://n/x/y?z=1")).alias("next"))


@query("""SELECT seq, CASE seq % 3 WHEN 0 THEN NULL WHEN 1 THEN concat(seq, ' views') END AS views, CASE seq % 3 WHEN 1 THEN '2 years ago · live' END AS age, CASE seq % 3 WHEN 2 THEN concat('info ', seq) END AS info FROM state""", "state")
def x7_split_stats(spark, d):
    k, n = F.col("seq") % 3, F.col("seq").cast("string")
    line = F.when(k == 1, F.concat(n, F.lit(" views • 2 years ago · live"))).when(k == 2, F.concat(F.lit(" info "), n, F.lit(" · ")))
    s = A.state(spark, d).select("seq", X.split_stats(line).alias("s"))
    return s.select("seq", *(F.col("s")[c].alias(c) for c in ("views", "age", "info")))


@query("SELECT seq, CASE seq % 3 WHEN 0 THEN at_ms WHEN 1 THEN 1783344537000 ELSE 0 END AS ms FROM state", "state")
def x11_date_ms(spark, d):
    k = F.col("seq") % 3
    return A.state(spark, d).select("seq", P.date_ms(F.when(k == 0, F.col("at_ms").cast("string")).when(k == 1, "2026-07-06T13:28:57.000Z").otherwise("soon")).alias("ms"))
