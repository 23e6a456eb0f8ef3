"""Queries of stored postings, routing, the backlog's batches, snapshots' shapes and ad-hoc SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from satchel import adapters as A
from satchel.operators import listing as L
from satchel.operators import snapshots as D
from satchel.operators import textsearch as S
from satchel.plans import queries as Q
from satchel.plans.archive_queries import _folder
from satchel.plans.queries import MODEL, query
from satchel.sources import tables as T
from satchel.sources.searchindex import SearchIndex

# search

_OPERATORS = r"""regexp_matches(t, '["():*^]') OR regexp_matches(t, '(^|[^A-Za-z0-9_])(AND|OR|NOT|NEAR)($|[^A-Za-z0-9_])') OR regexp_matches(t, '\S:')"""
_PLAINED = "regexp_replace(summary, '[^\\x00-\\x7F]', '-', 'g')"


@query(f"SELECT id AS query_id, ({_OPERATORS}) AS operators FROM (SELECT id, {_PLAINED} AS t FROM items)", "items")
def s3_operator_syntax(spark, d):
    q = A.items(spark, d).select(F.col("id").alias("query_id"), F.regexp_replace("summary", r"[^\x00-\x7F]", "-").alias("query"))
    return S.query_flags(q).select("query_id", "operators")


@query(f"WITH {Q._TEXT_SEARCH} SELECT query_id::BIGINT AS query_id, id, rank, score FROM fts WHERE rank <= 200", "items")
def s10_stored_postings(spark, d):
    items, path = A.items(spark, d), _folder(spark, "postings")
    S.postings(items).write.parquet(path)
    return S.search(items, Q.asked(spark), index=spark.read.parquet(path))


#: A query for every fiftieth row: the two longest plain words of its own text, flagged for
#: every hundredth.
_LONGEST = """list_sort(list_transform(list_distinct(list_filter(string_split_regex(summary, '\\s+'), lambda w: regexp_full_match(w, '[a-z]+'))), lambda w: struct_pack(n := -len(w), w := w)))"""
_ROWS_Q = f"""qs(query_id, query) AS (SELECT id, concat(CASE WHEN id % 100 = 0 THEN 'is:starred ' ELSE '' END, l[1].w, ' ', l[2].w) FROM (SELECT id, {_LONGEST} AS l FROM items WHERE id % 50 = 0) WHERE len(l) > 1)"""


def rows_as_queries(items, every=50):
    words = F.array_distinct(F.filter(F.split("summary", r"\s+"), lambda w: w.rlike("^[a-z]+$")))
    best = F.array_sort(F.transform(words, lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w"))))
    q = items.where(F.col("id") % every == 0).select(F.col("id").alias("query_id"), best.alias("l")).where(F.size("l") > 1)
    return q.select("query_id", F.concat(F.when(F.col("query_id") % 100 == 0, "is:starred ").otherwise(""), F.get("l", F.lit(0))["w"], F.lit(" "), F.get("l", F.lit(1))["w"]).alias("query"))


@query(f"WITH {Q._TEXT_SEARCH.replace(Q._Q, _ROWS_Q)} SELECT query_id::BIGINT AS query_id, id, rank, score FROM fts WHERE rank <= 200", "items")
def s2_every_fiftieth_row(spark, d):
    items = A.items(spark, d)
    return S.search(items, rows_as_queries(items))


def _followed(spark, d):
    """An index that followed the item table: old texts, changes, rows that came and went."""
    items = A.items(spark, d)
    k, index = F.col("id") % 8, SearchIndex(spark, _folder(spark, "index"), 64)
    old = items.where(k < 4).withColumn("summary", F.when(k == 1, F.concat(F.lit("former words "), F.substring("summary", 1, 99))).otherwise(F.col("summary")))
    passing = items.where(k == 2).withColumn("id", -F.col("id") - 1)
    index.add(old.unionByName(passing))
    index.add(items.where((k == 1) | (k == 4)), passing.where("id % 3 = 0").select("id"))
    index.add(items.where(k == 5).unionByName(passing.where("id % 3 = 0").withColumn("title", F.lit("again"))))
    return items, index.add(items.where(k > 5), passing.select("id"))


@query(Q.SQL["s1_postings"])
def s1_segments(spark, d):
    return _followed(spark, d)[1].postings().groupBy("field", "term").agg(F.count(F.lit(1)).alias("rows_"), F.sum(F.size("places")).alias("uses"))


@query(f"WITH {Q._TEXT_SEARCH.replace(Q._Q, _ROWS_Q)} SELECT query_id::BIGINT AS query_id, id, rank, score FROM fts WHERE rank <= 5", "items")
def s10_top_by_blocks(spark, d):
    items, index = _followed(spark, d)
    return index.search(items, rows_as_queries(items), 5)


# typed queries: a phrase, a prefix, a column, a word of two tokens, AND, OR, NOT, columns with a
# phrase that goes on, an unknown column, a start mark, a column beside a plain word

_PAIR = """list_filter(range(1, len(ws)), lambda i: regexp_full_match(ws[i], '[a-z]+') AND regexp_full_match(ws[i + 1], '[a-z]+'))"""
_FORMS = ["concat('\"', a, ' ', b, '\"')", "concat(substr(a, 1, 3), '*')", "concat('title:', a)", "concat(a, '-', b)", "concat(a, ' AND ', l)", "concat(a, ' OR ', l)", "concat(l, ' NOT ', a)", "concat('{title summary} : \"', a, ' ', b, '\"*')", "concat('nosuch:', a)", "concat('^', a)", "concat('Kind:', kind, ' ', l)"]
_PART_SQL = lambda c, part, terms, role="all", fields="NULL", prefix="false", first="false": f"SELECT id AS query_id, {part} AS part, '{role}' AS role, {terms} AS terms, {fields}::VARCHAR[] AS fields, {prefix} AS prefix, {first} AS first FROM base WHERE c = {c}"
_PARTS_SQL = " UNION ALL ".join([
    _PART_SQL(0, 0, "[a, b]"), _PART_SQL(1, 0, "[substr(a, 1, 3)]", prefix="true"), _PART_SQL(2, 0, "[a]", fields="['title']"), _PART_SQL(3, 0, "[a, b]", prefix="true"),
    _PART_SQL(4, 0, "[a]"), _PART_SQL(4, 1, "[l]"), _PART_SQL(5, 0, "[a]", "any"), _PART_SQL(5, 1, "[l]", "any"), _PART_SQL(6, 0, "[l]"), _PART_SQL(6, 1, "[a]", "none"),
    _PART_SQL(7, 0, "[a, b]", fields="['title', 'summary']", prefix="true"), _PART_SQL(9, 0, "[a]", first="true"), _PART_SQL(10, 0, "[kind]", fields="['kind']"), _PART_SQL(10, 1, "[l]"),
])
_TYPED = rf"""WITH w AS (SELECT id, kind, string_split_regex(summary, '\s+') AS ws, {_LONGEST} AS longest FROM items WHERE id % 50 = 0),
base AS (SELECT id, kind, (id // 50) % 11 AS c, ws[p[len(p) // 2 + 1]] AS a, ws[p[len(p) // 2 + 1] + 1] AS b, longest[1].w AS l FROM (SELECT *, {_PAIR} AS p FROM w) WHERE len(p) > 0),
parts AS ({_PARTS_SQL}),
tl AS (SELECT id, field, {Q._TOK} AS toks FROM (SELECT id, 'title' AS field, title AS t FROM items UNION ALL SELECT id, 'summary', summary FROM items UNION ALL SELECT id, 'collection', concat('["', label, '"]') FROM items UNION ALL SELECT id, 'kind', kind FROM items)),
pp AS (SELECT id, field, unnest(toks) AS term, generate_subscripts(toks, 1) AS place FROM tl),
occ AS (SELECT query_id, part, role, p.id, count(*)::DOUBLE AS tf FROM parts q JOIN pp p ON CASE WHEN len(terms) = 1 AND prefix THEN starts_with(p.term, terms[1]) ELSE p.term = terms[1] END JOIN tl t ON t.id = p.id AND t.field = p.field
 WHERE (fields IS NULL OR list_contains(fields, p.field)) AND (NOT first OR place = 1) AND (len(terms) = 1 OR coalesce(CASE WHEN prefix THEN starts_with(toks[place + 1], terms[2]) ELSE toks[place + 1] = terms[2] END, false)) GROUP BY ALL),
len_ AS (SELECT id, sum(len(toks)) AS length FROM tl GROUP BY id), tot AS (SELECT (SELECT count(*) FROM items) AS n, (SELECT sum(length) FROM len_) / (SELECT count(*) FROM items)::DOUBLE AS avgdl),
df AS (SELECT query_id, part, count(*) AS df FROM occ GROUP BY ALL),
sc AS (SELECT query_id, id, round(sum(CASE WHEN role <> 'none' THEN greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / avgdl)) END), 6) AS score, count(*) FILTER (role = 'all') AS g_all, count(*) FILTER (role = 'any') AS g_any, count(*) FILTER (role = 'none') AS g_none
 FROM occ JOIN df USING (query_id, part) JOIN len_ USING (id), tot GROUP BY ALL),
asked AS (SELECT query_id, count(*) FILTER (role = 'all') AS n_all, count(*) FILTER (role = 'any') AS n_any FROM parts GROUP BY ALL)
SELECT query_id, id, rank, score FROM (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank, score FROM sc JOIN asked USING (query_id) JOIN items i USING (id)
 WHERE i.deleted_at IS NULL AND g_all = n_all AND (n_any = 0 OR g_any > 0) AND g_none = 0) WHERE rank <= 200
UNION ALL SELECT query_id, id, rank, NULL FROM (SELECT b.id AS query_id, i.id, row_number() OVER (PARTITION BY b.id ORDER BY coalesce(i.sort_key, i.created_at) DESC, i.id) AS rank FROM base b JOIN items i ON b.c = 8 AND i.deleted_at IS NULL
 AND (contains(lower(i.title), concat('nosuch:', b.a)) OR contains(lower(i.summary), concat('nosuch:', b.a)))) WHERE rank <= 200"""


def typed_queries(items):
    """A query of each form from the words of every fiftieth row."""
    # exploded, so that a text is split once and not for each of its words
    words = F.explode(F.array(F.split("summary", r"\s+")))
    plain = lambda w: F.coalesce(w.rlike("^[a-z]+$"), F.lit(False))
    at = F.filter(F.sequence(F.lit(0), F.size("ws") - 1), lambda k: plain(F.get("ws", k)) & plain(F.get("ws", k + 1)))
    longest = F.array_min(F.transform(F.filter("ws", lambda w: w.rlike("^[a-z]+$")), lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w"))))
    rows = items.where("id % 50 = 0").select("id", "kind", words.alias("ws")).select("*", at.alias("p")).where(F.size("p") > 0)
    k = F.get("p", F.floor(F.size("p") / 2).cast("int"))
    base = rows.select("id", "kind", F.get("ws", k).alias("a"), F.get("ws", k + 1).alias("b"), longest["w"].alias("l"))
    return base.select(F.col("id").alias("query_id"), F.element_at(F.array(*map(F.expr, _FORMS)), (F.floor(F.col("id") / 50) % 11 + 1).cast("int")).alias("query"))


@query(_TYPED, "items")
def s5_s8_typed_queries(spark, d):
    items = A.items(spark, d)
    return S.search(items, typed_queries(items))


@query(_TYPED, "items")
def s5_s8_typed_queries_by_postings(spark, d):
    items, path = A.items(spark, d), _folder(spark, "postings")
    S.postings(items).write.parquet(path)
    return S.search(items, typed_queries(items), index=spark.read.parquet(path))


_MODE = "CASE id % 3 WHEN 0 THEN NULL WHEN 1 THEN 'vector' ELSE 'hybrid' END"


@query(f"""SELECT id AS query_id, coalesce(mode, 'fts') AS requested, CASE WHEN mode IS NOT NULL AND NOT ({_OPERATORS}) AND id % 5 <> 0 AND id % 7 <> 0 AND id % 11 <> 0 THEN mode ELSE 'fts' END AS mode
FROM (SELECT id, {_MODE} AS mode, {_PLAINED} AS t FROM items)""", "items")
def s14_route(spark, d):
    i = F.col("id")
    mode = F.when(i % 3 == 1, "vector").when(i % 3 == 2, "hybrid")
    q = A.items(spark, d).select(i.alias("query_id"), F.regexp_replace("summary", r"[^\x00-\x7F]", "-").alias("query"), mode.alias("mode"))
    k = F.col("query_id")
    return S.route(q, k % 5 != 0, k % 7 == 0, k % 11)


# listing and sources

@query(f"SELECT id FROM items WHERE deleted_at IS NULL AND (embedding IS NULL OR embedding_model IS DISTINCT FROM '{MODEL}') ORDER BY id DESC LIMIT 64", "items")
def l12_newest_pending(spark, d):
    return L.pending_embeddings(A.items(spark, d), MODEL, 64).select("id")


@query("SELECT id, provider, external_id AS \"externalId\", title, summary, [label] AS names, concat('n', id) AS views, created_at AS \"createdAt\", deleted_at AS \"deletedAt\", starred_at AS \"starredAt\", false AS has_vector FROM items", "items")
def src6_items_as_read(spark, d):
    stored = A.items(spark, d).withColumn("stats", F.to_json(F.create_map(F.lit("views"), F.concat(F.lit("n"), F.col("id").cast("string"))))).withColumn("collection", F.to_json("collection"))
    got = L.as_read(stored)
    return got.select("id", "provider", "externalId", "title", "summary", F.col("collection").alias("names"), F.col("stats")["views"].alias("views"), "createdAt", "deletedAt", "starredAt", F.lit("embedding" in got.columns).alias("has_vector"))


@query("""WITH p AS (SELECT page_id, split_part(split_part(url, '://', 2), '/', 1) AS provider, html AS body FROM pages UNION ALL SELECT -page_id - 1, 'json', concat('{"n":', page_id, '}') FROM pages)
SELECT provider, CASE WHEN starts_with(ltrim(body), '<') THEN 'html' ELSE 'json' END AS ext, count(*) AS files, sum(length(body))::BIGINT AS chars, sum(page_id)::BIGINT AS ids FROM p GROUP BY ALL""")
def src4_dumped_fixtures(spark, d):
    p = A.table(spark, d, "pages")
    host = F.split_part(F.split_part("url", F.lit("://"), F.lit(2)), F.lit("/"), F.lit(1))
    html = p.select("page_id", host.alias("provider"), F.col("html").alias("body"))
    pages = html.unionByName(p.select((-F.col("page_id") - 1).alias("page_id"), F.lit("json").alias("provider"), F.concat(F.lit('{"n":'), F.col("page_id").cast("string"), F.lit("}")).alias("body")))
    path = _folder(spark, "fixtures")
    T.dump_fixtures(pages, path)
    got = spark.read.schema("page_id long, body string, meta string, provider string, ext string").json(path)
    told = F.get_json_object("meta", "$.page_id").cast("long")
    return got.groupBy("provider", "ext").agg(F.count(F.lit(1)).alias("files"), F.sum(F.length("body")).alias("chars"), F.sum(told).alias("ids"))


@query("SELECT i.provider, count(DISTINCT i.id) AS items, count(DISTINCT w.page_id) AS pages FROM items i LEFT JOIN walks w ON w.provider = concat('p', i.id % 7) AND w.walk = i.id GROUP BY i.provider", "items", "walks")
def u3_sql_over_views(spark, d):
    T.register_views(A.items(spark, d), A.walks(spark, d))
    return spark.sql("SELECT i.provider, count(DISTINCT i.id) AS items, count(DISTINCT w.page_id) AS pages FROM saved_items i LEFT JOIN raw_data w ON w.provider = concat('p', i.id % 7) AND w.walk = i.id GROUP BY i.provider")


# snapshots

@query("""SELECT 'customer' AS "table", (SELECT count(*) FROM customer) AS before_rows, NULL::BIGINT AS after_rows UNION ALL SELECT 'orders', (SELECT count(*) FROM before_), (SELECT count(*) FROM after_)
UNION ALL SELECT 'part', NULL, (SELECT count(*) FROM part)""", "before_", "after_")
def d1_inventory(spark, d):
    return D.inventory({"customer": A.table(spark, d, "customer"), "orders": A.before(spark, d)}, {"orders": A.after(spark, d), "part": A.table(spark, d, "part")})


_PART = lambda c: f"(SELECT count({c}) FROM before_), (SELECT count({c}) FROM after_)"


@query(f"""SELECT 'o_orderkey' AS "column", '0' AS before_place, '0' AS after_place, {_PART('o_orderkey').replace('),', ') AS before_cells,', 1)} AS after_cells UNION ALL SELECT 'o_orderstatus', '1', '2', {_PART('o_orderstatus')}
UNION ALL SELECT 'o_custkey', '2', NULL, (SELECT count(o_custkey) FROM before_), 0 UNION ALL SELECT 'late', NULL, '1', 0, (SELECT count(o_totalprice) FROM after_)""", "before_", "after_")
def d2_schema_difference(spark, d):
    b = A.before(spark, d).select("o_orderkey", "o_orderstatus", "o_custkey")
    a = A.after(spark, d).select("o_orderkey", F.col("o_totalprice").alias("late"), "o_orderstatus")
    place = lambda c: F.split_part(c, F.lit(" "), F.lit(1))
    return D.schema_difference(b, a).select("column", place(F.col("before")).alias("before_place"), place(F.col("after")).alias("after_place"), "before_cells", "after_cells")


@query("""SELECT 'o_orderkey' AS key, (SELECT count(*) = count(DISTINCT o_orderkey) FROM before_) AS before_unique, (SELECT count(*) = count(DISTINCT o_orderkey) FROM after_) AS after_unique
UNION ALL SELECT 'o_custkey,o_orderkey', (SELECT count(*) = count(DISTINCT (o_custkey, o_orderkey)) FROM before_), (SELECT count(*) = count(DISTINCT (o_custkey, o_orderkey)) FROM after_) UNION ALL SELECT 'o_custkey', (SELECT count(*) = count(DISTINCT o_custkey) FROM before_), (SELECT count(*) = count(DISTINCT o_custkey) FROM after_)""", "before_", "after_")
def d5_unique_keys(spark, d):
    return D.unique_keys(A.before(spark, d), A.after(spark, d), [["o_orderkey"], ["o_custkey", "o_orderkey"], ["o_custkey"]])


@query("""SELECT 'before' AS side, coalesce(sum(c - 1), 0)::BIGINT AS surplus FROM (SELECT count(*) AS c FROM before_ GROUP BY o_orderkey) UNION ALL SELECT 'after', coalesce(sum(c - 1), 0)::BIGINT FROM (SELECT count(*) AS c FROM after_ GROUP BY o_orderkey)""", "before_", "after_")
def d6_surplus_of_both_sides(spark, d):
    key = D.chosen_key(A.before(spark, d), A.after(spark, d), unique={"by_key": ["o_orderkey"], "by_owner": ["o_custkey", "o_orderkey"]})
    one = lambda df, side: D.surplus_keys(df, key[-1:]).select(F.lit(side).alias("side"), "surplus")
    return one(A.before(spark, d), "before").unionByName(one(A.after(spark, d), "after"))
