"""Views of the test tables in the library's shapes, in SQL that two engines read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

ITEMS_SQL = """
SELECT d.doc_id AS id, d.source AS provider, 'u' AS account,
       CAST(d.doc_id AS VARCHAR(20)) AS external_id,
       concat('https://example.com/d/', CAST(d.doc_id AS VARCHAR(20))) AS url,
       CASE WHEN d.doc_id % 3 = 0 THEN substr(d.text, 1, 60) ELSE '' END AS title,
       '' AS publication, d.text AS summary, d.lang AS kind,
       CASE WHEN d.doc_id % 4 = 0 THEN NULL ELSE d.n_chars END AS duration,
       CASE WHEN d.doc_id % 5 = 0 THEN 'upvoted' ELSE concat('topic ', d.lang) END AS label,
       1700000000000 + d.doc_id * 1000 AS created_at,
       CASE WHEN d.doc_id % 7 = 0 THEN NULL ELSE 1700000000000 + (d.doc_id * 7919) % 100003 END AS sort_key,
       CASE WHEN l.toxic = 1 THEN 1800000000000 + d.doc_id END AS deleted_at,
       CASE WHEN l.quality = 1 THEN 1800000000000 + d.doc_id END AS starred_at,
       CASE WHEN e.vec_id IS NULL THEN NULL WHEN d.doc_id % 6 = 0 THEN 'other'
            ELSE 'local:bge-small-en-v1.5-q8+r2' END AS embedding_model,
       e.embedding AS embedding
FROM {documents} d
LEFT JOIN {labels} l ON l.doc_id = d.doc_id
LEFT JOIN {embeddings} e ON e.vec_id = d.doc_id
"""

WALKS_SQL = """
SELECT c.conv_id * 1000 + c.turn AS page_id,
       concat('p', CAST(c.conv_id % 7 AS VARCHAR(5))) AS provider, 'u' AS account,
       'items' AS kind, c.conv_id AS walk, CAST(c.turn AS INT) AS page_no,
       CAST(c.turn % 3 AS INT) AS page,
       1700000000000 + c.conv_id * 100000 + c.turn * 10 AS fetched_at,
       CASE WHEN c.conv_id % 11 = 0 AND c.turn = 1 THEN 'failed'
            WHEN c.turn % 2 = 0 THEN 'pending' ELSE 'ingested' END AS status,
       lower(c.text) AS body
FROM {conversations} c
"""

STATE_SQL = """
SELECT e.event_id AS seq, e.user_id AS item_id, AT_MS AS at_ms,
       CASE e.event_type WHEN 'click' THEN 'star' WHEN 'view' THEN 'unstar'
                         WHEN 'error' THEN 'delete' WHEN 'signup' THEN 'restore'
                         ELSE 'upsert' END AS action,
       e.value AS value, e.props AS props
FROM {events} e
"""

AFTER_SQL = """
SELECT o_orderkey, o_custkey,
       CASE WHEN o_orderkey % 41 = 0 THEN NULL ELSE o_orderstatus END AS o_orderstatus,
       CASE WHEN o_orderkey % 31 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice,
       o_orderdate, o_orderpriority
FROM {orders} WHERE o_orderkey % 97 <> 0
UNION ALL SELECT o_orderkey + 100000000, o_custkey, o_orderstatus, o_totalprice,
       o_orderdate, o_orderpriority FROM {orders} WHERE o_orderkey % 89 = 0
UNION ALL SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice,
       o_orderdate, o_orderpriority FROM {orders} WHERE o_orderkey % 101 = 0
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _view(spark: SparkSession, sf_dir: str, sql: str, *names: str) -> DataFrame:
    return spark.sql(sql, **{n: table(spark, sf_dir, n) for n in names})


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The item table; ``collection`` is an array."""
    found = _view(spark, sf_dir, ITEMS_SQL, "documents", "labels", "embeddings")
    return found.selectExpr("*", "array(label) AS collection").drop("label")


def walks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, WALKS_SQL, "conversations")


def state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, STATE_SQL.replace("AT_MS", "unix_millis(CAST(e.ts AS TIMESTAMP))"), "events")


def before(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")


def after(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, AFTER_SQL, "orders")


def _plain(sql: str) -> str:
    return sql.replace("{", "").replace("}", "")


#: The same views as common table expressions of the second engine.
WITH = {
    "items": _plain(ITEMS_SQL),
    "walks": _plain(WALKS_SQL),
    "state": _plain(STATE_SQL).replace("AT_MS", "epoch_us(e.ts) // 1000"),
    "after_": _plain(AFTER_SQL),
    "before_": "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders",
}


def oracle(body: str, *views: str) -> str:
    """``body`` after the named views and, if it starts with one, its own WITH list."""
    listed = [f"{v} AS ({WITH[v]})" for v in views]
    body = body.strip()
    if body.upper().startswith("WITH "):
        listed.append(body[5:].lstrip())
        return "WITH " + ", ".join(listed)
    return "WITH " + ", ".join(listed) + " " + body
