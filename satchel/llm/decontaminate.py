"""Benchmark decontamination by a prefix-filtered set join, in DataFrame functions only.

A window is ``size`` consecutive words of a benchmark item (an item of fewer words, but not
none, is one window). Shingles of two adjacent words are ordered by how often they occur in
all documents; an occurrence of a window holds each of its shingles, so it is enough to join
on the rarest one: with full containment the necessary prefix is one token. Where that
shingle stands in the window gives the only place the window could start in the document
(positional bound), which must leave room for the window (length bound); the words
there are then compared one by one. Windows of one word use the word itself. Candidates are
sought in lower-cased text, which is quicker and only coarser than A-Z alone.

Documents are scanned twice: to count the benchmark's shingles, which only leaves sums, and
to find the rarest of each window, which leaves those places. Only texts with a candidate
are moved. Work is done once per distinct text and per distinct window; items come in at the
end, once per distinct set of windows that a text holds.

Null and empty texts have no words and no windows; equal windows of several items, and
items repeated, all count; repeated document rows are kept apart; columns of any name pass
through ``decontaminate`` whole; empty tables give no hits. What is broadcast is bounded in
bytes (``bounded``); beyond it joins are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from satchel.llm.repeats import distinct_texts, keyed
from satchel.llm.shared import bounded, written

#: Fixed separators: every ASCII character but letters and digits.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same before A-Z are in lower case.
SEPARATORS_OF_CASED = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SIZE = 10


def words(text: Column) -> Column:
    return F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), SEPARATORS), lambda w: w != "")


def windows(items: DataFrame, size: int = SIZE) -> DataFrame:
    """One row per distinct window of an item: item_id, window array<string>."""
    w = items.select("item_id", words(F.col("text")).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - (size - 1), F.lit(1)))
    return w.select("item_id", F.explode(F.array_distinct(F.transform(starts, lambda i: F.slice("w", i, size)))).alias("window")).distinct()


def coarse(text: Column) -> Column:
    """Words in lower case beyond A-Z too, for the search of candidates only: words that are
    equal by ``words`` are equal here. (Sigma's lower case would depend on what follows.)"""
    return F.array_remove(F.split(F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("\u03a3"), F.lit("\u03c3"))), SEPARATORS), "")


def n_words(text: Column) -> Column:
    """The number of ``words``: parts between separators but for an empty first or last one."""
    parts = F.split(F.coalesce(text, F.lit("")), SEPARATORS_OF_CASED)
    empty = lambda part: F.when(part == "", 1).otherwise(0)
    return (F.size(parts) - empty(F.get(parts, F.lit(0))) - F.when(F.size(parts) > 1, empty(F.element_at(parts, -1))).otherwise(0)).cast("long")


def shingles(split: DataFrame, single: bool) -> DataFrame:
    """``split`` (w, other columns) with pos and token of every pair of adjacent words and, if
    ``single``, of every word; pos counts from 0. Without w."""
    rest = [c for c in split.columns if c != "w"]
    n = F.greatest(F.size("w") - 1, F.lit(0))
    pairs = split.select(*rest, F.posexplode(F.arrays_zip(F.slice("w", F.lit(1), n).alias("a"), F.slice("w", F.lit(2), n).alias("b"))).alias("pos", "p"))
    out = pairs.select(*rest, "pos", F.xxhash64("p.a", "p.b").alias("token"))
    if single:
        out = out.unionByName(split.select(*rest, F.posexplode("w").alias("pos", "a")).select(*rest, "pos", F.xxhash64("a").alias("token")))
    return out


def token_counts(split: DataFrame, listed: DataFrame, single: bool) -> DataFrame:
    """(token, df): how often each token of ``listed`` occurs in ``split`` (w)."""
    pool = written(listed.select("token").distinct(), "pool")
    every = shingles(split.select("w"), single).select("token")
    counted = lambda df: df.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    small = bounded(pool, 16, otherwise=None)
    return counted(every).join(pool, "token", "left_semi") if small is None else counted(every.join(small, "token", "left_semi"))


def occurrences(texts: DataFrame, items: DataFrame, size: int = SIZE) -> tuple[DataFrame, DataFrame]:
    """(found, windows): per text (key) with a hit found array<struct<start, n, wid>>, the exact
    occurrences of windows, start counted in words from 0; and (wid, item_id) of all windows."""
    win = written(windows(items, size), "windows")
    each = written(win.select("window").distinct().select(F.monotonically_increasing_id().alias("wid"), "window"), "distinct_windows")
    single = not each.where(F.size("window") == 1).isEmpty()
    listed = shingles(each.select("wid", F.size("window").alias("n"), coarse(F.concat_ws(" ", "window")).alias("w")), single)
    listed = listed.where((F.col("n") > 1) | (F.col("pos") == 0))
    split = texts.select("key", coarse(F.col("text")).alias("w"))
    common = written(token_counts(split, listed, single), "token_counts")
    # a window one of whose shingles occurs nowhere can't occur
    ranked = listed.join(common, "token", "left").groupBy("wid").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "token", "pos")).alias("t"), F.first("n").alias("n"))
    prefix = written(ranked.where("t.df > 0").select("wid", "n", F.col("t.token").alias("token"), F.col("t.pos").alias("off")), "prefix")
    at = shingles(split.withColumn("n_words", F.size("w")), single)
    start = F.col("pos") - F.col("off")
    places = written(at.join(bounded(prefix, 40), "token").where((start >= 0) & (start + F.col("n") <= F.col("n_words"))).select("key", "wid", start.alias("start")), "places")
    by_text = places.join(bounded(each, 48 + F.length(F.concat_ws(" ", "window"))), "wid").groupBy("key").agg(F.collect_list(F.struct("start", "wid", "window")).alias("cand"))
    wanted = bounded(places.select("key").distinct(), 24, otherwise=None)
    moved = texts if wanted is None else texts.join(wanted, "key", "left_semi")
    there = moved.join(by_text, "key").select("key", words(F.col("text")).alias("w"), "cand")
    exact = F.filter("cand", lambda c: F.slice("w", c["start"] + 1, F.size(c["window"])) == c["window"])
    found = there.select("key", F.transform(exact, lambda c: F.struct(c["start"].alias("start"), F.size(c["window"]).alias("n"), c["wid"].alias("wid"))).alias("found")).where(F.size("found") > 0)
    return written(found, "found"), each.join(win, "window").select("wid", "item_id")


def marked(rows: DataFrame, items: DataFrame, size: int = SIZE) -> DataFrame:
    """``keyed`` rows with n_hit (words inside any occurrence) and ids, the sorted item_ids as
    strings; null where nothing occurs."""
    _, texts = distinct_texts(rows)
    found, held = occurrences(texts, items, size)
    covered = F.array_distinct(F.flatten(F.transform("found", lambda c: F.sequence(c["start"], c["start"] + c["n"] - 1))))
    per = written(found.select("key", F.size(covered).cast("long").alias("n_hit"), F.array_sort(F.array_distinct(F.transform("found", lambda c: c["wid"]))).alias("wids")), "hits")
    sets = per.select("wids").distinct()
    ids = sets.select("wids", F.explode("wids").alias("wid")).join(held, "wid").groupBy("wids").agg(F.array_sort(F.collect_set(F.coalesce(F.col("item_id").cast("string"), F.lit("")))).alias("ids"))
    each = written(per.join(ids, "wids").select("key", "n_hit", "ids"), "hit_items")
    return rows.join(bounded(each, 48 + F.length(F.concat_ws(",", "ids"))), "key", "left")


OUTPUTS = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def hits(docs: DataFrame, items: DataFrame, size: int = SIZE) -> DataFrame:
    """``docs`` plus n_words, n_hit (words inside any occurrence), n_items, items_sha256 and
    contaminated, which replace columns of these names; a null item_id counts as ''."""
    ids = F.coalesce("ids", F.array().cast("array<string>"))
    return marked(keyed(docs), items, size).select(
        *(F.col("row").getField(c).alias(c) for c in docs.columns if c.lower() not in OUTPUTS),
        n_words(F.col("text")).alias("n_words"), F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.size(ids).cast("long").alias("n_items"), F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"),
        F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"),
    )


def decontaminate(docs: DataFrame, items: DataFrame, size: int = SIZE) -> DataFrame:
    """The rows of ``docs`` that share no window with any item, unchanged."""
    return marked(keyed(docs), items, size).where("n_hit IS NULL").select(*(F.col("row").getField(c).alias(c) for c in docs.columns))


def decontamination_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10: all documents against all benchmark items."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return hits(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).drop("text")


DECONTAMINATION_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, list_slice(w, i, i + least(len(w), 10) - 1) AS win
       FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT len(win) AS n FROM bw),
dw AS (SELECT doc_id, i, n, list_slice(w, i, i + n - 1) AS win
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lens WHERE len(w) >= n)),
hit AS (SELECT doc_id, i, n, item_id FROM dw JOIN bw USING (win)),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
ids AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS s FROM hit GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN ids USING (doc_id)
"""
