"""What a typed query asks for, as rows of parts: by column expressions, for whole tables of queries.

A part is a phrase: its terms stand side by side in one column. Plain text gives a part for
each of its words, all of them required; a word of several tokens ("covid-19", "it's") is a
phrase of them, and of the last word the last token is a prefix.

Text in the operator syntax gives parts where it is a list of units: words or "quoted phrases",
each with * behind it (a prefix), ^ before it (its column starts so) or a column and a colon
before it (title:fox, {title summary}:fox; case of columns is ignored). Units follow each
other directly or by AND (all), by OR (any), or by NOT (none). What is no such list (with
parentheses or NEAR, unbalanced quotes, an unknown column, OR mixed with others, several units
after one NOT, other signs) has no parts; ``operators`` text without parts is left to the
substring fallback. A unit without a token is dropped beside others that it follows directly;
joined by AND it finds nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from satchel.operators.textsearch import COLUMNS, tokens

#: Signs of a word that needs no quotes.
_LETTER = r"[A-Za-z0-9_\x{1A}\x{80}-\x{10FFFF}]"
#: Groups: 1 connector, 2 columns, 3 start mark, 4 quoted text, 5 word, 6 star.
UNIT = rf'(?:(AND|OR|NOT)\s+)?(?:(\{{[A-Za-z0-9_\s]+\}}|[A-Za-z0-9_]+)\s*:\s*)?(?:(\^)\s*)?(?:"([^"]*+(?:""[^"]*+)*+)"|((?!(?:AND|OR|NOT)(?!{_LETTER})){_LETTER}++))(\s*\*)?'
PART = "struct<part int, role string, terms array<string>, fields array<string>, prefix boolean, first boolean>"


def _plain(text: Column) -> Column:
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    each = F.transform(words, lambda w, k: F.struct(k.cast("int").alias("part"), F.lit("all").alias("role"), tokens(w).alias("terms"), F.lit(None).cast("array<string>").alias("fields"), (k == F.size(words) - 1).alias("prefix"), F.lit(False).alias("first")))
    return F.filter(each, lambda p: F.size(p["terms"]) > 0)


def _unit(u: Column, k: Column) -> Column:
    """A part of the groups ``u`` of a unit."""
    body = F.when(u["word"] != "", u["word"]).otherwise(F.replace(u["quoted"], F.lit('""'), F.lit('"')))
    fields = F.when(u["columns"] != "", F.split(F.lower(F.trim(F.translate(u["columns"], "{}", ""))), r"\s+"))
    role = F.when(u["connector"] == "OR", "any").when(u["connector"] == "NOT", "none").otherwise("all")
    return F.struct(k.cast("int").alias("part"), role.alias("role"), tokens(body).alias("terms"), fields.alias("fields"), (u["star"] != "").alias("prefix"), (u["start"] != "").alias("first"), u["connector"].alias("connector"))


def _with_units(queries: DataFrame) -> DataFrame:
    """``queries`` with ``units``: the parts of text in the operator syntax; null if it is no list
    of units. Step by step, so that no pattern is applied twice."""
    text = F.when(F.col("operators"), F.col("text")).otherwise("")
    group = lambda n: F.regexp_extract_all(text, F.lit(UNIT), F.lit(n))
    names = ("connector", "columns", "start", "quoted", "word", "star")
    q = queries.select("*", *(group(k + 1).alias(f"{n}_") for k, n in enumerate(names)), F.trim(F.regexp_replace(F.regexp_replace(text, UNIT, " "), r"\s+", " ")).alias("left_"))
    q = q.withColumn("zip_", F.arrays_zip(*(F.col(f"{n}_").alias(n) for n in names))).withColumn("each_", F.transform("zip_", _unit))
    q = q.withColumn("rest_", F.slice("connector_", 2, 1 << 20)).withColumn("next_", F.concat("rest_", F.array(F.lit("AND"))))
    known = F.forall("each_", lambda p: p["fields"].isNull() | F.forall(p["fields"], lambda f: f.isin(*COLUMNS)))
    either = F.forall("rest_", lambda x: x == "OR") & (F.size("rest_") > 0)
    # a unit that directly follows one after NOT would belong to it
    every = ~F.array_contains("connector_", "OR") & ~F.exists(F.arrays_zip(F.col("connector_").alias("x"), F.col("next_").alias("y")), lambda z: (z["x"] == "NOT") & (z["y"] == ""))
    # of units that follow each other directly, those without a token are dropped, unless all are
    alone = lambda p, k: ((p["connector"] == "AND") | (k == 0)) & (F.get("next_", k) != "")
    q = q.withColumn("either_", either).withColumn("kept_", F.filter("each_", lambda p, k: (F.size(p["terms"]) > 0) | alone(p, k)))
    roles = F.transform("kept_", lambda p: F.struct(p["part"].alias("part"), F.when(F.col("either_"), "any").otherwise(p["role"]).alias("role"), *(p[n].alias(n) for n in ("terms", "fields", "prefix", "first"))))
    whole = (F.col("left_") == "") & (F.size("each_") > 0) & (F.get("connector_", F.lit(0)) == "") & known & (F.col("either_") | every)
    return q.withColumn("units", F.when(whole, roles)).select(*queries.columns, "units")


def with_parts(queries: DataFrame) -> DataFrame:
    """``queries`` (text, operators, ...) with ``parts``: null where the text is left to the fallback."""
    typed = F.when(F.col("operators"), F.col("units")).otherwise(_plain(F.col("text")))
    return _with_units(queries).withColumn("parts", typed.cast(f"array<{PART}>")).drop("units")


def exploded(queries: DataFrame) -> DataFrame:
    """(query_id, part, role, terms, fields, prefix, first) of ``with_parts`` queries."""
    return queries.select("query_id", F.explode("parts").alias("p")).select("query_id", "p.*")
