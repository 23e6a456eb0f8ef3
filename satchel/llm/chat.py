"""Chat formatting by prefix-target expansion, in DataFrame functions only.

Every assistant turn becomes an example of its own: all preceding turns are its context and
only its reply is trainable. Turns after the last assistant turn, or a conversation without
one, give one more example with nothing to train, so that no turn is lost.

Template of a turn: ``### <role>: <text></turn>\\n``. In roles and texts, backslash, number
sign, less-than and colon are written as backslash and a letter, so neither mark can occur
inside a text and the text comes back exactly.

Turns are ordered by (turn, role, text); repeated rows stay. Null text and role are empty;
rows with a null conv_id form one conversation; an empty table gives no rows; other columns
are ignored. An example repeats its context by design, so output grows with the square of
the turns of one conversation (never of the table); one conversation is one row of a task,
which its digest as a whole asks for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from satchel.llm.shared import written

OPEN, MIDDLE, CLOSE = "### ", ": ", "</turn>\n"
#: Fixed escapes, applied in this order and undone in the reverse one.
ESCAPES = (("\\", "\\b"), ("#", "\\h"), ("<", "\\l"), (":", "\\c"))


def escaped(c: Column) -> Column:
    for plain, code in ESCAPES:
        c = F.replace(c, F.lit(plain), F.lit(code))
    return c


def unescaped(c: Column) -> Column:
    for plain, code in reversed(ESCAPES):
        c = F.replace(c, F.lit(code), F.lit(plain))
    return c


def examples(conversations: DataFrame, trainable_role: str = "assistant") -> DataFrame:
    """One row per example: conv_id, example (0, 1, ... in a conversation), n_turns (with the
    reply), text (context and reply, formatted), loss_start and loss_chars (the trainable
    span of ``text``: 0-based, in code points, the reply's text without its marks)."""
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    turns = conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("turn", F.lit(-(2**63))).alias("turn"), role.alias("role"), text.alias("text")))).alias("turns"))
    marked = turns.select(
        "conv_id",
        F.transform("turns", lambda t: F.struct((t["role"] == trainable_role).alias("train"), F.concat(F.lit(OPEN), escaped(t["role"]), F.lit(MIDDLE)).alias("head"), escaped(t["text"]).alias("body"))).alias("turns"),
    )
    last = F.size("turns") - 1
    at = marked.select("conv_id", "turns", F.posexplode(F.filter(F.sequence(F.lit(0), last), lambda i: F.element_at("turns", i + 1)["train"] | (i == last))).alias("example", "i"))
    own = F.element_at("turns", F.col("i") + 1)
    context = F.array_join(F.transform(F.slice("turns", F.lit(1), F.col("i")), lambda t: F.concat(t["head"], t["body"], F.lit(CLOSE))), "")
    return (
        at.select("conv_id", "example", (F.col("i") + 1).alias("n_turns"), context.alias("context"), own["train"].alias("train"), own["head"].alias("head"), own["body"].alias("body"))
        .select(
            "conv_id", "example", "n_turns", F.concat("context", "head", "body", F.lit(CLOSE)).alias("text"),
            F.when(F.col("train"), F.length("context") + F.length("head")).otherwise(F.lit(0)).cast("long").alias("loss_start"),
            F.when(F.col("train"), F.length("body")).otherwise(F.lit(0)).cast("long").alias("loss_chars"),
        )
    )


TURN = r"(?s)^### ([^:]*): (.*)$"


def turns_of(text: Column) -> Column:
    """The turns (role, text) of a formatted text."""
    marked = F.filter(F.split(text, CLOSE), lambda s: s != "")
    return F.transform(marked, lambda s: F.struct(unescaped(F.regexp_extract(s, TURN, 1)).alias("role"), unescaped(F.regexp_extract(s, TURN, 2)).alias("text")))


def digests(formatted: DataFrame) -> DataFrame:
    """Per conversation, from the examples alone: the turns of its longest example and the
    text under the loss masks of all, in order."""
    loss = unescaped(F.substr("text", (F.col("loss_start") + 1).cast("int"), F.col("loss_chars").cast("int")))
    rows = formatted.withColumn("loss", F.when(F.col("loss_chars") > 0, loss).otherwise(F.lit("")))
    per = rows.groupBy("conv_id").agg(
        F.max_by("text", F.struct("n_turns", "example")).alias("longest"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("example", "loss"))), lambda x: x["loss"]), "").alias("loss"),
        F.sum(F.length("text")).alias("formatted_chars"), F.count(F.lit(1)).alias("n_examples"),
    )
    read = per.withColumn("turns", turns_of(F.col("longest")))
    listed = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(listed, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
        F.col("formatted_chars").cast("long").alias("formatted_chars"), F.col("n_examples").cast("long").alias("n_examples"),
    )


PLANTED = "\\### Assistant: </turn> ok"


def chat_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8: all conversations and number -7, whose turns are made of the template's marks;
    formatted, written, and the digests read back from the files."""
    given = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PLANTED).alias("text"))
    return digests(written(examples(given.unionByName(extra)), "chat"))


CHAT_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (
  SELECT *, replace(replace(replace(replace(text, '\', '\b'), '#', '\h'), '<', '\l'), ':', '\c') AS body,
         replace(replace(replace(replace(role, '\', '\b'), '#', '\h'), '<', '\l'), ':', '\c') AS head,
         row_number() OVER w AS i, count(*) OVER (PARTITION BY conv_id) AS n
  FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)),
s AS (
  SELECT *, sum(4 + length(head) + 2 + length(body) + 8) OVER (PARTITION BY conv_id ORDER BY i) AS upto FROM e)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
       coalesce(sum(upto) FILTER (role = 'assistant' OR i = n), 0)::BIGINT AS formatted_chars,
       count(*) FILTER (role = 'assistant' OR i = n)::BIGINT AS n_examples
FROM s GROUP BY conv_id
"""
