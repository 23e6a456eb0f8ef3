"""A key's collections are united name by name, not gathered from all its copies."""

from pyspark.sql import functions as F

from satchel.operators import state as M


def test_a_key_holds_its_distinct_names_only(spark):
    n = F.col("id")
    names = F.when(n == 7, F.lit(None)).otherwise(F.array(F.concat(F.lit(" Topic "), (n % 3).cast("string")), F.when(n % 2 == 0, "TOPIC 1").otherwise("")))
    texts = {c: F.lit("x") for c in ("external_id", "title", "publication", "summary")}
    batch = spark.range(3000).select(n.alias("seq"), F.lit(None).cast("string").alias("provider"), F.lit("u").alias("account"), *(v.alias(c) for c, v in texts.items()), names.alias("collection"))
    (row,) = M.collapse(batch).collect()
    assert (row.copies, row.first_seq) == (3000, 0)
    assert row.incoming == ["Topic 0", "TOPIC 1", "Topic 2"]


def test_a_key_without_names_holds_none(spark):
    schema = "seq long, provider string, account string, external_id string, title string, publication string, summary string, collection array<string>"
    (row,) = M.collapse(spark.createDataFrame([(1, "p", "u", "e", "", "", "", ["", " "])], schema)).collect()
    assert row.incoming == []
