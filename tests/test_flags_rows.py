"""Flags are taken from as many queries as the table has rows."""

from satchel.catalog import QUERIES

SF = "/root/testdata/sf0.001"


def test_flags_grow_with_the_table(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    found = {r.query_id: r for r in QUERIES["s4_flags_rows"](spark, SF).collect()}
    assert found.keys() == docs.keys()
    assert all(r.starred == (i % 4 < 2) and r.text.strip(" ") == r.text and r.text.endswith(docs[i].strip(" ")) for i, r in found.items())
