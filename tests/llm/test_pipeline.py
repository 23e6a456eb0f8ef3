"""The pipeline, stage by stage, on the smallest tables."""

import corpus_pipeline as C
from satchel.llm import decontaminate, neardup
from satchel.llm.shared import written

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, n = docs.columns, [docs.count()]
    for name, stage in C.STAGES:
        docs = written(stage(spark, docs, SF), "stage")
        n.append(docs.count())
        if name == "MinHash near-dedup":
            assert neardup.near_duplicates(docs.select("doc_id", "text")).where("component_id <> doc_id").count() == 0
        if name == "benchmark decontamination":
            assert decontaminate.hits(docs, spark.read.parquet(f"{SF}/benchmark.parquet")).where("contaminated").count() == 0
        if name != C.STAGES[-1][0]:
            assert docs.columns == columns
    assert n == sorted(n, reverse=True) and n[-1] > n[0] / 2
    assert "ids" in docs.columns
