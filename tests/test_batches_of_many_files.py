"""A batch of the stream queries is what has arrived, in however many files; pages are put together once."""

from pathlib import Path

import pytest

from satchel.plans import page_queries as P
from satchel.plans import replay_queries as R

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize(("module", "name", "folder", "versions"), [(R, "st4_embed_after_merge", "embedded", "v*"), (P, "st1_st3_pages_parsed_and_merged", "pages_merged", "v/*")])
def test_many_files_make_one_batch(spark, monkeypatch, tmp_path, module, name, folder, versions):
    monkeypatch.setattr(module, "_folder", lambda spark, own: str(tmp_path / own))
    spark.conf.set("spark.sql.files.maxRecordsPerFile", "3")
    try:
        assert getattr(module, name)(spark, SF).count() > 0
    finally:
        spark.conf.unset("spark.sql.files.maxRecordsPerFile")
    (arrived,) = [f for f in tmp_path.iterdir() if f.name.endswith("arriving")]
    wanted = 2 if name.startswith("st4") else 3
    assert len(list(arrived.glob("*.parquet"))) > wanted
    assert len(list(Path(tmp_path / folder).glob(versions))) == wanted


def test_pages_of_one_service_are_read_alone(spark):
    plan = P.service_pages(spark, SF).where("provider = 'twitter'")._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan and "PartitionFilters: [isnotnull(provider" in plan
