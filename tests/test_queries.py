"""Every registered query against its SQL in a second engine."""

import duckdb
import pytest

from satchel.catalog import QUERIES, SQL, flagship

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def rounded(v):
    return round(v, 6) if isinstance(v, float) else v


def rows(names, found):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted(repr(tuple(rounded(r[k]) for k in order)) for r in found)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    got = QUERIES[name](spark, SF)
    want = duck.execute(SQL[name])
    columns = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert rows(got.columns, got.collect()) == rows(columns, want.fetchall())


def test_flagship(spark):
    assert flagship(spark, SF).count() > 0


def test_nothing_outside_imports_the_optional_subpackage():
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent / "satchel"
    assert not [p for p in root.rglob("*.py") if "llm" not in p.parts and "satchel.llm" in p.read_text()]
