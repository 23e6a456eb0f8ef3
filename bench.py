"""Wall time of headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS], and the rates of the core
jobs there and at a tenth of that size: one JSON line."""

import json
import os
import time
from pathlib import Path

import pyspark
from pyspark.sql import functions as F

from satchel import adapters as A
from satchel.catalog import QUERIES
from satchel.operators import textsearch as S
from satchel.plans import queries as Q
from satchel.plans.table_queries import rows_as_queries
from satchel.session import session

HEADLINE = ["l1_list", "l4_provider_stats", "i2_first_arrivals", "i4_i5_pages_read", "m1_upsert", "m8_soft_delete", "s1_postings", "s2_s10_search", "v1_cosine_top", "v4_hybrid", "d4_multiset_difference", "d8_d9_changed_cells", "p5_instagram", "p7_twitter"]
SMALLER = {"sf0.1": "sf0.01", "sf0.01": "sf0.001"}


def timed(df) -> float:
    start = time.time()
    df.write.format("noop").mode("overwrite").save()
    return time.time() - start


def query_time(spark, sf: str, name: str) -> float:
    start = time.time()
    QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
    return time.time() - start


def rates(spark, sf: str, took: dict[str, float]) -> dict[str, float]:
    """Rows, tokens, queries and pairs a second, of times in ``took`` (missing ones are measured)."""
    sec = lambda name: took.get(name) or query_time(spark, sf, name)
    items = A.items(spark, sf)
    n = items.count()
    batch = Q._batch(spark, sf).count()
    tokens = S.postings(items).agg(F.sum(F.size("places"))).first()[0]
    vectors = items.where("embedding IS NOT NULL AND deleted_at IS NULL").count()
    asked = items.where("id % 50 = 0 AND embedding IS NOT NULL").count()
    both = A.before(spark, sf).count() + A.after(spark, sf).count()
    hundred = rows_as_queries(items, max(1, n // 100)).limit(100)
    m = hundred.count()
    return {
        "merge_rows_per_s": round(batch / sec("m1_upsert")),
        "index_tokens_per_s": round(tokens / sec("s1_postings")),
        "bm25_queries_per_s": round(m / timed(S.search(items, hundred)), 2),
        "bm25_queries": m,
        "cosine_pairs_per_s": round(vectors * asked / sec("v1_cosine_top")),
        "diff_rows_per_s": round(both / sec("d4_multiset_difference")),
    }


def main() -> None:
    sf, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    spark = session(f"local[{cpus}]", int(cpus))
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf}/documents.parquet").count()
    took = {name: round(query_time(spark, sf, name), 3) for name in HEADLINE}
    measured = {Path(sf).name: rates(spark, sf, took)}
    small = Path(sf).with_name(SMALLER.get(Path(sf).name, "none"))
    if small.exists():
        measured[small.name] = rates(spark, str(small), {})
    print(json.dumps({"metric": "headline queries, wall time", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf, "rates": measured, "cpus": int(cpus), "spark": pyspark.__version__}))


if __name__ == "__main__":
    main()
