"""The token-hash query reads whole texts of all rows."""

import collections

from satchel.catalog import QUERIES
from satchel.operators.embedding import token_hash

SF = "/root/testdata/sf0.001"


def test_token_hash_query_reads_every_whole_text(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    got = collections.defaultdict(dict)
    for r in QUERIES["e2_token_hash_rows"](spark, SF).collect():
        got[r.id][r.bucket] = r.value
    want = {r.doc_id: {k: v for k, v in enumerate(token_hash([r.text])[0].tolist()) if v} for r in docs}
    assert max(len(r.text) for r in docs) > 1000 and got.keys() == want.keys()
    assert all(got[i].keys() == w.keys() and all(abs(got[i][k] - v) < 2e-5 for k, v in w.items()) for i, w in want.items())
