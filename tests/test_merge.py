"""Merging against a row-by-row checker."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from satchel.operators import state as M

SCHEMA = "provider string, account string, external_id string, url string, title string, publication string, summary string, bookmarked_at long, collection array<string>, created_at long, sort_key long, deleted_at long, starred_at long, embedding array<float>, embedding_model string"
BATCH = "seq long, provider string, account string, external_id string, url string, title string, publication string, summary string, bookmarked_at long, collection array<string>"


def one_by_one(items, batch, now, start):
    table = {(r["provider"], r["account"], r["external_id"]): dict(r) for r in items}
    known, inserted = {(r["provider"], r["external_id"]) for r in items}, 0
    for b in sorted(batch, key=lambda r: r["seq"]):
        key = (b["provider"], b["account"], b["external_id"])
        new = key[::2] not in known
        text = [b[c] or "" for c in ("title", "publication", "summary")]
        old = table.get(key)
        row = old or {"provider": key[0], "account": key[1], "external_id": key[2], "bookmarked_at": None, "collection": [], "created_at": now, "sort_key": start - inserted, "deleted_at": None, "starred_at": None, "embedding": None, "embedding_model": None}
        if old and [old[c] for c in ("title", "publication", "summary")] != text:
            row["embedding"] = row["embedding_model"] = None
        row |= {"url": b["url"] or "", "title": text[0], "publication": text[1], "summary": text[2], "bookmarked_at": (b["bookmarked_at"] or None) or row["bookmarked_at"]}
        names, seen = [], set()
        for n in [*row["collection"], *b["collection"]]:
            if n.strip() and n.strip().lower() not in seen:
                seen.add(n.strip().lower())
                names.append(n.strip())
        row["collection"] = names
        table[key] = row
        known.add(key[::2])
        inserted += new
    return sorted(((k, r["url"], r["title"], r["bookmarked_at"], tuple(r["collection"]), r["created_at"], r["sort_key"], r["embedding_model"]) for k, r in table.items()), key=repr)


ROW = st.tuples(st.sampled_from(["a", "b"]), st.sampled_from(["u", "v"]), st.sampled_from("123"), st.sampled_from([None, "t1", "t2"]), st.sampled_from([None, 0, 5, 9]), st.lists(st.sampled_from(["X", "x ", "Y", ""]), max_size=2))


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(ROW, max_size=7), st.lists(ROW, max_size=3, unique_by=lambda r: r[:3]))
def test_upsert_equals_one_by_one(spark, batch, stored):
    items = [{"provider": p, "account": a, "external_id": e, "url": "", "title": t or "", "publication": "", "summary": "", "bookmarked_at": b or None, "collection": ["X"], "created_at": 1, "sort_key": k, "deleted_at": None, "starred_at": None, "embedding": [1.0], "embedding_model": "m"} for k, (p, a, e, t, b, _) in enumerate(stored)]
    rows = [{"seq": k, "provider": p, "account": a, "external_id": e, "url": f"u{k}", "title": t, "publication": None, "summary": "", "bookmarked_at": b, "collection": c} for k, (p, a, e, t, b, c) in enumerate(batch)]
    frame = lambda r, s: spark.createDataFrame([tuple(x[c.split()[0]] for c in s.split(", ")) for x in r], s)
    out = M.upsert(frame(items, SCHEMA), frame(rows, BATCH), 100, 1000)
    got = sorted((((r.provider, r.account, r.external_id), r.url, r.title, r.bookmarked_at, tuple(r.collection), r.created_at, r.sort_key, r.embedding_model) for r in out.collect()), key=repr)
    assert got == one_by_one(items, rows, 100, 1000)


def test_union_keeps_first_spelling(spark):
    row = spark.range(1).select(M.union_names(F.array(*map(F.lit, ["Watch later", " recipes", "WATCH LATER", "", "Recipes"]))).alias("c")).first()
    assert row.c == ["Watch later", "recipes"]
