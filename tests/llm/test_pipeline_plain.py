"""Every stage of the pipeline against a plain version of it, rows and texts, on planted documents."""

import collections
import hashlib
import re
import string

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline as C
import public_tokenizers as P
from satchel.llm import bpe, quality
from satchel.llm.shared import written

LOW = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = np.random.default_rng(11)
    vocabulary = ["".join(rng.choice(list("abcdefghijklmnoé"), rng.integers(2, 9))) for _ in range(500)]
    text = lambda n: " ".join(vocabulary[k] for k in rng.integers(0, 500, n))
    base, passage, leak = text(150), text(60), text(25)
    rows = [text(120) for _ in range(24)] + ["".join(rng.choice(list("#$%|!0"), 300)) for _ in range(8)]
    rows += [base, base, base + " one more word", f"{text(2)} {base}"]  # copies
    rows += [f"{text(30)} {passage} {text(30)}" for _ in range(3)] + [f"{text(20)} {leak} {text(20)}"]
    rows += [None, "", "short text", "short text"]
    docs = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(rows)] + [(5, rows[5], "en", "s", 1), (None, text(90), "en", "s", 2)]
    labels = [(i, int(i < 24), 0) for i in range(32)]
    items = [("b1", leak), ("b2", "no words of it anywhere else at all in here 1 2 3"), ("b3", None)]
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id string, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def plain_quality(spark, rows, path):
    docs, labels = spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/labels.parquet")
    m = quality.train(docs, labels)
    out = []
    for r in rows:
        x = quality.features(pa.array([r[1] or ""]))[0]
        z = sum(max(-8.0, min(8.0, (float(a) - float(u)) / float(s))) * float(w) for a, u, s, w in zip(x, m.mean, m.scale, m.w, strict=True)) + m.b
        if 1 / (1 + np.exp(-z)) >= 0.3:
            out.append(r)
    return out


def plain_near(spark, rows, path):
    sets = []
    for r in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (r[1] or "").translate(LOW))
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()})
    group = list(range(len(rows)))
    for _ in rows:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if a and b and 100 * len(a & b) >= 80 * len(a | b):
                    group[i] = group[j] = min(group[i], group[j])
    out = []
    for g in sorted(set(group)):
        members = [rows[i] for i in range(len(rows)) if group[i] == g]
        out.append(min(members, key=lambda r: (-(2**63) if r[0] is None else r[0])))
    return out


def plain_repeats(spark, rows, path):
    raw = [(r[1] or "").encode() for r in rows]
    n = collections.Counter(b[k : k + 200] for b in raw for k in range(len(b) - 199))
    out = []
    for r, b in zip(rows, raw, strict=True):
        gone = set()
        for k in range(len(b) - 199):
            if n[b[k : k + 200]] > 1:
                gone |= set(range(k, k + 200))
        if not gone:
            out.append((*r[:4], None if r[1] is None else len(r[1])))
            continue
        at, kept = 0, ""
        for c in r[1]:
            size = len(c.encode())
            kept += "" if gone & set(range(at, at + size)) else c
            at += size
        out.append((r[0], kept, *r[2:4], len(kept)))
    return out


def plain_leaks(spark, rows, path):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOW))
    items = [words(r.text) for r in spark.read.parquet(f"{path}/benchmark.parquet").collect()]
    windows = {tuple(w[k : k + 10]) for w in items if w for k in range(max(1, len(w) - 9))}
    return [r for r in rows if not any(tuple(w[k : k + len(x)]) == x for w in [words(r[1])] for x in windows for k in range(len(w) - len(x) + 1))]


def test_every_stage(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = [tuple(r) for r in docs.collect()]
    order = lambda rs: sorted(rs, key=repr)
    for (name, stage), plain in zip(C.STAGES, (plain_quality, plain_near, plain_repeats, plain_leaks), strict=False):
        before = len(rows)
        rows = plain(spark, rows, folder)
        docs = written(stage(spark, docs, folder), name.replace(" ", "_"))
        assert order(tuple(r) for r in docs.collect()) == order(rows), name
        assert name == "suffix-array dedup" or len(rows) < before, name
    enc = bpe.encoder(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    out = C.STAGES[-1][1](spark, docs, folder).collect()
    want = {(r[0], tuple(enc.encode_ordinary(r[1] or "")), hashlib.sha256((r[1] or "").encode()).hexdigest()) for r in rows}
    assert {(r.doc_id, tuple(r.ids), r.decoded_sha256) for r in out} == want and len(out) == len(rows)
