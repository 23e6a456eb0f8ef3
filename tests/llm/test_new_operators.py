"""N-gram join, hard negatives and Merkle manifests against brute force, on awkward rows."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from satchel.llm import jaccard, manifest, negatives
from satchel.llm.registry import QUERIES, SQL
from tests.llm.test_operators import LOW, WORDS, corpus

SF = "/root/testdata/sf0.001"


def shingles(text, width):
    w = WORDS.findall((text or "").translate(LOW))
    return frozenset(tuple(w[k : k + width]) for k in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])


def linked_rows(rows, width):
    """(doc_id, set size, least doc_id reachable), by comparing all pairs that share a shingle."""
    sets = [shingles(t, width) for _, t in rows]
    least = [-(2**63) if i is None else i for i, _ in rows]
    at, top = defaultdict(list), list(range(len(rows)))

    def find(k):
        while top[k] != k:
            k = top[k]
        return k

    for k, s in enumerate(sets):
        both = Counter(m for g in s for m in at[g])
        for m, n in both.items():
            if 100 * n >= 80 * (len(s) + len(sets[m]) - n):
                top[find(k)] = find(m)
        for g in s:
            at[g].append(k)
    best = {}
    for k, i in enumerate(least):
        best[find(k)] = min(best.get(find(k), i), i)
    return sorted((least[k], len(sets[k]), best[find(k)]) for k in range(len(rows)))


def near_copies():
    """Groups of near copies, chains of edits, boilerplate of shared passages, sizes around bounds."""
    rng = np.random.default_rng(5)
    word = lambda n: [f"w{k}" for k in rng.integers(0, 3000, n)]
    out, passages = [], [word(60) for _ in range(12)]
    base = word(180)
    for k in range(150):
        now = list(base)
        for at in rng.integers(0, 180, int(rng.integers(0, 8))):
            now[at] = f"e{k}"
        out.append(now)
    chain = word(120)
    for k in range(40):
        chain = list(chain)
        chain[int(rng.integers(0, 120))] = f"c{k}"
        out.append(chain)
    out += [sum((passages[p] for p in rng.permutation(12)[: int(rng.integers(4, 9))]), []) for _ in range(120)]
    out += [word(n) for n in (1, 2, 4, 5, 6, 9, 10)]
    out += [out[-1][:-1], out[-2] + ["x"], word(4000)]
    out.append([*out[-1][:3990], *word(10)])
    return [(1000 - k, " ".join(w)) for k, w in enumerate(out)]


@pytest.mark.parametrize("rows", [corpus(), near_copies(), [(None, "a b c d e f"), (None, None), (7, "A B c d e f"), (7, "A B c d e f")]], ids=["corpus", "near", "nulls"])
@pytest.mark.parametrize("block_bytes", [700, 8 << 20])
def test_jaccard_join(spark, rows, block_bytes):
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, N_SHINGLES int, component_id string").repartition(3)
    got = jaccard.joined(docs, block_bytes=block_bytes).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == linked_rows(rows, 5)


def test_prefixes_lose_no_pair():
    """Sets dealt to two packets: every linked pair shares as many prefix tokens as asked for."""
    sets = [jaccard.shingle_sets(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t)]), 5)[0] for _, t in near_copies()]
    unique = list({jaccard.digest_of(s): s for s in sets}.values())
    halves, names = [unique[::2], unique[1::2]], ["bucket", "packet", "one", "place", "several", "holders"]
    sent = [r for k, half in enumerate(halves) for r in jaccard._packet(k, [jaccard.digest_of(s) for s in half], half, 3)]
    by = lambda rows, c: [jaccard.pa.Table.from_batches([jaccard._rows([r for r in rows if r[c] == v])]) for v in sorted({r[c] for r in rows})]
    back = [tuple(r[n] for n in names) for t in by(sent, 0) for r in jaccard._counted(t).to_pylist()]
    found = {r["digest"]: r for t in by(back, 1) for r in jaccard._prefixes(t).to_pylist()}
    assert max(r["ell"] for r in found.values()) > 1
    pairs = 0
    for k, s in enumerate(unique):
        for t in unique[:k]:
            both = len(np.intersect1d(s, t))
            if 100 * both >= 80 * (len(s) + len(t) - both):
                a, b = found[jaccard.digest_of(s)], found[jaccard.digest_of(t)]
                large, small = (a, b) if a["n"] >= b["n"] else (b, a)
                assert len({*large["tokens"]} & {*small["tokens"][: small["front"]]}) >= min(a["ell"], b["ell"])
                pairs += 1
    assert pairs > 500


def test_jaccard_of_nothing(spark):
    assert jaccard.joined(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def mined(rows, every=5):
    """rows (id, label, vector): all windows by sorting everything."""
    good = [(i, g, [math.floor(256 * x) for x in v]) for i, g, v in rows if i is not None and g is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    dot = lambda a, b: max(-(2**63), min(2**63 - 1, sum(x * y for x, y in zip(a, b))))  # noqa: B905, E731
    out = set()
    for i, g, v in good:
        if i % every:
            continue
        scored = sorted({(-dot(v, w), j, g == h) for j, h, w in good if j != i})
        for s, p, _ in [x for x in scored if x[2]][:5]:
            inside = [x for x in scored if not x[2] and 80 * -s <= 100 * -x[0] <= 100 * -s]
            out |= {(i, p, r, n, -s, -t) for r, (t, n, _) in enumerate(inside[:5], 1)}
    return sorted(out)


def vectors():
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(6, 12))
    rows = [(k, int(g := rng.integers(0, 6)) if k % 9 else int(g) // 2, [float(np.float32(x)) for x in centres[g] + 0.4 * rng.normal(size=12)]) for k in range(400)]
    rows += [(1000 + k, k % 3, [0.5] * 12) for k in range(30)]  # ties
    rows += [(2000, 1, [0.0] * 12), (2005, 2, []), (2010, 2, [0.1] * 5), (2011, 1, [0.9] * 20), (2015, 1, [-0.3] * 12)]
    rows += [(3000, None, [0.1] * 12), (3005, 1, None), (3010, 1, [0.1, None]), (3015, 1, [float("nan")] * 12), (3020, 1, [float("inf")]), (None, 1, [0.5] * 12)]
    return rows + [rows[3], rows[5], rows[400]]


@pytest.mark.parametrize("list_bytes", [2000, 4 << 20])
def test_hard_negatives(spark, list_bytes):
    rows = vectors()
    df = spark.createDataFrame([(*r, "x") for r in rows], "id long, label long, vector array<float>, SCORE string").repartition(3)
    got = negatives.hard_negatives(df, F.col("id") % 5 == 0, list_bytes=list_bytes).collect()
    assert sorted(tuple(r) for r in got) == mined(rows)


def test_hard_negatives_of_large_numbers(spark):
    rows = [(k, k % 2, [float(3e12 + 7 * k), float(-2e11 * k), 5.0]) for k in range(40)]
    df = spark.createDataFrame(rows, "id long, label long, vector array<double>")
    assert sorted(tuple(r) for r in negatives.hard_negatives(df, F.col("id") % 5 == 0).collect()) == mined(rows)
    assert negatives.hard_negatives(df.limit(0), F.col("id") % 5 == 0).collect() == []


def test_threshold_leaves_lists_early():
    rng = np.random.default_rng(2)
    x = np.floor(256 * rng.exponential(size=(5000, 3)))
    order = np.argsort(x.T, axis=1, kind="stable").astype(np.int32)
    found = negatives.Windows.of(np.array([-(2**63)]), np.array([2**63 - 1]))
    a = np.array([1.0, -2.0, 3.0])
    depth = negatives.threshold_algorithm(x, order, np.arange(5000), np.ones(5000, bool), a, found, 5, True)
    s = (x @ a).astype(int)
    assert depth < 2500 and found.row[0].tolist() == np.lexsort((np.arange(5000), -s))[:5].tolist()


def hashed(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def tree_of(digests):
    """(root, way of every leaf): all levels at once."""
    ways, at, level = [[] for _ in digests], list(range(len(digests))), digests
    while len(level) > 1:
        for k, p in enumerate(at):
            first = p - p % 3
            ways[k].append(("".join(level[first:p]), "".join(level[p + 1 : first + 3])))
            at[k] = p // 3
        level = [hashed(*level[k : k + 3]) for k in range(0, len(level), 3)]
    return level[0], ways


def manifest_by_hand(rows):
    groups = defaultdict(list)
    for i, g, leaf, changed in rows:
        groups[g].append((i, leaf, changed))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in names:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        trees[g] = tree_of([r[1] for r in groups[g]])
    root, tops = tree_of([trees[g][0] for g in names])
    out = []
    for g, top in zip(names, tops, strict=True):
        for (i, leaf, changed), way in zip(groups[g], trees[g][1], strict=True):
            whole, now = way + top, changed or leaf
            for b, a in whole:
                now = hashed(b, now, a)
            out.append((i, leaf, trees[g][0], root, hashed(*(b + a for b, a in whole)), now))
    return sorted(out, key=repr)


@pytest.mark.parametrize("levels", [1, 2, 8])
def test_manifest(spark, levels):
    rng = np.random.default_rng(4)
    sizes = {None: 4, "": 1, "a": 200, "b": 27, "é": 28, "z": 3, **{f"s{k}": 1 for k in range(9)}}
    rows = [(None if k == 1 else int(rng.integers(-50, 10**6)), g, hashed(str(g), str(k)), hashed("t", str(k)) if k % 2 else None) for g, n in sizes.items() for k in range(n)]
    rows += [rows[10], rows[10]]
    df = spark.createDataFrame([(*r, 1) for r in rows], "id long, grp string, digest string, changed string, ROOT int").repartition(4)
    got = sorted((tuple(r) for r in manifest.manifest(df, levels).collect()), key=repr)
    assert got == manifest_by_hand(rows)


def test_manifest_of_nothing_and_of_one(spark):
    df = lambda rows: spark.createDataFrame(rows, "id long, grp string, digest string, changed string")
    assert manifest.manifest(df([])).collect() == []
    one = manifest.manifest(df([(5, "g", "ab", None)])).first()
    assert tuple(one) == (5, "ab", "ab", "ab", hashed(""), "ab")


def test_a_version_copies_ancestors_only():
    tree = manifest.Tree([hashed(str(k)) for k in range(3**5)])
    other = tree.version(100, "x")
    shared, new = set(), 0

    def ids(node):
        shared.add(id(node))
        for c in node[1]:
            ids(c)

    ids(tree.root)
    stack = [other]
    while stack:
        node = stack.pop()
        if id(node) not in shared:
            new += 1
            stack += node[1]
    assert new == 6 and tree.version(100, hashed("100")) is tree.root


def test_leaf_of_fields(spark):
    df = spark.createDataFrame([(1, None, "é\n", 7), (None, "s", None, None)], "doc_id long, source string, text string, n int")
    got = [r[0] for r in df.select(manifest.leaf_of([F.col(c) for c in df.columns])).collect()]
    assert got == [hashed("1:1-3:é\n1:7"), hashed("-1:s--")]
    assert spark.range(1).select((F.crc32(F.lit(-12).cast("string").cast("binary")) % 2).alias("x")).first().x == zlib.crc32(b"-12") % 2


@pytest.mark.parametrize("name", ["op11_hard_negatives", "op12_merkle_manifest"])
def test_query_equals_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "embeddings"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = c.execute(SQL[name])
    columns = [d[0] for d in want.description]
    got = QUERIES[name](spark, SF).select(columns)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want.fetchall(), key=repr)
