"""Each operator against brute force on small tables with awkward rows."""

import collections
import hashlib
import json
import re
import string
import zlib

import numpy as np
import public_tokenizers as P
import pytest

from satchel.llm import bpe, chat, decontaminate, fmdedup, media, neardup, repeats, sharding, suffixdedup, tokenstore

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def corpus():
    rng = np.random.default_rng(3)
    vocabulary = ["".join(rng.choice(list("abcdefghié漢"), rng.integers(2, 8))) for _ in range(400)]
    text = lambda n: " ".join(vocabulary[k] for k in rng.integers(0, 400, n))
    passage = text(70)
    rows = [None, "", " \n\t", "Short", "a b c", text(300), "x" * 3000, " " * 700, "ab" * 900]
    base = text(200).split()
    for k in range(12):
        near = list(base)
        near[int(rng.integers(0, 200))] = f"edit{k}"
        rows.append(" ".join(near))
    rows += [f"{text(40)} {passage} {text(30)}" for _ in range(3)] + [f"{passage} {passage}", passage, passage]
    rows += [text(5000), text(5000)]
    docs = list(enumerate(rows)) + [(500, rows[5]), (501, None), (502, rows[5])]
    return docs + [docs[9]]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, f"k{i}", "other") for i, t in corpus()], "doc_id long, text string, kept string, n_tokens string").repartition(5)


def covered(seqs, size):
    n = collections.Counter(s[i : i + size] for s in seqs for i in range(len(s) - size + 1))
    out = []
    for s in seqs:
        m = np.zeros(len(s) + 1, int)
        for i in range(len(s) - size + 1):
            if n[s[i : i + size]] > 1:
                m[i] += 1
                m[i + size] -= 1
        out.append(np.cumsum(m[:-1]) > 0)
    return out


@pytest.mark.parametrize("limit", [1, 3, 1024])
def test_suffix_dedup(docs, limit):
    texts = [(i, (t or "").encode()) for i, t in corpus()]
    want = sorted((i, len(b), int(m.sum()), len(repeats.spans(m)[0]), hashlib.sha256(np.frombuffer(b, np.uint8)[~m].tobytes()).hexdigest()) for (i, b), m in zip(texts, covered([b for _, b in texts], 200), strict=True))
    got = repeats.removed(docs.select("doc_id", "text"), suffixdedup.kind_of(200), suffixdedup.keep_bytes, limit).select("row.doc_id", "*").collect()
    assert sorted((r.doc_id, r.n_symbols, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == want


@pytest.mark.parametrize("limit", [1, 3, 1024])
def test_fm_dedup(docs, limit):
    texts = [(i, tuple(WORDS.findall(t or ""))) for i, t in corpus()]
    want = sorted((i, len(w), int(m.sum()), hashlib.sha256(" ".join(x for x, o in zip(w, m, strict=True) if not o).encode()).hexdigest()) for (i, w), m in zip(texts, covered([w for _, w in texts], 35), strict=True))
    got = repeats.removed(docs.select("doc_id", "text"), fmdedup.kind_of(35), fmdedup.keep_words, limit).select("row.doc_id", "*").collect()
    assert sorted((r.doc_id, r.n_symbols, r.n_removed, r.kept_sha256) for r in got) == want


def test_long_rows_are_scanned_in_blocks(monkeypatch):
    x = np.random.default_rng(0).integers(0, 3, 5000).astype(np.uint64)
    offsets = np.array([0, 0, 40, 3000, 3001, 5000])
    windows = lambda found: sorted((int(r), int(p) + k) for r, p, n, _, _ in zip(*found, strict=True) for k in range(n))
    whole = windows(repeats.runs(x, offsets, 50, 4))
    monkeypatch.setattr(repeats, "BLOCK", 700)
    assert windows(repeats.runs(x, offsets, 50, 4)) == whole == sorted((r, p) for r in range(5) for p in range(int(np.diff(offsets)[r]) - 49))


def test_deduplicated_text_is_whole_characters(docs):
    out = {r.doc_id: r.text for r in suffixdedup.deduplicated(docs).collect()}
    assert out[0] is None and out[3] == "Short" and out[5] == "" and docs.columns == suffixdedup.deduplicated(docs).columns


@pytest.mark.parametrize(("width", "block", "block_bytes"), [(4, 2048, 8 << 20), (5, 3, 4000), (4, 2, 1)])
def test_near_duplicates(docs, width, block, block_bytes):
    sets = []
    for i, t in corpus():
        w = WORDS.findall((t or "").translate(LOW))
        sets.append((i, {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} - {()}))
    least = {i: i for i, _ in sets}
    find = lambda i: i if least[i] == i else find(least[i])
    for i, a in sets:
        for j, b in sets:
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = find(i), find(j)
                least[max(x, y)] = min(x, y)
    got = neardup.near_duplicates(docs.select("doc_id", "text"), width, block, block_bytes).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted((i, len(s), find(i)) for i, s in sets)


def test_forest_links_what_is_linked():
    near = {(0, 3), (3, 5), (1, 2)}
    found = neardup.forest(6, lambda k, others: np.array([(min(k, o), max(k, o)) in near for o in others.tolist()]))
    assert {tuple(sorted(x)) for x in found} == near


def test_odd_sketch_estimates(spark):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 500).astype(np.uint64)
    near, far = base.copy(), base.copy()
    near[:40], far[:300] = rng.integers(0, 2**63, 40), rng.integers(0, 2**63, 300)
    _, sketch = neardup.signatures([np.unique(x) for x in (base, near, far)])
    different = [int(np.bitwise_count(sketch[0] ^ s).sum()) for s in sketch]
    assert different[0] == 0 and different[1] <= neardup.MOST_DIFFERENT < different[2]


def test_decontamination(spark, docs):
    long = corpus()[5][1].split()
    items = [(1, " ".join(long[20:45])), (10, "Short"), (2, None), (3, " .,"), (4, " ".join(long[20:45])), (7, "a B. c!"), (8, "nowhere to be found in any of these at all ever"), (9, "Ékç ΑΣ ÀB")]
    odd = [(700, "x ékç ΑΣ Àb"), (701, "y Ékç ΑΣ ÀB z"), (702, ". Ékç  ΑΣ'ÀB"), (703, "...."), (704, "ΑΣ"), (705, "A b-C")]
    docs = docs.unionByName(spark.createDataFrame([(i, t, "k", "other") for i, t in odd], docs.schema))
    got = decontaminate.hits(docs, spark.createDataFrame(items, "item_id long, text string"))
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = {}
    for i, t in items:
        w = word.findall((t or "").translate(LOW))
        windows[i] = {tuple(w[k : k + 10]) for k in range(max(1, len(w) - 9))} if w else set()
    want = []
    for i, t in corpus() + odd:
        w = word.findall((t or "").translate(LOW))
        hit, ids = set(), set()
        for item, ws in windows.items():
            for x in ws:
                for k in range(len(w) - len(x) + 1):
                    if tuple(w[k : k + len(x)]) == x:
                        hit |= set(range(k, k + len(x)))
                        ids.add(str(item))
        want.append((i, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    assert sorted((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got.collect()) == sorted(want)
    assert "kept" in got.columns


def test_bpe_round_trip(docs, monkeypatch):
    path = P.path("byte_bpe_multi_50k.tiktoken")
    whole = bpe.encoder(path, P.PATTERN)
    for t in ["a  b\n\n c", "x" * 50 + " yé 漢字 \t\n z", " lead", "trail  "]:
        for limit in (1, 2, 3, 5):
            cut = bpe.parts(t, limit)
            assert "".join(cut) == t and [i for p in cut for i in whole.encode_ordinary(p)] == whole.encode_ordinary(t)
    got = {r.doc_id: r for r in bpe.round_trip(docs, path, P.PATTERN, keep_ids=True).collect()}
    for i, t in corpus():
        ids = whole.encode_ordinary(t or "")
        assert (got[i].n_tokens, got[i].ids) == (len(ids), ids) and got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    decoded = bpe.decode(bpe.encode(docs, path, P.PATTERN), path, P.PATTERN).collect()
    assert all(bytes(r.decoded).decode() == (r.text or "") for r in decoded)


def test_token_store(spark, docs):
    from tokenizers import Tokenizer

    extra = [(900, "a  b\t c \n\n d"), (901, "  lead <|endoftext|> x"), (902, "tail \n")]
    given = docs.select("doc_id", "text").unionByName(spark.createDataFrame(extra, "doc_id long, text string"))
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    rows = sorted((i, t.encode(x or "", add_special_tokens=False).ids + [0]) for i, x in corpus() + extra)
    starts = np.cumsum([0, *(len(x) for _, x in rows)])
    raw = [np.array(x, "<u4").tobytes() for _, x in rows]
    chunks, recipes, manifests = tokenstore.write_store(given, P.path("byte_bpe_50k.json"))
    got = sorted(tokenstore.read_store(chunks, recipes, manifests).collect(), key=lambda r: (r.doc_id, r.start))
    assert [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got] == [(i, s, len(x), zlib.crc32(b)) for (i, x), s, b in zip(rows, starts.tolist(), raw, strict=False)]
    assert sorted(bytes(r.ids) for r in tokenstore.reconstruct(chunks, recipes, manifests).collect()) == sorted(raw)
    assert chunks.count() == chunks.select("chunk").distinct().count()
    assert manifests.agg({"n_tokens": "sum"}).first()[0] == starts[-1]


def test_media(docs):
    got = sorted((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.media_sha256, r.feature) for r in media.media_columns(docs).collect())
    want = []
    for i, t in corpus():
        p = media.payload((t or "").encode())
        f = media.wav_head(len(p)) + p
        assert media.samples_of(f) == p
        want.append((i, len((t or "").encode()), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), hashlib.sha256(f).hexdigest(), media.feature(p)))
    assert got == sorted(want)


def test_sharding(spark, docs):
    names, slots = [f"s{k}" for k in range(7)], 101
    owner = sharding.claims(names, slots)
    drawn = lambda s, w: int(hashlib.md5(f"{s}/{w}".encode()).hexdigest()[:15], 16)
    free, want, turn = set(range(slots)), [-1] * slots, 0
    while free:
        i = turn % 7
        pick = next(s for j in range(slots) if (s := (drawn(names[i], "offset") % slots + j * (drawn(names[i], "skip") % (slots - 1) + 1)) % slots) in free)
        free.remove(pick)
        want[pick], turn = i, turn + 1
    assert owner == want
    placed = sharding.place(docs, ["doc_id"], sharding.lookup_table(spark, names, slots), slots).collect()
    assert len(placed) == len(corpus())
    for r in placed:
        slot = int(hashlib.md5(json.dumps([str(r.doc_id)], separators=(",", ":")).encode()).hexdigest()[:15], 16) % slots
        assert (r.slot, r.shard) == (slot, names[owner[slot]])
    assert sharding.lookup_table(spark, [], 7).count() == 0
    assert sharding.place(docs.limit(0), ["doc_id"], sharding.lookup_table(spark, names, slots), slots).count() == 0


def test_chat(spark):
    rows = [(1, 0, "user", "hi \\h # <"), (1, 1, "assistant", "### Assistant: </turn> \\"), (1, 2, "user", None), (2, 0, "system", "only"), (3, 1, "assistant", "a"), (3, 0, "assistant", ""), (3, 1, "assistant", "a"), (None, 0, None, "x: y"), (4, 0, "assistant", "long " * 9000)]
    made = chat.examples(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = {r.conv_id: r for r in chat.digests(made).collect()}
    for c in {r[0] for r in rows}:
        turns = sorted((t, r or "", x or "") for i, t, r, x in rows if i == c)
        loss = "".join(x for _, r, x in turns if r == "assistant")
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest()
        assert (got[c].n_turns, got[c].loss_chars, got[c].loss_sha256) == (len(turns), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert made.where("conv_id = 3").count() == 3


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([], "item_id long, text string")
    assert suffixdedup.deduplicated(none).count() == 0
    assert fmdedup.deduplicated(none).count() == 0
    assert neardup.near_duplicates(none).count() == 0
    assert media.media_columns(none).count() == 0
    assert decontaminate.hits(none, items).count() == 0
    assert bpe.round_trip(none, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN).count() == 0
    assert chat.digests(chat.examples(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).count() == 0
    assert tokenstore.read_store(*tokenstore.write_store(none, P.path("byte_bpe_50k.json"))).count() == 0
