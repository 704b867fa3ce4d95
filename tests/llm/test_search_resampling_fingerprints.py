"""Operators 11 to 13 against plain Python, and their edge cases."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from rankfold.llm import fingerprints as P
from rankfold.llm import lexical_search as L
from rankfold.llm import resampling as R

UPPER = {c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def lowered(text):
    return (text or "").translate(str.maketrans(UPPER))


def words(rng, n, pool=60):
    return " ".join(rng.choice(["Ä", "x", "İz", "10", ""]) + f"w{int(rng.paretovariate(1)) % pool}" for _ in range(n))


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(3)
    rows = [(k, words(rng, rng.choice([0, 1, 3, 25, 80, 400]))) for k in range(300)]
    rows += [(300 + k, rows[7][1]) for k in range(120)]  # copies
    rows += [(500, None), (501, ""), (502, "... --- ..."), (None, words(rng, 30)), (503, "w1"), (503, "w1"), (504, "w1 " * 5000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    clashing = docs.selectExpr("doc_id", "text", "text as term", "1 as n", "doc_id as score", "1 as shard", "3 as rank", "text as bucket", "0 as _range", "1 as weight", "2 as _row")
    return rows, clashing


# --- 11


def search_by_hand(rows, items, k=20):
    cut = re.compile(L.GAP.replace("[", "[^") + "+")
    counts = [(i, collections.Counter(cut.findall(lowered(t)))) for i, t in rows]
    n_docs = sum(1 for _, c in counts if c)
    n_terms = sum(sum(c.values()) for _, c in counts)
    df = collections.Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        asked = cut.findall(lowered(text))
        found = []
        for doc, c in counts:
            m = 75 + 25 * sum(c.values()) * n_docs // max(n_terms, 1)
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t in asked if c[t])
            if score > 0:
                found.append((-score, doc is None, doc))
        out += [(item, r, doc, -s) for r, (s, _, doc) in enumerate(sorted(found, key=lambda f: (f[0], f[1], f[2] or 0))[:k], 1)]
    return sorted(out, key=str)


ITEMS = [(1, "w1 w2 w2 İzw3"), (2, "W5 10w7 Äw1"), (3, None), (4, ""), (5, "nowhere"), (6, "w59 " * 3 + "w1"), (None, "xw2 w9")]


def test_search_equals_scoring_every_document(spark, corpus):
    rows, docs = corpus
    got = L.search(docs, spark.createDataFrame([(*i, 1) for i in ITEMS], "item_id long, text string, rank int"))
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=str) == search_by_hand(rows, ITEMS)


def test_search_with_small_blocks_shards_and_item_blocks(spark, corpus, monkeypatch):
    rows, docs = corpus
    for name, value in (("BLOCK", 3), ("SHARD_CHARS", 900), ("SHARD_DOCS", 9), ("WINDOW", 40), ("ITEM_CHARS", 20), ("STRETCHES", 1)):
        monkeypatch.setattr(L, name, value)
    items = [i for i in ITEMS if i[0] != 4]
    got = L.search(docs.coalesce(2), spark.createDataFrame(items + items[:1], "item_id long, text string"), k=7)
    assert sorted(map(tuple, got.collect()), key=str) == search_by_hand(rows, items, 7)


def test_blocks_below_the_threshold_stay_packed():
    rng = random.Random(1)
    texts = ["rare common " + "filler " * rng.randrange(5, 60) if k in (40, 41) else "common " + "filler " * rng.randrange(5, 400) for k in range(20_000)]
    batch = L.shard_batch("s", list(range(len(texts))), texts, len(texts), sum(len(t.split()) for t in texts))
    rows = {t: (np.array(a), np.array(b), c) for t, a, b, c in zip(*(batch.column(k).to_pylist() for k in (1, 3, 4, 5))) if t}
    norms = np.array(batch.column(7)[-1].as_py())
    one = L.Shard(np.arange(len(texts)), norms, rows)
    none = np.zeros(0, np.int64)
    scores, ids = one.search({"rare": 9000, "common": 40}, (none, none), 2)
    assert sorted(ids.tolist()) == [40, 41] and one.passed > 100
    assert one.unpacked < 0.2 * sum(len(r[2]) for t, r in rows.items() if t in ("rare", "common"))


def test_blocks_round_trip():
    rng = np.random.default_rng(5)
    places = np.sort(rng.choice(10_000_000, 1000, replace=False))
    tf = rng.integers(1, 70_000, 1000)
    starts = np.arange(0, 1000, 128)
    steps = np.diff(places, prepend=0)
    steps[starts] = places[starts]
    packed, offsets = L.pack_blocks(steps, tf, starts)
    back = [L.unpack_block(packed[a:b].tobytes()) for a, b in zip(offsets, offsets[1:])]
    assert np.array_equal(np.concatenate([p for p, _ in back]), places) and np.array_equal(np.concatenate([t for _, t in back]), tf)


def test_search_of_empty_tables(spark, corpus):
    none, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame(ITEMS, "item_id long, text string")
    assert L.search(none, items).count() == 0 and L.search(corpus[1], items.limit(0)).count() == 0


def test_long_text_in_windows():
    text = "".join(f"w{k % 97} " for k in range(300_000)) + "x" * 5000
    whole, cut = L.postings_of([text]), L.postings_of([text], 10_000)
    assert dict(zip([whole[0][t] for t in whole[1]], whole[3].tolist())) == dict(zip([cut[0][t] for t in cut[1]], cut[3].tolist()))
    assert whole[4].tolist() == cut[4].tolist() == [300_001]


# --- 12


def resample_by_hand(rows, target, percent, least, buckets, ngrams, seed):
    gap = re.compile(R.GAP)
    cut = lambda t: [w for w in gap.split(lowered(t)) if w]
    runs = lambda w: [" ".join(w[i : i + k]) for k in range(ngrams[0], ngrams[1] + 1) for i in range(len(w) - k + 1)]
    of = lambda t: [zlib.crc32(f.encode()) % buckets for f in runs(cut(t))]
    s, t = (collections.Counter(b for x in texts for b in of(x)) for texts in ([x for _, x in rows], target))
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s_all + buckets) / ((s[b] + 1) * (t_all + buckets)))) for b in range(buckets)]
    out = []
    for doc, text in rows:
        weight = sum(gain[b] for b in of(text))
        h = int(hashlib.sha256(f"{seed}:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        out.append([doc, len(of(text)), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None, len(cut(text))])
    fit = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(fit[: percent * len(fit) // 100], 1):
        r[4] = k
    return sorted((tuple(r[:5]) for r in out), key=str)


@pytest.mark.parametrize("ngrams, percent", [((1, 1), 10), ((1, 2), 100), ((2, 3), 37)])
def test_resampling_equals_plain_python(spark, corpus, monkeypatch, ngrams, percent):
    monkeypatch.setattr(R, "RANKED_ROWS", 20)  # many ranges
    rows, docs = corpus
    target = spark.createDataFrame([("w1 w2 Xw3",), (None,), ("İzw5 w5 w5",)], "text string")
    got = R.resample(docs, target, percent=percent, ngrams=ngrams, buckets=97)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    want = resample_by_hand(rows, [r[0] for r in target.collect()], percent, 20, 97, ngrams, 2024)
    assert sorted(map(tuple, got.collect()), key=str) == want == sorted(map(tuple, got.collect()), key=str)


def test_resampling_of_empty_tables(spark, corpus):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert R.resample(none, corpus[1]).count() == 0
    got = R.resample(corpus[1], none.select("text"))
    assert got.count() == len(corpus[0]) and got.where("rank is not null").count() > 0


def test_resampling_ties_go_to_smaller_ids(spark):
    docs = spark.createDataFrame([(k, "same words " * 15) for k in range(200)], "doc_id long, text string")
    got = [(r.rank, r.score, r.doc_id) for r in R.resample(docs, docs.select("text"), percent=50).where("rank is not null").orderBy("rank").collect()]
    assert [r[0] for r in got] == list(range(1, 101))
    assert got == [(k, s, d) for k, (_, d, s) in enumerate(sorted((-s, d, s) for _, s, d in got), 1)]


def test_resampling_plan_has_no_python(spark, corpus):
    plan = R.scored(corpus[1], corpus[1].select("text"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Generate" not in plan


# --- 13


def cells_by_hand(data):
    out = []
    for a in range(len(data) - P.WIDTH + 1):
        counts = collections.Counter(data[a : a + P.WIDTH])
        sums = sum(int(P._GROWTH[1 : c + 1].sum()) for c in counts.values())
        out.append((P._MOST - sums) * (P.CELLS - 1) // P._MOST)
    return out


def selected_by_hand(data, ranks):
    cells, wins = cells_by_hand(data), collections.Counter()
    for a in range(1 - P.RUN, len(cells)):
        run = range(max(a, 0), min(a + P.RUN, len(cells)))
        if len(run):
            wins[min(run, key=lambda i: (ranks[cells[i]], i))] += 1
    return sorted(i for i, n in wins.items() if n >= P.WINS)


def test_selected_windows_equal_plain_python(corpus):
    texts = [(t or "").encode() for _, t in corpus[0][:120]] + [b"", b"a", b"a" * 200, bytes(range(97, 121))]
    counts = P.cell_counts(texts)
    plain = collections.Counter(c for t in texts for c in cells_by_hand(t))
    assert {k: n for k, n in enumerate(counts.tolist()) if n} == dict(plain)
    ranks = P.ranks_of(counts)
    for text in texts:
        data, _, valid = P._joined([text])
        assert P.selected(data, valid, ranks).tolist() == selected_by_hand(text, ranks)


def test_entropy_is_shannons():
    rng = random.Random(2)
    data = bytes(rng.choice(b"aaabcdefgh ") for _ in range(500))
    for a, cell in enumerate(P.entropy_cells(np.frombuffer(data, np.uint8)).tolist()):
        counts = collections.Counter(data[a : a + P.WIDTH]).values()
        share = -sum(c / P.WIDTH * math.log2(c / P.WIDTH) for c in counts) / math.log2(P.WIDTH)
        assert abs(cell - share * (P.CELLS - 1)) < 1.01


def test_pieces_change_nothing():
    rng = random.Random(4)
    texts = [words(rng, n).encode() for n in (0, 1, 5, 30, 3000, 700)]
    counts = P.cell_counts(texts)
    assert np.array_equal(counts, P.cell_counts(texts, 333))
    ranks = P.ranks_of(counts)
    for a, b in zip(P.features(texts, ranks), P.features(texts, ranks, 333)):
        assert np.array_equal(a, b)


def test_chain_of_filters():
    h = P._mixed(np.arange(1, 1001, dtype=np.uint64))
    filters = P.digest(h)
    assert len(filters) == 7  # 160 features each
    bits = {(k // P.FILTER, int(x) >> (11 * j) & 2047) for k, x in enumerate(h) for j in range(P.BITS)}
    assert bits == {(r, b) for r in range(7) for b in range(2048) if filters[r, b >> 3] >> (b & 7) & 1}
    whole = P.written(filters, 1000)
    n, back = P.read(whole)
    assert n == 1000 and np.array_equal(back, filters)
    assert P.likeness(whole, P.written(P.digest(h[:500]), 500)) > 0.9
    other = P.written(P.digest(P._mixed(np.arange(5001, 6001, dtype=np.uint64))), 1000)
    assert P.likeness(whole, other) < 0.1 and P.likeness(whole, other) == P.likeness(other, whole)


def by_hand(rows):
    rows = [(d, t or "") for d, t in rows]
    edit = lambda t, f: t[: len(t) - len(t) // 4] + f[: len(t) // 4]
    return [(d, len(t), hashlib.sha256(edit(t, rows[(k + 1) % len(rows)][1]).encode()).hexdigest()) for k, (d, t) in enumerate(rows)]


@pytest.mark.parametrize("wanted", [1, 5, 40])
def test_fingerprints_meet_the_next_document(spark, corpus, wanted):
    rows, docs = corpus
    got = P.fingerprints(docs, wanted).collect()
    ordered = sorted((r for r in rows), key=lambda r: (r[0] is not None, r[0] or 0))
    assert sorted((tuple(r)[0:2] + (r.edited_sha256,) for r in got), key=str) == sorted(by_hand(ordered), key=str)
    ranks = P.corpus_ranks(docs)
    prints = dict(zip([t for _, t in rows], P.fingerprints_of([t or "" for _, t in rows], ranks)))
    texts = dict((d, t) for d, t in rows)
    following = {a[0]: b[1] or "" for a, b in zip(ordered, [*ordered[1:], *ordered[:1]])}
    for r in got:
        assert r.fingerprint == prints[texts[r.doc_id]][0] and 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        if r.doc_id != 503:  # stands twice
            changed, = P.fingerprints_of([P.edited(texts[r.doc_id] or "", following[r.doc_id])], ranks)
            assert r.edited_fingerprint == changed[0] and r.near_edited == P.likeness(r.fingerprint, changed[0])
            assert r.near_next == P.likeness(r.fingerprint, P.fingerprints_of([following[r.doc_id]], ranks)[0][0])


def test_fingerprints_of_few_documents(spark):
    schema = "doc_id long, text string"
    assert P.fingerprints(spark.createDataFrame([], schema)).count() == 0
    one, = P.fingerprints(spark.createDataFrame([(4, "alone in the world")], schema)).collect()
    assert one.near_next == 1.0 and one.edited_sha256 == hashlib.sha256(b"alone in the w" + b"alon").hexdigest()
    empty = P.fingerprints(spark.createDataFrame([(1, None), (2, "")], schema)).collect()
    assert [(r.fingerprint, r.near_edited, r.near_next) for r in empty] == [("0:", 1.0, 1.0)] * 2


def test_edited_texts_stay_near_and_others_do_not(spark):
    rng = random.Random(9)
    letters = "etaoinshrdlucmfw"
    vocabulary = ["".join(rng.choice(letters) for _ in range(rng.randrange(2, 9))) for _ in range(5000)]
    docs = [(k, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(30, 600)))) for k in range(150)]
    got = P.fingerprints(spark.createDataFrame(docs, "doc_id long, text string"), 3).collect()
    assert min(r.near_edited for r in got) > 0.45 and max(r.near_next for r in got) < 0.3
