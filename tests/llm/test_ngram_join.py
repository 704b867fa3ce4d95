import random

import numpy as np
import pytest

from rankfold.llm import ngram_join
from rankfold.llm.ngram_join import jaccard_join, prefix_length, required, tree_join
from rankfold.llm.shingles import shingle_sets

SCHEMA = "doc_id long, text string, component_id string"


def grams(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ")
    words = [w for w in words if w]
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def brute(rows, percent=75):
    sets = [grams(t) for _, t, *_ in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    least = {}
    for i in range(len(rows)):
        least[find(i)] = min(least.get(find(i), rows[i][0]), rows[i][0])
    return sorted((rows[i][0], len(sets[i]), least[find(i)]) for i in range(len(rows)))


def corpus(seed, groups=6, size=40):
    r = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    passage = [r.choice(vocabulary) for _ in range(30)]
    out = []
    for g in range(groups):
        base = [r.choice(vocabulary) for _ in range(r.randint(20, 90))] + (passage if g % 2 else [])
        for _ in range(r.choice([1, 2, size])):
            words = list(base)
            for _ in range(r.randint(0, 5)):
                words[r.randrange(len(words))] = r.choice(vocabulary)
            out.append(" ".join(words[: r.choice([len(words), len(words), len(words) - 4])]))
    out += ["", " \t", "one two", "One  TWO", "Ärger ärger", "é É é É é É", None, "a " * 3000, "a " * 3001]
    r.shuffle(out)
    return [(k * 3 + 1, t, "x") for k, t in enumerate(out)]


def answer(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("block", [4, 512])
def test_against_brute_force(spark, seed, block):
    """block=4 makes meeting points of many blocks, whose strangers are compared with every block."""
    rows = corpus(seed)
    got = jaccard_join(spark.createDataFrame(rows, SCHEMA).repartition(3), block=block)
    assert answer(got) == brute(rows)


def test_joins_by_key_where_nothing_may_be_broadcast(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BROADCAST_ROWS", 0)
    rows = corpus(5)
    assert answer(jaccard_join(spark.createDataFrame(rows, SCHEMA), block=8, chunk=200)) == brute(rows)


def test_documents_that_link_with_none_meet_nobody(spark):
    """Chance meetings of n-grams leave no rows, at either size; the copies of one text leave about a row each."""
    for size in (200, 1000):
        r = random.Random(size)
        rows = [(k, " ".join(r.choice("abcdefghijklmnop") for _ in range(60))) for k in range(size)]
        copy = " ".join(r.choice("abcdefghijklmnop") for _ in range(60))
        rows += [(size + k, f"{copy} {k}") for k in range(size // 10)]
        points, sizes = ngram_join.meeting_points(spark.createDataFrame(rows, "rep long, body string"), 5, 75, 4, 500)
        assert sizes.count() == len(rows)
        found = {tuple(x) for x in points.collect()}
        assert {i for i, _ in found} == {i for i, _ in rows[size:]} and len(found) <= 2 * size // 10


def test_words_of_equal_polynomials_do_not_link(spark):
    a = "".join("ab"[bin(k).count("1") % 2] for k in range(2048))
    b = a.translate({97: 98, 98: 97})
    rows = [(1, a, ""), (2, b, ""), (3, f"x y z v {a}", ""), (4, f"x y z v {b}", "")]
    assert answer(jaccard_join(spark.createDataFrame(rows, SCHEMA))) == brute(rows) == [(k, 1, k) for k in (1, 2, 3, 4)]


def test_chain_of_links_is_one_component(spark):
    words = [f"c{k}" for k in range(120)]
    rows = [(k, " ".join(words[k * 5 : k * 5 + 60]), "x") for k in range(12)]
    assert answer(jaccard_join(spark.createDataFrame(rows, SCHEMA), block=3)) == brute(rows)


def test_empty_table_null_ids_and_repeated_rows(spark):
    assert answer(jaccard_join(spark.createDataFrame([], SCHEMA))) == []
    rows = [(None, "a b c d e f", ""), (4, "a b c d e f", ""), (4, "a b c d e f", ""), (9, "x", ""), (7, None, ""), (6, None, "")]
    got = [tuple(r) for r in jaccard_join(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert sorted(got, key=str) == sorted([(None, 2, None), (4, 2, None), (4, 2, None), (9, 1, 9), (7, 0, 7), (6, 0, 6)], key=str)


def test_tree_join_connects_what_all_links_connect():
    r = random.Random(3)
    for _ in range(60):
        sets = [np.array(sorted(r.sample(range(24), r.randint(1, 18))), np.uint64) for _ in range(r.randint(1, 12))]
        root = list(range(len(sets)))

        def joined(pairs):
            part = list(range(len(sets)))
            for a, b in pairs:
                x, y = part[a], part[b]
                part = [min(x, y) if p in (x, y) else p for p in part]
            return part

        every = [(a, b) for a in root for b in root if a < b and 100 * len({*sets[a].tolist()} & {*sets[b].tolist()}) >= 60 * len({*sets[a].tolist()} | {*sets[b].tolist()})]
        a, b = tree_join(sets, 60)
        found = list(zip(a.tolist(), b.tolist()))
        assert all(tuple(sorted(p)) in every for p in found)
        assert joined(found) == joined(every)


def test_bounds():
    for n in range(1, 60):
        assert prefix_length(n, 75) == n - -(-75 * n // 100) + 1 + n // 8
        for m in range(1, 60):
            assert required(n, m, 75) == min(o for o in range(0, n + m + 1) if 100 * o >= 75 * (n + m - o))


def test_shingles_are_the_words_of_the_definition():
    texts = ["a b c d e f", "A b\tc\nd e  f ", "a b c", "", "é b c d e", "a a a a a a a"]
    offsets, hashes = shingle_sets([t.encode() for t in texts])
    sets = [set(hashes[a:b].tolist()) for a, b in zip(offsets, offsets[1:])]
    assert [len(s) for s in sets] == [len(grams(t)) for t in texts]
    assert sets[0] == sets[1] and not sets[2] & sets[0]
