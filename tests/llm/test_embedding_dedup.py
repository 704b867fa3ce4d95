import numpy as np
import pytest

from rankfold.llm import embedding_dedup as E
from rankfold.llm.components import components

SCHEMA = "vec_id long, embedding array<float>, label int, n_links string"


def brute(rows, threshold=0.98):
    def sound(v, label):
        return label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)

    n = len(rows)
    links, root = [0] * n, list(range(n))
    for i in range(n):
        for j in range(i):
            (_, v, a, _), (_, w, b, _) = rows[i], rows[j]
            if sound(v, a) and sound(w, b) and a == b and len(v) == len(w):
                x, y = np.float32(v).astype(float), np.float32(w).astype(float)
                if x @ y / np.sqrt(x @ x) / np.sqrt(y @ y) >= threshold:
                    links[i] += 1
                    links[j] += 1
                    p, q = root[i], root[j]
                    root = [min(p, q) if r in (p, q) else r for r in root]
    ids = [r[0] for r in rows]
    least = [min(ids[k] for k in range(n) if root[k] == root[i]) for i in range(n)]
    return sorted((ids[i], links[i], least[i], ids[i] == least[i]) for i in range(n))


@pytest.mark.parametrize("tile", [8, 1024])
def test_against_brute_force(spark, tile):
    r = np.random.default_rng(5)
    centres = r.normal(size=(6, 16))
    rows = []
    for k in range(150):
        v = centres[k % 6] + r.normal(size=16) * r.choice([0.02, 0.1, 0.3])
        rows.append((k, [float(x) for x in np.float32(v)], int(k % 6 > 2), "x"))
    rows += [(200 + k, rows[0][1], rows[0][2], "x") for k in range(30)]
    rows += [(300, None, 1, ""), (301, [], 1, ""), (302, [0.0] * 16, 1, ""), (303, [float("nan")] * 16, 1, ""), (304, [None] + [1.0] * 15, 1, ""), (305, [float("inf")] * 16, 1, ""), (306, rows[0][1], None, ""), (307, [1.0, 2.0], 1, ""), (308, [2.0, 4.0], 1, ""), (309, [1e-30, 2e-30], 1, ""), (310, [1e30, 2e30], 1, "")]
    got = E.embedding_dedup(spark.createDataFrame(rows, SCHEMA), tile=tile)
    assert sorted(tuple(x) for x in got.collect()) == brute(rows)


def test_empty_table(spark):
    assert E.embedding_dedup(spark.createDataFrame([], SCHEMA)).collect() == []


def test_quantisation_bound_holds():
    r = np.random.default_rng(1)
    x = r.normal(size=(80, 24))
    x /= np.linalg.norm(x, axis=1)[:, None]
    q = E.quantise(x)
    near = (q.steps * q.size[:, None]) @ (q.steps * q.size[:, None]).T
    assert (np.abs(x @ x.T - near) <= q.kept[:, None] * q.lost + q.lost[:, None] * q.kept + q.lost[:, None] * q.lost + 1e-12).all()
    i, j = E.near_pairs(x, x, 0.3, block=7)
    assert set(zip(i.tolist(), j.tolist())) == set(zip(*(k.tolist() for k in np.nonzero(x @ x.T >= 0.3))))


def test_most_pairs_are_decided_by_their_steps():
    """Only pairs within the bounds of the threshold are open, and sure ones are right."""
    r = np.random.default_rng(2)
    x = E.unit(np.concatenate([r.normal(size=(200, 32)), np.repeat(r.normal(size=(4, 32)), 25, axis=0) + r.normal(size=(100, 32)) * 0.05]))
    cosine, pairs, opened = x @ x.T, set(), 0
    for i, j, k, m in E.judged(E.quantise(x), E.quantise(x), 0.98, block=64):
        assert (cosine[i, j] >= 0.98).all() and (np.abs(cosine[k, m] - 0.98) < 0.03).all()
        pairs |= set(zip(i.tolist(), j.tolist())) | set(zip(k.tolist(), m.tolist()))
        opened += len(k)
    assert set(zip(*(c.tolist() for c in np.nonzero(cosine >= 0.98)))) <= pairs and 0 < opened < 0.1 * cosine.size


def test_repeated_ids(spark):
    """Rows that share an id count their own links and share a component."""
    rows = [(1, [1.0, 0.0], 1, ""), (1, [0.0, 1.0], 1, ""), (2, [1.0, 0.01], 1, ""), (3, [0.01, 1.0], 1, ""), (1, [1.0, 0.0], 1, "")]
    got = sorted(tuple(x) for x in E.embedding_dedup(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == [(1, 1, 1, True), (1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), (3, 1, 1, False)]


def test_components(spark):
    links = [(k, k + 1) for k in range(40)] + [(100, 101), (101, 100), (7, 7), (200, 5)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(41)}, 200: 0, 100: 100, 101: 100}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []
