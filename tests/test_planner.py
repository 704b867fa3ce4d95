import math
import random

import numpy as np
import pytest

from rankfold.functions import ranks as R
from rankfold.functions.codes import decode_array, encode_array
from rankfold.operators.sketches import Clusters, Compactor, load
from rankfold.plans import planner as P


def test_ranks_are_midpoints_in_double_arithmetic():
    assert R.MID.ranks(0.5, 2) == (1, 2) and R.MID.ranks(0.5, 5) == (3, 3) and R.MID.ranks(0.3, 5) == (2, 3)
    assert R.MID.ranks(0.29, 101) == (29, 30)  # decimals would give 30, 30
    assert R.MID.ranks(0, 7) == (1, 1) and R.MID.ranks(1, 7) == (7, 7)
    assert R.MEDIAN.ranks(0.9, 4) == (2, 3) and R.TRUNC.ranks(1.0, 4) == (4, 4)
    assert R.grid(3) == [0.25, 0.5, 0.75] and R.memory_slots("8KB") == 1024 and R.memory_slots("64MB") == 1 << 20


def test_capacities_fit_and_hold():
    for slots in (64, 500, 4096):
        for levels in range(1, 9):
            caps = P.capacities(levels, slots)
            assert caps == sorted(caps) and min(caps) >= 3 and sum(caps) <= max(slots, 3 * levels)
        n = 100 * slots
        assert sum(c << i for i, c in enumerate(P.capacities(P.levels_for(n, slots), slots))) >= n


def test_simulated_compactions_match_a_sketch():
    done = P.simulate_compactions(20_000, 256)
    sketch = Compactor(256).update(np.random.default_rng(1).normal(size=20_000))
    assert list(done) == sketch.compactions
    assert P.max_error(done) == sum(m * 2**i for i, m in enumerate(done))


def test_error_bounds():
    done = P.simulate_compactions(50_000, 512)
    bounds = [P.error_bound(done, p) for p in (0.5, 0.9, 0.99, 1.0)]
    assert bounds == sorted(bounds) and bounds[-1] == P.max_error(done)
    assert abs(sum(P.trinomial_pmf(20)) - 1) < 1e-12 and P.trinomial_normal_gap(64) < 0.005
    assert P.truncated_mean(0, 1, 0) == pytest.approx(math.sqrt(2 / math.pi))


def test_best_pr_is_no_worse_than_the_list():
    for n, slots in ((100_000, 1024), (1_000_000, 512)):
        best, listed = P.best_pr(n, slots), P.best_pr_of_list(n, slots)
        assert 0.5 <= best.pr < 1 and best.passes >= 1
        assert best.passes <= listed.passes * 1.05
    assert P.expected_passes(100, 1000, 0.9) == 1.0


def test_planning_does_not_follow_the_rows(monkeypatch):
    steps, plain = [0], P.next_level

    def counted(sizes, caps):
        steps[0] += 1
        if steps[0] > 600_000:
            raise AssertionError("a plan simulates too many compactions")
        return plain(sizes, caps)

    monkeypatch.setattr(P, "next_level", counted)
    for n, slots, m in ((10**6, 128, 1), (10**9, 128, 1), (10**9, 1 << 17, 500)):
        P.simulate_compactions.cache_clear()
        steps[0] = 0
        assert 0.5 <= P.best_pr(n, slots, m).pr < 1


@pytest.mark.parametrize("random_parity", [True, False])
def test_absorbed_batches_take_few_compactions(random_parity):
    x = np.random.default_rng(8).gamma(2.0, size=200_000)
    for records in (0, 64):
        state = Compactor(512, random=random_parity, records=records)
        for batch in np.array_split(x, 20):
            state.absorb(batch)
        assert state.n == len(x) and state._held() < 512 and state.low == x.min() and state.high == x.max()
        assert sum(state.compactions) < 20 * 40 and state.error(1.0) < 0.02 * len(x)
        for v in np.quantile(x, [0.0, 0.1, 0.5, 0.99, 1.0]):
            off = abs(state.rank(v) - int((x <= v).sum()))
            assert off <= (state.error_at(v, 1.0) if records else state.error(1.0))
    small = Compactor(512).absorb(x[:511])
    assert small.exact() and small.at(7) == np.sort(x[:511])[6]


def test_bound_coverage():
    r = np.random.default_rng(7)
    misses = 0
    for trial in range(200):
        x = r.normal(size=4000)
        s = Compactor(128, seed=trial).update(x)
        v = float(np.quantile(x, r.uniform(0.05, 0.95)))
        misses += abs(s.rank(v) - int((x <= v).sum())) > s.error(0.9)
    assert misses <= 200 * 0.1 + 15


@pytest.mark.parametrize("make", [lambda: Compactor(128), lambda: Compactor(128, random=False), lambda: Clusters(64), lambda: Clusters(64, tails=True)])
def test_sure_brackets_hold_after_merging(make):
    r = np.random.default_rng(3)
    for trial in range(40):
        n = int(r.integers(1, 3000))
        x = r.choice([r.normal(size=n), r.integers(0, 9, n).astype(float), np.sort(r.normal(size=n))], axis=0)
        summary = make()
        for part in np.array_split(x, 5):
            summary.merge(load(make().update(part).to_bytes()))
        summary = load(summary.to_bytes())
        x = np.sort(x)
        for q in (0.0, 0.1, 0.5, 0.77, 1.0):
            k1, k2 = R.MID.ranks(q, n)
            lo, hi = summary.bracket(k1, k2, 1.0)
            assert lo <= x[k1 - 1] and x[k2 - 1] <= hi, (trial, q, n)


def test_order_code():
    r = random.Random(1)
    x = [0.0, -0.0, 1.0, -1.0, math.inf, -math.inf, math.nan, 5e-324, -5e-324] + [r.uniform(-1e300, 1e300) for _ in range(200)]
    code = encode_array(np.array(x))
    order = sorted(range(len(x)), key=lambda i: (math.isnan(x[i]), 0 if math.isnan(x[i]) else x[i]))
    assert [code[i] for i in order] == sorted(code)
    assert code[0] == code[1] and np.array_equal(decode_array(code), np.where(np.array(x) == 0, 0.0, x), equal_nan=True)


def test_bloom_size():
    bits, hashes = P.bloom_size(1000, 0.01)
    assert bits == math.ceil(-1000 * math.log(0.01) / math.log(2) ** 2) and hashes == 7
    assert P.bloom_fpp(bits / 1000) == pytest.approx(0.01, rel=0.01)


def test_shrunk_summaries_still_enclose():
    x = np.sort(np.random.default_rng(4).normal(size=5000))
    for summary in (Compactor(1024).update(x).shrink(128), Clusters(512).update(x).shrink(64)):
        lo, hi = summary.bracket(2500, 2501, 1.0)
        assert lo <= x[2499] <= x[2500] <= hi and len(load(summary.to_bytes()).to_bytes()) < 9000
        assert abs(summary.rank(0.0) - (x <= 0).sum()) < 400


def test_clusters_with_tails_are_finer_at_the_ends():
    x = np.random.default_rng(9).normal(size=50_000)
    even, tails = Clusters(200).update(x), Clusters(200, tails=True).update(x)
    ordered = np.sort(x)
    width = lambda s, k: np.subtract(*np.searchsorted(ordered, s.bracket(k, k))[::-1])
    assert width(tails, 50) < width(even, 50) / 4 and width(tails, 49_950) < width(even, 49_950) / 4
    assert width(tails, 25_000) < 3 * width(even, 25_000) and len(tails.rows) <= 401
    assert abs(tails.quantile(0.999) - ordered[49_950]) < 0.5
