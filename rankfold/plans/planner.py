"""Cost model of multi-pass selection: how sure a pass's bracket should be.

A compacting summary with M slots loses, per compaction at level i, a rank error of -2^i, 0 or 2^i with probabilities
1/4, 1/2 and 1/4.  A bracket that holds the rank with probability Pr is narrow when Pr is small; a miss costs a pass.
The planner simulates the compactions for n items, takes the error bound of each Pr, and searches the Pr with the fewest
expected passes.  Everything here is plain arithmetic on the driver.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import lru_cache
from statistics import NormalDist

NORMAL = NormalDist()
#: Normalised rank error of a KLL sketch with parameter k: about 2.296 / k ** 0.9723.
KLL_ERROR, KLL_POWER = 2.296, 0.9723
#: The success probabilities that a list search tries.
PR_LIST = (0.70, 0.72, 0.74, 0.76, 0.78, 0.80, 0.82, 0.84, 0.86, 0.88, 0.90, 0.92, 0.94, 0.95, 0.96, 0.97, 0.975, 0.98, 0.985, 0.99, 0.9925, 0.995)


#: Times its slots that a summary is filled in simulations; larger ones are continued by rule.
SIMULATED = 256
#: Leading bits of a number of items that plans tell apart, so that a search simulates few of them, whatever their number.
COARSE = 5


@lru_cache(1024)
def capacities(levels: int, slots: int, least: int = 3) -> list[int]:
    """Slots of each level, lowest first: shares fall by 2/3 per level downwards, none under ``least``."""
    shares = [(2 / 3) ** (levels - 1 - i) for i in range(levels)]
    fit = lambda k: sum(max(least, round(k * s)) for s in shares)
    lo, hi = 1, slots
    while lo < hi:
        k = (lo + hi + 1) // 2
        lo, hi = (k, hi) if fit(k) <= slots else (lo, k - 1)
    return [max(least, round(lo * s)) for s in shares]


def levels_for(n: int, slots: int) -> int:
    """The fewest levels whose weighted slots hold n items."""
    for levels in range(2, max(3, math.ceil(math.log2(max(n, 6) / 3)) + 2)):
        if sum(c << i for i, c in enumerate(capacities(levels, slots))) >= n:
            return levels
    return max(2, math.ceil(math.log2(max(n, 6) / 3)) + 1)


def next_level(sizes: list[int], caps: list[int]) -> int:
    """The overfull level with the most items per unit of variance; the fullest lowest one if none is overfull."""
    over = [i for i, (s, c) in enumerate(zip(sizes, caps)) if s > c and s > 1]
    over = over or [i for i, s in enumerate(sizes) if s > 1]
    return max(over, key=lambda i: sizes[i] / 4.0**i)


@lru_cache(256)
def simulate_compactions(n: int, slots: int) -> tuple[int, ...]:
    """Compactions per level after n inserts, without data.

    Beyond so many inserts the lower levels repeat themselves: the upper levels are those of a half, a quarter, ... of the rows that
    count twice, four times, ..., and each level below compacts twice as often as the one above it.
    """
    if n > SIMULATED * slots:
        halvings = math.ceil(math.log2(n / (SIMULATED * slots)))
        upper = simulate_compactions(n >> halvings, slots)
        return (*(upper[0] << (halvings - i) for i in range(halvings)), *upper)
    sizes, done, left = [0], [0], n
    caps = capacities(1, slots)
    while left:
        step = min(left, max(slots, 3 * len(sizes)) - sum(sizes))  # a level can't do with less than three
        sizes[0] += step
        left -= step
        if not left:
            break
        i = next_level(sizes, caps)
        if i + 1 == len(sizes):
            sizes.append(0)
            done.append(0)
            caps = capacities(len(sizes), slots)
        moved = sizes[i] // 2
        sizes[i] -= 2 * moved
        sizes[i + 1] += moved
        done[i] += 1
    return tuple(done)


def variance(compactions: tuple[int, ...] | list[int]) -> float:
    return sum(0.5 * m * 4.0**i for i, m in enumerate(compactions))


def max_error(compactions: tuple[int, ...] | list[int]) -> int:
    return sum(m << i for i, m in enumerate(compactions))


def error_bound(compactions, pr: float) -> int:
    """Rank error that is not exceeded with probability ``pr``; the sure bound for pr = 1."""
    if pr >= 1:
        return max_error(compactions)
    sigma = math.sqrt(variance(compactions))
    return min(-math.floor(NORMAL.inv_cdf(0.5 * (1 - pr)) * sigma) if sigma else 0, max_error(compactions))


def trinomial_pmf(m: int) -> list[float]:
    """Probabilities of the sums -m..m of m steps of -1, 0, 1 with 1/4, 1/2, 1/4: a binomial of 2 m fair steps."""
    return [math.comb(2 * m, k) / 4.0**m for k in range(2 * m + 1)]


def trinomial_normal_gap(m: int) -> float:
    """Largest difference between that distribution function and the normal one with its variance."""
    sigma, total, worst = math.sqrt(m / 2), 0.0, 0.0
    for k, p in enumerate(trinomial_pmf(m)):
        total += p
        worst = max(worst, abs(total - NORMAL.cdf((k - m + 0.5) / sigma)))
    return worst


def truncated_mean(mu: float, sigma: float, least: float) -> float:
    """Mean of a normal variable given that it is over ``least``."""
    if sigma <= 0:
        return max(mu, least)
    a = (least - mu) / sigma
    tail = 1 - NORMAL.cdf(a)
    return mu + sigma * NORMAL.pdf(a) / tail if tail > 1e-12 else least


@dataclass(frozen=True)
class Plan:
    pr: float
    passes: float


def coarse(n: int) -> int:
    """``n`` without its bits behind the leading ones."""
    left = max(0, n.bit_length() - COARSE)
    return n >> left << left


def expected_passes(n: float, slots: int, pr: float, m: int = 1, depth: int = 0) -> float:
    """Passes to come over n candidates: one if they fit, else one and those of the next bracket."""
    share = slots / m
    if n <= share or depth >= 12:
        return 1.0
    compactions = simulate_compactions(coarse(int(n)), max(16, int(share)))
    each = pr ** (1.0 / m)
    e, worst, sigma = error_bound(compactions, each), max_error(compactions), math.sqrt(variance(compactions))
    hit = 2.0 * max(e, 1)
    miss = max((min(n, 2.0 * worst) - hit) / 2, 1.0)

    def after(size: float) -> float:
        done = NORMAL.cdf((share - size) / sigma) ** m if sigma else float(size <= share)
        if done >= 0.999 or size >= n:
            return 1.0
        rest = min(truncated_mean(size, sigma, share), n / 2)
        return done + (1 - done) * (1 + expected_passes(rest, slots, pr, m, depth + 1))

    return 1.0 + pr * after(hit) + (1 - pr) * (1.0 + after(miss))


def best_pr(n: int, slots: int, m: int = 1, tolerance: float = 5e-4, least: float = 5e-4, most: float = 0.5) -> Plan:
    """Golden-section search for the failure probability with the fewest expected passes, compared with the surest one."""
    cost = lambda d: expected_passes(n, slots, 1 - d, m)
    lo, hi, ratio = least, most, 0.618
    a, b = hi - ratio * (hi - lo), lo + ratio * (hi - lo)
    fa, fb = cost(a), cost(b)
    while (hi - lo) / (1 - lo) >= tolerance:
        if fa <= fb:
            hi, b, fb = b, a, fa
            a = hi - ratio * (hi - lo)
            fa = cost(a)
        else:
            lo, a, fa = a, b, fb
            b = lo + ratio * (hi - lo)
            fb = cost(b)
    return min((Plan(1 - d, cost(d)) for d in ((lo + hi) / 2, least)), key=lambda p: p.passes)


def best_pr_of_list(n: int, slots: int, m: int = 1, candidates=PR_LIST) -> Plan:
    return min((Plan(p, expected_passes(n, slots, p, m)) for p in candidates), key=lambda p: p.passes)


def kll_error(k: int) -> float:
    return KLL_ERROR / k**KLL_POWER


def kll_k(slots: int) -> int:
    """Parameter k of Spark's KLL sketches under a budget of slots: about three k slots are used."""
    return max(8, min(65535, slots // 3))


def z_of(pr: float) -> float:
    """Half-width, in standard deviations, of a bracket that holds with probability ``pr``."""
    return NORMAL.inv_cdf(0.5 + 0.5 * min(pr, 1 - 1e-12))


def bloom_size(n: int, fpp: float) -> tuple[int, int]:
    """(bits, hashes) of a Bloom filter of n keys."""
    bits = max(8, math.ceil(-n * math.log(fpp) / math.log(2) ** 2))
    return bits, max(1, round(bits / max(n, 1) * math.log(2)))


def bloom_fpp(bits_per_key: float) -> float:
    return math.exp(-bits_per_key * math.log(2) ** 2)
