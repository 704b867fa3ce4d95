"""Rank conventions: which of n sorted values answers a quantile q.

Ranks are 1-based here.  Arithmetic is in doubles throughout, as 0.29 and 0.29D differ (n = 101, q = 0.29).
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class RankSpec:
    """A convention: ``places(q, n, floor, ceil)`` gives the two ranks whose values are averaged.

    ``places`` takes numbers or Columns alike; ``lower`` and ``upper`` say the same in SQL over ``{q}`` and ``{n}``.
    """

    name: str
    places: Callable
    lower: str
    upper: str

    def sql(self, q: str, n: str) -> tuple[str, str]:
        """The two ranks as SQL that Spark and DuckDB share; ``q`` must be of type DOUBLE."""
        clamp = "least(greatest(CAST({} AS BIGINT), 1), {})"
        return tuple(clamp.format(x.format(q=q, n=n), n) for x in (self.lower, self.upper))

    def ranks(self, q: float, n: int) -> tuple[int, int]:
        """The two ranks of ``q`` among ``n`` values (n > 0)."""
        return tuple(min(max(int(x), 1), n) for x in self.places(float(q), n, math.floor, math.ceil))

    def columns(self, q: Column, n: Column) -> tuple[Column, Column]:
        one = F.lit(1).cast("long")
        return tuple(F.least(F.greatest(x.cast("long"), one), n.cast("long")) for x in self.places(q, n, F.floor, F.ceil))


#: The midpoint of the two order statistics about q (n - 1) + 1; what all exact quantiles use unless told otherwise.
MID = RankSpec("mid", lambda q, n, floor, ceil: (floor(q * (n - 1) + 1), ceil(q * (n - 1) + 1)), "floor({q} * ({n} - 1) + 1)", "ceil({q} * ({n} - 1) + 1)")
#: The midpoint of the statistics about q n.
FLOOR_CEIL = RankSpec("floor-ceil", lambda q, n, floor, ceil: (floor(q * n), ceil(q * n)), "floor({q} * {n})", "ceil({q} * {n})")
#: The smallest value of which more than trunc(q n) are not larger.
TRUNC = RankSpec("trunc", lambda q, n, floor, ceil: (floor(q * n) + 1,) * 2, "floor({q} * {n}) + 1", "floor({q} * {n}) + 1")
#: A sorted sample's value at index trunc(q m).
SAMPLE = RankSpec("sample", TRUNC.places, TRUNC.lower, TRUNC.upper)
#: The usual median, whatever q.
MEDIAN = RankSpec("median", lambda q, n, floor, ceil: (floor((n + 1) / 2), floor(n / 2) + 1), "floor(({n} + 1) / 2)", "floor({n} / 2) + 1")
#: The first value whose cumulative count exceeds q (n - 1).
DD = RankSpec("dd", lambda q, n, floor, ceil: (floor(q * (n - 1)) + 1,) * 2, "floor({q} * ({n} - 1)) + 1", "floor({q} * ({n} - 1)) + 1")
SPECS = {s.name: s for s in (MID, FLOOR_CEIL, TRUNC, SAMPLE, MEDIAN, DD)}


def grid(m: int) -> list[float]:
    """m equally spaced quantiles, (1 / (m + 1)) * i, in this order of operations."""
    return [(1.0 / (m + 1)) * i for i in range(1, m + 1)]


def memory_slots(memory: str | int, bytes_per_slot: int = 8) -> int:
    """Slots of a summary under a budget like ``1024KB``, ``1MB`` or a number of bytes; a power of two, 20, is the most."""
    text = str(memory).strip().upper()
    unit = next((u for u in ("KB", "MB", "GB", "B") if text.endswith(u)), "")
    number = float(text.removesuffix(unit))
    size = number * {"": 1, "B": 1, "KB": 1 << 10, "MB": 1 << 20, "GB": 1 << 30}[unit]
    return max(16, min(1 << 20, int(size // bytes_per_slot)))


def rank_of(v: Column, x: float | Column) -> Column:
    """How many values are at most x."""
    return F.count_if(v <= x)


def rank_below(v: Column, x: float | Column) -> Column:
    return F.count_if(v < x)


def delta_rank(v: Column, x: float | Column, target: int | Column) -> Column:
    """0 where ``target`` (1-based) lies in the run of ties of ``x``, else the signed distance to the run's nearer end."""
    below, upto, target = rank_below(v, x), rank_of(v, x), F.lit(target) if isinstance(target, int) else target
    return F.when(target <= below, below + 1 - target).when(target > upto, upto - target).otherwise(F.lit(0)).cast("long")
