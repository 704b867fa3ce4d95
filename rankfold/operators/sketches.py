"""Summaries with numpy state, for what Spark's built-in KLL sketches cannot say: sure error bounds.

``Compactor`` keeps levels of values; level i stands for 2**i rows per value.  When all slots are taken, one level is
sorted and every other value moves up.  With ``random`` parity (KLL) the error of a compaction is unbiased; without
(deterministic, MRL) it is one-sided.  The ledger of compactions gives the probable and the sure rank error.
``Clusters`` (t-digest with extremes) keeps (count, sum, min, max) of runs of neighbouring values.

Both are built per partition and merged in a tree of groups of at most ``FAN_IN``, so no task and not the driver ever
holds more than that many summaries.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans import planner

FAN_IN = 32
#: Values that a compacting summary sorts at once when it takes in batches.
BATCH = 1 << 14
#: First byte of every serialized summary.
VERSION = 2


class Summary(Protocol):
    """What a mergeable summary of doubles can do."""

    def update(self, values: np.ndarray) -> Summary: ...

    def merge(self, other: Summary) -> Summary: ...

    def bracket(self, k1: int, k2: int, pr: float) -> tuple[float, float]:
        """Values that enclose two ranks (from 1) with probability ``pr``."""

    def exact(self) -> bool:
        """Whether nothing was given up so far."""

    def at(self, k: int) -> float:
        """The value of rank k (from 1) of an exact summary."""

    def to_bytes(self) -> bytes: ...


def load(state: bytes) -> Summary:
    """The summary behind its bytes."""
    version, kind = struct.unpack_from("<BB", state)
    if version != VERSION:
        raise ValueError(f"summary of version {version}; this code reads {VERSION}")
    return (Compactor, Clusters, Sample)[kind].from_bytes(state)


class Splits:
    """For each value, at most how many compactions of one level had to part two neighbours around it: a step function of at most ``cells`` steps.

    A compaction of sorted values keeps one of each pair; it moves the rank of x only if x lies from the first to before
    the second of a pair.  Where steps must be merged, the greater count is kept, so bounds stay true and only grow.
    """

    def __init__(self, cells: int, edges: np.ndarray | None = None, counts: np.ndarray | None = None) -> None:
        self.cells = cells
        self.edges = np.zeros(0) if edges is None else edges
        self.counts = np.zeros(1, np.int64) if counts is None else counts

    def at(self, x: float) -> int:
        return int(self.counts[np.searchsorted(self.edges, x, "right")])

    def pairs(self, x: np.ndarray) -> None:
        """Adds the compaction of sorted values, an even number of them."""
        # equal values of a pair part nothing
        apart = x[1::2] > x[::2]
        ends = np.stack([x[::2][apart], x[1::2][apart]], axis=1).ravel()
        self.merge(Splits(self.cells, ends, (np.arange(len(ends) + 1) % 2).astype(np.int64)))

    def merge(self, other: Splits) -> Splits:
        edges = np.unique(np.concatenate([self.edges, other.edges]))
        # a cell begins at its edge; the first lies before all edges
        begins = np.concatenate([[-math.inf], edges])
        counts = sum(s.counts[np.searchsorted(s.edges, begins, "right")] for s in (self, other))
        if len(edges) >= self.cells:
            # the edges where the count changes most stay
            change = np.abs(np.diff(counts))
            keep = np.sort(np.argsort(-change, kind="stable")[: self.cells - 1])
            # beyond the least and the greatest value nothing was parted
            keep = np.unique(np.concatenate([[0], keep[1:-1], [len(edges) - 1]])) if len(keep) > 2 else np.array([0, len(edges) - 1])
            counts = np.maximum.reduceat(counts, np.concatenate([[0], keep + 1]))
            edges = edges[keep]
        self.edges, self.counts = edges, counts
        return self


class Compactor:
    """Mergeable compacting summary over doubles in ``slots`` slots."""

    def __init__(self, slots: int, random: bool = True, seed: int = 233, log: bool = False, records: int = 0) -> None:
        """With ``log`` every compaction's input is kept (level, values in order), for checks.

        With ``records`` (4 or more) the summary keeps, for each level, a step function of so many cells that bounds the error of
        single values; it goes with the bytes, and its size does not follow the data.
        """
        self.slots, self.random, self.rng = slots, random, np.random.default_rng(seed)
        self.records = records
        self.splits: list[Splits] = []
        self.log: list[tuple[int, np.ndarray]] | None = [] if log else None
        self.levels: list[np.ndarray] = [np.zeros(0)]
        self.compactions = [0]
        self.n, self.low, self.high = 0, math.inf, -math.inf

    def update(self, values: np.ndarray) -> Compactor:
        values = np.asarray(values, np.float64)
        if len(values):
            self.n += len(values)
            self.low, self.high = min(self.low, values.min()), max(self.high, values.max())
        at = 0
        while at < len(values):
            room = max(self.slots - self._held(), 1)
            self.levels[0] = np.concatenate([self.levels[0], values[at : at + room]])
            at += room
            self._shrink()
        return self

    def absorb(self, values: np.ndarray) -> Compactor:
        """As ``update``, for values that are in memory anyway: up to ``BATCH`` of them join at once, before anything is compacted.

        A long sorted run halves in one compaction, with the error of one.  Joined as slots come free, the same values take hundreds of
        short ones, each at its own cost and error.
        """
        values = np.asarray(values, np.float64)
        if len(values):
            self.n += len(values)
            self.low, self.high = min(self.low, values.min()), max(self.high, values.max())
        for at in range(0, len(values), BATCH):
            self.levels[0] = np.concatenate([self.levels[0], values[at : at + BATCH]])
            self._shrink()
        return self

    def merge(self, other: Compactor) -> Compactor:
        self.n += other.n
        self.low, self.high = min(self.low, other.low), max(self.high, other.high)
        for i, (level, done) in enumerate(zip(other.levels, other.compactions)):
            if i == len(self.levels):
                self.levels.append(np.zeros(0))
                self.compactions.append(0)
            self.levels[i] = np.concatenate([self.levels[i], level])
            self.compactions[i] += done
        if self.log is not None:
            self.log += other.log or []
        if self.records:
            if other.records != self.records and any(other.compactions):
                raise ValueError("only a summary with as many records keeps a bound per value")
            for i, splits in enumerate(other.splits):
                self._splits(i).merge(splits)
        self._shrink()
        return self

    def _splits(self, level: int) -> Splits:
        while len(self.splits) <= level:
            self.splits.append(Splits(self.records))
        return self.splits[level]

    def _held(self) -> int:
        return sum(map(len, self.levels))

    def _shrink(self) -> None:
        while self._held() >= self.slots:
            if self.random:
                i = planner.next_level([len(x) for x in self.levels], planner.capacities(len(self.levels), self.slots))
            else:  # equal shares
                share = self.slots / len(self.levels)
                i = next((k for k, x in enumerate(self.levels) if len(x) >= share and len(x) > 1), max(range(len(self.levels)), key=lambda k: len(self.levels[k])))
            x = np.sort(self.levels[i])
            odd = len(x) % 2
            # the odd value stays, at either end
            at_end = odd and (not self.random or self.rng.integers(2))
            self._compact(i, x, 0 if at_end else odd, len(x) - odd)

    def _compact(self, i: int, x: np.ndarray, start: int, many: int) -> None:
        """Every other of ``many`` of level i's sorted values ``x``, an even number from ``start`` on, moves up."""
        if i + 1 == len(self.levels):
            self.levels.append(np.zeros(0))
            self.compactions.append(0)
        run = x[start : start + many]
        first = int(self.rng.integers(2)) if self.random else 0
        if self.log is not None:
            self.log.append((i, run))
        if self.records:
            self._splits(i).pairs(run)
        self.levels[i] = np.concatenate([x[:start], x[start + many :]])
        self.levels[i + 1] = np.concatenate([self.levels[i + 1], run[first::2]])
        self.compactions[i] += 1

    def table(self) -> tuple[np.ndarray, np.ndarray]:
        """Values in order and the approximate number of rows up to each."""
        values = np.concatenate(self.levels)
        weight = np.concatenate([np.full(len(x), 1 << i, np.int64) for i, x in enumerate(self.levels)])
        order = np.argsort(values, kind="stable")
        return values[order], np.cumsum(weight[order])

    def rank(self, x: float) -> int:
        """Approximate number of rows at most x."""
        values, upto = self.table()
        k = int(np.searchsorted(values, x, "right"))
        return int(upto[k - 1]) if k else 0

    def error(self, pr: float) -> int:
        return planner.error_bound(self.compactions, pr)

    def bracket(self, k1: int, k2: int, pr: float) -> tuple[float, float]:
        """Values between which the ranks k1 and k2 lie, with probability ``pr`` (surely for 1, or if deterministic)."""
        values, upto = self.table()
        if not len(values):
            return self.low, self.high
        down = up = self.error(pr)
        if not self.random:
            # even places were kept: a value's rank is at most its approximate one
            down, up = 0, self.error(1.0)
        # the last kept value that surely (or probably) has fewer than k1 rows before it; the minimum if none has
        at = int(np.searchsorted(upto, k1 - down, "left"))
        lo = self.low if at == 0 or k1 - down <= 1 else values[at - 1]
        to = np.searchsorted(upto, k2 + up, "left")
        hi = self.high if to >= len(values) else values[to]
        return float(min(lo, hi)), float(hi)

    def error_at(self, x: float, pr: float) -> int:
        """Rank error of one value that is not exceeded with probability ``pr``, from the log or the records.

        A compaction changes the rank of x only if an odd number of its values are at most x: then by 2**level, else not at all.
        """
        levels = [0] * len(self.levels)
        if self.log is not None:
            for i, values in self.log:
                levels[i] += int(np.searchsorted(values, x, "right")) % 2
        elif self.records:
            for i, splits in enumerate(self.splits):
                levels[i] = min(splits.at(x), self.compactions[i])
        else:
            raise ValueError("a summary without log or records knows no bound per value")
        if pr >= 1:
            return planner.max_error(levels)
        sigma = math.sqrt(sum(m * 4.0**i for i, m in enumerate(levels)))  # each by +-2**level, evenly
        return min(math.ceil(planner.z_of(pr) * sigma), planner.max_error(levels))

    def exact(self) -> bool:
        return not any(self.compactions)

    def at(self, k: int) -> float:
        values, upto = self.table()
        return float(values[np.searchsorted(upto, k)])

    def shrink(self, slots: int) -> Compactor:
        """Compacts to fewer slots, as before a summary is stored."""
        self.slots = slots
        self._shrink()
        return self

    def fit(self, budget: int) -> Compactor:
        """Compacts just as much of the lowest levels as brings the bytes to at most ``budget``.

        A level is compacted whole only if that is not enough; the last one gives up as many neighbouring pairs as are in the
        way, at a random place, so the bytes end within one value of the budget and no more error than needed is made.
        """
        level = 0
        while (over := len(self.to_bytes()) - budget) > 0:
            while level < len(self.levels) and len(self.levels[level]) < 2:
                level += 1
            if level == len(self.levels):
                raise ValueError(f"a summary of {self.n} values does not fit {budget} bytes")
            x = np.sort(self.levels[level])
            # a new level or its records take bytes too; the next round sees them
            many = min(2 * -(-over // 8), len(x) // 2 * 2)
            start = int(self.rng.integers(len(x) - many + 1)) if self.random else len(x) - many
            self._compact(level, x, start, many)
        return self

    def to_bytes(self) -> bytes:
        """Version, kind, parameters, then compactions and values level by level, then edges and counts of the records."""
        head = struct.pack("<BBIBqddHI", VERSION, 0, self.slots, self.random, self.n, self.low, self.high, len(self.levels), self.records)
        body = b"".join(struct.pack("<qI", c, len(x)) for c, x in zip(self.compactions, self.levels)) + b"".join(np.ascontiguousarray(x, "<f8").tobytes() for x in self.levels)
        if not self.records:
            return head + body
        return head + body + struct.pack("<H", len(self.splits)) + b"".join(struct.pack("<I", len(s.edges)) + s.edges.astype("<f8").tobytes() + s.counts.astype("<i8").tobytes() for s in self.splits)

    @classmethod
    def from_bytes(cls, state: bytes) -> Compactor:
        head, entry = struct.Struct("<BBIBqddHI"), struct.Struct("<qI")
        _, _, slots, random, n, low, high, levels, records = head.unpack_from(state)
        at = head.size
        out = cls(slots, bool(random), seed=n, records=records)
        out.n, out.low, out.high = n, low, high
        table = [entry.unpack_from(state, at + i * entry.size) for i in range(levels)]
        at += levels * entry.size
        out.compactions, out.levels = [c for c, _ in table], []
        for _, size in table:
            out.levels.append(np.frombuffer(state, "<f8", size, at).copy())
            at += 8 * size
        if records:
            (many,) = struct.unpack_from("<H", state, at)
            at += 2
            for _ in range(many):
                (edges,) = struct.unpack_from("<I", state, at)
                ends = np.frombuffer(state, "<f8", edges, at + 4).copy()
                counts = np.frombuffer(state, "<i8", edges + 1, at + 4 + 8 * edges).copy()
                out.splits.append(Splits(records, ends, counts))
                at += 4 + 8 * (2 * edges + 1)
        return out


class Clusters:
    """Mergeable clusters (count, sum, min, max) over doubles: of equal count, or with ``tails`` smaller towards both ends.

    With ``tails`` a cluster may take one step of slots * (1/2 + asin(2 q - 1) / pi), the arcsine scale of t-digests.
    """

    def __init__(self, slots: int, tails: bool = False) -> None:
        self.slots, self.tails = slots, tails
        self.rows = np.zeros((0, 4))
        self.n = 0

    def update(self, values: np.ndarray) -> Clusters:
        for a in range(0, len(values), self.slots):
            x = np.asarray(values[a : a + self.slots], np.float64)
            self.n += len(x)
            self._add(np.stack([np.ones(len(x)), x, x, x], axis=1))
        return self

    def merge(self, other: Clusters) -> Clusters:
        self.n += other.n
        self._add(other.rows)
        return self

    def _add(self, rows: np.ndarray) -> None:
        self.rows = np.concatenate([self.rows, rows])
        if len(self.rows) > 2 * self.slots:
            self._compress()

    def _compress(self) -> None:
        rows = self.rows[np.lexsort((self.rows[:, 3], self.rows[:, 2]))]
        before = np.cumsum(rows[:, 0]) - rows[:, 0]
        if self.tails:
            q = (before + rows[:, 0] / 2) / self.n
            group = np.floor(self.slots * (0.5 + np.arcsin(2 * q - 1) / math.pi)).astype(np.int64)
        else:
            group = (before // math.ceil(self.n / self.slots)).astype(np.int64)
        first = np.flatnonzero(np.diff(group, prepend=-1))
        self.rows = np.stack([np.add.reduceat(rows[:, 0], first), np.add.reduceat(rows[:, 1], first), np.minimum.reduceat(rows[:, 2], first), np.maximum.reduceat(rows[:, 3], first)], axis=1)

    def bounds(self, x: float) -> tuple[int, int]:
        """Least and most number of rows at most x."""
        count, _, low, high = self.rows.T
        surely = count[high <= x].sum()
        inside = (low <= x) & (high > x)
        return int(surely + inside.sum()), int(surely + (count[inside] - 1).sum())

    def shrink(self, slots: int) -> Clusters:
        """Merges clusters until about ``slots`` are left, as before a summary is stored."""
        self.slots = slots
        self._compress()
        return self

    def rank(self, x: float) -> float:
        """Estimated number of rows at most x: whole clusters below, and a share of those that hold x by its place in them."""
        count, _, low, high = self.rows.T
        share = np.where(high > low, (x - low) / np.where(high > low, high - low, 1.0), (x >= low).astype(float))
        return float((count * np.clip(share, 0.0, 1.0)).sum())

    def quantile(self, q: float) -> float:
        """Estimate by interpolation between cluster means."""
        rows = self.rows[np.argsort(self.rows[:, 1] / self.rows[:, 0])]
        mid = np.cumsum(rows[:, 0]) - rows[:, 0] / 2
        return float(np.interp(q * self.n, mid, rows[:, 1] / rows[:, 0]))

    def bracket(self, k1: int, k2: int, pr: float = 1.0) -> tuple[float, float]:
        """Values that surely enclose the ranks k1 and k2; both are cluster ends, hence data values."""
        count, _, low, high = self.rows.T
        by_high, by_low = np.argsort(high, kind="stable"), np.argsort(low, kind="stable")
        # at least so many rows are at most each cluster's maximum
        upto = np.cumsum(count[by_high])
        hi = high[by_high][min(np.searchsorted(upto, k2), len(upto) - 1)]
        # at most so many rows are below each cluster's minimum
        below = np.cumsum(count[by_low]) - count[by_low]
        at = max(np.searchsorted(below, k1, "left") - 1, 0)
        lo = low[by_low][at]
        return float(min(lo, hi)), float(hi)

    def exact(self) -> bool:
        return bool((self.rows[:, 2] == self.rows[:, 3]).all())

    def at(self, k: int) -> float:
        rows = self.rows[np.argsort(self.rows[:, 2], kind="stable")]
        return float(rows[np.searchsorted(np.cumsum(rows[:, 0]), k), 2])

    def to_bytes(self) -> bytes:
        """Version, kind, parameters, then a row (count, sum, min, max) per cluster."""
        return struct.pack("<BBIBqI", VERSION, 1, self.slots, self.tails, self.n, len(self.rows)) + np.ascontiguousarray(self.rows, "<f8").tobytes()

    @classmethod
    def from_bytes(cls, state: bytes) -> Clusters:
        _, _, slots, tails, n, rows = struct.unpack_from("<BBIBqI", state)
        out = cls(slots, bool(tails))
        out.n = n
        out.rows = np.frombuffer(state, "<f8", 4 * rows, struct.calcsize("<BBIBqI")).reshape(rows, 4).copy()
        return out


class Sample:
    """Mergeable simple random sample of at most ``limit`` values: those with the smallest random keys; n, minimum and maximum are exact."""

    def __init__(self, limit: int, seed: int = 233) -> None:
        self.limit, self.rng = limit, np.random.default_rng(seed)
        self.keys, self.values = np.zeros(0), np.zeros(0)
        self.n, self.low, self.high = 0, math.inf, -math.inf

    def update(self, values: np.ndarray) -> Sample:
        values = np.asarray(values, np.float64)
        if len(values):
            self.n += len(values)
            self.low, self.high = min(self.low, values.min()), max(self.high, values.max())
            self._add(self.rng.random(len(values)), values)
        return self

    def merge(self, other: Sample) -> Sample:
        self.n += other.n
        self.low, self.high = min(self.low, other.low), max(self.high, other.high)
        self._add(other.keys, other.values)
        return self

    def _add(self, keys: np.ndarray, values: np.ndarray) -> None:
        self.keys, self.values = np.concatenate([self.keys, keys]), np.concatenate([self.values, values])
        if len(self.keys) > self.limit:
            keep = np.argpartition(self.keys, self.limit - 1)[: self.limit]
            self.keys, self.values = self.keys[keep], self.values[keep]

    def brackets(self, k1: int, k2: int, sigmas: tuple[float, ...] = (2.0, 6.0)) -> list[tuple[float, float]]:
        """Brackets of the ranks, each inside the next: so many average errors (m ** -1/2 / 3) to each side, and the sure one."""
        values, m = np.sort(self.values), len(self.values)
        out = []
        for s in sigmas:
            error = s * m**-0.5 / 3
            i, j = ((k1 - 1) / self.n - error) * m, (k2 / self.n + error) * m
            out.append((float(self.low if i < 0 else values[int(i)]), float(self.high if j >= m else values[int(j)])))
        return [*out, (float(self.low), float(self.high))]

    def bracket(self, k1: int, k2: int, pr: float = 1.0) -> tuple[float, float]:
        return self.brackets(k1, k2)[-1 if pr >= 1 else -2]

    def rank(self, x: float) -> float:
        return float((self.values <= x).mean() * self.n) if len(self.values) else 0.0

    def exact(self) -> bool:
        return self.n <= self.limit

    def at(self, k: int) -> float:
        return float(np.sort(self.values)[k - 1])

    def to_bytes(self) -> bytes:
        """Version, kind, limit, count, extremes, then keys and values; a value stands for n / (values kept) rows."""
        return struct.pack("<BBIqddI", VERSION, 2, self.limit, self.n, self.low, self.high, len(self.keys)) + self.keys.astype("<f8").tobytes() + self.values.astype("<f8").tobytes()

    @classmethod
    def from_bytes(cls, state: bytes) -> Sample:
        head = struct.Struct("<BBIqddI")
        _, _, limit, n, low, high, held = head.unpack_from(state)
        out = cls(limit, seed=n)
        out.n, out.low, out.high = n, low, high
        out.keys, out.values = (np.frombuffer(state, "<f8", held, head.size + k * 8 * held).copy() for k in range(2))
        return out


def tree_merge(df: DataFrame, column: str, make: Callable[[], Summary], fan_in: int = FAN_IN) -> Summary:
    """One summary of a double column: per partition, then merged ``fan_in`` at a time."""

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        summary = make()
        if hasattr(summary, "rng"):  # partitions draw independently
            summary.rng = np.random.default_rng([233, TaskContext.get().partitionId()])
        take = getattr(summary, "absorb", summary.update)
        for pdf in batches:
            take(pdf[column].to_numpy(np.float64))
        yield pd.DataFrame({"part": [TaskContext.get().partitionId()], "state": [summary.to_bytes()]})

    def merged(group: pd.DataFrame) -> pd.DataFrame:
        states = group.sort_values("part")["state"]
        summary = load(states.iloc[0])
        for s in states.iloc[1:]:
            summary.merge(load(s))
        return pd.DataFrame({"part": [int(group["part"].iloc[0]) // fan_in], "state": [summary.to_bytes()]})

    values = df.select(column).where(F.col(column).isNotNull() & ~F.isnan(column))
    parts = max(1, values.rdd.getNumPartitions())
    level = values.mapInPandas(partial, "part long, state binary")
    while True:
        level = level.groupBy(F.floor(F.col("part") / fan_in)).applyInPandas(merged, "part long, state binary")
        parts = -(-parts // fan_in)
        if parts == 1:
            break
    rows = level.collect()
    summary = make()
    for r in rows:
        summary = summary.merge(load(r["state"]))
    return summary
