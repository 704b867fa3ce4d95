"""Exact quantiles in a few passes.

A pass is one scan.  The first builds a summary and from it a bracket of values for each rank; the next counts the rows
below, in and above the brackets and the multiplicities of the values inside.  Exactness is decided by those counts,
never by trust in a summary: a bracket that misses its rank is replaced by the side that holds it, and one that holds
too many different values is narrowed by a summary of its rows alone.

What reaches the driver is bounded by the number of quantiles: counts per bracket, and the two values of each quantile.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from ..functions.codes import decode_array, order_code
from ..functions.places import doubles
from ..functions.ranks import MID, SPECS, RankSpec, memory_slots
from ..plans import planner
from .cache import held
from .sketches import Clusters, Compactor, Sample, tree_merge

METHODS = ("kll", "ledger", "mrl", "tdigest", "tdigest-tails", "ddsketch", "sample", "radix", "sort")
#: Different values that a bracket may hold before it is narrowed again.
SURVIVORS = 100_000
MAX_PASSES = 15
#: Up to so many brackets are comparisons in the plan; more are swept: the plan stays the same, whatever their number.
COMPARED = 16
#: Values inside brackets that a sweep holds before it merges equal ones and sends them on.
SWEPT = 1 << 20


@dataclass
class Bracket:
    """A closed interval of values for the ranks of one quantile, inside a sure one."""

    k1: int
    k2: int
    lo: float
    hi: float
    sure_lo: float = -math.inf
    sure_hi: float = math.inf
    found: dict[int, float] = field(default_factory=dict)
    #: Wider brackets to fall back on, one after another, before the sure one.
    wider: list[tuple[float, float]] = field(default_factory=list)

    def judge(self, below: int, inside: int) -> str:
        """``hit``, or on which side the ranks lie.  Ranks on both sides of an end widen the bracket."""
        if self.k1 > below and self.k2 <= below + inside:
            return "hit"
        low, high = self.k1 <= below, self.k2 > below + inside
        while self.wider:
            a, b = self.wider.pop(0)
            if a < self.lo or b > self.hi:
                self.lo, self.hi = min(a, self.lo), max(b, self.hi)
                return "miss"
        if low and high:
            self.lo, self.hi = self.sure_lo, self.sure_hi
        elif low:
            self.lo, self.hi = self.sure_lo, (self.lo if self.k2 <= below else self.hi)
        else:
            self.lo, self.hi = (self.hi if self.k1 > below + inside else self.lo), self.sure_hi
        return "miss"


@dataclass
class Answer:
    q: float
    value: float | None
    passes: int


def _intervals(brackets: Sequence[Bracket]) -> list[tuple[float, float]]:
    """Disjoint closed intervals that cover the brackets, in order."""
    out: list[list[float]] = []
    for b in sorted(brackets, key=lambda b: (b.lo, b.hi)):
        if out and b.lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b.hi)
        else:
            out.append([b.lo, b.hi])
    return [(a, b) for a, b in out]


def cell_of(v: Column, intervals: Sequence[tuple[float, float]]) -> Column:
    """2 i + 1 for values in interval i, 2 i for those between the intervals i - 1 and i; a balanced tree of comparisons."""

    def tree(a: int, b: int) -> Column:
        if a == b:
            return F.lit(2 * a)
        m = (a + b) // 2
        lo, hi = intervals[m]
        return F.when(v < F.lit(lo), tree(a, m)).when(v > F.lit(hi), tree(m + 1, b)).otherwise(F.lit(2 * m + 1))

    return tree(0, len(intervals))


def sweep(rows: DataFrame, intervals: Sequence[tuple[float, float]]) -> DataFrame:
    """(cell, v, n): rows of ``v`` counted by the cells of ``cell_of``; equal values inside an interval are merged, others only counted.

    The ends of the intervals, disjoint and ascending, go to the tasks as two arrays.  A value's cell is how many intervals begin at it
    or before, and how many end before it: two binary searches for a batch.  Counts between the intervals are kept for a whole task.
    """
    lows, highs = (np.array([x[i] for x in intervals]) for i in (0, 1))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros(2 * len(lows) + 1, np.int64)
        held: list[np.ndarray] = []

        def merged() -> pa.RecordBatch:
            v, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            cell = np.searchsorted(lows, v, "right") + np.searchsorted(highs, v, "left")
            return pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), pa.array(v), pa.array(n, pa.int64())], names=["cell", "v", "n"])

        for batch in batches:
            v = batch.column(0).to_numpy(zero_copy_only=False) + 0.0
            cell = np.searchsorted(lows, v, "right") + np.searchsorted(highs, v, "left")
            inside = cell % 2 == 1
            totals += np.bincount(cell[~inside], minlength=len(totals))
            held.append(v[inside])
            if sum(map(len, held)) >= SWEPT:
                yield merged()
        if held:
            yield merged()
        beside = np.flatnonzero(totals)
        yield pa.RecordBatch.from_arrays([pa.array(beside, pa.int32()), pa.nulls(len(beside), pa.float64()), pa.array(totals[beside], pa.int64())], names=["cell", "v", "n"])

    return rows.mapInArrow(count, "cell int, v double, n long").groupBy("cell", "v").agg(F.sum("n").alias("n"))


class _Run:
    """Shared state of the passes of one call."""

    def __init__(self, df: DataFrame, col: str | Column, memory: str | int, pr: float | None, survivors: int, max_passes: int) -> None:
        v = F.col(col) if isinstance(col, str) else col
        self.rows = df.select(v.cast("double").alias("v")).where(F.col("v").isNotNull())
        self.slots, self.pr, self.survivors, self.max_passes = memory_slots(memory), pr, survivors, max_passes
        self.passes = 0

    def start(self, *more: Column):
        self.passes += 1
        real = ~F.isnan("v")
        got = self.rows.agg(F.count("v").alias("n"), F.count_if(~real).alias("nan"), F.min(F.when(real, F.col("v"))).alias("lo"), F.max(F.when(real, F.col("v"))).alias("hi"), *more).first()
        self.n, self.nan, self.lo, self.hi = got["n"], got["nan"], got["lo"], got["hi"]
        self.real = self.n - self.nan
        return got

    def certainty(self, m: int, n: int | None = None) -> float:
        """Success probability of each of m brackets over n candidates (all values, unless told otherwise), planned for that pass."""
        pr = self.pr if self.pr is not None else planner.best_pr(n or self.real, max(self.slots, 64), m).pr
        return max(pr, 1e-6) ** (1.0 / m)


def _kll_brackets(run: _Run, brackets: list[Bracket]) -> None:
    k = planner.kll_k(run.slots)
    got = run.start(F.expr(f"kll_sketch_agg_double(v, {k}) FILTER (WHERE NOT isnan(v))").alias("s"))
    _from_kll(run, brackets, got["s"], run.real, k)


def sketch_quantiles(spark: SparkSession, sketch, fractions: Sequence[float]) -> list[float]:
    """Quantiles of one of Spark's KLL sketches."""
    asked = doubles(fractions)
    return spark.createDataFrame([(bytearray(sketch),)], "s binary").select(F.kll_sketch_get_quantile_double("s", asked).alias("v")).first()["v"]


def _from_kll(run: _Run, brackets: list[Bracket], sketch, n: int, k: int) -> None:
    """Brackets by Spark's KLL sketch of n values: quantiles a few standard errors off each rank."""
    if not n:
        return
    width = max(planner.z_of(run.certainty(len(brackets), n)), 1.0) * planner.kll_error(k) / 2 + 2.0 / n
    ends = [f for b in brackets for f in (max(0.0, (b.k1 - 1) / n - width), min(1.0, b.k2 / n + width))]
    got = sketch_quantiles(run.rows.sparkSession, sketch, ends)
    for i, b in enumerate(brackets):
        b.lo = b.sure_lo if ends[2 * i] <= 0 else got[2 * i]
        b.hi = b.sure_hi if ends[2 * i + 1] >= 1 else got[2 * i + 1]


def _summary_brackets(run: _Run, brackets: list[Bracket], make, pr: float) -> None:
    summary = tree_merge(run.rows, "v", make)
    for b in brackets:
        if summary.exact():  # nothing was given up, so the summary has the answer
            b.found = {k: summary.at(k) for k in (b.k1, b.k2)}
        elif isinstance(summary, Sample):
            (b.lo, b.hi), *b.wider = summary.brackets(b.k1, b.k2)[:-1]
        else:
            b.lo, b.hi = summary.bracket(b.k1, b.k2, pr)


def _dd_brackets(run: _Run, brackets: list[Bracket]) -> None:
    """Buckets of equal relative width around zero; each bracket is the extremes of the buckets that hold its ranks."""
    from .summaries import dd_buckets

    span = max(abs(run.lo), abs(run.hi), 1e-300)
    alpha = min(max(math.log10(span + 10) / run.slots * 8, 1e-4), 0.5)
    table = dd_buckets(run.rows, "v", alpha).orderBy("lo")
    upto = F.sum("n").over(Window.orderBy("lo"))  # at most a few thousand buckets: their number depends on alpha and the range only
    placed = table.withColumn("upto", upto)
    wanted = sorted({k for b in brackets for k in (b.k1, b.k2)})
    hits = placed.where(F.exists(F.array(*[F.lit(k) for k in wanted]), lambda k: (k <= F.col("upto")) & (k > F.col("upto") - F.col("n")))).collect()
    for b in brackets:
        b.lo = min(r["lo"] for r in hits if r["upto"] - r["n"] < b.k1 <= r["upto"])
        b.hi = max(r["hi"] for r in hits if r["upto"] - r["n"] < b.k2 <= r["upto"])


def _counted(rows: DataFrame, intervals: Sequence[tuple[float, float]]) -> DataFrame:
    """(cell, v, n) of the rows: by comparisons in the plan where these are few, by a sweep where they are many."""
    if len(intervals) > COMPARED:
        return sweep(rows, intervals)
    cells = rows.withColumn("cell", cell_of(F.col("v"), intervals))
    return cells.groupBy("cell", F.when(F.col("cell") % 2 == 1, F.col("v") + 0.0).alias("v")).agg(F.count("*").alias("n"))


def _resolve(run: _Run, brackets: list[Bracket]) -> None:
    """Passes until each bracket has its two values."""
    open_ = brackets
    while open_:
        if run.passes >= run.max_passes:  # summaries did not help: the sort looks into one range partition per rank
            _by_sort(run, open_)
            return
        intervals = _intervals(open_)
        run.passes += 1
        counted = _counted(run.rows.where(~F.isnan("v")), intervals).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            totals = {r["cell"]: (r["n"], r["values"]) for r in counted.groupBy("cell").agg(F.sum("n").alias("n"), F.count("*").alias("values")).collect()}
            below, done = [], 0
            for i in range(len(intervals)):
                done += totals.get(2 * i, (0, 0))[0]
                below.append(done)
                done += totals.get(2 * i + 1, (0, 0))[0]
            hits, narrow = [], []
            begins = [lo for lo, _ in intervals]
            for b in open_:
                i = bisect_right(begins, b.lo) - 1
                b.lo, b.hi = intervals[i]
                n, values = totals.get(2 * i + 1, (0, 0))
                verdict = b.judge(below[i], n)
                if verdict == "hit":
                    b.sure_lo, b.sure_hi = b.lo, b.hi
                    (hits if values <= run.survivors else narrow).append((b, i))
            if hits:
                _pick(run, counted, hits, below)
        finally:
            counted.unpersist()
        if narrow:
            _narrow(run, [(b, below[i]) for b, i in narrow])
        open_ = [b for b in open_ if not b.found]


def _placed(counted: DataFrame, part: str, wanted: list[tuple[int, int]]) -> dict[tuple[int, int], float]:
    """The value of each (part, rank in it), by running sums inside each part; two rows reach the driver per quantile."""
    upto = Window.partitionBy(part).orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    by_part: dict[int, list[int]] = {}
    for p, k in wanted:
        by_part.setdefault(p, []).append(k)
    if len(wanted) > 4 * COMPARED:  # a row for each rank is sent
        asked = counted.sparkSession.createDataFrame([(p, k) for p, k in wanted], f"{part} int, k long")
        own = counted.join(F.broadcast(asked.select(part).distinct()), part, "left_semi").withColumn("upto", F.sum("n").over(upto))
        rows = own.join(F.broadcast(asked), part).where((F.col("k") <= F.col("upto")) & (F.col("k") > F.col("upto") - F.col("n"))).select(part, "v", "k").collect()
        return {(r[part], r["k"]): r["v"] for r in rows}
    holds = lambda ks: F.exists(F.array(*[F.lit(k).cast("long") for k in ks]), lambda k: (k <= F.col("upto")) & (k > F.col("upto") - F.col("n")))
    hit = reduce(lambda so_far, x: so_far.when(F.col(part) == x[0], holds(x[1])), list(by_part.items())[1:], F.when(F.col(part) == wanted[0][0], holds(by_part[wanted[0][0]])))
    rows = counted.where(F.col(part).isin(sorted(by_part))).withColumn("upto", F.sum("n").over(upto)).where(hit).select(part, "v", "n", "upto").collect()
    return {(r[part], k): r["v"] for r in rows for k in by_part[r[part]] if r["upto"] - r["n"] < k <= r["upto"]}


def _pick(run: _Run, counted: DataFrame, hits: list[tuple[Bracket, int]], below: list[int]) -> None:
    """The values of the ranks of brackets that hit."""
    got = _placed(counted, "cell", sorted({(2 * i + 1, k - below[i]) for b, i in hits for k in (b.k1, b.k2)}))
    for b, i in hits:
        b.found = {k: got[2 * i + 1, k - below[i]] for k in (b.k1, b.k2)}


def _narrow(run: _Run, asked: list[tuple[Bracket, int]]) -> None:
    """Narrower brackets from a sketch of each interval's own rows, all in one more pass; ``asked`` has the rows below each bracket.

    The memory of the run is shared by the intervals.
    """
    run.passes += 1
    spans = sorted({(b.lo, b.hi) for b, _ in asked})  # intervals of one pass: disjoint
    k = planner.kll_k(max(run.slots // len(spans), 32))
    lows, highs = (np.array([x[i] for x in spans]) for i in (0, 1))

    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column(0).to_numpy(zero_copy_only=False)
            at = np.searchsorted(lows, v, "right") - 1
            hit = (at >= 0) & (v <= highs[at])
            yield pa.RecordBatch.from_arrays([pa.array(at[hit], pa.int32()), pa.array(v[hit])], names=["span", "v"])

    rows = run.rows.where(~F.isnan("v"))
    if len(spans) > COMPARED:
        rows = rows.mapInArrow(inside, "span int, v double")
    else:
        cell = cell_of(F.col("v"), spans)
        rows = rows.withColumn("cell", cell).where(F.col("cell") % 2 == 1).select(F.floor(F.col("cell") / 2).cast("int").alias("span"), "v")
    got = {r["span"]: r for r in rows.groupBy("span").agg(F.count("*").alias("n"), F.expr(f"kll_sketch_agg_double(v, {k})").alias("s")).collect()}
    for i, span in enumerate(spans):
        here = [(b, below) for b, below in asked if (b.lo, b.hi) == span]
        shifted = [Bracket(b.k1 - below, b.k2 - below, b.lo, b.hi, b.lo, b.hi) for b, below in here]
        _from_kll(run, shifted, got[i]["s"], got[i]["n"], k)
        for (b, _), x in zip(here, shifted):
            b.lo, b.hi = x.lo, x.hi


def _by_sort(run: _Run, brackets: list[Bracket]) -> None:
    """Range partitions in order, their counts, and a look into the partitions that hold the ranks."""
    run.passes += 1
    width = max(1, int(run.rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    counts = run.rows.where(~F.isnan("v")).withColumn("v", F.col("v") + 0.0).groupBy("v").agg(F.count("*").alias("n"))
    dealt = counts.repartitionByRange(width, "v").withColumn("part", F.spark_partition_id()).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        totals = {r["part"]: r["n"] for r in dealt.groupBy("part").agg(F.sum("n").alias("n")).collect()}
        below, done = {}, 0
        for p in sorted(totals):
            below[p] = done
            done += totals[p]
        wanted = sorted({(p, k - below[p]) for b in brackets for k in (b.k1, b.k2) for p in totals if below[p] < k <= below[p] + totals[p]})
        got = {k + below[p]: v for (p, k), v in _placed(dealt, "part", wanted).items()}
    finally:
        dealt.unpersist()
    for b in brackets:
        b.found = {k: got[k] for k in (b.k1, b.k2)}


def radix_select(df: DataFrame, code: str, ranks: Sequence[int], weight: str | None = None, bits: int = 16) -> tuple[dict[int, int], int]:
    """(code of each rank, passes) by fixing ``bits`` more leading bits each pass.

    A pass counts at most 2**bits prefixes per open rank range.  ``weight`` counts a row so many times.
    """
    w = F.sum(weight) if weight else F.count("*")
    key = F.col(code).bitwiseXOR(F.lit(-(2**63)))
    state = {k: (0, 0) for k in set(ranks)}  # prefix so far (unsigned), rows below it
    passes = 0
    for left in range(64 - bits, -1, -bits):
        passes += 1
        high = F.shiftrightunsigned(key, left + bits) if left + bits < 64 else F.lit(0).cast("long")
        part = F.shiftrightunsigned(key, left).bitwiseAND(F.lit((1 << bits) - 1))
        signed = lambda p, width: p - (1 << 64) if width == 64 and p >= 1 << 63 else p
        prefixes = sorted({signed(p, 64 - left - bits) for p, _ in state.values()})
        counts = df.where(F.col(code).isNotNull() & high.isin(prefixes)).groupBy(high.alias("high"), part.alias("part")).agg(w.alias("n"))
        counts = counts.withColumn("upto", F.sum("n").over(Window.partitionBy("high").orderBy("part").rowsBetween(Window.unboundedPreceding, 0)))
        wanted = df.sparkSession.createDataFrame([(k, p, k - b) for k, (p, b) in state.items()], "k long, high long, r long")
        hits = counts.join(F.broadcast(wanted), "high").where((F.col("r") <= F.col("upto")) & (F.col("r") > F.col("upto") - F.col("n"))).collect()
        state = {r["k"]: ((state[r["k"]][0] << bits) | r["part"], state[r["k"]][1] + r["upto"] - r["n"]) for r in hits}
    return {k: (p ^ (1 << 63)) - ((1 << 64) if (p ^ (1 << 63)) >= 1 << 63 else 0) for k, (p, _) in state.items()}, passes


def solve(df: DataFrame, col: str | Column, qs: Sequence[float], *, method: str = "kll", memory: str | int = "1024KB", pr: float | None = None, rank: RankSpec | str = MID, survivors: int = SURVIVORS, max_passes: int = MAX_PASSES) -> list[Answer]:
    """The quantiles ``qs`` of a numeric column, exactly.

    Nulls are ignored, NaN is greatest, -0.0 equals 0.0; no values give None.  ``pr`` fixes the success probability of
    the brackets; by default the planner chooses it.  Every method gives the same values; they differ in the first pass.
    """
    if method not in METHODS:
        raise ValueError(f"method {method!r} is none of {METHODS}")
    spec = SPECS[rank] if isinstance(rank, str) else rank
    run = _Run(df, col, memory, pr, survivors, max_passes)
    brackets: list[Bracket] = []

    def ranked() -> None:
        for q in qs:
            k1, k2 = spec.ranks(q, run.n)
            brackets.append(Bracket(k1, k2, run.lo, run.hi, run.lo, run.hi))

    if method == "kll":
        k = planner.kll_k(run.slots)
        got = run.start(F.expr(f"kll_sketch_agg_double(v, {k}) FILTER (WHERE NOT isnan(v))").alias("s"))
    else:
        run.start()
    if not run.n:
        return [Answer(q, None, run.passes) for q in qs]
    ranked()
    open_ = [b for b in brackets if b.k2 <= run.real]
    split = [b for b in brackets if b.k1 <= run.real < b.k2]
    for b in split:  # one rank is NaN, so the answer is
        b.found = {b.k1: math.nan, b.k2: math.nan}
    for b in brackets:
        if b.k1 > run.real:
            b.found = {b.k1: math.nan, b.k2: math.nan}
    if open_ and run.lo == run.hi:
        for b in open_:
            b.found = {b.k1: run.lo, b.k2: run.lo}
    elif open_ and method == "radix":
        coded = run.rows.where(~F.isnan("v")).select(order_code("v").alias("code"))
        codes, passes = radix_select(coded, "code", [k for b in open_ for k in (b.k1, b.k2)])
        run.passes += passes
        for b in open_:
            b.found = {k: float(decode_array([codes[k]])[0]) for k in (b.k1, b.k2)}
    elif open_ and method == "sort":
        _by_sort(run, open_)
    elif open_:
        if method == "kll":
            _from_kll(run, open_, got["s"], run.real, k)
        elif method == "ddsketch":
            _dd_brackets(run, open_)
        else:
            slots = run.slots
            makers = {"ledger": lambda: Compactor(slots), "mrl": lambda: Compactor(slots, random=False), "tdigest": lambda: Clusters(max(16, slots // 4)), "tdigest-tails": lambda: Clusters(max(16, slots // 4), tails=True), "sample": lambda: Sample(max(16, slots // 2))}
            _summary_brackets(run, open_, makers[method], run.certainty(len(open_)) if method == "ledger" else 1.0)
        if method != "kll":
            run.passes += 1
        _resolve(run, [b for b in open_ if not b.found])
    return [Answer(q, (b.found[b.k1] + b.found[b.k2]) * 0.5 if not math.isinf(b.found[b.k1] + b.found[b.k2]) else b.found[b.k1] * 0.5 + b.found[b.k2] * 0.5, run.passes) for q, b in zip(qs, brackets)]


def exact_quantiles(df: DataFrame, col: str | Column, qs: Sequence[float], **options) -> DataFrame:
    """(q, value, passes), a row per quantile; see ``solve``."""
    answers = solve(df, col, qs, **options)
    spark: SparkSession = df.sparkSession
    return spark.createDataFrame([(float(a.q), a.value, a.passes) for a in answers], "q double, value double, passes int")


def exact_quantile(df: DataFrame, col: str | Column, q: float, *, return_type: str = "value", **options) -> float | int | None:
    """One exact quantile, or with ``return_type='iteration_num'`` the passes it took."""
    answer = solve(df, col, [q], **options)[0]
    return answer.passes if return_type == "iteration_num" else answer.value


#: The aggregates' names and the method behind each.
SQL_NAMES = {
    "exact_quantile_pr_kll_post_best_pr": "kll",
    "exact_quantile_pr_kll_priori_best_pr": "ledger",
    "exact_quantile_pr_kll_priori_fix_pr": "ledger",
    "exact_quantile_mrl": "mrl",
    "exact_quantile_tdigest": "tdigest",
    "exact_quantile_ddsketch_positive": "ddsketch",
    "exact_quantile_quick_select": "sort",
}


def call(name: str, df: DataFrame, col: str, **attributes: str) -> DataFrame:
    """An aggregate by its SQL name with string attributes: quantile, multi_quantiles, memory, return_type, param, merge_buffer_ratio.

    ``exact_multi_quantiles_<m>`` takes ``multi_quantiles`` equally spaced quantiles.  Returns (q, value), the value being
    the number of passes for return_type 'iteration_num'.  merge_buffer_ratio matters to page summaries only
    (``synopsis.exact_quantile_from_pages``); Spark shares memory between buffers itself.
    """
    from ..functions.ranks import grid

    single = name.replace("exact_multi_quantiles", "exact_quantile")
    method = SQL_NAMES.get(single)
    if method is None:
        raise ValueError(f"no aggregate {name!r}; there are {sorted(SQL_NAMES)}")
    qs = grid(int(attributes["multi_quantiles"])) if "multi_quantiles" in attributes else [float(attributes.get("quantile", 0.5))]
    pr = float(attributes["param"]) if "param" in attributes and method == "ledger" else None
    got = exact_quantiles(df, col, qs, method=method, memory=attributes.get("memory", "1024KB"), pr=pr)
    return got.select("q", (F.col("passes").cast("double") if attributes.get("return_type") == "iteration_num" else F.col("value")).alias("value"))


#: Rows that a group's bracket may hold before it is narrowed again.
GROUP_ROWS = 1_000_000


#: A sketch per group is asked at this many equal steps, as the fractions must be constants.
STEPS = 128


def _near(sketch: str, n: str, eps: float, first: str, last: str) -> tuple[Column, Column]:
    """Sketched values at least ``eps`` of n below the rank ``first`` and above the rank ``last``; null beyond the ends."""
    low, high = (F.col(first) - 1) / F.col(n) - eps, F.col(last) / F.col(n) + eps
    every = F.kll_sketch_get_quantile_double(sketch, F.array(*[F.lit(i / STEPS) for i in range(STEPS + 1)]))
    at = lambda step: F.get(every, step.cast("int"))
    known = F.col(n) > 0
    return F.when(known & (low > 0), at(F.floor(low * STEPS))), F.when(known & (high < 1), at(F.ceil(high * STEPS)))


def grouped_exact_quantiles(df: DataFrame, by: Sequence[str], col: str, qs: Sequence[float], *, rank: RankSpec = MID, k: int = 200, width: float = 4.0, most: int = GROUP_ROWS) -> DataFrame:
    """(by..., q, n, value): a KLL sketch per group brackets each rank, counts decide, and brackets that missed start from the group's extremes.

    Two passes are usual.  Where a bracket may hold more than ``most`` rows, a third one between narrows it by a sketch of
    its own rows, so that a task sorts some hundredth of its group and not a tenth.  Rows outside the brackets are only counted;
    equal values inside are merged before the shuffle.  Nulls are ignored, NaN is greatest, a group without values has a
    null value.
    """
    rows = df.select(*by, F.col(col).cast("double").alias("v")).where(F.col("v").isNotNull())
    eps = width * planner.kll_error(k)
    sketch = f"kll_sketch_agg_double(v, {k})"
    stats = df.select(*by, F.col(col).cast("double").alias("v")).groupBy(*by).agg(F.count("v").alias("n"), F.count_if(F.col("v").isNotNull() & ~F.isnan("v")).alias("real"), F.expr(f"{sketch} FILTER (WHERE v IS NOT NULL AND NOT isnan(v))").alias("s"))
    k1, k2 = rank.columns(F.col("q"), F.col("n"))
    targets = stats.withColumn("q", F.explode(F.array(*[F.lit(float(q)) for q in qs]))).withColumn("k1", k1).withColumn("k2", k2)
    low, high = _near("s", "real", eps, "k1", "k2")
    small = F.col("real") <= 8 * k  # needs no bracket
    targets = targets.select(*by, "q", "n", "real", "k1", "k2", F.coalesce(F.when(~small, low), F.lit(-math.inf)).alias("lo"), F.coalesce(F.when(~small, high), F.lit(math.inf)).alias("hi"))
    targets = held(targets)  # a row per group and quantile

    def met(asked: DataFrame) -> DataFrame:
        t, r = asked.alias("t"), rows.where(~F.isnan("v")).alias("r")
        return r.join(t, [F.col(f"r.{c}").eqNullSafe(F.col(f"t.{c}")) for c in by]).select(*[F.col(f"t.{c}").alias(c) for c in by], "t.q", "t.n", "t.real", "t.k1", "t.k2", "t.lo", "t.hi", F.col("r.v").alias("v"))

    keys = [*by, "q", "n", "real", "k1", "k2", "lo", "hi"]
    inside = F.col("v").between(F.col("lo"), F.col("hi"))
    narrowed = targets
    wide = targets.where((F.col("k2") <= F.col("real")) & (F.col("real") * F.lit(2 * (eps + 1 / STEPS)) > most) & (F.col("real") > 8 * k))
    if wide.limit(1).count():
        got = met(wide).groupBy(*keys).agg(F.count_if(F.col("v") < F.col("lo")).alias("below"), F.count_if(inside).alias("inside"), F.expr(f"{sketch} FILTER (WHERE v BETWEEN lo AND hi)").alias("s"))
        got = got.withColumn("a", F.col("k1") - F.col("below")).withColumn("b", F.col("k2") - F.col("below"))
        low, high = _near("s", "inside", eps, "a", "b")
        hit = (F.col("a") >= 1) & (F.col("b") <= F.col("inside"))
        tight = got.select(*by, "q", F.when(hit, F.coalesce(low, "lo")).otherwise(F.lit(-math.inf)).alias("lo2"), F.when(hit, F.coalesce(high, "hi")).otherwise(F.lit(math.inf)).alias("hi2"))
        n_, t_ = targets.alias("n"), tight.alias("t")
        joined = n_.join(t_, [F.col(f"n.{c}").eqNullSafe(F.col(f"t.{c}")) for c in [*by, "q"]], "left")
        narrowed = held(joined.select(*[F.col(f"n.{c}") for c in [*by, "q", "n", "real", "k1", "k2"]], F.coalesce("t.lo2", "n.lo").alias("lo"), F.coalesce("t.hi2", "n.hi").alias("hi")))

    def picked(asked: DataFrame) -> DataFrame:
        place = F.when(F.col("v") > F.col("hi"), 1).when(F.col("v") < F.col("lo"), -1).otherwise(0)
        cells = met(asked).withColumn("side", place).groupBy(*keys[:-2], "side", F.when(F.col("side") == 0, F.col("v") + 0.0).alias("v")).agg(F.count("*").alias("c"))
        ranked = cells.withColumn("upto", F.sum("c").over(Window.partitionBy(*by, "q").orderBy("side", "v").rowsBetween(Window.unboundedPreceding, 0)))
        at = lambda k_: F.max(F.when((F.col(k_) <= F.col("upto")) & (F.col(k_) > F.col("upto") - F.col("c")) & (F.col("side") == 0), F.col("v")))
        return ranked.groupBy(*keys[:-2]).agg(at("k1").alias("a"), at("k2").alias("b")).withColumn("value", (F.col("a") + F.col("b")) * 0.5)

    final = held(picked(narrowed.where("k2 <= real")))
    out = final.where("value IS NOT NULL").select(*by, "q", "n", "value")
    out = out.unionByName(targets.where("n > 0 AND k2 > real").select(*by, "q", "n", F.lit(math.nan).alias("value")))
    out = out.unionByName(targets.where("n = 0").select(*by, "q", "n", F.lit(None).cast("double").alias("value")))
    if final.where("value IS NULL").limit(1).count():
        again = final.where("value IS NULL").select(*keys[:-2], F.lit(-math.inf).alias("lo"), F.lit(math.inf).alias("hi"))
        out = out.unionByName(picked(again).select(*by, "q", "n", "value"))
    return out
