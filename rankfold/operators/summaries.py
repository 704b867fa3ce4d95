"""Approximate summaries as plain DataFrames: relative-error buckets, equi-depth clusters, page histograms, bit prefixes, samples.

All are mergeable: rows of two summaries are united and aggregated again.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.places import range_part
from .cache import held

RUNNING = (Window.unboundedPreceding, 0)


def numbered(df: DataFrame, *order: str, name: str = "rn") -> DataFrame:
    """``numbered_of`` without the number of rows."""
    return numbered_of(df, *order, name=name)[0]


def numbered_of(df: DataFrame, *order: str, name: str = "rn") -> tuple[DataFrame, int]:
    """``df`` with the place of each row (from 1) in the given order, which should be total, and how many rows there are.

    Ranges of the order are counted and sorted; a row's place is its place in its range and the sizes of those before.  Rows
    are dealt by bounds kept in the plan and nothing is cached, so the result may be evaluated again at any time.  No task
    sees more than its ranges, and only the sizes reach the driver.
    """
    dealt = _parts(df, order)
    sizes = {r["_part"]: r["n"] for r in dealt.groupBy("_part").agg(F.count("*").alias("n")).collect()}
    carries, done = [], 0
    for p in sorted(sizes):
        carries.append((p, done))
        done += sizes[p]
    own = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return _with_carry(dealt.withColumn(name, own), carries, "long").withColumn(name, F.col(name) + F.col("_before")).drop("_part", "_before"), done


def _parts(df: DataFrame, order: tuple) -> DataFrame:
    """``df`` with ``_part``, the range that a row is in."""
    return df.withColumn("_part", range_part(df, *order))


def _with_carry(dealt: DataFrame, carries: list[tuple], kind: str) -> DataFrame:
    """``dealt`` with ``_before``, what the ranges before a row's hand on; a row per range is sent."""
    return dealt.join(F.broadcast(dealt.sparkSession.createDataFrame(carries, f"_part int, _before {kind}")), "_part")


def running_max(df: DataFrame, *order: str, value: str, name: str) -> DataFrame:
    """``df`` with the greatest ``value`` of the rows before each in the given total order, null for the first; no task sees more than its ranges."""
    dealt = _parts(df, order)
    tops = {r["_part"]: r["m"] for r in dealt.groupBy("_part").agg(F.max(value).alias("m")).collect()}
    carries, top = [], None
    for p in sorted(tops):
        carries.append((p, top))
        top = tops[p] if top is None else top if tops[p] is None else max(top, tops[p])
    own = F.max(value).over(Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    return _with_carry(dealt.withColumn(name, own), carries, df.schema[value].dataType.simpleString()).withColumn(name, F.greatest(name, "_before")).drop("_part", "_before")


def running_sum(df: DataFrame, *order: str, value: str, name: str) -> DataFrame:
    """``df`` with the sum of an integer ``value`` of each row and those before it in the given order."""
    dealt = _parts(df, order)
    sums = {r["_part"]: r["s"] for r in dealt.groupBy("_part").agg(F.sum(value).alias("s")).collect()}
    carries, done = [], 0
    for p in sorted(sums):
        carries.append((p, done))
        done += sums[p] or 0
    own = F.sum(value).over(Window.partitionBy("_part").orderBy(*order).rowsBetween(*RUNNING))
    return _with_carry(dealt.withColumn(name, own), carries, "long").withColumn(name, F.coalesce(name, F.lit(0)) + F.col("_before")).drop("_part", "_before")


def last_known(df: DataFrame, *order: str, value: str, name: str) -> DataFrame:
    """``df`` with the last ``value`` that is not null up to each row in the given order."""
    dealt = _parts(df, order)
    got = dealt.groupBy("_part").agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.struct(*order))).alias("v")).collect()
    last = {r["_part"]: r["v"] for r in got}
    carries, so_far = [], None
    for p in sorted(last):
        carries.append((p, so_far))
        so_far = so_far if last[p] is None else last[p]
    own = F.last(value, True).over(Window.partitionBy("_part").orderBy(*order).rowsBetween(*RUNNING))
    return _with_carry(dealt.withColumn(name, own), carries, df.schema[value].dataType.simpleString()).withColumn(name, F.coalesce(name, "_before")).drop("_part", "_before")


# --- DDSketch


def gamma(alpha: float) -> float:
    return 2 * alpha / (1 - alpha) + 1


def dd_index(v: Column, alpha: float) -> Column:
    """Bucket of a value's size: (gamma ** (i - 1), gamma ** i].  Rounded so that both ends of float error agree."""
    return F.ceil(F.round(F.ln(F.abs(v)) * F.lit(1 / math.log(gamma(alpha))), 9))


def dd_buckets(df: DataFrame, col: str, alpha: float = 0.01, zero: float = 1e-30) -> DataFrame:
    """(sign, idx, n, lo, hi): counts and extremes of each bucket; values within ``zero`` of 0 have sign and idx 0."""
    v = F.col(col).cast("double")
    sign = F.when(F.abs(v) <= zero, 0).otherwise(F.signum(v)).cast("int")
    idx = F.when(F.abs(v) <= zero, 0).otherwise(dd_index(F.when(F.abs(v) > zero, v), alpha)).cast("long")
    rows = df.where(F.col(col).isNotNull() & ~F.isnan(v))
    return rows.groupBy(sign.alias("sign"), idx.alias("idx")).agg(F.count("*").alias("n"), F.min(v).alias("lo"), F.max(v).alias("hi"))


def dd_merge(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).groupBy("sign", "idx").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def _in_order(buckets: DataFrame) -> Window:
    # the number of buckets depends on alpha and the range of values, not on the rows
    return Window.orderBy("sign", F.col("sign") * F.col("idx"))


def dd_quantile(buckets: DataFrame, q: float, alpha: float) -> DataFrame:
    """(q, sign, idx, estimate, exact, lo, hi): the first bucket whose running count exceeds q (n - 1).

    ``exact`` says that the bucket holds one value, which then is the answer.
    """
    n = buckets.agg(F.sum("n").alias("total"))
    placed = buckets.withColumn("upto", F.sum("n").over(_in_order(buckets).rowsBetween(*RUNNING))).crossJoin(F.broadcast(n))
    hit = placed.where(F.col("upto") > F.lit(float(q)) * (F.col("total") - 1)).orderBy("upto").limit(1)
    g = gamma(alpha)
    estimate = F.when(F.col("sign") == 0, 0.0).otherwise(F.col("sign") * 2 * F.pow(F.lit(g), F.col("idx")) / (1 + g))
    return hit.select(F.lit(float(q)).alias("q"), "sign", "idx", F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise(estimate).alias("estimate"), (F.col("lo") == F.col("hi")).alias("exact"), "lo", "hi")


def dd_collapse(buckets: DataFrame, limit: int) -> DataFrame:
    """At most ``limit`` buckets per sign: those of the smallest sizes fold into the smallest one that is kept."""
    by = Window.partitionBy("sign").orderBy(F.desc("idx"))
    ranked = buckets.withColumn("r", F.row_number().over(by))
    edge = F.min(F.when(F.col("r") <= limit, F.col("idx"))).over(Window.partitionBy("sign"))
    return ranked.withColumn("idx", F.greatest("idx", edge)).groupBy("sign", "idx").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def dd_collapse_both(buckets: DataFrame, limit: int) -> DataFrame:
    """At most ``limit`` buckets (or one per sign, if that is more): each sign keeps its share of them, the smallest sizes of both signs fold."""
    of = Window.partitionBy("sign")
    share = F.greatest(F.lit(1), F.floor(F.lit(limit) * F.col("own") / F.col("every")).cast("long"))
    every = buckets.agg(F.count("*").alias("every"))
    ranked = buckets.withColumn("own", F.count("*").over(of)).crossJoin(F.broadcast(every)).withColumn("r", F.row_number().over(of.orderBy(F.desc("idx"))))
    edge = F.min(F.when(F.col("r") <= share, F.col("idx"))).over(of)
    return ranked.withColumn("idx", F.greatest("idx", edge)).groupBy("sign", "idx").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))


# --- equi-depth clusters


def equi_depth_clusters(df: DataFrame, col: str, clusters: int, *tie: str) -> DataFrame:
    """(cluster, n, lo, hi, mean): ``clusters`` runs of equal count, the first ones one larger, as NTILE deals them."""
    placed, total = numbered_of(df.where(F.col(col).isNotNull()), col, *tie)
    small, extra = divmod(total, clusters)
    cut = extra * (small + 1)
    cluster = F.when(F.col("rn") <= cut, F.floor((F.col("rn") - 1) / (small + 1))).otherwise(extra + F.floor((F.col("rn") - 1 - cut) / max(small, 1))) + 1
    return placed.groupBy(cluster.cast("long").alias("cluster")).agg(F.count("*").alias("n"), F.min(col).alias("lo"), F.max(col).alias("hi"), F.avg(col).alias("mean"))


def cluster_bounds(clusters: DataFrame, k1: int, k2: int) -> DataFrame:
    """(lo1, hi1, lo2, hi2): extremes of the clusters that hold two ranks."""
    placed = clusters.withColumn("upto", F.sum("n").over(Window.orderBy("lo", "hi", "cluster").rowsBetween(*RUNNING)))
    holds = lambda k: (F.lit(k) <= F.col("upto")) & (F.lit(k) > F.col("upto") - F.col("n"))
    pick = lambda c, k, a: F.max(F.when(holds(k), F.col(c))).alias(a)
    return placed.agg(pick("lo", k1, "lo1"), pick("hi", k1, "hi1"), pick("lo", k2, "lo2"), pick("hi", k2, "hi2"))


def cluster_rank_bounds(clusters: DataFrame, x: float) -> DataFrame:
    """(least, most) number of rows at most x, as clusters know it."""
    inside = (F.col("lo") <= x) & (F.col("hi") > x)
    whole = F.coalesce(F.sum(F.when(F.col("hi") <= x, F.col("n"))), F.lit(0))
    return clusters.agg((whole + F.count_if(inside)).alias("least"), (whole + F.coalesce(F.sum(F.when(inside, F.col("n") - 1)), F.lit(0))).alias("most"))


# --- page histograms


def page_histogram(pages: DataFrame, page: str, col: str, every: int, start: int = 1, cells: int = 8) -> DataFrame:
    """(page, step, lo, hi, counts): order statistics ``start``, ``start + every``, ... of each page and counts in equal cells between.

    Values are integers; a cell is floor((hi - lo) / cells) + 1 wide.  Pages are bounded, so a page is one window; rows are dealt by page once.
    """
    placed = pages.where(F.col(col).isNotNull()).select(page, F.col(col).cast("long").alias("v")).withColumn("r", F.row_number().over(Window.partitionBy(page).orderBy("v")))
    placed = placed.withColumn("step", F.greatest(F.floor((F.col("r") - start) / every), F.lit(0)))
    step = Window.partitionBy(page, "step")
    bounded = placed.withColumn("lo", F.min("v").over(step)).withColumn("hi", F.max("v").over(step))
    cell = F.floor((F.col("v") - F.col("lo")) / (F.floor((F.col("hi") - F.col("lo")) / cells) + 1))
    counts = bounded.groupBy(page, "step", "lo", "hi", cell.alias("cell")).agg(F.count("*").alias("n"))
    return counts.groupBy(page, "step", "lo", "hi").agg(F.sum("n").alias("n"), F.array_sort(F.collect_list(F.struct("cell", "n"))).alias("counts"))


def may_hold(histogram: DataFrame, lo: float, hi: float) -> DataFrame:
    """The rows of a page histogram, or of any table with lo and hi, that can hold a value in [lo, hi]."""
    return histogram.where((F.col("lo") <= hi) & (F.col("hi") >= lo))


def combine_histograms(histogram: DataFrame, clusters: int) -> DataFrame:
    """(cluster, n, lo, hi): the steps of all pages in order, merged to about ``clusters`` clusters of equal count."""
    # the histogram is small beside its rows, and is read for its ranges, their sums and the result
    steps = held(histogram.select("page_id", "step", "lo", "hi", "n"))
    total = steps.agg(F.sum("n").alias("total"))
    placed = running_sum(steps, "lo", "hi", "page_id", "step", value="n", name="upto").crossJoin(F.broadcast(total))
    cluster = F.floor((F.col("upto") - F.col("n")) * F.lit(clusters) / F.col("total")).cast("long")
    return placed.groupBy(cluster.alias("cluster")).agg(F.sum("n").cast("long").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def rank_bounds(histogram: DataFrame, ranks: Sequence[int], cells: int = 8, page: str = "page_id") -> DataFrame:
    """(k, least, greatest, wide_least, wide_greatest): values that enclose the value of each rank (from 1), by the pages' steps and their cells.

    At least k values are at most x once cells that end by x hold k; fewer than k are, while cells that begin by x
    hold fewer.  The wide bounds are those by steps alone.  A rank beyond all values gives nulls.  The histogram is read a dozen
    times, so it is cached; it is small beside its rows.
    """
    histogram = held(histogram)
    width = F.floor((F.col("hi") - F.col("lo")) / cells) + 1
    begin = F.col("lo") + F.col("c.cell") * width
    parts = {
        "": histogram.select(page, "step", "lo", "hi", F.explode("counts").alias("c")).select(page, "step", F.col("c.cell").alias("cell"), begin.alias("lo"), F.least("hi", begin + width - 1).alias("hi"), F.col("c.n").alias("n")),
        "wide_": histogram.select(page, "step", F.lit(0).alias("cell"), "lo", "hi", "n"),
    }
    out = histogram.sparkSession.createDataFrame([(int(k),) for k in ranks], "k long")
    for name, table in parts.items():
        for end, bound in (("lo", "least"), ("hi", "greatest")):
            placed = running_sum(table, end, page, "step", "cell", value="n", name="upto")
            found = placed.agg(*[F.min(F.when(F.col("upto") >= int(k), F.col(end))).alias(str(i)) for i, k in enumerate(ranks)])
            long = found.select(F.explode(F.array(*[F.struct(F.lit(int(k)).cast("long").alias("k"), F.col(str(i)).alias(name + bound)) for i, k in enumerate(ranks)])).alias("r")).select("r.*")
            out = out.join(F.broadcast(long.distinct()), "k", "left")
    return out


_STEP = "<qqI8B"


def pack_histogram(histogram: DataFrame, page: str) -> DataFrame:
    """(page, state): each page's steps as bytes: lo, hi and n of a step, and the counts of its eight cells as shares of 255."""
    steps = F.array_sort(F.collect_list(F.struct("step", "lo", "hi", "n", F.transform("counts", lambda c: F.struct(c["cell"].alias("cell"), c["n"].alias("n"))).alias("counts"))))

    @F.pandas_udf("binary")
    def packed(lists: pd.Series) -> pd.Series:
        def one(rows) -> bytes:
            out = []
            for r in rows:
                cells = {int(c["cell"]): int(c["n"]) for c in r["counts"]}
                out.append(struct.pack(_STEP, int(r["lo"]), int(r["hi"]), int(r["n"]), *(min(255, -(-255 * cells.get(k, 0) // int(r["n"]))) for k in range(8))))
            return b"".join(out)

        return lists.map(one)

    return histogram.groupBy(page).agg(steps.alias("steps")).select(page, packed("steps").alias("state"))


def unpack_histogram(packed: DataFrame, page: str) -> DataFrame:
    """(page, step, lo, hi, n, shares) from the bytes."""

    @F.pandas_udf("array<struct<step: long, lo: long, hi: long, n: long, shares: array<int>>>")
    def loose(states: pd.Series) -> pd.Series:
        return states.map(lambda b: [{"step": k, "lo": lo, "hi": hi, "n": n, "shares": shares} for k, (lo, hi, n, *shares) in enumerate(struct.iter_unpack(_STEP, bytes(b)))])

    return packed.select(page, F.explode(loose("state")).alias("s")).select(page, "s.*")


# --- bit prefixes


def bit_prefixes(df: DataFrame, key: str, shift: int, weight: str | None = None) -> DataFrame:
    """(prefix, n): counts of integer keys by all but their lowest ``shift`` bits; at most 2**(64 - shift) rows."""
    return df.where(F.col(key).isNotNull()).groupBy(F.shiftright(F.col(key).cast("long"), shift).alias("prefix")).agg((F.sum(weight) if weight else F.count("*")).cast("long").alias("n"))


def prefix_of_ranks(prefixes: DataFrame, k1: int, k2: int) -> DataFrame:
    """(prefix1, before1, prefix2, before2): the prefixes that hold two ranks and the rows before each."""
    placed = running_sum(prefixes, "prefix", value="n", name="upto")
    holds = lambda k: (F.lit(k) <= F.col("upto")) & (F.lit(k) > F.col("upto") - F.col("n"))
    cols = []
    for i, k in ((1, k1), (2, k2)):
        cols += [F.max(F.when(holds(k), F.col("prefix"))).alias(f"prefix{i}"), F.max(F.when(holds(k), F.col("upto") - F.col("n"))).alias(f"before{i}")]
    return placed.agg(*cols)


def bounded_prefixes(df: DataFrame, key: str, most: int = 1 << 16) -> tuple[DataFrame, int]:
    """(prefix counts, shift) with the smallest shift that leaves at most ``most`` prefixes."""
    lo, hi = 0, 63
    while lo < hi:
        mid = (lo + hi) // 2
        few = bit_prefixes(df, key, mid).limit(most + 1).count() <= most
        lo, hi = (lo, mid) if few else (mid + 1, hi)
    return bit_prefixes(df, key, lo), lo


def merge_prefixes(a: tuple[DataFrame, int], b: tuple[DataFrame, int], most: int = 1 << 16) -> tuple[DataFrame, int]:
    """The prefix counts of two tables together, with the least shift, not under theirs, that leaves at most ``most`` prefixes."""
    (x, i), (y, j) = a, b
    lo, hi = max(i, j), 63
    at = lambda shift: x.select(F.shiftright("prefix", shift - i).alias("prefix"), "n").unionByName(y.select(F.shiftright("prefix", shift - j).alias("prefix"), "n")).groupBy("prefix").agg(F.sum("n").cast("long").alias("n"))
    while lo < hi:
        mid = (lo + hi) // 2
        lo, hi = (lo, mid) if at(mid).limit(most + 1).count() <= most else (mid + 1, hi)
    return at(lo), lo


def nested_window_select(df: DataFrame, col: str, q: float, sigmas: tuple[float, ...] = (4.0, 12.0), sample: int = 1000, seed: int = 233) -> DataFrame:
    """(q, n, level, value): the midpoint quantile from the narrowest window around the expected rank that holds its ranks.

    A sample of bounded size gives windows of so many standard deviations of its rank to each side, and the whole range as
    the last; one pass counts below and in all of them, the next only looks at values in the one chosen.
    """
    from ..functions.ranks import MID

    rows = df.select(F.col(col).cast("double").alias("v")).where(F.col("v").isNotNull())
    n, lo, hi = rows.agg(F.count("*"), F.min("v"), F.max("v")).first()
    spark = df.sparkSession
    schema = "q double, n long, level int, value double"
    if not n:
        return spark.createDataFrame([(float(q), 0, 0, None)], schema)
    drawn = sorted(r["v"] for r in rows.withColumn("r", F.rand(seed)).where(F.col("r") < 2.0 * sample / n).orderBy("r").limit(sample).select("v").collect())
    m, windows = len(drawn), []
    for s in sigmas:
        half = s * math.sqrt(max(m * q * (1 - q), 1.0))
        a, b = math.floor(q * m - half), math.ceil(q * m + half)
        windows.append((drawn[a] if 0 <= a < m else lo, drawn[b] if 0 <= b < m else hi))
    windows.append((lo, hi))
    got = rows.agg(*[x for i, (a, b) in enumerate(windows) for x in (F.count_if(F.col("v") < a).alias(f"b{i}"), F.count_if(F.col("v").between(a, b)).alias(f"i{i}"))]).first()
    k1, k2 = MID.ranks(q, n)
    level = next(i for i in range(len(windows)) if got[f"b{i}"] < k1 and k2 <= got[f"b{i}"] + got[f"i{i}"])
    a, b = windows[level]
    placed = numbered_weights(rows.where(F.col("v").between(a, b)).groupBy("v").agg(F.count("*").alias("w")))
    at = lambda k: F.max(F.when((F.lit(k) <= F.col("upto")) & (F.lit(k) > F.col("upto") - F.col("w")), F.col("v")))
    found = placed.agg(((at(k1 - got[f"b{level}"]) + at(k2 - got[f"b{level}"])) * 0.5).alias("value"))
    return found.select(F.lit(float(q)).alias("q"), F.lit(n).cast("long").alias("n"), F.lit(level).alias("level"), "value")


def window_around(df: DataFrame, col: str, lo: float, hi: float) -> DataFrame:
    """(below, inside, above): how many values lie below, in and above a guessed window."""
    v = F.col(col)
    return df.agg(F.count_if(v < lo).alias("below"), F.count_if(v.between(lo, hi)).alias("inside"), F.count_if(v > hi).alias("above"))


def weighted_quantile(df: DataFrame, col: str, weight: str, q: float) -> DataFrame:
    """(q, n, value): the midpoint quantile of values that count ``weight`` times each."""
    from ..functions.ranks import MID

    counts = df.where(F.col(col).isNotNull() & (F.col(weight) > 0)).groupBy(F.col(col).alias("v")).agg(F.sum(weight).cast("long").alias("w"))
    total = counts.agg(F.sum("w").alias("n"))
    k1, k2 = MID.columns(F.lit(float(q)), F.col("n"))
    placed = numbered_weights(counts).crossJoin(F.broadcast(total.withColumn("k1", k1).withColumn("k2", k2)))
    at = lambda k: F.max(F.when((F.col(k) <= F.col("upto")) & (F.col(k) > F.col("upto") - F.col("w")), F.col("v")))
    return placed.groupBy("n").agg(((at("k1") + at("k2")) * 0.5).alias("value")).select(F.lit(float(q)).alias("q"), "n", "value")


def numbered_weights(counts: DataFrame) -> DataFrame:
    """(v, w, upto) with running weights in the order of v, by ranges like ``numbered``."""
    return running_sum(held(counts.select("v", "w")), "v", value="w", name="upto")


# --- samples


def bottom_k(df: DataFrame, k: int, key: Column | None = None, seed: int = 233) -> DataFrame:
    """A simple random sample of k rows: those with the smallest key (random, or given to be repeatable)."""
    return df.withColumn("key", key if key is not None else F.rand(seed)).orderBy("key").limit(k)


def weighted_sample(df: DataFrame, weight: str, k: int, uniform: Column | None = None, seed: int = 233) -> DataFrame:
    """k rows with the largest u ** (1 / weight); a row is drawn in proportion to its weight.  Rows of no weight take no part."""
    u = uniform if uniform is not None else F.rand(seed)
    return df.where(F.col(weight) > 0).withColumn("key", F.pow(u, 1 / F.col(weight))).orderBy(F.desc("key")).limit(k)


def merge_samples(a: DataFrame, b: DataFrame, k: int, largest: bool = True) -> DataFrame:
    """The sample of the union of two disjoint sampled tables, from their keyed samples."""
    return a.unionByName(b).orderBy(F.desc("key") if largest else F.col("key")).limit(k)


def sample_quantile(sample: DataFrame, col: str, q: float) -> float | None:
    """The value at index trunc(q m) of a sorted sample; its extremes for q <= 0 and q >= 1."""
    got = [r[0] for r in sample.select(col).where(F.col(col).isNotNull()).orderBy(col).collect()]  # a sample is bounded
    return got[min(max(int(q * len(got)), 0), len(got) - 1)] if got else None


def sample_error(m: int) -> float:
    """Average rank error of a sample of m rows, as a share of all rows."""
    return m**-0.5 / 3
