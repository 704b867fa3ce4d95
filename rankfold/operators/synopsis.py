"""Summaries of pages and of their groups, kept as tables, and queries that combine them with raw rows.

A page is a run of rows in the order of time.  A page's row in the synopsis table holds its count, extremes of time and
value and a KLL sketch; groups of ``fan`` pages form nodes of higher levels.  A query over a time range takes the largest
nodes that lie inside, and raw rows at the edges and wherever late rows overlap a page.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.places import count_upto, doubles
from ..functions.ranks import MID, RankSpec
from . import exact as E
from .cache import held
from .sketches import Sample, tree_merge
from .summaries import last_known, numbered, numbered_weights, running_max, running_sum

PAGE_ROWS = 4096
LATE_POLICIES = ("ignore", "widen", "exact")


def paged(df: DataFrame, *order: str, rows: int = PAGE_ROWS) -> DataFrame:
    """``df`` with ``page_id``: ``rows`` rows to a page in the given total order."""
    return numbered(df, *order).withColumn("page_id", F.floor((F.col("rn") - 1) / rows).cast("long")).drop("rn")


def sketch_k(budget: int) -> int:
    """The parameter of a sketch that takes at most ``budget`` bytes when serialised: some four slots of eight bytes for each k, and a head."""
    return max(8, min(65_535, (budget - 256) // 32))


def synopsis(pages: DataFrame, t: str, v: str, k: int = 64, by: str = "page_id", budget: int | None = None) -> DataFrame:
    """(page_id, n, min_t, max_t, min_v, max_v, sketch) of each page; with ``budget`` each sketch takes at most so many bytes."""
    k = k if budget is None else sketch_k(budget)
    x = F.col(v).cast("double")
    return pages.groupBy(by).agg(F.count(x).alias("n"), F.min(t).alias("min_t"), F.max(t).alias("max_t"), F.min(x).alias("min_v"), F.max(x).alias("max_v"), F.expr(f"kll_sketch_agg_double(cast({v} as double), {k})").alias("sketch"))


def roll_up(pages: DataFrame, fan: int = 8, levels: int = 3, k: int | None = None, ratio: float = 1.0) -> DataFrame:
    """The synopsis of pages (level 0) and of ``fan`` nodes each for every higher level: adds level and node_id.

    ``k`` is the parameter of the merged sketches; a smaller one than the pages' makes them smaller.  With ``ratio`` it
    is multiplied by that at each level, so a node's sketch takes that share of what its parts' would as one.
    """
    # every level reads the pages, and they are much smaller than their rows
    level = held(pages).withColumn("level", F.lit(0)).withColumnRenamed("page_id", "node_id")
    out = level
    for at in range(1, levels + 1):
        merged = f"kll_merge_agg_double(sketch, {max(8, min(65_535, int(k * ratio**at)))})" if k else "kll_merge_agg_double(sketch)"
        level = level.groupBy(F.floor(F.col("node_id") / fan).cast("long").alias("node_id")).agg(F.sum("n").alias("n"), F.min("min_t").alias("min_t"), F.max("max_t").alias("max_t"), F.min("min_v").alias("min_v"), F.max("max_v").alias("max_v"), F.expr(merged).alias("sketch")).withColumn("level", F.lit(at))
        out = out.unionByName(level)
    return out


def cover(nodes: DataFrame, lo, hi, fan: int = 8) -> DataFrame:
    """The nodes that lie in [lo, hi) of time while their parents do not: a disjoint cover of all pages inside."""
    inside = nodes.where((F.col("min_t") >= lo) & (F.col("max_t") < hi))
    parents = inside.where("level > 0").select((F.col("level") - 1).alias("level"), F.col("node_id").alias("parent"))
    keyed = inside.withColumn("parent", F.floor(F.col("node_id") / fan).cast("long"))
    return keyed.join(parents, ["level", "parent"], "left_anti").drop("parent")


def clean_nodes(nodes: DataFrame, pages: DataFrame, fan: int = 8) -> DataFrame:
    """``nodes`` with ``clean``: no page outside a node overlaps its times.

    The pages that overlap a node are those that begin by its end less those that end before it begins; both are running
    counts over sorted times, so no pair of node and page is formed.
    """
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    asked = lambda end, kind: nodes.select(F.col(end).alias("t"), F.lit(kind).alias("kind"), "level", "node_id", zero.alias("one"))
    told = lambda end, kind: pages.select(F.col(end).alias("t"), F.lit(kind).alias("kind"), F.lit(None).cast("int").alias("level"), F.lit(None).cast("long").alias("node_id"), one.alias("one"))
    begun = running_sum(told("min_t", 0).unionByName(asked("max_t", 1)), "t", "kind", value="one", name="begun").where("level IS NOT NULL").select("level", "node_id", "begun")
    ended = running_sum(told("max_t", 1).unionByName(asked("min_t", 0)), "t", "kind", value="one", name="ended").where("level IS NOT NULL").select("level", "node_id", "ended")
    own = pages.select(F.col("page_id")).crossJoin(F.broadcast(nodes.select("level").distinct())).groupBy("level", F.floor(F.col("page_id") / F.pow(F.lit(fan), F.col("level"))).cast("long").alias("node_id")).agg(F.count("*").alias("own"))
    keys = ["level", "node_id"]
    return nodes.join(begun, keys).join(ended, keys).join(own, keys).withColumn("clean", F.col("begun") - F.col("ended") == F.col("own")).drop("begun", "ended", "own")


def cover_with_overlap(nodes: DataFrame, pages: DataFrame, lo, hi, fan: int = 8) -> DataFrame:
    """(level, node_id, n, use): how [lo, hi) of time is answered from files written in the order of arrival.

    ``merged`` nodes lie inside and overlap no page outside themselves, while their parents do not; all other pages that
    touch the range are read (``raw``).
    """
    pages, nodes = held(pages), held(nodes)
    good = held(clean_nodes(nodes, pages, fan).where((F.col("min_t") >= lo) & (F.col("max_t") < hi) & F.col("clean")))
    # a node goes if any node above it is taken; levels are few
    levels = sorted(r["level"] for r in nodes.select("level").distinct().collect())
    taken, out = None, None
    for level in reversed(levels):
        here = good.where(F.col("level") == level).select("level", "node_id", "n")
        if taken is not None:
            here = here.join(taken, "node_id", "left_anti")
        out = here if out is None else out.unionByName(here)
        inside = here.select("node_id") if taken is None else here.select("node_id").unionByName(taken)
        taken = inside.select(F.explode(F.sequence(F.col("node_id") * fan, F.col("node_id") * fan + fan - 1)).alias("node_id")) if level > levels[0] else inside
    touched = pages.where((F.col("min_t") < hi) & (F.col("max_t") >= lo)).select(F.col("page_id").alias("node_id"), "n")
    raw = touched.join(taken, "node_id", "left_anti").select(F.lit(levels[0]).alias("level"), "node_id", "n")
    return out.withColumn("use", F.lit("merged")).unionByName(raw.withColumn("use", F.lit("raw")))


def leveled(df: DataFrame, t: str, v: str, arrival: str, *tie: str, rows: int = PAGE_ROWS, fan: int = 8, levels: int = 3, k: int = 64) -> DataFrame:
    """Pages of rows in the order of arrival (level 0), and of the levels that ``fan`` runs of the level below are merged into.

    Columns level, page_id, run, n, min_t, max_t, min_v, max_v, sketch, total, live.  A run of level L is ``fan**L`` pages
    of arrivals, sorted by ``t`` anew and cut into pages of ``rows`` rows, so that late rows move to the pages of their
    time and pages overlap less from level to level.  ``live`` marks the pages that answer for their rows after compaction: those
    of the highest level whose run is full, level 0 for the newest.  n counts rows, total sums v.  ``arrival`` and ``tie`` make
    arrivals unique.  A null ``t`` comes first in its run.  Runs are sorted together by ranges of (run, t), so that no
    task holds a run.
    """
    first = paged(df.select(t, v, arrival, *tie), arrival, *tie, rows=rows)
    n = df.count()
    out = None
    for level in range(levels + 1):
        size = rows * fan**level
        here = first
        if level:
            run = first.withColumn("run", F.floor(F.col("page_id") / fan**level).cast("long")).drop("page_id")
            here = paged(run, "run", t, arrival, *tie, rows=rows).drop("run")
        run = F.floor(F.col("page_id") / fan**level).cast("long")
        full = lambda size: F.col("page_id") * rows < n // size * size
        live = (full(size) if level else F.lit(True)) & (~full(size * fan) if level < levels else F.lit(True))
        totals = here.groupBy("page_id").agg(F.count("*").alias("n"), F.sum(F.col(v).cast("double")).alias("total"))
        pages = synopsis(here, t, v, k).drop("n").join(totals, "page_id")
        got = pages.select(F.lit(level).alias("level"), "page_id", run.alias("run"), "n", "min_t", "max_t", "min_v", "max_v", "sketch", "total", live.alias("live"))
        out = got if out is None else out.unionByName(got)
    return out


def quantiles_from_cover(facts: DataFrame, nodes: DataFrame, t: str, v: str, qs: list[float], lo, hi, k: int = 64, fan: int = 8) -> DataFrame:
    """(q, value, n, rank_bound): quantiles of the rows in [lo, hi) of time from stored sketches; only edge pages' rows are read.

    ``facts`` holds page_id, t and v in pages in the order of t, ``nodes`` is their ``roll_up`` with sketches of parameter ``k``.  The
    cover's sketches and one of the edge rows are merged.  Of one sketch, ranks err by more than ``kll_error(k)`` of n in one case of a
    hundred; ``rank_bound`` is twice that.  A range without values gives nulls.
    """
    asked = E.doubles(qs)
    chosen = cover(nodes, lo, hi, fan).select("n", "sketch")
    pages = nodes.where("level = 0")
    inside = (F.col("min_t") >= lo) & (F.col("max_t") < hi)
    edges = pages.where(~inside & (F.col("min_t") < hi) & (F.col("max_t") >= lo)).select(F.col("node_id").alias("page_id"))
    x = F.col(v).cast("double")
    rows = facts.where((F.col(t) >= lo) & (F.col(t) < hi)).join(edges, "page_id", "left_semi").where(x.isNotNull())
    raw = rows.agg(F.count("*").alias("n"), F.expr(f"kll_sketch_agg_double(cast({v} as double), {k})").alias("sketch"))
    merged = chosen.unionByName(raw).where("n > 0").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.expr("kll_merge_agg_double(sketch)").alias("s"))
    values = F.when(F.col("n") > 0, F.kll_sketch_get_quantile_double("s", asked))
    answers = merged.select("n", F.explode(F.arrays_zip(asked.alias("q"), F.coalesce(values, F.array_repeat(F.lit(None).cast("double"), len(qs))).alias("value"))).alias("a"))
    return answers.select("a.q", "a.value", "n", (2 * E.planner.kll_error(k) * F.col("n") + 1).alias("rank_bound"))


def prune_by_value(pages: DataFrame, lo: float, hi: float) -> DataFrame:
    """(page_id, n, side): below pages count as a whole, above ones not at all; the others must be read."""
    side = F.when(F.col("max_v") < lo, "below").when(F.col("min_v") > hi, "above").otherwise("read")
    return pages.select("page_id", "n", side.alias("side"))


def exact_quantile_pruned(rows: DataFrame, pages: DataFrame, v: str, q: float, *, sample: int = 2000, rank: RankSpec = MID) -> DataFrame:
    """(q, value, n, rows_read): an exact quantile whose counting pass reads only pages that can hold values of the bracket.

    ``pages`` is the synopsis of ``rows`` (page_id, v).  A sample gives brackets of two widths and the extremes; the rows
    of pages below a bracket are counted from the synopsis.
    """
    spark, schema = rows.sparkSession, "q double, value double, n long, rows_read long"
    n = pages.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    values = rows.select("page_id", F.col(v).cast("double").alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v"))
    if not n:
        return spark.createDataFrame([(float(q), None, 0, 0)], schema)
    k1, k2 = rank.ranks(q, n)
    state = tree_merge(values.select("v"), "v", lambda: Sample(sample))
    read = 0
    for lo, hi in state.brackets(k1, k2):
        sides = prune_by_value(pages, lo, hi)
        counts = {r["side"]: r["n"] for r in sides.groupBy("side").agg(F.sum("n").alias("n")).collect()}
        read += counts.get("read", 0)
        inside = values.join(sides.where("side = 'read'").select("page_id"), "page_id", "left_semi")
        got = inside.agg(F.count_if(F.col("v") < lo).alias("below"), F.count_if(F.col("v").between(lo, hi)).alias("inside")).first()
        below = counts.get("below", 0) + got["below"]
        if below < k1 and k2 <= below + got["inside"]:
            break
    placed = numbered_weights(inside.where(F.col("v").between(lo, hi)).groupBy((F.col("v") + 0.0).alias("v")).agg(F.count("*").alias("w")))
    at = lambda k: F.max(F.when((F.lit(k) <= F.col("upto")) & (F.lit(k) > F.col("upto") - F.col("w")), F.col("v")))
    found = placed.agg(((at(k1 - below) + at(k2 - below)) * 0.5).alias("value"))
    return found.select(F.lit(float(q)).alias("q"), "value", F.lit(n).cast("long").alias("n"), F.lit(read).cast("long").alias("rows_read"))


def write_slabs(df: DataFrame, v: str, path: str, *tie: str, slabs: int = 64, k: int = 200) -> None:
    """Writes ``df`` below ``path`` in about ``slabs`` folders of ascending ranges of ``v``, and the synopsis of the folders beside them.

    Null values are in folder -1, NaN in folder ``slabs``.  Rows of a folder are sorted, so its files' own extremes prune
    inside it.  ``tie`` lets rows of one value go to several tasks.
    """
    spark = df.sparkSession
    x = F.col(v).cast("double")
    sketch = df.select(x.alias("x")).where(F.col("x").isNotNull() & ~F.isnan("x")).agg(F.expr(f"kll_sketch_agg_double(x, {max(k, 4 * slabs)})").alias("s"), F.count("*").alias("n")).first()
    cuts = sorted(set(E.sketch_quantiles(spark, sketch["s"], [i / slabs for i in range(1, slabs)]))) if sketch["n"] else []
    slab = F.when(x.isNull(), -1).when(F.isnan(x), slabs).otherwise(count_upto(doubles(cuts), len(cuts), x))
    df.withColumn("slab", slab.cast("int")).repartitionByRange("slab", v, *tie).sortWithinPartitions("slab", v).write.partitionBy("slab").parquet(f"{path}/rows")
    rows = spark.read.schema(f"`{v}` {df.schema[v].dataType.simpleString()}, slab int").parquet(f"{path}/rows")
    synopsis(rows, v, v, k, by="slab").write.parquet(f"{path}/synopsis")


def slab_rows(spark: SparkSession, path: str, lo: float, hi: float) -> DataFrame:
    """The rows of the slabs that can hold values in [lo, hi]: a condition on the folders, so no other is read."""
    ends = spark.read.parquet(f"{path}/synopsis").where((F.col("max_v") >= lo) & (F.col("min_v") <= hi)).agg(F.min("slab").alias("a"), F.max("slab").alias("b")).first()
    return spark.read.parquet(f"{path}/rows").where(F.col("slab").between(ends["a"], ends["b"]) if ends["a"] is not None else F.lit(False))


def exact_quantile_from_slabs(spark: SparkSession, path: str, v: str, q: float, *, rank: RankSpec = MID, k: int = 200) -> DataFrame:
    """(q, value, n, rows_read): the exact quantile of what ``write_slabs`` wrote; only the slab of its ranks, or two, are read.

    Counts of the slabs say which holds the ranks, without error; its sketch brackets them inside it.  NaN is greatest,
    nulls do not count, no values give null.
    """
    stored = spark.read.parquet(f"{path}/synopsis")
    slabs = [r for r in stored.select("slab", "n", "min_v", "max_v").orderBy("slab").collect() if r["n"]]  # as many as folders
    schema, n = "q double, value double, n long, rows_read long", sum(r["n"] for r in slabs)
    if not n:
        return spark.createDataFrame([(float(q), None, 0, 0)], schema)
    k1, k2 = rank.ranks(q, n)
    upto, chosen = 0, []
    for r in slabs:
        if upto < k2 and upto + r["n"] >= k1:
            chosen.append((r, upto))
        upto += r["n"]
    if chosen[-1][0]["max_v"] != chosen[-1][0]["max_v"]:
        return spark.createDataFrame([(float(q), float("nan"), n, 0)], schema)
    below, m = chosen[0][1], sum(r["n"] for r, _ in chosen)
    low, high = chosen[0][0]["min_v"], chosen[-1][0]["max_v"]
    own = F.col("slab").between(chosen[0][0]["slab"], chosen[-1][0]["slab"])
    run = E._Run(spark.read.parquet(f"{path}/rows").where(own), v, 8 * 3 * k, None, E.SURVIVORS, E.MAX_PASSES)
    run.n = run.real = m
    run.lo, run.hi = low, high
    bracket = E.Bracket(k1 - below, k2 - below, low, high, low, high)
    E._from_kll(run, [bracket], stored.where(own).agg(F.expr("kll_merge_agg_double(sketch)").alias("s")).first()["s"], m, k)
    E._resolve(run, [bracket])
    return spark.createDataFrame([(float(q), (bracket.found[k1 - below] + bracket.found[k2 - below]) * 0.5, n, m)], schema)


def rows_scanned(df: DataFrame) -> int:
    """Runs ``df`` and returns the rows that its scans of files gave out, by their metrics."""
    df.collect()
    total, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        elif name.endswith("QueryStageExec"):
            todo.append(node.plan())
        elif name == "FileSourceScanExec":
            total += node.metrics().get("numOutputRows").get().value()
        else:
            todo += [node.children().apply(i) for i in range(node.children().size())]
    return total


def prune_by_time(pages: DataFrame, lo, hi) -> DataFrame:
    """(page_id, use): ``whole`` pages lie in [lo, hi), ``edge`` pages overlap it."""
    use = F.when((F.col("min_t") >= lo) & (F.col("max_t") < hi), "whole").when((F.col("min_t") < hi) & (F.col("max_t") >= lo), "edge")
    return pages.select("page_id", use.alias("use")).where("use IS NOT NULL")


def split_late(events: DataFrame, t: str, arrival: str, flush_rows: int, *tie: str) -> DataFrame:
    """``events`` with ``flush`` (which batch of ``flush_rows`` arrivals) and ``is_late``: not after the times flushed before.

    What was flushed before is a running maximum over batches, in range partitions like the numbering of the rows.
    """
    placed = numbered(events, arrival, *tie).withColumn("flush", F.floor((F.col("rn") - 1) / flush_rows).cast("long")).drop("rn")
    ends = running_max(placed.groupBy("flush").agg(F.max(t).alias("m")), "flush", value="m", name="sealed").select("flush", "sealed")
    return placed.join(ends, "flush").withColumn("is_late", F.coalesce(F.col(t) <= F.col("sealed"), F.lit(False))).drop("sealed")


def overlapped(pages: DataFrame, late: DataFrame, t: str) -> DataFrame:
    """``pages`` with ``n_late`` (late rows within the page's times) and ``clean`` (none).

    Late times meet pages by the time cell of a page's width, an equi-join, before the exact test.
    """
    width = pages.agg(F.greatest(F.lit(1), F.max(F.unix_micros(F.col("max_t").cast("timestamp")) - F.unix_micros(F.col("min_t").cast("timestamp"))) + 1).alias("w")).first()["w"] or 1
    cell = lambda c: F.floor(F.unix_micros(F.col(c).cast("timestamp")) / width)
    p = pages.select("page_id", "min_t", "max_t").withColumn("cell", F.explode(F.sequence(cell("min_t"), cell("max_t"))))
    x = late.select(F.col(t).alias("t")).withColumn("cell", cell("t"))
    hits = p.join(x, "cell").where((F.col("t") >= F.col("min_t")) & (F.col("t") <= F.col("max_t"))).groupBy("page_id").agg(F.count("*").alias("n_late"))
    return pages.join(hits, "page_id", "left").withColumn("n_late", F.coalesce("n_late", F.lit(0))).withColumn("clean", F.col("n_late") == 0)


def exact_quantile_from_pages(facts: DataFrame, pages: DataFrame, t: str, v: str, q: float, lo, hi, *, late: DataFrame | None = None, late_policy: str = "exact", k: int = 256, width: float = 4.0, merge_buffer_ratio: int = 0, rank: RankSpec = MID) -> DataFrame:
    """(q, value, passes, rows_scanned): the exact quantile of the rows in [lo, hi), the first pass from page sketches.

    ``facts`` holds page_id, t and v of rows in time, ``late`` t and v of rows that came late and are kept apart.
    Policies: ``exact`` reads pages that late rows overlap and the late rows; ``ignore`` answers without the late rows;
    ``widen`` takes all page sketches and widens the ranks by half the late rows to each side, and still counts exactly.
    ``merge_buffer_ratio`` r leaves (r - 1) / r of the parameter k to the result, for parity with memory budgets.
    """
    if late_policy not in LATE_POLICIES:
        raise ValueError(f"late_policy {late_policy!r} is none of {LATE_POLICIES}")
    k = max(8, k * (merge_buffer_ratio - 1) // merge_buffer_ratio) if merge_buffer_ratio > 1 else k
    spans = pages.withColumn("clean", F.lit(True))
    here = late.where((F.col(t) >= lo) & (F.col(t) < hi)) if late is not None else None
    if here is not None and late_policy == "exact":
        spans = overlapped(pages, here, t)
    whole = (F.col("min_t") >= lo) & (F.col("max_t") < hi) & F.col("clean")
    inside = spans.where(whole)
    edges = spans.where(~whole & (F.col("min_t") < hi) & (F.col("max_t") >= lo)).select("page_id")
    in_time = facts.where((F.col(t) >= lo) & (F.col(t) < hi))
    raw = in_time.join(F.broadcast(edges) if edges.limit(100_001).count() <= 100_000 else edges, "page_id", "left_semi").select(F.col(v).cast("double").alias("v"))
    if here is not None and late_policy == "exact":
        raw = raw.unionByName(here.select(F.col(v).cast("double").alias("v")))
    raw = raw.where(F.col("v").isNotNull())
    from_raw = raw.agg(F.count("*").alias("n"), F.expr(f"kll_sketch_agg_double(v, {k})").alias("s"), F.min("v").alias("a"), F.max("v").alias("b"))
    from_pages = inside.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.expr("kll_merge_agg_double(sketch)").alias("s"), F.min("min_v").alias("a"), F.max("max_v").alias("b"))
    parts = from_raw.withColumn("raw", F.lit(True)).unionByName(from_pages.withColumn("raw", F.lit(False))).collect()
    spark = facts.sparkSession
    rows = in_time.select(F.col(v).cast("double").alias("v"))
    if here is not None and late_policy == "exact":
        rows = rows.unionByName(here.select(F.col(v).cast("double").alias("v")))
    n, scanned = sum(p["n"] for p in parts), sum(p["n"] for p in parts if p["raw"])
    schema = "q double, value double, passes int, rows_scanned long"
    if not n:
        return spark.createDataFrame([(float(q), None, 1, 0)], schema)
    k1, k2 = rank.ranks(q, n)
    slack = (here.count() // 2 if here is not None and late_policy == "widen" else 0)
    low, high = (f(p[c] for p in parts if p["n"]) for f, c in ((min, "a"), (max, "b")))
    sketches = spark.createDataFrame([(bytearray(p["s"]),) for p in parts if p["n"]], "s binary").agg(F.expr("kll_merge_agg_double(s)").alias("s")).first()["s"]
    run = E._Run(rows, "v", 8 * 3 * k, None, E.SURVIVORS, E.MAX_PASSES)
    run.n = run.real = n
    run.lo, run.hi, run.passes = low, high, 1
    wide = E.Bracket(max(1, k1 - slack), min(n, k2 + slack), low, high, low, high)
    error = width * E.planner.kll_error(min(k, 64)) + 2 / n
    ends = [max(0.0, (wide.k1 - 1) / n - error), min(1.0, wide.k2 / n + error)]
    got = E.sketch_quantiles(spark, sketches, ends)
    b = E.Bracket(k1, k2, got[0] if ends[0] > 0 else low, got[1] if ends[1] < 1 else high, low, high)
    E._resolve(run, [b])
    value = (b.found[k1] + b.found[k2]) * 0.5
    return spark.createDataFrame([(float(q), value, run.passes, scanned + (run.passes - 1) * n)], schema)


def rebuild_pages(facts: DataFrame, pages: DataFrame, late: DataFrame, t: str, v: str, k: int = 64) -> tuple[DataFrame, DataFrame]:
    """(facts, pages) after late rows are merged into the pages that they overlap; those pages' rows are summed up anew.

    A late row that overlaps no page joins the last page that begins before it, or the first page.
    """
    starts = pages.select("page_id", F.col("min_t").alias("begin"))
    marks = starts.select(F.col("begin").alias("t"), "page_id", F.lit(None).cast("double").alias("v"), F.lit(0).alias("kind"))
    x = late.select(F.col(t).alias("t"), F.lit(None).cast("long").alias("page_id"), F.col(v).cast("double").alias("v"), F.lit(1).alias("kind"))
    first = pages.agg(F.min_by("page_id", "min_t").alias("p")).first()["p"]
    # a look-back over late rows and page starts, in range partitions
    placed = last_known(marks.unionByName(x), "t", "kind", value="page_id", name="at").where("kind = 1").select("t", "v", F.col("at").alias("page_id"))
    joined = facts.select("page_id", F.col(t).alias("t"), F.col(v).cast("double").alias("v")).unionByName(placed.select(F.coalesce("page_id", F.lit(first)).alias("page_id"), "t", "v"))
    touched = placed.select(F.coalesce("page_id", F.lit(first)).alias("page_id")).distinct()
    anew = synopsis(joined.join(touched, "page_id", "left_semi"), "t", "v", k)
    return joined, pages.join(touched, "page_id", "left_anti").unionByName(anew)


def divide_chunk(chunk: DataFrame, page: str, v: str, compactions: int = 3, seed: int = 233) -> DataFrame:
    """(page, item, weight): a chunk is compacted as a whole and each surviving item goes to the page whose count lags most.

    ``chunk`` has a chunk_id; chunks are bounded like memory tables, each is one group.
    """
    import numpy as np
    import pandas as pd

    def divide(rows: pd.DataFrame) -> pd.DataFrame:
        rng = np.random.default_rng(seed)
        rows = rows.sort_values(v, kind="stable")
        step = 1 << compactions
        values, pages = rows[v].to_numpy(np.float64), rows[page].to_numpy()
        got, lag = [], dict.fromkeys(np.unique(pages).tolist(), 0.0)
        for a in range(0, len(values), step):
            run = pages[a : a + step]
            for p in run.tolist():
                lag[p] += 1
            if len(run) == step:
                at = a + int(rng.integers(step))
                to = max((p for p in set(run.tolist())), key=lambda p: lag[p])
                lag[to] -= step
                got.append((rows["chunk_id"].iloc[0], to, values[at], step))
            else:
                got += [(rows["chunk_id"].iloc[0], p, x, 1) for p, x in zip(run.tolist(), values[a : a + step])]
        return pd.DataFrame(got, columns=["chunk_id", "page", "item", "weight"])

    return chunk.select("chunk_id", page, F.col(v).cast("double").alias(v)).where(F.col(v).isNotNull()).groupBy("chunk_id").applyInPandas(divide, "chunk_id long, page long, item double, weight long")
