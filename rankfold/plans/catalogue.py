"""The queries by name: each applies one operator to a whole table."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import ranks as R
from ..operators import exact as E
from ..operators import misc, sketches, summaries, synopsis
from ..operators.cache import held
from ..sources import generators, text
from . import planner

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _exact(name: str, tab: str, col: str, q: float, **options) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return E.exact_quantiles(table(spark, sf_dir, tab).select(col), col, [q], **options).select("q", "value")

    QUERIES[name] = run


#: name: (table, column, q, options); the oracle of each is a sort.
EXACT = {
    "exact_q50_price": ("lineitem", "l_extendedprice", 0.5, {}),
    "exact_q999_price": ("lineitem", "l_extendedprice", 0.999, {}),
    "exact_q0_price": ("lineitem", "l_extendedprice", 0.0, {}),
    "exact_q100_price": ("lineitem", "l_extendedprice", 1.0, {}),
    "exact_fixed_pr_value": ("events", "value", 0.37, {"pr": 0.99}),
    "exact_bestpr_value": ("events", "value", 0.9, {"method": "ledger", "memory": "8KB"}),
    "exact_small_memory_price": ("lineitem", "l_extendedprice", 0.29, {"memory": "1KB", "survivors": 500}),
    "exact_mrl_totalprice": ("orders", "o_totalprice", 0.25, {"method": "mrl", "memory": "16KB"}),
    "exact_tdigest_retail": ("part", "p_retailprice", 0.75, {"method": "tdigest", "memory": "16KB"}),
    "exact_tdigest_tails_price": ("lineitem", "l_extendedprice", 0.9995, {"method": "tdigest-tails", "memory": "16KB"}),
    "exact_dd_price": ("lineitem", "l_extendedprice", 0.99, {"method": "ddsketch"}),
    "exact_dd_signed_acctbal": ("customer", "c_acctbal", 0.04, {"method": "ddsketch"}),
    "exact_sample_value": ("events", "value", 0.63, {"method": "sample", "memory": "8KB", "rank": "floor-ceil"}),
    "exact_radix_value": ("events", "value", 0.63, {"method": "radix"}),
    "exact_radix_acctbal": ("customer", "c_acctbal", 0.02, {"method": "radix"}),
    "exact_sort_price": ("lineitem", "l_extendedprice", 0.77, {"method": "sort"}),
    "exact_signed_acctbal": ("customer", "c_acctbal", 0.05, {}),
    "exact_ties_quantity": ("lineitem", "l_quantity", 0.51, {}),
    "exact_ties_discount": ("lineitem", "l_discount", 0.049, {"survivors": 4}),
    "exact_datasketches_value": ("events", "value", 0.41, {"rank": "floor-ceil", "memory": "4KB"}),
    "exact_trunc_value": ("events", "value", 0.87, {"rank": "trunc"}),
    "exact_median_value": ("events", "value", 0.5, {"rank": "median"}),
}
for _name, (_t, _c, _q, _o) in EXACT.items():
    _exact(_name, _t, _c, _q, **_o)


@query
def exact_sql_names(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_totalprice")
    out = None
    for name in sorted(E.SQL_NAMES):
        got = E.call(name, orders, "o_totalprice", quantile="0.5", memory="64KB").select(F.lit(name).alias("name"), "q", "value")
        out = got if out is None else out.unionByName(got)
    return out


@query
def multi_q32_price(spark, sf_dir):
    return E.exact_quantiles(table(spark, sf_dir, "lineitem"), "l_extendedprice", R.grid(32)).select("q", "value")


@query
def multi_q500_price(spark, sf_dir):
    """Many quantiles in the passes of one: brackets are swept, not compared one by one."""
    return E.exact_quantiles(table(spark, sf_dir, "lineitem"), "l_extendedprice", R.grid(500)).select("q", "value")


@query
def multi_q99_sort_value(spark, sf_dir):
    return E.exact_quantiles(table(spark, sf_dir, "events"), "value", R.grid(99), method="sort").select("q", "value")


@query
def exact_radix_custkey(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("long").alias("code"))
    n = orders.count()
    k1, k2 = R.MID.ranks(0.5, n)
    codes, _ = E.radix_select(orders, "code", [k1, k2])
    return spark.createDataFrame([(n, codes[k1], codes[k2])], "n long, low long, high long")


@query
def exact_radix_weighted(spark, sf_dir):
    part = table(spark, sf_dir, "part").groupBy(F.col("p_size").cast("long").alias("code")).agg(F.count("*").alias("w"))
    n = part.agg(F.sum("w")).first()[0]
    k1, k2 = R.MID.ranks(0.3, n)
    codes, _ = E.radix_select(part, "code", [k1, k2], weight="w")
    return spark.createDataFrame([(n, codes[k1], codes[k2])], "n long, low long, high long")


@query
def grouped_q_by_flag(spark, sf_dir):
    return E.grouped_exact_quantiles(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], "l_extendedprice", [0.1, 0.5, 0.9])


@query
def grouped_median_by_user(spark, sf_dir):
    return E.grouped_exact_quantiles(table(spark, sf_dir, "events"), ["user_id"], "value", [0.5])


@query
def range_q_shipdate(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").where("l_shipdate >= timestamp_ntz'1997-01-01' AND l_shipdate < timestamp_ntz'1998-01-01'")
    return E.exact_quantiles(rows, "l_extendedprice", [0.25, 0.5, 0.75]).select("q", "value")


@query
def rank_of_value(spark, sf_dir):
    probes = [901.0, 5000.0, 20000.5, 104000.0]
    v = F.col("l_extendedprice")
    one = table(spark, sf_dir, "lineitem").agg(*[x for i, p in enumerate(probes) for x in (R.rank_below(v, p).alias(f"b{i}"), R.rank_of(v, p).alias(f"u{i}"))])
    rows = F.explode(F.array(*[F.struct(F.lit(p).alias("probe"), F.col(f"b{i}").alias("below"), F.col(f"u{i}").alias("upto")) for i, p in enumerate(probes)]))
    return one.select(rows.alias("r")).select("r.*")


@query
def delta_rank(spark, sf_dir):
    v = F.col("l_quantity")
    return table(spark, sf_dir, "lineitem").agg(R.delta_rank(v, 10.0, 1).alias("before"), R.delta_rank(v, 10.0, F.count_if(v <= 10.0)).alias("inside"), R.delta_rank(v, 10.0, F.count(v)).alias("after"))


@query
def bracket_counts(spark, sf_dir):
    v = F.col("value")
    return table(spark, sf_dir, "events").agg(F.count_if(v < 20.0).alias("n_lt"), F.count_if(v == 20.0).alias("n_eq_lo"), F.count_if((v > 20.0) & (v < 80.0)).alias("n_in"), F.count_if(v == 80.0).alias("n_eq_hi"), F.count_if(v > 80.0).alias("n_gt"))


@query
def window_counts(spark, sf_dir):
    return summaries.window_around(table(spark, sf_dir, "events"), "value", 20.0, 80.0)


@query
def dd_buckets(spark, sf_dir):
    return summaries.dd_buckets(table(spark, sf_dir, "events"), "value", 0.01)


@query
def dd_signed_buckets(spark, sf_dir):
    return summaries.dd_buckets(table(spark, sf_dir, "customer"), "c_acctbal", 0.02)


@query
def dd_merged_buckets(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    a, b = (summaries.dd_buckets(lines.where(F.col("l_linenumber") % 2 == k), "l_extendedprice", 0.02) for k in (0, 1))
    return summaries.dd_merge(a, b)


@query
def dd_quantile(spark, sf_dir):
    got = summaries.dd_quantile(summaries.dd_buckets(table(spark, sf_dir, "events"), "value", 0.01), 0.9, 0.01)
    return got.select("q", "sign", "idx", F.round("estimate", 6).alias("estimate"), "exact", "lo", "hi")


@query
def dd_collapse(spark, sf_dir):
    return summaries.dd_collapse(summaries.dd_buckets(table(spark, sf_dir, "events"), "value", 0.01), 64)


@query
def equi_depth_clusters(spark, sf_dir):
    got = summaries.equi_depth_clusters(table(spark, sf_dir, "orders").select("o_totalprice", "o_orderkey"), "o_totalprice", 100, "o_orderkey")
    return got.withColumn("mean", F.round("mean", 4))


@query
def cluster_bounds(spark, sf_dir):
    return summaries.cluster_bounds(summaries.equi_depth_clusters(table(spark, sf_dir, "orders").select("o_totalprice", "o_orderkey"), "o_totalprice", 100, "o_orderkey"), 700, 701)


@query
def cluster_rank_bounds(spark, sf_dir):
    """The bounds enclose the true rank."""
    orders = table(spark, sf_dir, "orders").select("o_totalprice", "o_orderkey")
    got = summaries.cluster_rank_bounds(summaries.equi_depth_clusters(orders, "o_totalprice", 50, "o_orderkey"), 250_000.0)
    true = orders.agg(F.count_if(F.col("o_totalprice") <= 250_000.0).alias("true_rank"))
    return got.crossJoin(F.broadcast(true)).select("true_rank", ((F.col("least") <= F.col("true_rank")) & (F.col("true_rank") <= F.col("most"))).alias("enclosed"))


def _pages(spark, sf_dir) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_shipdate")
    return synopsis.paged(lines, "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_shipdate")


@query
def page_stats(spark, sf_dir):
    return synopsis.synopsis(_pages(spark, sf_dir), "l_orderkey", "l_extendedprice").drop("sketch")


@query
def page_histogram(spark, sf_dir):
    got = summaries.page_histogram(_pages(spark, sf_dir), "page_id", "l_extendedprice", 512)
    return got.select("page_id", "step", "lo", "hi", "n", F.explode("counts").alias("c")).select("page_id", "step", "lo", "hi", "n", F.col("c.cell").alias("cell"), F.col("c.n").alias("cell_n"))


@query
def page_prune_value(spark, sf_dir):
    return synopsis.prune_by_value(synopsis.synopsis(_events_pages(spark, sf_dir), "ts", "value"), 0.02, 150.0)


def _events_pages(spark, sf_dir) -> DataFrame:
    return synopsis.paged(table(spark, sf_dir, "events").select("event_id", "ts", "value"), "ts", "event_id", rows=512)


@query
def page_prune_time(spark, sf_dir):
    pages = synopsis.synopsis(_events_pages(spark, sf_dir), "ts", "value")
    return synopsis.prune_by_time(pages, F.expr("timestamp_ntz'2024-01-05'"), F.expr("timestamp_ntz'2024-01-17'"))


@query
def lsm_cover_nodes(spark, sf_dir):
    pages = synopsis.synopsis(synopsis.paged(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("t"), F.col("o_totalprice").alias("v")), "t", rows=64), "t", "v", k=16)
    ends = table(spark, sf_dir, "orders").agg(F.min("o_orderkey").alias("a"), F.max("o_orderkey").alias("b")).first()
    lo, hi = ends["a"] + (ends["b"] - ends["a"]) // 7, ends["a"] + (ends["b"] - ends["a"]) * 6 // 7
    got = synopsis.cover(synopsis.roll_up(pages, fan=4, levels=3), lo, hi, fan=4)
    return got.select("level", "node_id", "n", "min_t", "max_t")


@query
def pages_exact_q(spark, sf_dir):
    rows = synopsis.paged(table(spark, sf_dir, "events").select("event_id", F.col("ts").alias("t"), F.col("value").alias("v")), "t", "event_id", rows=256)
    pages = synopsis.synopsis(rows, "t", "v")
    got = synopsis.exact_quantile_from_pages(rows, pages, "t", "v", 0.5, F.expr("timestamp_ntz'2024-01-03 01:00:00'"), F.expr("timestamp_ntz'2024-01-21 05:00:00'"))
    return got.select("q", "value")


def _arrivals(spark, sf_dir) -> DataFrame:
    """Every tenth event arrives 3000 events late."""
    events = table(spark, sf_dir, "events").select("event_id", F.col("ts").alias("t"), F.col("value").alias("v"))
    return events.withColumn("arrival", F.col("event_id") * 10 + F.when(F.col("event_id") % 10 == 3, F.lit(3_001)).otherwise(0))


@query
def late_split(spark, sf_dir):
    return synopsis.split_late(_arrivals(spark, sf_dir), "t", "arrival", 200, "event_id").select("event_id", "flush", "is_late")


def _late_tables(spark, sf_dir):
    split = synopsis.split_late(_arrivals(spark, sf_dir), "t", "arrival", 200, "event_id")
    facts = synopsis.paged(split.where("NOT is_late").select("event_id", "t", "v"), "t", "event_id", rows=256)
    return facts, split.where("is_late").select("event_id", "t", "v")


@query
def late_overlap_pages(spark, sf_dir):
    facts, late = _late_tables(spark, sf_dir)
    return synopsis.overlapped(synopsis.synopsis(facts, "t", "v"), late, "t").select("page_id", "n", "n_late", "clean")


def _late_policy(policy: str) -> Query:
    def run(spark, sf_dir):
        facts, late = _late_tables(spark, sf_dir)
        lo, hi = F.expr("timestamp_ntz'2024-01-02'"), F.expr("timestamp_ntz'2024-01-25'")
        return synopsis.exact_quantile_from_pages(facts, synopsis.synopsis(facts, "t", "v"), "t", "v", 0.9, lo, hi, late=late, late_policy=policy).select("q", "value")

    return run


for _p in synopsis.LATE_POLICIES:
    QUERIES[f"late_policy_{_p}_q"] = _late_policy(_p)


@query
def late_rebuild_pages(spark, sf_dir):
    facts, late = _late_tables(spark, sf_dir)
    _, pages = synopsis.rebuild_pages(facts, synopsis.synopsis(facts, "t", "v"), late, "t", "v")
    return pages.agg(F.sum("n").cast("long").alias("n"), F.count("*").alias("pages"), F.min("min_v").alias("min_v"), F.max("max_v").alias("max_v"))


@query
def bit_prefix_pass1(spark, sf_dir):
    return summaries.bit_prefixes(table(spark, sf_dir, "orders"), "o_orderkey", 8)


@query
def bit_prefix_bounds(spark, sf_dir):
    return summaries.prefix_of_ranks(summaries.bit_prefixes(table(spark, sf_dir, "orders"), "o_orderkey", 8), 333, 901)


@query
def bit_prefix_bounded(spark, sf_dir):
    got, shift = summaries.bounded_prefixes(table(spark, sf_dir, "orders"), "o_custkey", 100)
    return got.agg((F.count("*") <= 100).alias("bounded"), F.sum("n").cast("long").alias("n"))


@query
def weighted_quantile(spark, sf_dir):
    part = table(spark, sf_dir, "part").withColumn("w", F.pmod("p_partkey", F.lit(23)) + 1)
    return summaries.weighted_quantile(part, "p_size", "w", 0.4)


@query
def frequency_merge(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_quantity").alias("v")).agg(F.count("*").alias("freq"))


@query
def bottomk_sample(spark, sf_dir):
    got = summaries.bottom_k(table(spark, sf_dir, "events").select("event_id", "value"), 500, F.md5(F.col("event_id").cast("string")))
    return got.select("event_id", "value")


def _unit(c: str):
    return (F.conv(F.substring(F.md5(F.col(c).cast("string")), 1, 8), 16, 10).cast("double") + 1) / 4294967297.0


@query
def weighted_sample(spark, sf_dir):
    got = summaries.weighted_sample(table(spark, sf_dir, "events").select("event_id", "value"), "value", 300, _unit("event_id"))
    return got.select("event_id", "value")


@query
def merged_sample(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", "value")
    a, b = (summaries.bottom_k(rows.where(F.pmod("event_id", F.lit(2)) == k), 200, F.md5(F.col("event_id").cast("string"))) for k in (0, 1))
    return summaries.merge_samples(a, b, 200, largest=False).select("event_id", "value")


@query
def kll_n_by_page_merge(spark, sf_dir):
    days = table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("day")).agg(F.expr("kll_sketch_agg_double(value, 64)").alias("s"))
    return days.agg(F.expr("kll_sketch_get_n_double(kll_merge_agg_double(s))").alias("n"))


def _within(spark, sf_dir, estimates: DataFrame, bound: float) -> DataFrame:
    """(q, within): whether each estimate's rank is off by no more than ``bound`` of all rows."""
    events = table(spark, sf_dir, "events").select("value")
    joined = events.crossJoin(F.broadcast(estimates))
    ranks = joined.groupBy("q", "v").agg(F.count_if(F.col("value") < F.col("v")).alias("below"), F.count_if(F.col("value") <= F.col("v")).alias("upto"), F.count("*").alias("n"))
    return ranks.select("q", ((F.col("q") * F.col("n") >= F.col("below") - bound * F.col("n")) & (F.col("q") * F.col("n") <= F.col("upto") + bound * F.col("n"))).alias("within"))


QS = [0.01, 0.1, 0.25, 0.5, 0.75, 0.9, 0.99]


@query
def kll_within_bound(spark, sf_dir):
    array = "array(" + ", ".join(f"{q}D" for q in QS) + ")"
    sketch = table(spark, sf_dir, "events").agg(F.expr("kll_sketch_agg_double(value, 200)").alias("s"))
    got = sketch.select(F.posexplode(F.expr(f"kll_sketch_get_quantile_double(s, {array})")).alias("i", "v"))
    got = got.select(F.element_at(F.array(*[F.lit(q) for q in QS]), F.col("i") + 1).alias("q"), "v")
    return _within(spark, sf_dir, got, 4 * planner.kll_error(200))


@query
def approx_percentile_within_bound(spark, sf_dir):
    got = table(spark, sf_dir, "events").agg(F.percentile_approx("value", QS, 1000).alias("p")).select(F.posexplode("p").alias("i", "v"))
    return _within(spark, sf_dir, got.select(F.element_at(F.array(*[F.lit(q) for q in QS]), F.col("i") + 1).alias("q"), "v"), 0.002)


def _own(spark, sf_dir, make, bound: float) -> DataFrame:
    events = table(spark, sf_dir, "events").select("value")
    summary = sketches.tree_merge(events, "value", make)
    n = events.count()
    rows = []
    for q in QS:
        k1, k2 = R.MID.ranks(q, n)
        lo, hi = summary.bracket(k1, k2, 1.0)
        rows.append((q, float(lo), float(hi), k1, k2))
    brackets = spark.createDataFrame(rows, "q double, lo double, hi double, k1 long, k2 long")
    counts = events.crossJoin(F.broadcast(brackets)).groupBy("q", "k1", "k2").agg(F.count_if(F.col("value") < F.col("lo")).alias("below"), F.count_if(F.col("value") <= F.col("hi")).alias("upto"), F.count("*").alias("n"))
    return counts.select("q", ((F.col("below") < F.col("k1")) & (F.col("k2") <= F.col("upto")) & (F.col("upto") - F.col("below") <= bound * F.col("n"))).alias("within"))


@query
def ledger_bracket_sure(spark, sf_dir):
    return _own(spark, sf_dir, lambda: sketches.Compactor(2048), 0.25)


@query
def mrl_bracket_sure(spark, sf_dir):
    return _own(spark, sf_dir, lambda: sketches.Compactor(2048, random=False), 0.25)


@query
def tdigest_bracket_sure(spark, sf_dir):
    return _own(spark, sf_dir, lambda: sketches.Clusters(512), 0.25)


@query
def delete_rank(spark, sf_dir):
    return misc.rank_after_deletes(table(spark, sf_dir, "orders"), "o_totalprice", F.col("o_orderstatus") == "F", [50_000.0, 150_000.0, 400_000.0])


@query
def change_only(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("user_id", "event_type", "ts", "event_id")
    return text.change_only(events, "user_id", ["ts", "event_id"], "event_type").select("event_id", "user_id", "event_type")


@query
def run_limited(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("user_id", "event_type", "ts", "event_id")
    return text.run_limited(events, "user_id", ["ts", "event_id"], "event_type", 1).select("event_id", "user_id", "event_type")


@query
def csv_try_cast(spark, sf_dir):
    """Numbers inside the JSON text of events, cells that are none skipped."""
    lines = table(spark, sf_dir, "events").select("event_id", F.concat_ws(",", F.col("event_type"), F.regexp_extract("props", r"([0-9.]+)", 1), F.col("value").cast("string")).alias("value"))
    return text.csv_columns(lines, [0, 1]).groupBy("col").agg(F.count("*").alias("n"), F.round(F.sum("v"), 4).alias("total"))


@query
def csv_flatten(spark, sf_dir):
    lines = table(spark, sf_dir, "part").select("p_partkey", F.concat_ws(",", "p_brand", "p_size", "p_partkey").alias("value"))
    return text.csv_flatten(lines).groupBy("col").agg(F.count("*").alias("n"), F.sum("v").alias("total"))


@query
def median_page_stat(spark, sf_dir):
    events = table(spark, sf_dir, "events").select(F.to_date("ts").cast("string").alias("day"), "value")
    return E.grouped_exact_quantiles(events, ["day"], "value", [0.5], rank=R.MEDIAN)


@query
def interval_mass(spark, sf_dir):
    return misc.interval_mass(table(spark, sf_dir, "lineitem"), "l_extendedprice", 20_000.0, 40_000.0).withColumn("share", F.round("share", 9))


@query
def arith_progressions(spark, sf_dir):
    part = table(spark, sf_dir, "part").select((F.col("p_size") + 60 * F.pmod("p_partkey", F.lit(7))).alias("x"))
    return misc.arithmetic_progressions(part, "x", 4, 60)


@query
def coverage_odd_even(spark, sf_dir):
    return misc.odd_even_coverage(table(spark, sf_dir, "events").select("value", "event_id"), "value", 9, "event_id").withColumn("place", F.round("place", 6))


@query
def error_stats(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select((F.col("l_extendedprice") - 38_000.0).alias("e"))
    return misc.error_stats(lines, "e").select("n", F.round("mean", 4).alias("mean"), F.round("stddev", 4).alias("stddev"))


@query
def bloom_probe(spark, sf_dir):
    """No key is missed, and few others are taken for keys."""
    orders, customers = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    n = customers.count()
    bloom = misc.bloom_build(orders, "o_custkey", n, 0.01)
    keys = customers.select(F.col("c_custkey").alias("k")).unionByName(customers.select((-1 - F.col("c_custkey")).alias("k")))
    true = orders.select(F.col("o_custkey").alias("k")).distinct().withColumn("is_key", F.lit(True))
    got = misc.bloom_probe(keys, "k", bloom, n, 0.01).join(true.hint("merge"), "k", "left").withColumn("is_key", F.coalesce("is_key", F.lit(False)))
    return got.agg(F.count_if(F.col("is_key")).alias("keys"), F.count_if(F.col("is_key") & F.col("might_contain")).alias("found"), (F.count_if(~F.col("is_key") & F.col("might_contain")) <= 0.05 * F.count("*")).alias("few_false"))


@query
def distinct_values(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").agg(F.count_distinct("l_extendedprice").alias("n_distinct"), F.count_distinct("l_quantity").alias("n_quantity"))


@query
def prefix_sums(spark, sf_dir):
    """Running counts of a bounded histogram: the relational difference array."""
    counts = table(spark, sf_dir, "lineitem").groupBy("l_quantity").agg(F.count("*").alias("n"))
    return counts.withColumn("upto", F.sum("n").over(Window.orderBy("l_quantity").rowsBetween(Window.unboundedPreceding, 0)))


@query
def stream_daily_kll_n(spark, sf_dir):
    from ..streaming.windows import drain, windowed_sketches

    batch = table(spark, sf_dir, "events")
    stream = spark.readStream.schema(batch.schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    got = drain(windowed_sketches(stream, "ts", "value", "1 day"), "rankfold_daily")
    return got.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "n", F.expr("kll_sketch_get_n_double(sketch)").alias("sketch_n"), "lo", "hi")


# --- sources and generators


def _size(spark, sf_dir, name: str) -> int:
    return table(spark, sf_dir, name).count()


@query
def gen_sequence(spark, sf_dir):
    """A series as long as the events."""
    return generators.sequence(spark, _size(spark, sf_dir, "events"))


@query
def gen_permutation(spark, sf_dir):
    """The events' places in random order."""
    made = generators.permutation(spark, _size(spark, sf_dir, "events"))
    return made.agg(F.count("*").alias("n"), F.count_distinct("v").alias("n_values"), F.sum("pos").alias("pos_sum"), F.sum("v").alias("v_sum"))


@query
def gen_ordered_uniform(spark, sf_dir):
    return generators.page_values(spark, _size(spark, sf_dir, "events"), "ordered-uniform")


@query
def gen_out_of_order(spark, sf_dir):
    """An arrival for each of the orders."""
    rows = generators.out_of_order(spark, _size(spark, sf_dir, "orders"))
    return rows.agg(F.count("*").alias("n"), F.min("event_time").alias("first"), F.max("event_time").alias("last"), F.count_if(F.col("arrival") < F.col("event_time")).alias("n_early"), F.count("v").alias("n_values"))


@query
def gen_random(spark, sf_dir):
    """(name, n, n_inside): values of each distribution, one for each line item, and how many lie where all must."""
    n = _size(spark, sf_dir, "lineitem")
    made = {"uniform": (generators.uniform(spark, n), 0.0, 1.0), "gaussian": (generators.gaussian(spark, n), -9.0, 9.0), "log-normal": (generators.log_normal(spark, n), 54.0, 55.2)}
    return reduce(DataFrame.unionByName, [df.agg(F.count("v").alias("n"), F.count_if(F.col("v").between(lo, hi)).alias("n_inside")).select(F.lit(name).alias("name"), "n", "n_inside") for name, (df, lo, hi) in made.items()])


@query
def gen_random_ranges(spark, sf_dir):
    """A query workload over the events: a range of a fiftieth of their places for every hundred of them."""
    n = _size(spark, sf_dir, "events")
    ranges = generators.random_ranges(spark, n, n // 50, n // 100)
    return ranges.agg(F.count("*").alias("n"), F.min(F.col("b") - F.col("a")).alias("least"), F.max(F.col("b") - F.col("a")).alias("most"), F.count_if((F.col("a") >= 0) & (F.col("b") <= n)).alias("n_inside"))


@query
def gen_cyclic(spark, sf_dir):
    """The regions' keys in turn, one for each order."""
    keys = [r[0] for r in table(spark, sf_dir, "region").select("r_regionkey").orderBy("r_regionkey").limit(64).collect()]
    return text.cyclic(spark, keys, _size(spark, sf_dir, "orders"), noise=0.0)


@query
def text_round_trip(spark, sf_dir):
    """A column written as text and read again."""
    path = text.scratch_path(spark, "column")
    text.write_column(table(spark, sf_dir, "events"), path, "value", banner="value", rows_per_file=5000)
    return text.read_column(spark, path).agg(F.count("v").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.round(F.sum("v"), 4).alias("total"))


@query
def summary_round_trip(spark, sf_dir):
    """Page sketches written as a table and read again."""
    path = text.scratch_path(spark, "pages")
    text.write_summary(synopsis.synopsis(_events_pages(spark, sf_dir), "ts", "value"), path)
    return spark.read.parquet(path).select("page_id", "n", F.expr("kll_sketch_get_n_double(sketch)").alias("sketch_n"), "min_v", "max_v")


# --- summaries with states


def _state(spark, sf_dir, make):
    """A summary of supplier balances, through its bytes."""
    return sketches.load(sketches.tree_merge(table(spark, sf_dir, "supplier").select(F.col("s_acctbal").cast("double").alias("v")), "v", make).to_bytes())


def _ranks(make) -> Query:
    def run(spark, sf_dir):
        state = _state(spark, sf_dir, make)
        return spark.createDataFrame([(x, int(round(state.rank(x)))) for x in (-500.0, 0.0, 2500.0, 9000.0)], "probe double, rank long")

    return run


#: No summary here gives anything up: suppliers are fewer than their slots, so ranks are exact after bytes and merges.
QUERIES["ledger_bytes_rank"] = _ranks(lambda: sketches.Compactor(1 << 16))
QUERIES["mrl_bytes_rank"] = _ranks(lambda: sketches.Compactor(1 << 16, random=False))
QUERIES["cluster_bytes_rank"] = _ranks(lambda: sketches.Clusters(1 << 16))


@query
def sample_state(spark, sf_dir):
    """(n, kept, low, high): a sample's state after bytes and merges; it keeps at most 64 values but knows count and extremes."""
    got = _state(spark, sf_dir, lambda: sketches.Sample(64))
    return spark.createDataFrame([(got.n, len(got.values), float(got.low), float(got.high))], "n long, kept long, low double, high double")


@query
def sample_small_q(spark, sf_dir):
    """Sample brackets of two widths with rollback; the value is exact."""
    return E.exact_quantiles(table(spark, sf_dir, "lineitem").select("l_extendedprice"), "l_extendedprice", [0.2, 0.5, 0.95], method="sample", memory="4KB").select("q", "value")


@query
def exact_shortcut_q(spark, sf_dir):
    """A summary that holds everything answers without another pass: (q, value, passes)."""
    return E.exact_quantiles(table(spark, sf_dir, "nation").select("n_nationkey"), "n_nationkey", [0.25, 0.5, 0.9], method="ledger").select("q", "value", "passes")


@query
def exact_iteration_num(spark, sf_dir):
    """Passes of a sort, as the aggregate reports them."""
    return E.call("exact_quantile_quick_select", table(spark, sf_dir, "part").select("p_retailprice"), "p_retailprice", quantile="0.5", return_type="iteration_num")


@query
def divided_chunk_weight(spark, sf_dir):
    chunk = table(spark, sf_dir, "orders").select(F.floor(F.col("o_orderkey") / 4096).cast("long").alias("chunk_id"), F.floor(F.col("o_orderkey") / 256).cast("long").alias("page"), F.col("o_totalprice").alias("v"))
    return synopsis.divide_chunk(chunk, "page", "v").groupBy("chunk_id").agg(F.sum("weight").cast("long").alias("weight"))


@query
def sketched_delete_rank(spark, sf_dir):
    """(probe, rank, within): true ranks without deleted rows, and whether two sketches' difference errs no more than both may."""
    orders, probes, k = table(spark, sf_dir, "orders"), [50_000.0, 150_000.0, 400_000.0], 1000
    got = misc.rank_after_deletes_sketched(orders, "o_totalprice", F.col("o_orderstatus") == "F", probes, k)
    exact = misc.rank_after_deletes(orders, "o_totalprice", F.col("o_orderstatus") == "F", probes)
    n = orders.agg(F.count("*").alias("every"))
    both = exact.select("probe", F.col("rank").alias("true")).join(got, "probe").crossJoin(F.broadcast(n))
    return both.select("probe", F.col("true").alias("rank"), (F.abs(F.col("rank") - F.col("true")) <= F.col("every") * F.lit(8 * planner.kll_error(k))).alias("within"))


@query
def bloom_round_trip(spark, sf_dir):
    """A filter written with its parameters and read again misses no key."""
    orders = table(spark, sf_dir, "orders")
    n, path = table(spark, sf_dir, "customer").count(), text.scratch_path(spark, "bloom")
    misc.bloom_write(misc.bloom_build(orders, "o_custkey", n, 0.02), path, n, 0.02)
    bloom, expected, fpp = misc.bloom_read(spark, path)
    got = misc.bloom_probe(orders.select("o_custkey").distinct(), "o_custkey", bloom, expected, fpp)
    return got.agg(F.count("*").alias("keys"), F.count_if("might_contain").alias("found")).withColumn("expected", F.lit(expected).cast("long")).withColumn("fpp", F.lit(fpp))


# --- the planner


@query
def planner_bloom_sizes(spark, sf_dir):
    """(keys, fpp, bits, hashes) of filters for each table's keys."""
    counts = [table(spark, sf_dir, t).count() for t in ("supplier", "customer", "orders")]
    return spark.createDataFrame([(n, p, *planner.bloom_size(n, p)) for n in counts for p in (0.1, 0.01)], "keys long, fpp double, bits long, hashes long")


# --- more of pages, buckets and prefixes


@query
def dd_collapse_both(spark, sf_dir):
    return summaries.dd_collapse_both(summaries.dd_buckets(table(spark, sf_dir, "customer"), "c_acctbal", 0.02), 60)


@query
def dd_shifted_q(spark, sf_dir):
    """Signed values by way of the positive domain: v - min + 1 is bucketed, the row found there has the answer."""
    rows = table(spark, sf_dir, "customer").select(F.col("c_acctbal").alias("v"))
    low = rows.agg(F.min("v")).first()[0]
    shifted = rows.withColumn("s", F.col("v") - F.lit(low) + 1.0)
    got = E.exact_quantiles(shifted, "s", [0.1, 0.6], method="ddsketch").select("q", F.round(F.col("value") + F.lit(low) - 1.0, 6).alias("value"))
    return got


@query
def merged_prefixes(spark, sf_dir):
    """Prefix counts of two halves with shifts of their own, brought to one."""
    orders = table(spark, sf_dir, "orders")
    a, b = (summaries.bounded_prefixes(orders.where(F.col("o_orderkey") % 2 == k), "o_custkey", most) for k, most in ((0, 80), (1, 30)))
    got, shift = summaries.merge_prefixes(a, b, 50)
    return got.withColumn("shift", F.lit(shift).cast("long"))


@query
def nested_window_q(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_extendedprice")
    return reduce(DataFrame.unionByName, [summaries.nested_window_select(lines, "l_extendedprice", q).select("q", "n", "value") for q in (0.03, 0.5)])


@query
def nested_window_fallback_q(spark, sf_dir):
    """Windows of no width miss, so the whole range answers."""
    return summaries.nested_window_select(table(spark, sf_dir, "events"), "value", 0.37, sigmas=(0.0, 0.0), sample=8).select("q", "n", "value")


@query
def histogram_combine(spark, sf_dir):
    return summaries.combine_histograms(summaries.page_histogram(_pages(spark, sf_dir), "page_id", "l_extendedprice", 512), 20)


@query
def histogram_bytes(spark, sf_dir):
    """Page histograms through their bytes; shares of cells are rounded up to 255ths."""
    got = summaries.unpack_histogram(summaries.pack_histogram(summaries.page_histogram(_pages(spark, sf_dir), "page_id", "l_extendedprice", 512), "page_id"), "page_id")
    return got.select("page_id", "step", "lo", "hi", "n", F.get("shares", F.lit(0)).alias("share0"), F.get("shares", F.lit(7)).alias("share7"))


@query
def page_sketch_budget(spark, sf_dir):
    """(page_id, n, fits): every page's sketch takes at most its budget and has seen all rows."""
    pages = synopsis.synopsis(_events_pages(spark, sf_dir), "ts", "value", budget=2048)
    return pages.select("page_id", F.expr("kll_sketch_get_n_double(sketch)").alias("n"), (F.octet_length("sketch") <= 2048).alias("fits"))


@query
def rollup_ratio(spark, sf_dir):
    """(level, node_id, n): sketches of higher levels, each half as fine as the level's below, have seen all rows."""
    pages = synopsis.synopsis(_events_pages(spark, sf_dir), "ts", "value", k=64)
    return synopsis.roll_up(pages, fan=4, levels=2, k=64, ratio=0.5).select("level", "node_id", F.expr("kll_sketch_get_n_double(sketch)").alias("n"))


@query
def leveled_compaction(spark, sf_dir):
    """Pages of each level after runs of four pages in the order of arrival are sorted by time anew, level by level."""
    levels = synopsis.leveled(_arrivals(spark, sf_dir), "t", "v", "arrival", "event_id", rows=64, fan=4, levels=3)
    return levels.select("level", "page_id", "n", "min_t", "max_t", F.round("total", 4).alias("total"), "live")


@query
def cover_quantile(spark, sf_dir):
    """(q, n, value, within, tight): a range's quantiles from a cover of stored sketches and its edge rows, beside the exact value."""
    facts = held(_events_pages(spark, sf_dir))
    lo, hi = F.expr("timestamp_ntz'2024-01-03 05:00:00'"), F.expr("timestamp_ntz'2024-01-22 19:00:00'")
    qs = [0.05, 0.5, 0.9]
    nodes = synopsis.roll_up(synopsis.synopsis(facts, "ts", "value", k=512), fan=4, levels=3)
    got = synopsis.quantiles_from_cover(facts, nodes, "ts", "value", qs, lo, hi, k=512, fan=4)
    here = facts.where((F.col("ts") >= lo) & (F.col("ts") < hi)).select("value")
    exact = E.exact_quantiles(here, "value", qs).select("q", F.col("value").alias("exact"))
    ranks = here.where("value IS NOT NULL").join(F.broadcast(got.select("q", "value")).withColumnRenamed("value", "estimate")).groupBy("q").agg(F.count_if(F.col("value") < F.col("estimate")).alias("below"), F.count_if(F.col("value") <= F.col("estimate")).alias("upto"))
    both = got.select("q", "n", "rank_bound").join(exact, "q").join(ranks, "q")
    off = F.greatest(F.col("below") + 1 - F.col("q") * F.col("n"), F.col("q") * F.col("n") - F.col("upto"), F.lit(0.0))
    return both.select("q", "n", F.col("exact").alias("value"), (off <= F.col("rank_bound")).alias("within"), (F.col("rank_bound") < 0.02 * F.col("n")).alias("tight"))


@query
def late_cover(spark, sf_dir):
    """Files in the order of arrival: nodes that no other page overlaps are merged, the rest is read."""
    rows = _arrivals(spark, sf_dir)
    pages = synopsis.synopsis(synopsis.paged(rows, "arrival", "event_id", rows=64), "t", "v", k=16)
    nodes = synopsis.roll_up(pages, fan=4, levels=2)
    return synopsis.cover_with_overlap(nodes, pages, F.expr("timestamp_ntz'2024-01-04'"), F.expr("timestamp_ntz'2024-01-26'"), fan=4)


@query
def session_totals(spark, sf_dir):
    from ..streaming.windows import session_sketches

    got = session_sketches(table(spark, sf_dir, "events"), "ts", "value", "2 hours", by=("user_id",))
    return got.select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n", "lo", "hi", F.expr("kll_sketch_get_n_double(sketch)").alias("sketch_n"))


@query
def page_pruned_q(spark, sf_dir):
    """Exact quantiles of all events; pages that lie beside the bracket are counted, not read."""
    rows = synopsis.paged(table(spark, sf_dir, "events").select("event_id", "ts", "value"), "value", "event_id", rows=128)
    pages = synopsis.synopsis(rows, "ts", "value")
    return reduce(DataFrame.unionByName, [synopsis.exact_quantile_pruned(rows, pages, "value", q).select("q", "value") for q in (0.21, 0.5, 0.999)])


@query
def page_pruned_share(spark, sf_dir):
    """Whether pages in the order of values spare most of the second pass."""
    rows = synopsis.paged(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice"), "l_extendedprice", "l_orderkey", "l_linenumber", rows=256)
    got = synopsis.exact_quantile_pruned(rows, synopsis.synopsis(rows, "l_orderkey", "l_extendedprice"), "l_extendedprice", 0.5)
    return got.select("q", "value", (F.col("rows_read") < 0.5 * F.col("n")).alias("spared"))


@query
def slab_pruned_q(spark, sf_dir):
    """(q, value, n, spared): exact quantiles from folders by ranges of values; by the scan's own metrics, less than half of the rows is read."""
    lines, path = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice"), text.scratch_path(spark, "slabs")
    synopsis.write_slabs(lines, "l_extendedprice", path, "l_orderkey", "l_linenumber", slabs=16)

    def one(q: float) -> DataFrame:
        got = synopsis.exact_quantile_from_slabs(spark, path, "l_extendedprice", q)
        value = got.first()["value"]
        read = synopsis.rows_scanned(synopsis.slab_rows(spark, path, value, value).select(F.max("l_extendedprice")))
        return got.select("q", "value", "n", ((F.col("rows_read") < 0.5 * F.col("n")) & (F.lit(read) < 0.5 * F.col("n"))).alias("spared"))

    return reduce(DataFrame.unionByName, [one(q) for q in (0.05, 0.5, 0.99)])


@query
def late_stream_pages(spark, sf_dir):
    """Pages of a day, kept by a stream of arrivals that is started anew for each fifth of them; late rows are counted and kept apart."""
    from ..streaming.windows import stored_late, stored_pages, upsert_pages

    rows, path = held(_arrivals(spark, sf_dir)), text.scratch_path(spark, "upkeep")
    ends = rows.agg(F.min("arrival").alias("a"), F.max("arrival").alias("b")).first()
    part = F.floor((F.col("arrival") - F.lit(ends["a"])) * 5 / F.lit(ends["b"] - ends["a"] + 1)) if ends["a"] is not None else F.lit(0)
    for k in range(5):
        rows.where(part == k).write.mode("append").parquet(f"{path}/arrivals")
        stream = spark.readStream.schema(rows.schema).parquet(f"{path}/arrivals")
        upsert_pages(stream, "t", "v", "1 day", f"{path}/kept", f"{path}/checkpoint", fold_every=2).awaitTermination()
    late = stored_late(spark, f"{path}/kept").groupBy(F.date_trunc("day", "t").cast("timestamp_ntz").alias("page")).agg(F.count("*").alias("n_kept"))
    pages = stored_pages(spark, f"{path}/kept").join(late, "page", "left")
    return pages.select(F.date_format("page", "yyyy-MM-dd").alias("day"), "n", "n_late", F.coalesce("n_kept", F.lit(0)).alias("n_kept"), "min_t", "max_t", "min_v", "max_v", F.round("total", 4).alias("total"), F.when(F.col("n") > 0, F.expr("kll_sketch_get_n_double(sketch)")).otherwise(0).alias("sketch_n"))


def _counted_probes(spark, rows: DataFrame, probes: list[float]) -> DataFrame:
    """(probe, rank): exact numbers of values at most each probe, in one pass."""
    counts = rows.agg(*[F.count_if(F.col("v") <= x).alias(str(i)) for i, x in enumerate(probes)])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(x).alias("probe"), F.col(str(i)).alias("rank")) for i, x in enumerate(probes)])).alias("r")).select("r.*")


@query
def value_bounds(spark, sf_dir):
    """(probe, rank, within, small): each probe's estimated rank errs no more than its own bound, in a state whose size does not follow the rows."""
    rows, slots, records = table(spark, sf_dir, "lineitem").select(F.col("l_extendedprice").cast("double").alias("v")), 512, 64
    state = sketches.tree_merge(rows, "v", lambda: sketches.Compactor(slots, records=records))
    levels = len(state.levels)
    probes = [5000.0 * i for i in range(1, 21)]
    known = spark.createDataFrame([(x, state.rank(x), state.error_at(x, 1.0)) for x in probes], "probe double, estimate long, most long")
    small = len(state.to_bytes()) <= 8 * slots + levels * (16 * records + 24) + 64
    return _counted_probes(spark, rows, probes).join(F.broadcast(known), "probe").select("probe", "rank", (F.abs(F.col("estimate") - F.col("rank")) <= F.col("most")).alias("within"), F.lit(small).alias("small"))


def _budgeted(make) -> Query:
    def run(spark, sf_dir):
        rows, budget = table(spark, sf_dir, "lineitem").select(F.col("l_extendedprice").cast("double").alias("v")), 3000
        state = sketches.tree_merge(rows, "v", make).fit(budget).to_bytes()
        got, probes = sketches.load(state), [20_000.0, 35_000.0, 50_000.0, 90_000.0]
        known = spark.createDataFrame([(x, got.rank(x)) for x in probes], "probe double, estimate long")
        off = F.abs(F.col("estimate") - F.col("rank")) <= F.lit(got.error(1.0))
        full = 0.9 * budget < len(state) <= budget
        return _counted_probes(spark, rows, probes).join(F.broadcast(known), "probe").select("probe", "rank", off.alias("within"), F.lit(full).alias("fits"), F.lit(got.exact()).alias("exact"))

    return run


#: Summaries with far fewer slots than rows, brought to a budget of bytes, stored and loaded; the ledger bounds their error.
QUERIES["ledger_budget_rank"] = _budgeted(lambda: sketches.Compactor(1 << 10))
QUERIES["mrl_budget_rank"] = _budgeted(lambda: sketches.Compactor(1 << 10, random=False))


@query
def histogram_rank_bounds(spark, sf_dir):
    """(q, value, holds, narrower): page histograms enclose exact quantiles, and their cells do so more closely than their steps."""
    prices, qs = table(spark, sf_dir, "lineitem").select(F.floor("l_extendedprice").cast("double").alias("v")).where("v IS NOT NULL"), [0.1, 0.5, 0.9]
    n = prices.count()
    ranks = {q: R.MID.ranks(q, n) for q in qs}
    bounds = held(summaries.rank_bounds(summaries.page_histogram(_pages(spark, sf_dir), "page_id", "l_extendedprice", 512), sorted({k for both in ranks.values() for k in both})))
    asked = spark.createDataFrame([(q, k1, k2) for q, (k1, k2) in ranks.items()], "q double, k1 long, k2 long")
    low = bounds.select(F.col("k").alias("k1"), "least", "wide_least")
    high = bounds.select(F.col("k").alias("k2"), "greatest", "wide_greatest")
    both = E.exact_quantiles(prices, "v", qs).select("q", "value").join(asked, "q").join(low, "k1").join(high, "k2")
    return both.select("q", "value", F.col("value").between(F.col("least"), F.col("greatest")).alias("holds"), (F.col("greatest") - F.col("least") < F.col("wide_greatest") - F.col("wide_least")).alias("narrower"))
