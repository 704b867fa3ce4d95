import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankfold.functions import ranks as R
from rankfold.operators import cache, misc, summaries, synopsis
from rankfold.operators.sketches import Compactor, Sample, load


def test_running_values_cross_partitions(spark):
    r = random.Random(2)
    rows = [(k, r.randint(-50, 50) if r.random() < 0.8 else None) for k in range(300)]
    df = spark.createDataFrame(rows, "k long, v long").repartition(7)
    got = {x["k"]: x["m"] for x in summaries.running_max(df, "k", value="v", name="m").collect()}
    sums = {x["k"]: x["s"] for x in summaries.running_sum(df, "k", value="v", name="s").collect()}
    last = {x["k"]: x["l"] for x in summaries.last_known(df, "k", value="v", name="l").collect()}
    for k in range(300):
        before = [v for _, v in rows[:k] if v is not None]
        upto = [v for _, v in rows[: k + 1] if v is not None]
        assert got[k] == (max(before) if before else None)
        assert sums[k] == sum(upto) and last[k] == (upto[-1] if upto else None)
    empty = df.limit(0)
    assert summaries.running_max(empty, "k", value="v", name="m").collect() == []
    assert summaries.last_known(empty, "k", value="v", name="m").collect() == []


def test_cached_tables_are_released(spark):
    cache.release()
    cache.held(spark.range(50)).count()
    assert cache.release() == 1 and cache.release() == 0


def test_places_are_the_same_after_release(spark):
    """Enough rows for range bounds to be sampled: a second evaluation deals them as the first did."""
    df = spark.range(40_000).select(F.col("id").alias("k"), F.when(F.col("id") % 3 > 0, F.col("id") * 7919 % 101).alias("v"))
    results = [
        summaries.numbered(df, "v", "k"),
        summaries.running_max(df, "k", value="v", name="m"),
        summaries.running_sum(df, "k", value="v", name="s"),
        summaries.last_known(df, "k", value="v", name="l"),
        summaries.numbered_weights(df.select(F.col("k").cast("double").alias("v"), F.lit(1).cast("long").alias("w"))),
    ]
    first = [sorted(map(str, r.collect())) for r in results]
    cache.release()
    assert [sorted(map(str, r.repartition(3).collect())) for r in results] == first
    assert sorted(r["rn"] for r in results[0].collect()) == list(range(1, 40_001))


def test_samples_merge_store_and_bracket():
    r = np.random.default_rng(4)
    misses = 0
    for trial in range(60):
        x = r.normal(size=3000)
        state = Sample(400, seed=trial)
        for k, part in enumerate(np.array_split(x, 4)):
            state.merge(load(Sample(400, seed=100 * trial + k).update(part).to_bytes()))
        state = load(state.to_bytes())
        assert state.n == 3000 and len(state.values) == 400 and state.low == x.min() and state.high == x.max()
        assert set(state.values) <= set(x) and not state.exact()
        ordered = np.sort(x)
        for q in (0.1, 0.5, 0.93):
            k1, k2 = R.MID.ranks(q, 3000)
            inner, outer, sure = state.brackets(k1, k2)
            assert sure[0] <= outer[0] <= inner[0] <= inner[1] <= outer[1] <= sure[1]
            assert sure[0] <= ordered[k1 - 1] and ordered[k2 - 1] <= sure[1]
            misses += not (outer[0] <= ordered[k1 - 1] and ordered[k2 - 1] <= outer[1])
    assert misses <= 4
    small = Sample(10).update(np.array([3.0, 1.0, 2.0]))
    assert small.exact() and [small.at(k) for k in (1, 2, 3)] == [1.0, 2.0, 3.0]


def test_bounds_of_single_values_hold_and_are_no_wider():
    r = np.random.default_rng(5)
    closer = 0
    for trial in range(40):
        x = r.normal(size=4000)
        state = Compactor(128, seed=trial, log=True).update(x[:2500]).merge(Compactor(128, seed=trial + 99, log=True).update(x[2500:]))
        for q in (0.01, 0.4, 0.99):
            v = float(np.quantile(x, q))
            true = int((x <= v).sum())
            assert abs(state.rank(v) - true) <= state.error_at(v, 1.0) <= state.error(1.0)
            closer += state.error_at(v, 1.0) < state.error(1.0)
    assert closer > 60
    with pytest.raises(ValueError):
        Compactor(64).error_at(0.0, 1.0)


def test_covers_with_overlap_against_pages(spark):
    """Every page in the range is merged once by a clean node, or read; random overlaps."""
    r = random.Random(6)
    rows = [(k, k * 10 + r.choice([0, 0, 0, 900, -400]), float(k)) for k in range(800)]
    df = spark.createDataFrame(rows, "arrival long, t long, v double")
    pages = synopsis.synopsis(synopsis.paged(df, "arrival", rows=10), "t", "v", k=8)
    spans = {x["page_id"]: (x["min_t"], x["max_t"], x["n"]) for x in pages.collect()}
    nodes = synopsis.roll_up(pages, fan=3, levels=3)
    lo, hi = 1000, 6000
    seen = []
    for x in synopsis.cover_with_overlap(nodes, pages, lo, hi, fan=3).collect():
        own = [p for p in spans if p // 3 ** x["level"] == x["node_id"]] if x["use"] == "merged" else [x["node_id"]]
        if x["use"] == "merged":
            a, b = min(spans[p][0] for p in own), max(spans[p][1] for p in own)
            assert lo <= a and b < hi
            assert not any(spans[p][0] <= b and spans[p][1] >= a for p in spans if p not in own)
            assert x["n"] == sum(spans[p][2] for p in own)
        seen += own
    assert len(seen) == len(set(seen))
    assert set(seen) == {p for p, (a, b, _) in spans.items() if a < hi and b >= lo}


def test_page_histograms_through_bytes(spark):
    df = spark.createDataFrame([(k // 100, (k * 37) % 500) for k in range(350)], "page_id long, v long")
    plain = summaries.page_histogram(df, "page_id", "v", 32)
    back = {(x["page_id"], x["step"]): x for x in summaries.unpack_histogram(summaries.pack_histogram(plain, "page_id"), "page_id").collect()}
    for x in plain.collect():
        got = back.pop((x["page_id"], x["step"]))
        assert (got["lo"], got["hi"], got["n"]) == (x["lo"], x["hi"], x["n"])
        counts = {c["cell"]: c["n"] for c in x["counts"]}
        assert list(got["shares"]) == [min(255, -(-255 * counts.get(k, 0) // x["n"])) for k in range(8)]
    assert not back
    combined = summaries.combine_histograms(plain, 4).collect()
    assert sum(c["n"] for c in combined) == 350 and len(combined) <= 5


def test_merged_prefixes_and_filters_keep_all(spark, tmp_path):
    df = spark.range(5000).select(F.col("id"), (F.col("id") * 7919 % 100_003).alias("key"))
    a, b = (summaries.bounded_prefixes(df.where(F.col("id") % 3 == k), "key", most) for k, most in ((0, 40), (1, 9)))
    got, shift = summaries.merge_prefixes(a, b, 20)
    assert shift >= max(a[1], b[1]) and got.count() <= 20
    want = {}
    for k in range(5000):
        if k % 3 != 2:
            want[(k * 7919 % 100_003) >> shift] = want.get((k * 7919 % 100_003) >> shift, 0) + 1
    assert {x["prefix"]: x["n"] for x in got.collect()} == want
    misc.bloom_write(misc.bloom_build(df, "key", 5000, 0.01), str(tmp_path / "bloom"), 5000, 0.01)
    bloom, expected, fpp = misc.bloom_read(spark, str(tmp_path / "bloom"))
    assert (expected, fpp) == (5000, 0.01)
    probes = df.select("key").unionByName(df.select((F.col("key") + 1_000_000).alias("key")))
    found = misc.bloom_probe(probes, "key", bloom, expected, fpp).groupBy(F.col("key") < 1_000_000).agg(F.count_if("might_contain").alias("n")).collect()
    counts = {x[0]: x["n"] for x in found}
    assert counts[True] == 5000 and counts[False] < 250


def test_probed_keys_never_pass_through_the_driver(spark, tmp_path):
    # a small file of many keys: by its size, Spark would broadcast a row for each hash of each key
    spark.range(20_000).select(F.col("id").alias("k")).write.parquet(str(tmp_path / "keys"))
    keys = spark.read.parquet(str(tmp_path / "keys"))
    got = misc.bloom_probe(keys, "k", misc.bloom_build(keys.where("k % 2 = 0"), "k", 10_000, 0.01), 10_000, 0.01)
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()
    counts = {r["even"]: r["n"] for r in got.groupBy((F.col("k") % 2 == 0).alias("even")).agg(F.count_if("might_contain").alias("n")).collect()}
    assert counts[True] == 10_000 and counts[False] < 500


def test_nested_windows_fall_back(spark):
    values = [float((k * 7919) % 1009) for k in range(1009)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    x = sorted(values)
    for sigmas, sample in (((4.0, 12.0), 200), ((0.0,), 5)):
        for q in (0.0, 0.31, 1.0):
            got = summaries.nested_window_select(df, "v", q, sigmas, sample).first()
            k1, k2 = R.MID.ranks(q, len(x))
            assert got["value"] == (x[k1 - 1] + x[k2 - 1]) / 2 and got["n"] == 1009
    assert summaries.nested_window_select(df.limit(0), "v", 0.5).first()["value"] is None


def test_pruned_pages_are_not_read(spark):
    df = spark.range(4000).select(F.col("id").cast("double").alias("v"), F.floor(F.col("id") / 50).cast("long").alias("page_id"), "id")
    pages = synopsis.synopsis(df, "id", "v", k=8)
    got = synopsis.exact_quantile_pruned(df, pages, "v", 0.5).first()
    assert got["value"] == 1999.5 and got["rows_read"] < 2000 and got["n"] == 4000
    assert synopsis.exact_quantile_pruned(df.limit(0), pages.limit(0), "v", 0.5).first()["value"] is None


def test_levels_overlap_less_and_live_pages_hold_each_row_once(spark):
    r = random.Random(8)
    rows = [(k, k * 10 + r.choice([0, 0, 0, -700, -1500]), float(k % 17)) for k in range(1000)]
    df = spark.createDataFrame(rows, "arrival long, t long, v double").repartition(5)
    pages = synopsis.leveled(df, "t", "v", "arrival", rows=10, fan=3, levels=3).collect()
    overlaps = []
    for level in range(4):
        here = [p for p in pages if p["level"] == level]
        assert sum(p["n"] for p in here) == 1000 and sum(p["total"] for p in here) == sum(x[2] for x in rows)
        overlaps.append(sum(a["min_t"] <= b["max_t"] and b["min_t"] <= a["max_t"] for i, a in enumerate(here) for b in here[:i]))
        for p in here:
            run = sorted((t, k) for k, t, _ in rows if k // (10 * 3**level) == p["run"])
            own = run[(p["page_id"] - p["run"] * 3**level) * 10 :][:10]
            if level:
                assert (p["min_t"], p["max_t"], p["n"]) == (own[0][0], own[-1][0], len(own))
    assert overlaps == sorted(overlaps, reverse=True) and overlaps[0] > 2 * overlaps[-1]
    live = [p for p in pages if p["live"]]
    assert sum(p["n"] for p in live) == 1000 and {p["level"] for p in live} == {0, 2, 3}  # 1000 = 3 * 270 + 2 * 90 + 10
    assert synopsis.leveled(df.limit(0), "t", "v", "arrival", rows=10, fan=3, levels=2).collect() == []


def test_quantiles_from_a_cover_stay_within_their_bound(spark):
    r = np.random.default_rng(9)
    v = r.normal(size=6000)
    df = spark.createDataFrame([(k, float(x)) for k, x in enumerate(v)], "t long, v double")
    facts = synopsis.paged(df, "t", rows=50)
    nodes = synopsis.roll_up(synopsis.synopsis(facts, "t", "v", k=256), fan=4, levels=3)
    own = np.sort(v[1234:5432])
    for x in synopsis.quantiles_from_cover(facts, nodes, "t", "v", [0.0, 0.2, 0.5, 0.97], 1234, 5432, k=256, fan=4).collect():
        assert x["n"] == len(own) and x["rank_bound"] < 0.025 * len(own)
        assert abs(np.searchsorted(own, x["value"], "right") - x["q"] * len(own)) <= x["rank_bound"] + 1
    assert [x["value"] for x in synopsis.quantiles_from_cover(facts, nodes, "t", "v", [0.5], 9000, 9001, k=256, fan=4).collect()] == [None]


def test_samples_err_by_their_size():
    assert [summaries.sample_error(m) for m in (16, 900)] == [pytest.approx(1 / 12), pytest.approx(1 / 90)]


def test_records_bound_single_values_in_bounded_bytes():
    r = np.random.default_rng(12)
    sizes, closer = [], 0
    for trial, n in enumerate([20_000, 20_000, 80_000]):
        x = np.cumsum(r.normal(size=n) + 0.5) if trial % 2 else np.round(r.normal(size=n), 2)
        parts = [load(Compactor(256, seed=trial + 7 * k, records=32).update(y).to_bytes()) for k, y in enumerate(np.array_split(x, 3))]
        state = load(parts[0].merge(parts[1]).merge(parts[2]).to_bytes())
        for v in np.linspace(x.min() - 1, x.max() + 1, 40):
            assert abs(state.rank(v) - int((x <= v).sum())) <= state.error_at(v, 1.0) <= state.error(1.0)
            closer += state.error_at(v, 1.0) < state.error(1.0)
        assert all(len(s.edges) <= 32 for s in state.splits)
        sizes.append(len(state.to_bytes()))
    assert closer > 40 and max(sizes) < 256 * 8 + 14 * (32 * 16 + 40)
    with pytest.raises(ValueError):
        Compactor(64, records=16).update(np.arange(10.0)).merge(Compactor(64).update(np.arange(500.0)))


@pytest.mark.parametrize("random_parity", [True, False])
def test_bytes_fit_a_budget(random_parity):
    x = np.random.default_rng(3).gamma(2.0, size=50_000)
    for budget in (600, 1500, 4000):
        state = Compactor(1024, random=random_parity, seed=4).update(x)
        assert len(state.to_bytes()) > budget
        got = load(state.fit(budget).to_bytes())
        assert budget - 24 <= len(got.to_bytes()) <= budget and got.n == len(x)
        for v in np.quantile(x, [0.0, 0.1, 0.5, 0.99, 1.0]):
            assert abs(got.rank(v) - int((x <= v).sum())) <= got.error(1.0)
    small = Compactor(1024).update(x[:20])
    assert small.fit(4000).exact()
    with pytest.raises(ValueError):
        small.fit(10)


def test_slabs_spare_the_scan(spark, tmp_path):
    r = np.random.default_rng(5)
    x = [float(v) for v in np.round(r.normal(size=3000), 1)] + [7.0] * 1500 + [None] * 20
    df = spark.createDataFrame([(k, v) for k, v in enumerate(x)], "id long, v double")
    path = str(tmp_path / "slabs")
    synopsis.write_slabs(df, "v", path, "id", slabs=12)
    own = sorted(v for v in x if v is not None)
    for q in (0.0, 0.3, 0.66, 0.9, 1.0):
        got = synopsis.exact_quantile_from_slabs(spark, path, "v", q).first()
        k1, k2 = R.MID.ranks(q, len(own))
        assert got["value"] == (own[k1 - 1] + own[k2 - 1]) / 2 and got["n"] == len(own) and got["rows_read"] <= 2000
    assert synopsis.rows_scanned(synopsis.slab_rows(spark, path, -0.5, -0.4)) < 1000
    assert synopsis.rows_scanned(spark.read.parquet(f"{path}/rows")) == len(x)
    nans = spark.createDataFrame([(1, 1.0), (2, math.nan), (3, math.nan)], "id long, v double")
    synopsis.write_slabs(nans, "v", str(tmp_path / "nan"), slabs=4)
    assert [synopsis.exact_quantile_from_slabs(spark, str(tmp_path / "nan"), "v", q).first()["value"] for q in (0.0, 1.0)] == [1.0, pytest.approx(math.nan, nan_ok=True)]
    synopsis.write_slabs(df.where("v IS NULL"), "v", str(tmp_path / "none"), slabs=4)
    assert synopsis.exact_quantile_from_slabs(spark, str(tmp_path / "none"), "v", 0.5).first()["value"] is None


def test_cells_enclose_ranks_more_closely_than_steps(spark):
    r = random.Random(3)
    x = [r.randrange(10_000) for _ in range(2000)]
    df = spark.createDataFrame([(k // 100, v) for k, v in enumerate(x)], "page_id long, v long")
    ranks = [1, 37, 1000, 1999, 2000, 2001]
    got = {b["k"]: b for b in summaries.rank_bounds(summaries.page_histogram(df, "page_id", "v", 25), ranks).collect()}
    for k in ranks[:-1]:
        b = got[k]
        assert b["wide_least"] <= b["least"] <= sorted(x)[k - 1] <= b["greatest"] <= b["wide_greatest"]
    assert got[1000]["greatest"] - got[1000]["least"] < 0.5 * (got[1000]["wide_greatest"] - got[1000]["wide_least"])
    assert got[2001]["least"] is None and got[2001]["greatest"] is None


def test_page_histograms_deal_their_rows_once(spark):
    df = spark.range(2000).select(F.floor(F.col("id") / 200).cast("long").alias("page_id"), (F.col("id") * 7919 % 1009).alias("v"))
    histogram = summaries.page_histogram(df, "page_id", "v", 25)
    plan = histogram._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange") == 1
    # bounds and clusters read the histogram many times, its rows once
    for read in (summaries.rank_bounds(histogram, [1, 1000]), summaries.combine_histograms(histogram, 4)):
        assert "InMemoryTableScan" in read._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("n", [0, 1, 128, 129, 300])
def test_places_among_many_bounds(spark, n):
    from rankfold.functions import places

    bounds = [3 * k for k in range(n)]
    rows = spark.range(-5, 3 * n + 9).select("id", F.when(F.col("id") != 7, F.col("id")).alias("key"))
    got = rows.select("key", places._upto([F.lit(b).cast("long") for b in bounds], F.col("key")).alias("at"))
    assert all(r["at"] == (0 if r["key"] is None else sum(b <= r["key"] for b in bounds)) for r in got.collect())
    assert "aggregate(" not in got._jdf.queryExecution().analyzed().toString()  # nothing interpreted for a row


def test_levels_read_pages_and_not_their_rows(spark):
    rows = spark.range(900).select(F.col("id"), (F.col("id") * 10).alias("t"), F.col("id").cast("double").alias("v"))
    nodes = synopsis.roll_up(synopsis.synopsis(synopsis.paged(rows, "id", rows=10), "t", "v", k=8), fan=3, levels=2)
    plan = nodes._jdf.queryExecution().executedPlan().toString()
    assert plan.count("InMemoryTableScan") >= 3 and nodes.where("level = 2").agg(F.sum("n")).first()[0] == 900
