import math
import random

import pytest
from pyspark.sql import functions as F

from rankfold.functions import ranks as R
from rankfold.operators import exact as E

NAN = math.nan


def truth(values, q, spec=R.MID):
    x = sorted((v for v in values if v is not None), key=lambda v: (math.isnan(v), 0 if math.isnan(v) else v))
    if not x:
        return None
    k1, k2 = spec.ranks(q, len(x))
    return (x[k1 - 1] + x[k2 - 1]) * 0.5


def same(a, b):
    return a == b or (a is not None and b is not None and (math.isnan(a) and math.isnan(b) or a == pytest.approx(b, rel=1e-12)))


def frame(spark, values):
    return spark.createDataFrame([(v,) for v in values], "v double").repartition(3)


EDGES = {
    "empty": [],
    "nulls": [None, None],
    "single": [7.0],
    "pair": [1.0, 2.0],
    "five": [1.0, 2.0, 3.0, 4.0, 5.0],
    "equal": [3.5] * 300,
    "two values": [0.0] * 200 + [1.0] * 200,
    "signs": [-1.0, -0.0, 0.0, 1.0],
    "nan": [1.0, NAN, None, 2.0],
    "only nan": [NAN, NAN],
    "infinite": [-math.inf, 1.0, math.inf],
}


@pytest.mark.parametrize("name", EDGES)
def test_edges(spark, name):
    got = E.solve(frame(spark, EDGES[name]), "v", [0.0, 0.25, 0.5, 1.0])
    for a in got:
        assert same(a.value, truth(EDGES[name], a.q)), (a, truth(EDGES[name], a.q))


@pytest.mark.parametrize("method", E.METHODS)
def test_methods_agree_with_sorting(spark, method):
    r = random.Random(11)
    values = [r.gauss(0, 50) for _ in range(3000)] + [float(r.randint(-3, 3)) for _ in range(900)] + [None] * 5
    got = E.solve(frame(spark, values), "v", [0.0, 0.013, 0.5, 0.98, 1.0], method=method, memory="2KB")
    for a in got:
        assert same(a.value, truth(values, a.q)), (method, a, truth(values, a.q))


def test_small_brackets_miss_and_recover(spark):
    r = random.Random(5)
    values = [r.expovariate(1) for _ in range(5000)]
    run = E._Run(frame(spark, values), "v", "1KB", 0.5, 50, 15)
    run.start()
    x = sorted(values)
    brackets = [E.Bracket(2500, 2501, x[100], x[200], x[0], x[-1]), E.Bracket(10, 10, x[4000], x[4010], x[0], x[-1]), E.Bracket(700, 701, x[690], x[699], x[0], x[-1])]
    E._resolve(run, brackets)
    assert [b.found for b in brackets] == [{2500: x[2499], 2501: x[2500]}, {10: x[9]}, {700: x[699], 701: x[700]}]


def test_ties_beyond_the_survivors(spark):
    values = [5.0] * 900 + [float(k) for k in range(100)]
    got = E.solve(frame(spark, values), "v", [0.5, 0.01], survivors=1)
    assert [a.value for a in got] == [truth(values, 0.5), truth(values, 0.01)]


def test_return_type_and_sql_names(spark):
    df = frame(spark, [float(k) for k in range(100)])
    assert E.exact_quantile(df, "v", 0.5) == 49.5 and E.exact_quantile(df, "v", 0.5, return_type="iteration_num") >= 1
    got = E.call("exact_multi_quantiles_mrl", df, "v", multi_quantiles="3", memory="4KB").collect()
    assert [r["value"] for r in got] == [truth([float(k) for k in range(100)], q) for q in R.grid(3)]
    with pytest.raises(ValueError):
        E.call("exact_quantile_unknown", df, "v")


def test_grouped(spark):
    r = random.Random(9)
    groups = {None: [r.random() for _ in range(50)], "big": [r.gauss(0, 1) for _ in range(4000)], "ties": [1.0] * 2500 + [2.0], "nan": [1.0, NAN, 3.0], "null": [None], "one": [4.0]}
    df = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs], "g string, v double").repartition(3)
    got = {(x["g"], x["q"]): x for x in E.grouped_exact_quantiles(df, ["g"], "v", [0.1, 0.5, 0.99], k=32, width=0.05).collect()}
    assert len(got) == 18
    for (g, q), x in got.items():
        assert same(x["value"], truth(groups[g], q)) and x["n"] == sum(v is not None for v in groups[g])


def test_grouped_brackets_are_narrowed(spark):
    """No bracket may hold more than 50 rows; ties that fill one stay."""
    r = random.Random(10)
    groups = {"a": [r.gauss(0, 1) for _ in range(3000)], "b": [1.0] * 2000 + [r.random() for _ in range(1000)], "c": [5.0] * 30, "d": [r.random() for _ in range(1500)] + [NAN] * 500}
    df = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs], "g string, v double").repartition(3)
    for x in E.grouped_exact_quantiles(df, ["g"], "v", [0.0, 0.3, 0.9, 1.0], k=64, most=50).collect():
        assert same(x["value"], truth(groups[x["g"]], x["q"])), x


def test_exact_summaries_answer_at_once(spark):
    """Nothing is scanned again where the summary holds every value."""
    values = [float(k % 37) for k in range(500)]
    for method in ("ledger", "mrl", "sample"):
        got = E.solve(frame(spark, values), "v", [0.1, 0.5], method=method, memory="64KB")
        assert [(a.value, a.passes) for a in got] == [(truth(values, q), 2) for q in (0.1, 0.5)]


def test_sample_brackets_roll_back_step_by_step(spark):
    values = [float(k) for k in range(4000)]
    run = E._Run(frame(spark, values), "v", "1KB", 0.5, 10_000, 15)
    run.start()
    b = E.Bracket(2000, 2000, 100.0, 200.0, 0.0, 3999.0, wider=[(90.0, 300.0), (50.0, 2500.0)])
    E._resolve(run, [b])
    assert b.found == {2000: 1999.0} and b.wider == [] and run.passes == 1 + 3


def test_partitioning_does_not_matter(spark):
    df = spark.range(2000).select(F.sin("id").alias("v"))
    assert E.exact_quantile(df.repartition(1), "v", 0.3) == E.exact_quantile(df.repartition(17), "v", 0.3)
