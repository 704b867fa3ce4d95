"""Side utilities: Bloom filters, arithmetic progressions, deletes, interval mass, coverage of odd and even intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.planner import bloom_size


def bloom_build(df: DataFrame, key: str, expected: int, fpp: float = 0.01) -> DataFrame:
    """(word, bits): the set 64-bit words of a Bloom filter; sizes follow from the expected keys and the error rate."""
    m, hashes = bloom_size(expected, fpp)
    at = F.explode(F.array(*[F.pmod(F.xxhash64(F.col(key), F.lit(i)), F.lit(m)) for i in range(hashes)]))
    places = df.select(key).where(F.col(key).isNotNull()).distinct().select(at.alias("at"))
    return places.groupBy(F.floor(F.col("at") / 64).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 64 as int))")).alias("bits"))


def bloom_probe(df: DataFrame, key: str, bloom: DataFrame, expected: int, fpp: float = 0.01) -> DataFrame:
    """``df`` with ``might_contain``.  The filter is joined by word, a row for each hash.

    Both joins are told to shuffle: Spark sizes the keys by their file, compressed and without the rows of the hashes, and would send
    them through the driver.
    """
    m, hashes = bloom_size(expected, fpp)
    keys = df.select(key).where(F.col(key).isNotNull()).distinct()
    asked = keys.select(key, F.explode(F.array(*[F.pmod(F.xxhash64(F.col(key), F.lit(i)), F.lit(m)) for i in range(hashes)])).alias("at")).withColumn("word", F.floor(F.col("at") / 64))
    hit = asked.join(bloom.hint("merge"), "word").where(F.expr("(bits & shiftleft(1L, cast(at % 64 as int))) != 0")).groupBy(key).agg((F.count("*") == hashes).alias("might_contain"))
    return df.join(hit.hint("merge"), key, "left").withColumn("might_contain", F.coalesce("might_contain", F.lit(False)))


def bloom_write(bloom: DataFrame, path: str, expected: int, fpp: float) -> None:
    """A filter with its parameters, as a table."""
    bloom.withColumn("expected", F.lit(expected).cast("long")).withColumn("fpp", F.lit(float(fpp))).write.mode("overwrite").parquet(path)


def bloom_read(spark: SparkSession, path: str) -> tuple[DataFrame, int, float]:
    """(filter, expected keys, error rate) as written."""
    table = spark.read.parquet(path)
    head = table.select("expected", "fpp").first()
    return table.select("word", "bits"), head["expected"] if head else 1, head["fpp"] if head else 0.01


def arithmetic_progressions(df: DataFrame, col: str, least: int, most_diff: int) -> DataFrame:
    """(start, diff, length): maximal runs start, start + diff, ... of distinct integers, with at least ``least`` members.

    Each integer looks for its successor at every difference up to ``most_diff``; runs are islands of row numbers within
    a difference and residue, so the work is rows times ``most_diff``.
    """
    values = df.select(F.col(col).cast("long").alias("x")).where("x IS NOT NULL").distinct()
    spread = values.select("x", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(most_diff).cast("long"))).alias("diff"))
    spread = spread.withColumn("residue", F.pmod("x", "diff")).withColumn("step", F.floor((F.col("x") - F.col("residue")) / F.col("diff")))
    w = Window.partitionBy("diff", "residue").orderBy("step")
    runs = spread.withColumn("island", F.col("step") - F.row_number().over(w))
    return runs.groupBy("diff", "residue", "island").agg(F.min("x").alias("start"), F.count("*").alias("length")).where(F.col("length") >= least).select("start", "diff", "length")


def rank_after_deletes(df: DataFrame, col: str, deleted: Column, probes: list[float]) -> DataFrame:
    """(probe, n_all, n_deleted, rank): rows at most each probe, deleted ones, and the difference."""
    aggs = []
    for i, p in enumerate(probes):
        aggs += [F.count_if(F.col(col) <= p).alias(f"a{i}"), F.count_if((F.col(col) <= p) & deleted).alias(f"d{i}")]
    one = df.agg(*aggs)
    rows = F.explode(F.array(*[F.struct(F.lit(float(p)).alias("probe"), F.col(f"a{i}").alias("n_all"), F.col(f"d{i}").alias("n_deleted")) for i, p in enumerate(probes)]))
    return one.select(rows.alias("r")).select("r.*").withColumn("rank", F.col("n_all") - F.col("n_deleted"))


def rank_after_deletes_sketched(df: DataFrame, col: str, deleted: Column, probes: list[float], k: int = 1000) -> DataFrame:
    """(probe, rank): estimated rows at most each probe that are not deleted, the difference of two sketches of one pass.

    Each sketch errs by its own count times ``planner.kll_error(k)``, so the difference by the sum of both.
    """
    x = F.col(col).cast("double")
    one = df.select(x.alias("v"), F.coalesce(deleted, F.lit(False)).alias("gone")).where("v IS NOT NULL AND NOT isnan(v)").agg(
        F.count("*").alias("n"), F.count_if(F.col("gone")).alias("m"), F.expr(f"kll_sketch_agg_double(v, {k})").alias("all"), F.expr(f"kll_sketch_agg_double(v, {k}) FILTER (WHERE gone)").alias("dead")
    )
    asked = F.array(*[F.lit(float(p)) for p in probes])
    rank = lambda s, n: F.when(F.col(n) > 0, F.transform(F.kll_sketch_get_rank_double(s, asked), lambda r: r * F.col(n))).otherwise(F.array_repeat(F.lit(0.0), len(probes)))
    both = one.select(F.arrays_zip(asked.alias("probe"), rank("all", "n").alias("a"), rank("dead", "m").alias("d")).alias("x"))
    return both.select(F.explode("x").alias("x")).select("x.probe", (F.col("x.a") - F.col("x.d")).alias("rank"))


def interval_mass(df: DataFrame, col: str, lo: float, hi: float) -> DataFrame:
    """(n_in, n, share) of the values in [lo, hi]."""
    got = df.agg(F.count_if(F.col(col).between(lo, hi)).alias("n_in"), F.count(col).alias("n"))
    return got.withColumn("share", F.col("n_in") / F.col("n"))


def odd_even_coverage(df: DataFrame, col: str, points: int = 9, *tie: str) -> DataFrame:
    """(point, place, odd, even): of the intervals between neighbours in sorted order, how many of odd and of even place cover equally spaced points."""
    from .summaries import numbered

    placed = numbered(df.where(F.col(col).isNotNull()), col, *tie)
    lo, hi = placed.agg(F.min(col), F.max(col)).first()
    at = [(i + 1, float(lo + (hi - lo) * (i + 1) / (points + 1))) for i in range(points)] if lo is not None else []
    v = F.col(col)
    # an interval (a, b) of places r, r + 1 covers x where a <= x < b, so counts of ends at most x differ by one there
    aggs = []
    for i, x in at:
        aggs += [F.max(F.when(v <= x, F.col("rn"))).alias(f"r{i}")]
    if not at:
        return df.sparkSession.createDataFrame([], "point int, place double, odd int, even int")
    one = placed.agg(*aggs)
    rows = F.explode(F.array(*[F.struct(F.lit(i).alias("point"), F.lit(x).alias("place"), F.col(f"r{i}").alias("r")) for i, x in at]))
    return one.select(rows.alias("p")).select("p.point", "p.place", (F.col("p.r") % 2).cast("int").alias("odd"), (1 - F.col("p.r") % 2).cast("int").alias("even"))


def error_stats(errors: DataFrame, col: str) -> DataFrame:
    """(n, mean, stddev) of a column, the deviation being that of a population."""
    return errors.agg(F.count(col).alias("n"), F.avg(col).alias("mean"), F.stddev_pop(col).alias("stddev"))
