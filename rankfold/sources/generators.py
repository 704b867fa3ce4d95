"""Synthetic series: (pos, v), made where they are used; every row depends on its position and the seed only."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SEED = 233


def _rows(spark: SparkSession, n: int, v) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("pos"), v.alias("v"))


def uniform(spark: SparkSession, n: int, seed: int = SEED) -> DataFrame:
    return _rows(spark, n, F.rand(seed))


def gaussian(spark: SparkSession, n: int, seed: int = SEED) -> DataFrame:
    return _rows(spark, n, F.randn(seed))


def sequence(spark: SparkSession, n: int) -> DataFrame:
    return _rows(spark, n, F.col("id").cast("double"))


def permutation(spark: SparkSession, n: int, seed: int = SEED) -> DataFrame:
    """0 .. n - 1 in random order: values are placed by a range-partitioned random sort."""
    from ..operators.summaries import numbered

    shuffled = numbered(spark.range(n).select(F.col("id").cast("double").alias("v"), F.rand(seed).alias("r")), "r", "v", name="pos")
    return shuffled.select((F.col("pos") - 1).alias("pos"), "v")


def log_normal(spark: SparkSession, n: int, mu: float = 4.0, sigma: float = 0.0004, seed: int = SEED) -> DataFrame:
    return _rows(spark, n, F.exp(mu + sigma * F.randn(seed)))


#: The page distributions by name.
PAGE_SHAPES = ("normal", "log-uniform", "ordered-log-uniform", "uniform", "ordered-uniform", "sinusoid")


def page_values(spark: SparkSession, n: int, shape: str, seed: int = SEED) -> DataFrame:
    """Integer values of one of ``PAGE_SHAPES``."""
    u, at = F.rand(seed), F.col("id") / F.lit(float(max(n, 1)))
    made = {
        "normal": F.randn(seed) * 1e8,
        "log-uniform": F.pow(F.lit(10.0), u * 15),
        "ordered-log-uniform": F.pow(F.lit(10.0), at * 15),
        "uniform": (u * 2 - 1) * 1e15,
        "ordered-uniform": (at * 2 - 1) * 1e15,
        "sinusoid": F.sin(at * 2 * math.pi) * 1e8,
    }
    return _rows(spark, n, made[shape].cast("long"))


def out_of_order(spark: SparkSession, n: int, mu: float = 3.0, sigma: float = 1.0, seed: int = SEED) -> DataFrame:
    """(event_time, arrival, v): each row arrives exp(mu + sigma N(0, 1)) after its time."""
    delay = F.round(F.exp(mu + sigma * F.randn(seed))).cast("long")
    return spark.range(n).select(F.col("id").alias("event_time"), (F.col("id") + delay).alias("arrival"), F.randn(seed + 1).alias("v"))


def random_ranges(spark: SparkSession, n: int, width: int, count: int, seed: int = SEED) -> DataFrame:
    """(a, b): random half-open position ranges of one width: a query workload."""
    begin = F.floor(F.rand(seed) * max(1, n - width + 1)).cast("long")
    return spark.range(count).select(begin.alias("a")).withColumn("b", F.col("a") + width)
