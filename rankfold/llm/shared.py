"""What the operators share: the cluster's shared folder, written tables that cut lineage, and small column helpers."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only where the session names no shared folder and driver and executors are one machine, as in tests.
LOCAL_SHARED = "file:///tmp/checkpoints/rankfold"
#: A key with more than a 1 / HOT_SHARE of all rows is hot, so fewer keys than that are; it is dealt to SALTS tasks in joins.
HOT_SHARE, SALTS = 256, 64

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.  On one machine a local one will do where it is unset."""
    set_to = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if set_to:
        return set_to.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("spark.checkpoint.dir is unset: a cluster needs a folder that driver and executors share")
    return LOCAL_SHARED


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session may be gone at exit; the folder is the cluster's scratch space
        pass


@atexit.register
def _delete_all() -> None:
    for spark, path in _written:
        _delete(spark, path)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` as Parquet in the shared folder and reads it back: lineage ends there and lost executors cost no recomputation.

    The files go when the driver ends, or before by ``released``.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def released() -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """Deletes at its end what was materialized inside, but for tables kept by the function that it gives."""
    before, kept = len(_written), []

    def keep(df: DataFrame, name: str) -> DataFrame:
        out = materialize(df, name)
        kept.append(_written.pop())
        return out

    try:
        yield keep
    finally:
        for spark, path in _written[before:]:
            _delete(spark, path)
        _written[before:] = kept


def looked_up(rows: DataFrame, table: DataFrame, keys: list[str], weight: str, total: int) -> DataFrame:
    """Inner join of ``rows`` with ``table``, which says in ``weight`` how many rows have a key, the same in all its rows of that key.

    Keys that hold more than a 1 / HOT_SHARE of all ``total`` rows, fewer than HOT_SHARE of them, are dealt to SALTS tasks each;
    only these keys are broadcast.
    """
    hot = F.col(weight) * HOT_SHARE > total
    named = rows.join(F.broadcast(table.where(hot).select(*keys, F.lit(True).alias("_hot")).distinct()), keys, "left")
    salted = named.withColumn("_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS))).otherwise(F.lit(0).cast("long"))).drop("_hot")
    salts = F.when(hot, F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).otherwise(F.array(F.lit(0).cast("long")))
    return salted.join(table.withColumn("_salt", F.explode(salts)).drop(weight), [*keys, "_salt"]).drop("_salt")


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and nothing else.  Pure ASCII takes the fast built-in; other text is translated letter by letter."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def shuffle_width(spark: SparkSession, least: int = 1) -> int:
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))


def bytes_of(df: DataFrame, column: str) -> int:
    """About how many bytes ``df`` reads: by the files' sizes where the plan knows them, else by a sum over ``column``.  For widths only."""
    known = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return known if known < 1 << 60 else df.agg(F.coalesce(F.sum(F.octet_length(column)), F.lit(0))).first()[0]


def fan_of(spark: SparkSession, bytes_in: int, each: int = 4_000_000) -> int:
    """How many key ranges the owners share: one for every ``each`` bytes of input, so that a range fits in memory at any size."""
    return max(shuffle_width(spark), -(-bytes_in // each))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once a row, even where ``body`` uses it inside a lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)
