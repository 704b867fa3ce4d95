"""Text files: single columns, CSV columns with bad cells, and what is written back."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_column(spark: SparkSession, path: str, limit: int | None = None, header: bool = True) -> DataFrame:
    """(v): one number per line after a header line; lines that are no number are skipped."""
    v = spark.read.csv(path, header=header, schema="v STRING").select(F.expr("try_cast(v AS DOUBLE)").alias("v")).where("v IS NOT NULL")
    return v.limit(limit) if limit is not None else v


def csv_columns(lines: DataFrame, columns: Sequence[int], line: str = "value", sep: str = ",") -> DataFrame:
    """(col, v): the cells of the chosen columns (from 0) that are numbers; other cells are skipped.  Other input columns stay."""
    cells = F.split(F.col(line), f"\\Q{sep}\\E", -1)
    picked = F.array(*[F.struct(F.lit(c).alias("col"), F.get(cells, F.lit(c)).alias("cell")) for c in columns])
    rest = [c for c in lines.columns if c != line]
    return lines.select(*rest, F.explode(picked).alias("x")).select(*rest, "x.col", F.expr("try_cast(x.cell AS DOUBLE)").alias("v")).where("v IS NOT NULL")


def csv_flatten(lines: DataFrame, line: str = "value", sep: str = ",") -> DataFrame:
    """(col, v): every numeric cell of every line, for all files of a folder."""
    rest = [c for c in lines.columns if c != line]
    return lines.select(*rest, F.posexplode(F.split(F.col(line), f"\\Q{sep}\\E", -1)).alias("col", "cell")).select(*rest, "col", F.expr("try_cast(cell AS DOUBLE)").alias("v")).where("v IS NOT NULL")


def change_only(df: DataFrame, by: str | Sequence[str], order: Sequence[str | Column], v: str) -> DataFrame:
    """The rows whose value differs from the one before in their series."""
    w = Window.partitionBy(*([by] if isinstance(by, str) else by)).orderBy(*order)
    before, n = F.lag(v).over(w), F.row_number().over(w)
    return df.withColumn("_p", before).withColumn("_n", n).where((F.col("_n") == 1) | ~F.col(v).eqNullSafe(F.col("_p"))).drop("_p", "_n")


def run_limited(df: DataFrame, by: str | Sequence[str], order: Sequence[str | Column], v: str, most: int = 30) -> DataFrame:
    """The first ``most`` rows of each run of equal values in a series."""
    keys = [by] if isinstance(by, str) else list(by)
    w = Window.partitionBy(*keys).orderBy(*order)
    changed = (~F.col(v).eqNullSafe(F.lag(v).over(w)) | (F.row_number().over(w) == 1)).cast("int")
    runs = df.withColumn("_c", changed).withColumn("_run", F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.withColumn("_k", F.row_number().over(Window.partitionBy(*keys, "_run").orderBy(*order))).where(F.col("_k") <= most).drop("_c", "_run", "_k")


def cyclic(spark: SparkSession, cycle: Sequence[float], n: int, noise: float = 1.0, seed: int = 233) -> DataFrame:
    """(pos, v): ``cycle`` repeated to n rows, with Gaussian noise.  The cycle is a literal, so it is small."""
    base = F.element_at(F.array(*[F.lit(float(x)) for x in cycle]), (F.col("id") % len(cycle) + 1).cast("int"))
    return spark.range(n).select(F.col("id").alias("pos"), (base + F.lit(noise) * F.randn(seed)).alias("v"))


def write_column(df: DataFrame, path: str, column: str = "v", banner: str | None = None, rows_per_file: int | None = None) -> None:
    """One value per line, files of at most ``rows_per_file``; ``banner`` is the header line."""
    writer = df.select(F.col(column).alias(banner or column)).write.option("header", banner is not None)
    if rows_per_file:
        writer = writer.option("maxRecordsPerFile", rows_per_file)
    writer.csv(path)


def write_summary(df: DataFrame, path: str, codec: str = "snappy") -> None:
    """Summaries, binary sketches among them, as Parquet."""
    df.write.option("compression", codec).parquet(path)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A place for a file to be read again until the driver ends, in the folder that driver and executors share; a local one only where both are one machine."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir is unset: a cluster needs a folder that driver and executors share")
        base = "file:///tmp/checkpoints/rankfold"
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    atexit.register(_delete, spark, path)
    return path


def _delete(spark: SparkSession, path: str) -> None:
    try:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session may be gone at exit; the folder is scratch space
        pass
