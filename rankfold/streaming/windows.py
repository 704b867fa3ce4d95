"""Streaming synopses: a sketch per time window, and late rows kept apart instead of dropped.

A watermark closes windows and bounds their state; rows that come later than that are routed to a side table by
``foreachBatch`` and merged into the pages that they overlap by ``synopsis.rebuild_pages``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def windowed_sketches(stream: DataFrame, t: str, v: str, width: str, *, delay: str | None = None, slide: str | None = None, k: int = 200, by: tuple[str, ...] = ()) -> DataFrame:
    """(start, end, by..., n, lo, hi, sketch) of each window of event time; ``delay`` sets the watermark."""
    rows = stream.withColumn("_t", F.col(t).cast("timestamp"))
    if delay:
        rows = rows.withWatermark("_t", delay)
    span = F.window("_t", width, slide) if slide else F.window("_t", width)
    x = F.col(v).cast("double")
    grouped = rows.groupBy(span.alias("w"), *by).agg(F.count(x).alias("n"), F.min(x).alias("lo"), F.max(x).alias("hi"), F.expr(f"kll_sketch_agg_double(cast({v} as double), {k})").alias("sketch"))
    return grouped.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n", "lo", "hi", "sketch")


def session_sketches(rows: DataFrame, t: str, v: str, gap: str, *, delay: str | None = None, k: int = 200, by: tuple[str, ...] = ()) -> DataFrame:
    """(start, end, by..., n, lo, hi, sketch) of each session: rows of a key with less than ``gap`` between neighbours.  For streams ``delay`` sets the watermark."""
    rows = rows.withColumn("_t", F.col(t).cast("timestamp"))
    if delay:
        rows = rows.withWatermark("_t", delay)
    x = F.col(v).cast("double")
    grouped = rows.groupBy(F.session_window("_t", gap).alias("w"), *by).agg(F.count(x).alias("n"), F.min(x).alias("lo"), F.max(x).alias("hi"), F.expr(f"kll_sketch_agg_double(cast({v} as double), {k})").alias("sketch"))
    return grouped.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n", "lo", "hi", "sketch")


def drain(df: DataFrame, name: str, checkpoint: str | None = None, mode: str = "complete") -> DataFrame:
    """Runs a bounded stream to its end into a memory table and returns that; for tests and replays."""
    writer = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True)
    if checkpoint:
        writer = writer.option("checkpointLocation", checkpoint)
    query = writer.start()
    query.awaitTermination()
    return df.sparkSession.table(name)


def _stored(spark: SparkSession, path: str) -> DataFrame | None:
    """The table at ``path``; None before anything was written there."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def _sealed_before(spark: SparkSession, state_path: str, number: int):
    """The greatest time of the batches before ``number``; None if there is none."""
    state = _stored(spark, state_path)
    return None if state is None else state.where(F.col("batch") < number).agg(F.max("sealed").alias("m")).first()["m"]


def split_stream(stream: DataFrame, t: str, in_time_path: str, late_path: str, state_path: str, checkpoint: str, *, on_batch: Callable[[DataFrame, DataFrame], None] | None = None) -> StreamingQuery:
    """Writes each micro-batch to the table of rows in time or the table of late rows.

    A row is late if its time is not after the greatest time of the batches before, which is kept as a one-row table
    per batch.  A batch that is run again after a failure writes the same places again, so nothing is doubled.
    """

    def route(batch: DataFrame, number: int) -> None:
        seen = _sealed_before(batch.sparkSession, state_path, number)
        tagged = batch.withColumn("is_late", F.lit(False) if seen is None else F.col(t) <= F.lit(seen)).persist()
        try:
            in_time, late = tagged.where("NOT is_late").drop("is_late"), tagged.where("is_late").drop("is_late")
            in_time.write.mode("overwrite").parquet(f"{in_time_path}/batch={number}")
            late.write.mode("overwrite").parquet(f"{late_path}/batch={number}")
            tagged.agg(F.max(t).alias("sealed")).select(F.lit(number).alias("batch"), F.greatest("sealed", F.lit(seen).cast(batch.schema[t].dataType)).alias("sealed")).write.mode("overwrite").parquet(f"{state_path}/n={number}")
            if on_batch:
                on_batch(in_time, late)
        finally:
            tagged.unpersist()

    return stream.writeStream.foreachBatch(route).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _folded(parts: DataFrame) -> DataFrame:
    """One row per page of rows that each stand for a part of it."""
    totals = [F.sum(c).alias(c) for c in ("n", "n_late", "total")]
    ends = [f(c).alias(c) for f, c in ((F.min, "min_t"), (F.max, "max_t"), (F.min, "min_v"), (F.max, "max_v"))]
    return parts.groupBy("page").agg(*totals, *ends, F.expr("kll_merge_agg_double(sketch)").alias("sketch"))


def upsert_pages(stream: DataFrame, t: str, v: str, width: str, path: str, checkpoint: str, *, k: int = 64, fold_every: int = 16) -> StreamingQuery:
    """Keeps synopses of pages of event time, ``width`` each, up to date with a stream; late rows are kept apart.

    Below ``path``: ``parts/batch=N`` holds what batch N adds to its pages, ``late/batch=N`` its late rows, ``state/n=N``
    the greatest time seen, ``pages/upto=N`` all pages after batch N, written every ``fold_every`` batches so that readers and
    later folds start there.  A batch touches its own pages only, and writes whole folders named by its number: run again after a
    failure, it replaces what it wrote and adds nothing twice.  ``stored_pages`` and ``stored_late`` read the tables.

    A row is late if it has no time, or one not after the greatest of the batches before.  A late row counts in n_late of
    the page of its time, whose answers are then incomplete, and in nothing else of it.
    """

    def upsert(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        seen = _sealed_before(spark, f"{path}/state", number)
        late = F.col(t).isNull() if seen is None else F.col(t).isNull() | (F.col(t) <= F.lit(seen))
        tagged = batch.withColumn("is_late", late).persist()
        try:
            tagged.where("is_late").drop("is_late").write.mode("overwrite").parquet(f"{path}/late/batch={number}")
            x, own = F.col(v).cast("double"), ~F.col("is_late")
            of = lambda c: F.when(own, c)
            sketch = F.expr(f"kll_sketch_agg_double(x, {k}) FILTER (WHERE NOT is_late AND x IS NOT NULL AND NOT isnan(x))")
            rows = tagged.where(F.col(t).isNotNull()).withColumn("x", x).groupBy(F.window(t, width)["start"].alias("page"))
            parts = rows.agg(F.count_if(own).alias("n"), F.count_if("is_late").alias("n_late"), F.sum(of(F.col("x"))).alias("total"), F.min(of(F.col(t))).alias("min_t"), F.max(of(F.col(t))).alias("max_t"), F.min(of(F.col("x"))).alias("min_v"), F.max(of(F.col("x"))).alias("max_v"), sketch.alias("sketch"))
            parts.write.mode("overwrite").parquet(f"{path}/parts/batch={number}")
            sealed = F.greatest(F.max(t), F.lit(seen).cast(batch.schema[t].dataType))
            tagged.agg(sealed.alias("sealed")).select(F.lit(number).cast("long").alias("batch"), "sealed").write.mode("overwrite").parquet(f"{path}/state/n={number}")
        finally:
            tagged.unpersist()
        if (number + 1) % fold_every == 0:
            stored_pages(spark, path, number).write.mode("overwrite").parquet(f"{path}/pages/upto={number}")

    return stream.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stored_pages(spark: SparkSession, path: str, upto: int | None = None) -> DataFrame:
    """(page, n, n_late, total, min_t, max_t, min_v, max_v, sketch) after all batches, or after batch ``upto``: the last fold before and the parts since."""
    last = (1 << 62) if upto is None else upto
    parts = spark.read.parquet(f"{path}/parts").where(F.col("batch") <= last)
    folds = _stored(spark, f"{path}/pages")
    at = None if folds is None else folds.where(F.col("upto") < last).agg(F.max("upto").alias("m")).first()["m"]
    if at is not None:
        parts = parts.where(F.col("batch") > at).drop("batch").unionByName(folds.where(F.col("upto") == at).drop("upto"))
    return _folded(parts.drop("batch"))


def stored_late(spark: SparkSession, path: str) -> DataFrame:
    """The late rows of all batches, with the number of their batch."""
    return spark.read.parquet(f"{path}/late")
