import os

import pytest
from pyspark.sql import functions as F

from rankfold.operators import misc, summaries, synopsis
from rankfold.sources import generators, text
from rankfold.streaming import windows


def test_text_round_trip_and_bad_cells(spark, tmp_path):
    df = spark.createDataFrame([(1.5,), (2.5,), (None,)], "v double")
    text.write_column(df.coalesce(1), str(tmp_path / "a"), banner="v")
    assert sorted(r["v"] for r in text.read_column(spark, str(tmp_path / "a")).collect()) == [1.5, 2.5]
    lines = spark.createDataFrame([("1,x,3",), ("2,5",), ("",)], "value string")
    assert sorted(map(tuple, text.csv_columns(lines, [0, 2]).collect())) == [(0, 1.0), (0, 2.0), (2, 3.0)]
    assert text.csv_flatten(lines).count() == 4


def test_runs(spark):
    df = spark.createDataFrame([(k, v) for k, v in enumerate([1, 1, 1, 2, 2, 1, None, None])], "t int, v int").withColumn("s", F.lit("a"))
    assert [r["t"] for r in text.change_only(df, "s", ["t"], "v").orderBy("t").collect()] == [0, 3, 5, 6]
    assert [r["t"] for r in text.run_limited(df, "s", ["t"], "v", 2).orderBy("t").collect()] == [0, 1, 3, 4, 5, 6, 7]


@pytest.mark.parametrize("shape", generators.PAGE_SHAPES)
def test_page_shapes(spark, shape):
    df = generators.page_values(spark, 300, shape)
    assert df.count() == 300 and df.where("v IS NULL").count() == 0


def test_generators(spark):
    assert sorted(r["v"] for r in generators.permutation(spark, 50).collect()) == list(range(50))
    assert generators.log_normal(spark, 100).agg(F.min("v") > 50).first()[0]
    assert generators.out_of_order(spark, 100).where("arrival < event_time").count() == 0
    assert all(0 <= a and b <= 100 and b - a == 10 for a, b in generators.random_ranges(spark, 100, 10, 20).collect())
    assert text.cyclic(spark, [1.0, 2.0], 5, noise=0.0).select("v").orderBy("pos").toPandas()["v"].tolist() == [1.0, 2.0, 1.0, 2.0, 1.0]


def test_numbered_is_row_number(spark):
    df = spark.range(500).select(F.pmod("id", F.lit(7)).alias("a"), "id").repartition(5)
    got = summaries.numbered(df, "a", "id").orderBy("rn").collect()
    assert [r["rn"] for r in got] == list(range(1, 501))
    assert [(r["a"], r["id"]) for r in got] == sorted((k % 7, k) for k in range(500))


def test_arithmetic_progressions(spark):
    df = spark.createDataFrame([(x,) for x in (1, 3, 5, 7, 8, 9, 20)], "a int")
    assert sorted(map(tuple, misc.arithmetic_progressions(df, "a", 3, 4).collect())) == [(1, 2, 5), (1, 4, 3), (7, 1, 3)]


def test_sample_helpers(spark):
    df = spark.range(1000).select(F.col("id").cast("double").alias("v"))
    sample = summaries.bottom_k(df, 100)
    assert sample.count() == 100 and 250 < summaries.sample_quantile(sample, "v", 0.5) < 750
    assert summaries.sample_quantile(df.limit(0), "v", 0.5) is None


def test_divided_chunks_keep_their_weight(spark):
    chunk = spark.range(1000).select(F.lit(1).cast("long").alias("chunk_id"), F.floor(F.col("id") / 250).alias("page"), F.rand(1).alias("v"))
    assert synopsis.divide_chunk(chunk, "page", "v").agg(F.sum("weight")).first()[0] == 1000


def test_streaming_windows_and_late_rows(spark, tmp_path):
    for k, values in enumerate([[(1, 1.0), (5, 2.0)], [(3, 9.0), (8, 3.0)], [(8, 4.0), (9, 5.0)]]):
        spark.createDataFrame([(t, v) for t, v in values], "t long, v double").coalesce(1).write.mode("append").parquet(str(tmp_path / f"in/k={k}"))
    stream = spark.readStream.schema("t long, v double, k int").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = windows.split_stream(stream.select("t", "v"), "t", *(str(tmp_path / x) for x in ("now", "late", "state", "check")))
    query.awaitTermination()
    now, late = (spark.read.parquet(str(tmp_path / x)).count() for x in ("now", "late"))
    assert now + late == 6 and late >= 1


def test_pages_kept_by_a_stream_survive_a_replayed_batch(spark, tmp_path):
    source, kept, check = (str(tmp_path / x) for x in ("in", "kept", "check"))
    batches = [[("2024-01-01 05:00:00", 1.0), ("2024-01-02 06:00:00", 2.0)], [("2024-01-01 09:00:00", 50.0), ("2024-01-03 01:00:00", 4.0), (None, 9.0)], [("2024-01-03 02:00:00", -1.0), ("2024-01-03 01:00:00", 70.0), ("2024-01-04 00:00:00", None)]]
    schema = "t timestamp_ntz, v double"

    def run():
        windows.upsert_pages(spark.readStream.schema(schema).parquet(source), "t", "v", "1 day", kept, check, fold_every=2).awaitTermination()
        pages = windows.stored_pages(spark, kept).orderBy("page").select(F.dayofmonth("page"), "n", "n_late", "total", "min_v", "max_v").collect()
        return list(map(tuple, pages)), sorted(map(str, windows.stored_late(spark, kept).select("v", "batch").collect()))

    for rows in batches:
        spark.createDataFrame([(t, v) for t, v in rows], "t string, v double").select(F.col("t").cast("timestamp_ntz"), "v").coalesce(1).write.mode("append").parquet(source)
        got = run()
    assert got[0] == [(1, 1, 1, 1.0, 1.0, 1.0), (2, 1, 0, 2.0, 2.0, 2.0), (3, 2, 1, 3.0, -1.0, 4.0), (4, 1, 0, None, None, None)]
    assert [x.split("batch")[0] for x in got[1]] == ["Row(v=50.0, ", "Row(v=70.0, ", "Row(v=9.0, "]
    for _ in range(2):  # the run died before the last batch was committed: it is run again
        for name in ("2", ".2.crc"):
            os.remove(f"{check}/commits/{name}")
        assert run() == got
    assert windows.stored_pages(spark, kept, 0).agg(F.sum("n")).first()[0] == 2
