"""Target-distribution importance resampling: draw the documents whose hashed n-grams look most like a target's.

Higher-order functions turn a text into the array of its features' buckets.  Counting the buckets of the corpus and of the
target combines in the tasks, so that at most one row for each bucket and task is shuffled; the logarithm of the ratio of
the two smoothed shares is a bucket's gain.  Scoring explodes nothing: a document's weight is an ``aggregate`` over
``element_at`` of the gains, one literal array with an entry for each bucket.  A Gumbel number drawn from the id's hash is
added to the weight, and the highest scores are a sample without replacement.

Ranks come from range partitions of (id, weight, score), written once with the number of the partition that each row is
in, so that no task sees more than a partition and a second reading gives the same ranks.

Nulls and empty texts have no features, weight 0 and are never drawn (``least_words`` > 0).  Of equal scores the smaller
id wins, then the row read first; a null id hashes like an empty one and comes last among equals.  Repeated rows are documents
of their own.  Other columns, whatever their names, take no part and are not returned.  An empty target leaves gains by the
corpus alone; an empty corpus gives an empty table.  A text's words must fit a task: some 40 bytes a word for the one
text at hand.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import ascii_lower, let, materialize, shuffle_width

#: Fixed value: what is no letter and no digit after A-Z are lower-cased; all beyond ASCII counts as letters.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Rows of one range partition when scores are ranked.
RANKED_ROWS = 1_000_000


def words_of(text: Column) -> Column:
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), GAP), lambda w: w != "")


def features_of(words: Column, least: int, most: int) -> Column:
    """All runs of ``least`` to ``most`` consecutive words, joined by one blank."""
    runs = lambda k: words if k == 1 else F.when(F.size(words) < k, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.size(words) - (k - 1)), lambda i: F.array_join(F.slice(words, i, F.lit(k)), " ")))
    each = [runs(k) for k in range(least, most + 1)]
    return each[0] if len(each) == 1 else F.concat(*each)


def buckets_of(features: Column, buckets: int) -> Column:
    """The bucket of each feature: the crc32 of its UTF-8 bytes by ``buckets``."""
    return F.transform(features, lambda f: (F.crc32(f.cast("binary")) % buckets).cast("int"))


def bucketed(docs: DataFrame, buckets: int, ngrams: tuple[int, int], *keep: str) -> DataFrame:
    """``keep``, n_words and the buckets of each text."""
    both = let(words_of(F.col("text")), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), buckets_of(features_of(w, *ngrams), buckets).alias("buckets")))
    return docs.select(*keep, both.alias("_b")).select(*keep, "_b.n_words", "_b.buckets")


def bucket_counts(docs: DataFrame, buckets: int, ngrams: tuple[int, int]) -> DataFrame:
    """(bucket, n) over whole texts; combined in the tasks, at most ``buckets`` rows from each."""
    each = F.explode_outer("buckets").alias("bucket")  # the inner form would cut every text twice, to look for empty arrays first
    return bucketed(docs.select("text"), buckets, ngrams).select(each).where(F.col("bucket").isNotNull()).groupBy("bucket").agg(F.count("*").alias("n"))


def gains(docs: DataFrame, target: DataFrame, buckets: int, ngrams: tuple[int, int]) -> DataFrame:
    """(bucket, gain) for every bucket: floor(1000 ln) of the ratio of the target's share to the corpus's, both smoothed by one."""
    every = docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    joined = every.join(bucket_counts(docs, buckets, ngrams).withColumnRenamed("n", "s"), "bucket", "left").join(bucket_counts(target, buckets, ngrams).withColumnRenamed("n", "t"), "bucket", "left").fillna(0, ["s", "t"])
    totals = joined.agg(F.sum("s").alias("s_all"), F.sum("t").alias("t_all"))  # one row
    d = lambda c: F.col(c).cast("double")
    ratio = (d("t") + 1) * (d("s_all") + buckets) / ((d("s") + 1) * (d("t_all") + buckets))
    return joined.crossJoin(F.broadcast(totals)).select("bucket", F.floor(F.lit(1000.0) * F.ln(ratio)).cast("long").alias("gain"))


def gumbel(doc_id: Column, seed: int) -> Column:
    """floor(-1000 ln(-ln u)) with u from the first 32 bits of sha256("seed:id")."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.ln(-F.ln((h + 0.5) / 4294967296.0))).cast("long")


def scored(docs: DataFrame, target: DataFrame, buckets: int = 10_000, ngrams: tuple[int, int] = (1, 1), seed: int = 2024) -> DataFrame:
    """doc_id, n_words, n_features, weight, score of every row."""
    table = [r["gain"] for r in gains(docs, target, buckets, ngrams).orderBy("bucket").collect()]  # an entry for each bucket
    literal = F.split(F.lit(",".join(map(str, table))), ",").cast("array<bigint>")
    weight = F.aggregate("buckets", F.lit(0).cast("long"), lambda sum_, b: sum_ + F.element_at(literal, b + 1))
    return bucketed(docs, buckets, ngrams, "doc_id").select("doc_id", "n_words", F.size("buckets").cast("long").alias("n_features"), weight.alias("weight")).withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed))


def resample(docs: DataFrame, target: DataFrame, *, percent: int = 10, least_words: int = 20, buckets: int = 10_000, ngrams: tuple[int, int] = (1, 1), seed: int = 2024) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every row of ``docs`` (doc_id, text); rank is null where it isn't drawn.

    Of the N documents with ``least_words`` words at least, floor(percent N / 100) are drawn.
    """
    spark = docs.sparkSession
    rows = materialize(scored(docs, target, buckets, ngrams, seed).withColumn("_row", F.monotonically_increasing_id()), "scored")
    fit = rows.where(F.col("n_words") >= least_words)
    n = fit.count()
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("_row")]
    dealt = materialize(fit.repartitionByRange(max(1, min(shuffle_width(spark, -(-n // RANKED_ROWS)), n)), *order).withColumn("_part", F.spark_partition_id()), "ranges")
    sizes = sorted((r["_part"], r["n"]) for r in dealt.groupBy("_part").agg(F.count("*").alias("n")).collect())  # a row for each range
    before = list(accumulate((s for _, s in sizes), initial=0))
    drawn = percent * n // 100
    offsets = spark.createDataFrame([(p, b) for (p, _), b in zip(sizes, before) if b < drawn], "_part int, _before long")
    place = F.col("_before") + F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    result = ["doc_id", "n_features", "weight", "score", "rank"]
    none = F.lit(None).cast("long").alias("rank")
    with_drawn = dealt.join(F.broadcast(offsets), "_part").withColumn("_place", place).withColumn("rank", F.when(F.col("_place") <= drawn, F.col("_place")))
    beyond = dealt.join(F.broadcast(offsets), "_part", "left_anti").select(*result[:-1], none)
    short = rows.where(F.col("n_words") < least_words).select(*result[:-1], none)
    return with_drawn.select(*result).unionByName(beyond).unionByName(short)
