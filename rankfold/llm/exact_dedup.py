"""Exact deduplication over an extendible-hash index on shared files.

The index maps a text's 64-bit hash to the one text that stays.  A directory addresses its buckets by the leading bits
of the hash.  Starting from one bucket, every bucket that holds more than ``bucket_capacity`` distinct hashes splits by
its next bit, and the directory doubles whenever a bucket needs more bits than it has.  The directory is folded from a
histogram of at most ``2**max_depth`` counters; buckets that are overfull at that depth keep an overflow chain, so no
row is ever dropped.

1. The directory is built from the hashes and broadcast, at most ``2**max_depth`` slots.
2. Equal texts are merged with their bytes as key.  Owner tasks take ranges of (bucket, hash), give the different texts
   behind one hash their places in its chain, and write the entries in that order to the shared folder.
3. Every row finds the slot of its hash, that slot's bucket, in the bucket the chain of its hash, and in the chain its
   text: by SHA-256, and by bytes where texts of a chain share that too.

Skew: copies are merged before the shuffle (partial aggregation), so a text that a third of all rows share reaches its
owner as one row per map task; in step 3 such rows are salted (``looked_up``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import ascii_lower, looked_up, materialize


def fold_directory(histogram: dict[int, int], max_depth: int, capacity: int) -> list[tuple[int, int]]:
    """Buckets as (depth, prefix), from counts of the first ``max_depth`` bits: split while overfull, doubling as needed."""
    levels = {max_depth: histogram}
    for depth in range(max_depth - 1, -1, -1):
        above: dict[int, int] = {}
        for prefix, n in levels[depth + 1].items():
            above[prefix >> 1] = above.get(prefix >> 1, 0) + n
        levels[depth] = above
    buckets, queue = [], [(0, 0)]
    while queue:
        depth, prefix = queue.pop()
        if depth < max_depth and levels[depth].get(prefix, 0) > capacity:
            queue += [(depth + 1, prefix * 2 + 1), (depth + 1, prefix * 2)]
        else:
            buckets.append((depth, prefix))
    return buckets


def directory(keys: DataFrame, max_depth: int, capacity: int) -> tuple[DataFrame, int]:
    """((slot, bucket), global depth) for distinct hashes ``h``: ``2**depth`` slots, at most ``2**max_depth``."""
    slot = F.shiftrightunsigned("h", 64 - max_depth) if max_depth else F.lit(0).cast("long")
    counts = {r["slot"]: r["n"] for r in keys.groupBy(slot.alias("slot")).agg(F.count("*").alias("n")).collect()}
    buckets = fold_directory(counts, max_depth, capacity)
    depth = max(d for d, _ in buckets)
    rows = [(s, number) for number, (d, prefix) in enumerate(sorted(buckets, key=lambda b: b[1] << (max_depth - b[0]))) for s in range(prefix << (depth - d), (prefix + 1) << (depth - d))]
    return keys.sparkSession.createDataFrame(rows, "slot long, bucket int"), depth


def addressed(rows: DataFrame, slots: DataFrame, depth: int) -> DataFrame:
    """``rows`` with the bucket that the directory names for their hash."""
    slot = F.shiftrightunsigned("h", 64 - depth) if depth else F.lit(0).cast("long")
    return rows.withColumn("slot", slot).join(F.broadcast(slots), "slot").drop("slot")


def build_index(rows: DataFrame, slots: DataFrame, depth: int) -> DataFrame:
    """One row per distinct text of ``rows`` (id, h, digest, body): bucket, h, chain, digest, keep_id, group_size, same, members.

    ``same`` counts the texts of a chain with this digest (1 unless they collide), ``members`` the rows of the whole chain.
    """
    texts = rows.groupBy("h", "digest", "body").agg(F.max("id").alias("keep_id"), F.count("*").alias("group_size")).drop("body")  # whole texts are compared here
    owned = addressed(texts, slots, depth).repartitionByRange("bucket", "h")
    chain = Window.partitionBy("bucket", "h")
    placed = owned.withColumn("chain", F.row_number().over(chain.orderBy("digest", "keep_id")))
    placed = placed.withColumn("members", F.sum("group_size").over(chain)).withColumn("same", F.count("*").over(Window.partitionBy("bucket", "h", "digest")))
    return placed.sortWithinPartitions("bucket", "h", "chain").select("bucket", "h", "chain", "digest", "keep_id", "group_size", "same", "members")


def look_up(entries: DataFrame, index: DataFrame, slots: DataFrame, depth: int, total: int) -> DataFrame:
    """``entries`` (h, digest, ...) with keep_id, group_size and same, found by slot, bucket, chain and digest."""
    asked = addressed(entries.withColumnRenamed("digest", "own"), slots, depth)
    found = looked_up(asked, index.drop("chain"), ["bucket", "h"], "members", total)
    return found.where("own = digest").drop("own")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, bucket_capacity: int = 100_000, max_depth: int = 16, hash_of: Callable[[Column], Column] = F.xxhash64, digest_of: Callable[[Column], Column] | None = None) -> DataFrame:
    """Groups equal texts; of each group the row with the largest id stays.

    Texts are equal when identical after lower-casing A-Z.  Returns one row per input row: ``id_col``, keep_id,
    group_size, kept, text_sha256 (of the normalised text in UTF-8).

    A null text counts as empty, and empty texts are equal to each other.  A row repeated with the same id counts twice
    and both rows are kept if the id is the largest.  Rows with a null id belong to their group; a group of such rows
    only has a null keep_id, and kept is then true.  An empty table gives an empty result.  Other columns are ignored,
    whatever their names.
    """
    sha = F.sha2("body", 256)
    body = ascii_lower(F.coalesce(F.col(text_col), F.lit("")))
    rows = docs.select(F.col(id_col).alias("id"), body.alias("body")).select("id", "body", hash_of(F.col("body")).alias("h"), (digest_of(F.col("body")) if digest_of else sha).alias("digest"))
    entries = materialize(rows.select("id", "h", "digest", *([sha.alias("sha")] if digest_of else [])), "dedup-entries")
    slots, depth = directory(entries.select("h").distinct(), max_depth, bucket_capacity)
    index = materialize(build_index(rows, slots, depth), "dedup-index")
    found = look_up(entries, index, slots, depth, entries.count())
    columns = ["id", "keep_id", "group_size", "sha" if digest_of else "digest"]
    out = found.where("same = 1").select(*columns)
    if index.where("same > 1").limit(1).count():
        out = out.unionByName(_compared(rows, index, slots, depth).withColumn("sha", sha).select(*columns[:3], (F.col("sha")).alias(columns[3])))
    kept = F.coalesce(F.col("id") == F.col("keep_id"), F.col("keep_id").isNull())
    return out.select(F.col("id").alias(id_col), "keep_id", "group_size", kept.alias("kept"), F.col(columns[3]).alias("text_sha256"))


def _compared(rows: DataFrame, index: DataFrame, slots: DataFrame, depth: int) -> DataFrame:
    """The rows whose hash and digest several texts of a chain share: these carry their text to the chain, where bytes are compared."""
    keys = index.where("same > 1").select("bucket", "h", "digest").distinct()
    asked = addressed(rows, slots, depth).join(keys, ["bucket", "h", "digest"], "left_semi")
    chains = asked.groupBy("bucket", "h", "digest", "body").agg(F.max("id").alias("keep_id"), F.count("*").alias("group_size"))
    return asked.join(chains, ["bucket", "h", "digest", "body"])
