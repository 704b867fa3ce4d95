"""Line deduplication by content-defined line chunks.

Lines are hashed, and a rolling hash runs over the hashes of every ``min_lines`` consecutive lines.  Where such a run's hash
occurs elsewhere too, in this document or another, the lines belong to a chunk; a chunk ends where the rolling hash
stops repeating.  So the boundaries come from content alone and move with it when lines are inserted above, and a
passage repeated at any place between any neighbours is found whole.  Hashes only choose: the runs of the chunks are then
merged with their whole text as key, so bytes are compared.  A run that occurs more than once is kept where it occurs first
(smallest id, then first place): no line of a first copy is ever removed, so every passage of ``min_lines`` lines that the
input has twice still stands somewhere.  Other copies are removed.

1. The rows are numbered and written.  The rolling hashes, short rows, are counted; equal ones combine before the shuffle.
2. Documents with repeated hashes get the list of their places; only these send text of runs, and only of repeated ones.
3. Runs with equal text are grouped; the first and the others go back to their documents by hash and SHA-256.

A run that a third of all rows share is one row per map task in the groupings and salted in the joins (``looked_up``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import let, looked_up, materialize

RESULT = ("n_runs", "n_repeated", "lines_removed")


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def rolling_hashes(text: Column, n_lines: int) -> Column:
    """array<long>: a hash of the hashes of ``n_lines`` lines, from each line on as far as there are so many; null if there are none."""
    roll = lambda h: F.when(F.size(h) >= n_lines, F.transform(F.sequence(F.lit(1), F.size(h) - n_lines + 1), lambda i: F.xxhash64(F.slice(h, i, n_lines))))
    return let(F.transform(_lines(text), lambda x: F.xxhash64(x)), roll)


def _total(table: DataFrame) -> int:
    return table.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_lines: int = 2) -> DataFrame:
    """All input columns, ``text_col`` without its repeated lines, and n_runs, n_repeated, lines_removed.

    Lines end at ``\\n``; a run is ``min_lines`` consecutive lines with some non-space character.  Runs overlap.  A run
    equal to one before it, in the order of id, row and line, is repeated; its lines are removed unless one of them belongs to
    a run that is the first of several equal ones.  n_runs counts the runs of a text, blank ones too, n_repeated the
    repeated ones, lines_removed the lines that go.
    A text of which nothing is left becomes empty; the row stays.  A null text stays null and counts as empty.  Rows that
    repeat an id, or id and text, are rows of their own: the first keeps its lines.  Null ids come first.  An empty table
    gives an empty result.  Other columns are carried along, but for those named like a result column, which go.
    """
    numbered = materialize(docs.select(F.monotonically_increasing_id().alias("no"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")), "lines-rows")
    text, own = F.col("row").getField(text_col), F.col("row").getField(id_col)
    runs = numbered.select("no", F.posexplode(rolling_hashes(text, min_lines)).alias("place", "h"))
    hashes = materialize(runs.groupBy("h").agg(F.count("*").alias("n")).where("n > 1"), "lines-hashes")
    places = looked_up(runs, hashes, ["h"], "n", _total(hashes)).groupBy("no").agg(F.collect_set("place").alias("places"))
    held = materialize(numbered.select("no", own.alias("id"), text.alias("text")).join(places, "no"), "lines-held")
    body = lambda lines: F.transform("places", lambda k: F.struct(k.alias("place"), F.array_join(F.slice(lines, k + 1, min_lines), "\n").alias("body")))
    chunks = held.select("no", "id", F.explode(let(_lines(F.col("text")), body)).alias("run")).select("no", "id", "run.place", "run.body").where(F.col("body").rlike(r"\S"))
    first = F.min(F.struct("id", "no", "place"))
    keys = [F.sha2("body", 256).alias("digest"), F.xxhash64("body").alias("h")]
    groups = chunks.groupBy("body").agg(first.alias("first"), F.count("*").alias("n")).where("n > 1")
    repeated = materialize(groups.select(*keys, "first", "n"), "lines-repeated")
    hits = looked_up(chunks.select("no", "place", *keys), repeated, ["digest", "h"], "n", _total(repeated))
    first_copy = (F.col("no") == F.col("first.no")) & (F.col("place") == F.col("first.place"))
    marks = hits.groupBy("no").agg(F.collect_set(F.when(~first_copy, F.col("place"))).alias("gone"), F.collect_set(F.when(first_copy, F.col("place"))).alias("firsts"))
    # runs that share a line with a first copy stay
    beside = F.flatten(F.transform("firsts", lambda k: F.sequence(k - (min_lines - 1), k + (min_lines - 1))))
    left = numbered.join(marks.select("no", "gone", F.array_except("gone", beside).alias("cut")), "no", "left")
    covered = F.array_distinct(F.flatten(F.transform("cut", lambda k: F.sequence(k, k + min_lines - 1))))
    cut = lambda lines: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), covered), lambda k: F.element_at(lines, k + 1)), "\n")
    stay = F.when(text.isNull() | (F.coalesce(F.size("cut"), F.lit(0)) == 0), text).otherwise(let(_lines(text), cut))
    kept = [stay.alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns if c.lower() not in RESULT]
    n_runs = F.greatest(F.size(_lines(text)) - min_lines + 1, F.lit(0))
    counts = (n_runs, F.coalesce(F.size("gone"), F.lit(0)), F.coalesce(F.size(covered), F.lit(0)))
    return left.select(*kept, *(n.cast("long").alias(name) for n, name in zip(counts, RESULT)))
