"""Where values stand among sorted bounds: literal arrays and binary search inside a row.

Bounds are literals of the plan, so every evaluation of it deals its rows the same way.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Range parts for each shuffle partition, so that parts share partitions evenly; rows of the sample for each part.
PARTS_EACH, SAMPLED_EACH = 4, 32


def doubles(values: Sequence[float]) -> Column:
    """One literal array of doubles; the plan does not grow with their number."""
    return F.split(F.lit(",".join(repr(float(v)) for v in values)), ",").cast("array<double>") if len(values) else F.array().cast("array<double>")


def count_upto(bounds: Column, n: int, key: Column) -> Column:
    """How many of the ``n`` ascending elements of ``bounds`` are at most ``key``, by halving; none for a null key."""
    jumps = F.array(*[F.lit(1 << s) for s in range(n.bit_length() - 1, -1, -1)])
    step = lambda at, jump: F.when((at + jump <= n) & (F.get(bounds, at + jump - 1) <= key), at + jump).otherwise(at)
    return F.aggregate(jumps, F.lit(0), step) if n else F.lit(0)


#: Up to so many bounds are a tree of comparisons in the generated code; of more, a tree finds the block that a key is in.
TREE = 128


def _upto(bounds: list[Column], key: Column) -> Column:
    size = max(1, -(-len(bounds) // TREE))
    ends = bounds[size - 1 :: size]

    def tree(a: int, b: int) -> Column:
        m = (a + b) // 2
        return F.lit(a * size) if a == b else F.when(key >= ends[m], tree(m + 1, b)).otherwise(tree(a, m))

    at = tree(0, len(ends))
    # the few bounds of that block are looked at one by one, also in the generated code; none beyond the last is at most the key
    every = F.array(*bounds)
    return reduce(lambda upto, k: upto + F.coalesce((F.get(every, at + k) <= key).cast("int"), F.lit(0)), range(size - 1), at)


def range_part(df: DataFrame, *order: str) -> Column:
    """The number of the range that a row is in, by the columns ``order``, ascending, nulls first.

    Bounds are taken from a sample: the rows with the smallest hashes of their keys.  It is of bounded size and only its keys reach the
    driver.  The first column alone deals the rows if it parts the sample well enough.
    """
    parts = PARTS_EACH * max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    drawn = df.select(*order).orderBy(F.xxhash64(*order)).limit(parts * SAMPLED_EACH).collect()
    sortable = [tuple((v is not None, v != v if isinstance(v, float) else False, 0 if v is None or v != v else v) for v in r) for r in drawn]
    drawn = [drawn[i] for i in sorted(range(len(drawn)), key=sortable.__getitem__)]
    cuts = [drawn[len(drawn) * k // parts] for k in range(1, parts)] if len(drawn) >= 2 * parts else drawn[1:]
    lit = lambda v, c: F.lit(v).cast(df.schema[c].dataType)
    first = order[0]
    heads = list(dict.fromkeys(r[first] for r in cuts if r[first] is not None))
    if 2 * len(heads) >= len(cuts):
        # a null is before every bound
        return F.coalesce(_upto([lit(v, first) for v in heads], F.col(first)), F.lit(0))
    bounds = [F.struct(*[lit(r[c], c).alias(f"c{i}") for i, c in enumerate(order)]) for r in dict.fromkeys(cuts)]
    return _upto(bounds, F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(order)]))
