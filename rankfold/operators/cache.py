"""Tables that operators cache between their passes, and their release.

A result may still be lazy when its operator returns, so what it reads stays cached until the caller says that it is done.
Caches only spare work: what is cached is a function of its input's rows, so that a result gives the same after ``release``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.storagelevel import StorageLevel

_held: list[DataFrame] = []


def held(df: DataFrame) -> DataFrame:
    """``df``, cached in memory and on disk until ``release``."""
    out = df.persist(StorageLevel.MEMORY_AND_DISK)
    _held.append(out)
    return out


def release() -> int:
    """Drops all tables that operators have cached; how many there were.  Results computed before stay valid, lazy ones are computed anew."""
    n = len(_held)
    while _held:
        _held.pop().unpersist()
    return n
