"""Arrays of integers as compressed bytes, so that what belongs to one task and one owner travels as one row."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def tight(x: np.ndarray, level: int = 1) -> bytes:
    """Integers as bytes, equal places of all of them together, compressed."""
    import zstandard

    if not len(x):
        return b""
    raw = np.ascontiguousarray(x)
    return zstandard.ZstdCompressor(level=level).compress(raw.view(np.uint8).reshape(len(raw), raw.itemsize).T.tobytes())


def loose(blob: bytes, kind) -> np.ndarray:
    import zstandard

    if not blob:
        return np.zeros(0, kind)
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(width, -1).T).reshape(-1).view(kind)


def batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    """A batch from rows; ``schema`` names the columns like Spark does."""
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]
    columns = list(zip(*rows)) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields)], names=[n for n, _ in fields])
