"""Embedding near-dedup by int8 tile products with rigorous bounds.

Each vector is scaled to length one and rounded to int8 steps of its own size; the length of what the rounding took away
is computed exactly, per vector.  For x = x' + e and y = y' + f the product x.y differs from x'.y' by at most
|x'||f| + |e||y'| + |e||f|, so one product of int8 tiles decides nearly every pair, and only pairs that the bounds leave
open are computed again in double precision.  (The tiles' integers are multiplied in float lanes, where sums under
2**24 are exact; wider vectors take double lanes.)

1. Vectors are compared within a label.  Equal vectors are merged first and counted, so a vector that a third of all rows
   share is one row.
2. A label's vectors are dealt to tiles of some thousands, each packed to one row of steps and bounds, an eighth of the
   doubles.  Each pair of tiles is a bounded unit of work however large the label; it returns link counts, a spanning
   forest of its links, at most one edge per vector, and the vectors that have open pairs.
3. Only those vectors follow in full precision to their pair of tiles, where the open pairs are settled.
4. Components are found in rounds of shuffles; rows find their vector's answer by label and SHA-256.

Each steps row travels once per tile of its label, so what is shuffled and compared still grows with the square of a
label's size, divided by the tile: exact comparison within a label asks for every pair.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components, forest
from .shared import looked_up, materialize

#: Vectors to a tile, fewer if they are wide: a tile's steps are at most TILE_BYTES.
TILE, TILE_BYTES = 8192, 2_000_000
#: More than what double precision can err in a cosine of up to a million components.
SLACK = 1e-9
STEPS = "label string, width int, t long, tiles long, no binary, rep binary, copies binary, steps binary, size binary, kept binary, lost binary"
FOUND = "label string, width int, first long, second long, t long, no long, rep long, copies long, links long, root long, open boolean, steps binary, size double, kept double, lost double"


@dataclass
class Steps:
    """Rounded vectors: int8 steps, size of a step, length of the rounded vector and of what was lost."""

    steps: np.ndarray
    size: np.ndarray
    kept: np.ndarray
    lost: np.ndarray


def unit(v: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled first, so that squares neither overflow nor vanish."""
    x = v / np.abs(v).max(axis=1)[:, None]
    return x / np.linalg.norm(x, axis=1)[:, None]


def quantise(x: np.ndarray) -> Steps:
    """The steps of rows of length one."""
    size = np.abs(x).max(axis=1) / 127.0
    steps = np.rint(x / size[:, None]).astype(np.int8)
    rounded = steps * size[:, None]
    return Steps(steps, size, np.linalg.norm(rounded, axis=1), np.linalg.norm(x - rounded, axis=1))


def judged(p: Steps, q: Steps, threshold: float, block: int = 256) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Places (i, j) of pairs that surely reach ``threshold`` and places of those that the bounds leave open, by blocks of p."""
    lane = np.float32 if p.steps.shape[1] * 127 * 127 < 1 << 24 else np.float64
    other = q.steps.astype(lane).T
    for a in range(0, len(p.size), block):
        some = slice(a, a + block)
        product = (p.steps[some].astype(lane) @ other).astype(np.float64) * p.size[some, None] * q.size[None, :]
        bound = p.kept[some, None] * q.lost[None, :] + p.lost[some, None] * q.kept[None, :] + p.lost[some, None] * q.lost[None, :]
        may = product + bound >= threshold - SLACK
        sure = product - bound >= threshold + SLACK
        i, j = np.nonzero(sure)
        k, m = np.nonzero(may & ~sure)
        yield i + a, j, k + a, m


class _Links:
    """Counts and components of links that come block by block; nothing but the forest is kept of them."""

    def __init__(self, copies: np.ndarray) -> None:
        self.copies, self.n = copies, np.zeros(len(copies), np.int64)
        self.root = np.arange(len(copies))

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        if len(i):
            size = len(self.copies)
            self.n += (np.bincount(i, self.copies[j], size) + np.bincount(j, self.copies[i], size)).astype(np.int64)
            self.root = forest(size, np.concatenate([i, np.arange(size)]), np.concatenate([j, self.root]))


def near_pairs(x: np.ndarray, y: np.ndarray, threshold: float, block: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of all pairs of rows with cosine of at least ``threshold``; rows have length one."""
    found = [(np.zeros(0, int), np.zeros(0, int))]
    for i, j, k, m in judged(quantise(x), quantise(y), threshold, block):
        hit = np.einsum("ij,ij->i", x[k], y[m]) >= threshold
        found += [(i, j), (k[hit], m[hit])]
    return tuple(np.concatenate(c) for c in zip(*found))


def _doubles(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    flat = column.combine_chunks().flatten() if isinstance(column, pa.ChunkedArray) else column.flatten()
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def _numbers(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy().astype(np.int64)


def _rows(columns: dict, schema: str) -> pa.Table:
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "double": pa.float64(), "boolean": pa.bool_()}
    return pa.table([pa.array(columns[n], kinds[k]) for n, k in (f.split() for f in schema.split(", "))], names=[f.split()[0] for f in schema.split(", ")])


def _packed(table: pa.Table) -> pa.Table:
    """The steps of a tile as one row."""
    label, width, t, tiles = (table.column(c)[0].as_py() for c in ("label", "width", "t", "tiles"))
    s = quantise(unit(_doubles(table.column("v"), width)))
    blobs = {"no": _numbers(table, "no"), "rep": _numbers(table, "rep"), "copies": _numbers(table, "copies"), "steps": s.steps, "size": s.size, "kept": s.kept, "lost": s.lost}
    return _rows({"label": [label], "width": [width], "t": [t], "tiles": [tiles]} | {k: [np.ascontiguousarray(b).tobytes()] for k, b in blobs.items()}, STEPS)


def _compared(threshold: float):
    """A pair of tiles (or one): counts and forest of sure links, and the vectors of open pairs."""

    def compared(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["t"])
        width, ends = rows[0]["width"], []
        for r in rows:
            n = np.frombuffer(r["no"], np.int64)
            ends.append((n, np.frombuffer(r["rep"], np.int64), np.frombuffer(r["copies"], np.int64), Steps(np.frombuffer(r["steps"], np.int8).reshape(-1, width), *(np.frombuffer(r[c], np.float64) for c in ("size", "kept", "lost")))))
        no, rep, copies = (np.concatenate([e[k] for e in ends]) for k in range(3))
        cut = len(ends[0][0]) if len(ends) > 1 else 0
        p, q = ends[0][3], ends[-1][3]
        links, open_ = _Links(copies), np.zeros(len(no), bool)
        for i, j, k, m in judged(p, q, threshold) if len(ends) > 1 or rows[0]["first"] == rows[0]["second"] else ():
            if not cut:
                i, j, k, m = i[i < j], j[i < j], k[k < m], m[k < m]
            links.add(i, j + cut)
            open_[k] = open_[m + cut] = True
        some = np.flatnonzero((links.n > 0) | open_)
        whole = Steps(*(np.concatenate([getattr(e[3], f) for e in ends]) for f in ("steps", "size", "kept", "lost")))
        tile = np.repeat([r["t"] for r in rows], [len(e[0]) for e in ends])
        same = {c: [rows[0][c]] * len(some) for c in ("label", "width", "first", "second")}
        steps = [whole.steps[k].tobytes() if open_[k] else None for k in some.tolist()]
        return _rows(same | {"t": tile[some], "no": no[some], "rep": rep[some], "copies": copies[some], "links": links.n[some], "root": rep[links.root[some]], "open": open_[some], "steps": steps, "size": whole.size[some], "kept": whole.kept[some], "lost": whole.lost[some]}, FOUND)

    return compared


def _settled(threshold: float):
    """The open pairs of a pair of tiles in double precision."""

    def settled(table: pa.Table) -> pa.Table:
        table = table.sort_by([("t", "ascending"), ("no", "ascending")])
        width, first, second = (table.column(c)[0].as_py() for c in ("width", "first", "second"))
        rep, copies, t, x = _numbers(table, "rep"), _numbers(table, "copies"), _numbers(table, "t"), unit(_doubles(table.column("v"), width))
        steps = np.frombuffer(b"".join(table.column("steps").to_pylist()), np.int8).reshape(-1, width)
        whole = Steps(steps, *(table.column(c).to_numpy() for c in ("size", "kept", "lost")))
        cut = 0 if first == second else int(np.searchsorted(t, second))
        part = lambda s: Steps(whole.steps[s], whole.size[s], whole.kept[s], whole.lost[s])
        links = _Links(copies)
        for _, _, k, m in judged(part(slice(0, cut or None)), part(slice(cut, None)), threshold):
            m = m + cut
            k, m = k[k < m], m[k < m]
            for a in range(0, len(k), 100_000):
                i, j = k[a : a + 100_000], m[a : a + 100_000]
                hit = np.einsum("ij,ij->i", x[i], x[j]) >= threshold
                links.add(i[hit], j[hit])
        some = links.n > 0
        return _rows({"no": _numbers(table, "no")[some], "rep": rep[some], "links": links.n[some], "root": rep[links.root[some]]}, "no long, rep long, links long, root long")

    return settled


def embedding_dedup(vectors: DataFrame, threshold: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", tile: int = TILE) -> DataFrame:
    """One row per vector: ``id_col``, n_links (other vectors linked directly), component_id (smallest id reachable), kept.

    Vectors link when their labels are equal and not null and their cosine, in double precision, is at least
    ``threshold``.  A vector that is null, empty, zero or holds a null or non-finite component links with nothing, nor
    do vectors of different lengths with one another.  Ids are integers; rows that repeat an id are rows of their own
    that share its component.  An empty table gives an empty result; other columns are ignored.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), F.transform(F.col(vector_col).cast("array<double>"), lambda c: c + F.lit(0.0)).alias("v"))
    sound = (F.size("v") > 0) & F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists("v", lambda c: c != 0)
    marked = rows.withColumn("sound", F.coalesce(sound & F.col("label").isNotNull(), F.lit(False)))
    digest = F.sha2(F.array_join(F.col("v").cast("array<string>"), ","), 256).alias("digest")
    # vectors are merged as they are, not by a hash
    merged = marked.where("sound").groupBy("label", "v").agg(F.min("id").alias("rep"), F.count("*").alias("copies"))
    known = materialize(merged.select("label", F.size("v").alias("width"), "v", "rep", "copies", digest, F.monotonically_increasing_id().alias("no")), "vectors")
    least = F.least(F.lit(tile), F.greatest(F.lit(1), F.floor(F.lit(TILE_BYTES) / F.col("width"))))
    tiles = known.groupBy("label", "width").agg(F.count("*").alias("n")).select("label", "width", F.ceil(F.col("n") / least).cast("long").alias("tiles"))
    dealt = known.join(tiles, ["label", "width"]).withColumn("t", F.pmod(F.xxhash64("no"), F.col("tiles")))
    packed = materialize(dealt.select("label", "width", "tiles", "t", "no", "rep", "copies", "v").groupBy("label", "width", "t").applyInArrow(_packed, STEPS), "vector-steps")
    # tile t takes part in the pairs (t, u) and (u, t) of all tiles u of its label
    paired = packed.withColumn("u", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1))).withColumn("first", F.least("t", "u")).withColumn("second", F.greatest("t", "u")).drop("u", "tiles")
    pair = ["label", "width", "first", "second"]
    found = materialize(paired.groupBy(*pair).applyInArrow(_compared(threshold), FOUND), "vector-found")
    full = found.where("open").join(known.select("no", "v"), "no")
    settled = materialize(full.groupBy(*pair).applyInArrow(_settled(threshold), "no long, rep long, links long, root long"), "vector-settled")
    linked = found.where("links > 0").select("no", "rep", "links", "root").unionByName(settled)
    counts = linked.groupBy("no").agg(F.sum("links").alias("links"))
    parts = components(linked.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    classes = known.select("no", "label", "digest", "rep", "copies").join(counts, "no", "left").join(parts.withColumnRenamed("node", "rep"), "rep", "left")
    classes = classes.select("label", "digest", "copies", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    total = known.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0]
    answered = looked_up(marked.where("sound").select("id", "label", digest), classes, ["label", "digest"], "copies", total).select("id", "n_links", "component_id")
    alone = marked.where("NOT sound").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = answered.unionByName(alone)
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))
