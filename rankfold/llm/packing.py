"""Best-fit packing of token sequences with a swap-based local search.

Texts are tokenised word by word, cut into pieces of at most ``capacity`` tokens, and packed.  Only the lengths of the
pieces travel.  Pieces are numbered as they are written and dealt by that number to groups of about ``GROUP`` pieces,
however many there are in all and whatever their ids; each group is packed on its own: best fit in order of falling
length, then a local search that moves a piece, exchanges one for one, or two for one, between underfull bins.  Each step
makes the sum of squared fills larger, so the search ends; bins that become empty are saved.  A group stops at a lower
bound of the bins that it needs, and the emptiest bins of all groups are packed together again.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import pieces
from .shared import materialize

GROUP = 4096
SLICE = 1_000_000
#: Words that a task remembers; beyond that it starts afresh.
REMEMBERED = 400_000


class _Words:
    """Ids of the words that a task has met."""

    def __init__(self, path: str) -> None:
        self.path = path
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.ids, self.begin = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def of(self, words: list[str]) -> np.ndarray:
        if len(self.known) > REMEMBERED:
            self.clear()
        known = self.known
        fresh = [w for w in words if w not in known]
        if fresh:
            ids, lengths = pieces.encode_words(fresh, self.path)
            for w in fresh:
                known[w] = len(known)
            self.ids = np.concatenate([self.ids, ids])
            self.begin = np.concatenate([self.begin, self.begin[-1] + np.cumsum(lengths)])
        return np.fromiter((known[w] for w in words), np.int64, len(words))


def _tokenised(texts: list[str], words: _Words) -> tuple[np.ndarray, np.ndarray]:
    """(ids, ends): the ids of all texts, one after another, and where each text ends; added tokens have ids of their own."""
    parts, after, last = pieces.split_added(texts, words.path)
    joined, points, starts, ends, owner = pieces.spans(parts)
    found, place = pieces.distinct(joined, points, starts, ends)
    at = words.of(found)[place] if len(place) else np.zeros(0, np.int64)
    length = words.begin[at + 1] - words.begin[at]
    per_part = np.bincount(owner, weights=length, minlength=len(parts)).astype(np.int64)
    ids, ends, marked = words.ids[pieces.ragged(words.begin[at], length)], np.cumsum(per_part), after >= 0
    if marked.any():
        ids = np.insert(ids, ends[marked], after[marked].astype(ids.dtype))
        ends = ends + np.cumsum(marked)
    return ids, ends[last]


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, no.  ``end_id`` closes each text; a shorter piece comes first."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, no = _Words(tokenizer), TaskContext.get().partitionId() << 40
        for batch in batches:
            doc_ids, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            out: list[list] = [[], [], [], [], []]
            for a, b in pieces.sliced([len(t) for t in texts], SLICE):
                ids, ends = _tokenised(texts[a:b], words)
                ids, begin = ids.astype("<u4"), 0
                for doc_id, end in zip(doc_ids[a:b], ends.tolist()):
                    own = np.append(ids[begin:end], np.uint32(end_id)).astype("<u4")
                    begin, n = end, len(own)
                    cuts = [0, *range(n % capacity or min(n, capacity), n + 1, capacity)]
                    for k, (x, y) in enumerate(zip(cuts, cuts[1:])):
                        for column, value in zip(out, (doc_id, k, x, y - x, zlib.crc32(own[x:y].tobytes()))):
                            column.append(value)
            out.append(range(no, no + len(out[0])))
            no += len(out[0])
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int32(), *[pa.int64()] * 4))], names=["id", "piece", "start", "length", "ids_crc32", "no"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(cut, "id long, piece int, start long, length long, ids_crc32 long, no long")


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of item numbers: each item, longest first, goes to the fullest bin that has room."""
    bins: list[list[int]] = []
    room: list[tuple[int, int]] = []  # (free, bin), sorted
    for i in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
        at = bisect_left(room, (lengths[i], -1))
        if at < len(room):
            free, b = room.pop(at)
        else:
            free, b = capacity, len(bins)
            bins.append([])
        bins[b].append(i)
        if free > lengths[i]:
            insort(room, (free - lengths[i], b))
    return bins


def least_bins(lengths: np.ndarray, capacity: int) -> int:
    """A lower bound of the bins needed: items over half a bin share none, and what they leave free takes only what is short enough."""
    lengths = np.sort(np.asarray(lengths, np.int64))
    if not len(lengths):
        return 0
    sums = np.concatenate([[0], np.cumsum(lengths)])
    half = np.searchsorted(lengths, capacity // 2, "right")  # from here on longer than half a bin
    short = np.unique(np.append(lengths[:half], 0))  # items shorter than this are left out
    full = np.searchsorted(lengths, capacity - short, "right")  # from here on nothing counted fits beside
    full = np.maximum(full, half)
    room = (full - half) * capacity - (sums[full] - sums[half])
    rest = sums[half] - sums[np.searchsorted(lengths, short, "left")]
    return int((len(lengths) - half + np.maximum(0, -(-(rest - room) // capacity))).max())


def improve(bins: list[list[int]], lengths: list[int], capacity: int) -> list[list[int]]:
    """Moves and exchanges between underfull bins, each raising the sum of squared fills, until none helps or ``least_bins`` is met.

    The emptiest bin first gives one item or two to a bin at least as full, for one of that bin's items or for none; of
    all that fit, the exchange that moves most.  Items of one length are alike, so lengths are tried, not items.
    """
    size = np.asarray(lengths, np.int64)
    where = np.empty(len(size), np.int64)
    for k, b in enumerate(bins):
        where[b] = k
    fill = np.bincount(where, weights=size, minlength=len(bins)).astype(np.int64)
    bound, left, moved = least_bins(size, capacity), len(bins), True

    def step(a: int) -> bool:
        able = (fill < capacity) & (fill >= fill[a])
        able[a] = False
        into, items = np.flatnonzero(able), np.flatnonzero(able[where])
        if not len(into):
            return False
        take = np.concatenate([np.zeros(len(into), np.int64), size[items]])  # nothing, or an item
        taken = np.concatenate([np.full(len(into), -1), items])
        to = np.concatenate([into, where[items]])
        order = np.argsort(take, kind="stable")
        take, taken, to = take[order], taken[order], to[order]
        most = take + capacity - fill[to]
        twins: dict[int, list[int]] = {}  # two items of each length at most: pairs of lengths, not of items
        for i in np.flatnonzero(where == a).tolist():
            if len(own := twins.setdefault(lengths[i], [])) < 2:
                own.append(i)
        ours = [i for own in twins.values() for i in own]
        gives = [(own[0],) for own in twins.values()] + [(i, j) for x, i in enumerate(ours) for j in ours[x + 1 :]]
        given = np.array([sum(lengths[i] for i in g) for g in gives])
        best = (0, 0, 0)
        for x in range(0, len(given), 256):
            n = given[x : x + 256, None]
            fits = (take < n) & (most >= n)
            first = fits.argmax(axis=1)  # the least that is taken back
            gain = np.where(fits.any(axis=1), n[:, 0] - take[first], 0)
            k = int(gain.argmax())
            best = max(best, (int(gain[k]), x + k, int(first[k])))
        gain, k, f = best
        if not gain:
            return False
        where[list(gives[k])] = to[f]
        if taken[f] >= 0:
            where[taken[f]] = a
        fill[a] -= gain
        fill[to[f]] += gain
        return True

    while moved and left > bound:
        moved = False
        for a in np.argsort(fill, kind="stable").tolist():
            while 0 < fill[a] < capacity and left > bound and step(a):
                moved = True
                left -= not fill[a]
    out: list[list[int]] = [[] for _ in bins]
    for i, k in enumerate(where.tolist()):
        out[k].append(i)
    return [b for b in out if b]


def _group(capacity: int, level: int, last: bool):
    """Packs one group; ``again`` marks its emptiest bin, unless this group is the last or has none underfull."""

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "id", "piece"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
        lengths = rows["length"].tolist()
        bins = improve(best_fit(lengths, capacity), lengths, capacity)
        fills = [sum(lengths[i] for i in b) for b in bins]
        open_ = -1 if last or min(fills) == capacity else fills.index(min(fills))
        seq, offset = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        for k, b in enumerate(bins):
            seq[b] = k
            offset[b] = np.cumsum([0, *(lengths[i] for i in b[:-1])])
        own = (level << 56) + rows["g"].to_numpy(np.int64) * (1 << 24) + seq
        return rows.assign(sequence_id=own, offset=offset, again=seq == open_).drop(columns="g")

    return one


def pack(pieces_: DataFrame, capacity: int = 2048, group: int = GROUP) -> DataFrame:
    """Adds sequence_id and offset to rows with ``id, piece, length, no`` (each length at most ``capacity``, ``no`` of each row its own).

    The emptiest bin of every group is packed anew with those of other groups, until one group is left.
    """
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces_.schema.fields)
    done: list[DataFrame] = []
    level, rest, before = 0, pieces_, None
    while True:
        n = rest.count()
        groups = max(1, -(-n // group))
        last = groups == 1 or before is not None and 2 * n > before  # bins of more pieces than a group would never end
        dealt = rest.withColumn("g", F.pmod(F.xxhash64("no"), F.lit(groups)))
        packed = dealt.groupBy("g").applyInPandas(_group(capacity, level, last), f"{fields}, sequence_id long, offset long, again boolean")
        if last:
            done.append(packed)
            break
        packed = materialize(packed, "pack-bins")
        done.append(packed.where("NOT again"))
        level, rest, before = level + 1, packed.where("again").select(*pieces_.columns), n
    return reduce(DataFrame.unionByName, done).drop("again", "no")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", group: int = GROUP) -> DataFrame:
    """One row per piece: ``id_col``, piece, start, length, ids_crc32, sequence_id, offset.

    A text's ids and ``end_id`` are one sequence; only those over ``capacity`` are cut.  A null or empty text is one
    piece of length 1.  Repeated rows are packed each.  Ids must be integers or null.  The order of pieces of one
    length is by id and piece.  An empty table gives an empty result; other columns are ignored.
    """
    cut = materialize(token_pieces(docs, tokenizer, capacity, end_id, id_col, text_col), "pack-pieces")
    return pack(cut, capacity, group).withColumnRenamed("id", id_col)
