"""Document fingerprints: the improbable features of a text in a chain of Bloom filters, compared by their bits.

A feature is a window of ``WIDTH`` bytes of the UTF-8 text.  Its Shannon entropy, kept for all windows at once in whole
numbers, falls into one of ``CELLS`` cells; how many windows of all documents fall into each cell makes the ranks: the
fewer, the more improbable, the lower the rank.  In every run of ``RUN`` neighbouring windows the leftmost of the lowest
rank wins; a window that wins ``WINS`` runs is selected.  Which windows win depends on their neighbourhood only, so
texts that share a passage select the same windows inside it.

Selected windows are hashed to ``BITS`` places each and inserted into Bloom filters of 2,048 bits, a new one for every
``FILTER`` of them; a window repeated in a text counts once.  Two fingerprints are compared filter by filter: each filter of the one
with fewer features takes the greatest overlap with a filter of the other, where overlap is the share of common bits
beyond those that chance would give; filters weigh as many bits as they have set.

The statistics are one pass of counts over all windows of all documents; ``CELLS`` totals for each task are shuffled and as many
ranks are sent to the tasks.  For ``near_edited`` and ``near_next`` each document meets the next one: ids are dealt to ranges whose
bounds come from all ids, the first document of a range is also sent to the range before it, and a task reads its range
in order, holding two batches of texts at most.  The texts are shuffled once.

A text of fewer than ``SHORT`` bytes hardly has rivals to be chosen from: all its windows of ``NARROW`` bytes are features too, and
one of fewer bytes is a feature as a whole.  An empty text has no feature, its fingerprint is that of nothing: 1 to another
such, 0 to all else.  Null texts are empty.  Documents are ordered by id, null first, equal ids by
their text's hash; repeated rows are documents of their own.  A lone document is its own next one.  Other columns take no part.
Long texts are worked through in pieces of ``PIECE`` bytes that overlap, so what a task holds beside the text is bounded.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import bytes_of, fan_of

#: Bytes of a feature; neighbours that compete; runs to be won; cells of the entropy.
WIDTH, RUN, WINS, CELLS = 24, 24, 6, 1000
#: Texts of fewer bytes also give all their windows of NARROW bytes.
SHORT, NARROW = 96, 6
#: Bits of a filter, bits set for a feature, features of a filter.
FILTER_BITS, BITS, FILTER = 2048, 5, 160
#: Bytes of texts worked on at once.
PIECE = 4_000_000
#: Places of a binary fixed point number, in which entropies are added up without loss.
POINT = 1 << 16

SCHEMA = "doc_id long, n_chars long, n_features long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _steps() -> np.ndarray:
    """How much c log2 c grows when a byte is seen for the c-th time in a window, in units of 1 / POINT."""
    c = np.arange(1, WIDTH + 1)
    whole = np.concatenate([[0], np.rint(c * np.log2(c) * POINT)]).astype(np.int64)
    return np.concatenate([[0], np.diff(whole)])


_GROWTH = _steps()
_MOST = int(_GROWTH.sum())


def entropy_cells(data: np.ndarray) -> np.ndarray:
    """The cell of each window of ``data``'s bytes: the window's entropy as a share of the greatest.

    A window's entropy is log2 WIDTH less the sum of c log2 c over its bytes, by WIDTH.  From one window to the next that sum changes by
    what the leaving byte's count gives up and the entering byte's takes, and both counts come from comparing the data
    with itself at each distance.
    """
    n = len(data) - WIDTH + 1
    if n < 1:
        return np.zeros(0, np.int64)
    ahead, back = np.ones(len(data), np.uint8), np.zeros(len(data), np.uint8)  # of its byte, in the window that it begins, ends
    for d in range(1, WIDTH):
        same = data[d:] == data[:-d]
        ahead[:-d] += same
        back[d:] += same
    counts = np.bincount(data[:WIDTH])
    first = int(sum(_GROWTH[1 : c + 1].sum() for c in counts.tolist()))
    change = _GROWTH[back[WIDTH:] + 1] - _GROWTH[ahead[: n - 1]]
    sums = np.concatenate([[first], first + np.cumsum(change)])
    return (_MOST - sums) * (CELLS - 1) // _MOST


def _joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes of all texts, where each begins, whether a window begins at a place and stays in its text)."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    begins = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    edge = np.zeros(len(data) + 1, np.int32)
    long = sizes >= WIDTH
    np.add.at(edge, begins[long], 1)
    np.add.at(edge, begins[long] + sizes[long] - WIDTH + 1, -1)
    return data, begins, np.cumsum(edge[:-1]) > 0


def pieces(texts: list[bytes], most: int) -> Iterator[tuple[list[bytes], list[int], list[int]]]:
    """(parts, text, skipped): parts of the texts of about ``most`` bytes in all, and where in its text a part begins.

    The parts of one text overlap by what may decide about a window: RUN windows to both sides.
    """
    margin = 2 * RUN + WIDTH
    held: list[bytes] = []
    owner: list[int] = []
    skipped: list[int] = []
    size = 0
    for k, text in enumerate(texts):
        for a in range(0, max(len(text), 1), most):
            lo = max(0, a - margin)
            part = text[lo : min(len(text), a + most + margin)]
            if held and size + len(part) > most:
                yield held, owner, skipped
                held, owner, skipped, size = [], [], [], 0
            held.append(part)
            owner.append(k)
            skipped.append(lo)
            size += len(part)
    if held:
        yield held, owner, skipped


def cell_counts(texts: list[bytes], most: int = PIECE) -> np.ndarray:
    """How many windows of the texts fall into each cell."""
    counts = np.zeros(CELLS, np.int64)
    margin = 2 * RUN + WIDTH
    for parts, _, skipped in pieces(texts, most):
        data, begins, valid = _joined(parts)
        cells = entropy_cells(data)
        use = valid[: len(cells)].copy()
        for b, lo, part in zip(begins.tolist(), skipped, parts):  # a window that the part before has counted is not counted again
            if lo:
                use[b : b + min(2 * margin - WIDTH + 1, len(part))] = False
        counts += np.bincount(cells[use], minlength=CELLS)
    return counts


def ranks_of(counts: np.ndarray) -> np.ndarray:
    """The rank of each cell, the rarest first; cells that hold windows of one byte only come last."""
    rank = np.empty(len(counts), np.int64)
    order = np.lexsort((np.arange(len(counts)), counts))
    rank[order] = np.arange(len(counts))
    rank[0] = len(counts)
    return rank


def selected(data: np.ndarray, valid: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """Places of the windows that win WINS runs of RUN neighbours at least; shorter runs at a text's ends count too."""
    cells = entropy_cells(data)
    n = len(cells)
    if not n:
        return np.zeros(0, np.int64)
    none = np.iinfo(np.int64).max
    key = np.full(n + 2 * (RUN - 1), none)
    here = np.flatnonzero(valid[:n])
    key[here + RUN - 1] = (ranks[cells[here]] << 32) | here
    best, have = key, 1
    while have < RUN:  # least key of growing runs
        step = min(have, RUN - have)
        best = np.minimum(best[:-step], best[step:])
        have += step
    won = best[best != none] & ((1 << 32) - 1)
    return np.flatnonzero(np.bincount(won, minlength=n) >= WINS)


def _mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def hashed(windows: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """64 bits of each window; one that is shorter is filled up with zeros."""
    words = np.ascontiguousarray(windows).view("<u8")
    h = _mixed(sizes.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    with np.errstate(over="ignore"):
        for k in range(words.shape[1]):
            h = _mixed(h * np.uint64(0x9FB21C651E98DF25) + words[:, k])
    return h


def _narrow(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """All windows of NARROW bytes of a short text, filled up with zeros, and their sizes."""
    size = min(NARROW, len(text))
    windows = np.zeros((len(text) - size + 1, WIDTH), np.uint8)
    windows[:, :size] = np.lib.stride_tricks.sliding_window_view(np.frombuffer(text, np.uint8), size)
    return windows, np.full(len(windows), size)


def features(texts: list[bytes], ranks: np.ndarray, most: int = PIECE) -> list[np.ndarray]:
    """The hashes of each text's selected windows, in their order, each once."""
    out: list[list[np.ndarray]] = [[] for _ in texts]
    margin = 2 * RUN + WIDTH
    for parts, owner, skipped in pieces(texts, most):
        data, begins, valid = _joined(parts)
        at = selected(data, valid, ranks)
        part = np.searchsorted(begins, at, "right") - 1
        # a part decides about the windows that begin in its own stretch, not about those of its margins
        lo = np.asarray(skipped, np.int64)
        own = np.where(lo > 0, margin, 0)
        place = at - begins[part]
        mine = (place >= own[part]) & (place < (own + most)[part])
        at, part = at[mine], part[mine]
        windows = np.lib.stride_tricks.sliding_window_view(data, WIDTH)[at] if len(at) else np.zeros((0, WIDTH), np.uint8)
        h = hashed(windows, np.full(len(at), WIDTH))
        cuts = np.searchsorted(part, np.arange(len(parts) + 1))
        for k, o in enumerate(owner):
            out[o].append(h[cuts[k] : cuts[k + 1]])
    done = []
    for text, each in zip(texts, out):
        if 0 < len(text) < SHORT:
            each = [*each, hashed(*_narrow(text))]
        h = np.concatenate(each) if each else np.zeros(0, np.uint64)
        _, first = np.unique(h, return_index=True)
        done.append(h[np.sort(first)])
    return done


def digest(h: np.ndarray) -> np.ndarray:
    """The chain of filters of a text's features: a row of bytes each."""
    filters = np.zeros((-(-len(h) // FILTER), FILTER_BITS // 8), np.uint8)
    row = np.arange(len(h)) // FILTER
    for k in range(BITS):
        bit = (h >> np.uint64(11 * k)).astype(np.int64) & (FILTER_BITS - 1)
        np.bitwise_or.at(filters, (row, bit >> 3), (1 << (bit & 7)).astype(np.uint8))
    return filters


def written(filters: np.ndarray, n: int) -> str:
    return f"{n}:{base64.b64encode(filters.tobytes()).decode()}"


def read(fingerprint: str) -> tuple[int, np.ndarray]:
    n, _, body = fingerprint.partition(":")
    return int(n), np.frombuffer(base64.b64decode(body), np.uint8).reshape(-1, FILTER_BITS // 8)


def likeness(a: str, b: str) -> float:
    """0 to 1: how much of the smaller of two fingerprints stands in the other, beyond chance."""
    if a == b:
        return 1.0
    (n, x), (m, y) = sorted((read(a), read(b)), key=lambda f: (f[0], f[1].tobytes()))
    if not n:
        return 0.0
    set_x, set_y = (np.bitwise_count(f).sum(1).astype(np.float64) for f in (x, y))
    total = 0.0
    for bits, own in zip(x, set_x):
        common = np.bitwise_count(bits & y).sum(1)
        chance = own * set_y / FILTER_BITS
        most = np.minimum(own, set_y)
        total += own * max(0.0, float(((common - chance) / np.maximum(most - chance, 1)).max()))
    return min(1.0, total / float(set_x.sum()))


# --- over a table


def corpus_ranks(docs: DataFrame) -> np.ndarray:
    """The rank of each cell of entropy, from all windows of all texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(CELLS, np.int64)
        for batch in batches:
            counts += cell_counts([(t.as_py() or "").encode() for t in batch.column(0)])
        cell = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), pa.array(counts[cell], pa.int64())], names=["cell", "n"])

    totals = np.zeros(CELLS, np.int64)
    for r in docs.select("text").mapInArrow(count, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        totals[r["cell"]] = r["n"]
    return ranks_of(totals)


def fingerprints_of(texts: list[str], ranks: np.ndarray) -> list[tuple[str, int]]:
    return [(written(digest(h), len(h)), len(h)) for h in features([t.encode() for t in texts], ranks)]


def edited(text: str, following: str) -> str:
    """``text`` with its last quarter replaced by the first as many characters of the next text."""
    cut = len(text) // 4
    return text[: len(text) - cut] + following[:cut]


def _described(rows: list[tuple], following: list[tuple], ranks: np.ndarray) -> pa.RecordBatch:
    """A row for each of ``rows`` (doc_id, text, fingerprint, n); ``following`` are the documents after them."""
    changed = [edited(r[1], f[1]) for r, f in zip(rows, following)]
    prints = fingerprints_of(changed, ranks)
    columns = [
        [r[0] for r in rows],
        [len(r[1]) for r in rows],
        [r[3] for r in rows],
        [hashlib.sha256(t.encode()).hexdigest() for t in changed],
        [r[2] for r in rows],
        [p for p, _ in prints],
        [likeness(r[2], p) for r, (p, _) in zip(rows, prints)],
        [likeness(r[2], f[2]) for r, f in zip(rows, following)],
    ]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[f.split()[0] for f in SCHEMA.split(", ")])


def ranges(docs: DataFrame, wanted: int) -> DataFrame:
    """``docs`` with ``_range``, and once more, with ``_extra``, the first document of each range in the range before it.

    The bounds are quantiles of all ids, kept as literals, so another evaluation deals the same way.
    """
    shares = [k / wanted for k in range(1, wanted)]
    bounds = sorted(set(docs.agg(F.percentile_approx("doc_id", shares, 100 * wanted).alias("b")).first()["b"] or [])) if shares else []
    literal, steps = F.lit(",".join(map(str, bounds))), range(len(bounds).bit_length() - 1, -1, -1)
    table = F.split(literal, ",").cast("array<bigint>")
    # how many bounds are at most the id, by halving
    up = lambda at, jump: F.when((at + jump <= len(bounds)) & (F.get(table, at + jump - 1) <= F.col("doc_id")), at + jump).otherwise(at)
    place = F.aggregate(F.array(*[F.lit(1 << s) for s in steps]), F.lit(0), up) if bounds else F.lit(0)
    dealt = docs.withColumn("_range", F.when(F.col("doc_id").isNull(), 0).otherwise(place)).withColumn("_order", F.xxhash64("text"))
    first = dealt.groupBy("_range").agg(F.min(F.struct("doc_id", "_order")).alias("f")).collect()  # a row for each range
    firsts = sorted((r["_range"], r["f"]["doc_id"], r["f"]["_order"]) for r in first)
    before = [(b[1], b[2], a[0]) for a, b in zip(firsts, [*firsts[1:], *firsts[:1]])]  # the last range ends with the first document of all
    heads = docs.sparkSession.createDataFrame(before, "_id long, _hash long, _to int")
    again = dealt.join(F.broadcast(heads), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_order") == F.col("_hash")))
    again = again.dropDuplicates(["_to"]).select(F.col("_to").alias("_range"), "doc_id", "text", "_order", F.lit(True).alias("_extra"))
    return dealt.select("_range", "doc_id", "text", "_order", F.lit(False).alias("_extra")).unionByName(again)


def fingerprints(docs: DataFrame, wanted: int | None = None) -> DataFrame:
    """One row of ``SCHEMA`` for each of ``docs`` (doc_id, text): its fingerprint, that of its text with the last quarter replaced by
    the next document's beginning, and how much both and the next document's fingerprint look like it."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    ranks = corpus_ranks(rows)
    dealt = ranges(rows, wanted or fan_of(spark, bytes_of(docs, "text"), 16_000_000))
    order = ["_range", "_extra", F.asc_nulls_first("doc_id"), "_order"]
    together = dealt.repartition(wanted or fan_of(spark, bytes_of(docs, "text"), 16_000_000), "_range").sortWithinPartitions(*order).drop("_order")

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[tuple] = []  # a document whose next one has not come yet
        for batch in batches:
            texts = batch.column(2).to_pylist()
            for a in range(0, len(texts), 500):
                some = texts[a : a + 500]
                part = [(i, t, p, n, r, x) for i, t, (p, n), r, x in zip(batch.column(1)[a : a + 500].to_pylist(), some, fingerprints_of(some, ranks), batch.column(0)[a : a + 500].to_pylist(), batch.column(3)[a : a + 500].to_pylist())]
                line = waiting + part
                pairs = [(u, v) for u, v in zip(line, line[1:]) if u[4] == v[4] and not u[5]]
                if pairs:
                    yield _described([u for u, _ in pairs], [v for _, v in pairs], ranks)
                waiting = [line[-1]] if line and not line[-1][5] else []

    return together.mapInArrow(describe, SCHEMA)
