"""Ranked lexical search by Block-Max WAND over posting blocks.

**Index.**  Tasks cut their documents into shards of bounded size and write, for each term of a shard, its postings: the
places of documents in the shard and how often the term stands in each, in blocks of ``BLOCK`` postings, each block packed
by itself.  Beside the packed bytes stand each block's last place and its maximum impact: the greatest saturation of a
posting in it.  A last row for each shard holds its documents' ids and length norms.  Nothing is shuffled for
that; a term that stands in all documents is one row for each shard, so no term is hot.  Norms need two totals (documents and
terms), which one scan counts before.

**Search.**  Terms that the items ask for are picked from the index, which gives their document counts, and their rows are
brought together by shard.  A task reads shard after shard and keeps the best ``k`` documents of every item over all of
them; the k-th score so far is the item's threshold.  In a shard the shallow pointers of the item's terms move over block
ends only: between two ends no pointer moves, and the sum of the current blocks' maximum impacts bounds every document there.
Stretches whose bound is below the threshold are passed over without unpacking a block; the others are evaluated from
unpacked blocks, the stretch with the highest bounds first to raise the threshold, then the rest in the order of documents.
Items are searched in blocks of bounded size, so what is sent to the tasks is bounded.

Answers are exact: scores are 64-bit integers, a document is left out only if its bound is below a score already held by k
others.  Equal scores are listed by ascending doc_id, null last, then by arrival.

Null and empty texts have no terms and match nothing; an item without terms, or whose terms stand nowhere, gets no rows.
Repeated documents are ranked each for itself; items of one id are joined to one (equal rows once).  Other columns take
no part.  Empty tables give an empty answer.  Long texts are cut into windows of ``WINDOW`` characters between terms, whose
counts are added up, so that what a task holds follows the window and a shard's postings.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pieces import distinct
from .shared import materialize, shuffle_width

#: What parts terms (A-Z are lower-cased; all beyond ASCII counts as letters) and the scale of a saturation.
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
SCALE = 1_000_000_000
#: Postings in a block.
BLOCK = 128
#: A shard ends after so many characters or documents; a text is read in windows of so many characters.
SHARD_CHARS, SHARD_DOCS, WINDOW = 16_000_000, 65_536, 2_000_000
#: Items searched at once: at most so many characters of them are sent to the tasks.
ITEM_CHARS = 8_000_000
#: Stretches evaluated at once, the first time and at most.
STRETCHES, MOST_STRETCHES = 16, 4096

_GAP = re.compile(GAP)
_IS_TERM = np.zeros(128, bool)
for _a, _b in (("0", "9"), ("A", "Z"), ("a", "z")):
    _IS_TERM[ord(_a) : ord(_b) + 1] = True

INDEX = "shard string, term string, n long, lasts array<int>, tops array<int>, blocks array<binary>, ids array<long>, norms array<long>"


# --- terms


def term_spans(texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(terms, term, owner): the distinct terms of ``texts`` and, for each occurrence, its term and its text."""
    joined = "\0".join(texts).encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")  # bytes.lower knows A-Z only
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    inside = np.empty(len(points) + 2, bool)
    inside[0] = inside[-1] = False
    inside[1:-1] = _IS_TERM[np.minimum(points, 127)] | (points > 127)
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    borders = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
    terms, term = distinct(joined, points, starts, ends)
    return terms, term, np.searchsorted(borders, starts, "right")


def windows(text: str, size: int = WINDOW) -> Iterator[str]:
    """``text`` in pieces of about ``size`` characters that cut no term."""
    begin = 0
    while len(text) - begin > size:
        gap = _GAP.search(text, begin + size)
        end = gap.end() if gap else len(text)
        yield text[begin:end]
        begin = end
    yield text[begin:]


def postings_of(texts: list[str], size: int = WINDOW) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(terms, term, place, tf, length): which term stands how often in which text, by term and place, and each text's terms with repeats."""
    known: dict[str, int] = {}
    parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    lengths = np.zeros(len(texts), np.int64)
    held: list[str] = []
    owners: list[int] = []

    def count() -> None:
        terms, term, owner = term_spans(held)
        if len(terms):
            at = np.asarray(owners, np.int64)[owner]
            np.add.at(lengths, at, 1)
            number = np.fromiter((known.setdefault(t, len(known)) for t in terms), np.int64, len(terms))[term]
            pair, tf = np.unique(number * len(texts) + at, return_counts=True)
            parts.append((pair // len(texts), pair % len(texts), tf))
        held.clear()
        owners.clear()

    chars = 0
    for k, text in enumerate(texts):
        for piece in windows(text, size):
            if held and chars + len(piece) > size:
                count()
                chars = 0
            held.append(piece)
            owners.append(k)
            chars += len(piece)
    if held:
        count()
    if not parts:
        none = np.zeros(0, np.int64)
        return [], none, none, none, lengths
    pair = np.concatenate([t * len(texts) + p for t, p, _ in parts])
    pair, where = np.unique(pair, return_inverse=True)
    tf = np.bincount(where, np.concatenate([c for _, _, c in parts]).astype(np.float64)).astype(np.int64)
    return list(known), pair // len(texts), pair % len(texts), tf, lengths


# --- blocks


def pack_blocks(steps: np.ndarray, tf: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of the blocks that begin at ``starts``: two bytes with the widths, then steps between places and counts.

    Both take the fewest whole bytes that hold the block's greatest; a block's first step is its first place.
    """
    sizes = np.diff(np.append(starts, len(steps)))
    width = lambda x: np.searchsorted(np.array([1 << 8, 1 << 16, 1 << 24]), np.maximum.reduceat(x, starts), "right") + 1
    a, b = width(steps), width(tf)
    offsets = np.concatenate([[0], np.cumsum(2 + sizes * (a + b))])
    out = np.zeros(offsets[-1], np.uint8)
    out[offsets[:-1]], out[offsets[:-1] + 1] = a, b
    nth = np.arange(len(steps)) - np.repeat(starts, sizes)
    for x, wide, at in ((steps, a, offsets[:-1] + 2), (tf, b, offsets[:-1] + 2 + sizes * a)):
        wide, at = np.repeat(wide, sizes), np.repeat(at, sizes)
        for byte in range(int(wide.max())):
            has = wide > byte
            out[at[has] + nth[has] * wide[has] + byte] = x[has] >> (8 * byte) & 255
    return out, offsets


def _whole(raw: np.ndarray, width: int) -> np.ndarray:
    each = raw.reshape(-1, width).astype(np.int64)
    return each @ (1 << (8 * np.arange(width)))


def unpack_block(block: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(places, tf) of a block."""
    raw = np.frombuffer(block, np.uint8)
    a, b = int(raw[0]), int(raw[1])
    n = (len(raw) - 2) // (a + b)
    return np.cumsum(_whole(raw[2 : 2 + a * n], a)), _whole(raw[2 + a * n :], b)


def saturation(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return SCALE * tf // (1000 * tf + 12 * m)


def norm(length: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """A document's m: 100 for one of average length, 75 and more for any."""
    exact = [75 + 25 * n * n_docs // max(n_terms, 1) for n in length.tolist()]  # Python's integers: the product may pass 64 bits
    return np.array(exact, np.int64)


def shard_batch(shard: str, ids: list, texts: list[str], n_docs: int, n_terms: int, block: int = BLOCK) -> pa.RecordBatch:
    """The rows of one shard; that of the term null holds the documents."""
    terms, term, place, tf, lengths = postings_of(texts)
    m = norm(lengths, n_docs, n_terms)
    firsts = np.flatnonzero(np.diff(term, prepend=-1))
    df = np.diff(np.append(firsts, len(term)))
    nth = np.arange(len(term)) - np.repeat(firsts, df)
    heads = np.flatnonzero(nth % block == 0)  # a block begins here
    many = -(-df // block)
    if len(heads):
        steps = np.diff(place, prepend=0)
        steps[heads] = place[heads]
        packed, offsets = pack_blocks(steps, tf, heads)
        lasts, tops = place[np.append(heads[1:], len(term)) - 1], np.maximum.reduceat(saturation(tf, m[place]), heads)
    else:
        packed, offsets, lasts, tops = np.zeros(0, np.uint8), np.zeros(1, np.int64), heads, heads
    each = pa.array(np.concatenate([[0], np.cumsum(many), [many.sum()]]), pa.int32())
    lists = lambda values: pa.ListArray.from_arrays(each, values)
    blobs = pa.BinaryArray.from_buffers(pa.binary(), len(heads), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(packed)])
    only = lambda values: pa.array([None] * len(df) + [values], pa.list_(pa.int64()))
    columns = [
        pa.array([shard] * (len(df) + 1)),
        pa.array([terms[t] for t in term[firsts].tolist()] + [None], pa.string()),
        pa.array(np.append(df, len(ids)), pa.int64()),
        lists(pa.array(lasts, pa.int32())),
        lists(pa.array(tops, pa.int32())),
        lists(blobs),
        only(ids),
        only(m.tolist()),
    ]
    return pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in INDEX.split(", ")])


def totals(docs: DataFrame) -> tuple[int, int]:
    """(documents with a term, all their terms with repeats)."""
    text = F.coalesce("text", F.lit(""))
    # what stands between gaps, less the nothing before a gap that begins the text and after one that ends it
    bare = lambda place: F.substring(text, place, 1).rlike(f"^{GAP}$").cast("int")
    n = F.when(text == "", 0).otherwise(F.size(F.split(text, f"{GAP}+")) - bare(1) - bare(-1)).cast("long")
    got = docs.select(n.alias("n")).agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    return int(got[0]), int(got[1])


def build_index(docs: DataFrame, n_docs: int, n_terms: int, block: int = BLOCK) -> DataFrame:
    """The posting blocks of ``docs`` (doc_id, text) as rows of ``INDEX``; documents without terms take no part."""

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, done = TaskContext.get().partitionId(), 0
        ids, texts, chars = [], [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            whole = shard_batch(f"{task}.{done}", ids, texts, n_docs, n_terms, block)
            for a in range(0, len(whole), 20_000):
                yield whole.slice(a, 20_000)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py()
                if not text:
                    continue
                ids.append(doc_id)
                texts.append(text)
                chars += len(text)
                if chars >= SHARD_CHARS or len(ids) == SHARD_DOCS:
                    yield from flush()
                    done += 1
                    ids, texts, chars = [], [], 0
        if ids:
            yield from flush()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(shards, INDEX)


# --- search


class Shard:
    """The asked terms of one shard; blocks stay unpacked once unpacked, a shard being bounded."""

    def __init__(self, ids: np.ndarray, norms: np.ndarray, rows: dict[str, tuple[np.ndarray, np.ndarray, list[bytes]]]):
        self.ids, self.norms, self.rows = ids, norms, rows
        self.open: dict[tuple[str, int], tuple[np.ndarray, np.ndarray]] = {}
        self.unpacked = self.passed = 0

    def block(self, term: str, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and saturations of a block."""
        got = self.open.get((term, k))
        if got is None:
            places, tf = unpack_block(self.rows[term][2][k])
            got = self.open[(term, k)] = (places, saturation(tf, self.norms[places]))
            self.unpacked += 1
        return got

    def search(self, weights: dict[str, int], best: tuple[np.ndarray, np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray]:
        """``best`` (scores, ids; highest first) of an item after this shard; ``weights`` are its terms' w times their repeats."""
        terms = [t for t in weights if t in self.rows]
        if not terms:
            return best
        ends = np.unique(np.concatenate([self.rows[t][0] for t in terms]))  # a stretch ends where any shallow pointer moves
        starts = np.concatenate([[0], ends[:-1] + 1])
        bound = np.zeros(len(ends), np.int64)
        at = []
        for t in terms:
            lasts, tops, _ = self.rows[t]
            current = np.searchsorted(lasts, ends)  # the block that the term's pointer is in
            at.append(current)
            on = current < len(lasts)
            bound[on] += weights[t] * tops[current[on]].astype(np.int64)
        left = np.ones(len(ends), bool)
        take = STRETCHES
        first = True
        while True:
            threshold = best[0][k - 1] if len(best[0]) >= k else 1  # a score counts if it is above 0
            left &= bound >= threshold
            some = np.flatnonzero(left)
            if not len(some):
                break
            if first:
                some = some[np.argsort(-bound[some], kind="stable")[:take]]
                first = False
            else:
                some = some[:take]
            left[some] = False
            best = self._evaluate(terms, weights, at, starts[some], ends[some], some, best, k)
            take = min(take * 2, MOST_STRETCHES)
        self.passed += int((bound < (best[0][k - 1] if len(best[0]) >= k else 1)).sum())
        return best

    def _evaluate(self, terms, weights, at, starts, ends, some, best, k):
        order = np.argsort(starts)
        starts, ends = starts[order], ends[order]
        score = np.zeros(len(self.ids), np.int64)
        for t, current in zip(terms, at):
            here = np.unique(current[some])
            for b in here[here < len(self.rows[t][0])].tolist():
                places, sat = self.block(t, b)
                score[places] += weights[t] * sat
        # only places inside the stretches are whole: all blocks over them were added
        mark = np.zeros(len(self.ids) + 1, np.int32)
        mark[starts] += 1
        np.add.at(mark, ends + 1, -1)
        found = np.flatnonzero((np.cumsum(mark[:-1]) > 0) & (score > 0))
        if len(best[0]) >= k:
            found = found[score[found] >= best[0][k - 1]]
        if not len(found):
            return best
        scores, ids = np.concatenate([best[0], score[found]]), np.concatenate([best[1], self.ids[found]])
        kept = np.lexsort((ids, -scores))[:k]
        return scores[kept], ids[kept]


#: Null ids take the last place among equals.
_NULL_ID = np.iinfo(np.int64).max


def _block_of_items(items: DataFrame) -> list[tuple[DataFrame, int]]:
    """Items by block: each with a part of them that is small enough to be sent to the tasks."""
    size = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    n = max(1, -(-size // ITEM_CHARS))
    return [(items.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == b) if n > 1 else items, b) for b in range(n)]


def search_block(index: DataFrame, wanted: list[tuple[object, str]], n_docs: int, k: int, width: int) -> DataFrame | None:
    """(item, doc_id, score): the best ``k`` of each task for each item of ``wanted`` (id, text), by the item's place there."""
    spark = index.sparkSession
    texts = [t or "" for _, t in wanted]
    terms, term, owner = term_spans(texts)
    if not terms:
        return None
    pair, repeats = np.unique(owner.astype(np.int64) * len(terms) + term, return_counts=True)
    asked = spark.createDataFrame(pd.DataFrame({"term": terms}), "term string")
    rows = index.join(F.broadcast(asked), "term", "left_semi")  # bounded by ITEM_CHARS
    df = {r["term"]: r["df"] for r in rows.groupBy("term").agg(F.sum("n").alias("df")).collect()}
    weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) for t in terms if t in df}
    items: list[dict[str, int]] = [{} for _ in wanted]
    for p, c in zip(pair.tolist(), repeats.tolist()):
        t = terms[p % len(terms)]
        if t in weight:
            items[p // len(terms)][t] = weight[t] * c
    heads = index.where(F.col("term").isNull())
    together = rows.select(*index.columns).unionByName(heads).repartition(width, "shard").sortWithinPartitions("shard", F.col("term").asc_nulls_first())

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.int64)
        found = [(none, none)] * len(items)
        ids = norms = none
        shard, held = None, {}

        def close() -> None:
            if held:
                one = Shard(ids, norms, held)
                for i, weights in enumerate(items):
                    found[i] = one.search(weights, found[i], k)

        for batch in batches:
            for row in zip(*(batch.column(c) for c in ("shard", "term", "lasts", "tops", "blocks", "ids", "norms"))):
                name, term = row[0].as_py(), row[1].as_py()
                if name != shard:
                    close()
                    shard, held = name, {}
                if term is None:
                    ids = row[5].values.fill_null(_NULL_ID).to_numpy(zero_copy_only=False)
                    norms = row[6].values.to_numpy()
                else:
                    held[term] = (row[2].values.to_numpy(), row[3].values.to_numpy(), row[4].as_py())
        close()
        place = np.repeat(np.arange(len(items)), [len(s) for s, _ in found])
        scores, docs = (np.concatenate([f[j] for f in found]) for j in (0, 1))
        yield pa.RecordBatch.from_arrays([pa.array(place, pa.int64()), pa.array(docs, mask=docs == _NULL_ID), pa.array(scores, pa.int64())], names=["item", "doc_id", "score"])

    return together.mapInArrow(best, "item long, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, k: int = 20) -> DataFrame:
    """item_id, rank, doc_id, score: the ``k`` best of ``docs`` (doc_id, text) for each of ``items`` (item_id, text)."""
    from pyspark.sql import Window

    spark = docs.sparkSession
    n_docs, n_terms = totals(docs)
    index = materialize(build_index(docs, n_docs, n_terms), "postings")
    one = items.select("item_id", "text").where(F.col("text").isNotNull()).distinct().groupBy("item_id").agg(F.array_join(F.sort_array(F.collect_list("text")), " ").alias("text"))
    kind = items.schema["item_id"].dataType.simpleString()
    width = shuffle_width(spark)
    out = spark.createDataFrame([], f"item_id {kind}, doc_id long, score long")
    for block, _ in _block_of_items(one):
        wanted = [(r["item_id"], r["text"]) for r in block.collect()]
        found = search_block(index, wanted, n_docs, k, width)
        if found is None:
            continue
        names = spark.createDataFrame([(i, item) for i, (item, _) in enumerate(wanted)], f"item long, item_id {kind}")
        out = out.unionByName(found.join(F.broadcast(names), "item").select("item_id", "doc_id", "score"))
    # a window over at most k rows of each task for an item
    place = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    return out.withColumn("rank", place).where(F.col("rank") <= k).select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
