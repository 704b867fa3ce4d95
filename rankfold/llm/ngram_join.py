"""N-gram Jaccard join over prefix trees.

Two sets with a Jaccard similarity of t have ceil(t |x|) n-grams of each in common, and, in any global order of n-grams,
m of the first |x| - ceil(t |x|) + m of each.  The order here is rarest first, by counts over all documents.

1. Equal texts are merged.
2. Every task sends the n-grams of its documents, sorted and packed by hash range, to owners, who add up in how many
   documents each stands and answer for those that stand in two or more.  An n-gram that a task meets several times is
   sent once with its count.  A document goes on only if ceil(t |x|) of its n-grams stand elsewhere too, and sends only
   such n-grams of its prefix: what comes after follows the documents that may link, not the corpus.
3. Owners name the smallest document id that has a prefix n-gram its meeting point; each task asks once for each of its
   n-grams.  Similar documents so get few and mostly equal meeting points, and two that share a prefix n-gram have one
   in common.  A document that shares fewer prefix n-grams than a link takes meets nobody, and each leaves out the points
   of its fewest n-grams while they make up less than half of that: two that link still keep a point in common.
4. Documents go to their meeting points with their texts.  One with more than ``BLOCK`` documents is dealt to blocks.
   Each block is joined exactly by a prefix tree: n-gram sets sorted by falling frequency in the block, equal prefixes
   stored and counted once; the overlaps with all later documents are carried down the tree, and a document is left
   out of a subtree once its overlap and what remains cannot reach the threshold.
5. Components of the links are found.  In a meeting point of several blocks, all documents outside its largest component
   are compared with every block, so no link between different components is missed, and components are found anew.

Nothing is expanded into all pairs: a block returns a spanning forest.  A group of copies or near copies that a third of
all rows belong to is many blocks of bounded size, and an n-gram that a third of them hold is one entry per task.
N-grams are told apart by 64-bit hashes (``shingles``); steps 2 and 3 use 48 bits of them, where equal hashes only make
documents meet that need not.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import pieces
from .blobs import batch as rows_batch
from .blobs import loose, tight
from .components import components, forest
from .shared import ascii_lower, fan_of, looked_up, materialize, shuffle_width
from .shingles import WORDS, shingle_sets

BLOCK = 512
SLICE = 1_000_000
#: A task sends its documents in chunks of about so many n-grams, and of fewer documents than 16 bits number.
CHUNK, CHUNK_DOCS = 2_000_000, 60_000
#: A table of meeting points with so few rows is broadcast; a larger one is joined by key.
BROADCAST_ROWS = 1_000_000
ASKED = "chunk string, bucket int, a binary, b binary, c binary"
LOW = np.uint64(0xFFFF)


def required(a, b, percent: int):
    """Least overlap o with 100 o >= percent (a + b - o)."""
    return -(-(percent * (a + b)) // (100 + percent))


def needed(n, percent: int):
    """N-grams that a set of n has in common with any set it links with, at least."""
    return -(-percent * n // 100)


def must_share(n, percent: int):
    """How many n-grams the prefixes of two sets that link share at least, if neither is smaller than n."""
    return np.minimum(1 + n // 8, needed(n, percent))


def prefix_length(n, percent: int):
    """Prefixes of this length share ``must_share`` of the smaller set."""
    return n - needed(n, percent) + must_share(n, percent)


def tree_join(sets: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (a, b) of links that connect all sets with a similarity of at least ``percent``: a subset of all links.

    The links found connect just what all links connect.
    """
    n, size = len(sets), np.array([len(s) for s in sets], np.int64)
    every = np.concatenate([*sets, np.zeros(0, np.uint64)])
    grams, place, held = np.unique(every, return_inverse=True, return_counts=True)
    rank = np.empty(len(grams), np.int64)
    rank[np.argsort(-held, kind="stable")] = np.arange(len(grams))
    shared = int((held > 1).sum())  # the others overlap with nothing
    cuts = np.cumsum(size)[:-1]
    paths = []
    for x in np.split(rank[place], cuts):
        x = x[x < shared]
        x.sort()
        paths.append(x)
    order = sorted(range(n), key=lambda k: paths[k].astype(">u4").tobytes())
    paths, size = [paths[k] for k in order], size[order]
    length = np.array([len(x) for x in paths], np.int64)
    flat, owner = np.concatenate(paths), np.repeat(np.arange(n), length)
    holders = owner[np.argsort(flat, kind="stable")]  # of each n-gram, one after another
    begin = np.concatenate([[0], np.cumsum(np.bincount(flat, minlength=shared))]).astype(np.int64)
    common = np.zeros(n, np.int64)  # prefix shared with the document before
    for k in range(1, n):
        m = min(length[k], length[k - 1])
        differ = np.flatnonzero(paths[k][:m] != paths[k - 1][:m])
        common[k] = differ[0] if len(differ) else m
    root = np.arange(n)

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out_a, out_b = [], []
    # a node: documents lo..hi that share their first ``depth`` n-grams; alive documents and their overlaps so far
    stack = [(0, n, 0, np.arange(n), np.zeros(n, np.int64))] if n > 1 else []
    while stack:
        lo, hi, depth, alive, overlap = stack.pop()
        down = int(common[lo + 1 : hi].min()) if hi - lo > 1 else int(length[lo])
        later = alive > lo
        alive, overlap = alive[later], overlap[later]
        if not len(alive):
            continue
        if down > depth:
            grams_here = paths[lo][depth:down]
            at = pieces.ragged(begin[grams_here], begin[grams_here + 1] - begin[grams_here])
            overlap = overlap + np.bincount(holders[at], minlength=n)[alive]
        rest = int(length[lo:hi].max()) - down
        able = overlap + np.minimum(rest, length[alive] - overlap) >= required(size[alive], int(size[lo:hi].min()), percent)
        alive, overlap = alive[able], overlap[able]
        if not len(alive):
            continue
        if hi - lo == 1:
            for k in alive[overlap >= required(size[alive], int(size[lo]), percent)].tolist():
                a, b = find(lo), find(k)
                if a != b:
                    root[max(a, b)] = min(a, b)
                    out_a.append(lo)
                    out_b.append(k)
            continue
        splits = [lo, *(lo + 1 + np.flatnonzero(common[lo + 1 : hi] == down)).tolist(), hi]
        for a, b in zip(splits, splits[1:]):
            stack.append((a, b, down, alive, overlap))
    order = np.array(order, np.int64)
    return order[np.array(out_a, np.int64)], order[np.array(out_b, np.int64)]


def _texts(batch: pa.RecordBatch, k: int) -> list[bytes]:
    return batch.column(k).cast(pa.large_binary()).to_pylist()


def _by_range(keys: np.ndarray, fan: int) -> Iterator[tuple[int, slice]]:
    """(bucket, slice) of sorted 48-bit keys, equal ranges of which make ``fan`` buckets."""
    edges = np.array([(k << 48) // fan for k in range(fan)] + [1 << 48], np.uint64)
    cuts = np.searchsorted(keys, edges)
    for k in np.flatnonzero(np.diff(cuts)).tolist():
        yield k, slice(cuts[k], cuts[k + 1])


def _asking(words: int, fan: int, chunk: int) -> Callable:
    """Map: the n-grams of each chunk of documents by hash range, and a row of what the chunk itself keeps.

    Keys that one document holds go as key << 16 | number of the document (a), keys that several hold once (b) with their
    count (c).  The kept row has ids (a), sizes (b) and the numbers of the documents behind the keys of several, key by
    key (c); its bucket is negative.
    """

    def asking(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number = TaskContext.get().partitionId(), 0
        ids: list[np.ndarray] = []
        sizes: list[np.ndarray] = []
        held: list[np.ndarray] = []

        def sent() -> Iterator[pa.RecordBatch]:
            nonlocal number
            if not ids:
                return
            size = np.concatenate(sizes)
            both = np.concatenate(held) & ~LOW | np.repeat(np.arange(len(size)), size).astype(np.uint64)
            both.sort()
            keys = both >> np.uint64(16)
            first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
            length = np.diff(np.append(first, len(keys)))
            lone = first[length == 1]
            multi, count = first[length > 1], length[length > 1].astype(np.int32)
            name = f"{task}-{number}"
            behind = (both[pieces.ragged(multi, count.astype(np.int64))] & LOW).astype(np.uint16)
            out = [(name, -1 - number % fan, tight(np.concatenate(ids)), tight(size.astype(np.int32)), tight(behind))]
            number += 1
            lone, multi = both[lone], keys[multi]
            ones, many = dict(_by_range(lone >> np.uint64(16), fan)), dict(_by_range(multi, fan))
            for k in sorted(ones.keys() | many.keys()):
                x, y = ones.get(k, slice(0, 0)), many.get(k, slice(0, 0))
                out.append((name, k, tight(lone[x]), tight(multi[y]), tight(count[y])))
            for part in (ids, sizes, held):
                part.clear()
            yield rows_batch(out, ASKED)

        waiting = docs = 0
        for batch in batches:
            own, texts = batch.column(0).to_numpy(), _texts(batch, 1)
            for a, b in pieces.sliced([len(t) for t in texts], SLICE):
                offsets, grams = shingle_sets(texts[a:b], words)
                if docs and (waiting + len(grams) > chunk or docs + b - a > CHUNK_DOCS):
                    yield from sent()
                    waiting = docs = 0
                ids.append(own[a:b])
                sizes.append(np.diff(offsets))
                held.append(grams)
                waiting, docs = waiting + len(grams), docs + b - a
        yield from sent()

    return asking


def _each_bucket(solve: Callable) -> Callable:
    """Owner: rows come sorted by bucket, and only those of one bucket are held; kept rows (negative) pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[1] < 0:
                    yield rows_batch([row], ASKED)
                    continue
                if row[1] != at and held:
                    yield rows_batch(solve(held), ASKED)
                    held = []
                at = row[1]
                held.append(row)
        if held:
            yield rows_batch(solve(held), ASKED)

    return run


def _grouped(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, firsts): equal keys stand together in that order and begin at the firsts."""
    order = np.argsort(keys)
    keys = keys[order]
    return order, np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))


def _counted(held: list[tuple]) -> list[tuple]:
    """Answers of a bucket: of the keys that stand in several documents, those of one document of the chunk (a) and their totals (b); the others with their counts and totals (c)."""
    asked = [(loose(a, np.uint64), loose(b, np.uint64), loose(c, np.int32)) for _, _, a, b, c in held]
    keys = np.concatenate([x for one, many, _ in asked for x in (one >> np.uint64(16), many)])
    weight = np.concatenate([x for one, _, n in asked for x in (np.ones(len(one), np.int64), n.astype(np.int64))])
    order, first = _grouped(keys)
    total = np.empty(len(keys), np.int64)
    total[order] = np.repeat(np.add.reduceat(weight[order], first), np.diff(np.append(first, len(keys))))
    out, at = [], 0
    for (chunk, bucket, *_), (one, many, n) in zip(held, asked):
        own, rest = total[at : at + len(one)], total[at + len(one) : at + len(one) + len(many)]
        at += len(one) + len(many)
        out.append((chunk, bucket, tight(one[own > 1]), tight(own[own > 1]), tight(np.concatenate([many.astype(np.int64), n, rest]))))
    return out


PREFIXES = "chunk string, ids binary, sizes binary, docs binary, counts binary, grams binary"


def _prefixes(percent: int) -> Callable:
    """Chunk: of each document that may link, the n-grams of its prefix that stand elsewhere too."""

    def prefixes(table: pa.Table) -> pa.Table:
        rows = sorted(zip(*(c.to_pylist() for c in table.columns)), key=lambda r: r[1])
        (name, _, ids, sizes, behind), *answers = rows
        size, behind = loose(sizes, np.int32).astype(np.int64), loose(behind, np.uint16).astype(np.int64)
        got = [(loose(a, np.uint64), loose(b, np.int64), loose(c, np.int64).reshape(3, -1)) for _, _, a, b, c in answers]
        one, own = (np.concatenate([*(g[k] for g in got), np.zeros(0, t)]) for k, t in ((0, np.uint64), (1, np.int64)))
        many, local, total = np.concatenate([*(g[2] for g in got), np.zeros((3, 0), np.int64)], axis=1)
        doc = np.concatenate([(one & LOW).astype(np.int64), behind])
        gram = np.concatenate([one >> np.uint64(16), np.repeat(many.astype(np.uint64), local)])
        often = np.concatenate([own, np.repeat(total, local)])
        repeated = np.bincount(doc, minlength=len(size))
        able = (size > 0) & (repeated >= needed(size, percent))
        some = able[doc]
        doc, gram, often = doc[some], gram[some], often[some]
        order = np.lexsort((gram, often, doc))
        doc, gram = doc[order], gram[order]
        alone = size - repeated  # n-grams of this document only come first in the order
        place = np.arange(len(doc)) - np.searchsorted(doc, doc)
        keep = place < (prefix_length(size, percent) - alone)[doc]
        doc, gram = doc[keep], gram[keep]
        docs, counts = np.unique(doc, return_counts=True)
        out = (name, ids, sizes, tight(docs.astype(np.int32)), tight(counts.astype(np.int32)), tight(gram))
        return pa.Table.from_batches([rows_batch([out], PREFIXES)])

    return prefixes


def _meetings(fan: int) -> Callable:
    """Map: of each chunk its different prefix n-grams by hash range (a), in how many of its documents each is (b) and the smallest id of these (c)."""

    def meetings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, ids, _, docs, counts, grams in zip(*(c.to_pylist() for c in batch.columns)):
                own = np.repeat(loose(ids, np.int64)[loose(docs, np.int32)], loose(counts, np.int32))
                keys, place, n = np.unique(loose(grams, np.uint64), return_inverse=True, return_counts=True)
                least = np.full(len(keys), np.iinfo(np.int64).max)
                np.minimum.at(least, place, own)
                yield rows_batch([(name, k, tight(keys[s]), tight(n[s].astype(np.int32)), tight(least[s])) for k, s in _by_range(keys, fan)], ASKED)

    return meetings


def _met(held: list[tuple]) -> list[tuple]:
    """Answers of a bucket: for each n-gram asked for the smallest id that has it (a), and whether several documents do (b)."""
    asked = [(loose(a, np.uint64), loose(b, np.int32).astype(np.int64), loose(c, np.int64)) for _, _, a, b, c in held]
    keys, n, least = (np.concatenate([x[k] for x in asked]) for k in range(3))
    order, first = _grouped(keys)
    length = np.diff(np.append(first, len(keys)))
    point, several = np.empty(len(keys), np.int64), np.empty(len(keys), np.uint8)
    point[order] = np.repeat(np.minimum.reduceat(least[order], first), length)
    several[order] = np.repeat(np.add.reduceat(n[order], first) > 1, length)
    cuts = np.cumsum([0, *(len(x[0]) for x in asked)]).tolist()
    return [(chunk, bucket, tight(point[a:b]), tight(several[a:b]), b"") for (chunk, bucket, *_), a, b in zip(held, cuts, cuts[1:])]


def _points(percent: int) -> Callable:
    """Chunk: the meeting points of each document (see step 3 above)."""

    def points(chunks: pa.Table, answers: pa.Table) -> pa.Table:
        out_id, out_point = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for _, ids, sizes, docs, counts, grams in zip(*(c.to_pylist() for c in chunks.columns)):
            docs, counts = loose(docs, np.int32), loose(counts, np.int32)
            _, place = np.unique(loose(grams, np.uint64), return_inverse=True)
            got = sorted(zip(*(answers.column(c).to_pylist() for c in ("bucket", "a", "b"))))
            point = np.concatenate([*(loose(a, np.int64) for _, a, _ in got), np.zeros(0, np.int64)])[place]
            several = np.concatenate([*(loose(b, np.uint8) for _, _, b in got), np.zeros(0, np.uint8)])[place] > 0
            doc, point = np.repeat(np.arange(len(docs)), counts)[several], point[several]
            order = np.lexsort((point, doc))
            doc, point = doc[order], point[order]
            first = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (point[1:] != point[:-1]))) if len(doc) else np.zeros(0, np.int64)
            shared = np.diff(np.append(first, len(doc)))
            doc, point = doc[first], point[first]
            order = np.lexsort((point, shared, doc))  # fewest n-grams first
            doc, point, shared = doc[order], point[order], shared[order]
            sums = np.concatenate([[0], np.cumsum(shared)])
            begin, end = np.searchsorted(doc, doc), np.searchsorted(doc, doc, "right")
            size = loose(sizes, np.int32).astype(np.int64)[docs]
            least = must_share(needed(size, percent), percent)[doc]  # with the smallest partner
            keep = (sums[end] - sums[begin] >= least) & (2 * (sums[1:] - sums[begin]) >= least)
            out_id.append(loose(ids, np.int64)[docs[doc[keep]]])
            out_point.append(point[keep])
        return pa.table({"id": np.concatenate(out_id), "point": np.concatenate(out_point)})

    return points


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for ids, sizes in zip(*(c.to_pylist() for c in batch.columns)):
            yield pa.RecordBatch.from_arrays([pa.array(loose(ids, np.int64)), pa.array(loose(sizes, np.int32).astype(np.int64))], names=["rep", "n_shingles"])


def _join_blocks(words: int, percent: int) -> Callable:
    """Rows (key, id, text) sorted by key: links (a, b) of each key's documents."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, sets = None, [], []

        def solved() -> pa.RecordBatch:
            own = np.array(ids, np.int64)
            order = np.argsort(own, kind="stable")
            root = forest(len(own), *(np.argsort(order)[x] for x in tree_join(sets, percent)))  # by rank of id
            a, b = own[order], own[order[root]]
            return pa.RecordBatch.from_arrays([pa.array(a[a != b]), pa.array(b[a != b])], names=["a", "b"])

        for batch in batches:
            keys, own, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist(), _texts(batch, 2)
            for a, b in pieces.sliced([len(t) for t in texts], SLICE):
                offsets, grams = shingle_sets(texts[a:b], words)
                for k in range(a, b):
                    if keys[k] != key:
                        if len(sets) > 1:
                            yield solved()
                        key, ids, sets = keys[k], [], []
                    ids.append(own[k])
                    sets.append(grams[offsets[k - a] : offsets[k - a + 1]])
        if len(sets) > 1:
            yield solved()

    return join


def _linked(routes: DataFrame, reps: DataFrame, words: int, percent: int, width: int) -> DataFrame:
    """Links within each group; routes: (key..., rep)."""
    keys = [c for c in routes.columns if c != "rep"]
    small = routes.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    met = reps.join(F.broadcast(routes) if small else routes, "rep")
    rows = met.select(F.concat_ws("/", *keys).alias("key"), "rep", "body").repartition(width, "key").sortWithinPartitions("key", "rep")
    return rows.mapInArrow(_join_blocks(words, percent), "a long, b long")


def meeting_points(texts: DataFrame, words: int, percent: int, fan: int, chunk: int = CHUNK) -> tuple[DataFrame, DataFrame]:
    """((id, point), (rep, n_shingles)) of distinct texts (rep, body); two that link have a point in common."""
    owned = lambda asked, solve: asked.repartition(fan, "bucket").sortWithinPartitions("bucket").mapInArrow(_each_bucket(solve), ASKED)
    answers = owned(texts.mapInArrow(_asking(words, fan, chunk), ASKED), _counted)
    prefixes = materialize(answers.groupBy("chunk").applyInArrow(_prefixes(percent), PREFIXES), "join-prefixes")
    met = owned(prefixes.mapInArrow(_meetings(fan), ASKED), _met)
    points = prefixes.groupBy("chunk").cogroup(met.groupBy("chunk")).applyInArrow(_points(percent), "id long, point long")
    return points, prefixes.select("ids", "sizes").mapInArrow(_sizes, "rep long, n_shingles long")


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = 75, block: int = BLOCK, chunk: int = CHUNK) -> DataFrame:
    """One row per document: ``id_col``, n_shingles (size of its set), component_id (smallest id reachable by links).

    Documents link when the Jaccard similarity of their sets of ``words``-word shingles is at least ``percent``
    hundredths.  A-Z are lower-cased; words are runs of characters other than the blank and U+0009 to U+000D.  A text
    with fewer words has its whole sequence as one shingle; a null text and one without words have none and link with
    nothing.  Ids are integers over -2**63; a null id counts as the smallest, and a component that holds one is named
    null.  Rows that repeat an id are documents of one component if not empty.  An empty table gives an empty result;
    other columns are ignored.
    """
    spark = docs.sparkSession
    width = shuffle_width(spark)
    none = F.lit(-(2**63)).cast("long")
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), none).alias("id"), ascii_lower(F.coalesce(F.col(text_col), F.lit(""))).alias("body"))
    merged = rows.groupBy("body").agg(F.min("id").alias("rep"), F.count("*").alias("copies"))
    reps = materialize(merged.select("rep", "body", "copies", F.octet_length("body").alias("bytes"), F.sha2("body", 256).alias("digest")), "join-texts")
    bodies = reps.select("rep", "body")
    total, bytes_in = reps.agg(F.coalesce(F.sum("copies"), F.lit(0)), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    met, sizes = meeting_points(bodies, words, percent, fan_of(spark, bytes_in), chunk)
    points = materialize(met, "join-points")
    many = points.groupBy("point").agg(F.count("*").alias("members")).where("members > 1").withColumn("blocks", F.ceil(F.col("members") / block).cast("long"))
    dealt = points.join(many.select("point", "blocks"), "point")
    own = F.col("id") == F.col("point")
    # the meeting point's own document, if it is there, stands in every block
    blocks = F.when(own, F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).otherwise(F.array(F.pmod(F.xxhash64("id"), F.col("blocks"))))
    routes = materialize(dealt.select("point", F.explode(blocks).alias("block"), F.col("id").alias("rep"), "blocks"), "join-routes")
    links = materialize(_linked(routes.select("point", "block", "rep"), bodies, words, percent, width), "join-links")
    parts = components(links)
    large = routes.where("blocks > 1")
    if large.limit(1).count():
        placed = large.join(parts.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
        ranked = placed.groupBy("point", "component").agg(F.count("*").alias("n")).withColumn("r", F.row_number().over(Window.partitionBy("point").orderBy(F.desc("n"), "component")))
        outside = materialize(placed.join(ranked.where("r > 1").select("point", "component"), ["point", "component"], "left_semi").select("point", "rep", "blocks").distinct(), "join-outside")
        if outside.limit(1).count():
            chunks = outside.groupBy("point").agg(F.ceil(F.count("*") / block).cast("long").alias("chunks"))
            strangers = outside.join(chunks, "point").select("point", F.pmod(F.xxhash64("rep"), F.col("chunks")).alias("chunk"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), "rep")
            members = large.join(chunks, "point").select("point", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("chunk"), "block", "rep")
            again = materialize(strangers.unionByName(members).distinct(), "join-routes")
            more = materialize(_linked(again, bodies, words, percent, width), "join-links")
            parts = components(links.unionByName(more))
    known_as = reps.select("rep", "digest", "copies").join(sizes, "rep").join(parts.withColumnRenamed("node", "rep"), "rep", "left")
    known_as = known_as.select("digest", "copies", "n_shingles", F.coalesce("component", "rep").alias("component"))
    out = looked_up(rows.select("id", F.sha2("body", 256).alias("digest")), known_as, ["digest"], "copies", total)
    component = F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("id"))
    return out.select(F.nullif("id", none).alias(id_col), "n_shingles", F.nullif(component, none).alias("component_id"))
