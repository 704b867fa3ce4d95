"""Byte-level BPE encoding and decoding by a global shuffle of distinct words.

1. Each task cuts its texts into pre-tokens and numbers the distinct ones chunk by chunk; a text becomes the list of its
   word numbers in order (its positions).  Chunks hold about ``CHUNK`` characters, or one longer text.
2. The distinct words of all chunks are dealt to owners by a hash of the word.  An owner encodes each word once.
3. The ids go back to their chunk, and each text is put together by position.

A word of every text is one entry per chunk, never one row per occurrence, so frequent words are no hot keys.
Steps 2 and 3 each read the texts and cut them, which costs less disk than keeping the words of all texts.  A table reads
the same way each time, also after an executor was lost; each chunk carries a fingerprint of its ids and words, and
where the two readings should differ the job fails.  For input that may change its order (``stable=False``) the result
of step 1 is written to the shared folder first.
Decoding looks each id up in the token-byte table of the rank file, which is as large as the vocabulary, not the data.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import pieces
from .blobs import loose as _loose
from .blobs import tight
from .shared import bytes_of, materialize, shuffle_width

CHUNK = 8_000_000
SLICE = 500_000
#: An owner remembers the distinct words of one bucket; there is a bucket for so many bytes of input at least.
BUCKET = 64_000_000
#: Words put together at a time.
STEP = 200_000
#: bucket -1: ids, word counts and word numbers of a chunk's texts; others: numbers, lengths and letters of its words.
CUT_SCHEMA = "chunk string, print long, bucket int, a binary, b binary, c binary"
NO_ID = -(2**63)


def _tight(x: np.ndarray) -> bytes:
    return tight(x, 3)


def _letters(words: list[str]) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=3).compress("".join(words).encode("utf-8", "surrogatepass"))


def _words(lengths: np.ndarray, letters: bytes) -> list[str]:
    import zstandard

    text = zstandard.ZstdDecompressor().decompress(letters).decode("utf-8", "surrogatepass")
    ends = np.cumsum(lengths).tolist()
    return [text[a:b] for a, b in zip([0, *ends], ends)]


class _Chunk:
    def __init__(self, name: str) -> None:
        self.name, self.held = name, 0
        self.words: dict[str, int] = {}
        self.doc_ids: list[int] = []
        self.counts: list[np.ndarray] = []
        self.places: list[np.ndarray] = []

    def add(self, doc_ids: list[int | None], texts: list[str]) -> None:
        joined, points, starts, ends, owner = pieces.spans(texts)
        words, place = pieces.distinct(joined, points, starts, ends)
        known = self.words
        numbers = np.array([known.setdefault(w, len(known)) for w in words], np.int32)
        self.doc_ids += [NO_ID if i is None else i for i in doc_ids]
        self.counts.append(np.bincount(owner, minlength=len(texts)).astype(np.int32))
        self.places.append(numbers[place] if len(place) else np.zeros(0, np.int32))
        self.held += len(joined)

    def rows(self, fan: int, kinds: str) -> Iterator[pa.RecordBatch]:
        if not self.doc_ids:
            return
        words, ids = list(self.words), np.array(self.doc_ids, np.int64)
        mark = zlib.crc32("\n".join(words).encode("utf-8", "surrogatepass"), zlib.crc32(ids.tobytes()))
        rows = []
        if kinds != "words":
            rows.append((self.name, mark, -1, _tight(ids), _tight(np.concatenate(self.counts)), _tight(np.concatenate(self.places))))
        if kinds != "texts":
            bucket = np.fromiter((zlib.crc32(w.encode("utf-8", "surrogatepass")) % fan for w in words), np.int64, len(words))
            order = np.argsort(bucket, kind="stable")
            cuts = np.searchsorted(bucket[order], np.arange(fan + 1))
            for k in np.flatnonzero(np.diff(cuts)).tolist():
                at = order[cuts[k] : cuts[k + 1]]
                own = [words[i] for i in at.tolist()]
                rows.append((self.name, mark, k, _tight(np.diff(at, prepend=0).astype(np.int32)), _tight(np.fromiter(map(len, own), np.int32, len(own))), _letters(own)))
        if rows:
            yield _batch(rows, (pa.string(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()), ("chunk", "print", "bucket", "a", "b", "c"))


def _batch(rows: list[tuple], kinds: tuple, names: tuple) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=list(names))


def _cut(fan: int, kinds: str):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number = TaskContext.get().partitionId(), 0
        chunk = _Chunk(f"{task}-{number}")
        for batch in batches:
            sizes = pc.utf8_length(batch.column(1)).fill_null(0).to_pylist()
            for a, b in pieces.sliced(sizes, SLICE):
                part = batch.slice(a, b - a)
                chunk.add(part.column(0).to_pylist(), [t or "" for t in part.column(1).to_pylist()])
                if chunk.held >= CHUNK:
                    yield from chunk.rows(fan, kinds)
                    number += 1
                    chunk = _Chunk(f"{task}-{number}")
        yield from chunk.rows(fan, kinds)

    return cut


def _encode(path: str):
    """Owner of buckets; rows come sorted by bucket and only the words of one bucket are remembered."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, known = None, {}
        ids, begin = np.zeros(0, np.uint32), np.zeros(1, np.int64)
        for batch in batches:
            out = []
            for chunk, mark, bucket, places, lengths, letters in zip(*(c.to_pylist() for c in batch.columns)):
                if bucket != at:
                    at, known = bucket, {}
                    ids, begin = np.zeros(0, np.uint32), np.zeros(1, np.int64)
                words = _words(_loose(lengths, np.int32), letters)
                fresh = [w for w in words if w not in known]
                if fresh:
                    new_ids, sizes = pieces.encode_words(fresh, path)
                    for w in fresh:
                        known[w] = len(known)
                    ids, begin = np.concatenate([ids, new_ids]), np.concatenate([begin, begin[-1] + np.cumsum(sizes)])
                place = np.fromiter((known[w] for w in words), np.int64, len(words))
                size = begin[place + 1] - begin[place]
                out.append((chunk, mark, places, _tight(ids[pieces.ragged(begin[place], size)].astype(np.int32)), _tight(size.astype(np.int32))))
            if out:
                yield _batch(out, (pa.string(), pa.int64(), pa.binary(), pa.binary(), pa.binary()), ("chunk", "print", "places", "ids", "lengths"))

    return encode


def _together(path: str, decoded: bool):
    """Ids of each text of a chunk, and the bytes they decode to, from its word numbers and the ids of its words."""

    def together(texts: pa.Table, words: pa.Table) -> pa.Table:
        if len(texts) != 1 or set(words.column("print").to_pylist()) - {texts.column("print")[0].as_py()}:
            raise RuntimeError("the texts did not read the same way twice; encode them with stable=False")
        row = {c: texts.column(c)[0].as_py() for c in "abc"}
        doc_ids, counts, used = _loose(row["a"], np.int64), _loose(row["b"], np.int32).astype(np.int64), _loose(row["c"], np.int32)
        got = [(np.cumsum(_loose(p, np.int32)), _loose(i, np.int32), _loose(n, np.int32)) for p, i, n in zip(*(words.column(c).to_pylist() for c in ("places", "ids", "lengths")))]
        place, ids, lengths = (np.concatenate([g[k] for g in got] or [np.zeros(0, np.int32)]) for k in range(3))
        del got
        begin, length = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
        begin[place] = np.cumsum(lengths) - lengths
        length[place] = lengths
        if decoded:
            table, offsets = pieces.token_bytes(path)
            bytes_upto = np.concatenate([[0], np.cumsum(offsets[ids + 1] - offsets[ids])])
            letters = table[pieces.ragged(offsets[ids], offsets[ids + 1] - offsets[ids])]
        first = np.concatenate([[0], np.cumsum(counts)])
        batches = []
        for a, b in pieces.sliced(counts.tolist(), STEP):
            some = used[first[a] : first[b]]
            own = doc_ids[a:b]
            columns = [pa.array(own, mask=own == NO_ID), _lists(pa.ListArray, ids, begin[some], length[some], counts[a:b])]
            if decoded:
                at = bytes_upto[begin[some]]
                columns.append(_lists(pa.BinaryArray, letters, at, bytes_upto[begin[some] + length[some]] - at, counts[a:b]))
            batches.append(pa.RecordBatch.from_arrays(columns, names=["id", "ids", *["decoded"] * decoded]))
        return pa.Table.from_batches(batches)

    return together


def _lists(kind, values: np.ndarray, begin: np.ndarray, length: np.ndarray, counts: np.ndarray) -> pa.Array:
    """Slices of ``values``, one after another, as one list (or binary) for every ``counts`` slices."""
    out = values[pieces.ragged(begin, length)]
    upto = np.concatenate([[0], np.cumsum(length)])[np.concatenate([[0], np.cumsum(counts)])].astype(np.int32)
    if kind is pa.BinaryArray:
        return pa.BinaryArray.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(upto), pa.py_buffer(np.ascontiguousarray(out))])
    return pa.ListArray.from_arrays(pa.array(upto), pa.array(out.astype(np.int32)))


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False, stable: bool = True) -> DataFrame:
    """One row per document: ``id_col`` and ids (array<int>), as the library encodes it without special tokens.

    With ``decoded`` also the bytes that the ids decode to (binary): the token-byte table is joined to the ids of each
    distinct word, and the texts' bytes are put together by position like their ids.

    A null text counts as empty and has no ids.  Repeated rows and ids are encoded each.  Ids must be integers or null.
    An empty table gives an empty result; other columns are ignored.
    """
    width = shuffle_width(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    fan = max(width, 32, bytes_of(rows, "text") // BUCKET)
    if stable:
        words, texts = (rows.mapInArrow(_cut(fan, kinds), CUT_SCHEMA) for kinds in ("words", "texts"))
    else:
        both = materialize(rows.mapInArrow(_cut(fan, "both"), CUT_SCHEMA), "bpe-words")
        words, texts = both.where("bucket >= 0"), both.where("bucket < 0")
    owned = (words.repartition(fan, "bucket") if fan > max(width, 32) else words.repartition("bucket")).sortWithinPartitions("bucket")
    coded = owned.mapInArrow(_encode(path), "chunk string, print long, places binary, ids binary, lengths binary")
    texts = texts.select("chunk", "print", "a", "b", "c")
    done = texts.groupBy("chunk").cogroup(coded.groupBy("chunk")).applyInArrow(_together(path, decoded), "id long, ids array<int>" + ", decoded binary" * decoded)
    return done.withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, path: str, ids_col: str = "ids") -> DataFrame:
    """All columns and decoded (binary): the bytes of the tokens, one after another.  Null ids decode to no bytes."""

    def join_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, offsets = pieces.token_bytes(path)
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index(ids_col))
            ids = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            size = np.concatenate([[0], np.cumsum(offsets[ids + 1] - offsets[ids])])
            ends = np.cumsum(np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64))
            upto = size[np.concatenate([[0], ends])]
            out = np.empty(int(size[-1]), np.uint8)
            for a in range(0, len(ids), 500_000):  # the table of places is eight times as large as the bytes
                some = ids[a : a + 500_000]
                out[size[a] : size[a + len(some)]] = table[pieces.ragged(offsets[some], offsets[some + 1] - offsets[some])]
            column = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(batch), [None, pa.py_buffer(upto.astype(np.int64)), pa.py_buffer(out)]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, column], names=[*batch.schema.names, "decoded"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema.fields)
    return encoded.mapInArrow(join_bytes, f"{fields}, decoded binary")
