"""Vectorised pre-tokenising and word-at-a-time byte-level BPE.

A byte-level BPE merges inside pre-tokens only, so each distinct pre-token need be encoded once.  ``spans`` finds the
pre-tokens of many texts at once with numpy over code points, by the rules of the public pattern

    's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+

which are: runs of letters, of numbers and of other visible characters, each with one preceding blank; the listed
endings after an apostrophe that begins a run of its own; white space before a visible character gives its last
character to what follows (as part of it if it is a blank, else as a pre-token of its own).
"""

from __future__ import annotations

import base64
import json
import re
from functools import lru_cache

import numpy as np

#: The characters of Unicode's White_Space property.
WHITE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
OTHER, LETTER, NUMBER, SPACE, END = range(5)


@lru_cache(1)
def _classes() -> np.ndarray:
    """Class of every code point."""
    import regex

    table = np.zeros(0x110000, np.uint8)
    text = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for pattern, kind in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER)):
        for m in regex.finditer(pattern, text):
            table[ord(text[m.start()]) : ord(text[m.end() - 1]) + 1] = kind
    table[0xD800:0xE000] = OTHER
    table[WHITE] = SPACE
    return table


def spans(texts: list[str]) -> tuple[str, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(joined, points, starts, ends, owner): pre-tokens as spans of ``joined`` and the text that each belongs to."""
    joined = "\0".join(texts) + "\0"
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = _classes()[points]
    borders = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1) - 1
    kind[borders] = END
    n = len(kind)
    run = np.empty(n, bool)  # a run of one class begins here
    run[0] = True
    np.not_equal(kind[1:], kind[:-1], out=run[1:])
    run[borders] = True
    run[(borders + 1)[:-1]] = True
    first = np.flatnonzero(run)
    last = np.append(first[1:], n) - 1
    start = run.copy()
    blank = points == 32
    # white space before something visible parts with its last character
    white = (kind[first] == SPACE) & (kind[np.minimum(last + 1, n - 1)] != END)
    start[last[white]] = True
    taken = white & blank[last]
    start[last[taken] + 1] = False
    # endings after an apostrophe that is a run of its own and follows no blank
    lone = first[(first == last) & (points[first] == 39) & (kind[first] == OTHER)]
    lone = lone[start[lone] & (lone + 2 < n)]
    if len(lone):
        one, two = points[lone + 1], points[np.minimum(lone + 2, n - 1)]
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = ((two == ord("e")) & ((one == ord("r")) | (one == ord("v")))) | ((one == ord("l")) & (two == ord("l")))
        for hit, width in ((lone[short], 1), (lone[long & ~short], 2)):
            start[hit + 1] = False
            start[np.minimum(hit + 1 + width, n - 1)] = True
    start[borders] = False
    starts = np.flatnonzero(start)
    stop = start.copy()
    stop[borders] = True
    stops = np.flatnonzero(stop)
    ends = np.append(stops[1:], n)[np.searchsorted(stops, starts)]
    return joined, points, starts, ends, np.searchsorted(borders, starts)


def distinct(joined: str, points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[list[str], np.ndarray]:
    """(words, place): the distinct pre-tokens and, for each span, the place of its word among them.

    Spans are sorted by a hash; then every span's letters are compared with those of the word that it was taken for.
    """
    if not len(starts):
        return [], np.zeros(0, np.int64)
    length = ends - starts
    with np.errstate(over="ignore"):
        base, back = _powers(len(points) + 1)
        sums = np.zeros(len(points) + 1, np.uint64)
        np.cumsum((points.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ np.uint64(0x2545F4914F6CDD1D)) * base[:-1], out=sums[1:])
        key = (sums[ends] - sums[starts]) * back[starts]
        key = (key ^ (key >> np.uint64(31)) ^ length.astype(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
    _, at, place = np.unique(key, return_index=True, return_inverse=True)
    if _all_equal(points, starts, length, at[place]):
        return [joined[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist())], place
    known: dict[str, int] = {}  # different words behind one hash
    place = np.fromiter((known.setdefault(joined[a:b], len(known)) for a, b in zip(starts.tolist(), ends.tolist())), np.int64, len(starts))
    return list(known), place


def _all_equal(points: np.ndarray, starts: np.ndarray, length: np.ndarray, like: np.ndarray) -> bool:
    """Whether every span has the letters of the span ``like`` says."""
    if (length != length[like]).any():
        return False
    other = like != np.arange(len(like))
    own = ragged(starts[other], length[other])
    return bool((points[own] == points[own + np.repeat(starts[like][other] - starts[other], length[other])]).all())


@lru_cache(4)
def _table_of_powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    odd = 0xD1342543DE82EF95
    inverse = pow(odd, -1, 1 << 64)
    with np.errstate(over="ignore"):
        base = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, odd, np.uint64)]), dtype=np.uint64)
        back = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, inverse, np.uint64)]), dtype=np.uint64)
    return base, back


def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    whole = 1 << max(16, (size - 1).bit_length())
    base, back = _table_of_powers(whole)
    return base[:size], back[:size]


def _byte_letters() -> dict[str, int]:
    """The byte behind each letter of a byte-level vocabulary: itself where printable, else U+0100 and on, in turn."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {chr(b): b for b in plain}
    return table | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if chr(b) not in table)}


@lru_cache(4)
def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ids of a rank file (a line each, the bytes in base 64) or of a byte-level BPE tokenizer's JSON file."""
    if not path.endswith(".json"):
        with open(path, "rb") as f:
            return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    with open(path, encoding="utf-8") as f:
        whole = json.load(f)
    special, letters = {t["content"] for t in whole.get("added_tokens", [])}, _byte_letters()
    return {bytes(letters[c] for c in token): i for token, i in whole["model"]["vocab"].items() if token not in special}


@lru_cache(4)
def added_tokens(path: str) -> dict[str, int]:
    """Added tokens of a tokenizer's JSON file and their ids: they are found in a text before anything else is; none in a rank file."""
    if not path.endswith(".json"):
        return {}
    with open(path, encoding="utf-8") as f:
        added = json.load(f).get("added_tokens", [])
    if odd := [t["content"] for t in added if t["single_word"] or t["lstrip"] or t["rstrip"]]:
        raise ValueError(f"added tokens that depend on what is beside them: {odd}")
    return {t["content"]: t["id"] for t in added}


@lru_cache(4)
def _added_pattern(path: str) -> re.Pattern | None:
    tokens = sorted(added_tokens(path), key=len, reverse=True)
    return re.compile("(" + "|".join(map(re.escape, tokens)) + ")") if tokens else None


def split_added(texts: list[str], path: str) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(parts, after, last): the texts cut at added tokens, the id of the token after each part (-1: none), and each text's last part."""
    pattern, tokens = _added_pattern(path), added_tokens(path)
    if not pattern or not any(token in t for t in texts for token in tokens):
        return texts, np.full(len(texts), -1, np.int64), np.arange(len(texts))
    parts, after, last = [], [], []
    for t in texts:
        cut = pattern.split(t)
        parts += cut[::2]
        after += [tokens[x] for x in cut[1::2]] + [-1]
        last.append(len(parts) - 1)
    return parts, np.array(after, np.int64), np.array(last, np.int64)


@lru_cache(4)
def _whole_word_encoder(path: str):
    """An encoding that takes all between two NULs for one pre-token."""
    import tiktoken

    return tiktoken.Encoding("words", pat_str=r"\x00|[^\x00]+", mergeable_ranks=load_ranks(path), special_tokens={})


def encode_words(words: list[str], path: str) -> tuple[np.ndarray, np.ndarray]:
    """(ids, lengths): the tokens of each word, one after another."""
    enc = _whole_word_encoder(path)
    if not words:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    if any("\0" in w for w in words):
        ids = [load_ranks(path)[b"\0"] if w == "\0" else None for w in words]
        each = [_encode_with_nul(w, path) if i is None and "\0" in w else [i] if i is not None else enc.encode_ordinary(w) for w, i in zip(words, ids)]
        return np.array([t for e in each for t in e], np.uint32), np.array([len(e) for e in each], np.int64)
    ids = np.asarray(enc.encode_ordinary("\0".join(words) + "\0"), np.uint32)
    cut = np.flatnonzero(ids == load_ranks(path)[b"\0"])
    lengths = np.diff(np.concatenate([[-1], cut])) - 1
    return np.delete(ids, cut), lengths


def _encode_with_nul(word: str, path: str) -> list[int]:
    import tiktoken

    whole = tiktoken.Encoding("one", pat_str=r"(?s).+", mergeable_ranks=load_ranks(path), special_tokens={})
    return whole.encode_ordinary(word)


def token_bytes(path: str) -> tuple[np.ndarray, np.ndarray]:
    """The token-byte table by id: (bytes one after another, offsets)."""
    ranks = load_ranks(path)
    table = [b""] * (max(ranks.values()) + 1)
    for token, i in ranks.items():
        table[i] = token
    return np.frombuffer(b"".join(table), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in table])]).astype(np.int64)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Places of all elements of the slices that begin at ``starts``: start, start + 1, ... of the first, then of the next."""
    total = int(lengths.sum())
    out = np.ones(total, np.int64)
    full = lengths > 0
    starts, lengths = starts[full], lengths[full]
    if not total:
        return np.zeros(0, np.int64)
    heads = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    out[heads] = starts - np.concatenate([[0], (starts + lengths - 1)[:-1]])
    return np.cumsum(out)


def sliced(sizes: list[int], most: int) -> list[tuple[int, int]]:
    """Ranges of consecutive texts of about ``most`` characters each; a longer text is a range of its own."""
    out, begin, held = [], 0, 0
    for k, size in enumerate(sizes):
        if held and held + size > most:
            out.append((begin, k))
            begin, held = k, 0
        held += size
    return [*out, (begin, len(sizes))] if begin < len(sizes) else out
