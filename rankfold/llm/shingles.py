"""Sets of hashed word shingles of many texts at once.

Words are told apart by a cryptographic hash (BLAKE2b, 64 bits), shingles by a chain of mixed word hashes: no text, however
regular, is known to make different shingles equal, and by chance two of them are so once in 2**64.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np

WORDS = 5
#: Words whose hash a process remembers; beyond that it starts afresh.
REMEMBERED = 300_000
_SEED, _STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_known: dict[bytes, int] = {}


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(words: list[bytes]) -> np.ndarray:
    """A 64-bit hash of each word."""
    if len(_known) > REMEMBERED:
        _known.clear()
    for w in set(words).difference(_known):
        _known[w] = int.from_bytes(blake2b(w, digest_size=8).digest(), "little")
    return np.fromiter(map(_known.__getitem__, words), np.uint64, len(words))


def shingle_sets(texts: list[bytes], words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, hashes): the distinct shingles of each text (UTF-8), sorted by hash.

    A-Z are lower-cased; words are parted by blanks and the characters 9 to 13.  A text with fewer than ``words`` words
    has its whole sequence as its only shingle, one without words has none.
    """
    n, every, count = len(texts), [], np.zeros(len(texts), np.int64)
    for k, text in enumerate(texts):
        own = text.lower().split()
        count[k] = len(own)
        every += own
    first = np.concatenate([[0], np.cumsum(count)])
    with np.errstate(over="ignore"):
        word = word_hashes(every)
        held = np.full(max(len(word) - words + 1, 0), _SEED)
        for k in range(words):
            held = _mixed(held * _STEP + word[k : k + len(held)])
        shingles = np.where(count >= words, count - words + 1, np.minimum(count, 1))
        upto = np.concatenate([[0], np.cumsum(shingles)])
        out = np.empty(int(upto[-1]), np.uint64)
        for i in range(n):
            a, b, f = upto[i], upto[i + 1], first[i]
            if count[i] >= words:
                out[a:b] = held[f : f + (b - a)]
                out[a:b].sort()
            elif b > a:
                few = np.array([_SEED ^ np.uint64(count[i])])  # never the chain of a full shingle
                for w in word[f : f + count[i]]:
                    few = _mixed(few * _STEP + w)
                out[a] = few[0]
    new = np.ones(len(out), bool)
    new[1:] = out[1:] != out[:-1]
    new[upto[:-1][shingles > 0]] = True
    places = np.concatenate([[0], np.cumsum(new)])
    return places[upto], out[new]
