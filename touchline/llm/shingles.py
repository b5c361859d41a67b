"""Words and five-word shingles of texts as 64-bit hashes, many texts at a time.

``A-Z`` count as ``a-z``; words are runs of other bytes than blanks (0x20, 0x09 to 0x0D) of the UTF-8 text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

N = 5


def mixed(x: np.ndarray) -> np.ndarray:
    """SplitMix64's finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def seeds(n: int, salt: int) -> np.ndarray:
    """``n`` odd 64-bit numbers by a rule."""
    return mixed((np.arange(1, n + 1, dtype="u8") + np.uint64(salt << 32)) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


_BLANK = np.zeros(256, "?")
_BLANK[[32, 9, 10, 11, 12, 13]] = True
_BYTE = seeds(256, 1)
_BYTE[65:91] = _BYTE[97:123]
_BYTE[_BLANK] = 0
_PLACE = seeds(1 << 10, 2)
_TERM = seeds(N * (N + 1), 3).reshape(N + 1, N)
PIECE = 1 << 20


def _hashed(raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of texts that lie one after another, and how many words each text has."""
    global _PLACE
    solid = ~_BLANK[raw]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    at = ends[:-1][ends[:-1] < len(raw)]
    first[at] = solid[at]
    start = np.flatnonzero(first)
    counts = np.diff(np.searchsorted(start, np.concatenate([[0], ends])))
    if not len(start):
        return np.zeros(0, "u8"), counts
    word = np.cumsum(first) - 1
    word[: start[0]] = 0
    place = np.arange(len(raw)) - start[word]
    if place.max() >= len(_PLACE):
        _PLACE = seeds(int(place.max()) * 2, 2)
    terms = _BYTE[raw] * _PLACE[place]
    return mixed(np.add.reduceat(terms, start)), counts


def _pieces(texts: pa.Array):
    """(bytes, text ends) of consecutive texts, together a ``PIECE`` or so."""
    held, size = [], 0
    for t in texts:
        b = t.as_buffer() if t.is_valid else b""
        held.append(np.frombuffer(b, "u1"))
        size += len(held[-1])
        if size >= PIECE:
            yield np.concatenate(held), np.cumsum([len(x) for x in held])
            held, size = [], 0
    if held:
        yield np.concatenate(held), np.cumsum([len(x) for x in held])


def shingle_sets(texts: pa.Array):
    """For each text the sorted distinct hashes of its shingles.

    A text with one to four words has one shingle, its whole sequence; a null, empty or blank text has none.
    """
    for raw, ends in _pieces(texts):
        words, counts = _hashed(raw, ends)
        many = np.zeros(0, "u8")
        if len(words) >= N:
            many = words[: len(words) - N + 1] * _TERM[N, 0]
            for k in range(1, N):
                many = many + words[k : len(words) - N + 1 + k] * _TERM[N, k]
            many = mixed(many)
        at = 0
        for n in counts.tolist():
            if n >= N:
                yield np.unique(many[at : at + n - N + 1])
            elif n:
                yield mixed((words[at : at + n] * _TERM[n, :n]).sum(keepdims=True))
            else:
                yield np.zeros(0, "u8")
            at += n
