"""Periodic runs of words within documents, found where k-grams repeat and by Main and Lorentz's division there.

A run is a stretch of consecutive words with smallest period q and of ``max(LEAST, TIMES * q)`` words at least that no
neighbouring word extends. Two copies of it, q words apart, overlap in all but q words: k is the least such overlap, so
each word of a run stands in a k-gram that occurs twice in its document. Words outside such k-grams can't join runs. What
they leave are segments, and only these are divided: a run contains one position that is a multiple of a higher power of
two than all others in it, so for each such position and each period that fits, the match of the two words at it and the
words a period further is extended in both directions. Extensions double and halve over hashes of windows of 4^r words;
every run is compared word by word before it counts.

A document is one row of one task. Batches of ``BATCH`` words or so are worked on together; memory is some 100 bytes for
each word of the segments of a batch, and a batch is one document at least. Time grows like n log n with the words of
the segments and like n with all others.

Defined results: words are runs of other bytes than blanks (0x20, 0x09 to 0x0D) of the UTF-8 text; null, empty and blank
texts have no words, no runs and an empty collapsed text; rows that repeat an id, or have none, are documents by
themselves; an empty table gives no rows. Only the id and the text are read, so other columns can't clash.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .shingles import mixed, seeds

LEAST, TIMES = 6, 4
#: Words worked on together, and pairs of a position and a period.
BATCH, PAIRS = 1 << 18, 1 << 20


def least_overlap(least: int = LEAST, times: int = TIMES) -> int:
    """The least overlap of a run with itself a period further, over all periods; from ``least`` on it only grows."""
    return min(max(least, times * q) - q for q in range(1, least + 1))


def repeated(ids: np.ndarray, doc: np.ndarray, k: int) -> np.ndarray:
    """Which words stand in a k-gram that occurs twice in their document; a hash too many only leaves a word more."""
    n = len(ids) - k + 1
    cover = np.zeros(len(ids) + 1, "i8")
    if n < 2:
        return cover[:-1] > 0
    gram = ids[:n].astype("u8") * seeds(k, 31)[0]
    for j, a in enumerate(seeds(k, 31)[1:], 1):
        gram = gram + ids[j : n + j].astype("u8") * a
    gram = mixed(gram + mixed(doc[:n].astype("u8") + np.uint64(1)))
    order = np.argsort(gram)
    twin = gram[order[1:]] == gram[order[:-1]]
    at = np.concatenate([order[1:][twin], order[:-1][twin]])
    at = at[doc[at] == doc[at + k - 1]]  # a k-gram is in one document
    hit = np.zeros(n, "i8")
    hit[at] = 1
    cover[:n] += hit
    cover[k : k + n] -= hit
    return np.cumsum(cover[:-1]) > 0


def _windows(w: np.ndarray, longest: int, seed: int) -> list[np.ndarray]:
    """Hashes of all windows of 4^r words, while these are no longer than ``longest``."""
    out = [mixed(w.astype("u8") + seeds(1, 40 + seed)[0])]
    while (size := 4 ** len(out)) <= longest:
        h, q = out[-1], size // 4
        n = len(w) - size + 1
        out.append(mixed(sum((h[j * q : j * q + n] * a for j, a in enumerate(seeds(4, 60 + seed))), np.zeros(n, "u8"))))
    return out


def _extended(hashes: list[np.ndarray], t: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, end) of the stretch around word ``t`` in which each word equals that ``p`` further."""
    first, end = t.copy(), t.copy()
    for r in reversed(range(len(hashes))):
        h, size = hashes[r], 4**r
        for _ in range(3):
            on = np.flatnonzero(end + p + size <= len(hashes[0]))
            on = on[h[end[on]] == h[end[on] + p[on]]]
            end[on] += size
            on = np.flatnonzero(first >= size)
            on = on[h[first[on] - size] == h[first[on] - size + p[on]]]
            first[on] -= size
    return first, end


def _anchored(length: np.ndarray, w: np.ndarray, least: int, times: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(words, periods) to look at, ``PAIRS`` at a time. ``length``: that of the segment of each word, 0 for separators."""
    half = 1 << ((max(least, times) - 1).bit_length() - 1)  # a run has an inner position that this divides
    while half <= len(w):
        m = np.arange(half, len(w), 2 * half)
        m = m[(length[m] > 0) & (length[m - 1] > 0)]
        most = np.minimum(max(1, 2 * half // times), length[m] // times)
        m, most = m[most > 0], most[most > 0]
        ends = np.cumsum(most)
        at = 0
        while at < len(m):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS)))
            n = most[at:to]
            p = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + 1
            mid = np.repeat(m[at:to], n)
            for t in (mid, mid - p):
                ok = (t >= 0) & (t + p < len(w))
                ok[ok] = w[t[ok]] == w[t[ok] + p[ok]]
                yield t[ok], p[ok]
            at = to
        half *= 2


def runs_in(w: np.ndarray, segment: np.ndarray, least: int = LEAST, times: int = TIMES) -> np.ndarray:
    """(start, end, period) rows of all runs. ``segment`` numbers the segments of ``w``; separators, all distinct, have -1."""
    size = np.bincount(segment[segment >= 0]) if (segment >= 0).any() else np.zeros(1, "i8")
    length = np.where(segment >= 0, size[segment], 0)
    none = np.zeros((0, 3), "i8")
    for seed in count():
        hashes = _windows(w, int(length.max(initial=0)), seed)
        found = [none]
        for t, p in _anchored(length, w, least, times):
            first, end = _extended(hashes, t, p)
            end += p
            ok = end - first >= np.maximum(least, times * p)
            found.append(np.unique(np.stack([first[ok], end[ok], p[ok]], axis=1), axis=0))
        runs = np.unique(np.concatenate(found), axis=0)  # in order of period within a stretch
        runs = runs[np.concatenate([[True], (runs[1:, :2] != runs[:-1, :2]).any(1)])] if len(runs) else runs
        if all(np.array_equal(w[s : e - p], w[s + p : e]) for s, e, p in runs.tolist()):
            return runs  # otherwise two windows have the same hash by chance: hash in another way


def _spans(words: list[list[bytes]], least: int, times: int) -> list[list[tuple[int, int, int]]]:
    """For each document its runs (start, length, period), by start, then period."""
    number: defaultdict[bytes, int] = defaultdict()
    number.default_factory = number.__len__
    ids = np.fromiter((i for ws in words for i in map(number.__getitem__, ws)), "i8")
    sizes = np.array([len(ws) for ws in words])
    doc = np.repeat(np.arange(len(words)), sizes)
    at = np.flatnonzero(repeated(ids, doc, least_overlap(least, times)))
    out: list[list[tuple[int, int, int]]] = [[] for _ in words]
    if not len(at):
        return out
    new = np.ones(len(at), "?")
    new[1:] = (np.diff(at) > 1) | (doc[at[1:]] != doc[at[:-1]])
    place = np.arange(len(at)) + np.cumsum(new)  # a separator before each segment
    w, segment = -1 - np.arange(place[-1] + 1), np.full(place[-1] + 1, -1)
    w[place], segment[place] = ids[at], np.cumsum(new) - 1
    back = np.zeros(len(w), "i8")
    back[place] = at
    begins = np.cumsum(sizes) - sizes
    for s, e, p in runs_in(w, segment, least, times).tolist():
        d = doc[back[s]]
        out[d].append((int(back[s] - begins[d]), e - s, p))
    return [sorted(x, key=lambda r: (r[0], r[2])) for x in out]


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words, one blank between them, without those of runs after the first period."""
    if not runs:
        return b" ".join(words)
    drop = np.zeros(len(words) + 1, "i8")
    for start, length, period in runs:
        drop[start + period] += 1
        drop[start + length] -= 1
    return b" ".join([words[i] for i in np.flatnonzero(np.cumsum(drop[:-1]) == 0).tolist()])


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_OUT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("runs", pa.list_(_RUN)), ("collapsed", pa.string())])
_DDL = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


def _found(least: int, times: int, edit: Callable | None) -> Callable:
    def rows(docs: list, words: list) -> pa.RecordBatch:
        runs = _spans(words, least, times)
        cols = [docs, [len(ws) for ws in words], [[dict(zip(("start", "length", "period"), r, strict=True)) for r in x] for x in runs]]
        texts = [collapsed(ws, x).decode() for ws, x in zip(words, runs, strict=True)]
        return pa.record_batch([pa.array(x, t.type) for x, t in zip([*cols, texts], _OUT, strict=True)], schema=_OUT)

    def run(it):
        docs, words, held = [], [], 0
        for batch in it:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ws = text.as_buffer().to_pybytes().split() if text.is_valid else []
                ws = edit(doc, ws) if edit else ws
                docs.append(doc)
                words.append(ws)
                held += len(ws)
                if held >= BATCH or len(docs) >= 4096:
                    yield rows(docs, words)
                    docs, words, held = [], [], 0
        if docs:
            yield rows(docs, words)

    return run


def periodic_runs(docs: DataFrame, least: int = LEAST, times: int = TIMES, edit: Callable[[int | None, list[bytes]], list[bytes]] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, runs, collapsed) of each document; ``edit`` may change its words first, ``times`` is 2 or more."""
    if times < 2:
        raise ValueError("a run has two periods at least")
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return rows.mapInArrow(_found(least, times, edit), _DDL)


def made_periodic(doc: int | None, words: list[bytes]) -> list[bytes]:
    """A tenth of the documents, by a checksum of their id, turn periodic from some word on; none without an id."""
    h, n = zlib.crc32(str(doc).encode()), len(words)
    if doc is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


def longest_power(runs: str = "runs") -> Column:
    """The run of the greatest exact quotient of length and period, the first of equals; null without runs."""
    first = F.get(runs, F.lit(0))
    return F.aggregate(runs, first, lambda best, r: F.when(r["length"] * best["period"] > best["length"] * r["period"], r).otherwise(best))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of every text of ``documents`` of which a tenth is made periodic, and what is left without repetitions."""
    found = periodic_runs(table(spark, sf_dir, "documents"), edit=made_periodic)
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", *[r[x].cast("string") for x in ("start", "length", "period")]), F.lit("\n")))
    best = found.withColumn("best", longest_power()).withColumn("lines", F.array_join(lines, ""))
    return best.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *[F.col(f"best.{x}").alias(x) for x in ("start", "length", "period")],
        F.call_function("div", F.col("best.length") * 1000, F.col("best.period")).alias("exponent_milli"),
        F.sha2(F.encode("lines", "utf-8"), 256).alias("runs_sha256"),
        F.sha2(F.encode("collapsed", "utf-8"), 256).alias("collapsed_sha256"),
    )
