"""Harmonic packing of token sequences: classes of reciprocal capacity, each filled with a fixed count of pieces.

A document is cut into pieces of ``capacity``, and the rest into descending powers of two. A piece of ``capacity`` / k
tokens is of class k, and k pieces of one class fill a sequence to the last token. Every task fills the sequences of
each class by itself, in the order in which it meets the pieces; nothing is shuffled, no task waits for another and a
hot source is one more run of pieces. What a task has left of a class in the end is fewer than k pieces: they are laid
out as sequences of a power of two tokens each, so that no sequence is padded at all.

The ids are those of the library ``tokenizers`` (tests hold them against it, character by character), but texts go
through ``tiktoken`` with the ranks of the same vocabulary file, which takes a fifth of the time. Texts with special
tokens, and long stretches without a word's end, go through ``tokenizers`` itself. In the pre-tokenisation of byte-level
BPE a blank between two characters that aren't white space starts a new word: long texts are cut at such blanks, so that
memory is bounded by the ids of one text.

Defined results: a null or empty text has no ids but the one that ends a document; rows that repeat an id, or have none,
are documents by themselves; an empty table packs nothing. Only the id and the text are read, so other columns can't
clash. Sequence numbers hold the number of the partition, so they are the same in every run over the same files.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Callable, Iterator
from functools import cache

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
CAPACITY, END = 2048, 1
#: Characters of a long text that are encoded together.
SLICE = 1 << 16
_SAFE = re.compile(r"(?<=\S) (?=\S)")


def byte_ranks(path: str) -> dict[bytes, int]:
    """The vocabulary of a byte-level BPE file with its tokens as bytes, without special tokens.

    Printable bytes stand for themselves and the rest, in order, for the characters from 256 on.
    """
    with open(path, encoding="utf-8") as f:
        model = json.load(f)
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}
    special = {x["content"] for x in model["added_tokens"]}
    vocab = model["model"]["vocab"]
    made = [vocab["".join(x if isinstance(x, list) else x.split(" "))] for x in model["model"]["merges"]]
    if made != sorted(made):
        raise ValueError("the ids of this vocabulary aren't in the order of its merges")
    return {bytes(map(byte_of.__getitem__, token)): i for token, i in vocab.items() if token not in special}


class Encoder:
    """Texts to ids, as little-endian unsigned 32-bit numbers."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        import tiktoken
        from tokenizers import Tokenizer

        self.of_library = Tokenizer.from_file(path)
        self.special = [x.content for x in self.of_library.get_added_tokens_decoder().values()]
        self.ordinary = tiktoken.Encoding("ordinary", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_ranks(path), special_tokens={}).encode_ordinary

    def plain(self, text: str) -> bytes:
        return array("I", self.of_library.encode(text, add_special_tokens=False).ids).tobytes()

    def __call__(self, text: str) -> bytes:
        if any(x in text for x in self.special):
            return self.plain(text)
        out, at = [], 0
        while at < len(text):
            cut = _SAFE.search(text, at + SLICE) if len(text) - at > SLICE else None
            end = cut.start() if cut else len(text)
            part = text[at:end]
            # without a blank that parts words for long, there may be one run that the pattern is too slow for
            out.append(self.plain(part) if len(part) > 2 * SLICE else array("I", self.ordinary(part)).tobytes())
            at = end
        return b"".join(out)


@cache
def encoder(path: str) -> Encoder:
    """One for each worker process."""
    return Encoder(path)


def cuts(n: int, capacity: int = CAPACITY) -> Iterator[int]:
    """The lengths of the pieces of ``n`` tokens: whole sequences, then the powers of two that the rest adds up to."""
    yield from [capacity] * (n // capacity)
    size, rest = capacity // 2, n % capacity
    while rest:
        if size <= rest:
            yield size
            rest -= size
        size //= 2


class Bins:
    """The open sequences of one task: of each class, fewer pieces than a sequence holds."""

    def __init__(self, capacity: int, first: int):
        self.capacity, self.next, self.open = capacity, first, {}

    def _closed(self, size: int, pieces: list[tuple]) -> Iterator[tuple]:
        for i, piece in enumerate(pieces):
            yield (*piece, self.next, i * size)
        self.next += 1

    def add(self, size: int, piece: tuple) -> Iterator[tuple]:
        held = self.open.setdefault(size, [])
        held.append(piece)
        if len(held) * size == self.capacity:
            yield from self._closed(size, held)
            self.open[size] = []

    def rest(self) -> Iterator[tuple]:
        """What is left: sequences of a power of two of pieces each, so that none is padded."""
        for size, held in self.open.items():
            while held:
                n = 1 << (len(held).bit_length() - 1)
                yield from self._closed(size, held[:n])
                held = held[n:]
        self.open = {}


_OUT = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])
_DDL = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def _packed(path: str, capacity: int, end: int) -> Callable:
    def run(it):
        from pyspark import TaskContext

        bins, encode, tail = Bins(capacity, TaskContext.get().partitionId() << 40), encoder(path), array("I", [end]).tobytes()
        rows: list[tuple] = []
        for batch in it:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encode(text.as_py() or "") + tail
                n, at = len(ids) // 4, 0
                for size in cuts(n, capacity):
                    rows.extend(bins.add(size, (doc, at, size, ids[4 * at : 4 * (at + size)], n)))
                    at += size
                if len(rows) >= 4096:
                    yield _batch(rows)
                    rows = []
        rows.extend(bins.rest())
        if rows:
            yield _batch(rows)

    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(x, t.type) for x, t in zip(zip(*rows, strict=True), _OUT, strict=True)], schema=_OUT)


def harmonic_pack(docs: DataFrame, path: str = VOCABULARY, capacity: int = CAPACITY, end: int = END, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start, length, ids, doc_tokens, sequence_id, offset): a row for each piece; ``capacity`` is a power of two.

    The vocabulary's ``path`` has to be there on every executor.
    """
    if capacity < 1 or capacity & (capacity - 1):
        raise ValueError("the capacity must be a power of two")
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return rows.mapInArrow(_packed(path, capacity, end), _DDL)


def sequences(pieces: DataFrame) -> DataFrame:
    """(sequence_id, n_tokens, ids, doc_ids, starts) from ``harmonic_pack``: whole sequences, with what each piece is of.

    A sequence has ``capacity`` tokens at most, so a group is bounded.
    """
    held = F.sort_array(F.collect_list(F.struct("offset", "ids", "doc_id", "start")))
    out = pieces.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), held.alias("held"))
    ids = F.aggregate("held", F.lit(b""), lambda a, p: F.concat(a, p["ids"]))
    return out.select("sequence_id", "n_tokens", ids.alias("ids"), F.col("held.doc_id").alias("doc_ids"), F.col("held.start").alias("starts"))


def op12_harmonic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every text of ``documents`` with its place and a checksum of its ids."""
    out = harmonic_pack(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
