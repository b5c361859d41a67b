"""SentencePiece encoding with seeded merge-dropout, and decoding.

Texts become ids of a public BPE vocabulary by merging neighbours, best score first, leftmost first among equals. The
candidate merges wait in an agenda; each that comes up is skipped with probability ``dropout``. Whether it is depends only
on a keyed hash of seed, document id and the candidate's place in the document and its two sizes in bytes. So each
occurrence of a word is cut by itself, and equal input gives equal output on any cluster and after any retry. Without
dropout the ids are those of the library's own encoder.

Blanks become U+2581 and one is put in front, as the vocabulary wants it. A text is cut into parts between two bytes
that stand side by side in no piece: no merge can reach over such a place, so each part has an agenda of its own. The
agendas of many parts are worked on together: every step takes the best candidate of each part, hashes all of them at
once, and merges or drops them. Characters that are no piece, and U+2581 itself, become byte pieces, so that decoding
gives exactly the text.

Defined results: a null or empty text has no ids and decodes to an empty one; rows that repeat are encoded alike; a null
id is hashed as one more id; an empty table gives no rows. Only the id and the text are read, so other columns can't
clash. Long texts are worked on by ``PIECE`` bytes or so, cut between parts; only a part has to be in memory as a whole.
"""

from __future__ import annotations

import heapq
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .shingles import mixed, seeds

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
DROPOUT, SEED = 0.1, 2024
BLANK = "▁"
#: Bytes that are worked on together, and the longest part whose agenda is worked on with others.
PIECE, SHORT = 1 << 19, 64
_KEYS = seeds(5, 43)
_ALL, NEVER = (1 << 64) - 1, 1 << 62


def skip_bar(dropout: float) -> int:
    """Hashes below it skip their candidate."""
    return min(int(dropout * 2**64), _ALL)


def document_keys(ids: np.ndarray, known: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit key for each document id; ``known`` is false where the id is null."""
    return mixed(np.where(known, ids.astype("u8"), _KEYS[4]) * _KEYS[3] + mixed(np.full(1, seed, "u8") + _KEYS[4]))


def candidate_hash(key: int, start: int, left: int, right: int) -> int:
    """The hash of the candidate whose left symbol starts at byte ``start`` and has ``left`` bytes, its right one ``right``."""
    x = (key + start * int(_KEYS[0]) + left * int(_KEYS[1]) + right * int(_KEYS[2])) & _ALL
    return int(mixed(np.full(1, x, "u8"))[0])


class Vocabulary:
    """Pieces of a SentencePiece BPE model."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        pieces = [sp.id_to_piece(i) for i in range(n)]
        self.byte_ids = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.byte_id = np.array(self.byte_ids, "i4")
        bytes_of = {i: bytes([b]) for b, i in enumerate(self.byte_ids)}
        special = {i for i in range(n) if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or sp.is_byte(i)}
        #: ids of pieces by what they stand for, blanks as blanks
        self.ids = {p.replace(BLANK, " "): i for i, p in enumerate(pieces) if i not in special}
        self.texts = [bytes_of.get(i) or p.replace(BLANK, " ").encode() for i, p in enumerate(pieces)]
        scores = sorted({sp.get_score(i) for i in self.ids.values()}, reverse=True)
        rank = {s: r for r, s in enumerate(scores)}
        #: (left id, right id) to (rank of the score, merged id)
        self.merges = {}
        for p, i in self.ids.items():
            for k in range(1, len(p)):
                a, b = self.ids.get(p[:k]), self.ids.get(p[k:])
                if a is not None and b is not None:
                    self.merges[a, b] = rank[sp.get_score(i)], i
        #: whether a piece may hold two bytes side by side; a character's own bytes always stay together
        self.joined = np.zeros((256, 256), "?")
        self.joined[:, 0x80:0xC0] = True
        for p in self.ids:
            b = p.encode()
            self.joined[list(b[:-1]), list(b[1:])] = True
        self.joined = self.joined.ravel()
        #: the id of each code point's character
        self.chars = np.full(0x110000, -1, "i4")
        for p, i in self.ids.items():
            if len(p) == 1 and p != BLANK:
                self.chars[ord(p)] = i
        self._index_merges()
        self.sizes = np.array([len(t) for t in self.texts], "i8")
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.bytes = np.frombuffer(b"".join(self.texts), "u1")

    def _index_merges(self) -> None:
        """``merges`` as an open hash table of arrays that is an eighth full at most."""
        self.bits = (8 * len(self.merges)).bit_length()
        self.pair, self.rank, self.to = (np.full(1 << self.bits, x, k) for x, k in ((_ALL, "u8"), (NEVER, "i8"), (-1, "i4")))
        for (a, b), (rank, to) in self.merges.items():
            k = a << 32 | b
            at = k * int(_KEYS[0]) % (1 << 64) >> (64 - self.bits)
            while self.pair[at] != _ALL:
                at = (at + 1) % (1 << self.bits)
            self.pair[at], self.rank[at], self.to[at] = k, rank << 32, to

    def merged(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank << 32, merged id) of pairs of ids; ``NEVER`` where they make no piece."""
        k = (a.astype("u8") << np.uint64(32)) | (b.astype("u8") & np.uint64(0xFFFFFFFF))
        at = ((k * _KEYS[0]) >> np.uint64(64 - self.bits)).astype("i8")
        there = self.pair[at]
        rank, to = self.rank[at], self.to[at]
        odd = np.flatnonzero((there != k) & (there != np.uint64(_ALL)))
        rank[odd] = NEVER
        while len(odd):
            at[odd] = (at[odd] + 1) % (1 << self.bits)
            there = self.pair[at[odd]]
            found = odd[there == k[odd]]
            rank[found], to[found] = self.rank[at[found]], self.to[at[found]]
            odd = odd[(there != k[odd]) & (there != np.uint64(_ALL))]
        return rank, to

    def characters(self, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(where each character starts, its id or -1) for UTF-8 bytes; what is no valid character has no id."""
        at = np.flatnonzero((raw & 0xC0) != 0x80)
        lead = raw[at]
        code = lead.astype("i4")
        many = np.flatnonzero((lead >= 0x80) | (np.diff(at, append=len(raw)) > 1))
        if len(many):
            size = np.diff(at, append=len(raw))[many]
            wanted = np.select([lead[many] < 0x80, lead[many] < 0xC2, lead[many] < 0xE0, lead[many] < 0xF0, lead[many] < 0xF5], [1, 0, 2, 3, 4], 0)
            c = code[many] & np.select([size == 2, size == 3], [0x1F, 0x0F], 0x07)
            for k in (1, 2, 3):
                more = size > k
                c[more] = (c[more] << 6) | (raw[at[many[more]] + k] & 0x3F)
            code[many] = np.where((size == wanted) & (c < 0x110000), c, 0x2581)
        return at, self.chars[code]

    def begins(self, raw: np.ndarray) -> np.ndarray:
        """Where a part begins, for bytes of one text; true at the first."""
        out = np.ones(len(raw), "?")
        out[1:] = ~self.joined[(raw[:-1].astype("u2") << np.uint16(8)) | raw[1:]]
        return out

    def symbols(self, part: bytes) -> tuple[list[int], list[int]]:
        """Ids of a part's characters, less than 0 where one is no piece, and where each starts, the end included."""
        ids, starts, at = [], [], 0
        for c in part.decode("utf-8", "surrogateescape"):
            ids.append(int(self.chars[ord(c)]))
            starts.append(at)
            at += len(c.encode("utf-8", "surrogateescape"))
        return ids, [*starts, at]

    def spelled(self, ids: list[int], starts: list[int], part: bytes) -> list[int]:
        """Ids of symbols, with byte pieces for those that are no piece."""
        out = []
        for s, a, b in zip(ids, starts, starts[1:], strict=False):
            out += [s] if s >= 0 else [self.byte_ids[x] for x in part[a:b]]
        return out

    def run_long(self, part: bytes, key: int, start: int, bar: int) -> list[int]:
        """Ids of a part at a place of a document; the agenda is a heap, so the work is n log n."""
        ids, at = self.symbols(part)
        n = len(ids)
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))

        def candidate(i: int, j: int) -> tuple | None:
            m = self.merges.get((ids[i], ids[j]))
            return None if m is None else (m[0], i, j, right[j], m[1])

        agenda = [c for i in range(n - 1) if (c := candidate(i, i + 1))]
        heapq.heapify(agenda)
        while agenda:
            _, i, j, k, s = heapq.heappop(agenda)
            if right[i] != j or right[j] != k:
                continue
            if bar and candidate_hash(key, start + at[i], at[j] - at[i], at[k] - at[j]) < bar:
                continue
            ids[i], right[i], right[j] = s, k, -1
            if k < n:
                left[k] = i
                if c := candidate(i, k):
                    heapq.heappush(agenda, c)
            if left[i] >= 0 and (c := candidate(left[i], i)):
                heapq.heappush(agenda, c)
        live, i = [], 0
        while i < n:
            live.append(i)
            i = right[i]
        return self.spelled([ids[i] for i in live], [*(at[i] for i in live), at[n]], part)

    def bytes_of(self, ids: np.ndarray) -> np.ndarray:
        """What ids stand for, one after another."""
        n = self.sizes[ids]
        ends = np.cumsum(n)
        return self.bytes[np.repeat(self.starts[ids] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]


@lru_cache(4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class Encoder:
    """Encodes many texts at a time."""

    def __init__(self, path: str, seed: int, dropout: float):
        self.v, self.seed, self.bar = vocabulary(path), seed, skip_bar(dropout)

    def _piece(self, raw: np.ndarray, begins: np.ndarray, place: np.ndarray, key: np.ndarray) -> np.ndarray:
        """An id for each byte where a symbol or byte piece begins, -2 elsewhere.

        Parts begin at ``begins`` and there stand at ``place`` of a document with this ``key``.
        """
        out = np.full(len(raw), -2, "i4")
        pos, sym = self.v.characters(raw)
        size = np.diff(begins, append=len(raw))
        n = np.diff(np.searchsorted(pos, begins), append=len(pos))
        for i in np.flatnonzero(size > SHORT).tolist():
            a = int(begins[i])
            ids = self.v.run_long(raw[a : a + int(size[i])].tobytes(), int(key[i]), int(place[i]), self.bar)
            out[a : a + len(ids)] = ids
        if not (size <= SHORT).all():
            some = np.repeat(size <= SHORT, n)
            wide = np.diff(pos, append=len(raw))[some]
            pos, sym = pos[some], sym[some]
            begins, place, key, size, n = (x[size <= SHORT] for x in (begins, place, key, size, n))
        else:
            wide = np.diff(pos, append=len(raw))
        lost = sym < 0
        if lost.any():
            w = wide[lost]
            at = np.repeat(pos[lost] - (np.cumsum(w) - w), w) + np.arange(w.sum())
            out[at] = self.v.byte_id[raw[at]]
        self._agendas(pos, sym, n, begins + size, key + (place - begins).astype("u8") * _KEYS[0], out)
        return out

    def _agendas(self, pos: np.ndarray, sym: np.ndarray, n: np.ndarray, end: np.ndarray, key: np.ndarray, out: np.ndarray) -> None:
        """Merges the symbols of parts of ``n`` characters each, and writes them to ``out`` where they begin.

        ``first`` holds for each symbol the rank of its pair with the next one and, below it, its place, so that the
        least of a part is its best candidate. A step takes one of each part, so it looks at each symbol once.
        """
        merged, bar = self.v.merged, np.uint64(self.bar)
        rank, to = merged(sym[:-1], sym[1:])
        first, to = np.append(rank, NEVER) | pos, np.append(to, np.int32(-1))
        first[np.cumsum(n) - 1] = NEVER
        while len(n):
            ends = np.cumsum(n)
            least = np.minimum.reduceat(first, ends - n)
            live = least < NEVER
            i = np.flatnonzero(first == np.repeat(np.where(live, least, -1), n))
            keep = np.ones(len(pos), "?")
            if not live.all():
                done = np.repeat(~live, n)
                put = done & (sym >= 0)
                out[pos[put]] = sym[put]
                keep[done] = False
            n, ends, end, key = (x[live] for x in (n, ends, end, key))
            last = i + 2 == ends
            stop = np.where(last, end, pos[np.minimum(i + 2, len(pos) - 1)])
            a, b = pos[i], pos[i + 1]
            h = mixed(key + a.astype("u8") * _KEYS[0] + (b - a).astype("u8") * _KEYS[1] + (stop - b).astype("u8") * _KEYS[2])
            go = h >= bar
            first[i[~go]] = NEVER
            is_first = (i == ends - n)[go]
            i, last, n = i[go], last[go], n - go
            sym[i], first[i], keep[i + 1] = to[i], NEVER, False
            k = i[~last]
            rank, to[k] = merged(sym[k], sym[k + 2])
            first[k] = rank | pos[k]
            k = i[~is_first]
            rank, to[k - 1] = merged(sym[k - 1], sym[k])
            first[k - 1] = rank | pos[k - 1]
            pos, sym, first, to = (x[keep] for x in (pos, sym, first, to))

    def _long_text(self, text: np.ndarray, key: np.ndarray) -> np.ndarray:
        """Ids of one long text, by pieces that end where a part does."""
        out, at = [], 0
        while at < len(text):
            step = PIECE
            while True:
                begins = np.flatnonzero(self.v.begins(text[at : at + step]))
                if at + step >= len(text):
                    end = len(text)
                    break
                if len(begins) > 1:
                    end, begins = at + int(begins[-1]), begins[:-1]
                    break
                step *= 2
            ids = self._piece(text[at:end], begins, at + begins, np.repeat(key, len(begins)))
            out.append(ids[ids != -2])
            at = end
        return np.concatenate(out)

    def encode(self, texts: list, keys: np.ndarray):
        """Yields (first text, ids one after another, how many each text has, which decode to their text)."""
        at = 0
        while at < len(texts):
            last, size = at, 0
            while last < len(texts) and (last == at or size + len(texts[last]) < PIECE):
                size += len(texts[last]) + 1
                last += 1
            n = np.array([len(t) + 1 if len(t) else 0 for t in texts[at:last]], "i8")
            raw = np.frombuffer(b"".join([x for t in texts[at:last] if len(t) for x in (b" ", t)]), "u1")
            if len(raw) > 2 * PIECE:
                ids = self._long_text(raw, keys[at : at + 1])
                counts = np.array([len(ids)])
            else:
                ends = np.cumsum(n)
                is_begin = self.v.begins(raw)
                is_begin[(ends - n)[n > 0]] = True
                begins = np.flatnonzero(is_begin)
                doc = np.searchsorted(ends, begins, "right")
                ids = self._piece(raw, begins, begins - (ends - n)[doc], keys[at:last][doc])
                where = np.flatnonzero(ids != -2)
                counts, ids = np.diff(np.searchsorted(where, ends), prepend=0), ids[where]
            yield at, ids, counts, self._lossless(raw, n, ids, counts)
            at = last

    def _lossless(self, raw: np.ndarray, n: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Which texts their ids decode to: the ids of all are decoded and held against the bytes."""
        back = self.v.bytes_of(ids)
        if len(back) == len(raw) and (back == raw).all():
            return np.ones(len(n), "?")
        of, ends = np.cumsum(counts), np.cumsum(n)
        return np.array([self.v.bytes_of(ids[of[i] - counts[i] : of[i]]).tobytes() == raw[ends[i] - n[i] : ends[i]].tobytes() for i in range(len(n))])


@lru_cache(4)
def encoder(path: str, seed: int, dropout: float) -> Encoder:
    return Encoder(path, seed, dropout)


ROW = "doc_id long, n_bytes long, n_tokens long, ids array<int>, lossless boolean"


def _encoded(path: str, seed: int, dropout: float):
    def run(it):
        e = encoder(path, seed, dropout)
        for batch in it:
            docs = batch.column(0)
            keys = document_keys(docs.fill_null(0).to_numpy(), docs.is_valid().to_numpy(zero_copy_only=False), seed)
            texts = [b"" if (b := t.as_buffer()) is None else b for t in batch.column(1)]
            for at, ids, counts, lossless in e.encode(texts, keys):
                n = len(counts)
                sizes = np.array([len(t) for t in texts[at : at + n]], "i8")
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(ids, pa.int32()))
                yield pa.record_batch([docs.slice(at, n), pa.array(sizes), pa.array(counts), lists, pa.array(lossless)], names=["doc_id", "n_bytes", "n_tokens", "ids", "lossless"])

    return run


def encode(docs: DataFrame, path: str = MODEL, seed: int = SEED, dropout: float = DROPOUT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, ids, lossless) of each row; ``lossless``: the ids decode to the text."""
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    return rows.mapInArrow(_encoded(path, seed, dropout), ROW)


def _decoded(path: str):
    def run(it):
        v = vocabulary(path)
        for batch in it:
            ids = [x.values.to_numpy(zero_copy_only=False) if x.is_valid else np.zeros(0, "i8") for x in batch.column(1)]
            texts = pa.array([v.bytes_of(x).tobytes()[1:] for x in ids], pa.binary())
            texts = texts.cast(options=pc.CastOptions(pa.string(), allow_invalid_utf8=True))
            yield pa.record_batch([batch.column(0), texts], names=["rest", "text"])

    return run


def decode(rows: DataFrame, path: str = MODEL, ids_col: str = "ids") -> DataFrame:
    """``rows`` with the text that ``ids_col`` stands for in its place, as ``text``."""
    keep = [F.col(f"`{c}`") for c in rows.columns if c not in (ids_col, "text")]
    d = rows.select(F.struct(*(keep or [F.lit(0)])).alias("rest"), F.col(f"`{ids_col}`").alias("ids"))
    return d.mapInArrow(_decoded(path), d.select("rest").schema.add("text", "string")).select(*(["rest.*"] if keep else []), "text")


def op9_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of ``documents`` as ids."""
    return encode(table(spark, sf_dir, "documents"))
