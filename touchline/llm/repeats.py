"""Removal of repeated strings: suffix arrays over buckets, and interval expansion on their Burrows-Wheeler transforms.

A byte goes if a string of ``LENGTH`` bytes covers it that also starts in a document with a smaller id. Equal strings
are brought together by what they hold: of the hashes of a string's 16-byte parts the least, its minimizer, and the 16
bytes after it or, if those reach out of the string, before it. Windows of a text that have both in common form a
stretch, and every window is in one stretch.
  1. Texts are written as blocks of ``BLOCK`` bytes or so, in a table bucketed by block, so that they needn't move again.
     Whole texts equal to that of a smaller id go as they are.
  2. Each block sends the hashes of its stretches' common parts, dealt into buckets; those of one document drop out.
  3. Each block sends its remaining stretches, each distinct one once with its smallest id. A common part of more than
     ``HOT`` of them is dealt by whole windows instead, so that no bucket gathers what surrounds a frequent string.
  4. Each bucket sorts its suffixes, takes the transform, and extends all intervals backward, breadth first: prefixes
     shared by neighbours come out by increasing length, intervals of one suffix drop out, and expansion ends at
     ``LENGTH``. Each interval left is a repeated string; its smallest id goes back to the blocks.
  5. Each block marks what is covered and removes it.
Whatever goes from blocks to buckets or back is dealt ``FAN`` ways at a time, in as many rounds as that needs, and every
row gathers what many senders have for one group. So rows and work follow the bytes, not blocks times buckets.

Defined results: a null text is an empty one; texts shorter than ``LENGTH`` stay as they are; rows with equal ids don't
affect each other and each give a row; a null id is larger than any other; an empty table gives no rows; other columns
go along whole, whatever their names.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from touchline.operators.lineage import done_with, tidy_shuffles, workspace, written

from .common import like, table, total, utf8, with_least
from .shingles import mixed, seeds

LENGTH, K = 50, 16
BLOCK, HOT = 1 << 22, 20_000
#: Bits of a destination that a round deals by, and bytes that a row of a later round gathers.
FAN_BITS, GATHER = 9, 1 << 23
#: Bytes that a bucket gathers, of hashes and of stretches.
KEYS, STRETCHES = 1 << 22, 3 << 20
LAST = np.iinfo("i8").max
_BYTE, _STEP = seeds(256, 31), seeds(8, 32)
PIECE = 1 << 16
_LOW = np.uint64((1 << 20) - 1)


def stretches(raw: np.ndarray, ends: np.ndarray, length: int = LENGTH):
    """(first window, windows, hash of the common part, text number, hash of both ends) of each stretch of texts one after another."""
    n, w = len(raw), length - K + 1
    none = np.zeros(0, "i8")
    if n < length:
        return none, none, np.zeros(0, "u8"), none, np.zeros(0, "u8")
    h, at = np.empty(n - K + 1, "u8"), np.empty(n - length + 1, "i8")
    for a in range(0, n - length + 1, PIECE):  # pieces that stay in a core's cache
        x, size = _BYTE[raw[a : a + PIECE + length - 1]], 1
        while size < K:
            x = x[:-size] * _STEP[0] + x[size:] * _STEP[1]
            x ^= x >> np.uint64(32)
            size *= 2
        x = mixed(x)
        h[a : a + len(x)] = x
        v = (x & ~_LOW) | np.arange(len(x), dtype="u8")
        width = 1
        while 2 * width <= w:
            v = np.minimum(v[:-width], v[width:])
            width *= 2
        if w > width:
            v = np.minimum(v[: -(w - width)], v[w - width :])
        at[a : a + len(v)] = (v & _LOW).astype("i8") + a
    doc = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
    whole = doc[: len(at)] == doc[length - 1 :]
    new = whole.copy()
    new[1:] &= ~whole[:-1] | (at[1:] != at[:-1])
    over = whole.copy()
    over[:-1] &= ~whole[1:] | (at[1:] != at[:-1])
    start, end = np.flatnonzero(new), np.flatnonzero(over) + 1
    at, doc = at[start], doc[start]
    turn = np.clip(at - (length - 2 * K), start, end)  # windows from here on hold what follows the minimizer
    left, right = turn > start, turn < end
    before = h[at[left] - K] * _STEP[2] + h[at[left]] * _STEP[3]
    after = h[at[right]] * _STEP[4] + h[at[right] + K] * _STEP[5]
    first, windows = np.r_[start[left], turn[right]], np.r_[(turn - start)[left], (end - turn)[right]]
    around = h[first] * _STEP[6] + h[first + windows - 1 + length - K] * _STEP[7]
    return first, windows, mixed(np.r_[before, after]), np.r_[doc[left], doc[right]], around


def _packed(table: pa.Table) -> bytes:
    """A table in Arrow's stream format; ``key``, mostly in order, as differences."""
    if "key" in table.column_names:
        key = np.diff(table["key"].to_numpy(), prepend=np.uint64(0))
        table = table.set_column(table.column_names.index("key"), "key", pa.array(key, pa.uint64()))
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _unpacked(data: pa.ChunkedArray) -> pa.Table | None:
    """The tables of a column, one after another."""
    tables = []
    for x in data:
        if x.is_valid:
            t = pa.ipc.open_stream(x.as_buffer()).read_all()
            if "key" in t.column_names:
                t = t.set_column(t.column_names.index("key"), "key", pa.array(np.cumsum(t["key"].to_numpy(), dtype="u8"), pa.uint64()))
            tables.append(t)
    return pa.concat_tables(tables).combine_chunks() if tables else None


#: Rows that are dealt: the group that they are for, and what is for it.
_DEALT = pa.schema([("group", pa.int64()), ("data", pa.binary())])
DEALT = "group long, data binary"


def rounds(homes: int, bits: int) -> int:
    """How many rounds of ``bits`` deal ``homes`` destinations."""
    return max(1, -(-(homes - 1).bit_length() // bits))


def _dealt(table: pa.Table, home: np.ndarray, homes: int, bits: int, level: int = 1, schema: pa.Schema = _DEALT, **more) -> pa.Table:
    """Rows of a round: in the last one a row for each home, before that one for each value of some bits of its hash."""
    group = home if level >= rounds(homes, bits) else (mixed(home.astype("u8")) >> np.uint64(64 - bits * level)).astype("i8")
    o = np.argsort(group, kind="stable")
    table, group = table.take(pa.array(o)), group[o]
    cut = np.r_[np.flatnonzero(np.diff(group, prepend=-1)), len(group)] if len(group) else np.zeros(1, "i8")
    data = [_packed(table.slice(a, b - a)) for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
    cols = {"group": pa.array(group[cut[:-1]], pa.int64()), "data": pa.array(data, pa.binary()), **{k: pa.array([v] * len(data), schema.field(k).type) for k, v in more.items()}}
    return pa.table([cols[n] for n in schema.names], schema=schema)


def _again(homes: int, level: int, home_of):
    def run(it):
        held, size, group = [], 0, None

        def out():
            table = _unpacked(pa.chunked_array([pa.array(held, pa.binary())]))
            return _dealt(table, home_of(table), homes, FAN_BITS, level).to_batches()

        for batch in it:
            for g, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if held and (g != group or size > GATHER):
                    yield from out()
                    held, size = [], 0
                group = g
                held.append(data)
                size += len(data)
        if held:
            yield from out()

    return run


def deal(rows: DataFrame, homes: int, home_of) -> DataFrame:
    """Rows of the first round to one or more rows for each home.

    A later round takes the rows of a group together, but not all in one task: they are salted as the homes' count asks.
    """
    for level in range(2, rounds(homes, FAN_BITS) + 1):
        tasks = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), homes // 64)
        salt = F.pmod(F.xxhash64("data"), F.lit(max(1, tasks >> (FAN_BITS * (level - 1)))))
        rows = rows.repartition(tasks, "group", salt).sortWithinPartitions("group").mapInArrow(_again(homes, level, home_of), DEALT)
    return rows


_BLOCK_COLS = [("block", pa.int64()), ("n_bytes", pa.int64()), ("ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())), ("data", pa.binary()), ("digests", pa.list_(pa.binary()))]


def _in_blocks(least: int):
    def run(it):
        from pyspark import TaskContext

        number, held, size = TaskContext.get().partitionId() << 32, [], 0

        def block():
            ids, texts, rest = (pa.concat_arrays([b.column(i) for b in held]) for i in range(3))
            sizes = [len(t.as_buffer()) for t in texts]
            cols = [[number], [sum(sizes)], [ids.to_pylist()], [sizes], [b"".join([t.as_py() for t in texts])], [[hashlib.sha256(t.as_buffer()).digest() for t in texts]]]
            arrays = [pa.array(x, t) for x, (_, t) in zip(cols, _BLOCK_COLS, strict=True)] + [pa.ListArray.from_arrays([0, len(rest)], rest)]
            return pa.record_batch(arrays, names=[*(n for n, _ in _BLOCK_COLS), "rest"])

        for batch in it:
            texts, last = batch.column(1), 0
            for i, t in enumerate(texts):
                size += len(t.as_buffer())
                if size >= least:
                    held.append(batch.slice(last, i + 1 - last))
                    yield block()
                    number, held, size, last = number + 1, [], 0, i + 1
            if last < batch.num_rows:
                held.append(batch.slice(last))
        if held:
            yield block()

    return run


def _block_of(blocks: pa.Table, copies: list[int]):
    """(bytes, text ends, ids, which texts are copies) of a block."""
    row = blocks.select(["ids", "sizes", "data"]).slice(0, 1).to_pylist()[0]
    ids = np.array([LAST if x is None else x for x in row["ids"]], "i8")
    is_copy = np.zeros(len(ids), "?")
    is_copy[copies] = True
    return np.frombuffer(row["data"], "u1"), np.cumsum(np.array(row["sizes"], "i8")), ids, is_copy


def _copies(side: pa.Table) -> list[int]:
    return [i for x in side["copies"].to_pylist() if x is not None for i in x]


def _bucket(keys: np.ndarray, buckets: int, bits: int = 64) -> np.ndarray:
    return ((keys >> np.uint64(bits - 32)) * np.uint64(buckets)) >> np.uint64(32)


#: Bits of a hash that are sent.
SENT_BITS = 48


def _key_home(buckets: int):
    return lambda table: _bucket(table["key"].to_numpy(), buckets, SENT_BITS).astype("i8")


def _home(table: pa.Table) -> np.ndarray:
    return table["home"].to_numpy()


def _send_keys(buckets: int, length: int):
    def run(blocks: pa.Table, side: pa.Table) -> pa.Table:
        if not blocks.num_rows:
            return _DEALT.empty_table()
        raw, ends, _, is_copy = _block_of(blocks, _copies(side))
        _, _, keys, doc, around = stretches(raw, ends, length)
        own = ~is_copy[doc]
        keys, doc, around = keys[own] >> np.uint64(64 - SENT_BITS), doc[own], around[own]
        if not len(keys):
            return _DEALT.empty_table()
        o = np.argsort(keys)
        keys, doc = keys[o], doc[o]
        first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        several = np.minimum.reduceat(doc, first) != np.maximum.reduceat(doc, first)
        # how many different stretches have the part in common
        size = np.diff(np.r_[first, len(keys)])
        n, many = np.ones(len(first), "i4"), np.flatnonzero(np.repeat(size > 1, size))
        if len(many):
            part, around = np.repeat(np.arange(len(first)), size)[many], around[o][many]
            at = np.lexsort((around, part))
            new = np.r_[True, (np.diff(part[at]) != 0) | (np.diff(around[at]) != 0)]
            n = np.maximum(n, np.bincount(part[at][new], minlength=len(first)).astype("i4"))
        table = pa.table({"key": keys[first], "home": np.full(len(first), blocks["block"][0].as_py()), "n": n, "several": several})
        return _dealt(table, _key_home(buckets)(table), buckets, FAN_BITS)

    return run


_FOUND = pa.schema([*_DEALT, ("n", pa.int64())])
FOUND = f"{DEALT}, n long"


def _repeated(blocks: int):
    def run(group: pa.Table) -> pa.Table:
        """Of one bucket's hashes, those that come from several documents, for each block that sent them."""
        table = _unpacked(group["data"])
        keys, n = table["key"].to_numpy(), table["n"].to_numpy()
        o = np.argsort(keys, kind="stable")
        first = np.flatnonzero(np.r_[True, np.diff(keys[o]) != 0])
        counts = np.diff(np.r_[first, len(o)])
        kept = (counts > 1) | np.logical_or.reduceat(table["several"].to_numpy()[o], first)
        keep, hot = np.empty(len(o), "?"), np.empty(len(o), "?")
        keep[o], hot[o] = np.repeat(kept, counts), np.repeat(np.add.reduceat(n[o].astype("i8"), first) > HOT, counts)
        table = table.select(["key", "home"]).append_column("hot", pa.array(hot)).filter(pa.array(keep))
        if not table.num_rows:
            return _FOUND.empty_table()
        out = _dealt(table, _home(table), blocks, FAN_BITS)
        return out.append_column("n", pa.array([table.num_rows] + [0] * (out.num_rows - 1), pa.int64()))

    return run


_STRETCH = pa.schema([*_DEALT, ("block", pa.int64())])
STRETCH = f"{DEALT}, block long"
#: The group of what a block keeps for itself.
OWN = -1


def _send_stretches(buckets: int, length: int):
    def run(blocks: pa.Table, side: pa.Table) -> pa.Table:
        found = _unpacked(side["data"]) if blocks.num_rows else None
        if found is None:
            return _STRETCH.empty_table()
        raw, ends, ids, is_copy = _block_of(blocks, _copies(side))
        keys, hot = found["key"].to_numpy(), found["hot"].to_numpy(zero_copy_only=False)
        o = np.argsort(keys)
        keys, hot = keys[o], hot[o]
        start, windows, key, doc, _ = stretches(raw, ends, length)
        short = key >> np.uint64(64 - SENT_BITS)
        where = np.minimum(np.searchsorted(keys, short), len(keys) - 1)
        is_in = (keys[where] == short) & ~is_copy[doc]
        start, windows, key, doc, is_hot = start[is_in], windows[is_in], key[is_in], doc[is_in], hot[where[is_in]]
        many = np.where(is_hot, windows, 1)
        place = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        start, key, doc, by_window = np.repeat(start, many) + place, np.repeat(key, many), np.repeat(doc, many), np.repeat(is_hot, many)
        windows = np.where(by_window, 1, np.repeat(windows, many))
        to, data, block = _bucket(mixed(key), buckets).astype("i8"), raw.tobytes(), blocks["block"][0].as_py()
        items: dict[bytes, int] = {}
        home, least, which = [], [], []
        for s, n, b, d, single in zip(start.tolist(), windows.tolist(), to.tolist(), ids[doc].tolist(), by_window.tolist(), strict=True):
            text = data[s : s + n + length - 1]
            i = items.setdefault(text, len(least))
            if i == len(least):
                home.append(zlib.crc32(text) % buckets if single else b)
                least.append(d)
            elif d < least[i]:
                least[i] = d
            which.append(i)
        table = pa.table({"home": np.array(home), "block": np.full(len(home), block), "item": np.arange(len(home), dtype="i4"), "least": np.array(least), "text": pa.array(list(items), pa.large_binary())})
        own = pa.table({"start": start, "windows": windows.astype("i4"), "item": np.array(which, "i4")})
        mine = pa.table([pa.array([OWN], pa.int64()), pa.array([_packed(own)], pa.binary()), pa.array([block], pa.int64())], schema=_STRETCH)
        return pa.concat_tables([mine, _dealt(table, _home(table), buckets, FAN_BITS, schema=_STRETCH, block=block)])

    return run


def suffix_array(s: np.ndarray, depth: int) -> np.ndarray:
    """Starts of the suffixes of a cyclic text (symbols up to 256), sorted by their first ``depth`` symbols at least."""
    n = len(s)
    key, s = np.zeros(n, "u8"), s.astype("u8")
    for j in range(7):
        key = (key << np.uint64(9)) | np.roll(s, -j)
    sa = np.argsort(key)
    new = np.r_[True, np.diff(key[sa]) != 0]
    slot = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank = np.empty(n, "i8")
    rank[sa] = slot
    done = 7
    while done < depth:
        open_ = ~(new & np.r_[new[1:], True])
        at = np.flatnonzero(open_)
        if not len(at):
            break
        sub = sa[at]
        key = (rank[sub] << 32) | rank[(sub + done) % n]
        o = np.argsort(key)
        sub, key = sub[o], key[o]
        sa[at] = sub
        first = np.r_[True, key[1:] != key[:-1]]
        new[at] = first
        rank[sub] = at[np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))]
        done *= 2
    return sa


def intervals(s: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(suffix array, interval number of each rank): ranks of an interval share their first ``length`` symbols.

    Backward extension on the transform, breadth first. An interval of a prefix p goes by the last-to-first mapping to
    the intervals of cp for every c at once; ``new`` marks where neighbours part. At step l just those pairs are looked
    at whose common prefix is at least l, so common prefixes come out by increasing length.
    """
    sa = suffix_array(s, length)
    bwt = s[sa - 1]
    back = np.argsort(bwt, kind="stable").astype("i4")
    first = bwt[back]
    new = np.r_[True, first[1:] != first[:-1]]
    live = None
    for _ in range(length - 1):
        group = np.cumsum(new, dtype="i4")
        if live is None:
            to = group[back]
            part = ~new[1:] & (to[1:] != to[:-1])
            new[1:] |= part
            if 8 * np.count_nonzero(new) > 7 * len(new):  # few are open: from now on only those are looked at
                live = np.flatnonzero(~new)
        else:
            part = group[back[live]] != group[back[live - 1]]
            new[live[part]] = True
            live = live[~part]
        if not part.any():
            break
    return sa, np.cumsum(new) - 1


def _expand(length: int, blocks: int):
    def run(group: pa.Table) -> pa.Table:
        """The smallest id that each window's string starts in, run by run, for the stretches of each block."""
        table = _unpacked(group["data"])
        seen: dict[bytes, int] = {}
        which = np.array([seen.setdefault(t, len(seen)) for t in table["text"].to_pylist()])
        least = np.full(len(seen), LAST, "i8")
        np.minimum.at(least, which, table["least"].to_numpy())
        sizes = np.array([len(t) for t in seen], "i8")
        text = np.frombuffer(b"\0".join(seen) + b"\0", "u1").astype("u2") + np.uint16(1)
        ends = np.cumsum(sizes + 1)
        text[ends - 1] = 0
        sa, number = intervals(text, length)
        begins = ends - sizes - 1
        windows = sizes - length + 1
        off = np.cumsum(windows) - windows
        place = np.repeat(begins - off, windows) + np.arange(windows.sum())
        of_rank = np.empty(len(text), "i8")
        of_rank[sa] = number
        mine = of_rank[place]
        ids = np.repeat(least, windows)
        best = np.full(int(number[-1]) + 1, LAST, "i8")
        o = np.argsort(mine, kind="stable")
        cut = np.flatnonzero(np.r_[True, np.diff(mine[o]) != 0])
        best[mine[o][cut]] = np.minimum.reduceat(ids[o], cut)
        # runs of equal values within each stretch; a block is told those of the stretches that it sent
        value = best[mine]
        new = np.r_[True, value[1:] != value[:-1]]
        new[off] = True
        run_at = np.flatnonzero(new)
        first = np.searchsorted(run_at, off)
        n = np.diff(np.r_[first, len(run_at)])
        size = np.diff(np.r_[run_at, len(value)]).astype("i4")
        at = np.repeat(first[which] - (np.cumsum(n[which]) - n[which]), n[which]) + np.arange(n[which].sum())
        bounds = pa.array(np.r_[0, np.cumsum(n[which])], pa.int32())
        out = pa.table({"home": table["block"], "item": table["item"], "runs": pa.ListArray.from_arrays(bounds, pa.array(size[at])), "least": pa.ListArray.from_arrays(bounds, pa.array(value[run_at][at]))})
        return _dealt(out, _home(out), blocks, FAN_BITS)

    return run


def _remove(length: int, schema: pa.Schema):
    def run(blocks: pa.Table, side: pa.Table) -> pa.Table:
        if not blocks.num_rows:
            return schema.empty_table()
        rest = blocks["rest"].combine_chunks().flatten()
        raw, ends, ids, is_copy = _block_of(blocks, _copies(side))
        own, said = _unpacked(side["own"]), _unpacked(side["said"])
        hit = np.zeros(len(raw), "?")
        if own is not None:
            said = said.sort_by("item")
            least = np.repeat(said["least"].combine_chunks().flatten().to_numpy(), said["runs"].combine_chunks().flatten().to_numpy())
            start, windows, item = (own[c].to_numpy() for c in ("start", "windows", "item"))
            n_of = np.zeros(said.num_rows, "i8")
            n_of[item] = windows
            off = np.cumsum(n_of) - n_of
            step = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
            at = np.repeat(start, windows) + step
            value = least[np.repeat(off[item], windows) + step]
            hit[at[value < ids[np.searchsorted(ends, at, "right")]]] = True
        begun = np.cumsum(hit, dtype="i4")
        gone = begun > 0
        gone[length:] = begun[length:] > begun[:-length]  # windows end within their text
        out, a = [], 0
        for b, copy in zip(ends.tolist(), is_copy.tolist(), strict=True):
            g = gone[a:b]
            g[:] |= copy and b - a >= length
            kept = raw[a:b][~g].tobytes()
            out.append((b - a, int(g.sum()), int(np.count_nonzero(g[1:] & ~g[:-1])) + int(len(g) > 0 and g[0]), kept, hashlib.sha256(kept).hexdigest()))
            a = b
        cols = [rest, *(pa.array([x[i] for x in out], schema.field(i + 1).type) for i in range(5))]
        return pa.table(cols, names=schema.names)

    return run


def _bucketed(spark: SparkSession, df: DataFrame, col: str, buckets: int) -> tuple[DataFrame, str]:
    """``df`` as a table in the warehouse, dealt into buckets as its tasks write; what is grouped by ``col`` stays."""
    name = f"touchline_{uuid.uuid4().hex}"
    with tidy_shuffles(spark):
        df.write.option("compression", "zstd").bucketBy(buckets, col).saveAsTable(name)
    return spark.table(name), name


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """(rest, n_bytes, n_removed, n_spans, kept, kept_sha256) of each row; ``rest`` holds its other columns."""
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = docs.sparkSession
    rest = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_col])
    rows = docs.select(F.col(id_col).cast("long").alias("id"), utf8(text_col).alias("bytes"), rest.alias("rest"))
    of_blocks = T.StructType().add("block", "long").add("n_bytes", "long").add("ids", T.ArrayType(T.LongType())).add("sizes", T.ArrayType(T.LongType()))
    of_blocks = of_blocks.add("data", "binary").add("digests", T.ArrayType(T.BinaryType())).add("rest", T.ArrayType(rows.schema["rest"].dataType))
    size = total(docs, F.octet_length(text_col).cast("long"))
    made = rows.mapInArrow(_in_blocks(BLOCK), of_blocks)
    blocks, name = _bucketed(spark, made, "block", max(8, -(-size // (8 * BLOCK))))
    schema = rows.select("rest").schema.add("n_bytes", "long").add("n_removed", "long").add("n_spans", "long").add("kept", "binary").add("kept_sha256", "string")

    try:
        with workspace(spark):
            texts = blocks.select("block", "ids", "sizes", "data").groupBy("block")
            each = blocks.select("block", F.posexplode(F.arrays_zip("ids", "digests")).alias("i", "x"))
            each = each.select("block", "i", F.coalesce("x.ids", F.lit(LAST)).alias("id"), F.col("x.digests").alias("digest"))
            copies = with_least(each, "digest", "id").filter("id > least").groupBy("block").agg(F.collect_list("i").alias("copies"))
            copies = written(spark, copies, "repeat-copies")
            n_blocks = max(1, blocks.select("block").count())

            buckets = max(1, size * 4 // 9 // KEYS)
            sent = texts.cogroup(copies.groupBy("block")).applyInArrow(_send_keys(buckets, length), DEALT)
            found = deal(sent, buckets, _key_home(buckets)).groupBy("group").applyInArrow(_repeated(n_blocks), FOUND)
            found = written(spark, found, "repeat-keys")

            buckets = max(1, total(found, "n") * (length + 9) // STRETCHES)
            told = deal(found.select("group", "data"), n_blocks, _home).select(F.col("group").alias("block"), "data")
            side = told.unionByName(copies, allowMissingColumns=True)
            sent = texts.cogroup(side.groupBy("block")).applyInArrow(_send_stretches(buckets, length), STRETCH)
            sent = written(spark, sent, "repeat-stretches")
            done_with(found)
            asked = deal(sent.filter(F.col("group") != OWN).select("group", "data"), buckets, _home)
            said = written(spark, asked.groupBy("group").applyInArrow(_expand(length, n_blocks), DEALT), "repeat-answers")

            own = sent.filter(F.col("group") == OWN).select("block", F.col("data").alias("own"))
            said = deal(said, n_blocks, _home).select(F.col("group").alias("block"), F.col("data").alias("said"))
            side = own.unionByName(said, allowMissingColumns=True).unionByName(copies, allowMissingColumns=True)
            texts = blocks.select("block", "ids", "sizes", "data", "rest").groupBy("block")
            out = texts.cogroup(side.groupBy("block")).applyInArrow(_remove(length, to_arrow_schema(schema)), schema)
            return written(spark, out, "repeat-result", keep=True)
    finally:
        spark.sql(f"drop table {name}")


def op2_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What goes from each text of ``documents``, and the digest of what stays."""
    out = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("rest.doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without their repeated strings; what is left of a character cut in two goes as well."""
    valid = F.replace(F.make_valid_utf8(F.col("kept").cast("string")), F.lit("\ufffd"), F.lit(""))
    # the mark of what isn't valid goes, but for texts that hold it themselves and are valid
    out = remove_repeats(docs).select("rest.*", F.when(F.is_valid_utf8(F.col("kept").cast("string")), F.col("kept").cast("string")).otherwise(valid).alias("text"))
    return like(out, docs)
