"""MinHash near-duplicates by an LSH forest, confirmed on full shingle sets.

Each text with shingles gets MinHash values. Sorted orders list every signature by 12 of its values, each order by others;
the first few (the least depth) are in no other order. Rows that share that prefix are a region of the order. The least
depth and the count of orders follow from the threshold, so that a pair at it shares no region with probability ``MISS``
at most: 24 orders and depth 5 at 0.85, 27 and 4 at 0.8. Texts are compared with
  (1) the pivot of their region, at the least depth, 8 and 12: the text that collides with most others,
  (2) all texts of their regions of at most ``SMALL`` rows, and their next neighbours in each sorted order, those with
      the longest common prefixes, where (1) left both in different groups, and
  (3) in larger regions that (1) and (2) left in several groups, all texts of other groups that may reach the threshold.
(3) is an exact prefix-filter join: under one order of all shingles, rare ones first, a pair at the threshold has its
first common shingle early in both sets. So every pair that shares a region is compared or known to be connected.
Pairs are confirmed on their full sets; nothing but confirmed pairs is linked. Texts with equal sets are one class and
are compared once.

What is compared are units: a document is one, and where rows repeat a doc_id with different sets, each of these is one
under a number that no document has, with links to the others of that doc_id.

Defined results: null, empty and blank texts have no shingles and link with nothing; rows that repeat a doc_id count as
one document with the links of all its texts; a row with a null doc_id is given back by itself, kept and without a
component, as nothing can be linked with it by name; an empty table gives no rows. Only the id and the text are read, so
other columns can't clash.
"""

from __future__ import annotations

import hashlib
import math
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.operators.lineage import workspace, written
from touchline.operators.resample import numbered

from .common import batches, components, table, utf8, with_least
from .shingles import mixed, seeds, shingle_sets

K, DEPTH, NEXT, SMALL, MISS = 128, 12, 3, 8, 1e-6
#: Counts by which shingles are ordered are kept for this many top bits of their hashes, each as a byte.
BITS = 20


class Shape(NamedTuple):
    least: int
    depths: tuple[int, ...]
    orders: list[list[int]]
    values: int


@cache
def shape(percent: int) -> Shape:
    """The orders for a threshold: the greatest least depth at most 5 whose orders take ``K`` values at most.

    Each order looks at own values first, then at some of the others, by a rule.
    """
    for least in (5, 4, 3, 2, 1):
        meet = (percent / 100) ** least
        trees = 1 if meet == 1 else math.ceil(math.log(MISS) / math.log1p(-meet))
        if trees * least <= K:
            break
    k = max(K, trees * least)
    orders = [[*range(least * t, least * (t + 1))] + [(least * t + least + 17 * (i + 1)) % k for i in range(DEPTH - least)] for t in range(trees)]
    return Shape(least, (least, 8, DEPTH), orders, k)


_SIG = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("digest", pa.binary()), ("sig", pa.binary())])
SIG = "doc_id long, n long, digest binary, sig binary"


@cache
def _factors(k: int) -> tuple[np.ndarray, np.ndarray]:
    return seeds(k, 11), seeds(k, 12)


def signature(shingles: np.ndarray, k: int = K) -> np.ndarray:
    """``k`` 32-bit MinHash values."""
    a, b = _factors(k)
    out = np.full(k, 0xFFFFFFFF, "u4")
    for i in range(0, len(shingles), 512):
        h = (shingles[i : i + 512, None] * a + b) >> np.uint64(32)
        out = np.minimum(out, h.min(0).astype("u4"))
    return out


def _digest(shingles: np.ndarray) -> bytes | None:
    """What texts with equal sets have in common; nothing for texts without shingles."""
    return hashlib.md5(shingles.tobytes()).digest() if len(shingles) else None


def _signed(percent: int):
    def run(it):
        k = shape(percent).values
        for batch in it:
            rows = []
            for doc, s in zip(batch.column(0).to_pylist(), shingle_sets(batch.column(1)), strict=True):
                sig = signature(s, k).astype(">u4").tobytes() if len(s) else None
                rows.append((doc, len(s), _digest(s), sig))
            if rows:
                yield pa.record_batch([pa.array(x, t.type) for x, t in zip(zip(*rows, strict=True), _SIG, strict=True)], schema=_SIG)

    return run


def _keys(sig: np.ndarray, depth: int, orders: list[list[int]]) -> np.ndarray:
    """For rows of signatures, a key of the first ``depth`` values of each order; the order is part of it."""
    place = seeds(depth, 21)
    return np.stack([mixed((sig[:, o[:depth]].astype("u8") * place).sum(1) + np.uint64(t)) for t, o in enumerate(orders)], axis=1).view("i8")


def _sigs(col, k: int) -> np.ndarray:
    return np.frombuffer(b"".join(x.as_py() for x in col), ">u4").reshape(-1, k).astype("u4")


def _first_keys(percent: int):
    def run(it):
        s = shape(percent)
        for batch in it:
            if batch.num_rows:
                keys = _keys(_sigs(batch.column(1), s.values), s.least, s.orders)
                yield pa.record_batch([pa.array(keys.ravel()), pa.array(np.repeat(batch.column(0).to_numpy(), len(s.orders)))], names=["k", "doc"])

    return run


_PATHS = "k_least long, k8 long, k12 long, path binary, doc long, score long"


def _paths(percent: int):
    def run(it):
        s = shape(percent)
        for batch in it:
            for at in range(0, batch.num_rows, 1024):
                b = batch.slice(at, 1024)
                sig = _sigs(b.column(1), s.values)
                paths = [t.to_bytes(2, "big") + row[o].tobytes() for row in sig.astype(">u4") for t, o in enumerate(s.orders)]
                cols = [pa.array(_keys(sig, d, s.orders).ravel()) for d in s.depths]
                cols += [pa.array(paths, pa.binary()), *(pa.array(np.repeat(b.column(i).to_numpy(), len(s.orders))) for i in (0, 2))]
                yield pa.record_batch(cols, names=["k_least", "k8", "k12", "path", "doc", "score"])

    return run


_NEAR = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("part", pa.int32()), ("edge", pa.binary())])


def _neighbours(it, least: int):
    """From rows in sorted order, pairs of each with the next ``NEXT`` that share the least prefix.

    The first and last rows of a partition go out too (b null), for pairs that a partition's end cuts.
    """
    from pyspark import TaskContext

    part, head, tail = TaskContext.get().partitionId(), [], []
    cut = 2 + 4 * least
    for batch in it:
        a, b = [], []
        for path, doc in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            for p, d in tail:
                if p[:cut] == path[:cut]:
                    a.append(d)
                    b.append(doc)
            tail = [*tail[1 - NEXT :], (path, doc)] if NEXT > 1 else [(path, doc)]
            if len(head) < NEXT:
                head.append((path, doc))
        if a:
            n = len(a)
            yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], schema=_NEAR)
    ends = [(d, part - 1, p[:cut]) for p, d in head] + [(d, part, p[:cut]) for p, d in tail]
    if ends:
        sides = [None] * len(head) + [0] * len(tail)
        yield pa.record_batch([pa.array([x[0] for x in ends], pa.int64()), pa.array([-1 if s is None else -2 for s in sides], pa.int64()), pa.array([x[1] for x in ends], pa.int32()), pa.array([x[2] for x in ends], pa.binary())], schema=_NEAR)


def neighbour_pairs(rows: DataFrame, least: int) -> DataFrame:
    """(a, b) of next neighbours in each order: a global sort by ranges, so no region has to be in one task.

    The few rows at the ends of sorted partitions meet by a join on the partition's number.
    """
    got = rows.select("path", "doc").repartitionByRange("path", "doc").sortWithinPartitions("path", "doc").mapInArrow(lambda it: _neighbours(it, least), "a long, b long, part int, edge binary")
    got = written(rows.sparkSession, got, "forest-near")
    after = got.filter("b = -1").select("part", "edge", F.col("a").alias("y"))
    before = got.filter("b = -2").select("part", "edge", F.col("a").alias("x"))
    return got.filter("part is null").select("a", "b").union(before.join(after, ["part", "edge"]).select("x", "y"))


_SETS = pa.schema([("doc_id", pa.int64()), ("digest", pa.binary()), ("n", pa.int64()), ("items", pa.binary())])


def _sets(it):
    for batch in it:
        rows, held = [], 0
        for doc, s in zip(batch.column(0).to_pylist(), shingle_sets(batch.column(1)), strict=True):
            rows.append((doc, _digest(s), len(s), s.tobytes()))
            held += s.nbytes
            if held > 1 << 23:
                yield pa.record_batch([pa.array(x, t.type) for x, t in zip(zip(*rows, strict=True), _SETS, strict=True)], schema=_SETS)
                rows, held = [], 0
        if rows:
            yield pa.record_batch([pa.array(x, t.type) for x, t in zip(zip(*rows, strict=True), _SETS, strict=True)], schema=_SETS)


def _confirm(percent: int):
    def run(it):
        for batch in it:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), "u8") for v in (x, y))
                both = len(x) + len(y) - len(np.union1d(x, y))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs`` whose sets have 100 * intersection >= percent * union.

    Sizes that can't reach it drop out before sets move; a text that many pairs name meets them in joins that
    adaptive execution can split.
    """
    n = sets.select("doc", "n")
    p = pairs.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    p = p.join(n.toDF("a", "na"), "a").join(n.toDF("b", "nb"), "b")
    p = p.filter(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")).select("a", "b")
    p = p.join(sets.select(F.col("doc").alias("a"), F.col("items").alias("ia")), "a")
    p = p.join(sets.select(F.col("doc").alias("b"), F.col("items").alias("ib")), "b")
    return p.select("a", "b", "ia", "ib").mapInArrow(_confirm(percent), "a long, b long")


def _counted(it):
    """How many shingles of a partition fall on each value of their top bits."""
    n = np.zeros(1 << BITS, "i8")
    for batch in it:
        for x in batch.column(0):
            np.add.at(n, (np.frombuffer(x.as_buffer(), "u8") >> np.uint64(64 - BITS)).astype("i8"), 1)
    at = np.flatnonzero(n)
    if len(at):
        yield from batches({"at": at, "n": n[at]}, pa.schema([("at", pa.int64()), ("n", pa.int64())]), 65536)


_POSTINGS = pa.schema([("t", pa.int64()), ("doc", pa.int64()), ("g", pa.int64()), ("n", pa.int64()), ("i", pa.int64())])


def _postings(percent: int, levels: np.ndarray):
    """Of each set the shingles among which the first one in common with a set that is near must be, with their places."""

    def run(it):
        for batch in it:
            for doc, g, n, x in zip(*(batch.column(i).to_pylist() for i in range(3)), batch.column(3), strict=True):
                s = np.frombuffer(x.as_buffer(), "u8")
                first = np.lexsort((s, levels[s >> np.uint64(64 - BITS)]))[: n + (-percent * n // 100) + 1]
                m = len(first)
                yield pa.record_batch([pa.array(v) for v in (s[first].view("i8"), np.full(m, doc), np.full(m, g), np.full(m, n), np.arange(m))], schema=_POSTINGS)

    return run


def shared_levels(sets: DataFrame) -> np.ndarray:
    """Of each value of the top bits a level, four for a doubling of the count of shingles there; 0 where there are none.

    It passes the driver and goes with each task, so it is a byte a value, 1 MB whatever the input.
    """
    got = sets.select("items").mapInArrow(_counted, "at long, n long").groupBy("at").agg(F.sum("n").alias("n"))
    level = F.least(F.lit(127), 1 + F.floor(4 * F.log2("n")))
    got = got.select(F.col("at").cast("int").alias("at"), level.cast("byte").alias("level")).toArrow()
    levels = np.zeros(1 << BITS, "i1")
    levels[got["at"].to_numpy()] = got["level"].to_numpy()
    return levels


def dense_pairs(sets: DataFrame, percent: int) -> DataFrame:
    """(a, b) of ``sets`` (doc, g, n, items) of different groups ``g``: all that may reach the threshold.

    Shingles are ordered by about how many share their top bits, then by value: any one order gives the same links, one with
    rare shingles first gives few candidates. Two near sets x and y, x not the larger one, have at least
    2 * percent / (100 + percent) of x and percent / 100 of y in common, so their first common shingle is in the rest of
    x and of y, counted from the front, and what follows it suffices in both. A shingle whose texts are in one group
    makes no pairs, and those of its largest group meet only the others, so a large group isn't squared.
    """
    spark = sets.sparkSession
    levels = shared_levels(sets)
    post = sets.select("doc", "g", "n", "items").mapInArrow(_postings(percent, levels), "t long, doc long, g long, n long, i long")
    post = written(spark, post, "forest-postings")
    top = post.groupBy("t", "g").agg(F.count("*").alias("c")).groupBy("t").agg(F.max_by("g", F.struct("c", "g")).alias("top"), F.count("*").alias("groups"))
    post = written(spark, post.join(top.filter("groups > 1").drop("groups"), "t").withColumn("rest", F.col("g") != F.col("top")).drop("top"), "forest-shared")
    x = post.filter(F.expr(f"{100 + percent} * (n - i) >= {2 * percent} * n")).toDF("t", "a", "ga", "na", "ia", "rest_a")
    y = post.toDF("t", "b", "gb", "nb", "ib", "rest_b")
    fits = F.expr(f"ga <> gb and na <= nb and {100 + percent} * least(na - ia, nb - ib) >= {percent} * (na + nb)")
    both = x.filter("rest_a").join(y, "t").filter(fits).union(x.filter("not rest_a").join(y.filter("rest_b"), "t").filter(fits))
    return both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _split(sigs: DataFrame, name: str) -> DataFrame:
    """(doc_id, digest, unit) of those documents that have several sets: numbers from the end of the ids on that is free."""
    odd = sigs.groupBy("doc_id").agg(F.min("digest").alias("low"), F.max("digest").alias("high")).filter("low <> high").select("doc_id")
    odd = numbered(sigs.select("doc_id", "digest").join(odd, "doc_id").distinct(), "doc_id", "digest")
    low, high, n = sigs.agg(F.min("doc_id"), F.max("doc_id")).crossJoin(odd.agg(F.count("*"))).first()
    unit = F.lit(0).cast("long")
    if n and high + n < 1 << 63:
        unit = F.col("i") + (high + 1)
    elif n and low - n >= -(1 << 63):
        unit = F.lit(low - 1) - F.col("i")
    elif n:
        raise ValueError("the ids leave no numbers free")
    return written(sigs.sparkSession, odd.select("doc_id", "digest", unit.alias("unit")), name)


def near_duplicates(docs: DataFrame, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of each document; see the module's text."""
    with workspace(docs.sparkSession):
        return written(docs.sparkSession, _near_duplicates(docs, percent, id_col, text_col), "forest-result", keep=True)


def _near_duplicates(docs: DataFrame, percent: int, id_col: str, text_col: str) -> DataFrame:
    spark = docs.sparkSession
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), utf8(text_col).alias("bytes"))
    every = written(spark, texts.mapInArrow(_signed(percent), SIG), "forest-sig")
    texts = texts.filter("doc_id is not null")
    sigs = every.filter("doc_id is not null and n > 0")
    split = _split(sigs, "forest-split")
    unit = F.coalesce("unit", "doc_id").alias("unit")
    named = sigs.select("doc_id", "digest").join(split, ["doc_id", "digest"], "left").select("digest", unit)
    members = with_least(named.distinct(), "digest", "unit").filter("least <> unit")
    members = written(spark, members.select(F.col("least").alias("a"), F.col("unit").alias("b")), "forest-members")
    plain = sigs.join(split.select("doc_id"), "doc_id", "left_anti").select("doc_id", "sig")
    units = plain.union(sigs.join(split, ["doc_id", "digest"]).select("unit", "sig"))
    reps = units.join(members.select(F.col("b").alias("doc_id")).distinct(), "doc_id", "left_anti").groupBy("doc_id").agg(F.first("sig").alias("sig"))

    keys = written(spark, reps.select("doc_id", "sig").mapInArrow(_first_keys(percent), "k long, doc long"), "forest-keys")
    dense = keys.groupBy("k").agg(F.count("*").alias("n")).filter("n > 1")
    live = written(spark, keys.join(dense, "k").groupBy("doc").agg(F.sum("n").alias("score")), "forest-live")
    rows = reps.join(live.withColumnRenamed("doc", "doc_id"), "doc_id").select("doc_id", "sig", "score").mapInArrow(_paths(percent), _PATHS)
    rows = written(spark, rows, "forest-paths")
    wanted = live.select(F.col("doc").alias("unit")).join(split.select("unit", F.col("doc_id").alias("of")), "unit", "left").select(F.coalesce("of", "unit").alias("doc_id"))
    sets = texts.join(wanted, "doc_id", "left_semi").select("doc_id", "bytes").mapInArrow(_sets, "doc_id long, digest binary, n long, items binary").filter("n > 0")
    sets = sets.groupBy("doc_id", "digest").agg(F.first("n").alias("n"), F.first("items").alias("items"))
    sets = written(spark, sets.join(split, ["doc_id", "digest"], "left").select(unit.alias("doc"), "n", "items"), "forest-sets")

    def pivots(k: str) -> DataFrame:
        best = rows.groupBy(k).agg(F.max_by("doc", F.struct("score", -F.col("doc"))).alias("b"), F.count("*").alias("n"))
        return rows.select(k, F.col("doc").alias("a")).join(best.filter("n > 1"), k).select("a", "b")

    first = pivots("k_least").union(pivots("k8")).union(pivots("k12")).distinct()
    links = written(spark, confirmed(first, sets, percent), "forest-links")
    groups = written(spark, components(spark, links), "forest-groups")
    small = keys.join(dense.filter(F.col("n") <= SMALL), "k").groupBy("k").agg(F.collect_list("doc").alias("docs"))
    small = small.select(F.explode("docs").alias("a"), "docs").select("a", F.explode("docs").alias("b")).filter("a < b")
    rest = neighbour_pairs(rows, shape(percent).least).union(small).distinct()
    for x in ("a", "b"):
        rest = rest.join(groups.toDF(x, f"g{x}"), x, "left").withColumn(f"g{x}", F.coalesce(f"g{x}", x))
    more = written(spark, confirmed(rest.filter("ga <> gb").select("a", "b"), sets, percent), "forest-more")

    links = links.union(more)
    groups = written(spark, components(spark, links), "forest-groups").toDF("doc", "g")
    held = keys.join(dense.filter(F.col("n") > SMALL).select("k"), "k").join(groups, "doc", "left").select("k", "doc", F.coalesce("g", "doc").alias("g"))
    mixed_up = held.groupBy("k").agg(F.min("g").alias("low"), F.max("g").alias("high")).filter("low <> high").select("k")
    held = written(spark, held.join(mixed_up, "k").select("doc", "g").distinct(), "forest-held")
    far = written(spark, confirmed(dense_pairs(sets.join(held, "doc").select("doc", "g", "n", "items"), percent), sets, percent), "forest-far")

    # texts of one doc_id are linked, and a component has the smallest of its documents, not of its units
    together = split.join(split.groupBy("doc_id").agg(F.min("unit").alias("a")), "doc_id").select("a", F.col("unit").alias("b"))
    found = written(spark, components(spark, members.union(links).union(far).union(together)), "forest-found")
    ids = found.join(split.select("unit", "doc_id"), found["id"] == split["unit"], "left").select("component", F.coalesce("doc_id", "id").alias("doc_id"), F.col("doc_id").isNotNull().alias("odd"))
    least = ids.groupBy("component").agg(F.min("doc_id").alias("least"), F.max("odd").alias("odd")).filter("odd").select("component", "least")
    found = ids.join(least, "component", "left").select("doc_id", F.coalesce("least", "component").alias("component")).distinct()
    each = every.filter("doc_id is not null").groupBy("doc_id").agg(F.max("n").alias("n_shingles"))
    out = each.join(found, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
    nameless = every.filter("doc_id is null").select("doc_id", F.col("n").alias("n_shingles"), F.lit(None).cast("long").alias("component_id"))
    return out.union(nameless).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op8_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of near-equal texts of ``documents`` at 0.85."""
    return near_duplicates(table(spark, sf_dir, "documents"), 85)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similarity 0.8 or more stays, that with the smallest id.

    Rows with a null id are nobody's copies and stay. Of rows that repeat both id and text one stays, that whose columns
    as JSON are the least; rows that share an id with different texts stay or go together.
    """
    kept = near_duplicates(docs, 80).filter("kept and doc_id is not null").select("doc_id")
    again = docs.filter("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id")
    named = docs.join(kept, "doc_id", "left_semi")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    repeated = named.join(again, "doc_id", "left_semi").groupBy("doc_id", F.md5(utf8("text")), F.col("text").isNull())
    repeated = repeated.agg(F.min_by(row, F.to_json(row)).alias("row")).select("row.*")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    return named.join(again, "doc_id", "left_anti").select(*columns).union(repeated).union(docs.filter("doc_id is null"))
