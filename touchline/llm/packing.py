"""Best-fit packing into sequences of several permitted lengths.

Texts longer than the greatest length are split; the pieces are dealt by hash into shards of bounded size, and each
shard is packed by itself. Within a shard pieces go, longest first, to the open bin that they fill best. Where none
fits, a bin is opened, of the size that costs least for a token: each permitted length that holds the piece is filled in
thought with the longest pieces still to come that fit, and downsized. In the end every bin is downsized to the smallest
permitted length that holds its contents. A bin costs its length plus ``BIN_COST`` tokens. The shard is also packed with
one least size for all bins, for each permitted length, and the cheapest packing stays.

Defined results: a null or empty text has no tokens and one row without a bin (capacity 0); rows that repeat are packed
one by one; an empty table packs nothing. Only the id and the text are read, so other columns can't clash.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.operators.lineage import written

from .common import table, total

CAPACITIES = (512, 1024, 2048, 4096, 8192)
BIN_COST = 16
SHARD_ROWS = 50_000


def word_count(text_col: str = "text") -> Column:
    """Tokens of a text: its runs of other than white space."""
    return F.regexp_count(F.coalesce(F.col(f"`{text_col}`"), F.lit("")), F.lit(r"\S+")).cast("long")


def cheapest(lengths: list[int], k: int, sums: list[int], capacities: tuple[int, ...]) -> int:
    """The size to open for piece ``k`` of decreasing ``lengths``: the least cost a token, smaller sizes first.

    ``sums`` are running sums, so a run of pieces that fit one after another is found at once.
    """
    best = (float("inf"), 0)
    for c in capacities[bisect_left(capacities, lengths[k]) :]:
        fill, at = lengths[k], k + 1
        while at < len(lengths) and fill < c:
            at = bisect_left(lengths, fill - c, at, key=lambda n: -n)  # the first piece that fits into what is left
            last = bisect_right(sums, sums[at] + c - fill, at) - 1
            if last <= at:
                break
            fill += sums[last] - sums[at]
            at = last
        held = capacities[bisect_left(capacities, fill)]
        best = min(best, ((held + BIN_COST) / fill, c))
    return best[1]


def best_fit(lengths: np.ndarray, capacities: tuple[int, ...], least: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each length, by best fit in the given (decreasing) order.

    A new bin has the cheapest size, or the smallest permitted one that is at least ``least`` and holds the piece.
    """
    bins, offsets = np.empty(len(lengths), "i8"), np.empty(len(lengths), "i8")
    sums, sizes = [0, *np.cumsum(lengths).tolist()], lengths.tolist()
    free: dict[int, list[int]] = {}
    rooms: list[int] = []
    fill: list[int] = []
    for k, n in enumerate(sizes):
        at = bisect_left(rooms, n)
        if at < len(rooms):
            room = rooms[at]
            b = free[room].pop()
            if not free[room]:
                del free[room], rooms[at]
        else:
            room = capacities[bisect_left(capacities, max(n, least))] if least else cheapest(sizes, k, sums, capacities)
            b = len(fill)
            fill.append(0)
        bins[k], offsets[k] = b, fill[b]
        fill[b] += n
        if room > n:
            if room - n not in free:
                free[room - n] = []
                insort(rooms, room - n)
            free[room - n].append(b)
    return bins, offsets


def pack_jointly(lengths: np.ndarray, capacities: tuple[int, ...] = CAPACITIES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin, offset, capacity) of each length: the cheapest packing, bins downsized."""
    order = np.argsort(-lengths, kind="stable")
    caps, best = np.array(capacities), None
    for least in (0, *capacities):
        bins, offsets = best_fit(lengths[order], capacities, least)
        fill = np.bincount(bins, lengths[order])
        size = caps[np.searchsorted(caps, fill)]
        cost = size.sum() + BIN_COST * len(size)
        if best is None or cost < best[0]:
            best = (cost, bins, offsets, size)
    out = np.empty((3, len(lengths)), "i8")
    out[:, order] = best[1], best[2], best[3][best[1]]
    return out[0], out[1], out[2]


_OUT = "doc_id long, piece int, start long, n_tokens long, bin_id string, bin_offset long, capacity int"


def _packer(capacities: tuple[int, ...]):
    def run(shard: pa.Table) -> pa.Table:
        shard = shard.sort_by([("doc_id", "ascending"), ("piece", "ascending"), ("n_tokens", "ascending")])
        n = shard["n_tokens"].to_numpy()
        bins, offsets, caps = pack_jointly(n, capacities)
        number = shard["shard"][0].as_py()
        return pa.table({"doc_id": shard["doc_id"], "piece": shard["piece"], "start": shard["start"], "n_tokens": shard["n_tokens"], "bin_id": pa.array([f"{number}-{b}" for b in bins.tolist()]), "bin_offset": pa.array(offsets), "capacity": pa.array(caps.astype("i4"))})

    return run


def pack(docs: DataFrame, length: Column | None = None, capacities: tuple[int, ...] = CAPACITIES, id_col: str = "doc_id", shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(doc_id, piece, start, n_tokens, bin_id, bin_offset, capacity): a row for each piece of each row.

    The count of shards follows the count of pieces, so a shard has ``shard_rows`` pieces or so at any size, and a hot
    source or id is spread over all of them. At most the last bin of each size in a shard is poorly filled.
    """
    capacities = tuple(sorted(capacities))
    most = capacities[-1]
    n = word_count() if length is None else length
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), n.alias("n"))
    rows = written(docs.sparkSession, rows, "pack-lengths", keep=True)  # texts are looked at once
    shards = max(1, -(-total(rows, F.ceil(F.col("n") / most)) // shard_rows))
    pieces = rows.filter("n > 0").select("doc_id", "n", F.posexplode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(most).cast("long"))).alias("piece", "start"))
    pieces = pieces.select("doc_id", "piece", "start", F.least(F.lit(most), F.col("n") - F.col("start")).cast("long").alias("n_tokens"))
    pieces = pieces.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", "n_tokens"), F.lit(shards)).cast("int"))
    packed = pieces.groupBy("shard").applyInArrow(_packer(capacities), _OUT)
    none = rows.filter("n = 0").select("doc_id", F.lit(0).alias("piece"), F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("n_tokens"), F.lit(None).cast("string").alias("bin_id"), F.lit(0).cast("long").alias("bin_offset"), F.lit(0).alias("capacity"))
    return packed.unionByName(none)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every text of ``documents`` with its place."""
    return pack(table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what the stages before have kept."""
    return pack(docs)
