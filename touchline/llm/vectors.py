"""Near-equal embeddings by collision counting on one-dimensional projections.

Unit vectors are projected on ``LINES`` fixed random directions. Vectors whose cosine is at least ``c`` are at most
sqrt(2 - 2c) apart, so on most lines they fall into each other's window. The width of the windows is two deviations of
such a distance's projection, and ``collisions_needed`` is calibrated so that a pair at the limit fails it with
probability ``MISS`` at most. Pairs that pass are verified in double precision; only those are linked.

Rows that equal each other are one class with a multiplicity. The classes of a label are sorted along a curve through
their first ``BOX`` projections, bit by bit in turn, and cut into cells of ``CELL``; two cells meet only if their ranges on
each of these lines are close enough for a pair that isn't missed. In a meeting, windows are counted line by line over the
sorted projections; once so many lines are counted that few pairs can still reach the count, only those are looked at.
What comes out are counts of links and the edges of a spanning forest, never the pairs: its rows are as many as the
cells' vectors. Single lines part vectors of many dimensions only weakly, so the meetings of a very large label still grow
faster than its rows.

Defined results: vectors that are null, empty, zero or hold null or non-finite values, and rows with a null label, have
no links and are a component each; vectors of other lengths than each other don't link; rows that repeat vec_id count as
vectors each and are then summed up by id; a null vec_id is left out; an empty table gives no rows. Only id, vector and
label are read, so other columns can't clash.
"""

from __future__ import annotations

from functools import cache
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.operators.lineage import workspace, written

from .common import components, table

LINES, CELL, MISS, WIDTH = 48, 1024, 1e-9, 2.0
#: Lines that cells are boxes on, and bits of each that the curve goes by.
BOX, CURVE_BITS = 4, 15
COSINE = 0.98


@cache
def directions(dim: int) -> np.ndarray:
    """``LINES`` unit directions, the same on every machine."""
    d = np.random.Generator(np.random.PCG64(dim)).standard_normal((LINES, dim))
    return d / np.linalg.norm(d, axis=1, keepdims=True)


@cache
def collisions_needed(dim: int, miss: float = MISS) -> int:
    """The largest count of lines that a pair at the limit collides on with probability 1 - ``miss`` at least."""
    u = np.random.Generator(np.random.PCG64(1)).standard_normal((200_000, min(dim, 64)))
    p = float((np.abs(u[:, 0]) / np.linalg.norm(u, axis=1) <= WIDTH / np.sqrt(min(dim, 64))).mean())
    p, below = min(p, 1 - 1e-6), 0.0
    for k in range(LINES + 1):
        below += comb(LINES, k) * p**k * (1 - p) ** (LINES - k)
        if below > miss:
            return k
    return LINES


_UNIT = pa.schema([("label", pa.int64()), ("dim", pa.int32()), ("curve", pa.int64()), ("vec", pa.binary()), ("lines", pa.list_(pa.float64())), ("id", pa.int64())])
UNIT = "label long, dim int, curve long, vec binary, lines array<double>, id long"


def curve(lines: np.ndarray) -> int:
    """The place of projections, each from -1 to 1, on a curve that takes a bit of each in turn."""
    at = np.clip((lines + 1) * 2 ** (CURVE_BITS - 1), 0, 2**CURVE_BITS - 1).astype("i8").tolist()
    out = 0
    for b in range(CURVE_BITS - 1, -1, -1):
        for x in at:
            out = out << 1 | (x >> b & 1)
    return out


def _measured(it):
    """Valid vectors as bytes, with their places on the first lines and on the curve."""
    for batch in it:
        rows = []
        for i, v, label in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
            if v is None or label is None or not v or any(x is None for x in v):
                continue
            x = np.array(v, "f8")
            norm = float(np.sqrt(x @ x))
            if not np.isfinite(x).all() or not np.isfinite(norm) or norm == 0:
                continue
            lines = directions(len(x))[:BOX] @ x / norm
            rows.append((label, len(x), curve(lines), (x + 0.0).tobytes(), lines, i))
        if rows:
            yield pa.record_batch([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), _UNIT, strict=True)], schema=_UNIT)


_CELL = pa.schema([("cell", pa.int64()), ("label", pa.int64()), ("dim", pa.int32()), ("low", pa.list_(pa.float64())), ("high", pa.list_(pa.float64())), ("ids", pa.list_(pa.int64())), ("vecs", pa.binary()), ("weights", pa.list_(pa.int64()))])
CELLS = "cell long, label long, dim int, low array<double>, high array<double>, ids array<long>, vecs binary, weights array<long>"


def _in_cells(most: int):
    """From classes sorted by (label, dim, curve), cells of ``most`` rows of one label, numbered within the task."""

    def run(it):
        from pyspark import TaskContext

        number, held, key = TaskContext.get().partitionId() << 32, [], None

        def cell():
            ids, vecs, lines, weights = (list(x) for x in zip(*held, strict=True))
            lines = np.array(lines)
            cols = [number, *key, lines.min(0), lines.max(0), ids, b"".join(vecs), weights]
            return pa.record_batch([pa.array([x], t.type) for x, t in zip(cols, _CELL, strict=True)], schema=_CELL)

        for batch in it:
            for label, dim, lines, i, v, w in zip(*(batch.column(c).to_pylist() for c in range(6)), strict=True):
                if held and ((label, dim) != key or len(held) == most):
                    yield cell()
                    number, held = number + 1, []
                key = (label, dim)
                held.append((i, v, lines, w))
        if held:
            yield cell()

    return run


def collided(a: np.ndarray, b: np.ndarray, width: float, need: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows (i of ``a``, j of ``b``) that fall into each other's window on ``need`` lines at least; both are projections.

    Line by line, the window around each row of ``a`` is a run of the sorted ``b``. A pair that has missed too many lines
    can't reach the count, so once few others are left, the remaining lines are looked at for them alone.
    """
    lines = a.shape[1]
    missed = lines - need
    count = np.zeros((len(a), len(b)), "u1")
    rows = np.arange(len(a))
    for k in range(lines):
        o = np.argsort(b[:, k])
        low, high = (np.searchsorted(b[o, k], a[:, k] + s, side) for s, side in ((-width, "left"), (width, "right")))
        edge = np.zeros((len(a), len(b) + 1), "i1")
        edge[rows, low] += 1
        edge[rows, high] -= 1
        at = np.empty(len(b), "i8")
        at[o] = np.arange(len(b))
        count += np.take(np.cumsum(edge, axis=1, dtype="i1"), at, axis=1).view("u1")
        if k >= missed and k % 4 == 3 or k == lines - 1:
            i, j = np.nonzero(count >= k + 1 - missed) if k + 1 > missed else np.nonzero(count >= 0)
            if len(i) * 16 <= count.size or k == lines - 1:
                break
    n = count[i, j].astype("i4")
    for k in range(k + 1, lines):
        n += np.abs(a[i, k] - b[j, k]) <= width
        left = n >= k + 1 - missed
        i, j, n = i[left], j[left], n[left]
    return i, j


_MET = pa.schema([("id", pa.int64()), ("links", pa.int64()), ("to", pa.int64())])


def _met(cosine: float):
    def run(it):
        for batch in it:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                dim, same = row["dim"], row["cell"] == row["cell2"]
                x, y = (np.frombuffer(row[c], "f8").reshape(-1, dim) for c in ("vecs", "vecs2"))
                nx, ny = np.sqrt((x * x).sum(1)), np.sqrt((y * y).sum(1))
                d = directions(dim)
                px, py = x @ d.T / nx[:, None], y @ d.T / ny[:, None]
                width = WIDTH * np.sqrt((2 - 2 * cosine) / dim) * (1 + 1e-9)
                need = collisions_needed(dim)
                i, j = collided(px, py, width, need)
                if same:
                    i, j = i[i < j], j[i < j]
                sure = np.concatenate([np.einsum("ij,ij->i", x[i[k : k + 65536]], y[j[k : k + 65536]]) / (nx[i[k : k + 65536]] * ny[j[k : k + 65536]]) >= cosine for k in range(0, max(1, len(i)), 65536)])
                i, j = i[sure], j[sure]
                if not len(i):
                    continue
                wx, wy = (np.array(row[c], "i8") for c in ("weights", "weights2"))
                ids = np.r_[np.array(row["ids"], "i8"), np.array(row["ids2"], "i8")]
                links = np.r_[np.bincount(i, wy[j], len(x)), np.bincount(j, wx[i], len(y))].astype("i8")
                top = np.arange(len(ids))  # both ends of each link take the smaller root until nothing changes
                a, b = i, j + len(x)
                while True:
                    low = np.minimum(top[a], top[b])
                    new = top.copy()
                    np.minimum.at(new, a, low)
                    np.minimum.at(new, b, low)
                    new = new[new]
                    if (new == top).all():
                        break
                    top = new
                some = np.flatnonzero(links)
                yield pa.record_batch([pa.array(ids[some]), pa.array(links[some]), pa.array(ids[top[some]])], schema=_MET)

    return run


def meetings(cells: DataFrame, cosine: float) -> DataFrame:
    """(cell, cell2) of cells of one label that may hold a near pair, each with itself, no pair twice."""
    # a pair further apart on one line than this has, at the limit, probability 1e-9: 6.1 deviations of its projection
    reach = F.least(F.lit(6.1 * float(np.sqrt(2 - 2 * cosine))) / F.sqrt("dim"), F.lit(float(np.sqrt(2 - 2 * cosine)))) * (1 + 1e-9)
    other = cells.select(*[F.col(c).alias(f"{c}2" if c not in ("label", "dim") else c) for c in cells.columns])
    slots = lambda side, k, more: F.explode(F.sequence(F.floor(F.col(f"low{side}")[k] / reach) - more, F.floor(F.col(f"high{side}")[k] / reach) + more))
    index, other_index = cells.select("cell", "label", "dim", "low", "high"), other.select("cell2", "label", "dim", "low2", "high2")
    for k in (0, 1):  # slots as wide as the reach, on two lines, make it an equi-join; all lines are looked at then
        index = index.withColumn(f"slot{k}", slots("", k, 0))
        other_index = other_index.withColumn(f"slot{k}", slots("2", k, 1))
    near = F.col("cell") <= F.col("cell2")
    for k in range(BOX):
        near &= (F.col("low2")[k] <= F.col("high")[k] + reach) & (F.col("high2")[k] >= F.col("low")[k] - reach)
    return index.join(other_index, ["label", "dim", "slot0", "slot1"]).filter(near).select("cell", "cell2").distinct()


def near_vectors(rows: DataFrame, cosine: float = COSINE, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept) of each vector; see the module's text."""
    with workspace(rows.sparkSession):
        return written(rows.sparkSession, _near_vectors(rows, cosine, id_col, vec_col, label_col), "vectors-result", keep=True)


def _near_vectors(rows: DataFrame, cosine: float, id_col: str, vec_col: str, label_col: str) -> DataFrame:
    spark = rows.sparkSession
    rows = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v"), F.col(label_col).cast("long").alias("label")).filter("id is not null")
    valid = written(spark, rows.mapInArrow(_measured, UNIT), "vectors-valid")
    same = ["label", "dim", "curve", "vec", "lines"]
    classes = written(spark, valid.groupBy(*same).agg(F.min("id").alias("rep"), F.count("*").alias("n")), "vectors-classes")
    members = written(spark, valid.join(classes.filter("n > 1"), same).select("id", "rep", "n"), "vectors-members")

    order = ["label", "dim", "curve", "rep"]
    in_order = classes.select("label", "dim", "lines", "rep", "vec", "n", "curve").repartitionByRange(*order).sortWithinPartitions(*order)
    cells = written(spark, in_order.mapInArrow(_in_cells(CELL), CELLS), "vectors-cells")
    close, other = meetings(cells, cosine), cells.select(*[F.col(c).alias(f"{c}2") for c in cells.columns])
    meet = close.repartition("cell", "cell2").join(cells.select("cell", "dim", "ids", "vecs", "weights"), "cell").join(other.select("cell2", "ids2", "vecs2", "weights2"), "cell2")
    met = written(spark, meet.mapInArrow(_met(cosine), "id long, links long, to long"), "vectors-met")

    # rows of one class link with each other, and each with all that its class links with
    per_class = met.groupBy("id").agg(F.sum("links").alias("links"))
    of_row = rows.select("id").join(members, "id", "left").select("id", F.coalesce("rep", "id").alias("rep"), F.coalesce("n", F.lit(1)).alias("n"))
    of_row = of_row.join(per_class.withColumnRenamed("id", "rep"), "rep", "left").groupBy("id").agg(F.max(F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"))
    edges = met.select(F.col("id").alias("a"), F.col("to").alias("b")).union(members.select("rep", "id"))
    found = components(spark, edges.filter("a <> b"))
    out = of_row.join(found, "id", "left").select(F.col("id").alias("vec_id"), F.col("n_links").cast("long"), F.coalesce("component", "id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))


def op5_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of ``embeddings`` at cosine 0.98."""
    return near_vectors(table(spark, sf_dir, "embeddings"))
