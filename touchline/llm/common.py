"""What the operators of this package share: tables, scratch folders, components."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.operators.lineage import written

#: Parts that the rows of one key are summed up in before they meet.
SALTS = 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_least(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Those ``rows`` whose ``key`` others have too, with ``least``: the smallest ``value`` of the key.

    Keys are summed up in ``SALTS`` parts of their rows first, and the parts meet instead of the rows, so a key that a
    third of all rows share is dealt over as many tasks.
    """
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(value), F.lit(SALTS)))
    parts = salted.groupBy(key, "_salt").agg(F.min(value).alias("_low"), F.count("*").alias("_n"))
    keys = parts.groupBy(key).agg(F.min("_low").alias("least"), F.sum("_n").alias("_n")).filter("_n > 1")
    return salted.join(parts.drop("_low", "_n").join(keys.drop("_n"), key), [key, "_salt"]).drop("_salt")


def total(df: DataFrame, expr) -> int:
    """One number over a whole table, 0 for an empty one."""
    return int(df.agg(F.coalesce(F.sum(expr), F.lit(0)).alias("n")).first()["n"])


def utf8(col: str):
    """A text as UTF-8 bytes; null is empty."""
    return F.encode(F.coalesce(F.col(col), F.lit("")), "utf-8")


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, or with ``_`` added until no column of ``df`` has the name."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def like(out: DataFrame, docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``out`` with the columns of ``docs``, in their order; ``n_chars``, where there is one, counts the text it has now."""
    cols = {"n_chars": F.char_length(text_col).cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {}
    return out.withColumns(cols).select(*[F.col(f"`{c}`") for c in docs.columns])


def batches(rows: dict, schema: pa.Schema, size: int = 4096):
    """A dict of equally long lists as Arrow batches of at most ``size`` rows."""
    n = len(next(iter(rows.values())))
    for i in range(0, n, size):
        yield pa.record_batch([pa.array(v[i : i + size], type=t.type) for v, t in zip(rows.values(), schema, strict=True)], schema=schema)


def _forest(it):
    """Edges of a partition, less those that close a cycle within it."""
    top: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while (up := top.get(root, root)) != root:
            root = up
        while (up := top.get(x, x)) != root:
            top[x] = root
            x = up
        return root

    for batch in it:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if (x := find(a)) != (y := find(b)):
                top[max(x, y)] = min(x, y)
    ids = list(top)
    if ids:
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
        yield from batches({"a": [find(x) for x in ids], "b": ids}, schema, 65536)


def components(spark: SparkSession, edges: DataFrame, name: str = "components") -> DataFrame:
    """(id, component) for each id in ``edges`` (a, b: non-null longs); component is the smallest id reachable.

    Every partition first replaces its edges by stars (same reachability, at most one edge an id). Then
    large-star and small-star steps alternate (Kiveris et al., 2014) until the edges are stars. A hub's edges
    meet its minimum in a join that adaptive execution can split; no neighbourhood is gathered in one row.
    Empty ``edges`` give an empty result. Self-loops and repeated edges change nothing.
    """
    e = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b")
    e = e.mapInArrow(_forest, "a long, b long")
    e = written(spark, e.distinct(), name)
    seen = None
    while True:
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).toDF("u", "v")
        low = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("m").alias("a"), F.col("v").alias("b"))
        large = large.filter("a <> b").distinct()
        low = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(low, "b").select(F.col("m"), F.explode(F.array("a", "b")).alias("x"))
        e = written(spark, small.filter("x <> m").select(F.col("m").alias("a"), F.col("x").alias("b")).distinct(), name)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.countDistinct("b")).first()
        if now == seen or now[0] == 0:
            break
        seen = now
    return e.groupBy(F.col("b").alias("id")).agg(F.min("a").alias("component")).union(e.select("a", "a").distinct())
