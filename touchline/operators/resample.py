"""Seeded resampling: how often a replicate takes a cluster is a rule of both, so any engine replays it.

Clusters are summed up first. A replicate takes each of them a Poisson number of times, as often as drawing with
replacement does in the limit of many clusters; so it needs no join, and what it keeps are sums that are combined before
the shuffle.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut

P = 2147483647


def draw(r: Column, k: Column, n: Column) -> Column:
    """An index below ``n`` for slot ``k`` of replicate ``r``."""
    x = (r.cast("long") * 1103515245 + k.cast("long") * 12345677 + 20260821) % P
    y = (x * x + 1013904223) % P
    z = (y * y + 362437069) % P
    return F.call_function("div", z, F.lit(97).cast("long")) % n


def draw_sql(r: str, k: str, n: str) -> str:
    x = f"((cast({r} as bigint) * 1103515245 + cast({k} as bigint) * 12345677 + 20260821) % {P})"
    y = f"(({x} * {x} + 1013904223) % {P})"
    return f"(((({y} * {y} + 362437069) % {P}) // 97) % {n})"


UNITS = 1_000_000


def _thresholds(rate: float) -> list[int]:
    """The Poisson distribution function in ``UNITS``, up to where it is 1."""
    out, p, total, k = [], math.exp(-rate), 0.0, 0
    while not out or out[-1] < UNITS:
        total += p
        out.append(round(total * UNITS))
        k += 1
        p *= rate / k
    return out


def times(r: Column, k: Column, rate: float = 1.0) -> Column:
    """How often replicate ``r`` takes cluster ``k``."""
    u, out = draw(r, k, F.lit(UNITS)), F.lit(0)
    for n, bound in enumerate(_thresholds(rate)[:-1]):
        out = F.when(u >= bound, n + 1).otherwise(out)
    return out


def with_times(df: DataFrame, r: str, k: str, name: str, rate: float = 1.0) -> DataFrame:
    """``df`` with ``times`` as a column. Each step of the draw is a column of its own, so that it is worked out once a row."""
    x, y = F.col("_x"), F.col("_y")
    d = df.withColumn("_x", (F.col(r).cast("long") * 1103515245 + F.col(k).cast("long") * 12345677 + 20260821) % P)
    d = d.withColumn("_y", (x * x + 1013904223) % P)
    z = (y * y + 362437069) % P
    d = d.withColumn("_u", F.call_function("div", z, F.lit(97).cast("long")) % UNITS)
    bounds = _thresholds(rate)[:-1]
    out = F.when(F.col("_u") < bounds[0], 0)
    for n, bound in enumerate(bounds[1:]):
        out = out.when(F.col("_u") < bound, n + 1)
    return d.withColumn(name, F.when(F.col("_u").isNotNull(), out.otherwise(len(bounds))).otherwise(0)).drop("_x", "_y", "_u")


def times_sql(r: str, k: str, rate: float = 1.0) -> str:
    bounds = _thresholds(rate)[:-1]
    whens = " ".join(f"when u >= {b} then {n + 1}" for n, b in reversed(list(enumerate(bounds))))
    return f"(select case {whens} else 0 end from (select {draw_sql(r, k, str(UNITS))} u))"


def numbered(df: DataFrame, *order: str) -> DataFrame:
    """``df`` with ``i`` from 0 in the given order, and ``n``, the count of all rows.

    Rows are dealt by ranges and written, so that a second reading finds them in the same part; ranks are taken within
    parts and raised by the counts of the parts before. Only the counts of parts are in one task.
    """
    d = cut(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "numbered")
    parts = d.groupBy("_part").agg(F.count("*").alias("_k"))
    before = F.coalesce(F.sum("_k").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("_part", before.alias("_before"), F.sum("_k").over(Window.partitionBy()).alias("n"))
    rank = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return d.withColumn("_r", rank).join(F.broadcast(parts), "_part").withColumn("i", F.col("_before") + F.col("_r") - 1).drop("_part", "_r", "_before")


def prefix_sums(df: DataFrame, i: str, value: str, chunk: int = 4096) -> DataFrame:
    """``df`` with ``c``, the sum of ``value`` up to and with row ``i``: sums of chunks first, then within chunks."""
    d = df.withColumn("_chunk", F.floor(F.col(i) / chunk))
    sums = d.groupBy("_chunk").agg(F.sum(value).alias("_s"))
    sums = sums.select("_chunk", F.coalesce(F.sum("_s").over(Window.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("_before"))
    inside = F.sum(value).over(Window.partitionBy("_chunk").orderBy(i))
    return d.withColumn("_in", inside).join(sums, "_chunk").withColumn("c", F.col("_before") + F.col("_in")).drop("_chunk", "_in", "_before")


def bootstrap(clusters: DataFrame, key: str, reps: int, rate: float = 1.0) -> DataFrame:
    """(r, v): the mean of each of ``reps`` resamples of clusters with (s, m): sum and count."""
    each = clusters.select("s", "m", F.col(key).cast("long").alias("k"), F.explode(F.sequence(F.lit(0), F.lit(reps - 1))).alias("r"))
    each = with_times(each, "r", "k", "w", rate).withColumn("w", F.when(F.col("w") > 0, F.col("w")))
    # rows that aren't taken stay in, as nulls: a filter would be pushed below the columns and work out all of them again
    v = each.groupBy("r").agg(F.sum(F.col("s") * F.col("w")).alias("s"), F.sum(F.col("m") * F.col("w")).alias("m"), F.count("w").alias("n"))
    return v.filter("n > 0").select("r", (F.col("s") / F.col("m")).alias("v"))


def bootstrap_mean(clusters: DataFrame, key: str, reps: int, rate: float = 1.0) -> DataFrame:
    """One row: mean, and the 2.5 and 97.5 percentiles of ``bootstrap``."""
    ends = bootstrap(clusters, key, reps, rate).agg(F.percentile("v", F.array(F.lit(0.025), F.lit(0.975))).alias("p"))
    return clusters.agg((F.sum("s") / F.sum("m")).alias("mean")).join(F.broadcast(ends)).select("mean", F.col("p")[0].alias("lo"), F.col("p")[1].alias("hi"))


def moving_blocks(rows: DataFrame, order: str, value: str, length: int = 21) -> DataFrame:
    """(k, s, m): sum and count of each run of ``length`` rows in order. Prefix sums make a run a difference of two rows."""
    x = numbered(rows.select(order, value), order).select("i", value)
    c = prefix_sums(x, "i", value)
    ends = c.select((F.col("i") - (length - 1)).alias("i"), F.col("c").alias("_z"))
    return c.join(ends, "i").select(F.col("i").alias("k"), (F.col("_z") - F.col("c") + F.col(value)).alias("s"), F.lit(length).alias("m"))


def ranked(df: DataFrame, group: str, *order: str) -> DataFrame:
    """``df`` with ``r``, from 0 in the given order within its group, and ``n``, the group's count of rows.

    All rows are numbered by ranges of (group, order), so a large group is sorted in many tasks; a group's first number is
    taken off.
    """
    d = numbered(df, group, *order).drop("n")
    first = d.groupBy(group).agg(F.min("i").alias("_first"), F.count("*").alias("n"))
    return d.join(first, group).withColumn("r", F.col("i") - F.col("_first")).drop("i", "_first")


def weighted_quantiles(counts: DataFrame, keys: list[str], value: str, n: str, **ranks: float) -> DataFrame:
    """(keys, ranks): for each named rank the least ``value`` that so large a share of the rows of its keys doesn't exceed.

    A row of ``counts`` stands for ``n`` rows; null values don't count. Rows are dealt by ranges of (keys, value) and running
    sums of parts are raised by those of the parts before, so a large group is sorted in many tasks.
    """
    d = counts.withColumn("_w", F.when(F.col(value).isNotNull(), F.col(n)).otherwise(0).cast("long"))
    d = cut(d.select(*keys, value, "_w").repartitionByRange(*keys, value).withColumn("_part", F.spark_partition_id()), "quantiles")
    parts = d.groupBy("_part").agg(F.sum("_w").alias("_k"))
    before = F.coalesce(F.sum("_k").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.sum("_w").over(Window.partitionBy("_part").orderBy(*keys, value).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    d = d.withColumn("_c", inside).join(F.broadcast(parts.select("_part", before.alias("_before"))), "_part").withColumn("_c", F.col("_c") + F.col("_before"))
    first = d.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.min(F.col("_c") - F.col("_w")).alias("_first"), F.sum("_w").alias("_n"))
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    d = d.join(first, same)
    rank = {c: F.greatest(F.lit(1), F.col("_n") - F.floor(F.col("_n") - F.lit(float(q)) * F.col("_n"))) for c, q in ranks.items()}
    return d.groupBy(*keys).agg(*[F.min(F.when(F.col("_c") - F.col("_first") >= r, F.col(value))).alias(c) for c, r in rank.items()])
