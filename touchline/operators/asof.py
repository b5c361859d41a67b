"""As-of joins and point-in-time reads. Every bound says whether it includes its instant; none looks ahead."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut


def latest(df: DataFrame, keys: list[str], value: list[str], order: list[str], where: Column | None = None, earliest: bool = False) -> DataFrame:
    """One row a key: ``value`` of the last (or first) row by ``order``. Summed up before the shuffle, so no hot key sorts."""
    df = df if where is None else df.filter(where)
    best = F.min if earliest else F.max
    got = best(F.struct(*order, *value)).alias("_best")
    return df.groupBy(*keys).agg(got).select(*keys, *[F.col(f"_best.{c}").alias(c) for c in [*order, *value]])


def as_known_at(obs: DataFrame, instant: Column, keys: list[str], order: list[str]) -> DataFrame:
    """Rows as they were known at ``instant``: published and ingested by then, the newest version of each key."""
    seen = (F.col("published_at") <= instant) & (F.col("ingested_at") <= instant)
    rest = [c for c in obs.columns if c not in (*keys, *order)]
    return latest(obs, keys, rest, order, seen).select(*obs.columns)


def as_of(left: DataFrame, right: DataFrame, keys: list[str], left_at: str, right_at: str, values: list[str], order: list[str] = (), inclusive: bool = False) -> DataFrame:
    """``left`` with ``values`` of the last right row of equal keys before ``left_at``, or at it if ``inclusive``.

    Rows of ``right`` at one instant go by ``order``. A left row without one, or with a null key or instant, gets nulls; right
    rows with a null key or instant are nobody's. Both sides are merged in one sort by ranges of (keys, instant), so a hot
    key is in many tasks. Within a range the last value is carried on by a window; a range that begins within a key gets
    what the ranges before have seen of it. Such keys are fewer than ranges, so only they are broadcast.
    """
    ks = [f"_k{i}" for i in range(len(keys))]
    sort = [*ks, "_at", "_kind", *(f"_o{i}" for i in range(len(order)))]
    types = [right.schema[c].dataType for c in order]
    l = left.select(*[F.col(k).alias(a) for k, a in zip(keys, ks, strict=True)], F.col(left_at).alias("_at"), F.lit(int(inclusive)).alias("_kind"), *[F.lit(None).cast(t).alias(f"_o{i}") for i, t in enumerate(types)], F.struct(*[F.col(f"`{c}`") for c in left.columns]).alias("_row"))
    r = right.dropna(subset=[*keys, right_at]).select(*[F.col(k).alias(a) for k, a in zip(keys, ks, strict=True)], F.col(right_at).alias("_at"), F.lit(1 - int(inclusive)).alias("_kind"), *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)], F.struct(*[F.col(f"`{c}`") for c in values]).alias("_value"))
    both = l.unionByName(r, allowMissingColumns=True).repartitionByRange(*sort).withColumn("_part", F.spark_partition_id())
    both = cut(both, "as-of")
    w = Window.partitionBy("_part", *ks).orderBy("_at", "_kind", *sort[len(ks) + 2 :]).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    parts = both.groupBy(*ks, "_part").agg(F.max(F.when(F.col("_value").isNotNull(), F.struct("_at", *sort[len(ks) + 2 :], "_value"))).alias("_last"))
    spread = parts.groupBy(*ks).agg(F.min("_part").alias("_a"), F.max("_part").alias("_b")).filter("_a < _b").drop("_a", "_b")
    earlier = Window.partitionBy(*ks).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = parts.join(spread, ks).select(*ks, "_part", F.last("_last._value", ignorenulls=True).over(earlier).alias("_carried"))
    got = both.withColumn("_seen", F.last("_value", ignorenulls=True).over(w)).filter("_row is not null").join(F.broadcast(carried), [*ks, "_part"], "left")
    got = got.withColumn("_seen", F.when(F.col("_at").isNotNull(), F.coalesce("_seen", "_carried")))
    return got.select("_row.*", *[F.col(f"_seen.`{c}`").alias(c) for c in values])


def nearest_dates(left: DataFrame, right: DataFrame, keys: list[str], left_date: str, right_date: str, days: int, tie: str) -> DataFrame:
    """(keys, left_date, gap, columns of right): for each key and date of ``left`` the right row of equal keys whose date is
    nearest, within ``days``; ties go to the smallest ``tie``.

    Of the right rows of a key and date only that with the smallest ``tie`` can be nearest, and left rows of a key and date
    have the same one, so dates meet dates: what is joined follows keys and dates, however many rows share them. Dates fall
    into slots of ``days`` + 1 days; a right one is in its own slot and the two beside, so that is an equi-join.
    """
    width = days + 1
    slot = F.floor(F.datediff(F.col(left_date), F.lit("1970-01-01").cast("date")) / width)
    own = F.floor(F.datediff(F.col(right_date), F.lit("1970-01-01").cast("date")) / width)
    theirs = [c for c in right.columns if c not in (*keys, tie)]
    first = F.min(F.struct(tie, *[c for c in theirs if c != right_date])).alias("_best")
    r = right.groupBy(*keys, right_date).agg(first).select(*keys, right_date, "_best.*").withColumn("_slot", F.explode(F.array(own - 1, own, own + 1)))
    pairs = left.select(*keys, left_date).distinct().withColumn("_slot", slot).join(r, [*keys, "_slot"]).withColumn("gap", F.abs(F.datediff(right_date, left_date)))
    near = pairs.filter(F.col("gap") <= days).groupBy(*keys, left_date).agg(F.min(F.struct("gap", tie, *theirs)).alias("_near"))
    return near.select(*keys, left_date, "_near.*")


def nearest_by_date(left: DataFrame, right: DataFrame, keys: list[str], left_date: str, right_date: str, days: int, left_id: str, tie: str) -> DataFrame:
    """Left rows, each ``left_id`` once, with the right row of ``nearest_dates``."""
    theirs = [c for c in right.columns if c not in (*keys, tie)]
    pairs = left.join(nearest_dates(left, right, keys, left_date, right_date, days, tie), [*keys, left_date])
    rest = [c for c in [*keys, *[c for c in left.columns if c not in keys], *theirs] if c != left_id]
    return pairs.groupBy(left_id).agg(F.min(F.struct("gap", tie, *rest)).alias("_m")).select(left_id, "_m.*")


def within(left: DataFrame, right: DataFrame, keys: list[str], left_ts: str, right_ts: str, hours: int) -> DataFrame:
    """Pairs of equal keys at most ``hours`` apart, by slots of that width like ``nearest_by_date``."""
    seconds = hours * 3600
    own, other = (F.floor(F.unix_timestamp(F.col(c).cast("timestamp")) / seconds) for c in (left_ts, right_ts))
    r = right.withColumn("_slot", F.explode(F.array(other - 1, other, other + 1)))
    gap = F.unix_timestamp(F.col(right_ts).cast("timestamp")) - F.unix_timestamp(F.col(left_ts).cast("timestamp"))
    return left.withColumn("_slot", own).join(r, [*keys, "_slot"]).filter(F.abs(gap) <= seconds).drop("_slot")
