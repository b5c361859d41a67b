"""The nearest price where very many matches and prices share a pair of teams and a date."""

import datetime as dt

from pyspark.sql import functions as F

from touchline.operators import asof


def test_dates_meet_dates_and_not_rows_rows(spark):
    n, day = 20_000, dt.date(2024, 1, 10)
    at = lambda c: F.date_add(F.lit(day), (F.col("id") % c).cast("int"))
    left = spark.range(n).select(F.col("id").alias("e"), F.lit("a").alias("k"), at(2).alias("d"), (F.col("id") * 3).alias("x"))
    right = spark.range(n).select((n - F.col("id")).alias("p"), F.lit("a").alias("k"), F.date_add(at(5), 1).alias("q"), (F.col("id") % 11).alias("y"))
    got = asof.nearest_by_date(left, right, ["k"], "d", "q", 3, "e", "p")
    assert got.columns == ["e", "gap", "p", "k", "d", "x", "q", "y"]
    first = right.filter(F.col("q") == dt.date(2024, 1, 11)).agg(F.min(F.struct("p", "y"))).first()[0]
    rows = got.collect()
    assert len(rows) == n
    assert all((r["p"], r["y"], r["x"], r["gap"]) == (*first, 3 * r["e"], 1 - r["e"] % 2) for r in rows)
    joins = [x for x in _metrics(got) if x is not None]
    assert joins and max(joins) <= n


def _metrics(df):
    """Rows that each join of a plan that has run put out."""
    def walk(p):
        name = p.nodeName()
        if "Join" in name:
            m = p.metrics().get("numOutputRows")
            yield m.get().value() if m.isDefined() else None
        if name.startswith("AdaptiveSparkPlan"):
            yield from walk(p.executedPlan())
        elif "QueryStage" in name:
            yield from walk(p.plan())
        for k in range(p.children().size()):
            yield from walk(p.children().apply(k))

    return list(walk(df._jdf.queryExecution().executedPlan()))
