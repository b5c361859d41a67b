"""Shin's model over many books: batches of rows give what the column gives, in little time."""

import time

from pyspark.sql import functions as F

from touchline.functions import odds as o
from touchline.plans import ledgers


def test_batches_bisect_as_the_column_does(spark):
    rows = [(2.0, 3.4, 4.0), (1.01, 900.0, 900.0), (3.0, 3.0, 3.0), (5.0, 5.0, 5.0), (None, 3.0, 2.0), (0.0, 2.0, 3.0), (-1.0, 2.0, 3.0), (float("nan"), 2.0, 3.0), (1.5, 2.5, 1.9)]
    df = o.with_shin(spark.createDataFrame(rows, "a double, b double, c double"), ["a", "b", "c"])
    ok = F.col("a").isNotNull() & ~F.isnan("a") & (F.col("a") > 1)
    got = df.withColumn("want", F.when(ok, o.shin_z(F.array("a", "b", "c")))).collect()
    assert [r["z"] for r in got] == [r["want"] for r in got]
    assert sum(r["p_a"] is None for r in got) == 4


def test_many_books_take_little_time(spark):
    x = spark.range(0, 120_000, 1, 1).select(*[(F.lit(1.5) + F.col("id") * k % 300 / 100).alias(n) for n, k in (("a", 7), ("b", 11), ("c", 13))])
    start = time.perf_counter()
    assert o.with_shin(x, ["a", "b", "c"]).agg(F.count("z"), F.avg("p_a")).first()[0] == 120_000
    assert time.perf_counter() - start < 8  # interpreted, 120,000 took more than that in one task


def test_matches_of_one_day_share_their_price(spark, tmp_path):
    """Work on prices follows pairs of teams and days, not matches."""
    o_ = spark.range(20_000).select(F.col("id").alias("o_orderkey"), (F.col("id") * 0).alias("o_custkey"), F.lit("F").alias("o_orderstatus"), F.lit(1.0).alias("o_totalprice"), F.lit("1998-02-06").cast("timestamp_ntz").alias("o_orderdate"), F.lit("1-URGENT").alias("o_orderpriority"))
    o_.write.parquet(str(tmp_path / "orders.parquet"))
    when = ledgers.fixture(spark, str(tmp_path), "match").select("home", "away", "match_date").distinct()
    assert ledgers.closing_prices(spark, str(tmp_path), when).count() == 19
    assert ledgers.full_ledger(spark, str(tmp_path)).select("event_id").distinct().count() > 1000
