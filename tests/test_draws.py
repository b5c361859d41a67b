"""Draws as columns: the same as in one expression, and each worked out once a row."""

from pyspark.sql import functions as F

from touchline.functions import special
from touchline.operators import resample


def test_times_are_those_of_one_expression(spark):
    d = spark.range(3_000).select((F.col("id") % 50).alias("r"), (F.col("id") * 7919 + 3).alias("k"))
    for rate in (1.0, 1 / 21):
        got = resample.with_times(d, "r", "k", "w", rate).withColumn("x", resample.times(F.col("r"), F.col("k"), rate))
        assert got.filter("not (w <=> x)").count() == 0 and got.filter("w > 0").count() > 0


def test_normals_are_those_of_one_expression(spark):
    d = spark.range(300).select((F.col("id") * 7919 + 3).alias("e"), (F.col("id") % 5).alias("k"))
    got = special.with_normal(d, "z", "e", "k").withColumn("x", special.normal("e", "k"))
    assert got.filter("abs(z - x) > 1e-12 or z is null").count() == 0


def test_a_replicate_names_a_cluster_once(spark):
    """The plan grew with the bounds of the distribution, each of which worked out the whole draw again."""
    d = spark.range(10).select(F.col("id").alias("k"), F.lit(1.0).alias("s"), F.lit(1).alias("m"))
    plan = resample.bootstrap(d, "k", 20)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("1103515245") == 1


def test_a_normal_names_its_event_few_times(spark):
    d = spark.range(10).select((F.col("id") + F.rand()).cast("long").alias("e"))
    plan = special.with_normal(d, "z", "e")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("12820163") <= 12


def test_a_sweep_prices_equal_means_once(spark, tmp_path):
    """Its grids follow the different means, not the matches: one row each reaches the sum."""
    from touchline.plans.more import weighted

    d = spark.createDataFrame([("a", 3, 1.0), ("a", 1, 0.0), ("a", 5, None), ("b", 2, None)], "key string, n long, v double")
    got = {r["key"]: (r["n"], r["x"]) for r in weighted(d, "key", x=F.col("v")).collect()}
    assert got == {"a": (9, 0.75), "b": (2, None)}


def test_a_grid_is_compiled(spark):
    """Higher-order functions are interpreted; a grid in its row has none."""
    from touchline.functions import grid as g

    d = spark.range(3).select((F.rand() + 1).alias("lam"), (F.rand() + 1).alias("mu"))
    for alpha in (None, 0.1, F.col("lam")):
        df, grid = g.with_grid(d, 10, -0.03, alpha=alpha)
        got = df.select(grid.probability(g.PICKS["win"]).alias("p"), *grid.columns)
        assert "aggregate(" not in got._jdf.queryExecution().optimizedPlan().toString()
        both = df.select(grid.x.alias("x"), g.nb_pmf("lam", alpha, 10).alias("z") if alpha is not None else g.poisson_pmf("lam", 10).alias("z"))
        assert all(r["x"] == r["z"] for r in both.collect())
