"""Special functions as columns against plain sums, and seeded draws against what they should look like."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from touchline.functions import special


def tail(m, alpha, k):
    """1 less the probabilities of 0 to k, by recursion."""
    r = 1 / alpha
    p = math.exp(-r * math.log1p(m / r))
    total = [p]
    for i in range(1, k + 1):
        p *= (i - 1 + r) / i * (m / (r + m))
        total.append(p)
    return 1 - math.fsum(total)


def test_count_tails_are_sums(spark):
    cases = [(m, a, k) for m in (0.05, 0.7, 2.7, 9.0, 26.0, 60.0) for a in (1e-6, 1e-3, 0.1, 0.7, 5.0) for k in (0, 1, 4, 9, 30, 60)]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, m double, a double, k int")
    got = {r["i"]: r["p"] for r in df.select("i", special.count_over("m", "a", F.col("k") + 0.5).alias("p")).collect()}
    for i, c in enumerate(cases):
        assert got[i] == pytest.approx(tail(*c), abs=1e-9), c
    odd = spark.createDataFrame([(0.0, 0.1, 3.5), (2.0, 0.1, -0.5), (2.0, 0.0, 3.5), (None, 0.1, 3.5), (2.0, 0.1, 3.0)], "m double, a double, k double")
    got = [r["p"] for r in odd.select(special.count_over("m", "a", "k").alias("p")).collect()]
    assert got[:2] == [0.0, 1.0] and got[2] == pytest.approx(tail(2.0, 1e-6, 3), abs=1e-9) and got[3] is None and got[4] == pytest.approx(tail(2.0, 0.1, 3), abs=1e-9)


def test_log_gamma_and_incomplete_beta(spark):
    xs = [0.01, 0.5, 1.0, 1.5, 7.0, 123.4, 1e6]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select(special.log_gamma("x").alias("g")).collect()
    assert [r["g"] for r in got] == pytest.approx([math.lgamma(x) for x in xs], rel=1e-12, abs=1e-11)
    rows = [(0.0, 2.0, 3.0, 0.0), (1.0, 2.0, 3.0, 1.0), (0.3, 1.0, 1.0, 0.3), (0.25, 2.0, 1.0, 0.0625), (0.25, 1.0, 2.0, 1 - 0.75**2), (0.5, 7.0, 7.0, 0.5)]
    got = spark.createDataFrame(rows, "x double, a double, b double, want double").select(special.beta_part("x", "a", "b").alias("p"), "want").collect()
    assert [r["p"] for r in got] == pytest.approx([r["want"] for r in got], abs=1e-12)


def test_draws_are_uniform_and_normal(spark):
    d = spark.range(40_000).select(special.uniform("id", F.lit(3)).alias("u"), special.normal("id", F.lit(3)).alias("z"), special.normal("id", F.lit(4)).alias("y")).toPandas()
    assert d["u"].between(0, 1, inclusive="neither").all() and d["u"].nunique() > 39_000
    assert np.abs(np.histogram(d["u"], 20, (0, 1))[0] / 2000 - 1).max() < 0.1
    assert abs(d["z"].mean()) < 0.02 and d["z"].std() == pytest.approx(1, abs=0.02) and abs(np.corrcoef(d["z"], d["y"])[0, 1]) < 0.02
    assert (d["z"].abs() > 1.96).mean() == pytest.approx(0.05, abs=0.005)
