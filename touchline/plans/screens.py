"""Screens of features: what a statistic adds to the goal model."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from touchline.functions import grid as g
from touchline.functions import odds as o
from touchline.operators import fit, ratings, resample
from touchline.operators.lattice import lattice
from touchline.operators.lineage import cut
from touchline.sources.fixtures import fixture

from .models import played

WIDTH, LAST = 2.0, 10


def _of_sides(*columns: str):
    """Both sides of a match as an array, each with its ``name`` and the given columns of its own."""
    return F.array(*[F.struct(F.col(t).alias("name"), *[F.col(f"{t}_{c}").alias(c) for c in columns]) for t in ("home", "away")])


def feature_days(spark: SparkSession, sf: str, features: tuple[str, ...]) -> DataFrame:
    """(name, match_date, features): a team's means of its matches on its last days strictly before, for each of its days.

    Statistics are dealt by match, so that what one has is summed up and lies in one row without another shuffle; teams and
    days are all that is left of them.
    """
    s = fixture(spark, sf, "stat", {"lineitem": "l_orderkey"}).filter(F.col("stat_name").isin(*features))
    s = s.groupBy("event_id").agg(F.count("*").alias("_n"), *[F.avg(F.when((F.col("team") == t) & (F.col("stat_name") == f), F.col("value"))).alias(f"{t}_{i}") for t in ("home", "away") for i, f in enumerate(features)])
    places = [str(i) for i in range(len(features))]
    sides = played(spark, sf).select("event_id", "match_date", "home", "away").join(s, "event_id", "left").select("match_date", F.inline(_of_sides(*places)))
    days = sides.groupBy("name", "match_date").agg(F.count("*").alias("_n"), *[f(i).alias(f"{a}{i}") for i in places for a, f in (("v", F.sum), ("n", F.count))])
    w = Window.partitionBy("name").orderBy("match_date").rowsBetween(-LAST, -1)
    means = [F.try_divide(F.sum(f"v{i}").over(w), F.sum(f"n{i}").over(w)).alias(f) for i, f in enumerate(features)]
    return days.select("name", "match_date", *means)


def with_features(matches: DataFrame, days: DataFrame, features: tuple[str, ...]) -> DataFrame:
    """``matches`` with each feature: the difference of both teams' means, in steps. Days are small, so matches stay in place."""
    for t in ("home", "away"):
        own = days.select(F.col("name").alias(t), "match_date", *[F.col(f).alias(f"_{t}_{f}") for f in features])
        matches = matches.join(own, [t, "match_date"], "left")
    mean = lambda t, f: F.coalesce(f"_{t}_{f}", F.lit(0.0))
    x = {f: F.round((mean("home", f) - mean("away", f)) / WIDTH) * WIDTH / 25 for f in features}
    return matches.withColumns(x).drop(*[f"_{t}_{f}" for t in ("home", "away") for f in features])


def feature_rows(spark: SparkSession, sf: str, features: tuple[str, ...]) -> DataFrame:
    """(event_id, feature, x): the difference of both teams' means of their last matches strictly before, in steps."""
    m = with_features(played(spark, sf).select("event_id", "match_date", "home", "away"), cut(feature_days(spark, sf, features), "feature-days"), features)
    return m.select("event_id", F.inline(_named(features)))


def _named(features: tuple[str, ...]):
    return F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("x")) for f in features]).cast("array<struct<feature:string,x:double>>")


def _rows(spark: SparkSession, sf: str, features: tuple[str, ...]) -> DataFrame:
    """(late, d, features, hs, aws, w): matches counted by what the models see of them; the last fifth, in order, is late."""
    rated = resample.numbered(ratings.elo(played(spark, sf)), "match_date", "event_id").withColumn("late", F.col("i") >= F.floor(F.col("n") * 0.8)).drop("i", "n")
    rows = with_features(rated, cut(feature_days(spark, sf, features), "feature-days"), features).withColumn("d", F.round(F.col("diff") / fit.STEP) * fit.STEP)
    return cut(rows.groupBy("late", "d", *features, F.col("home_score").alias("hs"), F.col("away_score").alias("aws")).agg(F.count("*").alias("w")), "screen-rows")


def _with_score(t: DataFrame, name: str, base: str, tilt, rho: str) -> DataFrame:
    """``t`` (y and the columns of a model) with the Brier score of its three chances."""
    t = t.withColumns({"lam": F.exp(F.col(base) + tilt), "mu": F.exp(F.col(base) - tilt)})
    low, high = g.rho_range("lam", "mu")
    t, grid = g.with_grid(t, 10, F.least(F.greatest(rho, low + 1e-6), high - 1e-6))
    hit = [(F.col("y") == k).cast("int") for k in (2, 1, 0)]
    return t.withColumn(name, o.brier([grid.probability(g.PICKS[n]) for n in ("win", "draw", "loss")], hit)).drop("lam", "mu", *grid.columns)


def _mean(name: str):
    """The mean of a score over all matches that ``w`` counts."""
    return (F.sum(F.col(name) * F.col("w")) / F.sum("w")).alias(name)


SCREEN = "feature string, theta double, a double, b double, alpha double, rho double, a0 double, b0 double, alpha0 double, rho0 double"


def _fitted(cells: pd.DataFrame) -> pd.DataFrame:
    with_x, without = fit.fit_goals(cells), fit.fit_goals(cells.drop(columns="x").groupby(["d", "hs", "aws"], as_index=False)["w"].sum())
    return pd.DataFrame([(cells["feature"].iloc[0], with_x["theta"], *(with_x[k] for k in ("a", "b", "alpha", "rho")), *(without[k] for k in ("a", "b", "alpha", "rho")))], columns=[c.split()[0] for c in SCREEN.split(", ")])


def feature_screen(spark: SparkSession, sf: str, features: tuple[str, ...]) -> DataFrame:
    """(feature, theta, n, brier, brier_base, gain): fits on the first four fifths of the matches, scores on the rest."""
    rows = _rows(spark, sf, features).select("late", "d", "hs", "aws", "w", F.inline(_named(features)))
    cells = rows.filter("not late").groupBy("feature", "d", "x", "hs", "aws").agg(F.sum("w").alias("w"))
    p = cells.groupBy("feature").applyInPandas(_fitted, SCREEN)
    # what a match scores follows from its cell, so a cell is scored once
    t = rows.filter("late").groupBy("feature", "d", "x", o.ordinal("hs", "aws").alias("y")).agg(F.sum("w").alias("w")).join(F.broadcast(p), "feature")
    t = _with_score(t, "brier", "a", F.col("b") * F.col("d") / 400 + F.col("theta") * F.col("x"), "rho")
    t = _with_score(t, "brier_base", "a0", F.col("b0") * F.col("d") / 400, "rho0")
    out = t.groupBy("feature", "theta").agg(F.sum("w").alias("n"), _mean("brier"), _mean("brier_base"))
    return out.withColumn("gain", F.col("brier_base") - F.col("brier"))


def combination_screen(spark: SparkSession, sf: str, features: tuple[str, ...]) -> DataFrame:
    """(subset, thetas, nll, n, brier, gain): every subset of features fitted on the first four fifths of the matches and
    scored on the rest; gain is over no feature at all."""
    rows = _rows(spark, sf, features)
    p = lattice(rows.filter("not late").select("d", *features, "hs", "aws", F.col("w").cast("double").alias("w")), list(features))
    late = rows.filter("late").groupBy("d", *features, o.ordinal("hs", "aws").alias("y")).agg(F.sum("w").alias("w"))
    # a subset's thetas are in the order of the features, so they are met by their place in it; what it doesn't have is 0
    place = {f: F.array_position(F.split("subset", r"\+"), f).cast("int") for f in features}
    own = [F.when(place[f] > 0, F.col(f)).otherwise(0.0).alias(f) for f in features]
    t = late.crossJoin(F.broadcast(p.select("subset"))).select("subset", "d", *own, "y", "w").groupBy("subset", "d", *features, "y").agg(F.sum("w").alias("w"))
    t = t.join(F.broadcast(p.select("subset", "theta", "nll", "a", "b", "rho")), "subset")
    terms = [F.coalesce(F.get("theta", place[f] - 1), F.lit(0.0)) * F.col(f) for f in features]
    t = _with_score(t, "brier", "a", F.col("b") * F.col("d") / 400 + sum(terms[1:], terms[0]), "rho")
    out = t.groupBy("subset", "theta", "nll").agg(F.sum("w").alias("n"), _mean("brier"))
    out = cut(out, "combination-scores")
    none = out.filter("subset = ''").select(F.col("brier").alias("base"))
    return out.crossJoin(F.broadcast(none)).select("subset", "theta", "nll", "n", "brier", (F.col("base") - F.col("brier")).alias("gain"))
