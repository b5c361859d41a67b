"""Fits on sliding training sets and the guard of kick-offs against plain loops."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from conftest import DATA
from pyspark.sql import functions as F

from touchline.operators import fit, ratings, sliding
from touchline.plans import models
from touchline.plans.more import blocks
from touchline.plans.registry import QUERIES
from touchline.sources.fixtures import fixture


def test_blocks_are_fitted_on_their_own_windows(spark):
    m = fixture(spark, DATA, "match")
    rated = ratings.elo(m.filter("home_score is not null")).select("event_id", "match_date", "diff", "home_score", "away_score").cache()
    first = blocks(m).filter("block > 0").groupBy(F.col("block").alias("k")).agg(F.min("match_date").alias("first"))
    got = {r["k"]: r for r in sliding.goal_model_by_block(rated, first, days=700, run=3).collect()}
    rows = rated.toPandas()
    rows["d"] = np.round(rows["diff"] / fit.STEP) * fit.STEP
    seen = 0
    for k, day in first.collect():
        x = rows[(rows["match_date"] < day) & (rows["match_date"] >= day - dt.timedelta(700))]
        if len(x) < 100:
            assert k not in got
            continue
        cells = x.groupby(["d", "home_score", "away_score"], as_index=False).size()
        want = fit.fit_goals(cells.set_axis(["d", "hs", "aws", "w"], axis=1))
        assert got[k]["n"] == len(x) and (got[k]["a"], got[k]["b"], got[k]["rho"]) == pytest.approx((want["a"], want["b"], want["rho"]), abs=2e-3)
        seen += 1
    assert seen == len(got) > 3
    assert sliding.goal_model_by_block(rated.limit(0), first).count() == 0
    rated.unpersist()


def test_fitted_ledger_prices_with_its_blocks_parameters(spark):
    m = fixture(spark, DATA, "match")
    rated = {r["event_id"]: r for r in ratings.elo(m.filter("home_score is not null")).collect()}
    by = {r["event_id"]: r["block"] for r in blocks(m).collect()}
    first = {}
    for r in m.collect():
        first[by[r["event_id"]]] = min(first.get(by[r["event_id"]], r["match_date"]), r["match_date"])
    got = QUERIES["q02_fitted_ledger"](spark, DATA).filter("market = 'ou25'").collect()
    block = max(r["block"] for r in got)
    x = [r for r in rated.values() if first[block] - dt.timedelta(1461) <= r["match_date"] < first[block]]
    cells = pd.DataFrame({"d": [round(r["diff"] / fit.STEP) * fit.STEP for r in x], "hs": [r["home_score"] for r in x], "aws": [r["away_score"] for r in x]}).groupby(["d", "hs", "aws"], as_index=False).size()
    p = fit.fit_goals(cells.rename(columns={"size": "w"}))
    rows = [r for r in got if r["block"] == block][:20]
    assert len(rows) == 20
    for r in rows:
        d = round(rated[r["event_id"]]["diff"] / fit.STEP) * fit.STEP / 400
        lam, mu = math.exp(p["a"] + p["b"] * d), math.exp(p["a"] - p["b"] * d)
        i, j = np.meshgrid(np.arange(11), np.arange(11), indexing="ij")
        i, j = i.ravel(), j.ravel()
        cell = np.exp(fit.nb_log(i, np.full(121, lam), p["alpha"]) + fit.nb_log(j, np.full(121, mu), p["alpha"])) * fit.low_scores(i, j, np.full(121, lam), np.full(121, mu), p["rho"])
        over = cell[i + j > 2].sum() / cell.sum()
        assert r["selection"] == ("over" if over >= 0.5 else "under") or abs(over - 0.5) < 2e-3
        assert r["prob"] == pytest.approx(max(over, 1 - over), abs=3e-3)


def machine(days, least, every):
    """The guard as a loop over matches in order: (fits: at, used, blocked, cutoff; fit of each match; refits put off)."""
    fits, of, queue, deferred, now = [], [], None, 0, None
    for i, day in enumerate(days):
        if i >= least and (i - least) % every == 0:
            queue = i
        if i >= least and queue is not None:
            usable = [d for d in days[:queue] if d < day]
            if usable:
                fits.append((i, len(usable), queue - len(usable), max(usable)))
                queue, now = None, len(fits) - 1
            else:
                deferred += 1
        of.append(now)
    return fits, of, deferred


@pytest.mark.parametrize(("sizes", "least", "every"), [([3, 1, 2, 5, 4, 1, 1, 6], 4, 3), ([9, 2, 2, 3], 4, 3), ([10, 2, 2, 3], 4, 3), ([7, 1, 1, 1, 8], 5, 50), ([12], 4, 3), ([2, 2], 9, 2), ([1] * 12, 1, 1)])
def test_guard_is_that_of_a_loop(spark, sizes, least, every):
    rng = np.random.default_rng(len(sizes))
    days = [dt.date(2024, 1, 1) + dt.timedelta(3 * k) for k, n in enumerate(sizes) for _ in range(n)]
    names = ["A", "B", "C", "D"]
    rows = []
    for i, d in enumerate(days):
        h, a = rng.choice(4, 2, replace=False)
        rows.append((i, d, names[h], names[a], int(rng.integers(4)), int(rng.integers(3))))
    df = spark.createDataFrame(rows, "event_id long, match_date date, home string, away string, home_score int, away_score int")
    obs, fits = sliding.guarded(df, 0.01, least, every, run=2)
    want, of, deferred = machine(days, least, every)
    one = {r["k"]: r for r in fits.collect()}
    order = sorted(one, key=lambda k: one[k]["at"])
    assert [(one[k]["at"], one[k]["used"], one[k]["blocked"], one[k]["cutoff"]) for k in order] == want
    assert {one[k]["deferred"] for k in order} <= {deferred}
    assert [None if r["k"] is None else order.index(r["k"]) for r in obs.orderBy("i").collect()] == of
    if want:  # the last fit, from nothing
        at, used, _, cutoff = want[-1]
        cells = pd.DataFrame([r[2:] for r in rows[:used]], columns=["home", "away", "hs", "aws"]).assign(w=[math.exp(-0.01 * (cutoff - r[1]).days) for r in rows[:used]], fold=0)
        cold = fit._fit_teams(cells)
        teams = {t: k for k, t in enumerate(cold["team"])}
        got = {r["team"]: r for r in fits.filter(F.col("k") == order[-1]).collect()}
        assert got.keys() == teams.keys()
        p = np.r_[[math.log(got[t]["attack"]) for t in teams], [math.log(got[t]["defence"]) for t in teams], math.log(next(iter(got.values()))["home_advantage"]), math.atanh(np.clip(next(iter(got.values()))["rho"] / fit.RHO_MOST, -1 + 1e-12, 1 - 1e-12))]
        assert fit.team_nll(cells, teams)(p)[0] <= cold["nll"][0] + 1e-2


def test_guard_of_no_matches_and_its_query(spark):
    obs, fits = sliding.guarded(models.played(spark, DATA).limit(0), 0.01, 5, 5)
    assert obs.count() == 0 and fits.count() == 0
    with pytest.raises(ValueError):
        sliding.guarded(models.played(spark, DATA), 0.01, 0, 5)
    days = [r["match_date"] for r in sorted(models.played(spark, DATA).collect(), key=lambda r: (r["match_date"], r["event_id"]))]
    want, of, deferred = machine(days, models.GUARD_LEAST, models.GUARD_EVERY)
    got = QUERIES["q03_guarded"](spark, DATA).collect()
    assert {(r["refits"], r["blocked_observations"], r["deferred_refits"]) for r in got} == {(len(want), sum(w[2] for w in want), deferred)}
    assert sum(r["n"] for r in got) == sum(k is not None for k in of) and all(0.1 < r["rps"] < 0.3 for r in got)


def orders(spark, path, days):
    """Orders whose first is a goalless match and whose others have goals, ``days[n]`` of them on day n."""
    rows, key = [], 20
    for n, many in enumerate(days):
        for _ in range(many):
            rows.append((key, 20 + (n > 0) * key % 7 * 3, "F", 1.0, dt.datetime(2020, 1, 1) + dt.timedelta(n), "1-URGENT"))
            key += 1
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string").coalesce(1).write.parquet(f"{path}/orders.parquet")


def test_a_block_before_which_no_goal_fell(spark, tmp_path):
    orders(spark, tmp_path, [1, 420, 200])
    m = fixture(spark, str(tmp_path), "match").filter("match_date = '2020-01-01'").collect()
    assert [(r["home_score"], r["away_score"]) for r in m] == [(0, 0)]
    got = QUERIES["q02_fitted_ledger"](spark, str(tmp_path)).collect()
    assert {r["block"] for r in got} == {3}


def counted(monkeypatch, spark, name):
    """The number of fits that run."""
    seen, real = spark.sparkContext.accumulator(0), getattr(sliding, name)

    def make(*args):
        inner = real(*args)

        def fitter(*x):
            seen.add(1)
            return inner(*x)

        return fitter

    monkeypatch.setattr(sliding, name, make)
    return seen


def test_blocks_and_refits_of_one_day_are_fitted_once(spark, tmp_path, monkeypatch):
    orders(spark, tmp_path, [1, 420, 600, 30])
    m = fixture(spark, str(tmp_path), "match")
    first = blocks(m).filter("block > 0").groupBy(F.col("block").alias("k")).agg(F.min("match_date").alias("first"))
    rated = m.withColumn("diff", F.lit(0.0))
    seen = counted(monkeypatch, spark, "_block_fit")
    got = sliding.goal_model_by_block(rated, first).collect()
    assert seen.value == 2 and sorted((r["k"], r["n"]) for r in got) == [(3, 421), (4, 421), (5, 421)]
    seen = counted(monkeypatch, spark, "_team_fit")
    _, fits = sliding.guarded(models.played(spark, str(tmp_path)), 0.01, 430, 100)
    got = fits.select("k", "used").distinct().collect()
    assert seen.value == 2 and sorted(tuple(r) for r in got) == [*((k, 421) for k in range(6)), (6, 1021)]
