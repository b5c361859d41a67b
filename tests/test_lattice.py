"""Subsets of features: all of them, against single fits, planted values and scores worked out by hand."""

import math

import numpy as np
import pandas as pd
import pytest
from conftest import DATA
from pyspark.sql import functions as F

from touchline.operators import fit, lattice, ratings
from touchline.plans import intake, models, screens
from touchline.plans.registry import QUERIES


@pytest.fixture(scope="module")
def planted():
    rng = np.random.default_rng(23)
    n = 12_000
    d, x, y, z = np.round(rng.normal(0, 20, n)) * 5, np.round(rng.normal(0, 1, n)) / 2, np.round(rng.normal(0, 1, n)) / 2, np.round(rng.normal(0, 1, n)) / 2
    tilt = 0.3 * d / 400 + 0.25 * x - 0.15 * y
    return pd.DataFrame({"d": d, "x": x, "y": y, "z": z, "hs": rng.poisson(np.exp(0.2 + tilt)), "aws": rng.poisson(np.exp(0.2 - tilt))}).assign(w=1.0)


def test_all_subsets_find_what_is_planted(spark, planted):
    got = {r["subset"]: r for r in lattice.lattice(spark.createDataFrame(planted), ["x", "y", "z"]).collect()}
    assert sorted(got) == sorted(["", "x", "y", "z", "x+y", "x+z", "y+z", "x+y+z"])
    assert all(r["converged"] and r["n"] == len(planted) for r in got.values())
    assert got["x+y+z"]["theta"] == pytest.approx([0.25, -0.15, 0.0], abs=0.03)
    for s, r in got.items():  # more features never fit worse
        for t, q in got.items():
            if set(s.split("+")) - {""} < set(t.split("+")):
                assert q["nll"] <= r["nll"] + 1e-3
    cells = planted.groupby(["d", "x", "hs", "aws"], as_index=False)["w"].sum()
    alone = fit.fit_goals(cells)
    assert (got["x"]["a"], got["x"]["b"], got["x"]["theta"][0], got["x"]["nll"]) == pytest.approx((alone["a"], alone["b"], alone["theta"], alone["nll"]), abs=2e-3)
    both = planted.groupby(["d", "x", "y", "hs", "aws"], as_index=False)["w"].sum()
    r = got["x+y"]
    p = np.array([r["a"], r["b"], math.log(r["alpha"]), r["rho"], *r["theta"]])
    f = lattice.goals_of(both, ["x", "y"])
    assert f(p) == pytest.approx(r["nll"], abs=1e-6)
    for k in (0, 1, 4, 5):
        for step in (-0.01, 0.01):
            assert f(p + step * np.eye(6)[k]) > f(p)


def test_lattice_of_no_rows_and_too_many_features(spark, planted):
    df = spark.createDataFrame(planted)
    assert lattice.lattice(df.limit(0), ["x", "y"]).count() == 0
    with pytest.raises(ValueError):
        lattice.lattice(df, [f"f{k}" for k in range(9)])


def test_screens_agree_and_their_scores_are_those_of_brute_force(spark):
    one = {r["feature"]: r for r in QUERIES["q14_feature_screen"](spark, DATA).collect()}
    every = {r["subset"]: r for r in QUERIES["q14_combinations"](spark, DATA).collect()}
    assert len(every) == 8 and every[""]["gain"] == 0
    for f in intake.FEATURES:
        assert (every[f]["theta"][0], every[f]["brier"], every[f]["n"]) == (pytest.approx(one[f]["theta"], abs=5e-3), pytest.approx(one[f]["brier"], abs=1e-4), one[f]["n"])
        assert every[""]["brier"] == pytest.approx(one[f]["brier_base"], abs=1e-4)
    rated = sorted(ratings.elo(models.played(spark, DATA)).collect(), key=lambda r: (r["match_date"], r["event_id"]))
    cut = math.floor(len(rated) * 0.8)
    cells = pd.DataFrame([(round(r["diff"] / fit.STEP) * fit.STEP, r["home_score"], r["away_score"]) for r in rated[:cut]], columns=["d", "hs", "aws"]).groupby(["d", "hs", "aws"], as_index=False).size()
    p, scores = fit.fit_goals(cells.rename(columns={"size": "w"})), []
    i, j = (v.ravel() for v in np.meshgrid(np.arange(11), np.arange(11), indexing="ij"))
    fact = np.array([math.lgamma(k + 1) for k in range(11)])
    for r in rated[cut:]:
        t = p["b"] * round(r["diff"] / fit.STEP) * fit.STEP / 400
        lam, mu = math.exp(p["a"] + t), math.exp(p["a"] - t)
        rho = min(max(p["rho"], max(-1 / lam, -1 / mu) + 1e-6), min(1 / (lam * mu), 1) - 1e-6)
        cell = np.exp(i * math.log(lam) - lam - fact[i] + j * math.log(mu) - mu - fact[j]) * fit.low_scores(i, j, np.full(121, lam), np.full(121, mu), rho)
        win, draw, loss = (cell[m].sum() / cell.sum() for m in (i > j, i == j, i < j))
        hs, aws = r["home_score"], r["away_score"]
        scores.append((win - (hs > aws)) ** 2 + (draw - (hs == aws)) ** 2 + (loss - (hs < aws)) ** 2)
    assert every[""]["n"] == len(scores) and every[""]["brier"] == pytest.approx(np.mean(scores), abs=5e-4)


def test_features_are_means_of_earlier_matches(spark):
    got = {(r["event_id"], r["feature"]): r["x"] for r in screens.feature_rows(spark, DATA, ("stat_A",)).collect()}
    m = sorted(models.played(spark, DATA).collect(), key=lambda r: r["match_date"])
    from touchline.sources.fixtures import fixture

    s = fixture(spark, DATA, "stat").filter("stat_name = 'stat_A'").groupBy("event_id", "team").agg(F.avg("value").alias("v")).collect()
    value = {(r["event_id"], r["team"]): r["v"] for r in s}
    last = m[-1]
    diff = 0.0
    for side, sign in (("home", 1), ("away", -1)):
        name, days = last[side], {}
        for r in m:
            for t in ("home", "away"):
                if r[t] == name and r["match_date"] < last["match_date"]:
                    days.setdefault(r["match_date"], []).append(value.get((r["event_id"], t)))
        values = [v for d in sorted(days)[-screens.LAST :] for v in days[d] if v is not None]
        diff += sign * (sum(values) / len(values) if values else 0.0)
    assert got[last["event_id"], "stat_A"] == pytest.approx(round(diff / screens.WIDTH) * screens.WIDTH / 25, abs=screens.WIDTH / 25 * 1.001)


def test_slopes_are_those_of_differences_and_sums_those_of_scores(planted):
    rng = np.random.default_rng(3)
    cells = planted.groupby(["d", "x", "y", "hs", "aws"], as_index=False)["w"].sum()
    for names in ([], ["y"], ["x", "y"]):
        f = lattice.with_slope(cells, names)
        for _ in range(3):
            p = np.r_[rng.normal(0.2, 0.1), rng.normal(0.3, 0.1), rng.normal(-2, 0.5), rng.uniform(-0.1, 0.1), rng.normal(0, 0.1, len(names))]
            lam, mu = (np.exp(p[0] + s * (p[1] * cells["d"] / 400 + cells[names].to_numpy("f8") @ p[4:])).to_numpy() for s in (1, -1))
            h, a, w = (cells[c].to_numpy() for c in ("hs", "aws", "w"))
            each = fit.nb_log(h, lam, np.exp(p[2])) + fit.nb_log(a, mu, np.exp(p[2])) + np.log(fit.low_scores(h, a, lam, mu, p[3]))
            value, slope = f(p)
            assert value == pytest.approx(-(w @ each), rel=1e-12)
            steps = np.eye(len(p)) * 1e-6
            assert slope == pytest.approx([(f(p + e)[0] - f(p - e)[0]) / 2e-6 for e in steps], rel=1e-4, abs=1e-2)
        assert f(np.r_[0.2, 0.3, -2, -50.0, np.zeros(len(names))]) == (1e12, None)
