"""Known answers, invariants and look-ahead checks."""

import datetime as dt
import hashlib
from pathlib import Path

import numpy as np
import pandas as pd
import pytest
from conftest import DATA
from pyspark.sql import functions as F

from touchline.functions import grid as g
from touchline.functions import odds as o
from touchline.operators import asof, fit, ratings, resample, store
from touchline.plans import models
from touchline.plans.registry import QUERIES
from touchline.sources import feeds


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.fixture(scope="module")
def grid3(spark):
    # rows are goals of the home side; the sums below are worked out by hand from these nine cells
    p = [[0.10, 0.05, 0.05], [0.10, 0.20, 0.10], [0.05, 0.20, 0.15]]
    return spark.createDataFrame([(1, i, j, p[i][j]) for i in range(3) for j in range(3)], "k int, i int, j int, p double")


def test_markets_of_a_small_grid(grid3):
    m = g.markets(grid3, "k").first()
    assert (m["win"], m["draw"], m["loss"]) == pytest.approx((0.35, 0.45, 0.20))
    assert (m["dc_1x"], m["dc_x2"], m["dc_12"]) == pytest.approx((0.80, 0.65, 0.55))
    t = g.total_market(grid3, "k", 2.0).first()
    assert t["over"] + t["push"] + t["under"] == pytest.approx(1)


def test_handicap_quarter_line_is_the_mean_of_its_neighbours(grid3):
    low, mid, high = (g.handicap_market(grid3, "k", x).first() for x in (-1.0, -0.75, -0.5))
    assert mid["win"] == pytest.approx((low["win"] + high["win"]) / 2)
    assert mid["win"] + mid["push"] + mid["lose"] == pytest.approx(1)


def test_grids_in_the_row_are_those_of_their_cells(spark):
    m = spark.createDataFrame([(1, 1.7, 0.9), (2, 0.3, 3.1)], "k int, lam double, mu double")
    for alpha in (None, 0.2):
        df, grid = g.with_grid(m, 10, -0.05, alpha=alpha)
        cells = grid.cells(df, "k")
        assert [r["s"] for r in cells.groupBy("k").agg(F.sum("p").alias("s")).collect()] == pytest.approx([1, 1])
        of_rows = {r["k"]: r for r in g.markets(cells, "k").collect()}
        for r in df.select("k", *[c.alias(n) for n, c in grid.markets().items()]).collect():
            assert [r[n] for n in g.PICKS] == pytest.approx([of_rows[r["k"]][n] for n in g.PICKS], abs=1e-12)
        half, quarter = (g.handicap_market(cells, "k", x).orderBy("k").collect() for x in (-0.5, 0.25))
        got = df.select("k", *[c.alias(n) for n, c in grid.handicap_market(-0.5).items()]).orderBy("k").collect()
        more = df.select("k", *[c.alias(n) for n, c in grid.handicap_market(0.25).items()]).orderBy("k").collect()
        assert [tuple(r) for r in got] == [pytest.approx(tuple(r), abs=1e-12) for r in half]
        assert [tuple(r) for r in more] == [pytest.approx(tuple(r), abs=1e-12) for r in quarter]
        want = cells.groupBy("k").agg(F.sum(F.col("p") * F.col("p")).alias("sq"), F.sum(F.col("p") * (F.col("i") + F.col("j"))).alias("goals")).orderBy("k").collect()
        got = df.select("k", grid.squares().alias("sq"), grid.mean(lambda i, j: i + j).alias("goals"), grid.top(3).alias("top")).orderBy("k").collect()
        assert [(r["sq"], r["goals"]) for r in got] == [pytest.approx((r["sq"], r["goals"]), abs=1e-12) for r in want]
        best = {k: sorted((-r["p"], r["i"], r["j"]) for r in cells.collect() if r["k"] == k)[:3] for k in (1, 2)}
        assert [[(x["i"], x["j"]) for x in r["top"]] for r in got] == [[x[1:] for x in best[k]] for k in (1, 2)]


def test_shin(spark):
    r = o.with_shin(spark.createDataFrame([(2.0, 3.4, 4.0), (2.2, 4.0, 5.0), (0.9, 3.0, 3.0)], "a double, b double, c double"), ["a", "b", "c"]).collect()
    assert [r[0][x] for x in ("p_a", "p_b", "p_c")] == pytest.approx([0.48364772, 0.27998724, 0.23636504], abs=1e-7)
    assert r[0]["z"] == pytest.approx(0.02210967, abs=1e-7)
    assert r[1]["z"] == 0 and r[1]["p_a"] + r[1]["p_b"] + r[1]["p_c"] == pytest.approx(1)
    assert r[2]["p_a"] is None


def test_scalars(spark):
    assert value(spark, o.fraction_odd(F.lit("5/2"))) == 3.5
    for bad in ("5", "a/2", "1/0", ""):
        assert value(spark, o.fraction_odd(F.lit(bad))) is None
    assert value(spark, o.half_life(F.lit(120.0), 120.0)) == 0.5
    assert value(spark, o.exponential_decay(F.lit(-1), 0.1)) is None
    assert value(spark, o.margin_factor(F.lit(-4))) == 1.875
    assert value(spark, o.epoch_seconds(F.lit(1_700_000_000_000))) == 1_700_000_000
    assert value(spark, o.is_price(F.lit(None).cast("double"))) is False
    assert value(spark, o.kelly(F.lit(0.9), F.lit(1.0))) == 0


def _match(i, day, h, a, hs, as_):
    return (i, dt.date(2024, 1, day), h, a, hs, as_, "L", 0, 2024)


MATCH = "event_id long, match_date date, home string, away string, home_score int, away_score int, tournament string, is_neutral int, season int"


def test_elo_keeps_points_and_does_not_look_ahead(spark):
    rows = [_match(1, 1, "A", "B", 2, 0), _match(2, 1, "C", "D", 1, 1), _match(3, 1, "A", "C", 0, 3)]
    got = {r["event_id"]: r for r in ratings.elo(spark.createDataFrame(rows, MATCH)).collect()}
    assert got[1]["home_rating"] + got[1]["away_rating"] == pytest.approx(3000)
    changed = rows[:2] + [_match(3, 1, "A", "C", 9, 0)]
    again = {r["event_id"]: r for r in ratings.elo(spark.createDataFrame(changed, MATCH)).collect()}
    assert again[1] == got[1] and again[3]["diff"] == got[3]["diff"]


def played(spark):
    return sorted((r for r in models.played(spark, DATA).collect()), key=lambda r: (r["match_date"], r["event_id"]))


def brute_elo(rows, home=100.0, half=4.0, weight=lambda r: {"1-URGENT": 60.0, "2-HIGH": 50.0, "4-NOT SPECIFIED": 40.0}.get(r["tournament"], 30.0) * (1.0 if abs(r["home_score"] - r["away_score"]) <= 1 else 1.5 if abs(r["home_score"] - r["away_score"]) == 2 else 1.75 + (abs(r["home_score"] - r["away_score"]) - 3) / 8)):
    now, seen, out = {}, {}, {}
    for r in rows:
        for t in (r["home"], r["away"]):
            now.setdefault(t, 1500.0)
            if half and t in seen:
                now[t] = 1500 + (now[t] - 1500) * 2 ** (-(r["match_date"] - seen[t]).days / 365.25 / half)
            seen[t] = r["match_date"]
        diff = now[r["home"]] + (0 if r["is_neutral"] else home) - now[r["away"]]
        won = 1.0 if r["home_score"] > r["away_score"] else 0.5 if r["home_score"] == r["away_score"] else 0.0
        step = weight(r) * (won - 1 / (1 + 10 ** (-diff / 400)))
        now[r["home"]] += step
        now[r["away"]] -= step
        out[r["event_id"]] = (diff, now[r["home"]], now[r["away"]])
    return now, out


def test_elo_of_all_matches_is_that_of_brute_force(spark):
    rows = played(spark)
    now, want = brute_elo(rows)
    got = {r["event_id"]: (r["diff"], r["home_rating"], r["away_rating"]) for r in QUERIES["w11_elo"](spark, DATA).collect()}
    assert got.keys() == want.keys() and all(got[i] == pytest.approx(want[i], abs=1e-4) for i in want)
    at = dt.date(1998, 1, 1)
    before, _ = brute_elo([r for r in rows if at - dt.timedelta(1461) <= r["match_date"] < at])
    shot = {r["team"]: r["rating"] for r in QUERIES["w12_elo_snapshots"](spark, DATA).filter("at = date '1998-01-01'").collect()}
    assert shot and shot.keys() == before.keys() and all(shot[t] == pytest.approx(before[t], abs=1e-3) for t in shot)
    top = QUERIES["w14_top_rated"](spark, DATA).collect()
    assert len(top) == 20 and [r["rating"] for r in top] == sorted((r["rating"] for r in top), reverse=True)


def test_slices_of_the_calendar_give_what_one_stream_gives(spark):
    m = models.played(spark, DATA)
    one, many = ({r["event_id"]: (r["diff"], r["home_rating"], r["away_rating"]) for r in ratings.elo(m, rows=n).collect()} for n in (1 << 40, 60))
    assert ratings.with_slice(ratings.with_pool(m), 60).select("slice").distinct().count() > 10
    assert one.keys() == many.keys() and all(many[i] == pytest.approx(one[i], abs=1e-6) for i in one)
    one, many = ({r["event_id"]: (r["home"], r["draw"]) for r in ratings.plain_baseline(m, rows=n).collect()} for n in (1 << 40, 60))
    assert one.keys() == many.keys() and all(many[i] == pytest.approx(one[i], abs=1e-6) for i in one)
    assert ratings.elo(m.limit(0)).count() == 0


@pytest.mark.parametrize("inclusive", [False, True])
def test_as_of_is_that_of_brute_force(spark, inclusive):
    rng = np.random.default_rng(3)
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    left = [(i, pick(["hot", "hot", "a", "b", None]), pick([None, *range(40)])) for i in range(400)]
    right = [(pick(["hot", "hot", "a", "c", None]), pick([None, *range(40)]), i, f"v{i}") for i in range(300)]
    ldf = spark.createDataFrame(left, "_row int, k string, at int").withColumn("_value", F.lit(1)).withColumn("a.b", F.lit("x"))
    rdf = spark.createDataFrame(right, "k string, t int, n int, v string")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        got = asof.as_of(ldf, rdf, ["k"], "at", "t", ["v", "n"], order=["n"], inclusive=inclusive)
        assert got.columns == ["_row", "k", "at", "_value", "a.b", "v", "n"]
        got = {r["_row"]: (r["v"], r["n"]) for r in got.collect()}
        assert asof.as_of(ldf.limit(0), rdf, ["k"], "at", "t", ["v"]).count() == 0
        assert asof.as_of(ldf, rdf.limit(0), ["k"], "at", "t", ["v"]).filter("v is null").count() == len(left)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    for i, k, at in left:
        seen = [(t, n, v) for kk, t, n, v in right if None not in (k, at, kk, t) and kk == k and (t < at or inclusive and t == at)]
        assert got[i] == ((max(seen)[2], max(seen)[1]) if seen else (None, None))
    assert len(got) == len(left)


def test_pools_of_teams_are_rated_by_themselves(spark):
    rows = [_match(1, 1, "A", "B", 2, 0), _match(2, 2, "X", "Y", 0, 4), _match(3, 3, "B", "A", 1, 1), _match(4, 4, "Y", "X", 2, 2)]
    every = {r["event_id"]: r for r in ratings.elo(spark.createDataFrame(rows, MATCH)).collect()}
    alone = {r["event_id"]: r for r in ratings.elo(spark.createDataFrame(rows[::2], MATCH)).collect()}
    assert len(every) == 4 and all(every[i] == r for i, r in alone.items())


def test_plain_baseline_is_that_of_brute_force(spark):
    rows = played(spark)
    got = {r["event_id"]: r for r in QUERIES["w13_plain_baseline"](spark, DATA).collect()}
    days = sorted({r["match_date"] for r in rows})
    for day in days[:: len(days) // 12]:
        before = [r for r in rows if r["match_date"] < day]
        now, _ = brute_elo([r | {"is_neutral": 0} for r in (x.asDict() for x in before)], 80.0, None, lambda r: 20.0)
        for r in (r for r in rows if r["match_date"] == day):
            if len(before) < ratings.PLAIN_LEAST:
                assert r["event_id"] not in got
                continue
            p = 1 / (1 + 10 ** (-(now.get(r["home"], 1500) + 80 - now.get(r["away"], 1500)) / 400))
            d = sum(x["home_score"] == x["away_score"] for x in before) / len(before)
            g_ = got[r["event_id"]]
            assert (g_["home"], g_["draw"], g_["away"]) == pytest.approx((p * (1 - d), d, (1 - p) * (1 - d)), abs=1e-6)


def test_goal_model_finds_its_parameters():
    rng = np.random.default_rng(11)
    d = np.round(rng.normal(0, 150, 60_000) / 5) * 5
    mean = np.exp(0.15 + np.array([[1], [-1]]) * 0.5 * d / 400)
    goals = rng.poisson(mean * rng.gamma(1 / 0.2, 0.2, mean.shape))
    cells = pd.DataFrame({"d": d, "hs": goals[0], "aws": goals[1], "w": 1}).groupby(["d", "hs", "aws"], as_index=False).sum()
    p = fit.fit_goals(cells)
    assert p["converged"] and p["at_bound"] == "" and (p["a"], p["b"], p["alpha"]) == pytest.approx((0.15, 0.5, 0.2), abs=0.03) and abs(p["rho"]) < 0.03
    f, best = fit.goal_nll(cells), np.array([p["a"], p["b"], np.log(p["alpha"]), p["rho"]])
    assert all(f(best + step) >= p["nll"] - 1e-6 for step in np.r_[np.eye(4), -np.eye(4)] * 1e-3)
    x = cells.assign(x=0.0)
    assert fit.fit_goals(x)["nll"] == pytest.approx(p["nll"], rel=1e-6)
    few = fit.fit_goals(pd.DataFrame({"d": [400.0], "hs": [9], "aws": [0], "w": [50]}))
    assert few["at_bound"] != ""


def test_team_fit_finds_strengths_and_its_gradient_is_right():
    rng = np.random.default_rng(12)
    names, attack, defence = list("ABCDEF"), np.array([1.6, 1.3, 1.1, 0.9, 0.8, 0.7]), np.array([0.8, 0.9, 1.0, 1.0, 1.1, 1.3])
    rows = [(names[i], names[j], h, a) for i in range(6) for j in range(6) if i != j for h, a in zip(rng.poisson(1.3 * attack[i] * defence[j], 400), rng.poisson(attack[j] * defence[i], 400), strict=True)]
    cells = pd.DataFrame(rows, columns=["home", "away", "hs", "aws"]).groupby(["home", "away", "hs", "aws"], as_index=False).size().rename(columns={"size": "w"}).assign(fold=1)
    f = fit.team_nll(cells, {t: k for k, t in enumerate(names)})
    at = rng.normal(0, 0.2, 14)
    assert f(at)[1] == pytest.approx(fit.numeric(lambda p: f(p)[0])(at)[1], rel=1e-3, abs=0.5)
    got = fit._fit_teams(cells)
    level = attack.prod() ** (1 / 6)
    assert got["converged"].all() and got["home_advantage"][0] == pytest.approx(1.3, abs=0.05) and abs(got["rho"][0]) < 0.03
    assert got["attack"].to_numpy() == pytest.approx(attack / level, abs=0.08) and got["defence"].to_numpy() == pytest.approx(defence * level, abs=0.08)


def test_fits_of_all_folds_use_earlier_days_only(spark):
    m = models.played(spark, DATA).filter("season <= 1997")
    later = m.withColumn("home_score", F.when(F.col("season") == 1997, 9).otherwise(F.col("home_score")))
    teams = {(r["fold"], r["team"]): r for r in fit.teams_by_fold(m, "season", 0.001).collect()}
    assert {k[0] for k in teams} == {1996, 1997} and {(r["fold"], r["team"]): r for r in fit.teams_by_fold(later, "season", 0.001).collect()} == teams
    x = m.withColumns({"home_xg": F.when(F.col("event_id") % 3 > 0, F.col("home_score") + 0.1), "away_xg": F.when(F.col("event_id") % 3 > 0, F.col("away_score") + 0.1)})
    got = fit.xg_by_fold(x, "season").collect()
    assert {r["fold"] for r in got} == {1996, 1997} and all(r["converged"] for r in got)
    goals = m.filter("season < 1997").agg(F.avg(F.col("home_score") + F.col("away_score"))).first()[0] / 2
    assert np.mean([np.exp(r["base"] + r["home_edge"] / 2) for r in got if r["fold"] == 1997]) == pytest.approx(goals, abs=0.35)
    best = fit.strengths_by_fold(models.played(spark, DATA).filter("season <= 1998"), "season").collect()
    assert {r["penalty"] for r in best} <= {1.0, *fit.PENALTIES}


def test_counts_find_their_parameters(spark):
    rng = np.random.default_rng(13)
    d = np.round(rng.normal(0, 150, 20_000) / 5) * 5
    h, a = (rng.poisson(np.exp(1.5 + s * 0.3 * d / 400)) for s in (1, -1))
    rows = spark.createDataFrame(pd.DataFrame({"f": np.repeat([0, 1], 10_000).astype("i4"), "diff": d, "home_score": h.astype("i4"), "away_score": a.astype("i4")}))
    got = fit.counts_by_fold(rows, "f").collect()
    assert [r["fold"] for r in got] == [1] and (got[0]["a"], got[0]["b"]) == pytest.approx((1.5, 0.3), abs=0.03) and (got[0]["alpha"] is None or got[0]["alpha"] < 0.01)


def test_ridge_solution_is_that_of_numpy(spark):
    rng = np.random.default_rng(14)
    x = rng.integers(-1, 2, (60, 12)).astype("f8")
    a, b = x.T @ x, x.T @ rng.normal(size=60)
    e = spark.createDataFrame([(i, j, float(a[i, j])) for i in range(12) for j in range(12)], "i long, j long, v double")
    got = {r["i"]: r["x"] for r in fit.ridge_solution(e, spark.createDataFrame([(i, float(v)) for i, v in enumerate(b)], "i long, b double"), 2.0).collect()}
    assert [got[i] for i in range(12)] == pytest.approx(np.linalg.solve(a + 2 * np.eye(12), b).tolist(), abs=1e-6)


def numpy_offset(y, offset, x, ridge):
    m, s = x.mean(0), x.std(0)
    z = np.c_[np.ones(len(x)), (x - m) / s]
    keep, beta = np.diag([1e-3] + [ridge] * x.shape[1]), np.zeros(x.shape[1] + 1)
    for _ in range(100):
        p = 1 / (1 + np.exp(-(offset + z @ beta)))
        h = (z * (p * (1 - p))[:, None]).T @ z + keep
        beta = beta + np.clip(np.linalg.solve(h, z.T @ (y - p) - keep @ beta), -2, 2)
    return lambda o_, v: (lambda zz, cov: (o_ + zz @ beta, np.sqrt(np.einsum("ij,jk,ik->i", zz, cov, zz))))(np.c_[np.ones(len(v)), (v - m) / s], np.linalg.inv(h))


def test_residual_model_and_walk_forward_are_those_of_numpy(spark):
    rows = models.residual_rows(spark, DATA).toPandas().sort_values(["bet_date", "game_id", "line_no"]).reset_index(drop=True)
    x = rows[["x1", "x2"]].to_numpy("f8")
    eta, se = numpy_offset(rows["y"].to_numpy(), rows["offset"].to_numpy(), x, 1.0)(rows["offset"].to_numpy(), x)
    got = models.m23_predictions(spark, DATA).toPandas()
    assert np.sort(got["p"]) == pytest.approx(np.sort(1 / (1 + np.exp(-eta))), abs=1e-6) and np.sort(got["low"]) == pytest.approx(np.sort(1 / (1 + np.exp(-eta + 1.96 * se))), abs=1e-6)
    assert (got["high"] > got["p"]).all()
    fold = np.arange(len(rows)) * models.FOLDS // len(rows)
    day = pd.to_datetime(rows["bet_date"])
    for r in models.q07(spark, DATA).collect():
        test = fold == r["fold"]
        train = (day + pd.Timedelta(days=2) <= day[test].min()).to_numpy()
        of = numpy_offset(rows["y"][train].to_numpy(), rows["offset"][train].to_numpy(), x[train], 5.0)
        eta, se = of(rows["offset"][test].to_numpy(), x[test])
        y, odd = rows["y"][test].to_numpy(), rows["odd"][test].to_numpy()
        bet = odd / (1 + np.exp(-eta + 1.96 * se)) - 1 > 0.02
        assert (r["n"], r["selected"]) == (test.sum(), bet.sum()) and r["model_brier"] == pytest.approx(((1 / (1 + np.exp(-eta)) - y) ** 2).mean(), abs=1e-6)
        assert r["roi"] == pytest.approx(np.where(y == 1, odd - 1, -1)[bet].mean(), abs=1e-6)


def test_student_distribution():
    for stat, freedom, p in ((12.706, 1, 0.05), (2.228, 10, 0.05), (3.169, 10, 0.01), (1.96, 1e6, 0.05), (0.0, 5, 1.0)):
        assert fit.student_two_sided(stat, freedom) == pytest.approx(p, abs=1e-4)


def test_tournament_has_one_winner(spark):
    got = {r["team"]: r for r in QUERIES["m25_tournament"](spark, DATA).collect()}
    assert len(got) == 16
    for n, c in ratings.STAGES:
        assert sum(r[c] for r in got.values()) == pytest.approx(n)
    assert all(r["p_quarter"] >= r["p_semi"] >= r["p_final"] >= r["p_title"] for r in got.values())
    strong = spark.createDataFrame([(f"t{k}", k % 4, 2500.0 if k == 0 else 1500.0) for k in range(16)], "team string, grp int, rating double")
    assert {r["team"]: r["p_title"] for r in ratings.tournament(spark, strong, 200).collect()}["t0"] > 0.6


def test_as_known_at_sees_what_was_ingested(spark):
    t = lambda h: dt.datetime(2024, 1, 1, h)
    obs = spark.createDataFrame([("m", 1, t(11), t(12), 1), ("m", 1, t(13), t(13), 2)], "kind string, id int, published_at timestamp_ntz, ingested_at timestamp_ntz, seq int")
    seen = lambda h: [r["seq"] for r in asof.as_known_at(obs, F.lit(f"2024-01-01 {h}:00:00").cast("timestamp_ntz"), ["kind", "id"], ["published_at", "ingested_at", "seq"]).collect()]
    assert [seen(10), seen(11), seen(12), seen(14)] == [[], [], [1], [2]]


def test_nearest_date_takes_three_days_and_the_first_of_ties(spark):
    left = spark.createDataFrame([(1, "x", dt.date(2024, 3, 10)), (2, "x", dt.date(2024, 4, 10))], "id int, k string, d date")
    right = spark.createDataFrame([(7, "x", dt.date(2024, 3, 13)), (8, "x", dt.date(2024, 3, 7)), (9, "x", dt.date(2024, 4, 14))], "pid int, k string, pd date")
    assert [(r["id"], r["pid"], r["gap"]) for r in asof.nearest_by_date(left, right, ["k"], "d", "pd", 3, "id", "pid").collect()] == [(1, 7, 3)]


def test_stores(spark):
    old = spark.createDataFrame([(1, "a"), (None, "n")], "k int, v string")
    new = spark.createDataFrame([(1, "b"), (2, "c"), (2, "c"), (None, "z")], "k int, v string")
    assert [(r["k"], r["v"]) for r in store.append_new(old, new, ["k"]).collect()] == [(2, "c")]
    q = spark.createDataFrame([(1, 1, None), (1, 2, 2.0), (1, 3, None)], "k int, t int, odd double")
    r = store.open_and_close(q, ["k"], "odd", "t").first()
    assert (r["odd_open"], r["odd_close"], r["n"]) == (2.0, None, 3)


def test_constant_sample_has_no_interval(spark):
    r = resample.bootstrap_mean(spark.createDataFrame([(k, 3.0, 1) for k in range(20)], "k int, s double, m int"), "k", 50).first()
    assert r["mean"] == r["lo"] == r["hi"] == 3.0


def test_goal_model_uses_earlier_folds_only(spark):
    rows = [(s, 40.0 * (i % 9 - 4), i % 4, i % 3) for s in (2020, 2021, 2022) for i in range(200)]
    df = spark.createDataFrame(rows, "season int, diff double, home_score int, away_score int")
    p = {r["fold"]: r for r in fit.goal_model_by_fold(df, "season").collect()}
    assert sorted(p) == [2021, 2022] and p[2021]["n"] == 200
    later = df.withColumn("home_score", F.when(F.col("season") == 2022, 9).otherwise(F.col("home_score")))
    assert {r["fold"]: r for r in fit.goal_model_by_fold(later, "season").collect()} == p


def test_manifest_names_every_file(spark):
    want = sorted((f.name, f.stat().st_size, hashlib.sha256(f.read_bytes()).hexdigest()) for f in Path(DATA).glob("*.parquet"))
    assert sorted(tuple(r) for r in QUERIES["s28_manifest"](spark, DATA).collect()) == want


def test_labels_of_groups(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(1, 30)] + [(100, 101)], "a long, b long")
    assert {r["component"] for r in ratings.component_labels(e).collect()} == {1, 100}


def test_tables_in_html_also_in_comments(spark):
    html = "<p>x</p><!--<table><tr><th>h</th></tr><tr><td>a <b>b</b></td><td>1,2</td></tr></table>-->"
    df = spark.createDataFrame([(1, html), (2, None), (3, "")], "page_id int, html string")
    assert [(r["page_id"], r["cells"]) for r in feeds.table_rows(df).collect()] == [(1, ["a b", "1,2"])]


def test_bad_json_lines_are_left_out_or_fail(spark):
    df = spark.createDataFrame([('{"a":1}',), ("{no",)], "value string")
    assert [r["a"] for r in feeds.json_lines(df, "a long").collect()] == [1]
    with pytest.raises(Exception):  # noqa: B017
        feeds.json_lines(df, "a long", strict=True).collect()


def test_xg_fit_is_at_the_maximum_of_its_likelihood():
    rng = np.random.default_rng(17)
    names = [f"t{k}" for k in range(5)]
    cells = pd.DataFrame([(a, b, int(h), int(x)) for a in names for b in names if a != b for h, x in rng.poisson((1.6, 1.2), (60, 2))], columns=["home", "away", "hs", "aws"])
    cells = cells.groupby(["home", "away", "hs", "aws"], as_index=False).size().rename(columns={"size": "w"}).assign(fold=1)
    cells["gh"], cells["ga"] = cells["w"] * (cells["hs"] + 0.1), cells["w"] * cells["aws"]
    got = fit._fit_xg(cells)
    p = got.set_index("team")

    def nll(attack=0.0, base=0.0, edge=0.0, alpha=None, rho=None):
        up = p["attack"] + np.where(p.index == "t1", attack, 0)
        x = np.exp(p["base"].iloc[0] + base + p["home_edge"].iloc[0] + edge + cells["home"].map(up) - cells["away"].map(p["defence"]))
        y = np.exp(p["base"].iloc[0] + base + cells["away"].map(up) - cells["home"].map(p["defence"]))
        if alpha is None and rho is None:
            return float((cells["w"] * (x + y) - cells["gh"] * np.log(x) - cells["ga"] * np.log(y)).sum() + fit.XG_RIDGE * (up**2).sum())
        h, a, x, y = (v.to_numpy() for v in (cells["hs"], cells["aws"], x, y))
        return -float((cells["w"] * (fit.nb_log(h, x, alpha) + fit.nb_log(a, y, alpha) + np.log(fit.low_scores(h, a, x, y, rho)))).sum())

    for step in ({"attack": 1e-3}, {"base": 1e-3}, {"edge": 1e-3}):
        assert nll() <= min(nll(**step), nll(**{k: -v for k, v in step.items()}))
    alpha, rho = got["alpha"][0], got["rho"][0]
    best = min((nll(alpha=a, rho=r), a, r) for a in np.exp(np.linspace(*np.log(fit.ALPHA_RANGE), 60)) for r in np.linspace(-0.3, 0.3, 61))
    assert nll(alpha=alpha, rho=rho) <= best[0] + 1e-6 and rho == pytest.approx(best[2], abs=0.011)
