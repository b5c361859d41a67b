"""Screens count matches by what the models see, so tables are read once and fits and scores don't grow with them."""

import pytest
from conftest import DATA
from pyspark.sql import functions as F

from touchline.plans import intake, models, screens
from touchline.plans.registry import QUERIES
from touchline.sources.fixtures import fixture


@pytest.mark.parametrize("name", ["q14_feature_screen", "q14_combinations"])
def test_what_is_scored_are_counts_and_no_tables(spark, name):
    plan = QUERIES[name](spark, DATA)._jdf.queryExecution().toString()
    assert not any(f"/{t}.parquet" in plan for t in ("orders", "lineitem"))


def test_counts_stand_for_every_match(spark):
    rows = screens._rows(spark, DATA, intake.FEATURES).collect()
    n = models.played(spark, DATA).count()
    assert sum(r["w"] for r in rows) == n and sum(r["w"] for r in rows if r["late"]) == n - int(n * 0.8)
    assert len({tuple(r)[:-1] for r in rows}) == len(rows)


def test_features_of_every_match_are_those_of_brute_force(spark):
    m = [r.asDict() for r in models.played(spark, DATA).collect()]
    s = fixture(spark, DATA, "stat").groupBy("event_id", "team", "stat_name").agg(F.avg("value").alias("v")).collect()
    value = {(r["event_id"], r["team"], r["stat_name"]): r["v"] for r in s}
    got = {(r["event_id"], r["feature"]): r["x"] for r in screens.feature_rows(spark, DATA, intake.FEATURES).collect()}
    assert len(got) == 3 * len(m)
    for f in intake.FEATURES:
        days: dict = {}
        for r in m:
            for t in ("home", "away"):
                days.setdefault(r[t], {}).setdefault(r["match_date"], []).append(value.get((r["event_id"], t, f)))

        def mean(team, day):
            last = sorted(d for d in days[team] if d < day)[-screens.LAST :]
            v = [x for d in last for x in days[team][d] if x is not None]
            return sum(v) / len(v) if v else 0.0

        for r in m:
            x = (mean(r["home"], r["match_date"]) - mean(r["away"], r["match_date"])) / screens.WIDTH
            near = abs(abs(x) % 1 - 0.5) < 1e-9
            assert got[r["event_id"], f] == pytest.approx(round(x) * screens.WIDTH / 25, abs=screens.WIDTH / 25 * near + 1e-9)


def test_no_features_no_rows(spark):
    assert screens.feature_rows(spark, DATA, ()).count() == 0 and screens.feature_screen(spark, DATA, ()).count() == 0
