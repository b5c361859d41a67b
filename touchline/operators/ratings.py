"""Ratings by recursion in date order, labels of connected groups, and a seeded tournament.

A rating is a recursion over all matches of the teams that are linked by playing each other. Such pools don't meet, so they
are worked on side by side, and the calendar of a pool is cut into slices of ``SLICE_ROWS`` matches or so, between days,
that are worked on side by side as well: every slice starts from guessed ratings, what its teams end with is where their
next slice starts, and slices whose start has moved are run again. A rating forgets where it started, as each result pulls
both sides to what they are worth, so that a few rounds do; in round k the first k slices are exact whatever they hold, so
the rounds end. Competitions of one pool share it, each with its own weight.
"""

from __future__ import annotations

import datetime as dt

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from touchline.functions.odds import col

from .asof import as_of
from .lineage import cut

BASE, HOME, HALF_LIFE_YEARS = 1500.0, 100.0, 4.0
#: Weights of competitions by name; those that name a qualification, and all others.
K_FACTORS, K_QUALIFICATION, K_OTHER = {"1-URGENT": 60.0, "2-HIGH": 50.0}, 40.0, 30.0
YEAR = 365.25


def k_factor(competition, factors: dict[str, float] | None = None, qualification: str = "specified") -> Column:
    """The weight of a match's competition."""
    c = col(competition)
    out = F.when(F.lower(c).contains(qualification), K_QUALIFICATION).otherwise(K_OTHER)
    for name, k in (K_FACTORS if factors is None else factors).items():
        out = F.when(c == name, k).otherwise(out)
    return out


def with_pool(matches: DataFrame) -> DataFrame:
    """``matches`` with ``pool``, the least name of the teams that are linked with them."""
    pairs = matches.select(F.col("home").alias("a"), F.col("away").alias("b")).distinct()
    return matches.join(component_labels(pairs).select(F.col("id").alias("home"), F.col("component").alias("pool")), "home")


class _Ratings:
    """Ratings of one pool as of the last match that was put in; days are numbers."""

    def __init__(self, half_life: float | None):
        self.half_life, self.fades = half_life, {}
        self.now: dict[str, float] = {}
        self.seen: dict[str, int] = {}

    def fade(self, days: int) -> float:
        """What is left of a team's distance from the base after so many days."""
        if days not in self.fades:
            self.fades[days] = 0.5 ** (days / YEAR / self.half_life)
        return self.fades[days]

    def play(self, m: pd.DataFrame, told=None) -> None:
        """Puts matches in, in their order: what one side wins the other loses. ``told`` gets each difference before it and
        both ratings after it. A loop over plain numbers: a row or an object for each match took five times as long."""
        now, seen, fade, ages = self.now, self.seen, self.fade, self.half_life is not None
        for h, a, day, weight, won, edge in zip(*(m[c].tolist() for c in _PLAY), strict=True):
            x, y = now.get(h, BASE), now.get(a, BASE)
            if ages:
                if day != seen.get(h, day):
                    x = BASE + fade(day - seen[h]) * (x - BASE)
                if day != seen.get(a, day):
                    y = BASE + fade(day - seen[a]) * (y - BASE)
                seen[h] = seen[a] = day
            diff = x - y + edge
            step = weight * (won - 1 / (1 + 10 ** (-diff / 400)))
            now[h], now[a] = x + step, y - step
            if told:
                told((diff, x + step, y - step))


#: What a match is to a rating: both sides, the day's number, its weight, the share that the home side won, its edge.
_PLAY = ["home", "away", "day", "weight", "won", "edge"]


def with_play(matches: DataFrame, weight: Column, edge: Column) -> DataFrame:
    """``matches`` with the columns ``_PLAY``."""
    h, a = F.col("home_score"), F.col("away_score")
    won = F.when(h > a, 1.0).when(h == a, 0.5).otherwise(0.0)
    day = F.datediff("match_date", F.lit("1970-01-01").cast("date"))
    return matches.withColumns({"day": day, "weight": weight.cast("double"), "won": won, "edge": edge.cast("double")})


def margin(goals: Column) -> Column:
    d = F.abs(goals)
    return F.when(d <= 1, 1.0).when(d == 2, 1.5).otherwise(1.75 + (d - 3) / 8)


RATED = "tournament string, event_id long, match_date date, season int, home string, away string, home_score int, away_score int, diff double, home_rating double, away_rating double"
_PLAYED = ["tournament", "event_id", "match_date", "season", "home", "away", "home_score", "away_score", "is_neutral"]
#: Matches of a slice, and how far a rating may move without its slice being run again.
SLICE_ROWS, STILL = 200_000, 1e-9
_ENDS = "pool string, slice long, team string, rating double"


def with_slice(matches: DataFrame, rows: int) -> DataFrame:
    """``matches`` with ``slice``: the days of a pool in runs of ``rows`` matches or so. Days are the only rows of a window."""
    days = matches.groupBy("pool", "match_date").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("pool").orderBy("match_date")) - F.col("_n")
    return matches.join(days.select("pool", "match_date", F.floor(before / rows).alias("slice")), ["pool", "match_date"])


def _over_slice(half_life: float | None, told):
    """Plays the matches of a slice from the ratings of its start; gives back what its teams end with, or rows of ``told``."""

    def run(key, matches: pd.DataFrame, start: pd.DataFrame) -> pd.DataFrame:
        r = _Ratings(half_life)
        r.now = dict(zip(start["team"], start["rating"].tolist(), strict=True))
        r.seen = {t: int(d) for t, d in zip(start["team"], start["seen"].tolist(), strict=True) if d == d and d is not None}
        matches = matches.iloc[np.lexsort((matches["event_id"].to_numpy(), matches["day"].to_numpy()))]
        if told:
            return told(r, matches)
        r.play(matches)
        return pd.DataFrame({"pool": key[0], "slice": key[1], "team": list(r.now), "rating": list(r.now.values())})

    return run


def _settled(m: DataFrame, half_life: float | None, rows: int | None) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """(``m`` in slices, where the teams of each slice start, where they end); ends are None where pools have one slice."""
    m = cut(with_slice(m, rows or SLICE_ROWS), "rating-slices")
    by = ["pool", "slice"]
    teams = m.select(*by, "day", F.explode(F.array("home", "away")).alias("team")).groupBy(*by, "team").agg(F.max("day").alias("last"))
    w = Window.partitionBy("pool", "team").orderBy("slice")
    plays = cut(teams.select(*by, "team", F.lag("last").over(w).alias("seen")), "rating-teams")
    start = plays.select(*by, "team", F.lit(BASE).alias("rating"), "seen")
    todo, ends = plays.select(*by).distinct(), None
    # slices are dealt over as many tasks as there are, so that a task's memory doesn't grow with the table
    parts = max(1, todo.count())
    m, start = (d.repartition(parts, *by) for d in (m, start))
    many = plays.agg(F.max("slice")).first()[0]
    while many:
        new = _ends(m.join(todo, by, "left_semi"), start.join(todo, by, "left_semi"), half_life)
        ends = cut(new if ends is None else new.union(ends.join(todo, by, "left_anti")), "rating-ends")
        now = plays.join(ends, [*by, "team"]).select(*by, "team", F.coalesce(F.lag("rating").over(w), F.lit(BASE)).alias("rating"), "seen")
        now = cut(now, "rating-starts")
        moved = now.join(start.select(*by, "team", F.col("rating").alias("_was")), [*by, "team"]).filter(F.abs(F.col("rating") - F.col("_was")) > STILL)
        todo, start = cut(moved.select(*by).distinct(), "rating-todo"), now.repartition(parts, *by)
        if todo.isEmpty():
            break
    return m, start, ends


def _ends(m: DataFrame, start: DataFrame, half_life: float | None) -> DataFrame:
    by = ["pool", "slice"]
    return m.select(*by, "event_id", *_PLAY).groupBy(*by).cogroup(start.groupBy(*by)).applyInPandas(_over_slice(half_life, None), _ENDS)


def in_slices(m: DataFrame, half_life: float | None, told, schema: str, rows: int | None = None) -> DataFrame:
    """``told`` over all matches of each pool in date order, slices side by side; ``m`` has ``pool`` and ``_PLAY``."""
    m, start, _ = _settled(m, half_life, rows)
    return m.groupBy("pool", "slice").cogroup(start.groupBy("pool", "slice")).applyInPandas(_over_slice(half_life, told), schema)


def _rated(r: _Ratings, matches: pd.DataFrame) -> pd.DataFrame:
    rows: list = []
    r.play(matches, rows.append)
    out = matches.copy(deep=False)
    for c, v in zip(("diff", "home_rating", "away_rating"), np.array(rows).reshape(-1, 3).T, strict=True):
        out[c] = v
    return out[[c.split()[0] for c in RATED.split(", ")]]


def _own(matches: DataFrame, k: Column | None = None) -> DataFrame:
    """``matches`` with what ``elo`` makes of them: competitions and margins have weights, and there is no edge on neutral ground."""
    weight = (k_factor("tournament") if k is None else k) * margin(F.col("home_score") - F.col("away_score"))
    return with_play(matches, weight, F.when(F.col("is_neutral") == 0, HOME).otherwise(0.0))


def elo(matches: DataFrame, k: Column | None = None, rows: int | None = None) -> DataFrame:
    """Each match with the difference before it and both ratings after it; differences fade, and margins count."""
    m = _own(with_pool(matches), k).select(*_PLAYED, "pool", *_PLAY[2:])
    return in_slices(m, HALF_LIFE_YEARS, _rated, RATED, rows)


def before_each_day(matches: DataFrame, rated: DataFrame) -> DataFrame:
    """(event_id, home_rating, away_rating) of any matches: what ``elo`` says of both sides before the day, else ``BASE``."""
    sides = ("home", "away")
    asked = matches.select("event_id", "match_date", F.explode(F.array(*[F.struct(F.lit(x).alias("side"), F.col(x).alias("team")) for x in sides])).alias("s")).select("event_id", "match_date", "s.*")
    known = rated.select("match_date", "event_id", F.explode(F.array(*[F.struct(F.col(x).alias("team"), F.col(f"{x}_rating").alias("rating")) for x in sides])).alias("s"))
    known = known.select("match_date", "s.*", F.col("event_id").alias("_event"))
    got = as_of(asked, known, ["team"], "match_date", "match_date", ["rating"], order=["_event"])
    one = [F.coalesce(F.max(F.when(F.col("side") == x, F.col("rating"))), F.lit(BASE)).alias(f"{x}_rating") for x in sides]
    return got.groupBy("event_id").agg(*one)


def snapshots(matches: DataFrame, dates: list[dt.date], years: float = 4.0, rows: int | None = None) -> DataFrame:
    """(at, team, rating): ratings from the matches of the ``years`` strictly before each of ``dates``, afresh for each.

    A pool before a date is a pool of its own, in slices as everywhere, so no task has more than a slice of it.
    """
    at = F.filter(F.array(*[F.lit(d) for d in dates]), lambda d: (d > F.col("match_date")) & (F.date_sub(d, int(years * YEAR)) <= F.col("match_date")))
    m = _own(with_pool(matches)).select("event_id", "match_date", "pool", *_PLAY, F.explode(at).alias("at"))
    m = m.withColumn("pool", F.concat(F.col("at").cast("string"), F.lit(" "), "pool")).drop("at")
    m, start, ends = _settled(m, HALF_LIFE_YEARS, rows)
    last = (_ends(m, start, HALF_LIFE_YEARS) if ends is None else ends).groupBy("pool", "team").agg(F.max_by("rating", "slice").alias("rating"))
    return last.select(F.substring("pool", 1, 10).cast("date").alias("at"), "team", "rating")


PLAIN_K, PLAIN_HOME, PLAIN_LEAST = 20.0, 80.0, 200


def _plain(r: _Ratings, matches: pd.DataFrame) -> pd.DataFrame:
    """Chances of the home side before each day; matches of one day don't see each other."""
    out, day = np.empty(len(matches)), matches["day"].to_numpy()
    first = np.flatnonzero(np.r_[True, day[1:] != day[:-1]])
    for a, b in zip(first, np.r_[first[1:], len(day)], strict=True):
        today = matches.iloc[a:b]
        rating = [today[c].map(r.now).fillna(BASE).to_numpy("f8") for c in ("home", "away")]
        out[a:b] = 1 / (1 + 10 ** (-(rating[0] - rating[1] + PLAIN_HOME) / 400))
        r.play(today)
    return pd.DataFrame({"event_id": matches["event_id"].array, "match_date": matches["match_date"].array, "p": out})


def plain_baseline(matches: DataFrame, least: int = PLAIN_LEAST, rows: int | None = None) -> DataFrame:
    """(event_id, home, draw, away): a plain rating and the share of draws, of all matches strictly before the day.

    Matches with fewer than ``least`` before them have no row. Draws are counted by running sums over days.
    """
    m = with_play(with_pool(matches), F.lit(PLAIN_K), F.lit(PLAIN_HOME)).select("event_id", "match_date", "pool", *_PLAY)
    p = in_slices(m, None, _plain, "event_id long, match_date date, p double", rows)
    days = matches.groupBy("match_date").agg(F.count("*").alias("n"), F.count_if(F.col("home_score") == F.col("away_score")).alias("draws"))
    before = Window.orderBy("match_date").rowsBetween(Window.unboundedPreceding, -1)
    days = days.select("match_date", F.sum("n").over(before).alias("n"), (F.sum("draws").over(before) / F.sum("n").over(before)).alias("d"))
    p = p.join(days.filter(F.col("n") >= least), "match_date")
    return p.select("event_id", (F.col("p") * (1 - F.col("d"))).alias("home"), F.col("d").alias("draw"), ((1 - F.col("p")) * (1 - F.col("d"))).alias("away"))


def component_labels(edges: DataFrame) -> DataFrame:
    """(id, component) of every node: labels fall to the least of the neighbourhood, and jump to their label's label."""
    both = edges.select("a", "b").union(edges.select("b", "a")).union(edges.select("a", "a")).union(edges.select("b", "b")).distinct()
    both = cut(both, "edges")
    labels = both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("component"))
    before = None
    while True:
        near = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("component"))
        up = labels.select(F.col("id").alias("component"), F.col("component").alias("top"))
        labels = cut(near.join(up, "component").select("id", F.least("component", "top").alias("component")), "labels")
        now = labels.agg(F.sum(F.xxhash64("id", "component").cast("decimal(38,0)"))).first()[0]
        if now == before:
            return labels
        before = now


STAGES = ((8, "p_quarter"), (4, "p_semi"), (2, "p_final"), (1, "p_title"))


def _played(rng, a: np.ndarray, b: np.ndarray, rating: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Goals of both sides of matches at once; a side that is sent off scores less and concedes more."""
    d = (rating[a] - rating[b]) / 400
    red = rng.random((2, len(a))) < 0.06
    more = np.where(red[1], 1.35, 1.0) * np.where(red[0], 0.7, 1.0)
    less = np.where(red[0], 1.35, 1.0) * np.where(red[1], 0.7, 1.0)
    return rng.poisson(np.exp(0.2 + 0.9 * d) * more), rng.poisson(np.exp(0.2 - 0.9 * d) * less)


def _winners(rng, a: np.ndarray, b: np.ndarray, rating: np.ndarray) -> np.ndarray:
    """Who goes on; a draw is shot out by the ratings."""
    f, g = _played(rng, a, b, rating)
    shoot = rng.random(len(a)) < 1 / (1 + 10 ** (-(rating[a] - rating[b]) / 400))
    return np.where((f > g) | ((f == g) & shoot), a, b)


def tournament(spark: SparkSession, teams: DataFrame, reps: int, seed: int = 20260821) -> DataFrame:
    """(team, p_quarter, p_semi, p_final, p_title) of ``teams`` (team, grp, rating): groups of four, then a knock-out.

    Two of each group go on, by points, goal difference and goals; a draw in the knock-out is decided by the ratings. Every
    replicate has its own seed, so replicates are dealt over tasks and can be run again. The field of a tournament is a few
    dozen teams.
    """
    field = teams.orderBy("grp", "team").collect()
    names, rating = [r["team"] for r in field], np.array([float(r["rating"]) for r in field])
    groups = np.arange(len(names)).reshape(-1, 4)
    home, away = (groups[:, list(k)].ravel() for k in ((0, 2, 0, 1, 0, 1), (1, 3, 2, 3, 3, 2)))

    def play(it):
        for batch in it:
            reached = np.zeros((len(names), len(STAGES)), "i8")
            for number in batch["id"]:
                rng = np.random.Generator(np.random.PCG64([seed, int(number)]))
                h, a = _played(rng, home, away, rating)
                table = np.zeros(len(names))
                for who, f, g in ((home, h, a), (away, a, h)):
                    np.add.at(table, who, 1e6 * (3.0 * (f > g) + (f == g)) + 1e3 * (f - g) + f)
                order = np.argsort(-(table + rng.random(len(names)) * 0.5)[groups], axis=1)
                first, second = (np.take_along_axis(groups, order[:, [k]], 1).ravel() for k in (0, 1))
                left = np.stack([first, np.roll(second, 1)], axis=1).ravel()
                for k, (n, _) in enumerate(STAGES):
                    while len(left) > n:
                        left = _winners(rng, left[0::2], left[1::2], rating)
                    reached[left, k] += 1
            yield pd.DataFrame({"team": names, **{c: reached[:, k] for k, (_, c) in enumerate(STAGES)}})

    got = spark.range(reps).mapInPandas(play, "team string, " + ", ".join(f"{c} long" for _, c in STAGES))
    return got.groupBy("team").agg(*[(F.sum(c) / reps).alias(c) for _, c in STAGES])
