"""Fits one after another on training sets that slide: each takes a few rows in and lets a few go.

Rows become weighted cells. What a fit has more or less than the one before are differences of cells, so no row is looked at
more than twice, however many fits it is in. Fits are dealt to tasks in runs of ``RUN``: a run begins with the cells as they
are before it, running sums of the differences of all runs before, and goes on from fit to fit, each started where the
last one ended. A run gets the cells of one training set and the differences of ``RUN`` fits. Runs are dealt by their count
and not by their bytes, which are few for the work there is in them.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import fit
from .lineage import cut
from .resample import numbered

RUN = 16


def sliding_fits(rows: DataFrame, fits: DataFrame, cell: list[str], fitter: Callable, schema: str, run: int | None = None) -> DataFrame:
    """``fitter`` for each of ``fits`` (k and other columns), over the cells of those ``rows`` that are in it.

    ``rows`` have the columns of ``cell``, a weight ``w``, and are in fits from ``enter`` on up to but without ``leave``
    (null: to the end). ``fitter(cells, mark, start)`` gets cells with their sums of ``w``, a row of ``fits`` and where the
    fit before ended (None for the first of a run), and gives (rows of ``schema`` without k, where it ended).
    """
    n = run or RUN
    moves = rows.filter("enter is not null").select(*cell, F.col("enter").alias("k"), "w").union(rows.filter("leave is not null").select(*cell, "leave", -F.col("w")))
    moves = cut(moves.groupBy("k", *cell).agg(F.sum("w").alias("w")).withColumn("run", F.floor(F.col("k") / n)), "slide-moves")
    fits = fits.withColumn("run", F.floor(F.col("k") / n))
    last = fits.agg(F.max("run")).first()[0]
    last = -1 if last is None else last
    w = Window.partitionBy(*cell).orderBy("run")
    sums = moves.groupBy("run", *cell).agg(F.sum("w").alias("w"))
    sums = sums.select(*cell, (F.col("run") + 1).alias("low"), F.lead("run").over(w).alias("next"), F.sum("w").over(w).alias("w"))
    sums = sums.withColumn("high", F.least(F.coalesce("next", F.lit(last)), F.lit(last))).filter("low <= high")
    base = sums.select(F.explode(F.sequence("low", "high")).alias("run"), *cell, "w").join(fits.select("run"), "run", "left_semi")
    mark = F.struct(*[F.col(c) for c in fits.columns if c not in ("run", "k")]).alias("mark")
    both = base.withColumn("k", F.lit(None).cast("long")).unionByName(moves)
    every = both.unionByName(fits.select("run", "k", mark), allowMissingColumns=True)

    def over_run(pdf: pd.DataFrame) -> pd.DataFrame:
        marks = pdf[pdf["mark"].notna()].sort_values("k")
        pdf = pdf[pdf["mark"].isna()].dropna(subset=cell)
        pdf = pdf.assign(code=pdf.groupby(cell).ngroup()).sort_values("k", kind="stable", na_position="first")
        known = pdf.drop_duplicates("code").sort_values("code")[cell].reset_index(drop=True)
        code, w, until = pdf["code"].to_numpy("i8"), pdf["w"].to_numpy("f8"), pdf["k"].fillna(-np.inf).to_numpy("f8")
        now, at, out, start = np.zeros(len(known)), 0, [], None
        for k, m in zip(marks["k"], marks["mark"], strict=True):
            to = np.searchsorted(until, k, "right")
            now, at = now + np.bincount(code[at:to], w[at:to], len(known)), to
            now[np.abs(now) <= 1e-12 * max(np.abs(now).max(initial=0.0), 1e-300)] = 0.0
            got, start = fitter(known[now != 0].assign(w=now[now != 0]), m, start)
            out.append(got.assign(k=int(k)))
        out = [x for x in out if len(x)]
        return pd.concat(out)[names] if out else pd.DataFrame(columns=names, dtype=object)

    names = [c.split()[0] for c in schema.split(", ")]
    # by a count that is given, as runs of few bytes would be put together in a task or two; twice, as hashes of runs meet
    return every.repartition(max(1, 2 * (last + 1)), "run").groupBy("run").applyInPandas(over_run, schema)


def _numbered_days(days: DataFrame, day: str) -> DataFrame:
    """``days`` (distinct) with ``k``, their numbers in order from 0; days are the only rows of the window."""
    return days.withColumn("k", (F.row_number().over(Window.orderBy(day)) - 1).cast("long"))


BLOCK = "k long, n long, a double, b double, alpha double, rho double, converged boolean"


def _block_fit(least: int):
    def fitter(cells: pd.DataFrame, mark, start):
        if cells.empty or cells["w"].sum() < least:
            return pd.DataFrame(columns=["n"]), start
        got = fit.fit_goals(cells, start)
        p = np.array([got["a"], got["b"], np.log(got["alpha"]), got["rho"]])
        return pd.DataFrame([{x: got[x] for x in ("n", "a", "b", "alpha", "rho", "converged")}]), p

    return fitter


def goal_model_by_block(rated: DataFrame, blocks: DataFrame, days: int = 1461, least: int = 100, run: int | None = None) -> DataFrame:
    """(k, n, a, b, alpha, rho, converged) for each block of ``blocks`` (k, first): fitted on what was rated in the ``days``
    strictly before its first day. Blocks with fewer than ``least`` have no row.

    Blocks that begin on one day have one training set, which is fitted once, so there are as many fits as days at most,
    however many matches a day has. ``rated`` has match_date, diff and scores. Days are the only rows of a window in one task.
    """
    once = cut(_numbered_days(blocks.select("first").distinct(), "first"), "slide-days")
    firsts = once.select(F.col("first").alias("day"), "k")
    seen = rated.select(F.col("match_date").alias("day")).distinct()
    none = F.lit(None).cast("long").alias("k")
    every = firsts.union(seen.select("day", none)).union(seen.select(F.date_add("day", days), none)).groupBy("day").agg(F.min("k").alias("k"))
    later = every.select("day", F.min("k").over(Window.orderBy("day").rowsBetween(1, Window.unboundedFollowing)).alias("k"))
    cells = rated.groupBy("match_date", (F.round(F.col("diff") / fit.STEP) * fit.STEP).alias("d"), F.col("home_score").alias("hs"), F.col("away_score").alias("aws")).agg(F.count("*").cast("double").alias("w"))
    cells = cells.withColumn("gone", F.date_add("match_date", days)).join(later.select(F.col("day").alias("match_date"), F.col("k").alias("enter")), "match_date")
    cells = cells.join(later.select(F.col("day").alias("gone"), F.col("k").alias("leave")), "gone")
    fits = sliding_fits(cells, once, ["d", "hs", "aws"], _block_fit(least), BLOCK, run)
    return blocks.select("k", "first").join(once.withColumnRenamed("k", "_k"), "first").join(fits.withColumnRenamed("k", "_k"), "_k").select(*[c.split()[0] for c in BLOCK.split(", ")])


TEAM_FIT = "k long, cutoff date, team string, attack double, defence double, home_advantage double, rho double"


def _team_fit(xi: float, origin):
    def fitter(cells: pd.DataFrame, mark, start):
        scale = np.exp(-xi * (mark["cutoff"] - origin).days)
        cells = cells.assign(w=cells["w"] * scale)
        names = sorted(set(cells["home"]) | set(cells["away"]))
        teams, n = {t: k for k, t in enumerate(names)}, len(names)
        p = np.zeros(2 * n + 2)
        p[2 * n] = np.log(1.3)
        for t, i in teams.items():
            p[i], p[n + i] = start[0].get(t, (0.0, 0.0)) if start else (0.0, 0.0)
        if start:
            p[2 * n :] = start[1]
        p, _, _ = fit.minimised(fit.team_nll(cells, teams), p)
        out = pd.DataFrame({"cutoff": mark["cutoff"], "team": names, "attack": np.exp(p[:n]), "defence": np.exp(p[n : 2 * n]), "home_advantage": np.exp(p[2 * n]), "rho": fit.RHO_MOST * np.tanh(p[2 * n + 1])})
        return out, ({t: (p[i], p[n + i]) for t, i in teams.items()}, p[2 * n :])

    return fitter


def guarded(matches: DataFrame, xi: float, least: int, every: int, run: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Fits of team strengths as matches go by, none of which sees a match that kicks off with the one it is for.

    Matches are numbered by (match_date, event_id). At number ``least`` and each ``every`` further a refit is asked for on
    all matches before that number; it is done when the next match is to be predicted, without those of that match's own
    day, which are counted as blocked. Where the day leaves nothing, the refit is put off to the next match (deferred),
    and what is predicted meanwhile has no prediction.

    Gives (matches with i and k, the fit that predicts them: null before ``least`` and while put off), and the fits
    (k, at, used, blocked, deferred, cutoff and the parameters by team). In numbers this is a rule: a refit asked for at t
    uses what stands before the first match of t's day. Only the first day of all can put refits off. Refits of one day have
    one training set, which is fitted once: there are as many fits as days at most, however many matches a day has.
    """
    if least < 1 or every < 1:
        raise ValueError("a fit needs a match before it, and refits come one after another")
    obs = cut(numbered(matches.select("match_date", "event_id", "home", "away", "home_score", "away_score"), "match_date", "event_id"), "guard-matches")
    days = obs.groupBy("match_date").agg(F.min("i").alias("first"), F.max("i").alias("last"))
    w = Window.orderBy("match_date")
    days = days.select("match_date", "first", (F.col("last") + 1).alias("following"), F.lag("match_date").over(w).alias("day_before"))
    obs = obs.join(F.broadcast(days), "match_date")
    edge, origin, n = days.agg(F.min("following"), F.min("match_date"), F.max("following")).first()
    if edge is None:
        edge, n = 0, 0
    asked = (F.col("i") >= least) & ((F.col("i") - least) % every == 0)
    number = F.floor((F.col("i") - least) / every)
    normal = obs.filter(asked & (F.col("first") > 0)).select(number.alias("k"), F.col("i").alias("at"), F.col("first").alias("used"), (F.col("i") - F.col("first")).alias("blocked"), F.col("day_before").alias("cutoff"))
    # refits put off by the first day are done at the first match after it, on what had been asked for last
    late = edge > least and (edge - least) % every > 0 and edge < n
    queued = least + (edge - 1 - least) // every * every if late else 0
    spark = matches.sparkSession
    first = [((edge - least) // every, edge, queued, 0, origin)] if late else []
    fits = normal.union(spark.createDataFrame(first, "k long, at long, used long, blocked long, cutoff date"))
    fits = cut(fits.withColumn("deferred", F.lit(max(0, edge - least)).cast("long")), "guard-fits")
    once = cut(_numbered_days(fits.select("used", "cutoff").distinct(), "used"), "guard-used")
    ahead = Window.orderBy("following").rowsBetween(0, Window.unboundedFollowing)
    enter = days.select("following").join(once.select(F.col("used").alias("following"), "k"), "following", "left").select("following", F.min("k").over(ahead).alias("enter"))
    next_fit = F.when(F.col("i") < queued, 0).otherwise(F.col("enter")) if first else F.col("enter")
    rows = obs.join(F.broadcast(enter), "following").select("home", "away", F.col("home_score").alias("hs"), F.col("away_score").alias("aws"), next_fit.cast("long").alias("enter"), F.lit(None).cast("long").alias("leave"), F.exp(xi * F.datediff("match_date", F.lit(origin).cast("date"))).alias("w"))
    params = sliding_fits(rows, once, ["home", "away", "hs", "aws"], _team_fit(xi, origin), TEAM_FIT, run)
    params = once.select("used", "k").join(params.drop("cutoff"), "k").drop("k")
    k = F.when((F.col("i") >= least) & (F.col("i") >= edge), number)
    return obs.withColumn("k", k.cast("long")).drop("first", "following", "day_before"), fits.join(params, "used").select("k", "at", "used", "blocked", "cutoff", "deferred", "team", "attack", "defence", "home_advantage", "rho")
