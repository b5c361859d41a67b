"""All subsets of a few features as tilts of the goal model: cells roll up from the finest, fits start from their parents."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import fit
from .lineage import cut

#: A lattice has 2^k subsets, so features are few.
MOST = 8
LATTICE = "subset string, n long, a double, b double, alpha double, rho double, theta array<double>, nll double, converged boolean"


def goals_of(cells: pd.DataFrame, names: list[str]):
    """The negative log-likelihood of (a, b, log alpha, rho, a theta for each of ``names``) on weighted cells."""
    f = with_slope(cells, names)
    return lambda p: f(p)[0]


def with_slope(cells: pd.DataFrame, names: list[str]):
    """``goals_of`` with its gradient, which is None outside of what is valid.

    The scores of one (d, x) come in as sums: of matches, of goals of each side, and of the four low scores; what depends on a
    score and the dispersion alone comes in as the count of each score. So nothing is worked out once a score.
    """
    x = np.column_stack([np.ones(len(cells)), cells["d"].to_numpy("f8") / 400, cells[names].to_numpy("f8")])
    h, a, w = cells["hs"].to_numpy("i8"), cells["aws"].to_numpy("i8"), cells["w"].to_numpy("f8")
    x, at = np.unique(x, axis=0, return_inverse=True)
    total = lambda v: np.bincount(at.ravel(), v, len(x))
    n, goals = total(w), (total(w * h), total(w * a))
    low = [total(w * ((h == i) & (a == j))) for i, j in ((0, 0), (0, 1), (1, 0), (1, 1))]
    seen = np.bincount(h, w, 1 + max(h.max(), a.max())) + np.bincount(a, w, 1 + max(h.max(), a.max()))
    above = np.cumsum(seen[::-1])[::-1][1:]  # how many scores there are above 0, 1, ...
    steps = np.arange(len(above))
    fixed = above @ np.log1p(steps)

    def f(p: np.ndarray) -> tuple[float, np.ndarray | None]:
        rho, r = p[3], np.exp(-p[2])
        tilt = x[:, 1:] @ np.r_[p[1], p[4:]]
        lam, mu = np.exp(p[0] + tilt), np.exp(p[0] - tilt)
        t = (1 - lam * mu * rho, 1 + lam * rho, 1 + mu * rho, np.full_like(lam, 1 - rho))
        if any((v[k > 0] <= 1e-12).any() for v, k in zip(t, low, strict=True)):
            return 1e12, None
        q = [np.divide(k, v, out=np.zeros_like(v), where=k > 0) for v, k in zip(t, low, strict=True)]
        value = above @ np.log(r + steps) - fixed + sum(k[k > 0] @ np.log(v[k > 0]) for v, k in zip(t, low, strict=True))
        of_r, each = (above / (r + steps)).sum(), []
        for m, g in ((lam, goals[0]), (mu, goals[1])):
            value += (n * r) @ np.log(r / (r + m)) + g @ np.log(m / (r + m))
            of_r += n @ (np.log(r / (r + m)) + m / (r + m)) - (g / (r + m)).sum()
            each.append(g - (n * r + g) * m / (r + m))
        each[0] += rho * lam * (q[1] - mu * q[0])
        each[1] += rho * mu * (q[2] - lam * q[0])
        of_rho = (lam * q[1] + mu * q[2] - lam * mu * q[0] - q[3]).sum()
        odd = x[:, 1:].T @ (each[0] - each[1])
        return -float(value), -np.r_[(each[0] + each[1]).sum(), odd[0], -r * of_r, of_rho, odd[1:]]

    return f


def _fitted(features: list[str]):
    def run(cells: pd.DataFrame) -> pd.DataFrame:
        subset = cells["subset"].iloc[0]
        names = [f for f in features if f in subset.split("+")]
        low, high = (np.r_[v[:4], np.full(len(names), v[4])] for v in (fit.GOAL_LOW, fit.GOAL_HIGH))
        start, w = cells["start"].iloc[0], cells["w"].to_numpy("f8")
        if start is None:
            start = fit.GOAL_START[:4].copy()
            start[0] = np.log(max(w @ (cells["hs"] + cells["aws"]).to_numpy("f8") / (2 * w.sum()), 1e-3))
        inside = 1e-3 * (high - low)
        start = np.clip(np.r_[np.asarray(start, "f8"), np.zeros(len(low) - len(start))], low + inside, high - inside)
        p, nll, ok = fit.bounded(with_slope(cells, names), start, low, high, slope=True)
        return pd.DataFrame([(subset, int(round(w.sum())), p[0], p[1], np.exp(p[2]), p[3], p[4:].tolist(), nll, ok)], columns=[c.split()[0] for c in LATTICE.split(", ")])

    return run


def lattice(cells: DataFrame, features: list[str]) -> DataFrame:
    """``LATTICE`` for each subset of ``features`` (its names joined by +, in their order), the empty one included.

    ``cells`` (d, features, hs, aws, w) are as fine as all features together and are counted once; a subset's cells are sums
    of them. A fit starts where the subset without its last feature ended, so there is a job for each size of subset and a
    task for each subset. Without rows there are no fits.
    """
    if len(features) > MOST or any("+" in f for f in features):
        raise ValueError(f"at most {MOST} features, and no + in their names")
    spark = cells.sparkSession
    fine = cut(cells.groupBy("d", *features, "hs", "aws").agg(F.sum("w").alias("w")), "lattice-cells")
    done = None
    for size in range(len(features) + 1):
        subsets = spark.createDataFrame([("+".join(s), "+".join(s[:-1]), *(f in s for f in features)) for s in combinations(features, size)], "subset string, parent string, " + ", ".join(f"_{i} boolean" for i in range(len(features))))
        x = [F.when(F.col(f"_{i}"), F.col(f)).otherwise(0.0).alias(f) for i, f in enumerate(features)]
        rows = fine.crossJoin(F.broadcast(subsets)).select("subset", "parent", "d", *x, "hs", "aws", "w")
        rows = rows.groupBy("subset", "parent", "d", *features, "hs", "aws").agg(F.sum("w").alias("w"))
        if done is None:
            rows = rows.withColumn("start", F.lit(None).cast("array<double>"))
        else:
            start = F.concat(F.array("a", "b", F.log("alpha"), "rho"), "theta").alias("start")
            rows = rows.join(F.broadcast(done.select(F.col("subset").alias("parent"), start)), "parent")
        got = cut(rows.groupBy("subset").applyInPandas(_fitted(features), LATTICE), "lattice-fits")
        done = got if done is None else done.union(got)
    return done
