"""Column builders for results, odds, probabilities and stakes. No state, so batch and stream share them."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def outcome(home, away) -> Column:
    """'home', 'draw' or 'away'; null while a score is."""
    h, a = col(home), col(away)
    return F.when(h > a, "home").when(h == a, "draw").when(h < a, "away")


def ordinal(home, away) -> Column:
    """Loss 0, draw 1, win 2, seen from the home side."""
    return (F.signum(col(home) - col(away)) + 1).cast("int")


def over(home, away, line: float) -> Column:
    return col(home) + col(away) > line


def both_score(home, away) -> Column:
    return (col(home) > 0) & (col(away) > 0)


def double_chance(home, away, pick: str) -> Column:
    h, a = col(home), col(away)
    return {"1X": h >= a, "X2": h <= a, "12": h != a}[pick]


def implied(odd) -> Column:
    return 1 / col(odd)


def is_price(odd, most: float = 1000.0) -> Column:
    """Finite, above 1 and below ``most``; null is no price."""
    o = col(odd)
    return F.coalesce((o > 1) & (o < most) & ~F.isnan(o), F.lit(False))


def edge(prob, odd) -> Column:
    return col(prob) - 1 / col(odd)


def has_edge(prob, odd, least: float = 0.02, most: float = 0.15) -> Column:
    """Edge above ``least`` and at most ``most``."""
    e = edge(prob, odd)
    return (e > least) & (e <= most)


def expected_value(prob, odd) -> Column:
    return col(prob) * col(odd) - 1


def kelly(prob, odd, fraction: float = 0.25, cap: float = 0.05) -> Column:
    """A fraction of the Kelly stake between 0 and ``cap``; none at a price of 1 or less."""
    o = col(odd)
    return F.when(o > 1, F.least(F.greatest(fraction * expected_value(prob, odd) / (o - 1), F.lit(0.0)), F.lit(cap))).otherwise(0.0)


def profit(won, odd) -> Column:
    """Of a unit stake; a push (null) returns it."""
    w = col(won)
    return F.when(w.isNull(), 0.0).when(w == 1, F.round(col(odd) - 1, 3)).otherwise(-1.0)


def fraction_odd(text) -> Column:
    """'5/2' as 3.5; null where it is no fraction."""
    p = F.split(col(text), "/")
    value = F.try_divide(F.get(p, 0).try_cast("double"), F.get(p, 1).try_cast("double"))
    return F.when(F.size(p) == 2, F.round(1 + value, 3))


def epoch_seconds(ts) -> Column:
    """Epochs above 1e11 are milliseconds."""
    t = col(ts)
    return F.when(t > 1e11, F.floor(t / 1000)).otherwise(t)


def half_life(age, length) -> Column:
    return F.pow(F.lit(0.5), col(age) / length)


def exponential_decay(age, rate: float) -> Column:
    """Null for a negative age, which would look ahead."""
    a = col(age)
    return F.when(a >= 0, F.exp(-rate * a))


def logistic(diff, scale: float = 400.0) -> Column:
    return 1 / (1 + F.pow(F.lit(10.0), -col(diff) / scale))


def margin_factor(margin) -> Column:
    """1 up to one goal, 1.5 for two, then 1.75 + (d - 3) / 8."""
    d = F.abs(col(margin))
    return F.when(d <= 1, 1.0).when(d == 2, 1.5).otherwise(1.75 + (d - 3) / 8)


def entropy(probs: list) -> Column:
    return -reduce(Column.__add__, [F.when(col(p) > 0, col(p) * F.ln(col(p))).otherwise(0.0) for p in probs])


def role(selection, home, away) -> Column:
    """Favourite is the shorter of home and away; draws are 'draw'."""
    s, h, a = col(selection), col(home), col(away)
    return F.when(s == "draw", "draw").when((s == "home") == (h <= a), "favourite").otherwise("underdog")


def is_half_line(line) -> Column:
    return F.pmod(col(line), F.lit(1.0)) == 0.5


def decile(prob) -> Column:
    return F.floor(col(prob) * 10) / 10


def rps(win, draw, y) -> Column:
    """Ranked probability score of (loss, draw, win) against the ordinal ``y``."""
    p0, p1, y = 1 - col(win) - col(draw), 1 - col(win), col(y)
    return 0.5 * (F.pow(p0 - (y <= 0).cast("int"), F.lit(2)) + F.pow(p1 - (y <= 1).cast("int"), F.lit(2)))


def brier(probs: list, hit: list) -> Column:
    return reduce(Column.__add__, [F.pow(col(p) - col(y), F.lit(2)) for p, y in zip(probs, hit, strict=True)])


def log_loss(prob_of_outcome, floor: float = 1e-12) -> Column:
    return -F.ln(F.greatest(col(prob_of_outcome), F.lit(floor)))


#: The polynomial of Abramowitz and Stegun's approximation 26.2.17 of the normal distribution.
_NORMAL, _NORMAL_P = (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429), 0.2316419


def normal_cdf(x) -> Column:
    """The normal distribution function, to 7.5e-8."""
    x = col(x)
    t = 1 / (1 + _NORMAL_P * F.abs(x))
    p = reduce(lambda a, b: (a + b) * t, reversed(_NORMAL), F.lit(0.0))
    tail = F.exp(-x * x / 2) / math.sqrt(2 * math.pi) * p
    return F.when(x >= 0, 1 - tail).otherwise(tail)


def normal_cdf_sql(x: str) -> str:
    t = f"(1 / (1 + {_NORMAL_P} * abs({x})))"
    p = reduce(lambda a, b: f"({a} + ({b!r})) * {t}", reversed(_NORMAL), "0e0")
    tail = f"(exp(-{x} * {x} / 2) / {math.sqrt(2 * math.pi)!r} * ({p}))"
    return f"(case when {x} >= 0 then 1 - {tail} else {tail} end)"


SHIN_STEPS = 60


def shin_z(odds: Column, steps: int = SHIN_STEPS) -> Column:
    """Shin's share of insiders for an array of decimal odds; 0 for a book without margin.

    The sum of the probabilities falls as z grows, so z is bisected within Catalyst.
    """
    pi = F.transform(odds, lambda x: 1 / x)
    book = F.aggregate(pi, F.lit(0.0), lambda a, x: a + x)

    def step(at: Column, _) -> Column:
        z = (at["lo"] + at["hi"]) / 2
        total = F.aggregate(at["pi"], F.lit(0.0), lambda a, x: a + shin_prob(x, at["book"], z))
        return F.struct(F.when(total > 1, z).otherwise(at["lo"]).alias("lo"), F.when(total > 1, at["hi"]).otherwise(z).alias("hi"), at["pi"].alias("pi"), at["book"].alias("book"))

    start = F.struct(F.lit(0.0).alias("lo"), F.lit(0.999999).alias("hi"), pi.alias("pi"), book.alias("book"))
    return F.when(book <= 1, F.lit(0.0)).otherwise(F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step, lambda at: (at["lo"] + at["hi"]) / 2))


def shin_prob(pi: Column, book: Column, z: Column) -> Column:
    return (F.sqrt(z * z + 4 * (1 - z) * pi * pi / book) - z) / (2 * (1 - z))


def _shin_z(*odds: pd.Series) -> pd.Series:
    """``shin_z`` of each row, step by step the same."""
    with np.errstate(all="ignore"):
        pi = [1 / o.to_numpy("f8", na_value=np.nan) for o in odds]
        book = reduce(np.add, pi)
        lo, hi = np.zeros(len(book)), np.full(len(book), 0.999999)
        for _ in range(SHIN_STEPS):
            at = (lo + hi) / 2
            above = reduce(np.add, [(np.sqrt(at * at + 4 * (1 - at) * x * x / book) - at) / (2 * (1 - at)) for x in pi]) > 1
            lo, hi = np.where(above, at, lo), np.where(above, hi, at)
        return pd.Series(np.where(book <= 1, 0.0, (lo + hi) / 2))


def with_shin(df: DataFrame, cols: list[str], z: str = "z", prefix: str = "p_") -> DataFrame:
    """``df`` with Shin's z and, for each column of odds, its probability without margin; null where one is no price.

    The bisection is that of ``shin_z``, over a batch of rows at once: as a higher-order function it is interpreted, and took
    0.1 ms or more a row.
    """
    ok = reduce(Column.__and__, [is_price(c) for c in cols])
    df = df.withColumn(z, F.when(ok, F.pandas_udf(_shin_z, "double")(*[F.col(c).cast("double") for c in cols])))
    book = reduce(Column.__add__, [1 / F.col(c) for c in cols])
    df = df.withColumns({f"_{c}": F.when(~ok, None).when(book <= 1, 1 / F.col(c) / book).otherwise(shin_prob(1 / F.col(c), book, F.col(z))) for c in cols})
    total = reduce(Column.__add__, [F.col(f"_{c}") for c in cols])
    return df.withColumns({f"{prefix}{c}": F.col(f"_{c}") / total for c in cols}).drop(*[f"_{c}" for c in cols])
