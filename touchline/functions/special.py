"""Special functions and seeded draws as columns: log gamma, the incomplete beta function, count tails, normal draws."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .odds import col

#: Steps of the continued fraction; tests hold the tails to 1e-9 with it.
STEPS = 40


def let(value: Column, f) -> Column:
    """``f(value)`` with the value worked out once."""
    return F.element_at(F.transform(F.array(value), f), 1)


def log_gamma(x) -> Column:
    """The logarithm of the gamma function for x > 0: Stirling's series ten further, and down again by what is between."""
    x = col(x)
    z = x + 10
    down = F.aggregate(F.sequence(F.lit(0), F.lit(9)), F.lit(0.0), lambda s, k: s + F.log(x + k))
    series = 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - 1 / (1680 * z**7)
    return (z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + series - down


def _fraction(x: Column, a: Column, b: Column) -> Column:
    """The regularised incomplete beta function for x below (a + 1) / (a + b + 2), by Lentz's method."""

    def turned(s: Column, up: Column) -> Column:
        d = 1 / (1 + up * s["d"])
        c = 1 + up / s["c"]
        return F.struct(c.alias("c"), d.alias("d"), (s["f"] * c * d).alias("f"))

    def step(s: Column, m: Column) -> Column:
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        return let(turned(s, even), lambda t: turned(t, odd))

    first = 1 / (1 - (a + b) * x / (a + 1))
    start = F.struct(F.lit(1.0).alias("c"), first.alias("d"), first.alias("f"))
    f = F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)).cast("array<double>"), start, step, lambda s: s["f"])
    return F.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * F.log(x) + b * F.log1p(-x)) / a * f


def beta_part(x, a, b) -> Column:
    """The regularised incomplete beta function for 0 <= x <= 1 and a, b > 0; null for nulls."""
    x, a, b = (col(v).cast("double") for v in (x, a, b))
    far = x > (a + 1) / (a + b + 2)
    side = F.struct(F.when(far, 1 - x).otherwise(x).alias("x"), F.when(far, b).otherwise(a).alias("a"), F.when(far, a).otherwise(b).alias("b"), far.alias("far"))
    part = let(side, lambda s: let(_fraction(s["x"], s["a"], s["b"]), lambda v: F.when(s["far"], 1 - v).otherwise(v)))
    return F.when(x <= 0, 0.0).when(x >= 1, 1.0).when(x.isNotNull() & a.isNotNull() & b.isNotNull(), part)


def count_over(mean, alpha, line) -> Column:
    """The chance that a negative binomial with variance mean + alpha mean^2 is over a line; alpha is 1e-6 at least."""
    m, k = col(mean).cast("double"), F.floor(col(line))
    r = 1 / F.greatest(col(alpha).cast("double"), F.lit(1e-6))
    return F.when(k < 0, 1.0).when(m <= 0, 0.0).otherwise(beta_part(m / (m + r), k + 1, r))


UNITS = 1 << 31


def uniform(*parts) -> Column:
    """A number between 0 and 1 that whole numbers fix: a counter run three times through a generator modulo a prime."""
    x = F.lit(0).cast("long")
    for salt, p in zip((20260821, 362437069, 521288629, 88675123), parts, strict=False):
        x = (x * 48271 + col(p).cast("long") * 69621 + salt) % (UNITS - 1)
        x = x * x % (UNITS - 1)
    for _ in range(3):
        x = (x * 48271 + 12820163) % (UNITS - 1)
        x = x * x % (UNITS - 1)
    return (x + 0.5) / (UNITS - 1)


def uniform_sql(*parts: str) -> str:
    """The same for another engine."""
    x = "cast(0 as bigint)"
    for salt, p in zip((20260821, 362437069, 521288629, 88675123), parts, strict=False):
        x = f"(({x} * 48271 + cast({p} as bigint) * 69621 + {salt}) % {UNITS - 1})"
        x = f"list_reduce([{x}, 0], lambda a, b: a * a % {UNITS - 1})"
    for _ in range(3):
        x = f"list_reduce([({x} * 48271 + 12820163) % {UNITS - 1}, 0], lambda a, b: a * a % {UNITS - 1})"
    return f"(({x} + 5e-1) / {UNITS - 1})"


def normal(*parts) -> Column:
    """A standard normal number that whole numbers fix, from two uniform ones by polar coordinates."""
    return F.sqrt(-2 * F.log(uniform(*parts, F.lit(1)))) * F.cos(2 * math.pi * uniform(*parts, F.lit(2)))


def with_normal(df: DataFrame, name: str, *parts: str) -> DataFrame:
    """``df`` with ``normal(*parts)`` as a column. A square names its number twice, so each of them is a column of its own:
    in one expression the first would be worked out 128 times."""
    mod, u = UNITS - 1, ["_u1", "_u2"]
    df = df.withColumns({c: F.lit(0).cast("long") for c in u})
    square = lambda d: d.withColumns({c: F.col(c) * F.col(c) % mod for c in u})
    for salt, p in zip((20260821, 362437069, 521288629, 88675123), (*parts, None), strict=False):
        by = [F.lit(n) if p is None else col(p).cast("long") for n in (1, 2)]
        df = square(df.withColumns({c: (F.col(c) * 48271 + v * 69621 + salt) % mod for c, v in zip(u, by, strict=True)}))
    for _ in range(3):
        df = square(df.withColumns({c: (F.col(c) * 48271 + 12820163) % mod for c in u}))
    one, two = ((F.col(c) + 0.5) / mod for c in u)
    return df.withColumn(name, F.sqrt(-2 * F.log(one)) * F.cos(2 * math.pi * two)).drop(*u)


def normal_sql(*parts: str) -> str:
    return f"(sqrt(-2 * ln({uniform_sql(*parts, '1')})) * cos({2 * math.pi!r} * {uniform_sql(*parts, '2')}))"
