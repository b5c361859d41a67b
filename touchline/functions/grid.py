"""Goal distributions and score grids.

A grid of two independent marginals whose four low scores depend on each other is known from its marginals, so it stays in
its row (``with_grid``): a market is a sum over runs of cells, one product for each home score, without a row for each cell
and without a shuffle. Grids of any other kind are rows (key, i, j, p), and markets are sums over them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .odds import col

#: Whether the cell of i home and j away goals is in a market; for numbers and for columns.
PICKS = {
    "win": lambda i, j: i > j,
    "draw": lambda i, j: i == j,
    "loss": lambda i, j: i < j,
    "over15": lambda i, j: i + j > 1,
    "over25": lambda i, j: i + j > 2,
    "over35": lambda i, j: i + j > 3,
    "btts": lambda i, j: (i > 0) & (j > 0),
    "dc_1x": lambda i, j: i >= j,
    "dc_x2": lambda i, j: i <= j,
    "dc_12": lambda i, j: i != j,
}


def nb_pmf(mean, alpha: Column | float, most: int) -> Column:
    """Array of negative-binomial probabilities of 0 to ``most`` with the given mean and dispersion, by recursion."""
    mu, r = col(mean), 1 / alpha
    q = mu / (r + mu)
    first = F.pow(r / (r + mu), r if isinstance(r, Column) else F.lit(float(r)))
    return F.aggregate(F.sequence(F.lit(1), F.lit(most)), F.array(first), lambda a, k: F.concat(a, F.array(F.element_at(a, -1) * (k - 1 + r) / k * q)))


def poisson_pmf(mean, most: int) -> Column:
    mu = col(mean)
    return F.aggregate(F.sequence(F.lit(1), F.lit(most)), F.array(F.exp(-mu)), lambda a, k: F.concat(a, F.array(F.element_at(a, -1) * mu / k)))


def tau(i, j, lam, mu, rho) -> Column:
    """Dependence of low scores: 1 - lam mu rho, 1 + lam rho, 1 + mu rho and 1 - rho at 0-0, 0-1, 1-0 and 1-1."""
    i, j, lam, mu, rho = map(col, (i, j, lam, mu, rho))
    return F.when((i == 0) & (j == 0), 1 - lam * mu * rho).when((i == 0) & (j == 1), 1 + lam * rho).when((i == 1) & (j == 0), 1 + mu * rho).when((i == 1) & (j == 1), 1 - rho).otherwise(1.0)


def rho_range(lam, mu) -> tuple[Column, Column]:
    """The open interval of valid dependence."""
    lam, mu = col(lam), col(mu)
    return F.greatest(-1 / lam, -1 / mu), F.least(1 / (lam * mu), F.lit(1.0))


CHUNK = 4


def _with_pmfs(df: DataFrame, name: str, means: dict[str, str], alpha: Column | float | None, most: int) -> tuple[DataFrame, list[str]]:
    """``df`` with an array of probabilities of 0 to ``most`` for each mean, and columns of their running sums.

    The recursion is that of ``nb_pmf`` and ``poisson_pmf``, but each probability is a column, so that all is compiled; a
    higher-order function is interpreted. ``CHUNK`` of them start from one column, which bounds both the depth of the plan
    and what is worked out twice. Gives back the columns to drop as well.
    """
    one = {f"{name}_{v}": col(m) for v, m in means.items()}
    parts = []
    if alpha is None:
        first, steps = {v: F.exp(-m) for v, m in one.items()}, {v: lambda p, k, m=m: p * m / float(k) for v, m in one.items()}
    else:
        r = 1 / alpha
        if isinstance(r, Column):
            df, r, parts = df.withColumn(f"{name}_r", r), F.col(f"{name}_r"), [f"{name}_r"]
        df = df.withColumns({f"{v}q": m / (r + m) for v, m in one.items()})
        parts += [f"{v}q" for v in one]
        first = {v: F.pow(r / (r + m), r if isinstance(r, Column) else F.lit(float(r))) for v, m in one.items()}
        steps = {v: lambda p, k, v=v: p * (k - 1 + r) / float(k) * F.col(f"{v}q") for v in one}
    df = df.withColumns({f"{v}0": p for v, p in first.items()} | {f"{name}_s{v[-1]}0": F.lit(0.0) for v in one})
    for low in range(0, most, CHUNK):
        new = {}
        for v, step in steps.items():
            p = F.col(f"{v}{low}")
            for k in range(low + 1, min(low + CHUNK, most) + 1):
                p = step(p, k)
                new[f"{v}{k}"] = p
        df = df.withColumns(new)
    for low in range(0, most + 1, CHUNK):
        new = {}
        for v in one:
            s = F.col(f"{name}_s{v[-1]}{low}")
            for k in range(low, min(low + CHUNK, most + 1)):
                s = s + F.col(f"{v}{k}")
                new[f"{name}_s{v[-1]}{k + 1}"] = s
        df = df.withColumns(new)
    parts += [f"{v}{k}" for v in one for k in range(most + 1)] + [f"{name}_s{v[-1]}{k}" for v in one for k in range(most + 2)]
    return df.withColumns({v: F.array(*[F.col(f"{v}{k}") for k in range(most + 1)]) for v in one}), parts


def with_grid(df: DataFrame, most: int = 12, rho: Column | float = 0.0, home: str = "lam", away: str = "mu", alpha: Column | float | None = None) -> tuple[DataFrame, Grid]:
    """``df`` with the parts of a grid for the means of each row, and the ``Grid`` that reads them.

    Each part is a column of its own, so that it is worked out once a row.
    """
    name = "_g"
    while any(c.startswith(name) for c in df.columns):
        name += "g"
    df = df.withColumn(f"{name}_rho", col(rho) if isinstance(rho, (Column, str)) else F.lit(float(rho)))
    df, parts = _with_pmfs(df, name, {"x": home, "y": away}, alpha, most)
    x, y = F.col(f"{name}_x"), F.col(f"{name}_y")
    low = [(i, j) for i in (0, 1) for j in (0, 1)]
    more = [F.greatest(x[i] * y[j] * tau(F.lit(i), F.lit(j), home, away, f"{name}_rho"), F.lit(0.0)) - x[i] * y[j] for i, j in low]
    df = df.withColumns({f"{name}_c": F.array(*[F.col(f"{name}_sy{k}") for k in range(most + 2)]), f"{name}_a": F.col(f"{name}_sx{most + 1}"), f"{name}_d": F.array(*more)}).drop(*parts)
    d = F.col(f"{name}_d")
    total = F.col(f"{name}_a") * F.element_at(f"{name}_c", -1) + d[0] + d[1] + d[2] + d[3]
    return df.withColumn(f"{name}_t", total), Grid(name, most)


class Grid:
    """What a grid in the row gives: probabilities of sets of cells, means, single cells, or its cells as rows."""

    def __init__(self, name: str, most: int):
        self.most, self.columns = most, [f"{name}_{x}" for x in ("x", "y", "rho", "c", "a", "d", "t")]
        self.x, self.y, _, self.c, _, self.d, self.total = map(F.col, self.columns)

    def probability(self, pick) -> Column:
        """Of the cells (i, j) with ``pick(i, j)``: for each i, runs of j are differences of running sums."""
        terms = []
        for i in range(self.most + 1):
            inside = [bool(pick(i, j)) for j in range(self.most + 1)]
            starts = [j for j in range(self.most + 1) if inside[j] and (j == 0 or not inside[j - 1])]
            ends = [j + 1 for j in range(self.most + 1) if inside[j] and (j == self.most or not inside[j + 1])]
            runs = [self.c[b] - self.c[a] for a, b in zip(starts, ends, strict=True)]
            if runs:
                terms.append(self.x[i] * sum(runs[1:], runs[0]))
        terms += [self.d[2 * i + j] for i in (0, 1) for j in (0, 1) if pick(i, j)]
        return sum(terms, F.lit(0.0)) / self.total

    def mean(self, value) -> Column:
        """Of ``value(i, j)``, a number for each cell."""
        rows = [self.x[i] * sum((float(value(i, j)) * self.y[j] for j in range(self.most + 1)), F.lit(0.0)) for i in range(self.most + 1)]
        low = [self.d[2 * i + j] * float(value(i, j)) for i in (0, 1) for j in (0, 1)]
        return sum(rows + low, F.lit(0.0)) / self.total

    def cell(self, i, j) -> Column:
        """The probability of one score."""
        if isinstance(i, int) and isinstance(j, int):
            more = self.d[2 * i + j] if i < 2 and j < 2 else F.lit(0.0)
            return (self.x[i] * self.y[j] + more) / self.total
        i, j = col(i), col(j)
        more = F.when((i < 2) & (j < 2), F.get(self.d, 2 * i + j)).otherwise(0.0)
        return (F.get(self.x, i) * F.get(self.y, j) + more) / self.total

    def squares(self) -> Column:
        """The sum of the squares of all cells."""
        both = [sum((v[k] * v[k] for k in range(self.most + 1)), F.lit(0.0)) for v in (self.x, self.y)]
        low = [(2 * self.x[i] * self.y[j] + self.d[2 * i + j]) * self.d[2 * i + j] for i in (0, 1) for j in (0, 1)]
        return (both[0] * both[1] + sum(low, F.lit(0.0))) / (self.total * self.total)

    def markets(self) -> dict[str, Column]:
        """Result, totals, both-score and double-chance probabilities."""
        return {n: self.probability(pick) for n, pick in PICKS.items()}

    def total_market(self, line: float) -> dict[str, Column]:
        """Over, push and under of the goals of both sides at a line."""
        return {n: self.probability(p) for n, p in (("over", lambda i, j: i + j > line), ("push", lambda i, j: i + j == line), ("under", lambda i, j: i + j < line))}

    def handicap_market(self, line: float) -> dict[str, Column]:
        """Win, push and lose of the home side at a handicap; a quarter line is the mean of the two beside it."""
        lines = _lines(line)
        of = lambda test: sum((self.probability(lambda i, j, x=x: test(i - j + x)) for x in lines), F.lit(0.0)) / len(lines)
        return {"win": of(lambda m: m > 0), "push": of(lambda m: m == 0), "lose": of(lambda m: m < 0)}

    def draw_no_bet(self) -> Column:
        """Win of the home side where a draw returns the stake."""
        win, loss = self.probability(PICKS["win"]), self.probability(PICKS["loss"])
        return F.try_divide(win, win + loss)

    def top(self, k: int = 5) -> Column:
        """The ``k`` likeliest scores as an array of (i, j, p), ties in the order of i and j."""
        every = [F.struct(F.round(-self.cell(i, j), 12).alias("less"), F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(self.most + 1) for j in range(self.most + 1)]
        return F.slice(F.sort_array(F.array(*every)), 1, k)

    def cells(self, df: DataFrame, *keys: str) -> DataFrame:
        """(keys, i, j, p): every cell as a row."""
        d = df.select(*keys, *self.columns).select("*", F.posexplode(self.x).alias("i", "_px")).select("*", F.posexplode(self.y).alias("j", "_py"))
        more = F.when((F.col("i") < 2) & (F.col("j") < 2), F.get(self.d, 2 * F.col("i") + F.col("j"))).otherwise(0.0)
        return d.select(*keys, "i", "j", ((F.col("_px") * F.col("_py") + more) / self.total).alias("p"))


def _lines(line: float) -> list[float]:
    return [line] if (line * 2) % 1 == 0 else [line - 0.25, line + 0.25]


def markets(grid: DataFrame, key: str) -> DataFrame:
    """Result, totals, both-score and double-chance probabilities of each grid of rows."""
    i, j, p = F.col("i"), F.col("j"), F.col("p")
    return grid.groupBy(key).agg(*[F.sum(F.when(c(i, j), p).otherwise(0.0)).alias(n) for n, c in PICKS.items()])


def total_market(grid: DataFrame, key: str, line: float) -> DataFrame:
    t = F.col("i") + F.col("j")
    return grid.groupBy(key).agg(*[F.sum(F.when(c, F.col("p")).otherwise(0.0)).alias(n) for n, c in (("over", t > line), ("push", t == line), ("under", t < line))])


def handicap_market(grid: DataFrame, key: str, line: float) -> DataFrame:
    """Win, push and lose of the home side at a handicap; a quarter line is the mean of the two beside it."""
    lines, d = _lines(line), F.col("i") - F.col("j")
    share = lambda test: sum((F.when(test(d + x), F.col("p")).otherwise(0.0) for x in lines), F.lit(0.0)) / len(lines)
    return grid.groupBy(key).agg(F.sum(share(lambda m: m > 0)).alias("win"), F.sum(share(lambda m: m == 0)).alias("push"), F.sum(share(lambda m: m < 0)).alias("lose"))
