"""Pricing and ledgers at fixed parameters; ratings and fits."""

from __future__ import annotations

import datetime as dt
import math
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from touchline.functions import grid as g
from touchline.functions import odds as o
from touchline.functions import special
from touchline.operators import asof, fit, ratings, resample, sliding
from touchline.operators.lineage import cut, tasks_for
from touchline.sources.fixtures import fixture, with_fixtures

from .core import query
from .feeds import new_ledger
from .relational import COMPLETE, closing_books

M, Q, B, S, O, P = (with_fixtures(n) for n in ("match", "quote", "bet", "stat", "obs", "price"))  # noqa: E741
ALPHA, RHO, MOST = 0.1, -0.03, 8


def r6(c):
    return F.round(c, 6)


#: Goal means of all fixtures from a difference that the id fixes.
MEANS = "e as (select event_id, exp(2e-1 + 3e-1 * d / 400) lam, exp(2e-1 - 3e-1 * d / 400) mu from (select event_id, 100e0 + (event_id * 37 % 401) - 200 d from fx_match))"
NB = f"exp(lgamma(k + 1/{ALPHA}) - lgamma(1/{ALPHA}) - lgamma(k + 1) + (1/{ALPHA}) * ln((1/{ALPHA}) / (1/{ALPHA} + m)) + k * ln(m / (1/{ALPHA} + m)))"
POISSON = "exp(k * ln(m) - m - lgamma(k + 1))"


def _grid_sql(pmf: str, most: int = MOST, name: str = "gr") -> str:
    x, y = pmf.replace("(k", "(i").replace("k *", "i *").replace("m)", "lam)").replace(" m ", " lam ").replace("- m -", "- lam -").replace("ln(m /", "ln(lam /"), pmf.replace("(k", "(j").replace("k *", "j *").replace("m)", "mu)").replace(" m ", " mu ").replace("- m -", "- mu -").replace("ln(m /", "ln(mu /")
    t = f"case when i = 0 and j = 0 then 1 - lam * mu * {RHO} when i = 0 and j = 1 then 1 + lam * {RHO} when i = 1 and j = 0 then 1 + mu * {RHO} when i = 1 and j = 1 then 1 - {RHO} else 1 end"
    return f"{name}0 as (select event_id, i, j, greatest(({x}) * ({y}) * ({t}), 0) w from e, range({most + 1}) a(i), range({most + 1}) b(j)), {name} as (select event_id, i, j, w / sum(w) over (partition by event_id) p from {name}0)"


def own_means() -> list:
    """Goal means of both sides, from the id of a match."""
    d = 100.0 + (F.col("event_id") * 37 % 401) - 200
    return [F.exp(0.2 + 0.3 * d / 400).alias("lam"), F.exp(0.2 - 0.3 * d / 400).alias("mu")]


def means(spark: SparkSession, sf: str) -> DataFrame:
    return fixture(spark, sf, "match").select("event_id", *own_means())


def priced(df: DataFrame, alpha: float | None = ALPHA) -> tuple[DataFrame, g.Grid]:
    """Grids of the plans' fixed parameters in the rows of ``df``."""
    return g.with_grid(df, MOST, RHO, alpha=alpha)


def columns(grid: g.Grid, *names: str) -> list:
    """Markets of a grid by name, rounded."""
    every = grid.markets()
    return [r6(every[n]).alias(n) for n in names]


MN, MPO = M + ", " + MEANS + ", " + _grid_sql(NB), M + ", " + MEANS + ", " + _grid_sql(POISSON)


@query("m01_nb_pmf", M + ", " + MEANS + f" select event_id, k, round({NB.replace('m)', 'lam)').replace('ln(m /', 'ln(lam /')}, 9) p from e, range(13) t(k)")
def m01(spark, sf):
    return means(spark, sf).select("event_id", F.posexplode(g.nb_pmf("lam", ALPHA, 12)).alias("k", "p")).select("event_id", F.col("k").cast("long").alias("k"), F.round("p", 9).alias("p"))


@query("m04_score_grid", MN + " select event_id, i, j, round(p, 9) p from gr")
def m04(spark, sf):
    df, grid = priced(means(spark, sf))
    return grid.cells(df, "event_id").select("event_id", F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), F.round("p", 9).alias("p"))


MARKETS = "round(sum(case when i > j then p else 0 end), 6) win, round(sum(case when i = j then p else 0 end), 6) draw, round(sum(case when i + j > 2 then p else 0 end), 6) over25, round(sum(case when i > 0 and j > 0 then p else 0 end), 6) btts, round(sum(case when i >= j then p else 0 end), 6) dc_1x"


@query("m05_grid_markets", MN + f" select event_id, {MARKETS} from gr group by 1")
def m05(spark, sf):
    df, grid = priced(means(spark, sf))
    return df.select("event_id", *columns(grid, "win", "draw", "over25", "btts", "dc_1x"))


@query("m06_remaining_time", M + ", " + MEANS.replace("exp(2e-1 +", "4e-1 * exp(2e-1 +").replace("exp(2e-1 -", "4e-1 * exp(2e-1 -") + ", " + _grid_sql(NB) + " select event_id, round(sum(case when i + 1 > j then p else 0 end), 6) win, round(sum(case when i + 1 = j then p else 0 end), 6) draw from gr group by 1")
def m06(spark, sf):
    """From 1-0 with two fifths of the match to play."""
    df, grid = priced(means(spark, sf).withColumns({"lam": 0.4 * F.col("lam"), "mu": 0.4 * F.col("mu")}))
    win, draw = (grid.probability(lambda i, j, test=test: test(i + 1, j)) for test in (g.PICKS["win"], g.PICKS["draw"]))
    return df.select("event_id", r6(win).alias("win"), r6(draw).alias("draw"))


@query("m07_poisson_markets", MPO + f" select event_id, {MARKETS} from gr group by 1")
def m07(spark, sf):
    df, grid = priced(means(spark, sf), alpha=None)
    return df.select("event_id", *columns(grid, "win", "draw", "over25", "btts", "dc_1x"))


@query("m08_rho_range", M + ", " + MEANS + " select event_id, round(greatest(-1/lam, -1/mu), 6) low, round(least(1/(lam*mu), 1), 6) high, round(least(greatest(9e-1, greatest(-1/lam, -1/mu) + 1e-6), least(1/(lam*mu), 1) - 1e-6), 6) clamped from e")
def m08(spark, sf):
    low, high = g.rho_range("lam", "mu")
    return means(spark, sf).select("event_id", r6(low).alias("low"), r6(high).alias("high"), r6(F.least(F.greatest(F.lit(0.9), low + 1e-6), high - 1e-6)).alias("clamped"))


@query("m09_totals_with_push", MN + " select event_id, round(sum(case when i + j > 3 then p else 0 end), 6) p_over, round(sum(case when i + j = 3 then p else 0 end), 6) push, round(sum(case when i + j < 3 then p else 0 end), 6) p_under from gr group by 1")
def m09a(spark, sf):
    df, grid = priced(means(spark, sf))
    return df.select("event_id", *[r6(c).alias(n) for n, c in zip(("p_over", "push", "p_under"), grid.total_market(3.0).values(), strict=True)])


@query("m09_quarter_handicap", MN + """ select event_id, round(sum(p * ((case when i - j > 1 then 1 else 0 end) + (case when i - j > 5e-1 then 1 else 0 end)) / 2), 6) win, round(sum(p * (case when i - j = 1 then 5e-1 else 0 end)), 6) push, round(sum(p * ((case when i - j < 1 then 1 else 0 end) + (case when i - j < 5e-1 then 1 else 0 end)) / 2), 6) lose from gr group by 1""")
def m09b(spark, sf):
    df, grid = priced(means(spark, sf))
    return df.select("event_id", *[r6(c).alias(n) for n, c in grid.handicap_market(-0.75).items()])


@query("m09_draw_no_bet", MN + """ select event_id, round(sum(case when i > j then p else 0 end) / sum(case when i <> j then p else 0 end), 6) draw_no_bet, round(sum(case when i = 2 and j = 1 then p else 0 end), 6) p_2_1,
round(sum(case when i >= 4 and i > j then p else 0 end), 6) any_other_home from gr group by 1""")
def m09c(spark, sf):
    """Draw no bet, one exact score, and all home wins by four goals or more together."""
    df, grid = priced(means(spark, sf))
    other = grid.probability(lambda i, j: i >= 4 and i > j)
    return df.select("event_id", r6(grid.draw_no_bet()).alias("draw_no_bet"), r6(grid.cell(2, 1)).alias("p_2_1"), r6(other).alias("any_other_home"))


@query("m10_blend", M + ", " + MEANS + ", " + _grid_sql(NB) + ", " + _grid_sql(POISSON, name="po") + " select gr.event_id, round(sum(case when gr.i > gr.j then 7e-1 * gr.p + 3e-1 * po.p else 0 end), 6) win from gr join po on gr.event_id = po.event_id and gr.i = po.i and gr.j = po.j group by 1")
def m10(spark, sf):
    df, nb = priced(means(spark, sf))
    df, po = priced(df, alpha=None)
    win = lambda grid: grid.probability(g.PICKS["win"])
    return df.select("event_id", r6(0.7 * win(nb) + 0.3 * win(po)).alias("win"))


LINES = [k + 0.5 for k in range(10)]


@query(
    "m12_count_over",
    M + ", " + MEANS + f""", t as (select event_id, lam + mu m, k, {NB} nb, {POISSON} po from (select *, lam + mu m from e), range(10) x(k))
select event_id, k + 5e-1 line, round(1 - sum(nb) over w, 6) p_over, round(sum(nb) over w, 6) p_under, round(1 - sum(po) over w, 6) p_over_poisson from t window w as (partition by event_id order by k)""",
)
def m12(spark, sf):
    """Events over and under the half lines up to 9.5, with a negative binomial total and with a Poisson one.

    The tail of the highest line is an incomplete beta function; below, each count between two lines is added to it.
    """
    d = means(spark, sf).select("event_id", (F.col("lam") + F.col("mu")).alias("m"))
    return d.join(count_lines(d.select("m").distinct()), "m").drop("m")


def count_lines(means_: DataFrame) -> DataFrame:
    """(m, line, p_over, p_under, p_over_poisson) of means ``m``: equal means are priced once, whatever shares them."""
    d = means_.withColumns({"po": g.poisson_pmf("m", 9), "nb": g.nb_pmf("m", ALPHA, 9), "top": special.count_over("m", F.lit(ALPHA), F.lit(9.5))})
    d = d.select("*", F.posexplode(F.array(*map(F.lit, LINES))).alias("k", "line"))
    total = lambda a, x: a + x
    over = F.aggregate(F.slice("nb", F.col("k") + 2, 10), F.col("top"), total)
    poisson = 1 - F.aggregate(F.slice("po", F.lit(1), F.col("k") + 1), F.lit(0.0), total)
    return d.select("m", "line", r6(over).alias("p_over"), r6(1 - over).alias("p_under"), r6(poisson).alias("p_over_poisson"))


@query("t01_top_scores", MN + " select event_id, i, j, r rank_no from (select *, row_number() over (partition by event_id order by round(p, 12) desc, i, j) r from gr) where r <= 5")
def t01(spark, sf):
    df, grid = priced(means(spark, sf))
    best = df.select("event_id", F.posexplode(grid.top()).alias("n", "x"))
    return best.select("event_id", F.col("x.i").cast("long").alias("i"), F.col("x.j").cast("long").alias("j"), (F.col("n") + 1).cast("long").alias("rank_no"))


@query("m16_fair_odds", MN + ", w as (select event_id, sum(case when i > j then p else 0 end) w from gr group by 1) select event_id, case when w > 1e-6 then round(1 / w, 4) end fair from w")
def m16(spark, sf):
    df, grid = priced(means(spark, sf))
    w = grid.probability(g.PICKS["win"])
    return df.select("event_id", F.when(w > 1e-6, F.round(1 / w, 4)).alias("fair"))


@query("m17_objective", M + f", e as (select event_id, home_score hs, away_score aws, exp(2e-1 + 3e-1 * d / 400) lam, exp(2e-1 - 3e-1 * d / 400) mu from (select *, 100e0 + (event_id * 37 % 401) - 200 d from fx_match where home_score is not null)) select count(*) n, round(-sum(ln({NB.replace('(k', '(hs').replace('k *', 'hs *').replace('m)', 'lam)').replace('ln(m /', 'ln(lam /')}) + ln({NB.replace('(k', '(aws').replace('k *', 'aws *').replace('m)', 'mu)').replace('ln(m /', 'ln(mu /')})), 3) nll from e")
def m17_objective(spark, sf):
    """The negative log-likelihood at fixed parameters as one aggregate."""
    d = 100.0 + (F.col("event_id") * 37 % 401) - 200
    m = fixture(spark, sf, "match").filter("home_score is not null")
    m = m.select(F.exp(0.2 + 0.3 * d / 400).alias("lam"), F.exp(0.2 - 0.3 * d / 400).alias("mu"), "home_score", "away_score")
    ll = F.ln(g.nb_pmf("lam", ALPHA, 8)[F.col("home_score")]) + F.ln(g.nb_pmf("mu", ALPHA, 8)[F.col("away_score")])
    return m.agg(F.count("*").alias("n"), F.round(-F.sum(ll), 3).alias("nll"))


def _shin_sql(src: str, keys: str, odds: list[str], name: str = "sh") -> str:
    b = " + ".join(f"1/{x}" for x in odds)
    p = lambda x, z: f"(sqrt({z}*{z} + 4*(1-{z})*(1/{x})*(1/{x})/b) - {z}) / (2*(1-{z}))"
    s = lambda z: " + ".join(p(x, z) for x in odds)
    raw = {x: f"case when b <= 1 then (1/{x})/b else {p(x, 'z')} end" for x in odds}
    t = " + ".join(f"r_{x}" for x in odds)
    return (
        f"{name}0 as (select {keys}, {', '.join(odds)}, {b} b, 0e0 lo, 999999e-6 hi, 0 k from {src} union all select {keys}, {', '.join(odds)}, b, case when {s('((lo+hi)/2)')} > 1 then (lo+hi)/2 else lo end, case when {s('((lo+hi)/2)')} > 1 then hi else (lo+hi)/2 end, k + 1 from {name}0 where k < 60), "
        f"{name}1 as (select {keys}, {', '.join(odds)}, b, case when b <= 1 then 0e0 else (lo+hi)/2 end z from {name}0 where k = 60), {name}2 as (select *, {', '.join(f'{v} r_{x}' for x, v in raw.items())} from {name}1), "
        f"{name} as (select {keys}, {', '.join(odds)}, z, {', '.join(f'r_{x} / ({t}) p_{x}' for x in odds)} from {name}2)"
    )


@query("m14_shin", Q + ", " + COMPLETE + ", " + _shin_sql("m", "match_id, book", ["oh", "od", "oa"]) + " select match_id, book, round(z, 6) z, round(p_oh, 6) p_home, round(p_od, 6) p_draw, round(p_oa, 6) p_away from sh")
def m14(spark, sf):
    s = o.with_shin(closing_books(fixture(spark, sf, "quote")), ["oh", "od", "oa"])
    return s.select("match_id", "book", r6("z").alias("z"), r6("p_oh").alias("p_home"), r6("p_od").alias("p_draw"), r6("p_oa").alias("p_away"))


@query("m15_proportional", Q + ", " + COMPLETE + " select match_id, book, round(1/oh/(1/oh+1/od+1/oa), 6) p_home, round(1/od/(1/oh+1/od+1/oa), 6) p_draw from m where 1/oh+1/od+1/oa > 1")
def m15(spark, sf):
    b = closing_books(fixture(spark, sf, "quote")).withColumn("t", 1 / F.col("oh") + 1 / F.col("od") + 1 / F.col("oa"))
    return b.filter("t > 1").select("match_id", "book", r6(1 / F.col("oh") / F.col("t")).alias("p_home"), r6(1 / F.col("od") / F.col("t")).alias("p_draw"))


@query("m24_decision", B + " select game_id, line_no, case when (model_prob - 5e-2) * odd - 1 > 2e-2 then 'BET' else 'NO_BET' end decision, round(1e-9 + case when (model_prob - 5e-2) * odd - 1 > 2e-2 then least(25e-2, 1e-1 * ((model_prob - 5e-2) * odd - 1) / (odd - 1)) else 0 end, 4) stake from fx_bet")
def m24(spark, sf):
    ev = o.expected_value(F.col("model_prob") - 0.05, "odd")
    stake = F.when(ev > 0.02, F.least(F.lit(0.25), 0.1 * ev / (F.col("odd") - 1))).otherwise(0.0)
    return fixture(spark, sf, "bet").select("game_id", "line_no", F.when(ev > 0.02, "BET").otherwise("NO_BET").alias("decision"), F.round(stake + 1e-9, 4).alias("stake"))


@query("m26_groups", "with recursive e as (select distinct c_custkey % 97 a, (c_custkey % 97) // 4 * 4 + c_nationkey % 3 b from customer), u as (select a, b from e union select b, a from e union select a, a from e union select b, b from e), r as (select a, b from u union select r.a, u.b from r join u on r.b = u.a), c as (select a node, min(b) grp from r group by 1) select grp, count(*) n, max(node) last from c group by 1 having count(*) = 4")
def m26(spark, sf):
    """Connected components of exactly four nodes, by labels that fall to the least neighbour until nothing changes."""
    c = spark.read.parquet(f"{sf}/customer.parquet")
    node = F.col("c_custkey") % 97
    e = c.select(node.alias("a"), (F.floor(node / 4) * 4 + F.col("c_nationkey") % 3).alias("b")).distinct()
    labels = ratings.component_labels(e)
    return labels.groupBy(F.col("component").alias("grp")).agg(F.count("*").alias("n"), F.max("id").alias("last")).filter("n = 4")


@query("m28_elasticity", M + ", " + MEANS + " select floor(abs(ln(lam / mu)) * 10) bin, count(*) n, round(avg(lam + mu), 6) total, round(avg(2 * exp(2e-1) * cosh(ln(lam / mu) / 2)), 6) analytic from e group by 1")
def m28(spark, sf):
    m = means(spark, sf).withColumn("d", F.ln(F.col("lam") / F.col("mu")))
    return m.groupBy(F.floor(F.abs("d") * 10).alias("bin")).agg(F.count("*").alias("n"), r6(F.avg(F.col("lam") + F.col("mu"))).alias("total"), r6(F.avg(2 * F.exp(F.lit(0.2)) * F.cosh(F.col("d") / 2))).alias("analytic"))


MODEL = "case selection when 'home' then 42e-2 when 'draw' then 28e-2 else 3e-1 end"


def _ledger_sql(tail: str) -> str:
    return Q + ", " + COMPLETE + ", " + _shin_sql("m", "match_id, book", ["oh", "od", "oa"]) + """, op as (select match_id, book, selection, arg_min(odd, (captured_at, quote_id)) odd_open from fx_quote where captured_at < kickoff_at and odd > 1 group by 1, 2, 3),
l as (select match_id, book, 'home' selection, oh odd_close, p_oh fair from sh union all select match_id, book, 'draw', od, p_od from sh union all select match_id, book, 'away', oa, p_oa from sh),
j as (select l.*, op.odd_open, case when op.odd_open <> odd_close then 'open' else 'close' end bet_at, coalesce(op.odd_open, odd_close) price from l left join op using (match_id, book, selection)),
k as (select *, """ + MODEL + " prob from j), b as (select match_id, book, selection, bet_at, price, round(prob - 1/price, 6) edge, round(price * fair - 1, 4) clv from k where prob - 1/price > 2e-2 and prob - 1/price <= 15e-2)" + tail


def closing_line_ledger(quotes: DataFrame) -> DataFrame:
    """Selections with an edge at the opening price, held against Shin's fair probability of the book's closing prices."""
    pre = quotes.filter((F.col("captured_at") < F.col("kickoff_at")) & o.is_price("odd"))
    opening = asof.latest(pre, ["match_id", "book", "selection"], ["odd"], ["captured_at", "quote_id"], earliest=True).select("match_id", "book", "selection", F.col("odd").alias("odd_open"))
    books = o.with_shin(closing_books(quotes), ["oh", "od", "oa"])
    sides = F.explode(F.array(*[F.struct(F.lit(n).alias("selection"), F.col(c).alias("odd_close"), F.col(f"p_{c}").alias("fair")) for n, c in (("home", "oh"), ("draw", "od"), ("away", "oa"))]))
    long = books.select("match_id", "book", sides.alias("x")).select("match_id", "book", "x.*").join(opening, ["match_id", "book", "selection"], "left")
    prob = F.when(F.col("selection") == "home", 0.42).when(F.col("selection") == "draw", 0.28).otherwise(0.3)
    long = long.withColumns({"price": F.coalesce("odd_open", "odd_close"), "prob": prob, "bet_at": F.when(F.col("odd_open") != F.col("odd_close"), "open").otherwise("close")})
    return long.filter(o.has_edge("prob", "price")).select("match_id", "book", "selection", "bet_at", "price", r6(o.edge("prob", "price")).alias("edge"), F.round(F.col("price") * F.col("fair") - 1, 4).alias("clv"))


@query("q01_closing_line_ledger", _ledger_sql(" select * from b"))
def q01(spark, sf):
    return closing_line_ledger(fixture(spark, sf, "quote"))


@query("q01_ledger_by_book", _ledger_sql(" select book, bet_at, count(*) n, round(avg(clv), 4) clv, round(avg(case when clv > 0 then 1 else 0 end), 6) beat_rate from b group by 1, 2"))
def q01b(spark, sf):
    led = closing_line_ledger(fixture(spark, sf, "quote"))
    return led.groupBy("book", "bet_at").agg(F.count("*").alias("n"), F.round(F.avg("clv"), 4).alias("clv"), r6(F.avg((F.col("clv") > 0).cast("int"))).alias("beat_rate"))


@query("q06_residual_dataset", Q + """, a as (select match_id, book, selection, arg_max(odd, (captured_at, quote_id)) odd from fx_quote where captured_at <= kickoff_at - interval '24' hour and odd > 1 group by 1, 2, 3),
w as (select match_id, book, max(odd) filter (where selection = 'home') h, max(odd) filter (where selection = 'draw') d, max(odd) filter (where selection = 'away') a from a group by 1, 2), c as (select *, (1/h) / (1/h + 1/d + 1/a) p from w where h is not null and d is not null and a is not null)
select match_id, count(*) books, max(h) best, round(median(p), 6) fair, round(coalesce(stddev_pop(p), 0), 6) spread, round(ln(1 + count(*)), 6) log_books from c group by 1""")
def q06(spark, sf):
    q = fixture(spark, sf, "quote")
    early = (F.col("captured_at") <= F.col("kickoff_at") - F.expr("interval '24' hour")) & o.is_price("odd")
    a = asof.latest(q, ["match_id", "book", "selection"], ["odd"], ["captured_at", "quote_id"], early)
    w = a.groupBy("match_id", "book").agg(*[F.max(F.when(F.col("selection") == s, F.col("odd"))).alias(c) for s, c in (("home", "h"), ("draw", "d"), ("away", "a"))]).dropna()
    w = w.withColumn("p", (1 / F.col("h")) / (1 / F.col("h") + 1 / F.col("d") + 1 / F.col("a")))
    return w.groupBy("match_id").agg(F.count("*").alias("books"), F.max("h").alias("best"), r6(F.median("p")).alias("fair"), r6(F.stddev_pop("p")).alias("spread"), r6(F.log1p(F.count("*"))).alias("log_books"))


def _emit_sql(start: int, end: int) -> str:
    """The candidates of a window of minutes before kick-off, and the best of each match."""
    return f"""(select match_id, book, selection, odd, quote_id, {MODEL} * odd - 1 ev from fx_quote where captured_at >= kickoff_at - interval '{start}' minute and captured_at < kickoff_at - interval '{end}' minute and book in ('view', 'click'))"""


@query(
    "q08_emit",
    Q
    + f""", c1 as {_emit_sql(1440, 720)}, c2 as {_emit_sql(720, 0)}, f as (select distinct match_id from fx_quote),
b1 as (select * from (select *, row_number() over (partition by match_id order by ev desc, quote_id) n from c1 where ev > 2e-2) where n = 1),
b2 as (select * from (select *, row_number() over (partition by match_id order by ev desc, quote_id) n from c2 where ev > 2e-2) where n = 1)
select f.match_id, case when b1.match_id is not null then 'ALREADY_DECIDED' when c.match_id is null then 'NO_EXECUTABLE_QUOTE' when b2.match_id is null then 'NO_SELECTION' else 'EMITTED' end status,
 coalesce(b1.book, b2.book) book, coalesce(b1.selection, b2.selection) selection, coalesce(b1.odd, b2.odd) odd
from f left join (select distinct match_id from c2) c using (match_id) left join b1 using (match_id) left join b2 using (match_id)""",
)
def q08(spark, sf):
    """Decisions of the last twelve hours; what the twelve hours before have decided stays as it is in the ledger."""
    q = fixture(spark, sf, "quote")
    prob = F.when(F.col("selection") == "home", 0.42).when(F.col("selection") == "draw", 0.28).otherwise(0.3)

    def window(start: int, end: int):
        c = q.filter(f"captured_at >= kickoff_at - interval '{start}' minute and captured_at < kickoff_at - interval '{end}' minute and book in ('view', 'click')").withColumn("ev", o.expected_value(prob, "odd"))
        c = c.withColumn("first", -F.col("quote_id"))
        return c, asof.latest(c, ["match_id"], ["book", "selection", "odd"], ["ev", "first"], F.col("ev") > 2e-2).select("match_id", "book", "selection", "odd", F.lit(start).alias("run"))

    decided = new_ledger(spark, "decisions", window(720, 0)[1], ["match_id"])
    for start, end in ((1440, 720), (720, 0)):
        c, best = window(start, end)
        decided.append(best)
    seen = c.select("match_id", F.lit(True).alias("seen")).distinct()
    f = q.select("match_id").distinct().join(seen, "match_id", "left").join(decided.read(), "match_id", "left")
    status = F.when(F.col("run") == 1440, "ALREADY_DECIDED").when(F.col("run") == 720, "EMITTED").when(F.col("seen").isNull(), "NO_EXECUTABLE_QUOTE").otherwise("NO_SELECTION")
    return f.select("match_id", status.alias("status"), "book", "selection", "odd")


@query("q12_missed_windows", Q + " select distinct match_id, kickoff_at from fx_quote f where not exists (select 1 from fx_quote q where q.match_id = f.match_id and q.captured_at >= f.kickoff_at - interval '105' minute and q.captured_at < f.kickoff_at)")
def q12(spark, sf):
    q = fixture(spark, sf, "quote")
    hit = q.filter("captured_at >= kickoff_at - interval '105' minute and captured_at < kickoff_at").select("match_id")
    return q.select("match_id", "kickoff_at").distinct().join(hit, "match_id", "left_anti")


@query("q18_shopping", Q + """, l as (select match_id, book, selection, arg_max(odd, (captured_at, quote_id)) odd from fx_quote group by 1, 2, 3), c as (select match_id, selection, median(1/odd) p, max(odd) best, count(*) books from l group by 1, 2), n as (select *, p / sum(p) over (partition by match_id) fair from c)
select match_id, selection, case when books < 3 then 'informative' when fair - 1/best >= 2e-2 then 'note' else 'none' end verdict from n""")
def q18(spark, sf):
    last = asof.latest(fixture(spark, sf, "quote"), ["match_id", "book", "selection"], ["odd"], ["captured_at", "quote_id"])
    c = last.groupBy("match_id", "selection").agg(F.median(1 / F.col("odd")).alias("p"), F.max("odd").alias("best"), F.count("*").alias("books"))
    c = c.withColumn("fair", F.col("p") / F.sum("p").over(Window.partitionBy("match_id")))
    return c.select("match_id", "selection", F.when(F.col("books") < 3, "informative").when(F.col("fair") - 1 / F.col("best") >= 0.02, "note").otherwise("none").alias("verdict"))


@query("q20_lifecycle", Q + """, s as (select match_id, count(*) n, max(captured_at) last, max(kickoff_at) ko, count(distinct book) b from fx_quote group by 1) select match_id, case when last >= ko + interval '48' hour then 'COMPLETE' when last >= ko then 'STARTED' when b >= 3 then 'SNAPSHOT' when n > 1 then 'VALIDATED' else 'DISCOVERED' end state from s""")
def q20(spark, sf):
    s = fixture(spark, sf, "quote").groupBy("match_id").agg(F.count("*").alias("n"), F.max("captured_at").alias("last"), F.max("kickoff_at").alias("ko"), F.count_distinct("book").alias("b"))
    state = F.when(F.expr("last >= ko + interval '48' hour"), "COMPLETE").when(F.expr("last >= ko"), "STARTED").when(F.col("b") >= 3, "SNAPSHOT").when(F.col("n") > 1, "VALIDATED").otherwise("DISCOVERED")
    return s.select("match_id", state.alias("state"))


def played(spark, sf) -> DataFrame:
    return fixture(spark, sf, "match").filter("home_score is not null")


#: The same recursion match by match: both ratings fade, then one side wins what the other loses. Teams are T0 to T19.
ELO_SQL = (
    with_fixtures("match")
    + """, mm as (select row_number() over (order by match_date, event_id) i, *, datediff('day', date '1970-01-01', match_date) d,
  cast(substr(home, 2) as int) + 1 h, cast(substr(away, 2) as int) + 1 a,
  case when tournament = '1-URGENT' then 60e0 when tournament = '2-HIGH' then 50e0 when lower(tournament) like '%specified%' then 40e0 else 30e0 end
  * case when abs(home_score - away_score) <= 1 then 1e0 when abs(home_score - away_score) = 2 then 1.5e0 else 1.75e0 + (abs(home_score - away_score) - 3) / 8e0 end k,
  case when home_score > away_score then 1e0 when home_score = away_score then 5e-1 else 0e0 end won
  from fx_match where home_score is not null),
st as (select cast(0 as bigint) i, cast(null as bigint) event_id, list_transform(range(20), lambda x: 1500e0) rt, list_transform(range(20), lambda x: cast(null as bigint)) seen, cast(null as double) diff, cast(null as double) hr, cast(null as double) ar
 union all
 select i, event_id, list_transform(rt, lambda x, j: case when j = h then hr + step when j = a then ar - step else x end), list_transform(seen, lambda x, j: case when j = h or j = a then d else x end), diff, hr + step, ar - step
 from (select *, k * (won - 1 / (1 + pow(10, -diff / 400))) step from (select *, hr - ar + case when is_neutral = 1 then 0 else 100 end diff
 from (select mm.*, rt, seen, 1500 + (rt[h] - 1500) * coalesce(pow(0.5, (d - seen[h]) / 365.25 / 4), 1) hr, 1500 + (rt[a] - 1500) * coalesce(pow(0.5, (d - seen[a]) / 365.25 / 4), 1) ar from st join mm on mm.i = st.i + 1)))),
elo as (select mm.tournament, mm.event_id, mm.match_date, mm.season, mm.home, mm.away, mm.home_score, mm.away_score, st.diff, st.hr home_rating, st.ar away_rating, mm.i from st join mm using (i))"""
)


@query("w11_elo", ELO_SQL + " select tournament, event_id, match_date, season, home, away, home_score, away_score, round(diff, 4) diff, round(home_rating, 4) home_rating, round(away_rating, 4) away_rating from elo")
def w11(spark, sf):
    """Ratings before and after each match, a recursion in date order over all competitions of a pool of teams."""
    return ratings.elo(played(spark, sf)).withColumns({c: F.round(c, 4) for c in ("diff", "home_rating", "away_rating")})


@query(
    "j23_rating_lookup",
    ELO_SQL
    + """, known as (select team, match_date, arg_max(rating, i) rating from (select home team, match_date, home_rating rating, i from elo union all select away, match_date, away_rating, i from elo) group by 1, 2)
 select m.event_id, round(coalesce(h.rating, 1500e0), 4) home_rating, round(coalesce(a.rating, 1500e0), 4) away_rating from fx_match m
 asof left join known h on h.team = m.home and h.match_date < m.match_date asof left join known a on a.team = m.away and a.match_date < m.match_date""",
)
def j23(spark, sf):
    """Every match, played or not, with the ratings of both sides as they were before its day."""
    m = fixture(spark, sf, "match")
    got = ratings.before_each_day(m, ratings.elo(played(spark, sf)))
    return got.withColumns({c: F.round(c, 4) for c in ("home_rating", "away_rating")})


#: The recursion afresh for each first day of a year, over what it is to see.
SNAPSHOT_SQL = (
    ELO_SQL.replace("row_number() over (order by match_date, event_id) i, *", "row_number() over (partition by asof_day order by match_date, event_id) i, *")
    .replace("from fx_match where home_score is not null)", "from (select * from fx_match where home_score is not null) m join (select make_date(y, 1, 1) asof_day from (select unnest(range(min(season) + 1, max(season) + 1)) y from fx_match where home_score is not null)) on match_date < asof_day and match_date >= asof_day - 1461)")
    .replace("st as (select cast(0 as bigint) i", "st as (select distinct asof_day, cast(0 as bigint) i")
    .replace("cast(null as double) ar\n union", "cast(null as double) ar from mm\n union")
    .replace("select i, event_id, list_transform(rt", "select asof_day, i, event_id, list_transform(rt")
    .replace("on mm.i = st.i + 1", "on mm.asof_day = st.asof_day and mm.i = st.i + 1")
    .partition(",\nelo as")[0]
    + ", shot as (select asof_day \"at\", concat('T', t - 1) team, round(rt[t], 4) rating from (select asof_day, arg_max(rt, i) rt, arg_max(seen, i) seen from st group by asof_day), range(1, 21) x(t) where seen[t] is not null)"
)


def snapshot_dates(m: DataFrame) -> list[dt.date]:
    """The first day of every year but the first."""
    low, high = m.agg(F.min("season"), F.max("season")).first()
    return [dt.date(y, 1, 1) for y in range(low + 1, high + 1)] if low else []


@query("w12_elo_snapshots", SNAPSHOT_SQL + " select * from shot")
def w12(spark, sf):
    """Ratings of every team before each first day of a year, each from the four years before it."""
    m = played(spark, sf)
    return ratings.snapshots(m, snapshot_dates(m)).select("at", "team", F.round("rating", 4).alias("rating"))


PLAIN_SQL = (
    with_fixtures("match")
    + """, mm as (select row_number() over (order by match_date, event_id) i, *, cast(substr(home, 2) as int) + 1 h, cast(substr(away, 2) as int) + 1 a,
  case when home_score > away_score then 1e0 when home_score = away_score then 5e-1 else 0e0 end won from fx_match where home_score is not null),
st as (select cast(0 as bigint) i, cast(null as date) on_day, list_transform(range(20), lambda x: 1500e0) rt, list_transform(range(20), lambda x: 1500e0) morning, cast(null as double) p
 union all
 select i, match_date, list_transform(rt, lambda x, j: case when j = h then x + step when j = a then x - step else x end), known, 1 / (1 + pow(10, -(known[h] + 80 - known[a]) / 400))
 from (select mm.*, rt, 20 * (won - 1 / (1 + pow(10, -(rt[h] + 80 - rt[a]) / 400))) step, case when match_date = on_day then morning else rt end known from st join mm on mm.i = st.i + 1)),
dd as (select match_date, count(*) n, count(*) filter (where home_score = away_score) x from mm group by 1),
db as (select match_date, sum(n) over w n, sum(x) over w / sum(n) over w d from dd window w as (order by match_date rows between unbounded preceding and 1 preceding))
select event_id, round(p * (1 - d), 6) home, round(d, 6) draw, round((1 - p) * (1 - d), 6) away from mm join st using (i) join db using (match_date) where n >= 200"""
)


@query("w13_plain_baseline", PLAIN_SQL)
def w13(spark, sf):
    """A plain rating without decay or margins, and the share of draws: what other models are held against."""
    return ratings.plain_baseline(played(spark, sf)).select("event_id", *[r6(F.col(c)).alias(c) for c in ("home", "draw", "away")])


@query("w14_top_rated", SNAPSHOT_SQL + " select * from shot order by rating desc, team, \"at\" limit 20")
def w14(spark, sf):
    return w12(spark, sf).orderBy(F.desc("rating"), "team", "at").limit(20)


@query("m17_goal_model_fit")
def m17(spark, sf):
    """Parameters by fold, each fitted on what was played strictly before its season."""
    return fit.goal_model_by_fold(ratings.elo(played(spark, sf)), "season")


@query("m18_team_fit")
def m18(spark, sf):
    """Attack and defence of each season's teams by weighted likelihood on what came before, with a half-life of 120 days."""
    return fit.teams_by_fold(played(spark, sf), "season", math.log(2) / 120)


@query("m19_xg_fit")
def m19(spark, sf):
    """The two-stage fit on expected goals, which some matches lack."""
    side = lambda t: F.max(F.when(F.col("team") == t, F.col("value") / 20)).alias(f"{t}_xg")
    xg = fixture(spark, sf, "stat").filter("period = 'ALL'").groupBy("event_id").agg(side("home"), side("away"))
    return fit.xg_by_fold(played(spark, sf).join(xg, "event_id", "left"), "season")


@query("m20_count_fit")
def m20_fit(spark, sf):
    """Counts of both sides with a tilt by the difference of the teams, fitted on earlier folds."""
    side = lambda t: F.max(F.when(F.col("team") == t, F.round("value").cast("int"))).alias(f"{t}_score")
    d = 100.0 + (F.col("event_id") * 37 % 401) - 200
    rows = fixture(spark, sf, "stat").filter("period = 'ALL'").groupBy("event_id").agg(side("home"), side("away")).dropna()
    return fit.counts_by_fold(rows.select((F.col("event_id") % 6).cast("int").alias("fold_no"), d.alias("diff"), "home_score", "away_score"), "fold_no")


@query("q03_prequential")
def q03(spark, sf):
    """Scores of each season under the parameters fitted on earlier seasons."""
    return fit.prequential(ratings.elo(played(spark, sf)), "season")


GUARD_LEAST, GUARD_EVERY, GUARD_HALF_LIFE = 200, 500, 120.0


@query("q03_guarded")
def q03_guarded(spark, sf):
    """Scores by season of team strengths refitted as matches go by, and what the guard of kick-offs has kept out.

    No fit sees the day of the match it is for; a team that no fit has seen counts as average.
    """
    obs, fits = sliding.guarded(played(spark, sf), math.log(2) / GUARD_HALF_LIFE, GUARD_LEAST, GUARD_EVERY)
    fits = cut(fits, "guarded-fits")
    x = obs.filter("k is not null")
    for side in ("home", "away"):
        x = x.join(fits.select("k", F.col("team").alias(side), F.col("attack").alias(f"{side}_attack"), F.col("defence").alias(f"{side}_defence")), ["k", side], "left")
    x = x.join(fits.groupBy("k").agg(F.first("home_advantage").alias("edge"), F.first("rho").alias("rho")), "k")
    own = lambda c: F.coalesce(c, F.lit(1.0))
    x = x.withColumns({"lam": own("home_attack") * own("away_defence") * F.col("edge"), "mu": own("away_attack") * own("home_defence"), "y": o.ordinal("home_score", "away_score")})
    low, high = g.rho_range("lam", "mu")
    df, grid = g.with_grid(x, 10, F.least(F.greatest("rho", low + 1e-6), high - 1e-6))
    x = df.select(F.year("match_date").alias("season"), "k", "y", *[grid.probability(g.PICKS[n]).alias(n) for n in ("win", "draw", "loss")])
    p = F.when(F.col("y") == 2, F.col("win")).when(F.col("y") == 1, F.col("draw")).otherwise(F.col("loss"))
    hit = [(F.col("y") == k).cast("int") for k in (2, 1, 0)]
    mean = lambda c: F.round(F.avg(c), 4)
    scores = x.groupBy("season").agg(F.count("*").alias("n"), F.count_distinct("k").alias("fits"), mean(o.rps("win", "draw", "y")).alias("rps"), mean(o.brier(["win", "draw", "loss"], hit)).alias("brier"), mean(o.log_loss(p)).alias("logloss"))
    once = fits.groupBy("k", "blocked", "deferred").agg(F.lit(1).alias("x"))
    kept = once.agg(F.count("*").alias("refits"), F.sum("blocked").alias("blocked_observations"), F.max("deferred").alias("deferred_refits"))
    return scores.join(F.broadcast(kept))


@query("m22_design_products", "with l as (select l_orderkey k, l_suppkey s, sum(case when l_linenumber % 2 = 0 then 1 else -1 end) v from lineitem group by 1, 2) select a.s, b.s t, sum(a.v * b.v) xtx from l a join l b on a.k = b.k and a.s <= b.s group by 1, 2 having sum(a.v * b.v) <> 0")
def m22(spark, sf):
    """Entries of X'X of a sparse presence matrix, the normal equations of a ridge over players."""
    x = presence(spark, sf)
    y = x.select("k", F.col("s").alias("t"), F.col("v").alias("w"))
    n = tasks_for(spark, f"{sf}/lineitem.parquet")  # most entries stand once, so they are dealt and not combined before
    return x.join(y, "k").filter("s <= t").repartition(n, "s", "t").groupBy("s", "t").agg(F.sum(F.col("v") * F.col("w")).alias("xtx")).filter("xtx <> 0")


def presence(spark, sf) -> DataFrame:
    """(k, s, v): rows, columns and entries of a sparse matrix of players' presence, +1 and -1 for the sides."""
    path = f"{sf}/lineitem.parquet"
    line = spark.read.parquet(path).repartition(tasks_for(spark, path), "l_orderkey")
    return line.groupBy(F.col("l_orderkey").alias("k"), F.col("l_suppkey").alias("s")).agg(F.sum(F.when(F.col("l_linenumber") % 2 == 0, 1).otherwise(-1)).alias("v"))


@query("m22_right_side", "with l as (select l_orderkey k, l_suppkey s, sum(case when l_linenumber % 2 = 0 then 1 else -1 end) v from lineitem group by 1, 2), m as (select o_orderkey k, (o_orderkey * 7 + o_custkey) % 5 - (o_orderkey * 3 + o_custkey * 11) % 4 y from orders) select s, sum(v * y) xty from l join m using (k) group by 1")
def m22b(spark, sf):
    """Entries of X'y: what each column has in common with the matches' differences."""
    return right_side(spark, sf)


def right_side(spark, sf) -> DataFrame:
    o_ = spark.read.parquet(f"{sf}/orders.parquet")
    y = o_.select(F.col("o_orderkey").alias("k"), ((F.col("o_orderkey") * 7 + F.col("o_custkey")) % 5 - (F.col("o_orderkey") * 3 + F.col("o_custkey") * 11) % 4).alias("y"))
    return presence(spark, sf).join(y, "k").groupBy("s").agg(F.sum(F.col("v") * F.col("y")).alias("xty"))


@query("m22_player_values")
def m22c(spark, sf):
    """Ridge values of players, and their values above replacement: the mean of the lowest fifth."""
    half = m22(spark, sf)
    entries = half.select(F.col("s").alias("i"), F.col("t").alias("j"), F.col("xtx").cast("double").alias("v"))
    entries = entries.union(entries.filter("i <> j").select(F.col("j"), F.col("i"), "v"))
    x = fit.ridge_solution(entries, right_side(spark, sf).select(F.col("s").alias("i"), F.col("xty").alias("b")), 100.0)
    x = resample.numbered(x.withColumnRenamed("i", "player"), "x", "player")
    level = x.filter("i < greatest(1, n * 2 div 10)").agg(F.avg("x").alias("level"))
    return x.join(F.broadcast(level)).select("player", F.col("x").alias("value"), (F.col("x") - F.col("level")).alias("above_replacement"))


def residual_rows(spark, sf) -> DataFrame:
    b = fixture(spark, sf, "bet")
    return b.select("game_id", "line_no", "odd", "bet_date", F.col("won").cast("double").alias("y"), F.ln(F.col("model_prob") / (1 - F.col("model_prob"))).alias("offset"), (1 / F.col("odd")).alias("x1"), (F.col("line_no") / 7).alias("x2"), "model_prob")


@query("m23_residual_fit")
def m23(spark, sf):
    """Logistic regression with the market's log-odds as offset, by Newton steps whose sums are Spark aggregates."""
    return fit.offset_logistic(spark, residual_rows(spark, sf), ["x1", "x2"])


@query("m23_residual_predictions")
def m23_predictions(spark, sf):
    """Probabilities with their intervals by the delta method, from the model as it is stored."""
    rows = residual_rows(spark, sf)
    m = fit.offset_models(rows.withColumn("fold", F.lit(0)), ["x1", "x2"])[0]
    p, low, high = fit.OffsetModel.from_json(m.to_json()).columns(F.col("offset"))
    return rows.select("game_id", "line_no", p.alias("p"), low.alias("low"), high.alias("high"))


FOLDS = 6


@query("q07_residual_walk_forward")
def q07(spark, sf):
    """Each later sixth of the bets, in order, under a model of those that were settled before its first prediction.

    A bet is predicted on its day and settled two days later. It counts where even the low end of its chance pays 2 %.
    """
    rows = resample.numbered(residual_rows(spark, sf), "bet_date", "game_id", "line_no").withColumn("fold", F.floor(F.col("i") * FOLDS / F.col("n")).cast("int"))
    first = rows.groupBy(F.col("fold").alias("of")).agg(F.min("bet_date").alias("first")).filter("of > 0")
    train = rows.drop("fold").join(F.broadcast(first), F.date_add("bet_date", 2) <= F.col("first")).withColumnRenamed("of", "fold")
    models = fit.offset_models(train, ["x1", "x2"], ridge=5.0)
    if not models:
        return spark.createDataFrame([], "fold int, n long, selected long, model_brier double, market_brier double, model_log_loss double, market_log_loss double, roi double")
    of = lambda k: reduce(lambda a, f: F.when(F.col("fold") == f, models[f].columns(F.col("offset"))[k]).otherwise(a), models, F.lit(None))
    x = rows.filter(F.col("fold").isin(list(models))).withColumns({"p": of(0), "low": of(1)})
    bet = o.expected_value("low", "odd") > 0.02
    own = lambda p: F.when(F.col("y") == 1, p).otherwise(1 - p)
    loss = {"brier": lambda p: F.pow(p - F.col("y"), F.lit(2)), "log_loss": lambda p: o.log_loss(own(p))}
    means_ = [F.avg(f(F.col(p))).alias(f"{n}_{k}") for k, f in loss.items() for n, p in (("model", "p"), ("market", "model_prob"))]
    pnl = F.when(F.col("y") == 1, F.col("odd") - 1).otherwise(-1.0)
    return x.groupBy("fold").agg(F.count("*").alias("n"), F.count_if(bet).alias("selected"), *means_, F.avg(F.when(bet, pnl)).alias("roi"))


@query("m25_tournament")
def m25(spark, sf):
    """Chances of stages of the sixteen best rated teams, drawn into groups by their ranks, by seeded simulation."""
    last = w12(spark, sf).groupBy("team").agg(F.max_by("rating", "at").alias("rating"))
    n = Window.orderBy(F.desc("rating"), "team")  # the teams of the last year
    best = last.withColumn("n", F.row_number().over(n)).filter("n <= 16")
    return ratings.tournament(spark, best.select("team", ((F.col("n") - 1) % 4).alias("grp"), "rating"), 2000)
