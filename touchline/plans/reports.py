"""Reports and verdicts: metric blocks, strata, the panel with its intervals, tests of forecasts, gates."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.functions import odds as o
from touchline.operators import fit, resample
from touchline.sources.fixtures import fixture, with_fixtures

from .analytics import MP, PNL, REPS, bets, blocks_sql, losses, r6
from .core import query
from .models import MEANS, means

BETS = with_fixtures("bet")
#: What a bet cost to place, in units; plain SQL for both engines.
COST = "(line_no % 3) / 1e2"


@query("a11_block", BETS + f""", d as (select market, bet_date, sum({PNL}) p from fx_bet group by 1, 2), e as (select market, bet_date, sum(p) over (partition by market order by bet_date) eq from d),
w as (select market, max(greatest(0, peak) - eq) drawdown from (select market, eq, max(eq) over (partition by market order by bet_date) peak from e) group by 1),
b as (select *, case when bet_at = 'open' then odd * model_prob - 1 end clv from fx_bet),
m as (select market, count(*) matured, avg(won) win_rate, avg({PNL}) roi_gross, avg({PNL} - {COST}) roi_net, avg(clv) clv_mean, median(clv) clv_median, avg(case when clv > 0 then 1e0 when clv is not null then 0e0 end) clv_positive_rate,
count(*) filter (where clv < 0) clv_negative, count(*) filter (where clv = 0) clv_zero, count(*) filter (where clv > 0) clv_positive, avg(pow(model_prob - won, 2)) brier,
avg(-ln(greatest(case when won = 1 then model_prob else 1 - model_prob end, 1e-12))) log_loss, avg(odd) odds_mean, avg(model_prob - 1 / odd) ev_predicted, sum({PNL}) pnl_total from b group by 1)
select market, matured, round(win_rate, 6) win_rate, round(roi_gross, 6) roi_gross, round(roi_net, 6) roi_net, round(clv_mean, 6) clv_mean, round(clv_median, 6) clv_median, round(clv_positive_rate, 6) clv_positive_rate, clv_negative, clv_zero, clv_positive,
round(brier, 6) brier, round(log_loss, 6) log_loss, round(odds_mean, 6) odds_mean, round(ev_predicted, 6) ev_predicted, round(pnl_total, 4) pnl_total, round(drawdown, 4) drawdown from m join w using (market)""")
def a11_block(spark, sf):
    """The whole block of metrics of each market; costs count, and the drawdown is that of the days' balance."""
    from .analytics import w05

    clv = F.when(F.col("bet_at") == "open", F.col("odd") * F.col("model_prob") - 1)
    own = F.when(F.col("won") == 1, F.col("model_prob")).otherwise(1 - F.col("model_prob"))
    b = bets(spark, sf).withColumn("clv", clv)
    six = {
        "win_rate": F.avg("won"), "roi_gross": F.avg("pnl"), "roi_net": F.avg(F.col("pnl") - F.expr(COST)), "clv_mean": F.avg("clv"), "clv_median": F.median("clv"),
        "clv_positive_rate": F.avg((F.col("clv") > 0).cast("double")), "brier": F.avg(F.pow(F.col("model_prob") - F.col("won"), F.lit(2))), "log_loss": F.avg(o.log_loss(own)),
        "odds_mean": F.avg("odd"), "ev_predicted": F.avg(o.edge("model_prob", "odd")),
    }
    signs = {"clv_negative": F.col("clv") < 0, "clv_zero": F.col("clv") == 0, "clv_positive": F.col("clv") > 0}
    m = b.groupBy("market").agg(F.count("*").alias("matured"), *[r6(c).alias(n) for n, c in six.items()], *[F.count_if(c).alias(n) for n, c in signs.items()], F.round(F.sum("pnl"), 4).alias("pnl_total"))
    return m.join(w05(spark, sf).select("market", F.col("max_drawdown").alias("drawdown")), "market")


TEAM_LEAST = 10
PANEL = (
    MP + f""", {MEANS}, h as (select event_id, case when row_number() over (partition by season order by match_date, event_id) <= count(*) over (partition by season) // 2 then 'T1' else 'T2' end half from fx_match),
k as (select l.*, month(m.match_date) month_no, m.home, greatest(pw, pd, 1 - pw - pd) top, lam + mu lt, half from l join p using (price_id) join fx_match m on m.event_id = l.price_id join e on e.event_id = l.price_id join h on h.event_id = l.price_id)"""
)


def panel(spark, sf) -> DataFrame:
    """Losses of each match with what strata go by."""
    p = fixture(spark, sf, "price").select(F.col("price_id").alias("event_id"), "odd_home", "odd_draw", "odd_away")
    t = 1 / F.col("odd_home") + 1 / F.col("odd_draw") + 1 / F.col("odd_away")
    p = p.select(F.col("event_id").alias("price_id"), (1 / F.col("odd_home") / t).alias("pw"), (1 / F.col("odd_draw") / t).alias("pd"))
    m = fixture(spark, sf, "match").select("season", "match_date", "event_id", "home")
    half = resample.ranked(m.select("season", "match_date", "event_id"), "season", "match_date", "event_id")
    half = half.select(F.col("event_id").alias("price_id"), F.when(F.col("r") + 1 <= F.floor(F.col("n") / 2), "T1").otherwise("T2").alias("half"))
    e = means(spark, sf).select(F.col("event_id").alias("price_id"), (F.col("lam") + F.col("mu")).alias("lt"))
    k = losses(spark, sf).join(p, "price_id").join(m.select(F.col("event_id").alias("price_id"), F.month("match_date").alias("month_no"), "home"), "price_id")
    return k.join(e, "price_id").join(half, "price_id").withColumn("top", F.greatest(F.col("pw"), F.col("pd"), 1 - F.col("pw") - F.col("pd")))


_STRATA = {
    "overall": "'overall'",
    "season": "cast(season as varchar(9))",
    "month": "cast(month_no as varchar(9))",
    "team": "home",
    "probability": "cast(cast(floor(top * 10) as int) as varchar(9))",
    "lambda": "cast(cast(floor(lt) as int) as varchar(9))",
    "half of season": "concat(cast(season as varchar(9)), '-', half)",
}


@query("a15_all_strata", PANEL + f""", s as ({' union all '.join(f"select '{n}' stratum, {c} key, rps, brier, ll from k" for n, c in _STRATA.items())})
select stratum, key, count(*) n, round(avg(rps), 6) rps, round(avg(brier), 6) brier, round(avg(ll), 6) log_loss from s group by 1, 2 having stratum <> 'team' or count(*) >= {TEAM_LEAST}""")
def a15_all(spark, sf):
    """Every stratification in one pass: a row counts once for each of its tags, summed up before the shuffle."""
    tags = F.explode(F.array(*[F.struct(F.lit(n).alias("stratum"), F.expr(c).cast("string").alias("key")) for n, c in _STRATA.items()]))
    s = panel(spark, sf).select(tags.alias("t"), "rps", "brier", "ll").groupBy("t.stratum", "t.key")
    out = s.agg(F.count("*").alias("n"), r6(F.avg("rps")).alias("rps"), r6(F.avg("brier")).alias("brier"), r6(F.avg("ll")).alias("log_loss"))
    return out.filter(f"stratum <> 'team' or n >= {TEAM_LEAST}")


#: Losses of the forecast that gives every match the shares of the results; by the result, as the shares are known.
_BASE = """f as (select count(*) filter (where y = 0) / count(*) f0, count(*) filter (where y = 1) / count(*) f1, count(*) filter (where y = 2) / count(*) f2 from l),
bs as (select price_id, y, rps, brier, ll, 5e-1 * (pow(f0 - (case when y <= 0 then 1 else 0 end), 2) + pow(f0 + f1 - (case when y <= 1 then 1 else 0 end), 2)) rps0,
f0 * f0 + f1 * f1 + f2 * f2 - 2 * (case y when 0 then f0 when 1 then f1 else f2 end) + 1 brier0, -ln(case y when 0 then f0 when 1 then f1 else f2 end) ll0 from l, f)"""


def with_baseline(x: DataFrame) -> DataFrame:
    share = [(F.count_if(F.col("y") == k) / F.count("*")).alias(f"f{k}") for k in (0, 1, 2)]
    d = x.join(F.broadcast(x.agg(*share)))
    own = F.when(F.col("y") == 0, F.col("f0")).when(F.col("y") == 1, F.col("f1")).otherwise(F.col("f2"))
    squares = sum((F.col(f"f{k}") * F.col(f"f{k}") for k in (1, 2)), F.col("f0") * F.col("f0"))
    return d.withColumns({"rps0": o.rps("f2", "f1", "y"), "brier0": squares - 2 * own + 1, "ll0": -F.ln(own)})


_METRICS = {"rps": ("rps", "rps0"), "brier_1x2": ("brier", "brier0"), "log_loss": ("ll", "ll0")}


@query("q04_panel", MP + f", {_BASE}, " + ", ".join(blocks_sql("bs", "price_id", f"{a} - {b}", f"_{n}") for n, (a, b) in _METRICS.items()) + " " + " union all ".join(
    f"select '{n}' metric, count(*) n, round(avg({a}), 6) as value, round(avg({b}), 6) baseline, round(1 - avg({a}) / avg({b}), 6) skill, (select round(quantile_cont(v, 25e-3), 6) from v_{n}) lo, (select round(quantile_cont(v, 975e-3), 6) from v_{n}) hi from bs" for n, (a, b) in _METRICS.items())
    + " union all select 'accuracy_1x2', count(*), round(avg(case when y = case when 1 - pw - pd >= greatest(pw, pd) then 0 when pd >= pw then 1 else 2 end then 1e0 else 0e0 end), 6), null, null, null, null from p")
def q04(spark, sf):
    """The panel: each loss against that of the results' shares, its skill, and the interval of the difference by blocks."""
    x = with_baseline(losses(spark, sf))
    rows = None
    for n, (a, b) in _METRICS.items():
        d = x.select("price_id", (F.col(a) - F.col(b)).alias("d"))
        ends = resample.bootstrap_mean(resample.moving_blocks(d, "price_id", "d"), "k", REPS, 1 / 21).select(r6("lo").alias("lo"), r6("hi").alias("hi"))
        m = x.agg(F.count("*").alias("n"), r6(F.avg(a)).alias("value"), r6(F.avg(b)).alias("baseline"), r6(1 - F.avg(a) / F.avg(b)).alias("skill"))
        row = m.select(F.lit(n).alias("metric"), "*").join(F.broadcast(ends))
        rows = row if rows is None else rows.unionByName(row)
    loss = 1 - F.col("pw") - F.col("pd")
    said = F.when(loss >= F.greatest("pw", "pd"), 0).when(F.col("pd") >= F.col("pw"), 1).otherwise(2)
    hit = panel(spark, sf).agg(F.count("*").alias("n"), r6(F.avg((said == F.col("y")).cast("double"))).alias("value"))
    return rows.unionByName(hit.select(F.lit("accuracy_1x2").alias("metric"), "n", "value"), allowMissingColumns=True)


H = 3


@query("g07_hln", MP + f""", d as (select price_id, pow(rps, 2) - pow(brier / 3, 2) d from l), x as (select price_id, d - avg(d) over () e, avg(d) over () m from d), z as (select e, m, lag(e, 1) over (order by price_id) e1, lag(e, 2) over (order by price_id) e2 from x),
v as (select count(*) n, max(m) m, avg(e * e) g0, sum(e * e1) / (count(*) - 1) g1, sum(e * e2) / (count(*) - 2) g2 from z), s as (select *, (g0 + 2 * (g1 + g2)) / n s2 from v)
select n, round(m, 6) mean, round(case when s2 > 0 then m / sqrt(s2) * sqrt((n + 1 - 2 * {H} + {H} * ({H} - 1) / cast(n as double)) / n) end, 4) stat from s""")
def g07_hln(spark, sf):
    """Diebold and Mariano's test for squared errors at horizon 3, corrected for small samples; null without variance."""
    return diebold_mariano(losses(spark, sf).select("price_id", (F.pow("rps", F.lit(2)) - F.pow(F.col("brier") / 3, F.lit(2))).alias("d")), "price_id", "d", H).select("n", r6("mean").alias("mean"), F.round("stat", 4).alias("stat"))


def diebold_mariano(rows: DataFrame, order: str, d: str, horizon: int) -> DataFrame:
    """(n, mean, stat) of loss differences ``d``; autocovariances are sums over pairs a lag apart, met by the row's number."""
    m = rows.agg(F.avg(d).alias("mean"), F.count("*").alias("n"))
    e = resample.numbered(rows.select(order, d), order).join(F.broadcast(m.select("mean"))).select("i", (F.col(d) - F.col("mean")).alias("e"))
    z = e
    for k in range(1, horizon):
        z = z.join(e.select((F.col("i") + k).alias("i"), F.col("e").alias(f"e{k}")), "i", "left")
    v = z.agg(F.avg(F.col("e") * F.col("e")).alias("g0"), *[F.sum(F.col("e") * F.col(f"e{k}")).alias(f"g{k}") for k in range(1, horizon)]).join(F.broadcast(m))
    n = F.col("n")
    s2 = sum((2 * F.col(f"g{k}") / (n - k) for k in range(1, horizon)), F.col("g0")) / n
    factor = F.sqrt((n + 1 - 2 * horizon + horizon * (horizon - 1) / n) / n)
    return v.select("n", "mean", F.when(s2 > 0, F.col("mean") / F.sqrt(s2) * factor).alias("stat"))


@query("g07_p_value")
def g07_p(spark, sf):
    """The test's two-sided p-value by Student's distribution, on the one row that it gives."""
    r = g07_hln(spark, sf).first()
    p = fit.student_two_sided(r["stat"], r["n"] - 1) if r["stat"] is not None else None
    return spark.createDataFrame([(r["n"], r["stat"], p)], "n long, stat double, p_value double")


TRIALS = 3
_Z = [NormalDist().inv_cdf(1 - 1 / TRIALS), NormalDist().inv_cdf(1 - 1 / (TRIALS * math.e))]
#: The expected greatest of ``TRIALS`` standard normal values.
GREATEST = (1 - 0.5772156649015329) * _Z[0] + 0.5772156649015329 * _Z[1]


@query("g11_sharpe", BETS + f""", d as (select market, bet_date, sum({PNL}) x from fx_bet group by 1, 2), m as (select market, count(*) n, avg(x) / stddev_samp(x) sr, avg(x) m, avg(x*x) m2, avg(x*x*x) m3, avg(x*x*x*x) m4 from d group by 1),
c as (select *, (m3 - 3*m*m2 + 2*m*m*m) / pow(m2 - m*m, 15e-1) sk, (m4 - 4*m*m3 + 6*m*m*m2 - 3*m*m*m*m) / pow(m2 - m*m, 2) ku from m), v as (select stddev_samp(sr) * {GREATEST!r} sr0 from c),
z as (select *, sr * sqrt(n - 1) / sqrt(1 - sk * sr + (ku - 1) / 4 * sr * sr) za, (sr - sr0) * sqrt(n - 1) / sqrt(1 - sk * sr + (ku - 1) / 4 * sr * sr) zb from c, v)
select market, n, round(sr, 4) sharpe, round({o.normal_cdf_sql('za')}, 4) psr, round(sr0, 4) sr0, round({o.normal_cdf_sql('zb')}, 4) dsr from z""")
def g11_sharpe(spark, sf):
    """Probabilistic and deflated Sharpe ratios of the markets' daily results, deflated by the number of markets tried."""
    d = bets(spark, sf).groupBy("market", "bet_date").agg(F.sum("pnl").alias("x"))
    c = d.groupBy("market").agg(F.count("*").alias("n"), (F.avg("x") / F.stddev_samp("x")).alias("sr"), F.skewness("x").alias("sk"), (F.kurtosis("x") + 3).alias("ku"))
    c = c.join(F.broadcast(c.agg((F.stddev_samp("sr") * GREATEST).alias("sr0"))))
    sr = F.col("sr")
    z = lambda least: (sr - least) * F.sqrt(F.col("n") - 1) / F.sqrt(1 - F.col("sk") * sr + (F.col("ku") - 1) / 4 * sr * sr)
    c = c.withColumns({"za": z(F.lit(0.0)), "zb": z(F.col("sr0"))})
    four = lambda c, n: F.round(c, 4).alias(n)
    return c.select("market", "n", four(sr, "sharpe"), four(o.normal_cdf("za"), "psr"), four(F.col("sr0"), "sr0"), four(o.normal_cdf("zb"), "dsr"))


@query("g12_block_verdict", MP + ", " + blocks_sql("l", "price_id", "rps - brier / 3", "_d") + ", " + blocks_sql("l", "price_id", "ll - brier", "_e") + """,
t as (select (select quantile_cont(v, 25e-3) from v_d) lo, (select quantile_cont(v, 975e-3) from v_d) hi, (select quantile_cont(v, 975e-3) from v_e) guard)
select round((select avg(rps - brier / 3) from l), 6) gain, round(lo, 6) lo, round(hi, 6) hi, case when lo > 0 and not guard < 0 then 'BETTER' when hi < 0 then 'WORSE' else 'UNDECIDED' end verdict from t""")
def g12_blocks(spark, sf):
    """A paired gain by blocks: better if its interval is above 0 and the guard's isn't below."""
    x = losses(spark, sf).select("price_id", (F.col("rps") - F.col("brier") / 3).alias("d"), (F.col("ll") - F.col("brier")).alias("e"))
    d, e = (resample.bootstrap_mean(resample.moving_blocks(x, "price_id", c), "k", REPS, 1 / 21) for c in ("d", "e"))
    t = x.agg(F.avg("d").alias("gain")).join(F.broadcast(d.select("lo", "hi"))).join(F.broadcast(e.select(F.col("hi").alias("guard"))))
    verdict = F.when((F.col("lo") > 0) & ~(F.col("guard") < 0), "BETTER").when(F.col("hi") < 0, "WORSE").otherwise("UNDECIDED")
    return t.select(r6("gain").alias("gain"), r6("lo").alias("lo"), r6("hi").alias("hi"), verdict.alias("verdict"))


#: Names by which trials of a market are registered, and the state of one that is proven.
MARKET_NAMES = {"ou25": ["ou25", "over25"], "btts": ["btts"], "cards": ["cards"]}
PROVEN = "comprovada"


@query("g17_capital_gate", "with t as (select ['ou25', 'over25', 'btts', '1x2'][c_custkey % 4 + 1] market, case when c_custkey % 7 = 3 and c_custkey % 4 < 2 then '" + PROVEN + """' else 'aberta' end status from customer),
a as (select unnest(['ou25', 'ou25', 'btts', 'cards']) market, unnest(['ou25', 'over25', 'btts', 'cards']) named)
select a.market, count(t.market) trials, coalesce(bool_or(t.status = '""" + PROVEN + "'), false) proven from a left join t on t.market = a.named group by 1")
def g17(spark, sf):
    """Markets that a registered trial has proven; the register is JSON, a line a trial."""
    c = spark.read.parquet(f"{sf}/customer.parquet")
    names = F.array(*[F.lit(x) for x in ("ou25", "over25", "btts", "1x2")])
    status = F.when((F.col("c_custkey") % 7 == 3) & (F.col("c_custkey") % 4 < 2), PROVEN).otherwise("aberta")
    line = F.to_json(F.struct(F.struct(F.get(names, (F.col("c_custkey") % 4).cast("int")).alias("market")).alias("params"), status.alias("status")))
    t = c.select(F.from_json(line, "params struct<market:string>, status string").alias("t")).select("t.params.market", "t.status")
    t = t.groupBy(F.col("market").alias("named")).agg(F.count("*").alias("n"), F.bool_or(F.col("status") == PROVEN).alias("ok"))
    a = spark.createDataFrame([(m, x) for m, xs in MARKET_NAMES.items() for x in xs], "market string, named string").join(t, "named", "left")
    return a.groupBy("market").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("trials"), F.coalesce(F.bool_or("ok"), F.lit(False)).alias("proven"))
