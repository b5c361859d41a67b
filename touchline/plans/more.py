"""Further operators: feeds by role, funnels, sweeps, walk-forward blocks, audits and serving at fixed parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from touchline.functions import grid as g
from touchline.functions import odds as o
from touchline.functions import special
from touchline.operators import asof, fit, resample
from touchline.sources import feeds
from touchline.sources.fixtures import fixture, with_fixtures

from .analytics import MP, PNL, bets, losses
from .core import query
from .models import ALPHA, MEANS, MN, MOST, NB, RHO, _grid_sql, means, priced

M, Q, B, S, P = (with_fixtures(n) for n in ("match", "quote", "bet", "stat", "price"))


def r6(c):
    return F.round(c, 6)


@query(
    "s07_first_statistic",
    S + """, a as (select * from fx_stat where period = 'ALL' and stat_name in ('stat_N', 'stat_R')), f as (select event_id, min(stat_name) stat_name from a group by 1)
select event_id, round(max(value) filter (where team = 'home'), 4) home_value, round(max(value) filter (where team = 'away'), 4) away_value from a join f using (event_id, stat_name) group by 1""",
)
def s07(spark, sf):
    """The first item of the whole-match period whose name contains a text, from JSON payloads."""
    s = fixture(spark, sf, "stat").filter("stat_name in ('stat_N', 'stat_R')").groupBy("event_id", "period", "stat_name").agg(*[F.max(F.when(F.col("team") == t, F.round("value", 4).cast("string"))).alias(t) for t in ("home", "away")])
    groups = s.groupBy("event_id", "period").agg(F.array_sort(F.collect_list(F.struct(F.col("stat_name").alias("name"), "home", "away"))).alias("statisticsItems"))
    periods = groups.groupBy("event_id").agg(F.array_sort(F.collect_list(F.struct("period", F.array(F.struct("statisticsItems")).alias("groups")))).alias("statistics"))
    return feeds.first_statistic(periods.select("event_id", F.to_json(F.struct("statistics")).alias("payload")), "stat_")


@query("s15_totals_only", Q + " select quote_id event_id, book, selection, odd from fx_quote where captured_at < kickoff_at and odd > 1 and odd < 1000 and quote_id % 2 = 1")
def s15(spark, sf):
    q = fixture(spark, sf, "quote")
    even = F.col("quote_id") % 2 == 0
    outcome = F.struct(F.initcap("selection").alias("name"), F.col("odd").alias("price"), F.when(~even, F.lit(2.5)).alias("point"))
    market = F.struct(F.when(even, "h2h").otherwise("totals").alias("key"), F.col("captured_at").cast("string").alias("last_update"), F.array(outcome).alias("outcomes"))
    body = F.struct(F.array(F.struct(F.col("book").alias("key"), F.array(market).alias("markets"))).alias("bookmakers"))
    got = feeds.books(q.select(F.col("quote_id").alias("event_id"), "kickoff_at", F.to_json(body).alias("payload")))
    return got.filter("market = 'ou2.5'").select("event_id", "book", "selection", "odd")


@query("s17_participants", M + " select event_id, home, away, home_score, away_score from fx_match")
def s17(spark, sf):
    """Participants found by the location in their meta data, from JSON payloads in which the away side comes first."""
    m = fixture(spark, sf, "match")
    sides = F.array(*[F.struct(F.col(t).alias("name"), F.struct(F.lit(t).alias("location")).alias("meta")) for t in ("away", "home")])
    scores = F.filter(F.array(*[F.struct(F.lit(t).alias("participant"), F.col(f"{t}_score").alias("goals")) for t in ("away", "home")]), lambda x: x["goals"].isNotNull())
    return feeds.participants(m.select("event_id", F.to_json(F.struct(sides.alias("participants"), scores.alias("scores"))).alias("payload")))


@query("s25_lines", P + """, l as (select price_id, unnest([15e-1, 25e-1, 35e-1]) line, unnest([odd_home, odd_draw, odd_away]) odd from fx_price), f as (select price_id, unnest([25e-1, 35e-1]) line, unnest([odd_under, odd_home]) first from fx_price) select price_id, line, odd, first from l left join f using (price_id, line)""")
def s25(spark, sf):
    p = fixture(spark, sf, "price")
    as_map = lambda pairs: F.map_from_entries(F.array(*[F.struct(F.lit(k).alias("k"), F.col(c).alias("v")) for k, c in pairs]))
    now = p.select("price_id", F.explode(as_map([(1.5, "odd_home"), (2.5, "odd_draw"), (3.5, "odd_away")])).alias("line", "odd"))
    first = p.select("price_id", F.explode(as_map([(2.5, "odd_under"), (3.5, "odd_home")])).alias("line", "first"))
    return now.join(first, ["price_id", "line"], "left")


@query("p20_confidence", P + " select price_id, case when odd_over is null then 'LOW' when 55e-2 - 1/odd_over > 2e-2 and 55e-2 - 1/odd_over <= 15e-2 then 'HIGH' when abs(1/least(odd_home, odd_away) - 5e-1) >= 1e-1 then 'LOW' else 'MEDIUM' end confidence from fx_price")
def p20(spark, sf):
    e = o.edge(F.lit(0.55), "odd_over")
    c = F.when(F.col("odd_over").isNull(), "LOW").when((e > 0.02) & (e <= 0.15), "HIGH").when(F.abs(1 / F.least("odd_home", "odd_away") - 0.5) >= 0.1, "LOW").otherwise("MEDIUM")
    return fixture(spark, sf, "price").select("price_id", c.alias("confidence"))


@query("j20_aligned", M + ", a as (select event_id, home, away, home_score x from fx_match where home_score is not null), b as (select event_id, home, away, away_score y from fx_match where event_id % 3 > 0 and home_score is not null) select count(*) pairs, (select count(*) from a) n_left, (select count(*) from b) n_right, sum(x - y) diff from a join b using (event_id, home, away)")
def j20(spark, sf):
    m = fixture(spark, sf, "match").filter("home_score is not null")
    a = m.select("event_id", "home", "away", F.col("home_score").alias("x"))
    b = m.filter("event_id % 3 > 0").select("event_id", "home", "away", F.col("away_score").alias("y"))
    n = a.agg(F.count("*").alias("n_left")).join(F.broadcast(b.agg(F.count("*").alias("n_right"))))
    return a.join(b, ["event_id", "home", "away"]).agg(F.count("*").alias("pairs"), F.sum(F.col("x") - F.col("y")).alias("diff")).join(F.broadcast(n))


@query("a08_bet_log", B + f" select line_no > 3 validated, count(*) n, round(sum({PNL}) / count(*), 6) roi, round(avg(case when bet_at = 'open' then odd * model_prob - 1 end), 6) clv from fx_bet group by 1")
def a08(spark, sf):
    clv = F.when(F.col("bet_at") == "open", F.col("odd") * F.col("model_prob") - 1)
    return bets(spark, sf).groupBy((F.col("line_no") > 3).alias("validated")).agg(F.count("*").alias("n"), r6(F.sum("pnl") / F.count("*")).alias("roi"), r6(F.avg(clv)).alias("clv"))


@query("a10_grades", M + ", g as (select unnest(['1x2', 'ou25', 'btts']) market, unnest([home_score > away_score, home_score + away_score > 2, home_score > 0 and away_score > 0]) ok from fx_match where home_score is not null) select market, count(*) n, count(*) filter (where ok) correct from g group by 1")
def a10(spark, sf):
    h, a = "home_score", "away_score"
    m = fixture(spark, sf, "match").filter("home_score is not null")
    grades = F.explode(F.array(*[F.struct(F.lit(k).alias("market"), c.alias("ok")) for k, c in (("1x2", F.col(h) > F.col(a)), ("ou25", o.over(h, a, 2.0)), ("btts", o.both_score(h, a)))]))
    return m.select(grades.alias("g")).groupBy("g.market").agg(F.count("*").alias("n"), F.count_if("g.ok").alias("correct"))


@query("a23_funnel", Q + ", s as (select match_id, captured_at, quote_id, case when odd > 61e-1 then 'EMITTED' when odd < 2 then 'NO_SELECTION' else 'NO_QUOTE' end status from fx_quote), f as (select match_id, case when count(*) filter (where status = 'EMITTED') > 0 then 'EMITTED' else arg_max(status, (captured_at, quote_id)) end status from s group by 1) select status, count(*) n, round(count(*) / sum(count(*)) over (), 6) share from f group by 1")
def a23(spark, sf):
    """A match counts by its first emission, or else by its last attempt."""
    status = F.when(F.col("odd") > 6.1, "EMITTED").when(F.col("odd") < 2, "NO_SELECTION").otherwise("NO_QUOTE")
    q = fixture(spark, sf, "quote").withColumn("status", status)
    f = q.groupBy("match_id").agg(F.bool_or(F.col("status") == "EMITTED").alias("any"), F.max_by("status", F.struct("captured_at", "quote_id")).alias("last"))
    c = f.groupBy(F.when(F.col("any"), "EMITTED").otherwise(F.col("last")).alias("status")).agg(F.count("*").alias("n"))
    return c.join(F.broadcast(c.agg(F.sum("n").alias("t")))).select("status", "n", r6(F.col("n") / F.col("t")).alias("share"))


@query("a31_rate_to_gate", B + ", t as (select count(*) n, date_diff('day', min(bet_date), max(bet_date)) + 1 days from fx_bet) select n, days, round(n / days, 6) rate, ceil(greatest(0, 1000000 - n) / (n / days)) days_left from t".replace(" + 1 days from", " + 1 as days from"))
def a31(spark, sf):
    t = fixture(spark, sf, "bet").agg(F.count("*").alias("n"), (F.datediff(F.max("bet_date"), F.min("bet_date")) + 1).cast("long").alias("days"))
    rate = F.col("n") / F.col("days")
    return t.select("n", "days", r6(rate).alias("rate"), F.ceil(F.greatest(F.lit(0), 1_000_000 - F.col("n")) / rate).cast("double").alias("days_left"))


@query("g05_matrix_loss", MN + f", r as (select event_id, least(home_score, {MOST}) hs, least(away_score, {MOST}) aws from fx_match where home_score is not null), s as (select event_id, sum(p * p) sq from gr group by 1) select count(*) n, round(avg(-ln(greatest(gr.p, 1e-12))), 6) logloss, round(avg(s.sq - 2 * gr.p + 1), 6) brier from r join gr on gr.event_id = r.event_id and gr.i = r.hs and gr.j = r.aws join s on s.event_id = r.event_id")
def g05(spark, sf):
    m = fixture(spark, sf, "match").filter("home_score is not null").select("event_id", F.least("home_score", F.lit(MOST)).alias("i"), F.least("away_score", F.lit(MOST)).alias("j"))
    df, grid = priced(means(spark, sf).join(m, "event_id"))
    x = df.select(grid.cell("i", "j").alias("p"), grid.squares().alias("sq"))
    return x.agg(F.count("*").alias("n"), r6(F.avg(o.log_loss("p"))).alias("logloss"), r6(F.avg(F.col("sq") - 2 * F.col("p") + 1)).alias("brier"))


@query("g12_paired_verdict", MP + ", d as (select rps - brier / 3 d, ll - brier e from l), t as (select count(*) n, avg(d) m, stddev_samp(d) / sqrt(count(*)) s, avg(e) g, stddev_samp(e) / sqrt(count(*)) gs from d) select n, round(m, 6) gain, case when m - 196e-2 * s > 0 and not (g + 196e-2 * gs < 0) then 'BETTER' when m + 196e-2 * s < 0 then 'WORSE' else 'UNDECIDED' end verdict from t")
def g12(spark, sf):
    d = losses(spark, sf).select((F.col("rps") - F.col("brier") / 3).alias("d"), (F.col("ll") - F.col("brier")).alias("e"))
    t = d.agg(F.count("*").alias("n"), *[f(F.col(c)).alias(f"{k}{c}") for c in ("d", "e") for k, f in (("m", F.avg), ("s", F.stddev_samp))])
    lo = lambda c, sign: F.col(f"m{c}") + sign * 1.96 * F.col(f"s{c}") / F.sqrt("n")
    verdict = F.when((lo("d", -1) > 0) & ~(lo("e", 1) < 0), "BETTER").when(lo("d", 1) < 0, "WORSE").otherwise("UNDECIDED")
    return t.select("n", r6(F.col("md")).alias("gain"), verdict.alias("verdict"))


@query("g15_synthetic_edge", f"with recursive d as (select r, {resample.draw_sql('r', '1', '1000')} / 1e3 u, {resample.draw_sql('r', '2', '1000')} / 1e3 v from range(20000) t(r)), b as (select r % 2 has_edge, 18e-1 + u odd, case when v < 1 / (18e-1 + u) + (case when r % 2 = 1 then 5e-2 else 0 end) then 1 else 0 end won from d) select has_edge, count(*) n, round(avg(case when won = 1 then odd - 1 else -1 end), 6) roi from b group by 1")
def g15(spark, sf):
    """Positive control: bets with a planted edge against bets without, from the rule of draws."""
    d = spark.range(20_000).withColumnRenamed("id", "r")
    u, v = (resample.draw(F.col("r"), F.lit(k), F.lit(1000)) / 1000 for k in (1, 2))
    has = F.col("r") % 2
    b = d.select(has.alias("has_edge"), (1.8 + u).alias("odd"), v.alias("v")).withColumn("won", F.col("v") < 1 / F.col("odd") + F.when(F.col("has_edge") == 1, 0.05).otherwise(0.0))
    return b.groupBy("has_edge").agg(F.count("*").alias("n"), r6(F.avg(F.when(F.col("won"), F.col("odd") - 1).otherwise(-1.0))).alias("roi"))


@query("m11_attack_defence", M + ", a as (select home team, ln((sum(home_score) + 1) / (count(*) + 1)) atk, ln((sum(away_score) + 1) / (count(*) + 1)) def from fx_match where home_score is not null and home <> 'T7' group by 1) select event_id, round(exp(1e-1 + coalesce(h.atk, 0) + coalesce(w.def, 0)), 6) lam from fx_match m left join a h on h.team = m.home left join a w on w.team = m.away")
def m11(spark, sf):
    """Team strengths from a small table; a team that isn't in it counts as average."""
    m = fixture(spark, sf, "match")
    rate = lambda c: F.ln((F.sum(c) + 1) / (F.count("*") + 1))
    a = m.filter("home_score is not null and home <> 'T7'").groupBy(F.col("home").alias("team")).agg(rate("home_score").alias("atk"), rate("away_score").alias("def"))
    j = m.join(a.select(F.col("team").alias("home"), "atk"), "home", "left").join(a.select(F.col("team").alias("away"), "def"), "away", "left")
    return j.select("event_id", r6(F.exp(0.1 + F.coalesce("atk", F.lit(0.0)) + F.coalesce("def", F.lit(0.0)))).alias("lam"))


@query("m13_tournament_means", M + ", t as (select tournament, avg(home_score + away_score) a from fx_match group by 1), b as (select avg(home_score + away_score) b from fx_match) select event_id, round(135e-2 * a / b, 6) lam from fx_match join t using (tournament), b")
def m13(spark, sf):
    m, goals = fixture(spark, sf, "match"), F.avg(F.col("home_score") + F.col("away_score"))
    t = m.groupBy("tournament").agg(goals.alias("a"))
    return m.join(F.broadcast(t), "tournament").join(F.broadcast(m.agg(goals.alias("b")))).select("event_id", r6(1.35 * F.col("a") / F.col("b")).alias("lam"))


@query("m27_slope_sweep", M + ", s as (select k / 4e0 slope from range(0, 9) r(k)), e as (select event_id * 100 + cast(slope * 4 as bigint) event_id, slope, exp(2e-1 + slope * 3e-1 * d / 400) lam, exp(2e-1 - slope * 3e-1 * d / 400) mu from (select event_id, 100e0 + (event_id * 37 % 401) - 200 d from fx_match), s), " + _grid_sql(NB) + " select slope, count(distinct e.event_id) n, round(sum(case when i > j then p else 0 end) / count(distinct e.event_id), 6) mean_win from gr join e using (event_id) group by 1")
def m27(spark, sf):
    """The same fixtures under each slope: a cross of a bounded parameter table, then one grid for fixtures of equal means."""
    d = 100.0 + (F.col("event_id") * 37 % 401) - 200
    m = fixture(spark, sf, "match").groupBy(d.alias("d")).agg(F.count("*").alias("n"))
    m = m.select("d", "n", F.explode(F.sequence(F.lit(0), F.lit(8))).alias("k"))
    m = m.withColumn("slope", F.col("k") / 4)
    m = m.select("slope", "n", F.exp(0.2 + F.col("slope") * 0.3 * F.col("d") / 400).alias("lam"), F.exp(0.2 - F.col("slope") * 0.3 * F.col("d") / 400).alias("mu"))
    df, grid = priced(m)
    return weighted(df, "slope", mean_win=grid.probability(g.PICKS["win"]))


def weighted(df: DataFrame, key: str, **values) -> DataFrame:
    """(key, n, means): means of ``values``, each row counting ``n`` times; nulls don't count."""
    df = df.select(key, "n", *[v.alias(c) for c, v in values.items()])
    mean = lambda c: F.sum(F.col(c) * F.col("n")) / F.sum(F.when(F.col(c).isNotNull(), F.col("n")))
    return df.groupBy(key).agg(F.sum("n").alias("n"), *[r6(mean(c)).alias(c) for c in values])


RHOS, SIGMAS, DRAWS = (-0.2, -0.1, -0.03, 0.0, 0.1), (0, 40, 80, 160), 5


@query(
    "m27_rho_sweep",
    M + ", x as (select k, rho from (select unnest(range(5)) k, unnest([-2e-1, -1e-1, -3e-2, 0e0, 1e-1]) rho)), b as (select event_id, exp(2e-1 + 3e-1 * d / 400) lam, exp(2e-1 - 3e-1 * d / 400) mu from (select event_id, 100e0 + (event_id * 37 % 401) - 200 d from fx_match)), e as (select event_id * 5 + k event_id, rho, lam, mu from b, x), "
    + _grid_sql(NB).replace(str(RHO), "rho")
    + " select rho, count(distinct e.event_id) n, round(sum(case when i = j then p else 0 end) / count(distinct e.event_id), 6) mean_draw, round(sum(case when i + j > 2 then p else 0 end) / count(distinct e.event_id), 6) mean_over25 from gr join e using (event_id) group by 1",
)
def m27_rho(spark, sf):
    """The same fixtures under each dependence of low scores; one grid for fixtures of equal means."""
    d = means(spark, sf).groupBy("lam", "mu").agg(F.count("*").alias("n")).withColumn("rho", F.explode(F.array(*map(F.lit, RHOS))))
    df, grid = g.with_grid(d, MOST, "rho", alpha=ALPHA)
    return weighted(df, "rho", mean_draw=grid.probability(g.PICKS["draw"]), mean_over25=grid.probability(g.PICKS["over25"]))


@query(
    "m27_noise_sweep",
    M + f", x as (select k, unnest([0, 40, 80, 160]) sigma from range({DRAWS}) r(k)), d as (select event_id, sigma, k, 100e0 + (event_id * 37 % 401) - 200 + sigma * z d from (select event_id, sigma, k, {special.normal_sql('event_id', 'k')} z from fx_match, x)), e as (select row_number() over (order by event_id, sigma, k) event_id, sigma, exp(2e-1 + 3e-1 * d / 400) lam, exp(2e-1 - 3e-1 * d / 400) mu from d), "
    + _grid_sql(NB)
    + ", w as (select event_id, sum(case when i > j then p else 0 end) p from gr group by 1) select sigma, count(*) n, round(avg(p), 6) mean_win, round(stddev_pop(p), 6) spread from w join e using (event_id) group by 1",
)
def m27_noise(spark, sf):
    """Ratings known with an error: each difference is drawn five times around itself, by event and draw."""
    m = fixture(spark, sf, "match").select("event_id", (100.0 + (F.col("event_id") * 37 % 401) - 200).alias("d"), F.explode(F.sequence(F.lit(0), F.lit(DRAWS - 1))).alias("k"))
    m = special.with_normal(m, "z", "event_id", "k").withColumn("sigma", F.explode(F.array(*map(F.lit, SIGMAS))))
    d = F.col("d") + F.col("sigma") * F.col("z")
    df, grid = priced(m.select("sigma", F.exp(0.2 + 0.3 * d / 400).alias("lam"), F.exp(0.2 - 0.3 * d / 400).alias("mu")))
    win = grid.probability(g.PICKS["win"])
    return df.select("sigma", win.alias("p")).groupBy("sigma").agg(F.count("*").alias("n"), r6(F.avg("p")).alias("mean_win"), r6(F.stddev_pop("p")).alias("spread"))


def blocks(m: DataFrame, size: int = 190) -> DataFrame:
    """Matches with their block in date order; counts before each day make the order global without one task."""
    days = m.groupBy("match_date").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("match_date").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    r = F.row_number().over(Window.partitionBy("match_date").orderBy("event_id"))
    return m.withColumn("r", r).join(days.select("match_date", "before"), "match_date").withColumn("block", F.floor((F.col("before") + F.col("r") - 1) / size)).drop("r", "before")


def training_sums(m: DataFrame, sums: dict[str, str], days: int = 1461, size: int = 190) -> DataFrame:
    """(block, n, sums) over what was played in the ``days`` before a block's first day.

    They are differences of running sums over the calendar, so a block meets two days, not all before it. The calendar's
    days are the only rows in one task.
    """
    first = blocks(m, size).groupBy("block").agg(F.min("match_date").alias("first"))
    each = m.filter("home_score is not null").groupBy(F.col("match_date").alias("day")).agg(F.count("*").alias("n"), *[F.sum(c).alias(n) for n, c in sums.items()])
    ends = m.agg(F.min("match_date").alias("low"), F.max("match_date").alias("high"))
    calendar = ends.select(F.explode(F.sequence(F.date_sub("low", days + 2), "high")).alias("day"))
    names, until = ["n", *sums], Window.orderBy("day")
    total = calendar.join(each, "day", "left").select("day", *[F.sum(F.coalesce(c, F.lit(0))).over(until).alias(c) for c in names])
    last, before = (total.select(F.date_add("day", k).alias("first"), *[F.col(c).alias(f"{c}_{x}") for c in names]) for x, k in ((1, 1), (0, days + 1)))
    t = first.join(last, "first").join(before, "first")
    return t.select("block", *[(F.col(f"{c}_1") - F.col(f"{c}_0")).alias(c) for c in names])


@query("q02_walk_forward", M + """, b as (select *, (row_number() over (order by match_date, event_id) - 1) // 190 block from fx_match), f as (select block, min(match_date) first from b group by 1),
t as (select f.block, count(*) n, avg(m.home_score) gh, avg(m.away_score) ga from f join fx_match m on m.match_date < f.first and m.match_date >= f.first - 1461 and m.home_score is not null group by 1 having count(*) >= 100) select b.block, t.n n_train, round(gh, 6) home_mean, round(ga, 6) away_mean, count(*) n_test, round(avg(abs(b.home_score - gh)), 6) error from b join t using (block) where b.block > 0 and b.home_score is not null group by 1, 2, 3, 4""")
def q02(spark, sf):
    """Blocks of 190 after a burn-in, each under means of the four years strictly before its first day."""
    m = fixture(spark, sf, "match")
    b = blocks(m)
    t = training_sums(m, {"h": "home_score", "a": "away_score"}).filter("n >= 100")
    t = t.select("block", F.col("n").alias("n_train"), (F.col("h") / F.col("n")).alias("gh"), (F.col("a") / F.col("n")).alias("ga"))
    x = b.filter("block > 0 and home_score is not null").join(t, "block")
    return x.groupBy("block", "n_train", r6("gh").alias("home_mean"), r6("ga").alias("away_mean")).agg(F.count("*").alias("n_test"), r6(F.avg(F.abs(F.col("home_score") - F.col("gh")))).alias("error"))


@query(
    "q05_count_backtest",
    S + """, t as (select event_id, sum(value) total from fx_stat where period = 'ALL' and stat_name = 'stat_N' group by 1), r as (select *, row_number() over (order by event_id) i, count(*) over () n from t),
c as (select m, 1 / greatest((q - m * m - m) / (m * m), 1e-6) r from (select avg(total) m, avg(total * total) q from r where i <= floor(n * 8e-1))),
o as (select 1 - sum(exp(lgamma(k + r) - lgamma(r) - lgamma(k + 1) + r * ln(r / (r + m)) + k * ln(m / (r + m)))) p_over from c, range(31) x(k)),
p as (select event_id, total, p_over, 17e-1 + (event_id % 7) / 10e0 o_over, 17e-1 + (event_id % 5) / 10e0 o_under from r, o where i > floor((select max(n) from r) * 8e-1))
select event_id, round(p_over, 6) p_over, case when p_over - 1/o_over > 2e-2 then 'over' when 1 - p_over - 1/o_under > 2e-2 then 'under' end pick, case when p_over - 1/o_over > 2e-2 then total > 30 when 1 - p_over - 1/o_under > 2e-2 then total < 30 end won from p""",
)
def q05(spark, sf):
    """Chronological 80/20 split: a negative binomial by moments on the first part; over is looked at before under."""
    t = fixture(spark, sf, "stat").filter("period = 'ALL' and stat_name = 'stat_N'").groupBy("event_id").agg(F.sum("value").alias("total"))
    r = resample.numbered(t, "event_id").withColumn("cut", F.floor(F.col("n") * 0.8))
    c = r.filter("i < cut").agg(F.avg("total").alias("m"), F.avg(F.col("total") * F.col("total")).alias("q"))
    c = c.select(special.count_over("m", (F.col("q") - F.col("m") * F.col("m") - F.col("m")) / (F.col("m") * F.col("m")), F.lit(30.5)).alias("p"))
    p = r.filter("i >= cut").join(F.broadcast(c))
    over = o.edge("p", 1.7 + (F.col("event_id") % 7) / 10) > 0.02
    under = o.edge(1 - F.col("p"), 1.7 + (F.col("event_id") % 5) / 10) > 0.02
    return p.select("event_id", r6("p").alias("p_over"), F.when(over, "over").when(under, "under").alias("pick"), F.when(over, F.col("total") > 30).when(under, F.col("total") < 30).alias("won"))


@query(
    "q09_settle",
    with_fixtures("quote", "match") + """, e as (select match_id, book, selection, arg_min(odd, (captured_at, quote_id)) taken, max(kickoff_at) kickoff_at from fx_quote where captured_at < kickoff_at group by 1, 2, 3),
c as (select match_id, book, selection, arg_max(odd, (captured_at, quote_id)) closed from fx_quote where captured_at < kickoff_at and captured_at >= kickoff_at - interval '72' hour group by 1, 2, 3),
r as (select event_id match_id, home_score hs, away_score aws, 60 + event_id % 5 * 30 after from fx_match where home_score is not null),
s as (select e.*, closed, hs, aws, case when hs is null then 'RESULT_MISSING' when after < 120 then 'RESULT_TOO_EARLY' when closed is null then 'QUOTE_HISTORY_MISSING' else 'SETTLED' end status from e left join c using (match_id, book, selection) left join r using (match_id))
select match_id, book, selection, status, case when status = 'SETTLED' then round((taken - closed) / closed, 6) end clv, case when status = 'SETTLED' then case selection when 'home' then hs > aws when 'draw' then hs = aws else hs < aws end end won from s""",
)
def q09(spark, sf):
    """Decisions with their result, which counts from two hours after kick-off on, and the same book's close.

    What isn't settled says why: no result, one too early to be final, or no price of that book in the last 72 hours.
    """
    q, key = fixture(spark, sf, "quote"), ["match_id", "book", "selection"]
    pre = F.col("captured_at") < F.col("kickoff_at")
    taken = asof.latest(q, key, ["odd", "kickoff_at"], ["captured_at", "quote_id"], pre, earliest=True).select(*key, F.col("odd").alias("taken"), "kickoff_at")
    closed = asof.latest(q, key, ["odd"], ["captured_at", "quote_id"], pre & (F.col("captured_at") >= F.col("kickoff_at") - F.expr("interval '72' hour"))).select(*key, F.col("odd").alias("closed"))
    r = fixture(spark, sf, "match").filter("home_score is not null").select(F.col("event_id").alias("match_id"), F.col("home_score").alias("hs"), F.col("away_score").alias("aws"), (60 + F.col("event_id") % 5 * 30).alias("minutes"))
    x = taken.join(closed, key, "left").join(r, "match_id", "left").withColumn("result_at", F.expr("kickoff_at + make_dt_interval(0, 0, minutes)"))
    early = F.col("result_at") < F.expr("kickoff_at + interval '2' hour")
    status = F.when(F.col("hs").isNull(), "RESULT_MISSING").when(early, "RESULT_TOO_EARLY").when(F.col("closed").isNull(), "QUOTE_HISTORY_MISSING").otherwise("SETTLED")
    x = x.withColumn("status", status)
    settled, hs, aws = F.col("status") == "SETTLED", F.col("hs"), F.col("aws")
    won = F.when(F.col("selection") == "home", hs > aws).when(F.col("selection") == "draw", hs == aws).otherwise(hs < aws)
    return x.select(*key, "status", F.when(settled, r6((F.col("taken") - F.col("closed")) / F.col("closed"))).alias("clv"), F.when(settled, won).alias("won"))


@query(
    "q16_bias_audit",
    MN + """ select m.home_score - m.away_score = 0 is_draw, count(*) n, round(avg(w), 6) mean_win, round(avg(d), 6) mean_draw,
round(avg(d0), 6) p_00, round(avg(d1), 6) p_11, round(avg(d2), 6) p_22,
count(*) filter (where home_score = 0 and away_score = 0) n_00, count(*) filter (where home_score = 1 and away_score = 1) n_11, count(*) filter (where home_score = 2 and away_score = 2) n_22,
round(avg(l), 6) mean_total, round(avg(home_score + away_score), 6) goals
from (select event_id, sum(case when i > j then p else 0 end) w, sum(case when i = j then p else 0 end) d,
sum(case when i = 0 and j = 0 then p else 0 end) d0, sum(case when i = 1 and j = 1 then p else 0 end) d1, sum(case when i = 2 and j = 2 then p else 0 end) d2, sum(p * (i + j)) l
from gr group by 1) x join fx_match m using (event_id) where home_score is not null group by 1""",
)
def q16(spark, sf):
    m = fixture(spark, sf, "match").filter("home_score is not null").select("event_id", "home_score", "away_score")
    df, grid = priced(means(spark, sf).join(m, "event_id"))
    cells = range(3)
    x = df.select("home_score", "away_score", grid.probability(g.PICKS["win"]).alias("w"), grid.probability(g.PICKS["draw"]).alias("d"), *[grid.cell(k, k).alias(f"d{k}") for k in cells], grid.mean(lambda i, j: i + j).alias("l"))
    expected = [r6(F.avg(f"d{k}")).alias(f"p_{k}{k}") for k in cells]
    seen = [F.count_if((F.col("home_score") == k) & (F.col("away_score") == k)).alias(f"n_{k}{k}") for k in cells]
    return x.groupBy((F.col("home_score") == F.col("away_score")).alias("is_draw")).agg(F.count("*").alias("n"), r6(F.avg("w")).alias("mean_win"), r6(F.avg("d")).alias("mean_draw"), *expected, *seen, r6(F.avg("l")).alias("mean_total"), r6(F.avg(F.col("home_score") + F.col("away_score"))).alias("goals"))


#: What the totals of a model have to keep: calibration within 5 points, a slope near 1, and some sharpness.
ECE_MOST, SLOPE_LOW, SLOPE_HIGH, SHARP_LEAST = 0.05, 0.9, 1.1, 0.005


@query(
    "q04_totals",
    MN + f""", q as (select event_id, sum(case when i + j > 2 then p else 0 end) po, sum(p * (i + j)) goals from gr group by 1), x as (select q.*, case when home_score + away_score > 2 then 1 else 0 end y from q join fx_match using (event_id) where home_score is not null),
c as (select count(*) n, avg(po) a, avg(y) b from x group by floor(po * 10)), t as (select sum(n) n, sum(n * a) / sum(n) ma, sum(n * b) / sum(n) mb from c),
s as (select round(sum(c.n * abs(a - b)) / max(t.n), 6) ece, round(sum(c.n * pow(b - mb, 2)) / max(t.n), 6) resolution, round(sum(c.n * (a - ma) * (b - mb)) / nullif(sum(c.n * pow(a - ma, 2)), 0), 6) slope from c, t),
m as (select count(*) n, round(avg(2 * pow(po - y, 2)), 6) brier_ou25, round(avg(case when (po > 5e-1) = (y = 1) then 1e0 else 0e0 end), 6) hit_rate, round(avg(goals), 6) mean_goals, round(var_pop(po), 6) sharpness from x)
select m.*, s.*, ece <= {ECE_MOST} ece_ok, slope between {SLOPE_LOW} and {SLOPE_HIGH} slope_ok, sharpness >= {SHARP_LEAST} sharp_ok from m, s""",
)
def q04_totals(spark, sf):
    """The panel's totals: scores of over 2.5 goals, and guardrails on calibration, slope and sharpness by deciles."""
    m = fixture(spark, sf, "match").filter("home_score is not null").select("event_id", (F.col("home_score") + F.col("away_score") > 2).cast("int").alias("y"))
    df, grid = priced(means(spark, sf).join(m, "event_id"))
    x = df.select("y", grid.probability(g.PICKS["over25"]).alias("po"), grid.mean(lambda i, j: i + j).alias("goals"))
    c = x.groupBy(F.floor(F.col("po") * 10).alias("bin")).agg(F.count("*").alias("n"), F.avg("po").alias("a"), F.avg("y").alias("b"))
    n, a, b = F.col("n"), F.col("a"), F.col("b")
    t = c.agg(F.sum("n").alias("t"), (F.sum(n * a) / F.sum(n)).alias("ma"), (F.sum(n * b) / F.sum(n)).alias("mb"))
    da, db = a - F.col("ma"), b - F.col("mb")
    s = c.join(F.broadcast(t)).agg(r6(F.sum(n * F.abs(a - b)) / F.max("t")).alias("ece"), r6(F.sum(n * db * db) / F.max("t")).alias("resolution"), r6(F.try_divide(F.sum(n * da * db), F.sum(n * da * da))).alias("slope"))
    hit = ((F.col("po") > 0.5) == (F.col("y") == 1)).cast("double")
    scores = x.agg(F.count("*").alias("n"), r6(F.avg(2 * F.pow(F.col("po") - F.col("y"), F.lit(2)))).alias("brier_ou25"), r6(F.avg(hit)).alias("hit_rate"), r6(F.avg("goals")).alias("mean_goals"), r6(F.var_pop("po")).alias("sharpness"))
    out = scores.join(F.broadcast(s))
    return out.withColumns({"ece_ok": F.col("ece") <= ECE_MOST, "slope_ok": F.col("slope").between(SLOPE_LOW, SLOPE_HIGH), "sharp_ok": F.col("sharpness") >= SHARP_LEAST})


@query("q17_serving", with_fixtures("match", "price") + ", " + MEANS + ", " + _grid_sql(NB) + ", w as (select event_id, sum(case when i > j then p else 0 end) w, sum(case when i + j > 2 then p else 0 end) o from gr group by 1) select m.event_id, round(w, 6) win, round(o, 6) over25, round(w - (1/odd_home) / (1/odd_home + 1/odd_draw + 1/odd_away), 6) versus_market from fx_match m join w using (event_id) left join fx_price p on p.price_id = m.event_id where m.home_score is null")
def q17(spark, sf):
    """Open fixtures priced in one batch and held against the market where there is one."""
    open_ = fixture(spark, sf, "match").filter("home_score is null").select("event_id")
    df, grid = priced(means(spark, sf).join(open_, "event_id"))
    every = grid.markets()
    m = df.select("event_id", every["win"].alias("win"), every["over25"].alias("over25"))
    p = fixture(spark, sf, "price").select(F.col("price_id").alias("event_id"), ((1 / F.col("odd_home")) / (1 / F.col("odd_home") + 1 / F.col("odd_draw") + 1 / F.col("odd_away"))).alias("market"))
    return m.join(p, "event_id", "left").select("event_id", r6("win").alias("win"), r6("over25").alias("over25"), r6(F.col("win") - F.col("market")).alias("versus_market"))


_AT_CLOSE = "select b.*, coalesce(c.close_odd, b.odd) price from fx_bet b left join c on c.game_id = b.game_id and c.market = b.market"


@query(
    "q19_close_only",
    B + f""", c as (select game_id, market, max_by(odd, (line_no, odd)) close_odd from fx_bet where bet_at = 'close' group by 1, 2), p as ({_AT_CLOSE}), x as (select market, won, price, case when won = 1 then price - 1 else -1 end pnl from p where price > 1 and model_prob - 1 / price > 2e-2 and model_prob - 1 / price <= 15e-2)
select market, count(*) n, round(avg(won), 6) hit, round(avg(pnl), 6) roi, round(avg(pnl) / nullif(stddev_samp(pnl), 0), 6) sharpe from x group by 1""",
)
def q19(spark, sf):
    """The same bets with the price of each replaced by the last closing price of its game and market: trigger and profit.

    Opening prices are thrown away, so what is left of an edge doesn't come from prices that could not be had.
    """
    b = fixture(spark, sf, "bet")
    close = asof.latest(b, ["game_id", "market"], [], ["line_no", "odd"], F.col("bet_at") == "close").select("game_id", "market", F.col("odd").alias("close_odd"))
    x = b.join(close, ["game_id", "market"], "left").withColumn("price", F.coalesce("close_odd", "odd"))
    x = x.filter((F.col("price") > 1) & o.has_edge("model_prob", "price")).withColumn("pnl", F.when(F.col("won") == 1, F.col("price") - 1).otherwise(-1.0))
    return x.groupBy("market").agg(F.count("*").alias("n"), r6(F.avg("won")).alias("hit"), r6(F.avg("pnl")).alias("roi"), r6(F.try_divide(F.avg("pnl"), F.nullif(F.stddev_samp("pnl"), F.lit(0.0)))).alias("sharpe"))


@query("r07_edge_signals", Q + " select quote_id, selection, round(case selection when 'home' then 42e-2 when 'draw' then 28e-2 else 3e-1 end - 1/odd, 6) edge, round(least(greatest(25e-2 * (case selection when 'home' then 42e-2 when 'draw' then 28e-2 else 3e-1 end * odd - 1) / (odd - 1), 0), 5e-2), 6) stake from fx_quote where case selection when 'home' then 42e-2 when 'draw' then 28e-2 else 3e-1 end - 1/odd >= 2e-2 and odd > 1")
def r07(spark, sf):
    prob = F.when(F.col("selection") == "home", 0.42).when(F.col("selection") == "draw", 0.28).otherwise(0.3)
    q = fixture(spark, sf, "quote").withColumn("prob", prob)
    return q.filter((o.edge("prob", "odd") >= 0.02) & (F.col("odd") > 1)).select("quote_id", "selection", r6(o.edge("prob", "odd")).alias("edge"), r6(o.kelly("prob", "odd")).alias("stake"))


@query("m21_team_strengths")
def m21(spark, sf):
    """Attack, defence and home edge of each season's teams, fitted on earlier seasons."""
    return fit.strengths_by_fold(fixture(spark, sf, "match").filter("home_score is not null"), "season")


@query("m20_count_model", S + ", y as (select event_id % 6 fold, value from fx_stat where period = 'ALL'), f as (select distinct fold from y), t as (select f.fold, count(*) n, avg(value) m, avg(value * value) q from f join y on y.fold < f.fold group by 1) select fold, n, round(m, 6) mean, round(greatest(0, (q - m * m - m) / (m * m)), 6) alpha from t")
def m20(spark, sf):
    y = fixture(spark, sf, "stat").filter("period = 'ALL'").select((F.col("event_id") % 6).alias("fold"), "value")
    return fit.count_model_by_fold(y, "fold", "value").select("fold", "n", r6("mean").alias("mean"), r6("alpha").alias("alpha"))


#: Picks as they were sent: some without a kick-off or a book, some with an instant that has no zone. Plain SQL for both engines.
SENT = """select quote_id, match_id, case when quote_id % 31 = 0 then null else book end book, selection, captured_at, case when quote_id % 29 = 0 then null else kickoff_at end kickoff_at, kickoff_at starts,
quote_id % 17 <> 0 zoned, odd, match_id % 5 * 60 - 60 wait, match_id % 13 = 0 altered"""
#: What a pick is rejected for, in this order; the first that holds counts.
REJECTED = [
    ("duplicate_pick", "quote_id <> first_id"),
    ("legacy_incomplete", "kickoff_at is null"),
    ("missing_required_field", "book is null"),
    ("timezone_or_timestamp_invalid", "not zoned"),
    ("pre_event_clock_violation", "captured_at >= kickoff_at"),
    ("invalid_odds", "odd < 13e-1 or odd >= 1000"),
    ("settlement_hash_invalid", "hs is not null and altered"),
    ("settlement_clock_invalid", "hs is not null and wait < 0"),
]
_WHY = "case " + " ".join(f"when {rule} then '{name}'" for name, rule in REJECTED) + " end"


@query(
    "q11_cohort",
    with_fixtures("quote", "match") + f""", p as ({SENT} from fx_quote), f as (select match_id, coalesce(book, '') k, selection, min(quote_id) first_id from p group by 1, 2, 3),
r as (select p.*, first_id, m.home_score hs, m.away_score aws from p join f on f.match_id = p.match_id and f.k = coalesce(p.book, '') and f.selection = p.selection left join (select * from fx_match where home_score is not null) m on m.event_id = p.match_id),
x as (select *, {_WHY} reason from r), y as (select *, case when reason = 'legacy_incomplete' then 'LEGACY_INCOMPLETE' when reason is not null then 'PROSPECTIVE_REJECTED' when hs is not null then 'MATURED_ELIGIBLE' else 'PROSPECTIVE_ELIGIBLE' end class from x)
select class, reason, count(*) n, round(avg(case when class = 'MATURED_ELIGIBLE' then case when case selection when 'home' then hs > aws when 'draw' then hs = aws else hs < aws end then odd - 1 else -1e0 end end), 6) roi from y group by 1, 2""",
)
def q11(spark, sf):
    """Picks by class and by the first reason that they are rejected for; profit of those whose result counts.

    A pick is sent again if an earlier one has its match, book and selection; which is the earliest is an aggregate, so a
    key with many picks isn't sorted.
    """
    p = fixture(spark, sf, "quote")
    p = spark.sql(SENT + " from {q}", q=p).withColumn("k", F.coalesce("book", F.lit("")))
    key = ["match_id", "k", "selection"]
    first = p.groupBy(*key).agg(F.min("quote_id").alias("first_id"))
    m = fixture(spark, sf, "match").filter("home_score is not null").select(F.col("event_id").alias("match_id"), F.col("home_score").alias("hs"), F.col("away_score").alias("aws"))
    x = p.join(first, key).join(m, "match_id", "left").withColumn("reason", F.expr(_WHY))
    kind = F.when(F.col("reason") == "legacy_incomplete", "LEGACY_INCOMPLETE").when(F.col("reason").isNotNull(), "PROSPECTIVE_REJECTED").when(F.col("hs").isNotNull(), "MATURED_ELIGIBLE").otherwise("PROSPECTIVE_ELIGIBLE")
    hs, aws = F.col("hs"), F.col("aws")
    won = F.when(F.col("selection") == "home", hs > aws).when(F.col("selection") == "draw", hs == aws).otherwise(hs < aws)
    pnl = F.when(F.col("class") == "MATURED_ELIGIBLE", F.when(won, F.col("odd") - 1).otherwise(-1.0))
    return x.withColumn("class", kind).groupBy("class", "reason").agg(F.count("*").alias("n"), r6(F.avg(pnl)).alias("roi"))


@query("q13_survival", MP + ", b as (select season, avg(brier) model, count(*) n from l group by 1), c as (select season, y, count(*) k from l group by 1, 2), s as (select season, sum(k * k) / pow(sum(k), 2) sq, sum(k) t from c group by 1) select season, n, round(model, 6) model, round(1 - sq, 6) base, case when model < 1 - sq then 'SURVIVES' else 'FAILS' end verdict from b join s using (season)")
def q13(spark, sf):
    """Each season's Brier score against that of its own class shares, whose mean is 1 - sum of squares."""
    x = losses(spark, sf)
    b = x.groupBy("season").agg(F.avg("brier").alias("model"), F.count("*").alias("n"))
    c = x.groupBy("season", "y").agg(F.count("*").alias("k")).groupBy("season").agg((1 - F.sum(F.col("k") * F.col("k")) / F.sum("k") / F.sum("k")).alias("base"))
    return b.join(c, "season").select("season", "n", r6("model").alias("model"), r6("base").alias("base"), F.when(F.col("model") < F.col("base"), "SURVIVES").otherwise("FAILS").alias("verdict"))


@query("q15_half_life_sweep", M + ", l as (select max(match_date) d from fx_match), p as (select 30 * (k + 1) half from range(0, 6) r(k)), w as (select half, home, sum(pow(5e-1, date_diff('day', match_date, d) / cast(half as double)) * home_score) / sum(pow(5e-1, date_diff('day', match_date, d) / cast(half as double))) rate from fx_match, l, p where home_score is not null group by 1, 2) select half, count(*) teams, round(avg(rate), 6) mean_rate, round(stddev_pop(rate), 6) spread from w group by 1")
def q15(spark, sf):
    """Weighted rates under every half-life of a bounded grid in one pass."""
    m = fixture(spark, sf, "match")
    m = m.join(F.broadcast(m.agg(F.max("match_date").alias("d")))).filter("home_score is not null").withColumn("half", F.explode(F.array(*[F.lit(30 * (k + 1)) for k in range(6)])))
    weight = o.half_life(F.datediff("d", "match_date"), F.col("half"))
    w = m.groupBy("half", "home").agg((F.sum(weight * F.col("home_score")) / F.sum(weight)).alias("rate"))
    return w.groupBy("half").agg(F.count("*").alias("teams"), r6(F.avg("rate")).alias("mean_rate"), r6(F.stddev_pop("rate")).alias("spread"))
