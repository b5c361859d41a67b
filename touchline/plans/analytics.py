"""Aggregations, windows, rankings, scoring and significance over the projections of ``sources.fixtures``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from touchline.functions import odds as o
from touchline.operators import asof, resample
from touchline.sources.fixtures import fixture, with_fixtures

from .core import query

M, Q, B, S, O, P = (with_fixtures(n) for n in ("match", "quote", "bet", "stat", "obs", "price"))  # noqa: E741
PNL = "case when won = 1 then odd - 1 else -1e0 end"


def bets(spark: SparkSession, sf: str) -> DataFrame:
    return fixture(spark, sf, "bet").withColumn("pnl", F.when(F.col("won") == 1, F.col("odd") - 1).otherwise(-1.0))


def r6(c):
    return F.round(c, 6)


@query("a01_counts", M + " select count(*) n, count(home_score) played, count(*) filter (where home_score is null) open, min(match_date) first, max(match_date) last from fx_match")
def a01(spark, sf):
    return fixture(spark, sf, "match").agg(F.count("*").alias("n"), F.count("home_score").alias("played"), F.count_if(F.col("home_score").isNull()).alias("open"), F.min("match_date").alias("first"), F.max("match_date").alias("last"))


@query("a02_by_year", M + " select season, count(*) n, count(home_score) with_score, count(*) filter (where is_neutral = 1) neutral from fx_match group by 1")
def a02(spark, sf):
    return fixture(spark, sf, "match").groupBy("season").agg(F.count("*").alias("n"), F.count("home_score").alias("with_score"), F.count_if(F.col("is_neutral") == 1).alias("neutral"))


@query("a03_distinct", Q + " select selection, count(distinct match_id) matches, count(distinct book) books, min(captured_at) first, max(captured_at) last from fx_quote group by 1")
def a03(spark, sf):
    return fixture(spark, sf, "quote").groupBy("selection").agg(F.count_distinct("match_id").alias("matches"), F.count_distinct("book").alias("books"), F.min("captured_at").alias("first"), F.max("captured_at").alias("last"))


@query("a04_drift", Q + ", g as (select match_id, book, selection, arg_min(odd, (captured_at, quote_id)) a, arg_max(odd, (captured_at, quote_id)) z from fx_quote group by 1, 2, 3) select book, count(*) n, count(*) filter (where a <> z) moved from g group by 1")
def a04(spark, sf):
    at = F.struct("captured_at", "quote_id")
    g = fixture(spark, sf, "quote").groupBy("match_id", "book", "selection").agg(F.min_by("odd", at).alias("a"), F.max_by("odd", at).alias("z"))
    return g.groupBy("book").agg(F.count("*").alias("n"), F.count_if(F.col("a") != F.col("z")).alias("moved"))


@query("a05_by_market", B + f" select market, count(*) n, sum(won) wins, round(sum({PNL}), 4) pnl, round(avg(won), 6) hit, round(sum({PNL}) / count(*), 6) roi from fx_bet group by rollup (market)")
def a05(spark, sf):
    return bets(spark, sf).rollup("market").agg(F.count("*").alias("n"), F.sum("won").alias("wins"), F.round(F.sum("pnl"), 4).alias("pnl"), r6(F.avg("won")).alias("hit"), r6(F.sum("pnl") / F.count("*")).alias("roi"))


@query("a06_clv", B + " select bet_at, count(*) n, round(avg(odd * model_prob - 1), 6) clv, round(avg(case when odd * model_prob > 1 then 1 else 0 end), 6) beat_rate from fx_bet group by 1")
def a06(spark, sf):
    clv = F.col("odd") * F.col("model_prob") - 1
    return fixture(spark, sf, "bet").groupBy("bet_at").agg(F.count("*").alias("n"), r6(F.avg(clv)).alias("clv"), r6(F.avg((clv > 0).cast("int"))).alias("beat_rate"))


@query("a07_edge_bands", B + f" select case when model_prob - 1/odd < 5e-2 then 'a' when model_prob - 1/odd < 1e-1 then 'b' else 'c' end band, count(*) n, round(avg(model_prob), 6) mean_prob, round(avg(won), 6) hit, round(avg({PNL}), 6) roi from fx_bet where model_prob > 1/odd group by 1")
def a07(spark, sf):
    e = o.edge("model_prob", "odd")
    band = F.when(e < 0.05, "a").when(e < 0.1, "b").otherwise("c")
    return bets(spark, sf).filter(F.col("model_prob") > 1 / F.col("odd")).groupBy(band.alias("band")).agg(F.count("*").alias("n"), r6(F.avg("model_prob")).alias("mean_prob"), r6(F.avg("won")).alias("hit"), r6(F.avg("pnl")).alias("roi"))


@query("a09_bankroll", B + f", i as (select max(bet_date) d from fx_bet where game_id % 997 = 3) select round(1000 + sum({PNL}), 4) balance, count(*) settled, round(sum(case when line_no = 7 then odd end), 4) open_exposure from fx_bet, i where bet_date >= i.d")
def a09(spark, sf):
    b = bets(spark, sf)
    d = b.filter("game_id % 997 = 3").agg(F.max("bet_date").alias("d"))
    b = b.join(F.broadcast(d)).filter("bet_date >= d")
    return b.agg(F.round(1000 + F.sum("pnl"), 4).alias("balance"), F.count("*").alias("settled"), F.round(F.sum(F.when(F.col("line_no") == 7, F.col("odd"))), 4).alias("open_exposure"))


@query("a11_metrics", B + f""" select market, count(*) n, round(avg(won), 6) win_rate, round(avg({PNL}), 6) roi, round(median(odd), 6) median_odd, round(avg(pow(model_prob - won, 2)), 6) brier, round(avg(-ln(greatest(case when won = 1 then model_prob else 1 - model_prob end, 1e-12))), 6) logloss, round(avg(model_prob * odd - 1), 6) ev from fx_bet group by 1""")
def a11(spark, sf):
    p = F.when(F.col("won") == 1, F.col("model_prob")).otherwise(1 - F.col("model_prob"))
    return bets(spark, sf).groupBy("market").agg(F.count("*").alias("n"), r6(F.avg("won")).alias("win_rate"), r6(F.avg("pnl")).alias("roi"), r6(F.median("odd")).alias("median_odd"), r6(F.avg(F.pow(F.col("model_prob") - F.col("won"), F.lit(2)))).alias("brier"), r6(F.avg(o.log_loss(p))).alias("logloss"), r6(F.avg(o.expected_value("model_prob", "odd"))).alias("ev"))


@query("a12_segments", B + f" select market, bet_at, line_no, count(*) n, round(avg({PNL}), 6) roi from fx_bet group by grouping sets ((market), (bet_at), (line_no))")
def a12(spark, sf):
    return spark.sql("select market, bet_at, line_no, count(*) n, round(avg(pnl), 6) roi from {b} group by grouping sets ((market), (bet_at), (line_no))", b=bets(spark, sf))


@query("a13_calibration", B + " select floor(model_prob * 10) / 10 bin, count(*) n, round(avg(model_prob), 6) predicted, round(avg(won), 6) observed, round(abs(avg(model_prob) - avg(won)), 6) gap from fx_bet group by 1")
def a13(spark, sf):
    p, y = F.avg("model_prob"), F.avg("won")
    return fixture(spark, sf, "bet").groupBy(o.decile("model_prob").alias("bin")).agg(F.count("*").alias("n"), r6(p).alias("predicted"), r6(y).alias("observed"), r6(F.abs(p - y)).alias("gap"))


@query("a14_calibration_error", B + """, c as (select count(*) n, avg(model_prob) x, avg(won) y from fx_bet group by floor(model_prob * 10)), t as (select sum(n) n, sum(n * x) / sum(n) mx, sum(n * y) / sum(n) my from c)
select round(sum(c.n * abs(x - y)) / max(t.n), 6) ece, round(sum(c.n * pow(y - my, 2)) / max(t.n), 6) resolution, round(sum(c.n * (x - mx) * (y - my)) / sum(c.n * pow(x - mx, 2)), 6) slope, round((select var_pop(model_prob) from fx_bet), 6) sharpness from c, t""")
def a14(spark, sf):
    b = fixture(spark, sf, "bet")
    c = b.groupBy(F.floor(F.col("model_prob") * 10).alias("bin")).agg(F.count("*").alias("n"), F.avg("model_prob").alias("x"), F.avg("won").alias("y"))
    n, x, y = F.col("n"), F.col("x"), F.col("y")
    t = c.agg(F.sum("n").alias("t"), (F.sum(n * x) / F.sum(n)).alias("mx"), (F.sum(n * y) / F.sum(n)).alias("my"))
    s = b.agg(r6(F.var_pop("model_prob")).alias("sharpness"))
    dx, dy = x - F.col("mx"), y - F.col("my")
    out = c.join(F.broadcast(t)).agg(r6(F.sum(n * F.abs(x - y)) / F.max("t")).alias("ece"), r6(F.sum(n * dy * dy) / F.max("t")).alias("resolution"), r6(F.sum(n * dx * dy) / F.sum(n * dx * dx)).alias("slope"))
    return out.join(F.broadcast(s))


@query("a15_strata", B + " select market, year(bet_date) season, month(bet_date) month_no, count(*) n, round(avg(pow(model_prob - won, 2)), 6) brier from fx_bet group by grouping sets ((market, year(bet_date)), (month(bet_date)), ())")
def a15(spark, sf):
    return spark.sql("select market, year(bet_date) season, month(bet_date) month_no, count(*) n, round(avg(pow(model_prob - won, 2)), 6) brier from {b} group by grouping sets ((market, year(bet_date)), (month(bet_date)), ())", b=fixture(spark, sf, "bet"))


@query("a16_climatology", M + """, r as (select case when home_score > away_score then 'home' when home_score = away_score then 'draw' else 'away' end x, count(*) n from fx_match where home_score is not null group by 1)
select x outcome, n, round(n / sum(n) over (), 6) share, round(sum(pow(n / t, 2)) over () - 2 * n / t + 1, 6) brier_if from (select *, sum(n) over () t from r)""")
def a16(spark, sf):
    r = fixture(spark, sf, "match").filter("home_score is not null").groupBy(o.outcome("home_score", "away_score").alias("outcome")).agg(F.count("*").alias("n"))
    t = r.agg(F.sum("n").alias("t"), F.sum(F.col("n") * F.col("n")).alias("sq"))
    share = F.col("n") / F.col("t")
    return r.join(F.broadcast(t)).select("outcome", "n", r6(share).alias("share"), r6(F.col("sq") / F.col("t") / F.col("t") - 2 * share + 1).alias("brier_if"))


@query("a17_team_bias", M + " select team, count(*) n, round(sum(f - 2e0), 6) attack, round(sum(g - 15e-1), 6) defence from (select home team, home_score f, away_score g from fx_match union all select away, away_score, home_score from fx_match) where f is not null group by 1")
def a17(spark, sf):
    m = fixture(spark, sf, "match").filter("home_score is not null")
    sides = m.select(F.explode(F.array(F.struct(F.col("home").alias("team"), F.col("home_score").alias("f"), F.col("away_score").alias("g")), F.struct(F.col("away").alias("team"), F.col("away_score").alias("f"), F.col("home_score").alias("g")))).alias("x")).select("x.*")
    return sides.groupBy("team").agg(F.count("*").alias("n"), r6(F.sum(F.col("f") - 2.0)).alias("attack"), r6(F.sum(F.col("g") - 1.5)).alias("defence"))


@query("a18_points", M + " select team, season, sum(case when f > g then 3 when f = g then 1 else 0 end) points, count(*) n from (select home team, season, home_score f, away_score g from fx_match union all select away, season, away_score, home_score from fx_match) where f is not null and team in ('T1', 'T2', 'T3') group by 1, 2")
def a18(spark, sf):
    m = fixture(spark, sf, "match").filter("home_score is not null")
    s = m.select(F.col("home").alias("team"), "season", F.col("home_score").alias("f"), F.col("away_score").alias("g")).union(m.select("away", "season", "away_score", "home_score")).filter("team in ('T1', 'T2', 'T3')")
    return s.groupBy("team", "season").agg(F.sum(F.when(F.col("f") > F.col("g"), 3).when(F.col("f") == F.col("g"), 1).otherwise(0)).alias("points"), F.count("*").alias("n"))


@query("a19_half_time_share", M + ", t as (select tournament, sum(home_score // 2 + away_score // 2) h, sum(home_score + away_score) f, count(*) n from fx_match where home_score + away_score > 0 group by 1) select tournament, n, case when n >= 50 then round(h / f, 6) end share from t")
def a19(spark, sf):
    half = F.floor(F.col("home_score") / 2) + F.floor(F.col("away_score") / 2)
    t = fixture(spark, sf, "match").filter("home_score + away_score > 0").groupBy("tournament").agg(F.sum(half).alias("h"), F.sum(F.col("home_score") + F.col("away_score")).alias("f"), F.count("*").alias("n"))
    return t.select("tournament", "n", F.when(F.col("n") >= 50, r6(F.col("h") / F.col("f"))).alias("share"))


@query("a20_consensus", Q + ", l as (select match_id, book, selection, arg_max(odd, (captured_at, quote_id)) odd from fx_quote group by 1, 2, 3), c as (select match_id, selection, median(1/odd) p, max(odd) best, count(*) books from l group by 1, 2) select match_id, selection, round(p / sum(p) over (partition by match_id), 6) fair, best, books from c")
def a20(spark, sf):
    last = asof.latest(fixture(spark, sf, "quote"), ["match_id", "book", "selection"], ["odd"], ["captured_at", "quote_id"])
    c = last.groupBy("match_id", "selection").agg(F.median(1 / F.col("odd")).alias("p"), F.max("odd").alias("best"), F.count("*").alias("books"))
    return c.select("match_id", "selection", r6(F.col("p") / F.sum("p").over(Window.partitionBy("match_id"))).alias("fair"), "best", "books")


@query("a21_smoke", Q + " select book, count(*) quotes, count(distinct match_id) events_seen, count(*) filter (where odd > 2) valid, count(distinct match_id) / (select count(distinct match_id) from fx_quote) coverage from fx_quote group by 1")
def a21(spark, sf):
    q = fixture(spark, sf, "quote")
    n = q.agg(F.count_distinct("match_id").alias("all"))
    return q.groupBy("book").agg(F.count("*").alias("quotes"), F.count_distinct("match_id").alias("events_seen"), F.count_if(F.col("odd") > 2).alias("valid")).join(F.broadcast(n)).select("book", "quotes", "events_seen", "valid", (F.col("events_seen") / F.col("all")).alias("coverage"))


@query("a22_stability", Q + """, d as (select book, cast(captured_at as date) d, count(distinct match_id) events, max(odd) lag_s from fx_quote group by 1, 2), t as (select count(distinct cast(captured_at as date)) as days from fx_quote),
b as (select book, count(*) present, count(*) / max(days) presence, avg(events) / 40 coverage, max(lag_s) lag_s from d, t group by 1)
select book, present, round(presence, 6) presence, round(coverage, 6) coverage, case when book = 'error' then 'rejected' when present < 3 then 'candidate' when presence < 8e-1 then 'intermittent' when coverage < 5e-1 then 'insufficient' when lag_s > 6 then 'intermittent' else 'stable' end status,
row_number() over (order by presence desc, coverage desc, book) rank_no from b""")
def a22(spark, sf):
    q = fixture(spark, sf, "quote").withColumn("d", F.to_date("captured_at"))
    days = q.agg(F.count_distinct("d").alias("days"))
    d = q.groupBy("book", "d").agg(F.count_distinct("match_id").alias("events"), F.max("odd").alias("lag_s"))
    b = d.join(F.broadcast(days)).groupBy("book").agg(F.count("*").alias("present"), (F.count("*") / F.max("days")).alias("presence"), (F.avg("events") / 40).alias("coverage"), F.max("lag_s").alias("lag_s"))
    status = F.when(F.col("book") == "error", "rejected").when(F.col("present") < 3, "candidate").when(F.col("presence") < 0.8, "intermittent").when(F.col("coverage") < 0.5, "insufficient").when(F.col("lag_s") > 6, "intermittent").otherwise("stable")
    rank = F.row_number().over(Window.orderBy(F.desc("presence"), F.desc("coverage"), "book"))
    return b.select("book", "present", r6(F.col("presence")).alias("presence"), r6(F.col("coverage")).alias("coverage"), status.alias("status"), rank.cast("long").alias("rank_no"))


@query("a24_concentration", M + ", c as (select team, count(*) n from (select home team from fx_match union all select away from fx_match) group by 1) select sum(n) n, count(*) clubs, round(sum(pow(n / t, 2)), 9) hhi from (select *, sum(n) over () t from c)")
def a24(spark, sf):
    m = fixture(spark, sf, "match")
    c = m.select(F.explode(F.array("home", "away")).alias("team")).groupBy("team").agg(F.count("*").alias("n"))
    return c.agg(F.sum("n").alias("n"), F.count("*").alias("clubs"), F.round(F.sum(F.col("n") * F.col("n")) / F.sum("n") / F.sum("n"), 9).alias("hhi"))


@query("a25_mode", Q + ", c as (select match_id, book, count(*) n from fx_quote group by 1, 2) select match_id, arg_max(book, (n, book)) book from c group by 1")
def a25(spark, sf):
    c = fixture(spark, sf, "quote").groupBy("match_id", "book").agg(F.count("*").alias("n"))
    return c.groupBy("match_id").agg(F.max(F.struct("n", "book"))["book"].alias("book"))


@query("a26_replacement", "select p_brand, round(avg(p_retailprice) * 8e-1, 6) level, count(*) n from (select *, row_number() over (partition by p_brand order by p_retailprice, p_partkey) r, count(*) over (partition by p_brand) c from part) where r <= greatest(1, floor(c * 2e-1)) group by 1")
def a26(spark, sf):
    w = Window.partitionBy("p_brand")
    p = spark.read.parquet(f"{sf}/part.parquet").withColumn("r", F.row_number().over(w.orderBy("p_retailprice", "p_partkey"))).withColumn("c", F.count("*").over(w))
    return p.filter("r <= greatest(1, floor(c * 2e-1))").groupBy("p_brand").agg(r6(F.avg("p_retailprice") * 0.8).alias("level"), F.count("*").alias("n"))


@query("a27_percentiles", B + " select market, round(quantile_cont(odd, 25e-3), 6) lo, round(quantile_cont(odd, 5e-1), 6) mid, round(quantile_cont(odd, 975e-3), 6) hi from fx_bet group by 1")
def a27(spark, sf):
    p = [r6(F.percentile("odd", F.lit(x))).alias(n) for x, n in ((0.025, "lo"), (0.5, "mid"), (0.975, "hi"))]
    return fixture(spark, sf, "bet").groupBy("market").agg(*p)


@query("a28_rank_latency", "select event_type, max(case when r = floor(n * 5e-1) then value end) p50, max(case when r = floor(n * 95e-2) then value end) p95, max(value) most from (select *, row_number() over (partition by event_type order by value, event_id) - 1 r, count(*) over (partition by event_type) n from events) group by 1")
def a28(spark, sf):
    e = resample.ranked(spark.read.parquet(f"{sf}/events.parquet").select("event_type", "value", "event_id"), "event_type", "value", "event_id")
    pick = [F.max(F.when(F.col("r") == F.floor(F.col("n") * x), F.col("value"))).alias(a) for x, a in ((0.5, "p50"), (0.95, "p95"))]
    return e.groupBy("event_type").agg(*pick, F.max("value").alias("most"))


@query("a29_top_share", B + f", g as (select game_id, round(sum({PNL}), 6) pnl from fx_bet group by 1), t as (select pnl from g where pnl > 0 order by pnl desc, game_id limit 5) select round((select sum(pnl) from t), 6) top5, round((select sum(pnl) from t) / (select sum(pnl) from g where pnl > 0), 6) share")
def a29(spark, sf):
    g = bets(spark, sf).groupBy("game_id").agg(r6(F.sum("pnl")).alias("pnl")).filter("pnl > 0")
    top = g.orderBy(F.desc("pnl"), "game_id").limit(5).agg(F.sum("pnl").alias("top5"))
    return top.join(F.broadcast(g.agg(F.sum("pnl").alias("all")))).select(r6(F.col("top5")).alias("top5"), r6(F.col("top5") / F.col("all")).alias("share"))


@query("a30_in_every_run", Q + " select match_id from fx_quote group by 1 having count(distinct book) = (select count(distinct book) from fx_quote)")
def a30(spark, sf):
    q = fixture(spark, sf, "quote")
    n = q.agg(F.count_distinct("book").alias("all"))
    return q.groupBy("match_id").agg(F.count_distinct("book").alias("n")).join(F.broadcast(n)).filter("n = all").select("match_id")


@query("t01_top_k", B + " select game_id, line_no, odd, market from (select *, row_number() over (partition by market order by odd desc, game_id, line_no, model_prob) r from fx_bet) where r <= 5")
def t01(spark, sf):
    w = Window.partitionBy("market").orderBy(F.desc("odd"), "game_id", "line_no", "model_prob")
    return fixture(spark, sf, "bet").withColumn("r", F.row_number().over(w)).filter("r <= 5").select("game_id", "line_no", "odd", "market")


@query("t02_limit", "select c_custkey, c_acctbal from customer order by c_acctbal desc, c_custkey limit 25")
def t02(spark, sf):
    return spark.read.parquet(f"{sf}/customer.parquet").orderBy(F.desc("c_acctbal"), "c_custkey").limit(25).select("c_custkey", "c_acctbal")


@query("t04_argmax", P + " select price_id, case when odd_home <= least(odd_draw, odd_away) then 'home' when odd_draw <= odd_away then 'draw' else 'away' end pick from fx_price")
def t04(spark, sf):
    low = F.least("odd_home", "odd_draw", "odd_away")
    return fixture(spark, sf, "price").select("price_id", F.when(F.col("odd_home") == low, "home").when(F.col("odd_draw") == low, "draw").otherwise("away").alias("pick"))


@query("t05_best_of_grid", B + f", g as (select t / 1e2 least_edge, count(*) n, round(avg({PNL}), 6) roi from fx_bet, range(0, 20) r(t) where model_prob - 1/odd > t / 1e2 group by 1) select arg_max(least_edge, (roi, least_edge)) least_edge, max(roi) roi from g")
def t05(spark, sf):
    b = bets(spark, sf).select("pnl", F.explode(F.sequence(F.lit(0), F.lit(19))).alias("t"), o.edge("model_prob", "odd").alias("e"))
    g = b.filter("e > t / 1e2").groupBy((F.col("t") / 100).alias("least_edge")).agg(r6(F.avg("pnl")).alias("roi"))
    return g.agg(F.max_by("least_edge", F.struct("roi", "least_edge")).alias("least_edge"), F.max("roi").alias("roi"))


@query("w01_as_known_at", O + " select entity_type, entity_id, source, seq from (select *, row_number() over (partition by entity_type, entity_id, source order by published_at desc, ingested_at desc, seq desc) n from fx_obs where published_at <= timestamp '2024-01-20 12:00:00' and ingested_at <= timestamp '2024-01-20 12:00:00') where n = 1")
def w01(spark, sf):
    t = F.lit("2024-01-20 12:00:00").cast("timestamp_ntz")
    return asof.as_known_at(fixture(spark, sf, "obs"), t, ["entity_type", "entity_id", "source"], ["published_at", "ingested_at", "seq"]).select("entity_type", "entity_id", "source", "seq")


SIDES = "s as (select event_id, match_date, home team, home_score f, away_score g from fx_match union all select event_id, match_date, away, away_score, home_score from fx_match)"


def sides(spark, sf) -> DataFrame:
    m = fixture(spark, sf, "match")
    return m.select("event_id", "match_date", F.col("home").alias("team"), F.col("home_score").alias("f"), F.col("away_score").alias("g")).union(m.select("event_id", "match_date", "away", "away_score", "home_score"))


@query("w03_last_ten", M + ", " + SIDES + ", d as (select team, match_date, sum(f) f, count(f) n, count(*) c from s group by 1, 2) select event_id, team, round(fs / nullif(ns, 0), 6) mean_goals, ns n_before from (select s.event_id, s.team, w.fs, w.ns from s join (select team, match_date, sum(f) over x fs, sum(n) over x ns from d window x as (partition by team order by match_date rows between 10 preceding and 1 preceding)) w using (team, match_date))")
def w03(spark, sf):
    """Goals of the team's ten match days strictly before; matches of one day don't see each other."""
    s = sides(spark, sf)
    x = Window.partitionBy("team").orderBy("match_date").rowsBetween(-10, -1)
    d = s.groupBy("team", "match_date").agg(F.sum("f").alias("f"), F.count("f").alias("n"))
    d = d.select("team", "match_date", F.sum("f").over(x).alias("fs"), F.sum("n").over(x).alias("ns"))
    return s.join(d, ["team", "match_date"]).select("event_id", "team", r6(F.try_divide("fs", "ns")).alias("mean_goals"), F.col("ns").alias("n_before"))


@query("w04_rest_days", M + ", " + SIDES + ", d as (select distinct team, match_date from s) select team, match_date, coalesce(least(date_diff('day', lag(match_date) over (partition by team order by match_date), match_date), 5), 5) rest from d")
def w04(spark, sf):
    d = sides(spark, sf).select("team", "match_date").distinct()
    before = F.lag("match_date").over(Window.partitionBy("team").orderBy("match_date"))
    return d.select("team", "match_date", F.coalesce(F.least(F.datediff("match_date", before), F.lit(5)), F.lit(5)).cast("long").alias("rest"))


@query("w05_drawdown", B + f", d as (select market, bet_date, sum({PNL}) pnl from fx_bet group by 1, 2), e as (select market, bet_date, sum(pnl) over (partition by market order by bet_date) eq from d), p as (select *, greatest(0, max(eq) over (partition by market order by bet_date)) peak from e) select market, round(max(peak - eq), 4) max_drawdown, round(arg_max(eq, bet_date), 4) last from p group by 1")
def w05(spark, sf):
    w = Window.partitionBy("market").orderBy("bet_date")
    d = bets(spark, sf).groupBy("market", "bet_date").agg(F.sum("pnl").alias("pnl")).withColumn("eq", F.sum("pnl").over(w))
    d = d.withColumn("peak", F.greatest(F.lit(0.0), F.max("eq").over(w)))
    return d.groupBy("market").agg(F.round(F.max(F.col("peak") - F.col("eq")), 4).alias("max_drawdown"), F.round(F.max_by("eq", "bet_date"), 4).alias("last"))


@query("w06_half_season", M + " select event_id, case when r <= n // 2 then 'T1' else 'T2' end half from (select event_id, row_number() over (partition by season order by match_date, event_id) r, count(*) over (partition by season) n from fx_match)")
def w06(spark, sf):
    m = resample.ranked(fixture(spark, sf, "match").select("season", "match_date", "event_id"), "season", "match_date", "event_id")
    return m.select("event_id", F.when(F.col("r") + 1 <= F.floor(F.col("n") / 2), "T1").otherwise("T2").alias("half"))


@query("w07_vintage", O + ", h as (select entity_id, payload, max(published_at) p, count(*) n from fx_obs group by 1, 2) select entity_id, payload, n from (select *, row_number() over (partition by entity_id order by p desc, payload) r from h) where r = 1")
def w07(spark, sf):
    h = fixture(spark, sf, "obs").groupBy("entity_id", "payload").agg(F.max("published_at").alias("p"), F.count("*").alias("n"))
    return h.withColumn("r", F.row_number().over(Window.partitionBy("entity_id").orderBy(F.desc("p"), "payload"))).filter("r = 1").select("entity_id", "payload", "n")


@query("w09_compound", B + f", d as (select market, bet_date, sum(1e-3 * {PNL}) r from fx_bet group by 1, 2) select market, bet_date, round(exp(sum(ln(1 + r)) over (partition by market order by bet_date)), 6) bank from d")
def w09(spark, sf):
    d = bets(spark, sf).groupBy("market", "bet_date").agg(F.sum(0.001 * F.col("pnl")).alias("r"))
    return d.select("market", "bet_date", r6(F.exp(F.sum(F.log1p("r")).over(Window.partitionBy("market").orderBy("bet_date")))).alias("bank"))


@query("w10_blocks", M + " select block, count(*) n, min(match_date) first from (select match_date, (row_number() over (order by match_date, event_id) - 1) // 190 block from fx_match) where block > 0 group by 1")
def w10(spark, sf):
    """Blocks of 190 matches after a burn-in of one: a global order, by counts before each day and ranks within it."""
    m = fixture(spark, sf, "match").select("match_date", "event_id")
    days = m.groupBy("match_date").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("match_date").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    r = F.row_number().over(Window.partitionBy("match_date").orderBy("event_id"))
    m = m.withColumn("r", r).join(days.select("match_date", "before"), "match_date").withColumn("block", F.floor((F.col("before") + F.col("r") - 1) / 190))
    return m.filter("block > 0").groupBy("block").agg(F.count("*").alias("n"), F.min("match_date").alias("first"))


PROBS = "p as (select price_id, m.home_score hs, m.away_score aws, (1/odd_home) / (1/odd_home + 1/odd_draw + 1/odd_away) pw, (1/odd_draw) / (1/odd_home + 1/odd_draw + 1/odd_away) pd, sign(home_score - away_score) + 1 y, m.season from fx_price join fx_match m on m.event_id = price_id where home_score is not null)"
LOSS = "l as (select price_id, season, y, 5e-1 * (pow(1 - pw - pd - (case when y <= 0 then 1 else 0 end), 2) + pow(1 - pw - (case when y <= 1 then 1 else 0 end), 2)) rps, pow(pw - (case when y = 2 then 1 else 0 end), 2) + pow(pd - (case when y = 1 then 1 else 0 end), 2) + pow(1 - pw - pd - (case when y = 0 then 1 else 0 end), 2) brier, -ln(greatest(case y when 2 then pw when 1 then pd else 1 - pw - pd end, 1e-12)) ll from p)"
MP = with_fixtures("match", "price") + ", " + PROBS + ", " + LOSS


def losses(spark, sf) -> DataFrame:
    """Ranked probability score, Brier score and log-loss of proportional book probabilities, a row a match."""
    p = fixture(spark, sf, "price").select(F.col("price_id").alias("event_id"), "odd_home", "odd_draw", "odd_away")
    t = o.implied("odd_home") + o.implied("odd_draw") + o.implied("odd_away")
    m = fixture(spark, sf, "match").filter("home_score is not null").join(p, "event_id").withColumns({"pw": o.implied("odd_home") / t, "pd": o.implied("odd_draw") / t, "y": o.ordinal("home_score", "away_score")})
    m = m.withColumn("pl", 1 - F.col("pw") - F.col("pd"))
    hit = [(F.col("y") == k).cast("int") for k in (2, 1, 0)]
    own = F.when(F.col("y") == 2, F.col("pw")).when(F.col("y") == 1, F.col("pd")).otherwise(F.col("pl"))
    return m.select(F.col("event_id").alias("price_id"), "season", "y", o.rps("pw", "pd", "y").alias("rps"), o.brier(["pw", "pd", "pl"], hit).alias("brier"), o.log_loss(own).alias("ll"))


@query("g01_losses", MP + " select season, count(*) n, round(avg(rps), 6) rps, round(avg(brier), 6) brier, round(avg(ll), 6) logloss from l group by 1")
def g01(spark, sf):
    return losses(spark, sf).groupBy("season").agg(F.count("*").alias("n"), r6(F.avg("rps")).alias("rps"), r6(F.avg("brier")).alias("brier"), r6(F.avg("ll")).alias("logloss"))


@query("g06_skill", MP + ", c as (select y, count(*) / (select count(*) from l) f from l group by 1), b as (select (select sum(f * f) from c) sq), k as (select avg(brier) model, avg((select sq from b) - 2 * c.f + 1) base from l join c using (y)) select round(model, 6) model, round(base, 6) base, round(1 - model / base, 6) skill from k")
def g06(spark, sf):
    x = losses(spark, sf)
    c = x.groupBy("y").agg(F.count("*").alias("k"))
    n = c.agg(F.sum("k").alias("n"), F.sum(F.col("k") * F.col("k")).alias("sq"))
    c = c.join(F.broadcast(n)).select("y", (F.col("sq") / F.col("n") / F.col("n") - 2 * F.col("k") / F.col("n") + 1).alias("base"))
    k = x.join(F.broadcast(c), "y").agg(F.avg("brier").alias("model"), F.avg("base").alias("base"))
    return k.select(r6(F.col("model")).alias("model"), r6(F.col("base")).alias("base"), r6(1 - F.col("model") / F.col("base")).alias("skill"))


@query("g07_diebold_mariano", MP + """, d as (select price_id, rps - brier / 3 d from l), x as (select price_id, d - avg(d) over () e, avg(d) over () m from d), z as (select e, m, lag(e, 1) over (order by price_id) e1, lag(e, 2) over (order by price_id) e2 from x), v as (select count(*) n, max(m) m, avg(e * e) g0, sum(e * e1) / (count(*) - 1) g1, sum(e * e2) / (count(*) - 2) g2 from z)
select n, round(m, 6) mean, round(m / sqrt((g0 + 2 * g1 + 2 * g2) / n), 4) stat from v""")
def g07(spark, sf):
    """Mean loss difference over its long-run deviation; lags meet by a join on the row's number."""
    d = losses(spark, sf).select("price_id", (F.col("rps") - F.col("brier") / 3).alias("d"))
    m = d.agg(F.avg("d").alias("m"), F.count("*").alias("n"))
    e = resample.numbered(d, "price_id").join(F.broadcast(m.select("m"))).select("i", (F.col("d") - F.col("m")).alias("e"))
    lag = [e.select((F.col("i") + k).alias("i"), F.col("e").alias(f"e{k}")) for k in (1, 2)]
    z = e.join(lag[0], "i", "left").join(lag[1], "i", "left")
    v = z.agg(F.avg(F.col("e") * F.col("e")).alias("g0"), *[F.sum(F.col("e") * F.col(f"e{k}")).alias(f"g{k}") for k in (1, 2)]).join(F.broadcast(m))
    n, var = F.col("n"), (F.col("g0") + 2 * F.col("g1") / (F.col("n") - 1) + 2 * F.col("g2") / (F.col("n") - 2)) / F.col("n")
    return v.select(n, r6(F.col("m")).alias("mean"), F.round(F.col("m") / F.sqrt(var), 4).alias("stat"))


REPS = 200


def _boot_sql(cluster: str) -> str:
    return f""", c as ({cluster}), w as (select r, s, m, {resample.times_sql('r', 'k')} w from c, range({REPS}) t(r)), v as (select r, sum(s * w) / sum(m * w) v from w where w > 0 group by 1)
select round((select sum(s) / sum(m) from c), 6) mean, round(quantile_cont(v, 25e-3), 6) lo, round(quantile_cont(v, 975e-3), 6) hi from v"""


def _boot(clusters: DataFrame) -> DataFrame:
    b = resample.bootstrap_mean(clusters, "k", REPS)
    return b.select(*[r6(F.col(c)).alias(c) for c in ("mean", "lo", "hi")])


@query("g08_bootstrap", B + _boot_sql(f"select year(bet_date) * 400 + dayofyear(bet_date) k, sum({PNL}) s, count(*) m from fx_bet group by 1"))
def g08(spark, sf):
    """ROI with days as clusters."""
    day = F.year("bet_date") * 400 + F.dayofyear("bet_date")
    return _boot(bets(spark, sf).groupBy(day.alias("k")).agg(F.sum("pnl").alias("s"), F.count("*").alias("m")))


@query("g09_cluster_bootstrap", B + _boot_sql(f"select game_id k, sum({PNL}) s, count(*) m from fx_bet group by 1"))
def g09(spark, sf):
    """ROI with games as clusters."""
    return _boot(bets(spark, sf).groupBy(F.col("game_id").alias("k")).agg(F.sum("pnl").alias("s"), F.count("*").alias("m")))


def blocks_sql(rows: str, order: str, value: str, name: str = "") -> str:
    """Sums of runs of 21 rows, and the mean of each replicate of them."""
    return f"""x{name} as (select {value} x, row_number() over (order by {order}) - 1 i from {rows}), c{name} as (select i, x, sum(x) over (order by i) c from x{name}),
b{name} as (select a.i k, z.c - a.c + a.x s, 21 m from c{name} a join c{name} z on z.i = a.i + 20), w{name} as (select r, s, m, {resample.times_sql('r', 'k', 1 / 21)} w from b{name}, range({REPS}) t(r)),
v{name} as (select r, sum(s * w) / sum(m * w) v from w{name} where w > 0 group by 1)"""


@query("g10_block_bootstrap", MP + ", " + blocks_sql("l", "price_id", "rps") + " select round((select avg(rps) from l), 6) mean, round(quantile_cont(v, 25e-3), 6) lo, round(quantile_cont(v, 975e-3), 6) hi from v")
def g10(spark, sf):
    """Moving blocks of 21 matches."""
    x = losses(spark, sf).select("price_id", "rps")
    b = resample.bootstrap_mean(resample.moving_blocks(x, "price_id", "rps"), "k", REPS, 1 / 21)
    return x.agg(r6(F.avg("rps")).alias("mean")).join(F.broadcast(b.select(r6("lo").alias("lo"), r6("hi").alias("hi"))))


@query("g11_moments", B + f", d as (select bet_date, sum({PNL}) x from fx_bet group by 1), m as (select count(*) n, avg(x) m, avg(x*x) m2, avg(x*x*x) m3, avg(x*x*x*x) m4 from d), c as (select n, m, m2 - m*m v, m3 - 3*m*m2 + 2*m*m*m k3, m4 - 4*m*m3 + 6*m*m*m2 - 3*m*m*m*m k4 from m) select n, round(m / sqrt(v), 4) sharpe, round(k3 / pow(v, 15e-1), 4) skew, round(k4 / (v * v) - 3, 4) excess from c")
def g11(spark, sf):
    d = bets(spark, sf).groupBy("bet_date").agg(F.sum("pnl").alias("x"))
    return d.agg(F.count("*").alias("n"), F.round(F.avg("x") / F.stddev_pop("x"), 4).alias("sharpe"), F.round(F.skewness("x"), 4).alias("skew"), F.round(F.kurtosis("x"), 4).alias("excess"))


@query("g13_paired_t", MP + " select count(*) n, round(avg(rps - brier / 3), 6) mean, round(stddev_samp(rps - brier / 3) / sqrt(count(*)), 6) se, round(avg(rps - brier / 3) / (stddev_samp(rps - brier / 3) / sqrt(count(*))), 4) t from l")
def g13(spark, sf):
    d = losses(spark, sf).select((F.col("rps") - F.col("brier") / 3).alias("d"))
    se = F.stddev_samp("d") / F.sqrt(F.count("*"))
    return d.agg(F.count("*").alias("n"), r6(F.avg("d")).alias("mean"), r6(se).alias("se"), F.round(F.avg("d") / se, 4).alias("t"))


@query("g14_permutation", MP + ", a as (select y, row_number() over (order by price_id) i from l), b as (select pw, pd, row_number() over (order by md5('1|' || cast(price_id as varchar(20)))) i from p) select count(*) n, round(avg(pow(pw - (case when y = 2 then 1 else 0 end), 2) + pow(pd - (case when y = 1 then 1 else 0 end), 2) + pow(1 - pw - pd - (case when y = 0 then 1 else 0 end), 2)), 6) brier from a join b using (i)")
def g14(spark, sf):
    """Negative control: results shuffled over fixtures by a keyed rank."""
    m = fixture(spark, sf, "match").filter("home_score is not null").withColumn("y", o.ordinal("home_score", "away_score"))
    p = fixture(spark, sf, "price").withColumnRenamed("price_id", "event_id")
    t = o.implied("odd_home") + o.implied("odd_draw") + o.implied("odd_away")
    j = m.select("event_id", "y").join(p, "event_id").select("event_id", "y", (o.implied("odd_home") / t).alias("pw"), (o.implied("odd_draw") / t).alias("pd"), F.md5(F.concat_ws("|", F.lit("1"), "event_id")).alias("h"))
    a = resample.numbered(j.select("event_id", "y"), "event_id").select("i", "y")
    b = resample.numbered(j.select("h", "pw", "pd"), "h").select("i", "pw", "pd", (1 - F.col("pw") - F.col("pd")).alias("pl"))
    hit = [(F.col("y") == k).cast("int") for k in (2, 1, 0)]
    return a.join(b, "i").agg(F.count("*").alias("n"), r6(F.avg(o.brier(["pw", "pd", "pl"], hit))).alias("brier"))


@query("g16_gate", B + f", g as (select game_id, sum({PNL}) s, count(*) m from fx_bet group by 1), t as (select sum(m) n, count(*) clusters, sum(s) / sum(m) roi from g) select n, clusters, round(roi, 6) roi, case when n < 1000 or clusters < 100 then 'PENDING' when roi > 0 then 'GO' else 'NO_GO' end verdict, false capital from t")
def g16(spark, sf):
    g = bets(spark, sf).groupBy("game_id").agg(F.sum("pnl").alias("s"), F.count("*").alias("m"))
    t = g.agg(F.sum("m").alias("n"), F.count("*").alias("clusters"), (F.sum("s") / F.sum("m")).alias("roi"))
    verdict = F.when((F.col("n") < 1000) | (F.col("clusters") < 100), "PENDING").when(F.col("roi") > 0, "GO").otherwise("NO_GO")
    return t.select("n", "clusters", r6(F.col("roi")).alias("roi"), verdict.alias("verdict"), F.lit(False).alias("capital"))


@query("g18_invariants", Q + " select bool_and(odd > 1) prices_ok, bool_and(captured_at is not null) clocks_ok, count(distinct book) books, count(distinct selection) = 3 complete from fx_quote")
def g18(spark, sf):
    return fixture(spark, sf, "quote").agg(F.bool_and(F.col("odd") > 1).alias("prices_ok"), F.bool_and(F.col("captured_at").isNotNull()).alias("clocks_ok"), F.count_distinct("book").alias("books"), (F.count_distinct("selection") == 3).alias("complete"))
