"""Scans, projections, joins, set operations and stores over the projections of ``sources.fixtures``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from touchline.functions import odds as o
from touchline.operators import asof, ratings, store
from touchline.operators.lineage import cut
from touchline.sources.fixtures import fixture, with_fixtures

from .core import query

M, Q, B, S, O, P = (with_fixtures(n) for n in ("match", "quote", "bet", "stat", "obs", "price"))  # noqa: E741


@query("s02_played", M + " select event_id, match_date, home, away, home_score, away_score from fx_match where home_score is not null")
def s02(spark: SparkSession, sf: str) -> DataFrame:
    return fixture(spark, sf, "match").filter("home_score is not null").select("event_id", "match_date", "home", "away", "home_score", "away_score")


@query("s03_upcoming", M + " select event_id, match_date, home, away from fx_match where home_score is null and match_date >= date '1996-01-01' order by match_date, event_id limit 50")
def s03(spark, sf):
    m = fixture(spark, sf, "match").filter(F.col("home_score").isNull() & (F.col("match_date") >= F.lit("1996-01-01").cast("date")))
    return m.orderBy("match_date", "event_id").limit(50).select("event_id", "match_date", "home", "away")


@query("s04_keep_last", M + " select home, away, event_id, match_date, home_score, away_score from (select *, row_number() over (partition by home, away order by match_date desc, event_id desc) n from fx_match) where n = 1")
def s04(spark, sf):
    return asof.latest(fixture(spark, sf, "match"), ["home", "away"], ["home_score", "away_score"], ["match_date", "event_id"])


@query("s21_append_new", Q + """, old as (select * from fx_quote where quote_id % 3 <> 0), k as (select distinct match_id, book, selection from old)
select match_id, book, selection from (select distinct match_id, book, selection from fx_quote) n where not exists (select 1 from k where k.match_id = n.match_id and k.book = n.book and k.selection = n.selection)""")
def s21(spark, sf):
    q = fixture(spark, sf, "quote")
    key = ["match_id", "book", "selection"]
    return store.append_new(q.filter("quote_id % 3 <> 0"), q.select(*key), key)


@query("s22_upsert_last", Q + " select match_id, book, selection, captured_at, odd from (select *, row_number() over (partition by match_id, book, selection order by captured_at desc, (case when quote_id % 2 = 0 then 1 else 0 end) desc, odd desc) n from fx_quote) where n = 1")
def s22(spark, sf):
    q = fixture(spark, sf, "quote")
    cols = ["match_id", "book", "selection", "captured_at", "odd"]
    return store.upsert_last(q.filter("quote_id % 2 = 1").select(*cols), q.filter("quote_id % 2 = 0").select(*cols), cols[:3], "captured_at").select(*cols)


@query("s23_write_once_open", Q + """, q as (select *, case when quote_id % 7 = 0 then null else odd end v from fx_quote)
select match_id, book, selection, arg_min(v, captured_at) filter (where v is not null) v_open, arg_max_null(v, captured_at) v_close, count(*) n from q group by 1, 2, 3""")
def s23(spark, sf):
    q = fixture(spark, sf, "quote").withColumn("v", F.when(F.col("quote_id") % 7 != 0, F.col("odd")))
    return store.open_and_close(q, ["match_id", "book", "selection"], "v", "captured_at")


@query("s24_fill", M + """, n as (select event_id, case when event_id % 4 = 0 then 9 end home_score, case when event_id % 6 = 0 then 8 end away_score from fx_match where event_id % 2 = 0)
select m.event_id, coalesce(n.home_score, m.home_score) home_score, coalesce(n.away_score, m.away_score) away_score from fx_match m left join n using (event_id)""")
def s24(spark, sf):
    m = fixture(spark, sf, "match")
    new = m.filter("event_id % 2 = 0").select("event_id", F.when(F.col("event_id") % 4 == 0, 9).alias("home_score"), F.when(F.col("event_id") % 6 == 0, 8).alias("away_score"))
    return store.fill_from(new, m, ["event_id"], ["home_score", "away_score"])


@query("s26_mirror", M + " select match_date, home home_team, away away_team, home_score, away_score, 'mirror' source, 0 neutral from fx_match where tournament in ('1-URGENT', '2-HIGH') and home is not null and away is not null")
def s26(spark, sf):
    m = fixture(spark, sf, "match").filter(F.col("tournament").isin("1-URGENT", "2-HIGH")).dropna(subset=["home", "away"])
    return m.select("match_date", F.col("home").alias("home_team"), F.col("away").alias("away_team"), "home_score", "away_score", F.lit("mirror").alias("source"), F.lit(0).alias("neutral"))


@query("p01_outcomes", M + """ select event_id, case when home_score > away_score then 'home' when home_score = away_score then 'draw' when home_score < away_score then 'away' end outcome,
cast(sign(home_score - away_score) + 1 as int) ordinal, home_score + away_score > 2.5 over25, home_score > 0 and away_score > 0 btts, home_score >= away_score dc_1x, home_score <= away_score dc_x2, home_score <> away_score dc_12 from fx_match""")
def p01(spark, sf):
    h, a = "home_score", "away_score"
    return fixture(spark, sf, "match").select("event_id", o.outcome(h, a).alias("outcome"), o.ordinal(h, a).alias("ordinal"), o.over(h, a, 2.5).alias("over25"), o.both_score(h, a).alias("btts"), *[o.double_chance(h, a, x).alias(f"dc_{x.lower()}") for x in ("1X", "X2", "12")])


@query("p03_window_cut", M + " select event_id, match_date from fx_match where match_date >= (select max(match_date) from fx_match) - 1461")
def p03(spark, sf):
    m = fixture(spark, sf, "match")
    last = m.agg(F.max("match_date").alias("last"))
    return m.join(F.broadcast(last)).filter("match_date >= date_sub(last, 1461)").select("event_id", "match_date")


@query("p04_edge", B + " select game_id, line_no, round(model_prob - 1/odd, 6) edge from fx_bet where model_prob - 1/odd > 2e-2 and model_prob - 1/odd <= 15e-2")
def p04(spark, sf):
    b = fixture(spark, sf, "bet")
    return b.filter(o.has_edge("model_prob", "odd")).select("game_id", "line_no", F.round(o.edge("model_prob", "odd"), 6).alias("edge"))


@query("p05_overround", P + " select price_id, round(1/odd_home + 1/odd_draw + 1/odd_away - 1, 6) overround, round(odd_home * 45e-2 - 1, 6) ev_home from fx_price")
def p05(spark, sf):
    p = fixture(spark, sf, "price")
    book = o.implied("odd_home") + o.implied("odd_draw") + o.implied("odd_away") - 1
    return p.select("price_id", F.round(book, 6).alias("overround"), F.round(o.expected_value(F.lit(0.45), "odd_home"), 6).alias("ev_home"))


@query("p07_wide_to_long", P + " select price_id, 'home' selection, odd_home odd from fx_price union all select price_id, 'draw', odd_draw from fx_price union all select price_id, 'away', odd_away from fx_price")
def p07(spark, sf):
    p = fixture(spark, sf, "price").select("price_id", F.col("odd_home").alias("home"), F.col("odd_draw").alias("draw"), F.col("odd_away").alias("away"))
    return p.unpivot("price_id", ["home", "draw", "away"], "selection", "odd")


COMPLETE = """c as (select match_id, book, arg_max(odd, captured_at) filter (where selection = 'home') oh, arg_max(odd, captured_at) filter (where selection = 'draw') od, arg_max(odd, captured_at) filter (where selection = 'away') oa
from fx_quote where captured_at < kickoff_at and odd > 1 group by 1, 2), m as (select * from c where oh is not null and od is not null and oa is not null)"""


def closing_books(quotes: DataFrame) -> DataFrame:
    """Complete three-way markets of each book at the last price before kick-off."""
    seen = quotes.filter((F.col("captured_at") < F.col("kickoff_at")) & o.is_price("odd"))
    sides = {"oh": "home", "od": "draw", "oa": "away"}
    wide = seen.groupBy("match_id", "book").agg(*[F.max_by("odd", F.when(F.col("selection") == s, F.col("captured_at"))).alias(c) for c, s in sides.items()])
    return wide.dropna()  # a side without a quote has no latest one


@query("p08_assemble", Q + ", " + COMPLETE + " select match_id, book, oh, od, oa from m")
def p08(spark, sf):
    return closing_books(fixture(spark, sf, "quote"))


@query("p09_orient", P + " select price_id, least(home, away) a, greatest(home, away) b, case when home <= away then odd_home else odd_away end odd_a, odd_draw, case when home <= away then odd_away else odd_home end odd_b, odd_over from fx_price")
def p09(spark, sf):
    p = fixture(spark, sf, "price")
    same = F.col("home") <= F.col("away")
    return p.select("price_id", F.least("home", "away").alias("a"), F.greatest("home", "away").alias("b"), F.when(same, F.col("odd_home")).otherwise(F.col("odd_away")).alias("odd_a"), "odd_draw", F.when(same, F.col("odd_away")).otherwise(F.col("odd_home")).alias("odd_b"), "odd_over")


@query("p10_canonical", "select s_suppkey, lower(trim(s_name)) name, translate(lower(trim(n_name)), 'áàâãéêíóôõúç', 'aaaaeeiooouc') nation from supplier join nation on s_nationkey = n_nationkey")
def p10(spark, sf):
    s, n = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("supplier", "nation"))
    plain = F.translate(F.lower(F.trim("n_name")), "áàâãéêíóôõúç", "aaaaeeiooouc")
    return s.join(n, s.s_nationkey == n.n_nationkey).select("s_suppkey", F.lower(F.trim("s_name")).alias("name"), plain.alias("nation"))


@query("p11_fractions", B + """, f as (select game_id, line_no, case line_no % 5 when 0 then 'x/2' when 1 then '7' when 2 then '3/0' else cast(game_id % 20 as varchar(10)) || '/' || cast(line_no as varchar(10)) end t from fx_bet)
select game_id, line_no, case when len(string_split(t, '/')) = 2 and try_cast(split_part(t, '/', 2) as double) <> 0 then round(1 + try_cast(split_part(t, '/', 1) as double) / try_cast(split_part(t, '/', 2) as double), 3) end odd from f""")
def p11(spark, sf):
    k = F.col("line_no") % 5
    text = F.when(k == 0, "x/2").when(k == 1, "7").when(k == 2, "3/0").otherwise(F.concat_ws("/", F.col("game_id") % 20, "line_no"))
    return fixture(spark, sf, "bet").select("game_id", "line_no", o.fraction_odd(text).alias("odd"))


@query("p12_pre_match", Q + " select quote_id, case when captured_at < kickoff_at then 1 else 0 end pre_match, date_diff('second', captured_at, kickoff_at) seconds_left from fx_quote")
def p12(spark, sf):
    q = fixture(spark, sf, "quote")
    left = F.unix_timestamp(F.col("kickoff_at").cast("timestamp")) - F.unix_timestamp(F.col("captured_at").cast("timestamp"))
    return q.select("quote_id", (F.col("captured_at") < F.col("kickoff_at")).cast("int").alias("pre_match"), left.alias("seconds_left"))


@query("p13_prices", B + " select game_id, line_no, coalesce(v > 1 and v < 4 and not isnan(v), false) valid from (select *, case line_no % 4 when 0 then null when 1 then cast('nan' as double) else odd end v from fx_bet)")
def p13(spark, sf):
    v = F.when(F.col("line_no") % 4 == 0, F.lit(None)).when(F.col("line_no") % 4 == 1, F.lit(float("nan"))).otherwise(F.col("odd"))
    return fixture(spark, sf, "bet").select("game_id", "line_no", o.is_price(v, 4.0).alias("valid"))


@query("p14_quarter_lines", B + """, l as (select game_id, line_no, (game_id % 17) / 4e0 - 2e0 line from fx_bet)
select game_id, line_no, line, (line % 1 + 1) % 1 = 5e-1 is_half, case when (line * 2) % 1 <> 0 then line - 25e-2 else line end low, case when (line * 2) % 1 <> 0 then line + 25e-2 else line end high from l""")
def p14(spark, sf):
    line = (F.col("game_id") % 17) / 4 - 2
    quarter = F.pmod(line * 2, F.lit(1.0)) != 0
    return fixture(spark, sf, "bet").select("game_id", "line_no", line.alias("line"), o.is_half_line(line).alias("is_half"), F.when(quarter, line - 0.25).otherwise(line).alias("low"), F.when(quarter, line + 0.25).otherwise(line).alias("high"))


@query("p15_k_factor", M + """ select event_id, case tournament when '1-URGENT' then 60 when '2-HIGH' then 50 else case when contains(lower(tournament), 'specified') then 40 else 30 end end
* case when abs(home_score - away_score) <= 1 then 1e0 when abs(home_score - away_score) = 2 then 15e-1 else 175e-2 + (abs(home_score - away_score) - 3) / 8e0 end k from fx_match where home_score is not null""")
def p15(spark, sf):
    m = fixture(spark, sf, "match").filter("home_score is not null")
    return m.select("event_id", (ratings.k_factor("tournament") * o.margin_factor(F.col("home_score") - F.col("away_score"))).alias("k"))


@query("p16_decays", M + ", l as (select max(match_date) d from fx_match) select event_id, round(pow(5e-1, date_diff('day', match_date, d) / 120e0), 9) half, round(exp(-65e-4 * date_diff('day', match_date, d)), 9) expo from fx_match, l")
def p16(spark, sf):
    m = fixture(spark, sf, "match")
    m = m.join(F.broadcast(m.agg(F.max("match_date").alias("d")))).withColumn("age", F.datediff("d", "match_date"))
    return m.select("event_id", F.round(o.half_life("age", 120.0), 9).alias("half"), F.round(o.exponential_decay("age", 0.0065), 9).alias("expo"))


@query("p17_buckets", B + " select floor(model_prob * 10) / 10 decile, case when model_prob - 1/odd < 0 then 'none' when model_prob - 1/odd < 5e-2 then 'small' when model_prob - 1/odd < 15e-2 then 'medium' else 'large' end band, count(*) n from fx_bet group by 1, 2")
def p17(spark, sf):
    e = o.edge("model_prob", "odd")
    band = F.when(e < 0, "none").when(e < 0.05, "small").when(e < 0.15, "medium").otherwise("large")
    return fixture(spark, sf, "bet").groupBy(o.decile("model_prob").alias("decile"), band.alias("band")).agg(F.count("*").alias("n"))


@query("p18_roles", P + """, l as (select price_id, odd_home, odd_away, 'home' s from fx_price union all select price_id, odd_home, odd_away, 'draw' from fx_price union all select price_id, odd_home, odd_away, 'away' from fx_price)
select price_id, s selection, case when s = 'draw' then 'draw' when (s = 'home') = (odd_home <= odd_away) then 'favourite' else 'underdog' end as role from l""")
def p18(spark, sf):
    p = fixture(spark, sf, "price").withColumn("selection", F.explode(F.array(*map(F.lit, ("home", "draw", "away")))))
    return p.select("price_id", "selection", o.role("selection", "odd_home", "odd_away").alias("role"))


@query("p19_entropy", P + """, p as (select price_id, (1/odd_home) / (1/odd_home + 1/odd_draw + 1/odd_away) h, (1/odd_draw) / (1/odd_home + 1/odd_draw + 1/odd_away) d, (1/odd_away) / (1/odd_home + 1/odd_draw + 1/odd_away) a from fx_price)
select price_id, round(-(h * ln(h) + d * ln(d) + a * ln(a)), 6) entropy, round(greatest(h, d, a), 6) sharpness from p""")
def p19(spark, sf):
    p = fixture(spark, sf, "price")
    total = o.implied("odd_home") + o.implied("odd_draw") + o.implied("odd_away")
    p = p.select("price_id", *[(o.implied(f"odd_{x}") / total).alias(x) for x in ("home", "draw", "away")])
    return p.select("price_id", F.round(o.entropy(["home", "draw", "away"]), 6).alias("entropy"), F.round(F.greatest("home", "draw", "away"), 6).alias("sharpness"))


@query("p21_late", Q + " select quote_id, captured_at >= kickoff_at late from fx_quote")
def p21(spark, sf):
    return fixture(spark, sf, "quote").select("quote_id", (F.col("captured_at") >= F.col("kickoff_at")).alias("late"))


@query("p23_ids", Q + " select quote_id, sha256('t1:' || cast(match_id as varchar(20)) || ':' || selection) id from fx_quote")
def p23(spark, sf):
    return fixture(spark, sf, "quote").select("quote_id", F.sha2(F.concat_ws(":", F.lit("t1"), "match_id", "selection"), 256).alias("id"))


@query("p24_kelly", B + " select game_id, line_no, round(case when odd > 1 then least(greatest(25e-2 * (model_prob * odd - 1) / (odd - 1), 0), 5e-2) else 0 end, 6) stake from fx_bet")
def p24(spark, sf):
    return fixture(spark, sf, "bet").select("game_id", "line_no", F.round(o.kelly("model_prob", "odd"), 6).alias("stake"))


@query("p25_staleness", Q + " select quote_id, odd from fx_quote where case when quote_id % 11 = 0 then true else captured_at >= kickoff_at - interval '72' hour end")
def p25(spark, sf):
    q = fixture(spark, sf, "quote").withColumn("at", F.when(F.col("quote_id") % 11 != 0, F.col("captured_at")))
    return q.filter(F.col("at").isNull() | (F.col("at") >= F.col("kickoff_at") - F.expr("interval '72' hour"))).select("quote_id", "odd")


PAIRED = """m as (select *, least(home, away) a, greatest(home, away) b from fx_match), p as (select price_id, price_date, home phome, odd_home, odd_draw, odd_away, least(home, away) a, greatest(home, away) b from fx_price)"""


@query("j01_nearest_price", with_fixtures("match", "price") + ", " + PAIRED + """, x as (select m.event_id, p.price_id, abs(date_diff('day', match_date, price_date)) gap,
case when phome = home then odd_home else odd_away end odd_h, odd_draw odd_d, case when phome = home then odd_away else odd_home end odd_a from m join p on m.a = p.a and m.b = p.b and price_date between match_date - 3 and match_date + 3)
select event_id, price_id, gap, odd_h, odd_d, odd_a from (select *, row_number() over (partition by event_id order by gap, price_id) n from x) where n = 1""")
def j01(spark, sf):
    m = fixture(spark, sf, "match").select("event_id", "match_date", "home", F.least("home", "away").alias("a"), F.greatest("home", "away").alias("b"))
    p = fixture(spark, sf, "price").select("price_id", "price_date", F.col("home").alias("phome"), "odd_home", "odd_draw", "odd_away", F.least("home", "away").alias("a"), F.greatest("home", "away").alias("b"))
    got = asof.nearest_by_date(m, p, ["a", "b"], "match_date", "price_date", 3, "event_id", "price_id")
    same = F.col("phome") == F.col("home")
    return got.select("event_id", "price_id", "gap", F.when(same, F.col("odd_home")).otherwise(F.col("odd_away")).alias("odd_h"), F.col("odd_draw").alias("odd_d"), F.when(same, F.col("odd_away")).otherwise(F.col("odd_home")).alias("odd_a"))


@query("j02_latest_price", P + " select a, b, price_date, price_id, odd_draw from (select *, least(home, away) a, greatest(home, away) b, row_number() over (partition by least(home, away), greatest(home, away) order by price_date desc, price_id desc) n from fx_price) where n = 1")
def j02(spark, sf):
    p = fixture(spark, sf, "price").withColumns({"a": F.least("home", "away"), "b": F.greatest("home", "away")})
    return asof.latest(p, ["a", "b"], ["odd_draw"], ["price_date", "price_id"])


@query("j03_exact", with_fixtures("match", "price") + " select event_id, price_id, odd_home from fx_match m join fx_price p on m.match_date = p.price_date and m.home = p.home and m.away = p.away")
def j03(spark, sf):
    p = fixture(spark, sf, "price").withColumnRenamed("price_date", "match_date")
    return fixture(spark, sf, "match").join(p, ["match_date", "home", "away"]).select("event_id", "price_id", "odd_home")


@query("j04_left", with_fixtures("match", "price") + " select event_id, price_id, odd_home from fx_match m left join fx_price p on m.match_date = p.price_date and m.home = p.home and m.away = p.away")
def j04(spark, sf):
    p = fixture(spark, sf, "price").withColumnRenamed("price_date", "match_date")
    return fixture(spark, sf, "match").join(p, ["match_date", "home", "away"], "left").select("event_id", "price_id", "odd_home")


@query("j05_stat_totals", with_fixtures("match", "stat") + """ select m.event_id, tournament, h.value home_value, a.value away_value, h.value + a.value total from fx_match m
join fx_stat h on h.event_id = m.event_id and h.team = 'home' and h.period = 'ALL' and h.stat_name = 'stat_N' join fx_stat a on a.event_id = m.event_id and a.team = 'away' and a.period = 'ALL' and a.stat_name = 'stat_N'""")
def j05(spark, sf):
    s = fixture(spark, sf, "stat").filter("period = 'ALL' and stat_name = 'stat_N'").groupBy("event_id").agg(*[F.max(F.when(F.col("team") == t, F.col("value"))).alias(f"{t}_value") for t in ("home", "away")])
    s = s.dropna().withColumn("total", F.col("home_value") + F.col("away_value"))
    return fixture(spark, sf, "match").select("event_id", "tournament").join(s, "event_id")


@query("j07_fallback", S + """, c as (select event_id, team, stat_name, value, case stat_name when 'stat_R' then 1 when 'stat_A' then 2 else 3 end r from fx_stat where period = 'ALL')
select event_id, team, stat_name, value from (select *, row_number() over (partition by event_id, team order by r) n from c) where n = 1""")
def j07(spark, sf):
    s = fixture(spark, sf, "stat").filter("period = 'ALL'").withColumn("r", F.when(F.col("stat_name") == "stat_R", 1).when(F.col("stat_name") == "stat_A", 2).otherwise(3))
    return asof.latest(s, ["event_id", "team"], ["stat_name", "value"], ["r"], earliest=True).drop("r")


@query("j08_with_statistics", with_fixtures("match", "stat") + " select event_id from fx_match where event_id in (select event_id from fx_stat where period = '1ST')")
def j08(spark, sf):
    return fixture(spark, sf, "match").join(fixture(spark, sf, "stat").filter("period = '1ST'"), "event_id", "left_semi").select("event_id")


@query("j09_orphans", with_fixtures("match", "price") + ", m as (select distinct least(home, away) a, greatest(home, away) b, season from fx_match where home_score is not null) select distinct least(home, away) a, greatest(home, away) b, year(price_date) season from fx_price p where not exists (select 1 from m where m.a = least(p.home, p.away) and m.b = greatest(p.home, p.away) and m.season = year(p.price_date))")
def j09(spark, sf):
    m = fixture(spark, sf, "match").filter("home_score is not null").select(F.least("home", "away").alias("a"), F.greatest("home", "away").alias("b"), "season")
    p = fixture(spark, sf, "price").select(F.least("home", "away").alias("a"), F.greatest("home", "away").alias("b"), F.year("price_date").alias("season")).distinct()
    return p.join(m, ["a", "b", "season"], "left_anti")


@query("j10_as_of", Q + " select match_id, book, selection, max(captured_at) captured_at, arg_max(odd, (captured_at, quote_id)) odd from fx_quote where captured_at <= kickoff_at - interval '24' hour group by 1, 2, 3")
def j10(spark, sf):
    q = fixture(spark, sf, "quote")
    cut = F.col("captured_at") <= F.col("kickoff_at") - F.expr("interval '24' hour")
    return asof.latest(q, ["match_id", "book", "selection"], ["odd"], ["captured_at", "quote_id"], cut).drop("quote_id")


@query("j11_closing", Q + " select match_id, book, selection, max(captured_at) captured_at, arg_max(odd, (captured_at, quote_id)) odd from fx_quote where captured_at < kickoff_at and captured_at >= kickoff_at - interval '72' hour and odd > 1 and odd < 1000 group by 1, 2, 3")
def j11(spark, sf):
    q = fixture(spark, sf, "quote")
    cut = (F.col("captured_at") < F.col("kickoff_at")) & (F.col("captured_at") >= F.col("kickoff_at") - F.expr("interval '72' hour")) & o.is_price("odd")
    return asof.latest(q, ["match_id", "book", "selection"], ["odd"], ["captured_at", "quote_id"], cut).drop("quote_id")


@query("j12_opening", Q + " select match_id, selection, min(captured_at) captured_at, arg_min(book, (captured_at, quote_id)) book, arg_min(odd, (captured_at, quote_id)) odd from fx_quote group by 1, 2")
def j12(spark, sf):
    return asof.latest(fixture(spark, sf, "quote"), ["match_id", "selection"], ["book", "odd"], ["captured_at", "quote_id"], earliest=True).drop("quote_id")


@query("j13_best_price", Q + " select match_id, selection, max(odd) best, arg_max(book, (odd, book)) book, count(distinct book) books from fx_quote where captured_at <= kickoff_at - interval '24' hour group by 1, 2")
def j13(spark, sf):
    q = fixture(spark, sf, "quote").filter("captured_at <= kickoff_at - interval '24' hour")
    return q.groupBy("match_id", "selection").agg(F.max("odd").alias("best"), F.max(F.struct("odd", "book"))["book"].alias("book"), F.count_distinct("book").alias("books"))


@query("j14_interval", Q + """, k as (select distinct match_id, kickoff_at from fx_quote), f as (select match_id fixture_id, match_id % 4 grp, kickoff_at start_at from k), q as (select quote_id, match_id % 4 grp, captured_at from fx_quote)
select q.quote_id, count(f.fixture_id) n, min(f.fixture_id) fixture_id, case when count(f.fixture_id) = 0 then 'no fixture' when count(f.fixture_id) = 1 then 'matched' else 'ambiguous' end status
from q left join f on q.grp = f.grp and abs(date_diff('second', q.captured_at, f.start_at)) <= 36 * 3600 group by 1""")
def j14(spark, sf):
    q = fixture(spark, sf, "quote")
    f = q.select(F.col("match_id").alias("fixture_id"), (F.col("match_id") % 4).alias("grp"), F.col("kickoff_at").alias("start_at")).distinct()
    left = q.select("quote_id", (F.col("match_id") % 4).alias("grp"), "captured_at")
    got = asof.within(left, f, ["grp"], "captured_at", "start_at", 36).groupBy("quote_id").agg(F.count("*").alias("n"), F.min("fixture_id").alias("fixture_id"))
    out = left.select("quote_id").join(got, "quote_id", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    return out.withColumn("status", F.when(F.col("n") == 0, "no fixture").when(F.col("n") == 1, "matched").otherwise("ambiguous"))


@query("j15_decision_window", Q + " select quote_id, match_id from fx_quote where captured_at >= kickoff_at - interval '105' minute and captured_at < kickoff_at")
def j15(spark, sf):
    return fixture(spark, sf, "quote").filter("captured_at >= kickoff_at - interval '105' minute and captured_at < kickoff_at").select("quote_id", "match_id")


@query("j16_settlement", with_fixtures("match", "bet") + """, r as (select event_id, home_score, away_score from fx_match where home_score is not null)
select b.game_id, b.line_no, b.market, case market when '1x2' then case when home_score > away_score then 1 else 0 end when 'btts' then case when home_score > 0 and away_score > 0 then 1 else 0 end else case when home_score + away_score = 3 then null when home_score + away_score > 3 then 1 else 0 end end won,
case market when '1x2' then case when home_score > away_score then round(odd - 1, 3) else -1e0 end when 'btts' then case when home_score > 0 and away_score > 0 then round(odd - 1, 3) else -1e0 end else case when home_score + away_score = 3 then 0e0 when home_score + away_score > 3 then round(odd - 1, 3) else -1e0 end end profit
from fx_bet b join r on r.event_id = b.game_id""")
def j16(spark, sf):
    r = fixture(spark, sf, "match").filter("home_score is not null").select(F.col("event_id").alias("game_id"), "home_score", "away_score")
    h, a = F.col("home_score"), F.col("away_score")
    total = F.when(h + a != 3, (h + a > 3).cast("int"))
    won = F.when(F.col("market") == "1x2", (h > a).cast("int")).when(F.col("market") == "btts", o.both_score(h, a).cast("int")).otherwise(total)
    b = fixture(spark, sf, "bet").join(r, "game_id").withColumn("won", won)
    return b.select("game_id", "line_no", "market", "won", o.profit("won", "odd").alias("profit"))


@query("j17_latest_prediction", with_fixtures("match", "bet") + """, p as (select game_id, arg_max(model_prob, (line_no, odd, model_prob)) prob, max(line_no) line_no from fx_bet group by 1)
select event_id, line_no, prob, case when home_score > away_score then 1 else 0 end hit from fx_match m join p on p.game_id = m.event_id where home_score is not null""")
def j17(spark, sf):
    p = fixture(spark, sf, "bet").groupBy(F.col("game_id").alias("event_id")).agg(F.max(F.struct("line_no", "odd", "model_prob"))["model_prob"].alias("prob"), F.max("line_no").alias("line_no"))
    m = fixture(spark, sf, "match").filter("home_score is not null")
    return m.join(p, "event_id").select("event_id", "line_no", "prob", (F.col("home_score") > F.col("away_score")).cast("int").alias("hit"))


@query("j18_merge_reasons", with_fixtures("match", "bet") + """, b as (select *, row_number() over (partition by game_id, market order by line_no, odd, model_prob) n from fx_bet)
select b.game_id, b.line_no, case when n > 1 then 'duplicate' when m.event_id is null then 'no fixture' when m.home_score is null then 'no result' when b.odd < 125e-2 then 'price' end reason from b left join fx_match m on m.event_id = b.game_id""")
def j18(spark, sf):
    b = fixture(spark, sf, "bet").withColumn("n", F.row_number().over(Window.partitionBy("game_id", "market").orderBy("line_no", "odd", "model_prob")))
    m = fixture(spark, sf, "match").select(F.col("event_id").alias("game_id"), "event_id", "home_score")
    reason = store.first_reason([("duplicate", F.col("n") == 1), ("no fixture", F.col("event_id").isNotNull()), ("no result", F.col("home_score").isNotNull()), ("price", F.col("odd") >= 1.25)])
    return b.join(m, "game_id", "left").select("game_id", "line_no", reason.alias("reason"))


@query("j19_paired", B + ", x as (select game_id, sum(odd) s from fx_bet where line_no <= 3 group by 1), y as (select game_id, sum(odd) s from fx_bet where line_no >= 3 group by 1) select game_id, round(x.s, 6) left_odds, round(y.s, 6) right_odds from x full join y using (game_id)")
def j19(spark, sf):
    b = fixture(spark, sf, "bet")
    x, y = (b.filter(c).groupBy("game_id").agg(F.round(F.sum("odd"), 6).alias(n)) for c, n in (("line_no <= 3", "left_odds"), ("line_no >= 3", "right_odds")))
    return x.join(y, "game_id", "full")


@query("j21_coverage", with_fixtures("match", "price") + """, n as (select distinct price_date d, home, away, cast(price_id % 3 as int) hs from fx_price), e as (select match_date d, home, away, max(home_score) hs from fx_match group by 1, 2, 3)
select count(*) total, count(*) filter (where e.d is null) new_rows, count(*) filter (where e.d is not null and e.hs is not distinct from n.hs) same_rows, count(*) filter (where e.d is not null and e.hs is distinct from n.hs) conflicts from n left join e on n.d = e.d and n.home = e.home and n.away = e.away""")
def j21(spark, sf):
    n = fixture(spark, sf, "price").select(F.col("price_date").alias("d"), "home", "away", (F.col("price_id") % 3).cast("int").alias("hs")).distinct()
    e = fixture(spark, sf, "match").groupBy(F.col("match_date").alias("d"), "home", "away").agg(F.max("home_score").alias("ehs"), F.lit(True).alias("known"))
    j, same = n.join(e, ["d", "home", "away"], "left"), F.col("hs").eqNullSafe(F.col("ehs"))
    known = F.col("known").isNotNull()
    return j.agg(F.count("*").alias("total"), F.count_if(~known).alias("new_rows"), F.count_if(known & same).alias("same_rows"), F.count_if(known & ~same).alias("conflicts"))


@query("j22_coverage_counts", with_fixtures("match", "stat", "quote") + """ select tournament, count(distinct m.event_id) n_matches, count(distinct case when s.event_id is not null then m.event_id end) with_stats, count(distinct case when p.o_orderkey is not null then m.event_id end) with_price
from fx_match m left join fx_stat s on s.event_id = m.event_id and s.period = '1ST' left join (select o_orderkey from orders where o_orderkey % 3 = 0) p on p.o_orderkey = m.event_id group by 1""")
def j22(spark, sf):
    s = fixture(spark, sf, "stat").filter("period = '1ST'").select("event_id", F.lit(1).alias("s")).distinct()
    p = fixture(spark, sf, "price").select(F.col("price_id").alias("event_id"), F.lit(1).alias("p"))
    m = fixture(spark, sf, "match").select("event_id", "tournament").join(s, "event_id", "left").join(p, "event_id", "left")
    return m.groupBy("tournament").agg(F.count("*").alias("n_matches"), F.count("s").alias("with_stats"), F.count("p").alias("with_price"))


@query("j24_lookup_chain", "select p_partkey, coalesce(a.v, b.v, 0e0) v from part left join (select l_partkey, round(avg(l_discount), 6) v from lineitem where l_quantity > 49 group by 1) a on a.l_partkey = p_partkey left join (select p_brand br, round(avg(p_size), 6) v from part where p_size < 10 group by 1) b on b.br = p_brand")
def j24(spark, sf):
    part, line = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("part", "lineitem"))
    a = line.filter("l_quantity > 49").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.round(F.avg("l_discount"), 6).alias("a"))
    b = part.filter("p_size < 10").groupBy("p_brand").agg(F.round(F.avg("p_size"), 6).alias("b"))
    return part.join(a, "p_partkey", "left").join(b, "p_brand", "left").select("p_partkey", F.coalesce("a", "b", F.lit(0.0)).alias("v"))


@query("u01_union_kinds", O + " select entity_type, seq from fx_obs where entity_type = 'click' union all select entity_type, seq from fx_obs where entity_type = 'view'")
def u01(spark, sf):
    x = fixture(spark, sf, "obs").select("entity_type", "seq")
    return x.filter("entity_type = 'click'").unionByName(x.filter("entity_type = 'view'"))


@query("u02_intersect", B + " select game_id from fx_bet where market = '1x2' intersect select game_id from fx_bet where market = 'btts'")
def u02(spark, sf):
    b = fixture(spark, sf, "bet")
    return b.filter("market = '1x2'").select("game_id").intersect(b.filter("market = 'btts'").select("game_id"))


@query("u03_union_keys", B + " select game_id from fx_bet where market = '1x2' union select game_id from fx_bet where market = 'btts'")
def u03(spark, sf):
    b = fixture(spark, sf, "bet")
    return b.filter("market = '1x2'").select("game_id").union(b.filter("market = 'btts'").select("game_id")).distinct()


@query("u05_symmetric_difference", Q + """, b as (select match_id, list(distinct book) filter (where captured_at < kickoff_at - interval '96' hour) x, list(distinct book) filter (where captured_at >= kickoff_at) y from fx_quote group by 1)
select match_id, len(list_filter(coalesce(x, []), lambda v: not list_contains(coalesce(y, []), v))) + len(list_filter(coalesce(y, []), lambda v: not list_contains(coalesce(x, []), v))) n from b""")
def u05(spark, sf):
    q = fixture(spark, sf, "quote")
    early, late = F.col("captured_at") < F.col("kickoff_at") - F.expr("interval '96' hour"), F.col("captured_at") >= F.col("kickoff_at")
    b = q.groupBy("match_id").agg(F.collect_set(F.when(early, F.col("book"))).alias("x"), F.collect_set(F.when(late, F.col("book"))).alias("y"))
    return b.select("match_id", (F.size(F.array_except("x", "y")) + F.size(F.array_except("y", "x"))).cast("long").alias("n"))


@query("u06_difference", B + " select game_id from fx_bet where market = '1x2' except select game_id from fx_bet where market = 'btts'")
def u06(spark, sf):
    b = fixture(spark, sf, "bet")
    return b.filter("market = '1x2'").select("game_id").subtract(b.filter("market = 'btts'").select("game_id"))


@query("u07_teams", M + " select home team from fx_match union select away from fx_match")
def u07(spark, sf):
    m = fixture(spark, sf, "match")
    return m.select(F.col("home").alias("team")).union(m.select("away")).distinct()


#: What the two engines call the same.
SPARK_NAMES = {"{like}": "regexp_like", "{sha}": "sha2", "{bits}": ", 256", "{time}": "date_format", "{format}": "yyyy-MM-dd HH:mm:ss"}
OTHER_NAMES = {"{like}": "regexp_matches", "{sha}": "sha256", "{bits}": "", "{time}": "strftime", "{format}": "%Y-%m-%d %H:%M:%S"}


def _spelt(text: str, names: dict[str, str]) -> str:
    for k, v in names.items():
        text = text.replace(k, v)
    return text


def _rule_query(name, fx, ids, rules, more=None):
    """A validation: rows with the first rule they break; the rules are predicates that both engines read alike.

    ``more`` are columns that the rules read beside those of the fixture, each one after those before it.
    """
    more = more or {}
    case = " ".join(f"when not coalesce({r}, false) then '{n}'" for n, r in rules)
    inner = f"fx_{fx}"
    for c, text in more.items():
        inner = f"(select *, {text} {c} from {inner})"
    sql = with_fixtures(fx) + _spelt(f" select {', '.join(ids)}, case {case} end reason from {inner}", OTHER_NAMES)

    def run(spark, sf):
        df = fixture(spark, sf, fx)
        for c, text in more.items():
            df = df.withColumn(c, F.expr(_spelt(text, SPARK_NAMES)))
        return df.select(*ids, store.first_reason([(n, F.expr(_spelt(r, SPARK_NAMES))) for n, r in rules]).alias("reason"))

    query(name, sql)(run)
    return run, sql


#: Instants as texts, some without a zone, and records with the digest that their writer gave them; some were changed since.
ZONE = "{like}(said, '(Z|[+-][0-9]{2}:[0-9]{2})$')"
_SAID = "concat({time}(%s, '{format}'), case when %s %% 17 = 0 then '' when %s %% 3 = 0 then 'Z' else '+00:00' end)"
PICK = {
    "said": _SAID % ("captured_at", "quote_id", "quote_id"),
    "record": "concat_ws('|', cast(quote_id as varchar(20)), book, selection, said, cast(cast(round(odd * 100) as bigint) as varchar(20)))",
    "given": "{sha}(case when quote_id % 13 = 0 then concat(record, '0') else record end{bits})",
}
SETTLED = {
    "said": _SAID % ("cast(bet_date as timestamp)", "game_id", "game_id"),
    "record": "concat_ws('|', cast(game_id as varchar(20)), cast(line_no as varchar(20)), market, said, cast(won as varchar(20)))",
    "given": "{sha}(case when game_id % 13 = 0 then concat(record, '0') else record end{bits})",
}
#: Half-time scores as texts: most are half of the final ones, some are missing, no numbers or more than the final ones.
HALF_TIME = {
    "half": "case when event_id % 19 = 0 then null when event_id % 23 = 0 then 'n-a' else concat(cast(floor(home_score / 2) + case when event_id % 11 = 0 then 3 else 0 end as int), '-', cast(floor(away_score / 2) as int)) end",
    "ht_home": "cast(case when {like}(half, '^[0-9]+-[0-9]+$') then split_part(half, '-', 1) end as int)",
    "ht_away": "cast(case when {like}(half, '^[0-9]+-[0-9]+$') then split_part(half, '-', 2) end as int)",
}
AGAIN = {"nth": "row_number() over (partition by game_id, market, bet_at order by line_no, odd, model_prob, won, bet_date)"}

_rule_query("v01_picks", "quote", ["quote_id"], [("missing", "odd is not null and book is not null"), ("zone", ZONE), ("clock", "captured_at < kickoff_at"), ("odds", "odd > 15e-1 and odd < 1000"), ("production", "book <> 'click'"), ("hash", "given = {sha}(record{bits})")], PICK)
_rule_query("v02_settlements", "bet", ["game_id", "line_no"], [("missing", "odd is not null and won is not null"), ("zone", ZONE), ("close", "bet_at <> 'close' or line_no < 7"), ("price", "odd > 125e-2"), ("probability", "model_prob > 0 and model_prob < 1"), ("market", "market in ('1x2', 'ou25')"), ("hash", "given = {sha}(record{bits})")], SETTLED)
v03, V03_SQL = _rule_query("v03_curated", "obs", ["seq"], [("fields", "payload is not null"), ("order", "published_at <= ingested_at and event_at <= published_at"), ("late", "published_at < event_at + interval '6' hour")])
_rule_query("v05_eligible", "quote", ["quote_id"], [("not available", "captured_at <= kickoff_at - interval '24' hour"), ("after start", "kickoff_at - interval '24' hour < kickoff_at")])
_rule_query("v07_bets", "bet", ["game_id", "line_no"], [("market", "market in ('1x2', 'ou25', 'btts')"), ("odds", "odd > 1"), ("duplicate", "nth = 1"), ("cap", "odd <= 5"), ("edge", "model_prob * odd > 1")], AGAIN)
_rule_query("v08_observations", "obs", ["seq"], [("order", "ingested_at >= published_at"), ("payload", "payload like '{%}'")])
_rule_query("v09_scores", "match", ["event_id"], [("missing", "home_score is not null and away_score is not null"), ("range", "home_score between 0 and 3"), ("half-time text", "half is null or ht_home is not null"), ("half-time", "half is null or (ht_home <= home_score and ht_away <= away_score)"), ("teams", "home <> away")], HALF_TIME)


@query("v03_tables", f"with r as ({V03_SQL}) select case when reason is null then 'curated' else 'rejected' end kept_in, reason, count(*) n, min(seq) first_seq from r group by 1, 2")
def v03_tables(spark, sf):
    """What goes on and what a reject table keeps, written apart: both together are all rows."""
    rows = cut(v03(spark, sf), "v03-rows")
    kept, rejected = cut(rows.filter("reason is null"), "v03-curated"), cut(rows.filter("reason is not null"), "v03-rejects")
    both = kept.withColumn("kept_in", F.lit("curated")).union(rejected.withColumn("kept_in", F.lit("rejected")))
    return both.groupBy("kept_in", "reason").agg(F.count("*").alias("n"), F.min("seq").alias("first_seq"))


@query("v04_entities", "with recursive a as (select n_name, lower(substr(n_name, 1, 3)) k from nation), c as (select k, count(*) n, min(n_name) name from a group by 1) select s_suppkey, case when n is null then 'rejected' when n = 1 then 'exact' else 'ambiguous' end status, case when n = 1 then name end name from (select s_suppkey, case when s_suppkey % 5 = 0 then 'zzz' else lower(substr(n_name, 1, 3)) end k from supplier join nation on s_nationkey = n_nationkey) s left join c using (k)")
def v04(spark, sf):
    s, n = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("supplier", "nation"))
    short = F.lower(F.substring("n_name", 1, 3))
    c = n.groupBy(short.alias("k")).agg(F.count("*").alias("n"), F.min("n_name").alias("name"))
    asked = s.join(n, s.s_nationkey == n.n_nationkey).select("s_suppkey", F.when(F.col("s_suppkey") % 5 == 0, "zzz").otherwise(short).alias("k"))
    status = F.when(F.col("n").isNull(), "rejected").when(F.col("n") == 1, "exact").otherwise("ambiguous")
    return asked.join(c, "k", "left").select("s_suppkey", status.alias("status"), F.when(F.col("n") == 1, F.col("name")).alias("name"))


@query("v06_splits", M + " select case when match_date < date '1996-01-01' then 'dev' when match_date < date '1998-01-01' then 'val' else 'test' end split, min(match_date) first, max(match_date) last, count(*) n from fx_match group by 1")
def v06(spark, sf):
    d = F.col("match_date")
    split = F.when(d < F.lit("1996-01-01").cast("date"), "dev").when(d < F.lit("1998-01-01").cast("date"), "val").otherwise("test")
    return fixture(spark, sf, "match").groupBy(split.alias("split")).agg(F.min("match_date").alias("first"), F.max("match_date").alias("last"), F.count("*").alias("n"))
