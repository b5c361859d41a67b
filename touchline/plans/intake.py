"""Intake: more feeds, files and sinks. Payloads are made from the tables, so plain SQL over these gives the rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from touchline.functions import grid as g
from touchline.functions import odds as o
from touchline.operators import asof, resample, store
from touchline.operators.lineage import removed_at_exit, scratch
from touchline.sources import feeds
from touchline.sources.fixtures import fixture, with_fixtures

from .core import query
from .feeds import new_ledger
from .models import MEANS, MN, means, priced

M, Q, B, S, O, P = (with_fixtures(n) for n in ("match", "quote", "bet", "stat", "obs", "price"))  # noqa: E741


def r6(c):
    return F.round(c, 6)


@query("s04_results_file", M + """ select match_date as date, home home_team, away away_team, arg_max(home_score, event_id) home_score, arg_max(away_score, event_id) away_score, arg_max(tournament, event_id) tournament, arg_max(is_neutral, event_id) neutral
from (select * replace (coalesce(home_score, -1) as home_score, coalesce(away_score, -1) as away_score) from fx_match where event_id % 11 > 0) group by 1, 2, 3""")
def s04(spark, sf):
    """A file of results with bad dates, names and numbers; its own place can't be read, so the copy is."""
    m = fixture(spark, sf, "match")
    bad = F.col("event_id") % 11 == 0
    lines = m.select(
        F.when(bad & (F.col("event_id") % 2 == 0), "31/12/1999").otherwise(F.col("match_date").cast("string")).alias("date"), F.when(bad & (F.col("event_id") % 2 == 1), " ").otherwise(F.col("home")).alias("home_team"), F.col("away").alias("away_team"),
        F.concat(F.coalesce("home_score", F.lit(-1)), F.lit(".0")).alias("home_score"), F.coalesce(F.col("away_score").cast("string"), F.lit("-1")).alias("away_score"), "tournament", F.when(F.col("is_neutral") == 1, "true").otherwise("FALSE").alias("neutral"), "event_id",
    )
    path = scratch(spark, "results-file")
    removed_at_exit(spark, path)
    lines.repartitionByRange("event_id").sortWithinPartitions("event_id").drop("event_id").write.option("header", True).csv(path)
    return feeds.results_file(spark, f"{path}-not-there", path)


_FEED = "select price_id event_id, price_id % 30 h, price_id % 40 d, price_id % 20 o, home, away from fx_price"


@query("s08_all_markets", P + f""", f as ({_FEED}), k as (select *, round(1 + h / 10e0, 3) a, round(1 + d / 10e0, 3) b, round(1 + o / 4e0, 3) c from f)
select event_id, '1x2' market, cast(null as double) line, 'home' selection, a odd, b odd_open from k union all select event_id, '1x2', null, 'draw', b, null from k union all select event_id, '1x2', null, 'away', c, a from k
union all select event_id, 'double chance', null, '1x', a, b from k union all select event_id, 'draw no bet', null, 'home', b, c from k union all select event_id, 'both score', null, 'yes', c, a from k
union all select event_id, 'over/under', 25e-1, 'over', c, a from k union all select event_id, 'cards', 45e-1, 'under', a, a from k union all select event_id, 'corners', 95e-1, 'over', b, b from k
union all select event_id, 'asian handicap', -75e-2, 'home', a, b from k union all select event_id, 'asian handicap', -75e-2, 'away', c, a from k""")
def s08_all(spark, sf):
    """Every market of the odds feed; handicaps name their teams."""
    p = spark.sql(_FEED.replace("fx_price", "{p}"), p=fixture(spark, sf, "price"))
    part = lambda c, n: F.concat(F.col(c), F.lit(f"/{n}"))
    a, b, c = part("h", 10), part("d", 10), part("o", 4)
    none = F.lit(None).cast("string")
    one = lambda name, now, first: F.struct((name if not isinstance(name, str) else F.lit(name)).alias("name"), now.alias("fractionalValue"), first.alias("initialFractionalValue"))
    market = lambda k, group, *choices: F.struct(F.lit(k).alias("marketId"), F.lit("m").alias("marketName"), (F.lit(group) if group else none).alias("choiceGroup"), F.array(*choices).alias("choices"))
    handicap = market(17, None, one(F.concat(F.lit("(-0.75) "), F.lower("home")), a, b), one(F.concat(F.lit("( +0.75 ) "), "away", F.lit(" ")), c, a), one("(0.75) Nobody", a, a), one("no line", a, a))
    every = F.array(
        market(1, None, one("1", a, b), one("X", b, F.lit("x")), one("2", c, a)), market(2, None, one("1X", a, b)), market(4, None, one("1", b, c)), market(5, None, one("Yes", c, a)),
        market(9, "2.5", one("Over", c, a)), market(9, "two", one("Over", c, a)), market(20, "4.5", one("Under", a, a)), market(21, "9.5", one("Over", b, b)), handicap, market(99, None, one("1", a, a)),
    )
    raw = p.select("event_id", "home", "away", F.to_json(F.struct(every.alias("markets"))).alias("payload"))
    return feeds.odds(raw, home="home", away="away")


@query("s09_total_at_a_line", P + f", f as ({_FEED}) select event_id, case when event_id % 5 > 0 then round(1 + h / 10e0, 3) end as over, case when event_id % 5 > 0 then round(1 + d / 10e0, 3) end under from f")
def s09(spark, sf):
    """Over and under 2.5, of lines that hold the same digits, at the end of names or in the group."""
    p = spark.sql(_FEED.replace("fx_price", "{p}"), p=fixture(spark, sf, "price"))
    none, bad = F.lit(None).cast("string"), F.lit("9/1")
    one = lambda name, now: F.struct(F.lit(name).alias("name"), now.alias("fractionalValue"), none.alias("initialFractionalValue"))
    over, under = F.concat("h", F.lit("/10")), F.concat("d", F.lit("/10"))
    market = lambda name, group, *choices: F.struct(F.lit(9).alias("marketId"), F.lit(name).alias("marketName"), group.alias("choiceGroup"), F.array(*choices).alias("choices"))
    some = F.col("event_id") % 5 > 0
    group = F.when(some, "2.5").otherwise("3.5")
    in_group = market("Match goals", group, one("Over", over), one("Under", under))
    in_name = market("Total", F.lit("12.5"), one("Over 12.5", bad), F.struct(F.when(some, "Over 2.5").otherwise("Over 1.5").alias("name"), over.alias("fractionalValue"), none.alias("initialFractionalValue")), F.struct(F.when(some, "Under 2.5").otherwise("Under 1.5").alias("name"), under.alias("fractionalValue"), none.alias("initialFractionalValue")))
    markets = F.array(market("Corners", F.lit("2.5"), one("Over", bad), one("Under", bad)), market("Total goals", F.lit("2.5"), one("Over", bad)), F.when(F.col("event_id") % 2 == 0, in_group).otherwise(in_name))
    return feeds.total_at(p.select("event_id", F.to_json(F.struct(markets.alias("markets"))).alias("payload")), 2.5)


@query("s14_first_half", Q + """, q as (select *, 'e' || cast(quote_id as varchar(20)) event_id, quote_id % 3 k from fx_quote where captured_at < kickoff_at and odd > 1)
select event_id, book, case when k = 0 then 'ou1.5_1h' when k = 1 then 'ou1_1h' else '1x2_1h' end market, case when k < 2 then 'under' else selection end selection, case when k = 0 then 15e-1 when k = 1 then 1e0 end line, odd, captured_at from q""")
def s14(spark, sf):
    q = fixture(spark, sf, "quote")
    k = F.col("quote_id") % 3
    team = F.when(F.col("selection") == "home", "Ajax").when(F.col("selection") == "away", "PSV").otherwise("Draw")
    name, point = F.when(k < 2, "Under").otherwise(team), F.when(k == 0, 1.5).when(k == 1, 1.0)
    good = F.struct(name.alias("name"), F.col("odd").alias("price"), point.alias("point"))
    bad = F.array(F.struct(F.lit("Feyenoord").alias("name"), F.lit(2.0).alias("price"), F.lit(None).cast("double").alias("point")), F.struct(name.alias("name"), F.lit(1.0).alias("price"), point.alias("point")))
    market = F.struct(F.when(k < 2, "totals_h1").otherwise("h2h_3_way_h1").alias("key"), F.when(F.col("quote_id") % 2 == 0, F.col("captured_at").cast("string")).alias("last_update"), F.concat(F.array(good), bad).alias("outcomes"))
    book = F.struct(F.col("book").alias("key"), F.col("captured_at").cast("string").alias("last_update"), F.array(market).alias("markets"))
    body = F.struct(F.concat(F.lit("e"), "quote_id").alias("id"), F.col("kickoff_at").cast("string").alias("commence_time"), F.lit("Ajax").alias("home_team"), F.lit("PSV").alias("away_team"), F.array(book).alias("bookmakers"))
    got = feeds.first_half(q.select(F.to_json(body).alias("payload")))
    return got.drop("payload_hash").withColumn("captured_at", F.col("captured_at").cast("timestamp_ntz"))


@query("s16_schedule", M + """ select event_id, cast(match_date as timestamp) - interval '3' hour scheduled_at, home, away, home_score home_goals, away_score away_goals, case when home_score is null then 'NS' else 'FT' end status from fx_match where event_id % 9 > 1""")
def s16(spark, sf):
    m = fixture(spark, sf, "match")
    k = F.col("event_id") % 9
    date = F.concat(F.col("match_date").cast("string"), F.lit("T00:00:00"), F.when(k == 0, "").otherwise("+03:00"))
    body = F.struct(
        F.struct(F.col("event_id").alias("id"), date.alias("date"), F.struct(F.when(F.col("home_score").isNull(), "NS").otherwise("FT").alias("short")).alias("status")).alias("fixture"),
        F.struct(F.struct(F.when(k != 1, F.col("home")).alias("name")).alias("home"), F.struct(F.col("away").alias("name")).alias("away")).alias("teams"),
        F.struct(F.col("home_score").alias("home"), F.col("away_score").alias("away")).alias("goals"),
    )
    return feeds.schedule(m.select(F.to_json(body).alias("payload"))).withColumn("scheduled_at", F.col("scheduled_at").cast("timestamp_ntz"))


@query("s16_team_sheets", "select l_orderkey event_id, cast(l_orderkey % 2 as bigint) team_id, cast(l_suppkey as bigint) player_id, 'p' || cast(l_suppkey as varchar(20)) player, case when l_linenumber <= 4 then 'starter' else 'substitute' end role, case when l_linenumber = 1 then 'G' end as position, '4-3-3' formation from lineitem where l_suppkey % 10 > 0")
def s16b(spark, sf):
    line = spark.read.parquet(f"{sf}/lineitem.parquet")
    player = F.struct(F.struct(F.when(F.col("l_suppkey") % 10 > 0, F.col("l_suppkey")).cast("long").alias("id"), F.concat(F.lit("p"), "l_suppkey").alias("name"), F.when(F.col("l_linenumber") == 1, "G").alias("pos")).alias("player"))
    body = F.struct(F.struct((F.col("l_orderkey") % 2).cast("long").alias("id"), F.lit("Team").alias("name")).alias("team"), F.lit("4-3-3").alias("formation"), F.when(F.col("l_linenumber") <= 4, F.array(player)).alias("startXI"), F.when(F.col("l_linenumber") > 4, F.array(player)).alias("substitutes"))
    return feeds.team_sheets(line.select(F.col("l_orderkey").alias("event_id"), F.to_json(body).alias("payload"))).drop("payload_hash")


@query("s20_append_lines", B + " select game_id, line_no, market, odd from fx_bet")
def s20(spark, sf):
    """Two appends to one folder of lines, read back."""
    b, path = fixture(spark, sf, "bet").select("game_id", "line_no", "market", "odd"), scratch(spark, "lines")
    removed_at_exit(spark, path)
    for part in ("line_no <= 3", "line_no > 3"):
        store.append_lines(b.filter(part), path)
    return spark.read.schema(b.schema).json(path)


@query("s27_persist", B + " select game_id, line_no, market, odd from fx_bet where line_no > 3")
def s27(spark, sf):
    """A ledger that takes the place of one before; read back from its CSV."""
    b, path = fixture(spark, sf, "bet").select("game_id", "line_no", "market", "odd"), scratch(spark, "ledger")
    removed_at_exit(spark, path)
    store.persist(b, path)
    store.persist(b.filter("line_no > 3"), path)
    return spark.read.option("header", True).schema(b.schema).csv(f"{path}/csv")


@query("p22_record_hash", Q + """ select quote_id, sha256('{"book":"' || book || '","match_id":' || cast(match_id as varchar(20)) || ',"quote_id":' || cast(quote_id as varchar(20)) || ',"selection":' || case when quote_id % 4 = 0 then 'null' else '"' || selection || '"' end || '}') hash from fx_quote""")
def p22(spark, sf):
    q = fixture(spark, sf, "quote").withColumn("selection", F.when(F.col("quote_id") % 4 > 0, F.col("selection")))
    return q.select("quote_id", store.record_hash("selection", "quote_id", "match_id", "book").alias("hash"))


@query("p06_value", P + " select price_id, round(45e-2 * odd_home - 1, 6) ev, round(45e-2 / ((1 / odd_home) / (1 / odd_home + 1 / odd_draw + 1 / odd_away)) - 1, 6) ev_ratio from fx_price")
def p06(spark, sf):
    """Expected value at the price, and the model's chance against the market's without its margin."""
    fair = o.implied("odd_home") / (o.implied("odd_home") + o.implied("odd_draw") + o.implied("odd_away"))
    return fixture(spark, sf, "price").select("price_id", r6(o.expected_value(F.lit(0.45), "odd_home")).alias("ev"), r6(0.45 / fair - 1).alias("ev_ratio"))


#: Letters with marks and what they are without.
MARKED, UNMARKED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy"
ALIASES = {"united states": "usa", "united kingdom": "england", "russia": "russian federation"}


@query("p10_aliases", "select s_suppkey, coalesce(case n " + " ".join(f"when '{a}' then '{b}'" for a, b in ALIASES.items()) + f" end, n) team from (select s_suppkey, translate(lower(trim(replace(n_name, 'IR', 'ÎR'))), '{MARKED}', '{UNMARKED}') n from supplier join nation on s_nationkey = n_nationkey)")
def p10_aliases(spark, sf):
    """Names in one spelling: no marks, small letters, and those that a table of other names has."""
    s, n = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("supplier", "nation"))
    name = F.translate(F.lower(F.trim(F.replace("n_name", F.lit("IR"), F.lit("ÎR")))), MARKED, UNMARKED)
    names = s.join(n, s.s_nationkey == n.n_nationkey).select("s_suppkey", name.alias("name"))
    other = spark.createDataFrame(list(ALIASES.items()), "name string, canonical string")
    return names.join(F.broadcast(other), "name", "left").select("s_suppkey", F.coalesce("canonical", "name").alias("team"))


@query("p20_narrative", MN + ", k as (select event_id, sum(case when i + j > 2 then p else 0 end) o, sum(case when i > 0 and j > 0 then p else 0 end) b from gr group by 1) select event_id, case when o >= 5e-1 then 'over' else 'under' end total_side, case when b >= 5e-1 then 'yes' else 'no' end both_side, (o >= 5e-1) = (b >= 5e-1) coherent from k")
def p20b(spark, sf):
    """Whether goals in all and goals of both sides tell one story."""
    df, grid = priced(means(spark, sf))
    over, both = grid.probability(g.PICKS["over25"]) >= 0.5, grid.probability(g.PICKS["btts"]) >= 0.5
    return df.select("event_id", F.when(over, "over").otherwise("under").alias("total_side"), F.when(both, "yes").otherwise("no").alias("both_side"), (over == both).alias("coherent"))


@query("w04_rest_gap", M + """, s as (select event_id, match_date, home team from fx_match union all select event_id, match_date, away from fx_match), d as (select team, match_date, coalesce(least(date_diff('day', lag(match_date) over (partition by team order by match_date), match_date), 5), 5) rest from (select distinct team, match_date from s))
select event_id, h.rest - a.rest gap from fx_match m join d h on h.team = m.home and h.match_date = m.match_date join d a on a.team = m.away and a.match_date = m.match_date""")
def w04_gap(spark, sf):
    """Rest days of the home side less those of the away side."""
    from .analytics import w04

    d, m = w04(spark, sf), fixture(spark, sf, "match").select("event_id", "match_date", "home", "away")
    for side in ("home", "away"):
        m = m.join(d.withColumnsRenamed({"team": side, "rest": f"{side}_rest"}), [side, "match_date"])
    return m.select("event_id", (F.col("home_rest") - F.col("away_rest")).alias("gap"))


#: Entries of a bank: it is opened anew now and then, and money comes and goes. Plain SQL for both engines.
BANK = "select o_orderkey as pos, case when o_orderkey % 400 = 1 then 'init' when o_orderkey % 10 = 0 then 'deposit' when o_orderkey % 15 = 0 then 'withdraw' end kind, cast(o_orderkey % 90 + 10 as double) amount from {orders}"


@query("a09_bank_state", B + ", k as (" + BANK.format(orders="orders") + f"""), i as (select max(pos) pos, arg_max(amount, pos) initial from k where kind = 'init'), f as (select coalesce(sum(case kind when 'deposit' then amount when 'withdraw' then -amount end), 0) flows from k, i where k.pos > i.pos),
s as (select count(*) filter (where game_id >= i.pos and line_no < 7) settled, coalesce(sum(case when game_id >= i.pos and line_no < 7 then case when won = 1 then odd - 1 else -1e0 end end), 0) units, count(*) filter (where line_no = 7) open_units from fx_bet, i)
select initial, round(flows, 2) flows, settled, round(units, 4) profit_units, round(initial + flows + units * 2, 2) balance, cast(open_units as double) open_units from i, f, s""")
def a09_bank(spark, sf):
    """The bank since it was last opened: flows, results settled since then in units of 2, and what is open at all."""
    k = spark.sql(BANK.format(orders="{o}"), o=spark.read.parquet(f"{sf}/orders.parquet")).filter("kind is not null")
    i = k.filter("kind = 'init'").agg(F.max("pos").alias("since"), F.max_by("amount", "pos").alias("initial"))
    flow = F.when(F.col("kind") == "deposit", F.col("amount")).when(F.col("kind") == "withdraw", -F.col("amount"))
    f = k.join(F.broadcast(i)).filter("pos > since").agg(F.coalesce(F.sum(flow), F.lit(0.0)).alias("flows"))
    b = fixture(spark, sf, "bet").join(F.broadcast(i))
    done = (F.col("game_id") >= F.col("since")) & (F.col("line_no") < 7)
    s = b.agg(F.count_if(done).alias("settled"), F.coalesce(F.sum(F.when(done, o.profit("won", "odd"))), F.lit(0.0)).alias("units"), F.count_if(F.col("line_no") == 7).cast("double").alias("open_units"))
    money = F.col("initial") + F.col("flows") + F.col("units") * 2
    return i.join(F.broadcast(f)).join(F.broadcast(s)).select("initial", F.round("flows", 2).alias("flows"), "settled", F.round("units", 4).alias("profit_units"), F.round(money, 2).alias("balance"), "open_units")


@query("a19_share_before", M + """, d as (select tournament, match_date, sum(home_score // 2 + away_score // 2) h, sum(home_score + away_score) f, count(home_score) n from fx_match group by 1, 2), c as (select tournament, match_date, sum(h) over w h, sum(f) over w f, sum(n) over w n from d window w as (partition by tournament order by match_date rows between unbounded preceding and 1 preceding))
select tournament, match_date, case when n >= 50 then round(h / f, 6) end share from c""")
def a19_before(spark, sf):
    """The share of goals before the break as it was known before each day; days are the rows of a window, not matches."""
    from pyspark.sql import Window

    half = F.floor(F.col("home_score") / 2) + F.floor(F.col("away_score") / 2)
    d = fixture(spark, sf, "match").groupBy("tournament", "match_date").agg(F.sum(half).alias("h"), F.sum(F.col("home_score") + F.col("away_score")).alias("f"), F.count("home_score").alias("n"))
    w = Window.partitionBy("tournament").orderBy("match_date").rowsBetween(Window.unboundedPreceding, -1)
    c = d.select("tournament", "match_date", *[F.sum(x).over(w).alias(x) for x in ("h", "f", "n")])
    return c.select("tournament", "match_date", F.when(F.col("n") >= 50, r6(F.col("h") / F.col("f"))).alias("share"))


@query("a23_execution", Q + """, b as (select match_id, max(odd) best from fx_quote where odd < 6 group by 1), s as (select match_id, captured_at, quote_id, odd, case when odd > 58e-1 then 'EMITTED' when odd < 2 then 'NO_SELECTION' else 'NO_QUOTE' end status from fx_quote),
f as (select match_id, case when count(*) filter (where status = 'EMITTED') > 0 then arg_min(odd, (captured_at, quote_id)) filter (where status = 'EMITTED') end taken from s group by 1), x as (select (taken - best) / best slip from f join b using (match_id) where taken is not null)
select count(*) n, round(avg(slip), 6) mean_slippage, round(median(slip), 6) median_slippage, round(avg(case when slip >= 0 then 1e0 else 0e0 end), 6) matched_rate from x""")
def a23_execution(spark, sf):
    """What emitted matches paid against the best price there was: a match counts with its first emission."""
    q = fixture(spark, sf, "quote")
    best = q.filter("odd < 6").groupBy("match_id").agg(F.max("odd").alias("best"))
    taken = asof.latest(q, ["match_id"], ["odd"], ["captured_at", "quote_id"], F.col("odd") > 5.8, earliest=True).select("match_id", F.col("odd").alias("taken"))
    x = taken.join(best, "match_id").select(((F.col("taken") - F.col("best")) / F.col("best")).alias("slip"))
    return x.agg(F.count("*").alias("n"), r6(F.avg("slip")).alias("mean_slippage"), r6(F.median("slip")).alias("median_slippage"), r6(F.avg((F.col("slip") >= 0).cast("double"))).alias("matched_rate"))


_DELTAS = "select time_bucket(interval '5' minute, published_at) as start_at, date_diff('second', event_at, published_at) d1, date_diff('second', published_at, ingested_at) d2 from fx_obs"


@query("r08_deltas", O + f", d as ({_DELTAS}) select start_at, count(*) n, count(*) filter (where d2 > 120) breaches, max(d1) most_published, round(quantile_cont(d2, 5e-1), 6) p50, round(quantile_cont(d2, 95e-2), 6) p95 from d group by 1")
def r08_deltas(spark, sf):
    """Steps' times in windows of five minutes: how many, how many late, and their percentiles."""
    obs = fixture(spark, sf, "obs")
    seconds = lambda a, b: F.unix_timestamp(F.col(b).cast("timestamp")) - F.unix_timestamp(F.col(a).cast("timestamp"))
    d = obs.select(F.window(F.col("published_at").cast("timestamp"), "5 minutes").alias("w"), seconds("event_at", "published_at").alias("d1"), seconds("published_at", "ingested_at").alias("d2"))
    p = [r6(F.percentile("d2", F.lit(x))).alias(n) for x, n in ((0.5, "p50"), (0.95, "p95"))]
    out = d.groupBy("w").agg(F.count("*").alias("n"), F.count_if(F.col("d2") > 120).alias("breaches"), F.max("d1").alias("most_published"), *p)
    return out.select(F.col("w.start").cast("timestamp_ntz").alias("start_at"), "n", "breaches", "most_published", "p50", "p95")


def _picks_sql(hours: int) -> str:
    """Picks on the prices that were there so many hours ahead."""
    return f"""(select match_id, sel, odd, odd_open, prob from (select t.*, case when sel = 'over' then p_over else 1 - p_over end prob from
  (select match_id, sel, arg_max(odd, (captured_at, quote_id)) odd, arg_min(odd, (captured_at, quote_id)) odd_open from q where captured_at < kickoff_at - interval '{hours}' hour group by 1, 2) t
  join mk using (match_id)) where odd > 1 and prob - 1 / odd > 2e-2 and prob - 1 / odd <= 15e-2)"""


@query(
    "q10_shadow_funnel",
    with_fixtures("match", "quote")
    + f""", f as (select match_id, max(kickoff_at) ko from fx_quote group by 1), mk as (select match_id, 45e-2 + (match_id % 10) / 1e2 p_over from f),
q as (select *, case when selection = 'home' then 'over' when selection = 'away' then 'under' end sel from fx_quote where book = 'click' and captured_at < kickoff_at and selection <> 'draw'),
c as (select match_id, sel, arg_max(odd, (captured_at, quote_id)) close from q group by 1, 2),
p1 as {_picks_sql(48)}, p2 as {_picks_sql(24)},
e as (select *, 1 run from p1 union all select *, 2 from p2 where not exists (select 1 from p1 where p1.match_id = p2.match_id and p1.sel = p2.sel))
select e.run, e.match_id, e.sel selection, round(odd, 3) odd, round(odd_open, 3) odd_open, round(prob - 1 / odd, 4) edge, round(a.close, 3) close_odd,
 case when z.close is null or a.close is null then null else round(odd * (1 / a.close) / (1 / a.close + 1 / z.close) - 1, 4) end clv
from e left join c a on a.match_id = e.match_id and a.sel = e.sel left join c z on z.match_id = e.match_id and z.sel <> e.sel""",
)
def q10(spark, sf):
    """Picks on one named book's prices, two days ahead and one, and how that book closed on them.

    Both runs write to one ledger: what the first has taken, the second doesn't take again at another price.
    """
    q = fixture(spark, sf, "quote").filter("book = 'click' and captured_at < kickoff_at and selection <> 'draw'").withColumn("selection", F.when(F.col("selection") == "home", "over").otherwise("under"))
    key, order = ["match_id", "selection"], ["captured_at", "quote_id"]
    over = 0.45 + (F.col("match_id") % 10) / 100

    def picks(run: int, hours: int):
        early = F.col("captured_at") < F.col("kickoff_at") - F.expr(f"interval '{hours}' hour")
        now = asof.latest(q, key, ["odd"], order, early).select(*key, "odd")
        first = asof.latest(q, key, ["odd"], order, early, earliest=True).select(*key, F.col("odd").alias("odd_open"))
        p = now.join(first, key).withColumn("prob", F.when(F.col("selection") == "over", over).otherwise(1 - over))
        return p.filter((F.col("odd") > 1) & o.has_edge("prob", "odd")).withColumn("run", F.lit(run))

    taken = new_ledger(spark, "shadow", picks(1, 48), key)
    for run, hours in ((1, 48), (2, 24)):
        taken.append(picks(run, hours))
    close = asof.latest(q, key, ["odd"], order).select(*key, F.col("odd").alias("close_odd"))
    other = close.select("match_id", F.when(F.col("selection") == "over", "under").otherwise("over").alias("selection"), F.col("close_odd").alias("other"))
    x = taken.read().join(close, key, "left").join(other, key, "left")
    fair = (1 / F.col("close_odd")) / (1 / F.col("close_odd") + 1 / F.col("other"))
    return x.select("run", "match_id", "selection", F.round("odd", 3).alias("odd"), F.round("odd_open", 3).alias("odd_open"), F.round(o.edge("prob", "odd"), 4).alias("edge"), F.round("close_odd", 3).alias("close_odd"), F.round(F.col("odd") * fair - 1, 4).alias("clv"))


@query("q21_collection", Q + """, v as (select * from fx_quote where captured_at < kickoff_at and odd > 1 and odd < 1000 and quote_id % 2 = 0), k as (select match_id || '|' || book || '|1x2|' || selection entity, captured_at, odd, quote_id from v)
select entity, count(*) versions, arg_max(odd, (captured_at, quote_id)) odd, max(captured_at) published_at from k group by 1""")
def q21(spark, sf):
    """One collection: payloads to quotes, quotes to versions of entities, and what is known of each in the end."""
    from .feeds import s13

    got = s13(spark, sf).filter("market = '1x2'")
    ids = fixture(spark, sf, "quote").select(F.col("quote_id").alias("event_id"), "match_id")
    rows = got.join(ids, "event_id")
    obs = rows.select(F.concat_ws("|", "match_id", "book", "market", "selection").alias("entity"), F.col("captured_at").alias("published_at"), F.col("event_id").alias("seq"), "odd")
    known = new_ledger(spark, "collection", obs, ["entity", "published_at", "seq"])
    for part in (obs.filter("seq % 3 > 0"), obs):  # a collection that was broken off is run again over everything
        known.append(part)
    return known.read().groupBy("entity").agg(F.count("*").alias("versions"), F.max_by("odd", F.struct("published_at", "seq")).alias("odd"), F.max("published_at").alias("published_at"))


FEATURES = ("stat_A", "stat_N", "stat_R")


@query("q14_feature_screen")
def q14(spark, sf):
    """Each statistic as one more tilt of the goal model: what it adds on the last fifth of the matches, in order.

    A feature is the difference of both teams' means over what they played before, rounded, so that cells are few; all
    features are fitted side by side, each in its own task.
    """
    from .screens import feature_screen

    return feature_screen(spark, sf, FEATURES)


@query("q14_combinations")
def q14_all(spark, sf):
    """All eight subsets of the statistics as tilts of the goal model, each fitted and scored like one."""
    from .screens import combination_screen

    return combination_screen(spark, sf, FEATURES)
