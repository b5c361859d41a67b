"""Parsers of JSON and HTML feeds: explicit schemas, exploded arrays, and nulls for what doesn't parse."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.functions.odds import fraction_odd, is_price

EVENT = "struct<id:long,status:struct<type:string>,startTimestamp:long,homeTeam:struct<name:string>,awayTeam:struct<name:string>,homeScore:struct<current:int,period1:int>,awayScore:struct<current:int,period1:int>>"
ODDS = "struct<markets:array<struct<marketId:int,marketName:string,choiceGroup:string,choices:array<struct<name:string,fractionalValue:string,initialFractionalValue:string>>>>>"
STATISTICS = "struct<statistics:array<struct<period:string,groups:array<struct<statisticsItems:array<struct<name:string,home:string,away:string>>>>>>>"
BOOKS = "struct<bookmakers:array<struct<key:string,markets:array<struct<key:string,last_update:string,outcomes:array<struct<name:string,price:double,point:double>>>>>>>"
LINEUP = "struct<home:struct<players:array<struct<player:struct<name:string>,substitute:boolean,statistics:struct<rating:double,minutesPlayed:int>>>>,away:struct<players:array<struct<player:struct<name:string>,substitute:boolean,statistics:struct<rating:double,minutesPlayed:int>>>>>"
#: Markets of the odds feed by their number.
MARKETS = {1: "1x2", 2: "double chance", 4: "draw no bet", 5: "both score", 9: "over/under", 17: "asian handicap", 20: "cards", 21: "corners"}
#: What the feed calls the sides.
SIDES = {"1": "home", "X": "draw", "2": "away"}


def events(raw: DataFrame, payload: str = "payload") -> DataFrame:
    """One row an event; scores only once it is finished."""
    e = raw.select("*", F.from_json(payload, EVENT).alias("_e"))
    done = F.col("_e.status.type") == "finished"
    score = lambda side, what: F.when(done, F.col(f"_e.{side}Score.{what}"))
    return e.select(F.col("_e.id").alias("event_id"), F.col("_e.status.type").alias("status"), F.to_date(F.timestamp_seconds("_e.startTimestamp")).alias("date"), F.col("_e.homeTeam.name").alias("home"), F.col("_e.awayTeam.name").alias("away"), score("home", "current").alias("home_score"), score("away", "current").alias("away_score"), score("home", "period1").alias("home_ht"), score("away", "period1").alias("away_ht"))


def _number(text: Column) -> Column:
    return F.regexp_replace(F.trim(text), r"\s*(%|km|m)$", "").try_cast("double")


def statistics(raw: DataFrame, key: str = "event_id", payload: str = "payload") -> DataFrame:
    """(key, team, period, stat_name, value): periods, groups and items exploded, both sides stacked; no number, no row."""
    s = raw.select(key, F.explode(F.from_json(payload, STATISTICS)["statistics"]).alias("s"))
    s = s.select(key, "s.period", F.explode("s.groups").alias("g")).select(key, "period", F.explode("g.statisticsItems").alias("i"))
    sides = F.explode(F.array(*[F.struct(F.lit(t).alias("team"), _number(F.col(f"i.{t}")).alias("value")) for t in ("home", "away")]))
    return s.select(key, "period", F.lower("i.name").alias("stat_name"), sides.alias("x")).select(key, "x.team", "period", "stat_name", "x.value").filter("value is not null")


def first_statistic(raw: DataFrame, needle: str, key: str = "event_id", payload: str = "payload") -> DataFrame:
    """(key, home_value, away_value) of the first item of the whole match whose name contains ``needle``, without exploding.

    Payloads that are no JSON, have no such period or no such item have no row; a side that is no number is null.
    """
    periods = F.filter(F.from_json(payload, STATISTICS)["statistics"], lambda p: p["period"] == "ALL")
    items = F.flatten(F.transform(periods, lambda p: F.flatten(F.transform(p["groups"], lambda g: g["statisticsItems"]))))
    hit = F.try_element_at(F.filter(items, lambda i: F.lower(i["name"]).contains(needle)), F.lit(1))
    found = raw.select(key, hit.alias("_hit")).filter("_hit is not null")
    return found.select(key, *[_number(F.col(f"_hit.{t}")).alias(f"{t}_value") for t in ("home", "away")])


PARTICIPANTS = "struct<participants:array<struct<name:string,meta:struct<location:string>>>,scores:array<struct<participant:string,goals:int>>>"


def participants(raw: DataFrame, key: str = "event_id", payload: str = "payload") -> DataFrame:
    """(key, home, away, home_score, away_score): sides are found by the location that each participant's meta data name."""
    d = raw.select(key, F.from_json(payload, PARTICIPANTS).alias("_p"))
    name = lambda side: F.try_element_at(F.filter("_p.participants", lambda x: x["meta"]["location"] == side), F.lit(1))["name"]
    goals = lambda side: F.try_element_at(F.filter("_p.scores", lambda x: x["participant"] == side), F.lit(1))["goals"]
    return d.select(key, name("home").alias("home"), name("away").alias("away"), goals("home").alias("home_score"), goals("away").alias("away_score"))


#: A handicap as '(-0.75) Team'.
_HANDICAP = r"\(\s*([+-]?\d+(?:\.\d+)?)\s*\)\s*(.+)"


def odds(raw: DataFrame, key: str = "event_id", payload: str = "payload", home: str | None = None, away: str | None = None) -> DataFrame:
    """(key, market, line, selection, odd, odd_open) of the known markets; open odds stay null where they aren't known.

    Sides of a handicap are found by their names, which ``home`` and ``away`` name columns of; both take the home side's
    line, and without a home side there is no market.
    """
    names = F.create_map(*[F.lit(x) for k, v in MARKETS.items() for x in (k, v)])
    sides = F.create_map(*[F.lit(x) for k, v in SIDES.items() for x in (k, v)])
    more = [F.lower(F.trim(c)) if c else F.lit(None).cast("string") for c in (home, away)]
    m = raw.select(key, *[c.alias(n) for c, n in zip(more, ("_home", "_away"), strict=True)], F.explode(F.from_json(payload, ODDS)["markets"]).alias("m"))
    m = m.withColumn("market", F.try_element_at(names, F.col("m.marketId"))).filter("market is not null")
    team = lambda c: F.lower(F.trim(F.regexp_extract(c["name"], _HANDICAP, 2)))
    own = F.try_element_at(F.filter("m.choices", lambda c: team(c) == F.col("_home")), F.lit(1))["name"]
    m = m.withColumn("_line", F.when(F.col("market") == "asian handicap", F.nullif(F.regexp_extract(own, _HANDICAP, 1), F.lit("")).try_cast("double")).otherwise(F.col("m.choiceGroup").try_cast("double")))
    c = m.select(key, "market", "_line", "_home", "_away", F.explode("m.choices").alias("c"))
    who = F.when(team(F.col("c")) == F.col("_home"), "home").when(team(F.col("c")) == F.col("_away"), "away")
    plain = F.coalesce(F.try_element_at(sides, F.col("c.name")), F.lower(F.trim("c.name")))
    c = c.withColumn("selection", F.when(F.col("market") == "asian handicap", who).otherwise(plain))
    lined = F.col("market").isin("asian handicap", "over/under", "cards", "corners")
    c = c.filter(F.col("selection").isNotNull() & (~lined | F.col("_line").isNotNull()))
    return c.select(key, "market", F.col("_line").alias("line"), "selection", fraction_odd("c.fractionalValue").alias("odd"), fraction_odd("c.initialFractionalValue").alias("odd_open"))


def total_at(raw: DataFrame, line: float, key: str = "event_id", payload: str = "payload") -> DataFrame:
    """(key, over, under) of the first market of goals that has both at ``line``, compared as a number.

    The line stands at the end of a choice's name or else is the market's group.
    """
    markets = F.from_json(payload, ODDS)["markets"]
    named = F.filter(markets, lambda m: F.lower(m["marketName"]).rlike("total|over/under|goals"))

    def of(m: Column, side: str) -> Column:
        at = lambda c: F.coalesce(F.nullif(F.regexp_extract(c["name"], r"(\d+(?:\.\d+)?)\s*$", 1), F.lit("")), m["choiceGroup"]).try_cast("double")
        return F.try_element_at(F.filter(m["choices"], lambda c: (at(c) == line) & F.lower(c["name"]).contains(side)), F.lit(-1))["fractionalValue"]

    both = F.transform(named, lambda m: F.struct(fraction_odd(of(m, "over")).alias("over"), fraction_odd(of(m, "under")).alias("under")))
    first = F.try_element_at(F.filter(both, lambda x: x["over"].isNotNull() & x["under"].isNotNull()), F.lit(1))
    return raw.select(key, first.alias("x")).select(key, "x.over", "x.under")


def books(raw: DataFrame, key: str = "event_id", payload: str = "payload", kickoff: str = "kickoff_at") -> DataFrame:
    """(key, book, market, selection, odd, captured_at): valid prices captured before kick-off, totals with their line."""
    b = raw.select(key, kickoff, F.explode(F.from_json(payload, BOOKS)["bookmakers"]).alias("b"))
    m = b.select(key, kickoff, F.col("b.key").alias("book"), F.explode("b.markets").alias("m"))
    o = m.select(key, kickoff, "book", F.col("m.key").alias("kind"), F.try_to_timestamp("m.last_update").alias("captured_at"), F.explode("m.outcomes").alias("o"))
    market = F.when((F.col("kind") == "totals") & F.col("o.point").isNotNull(), F.concat(F.lit("ou"), F.format_string("%.1f", F.col("o.point")))).when(F.col("kind") == "h2h", "1x2")
    o = o.filter(is_price("o.price") & (F.col("captured_at") < F.col(kickoff).cast("timestamp")))
    return o.select(key, "book", market.alias("market"), F.lower("o.name").alias("selection"), F.col("o.price").alias("odd"), "captured_at").filter("market is not null")


FIRST_HALF = "struct<id:string,commence_time:string,home_team:string,away_team:string,bookmakers:array<struct<key:string,last_update:string,markets:array<struct<key:string,last_update:string,outcomes:array<struct<name:string,price:double,point:double>>>>>>>"


def first_half(raw: DataFrame, payload: str = "payload") -> DataFrame:
    """(event_id, book, market, selection, line, odd, captured_at, payload_hash) of first-half totals and results."""
    e = raw.select(F.from_json(payload, FIRST_HALF).alias("e"), F.sha2(F.col(payload), 256).alias("payload_hash"))
    m = e.select("e", "payload_hash", F.explode("e.bookmakers").alias("b")).select("e", "payload_hash", "b", F.explode("b.markets").alias("m"))
    captured = F.coalesce(F.try_to_timestamp("m.last_update"), F.try_to_timestamp("b.last_update"))
    o = m.select("e", "payload_hash", "b.key", "m.key", captured.alias("captured_at"), F.try_to_timestamp("e.commence_time").alias("_start"), F.explode("m.outcomes").alias("o")).toDF("e", "payload_hash", "book", "kind", "captured_at", "_start", "o")
    totals, sides = F.col("kind") == "totals_h1", F.col("kind") == "h2h_3_way_h1"
    market = F.when(totals, F.concat(F.lit("ou"), F.regexp_replace(F.col("o.point").cast("string"), r"\.0$", ""), F.lit("_1h"))).when(sides, "1x2_1h")
    name = F.col("o.name")
    pick = F.when(totals & name.isin("Over", "Under"), F.lower(name)).when(sides, F.when(name == F.col("e.home_team"), "home").when(name == "Draw", "draw").when(name == F.col("e.away_team"), "away"))
    o = o.select(F.col("e.id").alias("event_id"), "book", market.alias("market"), pick.alias("selection"), F.col("o.point").alias("line"), F.col("o.price").alias("odd"), "captured_at", "payload_hash", "_start")
    return o.filter(F.col("market").isNotNull() & F.col("selection").isNotNull() & is_price("odd", float("inf")) & (F.col("captured_at") < F.col("_start"))).drop("_start")


SCHEDULE = "struct<fixture:struct<id:long,date:string,status:struct<short:string>>,teams:struct<home:struct<name:string>,away:struct<name:string>>,goals:struct<home:int,away:int>>"
TEAM_SHEET = "struct<team:struct<id:long,name:string>,coach:struct<id:long,name:string>,formation:string,startXI:array<struct<player:struct<id:long,name:string,pos:string>>>,substitutes:array<struct<player:struct<id:long,name:string,pos:string>>>>"


def schedule(raw: DataFrame, payload: str = "payload") -> DataFrame:
    """(event_id, scheduled_at, home, away, home_goals, away_goals, status); rows without a zone, an id or names drop out."""
    f = raw.select(F.from_json(payload, SCHEDULE).alias("f"))
    zoned = F.col("f.fixture.date").rlike(r"(?:Z|[+-]\d{2}:?\d{2})$")
    at = F.when(zoned, F.try_to_timestamp("f.fixture.date"))
    out = f.select(F.col("f.fixture.id").alias("event_id"), at.alias("scheduled_at"), F.col("f.teams.home.name").alias("home"), F.col("f.teams.away.name").alias("away"), F.col("f.goals.home").alias("home_goals"), F.col("f.goals.away").alias("away_goals"), F.col("f.fixture.status.short").alias("status"))
    return out.filter("event_id is not null and scheduled_at is not null and home <> '' and away <> ''")


def team_sheets(raw: DataFrame, key: str = "event_id", payload: str = "payload") -> DataFrame:
    """(key, team_id, player_id, player, role, position, formation, payload_hash): starters and substitutes, a row each."""
    t = raw.select(key, F.from_json(payload, TEAM_SHEET).alias("t"), F.sha2(F.col(payload), 256).alias("payload_hash"))
    side = lambda role, c: t.select(key, "t", "payload_hash", F.lit(role).alias("role"), F.explode(f"t.{c}").alias("p"))
    rows = side("starter", "startXI").union(side("substitute", "substitutes"))
    out = rows.select(key, F.col("t.team.id").alias("team_id"), F.col("p.player.id").alias("player_id"), F.col("p.player.name").alias("player"), "role", F.col("p.player.pos").alias("position"), F.col("t.formation").alias("formation"), "payload_hash")
    return out.filter("team_id is not null and player_id is not null and player <> ''")


def results_file(spark: SparkSession, path: str, fallback: str) -> DataFrame:
    """Results as CSV from ``path``, or from ``fallback`` where that can't be read, with their kinds made right.

    Rows without a date or a team drop out; of rows of one match the last in the file stays. A folder's files are one file in
    the order of their names, so that many tasks can write and read it.
    """
    text = spark.read.option("header", True).schema("date string, home_team string, away_team string, home_score string, away_score string, tournament string, neutral string")
    try:
        df = text.csv(path)
    except AnalysisException:
        df = text.csv(fallback)
    # a task reads blocks of several files in any order, and the rows of a block from first to last
    df = df.withColumn("_at", F.struct("_metadata.file_name", "_metadata.file_block_start", F.monotonically_increasing_id()))
    score = lambda c: F.col(c).try_cast("double").try_cast("int").alias(c)
    neutral = F.upper(F.trim("neutral")).isin("TRUE", "1").cast("int")
    df = df.select(F.expr("try_to_date(date, 'yyyy-MM-dd')").alias("date"), F.nullif(F.trim("home_team"), F.lit("")).alias("home_team"), F.nullif(F.trim("away_team"), F.lit("")).alias("away_team"), score("home_score"), score("away_score"), "tournament", F.coalesce(neutral, F.lit(0)).alias("neutral"), "_at")
    df = df.dropna(subset=["date", "home_team", "away_team"])
    rest = ["home_score", "away_score", "tournament", "neutral"]
    last = F.max(F.struct("_at", *rest)).alias("r")
    return df.groupBy("date", "home_team", "away_team").agg(last).select("date", "home_team", "away_team", *[f"r.{c}" for c in rest])


def lineup(raw: DataFrame, key: str = "event_id", payload: str = "payload") -> DataFrame:
    """(key, team, player, starter, rating, minutes) of players that have a rating."""
    d = raw.select(key, F.from_json(payload, LINEUP).alias("l"))
    side = lambda t: d.select(key, F.lit(t).alias("team"), F.explode(f"l.{t}.players").alias("p"))
    rows = side("home").unionByName(side("away"))
    return rows.select(key, "team", F.col("p.player.name").alias("player"), (~F.coalesce("p.substitute", F.lit(False))).alias("starter"), F.col("p.statistics.rating").alias("rating"), F.col("p.statistics.minutesPlayed").alias("minutes")).filter("rating is not null")


def json_lines(raw: DataFrame, schema: str, text: str = "value", strict: bool = False) -> DataFrame:
    """Parsed lines. Tolerant reading leaves bad lines out; strict reading fails on the first."""
    mode = {"mode": "FAILFAST"} if strict else {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}
    parsed = raw.select(F.from_json(text, schema if strict else f"{schema}, _bad string", mode).alias("r"))
    return parsed.select("r.*") if strict else parsed.filter("r is not null and r._bad is null").select("r.*").drop("_bad")


def table_rows(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, row_no, cells) of simple tables, also those hidden in comments; repeated header rows are left out."""
    t = F.regexp_replace(F.coalesce(html, F.lit("")), "<!--|-->", "")
    rows = pages.select(key, F.posexplode(F.regexp_extract_all(t, F.lit(r"(?is)<tr\b[^>]*>(.*?)</tr>"), F.lit(1))).alias("row_no", "r"))
    cells = F.transform(F.regexp_extract_all("r", F.lit(r"(?is)<td\b[^>]*>(.*?)</td>"), F.lit(1)), lambda c: F.trim(F.regexp_replace(c, r"<[^>]*>", "")))
    return rows.select(key, "row_no", cells.alias("cells")).filter("size(cells) > 0")


def plain_number(text) -> Column:
    """'12,345' as 12345; null where it is no number."""
    return F.regexp_replace(F.trim(text), ",", "").try_cast("double")


def table_records(pages: DataFrame, names: dict[str, list[str]], key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, row_no, record) of table rows, also those in comments: a map from the column's name to the cell's text.

    ``names`` has for each column what its header may be, in lower case without punctuation. Rows of headers, wherever they
    stand, are left out; a row is read by the first header of its page.
    """
    t = F.regexp_replace(F.coalesce(html, F.lit("")), "<!--|-->", "")
    text = lambda c: F.trim(F.regexp_replace(c, r"<[^>]*>", ""))
    cells = lambda kind, row: F.transform(F.regexp_extract_all(row, F.lit(rf"(?is)<{kind}\b[^>]*>(.*?)</{kind}>"), F.lit(1)), text)
    alias = F.create_map(*[F.lit(x) for name, heads in names.items() for h in heads for x in (h, name)])
    head = F.transform(cells("th", t), lambda h: F.try_element_at(alias, F.regexp_replace(F.lower(h), r"[^a-z0-9 ]", "")))
    rows = pages.select(key, head.alias("_head"), F.posexplode(F.regexp_extract_all(t, F.lit(r"(?is)<tr\b[^>]*>(.*?)</tr>"), F.lit(1))).alias("row_no", "_row"))
    rows = rows.select(key, "row_no", "_head", cells("td", F.col("_row")).alias("_cells")).filter("size(_cells) > 0")
    pairs = F.filter(F.arrays_zip(F.slice("_head", 1, F.size("_cells")), "_cells"), lambda x: x["0"].isNotNull())
    return rows.select(key, "row_no", F.map_from_entries(pairs).alias("record"))


def links(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, n_links, n_paragraphs) of each page."""
    h = F.coalesce(html, F.lit(""))
    return pages.select(key, F.regexp_count(h, F.lit(r"<a ")).cast("long").alias("n_links"), F.regexp_count(h, F.lit(r"<p[ >]")).cast("long").alias("n_paragraphs"))
