"""Matches, quotes, statistics, observations and bets as projections of the star-schema tables.

The projections are plain SQL, so that Spark and an independent SQL engine read the same rows: only the spelling of a
timestamp literal differs (``{ts}``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from touchline.operators.lineage import tasks_for

TEXT = {
    "match": """select o_orderkey event_id, cast(o_orderdate as date) match_date,
  concat('T', cast(o_custkey % 20 as varchar(10))) home,
  concat('T', cast((o_custkey % 20 + 1 + o_orderkey % 19) % 20 as varchar(10))) away,
  case when o_orderstatus='O' then null else cast((o_orderkey*7+o_custkey) % 5 as int) end home_score,
  case when o_orderstatus='O' then null else cast((o_orderkey*3+o_custkey*11) % 4 as int) end away_score,
  o_orderpriority tournament, case when o_orderstatus='P' then 1 else 0 end is_neutral,
  year(o_orderdate) season from {orders}""",
    "quote": """select event_id quote_id, user_id % 40 match_id, event_type book,
  case event_id % 3 when 0 then 'home' when 1 then 'draw' else 'away' end selection,
  ts captured_at, 1.2e0 + (cast(round(value*100) as bigint) % 500)/1e2 odd,
  {ts} + (user_id % 10) * interval '1' day kickoff_at from {events}""",
    "stat": """select l_orderkey event_id, case when l_linenumber % 2 = 0 then 'home' else 'away' end team,
  case when l_linestatus='O' then 'ALL' else '1ST' end period,
  concat('stat_', l_returnflag) stat_name, round(avg(l_quantity), 6) value from {lineitem} group by 1,2,3,4""",
    "obs": """select event_type entity_type, user_id entity_id, concat('s', cast(event_id % 3 as varchar(5))) source,
  ts event_at, ts + (event_id % 7) * interval '1' hour published_at,
  ts + (event_id % 7) * interval '1' hour + (event_id % 5) * interval '1' minute ingested_at,
  props payload, event_id seq from {events}""",
    "bet": """select l_orderkey game_id, l_linenumber line_no,
  case l_linenumber % 3 when 0 then '1x2' when 1 then 'ou25' else 'btts' end market,
  case when l_returnflag='A' then 'open' else 'close' end bet_at,
  1.2e0 + (l_partkey % 400)/1e2 odd, 5e-2 + (l_suppkey % 90)/1e2 model_prob,
  case when (l_orderkey + l_linenumber*3) % 2 = 0 then 1 else 0 end won,
  cast(l_shipdate as date) bet_date from {lineitem}""",
    # prices of another source: some matches, some days off, every second one with home and away exchanged
    "price": """select o_orderkey price_id, date_add(cast(o_orderdate as date), cast(o_orderkey % 9 - 4 as int)) price_date,
  concat('T', cast(case when o_orderkey % 2 = 0 then o_custkey % 20 else (o_custkey % 20 + 1 + o_orderkey % 19) % 20 end as varchar(10))) home,
  concat('T', cast(case when o_orderkey % 2 = 1 then o_custkey % 20 else (o_custkey % 20 + 1 + o_orderkey % 19) % 20 end as varchar(10))) away,
  1.5e0 + (o_orderkey*7 % 300)/1e2 odd_home, 2.8e0 + (o_orderkey % 120)/1e2 odd_draw, 1.5e0 + (o_orderkey*11 % 300)/1e2 odd_away,
  case when o_orderkey % 5 = 0 then null else 1.6e0 + (o_orderkey % 90)/1e2 end odd_over, 1.6e0 + (o_orderkey*3 % 90)/1e2 odd_under
  from {orders} where o_orderkey % 3 = 0""",
}
_TABLES = ("orders", "events", "lineitem")


def fixture(spark: SparkSession, sf_dir: str, name: str, dealt: dict[str, str] | None = None) -> DataFrame:
    """The projection ``name`` of the tables under ``sf_dir``; tables named in ``dealt`` are dealt by that column over as many
    tasks as their size asks for, and groups that hold the column stay where they are."""
    text = TEXT[name].replace("{ts}", "timestamp_ntz '2024-01-15 00:00:00'")
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in _TABLES if "{%s}" % t in text}
    for t, c in (dealt or {}).items():
        used[t] = used[t].repartition(tasks_for(spark, f"{sf_dir}/{t}.parquet"), c)
    return spark.sql(text, **used)


def with_fixtures(*names: str) -> str:
    """``with fx_<name> as (...), ...`` for the SQL that checks a query."""
    def text(n: str) -> str:
        t = TEXT[n].replace("{ts}", "timestamp '2024-01-15 00:00:00'").replace("date_add(cast(o_orderdate as date), cast(o_orderkey % 9 - 4 as int))", "cast(cast(o_orderdate as date) + cast(o_orderkey % 9 - 4 as int) as date)")
        for x in _TABLES:
            t = t.replace("{%s}" % x, x)
        return t

    return "with recursive " + ", ".join(f"fx_{n} as ({text(n)})" for n in names)
