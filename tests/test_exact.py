"""Percentiles of days with more rows than a sketch holds."""

import duckdb
import numpy as np

from touchline.plans.registry import ORACLE_SQL, QUERIES


def test_percentiles_of_large_days_are_those_of_sql(spark, tmp_path):
    n, rng = 12_000, np.random.default_rng(3)
    con = duckdb.connect()
    con.register("v", __import__("pandas").DataFrame({"i": np.arange(n), "value": rng.lognormal(5, 1, n), "kind": rng.integers(0, 2, n)}))
    con.execute(f"""copy (select i event_id, timestamp '2024-01-01' + i * interval 10 second ts, i % 7 user_id, 'k' || kind event_type, case when i % 97 > 0 then value end as value, '' props from v
      union all select {n}, timestamp '2024-03-01', 1, 'none', null, '') to '{tmp_path}/events.parquet' (format parquet)""")
    con.execute(f"create view events as select * from '{tmp_path}/events.parquet'")
    cols = ["start", "event_type", "n", "breaches", "p50", "p95", "p99"]
    got = sorted((tuple(r[c] for c in cols) for r in QUERIES["r08_percentiles"](spark, str(tmp_path)).collect()), key=repr)
    want = sorted((tuple(r) for r in con.execute(f"select {', '.join(cols)} from ({ORACLE_SQL['r08_percentiles']})").fetchall()), key=repr)
    assert got == want and max(r[2] for r in got) > 1600
