"""Percentiles from sketches in a stream's state: within their bound of the exact ranks, over batches and nulls."""

import datetime as dt

import numpy as np
import pytest

from touchline.streaming import jobs

ROW = "event_id long, ts timestamp, event_type string, value double"


@pytest.mark.parametrize(("n", "k"), [(60_000, 200), (900, 1600)])
def test_percentiles_are_within_their_bound(spark, tmp_path, n, k):
    rng = np.random.default_rng(n)
    value, kind = rng.lognormal(3, 1, n), rng.integers(0, 2, n)
    t0 = dt.datetime(2024, 1, 1)
    for part in range(3):  # a file a batch
        rows = [(i, t0 + dt.timedelta(seconds=i % 80_000), f"k{kind[i]}", None if i % 97 == 0 else float(value[i])) for i in range(part, n, 3)]
        spark.createDataFrame(rows, ROW).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    spark.createDataFrame([(n, t0 + dt.timedelta(days=1, hours=1), "none", None)], ROW).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(ROW).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    got = jobs.quantiles(jobs.collected(jobs.percentiles(stream, "1 day", "value", 50.0, k), "percentile-test", "complete"), p50=0.5, p95=0.95).collect()
    by = {r["event_type"]: r for r in got}
    assert by.keys() == {"k0", "k1", "none"} and (by["none"]["n"], by["none"]["p50"]) == (0, None)
    for j in (0, 1):
        x = np.sort([value[i] for i in range(n) if kind[i] == j and i % 97])
        r = by[f"k{j}"]
        assert (r["n"], r["breaches"]) == (len(x), (x > 50).sum())
        for name, rank in (("p50", 0.5), ("p95", 0.95)):
            if len(x) <= k:
                assert r[name] == x[int(np.ceil(rank * len(x))) - 1]
            else:
                assert abs(np.searchsorted(x, r[name]) / len(x) - rank) <= 1.5 * jobs.rank_error(k)
