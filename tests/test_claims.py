"""Claims as a stream: a key is free again a minute after its last claim, whatever the batches; rejects by reason."""

import datetime as dt

from pyspark.sql import functions as F

from touchline.streaming import jobs

T0 = dt.datetime(2024, 1, 1, tzinfo=dt.UTC)
ROW = "event_id long, ts timestamp, idempotency_key string, elo_a double, elo_b double"


def test_a_claim_repeats_after_a_minute_also_in_a_later_batch(spark, tmp_path):
    times = {"a": [0, 0, 30, 59, 60, 61, 119, 120, 121], "b": [5, 64, 66, 300]}
    n = 0
    for cut in (range(3), range(3, 6), range(6, 9)):  # a file a batch
        rows = []
        for k, ts in times.items():
            for i in cut:
                if i < len(ts):
                    rows.append((n, T0 + dt.timedelta(seconds=ts[i]), k, 1500.0, 1500.0))
                    n += 1
        spark.createDataFrame(rows, ROW).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(ROW).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    got = jobs.collected(jobs.claims(stream), "claims-test").collect()
    every = spark.read.schema(ROW).parquet(f"{tmp_path}/in").collect()
    at = {r["event_id"]: (r["idempotency_key"], (r["ts"].replace(tzinfo=dt.UTC) if r["ts"].tzinfo is None else r["ts"]) - T0) for r in every}
    seen = sorted((at[r["event_id"]][0], int(at[r["event_id"]][1].total_seconds()) % 86400) for r in got)
    assert [s for k, s in seen if k == "a"] == [0, 60, 120] and [s for k, s in seen if k == "b"] == [5, 66, 300]


def test_requests_are_rejected_with_a_reason(spark):
    good = '{"protocol_version": "touchline/1", "match_id": "m", "job_id": "j", "run_id": "r", "idempotency_key": "k", "elo_a": 1600}'
    cases = [(good, None), (good[:-5], "json"), ("", "json"), (None, "json"), ("[]", "protocol"), ("{}", "protocol"), (good.replace("/1", "/2"), "protocol"), (good.replace('"r"', '""'), "identifiers"), (good.replace('"k"', "null"), "identifiers")]
    df = spark.createDataFrame([(i, p) for i, (p, _) in enumerate(cases)], "event_id long, payload string").withColumn("a.b", F.lit(1)).select("event_id", "payload")
    got = {r["event_id"]: r for r in jobs.decoded(df).collect()}
    assert [got[i]["reason"] for i in range(len(cases))] == [r for _, r in cases]
    assert (got[0]["elo_a"], got[0]["elo_b"]) == (1600.0, 1500.0)
