"""Structured Streaming: the same column builders as in batch, state by key, watermarks for what may come late."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from touchline.operators.lineage import scratch

LATE = "60 days"
EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def event_stream(spark: SparkSession, sf_dir: str, per_trigger: int = 16) -> DataFrame:
    """``events`` as a stream of files, with an event time that watermarks accept."""
    s = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", per_trigger).option("pathGlobFilter", "events*.parquet").parquet(f"{sf_dir}/")
    return s.withColumn("ts", F.col("ts").cast("timestamp"))


def collected(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Runs a stream over what is there now and returns what it put out; a restart goes on from its checkpoint."""
    spark, path = stream.sparkSession, scratch(stream.sparkSession, f"stream-{name}")

    def put(batch: DataFrame, number: int) -> None:
        where = f"{path}/out" if mode == "complete" else f"{path}/out/batch={number}"
        batch.write.mode("overwrite").parquet(where)

    schema = stream.schema
    stream.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(schema).parquet(f"{path}/out").select(*schema.names)


def claimed(stream: DataFrame, keys: list[str]) -> DataFrame:
    """The first row of each key; a key is remembered for as long as rows may be late."""
    return stream.withWatermark("ts", LATE).dropDuplicatesWithinWatermark(keys)


REQUEST = "protocol_version string, match_id string, job_id string, run_id string, idempotency_key string, elo_a double, elo_b double"
PROTOCOL, CLAIM_S = "touchline/1", 60


def decoded(stream: DataFrame, payload: str = "payload") -> DataFrame:
    """``stream`` with the fields of its requests and ``reason``: why a request isn't one, null if it is.

    Rows that fail stay in the stream, so that a side output can take them: bad JSON, another protocol, no identifiers.
    """
    r = stream.withColumn("r", F.from_json(payload, REQUEST, {"mode": "PERMISSIVE"}))
    names = ("match_id", "job_id", "run_id", "idempotency_key")
    given = [F.coalesce(F.col(f"r.{n}"), F.lit("")) != "" for n in names]
    broken = F.col("r").isNull() | F.try_parse_json(payload).isNull()
    reason = F.when(broken, "json").when(F.coalesce(F.col("r.protocol_version") != PROTOCOL, F.lit(True)), "protocol").when(~(given[0] & given[1] & given[2] & given[3]), "identifiers")
    return r.select(*stream.columns, *[F.col(f"r.{n}").alias(n) for n in names], F.coalesce("r.elo_a", F.lit(1500.0)).alias("elo_a"), F.coalesce("r.elo_b", F.lit(1500.0)).alias("elo_b"), reason.alias("reason"))


def _granted(key, batches, state: GroupState):
    """Requests of a key in order of time: one is granted if none was in the ``CLAIM_S`` seconds before it."""
    if state.hasTimedOut:
        state.remove()
        return
    last = state.get[0] if state.exists else None
    rows = pd.concat(list(batches)).sort_values(["ts", "event_id"], kind="stable")
    at = (rows["ts"].astype("int64") if rows["ts"].dtype == "datetime64[us]" else rows["ts"].map(lambda t: int(t.timestamp() * 1_000_000))).tolist()
    keep = []
    for t in at:
        keep.append(last is None or t >= last + CLAIM_S * 1_000_000)
        last = t if keep[-1] else last
    state.update((last,))
    state.setTimeoutTimestamp(max(last // 1000 + CLAIM_S * 1000, state.getCurrentWatermarkMs() + 1))
    yield rows[keep][["event_id", "idempotency_key", "elo_a", "elo_b"]]


def claims(requests: DataFrame) -> DataFrame:
    """Requests (event_id, ts, idempotency_key, elo_a, elo_b) that nobody has claimed in the last minute of event time.

    What a key remembers is its last claim, and that goes once the watermark has passed its end.
    """
    s = requests.withWatermark("ts", LATE).groupBy("idempotency_key")
    return s.applyInPandasWithState(_granted, "event_id long, idempotency_key string, elo_a double, elo_b double", "last long", "append", GroupStateTimeout.EventTimeTimeout)


def latest(stream: DataFrame) -> DataFrame:
    """The newest value of each user."""
    return stream.groupBy("user_id").agg(F.max_by("value", F.struct("ts", "event_id")).alias("value"), F.max("ts").alias("ts"))


def bars(stream: DataFrame, width: str) -> DataFrame:
    """Counts and extremes in tumbling windows."""
    b = stream.withWatermark("ts", LATE).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"))
    return b.select(F.col("window.start").alias("start"), "event_type", "n", "low", "high")


def sessions(stream: DataFrame, gap: str) -> DataFrame:
    """Sessions of a user: rows less than ``gap`` apart."""
    s = stream.withWatermark("ts", LATE).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
    return s.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def latency(stream: DataFrame, limit: float) -> DataFrame:
    return stream.groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(F.col("value") > limit).alias("breaches"), F.max("value").alias("most"))


SKETCH_K = 1600


def rank_error(k: int = SKETCH_K) -> float:
    """How far the rank of a percentile of a sketch may be off, as a share of the rows, with 99 % confidence."""
    return 2.296 / k**0.9021


def percentiles(stream: DataFrame, width: str, value: str, limit: float, k: int = SKETCH_K) -> DataFrame:
    """Counts, breaches of a limit and a quantile sketch of each window and kind.

    State holds a sketch of bounded size for each of them, whatever their rows; sketches merge, so rows are summed up before
    the shuffle and across batches. Up to ``k`` rows nothing is rounded; beyond, see ``rank_error``.
    """
    s = stream.withWatermark("ts", LATE).groupBy(F.window("ts", width), "event_type")
    b = s.agg(F.count(value).alias("n"), F.count_if(F.col(value) > limit).alias("breaches"), F.kll_sketch_agg_double(F.col(value).cast("double"), F.lit(k)).alias("sketch"))
    return b.select(F.col("window.start").alias("start"), "event_type", "n", "breaches", "sketch")


def value_counts(stream: DataFrame, width: str, value: str) -> DataFrame:
    """How often each value stands in each window and kind, nulls too: what exact percentiles need of a stream."""
    b = stream.groupBy(F.window("ts", width), "event_type", F.col(value).cast("double").alias("value")).agg(F.count("*").alias("n"))
    return b.select(F.col("window.start").alias("start"), "event_type", "value", "n")


def quantiles(sketches: DataFrame, **ranks: float) -> DataFrame:
    """``sketches`` with a column for each named rank; null where a window has no values."""
    at = {n: F.when(F.col("n") > 0, F.kll_sketch_get_quantile_double("sketch", F.lit(r))) for n, r in ranks.items()}
    return sketches.withColumns(at).drop("sketch")


def fresh(fair: DataFrame, market: DataFrame, age: str) -> DataFrame:
    """Pairs of a user whose market row is at most ``age`` older than the fair one; older rows leave the state."""
    f, m = fair.withWatermark("fair_ts", LATE), market.withWatermark("ts", LATE)
    return f.join(m, F.expr(f"u = user_id and ts >= fair_ts - interval {age} and ts <= fair_ts")).select("fair_id", "market_id")


WAIT_MS, DEADLINE_MS, BUCKETS = 6 * 3600 * 1000, 55 * 60_000, 1024
#: What is known of a match: which sides have come, whether it has been told, and when it is due.
MATCH = np.dtype([("match_id", "<i8"), ("home", "?"), ("away", "?"), ("told", "?"), ("due", "<i8")])


def _by_bucket(stream: DataFrame, late: str, step, schema: str, buckets: int) -> DataFrame:
    """``step`` over matches by buckets of their ids: a call into Python and a row of state for many matches, not for each.

    The state of a bucket is its matches (``MATCH``) as one array of bytes, and its timeout is the first time at which one
    of them is due; ``step`` keeps each match by its own time. Matches without an id are one match, in a bucket of their own.
    """
    bucket = F.when(F.col("match_id").isNull(), -1).otherwise(F.pmod(F.xxhash64("match_id"), F.lit(buckets)))
    home, no = F.col("is_home"), F.lit(False)
    s = stream.withWatermark("ts", late).select("ts", bucket.cast("long").alias("bucket"), F.coalesce("match_id", F.lit(0)).cast("long").alias("match_id"), F.coalesce(home, no).alias("home"), F.coalesce(~home, no).alias("away"), F.coalesce(F.unix_millis("ts"), F.lit(0)).cast("long").alias("ms"))
    return s.groupBy("bucket").applyInPandasWithState(step, schema, "matches binary", "append", GroupStateTimeout.EventTimeTimeout)


def _merged(batches, state: GroupState, wait: int) -> tuple[np.ndarray, np.ndarray]:
    """All matches of a bucket, each once, and which of them have new rows. Arrays only: data frames took 30 ms a call."""
    parts = [np.frombuffer(bytes(state.get[0]), MATCH)] if state.exists else []
    known = len(parts[0]) if parts else 0
    for b in () if state.hasTimedOut else batches:
        x = np.zeros(len(b), MATCH)
        x["match_id"], x["home"], x["away"], x["due"] = b["match_id"], b["home"], b["away"], b["ms"] + wait
        parts.append(x)
    rows = np.concatenate(parts) if parts else np.zeros(0, MATCH)
    if not len(rows):
        return rows, np.zeros(0, bool)
    order = np.argsort(rows["match_id"], kind="stable")
    rows, new = rows[order], order >= known
    first = np.flatnonzero(np.r_[True, rows["match_id"][1:] != rows["match_id"][:-1]])
    out = rows[first]
    for c in ("home", "away", "told"):
        out[c] = np.logical_or.reduceat(rows[c], first)
    out["due"] = np.maximum.reduceat(rows["due"], first)
    return out, np.logical_or.reduceat(new, first)


def _kept(left: np.ndarray, state: GroupState) -> None:
    """Remembers the matches of ``left``; none are due before the watermark."""
    if not len(left):
        if state.exists:
            state.remove()
        return
    state.update((left.tobytes(),))
    state.setTimeoutTimestamp(max(int(left["due"].min()), state.getCurrentWatermarkMs(), 1))


def _ids(key, rows: np.ndarray):
    return rows["match_id"] if key[0] >= 0 else pd.array([None] * len(rows), "Int64")


def _both(key, batches, state: GroupState):
    """A row once both sides of a match have been seen; a side is forgotten when the other hasn't come in time."""
    rows, new = _merged(batches, state, WAIT_MS)
    got = rows[new & rows["home"] & rows["away"] & ~rows["told"]]
    rows["told"] |= new & rows["home"] & rows["away"]
    now = state.getCurrentWatermarkMs()
    rows["due"][new] = np.maximum(rows["due"][new], now)
    _kept(rows[rows["due"] >= now], state)
    if len(got):
        yield pd.DataFrame({"match_id": _ids(key, got)})


def assembled(stream: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """Matches both of whose sides (is_home) have arrived, each once; what is known of one goes ``WAIT_MS`` after its last row."""
    return _by_bucket(stream, LATE, _both, "match_id long", buckets)


def _deadline(key, batches, state: GroupState):
    """A widening signal for a match whose other side hasn't come 55 minutes after its last row."""
    rows, new = _merged(batches, state, DEADLINE_MS)
    now = state.getCurrentWatermarkMs()
    late = rows[~new & (rows["due"] < now)]
    rows["due"][new] = np.maximum(rows["due"][new], now)
    _kept(rows[(rows["due"] >= now) & ~(new & rows["home"] & rows["away"])], state)
    if len(late):
        yield pd.DataFrame({"match_id": _ids(key, late), "missing": np.where(late["home"], "away", "home").astype(object), "factor": 1.35})


def watched(stream: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    return _by_bucket(stream, "0 seconds", _deadline, "match_id long, missing string, factor double", buckets)
