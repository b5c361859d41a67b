"""Matches followed by buckets of their ids: thousands of them in little time, each by its own clock, over several batches."""

import datetime as dt
import time

import pandas as pd

from touchline.streaming import jobs

ROW, T0 = "match_id long, is_home boolean, ts timestamp", dt.datetime(2024, 1, 1)


def source(spark, path, *files):
    for n, rows in enumerate(files):
        spark.createDataFrame([(m, h, T0 + dt.timedelta(minutes=t)) for m, h, t in rows], ROW).coalesce(1).write.parquet(f"{path}/{n}")
    return spark.readStream.schema(ROW).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(path))


def test_many_matches_take_little_time(spark, tmp_path):
    n = 20_000
    rows = [(m, s == 0, m % 50) for m in range(n) for s in range(1 + (m % 3 == 0))] + [(n, True, 600)]
    start = time.perf_counter()
    got = jobs.collected(jobs.assembled(source(spark, tmp_path, rows), 64), "many").collect()
    assert time.perf_counter() - start < 20  # a call for each match took 5 ms of a core
    assert sorted(r[0] for r in got) == [m for m in range(n) if m % 3 == 0]


def test_each_match_has_its_own_clock(spark, tmp_path):
    files = ([(1, True, 0), (2, True, 30), (2**60 + 1, False, 1), (4, True, 2), (None, True, 3)], [(1, False, 40), (5, True, 58)], [(2, False, 60), (4, False, 57), (None, False, 58), (6, True, 200)], [(7, True, 500)])
    stream = source(spark, tmp_path, *files)
    assert sorted((r[0] or 0) for r in jobs.collected(jobs.assembled(stream, 2), "clock").collect()) == [0, 1, 2, 4]
    got = {(r["match_id"], r["missing"]) for r in jobs.collected(jobs.watched(stream, 1), "clock").collect()}
    assert {(2**60 + 1, "home"), (5, "away"), (6, "away")} <= got and not {m for m, _ in got} & {1, 2, 7}


class State:
    """What a step asks of a bucket's state."""

    def __init__(self):
        self.get, self.now, self.hasTimedOut = None, 0, False

    exists = property(lambda self: self.get is not None)

    def update(self, value):
        self.get = value

    def remove(self):
        self.get = None

    def getCurrentWatermarkMs(self):
        return self.now

    def setTimeoutTimestamp(self, at):
        assert at >= self.now


def test_a_call_is_cheap_and_tells_what_a_plain_loop_tells():
    known, want, got, state, start = {}, [], [], State(), time.perf_counter()
    for call in range(300):
        rows = [(m * 7919 % 400 + call // 2, (m + call) % 3 == 0, call * 600_000 + m * 1000) for m in range(20)] if call % 5 else []
        state.now, state.hasTimedOut = max(0, (call - 2) * 600_000), not rows
        batch = pd.DataFrame([(m, h, not h, ms) for m, h, ms in rows], columns=["match_id", "home", "away", "ms"])
        for out in jobs._deadline((0,), iter([batch] if rows else []), state):
            got += [(call, *r) for r in out[["match_id", "missing"]].itertuples(index=False)]
        told = {m for m, (_, due) in known.items() if due < state.now} - {r[0] for r in rows}
        want += [(call, m, "away" if True in known.pop(m)[0] else "home") for m in told]
        for m, h, ms in rows:
            sides, due = known.get(m, (set(), 0))
            known[m] = (sides | {h}, max(due, ms + jobs.DEADLINE_MS, state.now))
        known = {m: x for m, x in known.items() if len(x[0]) < 2}
    assert sorted(got) == sorted(want) and len(want) > 300
    assert time.perf_counter() - start < 2  # with data frames a call took 30 ms
