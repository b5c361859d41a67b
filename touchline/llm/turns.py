"""Repair of conversations: the cheapest edits that leave ``(system?(user assistant)+)?``, found over retained turns.

Every row is kept, given another role or deleted, and empty turns are inserted. The programme goes over the rows that are
retained. Deletions between two of them are a difference of prefix sums, the roles of both determine what is inserted,
so for each row the running minima for each role of the row retained before it are enough. Of the cheapest edits those
with the least letters (D, I, K, R) win: going forward, all edits possible at a row have different letters, so the
cheapest cost from each row on, by role retained last, decides.

Conversations may be of any length. Rows are dealt by ranges of (conversation, turn) and what a task has of a conversation
is a segment. Only a task's first and last segment may go on elsewhere; these are summed up as the least cost from each
state before to each state after, which compose, so a hot conversation is worked on by many tasks. Texts don't take part:
they are met again by turn and digest once it is known what stays. A checksum over a whole conversation streams through one
task, as SHA-256 can't be split, and holds one row at a time.

Defined results: a null role or text is one blank; null turns come first; rows of one turn go by role, then by the digest
of role and text; equal rows of one turn are one row several times; a role other than system, user or assistant can't be
kept, only the first letter counts; a null conversation is one more conversation; a conversation without rows has no edits
and is in the result only if the caller says which there are; an empty table gives no rows. Only the four named columns are
read, so other columns can't clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.operators.lineage import workspace, written

from .common import table

BLANKS = " \t\n\x0b\x0c\r"
NEVER = 1 << 60
#: States: the role retained last (none, s, u, a).
NONE, S, U, A = range(4)
ROLES = {U: "user", A: "assistant"}
#: What has to be inserted where a role follows another; pairs that aren't here can't be.
BETWEEN = {(NONE, S): (), (NONE, U): (), (NONE, A): (U,), (S, U): (), (S, A): (U,), (U, A): (), (U, U): (A,), (A, U): (), (A, A): (U,)}
AT_END = {NONE: (), S: (U, A), U: (A,), A: ()}
LEGAL = {"su", "ua", "au"}


class Costs(NamedTuple):
    rerole: int = 1
    delete: int = 2
    insert: int = 5
    truncated: int = 5


class Row(NamedTuple):
    """A row of a conversation; ``lost``: blank or seen before, so that it has to go."""

    at: int
    initial: str
    lost: bool
    truncated: bool

    def retained(self, c: Costs) -> dict[int, int]:
        """What it costs to retain it as each role."""
        if self.lost:
            return {}
        more = c.truncated if self.truncated else 0
        out = {x: more + (0 if self.initial == name[0] else c.rerole) for x, name in ROLES.items()}
        return out | ({S: more} if self.initial == "s" else {})


def priced(rows: list[Row], start: list[int], c: Costs) -> list[int]:
    """The least cost in each state behind ``rows``, from what each state costs before them."""
    low, deleted = list(start), 0
    for row in rows:
        new = {x: min(low[r] + c.insert * len(BETWEEN[r, x]) for r in range(4) if (r, x) in BETWEEN) + deleted + w for x, w in row.retained(c).items()}
        deleted += c.delete
        for x, cost in new.items():
            low[x] = min(low[x], cost - deleted)
    return [min(NEVER, v + deleted) for v in low]


def ahead(rows: list[Row], end: list[int], c: Costs) -> list[list[int]]:
    """For each place between ``rows`` the least cost from it on, by the role retained last."""
    total = c.delete * len(rows)
    low, after = [NEVER] * 4, list(end)
    out = [after]
    for i in range(len(rows) - 1, -1, -1):
        deleted = c.delete * i
        for x, w in rows[i].retained(c).items():
            low[x] = min(low[x], deleted + w + after[x])
        after = [min(total + end[r], *(low[x] + c.insert * len(BETWEEN[r, x]) for x in (S, U, A) if (r, x) in BETWEEN)) - deleted for r in range(4)]
        out.append(after)
    return out[::-1]


def edits(rows: list[Row], state: int, cost: list[list[int]], c: Costs) -> Iterator[tuple[str, int, int]]:
    """(letters, place in ``rows`` or -1, state) of each step of the cheapest edits; of equal ones the least letters."""
    for i, row in enumerate(rows):
        if cost[i][state] == c.delete + cost[i + 1][state]:
            yield "D", -1, state
            continue
        options = []
        for x, w in row.retained(c).items():
            if (state, x) in BETWEEN and cost[i][state] == c.insert * len(BETWEEN[state, x]) + w + cost[i + 1][x]:
                options.append(("I" * len(BETWEEN[state, x]) + ("K" if row.initial == "?sua"[x] else "R"), i, x))
        step = min(options)
        yield step
        state = step[2]


_SEGMENT = pa.schema([("key", pa.string()), ("part", pa.int64()), ("edge", pa.bool_()), ("turn", pa.list_(pa.int64())), ("role", pa.list_(pa.string())), ("digest", pa.list_(pa.string())), ("blank", pa.list_(pa.bool_())), ("truncated", pa.list_(pa.bool_())), ("first", pa.list_(pa.bool_())), ("n", pa.list_(pa.int64())), ("matrix", pa.list_(pa.int64())), ("initials", pa.string())])
_SEGMENT_DDL = "key string, part long, edge boolean, turn array<long>, role array<string>, digest array<string>, blank array<boolean>, truncated array<boolean>, first array<boolean>, n array<long>, matrix array<long>, initials string"
_FIELDS = ("turn", "role", "digest", "blank", "truncated", "first", "n")


def _rows(seg: dict) -> list[Row]:
    out = []
    for at, (role, blank, cut, first, n) in enumerate(zip(*(seg[x] for x in ("role", "blank", "truncated", "first", "n")), strict=True)):
        out += [Row(at, role[:1], blank or not first or i > 0, cut) for i in range(n)]
    return out


def _segments(c: Costs):
    """Sorted rows to a row for each conversation of the partition; its first and last are summed up for others."""

    def run(it):
        from pyspark import TaskContext

        part, key, held, done = TaskContext.get().partitionId(), None, None, 0

        def closed(edge: bool) -> pa.RecordBatch:
            seg = {"key": key, "part": part, "edge": edge, "matrix": None, "initials": None} | held
            if edge:
                rows = _rows(seg)
                seg["matrix"] = [v for r in range(4) for v in priced(rows, [0 if x == r else NEVER for x in range(4)], c)]
                seg["initials"] = rows[0].initial.ljust(1) + rows[-1].initial.ljust(1)
            return pa.RecordBatch.from_pylist([seg], schema=_SEGMENT)

        for batch in it:
            cols = batch.to_pydict()
            for i, k in enumerate(cols["key"]):
                if k != key:
                    if key is not None:
                        yield closed(edge=not done)
                        done += 1
                    key, held = k, {x: [] for x in _FIELDS}
                for x in _FIELDS:
                    held[x].append(cols[x][i])
        if key is not None:
            yield closed(edge=True)

    return run


def _sorted_pieces(pieces: pa.Table) -> list[dict]:
    return sorted(pieces.to_pylist(), key=lambda x: x["part"])


def _costs_after(c: Costs):
    """For the segments of a conversation, at most one a task: the cost from each one's end on, and the letter before it."""

    def run(pieces: pa.Table) -> pa.Table:
        segs = _sorted_pieces(pieces)
        end = [c.insert * len(AT_END[r]) for r in range(4)]
        out = []
        for i, seg in reversed([*enumerate(segs)]):
            out.append({"key": seg["key"], "part": seg["part"], "after": end, "before": segs[i - 1]["initials"][1] if i else None, "last": i == len(segs) - 1})
            m = seg["matrix"]
            end = [min(NEVER, *(m[4 * r + x] + end[x] for x in range(4))) for r in range(4)]
        return pa.Table.from_pylist(out, schema=pa.schema([("key", pa.string()), ("part", pa.int64()), ("after", pa.list_(pa.int64())), ("before", pa.string()), ("last", pa.bool_())]))

    return run


def _ends(c: Costs):
    """Where the cheapest edits of a segment end, from each state that it may begin in."""

    def run(it):
        for batch in it:
            out = []
            for seg in batch.to_pylist():
                rows = _rows(seg)
                cost = ahead(rows, seg["after"], c)
                ends = []
                for r in range(4):
                    state = r
                    if cost[0][r] < NEVER:
                        for _, _, state in edits(rows, r, cost, c):
                            pass
                    ends.append(state)
                out.append({"key": seg["key"], "part": seg["part"], "ends": ends})
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("key", pa.string()), ("part", pa.int64()), ("ends", pa.list_(pa.int64()))]))

    return run


def _starts(pieces: pa.Table) -> pa.Table:
    """The state that each segment of a conversation begins in."""
    state, out = NONE, []
    for seg in _sorted_pieces(pieces):
        out.append({"key": seg["key"], "part": seg["part"], "state": state})
        state = seg["ends"][state]
    return pa.Table.from_pylist(out, schema=pa.schema([("key", pa.string()), ("part", pa.int64()), ("state", pa.int64())]))


_STAY = pa.struct([("at", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("digest", pa.string()), ("becomes", pa.string())])
_TRACE = pa.schema([("key", pa.string()), ("part", pa.int64()), *((x, pa.int64()) for x in ("blank", "duplicate", "truncated", "illegal", "cost")), ("audit", pa.string()), ("stay", pa.list_(_STAY))])
_TRACE_DDL = "key string, part long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, stay array<struct<at:long,turn:long,role:string,digest:string,becomes:string>>"


def _traced(c: Costs):
    def run(it):
        for batch in it:
            out = []
            for seg in batch.to_pylist():
                rows = _rows(seg)
                cost = ahead(rows, seg["after"] or [c.insert * len(AT_END[r]) for r in range(4)], c)
                audit, stay, state = [], [], NONE if seg["state"] is None else seg["state"]
                total = cost[0][state]

                def inserted(x: int, stay=stay) -> None:
                    stay.append({"at": len(stay), "turn": None, "role": ROLES[x], "digest": None, "becomes": ROLES[x]})

                for letters, i, x in edits(rows, state, cost, c):
                    audit.append(letters)
                    if i >= 0:
                        for y in BETWEEN[state, x]:
                            inserted(y)
                        at = rows[i].at
                        role = seg["role"][at]
                        stay.append({"at": len(stay), "turn": seg["turn"][at], "role": role, "digest": seg["digest"][at], "becomes": role if letters[-1] == "K" else ROLES[x]})
                    state = x
                total -= cost[-1][state]
                if seg["last"] is not False:
                    audit.append("I" * len(AT_END[state]))
                    total += c.insert * len(AT_END[state])
                    for x in AT_END[state]:
                        inserted(x)
                initials = ([seg["before"]] if seg["before"] else []) + [r.initial for r in rows]
                illegal = sum(a + b not in LEGAL for a, b in zip(initials, initials[1:], strict=False))
                blank = sum(n for n, b in zip(seg["n"], seg["blank"], strict=True) if b)
                again = sum(n - f for n, b, f in zip(seg["n"], seg["blank"], seg["first"], strict=True) if not b)
                cut = sum(t and not r.lost for r, t in zip(rows, (r.truncated for r in rows), strict=True))
                out.append({"key": seg["key"], "part": seg["part"], "blank": blank, "duplicate": again, "truncated": cut, "illegal": illegal, "cost": total, "audit": "".join(audit), "stay": stay})
            yield pa.RecordBatch.from_pylist(out, schema=_TRACE)

    return run


def key_of(conv: str) -> Column:
    """A conversation's id as a text that is never null."""
    return F.coalesce(F.concat(F.lit("="), F.col(f"`{conv}`").cast("string")), F.lit(""))


def _place(turn: str) -> Column:
    """A turn as a text that is never null."""
    return F.coalesce(F.col(turn).cast("string"), F.lit(""))


class Repaired(NamedTuple):
    """``summary``: (key, blank, duplicate, truncated, illegal, gaps, cost, audit) of each conversation with rows;
    ``turns``: (key, part, at, role, text), the repaired rows in the order of ``part`` and ``at``."""

    summary: DataFrame
    turns: DataFrame


def repaired(rows: DataFrame, costs: Costs = Costs(), conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> Repaired:
    """See the module's text. Both results are tables in the scratch folder."""
    with workspace(rows.sparkSession):
        return _repaired(rows, costs, conv, turn, role, text)


def _repaired(rows: DataFrame, c: Costs, conv: str, turn: str, role: str, text: str) -> Repaired:
    spark = rows.sparkSession
    blank = lambda x: F.coalesce(F.col(f"`{x}`").cast("string"), F.lit(" "))
    rows = rows.select(key_of(conv).alias("key"), F.col(f"`{turn}`").cast("long").alias("turn"), blank(role).alias("role"), blank(text).alias("text"))
    rows = rows.withColumn("digest", F.md5(F.concat_ws("\0", "role", "text").cast("binary")))
    end = F.right(F.rtrim("text", F.lit(BLANKS)), F.lit(1))
    rows = rows.withColumn("t", _place("turn"))
    by = ("key", "t", "role", "digest")
    light = rows.withColumn("end", end).groupBy(*by, "turn").agg(F.count("*").alias("n"), F.first("end").alias("end"))
    light = written(spark, light.select("key", "turn", "role", "digest", "n", (F.col("end") == "").alias("blank"), (~F.col("end").isin("", ".", "!", "?")).alias("truncated")), "turns-rows")

    twice = light.groupBy("key", "role", "digest").agg(F.min(F.struct(F.col("turn").isNotNull(), "turn")).alias("first"), F.count("*").alias("m")).filter("m > 1")
    first = F.coalesce(F.struct(F.col("turn").isNotNull(), F.col("turn")) == F.col("f.first"), F.lit(True))
    marked = light.join(twice.select("key", "role", "digest", F.struct("first").alias("f")), ["key", "role", "digest"], "left").select("key", "turn", "role", "digest", "n", "blank", "truncated", first.alias("first"))
    order = ["key", F.col("turn").asc_nulls_first(), "role", "digest"]
    segs = marked.repartitionByRange(*order).sortWithinPartitions(*order).select("key", *_FIELDS).mapInArrow(_segments(c), _SEGMENT_DDL)
    segs = written(spark, segs, "turns-segments")

    # two rows a task at most go on elsewhere: these are few enough for one of them to know all of one conversation
    edges = segs.filter("edge")
    after = edges.select("key", "part", "matrix", "initials").groupBy("key").applyInArrow(_costs_after(c), "key string, part long, after array<long>, before string, last boolean")
    after = written(spark, after, "turns-after")
    ends = edges.join(after.select("key", "part", "after"), ["key", "part"]).mapInArrow(_ends(c), "key string, part long, ends array<long>")
    starts = after.join(ends.groupBy("key").applyInArrow(_starts, "key string, part long, state long"), ["key", "part"])
    traced = segs.join(F.broadcast(starts), ["key", "part"], "left").mapInArrow(_traced(c), _TRACE_DDL)
    traced = written(spark, traced, "turns-traced")

    numbers = [F.sum(x).alias(x) for x in ("blank", "duplicate", "truncated", "illegal", "cost")]
    audit = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("part", "audit"))), lambda x: x["audit"]), "")
    turns = light.groupBy("key", "turn").agg(F.lit(1).alias("x")).groupBy("key").agg((F.max("turn") - F.min("turn") + 1 - F.count("turn")).alias("gaps"))
    summary = traced.groupBy("key").agg(*numbers, audit.alias("audit")).join(turns, "key").withColumn("gaps", F.coalesce("gaps", F.lit(0).cast("long")))
    stay = traced.select("key", "part", F.inline("stay"))
    texts = rows.select(*by, "text").dropDuplicates(list(by))
    found = stay.filter("digest is not null").withColumn("t", _place("turn")).join(texts, list(by)).select("key", "part", "at", F.col("becomes").alias("role"), "text")
    new = stay.filter("digest is null").select("key", "part", "at", F.col("becomes").alias("role"), F.lit("").alias("text"))
    return Repaired(written(spark, summary, "turns-summary", keep=True), written(spark, found.union(new), "turns-repaired", keep=True))


def _hashed(it):
    """Rows in order to a checksum for each key: one row is held at a time."""
    key, sha = None, None
    for batch in it:
        for k, line in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if k != key:
                if key is not None:
                    yield pa.record_batch([pa.array([key]), pa.array([sha.hexdigest()])], names=["key", "sha256"])
                key, sha = k, hashlib.sha256()
            else:
                sha.update(b"\n")
            sha.update(line.as_buffer())
    if key is not None:
        yield pa.record_batch([pa.array([key]), pa.array([sha.hexdigest()])], names=["key", "sha256"])


def checksums(turns: DataFrame) -> DataFrame:
    """(key, sha256) of the repaired rows of each conversation as ``role:text`` lines."""
    lines = turns.select("key", "part", "at", F.concat("role", F.lit(":"), "text").alias("line"))
    lines = lines.repartition("key").sortWithinPartitions("key", "part", "at")
    return lines.select("key", "line").mapInArrow(_hashed, "key string, sha256 string")


def damaged(rows: DataFrame) -> DataFrame:
    """A fifth of the rows is damaged by a checksum of conversation and turn: dropped, emptied, cut, repeated, renamed."""
    text = lambda x: F.coalesce(F.col(x).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat_ws(":", text("conv_id"), text("turn")).cast("binary")) % 20
    rows = rows.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"), kind.alias("kind")).filter("kind <> 0")
    new = F.when(F.col("kind") == 1, F.lit("")).when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, F.lit("user")).otherwise(F.col("role"))
    times = F.explode(F.array_repeat(F.lit(1), F.when(F.col("kind") == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", role.alias("role"), new.alias("text"), times.alias("_")).drop("_")


def op13_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation of ``conversations``, damaged, with its faults, the cheapest repair and a checksum of the result."""
    rows = table(spark, sf_dir, "conversations")
    found = repaired(damaged(rows))
    every = rows.select("conv_id").distinct().withColumn("key", key_of("conv_id"))
    out = every.join(found.summary, "key", "left").join(checksums(found.turns), "key", "left")
    zero = lambda x: F.coalesce(x, F.lit(0)).cast("long").alias(x)
    sha = F.coalesce("sha256", F.sha2(F.lit(b""), 256)).alias("repaired_sha256")
    return out.select("conv_id", *[zero(x) for x in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")], F.coalesce("audit", F.lit("")).alias("audit"), sha)
