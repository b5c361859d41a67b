"""Periodic runs, harmonic packing and repair of conversations against brute force, with hostile rows."""

import hashlib
import itertools
import random
import re
import zlib
from array import array
from functools import cache

import pytest
from conftest import DATA
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from touchline.llm import harmonic, registry, runs, turns


def docs_of(spark, tmp_path, rows):
    """A table with clashing columns."""
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({x: F.lit("x") for x in ("runs", "start", "length", "ids", "_", "a.b", "N_WORDS")})
    df.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    return f"file://{tmp_path}"


def brute_runs(ws, least=6, times=4):
    n, out = len(ws), []
    for q in range(1, n // times + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and ws[j] == ws[j + q]:
                j += 1
            e = j + q
            if j > i and e - i >= max(least, times * q) and not any(all(ws[k] == ws[k + d] for k in range(i, e - d)) for d in range(1, q)):
                out.append((i, e - i, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize(("least", "times"), [(6, 4), (3, 2), (10, 3)])
def test_runs_are_those_of_brute_force(monkeypatch, least, times):
    monkeypatch.setattr(runs, "PAIRS", 50)
    rng = random.Random(least)
    for _ in range(150):
        docs = []
        for _ in range(rng.randint(1, 4)):
            letters, n = rng.choice([1, 2, 3, 20]), rng.choice([0, 1, 5, 6, 7, 30, 120])
            ws = [b"%d" % rng.randrange(letters) for _ in range(n)]
            for _ in range(rng.randint(0, 4) if n > 10 else 0):
                a, p = rng.randrange(n), rng.randint(1, 12)
                for i in range(a + p, min(n, a + rng.randint(1, 80))):
                    ws[i] = ws[i - p]
            docs.append(ws)
        assert runs._spans(docs, least, times) == [brute_runs(ws, least, times) for ws in docs]


def test_least_overlap_holds_for_all_periods():
    for least, times in itertools.product(range(2, 20), range(2, 6)):
        assert runs.least_overlap(least, times) == min(max(least, times * q) - q for q in range(1, 200))


def test_very_long_texts_have_their_runs():
    (same,) = runs._spans([[b"a"] * 200_000], 6, 4)
    assert same == [(0, 200_000, 1)]
    (twice,) = runs._spans([[b"%d" % (i * i % 97) for i in range(100_000)] + [b"x"] + [b"y", b"z"] * 50_000], 6, 4)
    assert twice == [(0, 100_000, 97), (100_001, 100_000, 2)]


def expected_runs(doc, text):
    ws = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h, n = zlib.crc32(str(doc).encode()), len(ws)
    if h % 10 == 0 and n and doc is not None:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        ws = ws[:a] + [ws[a + (i - a) % p] for i in range(a, n)]
    found = brute_runs(ws)
    best = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
    lost = {i for s, m, q in found for i in range(s + q, s + m)}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    at = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (len(found), *at, sha("".join(f"{s},{m},{q}\n" for s, m, q in found)), sha(" ".join(w for i, w in enumerate(ws) if i not in lost)))


RUN_COLUMNS = ("n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


def test_run_query_with_hostile_rows(spark, tmp_path):
    hot = next(i for i in range(1000) if zlib.crc32(str(i).encode()) % 10 == 0)
    texts = [None, "", " \n\x0b", "a", "a a a a a a", "é\x1cé é\x1cé é\x1cé é\x1cé é\x1cé é\x1cé", "a b a b a b a b", "a b a b a b a b c c c c c c", "x y " * 300]
    rows = [(i, t) for i in (hot, 1, 1, None) for t in texts]
    got = registry.QUERIES["op11_periodic_runs"](spark, docs_of(spark, tmp_path, rows)).collect()
    key = lambda r: (str(r[0]), *map(str, r[1:]))
    assert sorted(((r["doc_id"], *(r[c] for c in RUN_COLUMNS)) for r in got), key=key) == sorted(((i, *expected_runs(i, t)) for i, t in rows), key=key)


def test_run_query_of_the_documents(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").filter("length(text) < 20000").select("doc_id", "text").collect()
    got = {r["doc_id"]: tuple(r[c] for c in RUN_COLUMNS) for r in registry.QUERIES["op11_periodic_runs"](spark, DATA).collect()}
    assert len(docs) > 100
    assert {r["doc_id"]: got[r["doc_id"]] for r in docs} == {r["doc_id"]: expected_runs(*r) for r in docs}


HOSTILE = ["", None, " ", " a", "a  b", "a b ", "\n \n x", "  y z", "a <|endoftext|> b c", "x　y z", "it's don't 'll we 'll", "a\x1c b", "tab\t b\t\tc  d", "a, b. c. ., x1. 日. é, ②.", "e" * 5000, "é \U0001f600 " * 3000]


def library(texts):
    return Tokenizer.from_file(harmonic.VOCABULARY).encode_batch([t or "" for t in texts], add_special_tokens=False)


@pytest.mark.parametrize("size", [7, 1 << 16])
def test_ids_are_those_of_the_library(monkeypatch, size):
    monkeypatch.setattr(harmonic, "SLICE", size)
    texts = [t or "" for t in HOSTILE] + ["w" * 30 + " " + " ".join(["ab  c", "de\n"] * 200), " " * 3000 + "x", "^" * 3000, "\n" * 3000]
    texts += ["".join(f"a{chr(c)}b {chr(c)} 1{chr(c)}{chr(c)}  {chr(c)}." for c in range(i, i + 256)) for i in (0, 0x100, 0x300, 0x600, 0x2000, 0x3000, 0xFF00)]
    e = harmonic.Encoder(harmonic.VOCABULARY)
    assert [e(t) for t in texts] == [array("I", x.ids).tobytes() for x in library(texts)]


def check_packing(got, ids):
    """Every id in one piece, sequences without gaps, and none padded."""
    docs, seqs = {}, {}
    for r in got:
        docs.setdefault(r["doc_id"], []).append(r)
        seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for i, rows in docs.items():
        want, at = ids[i], 0
        for r in sorted(rows, key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(want)
            at += r["length"]
            assert r["ids_crc32"] == zlib.crc32(array("I", want[r["start"] : at]).tobytes())
        assert at == len(want)
    assert docs.keys() == ids.keys()
    for rows in seqs.values():
        at = 0
        for offset, n in sorted(rows):
            assert offset == at
            at += n
        assert at <= 2048 and at & (at - 1) == 0


def test_packing_query_with_hostile_rows(spark, tmp_path):
    rows = list(enumerate(HOSTILE))
    got = registry.QUERIES["op12_harmonic"](spark, docs_of(spark, tmp_path, rows)).collect()
    check_packing(got, {i: [*x.ids, 1] for (i, _), x in zip(rows, library(HOSTILE), strict=True)})


def test_packing_query_of_the_documents(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    got = registry.QUERIES["op12_harmonic"](spark, DATA).collect()
    check_packing(got, {r["doc_id"]: [*x.ids, 1] for r, x in zip(docs, library([r["text"] for r in docs]), strict=True)})


def test_repeated_documents_are_packed_one_by_one_and_sequences_come_out_whole(spark, tmp_path):
    docs = spark.read.parquet(docs_of(spark, tmp_path, [(1, "a b c d"), (1, "a b c d"), (None, "a b c d"), (2, "x " * 5000)]) + "/documents.parquet")
    pieces = harmonic.harmonic_pack(docs, capacity=64)
    whole = harmonic.sequences(pieces).collect()
    assert sum(r["n_tokens"] for r in whole) == sum(len(r["ids"]) // 4 for r in whole) == 3 * 5 + len(library(["x " * 5000])[0].ids) + 1
    held = [(d, s) for r in whole for d, s in zip(r["doc_ids"], r["starts"], strict=True)]
    assert sorted(map(str, held)) == sorted(str((r["doc_id"], r["start"])) for r in pieces.select("doc_id", "start").collect())
    assert len({r["sequence_id"] for r in whole}) == len(whole)
    with pytest.raises(ValueError):
        harmonic.harmonic_pack(docs, capacity=100)


SOLID = re.compile(r"[^\x20\x09-\x0D]")
FOLLOWS = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}


def brute_damage(rows):
    out = []
    for c, t, r, x in rows:
        r, x = (" " if v is None else v for v in (r, x))
        h = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        x = "" if h == 1 else re.sub("[.!?]", "", x) if h == 2 else x
        out += [(c, t, "user" if h == 4 else r, x)] * (0 if h == 0 else 2 if h == 3 else 1)
    return out


def brute_repair(rows):
    """Over whole audits: of all edits from a row on the cheapest, then the least in letters."""
    rows = sorted(rows, key=lambda q: (q[1] is not None, q[1] or 0, q[2], hashlib.md5(f"{q[2]}\0{q[3]}".encode()).hexdigest()))
    seen, fault = set(), []
    for _, _, r, x in rows:
        solid = SOLID.findall(x)
        fault.append("b" if not solid else "d" if (r, x) in seen else "t" if solid[-1] not in ".!?" else "")
        seen.add((r, x))

    @cache
    def best(i, state, inserted):
        found = [(0, "", ())] if i == len(rows) and state in ("", "a") else []

        def step(more, letter, j, now, line, n=0):
            cost, audit, lines = best(j, now, n)
            found.append((more + cost, letter + audit, (line, *lines) if line is not None else lines))

        if i < len(rows):
            _, _, r, x = rows[i]
            step(2, "D", i + 1, state, None)
            if fault[i] not in ("b", "d"):
                more = 5 * (fault[i] == "t")
                if (state, r[:1]) in FOLLOWS:
                    step(more, "K", i + 1, FOLLOWS[state, r[:1]], f"{r}:{x}")
                for y in ("user", "assistant"):
                    if (state, y[0]) in FOLLOWS:
                        step(more + 1, "R", i + 1, y[0], f"{y}:{x}")
        for y in ("user", "assistant"):
            if inserted < 3 and (state, y[0]) in FOLLOWS:
                step(5, "I", i, y[0], f"{y}:", inserted + 1)
        return min(found, key=lambda f: f[:2], default=(10**9, "", ()))

    for i in range(len(rows), -1, -1):  # from the end, so that the recursion isn't deep
        for state in ("", "s", "u", "a"):
            best(i, state, 0)
    cost, audit, lines = best(0, "", 0)
    places = [q[1] for q in rows if q[1] is not None]
    gaps = max(places) - min(places) + 1 - len(set(places)) if places else 0
    initials = [q[2][:1] for q in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials))
    return (gaps, *(fault.count(x) for x in "bdt"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


TURN_COLUMNS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def check_turns(spark, sf_dir, rows):
    by = {r[0]: [] for r in rows}
    for r in brute_damage(rows):
        by[r[0]].append(r)
    got = registry.QUERIES["op13_turns"](spark, sf_dir).collect()
    assert len(got) == len(by)
    assert {r["conv_id"]: tuple(r[c] for c in TURN_COLUMNS) for r in got} == {c: brute_repair(x) for c, x in by.items()}


def turns_of(spark, tmp_path, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({x: F.lit("x") for x in ("key", "digest", "n", "a.b", "kind")})
    df.repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    return f"file://{tmp_path}"


@pytest.mark.parametrize("seed", [1, 2])
def test_repairs_are_those_of_brute_force(spark, tmp_path, seed):
    rng, rows = random.Random(seed), []
    for c in [None, *range(60)]:
        t = rng.randrange(5)
        for _ in range(rng.choice([1, 2, 3, 5, 8, 14])):
            t += rng.choice([0, 1, 1, 1, 3])
            role = rng.choice(["user", "assistant", "system", "user", "assistant", "tool", None, ""])
            rows.append((c, rng.choice([None, *[t] * 7]), role, rng.choice([None, "", " \n", "hi.", "ok", "yes!", "no? ", "a b\x0b", "long text.", "é.　"])))
    check_turns(spark, turns_of(spark, tmp_path, rows), rows)


def test_a_hot_conversation_is_repaired_by_many_tasks(spark, tmp_path):
    rng, rows = random.Random(5), []
    for i in range(900):
        rows.append((7 if i % 3 else i, i // 2 * 3, rng.choice(["user", "assistant", "assistant", "system"]), rng.choice([f"say {i}.", f"say {i}", "ok.", "ok.", ""])))
    sf_dir = turns_of(spark, tmp_path, rows)
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        parts = turns.repaired(turns.damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet"))).turns.filter("key = '=7'").select("part").distinct().count()
        assert parts > 5
        check_turns(spark, sf_dir, rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_repair_of_the_conversations_and_other_costs(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    check_turns(spark, DATA, rows)
    df = spark.createDataFrame([(1, 0, "user", "a."), (1, 1, "user", "b."), (1, 2, "user", "c.")], "conv_id long, turn long, role string, text string")
    cheap = turns.repaired(df, turns.Costs(rerole=9, delete=9, insert=1))
    assert [(r["cost"], r["audit"]) for r in cheap.summary.collect()] == [(3, "KIKIKI")]
    assert [(r["role"], r["text"]) for r in cheap.turns.orderBy("part", "at").collect()] == [("user", "a."), ("assistant", ""), ("user", "b."), ("assistant", ""), ("user", "c."), ("assistant", "")]


@pytest.mark.parametrize("name", ["op11_periodic_runs", "op12_harmonic", "op13_turns"])
def test_no_rows(spark, tmp_path, name):
    for t in ("documents", "conversations"):
        spark.read.parquet(f"{DATA}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert registry.QUERIES[name](spark, f"file://{tmp_path}").count() == 0
