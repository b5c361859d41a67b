"""Near-duplicates, repeated strings and near vectors against brute force, with hostile rows."""

import hashlib
import itertools
import math
import random
import re

import numpy as np
import pyarrow.parquet as pq
import pytest
from conftest import DATA

from touchline.llm import common, near_dup, repeats, vectors


def shingles(text):
    b = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())
    w = re.findall(rb"[^\x20\x09-\x0D]+", b)
    return frozenset() if not w else frozenset([tuple(w)]) if len(w) < 5 else frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4))


def roots(ids, links):
    top = {i: i for i in ids}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        top[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def check_near(spark, docs, percent=85):
    df = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, digest string")
    sets = {i: shingles(t) for i, t in docs}
    links = [(a, b) for a, b in itertools.combinations(sets, 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    want = roots(sets, links)
    got = {r["doc_id"]: r for r in near_dup.near_duplicates(df, percent).collect()}
    assert {i: (r["n_shingles"], r["component_id"], r["kept"]) for i, r in got.items()} == {i: (len(sets[i]), want[i], want[i] == i) for i in sets}


def words(rng, n):
    return [rng.choice("alpha beta gamma delta eps zeta eta theta iota kappa".split()) + str(rng.randrange(40)) for _ in range(n)]


def test_near_duplicates_with_a_hub_and_hostile_rows(spark):
    rng = random.Random(5)
    base = words(rng, 120)
    docs = [(100, " ".join(base))]
    for k in range(40):  # copies near to the base, less so to each other
        w = list(base)
        w[rng.randrange(120)] = f"new{k}"
        if k % 2:
            w[rng.randrange(120)] = f"other{k}"
        docs.append((200 + k, " ".join(w)))
    docs += [(1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, "One"), (6, "a b c d"), (7, "A b\nC  d"), (8, " ".join(words(rng, 5000))), (9, " ".join(base))]
    docs += [(300 + k, " ".join(words(rng, 60))) for k in range(20)]
    check_near(spark, docs)


@pytest.mark.parametrize(("percent", "edits", "shared"), [(85, 19, 4), (80, 26, 5)])
def test_near_duplicates_within_a_family_without_a_centre(spark, percent, edits, shared):
    rng = random.Random(percent)
    base = [f"w{k}" for k in range(2000)]

    def text(own, at):
        w = list(base)
        for k, new in at.items():
            w[5 * k] = f"{new}x{k}"
        for k in rng.sample(sorted(set(range(400)) - set(at)), edits - len(at)):
            w[5 * k] = f"{own}x{k}"
        return " ".join(w)

    docs = []
    for k in range(100):  # all pairs lie just below the threshold, 30 pairs of two texts just above it
        at = dict.fromkeys(rng.sample(range(400), shared), f"both{k}") if k < 30 else {}
        docs += [(2 * k, text(2 * k, at)), (2 * k + 1, text(2 * k + 1, at))]
    check_near(spark, docs, percent)


def test_near_duplicates_of_no_rows(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert near_dup.near_duplicates(df).count() == 0
    df = spark.createDataFrame([(None, "a"), (1, "a b"), (1, "c d")], "doc_id long, text string")
    assert [(r["doc_id"], r["component_id"]) for r in near_dup.near_duplicates(df).orderBy("doc_id").collect()] == [(None, None), (1, 1)]


def repeated_ids(rng):
    """Ids that repeat over different texts, whose near copies have ids of their own."""
    docs = []
    for k in range(12):
        a, b = words(rng, 300), words(rng, rng.choice([200, 300]))
        near = [list(a), list(b)]
        for w in near:
            w[rng.randrange(len(w))] = "changed"
        docs += [(10 * k, " ".join(a)), (10 * k, " ".join(b)), (10 * k + 1, " ".join(near[0])), (10 * k + 2, " ".join(near[1]))]
        docs += rng.choice([[], [(10 * k, None), (10 * k, " ".join(a))], [(10 * k + 3, " ".join(b)), (10 * k + 3, "two words")], [(10 * k + 4, "two words")]])
    return docs


@pytest.mark.parametrize("shift", [0, (1 << 63) - 120, -(1 << 63)])
def test_near_duplicates_where_ids_repeat_over_different_texts(spark, shift):
    docs = [(i + shift, t) for i, t in repeated_ids(random.Random(9))]
    docs.append((-7 if shift <= 0 else 7, "other text"))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    sets = [(i, shingles(t)) for i, t in docs]
    links = [(a, b) for (a, x), (b, y) in itertools.combinations(sets, 2) if x and y and 100 * len(x & y) >= 85 * len(x | y)]
    want = roots(sorted({i for i, _ in docs}), links)
    most = {i: max(len(x) for j, x in sets if j == i) for i in want}
    got = {r["doc_id"]: r for r in near_dup.near_duplicates(df).collect()}
    assert {i: (r["n_shingles"], r["component_id"], r["kept"]) for i, r in got.items()} == {i: (most[i], want[i], want[i] == i) for i in want}
    assert len(got) < len(docs) and len(set(want.values())) > 5


def test_near_duplicates_of_the_documents(spark):
    t = pq.read_table(f"{DATA}/documents.parquet")
    check_near(spark, list(zip(t["doc_id"].to_pylist(), t["text"].to_pylist(), strict=True)))


def brute_repeats(docs, length=50):
    first = {}
    for i, t in docs:
        b = (t or "").encode()
        for p in range(len(b) - length + 1):
            w = b[p : p + length]
            first[w] = min(first.get(w, i), i)
    out = []
    for i, t in docs:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - length + 1):
            if first[b[p : p + length]] < i:
                gone[p : p + length] = True
        kept = bytes(np.frombuffer(b, "u1")[~gone])
        out.append((i, len(b), int(gone.sum()), int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def check_repeats(spark, docs):
    df = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, block int").repartition(3)
    got = [(r["rest"]["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in repeats.remove_repeats(df).collect()]
    assert sorted(got) == brute_repeats(docs)


@pytest.mark.parametrize("small", [False, True])
def test_repeats_with_hostile_rows(spark, monkeypatch, small):
    if small:  # many blocks and buckets, and frequent strings dealt by window
        monkeypatch.setattr(repeats, "BLOCK", 2000)
        monkeypatch.setattr(repeats, "HOT", 2)
        monkeypatch.setattr(repeats, "KEYS", 2000)
        monkeypatch.setattr(repeats, "STRETCHES", 4000)
        monkeypatch.setattr(repeats, "FAN_BITS", 2)
        monkeypatch.setattr(repeats, "GATHER", 1000)
    rng = random.Random(3)
    text = lambda n: "".join(rng.choice("abcdé \n") for _ in range(n))
    common_passage = text(90)
    docs = [(1, None), (2, ""), (3, "short"), (4, "x" * 200), (5, "x" * 120), (6, common_passage), (7, common_passage), (7, common_passage), (8, "ab" * 100), (9, "\x00" * 80), (10, "\x00" * 60)]
    docs += [(20 + k, text(40) + common_passage + text(70)) for k in range(12)]
    docs += [(60, text(30000)), (61, text(49)), (62, text(50))]
    check_repeats(spark, docs)


def test_repeats_of_the_documents(spark):
    t = pq.read_table(f"{DATA}/documents.parquet")
    check_repeats(spark, list(zip(t["doc_id"].to_pylist(), t["text"].to_pylist(), strict=True)))


def test_repeats_of_no_rows_and_the_stage(spark):
    df = spark.createDataFrame([], "doc_id long, text string, n_chars long")
    assert repeats.stage(spark, df, "").count() == 0
    p = "é" * 60
    df = spark.createDataFrame([(1, p + "a", "s", 61), (2, "b" + p, "s", 61)], "doc_id long, text string, source string, n_chars long")
    assert [tuple(r) for r in repeats.stage(spark, df, "").orderBy("doc_id").collect()] == [(1, p + "a", "s", 61), (2, "b", "s", 1)]
    cut = "z" + "q" * 60  # removal leaves the first byte of a character before it
    rows = [(1, "\u00e9" + cut, 0), (2, "\u00e8\u00a9" + cut, 0), (3, "\ufffd stays", 0)]
    got = {r["doc_id"]: r["text"] for r in repeats.stage(spark, spark.createDataFrame(rows, "doc_id long, text string, n_chars long"), "").collect()}
    assert got == {1: rows[0][1], 2: "\u00e8", 3: "\ufffd stays"}


def brute_vectors(rows, cosine=0.98):
    ok = {i: (lab, np.array(v, "f8")) for i, v, lab in rows if lab is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    links = [(a, b) for a, b in itertools.combinations(ok, 2) if ok[a][0] == ok[b][0] and len(ok[a][1]) == len(ok[b][1]) and ok[a][1] @ ok[b][1] / np.sqrt(ok[a][1] @ ok[a][1]) / np.sqrt(ok[b][1] @ ok[b][1]) >= cosine]
    n = {i: sum(i in x for x in links) for i, _, _ in rows}
    top = roots([i for i, _, _ in rows], links)
    return {i: (n[i], top[i], top[i] == i) for i in n}


@pytest.mark.parametrize("cell", [1024, 7])
def test_vectors_with_hostile_rows(spark, monkeypatch, cell):
    monkeypatch.setattr(vectors, "CELL", cell)
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((8, 32))
    rows = [(k, (centres[k % 8] + rng.standard_normal(32) * 0.09).tolist(), k % 2) for k in range(120)]
    rows += [(200 + k, rows[0][1], 0) for k in range(5)] + [(210, [2 * x for x in rows[0][1]], 0), (211, rows[0][1], None), (212, None, 0), (213, [], 0), (214, [0.0] * 32, 0), (215, [float("nan")] * 32, 0), (216, [1.0, None], 0), (217, [float("inf")] * 32, 0), (218, [1.0, 0.0], 0), (219, [1.0, 0.01], 0)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, label int, links int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in vectors.near_vectors(df).collect()}
    assert got == brute_vectors(rows)


def test_cells_that_are_far_apart_do_not_meet(spark, monkeypatch):
    monkeypatch.setattr(vectors, "CELL", 64)
    seen = []
    monkeypatch.setattr(vectors, "meetings", lambda cells, cosine, real=vectors.meetings: seen.append((cells.count(), (m := real(cells, cosine)).count())) or m)
    rng = np.random.default_rng(2)
    rows = [(k, v.tolist(), 0) for k, v in enumerate(rng.standard_normal((3000, 3)))]
    got = vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), 0.9999)
    assert {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in got.collect()} == brute_of(rows, 0.9999)
    cells, pairs = seen[0]
    assert pairs < cells * (cells + 1) / 4


def brute_of(rows, cosine):
    x = np.array([v for _, v, _ in rows])
    x = x / np.linalg.norm(x, axis=1)[:, None]
    near = (x @ x.T >= cosine) & ~np.eye(len(x), dtype=bool)
    top = roots(range(len(x)), zip(*(i.tolist() for i in np.nonzero(near)), strict=True))
    return {i: (int(near[i].sum()), top[i], top[i] == i) for i in range(len(x))}


def test_very_long_vectors(spark):
    rng = np.random.default_rng(3)
    a = rng.standard_normal(20_000)
    rows = [(1, a.tolist(), 0), (2, (a + 0.05 * rng.standard_normal(20_000)).tolist(), 0), (3, rng.standard_normal(20_000).tolist(), 0)]
    got = vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"))
    assert {r["vec_id"]: r["component_id"] for r in got.collect()} == {1: 1, 2: 1, 3: 3}


def test_vectors_of_no_rows(spark):
    assert vectors.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_components_of_a_long_chain_and_a_hub(spark):
    e = [(i, i + 1) for i in range(1, 200)] + [(1000, 1000 + k) for k in range(1, 300)] + [(5000, 5000), (7, 7)]
    got = {r["id"]: r["component"] for r in common.components(spark, spark.createDataFrame(e, "a long, b long").repartition(5)).collect()}
    assert {got[i] for i in range(1, 201)} == {1} and {got[1000 + k] for k in range(300)} == {1000}


def test_what_orders_shingles_is_a_megabyte_on_the_driver(spark):
    rng = np.random.default_rng(5)
    common = rng.integers(1 << 62, (1 << 62) + (1 << 43), 40, "u8")
    sets = [np.unique(np.r_[common, rng.integers(0, 1 << 63, 8, "u8")]) for _ in range(30)]
    rows = [(k, k, len(x), x.tobytes()) for k, x in enumerate(sets)]
    df = spark.createDataFrame(rows, "doc long, g long, n long, items binary")
    levels = near_dup.shared_levels(df)
    assert levels.nbytes == 1 << near_dup.BITS and levels.max() == levels[1 << 18] == 1 + math.floor(4 * math.log2(1200))
    near = {(a, b) for a in range(30) for b in range(a + 1, 30) if 100 * len(np.intersect1d(sets[a], sets[b])) >= 70 * len(np.union1d(sets[a], sets[b]))}
    assert near and near <= {tuple(r) for r in near_dup.dense_pairs(df, 70).collect()}
