"""The corpus pipeline against brute force, stage by stage, and over hostile and empty tables."""

import itertools
import re

import numpy as np
import pytest
from conftest import DATA
from pyspark.sql import functions as F
from test_pairs import roots, shingles
from test_rows import KEY, brute_pii

import corpus_pipeline
from touchline.llm import pii, quality


def without_repeats(docs, length=50):
    """Texts less their repeated strings; a character that is cut goes whole."""
    first = {}
    for i, t in docs:
        b = t.encode()
        for p in range(len(b) - length + 1):
            w = b[p : p + length]
            first[w] = min(first.get(w, i), i)
    out = {}
    for i, t in docs:
        b = t.encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - length + 1):
            if first[b[p : p + length]] < i:
                gone[p : p + length] = True
        out[i] = np.frombuffer(b, "u1")[~gone].tobytes().decode(errors="ignore")
    return out


@pytest.fixture
def corpus(spark, tmp_path):
    """The smallest documents with hostile rows and columns, and their labels."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    good = docs.filter("doc_id = 2").first()["text"]
    more = [(900_001, good), (None, good), (None, None), (900_002, None), (900_003, ""), (900_004, "one"), (900_005, good + " more"), (900_005, good + " more"), (900_006, "w\u0000\u2581 " * 50)]
    add = spark.createDataFrame(more, "doc_id long, text string").withColumns({"lang": F.lit("en"), "source": F.lit("s"), "n_chars": F.char_length("text").cast("long")})
    docs = docs.unionByName(add.select(*[F.col(f.name).cast(f.dataType) for f in docs.schema]))
    for c in ("_score", "_stats", "_pii", "_hits", "a.b", "block", "digest"):
        docs = docs.withColumn(c, F.lit("x"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{DATA}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    spark.conf.set(pii.KEY_SETTING, KEY)
    yield f"file://{tmp_path}"
    spark.conf.unset(pii.KEY_SETTING)


def test_pipeline_is_that_of_brute_force(spark, corpus):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_dup", "repeats", "pii", "packing"]
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    model = quality.fit(docs, spark.read.parquet(f"{corpus}/labels.parquet"))
    kept = [(r["doc_id"], r["text"]) for r in quality.score(docs.select("doc_id", "text"), model, name="p").filter("p >= 0.5").collect()]
    assert 0 < len(kept) < docs.count()
    named = {i: t or "" for i, t in kept if i is not None}
    sets = {i: shingles(t) for i, t in named.items()}
    links = [(a, b) for a, b in itertools.combinations(sets, 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    top = roots(sets, links)
    stay = [(i, t) for i, t in named.items() if top[i] == i]
    nameless = [t or "" for i, t in kept if i is None]
    last = max(named) + 1
    texts = without_repeats(stay + [(last, t) for t in nameless])
    words = {i: len(re.findall(r"\S+", brute_pii(t, KEY)[0], re.ASCII)) for i, t in texts.items() if i != last}
    got = {}
    for r in corpus_pipeline.run(spark, corpus).collect():
        got.setdefault(r["doc_id"], []).append(r["n_tokens"])
    rows = got.pop(None, [])
    assert len(rows) == len(nameless)
    assert {i: sum(n) for i, n in got.items()} == words


def test_pipeline_of_no_rows(spark, tmp_path):
    spark.read.parquet(f"{DATA}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{DATA}/labels.parquet").limit(0).write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, f"file://{tmp_path}").count() == 0
