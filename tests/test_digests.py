"""Digests of files that no task reads as a whole."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from touchline.operators import ledger


@pytest.fixture
def folder(tmp_path):
    noise = np.random.default_rng(5).bytes(300_000)
    files = {"noise": noise, "fed": noise + b"\n", "two": noise + b"\n\n", "cr": b"\r\n" * 90_000, "marked": b"\xef\xbb\xbf" + noise, "feeds": b"\n" * 100_001, "one + %20line": b"x" * 150_000, "at": noise[:50_000], "over": noise[:50_001], "small": b"PAR1"}
    (tmp_path / "deep").mkdir()
    for k, (name, data) in enumerate(files.items()):
        (tmp_path / ("deep" if k % 2 else ".") / f"{name}.parquet").write_bytes(data)
    (tmp_path / "other.txt").write_bytes(noise)
    return tmp_path, sorted((f"{n}.parquet", len(d), hashlib.sha256(d).hexdigest()) for n, d in files.items())


def test_ranges_give_the_digests_of_whole_files(spark, folder):
    path, want = folder
    spark.conf.set("spark.sql.files.maxPartitionBytes", "40000")
    try:
        got = ledger.digests(spark, f"file://{path}", 50_000)
        assert got.columns == ["name", "length", "sha256"] and sorted(tuple(r) for r in got.collect()) == want
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_no_whole_file_is_asked_of_one_task(spark, folder):
    path, want = folder
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", "50000")  # stands for the 2 GB that a row may have
    try:
        assert sorted(tuple(r) for r in ledger.digests(spark, f"file://{path}", 50_000).collect()) == want
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")


def test_a_file_that_is_not_whole_has_no_digest(spark):
    rows = [("p", 20, 0, bytearray(b"abc")), ("p", 20, 0, bytearray(b"de"))]
    lines = spark.createDataFrame(rows, "path string, length long, start long, line binary")
    with pytest.raises(Exception, match="changed while it was read"):
        ledger._chained(spark, lines.coalesce(1), 4).select(F.max("sha256")).collect()
