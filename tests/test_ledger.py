"""The ledger that remembers: versions, appends at once, what an append adds, and verification."""

import threading
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from touchline.operators.ledger import Ledger


@pytest.fixture
def ledger(spark, tmp_path):
    return Ledger(spark, f"file://{tmp_path}/ledger", spark.createDataFrame([], "k long, v string").schema, ["k"])


def rows(spark, *ks, v="x"):
    return spark.createDataFrame([(k, v) for k in ks], "k long, v string").withColumn("more", F.lit(1))


def test_appends_add_what_is_not_there(spark, ledger):
    assert ledger.read().count() == 0 and ledger.versions() == []
    assert ledger.append(rows(spark, 1, 2, None)) == 3
    assert ledger.append(rows(spark, 2, 3, None, v="y")) == 1
    assert ledger.append(rows(spark, 2, 3, None, v="z")) == 0
    assert sorted(map(str, ledger.read().collect())) == sorted(map(str, [*rows(spark, 1, 2, None).drop("more").collect(), *rows(spark, 3, v="y").drop("more").collect()]))
    assert [ledger.read(n).count() for n in ledger.versions()] == [3, 4, 4]
    assert tuple(ledger.verified().first()) == (0, 0, 0, 0)


def test_two_appends_at_once_add_every_row_once(spark, ledger):
    barrier, added = threading.Barrier(3), []
    def add(*ks):
        barrier.wait()
        added.append(ledger.append(rows(spark, *ks)))

    threads = [threading.Thread(target=add, args=ks) for ks in ((1, 2, 3), (2, 3, 4), (3, 4, 5))]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sum(added) == 5 and ledger.versions() == [1, 2, 3]
    assert sorted(r["k"] for r in ledger.read().collect()) == [1, 2, 3, 4, 5]
    assert tuple(ledger.verified().first()) == (0, 0, 0, 0)


def test_a_flipped_byte_a_lost_and_a_foreign_file_are_found(spark, ledger, tmp_path):
    for k in (1, 2, 3):
        ledger.append(rows(spark, k))
    files = sorted(Path(tmp_path).rglob("parts/**/*.parquet"))
    assert len(files) > 2
    raw = bytearray(files[0].read_bytes())
    raw[len(raw) // 2] ^= 1
    files[0].write_bytes(raw)
    for crc in Path(tmp_path).rglob("parts/**/.*.crc"):
        crc.unlink()
    files[1].rename(files[1].with_name("part-foreign.parquet"))
    found = ledger.verified().select("changed", "missing", "added")
    assert tuple(found.first()) == (1, 1, 1)
