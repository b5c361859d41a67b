"""A ledger that remembers: Parquet parts and numbered manifests in a shared folder, appended to and never rewritten.

A manifest names the parts of its version and is created only if no other has its number, so of two appends at once one
gets the next number and the other begins again from what the first has added. A reader takes one manifest and sees whole
appends only. What an append adds is decided by an anti join against what is there, so running it again adds nothing.
Digests of the files are recorded with each part, by Spark, and verified by reading the files again.
"""

from __future__ import annotations

import ctypes
import json
import threading
import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .lineage import cut, removed, workspace, written
from .store import append_new

#: The local file system looks for a file and creates it in two steps; there, one driver is all there is.
_LOCAL = threading.Lock()


#: A file of more bytes isn't read by one task, but in ranges of so many or a split of Spark's, whichever is more.
RANGE = 64 << 20
_PIECE = "path string, length long, start long, no long, bytes binary"
_STATE = "path string, length long, done long, state binary, sha256 string"


def digests(spark: SparkSession, path: str, most: int = RANGE) -> DataFrame:
    """(name, length, sha256) of each Parquet file below a folder; of files above ``most`` bytes a task has a range only."""
    options = {"recursiveFileLookup": "true", "pathGlobFilter": "*.parquet"}
    f = spark.read.format("binaryFile").options(**options).load(path)
    whole = f.filter(F.col("length") <= most).select(F.regexp_extract("path", "[^/]+$", 0).alias("name"), "length", F.sha2("content", 256).alias("sha256"))
    if f.filter(F.col("length") > most).select("path").isEmpty():
        return whole
    lines = spark.read.options(**options, lineSep="\n").text(path).filter(F.col("_metadata.file_size") > most)
    of_file = [F.col(f"_metadata.{c}").alias(a) for c, a in (("file_path", "path"), ("file_size", "length"), ("file_block_start", "start"))]
    return whole.union(_chained(spark, lines.select(*of_file, F.col("value").cast("binary").alias("line")), most))


def _chained(spark: SparkSession, lines: DataFrame, most: int) -> DataFrame:
    """Digests of files from their ``lines``: what SHA-256 has come to is passed on from one range of a file to the next.

    SHA-256 runs through its bytes in order, so a file takes as many rounds as it has ranges; files go side by side. Splits
    are read once, side by side, and their bytes are kept in a scratch table until the rounds are over.
    """
    with workspace(spark):
        pieces = cut(lines.mapInArrow(_pieces, _PIECE).withColumn("round", F.floor(F.col("start") / most)), "digest-pieces")
        files = pieces.groupBy("path", "length").agg(F.sum(F.length("bytes")).alias("got"))
        # the reader of lines leaves out a mark of byte order at the start of a file
        state = files.select("path", "length", F.lit(0).cast("long").alias("done"), F.when(F.col("got") < F.col("length"), F.lit(b"\xef\xbb\xbf")).otherwise(F.lit(b"")).alias("state"), F.lit(None).cast("string").alias("sha256"))
        for r in sorted(x["round"] for x in pieces.select("round").distinct().collect()):
            now = pieces.filter(F.col("round") == r).select("path", "start", "no", "bytes")
            state = cut(state.groupBy("path").cogroup(now.groupBy("path")).applyInPandas(_hashed, _STATE), "digest-states")
        # metadata give a path as URI does: %, spaces and the like are escaped in it, and a plus is a plus
        name = F.url_decode(F.replace(F.regexp_extract("path", "[^/]+$", 0), F.lit("+"), F.lit("%2B"))).alias("name")
        return written(spark, state.select(name, "length", F.coalesce("sha256", F.raise_error(F.concat(F.lit("changed while it was read: "), "path"))).alias("sha256")), "digests", keep=True)


def _pieces(batches):
    """The lines of a batch and split as one piece, each with its line feed, numbered in the order of reading."""
    no = 0
    for b in batches:
        n = len(b)
        if not n:
            continue
        new = pc.or_(pc.not_equal(b["path"][1:], b["path"][:-1]), pc.not_equal(b["start"][1:], b["start"][:-1]))
        first = np.r_[0, np.flatnonzero(new.to_numpy(zero_copy_only=False)) + 1, n]
        for i, j in zip(first[:-1], first[1:], strict=True):
            of_file = {c: b[c][i : i + 1] for c in ("path", "length", "start")}
            piece = b"\n".join([*b["line"][i:j].to_pylist(), b""])
            yield pa.RecordBatch.from_pydict({**of_file, "no": pa.array([no], pa.int64()), "bytes": pa.array([piece], pa.binary())})
            no += 1


def _hashed(state: pd.DataFrame, pieces: pd.DataFrame) -> pd.DataFrame:
    """``state`` of a file after its next pieces, and its digest at its end.

    The state is OpenSSL's SHA256_CTX, 112 bytes that may be copied; ``hashlib`` has the same code but keeps it to itself.
    """
    import _hashlib

    lib = ctypes.CDLL(_hashlib.__file__)
    row = state.iloc[0].to_dict()
    if row["sha256"] or not len(pieces):
        return state
    size, done, lead = int(row["length"]), int(row["done"]), b""
    if done:
        ctx = ctypes.create_string_buffer(row["state"], 112)
    else:
        ctx, lead = ctypes.create_string_buffer(112), row["state"]
        lib.SHA256_Init(ctx)
    for piece in (lead, *pieces.sort_values(["start", "no"])["bytes"]):
        # the last line of a file may have no line feed
        left = piece[: size - done] if len(piece) == size - done + 1 else piece
        lib.SHA256_Update(ctx, left, ctypes.c_size_t(len(left)))
        done += len(left)
    if done == size:
        out = ctypes.create_string_buffer(32)
        lib.SHA256_Final(out, ctypes.create_string_buffer(ctx.raw, 112))
        row["sha256"] = out.raw.hex()
    return pd.DataFrame([{**row, "done": done, "state": ctx.raw}])


class Ledger:
    """Rows of one schema under ``path``, one for each value of ``keys`` (nulls are equal)."""

    def __init__(self, spark: SparkSession, path: str, schema, keys: list[str]):
        self.spark, self.path, self.schema, self.keys = spark, path.rstrip("/"), schema, keys

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        p, fs = self._fs(f"{self.path}/manifests")
        return sorted(int(x.getPath().getName()) for x in fs.listStatus(p)) if fs.exists(p) else []

    def parts(self, version: int | None = None) -> list[str]:
        """The parts of a version, the newest if none is named; none before the first."""
        known = self.versions()
        version = version if version is not None else known[-1] if known else 0
        if not version:
            return []
        p, fs = self._fs(f"{self.path}/manifests/{version}")
        stream = fs.open(p)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def read(self, version: int | None = None) -> DataFrame:
        parts = self.parts(version)
        if not parts:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/parts/{x}" for x in parts])

    def _committed(self, version: int, parts: list[str]) -> bool:
        p, fs = self._fs(f"{self.path}/manifests/{version}")
        with _LOCAL:
            if fs.exists(p):
                return False
            try:
                out = fs.create(p, False)
            except Exception as e:  # another driver was first
                if "AlreadyExists" in str(e):
                    return False
                raise
            out.write(bytearray(json.dumps(parts).encode()))
            out.close()
        return True

    def append(self, df: DataFrame) -> int:
        """Adds the rows whose key isn't there and gives back how many; always a new version, of whole appends."""
        while True:
            known = self.versions()
            version = known[-1] if known else 0
            before, part = self.parts(version), uuid.uuid4().hex
            rows = append_new(self.read(version), df.select(*self.schema.fieldNames()), self.keys)
            path = f"{self.path}/parts/{part}"
            rows.write.parquet(path)
            digests(self.spark, path).write.parquet(f"{self.path}/digests/{part}")
            if self._committed(version + 1, [*before, part]):
                return self.spark.read.schema(self.schema).parquet(path).count()
            for x in (path, f"{self.path}/digests/{part}"):
                removed(self.spark, x)

    def verified(self, version: int | None = None) -> DataFrame:
        """One row: files of a version that changed, that are missing, that nobody recorded, and keys that stand twice."""
        parts = self.parts(version)
        twice = self.read(version).groupBy(*self.keys).agg(F.count("*").alias("n")).agg(F.count_if(F.col("n") > 1).alias("twice"))
        if not parts:
            return twice.select(*[F.lit(0).cast("long").alias(x) for x in ("changed", "missing", "added")], "twice")
        then = self.spark.read.schema("name string, length long, sha256 string").parquet(*[f"{self.path}/digests/{x}" for x in parts])
        now = digests(self.spark, f"{self.path}/parts/{{{','.join(parts)}}}").withColumnsRenamed({"length": "length_now", "sha256": "sha256_now"})
        j = then.join(now, "name", "full")
        changed = F.count_if(F.col("sha256") != F.col("sha256_now"))
        return j.agg(changed.alias("changed"), F.count_if(F.col("sha256_now").isNull()).alias("missing"), F.count_if(F.col("sha256").isNull()).alias("added")).join(F.broadcast(twice))
