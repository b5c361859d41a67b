"""Media columns: payloads as 8-bit WAV, cut at content-defined places, stored once a chunk, rebuilt and verified.

``media_of`` makes a mono 8-bit PCM WAV of a text's bytes. ``cut`` finds chunk ends with a rolling gear hash over 32
bytes, so equal stretches are cut alike wherever they stand. ``chunk`` cuts and hashes every payload once, and stages
ordered chunk lists and the chunks that a task hasn't sent yet. ``write_chunks`` stores each distinct chunk once, by its
SHA-256: a left-anti join drops what the store has already, and of equal chunks, which sorting brings together, the first
stays. ``rebuild`` joins the lists with the store, puts media together again and verifies each chunk and each medium.

Defined results: a null text is an empty one; an empty text is a payload of 192 blanks; rows that repeat doc_id, text or
both each give a row; an empty table stores nothing. Only the named columns are read, so others can't clash.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from functools import reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.operators.lineage import removed, scratch, tidy_shuffles, workspace, written

from .common import table, total, utf8

UNIT, RATE = 192, 8000
#: Parts by digest that chunks are stored in, and by medium that media are rebuilt in, one after another.
STORED, REBUILT = 6, 3
#: A chunk's least and greatest size, and how many high bits of the hash are zero where one ends.
LEAST, MOST, ZEROS = 1 << 10, 1 << 14, 12
#: Bytes of media that a bucket of the store holds before chunks are shared and compressed.
BUCKET_BYTES = 1 << 27
#: Gear values by a rule: the low 32 bits of SplitMix64 from each byte value.
_Z = (np.arange(1, 257, dtype="u8") * np.uint64(0x9E3779B97F4A7C15))
_Z = (_Z ^ (_Z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
GEAR = ((_Z ^ (_Z >> np.uint64(27))) >> np.uint64(16)).astype("u4")
HEADER = 44


def media_of(text: bytes) -> bytes:
    """A WAV file whose samples are ``text`` and blanks up to a positive multiple of 192."""
    size = max(1, -(-len(text) // UNIT)) * UNIT
    head = b"RIFF" + struct.pack("<I", 36 + size) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, RATE, RATE, 1, 8) + b"data" + struct.pack("<I", size)
    return head + text + b" " * (size - len(text))


def cut(data: bytes) -> list[int]:
    """Ends of the chunks of ``data``: after bytes where the gear hash of 32 bytes has ``ZEROS`` high zero bits.

    A chunk has 1 to 16 KiB; only the last may be shorter. Works on pieces, so a long payload takes little memory.
    """
    n, piece, found = len(data), 1 << 20, []
    if n > LEAST:
        raw = np.frombuffer(data, "u1")
        for at in range(0, n, piece):
            lo = max(0, at - 31)
            h = GEAR[raw[lo : at + piece]]
            for m in (1, 2, 4, 8, 16):
                rolled = h.copy()
                rolled[m:] += h[:-m] << np.uint32(m)
                h = rolled
            found += (np.flatnonzero((h[at - lo :] >> np.uint32(32 - ZEROS)) == 0) + at + 1).tolist()
    ends, last = [], 0
    for end in [*found, n]:
        while end - last > MOST:
            last += MOST
            ends.append(last)
        if end - last >= LEAST or end == n and end > last:
            ends.append(end)
            last = end
    return ends


_STAGED = pa.schema([("wave", pa.int32()), ("media_key", pa.string()), ("chunks", pa.list_(pa.binary())), ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("digest", pa.binary()), ("size", pa.int32()), ("data", pa.binary())])
LISTED, STORE = "media_key string, chunks array<binary>, doc_id long, n_bytes long", "digest binary, size int, data binary"
#: The part that lists are in.
LISTS = -1


def _staged(it):
    """A row for each payload with its chunks' digests, and one for each chunk that the task hasn't sent yet."""
    z, seen = zstandard.ZstdCompressor(level=3), set()
    for batch in it:
        rows, held = [], 0
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            text = text.as_py()
            media, last, digests = media_of(text), 0, []
            for end in cut(media):
                c = media[last:end]
                last = end
                d = hashlib.sha256(c).digest()
                digests.append(d)
                if d not in seen:
                    if len(seen) > 200_000:  # only what a task sends twice depends on this
                        seen.clear()
                    seen.add(d)
                    rows.append((d[-1] % STORED, None, None, None, None, d, len(c), z.compress(c)))
                    held += len(rows[-1][-1])
            rows.append((LISTS, hashlib.sha256(media).hexdigest(), digests, doc, len(text), None, None, None))
            if held > 1 << 22 or len(rows) > 10_000:
                yield pa.record_batch([pa.array(x, t.type) for x, t in zip(zip(*rows, strict=True), _STAGED, strict=True)], schema=_STAGED)
                rows, held = [], 0
        if rows:
            yield pa.record_batch([pa.array(x, t.type) for x, t in zip(zip(*rows, strict=True), _STAGED, strict=True)], schema=_STAGED)


def chunk(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(media_key, chunks: ordered digests, doc_id, n_bytes) for each row; the chunks themselves are staged under ``path``."""
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), utf8(text_col).alias("payload"))
    rows.mapInArrow(_staged, f"wave int, {LISTED}, {STORE}").write.option("compression", "zstd").partitionBy("wave").parquet(path)
    return _part(docs.sparkSession, path, LISTED, LISTS)


def _part(spark: SparkSession, path: str, columns: str, wave: int) -> DataFrame:
    return spark.read.schema(f"{columns}, wave int").parquet(path).filter(F.col("wave") == wave).drop("wave")


def write_chunks(spark: SparkSession, path: str, store: str, existing: DataFrame | None = None, buckets: int = 1) -> DataFrame:
    """Moves staged chunks that ``existing`` lacks to the table ``store``, one row a digest, bucketed by digest; returns it.

    A task has staged a chunk once, so a chunk that many rows share makes few rows. Chunks move in ``STORED`` parts by
    their digest, and a part is no longer staged once it is stored, so that only a part of them is on disk twice.
    """
    for wave in range(STORED):
        new = _part(spark, path, STORE, wave)
        if existing is not None:
            new = new.join(existing.select("digest"), "digest", "left_anti")
        new = new.repartition(buckets, "digest").sortWithinPartitions("digest").mapInArrow(_once, STORE)
        new.write.option("compression", "none").bucketBy(buckets, "digest").mode("append" if wave else "overwrite").saveAsTable(store)
        removed(spark, f"{path}/wave={wave}")
    return spark.table(store)


def _once(it):
    """Of rows sorted by digest the first of each."""
    last = None
    for batch in it:
        keep = []
        for d in batch.column(0).to_pylist():
            keep.append(d != last)
            last = d
        yield batch.filter(pa.array(keep, pa.bool_()))


_MEDIA = pa.schema([("media_key", pa.string()), ("media", pa.binary())])


def _assemble(it):
    """Rows sorted by (media_key, seq) to whole media, each chunk verified by its digest and each medium by its key."""
    z, key, parts = zstandard.ZstdDecompressor(), None, []

    def done():
        media = b"".join(parts)
        if hashlib.sha256(media).hexdigest() != key:
            raise ValueError(f"medium {key} was not rebuilt as it was")
        return pa.record_batch([pa.array([key], pa.string()), pa.array([media], pa.binary())], schema=_MEDIA)

    for batch in it:
        for k, digest, size, data in zip(*(batch.column(i) for i in range(4)), strict=True):
            if key is not None and k.as_py() != key:
                yield done()
                parts = []
            key = k.as_py()
            c = z.decompress(data.as_py(), max_output_size=size.as_py())
            if hashlib.sha256(c).digest() != digest.as_py():
                raise ValueError("a chunk differs from its digest")
            parts.append(c)
    if key is not None:
        yield done()


def _joined(lists: DataFrame, store: DataFrame, heavy: int = 1000) -> DataFrame:
    """(media_key, seq, digest, size, data) for each distinct medium.

    Equal media are rebuilt once. Digests that more than a ``heavy``-th of all references name are fewer than
    ``heavy`` by count, so they are broadcast (16 MiB at most); the others meet the store by its buckets.
    """
    media = lists.groupBy("media_key").agg(F.first("chunks").alias("chunks"))
    refs = media.select("media_key", F.posexplode("chunks").alias("seq", "digest"))
    n = refs.count()
    hot = refs.groupBy("digest").agg(F.count("*").alias("n")).filter((F.col("n") > 100) & (F.col("n") * heavy > n)).select("digest").collect()
    hot = [r["digest"] for r in hot]
    if not hot:
        return refs.join(store.hint("merge"), "digest")
    hot_rows = store.filter(F.col("digest").isin(hot))
    rest = refs.filter(~F.col("digest").isin(hot)).join(store.hint("merge"), "digest")
    return rest.unionByName(refs.join(F.broadcast(hot_rows), "digest"))


def rebuild(lists: DataFrame, store: DataFrame) -> DataFrame:
    """(media_key, media) for each distinct medium of ``lists``, put together from the store and verified."""
    rows = _joined(lists, store).select("media_key", "digest", "size", "data", "seq")
    rows = rows.repartition("media_key").sortWithinPartitions("media_key", "seq")
    return rows.mapInArrow(_assemble, "media_key string, media binary")


_FEATURES = pa.schema([("media_key", pa.string()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])
FEATURES = "media_key string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _features(it):
    for batch in it:
        rows = []
        for key, media in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            media = media.as_py()
            payload = media[HEADER:]
            x = np.frombuffer(payload, "u1")
            energy = int(np.abs(x.astype("i4") - 128).sum())
            turns = int(np.count_nonzero(np.diff(x.astype("i2") >= 128)))
            feature = f"mean={int(x.sum(dtype='i8')) // len(x)};energy={energy // len(x)};turns={turns};peak={int(x.max())}"
            rows.append((key, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature))
        if rows:
            yield pa.record_batch([pa.array(x, t.type) for x, t in zip(zip(*rows, strict=True), _FEATURES, strict=True)], schema=_FEATURES)


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as chunked WAV media, read back from the chunk store."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    name, path = f"media_{uuid.uuid4().hex}", scratch(spark, "media-staged")
    try:
        with workspace(spark):
            with tidy_shuffles(spark):
                lists = chunk(docs, path)
                buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total(lists, "n_bytes") // BUCKET_BYTES)
                store = write_chunks(spark, path, name, buckets=buckets)
            got = []
            for wave in range(REBUILT):
                part = lists.filter(F.pmod(F.crc32("media_key"), F.lit(REBUILT)) == wave)
                got.append(written(spark, rebuild(part, store).mapInArrow(_features, FEATURES), "media-features"))
            out = lists.select("doc_id", "n_bytes", "media_key").join(reduce(DataFrame.union, got), "media_key")
            out = out.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
            return written(spark, out, "media-result", keep=True)
    finally:
        removed(spark, path)
        spark.sql(f"drop table if exists {name}")
