"""WARC: writing whole-file gzip archives, normalising them to a member for each record, reading by offset.

``write_archives`` writes one gzip stream a file. ``normalise`` inflates each such stream once, from front to back and a
record at a time, rewrites every record as a gzip member of its own and writes a sidecar index of offsets. A long stream
becomes several archives of ``ARCHIVE_BYTES`` or so, so no task holds a whole file. ``read_archives`` takes records out
of the normalised archives by that index alone.

Defined results: a null payload is an empty one; a null id is the largest (its record revisits an equal payload
that has an id, and is a response where none has); rows that repeat both id and payload have the same type; a null
URL leaves its header out; white space and controls in a URL become ``%20``; an empty table writes no record. Other
columns of the input are not read, so their names can't clash.
"""

from __future__ import annotations

import hashlib
import zlib
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.operators.lineage import removed, scratch, tidy_shuffles, written

from .common import table

CRLF = "\r\n"
RECORDS_A_FILE = 1000
#: Bytes of members after which an archive ends, and parts that what refers to one record is dealt into.
ARCHIVE_BYTES, SALTS = 1 << 25, 64
#: What every record begins with; streams are read in pieces between these marks.
MARK = b"WARC/1."
INDEX = "archive string, seq int, offset long, length long, record_id string"


def base32_sha1(hex_digest: Column) -> Column:
    """Upper-case base32 of a SHA-1 given as hex: 40 bits, eight digits at a time."""
    parts = [F.lpad(F.conv(F.substring(hex_digest, i, 10), 16, 32), 8, "0") for i in (1, 11, 21, 31)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _uuid(*cols) -> Column:
    h = F.md5(F.concat_ws("|", *cols))
    return F.concat(F.lit("<urn:uuid:"), *[x for i, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)) for x in (F.substring(h, i, n), F.lit("-" if i < 21 else ">"))])


def records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", least: int = 0) -> DataFrame:
    """A WARC record (string, without the blank lines that end it) for each row of ``pages``.

    Of equal payloads of at least ``least`` bytes the one with the smallest id is a response, the others are
    revisits without payload. The smallest id by digest is summed up before the shuffle; rows of one digest meet it in
    ``SALTS`` parts, each with a row of its own.
    """
    body = F.coalesce(F.col(body_col), F.lit(""))
    p = pages.select(F.col(id_col).cast("long").alias("id"), F.regexp_replace(F.col(url_col), r"[\x00-\x20\x7f]", "%20").alias("url"), body.alias("body"))
    p = p.withColumn("digest", F.sha1(F.encode("body", "utf-8")))
    p = p.withColumn("salt", F.pmod(F.xxhash64("id", "url"), F.lit(SALTS)))
    parts = p.groupBy("digest", "salt").agg(F.min("id").alias("low"))
    first = parts.select("digest", "salt").join(parts.groupBy("digest").agg(F.min("low").alias("first")), "digest")
    p = p.join(first, ["digest", "salt"], "left")
    revisit = (F.octet_length("body") >= least) & ~F.col("id").eqNullSafe(F.col("first"))
    http = F.concat(F.lit(CRLF.join(["HTTP/1.1 200 OK", "Content-Type: text/html; charset=utf-8", "Content-Length: "])), F.octet_length("body"), F.lit(CRLF * 2))
    sha1 = F.concat(F.lit("sha1:"), base32_sha1(F.col("digest")))
    first_id = _uuid(F.lit("response"), F.col("digest"), F.when(F.octet_length("body") < least, F.concat_ws("|", "id", "url")).otherwise(""))
    p = p.withColumn("revisit", revisit).withColumn("block", F.when(revisit, http).otherwise(F.concat(http, "body")))
    head = F.concat_ws(
        CRLF,
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(F.col("revisit"), "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: "), F.when(F.col("revisit"), _uuid(F.lit("revisit"), F.col("digest"), F.col("id"), F.col("url"))).otherwise(first_id)),
        F.lit("WARC-Date: 2024-01-01T00:00:00Z"),
        F.concat(F.lit("WARC-Target-URI: "), F.col("url")),
        F.concat(F.lit("WARC-Payload-Digest: "), sha1),
        F.when(F.col("revisit"), F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.when(F.col("revisit"), F.concat(F.lit("WARC-Refers-To: "), first_id)),
        F.concat(F.lit("X-Page-Id: "), F.col("id")),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.octet_length("block")),
    )
    return p.select(F.concat(head, F.lit(CRLF * 2), F.col("block")).alias("record"))


def write_archives(recs: DataFrame, path: str) -> None:
    """Whole-file gzip archives: Spark's text sink ends each record with the two blank lines that WARC asks for."""
    recs.write.option("lineSep", CRLF * 2).option("compression", "gzip").option("maxRecordsPerFile", RECORDS_A_FILE).text(path)


def _records(pieces):
    """Records of one stream from its pieces between marks; a mark within a payload joins its pieces again."""
    held, size, need = [], 0, None
    for n, piece in enumerate(pieces):
        if n == 0:
            if piece.strip(b"\r\n"):
                raise ValueError("a WARC file begins with something else")
            continue
        held += [MARK, piece]
        size += len(MARK) + len(piece)
        if need is None:
            held = [b"".join(held)]
            if (end := held[0].find(b"\r\n\r\n")) >= 0:
                need = end + 4 + _length(held[0][:end])
        if need is not None and size >= need:
            have = b"".join(held)
            if have[need:].strip(b"\r\n"):
                raise ValueError("a WARC record is longer than it says")
            yield have[:need] + b"\r\n\r\n"
            held, size, need = [], 0, None
    if held:
        raise ValueError("a WARC file ends within a record")


def _fields(head: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("utf-8", "replace").split(CRLF)[1:])}


def _length(head: bytes) -> int:
    return int(_fields(head)["content-length"])


def _member(record: bytes) -> bytes:
    """A gzip member that ends in a zero byte.

    The last byte of a member is the top byte of its length, zero below 16 MiB. Where it isn't, an empty member
    follows; readers see the same bytes.
    """
    gz = zlib.compressobj(6, zlib.DEFLATED, 31)
    out = gz.compress(record) + gz.flush()
    if out[-1]:
        gz = zlib.compressobj(6, zlib.DEFLATED, 31)
        out += gz.compress(b"") + gz.flush()
    return out


_ARCHIVE = pa.schema([("archive", pa.string()), ("offsets", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("record_ids", pa.list_(pa.string())), ("members", pa.list_(pa.binary()))])
ARCHIVE = "archive string, offsets array<long>, lengths array<long>, record_ids array<string>, members array<binary>"


def _members(it):
    """From the pieces of files, one file after another, archives of members."""

    def pieces():
        for batch in it:
            yield from zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)

    for path, part in groupby(pieces(), key=lambda x: x[0]):
        name = f"{hashlib.md5(path.encode()).hexdigest()[:8]}-{path.rpartition('/')[2].removesuffix('.gz')}"
        number, rows, offset = 0, [], 0

        def archive():
            cols = [[f"{name}-{number}"], *([list(x)] for x in zip(*rows, strict=True))]
            return pa.record_batch([pa.array(x, t.type) for x, t in zip(cols, _ARCHIVE, strict=True)], schema=_ARCHIVE)

        for rec in _records(piece for _, piece in part):
            m = _member(rec)
            if rows and offset + len(m) > ARCHIVE_BYTES:
                yield archive()
                number, rows, offset = number + 1, [], 0
            rows.append((offset, len(m), _fields(rec[: rec.find(b"\r\n\r\n")]).get("warc-record-id"), m))
            offset += len(m)
        if rows:
            yield archive()


def normalise(spark: SparkSession, source: str, archives: str, index: str, drop_source: bool = False) -> None:
    """Rewrites whole-file gzip WARCs under ``source`` with a member for each record, and writes their index.

    Spark's text source inflates each file as one stream and hands on what stands between marks, in order, so what a task
    holds are a record and an archive of members. An archive is one row and becomes one file, so its members stay in order
    without a shuffle. Spark's text sink writes the members as they are: each ends in the zero byte that stands as the
    line separator. ``drop_source`` removes the source once all is staged.
    """
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.gz").option("lineSep", MARK.decode()).text(source)
    staged = scratch(spark, "warc-members")
    try:
        with tidy_shuffles(spark):
            files = files.select(F.col("_metadata.file_path").alias("path"), F.col("value").cast("binary").alias("piece"))
            files.mapInArrow(_members, ARCHIVE).write.option("compression", "none").parquet(staged)
            if drop_source:
                removed(spark, source)
            rows = spark.read.schema(ARCHIVE).parquet(staged)
            at = rows.select("archive", F.posexplode(F.arrays_zip("offsets", "lengths", "record_ids")).alias("seq", "at"))
            at.select("archive", "seq", F.col("at.offsets").alias("offset"), F.col("at.lengths").alias("length"), F.col("at.record_ids").alias("record_id")).write.parquet(index)
            line = F.expr("cast(substring(member, 1, length(member) - 1) as string)")
            lines = rows.select("archive", F.explode("members").alias("member")).select("archive", line.alias("line"))
            lines.write.partitionBy("archive").option("lineSep", "\0").text(archives)
    finally:
        removed(spark, staged)


_READ = pa.schema([("record_type", pa.string()), ("record_id", pa.string()), ("refers_to_record", pa.string()), ("url", pa.string()), ("page_id", pa.int64()), ("declared_digest", pa.string()), ("payload", pa.binary()), ("payload_sha1", pa.string())])


def _read(it):
    for batch in it:
        for data, index in zip(batch.column("content"), batch.column("index"), strict=True):
            data, rows = memoryview(data.as_buffer()), []
            for where in index.as_py():
                rec = zlib.decompress(data[where["offset"] : where["offset"] + where["length"]], 31)
                head, _, block = rec.partition(b"\r\n\r\n")
                f = _fields(head)
                if f.get("warc-record-id") != where["record_id"]:
                    raise ValueError("the index names another record")
                block = block[: int(f["content-length"])]
                payload = block.partition(b"\r\n\r\n")[2]
                is_response = f["warc-type"] == "response"
                rows.append((f["warc-type"], f.get("warc-record-id"), f.get("warc-refers-to"), f.get("warc-target-uri"), int(f["x-page-id"]) if "x-page-id" in f else None, f.get("warc-payload-digest", "").rpartition(":")[2], payload if is_response else None, hashlib.sha1(payload).hexdigest() if is_response else None))
                if len(rows) >= 256:
                    yield pa.record_batch([pa.array(x, t.type) for x, t in zip(zip(*rows, strict=True), _READ, strict=True)], schema=_READ)
                    rows = []
            if rows:
                yield pa.record_batch([pa.array(x, t.type) for x, t in zip(zip(*rows, strict=True), _READ, strict=True)], schema=_READ)


def read_archives(spark: SparkSession, archives: str, index: str) -> DataFrame:
    """Every record of normalised archives, each inflated alone at the place that the index gives."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(archives)
    files = files.filter(~F.col("path").rlike(r"/[_.][^/]*$")).select(F.regexp_extract("path", r"archive=([^/]+)/", 1).alias("archive"), "content")
    at = spark.read.schema(INDEX).parquet(index).groupBy("archive").agg(F.collect_list(F.struct("offset", "length", "record_id")).alias("index"))
    schema = "record_type string, record_id string, refers_to_record string, url string, page_id long, declared_digest string, payload binary, payload_sha1 string"
    return files.join(at, "archive").select("content", "index").mapInArrow(_read, schema)


def resolve(recs: DataFrame) -> DataFrame:
    """Records with what revisits refer to; written once, without payloads, as both sides of the join read it.

    Revisits of one record are dealt over ``SALTS`` parts, each of which gets a row of the record, so a record that a
    third of all others refer to isn't met in one task.
    """
    slim = recs.select("record_type", "record_id", "refers_to_record", "url", "page_id", "declared_digest", F.octet_length("payload").cast("long").alias("own_bytes"), "payload_sha1")
    r = written(recs.sparkSession, slim, "warc-read", keep=True).withColumn("own_digest", base32_sha1(F.col("payload_sha1")))
    r = r.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)))
    asked = r.filter("refers_to_record is not null").select("refers_to_record", "salt").distinct()
    first = r.filter("record_type = 'response'").groupBy(F.col("record_id").alias("refers_to_record")).agg(F.min("page_id").alias("first_page"), F.max("own_bytes").alias("first_bytes"), F.max("own_digest").alias("first_digest"))
    r = r.join(asked.join(first, "refers_to_record"), ["refers_to_record", "salt"], "left")
    digest = F.coalesce("own_digest", "first_digest")
    return r.select("page_id", F.coalesce("own_bytes", "first_bytes").alias("payload_bytes"), digest.alias("payload_digest"), "record_type", F.col("first_page").alias("refers_to"), "url", (digest == F.col("declared_digest")).alias("verified"))


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``pages`` written as whole-file gzip WARCs, normalised, and read back by offset."""
    raw, archives, index = (scratch(spark, f"warc-{x}") for x in ("raw", "archives", "index"))
    try:
        with tidy_shuffles(spark):
            write_archives(records(table(spark, sf_dir, "pages")), raw)
        normalise(spark, raw, archives, index, drop_source=True)
        return resolve(read_archives(spark, archives, index)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "verified")
    finally:
        for path in (raw, archives, index):
            removed(spark, path)


OP1_SQL = """
with p as (select page_id, coalesce(html, '') as body from pages),
d as (select page_id, strlen(body) as payload_bytes, sha1(body) as h from p),
f as (select h, min(page_id) as first_page from d group by h),
k as (select d.page_id, d.payload_bytes, f.first_page, d.h from d join f using (h)),
b as (select h, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        cast((cast('0x' || substr(h, 10 * (i // 8) + 1, 10) as bigint) >> (35 - 5 * (i % 8))) & 31 as int) + 1, 1), '' order by i) as digest
      from (select distinct h from k), range(32) as r(i) group by h)
select page_id, cast(payload_bytes as bigint) as payload_bytes, digest as payload_digest,
       case when page_id = first_page then 'response' else 'revisit' end as record_type,
       case when page_id <> first_page then first_page end as refers_to, true as verified
from k join b using (h)
"""
