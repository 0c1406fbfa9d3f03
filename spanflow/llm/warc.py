"""WARC archives through a chunked record table.

Writing: every page becomes one record.  A payload longer than a chunk is written
as segments, one WARC record per (record id, chunk number); a payload that repeats
that of another record becomes a revisit without a payload.  Chunks are rows of
their own before their headers are written, all by DataFrame functions, so no Python
worker holds a payload.  The archives are
plain WARC 1.1 in gzip part files, written by Spark's own text writer, so that any
store that Spark writes to will do and a lost executor's part is written again.

Reading: archives are split at record boundaries while they are read, so no file
is held in memory.  Whole records get their digest where they are read; segments
are sent to their record's partition, sorted by chunk number, and run through an
incremental digest chunk by chunk.

Defined cases: a NULL payload is an empty one; bytes of a payload or an id that are no
UTF-8 are U+FFFD; a NULL id or url has no header and comes back NULL, an empty one is
an empty header; control characters in urls, and in ids also %, are written as %XX (ids come back as
they were); rows that repeat an id are records of their own (of equal payloads,
all that hold the largest id are responses); an empty table writes no record; other
columns are not read.  A payload may hold anything, also text that looks like a
record boundary: it is cut inside that.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import annotate, quoted, shared_path

#: Characters in a chunk.
CHUNK = 1 << 16
_BREAK = "\r\n\r\n"
_BOUNDARY = "\r\n\r\nWARC/1.1\r\n"
#: Payloads are cut here, so that no chunk holds the start of a record.
_CUT = r"(?<=WARC)(?=/1\.1)"
#: Characters of base 32 (RFC 4648), and those that conv() writes for the same values.
_BASE32, _DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "0123456789ABCDEFGHIJKLMNOPQRSTUV"


def _b32(sha1: bytes) -> str:
    return base64.b32encode(sha1).decode()


def b32(hexed: Column) -> Column:
    """Base 32 of a SHA-1 given as 40 hex digits: 10 of them are 8 characters."""
    parts = [F.lpad(F.conv(F.substring(hexed, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*parts), _DIGITS, _BASE32)


def escaped(text: Column, chars: str) -> Column:
    """``text`` with each of ``chars``, a class of ASCII characters, as %XX."""
    code = F.transform(F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0)), lambda c: F.when(
        c.rlike(chars), F.concat(F.lit("%"), F.hex(c.cast("binary")))).otherwise(c))
    return F.when(text.rlike(chars), F.array_join(code, "")).otherwise(text)


def chunks(body: Column, chunk: int = CHUNK) -> Column:
    """Array of pieces of at most ``chunk`` characters that make up ``body``; none holds the
    start of a record, and an empty text is one empty piece."""
    pieces = F.flatten(F.transform(F.split(body, _CUT, -1), lambda x: F.regexp_extract_all(x, F.lit(f"(?s).{{1,{chunk}}}"), F.lit(0))))
    return F.when(body == "", F.array(F.lit(""))).otherwise(pieces)


def record_texts(rows: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """One WARC record a chunk as ``value``, without the closing line breaks, of rows
    (id, url, body, refers, sha1, size, ordinal), texts but for the numbers ``size`` and ``ordinal``."""
    cut = F.when(F.col("refers").isNull(), chunks(F.col("body"), chunk)).otherwise(F.array(F.lit("")))
    rows = rows.select("id", "url", "refers", "size", "ordinal", b32(F.col("sha1")).alias("digest"), cut.alias("parts"))
    rows = rows.select("id", "url", "refers", "size", "ordinal", "digest", F.size("parts").alias("n"), F.posexplode("parts").alias("k", "part"))
    number = F.col("ordinal").cast("string")
    first = F.concat(F.lit("<urn:x-record:"), number, F.lit(">"))
    own = F.when(F.col("k") == 0, first).otherwise(F.concat(F.lit("<urn:x-record:"), number, F.lit(":"), F.col("k").cast("string"), F.lit(">")))
    again, many = F.col("refers").isNotNull(), F.col("n") > 1

    def header(name: str, value: Column, when: Column | None = None) -> Column:
        text = F.concat(F.lit(f"{name}: "), value)
        return text if when is None else F.when(when, text)
    head = F.concat_ws(
        "\r\n", F.lit("WARC/1.1"),
        header("WARC-Type", F.when(again, "revisit").when(F.col("k") == 0, "response").otherwise("continuation")),
        header("WARC-Record-ID", own), header("X-Page-ID", escaped(F.col("id"), r"[\x00-\x20\x7f%]")),
        header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))), header("X-Payload-Length", F.col("size").cast("string")),
        header("WARC-Target-URI", escaped(F.col("url"), r"[\x00-\x20\x7f]")),
        header("X-Refers-To-Page", escaped(F.col("refers"), r"[\x00-\x20\x7f%]")),
        header("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), again),
        header("Content-Length", F.octet_length("part").cast("string")),
        header("WARC-Segment-Origin-ID", first, many), header("WARC-Segment-Number", (F.col("k") + 1).cast("string"), many),
        header("WARC-Segment-Total-Length", F.col("size").cast("string"), many & (F.col("k") == F.col("n") - 1)))
    return rows.select(F.concat(head, F.lit(_BREAK), F.col("part")).alias("value"))


def write(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", payload: str = "html",
          chunk: int = CHUNK, least_bytes: int = 0) -> None:
    """Write ``pages`` to gzip WARC part files under ``path``.  Of payloads of at
    least ``least_bytes`` that are equal, the largest id is the response."""
    body = F.make_valid_utf8(F.coalesce(quoted(payload).cast("string"), F.lit("")))
    rows = pages.select(quoted(page_id).alias("id"), quoted(url).cast("string").alias("url"), body.alias("body"),
                        F.sha1(body.cast("binary")).alias("sha1"), F.octet_length(body).alias("size"))
    heads = pages.select(quoted(page_id).alias("id"), F.sha1(body.cast("binary")).alias("sha1"), F.octet_length(body).alias("size"))
    held = heads.groupBy("sha1", "size").agg(F.max("id").alias("keeper"), F.count("*").alias("copies"))
    copied = held.where((F.col("copies") > 1) & (F.col("size") >= least_bytes)).drop("copies")
    rows = rows.join(copied, ["sha1", "size"], "left")

    def text(c: Column) -> Column:
        return F.make_valid_utf8(c.cast("string"))
    refers = F.when(~F.col("id").eqNullSafe(F.col("keeper")), text(F.col("keeper")))
    rows = rows.select(text(F.col("id")).alias("id"), text(F.col("url")).alias("url"), "body", "sha1", "size", refers.alias("refers"),
                       F.monotonically_increasing_id().alias("ordinal"))
    record_texts(rows, chunk).write.option("lineSep", _BREAK).option("compression", "gzip").text(path)


_HEADER = re.compile(rb"^([^:\r\n]+): ?([^\r\n]*)\r?$", re.M)
RECORD = [("record", "string"), ("part", "int"), ("page", "string"), ("type", "string"), ("refers_to", "string"),
          ("said_bytes", "bigint"), ("said_digest", "string"), ("bytes", "bigint"), ("digest", "string"), ("data", "binary")]


def _id(fields: dict[bytes, str], name: bytes) -> str | None:
    return unquote(fields[name]) if name in fields else None


def parsed(text: bytes) -> tuple | None:
    """One record of the archive as a row of RECORD; None for what is none.  Only
    segments keep their data."""
    head, found, body = text.partition(b"\r\n\r\n")
    fields = {k.lower(): v.decode() for k, v in _HEADER.findall(head)}
    if not found or b"warc-type" not in fields:
        return None
    body = body[:int(fields.get(b"content-length", 0))]
    kind, number = fields[b"warc-type"], fields.get(b"warc-segment-number")
    said = int(fields.get(b"x-payload-length", 0)), fields.get(b"warc-payload-digest", "").rpartition(":")[2]
    row = (fields.get(b"warc-segment-origin-id", fields.get(b"warc-record-id")), int(number or 1),
           _id(fields, b"x-page-id"), "response" if kind == "continuation" else kind, _id(fields, b"x-refers-to-page"), *said)
    if number:
        return (*row, None, None, body)
    if kind == "revisit":
        return (*row, *said, None)
    return (*row, len(body), _b32(hashlib.sha1(body).digest()), None)


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments, sorted by record and number, to one row a record: the digest is
    carried from chunk to chunk, payloads are never put together."""
    names = [n for n, _ in RECORD[:-1]]
    last = digest = None
    size = 0

    def closed(row: dict) -> dict:
        return {**row, "bytes": size, "digest": _b32(digest.digest())} if digest else row

    schema = None
    for b in batches:
        schema = pa.schema([b.schema.field(n) for n in names])
        done = []
        for row in b.to_pylist():
            data = row.pop("data")
            if last is not None and (row["record"] != last["record"] or data is None):
                done.append(closed(last))
                last = digest = None
            if data is not None:
                if last is None:
                    last, digest, size = row, hashlib.sha1(), 0
                digest.update(data)
                size += len(data)
            else:
                done.append(row)
        if done:
            yield pa.RecordBatch.from_pylist(done, schema)
    if last is not None:
        yield pa.RecordBatch.from_pylist([closed(last)], schema)


def read(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of the archives under ``path``: page, type, refers_to,
    bytes and digest of the full payload, and whether they are as recorded."""
    texts = spark.read.option("lineSep", _BOUNDARY).text(path)

    def make():
        def work(cols):
            rows = [(k, *r) for k, t in enumerate(cols[0]) if (r := parsed(t)) is not None]
            return [list(c) for c in zip(*rows)] if rows else [[] for _ in range(len(RECORD) + 1)]
        return work
    records = annotate(texts, [F.col("value")], RECORD, make, [], explode=True)
    sorted_rows = records.repartition(F.col("record")).sortWithinPartitions("record", "part")
    whole = sorted_rows.mapInArrow(_joined, ", ".join(f"{n} {t}" for n, t in RECORD[:-1]))
    intact = (F.col("bytes") == F.col("said_bytes")) & (F.col("digest") == F.col("said_digest"))
    return whole.select("page", "type", "refers_to", "bytes", "digest", intact.alias("intact"))


def payload_chunks(spark: SparkSession, path: str) -> DataFrame:
    """The chunked record table itself: record, part, page, type and the text of
    each chunk (NULL for revisits)."""
    texts = spark.read.option("lineSep", _BOUNDARY).text(path)
    head = F.substring_index("value", _BREAK, 1)

    def field(name):
        return F.regexp_extract(head, rf"(?m)^{name}: ?([^\r\n]*)", 1)
    body = F.expr("substring(value, locate('\\r\\n\\r\\n', value) + 4)")
    origin = field("WARC-Segment-Origin-ID")
    page = F.url_decode(F.replace(field("X-Page-ID"), F.lit("+"), F.lit("%2B")))
    size = field("Content-Length").cast("int")
    data = F.when(field("WARC-Type") != "revisit", F.substring(body.cast("binary"), F.lit(1), size).cast("string"))
    return texts.where(F.instr("value", "WARC-Type:") > 0).select(
        F.when(origin != "", origin).otherwise(field("WARC-Record-ID")).alias("record"),
        F.coalesce(F.expr("try_cast(nullif(regexp_extract(substring_index(value, '\\r\\n\\r\\n', 1), "
                          "'(?m)^WARC-Segment-Number: ?([0-9]+)', 1), '') as int)"), F.lit(1)).alias("part"),
        F.when(head.rlike("(?m)^X-Page-ID:"), page).alias("page"), field("WARC-Type").alias("type"), data.alias("data"))


def archived(pages: DataFrame, page_id: str = "page_id", url: str = "url", payload: str = "html", chunk: int = CHUNK,
             path: str | None = None) -> DataFrame:
    """Write ``pages`` to archives (in the shared folder unless a path is given)
    and read them back; ids get their own type again."""
    spark = pages.sparkSession
    path = path or shared_path(spark, "warc")
    write(pages, path, page_id, url, payload, chunk)
    kind = pages.schema[page_id].dataType
    return (read(spark, path).withColumn("page", F.col("page").cast(kind))
            .withColumn("refers_to", F.col("refers_to").cast(kind)))
