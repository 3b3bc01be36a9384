"""Legacy web archives (ARC) converted to WARC.

An ARC file starts with a version block (`filedesc://`) that says which fields the one-line record
headers have: version 1 has five, version 2 ten. Each header ends in the length of the record that
follows. The converter reads those lines and lengths, and makes up what WARC wants: record ids,
dates, types and digests. Records whose payload was archived before become revisit records.

Archives are written by Spark's text writer, whose line separator is the blank pair that ends a WARC
record (a line feed for ARC), and read as binary files, so both may lie in any store Spark knows.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm.common import load, query, staged
from paperloom.session import shared_folder

# Fixed values of the ARC format, by version: the record fields named in the version block.
ARC_FIELDS = {
    1: ("URL", "IP-address", "Archive-date", "Content-type", "Archive-length"),
    2: ("URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"),
}
# Records of a file; a file is read as one value, so this bounds what a task holds.
FILE_RECORDS = 1000
# Payloads below this many bytes are never revisits.
REVISIT_BYTES = 1000
KEY = "X-Page-Id"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

RECORD_SCHEMA = "archive string, at long, version int, url string, ip string, date string, mime string, status int, key string, head binary, payload binary, digest string"
WARC_SCHEMA = "archive string, warc_id string, warc_type string, warc_date string, url string, key string, digest string, refers_to string, payload_bytes long, payload_digest string"


def _field(text: Column) -> Column:
    """A value without blanks for a header line; `-` for null or empty."""
    clean = F.regexp_replace(F.regexp_replace(text, r"[\x00-\x20\x7f]", "%20"), "^-?$", "-")
    return F.coalesce(clean, F.lit("-"))


def write_arc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", file_records: int = FILE_RECORDS) -> None:
    """Pages as gzipped ARC files of file_records records, of version 1 and 2 in turn.

    Ids are kept in a field of the archived HTTP head. Null html is an empty payload, a null url is
    written `-`, a null id as an empty field.
    """
    body = F.coalesce(F.col(html_col), F.lit(""))
    head = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" + KEY + ": "),
        F.coalesce(F.col(id_col).cast("string"), F.lit("")),
        F.lit("\r\nContent-Length: "), F.octet_length(body), F.lit("\r\n\r\n"),
    )
    row = F.monotonically_increasing_id()
    within = row.bitwiseAND((1 << 33) - 1)
    version = 1 + F.pmod(F.shiftright(row, 33) + F.floor(within / file_records), F.lit(2))
    date = F.date_format(F.timestamp_seconds(F.lit(852076800) + F.coalesce(F.col(id_col).cast("long"), F.lit(0)) % 86400), "yyyyMMddHHmmss")
    rows = pages.select(head.alias("head"), body.alias("body"), version.alias("version"), (within % file_records == 0).alias("opens"), _field(F.col(url_col)).alias("url"), date.alias("date"))
    length = (F.octet_length("head") + F.octet_length("body")).cast("string")
    tail = {1: F.lit(""), 2: F.concat(F.lit(" 200 - - 0 pages.arc"))}
    block = {v: f"{v} 0 Pages\n{' '.join(ARC_FIELDS[v])}\n" for v in ARC_FIELDS}
    desc = {
        1: f"filedesc://pages.arc 0.0.0.0 19970101000000 text/plain {len(block[1])}\n{block[1]}\n",
        2: f"filedesc://pages.arc 0.0.0.0 19970101000000 text/plain 200 - - 0 pages.arc {len(block[2])}\n{block[2]}\n",
    }
    by = lambda of: F.when(F.col("version") == 1, of[1]).otherwise(of[2])
    line = F.concat(
        F.when(F.col("opens"), by({v: F.lit(d) for v, d in desc.items()})).otherwise(""),
        F.col("url"), F.lit(" 127.0.0.1 "), F.col("date"), F.lit(" text/html"), by(tail), F.lit(" "), length, F.lit("\n"),
        F.col("head"), F.col("body"),
    )
    rows.select(line.alias("value")).write.option("lineSep", "\n").option("compression", "gzip").option("maxRecordsPerFile", file_records).text(path)


def _opened(content: bytes) -> io.BufferedIOBase:
    raw = io.BytesIO(content)
    return gzip.GzipFile(fileobj=raw) if content[:2] == b"\x1f\x8b" else raw


# What a damaged gzip file raises.
BROKEN = (EOFError, zlib.error, gzip.BadGzipFile)


def _size(field: bytes | str) -> int | None:
    """A declared length or version: digits, at most as many as a file can need."""
    return int(field) if len(field) <= 18 and field.isdigit() and field.isascii() else None


def arc_records(archive: str, content: bytes) -> Iterator[tuple]:
    """Records of one ARC file, as its version's header lines and declared lengths give them.

    A file that ends within a record, a header line of the wrong form or a damaged gzip part ends the
    file there: what was whole before it is returned.
    """
    stream = _opened(content)
    version, at = 0, 0
    try:
        while line := stream.readline():
            fields = line.rstrip(b"\r\n").split(b" ")
            if fields == [b""]:
                at += len(line)
                continue
            if line.startswith(b"filedesc://"):
                size = _size(fields[-1])
                block = b"" if size is None else stream.read(size)
                number = _size(block.split(b" ", 1)[0])
                if size is None or len(block) < size or number is None:
                    return
                version = number
                at += len(line) + len(block)
                continue
            if version not in ARC_FIELDS or len(fields) != len(ARC_FIELDS[version]) or _size(fields[-1]) is None:
                return
            size = _size(fields[-1])
            record = stream.read(size)
            if len(record) < size:
                return
            named = dict(zip(ARC_FIELDS[version], (f.decode("utf-8", "replace") for f in fields)))
            head, split, payload = record.partition(b"\r\n\r\n")
            if not split or not head.startswith(b"HTTP/"):
                head, payload = b"", record
            key = re.search(rb"(?im)^" + KEY.encode() + rb": *([^\r\n]*)", head)
            status = re.match(rb"HTTP/\S+ (\d{3})", head)
            yield (
                archive, at, version, named["URL"], named["IP-address"], named["Archive-date"], named["Content-type"],
                int(named["Result-code"]) if named.get("Result-code", "-").isdigit() else int(status[1]) if status else None,
                key[1].decode("utf-8", "replace") if key else "", head, payload, hashlib.sha1(payload).hexdigest(),
            )
            at += len(line) + size
    except BROKEN:
        return


def _from_files(spark: SparkSession, path: str, ddl: str, records, drop: tuple[str, ...] = ()) -> DataFrame:
    """One row per record of the archives below a folder; records are handed on in small batches."""
    from pyspark.sql.types import StructType

    schema = StructType.fromDDL(ddl)
    keep = [i for i, f in enumerate(schema.fields) if f.name not in drop]
    schema = StructType([schema.fields[i] for i in keep])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        kind = to_arrow_schema(schema)

        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), kind)], schema=kind)

        for batch in batches:
            for i in range(batch.num_rows):
                rows = []
                for record in records(batch.column(0)[i].as_py(), batch.column(1)[i].as_py()):
                    rows.append([record[k] for k in keep])
                    if len(rows) == 64:
                        yield batch_of(rows)
                        rows = []
                if rows:
                    yield batch_of(rows)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, schema)


def read_arc(spark: SparkSession, path: str, drop: tuple[str, ...] = ()) -> DataFrame:
    """Records of the ARC files below a folder; columns as RECORD_SCHEMA, less those in drop."""
    return _from_files(spark, path, RECORD_SCHEMA, arc_records, drop)


def _record_id(archive: Column, at: Column) -> Column:
    """The same urn:uuid for the same record of the same file, version digit 5 as for names."""
    h = F.sha1(F.concat_ws("#", F.regexp_extract(archive, "[^/]*$", 0), at.cast("string")))
    cut = lambda a, n: F.substring(h, a, n)
    return F.concat(F.lit("<urn:uuid:"), cut(1, 8), F.lit("-"), cut(9, 4), F.lit("-5"), cut(14, 3), F.lit("-a"), cut(18, 3), F.lit("-"), cut(21, 12), F.lit(">"))


def firsts(records: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """Of each payload that occurs more than once: (digest, length, archive, at, key) of its response.

    That is the record with the largest numeric key, then the last in the archives; summed per task
    before the shuffle, whatever the number of copies.
    """
    return (
        records.filter(F.col("bytes") >= least)
        .groupBy("digest", "bytes")
        .agg(F.max(F.struct(F.col("key").try_cast("long").alias("number"), "key", "archive", "at")).alias("first"), F.count("*").alias("n"))
        .filter("n > 1")
        .select("digest", "bytes", "first.*")
    )


def convert(spark: SparkSession, arc_path: str, warc_path: str, least: int = REVISIT_BYTES, file_records: int = FILE_RECORDS) -> None:
    """Write every ARC record as a WARC record: response, or revisit of the response with its payload.

    The first pass over the archives takes digests alone. Who is the response goes to a table of the
    repeated payloads only, which Spark broadcasts where its written size allows and joins by a
    shuffle where not; payloads are shuffled in the second case alone.
    """
    slim = read_arc(spark, arc_path, drop=("head", "mime", "ip", "url", "date", "status")).select("archive", "at", "key", "digest", F.octet_length("payload").alias("bytes"))
    repeated = staged(firsts(slim, least).select(F.col("digest").alias("_digest"), F.col("bytes").alias("_bytes"), F.col("archive").alias("_archive"), F.col("at").alias("_at"), F.col("key").alias("_key")), "arc-firsts")
    records = read_arc(spark, arc_path).withColumn("bytes", F.octet_length("payload"))
    joined = records.join(repeated, (F.col("digest") == F.col("_digest")) & (F.col("bytes") == F.col("_bytes")), "left")
    revisit = F.col("_digest").isNotNull() & ~((F.col("archive") == F.col("_archive")) & (F.col("at") == F.col("_at")))
    when = F.regexp_replace("date", r"^(\d{4})(\d\d)(\d\d)(\d\d)(\d\d)(\d\d)$", "$1-$2-$3T$4:$5:$6Z")
    http = F.concat(F.col("head"), F.lit("\r\n\r\n").cast("binary"))
    has_head = F.octet_length("head") > 0
    block = F.concat(F.when(has_head, http).otherwise(F.lit("").cast("binary")), F.when(revisit, F.lit("").cast("binary")).otherwise(F.col("payload")))
    made = joined.select(
        F.when(revisit, "revisit").when(has_head, "response").otherwise("resource").alias("type"),
        _record_id(F.col("archive"), F.col("at")).alias("id"), when.alias("date"), "url", "ip", "key", "digest", "bytes", block.alias("block"),
        F.when(revisit, _record_id(F.col("_archive"), F.col("_at"))).alias("refers"), F.when(revisit, F.col("_key")).alias("refers_key"), has_head.alias("has_head"), "mime",
    )
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.col("type")), line("WARC-Record-ID", F.col("id")), line("WARC-Date", F.col("date")),
        line("WARC-Target-URI", F.col("url")), line("WARC-IP-Address", F.col("ip")), line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        line(KEY, F.col("key")), line("X-Payload-Length", F.col("bytes").cast("string")),
        F.when(F.col("refers").isNotNull(), F.concat(line("WARC-Profile", F.lit(PROFILE)), line("WARC-Refers-To", F.col("refers")), line("X-Refers-To-Page-Id", F.col("refers_key")))).otherwise(""),
        line("Content-Type", F.when(F.col("has_head"), "application/http; msgtype=response").otherwise(F.col("mime"))),
        line("Content-Length", F.octet_length("block").cast("string")), F.lit("\r\n"),
    )
    # The text writer puts the bytes down as they are, then the separator.
    made.select(F.concat(head.cast("binary"), F.col("block")).cast("string").alias("value")).write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", file_records).text(warc_path)


def warc_records(archive: str, content: bytes) -> Iterator[tuple]:
    """Records of one WARC file, by their declared lengths; payload figures from the payload itself,
    for a revisit from its header. A file that ends within a record, or has one without a type, an id
    or a length, gives the whole ones before it; other headers may be missing and are null."""
    stream = _opened(content)
    try:
        while line := stream.readline():
            if not line.startswith(b"WARC/"):
                if line.strip():
                    return
                continue
            named: dict[str, str] = {}
            while (line := stream.readline()) not in (b"\r\n", b""):
                name, _, value = line.decode("utf-8", "replace").rstrip("\r\n").partition(": ")
                named[name.lower()] = value.strip()
            size = _size(named.get("content-length", ""))
            if size is None or "warc-type" not in named or "warc-record-id" not in named:
                return
            block = stream.read(size)
            if len(block) < size:
                return
            kind = named["warc-type"]
            payload = block.partition(b"\r\n\r\n")[2] if named.get("content-type", "").startswith("application/http") else block
            gone = kind == "revisit"
            digest = named["warc-payload-digest"].removeprefix("sha1:") if "warc-payload-digest" in named else None
            yield (
                archive, named["warc-record-id"], kind, named.get("warc-date"), named.get("warc-target-uri"), named.get(KEY.lower(), ""),
                digest, named.get("x-refers-to-page-id"),
                _size(named.get("x-payload-length", "")) if gone else len(payload),
                digest if gone else hashlib.sha1(payload).hexdigest(),
            )
    except BROKEN:
        return


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of the WARC files below a folder; columns as WARC_SCHEMA."""
    return _from_files(spark, path, WARC_SCHEMA, warc_records)


def archive_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = REVISIT_BYTES) -> DataFrame:
    """Pages written to ARC, converted to WARC, and read back: columns as WARC_SCHEMA.

    One record per row: repeated rows are records of their own, all but one of them revisits where
    the payload is long enough, also where their ids are equal. Null html is an empty payload; null
    ids come back as empty keys and are a response only if no copy has an id; an empty table gives an
    empty table; other columns are not read.
    """
    spark = pages.sparkSession
    arc, warc = shared_folder(spark, "arc"), shared_folder(spark, "warc")
    write_arc(pages, arc, id_col, url_col, html_col)
    convert(spark, arc, warc, least)
    return read_warc(spark, warc)


_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha1(html) AS payload_digest FROM p),
f AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first FROM d)
SELECT page_id, payload_bytes, payload_digest,
    CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN page_id <> first THEN first END AS refers_to
FROM f
"""


@query("op1_arc_to_warc", _SQL)
def op1_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = archive_pages(load(spark, sf_dir, "pages", "page_id", "url", "html"))
    return read.select(
        F.col("key").try_cast("long").alias("page_id"), "payload_bytes", "payload_digest", F.col("warc_type").alias("record_type"), F.col("refers_to").try_cast("long").alias("refers_to")
    )
