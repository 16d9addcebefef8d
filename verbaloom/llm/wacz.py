"""Web archives packed in ZIP files: written by Spark tasks and read by ranges.

``write_archives`` writes records as gzipped WARC 1.1 members ``archive/data-N.warc.gz``, each
followed by its index ``indexes/data-N.cdxj`` with the offset and length of every record.  One
task makes one archive, as a stream.  An archive is any byte stream that ends with a line feed
(the ZIP comment), so it can be cut at line feeds into rows and written by Spark's own text
writer: any file system that Spark knows will do, and tasks that are lost or run twice leave nothing behind.

``read_archives`` reads the central directories (``zip_members``), locates stored archive members
and indexes, deals stretches of neighbouring records out to tasks and reads each stretch as a
range; an archive member that no index names is scanned once for its records' borders.  Nothing
is extracted.  Archives are opened with ``pyarrow.fs``: mounted folders, HDFS, S3, GCS.

``with_record_types`` makes records of pages: of pages with equal payloads of ``MIN_REVISIT``
bytes or more, the one with the largest id is a response and the others are revisits of it, which hold no payload.

Defined cases: a null payload is empty.  A null id is less than all others.  Of rows with one id and one
payload, the largest url counts; rows equal in all three are one response and its revisits.  A
null url has no target header; control characters and spaces in a url are percent-encoded.
An empty table gives no archive or an empty file, and no records.  Extra columns are left out.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, LongType, StringType, StructField, StructType

from verbaloom.llm.common import shared_folder, stored, table
from verbaloom.llm.zip_members import ZipStream, members

MIN_REVISIT = 1000
#: Bytes and records after which an archive gets a further member, which bounds its index.
SEGMENT_BYTES, SEGMENT_RECORDS = 256 << 20, 50_000
#: Bytes that a task sends on, or reads, at a time; a longer record is read alone.
PIECE_BYTES = 4 << 20
DATE = "2024-01-01T00:00:00Z"
# Fixed values of the record formats.
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"

RECORD = ["record_id", "record_type", "url", "payload_bytes", "payload_digest", "refers_to", "payload"]


def with_record_types(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Columns ``RECORD`` for every row of ``pages``.

    Payloads are compared by length and SHA-256.  The counts that choose the responses move no
    payload; the choices are stored, so that the optimizer broadcasts them only if their true size
    is small, and otherwise joins by shuffle and splits a payload that many pages share.
    """
    payload = F.coalesce(F.col(html).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), payload.alias("payload")).select(
        "*", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("payload_digest"),
        F.sha2("payload", 256).alias("same"))
    large = rows.filter(F.col("payload_bytes") >= MIN_REVISIT)
    alike = large.groupBy("same", "payload_bytes", "payload_digest", "page_id", "url").count()
    chosen = stored(
        alike.groupBy("same", "payload_bytes", "payload_digest").agg(
            F.max(F.struct("page_id", "url", "count")).alias("best"), F.sum("count").alias("n")).filter("n > 1"), "chosen-responses")
    target = record_id(F.col("best.page_id"), F.concat(F.lit("sha1-"), "payload_digest"))
    best = chosen.select(F.col("same").alias("best_same"), F.col("payload_bytes").alias("best_bytes"), "best", target.alias("target"))
    joined = rows.join(best, (rows["same"] == best["best_same"]) & (rows["payload_bytes"] == best["best_bytes"]), "left")
    is_best = F.col("best").isNotNull() & F.col("page_id").eqNullSafe(F.col("best.page_id")) & F.col("url").eqNullSafe(F.col("best.url"))
    repeated = is_best & (F.col("best.count") > 1)
    own_id = record_id(F.col("page_id"), F.concat(F.lit("row-"), F.hex(F.monotonically_increasing_id())))
    revisit = F.col("best").isNotNull() & ~is_best
    records = joined.filter(~repeated).select(
        F.when(is_best, F.col("target")).otherwise(own_id).alias("record_id"),
        F.when(revisit, "revisit").otherwise("response").alias("record_type"), "url", "payload_bytes", "payload_digest",
        F.when(revisit, F.col("target")).alias("refers_to"), F.when(~revisit, F.col("payload")).alias("payload"))
    twice = chosen.filter("best.count > 1")
    if twice.isEmpty():
        return records
    first = joined.filter(repeated).groupBy("same", "payload_bytes", "payload_digest").agg(
        F.first("target").alias("record_id"), F.first("url").alias("url"), F.first("payload").alias("payload"))
    first = first.select("record_id", F.lit("response").alias("record_type"), "url", "payload_bytes", "payload_digest",
                         F.lit(None).cast("string").alias("refers_to"), "payload")
    again = twice.select("*", F.explode(F.sequence(F.lit(2), F.col("best.count"))).alias("number"))
    again = again.select(
        record_id(F.col("best.page_id"), F.concat(F.lit("again-"), F.col("number").cast("string"), F.lit("-"), "payload_digest")).alias("record_id"),
        F.lit("revisit").alias("record_type"), F.col("best.url").alias("url"), "payload_bytes", "payload_digest",
        target.alias("refers_to"), F.lit(None).cast("binary").alias("payload"))
    return records.unionByName(first).unionByName(again)


def record_id(page_id: Column, rest: Column) -> Column:
    return F.concat(F.lit("urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(":"), rest)


def page_of(record: Column) -> Column:
    """The page's id in a record's id, null where the page had none."""
    digits = F.regexp_extract(record, r"^urn:page:(-?\d*):", 1)
    return F.when(digits != "", digits.cast("long"))


# Records


def _label(digest: str) -> str:
    return "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()


def _hex(label: str) -> str:
    """Bare hex of a digest that is written in base 32 or in hex."""
    value = label.rpartition(":")[2]
    return base64.b32decode(value.upper()).hex() if len(value) == 32 else value.lower()


def _uri(url: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda c: f"%{ord(c[0]):02X}", url)


def warc_record(row: dict, date: str) -> bytes:
    payload = row["payload"] or b""
    block = HTTP_HEAD.format(row["payload_bytes"]).encode() + payload
    head = [("WARC-Type", row["record_type"]), ("WARC-Record-ID", f"<{row['record_id']}>"), ("WARC-Date", date)]
    if row["url"] is not None:
        head.append(("WARC-Target-URI", _uri(row["url"])))
    head.append(("WARC-Payload-Digest", _label(row["payload_digest"])))
    head.append(("WARC-Block-Digest", _label(hashlib.sha1(block).hexdigest())))
    if row["refers_to"] is not None:
        head += [("WARC-Profile", SAME_PAYLOAD), ("WARC-Refers-To", f"<{row['refers_to']}>")]
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", len(block))]
    lines = "".join(f"{name}: {value}\r\n" for name, value in head)
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n"


def _fields(raw: bytes) -> dict[str, str]:
    pairs = (line.partition(":") for line in raw.decode("utf-8", "replace").split("\r\n")[1:])
    return {name.strip().lower(): value.strip() for name, _, value in pairs}


def parsed_record(raw: bytes) -> dict:
    """A record's columns: length and digest of a payload that is there are measured, those of a
    revisit are its headers'.  ``intact`` says whether the digests in the headers are right."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = _fields(head)
    block = rest[: int(fields["content-length"])]
    intact = len(block) == int(fields["content-length"])
    if "warc-block-digest" in fields:
        intact &= hashlib.sha1(block).hexdigest() == _hex(fields["warc-block-digest"])
    http, _, payload = block.partition(b"\r\n\r\n")
    kind = fields.get("warc-type")
    named = _hex(fields["warc-payload-digest"]) if "warc-payload-digest" in fields else None
    if kind == "revisit":
        size, digest, payload = int(_fields(http).get("content-length", 0)), named, None
    else:
        size, digest = len(payload), hashlib.sha1(payload).hexdigest()
        intact &= named in (None, digest)
    bare = {k: fields[k].strip("<>") if k in fields else None for k in ("warc-record-id", "warc-refers-to")}
    return {"record_id": bare["warc-record-id"], "record_type": kind, "url": fields.get("warc-target-uri"), "payload_bytes": size,
            "payload_digest": digest, "refers_to": bare["warc-refers-to"], "payload": payload, "intact": intact}


# Writing


def _archive(rows: Iterator[dict], date: str, zip64: bool) -> Iterator[bytes]:
    """The bytes of one archive with all ``rows``."""
    out, number, index, begun = ZipStream(zip64), 0, [], False

    def index_member() -> Iterator[bytes]:
        yield out.end()
        yield out.begin(f"indexes/data-{number}.cdxj")
        yield out.data("".join(sorted(index)).encode())
        yield out.end()

    for row in rows:
        if not begun:
            yield out.begin(f"archive/data-{number}.warc.gz")
            begun = True
        raw = gzip.compress(warc_record(row, date), 6, mtime=0)
        place = {"offset": out.size, "length": len(raw), "filename": f"data-{number}.warc.gz", "digest": _label(row["payload_digest"])}
        stamp = re.sub(r"\D", "", date)
        index.append(f"{_uri(row['url'] or '-')} {stamp} {json.dumps(place)}\n")
        yield out.data(raw)
        if out.size >= SEGMENT_BYTES or len(index) >= SEGMENT_RECORDS:
            yield from index_member()
            number, index, begun = number + 1, [], False
    if begun:
        yield from index_member()
    if out.at:
        yield out.finish(b"\n")


def _lines(stream: Iterator[bytes]) -> Iterator[bytes]:
    """The stream, which ends with a line feed, in pieces that leave one out between them and at the end."""
    held: list[bytes] = []
    size = 0
    for raw in stream:
        held.append(raw)
        size += len(raw)
        if size >= PIECE_BYTES:
            whole = b"".join(held)
            at = whole.rfind(b"\n")
            if at >= 0:
                yield whole[:at]
                whole = whole[at + 1 :]
            held, size = [whole], len(whole)
    if size:
        yield b"".join(held)[:-1]


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            yield from batch.slice(at, 64).to_pylist()


def write_archives(records: DataFrame, path: str, date: str = DATE, zip64: bool = False) -> None:
    """Records (``RECORD``) as archives in the folder ``path``, one for each task that has any.
    ``zip64`` makes long directories even where short ones would do."""
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in _lines(_archive(_rows(batches), date, zip64)):
            yield pa.RecordBatch.from_arrays([pa.array([piece], pa.binary())], names=["value"])
    pieces = records.select(RECORD).mapInArrow(write, StructType([StructField("value", BinaryType())]))
    pieces.select(F.col("value").cast("string")).write.option("lineSep", "\n").option("compression", "none").text(path)


# Reading


@lru_cache(maxsize=4)
def _opened(uri: str):
    """An open file; every task starts without any, so that a file made anew is not mistaken."""
    if re.match(r"file:/|/", uri):
        system, path = fs.LocalFileSystem(), re.sub(r"^file:/+", "/", uri)
    else:
        system, path = fs.FileSystem.from_uri(uri)
    return system.open_input_file(path)


def _read(uri: str, offset: int, size: int) -> bytes:
    return _opened(uri).read_at(size, offset)


def _borders(uri: str, start: int, size: int) -> Iterator[tuple[int, int]]:
    """Offset and length of each gzip member in a range, read piece by piece."""
    at, end = start, start + size
    begun, machine = at, zlib.decompressobj(31)
    held = b""
    while at < end or held:
        if not held:
            held = _read(uri, at, min(PIECE_BYTES, end - at))
            at += len(held)
            if not held:
                raise ValueError(f"{uri} is cut off")
        machine.decompress(held, PIECE_BYTES)
        held = machine.unconsumed_tail or machine.unused_data
        if machine.eof:
            border = at - len(held)
            yield begun, border - begun
            begun, machine = border, zlib.decompressobj(31)


def _indexed(uri: str, start: int, size: int, packed: bool) -> Iterator[list[tuple[str, int, int]]]:
    """File name, offset and length of an index's records, in lists for each piece of it."""
    machine, rest, end = zlib.decompressobj(31), b"", start + size
    while start < end:
        raw = _read(uri, start, min(PIECE_BYTES, end - start))
        start += len(raw)
        while packed and raw:
            text = machine.decompress(raw)
            raw, machine = (machine.unused_data, zlib.decompressobj(31)) if machine.eof else (b"", machine)
            rest += text
        *lines, rest = (rest + raw).split(b"\n")
        if start >= end:
            lines.append(rest)
        places = [json.loads(line[line.index(b"{"):]) for line in lines if b"{" in line]
        yield [(p["filename"], int(p["offset"]), int(p["length"])) for p in places]


STRETCH = StructType([StructField("archive", StringType()), StructField("offset", LongType()), StructField("lengths", ArrayType(LongType()))])


def _stretches(uri: str, places: list[tuple[int, int]]) -> Iterator[dict]:
    """Neighbouring records together, up to ``PIECE_BYTES`` or one record."""
    begun, lengths = 0, []
    for offset, length in sorted(places):
        if lengths and (offset != begun + sum(lengths) or sum(lengths) + length > PIECE_BYTES or len(lengths) >= 1000):
            yield {"archive": uri, "offset": begun, "lengths": lengths}
            lengths = []
        begun = begun if lengths else offset
        lengths = [*lengths, length]
    if lengths:
        yield {"archive": uri, "offset": begun, "lengths": lengths}


def archive_stretches(uri: str, length: int) -> Iterator[dict]:
    warcs, indexes = {}, []
    for member in members(lambda offset, size: _read(uri, offset, size), length):
        folder, _, name = member.name.rpartition("/")
        if folder == "archive" and name.endswith(".warc.gz"):
            if member.method:
                raise ValueError(f"{uri}: {member.name} is not stored")
            warcs[name] = member
        elif folder == "indexes" and not member.method and re.search(r"\.cdxj?(\.gz)?$", name):
            indexes.append(member)
    named = set()
    for index in indexes:
        for places in _indexed(uri, index.offset, index.size, index.name.endswith(".gz")):
            known = [(warcs[name].offset + offset, size) for name, offset, size in places if name in warcs]
            named |= {name for name, _, _ in places}
            yield from _stretches(uri, known)
    for name, member in warcs.items():
        if name not in named:
            for place in _borders(uri, member.offset, member.size):
                yield from _stretches(uri, [place])


READ = StructType([StructField(c, LongType() if c == "payload_bytes" else BinaryType() if c == "payload" else StringType()) for c in RECORD]
                  + [StructField("intact", BooleanType())])
_ARROW = {LongType: pa.int64(), BinaryType: pa.binary(), StringType: pa.string(), BooleanType: pa.bool_()}


def _batch(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=pa.schema([(f.name, _ARROW[type(f.dataType)]) for f in READ]))


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Columns ``RECORD`` and ``intact`` of every record in the archives of a folder; ``payload``
    is null for revisits, and everywhere if ``payloads`` is false (they are read and measured all the same)."""
    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _opened.cache_clear()
        schema = pa.schema([("archive", pa.string()), ("offset", pa.int64()), ("lengths", pa.list_(pa.int64()))])
        for file in _rows(batches):
            held = []
            for stretch in archive_stretches(file["path"], file["length"]):
                held.append(stretch)
                if len(held) == 1000:
                    yield pa.RecordBatch.from_pylist(held, schema=schema)
                    held = []
            yield pa.RecordBatch.from_pylist(held, schema=schema)

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _opened.cache_clear()
        held, size = [], 0
        for stretch in _rows(batches):
            raw = _read(stretch["archive"], stretch["offset"], sum(stretch["lengths"]))
            at = 0
            for length in stretch["lengths"]:
                row = parsed_record(gzip.decompress(raw[at : at + length]))
                at += length
                if not payloads:
                    row["payload"] = None
                held.append(row)
                size += 500 + len(row["payload"] or b"")
                if size >= PIECE_BYTES:
                    yield _batch(held)
                    held, size = [], 0
        yield _batch(held)

    files = spark.read.format("binaryFile").load(path).filter("length > 0").select("path", "length")
    # Stretches differ little in size, so they are dealt in turn: one archive is many tasks.
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return files.mapInArrow(locate, STRETCH).repartition(tasks).mapInArrow(fetch, READ)


def op12_web_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written to archives and read back."""
    path = shared_folder(spark, "archives")
    write_archives(with_record_types(table(spark, sf_dir, "pages").select("page_id", "url", "html")), path)
    records = read_archives(spark, path, payloads=False)
    return records.select(page_of(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", "record_type",
                          page_of(F.col("refers_to")).alias("refers_to"))


OP12_SQL = r"""
WITH p AS (
  SELECT page_id, url, encode(coalesce(html, '')) AS payload, row_number() OVER () AS row FROM pages
), r AS (
  SELECT page_id, octet_length(payload)::BIGINT AS payload_bytes, sha1(payload) AS payload_digest,
         octet_length(payload) >= 1000 AND row_number() OVER w > 1 AS again, first_value(page_id) OVER w AS target
  FROM p WINDOW w AS (PARTITION BY payload ORDER BY page_id DESC NULLS LAST, url DESC NULLS LAST, row)
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN again THEN target END AS refers_to
FROM r
"""
