"""Archives against the zipfile and gzip modules, and round trips of odd pages."""

import gzip
import hashlib
import io
import json
import zipfile
import zlib

import pytest
from compare import compare, connect
from llm_tables import SMALL
from pyspark.sql import functions as F

from verbaloom.llm import wacz, zip_members

PAGES = "page_id long, url string, html string"
BIG, OTHER = "<p>" + "same " * 400, "<p>" + "Größe \U0001f600 " * 300


def odd_pages():
    rows = [(1, "http://a/1", BIG), (2, "http://a/2", BIG), (3, "http://a/3", "<p>short"), (4, "http://a/4", "<p>short"),
            (5, None, None), (6, "http://a/6", ""), (7, "http://a b\r\nX: y", OTHER), (7, "http://c", OTHER), (None, "http://n", OTHER),
            (9, "u", "x" * 1000), (8, "u", "x" * 1000), (10, "u", "y" * 999), (11, "u", "y" * 999), (12, "w", "\r\n\r\nz" * 400_000)]
    rows += [(20, "twice", "t" * 5000)] * 5 + [(19, "twice", "t" * 5000)] + [(30, "tiny", "t")] * 3
    rows += [(None, "null", "nulls " * 300)] * 2
    return rows


def expected(rows):
    groups = {}
    for row in rows:
        groups.setdefault(row[2] or "", []).append(row)
    result = []
    for html, same in groups.items():
        raw = html.encode()
        same.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""), reverse=True)
        for k, (page, _, _) in enumerate(same):
            again = k > 0 and len(raw) >= 1000
            result.append((page, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if again else "response", same[0][0] if again else None))
    return sorted(result, key=str)


def test_odd_pages_through_the_query(spark, tmp_path):
    pages = spark.createDataFrame(odd_pages(), PAGES).withColumns({c: F.lit("clash") for c in ("payload", "best", "same", "target", "count")})
    pages.write.parquet(str(tmp_path / "pages.parquet"))
    rows = [tuple(r) for r in wacz.op12_web_archive(spark, str(tmp_path)).collect()]
    assert sorted(rows, key=str) == expected(odd_pages())
    assert compare(wacz.op12_web_archive(spark, str(tmp_path)), connect_pages(tmp_path), wacz.OP12_SQL) == ""


def connect_pages(folder):
    import duckdb
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{folder}/pages.parquet/*.parquet'")
    return con


def test_no_pages(spark, tmp_path):
    records = wacz.with_record_types(spark.createDataFrame([], PAGES))
    wacz.write_archives(records, str(tmp_path / "none"))
    assert wacz.read_archives(spark, str(tmp_path / "none")).count() == 0


@pytest.mark.parametrize("zip64", [False, True])
def test_other_readers_agree(spark, tmp_path, monkeypatch, zip64):
    records = wacz.with_record_types(spark.createDataFrame(odd_pages(), PAGES).coalesce(1))
    wacz.write_archives(records, str(tmp_path / "a"), zip64=zip64)
    back = {r.record_id: r for r in wacz.read_archives(spark, str(tmp_path / "a")).collect()}
    assert len(back) == len(odd_pages()) and all(r.intact for r in back.values())
    seen = 0
    for file in (tmp_path / "a").glob("part-*"):
        if not file.stat().st_size:
            continue
        with zipfile.ZipFile(file) as archive:
            assert archive.testzip() is None
            for info in archive.infolist():
                assert info.compress_type == zipfile.ZIP_STORED
                raw = archive.read(info)
                if info.filename.startswith("indexes/"):
                    warc = archive.read("archive/" + info.filename.split("/")[1].replace(".cdxj", ".warc.gz"))
                    lines = raw.decode().splitlines()
                    assert lines == sorted(lines)
                    for line in lines:
                        place = json.loads(line[line.index("{"):])
                        record = wacz.parsed_record(gzip.decompress(warc[place["offset"]: place["offset"] + place["length"]]))
                        assert record == back[record["record_id"]].asDict()
                        seen += 1
    assert seen == len(back)


def test_segments_and_pieces(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(wacz, "SEGMENT_RECORDS", 3)
    monkeypatch.setattr(wacz, "PIECE_BYTES", 700)
    rows = [{"record_id": f"urn:page:{i}:x", "record_type": "response", "url": f"u{i}", "payload": bytes([i]) * (50 * i), "payload_bytes": 50 * i,
             "payload_digest": hashlib.sha1(bytes([i]) * (50 * i)).hexdigest(), "refers_to": None} for i in range(11)]
    stream = b"".join(wacz._archive(iter(rows), wacz.DATE, False))
    assert stream.endswith(b"\n")
    assert b"".join(piece + b"\n" for piece in wacz._lines(wacz._archive(iter(rows), wacz.DATE, False))) == stream
    file = tmp_path / "one.wacz"
    file.write_bytes(stream)
    places = [(s["offset"], s["lengths"]) for s in wacz.archive_stretches(str(file), len(stream))]
    got = []
    for offset, lengths in places:
        for length in lengths:
            got.append(wacz.parsed_record(gzip.decompress(stream[offset: offset + length]))["record_id"])
            offset += length
    assert sorted(got) == sorted(r["record_id"] for r in rows) and len(places) < 11


def packed(names, method=zipfile.ZIP_STORED):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", method) as archive:
        for name, raw in names:
            archive.writestr(name, raw)
    return out.getvalue()


def warc(count):
    rows = [{"record_id": f"r{i}", "record_type": "response", "url": None, "payload": b"%d" % i * 900, "payload_bytes": 900,
             "payload_digest": "00" * 20, "refers_to": None} for i in range(count)]
    return [gzip.compress(wacz.warc_record(r, wacz.DATE)) for r in rows]


def records_in(path, raw):
    path.write_bytes(raw)
    return [s["offset"] for s in wacz.archive_stretches(str(path), len(raw)) for _ in s["lengths"]]


def test_archives_of_others(tmp_path, monkeypatch):
    monkeypatch.setattr(wacz, "PIECE_BYTES", 64)
    parts = warc(5)
    whole = b"".join(parts)
    lines = b"".join(b'k 2024 {"offset": %d, "length": %d, "filename": "d.warc.gz"}\n' % (sum(map(len, parts[:i])), len(p)) for i, p in enumerate(parts))
    without_index = packed([("archive/d.warc.gz", whole), ("pages/pages.jsonl", "{}")])
    assert len(records_in(tmp_path / "a", without_index)) == 5  # borders by scanning
    assert len(records_in(tmp_path / "b", packed([("archive/d.warc.gz", whole), ("indexes/index.cdx", lines)]))) == 5
    two = gzip.compress(lines[:100]) + gzip.compress(lines[100:])
    assert len(records_in(tmp_path / "c", packed([("archive/d.warc.gz", whole), ("indexes/index.cdx.gz", two)]))) == 5
    assert records_in(tmp_path / "e", packed([])) == []
    with pytest.raises(ValueError, match="not stored"):
        records_in(tmp_path / "f", packed([("archive/d.warc.gz", whole)], zipfile.ZIP_DEFLATED))
    with pytest.raises(ValueError, match="central directory"):
        records_in(tmp_path / "g", whole)


def test_damage_is_seen():
    record = wacz.warc_record({"record_id": "r", "record_type": "response", "url": "u", "payload": b"abc", "payload_bytes": 3,
                               "payload_digest": hashlib.sha1(b"abc").hexdigest(), "refers_to": None}, wacz.DATE)
    assert wacz.parsed_record(record)["intact"]
    assert not wacz.parsed_record(record.replace(b"abc", b"abd"))["intact"]
    assert not wacz.parsed_record(record[:-6])["intact"]


def test_directory_beyond_32_bits():
    """Places and sizes over 4 GiB, in an archive that is only there where it is read."""
    stream = zip_members.ZipStream()
    head = stream.begin("archive/large.warc.gz")
    far = 5 << 30
    stream.at, stream.size, stream.crc = len(head) + far, far, zlib.crc32(b"")
    tail = stream.end()
    second_at, second = stream.at, stream.begin("archive/second.warc.gz") + stream.data(b"12345") + stream.end()
    end_at, end = stream.at, stream.finish(b"\n")
    pieces = [(0, head), (len(head) + far, tail), (second_at, second), (end_at, end)]

    def read(offset, size):
        raw = bytearray(size)
        for at, piece in pieces:
            low, high = max(at, offset), min(at + len(piece), offset + size)
            if low < high:
                raw[low - offset: high - offset] = piece[low - at: high - at]
        return bytes(raw[: max(0, stream.at - offset)])
    found = list(zip_members.members(read, stream.at))
    assert [(m.name, m.size) for m in found] == [("archive/large.warc.gz", far), ("archive/second.warc.gz", 5)]
    assert read(found[1].offset, 5) == b"12345"


def test_many_members():
    stream = zip_members.ZipStream()
    raw = b"".join(stream.begin(f"{i:06d}") + stream.end() for i in range(70_000)) + stream.finish()
    found = [m.name for m in zip_members.members(lambda at, size: raw[at: at + size], len(raw))]
    assert found == [f"{i:06d}" for i in range(70_000)]
    with zipfile.ZipFile(io.BytesIO(raw)) as archive:
        assert len(archive.namelist()) == 70_000


def test_small_table_equals_sql(spark):
    assert compare(wacz.op12_web_archive(spark, SMALL), connect(SMALL), wacz.OP12_SQL) == ""
