"""Archives: round trips, splits, false magic and foreign readers."""

import gzip
import io
import random
import zlib

import duckdb
import pytest
from data import FOLDER

from pagecorpus.llm import warc
from pagecorpus.llm.queries import ORACLES, op4_warc


def canonical(rows):
    return sorted(map(repr, rows))


def test_query_matches_sql(spark):
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW pages AS SELECT * FROM '{FOLDER}/pages.parquet'")
    expected = connection.execute(ORACLES["op4_warc"])
    names = [d[0] for d in expected.description]
    got = op4_warc(spark, FOLDER)
    assert canonical(expected.fetchall()) == canonical(tuple(r[n] for n in names) for r in got.collect())


PAGES = [
    (4, "http://a/ b\r\n", "<p>" + "x" * 200),
    (2, None, "<p>" + "x" * 200),
    (9, "http://c", "<p>" + "x" * 200),
    (5, "http://d", "short"),
    (6, "http://e", "short"),
    (7, "http://f", None),
    (8, "http://g", ""),
    (None, "http://h", "<p>" + "x" * 200),
    (None, "http://i", "ü" * 50),
    (None, "http://j", "ü" * 50),
    (3, "http://k", "y" * 99),
    (1, "http://k", "y" * 99),
    (11, "http://l", "WARC/1.1\r\n\r\n" * 3000),
    (12, "http://m", "same" * 30),
    (12, "http://m", "same" * 30),
]


def pages(spark):
    return spark.createDataFrame([(i, u, h, "x", "y", 1) for i, u, h in PAGES], "page_id bigint, url string, html string, digest string, payload string, path long")


def test_records_of_made_pages(spark, tmp_path):
    rows = warc.archive_round_trip(pages(spark), folder=str(tmp_path / "w")).collect()
    assert len(rows) == len(PAGES)
    got = {(r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in rows}
    assert {(2, "response", None, 203), (4, "revisit", 2, 203), (9, "revisit", 2, 203), (None, "revisit", 2, 203)} <= got
    assert {(5, "response", None, 5), (6, "response", None, 5), (7, "response", None, 0), (8, "response", None, 0)} <= got
    assert {(None, "response", None, 100), (3, "response", None, 99), (1, "response", None, 99)} <= got
    assert {(12, "response", None, 120), (11, "response", None, 36000)} <= got
    assert {r.payload_digest for r in rows if r.page_id in (2, 4, 9)} == {warc.payload_digest(b"<p>" + b"x" * 200)}
    assert warc.archive_round_trip(pages(spark).limit(0), folder=str(tmp_path / "e")).count() == 0


@pytest.mark.parametrize(("split", "file_bytes"), [(1, 10**9), (97, 500), (4096, 10**9), (1 << 24, 700)])
def test_every_record_is_read_once_whatever_the_split(spark, tmp_path, split, file_bytes):
    few = pages(spark).where("page_id <> 11 or page_id is null")
    manifest = warc.write_archives(warc.planned(few), str(tmp_path / "w"), file_bytes)
    records = warc.read_archives(manifest, split_bytes=split, tasks=8)
    assert records.count() == manifest.agg({"records": "sum"}).first()[0] == len(PAGES) - 1
    assert records.select("path", "position").distinct().count() == len(PAGES) - 1


def test_files_are_plain_gzip_and_hold_whole_payloads(spark, tmp_path):
    manifest = warc.write_archives(warc.planned(pages(spark)), str(tmp_path / "w"))
    text = b"".join(gzip.open(r.path).read() for r in manifest.collect())
    assert text.count(b"WARC-Type: response") + text.count(b"WARC-Type: revisit") == len(PAGES)
    payloads = {bytes(r.payload) for r in warc.read_archives(manifest).where("record_type = 'response'").collect()}
    assert payloads == {(h or "").encode() for _, _, h in PAGES}


def split_reads(data, split):
    def read_at(at, n):
        return data[at : at + n]

    return [x for s in range(0, len(data), split) for x in warc.records_in(read_at, len(data), s, s + split)]


def test_false_magic_inside_members():
    """A stored member that holds a whole gzip record, and noise full of magic bytes."""
    rng = random.Random(1)
    inner = warc.encode_record(99, "http://inner", b"inner", None, "d")
    noise = b"\x1f\x8b\x08" * 50 + bytes(rng.randrange(256) for _ in range(400)) + inner

    def stored(page):
        packer = zlib.compressobj(0, zlib.DEFLATED, 31)
        head = f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:x-page:{page}>\r\nContent-Length: {len(noise) + 4}\r\n\r\n"
        return packer.compress(head.encode() + b"\r\n\r\n" + noise + b"\r\n\r\n") + packer.flush()

    data = stored(1) + warc.encode_record(2, "u", b"p" * 300, None, "d") + stored(3)
    for split in (1 << 20, 64, 1000):
        found = [warc.decode_record(x)["page_id"] for _, x in split_reads(data, split)]
        assert found == [1, 2, 3]


def test_other_members_and_torn_ends_are_no_records():
    record = warc.encode_record(1, "u", b"p", None, "d")
    plain = gzip.compress(b"no archive record")
    assert [at for at, _ in split_reads(plain + record, 50)] == [len(plain)]
    assert split_reads(record[:-3], 50) == []
    assert split_reads(b"", 50) == []
    assert gzip.GzipFile(fileobj=io.BytesIO(record)).read().startswith(b"WARC/1.1")
