import gzip
import hashlib

import pytest

from nearwave.llm.warc import CaptureIndex, archive_round_trip, parse_record, read_pages, record, url_key, write_archive
from nearwave.workdir import new_folder


@pytest.fixture(scope="module")
def pages_of(spark):
    return lambda rows, n=3: spark.createDataFrame(rows, "page_id BIGINT, url STRING, html STRING").repartition(n)


def rows_for(n):
    pages = [(i, f"http://www.h{i % 7}.example.org/p{i}?q={i}", f"<p>page {i % 40} é" + "x" * (i % 40 * 5)) for i in range(n)]
    return pages + [(n, None, None), (n + 1, "", ""), (n + 2, "not a url \r\n x", "short"), (n + 3, "http://[bad", "short")]


def plain(rows):
    want = set()
    for page_id, _, html in rows:
        data = (html or "").encode()
        same = [p for p, _, h in rows if (h or "").encode() == data]
        first = min(same) if len(data) >= 100 else page_id
        kind = "response" if first == page_id else "revisit"
        want.add((page_id, len(data), hashlib.sha256(data).hexdigest(), kind, None if kind == "response" else first))
    return want


def test_round_trip_against_brute_force(pages_of):
    rows = rows_for(200)
    assert {tuple(r) for r in archive_round_trip(pages_of(rows).selectExpr("*", "1 AS digest", "2 AS key")).collect()} == plain(rows)


def test_nulls_ties_and_nothing(pages_of):
    html = "y" * 200
    rows = [(None, "u", html), (4, "u", html), (4, "u", html), (2, "v", html), (None, "w", "z" * 150), (None, "w", "z" * 150)]
    got = sorted((r.page_id or -1, r.record_type, r.refers_to) for r in archive_round_trip(pages_of(rows)).collect())
    assert got == [(-1, "response", None), (-1, "response", None), (-1, "revisit", 2), (2, "response", None), (4, "revisit", 2), (4, "revisit", 2)]
    assert archive_round_trip(pages_of(rows).limit(0)).count() == 0


def test_lookup_of_some_pages(spark, pages_of):
    rows = rows_for(150)
    folder = new_folder(spark, "test-warc")
    write_archive(pages_of(rows), folder)
    asked = pages_of([rows[3], rows[77], (5, "http://www.h0.example.org/none", None)], 1)
    found = read_pages(spark, folder, asked).collect()
    assert {r.page_id for r in found} == {3, 77}


def test_records_are_whole():
    data = record(5, "http://x/", b"body\r\n\r\nmore", "d" * 64, None, False)
    parsed = parse_record(data)
    assert parsed["payload"] == b"body\r\n\r\nmore" and parsed["page_id"] == 5 and parsed["url"] == "http://x/"
    revisit = parse_record(record(6, "http://x/", b"body", "d" * 64, 5, True))
    assert (revisit["record_type"], revisit["refers_to"], revisit["payload"], revisit["payload_bytes"]) == ("revisit", 5, None, 4)
    assert gzip.decompress(gzip.compress(data)) == data


def test_keys():
    assert url_key("https://M.Example.com:443/a/b?x=1#top") == "com,example,m)/a/b?x=1"
    assert url_key("http://example.com:8080") == "com,example:8080)/"
    assert url_key(None) == ")/"


def test_blocks_of_equal_keys(spark, pages_of, tmp_path):
    from nearwave.llm.warc import write_index

    captures = spark.createDataFrame(
        [("k", 1, "f", i, 1) for i in range(50)] + [("a", 1, "f", 99, 1), ("z", None, "f", 98, 1)],
        "key STRING, page_id BIGINT, file STRING, offset BIGINT, size BIGINT",
    ).coalesce(1)
    files = write_index(captures, f"file://{tmp_path}/i", block_lines=7).collect()
    entries = [e for f in files for e in CaptureIndex(f"{tmp_path}/i", f.file).find("k", 1)]
    assert sorted(e[3] for e in entries) == list(range(50))
    assert [e[3] for f in files for e in CaptureIndex(f"{tmp_path}/i", f.file).find("z", None)] == [98]
