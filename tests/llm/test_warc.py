import gzip
import io

import pytest

from lodeseek.llm.common import fresh_path
from lodeseek.llm.warc import MAGIC, _member, _record, base32_sha1, list_archives, read_warc, records_in, resolved, write_warc

PAGES = [(3, "http://a/", "same"), (1, "http://b/\nx", "same"), (2, None, ""), (7, "u", None), (None, "n", "lone"), (None, "n", "lone"), (5, "v", "é" * 50_000), (5, "v", "é" * 50_000)]


@pytest.mark.parametrize("span", [64, 1000, 1 << 24])
def test_round_trip(spark, span):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    folder = fresh_path(spark, "warc-test")
    archives = write_warc(pages.repartition(2), folder)
    assert sorted(r["path"].split("/")[-1] for r in list_archives(spark, folder).collect()) == sorted(r["path"].split("/")[-1] for r in archives.collect())
    got = sorted(map(repr, (tuple(r) for r in resolved(read_warc(archives, span)).collect())))
    first = {"same": 1, "": 2, "é" * 50_000: 5}
    want = []
    for page_id, _, html in PAGES:
        data = (html or "").encode()
        to = first.get(html or "")
        kind, to = ("response", None) if to in (None, page_id) else ("revisit", str(to))
        want.append(repr((kind, None if page_id is None else str(page_id), to, base32_sha1(data), len(data))))
    assert got == sorted(want)


def test_small_payloads_are_responses(spark):
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab")], "page_id long, url string, html string")
    records = read_warc(write_warc(pages, fresh_path(spark, "warc-test"), least_bytes=3))
    assert {r["record_type"] for r in records.collect()} == {"response"}


def test_empty_table_and_clashing_columns(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string, payload string, sha long")
    assert resolved(read_warc(write_warc(pages, fresh_path(spark, "warc-test")))).count() == 0


def test_ranges_own_each_record_once_and_pass_over_false_members():
    members = [_member(_record(str(i), "u", bytes([i]) * (i * 37), None)) for i in range(20)]
    data = b"noise" + MAGIC + b"noise" + members[0] + gzip.compress(b"not a record") + b"".join(members[1:])
    for span in (7, 64, 333, 10_000):
        found = [f["x-page-id"] for a in range(0, len(data), span) for _, f, _ in records_in(io.BytesIO(data), a, a + span)]
        assert found == [str(i) for i in range(20)]


@pytest.mark.parametrize("stated, held", [(b"12x", b"body here"), (b"-3", b"body here"), (b"", b"body here"), (b"999", b"body here"), (b"4", b"body"), ("٤".encode(), b"body here")])
def test_lengths_that_can_not_be_used_take_the_whole_block(stated, held):
    record = b"WARC/1.0\r\nWARC-Type: resource\r\nno header line\r\nContent-Length: " + stated + b"\r\n\r\nbody here"
    data = gzip.compress(record) + _member(_record("1", "u", b"after", None))
    found = list(records_in(io.BytesIO(data), 0, len(data)))
    assert [b for _, _, b in found][0] == held and found[1][1]["x-page-id"] == "1"


def test_clashing_columns_and_all_nulls(spark):
    """Columns of the operator's own names in the input are not read."""
    rows = [(1, "u", "one", 7, "x", "z"), (None, None, None, None, None, None), (2, "u", "one", 8, "y", "z")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, payload long, refers_to string, record_type string")
    got = {(r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in resolved(read_warc(write_warc(pages, fresh_path(spark, "warc-test")))).collect()}
    assert got == {("1", "response", None, 3), ("2", "revisit", "1", 3), (None, "response", None, 0)}
