import base64
import gzip
import hashlib
import io

import pytest

from lodestrata.llm import warc as W
from lodestrata.llm.shared import shared_dir

PAGES = [
    (1, "http://a/1", "<p>x</p>"), (2, "http://a/2", "<p>x</p>"), (3, "http://a/é\r\nX: y", None), (4, None, ""), (5, "u", "é" * 50_000), (6, "", "\r\n\r\nWARC/1.1\r\n\r\n"),
    (None, "n", "<p>x</p>"), (None, "m", "only"), (5, "u", "é" * 50_000),
]


def pages(spark, rows=PAGES):
    return spark.createDataFrame([(*r, 7) for r in rows], "page_id long, url string, html string, payload_bytes int")


@pytest.mark.parametrize("size", [64 << 20, 200])
def test_round_trip(spark, monkeypatch, size):
    monkeypatch.setattr(W, "ARCHIVE_BYTES", size)
    monkeypatch.setattr(W, "RANGE_BYTES", size)
    folder = shared_dir(spark)
    manifest = W.write_archives(pages(spark).coalesce(1), folder)
    members = W.normalise_archives(manifest, folder)
    rows = W.read_archives(members).collect()
    firsts = {}
    for i, _, html in PAGES:
        key = html or ""
        firsts[key] = min([x for x in (firsts.get(key), i) if x is not None], default=None)
    want = []
    for i, _, html in PAGES:
        data, first = (html or "").encode(), firsts[html or ""]
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        want.append(str((i, len(data), digest, *(("response", None, data) if i == first else ("revisit", first, None)))))
    got = [str((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, None if r.payload is None else bytes(r.payload))) for r in rows]
    assert sorted(got) == sorted(want)


def test_each_record_is_a_member_at_its_offset(spark):
    import json

    folder = shared_dir(spark)
    members = W.normalise_archives(W.write_archives(pages(spark), folder), folder).collect()
    for m in members:
        data = open(m.archive.removeprefix("file://"), "rb").read()
        index = [json.loads(x) for x in open(m["index"].removeprefix("file://"))]
        assert len(index) == m.records and sum(x["length"] for x in index) == len(data)
        for x in index:
            one = gzip.decompress(data[x["offset"] : x["offset"] + x["length"]])
            assert one.startswith(b"WARC/1.1\r\n") and one.endswith(b"\r\n\r\n") and W.field_of(one, "WARC-Record-ID") == x["id"]


def test_small_payloads_are_never_revisits(spark):
    folder = shared_dir(spark)
    rows = W.read_archives(W.normalise_archives(W.write_archives(pages(spark), folder, least_bytes=5), folder)).collect()
    assert {r.record_type for r in rows if r.payload_bytes < 5} == {"response"}
    assert sum(r.record_type == "revisit" for r in rows) == 2


def test_damage_is_noticed():
    with pytest.raises(ValueError):
        list(W._records(iter([b"WARC/1.1\r\nContent-Length: 10\r\n\r\nabc"])))
    two = gzip.compress(b"a" * 3_000_000) + gzip.compress(b"b")
    assert b"".join(W.inflated(io.BytesIO(two))) == b"a" * 3_000_000 + b"b"


def test_empty_table(spark):
    folder = shared_dir(spark)
    assert W.read_archives(W.normalise_archives(W.write_archives(pages(spark, []), folder), folder)).count() == 0


def test_ranges_are_read_by_as_many_tasks_as_their_bytes_need(spark, monkeypatch):
    monkeypatch.setattr(W, "RANGE_BYTES", 4000)
    import os

    folder = shared_dir(spark)
    members = W.normalise_archives(W.write_archives(pages(spark, [(i, "u", os.urandom(500).hex()) for i in range(200)]).coalesce(2), folder), folder)
    read = W.read_archives(members)
    n = sum(r["bytes"] for r in members.collect()) // 4000
    assert n > 8 and read.rdd.getNumPartitions() >= n
    assert read.count() == 200


def test_a_payload_of_most_rows(spark):
    rows = [(i, "u", "same" if i % 3 else f"own {i}") for i in range(3000)]
    folder = shared_dir(spark)
    got = W.read_archives(W.normalise_archives(W.write_archives(pages(spark, rows), folder), folder)).collect()
    assert len(got) == 3000 and {r.refers_to for r in got if r.record_type == "revisit"} == {1}
    assert sum(r.record_type == "response" for r in got) == 1001
