"""WARC archives: round trip, pushdown, skipped payloads, lost tasks, other writers."""

from __future__ import annotations

import gzip
import hashlib
import io
from pathlib import Path

import compare
import pytest

from tillsight.llm import warc
from tillsight.session import scratch_path

PAGES = [(i, f"http://a/{i}", "<p>" + "x" * (i % 3) * 900) for i in range(40)] + [
    (100, "http://long", "é" * 400_000), (101, None, None), (102, "http://b\r\nWARC-Type: x", ""), (103, "u", "WARC/1.1\r\n\r\n"),
    (104, "same", "s" * 1000), (104, "same", "s" * 1000), (105, "below", "t" * 999), (106, "below", "t" * 999), (None, None, "s" * 1000),
]


def frame(spark, rows=PAGES):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def expected(rows):
    largest = {}
    for i, _, html in rows:
        body = (html or "").encode()
        if len(body) >= 1000 and i is not None:
            largest[body] = max(i, largest.get(body, i))
    out = []
    for i, _, html in rows:
        body = (html or "").encode()
        keep = largest.get(body, i)
        out.append((i, len(body), hashlib.sha1(body).hexdigest(), *(("response", None) if keep == i else ("revisit", keep))))
    return sorted(out, key=str)


def test_round_trip(spark):
    assert sorted(map(tuple, warc.query(frame(spark)).collect()), key=str) == expected(PAGES)
    assert warc.query(frame(spark, [])).count() == 0


def test_equals_sql(spark, folder):
    pages = spark.read.parquet(f"{folder}/pages.parquet")
    count, only = compare.differences(warc.query(pages), compare.connect(folder), warc.ORACLE)
    assert not only and count


@pytest.fixture
def archive(spark):
    path = scratch_path(spark, "warc-test")
    warc.write_warc(warc.with_revisits(frame(spark).selectExpr("page_id record", "url", "cast(coalesce(html, '') as binary) payload")), path)
    return path


def test_pushdown(spark, archive):
    every = warc.read_warc(spark, archive)
    revisits = every.where("record_type = 'revisit' and target_uri like 'http://a/%'").collect()
    assert revisits and all(r.payload is None and r.record_type == "revisit" for r in revisits)
    few = every.where("record_id in ('urn:page:3', 'urn:page:100')").collect()
    assert sorted(len(r.payload) for r in few if r.payload is not None)[-1] == 800_000
    plan = every.where("record_type = 'response'")._jdf.queryExecution().executedPlan().toString()
    assert ") Filter (" not in plan
    heads = warc.read_warc(spark, archive, "record_id string, payload_bytes long, payload_digest string")
    assert {(r.record_id, r.payload_bytes) for r in heads.collect()} >= {("urn:page:100", 800_000)}


class Counted(io.BytesIO):
    taken = 0

    def read(self, size=-1):
        out = super().read(size)
        self.taken += len(out)
        return out


def test_payloads_are_not_decoded(monkeypatch):
    import os

    big = [{"record_id": f"r{i}", "record_type": "response", "payload": os.urandom(3_000_000)} for i in range(4)]
    data = b"".join(warc.record(row, 1) for row in big)
    file = Counted(data)
    rows = list(warc.records(file, lambda row: row["record_id"] == "r2", False, True))
    assert [(r["record_id"], r["payload_bytes"]) for r in rows] == [("r2", 3_000_000)]
    assert file.taken < len(data) / 4
    rows = list(warc.records(Counted(data), lambda row: row["record_id"] == "r3", True, True))
    assert rows[0]["payload"] == big[3]["payload"]


def test_other_writers(spark, tmp_path):
    body = b"HTTP/1.1 200 OK\r\nServer: x\r\n\r\n<html>\r\n\r\n</html>"
    one = b"WARC/1.0\r\nWARC-Type: response\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n"
    info = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nContent-Length: 5\r\n\r\nabc\r\n\r\n\r\n"
    parts = [info, one % (len(body), body), info, one % (len(body), body)]
    (tmp_path / "a.warc").write_bytes(b"".join(parts))
    (tmp_path / "b.warc.gz").write_bytes(b"".join(map(gzip.compress, parts)))
    got = warc.read_warc(spark, f"file://{tmp_path}").collect()
    assert len(got) == 8
    assert [bytes(r.payload) for r in got if r.record_type == "response"] == [b"<html>\r\n\r\n</html>"] * 4
    assert warc.read_warc(spark, str(tmp_path), "record_type string").where("record_type = 'warcinfo'").count() == 4


def test_files_of_lost_tasks_do_not_count(spark, archive):
    folder = Path(archive.removeprefix("file:"))
    before = warc.read_warc(spark, archive, "record_id string").count()
    (folder / "part-lost.warc.gz").write_bytes(warc.record({"record_id": "lost", "payload": b"x"}, 1))
    assert warc.read_warc(spark, archive, "record_id string").count() == before == len(PAGES)
