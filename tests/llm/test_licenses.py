"""License scans: against SQL, by hand, and the shape of the plan."""

from __future__ import annotations

import re

import compare
import duckdb
import pytest

from tillsight.llm import licenses

SCHEMA = "doc_id long, text string, score string, label string, H string"
MIT = dict(licenses.NOTICES[-1:])["mit"]


def test_equals_sql(spark):
    rows = [
        (1, None), (2, ""), (3, "under the"), (4, "Under-the MIT\nLicense; cc by nc, CC BY NC!"), (4, "under the mit license"),
        (None, "x Apache License, Version 2.0 and Apache License Version 2"), (None, None), (5, "a " + MIT.upper()),
        (6, MIT.replace("charge to any", "charge and to any")), (7, " ".join(MIT.split()[:12])), (8, MIT.replace("files to", "files")),
        (9, "cc by nc " * 4000 + "und é日本 cc-by-nc"), (10, "the mit license under the mit license under"), (11, (MIT + " and ") * 3),
    ]
    rows += [(12, "released under the mit license")] * 3
    docs = spark.createDataFrame([(*r, "s", "l", "h") for r in rows], SCHEMA)
    con = duckdb.connect()
    documents = docs.select("doc_id", "text").toArrow()  # noqa: F841
    con.execute("CREATE TABLE documents AS SELECT * FROM documents")
    count, only = compare.differences(licenses.query(docs), con, licenses.ORACLE)
    assert not only and count == len(rows)


def places(text):
    """Base places found one by one."""
    found = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    out = []
    for label, phrase in licenses.BASE:
        want = phrase.split()
        out += [(at, label) for at in range(len(found)) if found[at : at + len(want)] == want]
    return len(found), sorted(out)


def test_base_by_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = licenses.query(docs).collect()
    assert len(got) == len(texts)
    for r in got:
        n, base = places(texts[r.doc_id])
        assert (r.n_words, r.n_base) == (n, len(base))
        assert (r.first_word, r.last_word) == ((base[0][0], base[-1][0]) if base else (None, None))
        assert r.base_labels == ",".join(sorted({label for _, label in base}))
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1


def scan(spark, text):
    docs = spark.createDataFrame([(1, text, "s", "l", "h")], SCHEMA)
    return licenses.scanned(docs).first()


def test_votes_of_neighbouring_diagonals(spark):
    words = MIT.split()
    changed = " ".join([*words[:9], "inserted", *words[9:15], *words[16:]])
    got = scan(spark, "Some words before. " + changed)
    assert got.labels == "mit" and got.base_labels == "" and 0.75 <= got.score < 1
    assert (got.spans[0].first, got.spans[0].label) == (3, "mit")
    assert scan(spark, " ".join(words[:10])).labels == ""
    # The same words in pieces far apart do not make a notice.
    assert scan(spark, (" filler" * 40).join(" ".join(words[n : n + 4]) for n in range(0, len(words), 4))).labels == ""


def test_extra_columns_pass(spark):
    got = scan(spark, "Licensed under CC BY-NC 4.0.")
    assert got.asDict().keys() == {"doc_id", "text", "label", "H", *licenses.RESULT, "spans"}
    assert (got.label, got.H, got.labels, got.score, got.first_word) == ("l", "h", "cc-by-nc", 1.0, 2)


@pytest.mark.parametrize("rows", [[], [(None, None, None, None, None)]])
def test_nothing_to_scan(spark, rows):
    got = licenses.query(spark.createDataFrame(rows, SCHEMA)).collect()
    assert [(r.n_words, r.n_base, r.first_word, r.base_labels, r.labels, r.score) for r in got] == [(0, 0, None, "", "", 0.0)] * len(rows)


def test_stays_native(spark, folder):
    plan = licenses.query(spark.read.parquet(f"{folder}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan
