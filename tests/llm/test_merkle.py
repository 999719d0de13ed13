"""Fingerprints: against SQL, against Python, edge cases."""

from __future__ import annotations

import hashlib

import compare
import duckdb
from pyspark.sql import functions as F

from tillsight.llm import merkle


def test_equals_sql(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    extra = spark.createDataFrame(
        [(-5, None), (-4, ""), (-3, "é"), (-2, "日本🙂. x! y\n\n z"), (10**9, "A. b. c. " * 9000)], "doc_id long, text string"
    )
    docs = docs.unionByName(extra)
    con = duckdb.connect()
    documents = docs.toArrow()  # noqa: F841
    con.execute("CREATE TABLE documents AS SELECT * FROM documents")
    count, only = compare.differences(merkle.query(docs), con, merkle.ORACLE)
    assert not only and count


def expected(rows):
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    out = []
    for n, (doc_id, text) in enumerate(rows):
        text, after = text or "", rows[(n + 1) % len(rows)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        out.append((doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest()))
    return sorted(out, key=str)


def check(spark, rows):
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id long, text string, mark string, KEY string")
    got = merkle.query(docs).collect()
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in got), key=str) == expected(rows)
    return got


def test_order_and_edges(spark):
    rows = [(i * 7 - 300, f"Text {i}. Of line one.\nAnd {i % 3}. Two" * (i % 5)) for i in range(400)]
    got = check(spark, [*rows, (10**12, None), (None, "no id")])
    same = {}
    for r in got:
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        same.setdefault(r.fingerprint, set()).add(r.n_chars)
    assert all(len(v) == 1 for v in same.values())
    check(spark, [(1, "only")])
    check(spark, [(3, "a"), (3, "a"), (3, "a"), (9, "b")])
    assert merkle.query(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_changed_branches_locate_edits(spark):
    df = spark.createDataFrame([("One. Two.\nThree. Four.", "One. Two.\nThree. Five.")], "a string, b string")
    marks = df.select(*[merkle.fingerprint(merkle.branches(F.col(c))).alias(c) for c in "ab"])
    row = marks.select("a", merkle.changed(F.col("a"), F.col("b")).alias("c")).first()
    parts = row.a.split(",")
    assert row.c == [parts[0], parts[4], parts[6]]  # the root, the second section, its last paragraph


def test_stays_native(spark, folder):
    plan = merkle.query(spark.read.parquet(f"{folder}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan
