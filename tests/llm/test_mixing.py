"""Mixing: against SQL, and its edge cases."""

from __future__ import annotations

import compare
import duckdb
import pytest

from tillsight.llm import mixing

SCHEMA = "doc_id long, text string, source string, size string, U string"


def run(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA)
    for name in ("rest", "p", "copies", "bin", "_u", "row"):
        docs = docs.withColumn(name, docs["size"])
    return docs, mixing.mixed(docs)


def rows():
    out = [(i, " ".join(["w"] * (i % 37)), f"s{i % 5}", "clash", "x") for i in range(400)]
    out += [(1000 + i, "a b c  d\te", "s1", None, None) for i in range(200)]
    out += [(7, "same row", "s2", None, None)] * 5
    out += [(None, "no id", None, None, None), (None, None, None, None, None), (5000, "", "empty", None, None)]
    out += [(5001, "long " * 30_000, "s3", None, None)]
    return out


def test_equals_sql(spark):
    docs, mixed = run(spark, rows())
    con = duckdb.connect()
    documents = docs.select("doc_id", "text", "source").toArrow()  # noqa: F841
    con.execute("CREATE TABLE documents AS SELECT * FROM documents")
    count, only = compare.differences(
        mixed.select("doc_id", "source", *mixing.RESULT), con, mixing.ORACLE
    )
    assert not only and count == len(rows())


def test_targets_are_met(spark):
    _, mixed = run(spark, rows())
    got = mixed.collect()
    assert mixed.columns == ["doc_id", "text", "source", "U", "rest", "p", "copies", "bin", "_u", "row", *mixing.RESULT]
    by_source = {}
    for r in got:
        assert r.taken in (0, r.size, 2 * r.size)  # documents are taken whole
        held = by_source.setdefault(r.source, [r.target, r.source_size, 0, 0])
        held[2] += r.taken
        held[3] = max(held[3], r.size)
    for target, size, taken, longest in by_source.values():
        assert target <= 2 * size and abs(taken - target) <= longest / 2 + 0.5
    assert abs(sum(t for t, _, _, _ in by_source.values()) - 1.5 * sum(s for _, s, _, _ in by_source.values())) < 1


def test_copies_hold_the_taken_words(spark):
    docs, mixed = run(spark, rows())
    mix = mixing.copies(mixed, docs.columns[:3])
    words = mix.select(mixing.words(mix["text"]).alias("n")).groupBy().sum("n").first()[0]
    assert words == mixed.groupBy().sum("taken").first()[0]


def test_reruns_agree_whatever_the_partitions(spark):
    """Rows without id and rows of one id, of equal sizes and other texts."""
    listed = [(None, f"text {i} has some words", "s1", None, None) for i in range(200)]
    listed += [(77, f"other {i} of one id and size", "s2", None, None) for i in range(200)]
    listed += [(i, "w " * (i % 50 + 1), f"s{i % 3}", None, None) for i in range(300)]
    listed += [(5, "the same row", "s1", None, None)] * 30
    docs = spark.createDataFrame(listed, SCHEMA)
    told = {
        tuple(sorted((str(r.doc_id), r.text, r.source, r.taken) for r in mixing.mixed(laid).collect()))
        for laid in (docs.repartition(1), docs.repartition(7), docs.repartition(5, "text"))
    }
    assert len(told) == 1
    by_source = {}
    for _, text, source, taken in next(iter(told)):
        by_source.setdefault(source, []).append((len(text.split()), taken))
    assert sum(t > 0 for rows in by_source.values() for _, t in rows) < len(listed)


def test_longer_documents_are_likelier(spark):
    listed = [(i, "w " * (4 if i % 2 else 40), "a", None, None) for i in range(2000)] + [(9000 + i, "w " * 8, "b", None, None) for i in range(800)]
    got = mixing.mixed(spark.createDataFrame(listed, SCHEMA), mixing.Mix(weights=(1, 20), share=0.4)).collect()
    own = [r for r in got if r.source == "a"]
    share = {size: sum(r.taken > 0 for r in own if r.size == size) / 1000 for size in (4, 40)}
    assert 0 < share[4] < share[40] < 1 and 7 < share[40] / share[4] < 13


@pytest.mark.parametrize("docs", [[], [(1, None, None, None, None)]])
def test_nothing_to_mix(spark, docs):
    _, mixed = run(spark, docs)
    assert [(r.size, r.taken, r.target) for r in mixed.collect()] == [(0, 0, 0.0)] * len(docs)
