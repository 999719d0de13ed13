"""Importance resampling: against SQL, against a full sort, edge cases."""

from __future__ import annotations

import random

import compare
import duckdb
import pytest

from tillsight.llm import resampling

SCHEMA = "doc_id long, text string, rank string, _row string, ROW string"


def rows():
    draw = random.Random(3)
    vocabulary = [f"w{n}" for n in range(60)] + ["Été", "日本"]
    out = [(n, " ".join(draw.choices(vocabulary, k=draw.randrange(0, 60)))) for n in range(400)]
    out += [(1000, "same words " * 15)] * 60 + [(None, "without an id " * 10)] * 40 + [(None, f"other {n} " * 12) for n in range(40)]
    return [*out, (2000, None), (2001, ""), (2002, "long " * 50_000), (2003, "w1 " * 19), (2004, "w1 " * 20)]


def tables(spark, listed, wanted):
    docs = spark.createDataFrame([(*r, "a", "b", "c") for r in listed], SCHEMA)
    target = spark.createDataFrame([(n, t) for n, t in enumerate(wanted)], "item_id long, text string")
    return docs, target


@pytest.mark.parametrize("wanted", [["w1 w2 w3 Été", None, "w1 same"], []])
def test_equals_sql(spark, wanted):
    docs, target = tables(spark, rows(), wanted)
    con = duckdb.connect()
    documents, benchmark = docs.select("doc_id", "text").toArrow(), target.toArrow()  # noqa: F841
    con.execute("CREATE TABLE documents AS SELECT * FROM documents; CREATE TABLE benchmark AS SELECT * FROM benchmark")
    count, only = compare.differences(resampling.query(docs, target), con, resampling.ORACLE)
    assert not only and count == len(rows())


@pytest.mark.parametrize("final", [1, 50])
def test_selection_finds_the_exact_key(spark, final):
    """Keys with many ties, in partitions of unequal size, some empty: every place of the order."""
    draw = random.Random(1)
    listed = [(draw.choice([-3, 0, 0, 0, 5]), draw.randrange(4), draw.randrange(2), n) for n in range(700)]
    frame = spark.createDataFrame(listed, ", ".join(f"{c} long" for c in resampling.KEY))
    keys = frame.repartition(7, "_low").unionByName(frame.limit(0))
    for wanted in (1, 2, 70, 350, 699, 700):
        assert tuple(resampling.cutoff(keys, wanted, 700, final)) == sorted(listed)[wanted - 1]


def test_ranks_and_columns(spark):
    docs, target = tables(spark, rows(), ["w1 w2"])
    how = resampling.Settings(final=1)
    got = resampling.resampled(docs, target, how).collect()
    assert set(got[0].asDict()) == {"doc_id", "text", "_row", "ROW", *resampling.RESULT}
    fit = sum(r.n_features >= 20 for r in got)
    drawn = sorted((r for r in got if r["rank"] is not None), key=lambda r: r["rank"])
    assert [r["rank"] for r in drawn] == list(range(1, fit * 10 // 100 + 1))
    keys = [(-r.score, r.doc_id is None, r.doc_id or 0) for r in drawn]
    assert keys == sorted(keys) and all(r.n_features >= 20 for r in drawn)


def test_longer_runs_are_features(spark):
    docs, target = tables(spark, [(1, "a b c"), (2, "a")], ["a b"])
    got = resampling.resampled(docs, target, resampling.Settings(longest=3, least_words=1, percent=100)).collect()
    assert {r.doc_id: r.n_features for r in got} == {1: 6, 2: 1}
    assert sorted(r["rank"] for r in got) == [1, 2]


@pytest.mark.parametrize("listed", [[], [(1, None)], [(None, "a few words only")]])
def test_nothing_to_draw(spark, listed):
    docs, target = tables(spark, listed, ["x"])
    got = resampling.query(docs, target).collect()
    assert len(got) == len(listed) and all(r["rank"] is None for r in got)
