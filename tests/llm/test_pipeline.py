"""The pipeline, stage by stage, against brute force; its registration."""

from __future__ import annotations

import base64
import hashlib
import re

import compare
import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from test_jaccard import brute

import __spark_entry__ as entry
import corpus_pipeline
from tillsight.llm import mixing, substrings, toxicity
from tillsight.llm.common import table, written
from tillsight.llm.queries import VOCABULARY

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, folder):
    """What goes into and comes out of every stage."""
    docs, seen = table(spark, folder, "documents"), {}
    for name, stage in corpus_pipeline.STAGES:
        out = written(stage(spark, docs, folder), "test-stage")
        seen[name] = (docs, out)
        docs = out
    return seen


def test_every_stage_is_there(stages):
    assert list(stages) == ["toxicity", "jaccard_join", "substring_dedup", "mixing", "bpe"]
    assert all(out.columns == COLUMNS for _, out in list(stages.values())[:-1])


def test_rejected_documents_go(spark, folder, stages):
    docs, out = stages["toxicity"]
    told = toxicity.toxicity(docs, table(spark, folder, "labels"))
    assert out.exceptAll(told.where("predicted = 0").select(COLUMNS)).count() == 0
    assert out.count() == told.where("predicted = 0").count() < docs.count()


def test_one_of_each_group_stays(stages):
    docs, out = stages["jaccard_join"]
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted(r.doc_id for r in out.collect()) == sorted({group for _, group, _ in brute(rows)})


def test_repeated_spans_go(stages):
    docs, out = stages["substring_dedup"]
    con = duckdb.connect()
    documents = docs.select("doc_id", "text").toArrow()  # noqa: F841
    con.execute("CREATE TABLE documents AS SELECT * FROM documents")
    want = {i: text for i, text, gone in con.execute(substrings.ORACLE).fetchall() if not gone or text.strip(" \t\r\n")}
    assert {r.doc_id: r.text for r in out.collect()} == want
    assert all(r.n_chars == len(r.text) for r in out.collect() if r.text is not None)


def test_sources_meet_their_targets(stages):
    docs, out = stages["mixing"]
    told = mixing.mixed(docs).groupBy("source").agg({"taken": "sum", "target": "max", "size": "max"}).collect()
    whole = {r.text for r in docs.collect()}
    assert all(r.text in whole for r in out.collect())
    words = out.groupBy("source").agg({"*": "count"}).count()
    taken = {r.source: 0 for r in told}
    for r in out.collect():
        taken[r.source] += len([w for w in re.findall(r"[^\x20\x09-\x0D]+", r.text)])
    assert words and all(taken[r.source] == r["sum(taken)"] and abs(taken[r.source] - r["max(target)"]) <= r["max(size)"] / 2 + 0.5 for r in told)


def test_ids_are_the_library_s(stages):
    docs, out = stages["bpe"]
    path = public_tokenizers.path(VOCABULARY)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def row(r):
        ids = np.array(library.encode_ordinary(r.text or ""), dtype="<u4")
        return (r.doc_id, r.text, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest())

    got = out.select("doc_id", "text", "n_tokens", "ids_sha256", "decoded_sha256").collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(row, docs.collect()), key=str)


def test_registered(spark, folder):
    names = entry.queries()
    assert all(any(name.startswith(f"op{n}_") for name in names) for n in range(1, 14)) and "pipeline" in names
    assert set(entry.oracle_sql()) <= set(names)


@pytest.mark.parametrize("name", ["op1_substrings", "op3_warc", "op4_merkle", "op10_mixing", "op11_prefixes", "op12_licenses", "op13_resampling"])
def test_query_equals_sql(spark, folder, name):
    count, only = compare.differences(entry.queries()[name](spark, folder), compare.connect(folder), entry.oracle_sql()[name])
    assert not only and count


def test_empty_documents(spark, folder):
    docs = table(spark, folder, "documents").limit(0)
    for name, stage in corpus_pipeline.STAGES[1:]:
        assert stage(spark, docs, folder).count() == 0, name


def test_odd_documents(spark, folder):
    """Nulls, empty, repeated and very long texts, and columns named like results."""
    text = "A text of its own with more than a handful of words in it. It has another sentence too."
    rows = [(None, None, None, None, None), (1, None, "en", "a", 0), (2, "", "en", None, 0), (None, "Something else that nobody gave an id, though it is long enough to be compared.", "en", "a", 78)]
    rows += [(3, text, "en", "a", len(text))] * 3 + [(4, text, "en", "b", len(text)), (5, " ".join(f"word{n}" for n in range(100_000)), "en", "b", 988_889)]
    docs = spark.createDataFrame([(*r, n, "x") for n, r in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long, SIZE int, row string")
    for name, stage in corpus_pipeline.STAGES[1:]:
        before, docs = docs, written(stage(spark, docs, folder), "test-odd")
        if name != "bpe":
            assert [c.lower() for c in docs.columns] == [c.lower() for c in before.columns], name
        texts, earlier = {r.text for r in docs.collect()}, {r.text for r in before.collect()}
        assert texts <= earlier, name
        if name == "jaccard_join":
            assert texts == earlier and docs.where("doc_id in (3, 4)").count() == 1
    assert docs.count() > 0 and docs.where("n_tokens is null or decoded_sha256 is null").count() == 0
