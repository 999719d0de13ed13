"""Substring dedup: against SQL, planted passages, edge cases."""

from __future__ import annotations

import time

import compare
import duckdb

from tillsight.llm import substrings
from tillsight.llm.common import SHUFFLE_CLEANUP, written

PASSAGE = " ".join(f"Planted{i} words of one passage that many texts share." for i in range(8))


def cut(spark, rows, schema="doc_id long, text string, Removed_Words string, later int"):
    docs = spark.createDataFrame(rows, schema)
    return docs, substrings.without_repeats(docs)


def test_passage_stays_once(spark):
    rows = [(i, f"Own{i} start of it. {PASSAGE}\nOwn{i} end of it all. And more{i}.", "x", i) for i in range(30)]
    rows += [(100, "Clean text of one. Clean text of two. Clean text of three.", "x", 1)]
    _, out = cut(spark, rows)
    assert out.columns == ["doc_id", "text", "later", "removed_words"]
    got = {r.doc_id: r.text for r in out.collect()}
    assert got[0] == rows[0][1] and got[100] == rows[-1][1]
    assert all(got[i] == f"Own{i} start of it. Own{i} end of it all. And more{i}." for i in range(1, 30))


def test_edge_cases(spark):
    long = "".join(f"Sentence number {i} of a long text. " for i in range(20_000))
    rows = [
        (1, None, None, None), (2, "", None, None), (3, " \n ", None, None), (4, long, None, None), (5, long, None, None),
        (6, PASSAGE, None, None), (6, PASSAGE, None, None), (None, PASSAGE, None, None), (None, None, None, None),
        (7, (PASSAGE + " ") * 3, None, None), (8, "One. Two. Three.", None, None), (9, "One. Two. Three.", None, None),
    ]
    _, out = cut(spark, rows)
    got = sorted(((r.doc_id is None, r.doc_id, r.text) for r in out.collect()), key=str)
    by_id = {(r[1], n): r[2] for n, r in enumerate(got)}
    texts = {}
    for (doc_id, _), text in by_id.items():
        texts.setdefault(doc_id, []).append(text)
    assert texts[1] == [None] and texts[2] == [""] and texts[3] == [" \n "] and texts[4] == [long] and texts[5] == [""]
    assert texts[6] == [PASSAGE, PASSAGE]
    assert sorted(texts[None], key=str) == ["", None]
    assert texts[7] == [""]
    assert texts[8] == texts[9] == ["One. Two. Three."]
    assert cut(spark, [])[1].count() == 0


def test_repeats_inside_a_text(spark):
    _, out = cut(spark, [(1, (PASSAGE + " ") * 3, None, None)])
    # the runs that lead from one copy to the next repeat in the third
    assert out.first().text == PASSAGE + " "


def test_equals_sql(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    con = duckdb.connect()
    documents = docs.toArrow()  # noqa: F841
    con.execute("CREATE TABLE documents AS SELECT * FROM documents")
    count, only = compare.differences(substrings.query(docs), con, substrings.ORACLE)
    assert not only and count


def test_short_sentences_do_not_match_by_chance(spark):
    import random

    dice = random.Random(1)
    rows = [(i, " ".join(dice.choice("THE OF AND TO IN A".split()) + "!!" for _ in range(60)), None, None) for i in range(200)]
    _, out = cut(spark, rows)
    assert out.where("removed_words > 0").count() == 0


def test_every_piece_is_covered_by_runs():
    import random

    dice = random.Random(2)
    for _ in range(300):
        text = "".join(" ".join(f"w{dice.randrange(50)}" for _ in range(dice.randint(1, 9))) + f" {n}. " for n in range(dice.randint(20, 40)))
        found = substrings.pieces([text], substrings.Tokens(), substrings.Spans())
        assert "".join(text[a:z] for a, z in zip(found.begin, found.end)) == text
        if len(found.first):
            assert {n for a, z in zip(found.first, found.stop) for n in range(a, z)} == set(range(len(found.text)))


def test_runs_equal_a_plain_statement_of_the_rule():
    import hashlib
    import random

    dice = random.Random(8)
    words = ["alpha", "beta", "gamma", "delta", "a", "日", "本", "über", "x" * 70]
    spans = substrings.Spans()

    def plain(text):
        tokens = substrings.TOKENS.findall(text)
        assert "".join(tokens) == text
        order = [hashlib.md5(x.strip(" \t\r\n").encode()).hexdigest()[:8] for x in tokens]
        ends = [any(c in x for c in ".!?。！？\n") for x in tokens]
        parts, held = [], []
        for i, token in enumerate(tokens):
            held.append(token)
            inside = 3 <= i < len(tokens) - 3 and not any(ends[i - 3 : i + 3])
            if ends[i] or i == len(tokens) - 1 or (inside and order[i] == min(order[i - 3 : i + 4])):
                parts.append(held)
                held = []
        size = [sum(len("".join(x.split()).encode()) for x in part) for part in parts]
        runs = set()
        for a in range(len(parts)):
            fit = [z for z in range(a + 3, len(parts) + 1) if sum(size[a:z]) >= spans.run_bytes]
            runs |= {(a, fit[0])} if fit else set()
        for z in range(len(parts) + 1):
            fit = [a for a in range(0, z - 2) if sum(size[a:z]) >= spans.run_bytes]
            runs |= {(fit[-1], z)} if fit else set()
        told = {(a, z): " ".join(x.strip() for part in parts[a:z] for x in part if x.strip()) for a, z in runs}
        return ["".join(part) for part in parts], told

    texts = [None, ""]
    for _ in range(200):
        texts.append("".join(dice.choice(words) + dice.choice([" ", " ", " ", "", ". ", "\n", " \n", "。", "  "]) for _ in range(dice.randint(0, 80))))
    found = substrings.pieces(texts, substrings.Tokens(), spans)
    by_hash = {}
    for n, text in enumerate(texts):
        parts, told = plain(text or "")
        mine = found.text == n
        assert [(text or "")[a:z] for a, z in zip(found.begin[mine], found.end[mine])] == parts
        low = int(mine.argmax()) if parts else 0
        own = found.text[found.first] == n if len(found.text) else []
        got = {(a - low, z - low): (x, y) for a, z, x, y in zip(found.first[own], found.stop[own], found.h1[own], found.h2[own])}
        assert set(got) == set(told)
        for at, words_of_run in told.items():
            assert by_hash.setdefault(got[at], words_of_run) == words_of_run
    assert len(by_hash) == len(set(by_hash.values()))


def test_passage_in_mid_sentence_behind_leads_of_other_lengths(spark):
    import random

    dice = random.Random(4)
    word = lambda: "".join(dice.choice("abcdefghijklmnop") for _ in range(6))
    for _ in range(5):
        passage = [word() for _ in range(60)]
        rows = [(1, " ".join([word() for _ in range(3)] + passage + [word()]) + ".", None, None)]
        rows += [(2, " ".join([word() for _ in range(7)] + passage + [word() for _ in range(9)]) + ".", None, None)]
        got = {r.doc_id: r for r in cut(spark, rows)[1].collect()}
        assert got[1].text == rows[0][1]
        # Only the pieces at both ends hold other words, too.
        assert got[2].removed_words >= 30 and all(x in got[2].text for x in rows[1][1].split()[:7])


def test_texts_without_spaces(spark):
    letters = "春夏秋冬山川海空雨雪風花鳥月日星木火土金水人犬猫本文字語言手足目耳口"
    passage = "".join(letters[i % 7 : i % 7 + 12] + letters[i : i + 5] + "。" for i in range(10))
    rows = [(i, f"始{letters[i]}。{passage}終{letters[i + 1]}。", None, None) for i in range(4)]
    got = {r.doc_id: r.text for r in cut(spark, rows)[1].collect()}
    assert got[0] == rows[0][1] and all(got[i] == f"始{letters[i]}。終{letters[i + 1]}。" for i in (1, 2, 3))


def test_short_repeated_regions_go_whole(spark):
    shared = "The first shared line has words. The second shared line has words. The third shared line has a few more words than both of them."
    rows = [(1, shared, None, None), (2, f"Own words stay here. {shared} Own words stay there.", None, None)]
    got = {r.doc_id: r for r in cut(spark, rows)[1].collect()}
    assert got[2].text == "Own words stay here. Own words stay there." and got[2].removed_words == 25


def test_written_tables_leave_no_shuffles(spark):
    """What was shuffled for a written table does not stay on disk beside it."""
    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffles():
        files = blocks.getAllFiles()
        names = [files.apply(i).getName() for i in range(files.size())]
        return {name for name in names if name.startswith("shuffle_")}

    before = shuffles()
    docs = spark.range(1000).selectExpr("id % 10 AS k").repartition(4)
    table = written(docs.groupBy("k").count(), "counts")
    deadline = time.monotonic() + 10
    while shuffles() - before and time.monotonic() < deadline:
        time.sleep(0.2)
    assert not shuffles() - before and table.count() == 10
    assert spark.conf.get(SHUFFLE_CLEANUP) == "false"
