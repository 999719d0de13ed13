"""The Jaccard join against brute force over all pairs, and its edge cases."""

from __future__ import annotations

import random
import re

import pytest

from tillsight.llm import components, jaccard


def sets(rows):
    out = []
    for _, text in rows:
        w = re.findall(r"\w+", (text or "").lower())
        out.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    return out


def brute(rows, threshold=0.8):
    own, n = sets(rows), len(rows)
    links = [[] for _ in rows]
    index = {}
    for i, s in enumerate(own):
        for x in s:
            index.setdefault(x, []).append(i)
    for i, s in enumerate(own):
        for j in {j for x in s for j in index[x] if j != i}:
            if len(s & own[j]) >= threshold * len(s | own[j]) - 1e-12:
                links[i].append(j)
    group = [None] * n
    for i in range(n):
        if group[i] is None:
            seen, todo = {i}, [i]
            while todo:
                for j in links[todo.pop()]:
                    if j not in seen:
                        seen.add(j)
                        todo.append(j)
            ids = [rows[j][0] for j in seen if rows[j][0] is not None]
            for j in seen:
                group[j] = min(ids) if ids else -1
    return sorted(((str(r[0]), None if g == -1 else g, len(ln)) for r, g, ln in zip(rows, group, links)), key=str)


def made(seed, families, copies):
    dice = random.Random(seed)
    rows = []
    for f in range(families):
        base = [f"w{dice.randrange(900)}" for _ in range(dice.randint(3, 120))]
        for _ in range(copies):
            text = list(base)
            for _ in range(dice.randint(0, 4)):
                text[dice.randrange(len(text))] = f"x{dice.randrange(900)}"
            rows.append((len(rows), " ".join(text)))
    return rows


EDGE = [
    (9001, None), (9002, ""), (9003, " !! "), (9004, "one"), (9005, "One!"), (9005, "One!"), (None, "one"),
    (None, "lonely text that nobody else has at all"), (None, None),
    (9006, "same id " * 3 + "first"), (9006, "other words with the same id, second text"),
    (9007, "very long " + " ".join(f"t{i}" for i in range(60_000))), (9008, "very long " + " ".join(f"t{i}" for i in range(59_000))),
]


@pytest.mark.parametrize("block", [400, 3])
def test_equals_brute_force(spark, block):
    rows = made(5, 40, 12) + EDGE
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, node string, Key int")
    found = jaccard.near_duplicates(docs, jaccard.Forest(block_nodes=block))
    got = sorted(((str(r.doc_id), r.class_id, r.n_links) for r in found.collect()), key=str)
    assert got == brute(rows)
    if block == 3:
        kept = jaccard.one_of_each(docs).collect()
        groups = {(r.root, r.class_id) for r in found.collect() if r.node is not None}
        wordless = sum(1 for s in sets(rows) if not s)
        assert len(kept) == len(groups) + wordless
        assert {r.doc_id for r in kept} == {r.class_id for r in found.collect()}


def test_given_documents(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    got = sorted(((str(r.doc_id), r.class_id, r.n_links) for r in jaccard.query(docs).collect()), key=str)
    assert got == brute(rows)


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard.query(docs).count() == 0 and jaccard.one_of_each(docs).count() == 0


def test_depth_follows_the_target():
    assert jaccard.Forest(recall=0.5).depth() > jaccard.Forest(recall=0.99999).depth()


def test_components(spark):
    dice = random.Random(2)
    pairs = [(i, i + 1) for i in range(200) if i % 50] + [(1000, 1000 + i) for i in range(300)]
    dice.shuffle(pairs)
    got = dict(tuple(r) for r in components.components(spark.createDataFrame(pairs, "a long, b long")).collect())
    for a, b in pairs:
        assert got.get(a, a) == got.get(b, b)
    assert len(set(got.values())) == 5
