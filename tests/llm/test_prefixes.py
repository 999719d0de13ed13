"""Prefix tree: against SQL and brute force, in one block and in many."""

from __future__ import annotations

import hashlib
import random
import zlib

import compare
import duckdb
import pytest

from tillsight.llm import prefixes

SCHEMA = "conv_id long, turn long, role string, text string, depth string, PATH string"


@pytest.fixture(params=[1, 4])
def blocks(spark, request):
    """Whether the sorted conversations lie in one block or in several."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", str(request.param == 1).lower())
    yield request.param
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def expected(rows):
    """Nodes of all rebuilt conversations, counted one by one."""
    own = {}
    for conv, turn, role, text in sorted(
        (r[:4] for r in rows if r[0] is not None), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "")
    ):
        own.setdefault(conv, []).append((role or "", text or ""))
    nodes = {}
    for conv, turns in own.items():
        h = zlib.crc32(str(conv).encode()) % 6
        whole = own.get(conv - conv % 100, [])[:h] + turns[h:]
        for d in range(len(whole) + 1):
            node = nodes.setdefault(tuple(whole[:d]), ([], []))
            node[0].append(conv)
            if d == len(whole):
                node[1].append(conv)
    out = []
    for path, (members, ends) in nodes.items():
        below = [p for p in nodes if p[: len(path)] == path]
        out.append((
            min(members), len(path), min(nodes[path[:-1]][0]) if path else None, len(members),
            sum(len(p) == len(path) + 1 for p in below), sum(not any(len(q) == len(p) + 1 and q[: len(p)] == p for q in below) for p in below),
            sum((len(nodes[p][0]) - 1) * len(p[-1][1]) for p in below if p),
            hashlib.sha256(",".join(map(str, sorted(ends))).encode()).hexdigest(),
        ))
    return sorted(out, key=str)


def check(spark, rows):
    turns = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)
    got = prefixes.query(turns).collect()
    assert sorted((tuple(r[c] for c in prefixes.RESULT) for r in got), key=str) == expected(rows)
    return got


def test_equals_sql(spark, folder, blocks):
    con = compare.connect(folder)
    _, only = compare.differences(prefixes.query(spark.read.parquet(f"{folder}/conversations.parquet")), con, prefixes.ORACLE)
    assert not only


def test_small_alphabet(spark, blocks):
    """Few different turns, so that many conversations share long prefixes over the blocks' ends."""
    draw = random.Random(5)
    rows = []
    for conv in range(260):
        for turn in range(draw.choice([1, 2, 3, 8])):
            rows.append((conv, turn, "u" if turn % 2 else "a", draw.choice(["x", "é🙂", "yy"])))
    rows += [(conv, t, "u", "same") for conv in range(1000, 1300) for t in range(7)]  # one large group of copies
    check(spark, rows)


def test_edges(spark, blocks):
    rows = [(7, 0, "u", "a"), (100, None, None, None), (100, 3, "u", "b"), (100, 3, "u", "b"), (107, 1, "u", "")]
    rows += [(None, 1, "u", "nobody"), (-5, 2, "z", "long " * 50_000), (250, 0, "u", "a")]
    rows += [(301, t, "u", f"t{t}") for t in range(300)] + [(302, t, "u", f"t{t}") for t in range(299)]
    con = duckdb.connect()
    conversations = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)
    arrow = conversations.select("conv_id", "turn", "role", "text").toArrow()  # noqa: F841
    con.execute("CREATE TABLE conversations AS SELECT * FROM arrow")
    count, only = compare.differences(prefixes.query(conversations), con, prefixes.ORACLE)
    assert not only and count > 300


def test_conversations_without_turns(spark, blocks):
    # Their own turns go and the group's first conversation is absent: members of the root alone.
    short = [c for c in range(101, 160) if zlib.crc32(str(c).encode()) % 6 >= 2][:5]
    got = check(spark, [(c, t, "u", "gone") for c in short for t in range(2)])
    assert [(r.depth, r.n_convs, r.n_leaves, r.saved_tokens) for r in got] == [(0, 5, 1, 0)]


def test_empty(spark):
    assert prefixes.query(spark.createDataFrame([], SCHEMA)).count() == 0
