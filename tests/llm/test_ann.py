"""Nearest neighbours against brute force: recall, exact scores, order, edge cases."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tillsight.llm import ann


def brute(rows, k=20, every=20):
    rows = [(i, np.array(v, dtype=float)) for i, v in rows if i is not None and v is not None and None not in v]
    rows = [(i, v) for i, v in rows if len(v) and np.isfinite(v).all() and (v**2).sum() > 0]
    out = {}
    for i, q in rows:
        if i % every == 0:
            out[i] = sorted(((-float(v @ q), j) for j, v in rows if j != i))[:k]
    return out


def compared(spark, rows, search=ann.Search()):
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<float>, label int, V string")
    got = {}
    for r in ann.nearest(df, F.col("vec_id") % 20 == 0, search).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    want = brute([(i, np.array(v, np.float32).tolist() if v and None not in v else v) for i, v in rows], search.k)
    hits = total = 0
    vectors = {i: np.array(v, np.float32).astype(float) for i, v in rows if v is not None and None not in v}
    for q, true in want.items():
        own = got.pop(q, [])
        assert [r for r, _, _ in own] == list(range(1, len(own) + 1)) and len(own) == len(true)
        assert own == sorted(own, key=lambda x: (-x[2], x[1]))
        assert all(abs(s - float(vectors[j] @ vectors[q])) < 1e-9 for _, j, s in own)
        hits += len({j for _, j in true} & {j for _, j, _ in own})
        total += len(true)
    assert not got
    return hits / total if total else 1.0


@pytest.mark.parametrize("kind", ["uniform", "clustered", "norms"])
def test_recall(spark, kind):
    dice = np.random.default_rng(4)
    x = dice.standard_normal((3000, 24))
    if kind == "clustered":
        x = x * 0.3 + dice.standard_normal((12, 24))[dice.integers(0, 12, 3000)]
    if kind == "norms":
        x *= dice.lognormal(size=(3000, 1))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    assert compared(spark, rows, ann.Search(per_list=100, block=70, queries=20)) >= 0.93


def test_edge_cases(spark):
    nan, inf = float("nan"), float("inf")
    same = [1.0, 2.0, 3.0]
    rows = [(i, same) for i in range(100, 160)] + [(200, [0.0, 0.0, 0.0]), (220, None), (240, [1.0, nan, 0.0]), (260, [1.0, inf, 0.0])]
    rows += [(280, []), (None, same), (0, [1.0, None, 2.0]), (20, [1.0, 0.0, 0.0]), (21, [-1.0, 0.0, 0.0])]
    assert compared(spark, rows) == 1.0
    assert compared(spark, [(20, same), (21, [1.0, 0.0, 0.0])]) == 1.0
    assert compared(spark, [(20, same)]) == 1.0
    assert compared(spark, []) == 1.0
    empty = spark.createDataFrame([(1, [1.0])], "vec_id long, embedding array<float>")
    assert ann.query(empty).count() == 0


def test_given_embeddings(spark, folder):
    df = spark.read.parquet(f"{folder}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    want = brute(rows)
    found = ann.query(df).collect()
    hits = sum(r.vec_id in {j for _, j in want[r.query_id]} for r in found)
    assert hits >= 0.9 * sum(map(len, want.values())) and len(found) == sum(map(len, want.values()))


def test_candidates_are_abandoned():
    dice = np.random.default_rng(1)
    x = dice.standard_normal((1000, 65))
    q = x[:3] + 0.01
    square = ((x[None] - q[:, None]) ** 2).sum(axis=2)
    bounds = np.sort(square, axis=1)[:, 19]
    for few in (0.0, 0.1, 1.0):  # all as products, both ways, all pair by pair
        at, to = ann.scan(np.ascontiguousarray(x.T), q, bounds, ann.Search(few=few))
        for n in range(3):
            kept = set(to[at == n])
            assert set(np.argsort(square[n])[:18]) <= kept and len(kept) <= 20
