"""Toxicity: gradients, held-out accuracy, whole texts, edge cases."""

from __future__ import annotations

import random

import numpy as np

from tillsight.llm import toxicity as tx

SMALL = tx.Settings(window=6, bits=6, state=3, width=2, steps=3, batch=8)


def test_gradients():
    network = tx.Network(SMALL)
    network.p = {k: v.astype(np.float64) for k, v in network.p.items()}
    dice = np.random.default_rng(1)
    found = dice.integers(0, 64, size=(6, 4, 6)).astype(np.int32)
    found[..., 1:] += 64
    mask = np.ones((6, 4), bool)
    mask[3:, 1], mask[1:, 2] = False, False
    label = np.array([1, 0, 1, 0])

    def loss():
        gates = network.projected(found.reshape(-1, 6)).reshape(6, 4, -1)
        x = network.logits(gates, mask)
        return float(np.mean(np.log1p(np.exp(x)) - label * x))

    g = network.gradients(found, mask, label)
    rows, values = g.pop("table")
    table = np.zeros_like(network.p["table"])
    table[rows] = values
    g["table"] = table
    for name, grad in g.items():
        at = np.unravel_index(np.argmax(np.abs(grad)), grad.shape)
        kept = network.p[name][at]
        ends = []
        for move in (1e-4, -1e-4):
            network.p[name][at] = kept + move
            ends.append(loss())
        network.p[name][at] = kept
        assert abs((ends[0] - ends[1]) / 2e-4 - grad[at]) < 2e-3 * max(1, abs(grad[at])), name


def texts(count, seed):
    dice = random.Random(seed)
    out = []
    for n in range(count):
        words = [f"w{dice.randrange(300)}" for _ in range(dice.randint(5, 200))]
        if n % 4 == 0:
            words[dice.randrange(len(words))] = "vilest" + dice.choice(["er", "ing", "ando"])
        out.append((n, " ".join(words), int(n % 4 == 0)))
    return out


def test_learns_and_scores_whole_texts(spark):
    rows = texts(800, 1)
    tail = ("calm words " * 30_000) + "vilester"
    extra = [(5000, tail, None), (5001, "calm words " * 30_000, None), (5002, None, None), (5003, "", None), (5003, "", None)]
    schema = "doc_id long, text string, score string, Predicted int, keep string"
    docs = spark.createDataFrame([(i, t, "x", 1, "k") for i, t, _ in rows + extra], schema)
    labels = spark.createDataFrame([(i, y, 1) for i, _, y in rows], "doc_id long, toxic int, quality int")
    out = tx.toxicity(docs.withColumnRenamed("keep", "toxic"), labels).withColumnRenamed("toxic", "keep")
    assert out.columns == ["doc_id", "text", "keep", "score", "predicted"]
    got = {r.doc_id: r for r in out.withColumn("out", tx.held_out(out.doc_id)).collect()}
    held = [(got[i].predicted, y) for i, _, y in rows if got[i].out]
    assert sum(p == y for p, y in held) >= 0.95 * len(held) and len(held) > 100
    assert got[5000].predicted == 1 and got[5001].predicted == 0  # the last word of a long text counts
    assert got[5002].score == got[5003].score and 0 <= got[5002].score < 0.5
    assert out.count() == len(rows) + len(extra)
    empty = docs.limit(0)
    assert tx.query(empty, labels).count() == 0
    assert {r.score for r in tx.query(docs, labels.limit(0)).collect()} == {0.0}


def test_same_batch_or_alone():
    network = tx.trained([(t, y) for _, t, y in texts(80, 3)], tx.Settings(steps=5))
    some = [t for _, t, _ in texts(40, 4)] + ["", None, "one"]
    together = tx.Scorer(network)(some)
    alone = [tx.Scorer(network)([t])[0] for t in some]
    assert np.allclose(together, alone, atol=1e-5)


def test_middles_of_words_count():
    rows = [(t, y) for _, t, y in texts(800, 1)]
    scores = tx.Scorer(tx.trained(rows))(["calm words", *(f"calm words abcd_vilest{end}_efgh words" for end in ("er", "ing", "ando"))])
    assert scores[0] < 0.5 and (scores[1:] > 0.5).all()
    plain, other = (tx.features([word], 16).chars.tolist() for word in ("abcdefgh" * 3, "abcdefgh" + "stuvwxyz" + "abcdefgh"))
    assert set(plain) != set(other) and len(plain) == 24 + 23 + 22


def test_given_documents(spark, folder):
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    got = tx.query(docs, labels).join(labels, "doc_id").collect()
    assert sum(r.predicted == r.toxic for r in got) >= 0.9 * len(got)
