"""Toxicity: a bidirectional gated recurrent network with attention pooling, in numpy.

A text is a sequence of words (lower-case runs of letters, digits, underscores). A
word has two inputs: an embedding of the word itself and one of its characters, the
sum over all runs of three, four and five characters of the whole word, its ends
marked, as the mean of the three lengths; both look up hashed tables. Windows of ``window`` words, each
overlapping the next by half, cover the whole text; the last one ends with it. A
forward and a backward network read a window, attention pools their states, and the
text's score is a calibrated logistic of its highest window.

Training takes a bounded sample: at most ``sample`` labelled rows of either label, in
the order of a hash, with texts of at most ``sample_chars`` characters, from rows the
caller declares not held out. One input of each table starts as the smoothed log-odds
of its feature in the sample. Labels hold for whole texts, so training goes twice
over the windows that score highest, first by those odds, then by the network. The
model (about ``2 ** bits * 48`` bytes) goes to the tasks; all texts are scored there.

Defined results: texts without words (missing, empty, only signs) have one empty
window and its score; repeated rows and equal texts score the same; without rows of
both labels every score is 0. A row without id is scored and never a training row. An
empty table gives an empty table. Only the text is an input of a score. Extra columns
pass through, and columns named ``score`` or ``predicted`` are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import prepared, slices

WORDS = re.compile(r"\w+")
SLICE = 2 << 20
KNOWN = 250_000
GRAMS = (3, 4, 5)
#: Characters of words that are looked up at once.
PIECE = 1 << 18


@dataclass(frozen=True)
class Settings:
    window: int = 32
    width: int = 6
    state: int = 8
    bits: int = 16
    sample: int = 2000
    sample_chars: int = 8000
    steps: int = 160
    batch: int = 128
    rate: float = 0.01
    seed: int = 11

    @property
    def stride(self) -> int:
        return self.window // 2


@dataclass(frozen=True)
class Inputs:
    """Buckets of words: their own, and those of their character runs, one word after the other."""

    own: np.ndarray
    chars: np.ndarray
    counts: np.ndarray

    @staticmethod
    def dense(found: np.ndarray) -> Inputs:
        """From one row per word: its own bucket, then those of its characters."""
        return Inputs(found[:, 0], found[:, 1:].ravel(), np.full(len(found), found.shape[1] - 1))

    def picked(self, at: np.ndarray) -> Inputs:
        counts = self.counts[at]
        begins = (np.cumsum(self.counts) - self.counts)[at]
        within = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        return Inputs(self.own[at], self.chars[np.repeat(begins, counts) + within], counts)

    def words(self) -> np.ndarray:
        """The word of every character run."""
        return np.repeat(np.arange(len(self.own)), self.counts)


def features(words: list[str], bits: int) -> Inputs:
    """The words' own buckets and those of their characters; the tables lie one after the other."""
    mask, size = (1 << bits) - 1, 1 << bits
    hashed = xxhash.xxh3_64_intdigest
    own = np.array([hashed(word.encode("utf-8", "surrogatepass")) & mask for word in words], dtype=np.int32)
    codes = np.frombuffer("".join(f"<{word}>" for word in words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    word = np.repeat(np.arange(len(words), dtype=np.int32), [len(word) + 2 for word in words])
    chars, owner = [], []
    for length in GRAMS:
        last = max(len(codes) - length + 1, 0)
        inside = np.flatnonzero(word[:last] == word[length - 1 :][:last])
        run = np.full(len(inside), length, dtype=np.uint64)
        for at in range(length):
            run = (run ^ codes[inside + at]) * np.uint64(0x9E3779B97F4A7C15)
            run ^= run >> np.uint64(29)
        chars.append((size + (run & np.uint64(mask))).astype(np.int32))
        owner.append(word[inside])
    owner = np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    return Inputs(own, np.concatenate(chars)[order], np.bincount(owner, minlength=len(words)))


def pieces(words: list[str]) -> Iterator[list[str]]:
    """The words in lists of about ``PIECE`` characters."""
    start, held = 0, 0
    for at, word in enumerate(words):
        if at > start and held + len(word) > PIECE:
            yield words[start:at]
            start, held = at, 0
        held += len(word)
    if words:
        yield words[start:]


def words_of(text: str | None) -> list[str]:
    return WORDS.findall(text.lower()) if text else []


def starts(count: int, settings: Settings) -> list[int]:
    """Where the windows over ``count`` words start."""
    if count <= settings.window:
        return [0]
    return [*range(0, count - settings.window, settings.stride), count - settings.window]


def _logistic(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Network:
    """Parameters, and the forward and backward passes. Directions are stacked in front."""

    def __init__(self, settings: Settings):
        self.settings = settings
        dice = np.random.default_rng(settings.seed)
        d, h = 2 * settings.width, settings.state
        scale = lambda *shape: (dice.standard_normal(shape) / np.sqrt(shape[-2])).astype(np.float32)
        self.p = {
            "table": (0.05 * dice.standard_normal((2 << settings.bits, settings.width))).astype(np.float32),
            "w": scale(2, d, 3 * h), "u": scale(2, h, 3 * h), "b": np.zeros((2, 1, 3 * h), np.float32),
            "a": scale(2 * h, h), "v": scale(h, 1)[:, 0], "o": scale(2 * h, 1)[:, 0], "c": np.zeros(1, np.float32),
        }
        self.line = (1.0, 0.0)  # calibration of a text's highest window

    def vectors(self, found: Inputs | np.ndarray) -> np.ndarray:
        """Inputs of words, from their buckets."""
        found = found if isinstance(found, Inputs) else Inputs.dense(found)
        table, words = self.p["table"], found.words()
        sums = [np.bincount(words, weights=table[found.chars, k], minlength=len(found.own)) for k in range(self.settings.width)]
        return np.concatenate((table[found.own], (np.stack(sums, axis=1) / len(GRAMS)).astype(table.dtype)), axis=1)

    def projected(self, found: Inputs | np.ndarray) -> np.ndarray:
        """What words give to the gates of both directions."""
        x = self.vectors(found)
        return np.concatenate([x @ self.p["w"][k] + self.p["b"][k] for k in (0, 1)], axis=1)

    def read(self, gates: np.ndarray, mask: np.ndarray, keep: bool = False):
        """gates: (steps, windows, 2 * 3 * states) by step; mask: (steps, windows)."""
        steps, windows, _ = gates.shape
        h = self.settings.state
        state = np.zeros((2, windows, h), np.float32)
        states = np.empty((steps, windows, 2 * h), np.float32)
        memory = []
        full = bool(mask.all())
        for t in range(steps):
            back = steps - 1 - t
            x = np.stack((gates[t, :, : 3 * h], gates[back, :, 3 * h :]))
            inner = state @ self.p["u"]
            zr = _logistic(x[..., : 2 * h] + inner[..., : 2 * h])
            z, r = zr[..., :h], zr[..., h:]
            n = np.tanh(x[..., 2 * h :] + r * inner[..., 2 * h :])
            new = n + z * (state - n)
            m = None
            if not full:
                m = np.stack((mask[t], mask[back]))[..., None]
                new = np.where(m, new, state)
            if keep:
                memory.append((state, z, r, n, inner[..., 2 * h :], m))
            state = new
            states[t, :, :h], states[back, :, h:] = state[0], state[1]
        return states, memory

    def pool(self, states: np.ndarray, mask: np.ndarray):
        hidden = np.tanh(states @ self.p["a"])
        energy = np.where(mask, hidden @ self.p["v"], np.float32(-1e9))
        weight = np.exp(energy - energy.max(axis=0)) * mask
        weight /= np.maximum(weight.sum(axis=0), 1e-9)
        pooled = (weight[..., None] * states).sum(axis=0)
        return hidden, weight, pooled, pooled @ self.p["o"] + self.p["c"]

    def logits(self, gates: np.ndarray, mask: np.ndarray) -> np.ndarray:
        return self.pool(self.read(gates, mask)[0], mask)[3]

    def gradients(self, found: np.ndarray, mask: np.ndarray, label: np.ndarray, known: Inputs | None = None) -> dict[str, np.ndarray]:
        """found: (steps, windows, features), or words of ``known``, (steps, windows). The mean logistic loss's gradients."""
        p, h = self.p, self.settings.state
        steps, windows = found.shape[:2]
        if known is None:
            there, place = Inputs.dense(found.reshape(steps * windows, -1)), np.arange(steps * windows)
        else:
            met, place = np.unique(found, return_inverse=True)
            there, place = known.picked(met), place.ravel()
        x = self.vectors(there)[place]
        gates = np.concatenate([x @ p["w"][k] + p["b"][k] for k in (0, 1)], axis=1).reshape(steps, windows, -1)
        states, memory = self.read(gates, mask, keep=True)
        hidden, weight, pooled, logit = self.pool(states, mask)
        g = {name: np.zeros_like(value) for name, value in p.items() if name != "table"}
        d_logit = ((_logistic(logit) - label) / windows).astype(np.float32)
        g["o"], g["c"] = pooled.T @ d_logit, d_logit.sum(keepdims=True)
        d_pooled = d_logit[:, None] * p["o"]
        d_states = weight[..., None] * d_pooled
        d_weight = (states * d_pooled).sum(axis=2)
        d_energy = weight * (d_weight - (weight * d_weight).sum(axis=0))
        g["v"] = np.einsum("twh,tw->h", hidden, d_energy)
        d_hidden = d_energy[..., None] * p["v"] * (1 - hidden**2)
        g["a"] = np.einsum("tws,twh->sh", states, d_hidden)
        d_states = d_states + d_hidden @ p["a"].T
        d_gates = np.zeros_like(gates)
        carried = np.zeros((2, windows, h), np.float32)
        for t in range(steps - 1, -1, -1):
            back = steps - 1 - t
            state, z, r, n, inner, m = memory[t]
            d_new = carried + np.stack((d_states[t, :, :h], d_states[back, :, h:]))
            d_kept = 0.0
            if m is not None:
                d_kept = np.where(m, 0, d_new)
                d_new = np.where(m, d_new, 0)
            d_z = d_new * (state - n) * z * (1 - z)
            d_n = d_new * (1 - z) * (1 - n**2)
            d_r = d_n * inner * r * (1 - r)
            d_x = np.concatenate((d_z, d_r, d_n), axis=2)
            d_inner = np.concatenate((d_z, d_r, d_n * r), axis=2)
            d_gates[t, :, : 3 * h], d_gates[back, :, 3 * h :] = d_x[0], d_x[1]
            g["u"] += state.transpose(0, 2, 1) @ d_inner
            carried = d_new * z + d_inner @ p["u"].transpose(0, 2, 1) + d_kept
        d_gates = d_gates.reshape(steps * windows, 2, 3 * h)
        g["w"] = np.stack([x.T @ d_gates[:, k] for k in (0, 1)])
        g["b"] = d_gates.sum(axis=0)[:, None, :]
        d_vectors = sum(d_gates[:, k] @ p["w"][k].T for k in (0, 1))
        width = self.settings.width
        d_words = np.zeros((len(there.own), 2 * width), d_vectors.dtype)
        np.add.at(d_words, place, d_vectors)
        buckets, place = np.unique(np.concatenate((there.own, there.chars)), return_inverse=True)
        d_table = np.zeros((len(buckets), width), np.float32)
        np.add.at(d_table, place, np.concatenate((d_words[:, :width], d_words[there.words(), width:] / len(GRAMS))))
        g["table"] = (buckets, d_table)
        return g


class Adam:
    def __init__(self, p: dict[str, np.ndarray], rate: float):
        self.p, self.rate, self.t = p, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in p.items()}
        self.s = {k: np.zeros_like(v) for k, v in p.items()}

    def step(self, g: dict) -> None:
        self.t += 1
        for name, grad in g.items():
            at = slice(None)
            if isinstance(grad, tuple):  # only the rows that a batch touched
                at, grad = grad
            m = self.m[name][at] = 0.9 * self.m[name][at] + 0.1 * grad
            s = self.s[name][at] = 0.99 * self.s[name][at] + 0.01 * grad**2
            fix = np.sqrt(1 - 0.99**self.t) / (1 - 0.9**self.t)
            self.p[name][at] -= self.rate * fix * m / (np.sqrt(s) + 1e-7)


def _odds(network: Network, known: Inputs, docs: list[np.ndarray], labels: np.ndarray) -> None:
    """Set the first input of both tables to the smoothed log-odds of the features."""
    size = len(network.p["table"])
    counts = np.zeros((2, size))
    for found, label in zip(docs, labels):
        there = known.picked(np.unique(found))
        counts[int(label), np.unique(np.concatenate((there.own, there.chars)))] += 1
    total = np.maximum(np.bincount(labels.astype(int), minlength=2), 1)[:, None]
    share = (counts + 2 * total / total.sum()) / total
    odds = np.log(share[1] / share[0])
    odds[counts.sum(axis=0) < 3] = 0
    network.p["table"][:, 0] = odds


def trained(rows: list[tuple[str | None, int]], settings: Settings = Settings()) -> Network | None:
    """A network for labelled texts; None unless both labels occur."""
    labels = np.array([label for _, label in rows], dtype=np.float32)
    if len(set(labels.tolist())) < 2:
        return None
    rows = [*rows, ("", 0)]  # a text without words is not toxic; every batch says so
    labels = np.append(labels, np.float32(0))
    network = Network(settings)
    numbers: dict[str, int] = {"": 0}  # the word of padding, which masks hide
    docs = [np.array([numbers.setdefault(w, len(numbers)) for w in words_of(text)], dtype=np.int32) for text, _ in rows]
    parts = [features(piece, settings.bits) for piece in pieces(list(numbers))]
    known = Inputs(*(np.concatenate([getattr(part, name) for part in parts]) for name in ("own", "chars", "counts")))
    _odds(network, known, docs, labels)
    spans = [(d, s) for d, found in enumerate(docs) for s in starts(len(found), settings)]
    owner = np.array([d for d, _ in spans])
    size = settings.window
    odds = network.p["table"][:, 0]
    # First ranking of windows: the strongest word.
    words = odds[known.own] + np.bincount(known.words(), weights=odds[known.chars], minlength=len(known.own)) / len(GRAMS)
    strength = [words[found] if len(found) else np.zeros(1) for found in docs]
    ranking = np.array([strength[d][s : s + size].max() for d, s in spans])
    dice = np.random.default_rng(settings.seed)
    adam = Adam(network.p, settings.rate)

    def padded(chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        found = np.zeros((size, len(chosen)), np.int32)
        mask = np.zeros((size, len(chosen)), bool)
        for n, span in enumerate(chosen):
            part = docs[spans[span][0]][spans[span][1] :][:size]
            found[: len(part), n], mask[: len(part), n] = part, True
        return found, mask

    def scored() -> np.ndarray:
        out = []
        gates = np.concatenate([network.projected(known.picked(part)) for part in np.array_split(np.arange(len(numbers)), 1 + len(numbers) // 20_000)])
        for at in range(0, len(spans), 2048):
            found, mask = padded(np.arange(at, min(at + 2048, len(spans))))
            out.append(network.logits(gates[found], mask))
        return np.concatenate(out)

    for _ in range(2):
        order = np.lexsort((-ranking, owner))
        first = np.searchsorted(owner[order], np.arange(len(docs)))
        best, second = order[first], order[np.minimum(first + 1, len(order) - 1)]
        clean = labels[owner] == 0
        groups = [
            best[labels == 1],
            np.concatenate((best[labels == 0], second[(labels == 0) & (owner[second] == np.arange(len(docs)))])),
            np.flatnonzero(clean),
        ]
        parts = (settings.batch // 2, settings.batch // 4, settings.batch // 4)
        for _ in range(settings.steps):
            chosen = np.concatenate([dice.choice(group, part) for group, part in zip(groups, parts)])
            chosen[-2:] = len(spans) - 1
            found, mask = padded(chosen)
            adam.step(network.gradients(found, mask, labels[owner[chosen]], known))
        ranking = scored()
    highest = np.full(len(docs), -np.inf)
    np.maximum.at(highest, owner, ranking)
    network.line = _calibrated(highest, labels)
    return network


def _calibrated(x: np.ndarray, y: np.ndarray, pull: float = 1e-3) -> tuple[float, float]:
    """The logistic line through the highest windows of the training texts, by Newton steps."""
    line = np.array([1.0, 0.0])
    points = np.stack((x, np.ones(len(x))), axis=1)
    for _ in range(50):
        chance = 1 / (1 + np.exp(-np.clip(points @ line, -30, 30)))
        slope = points.T @ (chance - y) / len(y) + pull * (line - [1.0, 0.0])
        curve = (points * (chance * (1 - chance))[:, None]).T @ points / len(y) + pull * np.eye(2)
        line = line - np.clip(np.linalg.solve(curve, slope), -2, 2)
    return float(max(line[0], 1e-3)), float(line[1])


class Scorer:
    """Scores of whole texts. Words met before keep what they give to the gates."""

    def __init__(self, network: Network):
        self.network = network
        self.reset()

    def reset(self) -> None:
        width = 6 * self.network.settings.state
        self.rows: dict[str, int] = {}
        self.gates = np.zeros((1 << 14, width), np.float32)

    def ids(self, words: list[list[str]]) -> list[np.ndarray]:
        new = list(set().union(*words).difference(self.rows))
        if len(self.rows) + len(new) > KNOWN and self.rows:
            self.reset()
            new = list(set().union(*words))
        if new:
            held = len(self.rows)
            self.rows.update(zip(new, range(held, held + len(new))))
            if len(self.rows) > len(self.gates):
                grown = np.zeros((max(2 * len(self.gates), len(self.rows)), self.gates.shape[1]), np.float32)
                grown[:held] = self.gates[:held]
                self.gates = grown
            bits = self.network.settings.bits
            for piece in pieces(new):
                self.gates[held : held + len(piece)] = self.network.projected(features(piece, bits))
                held += len(piece)
        get = self.rows.__getitem__
        return [np.fromiter(map(get, own), dtype=np.int32, count=len(own)) for own in words]

    def __call__(self, texts: list[str | None]) -> np.ndarray:
        settings, size = self.network.settings, self.network.settings.window
        ids = self.ids([words_of(text) for text in texts])
        counts = np.array([len(x) for x in ids])
        begins = np.concatenate(([0], np.cumsum(counts)))[:-1]
        every = np.concatenate((*ids, np.zeros(size, np.int32)))
        at, owner, held = [], [], []
        for n, (count, begin) in enumerate(zip(counts.tolist(), begins.tolist())):
            own = starts(count, settings)
            at.extend(begin + s for s in own)
            owner.extend([n] * len(own))
            held.extend([min(count, size)] * len(own))
        at, owner, held = np.array(at), np.array(owner), np.array(held)
        highest = np.full(len(texts), -np.inf)
        # Full windows and short texts separately: full ones need no mask.
        for chosen in (np.flatnonzero(held == size), np.flatnonzero(held < size)):
            for start in range(0, len(chosen), 1024):
                part = chosen[start : start + 1024]
                gates = self.gates[every[at[part] + np.arange(size)[:, None]]]
                mask = np.arange(size)[:, None] < held[part]
                np.maximum.at(highest, owner[part], self.network.logits(gates, mask))
        slope, shift = self.network.line
        return 1 / (1 + np.exp(-np.clip(slope * highest + shift, -40, 40)))


def held_out(doc_id: Column) -> Column:
    """The fold that training never sees; a missing id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def sample(docs: DataFrame, labels: DataFrame, settings: Settings) -> list[tuple[str | None, int]]:
    """At most ``settings.sample`` rows of either label, none of them held out."""
    known = labels.where("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    usable = known.where(~held_out(F.col("doc_id")))
    short = docs.select("doc_id", "text").where(F.length("text") <= settings.sample_chars)
    there = usable.join(short.select(F.col("doc_id").alias("own_id")), F.col("own_id") == F.col("doc_id"), "left_semi")
    order = (F.xxhash64("doc_id", F.lit(settings.seed)), F.col("doc_id"))
    chosen = []
    for label in (0, 1):  # ids only: no text is shuffled or ordered
        chosen += there.where(F.col("toxic") == label).orderBy(*order).limit(settings.sample).collect()
    if not chosen:
        return []
    # At most 2 * settings.sample rows, so this side may be broadcast.
    ids = docs.sparkSession.createDataFrame([(int(r.doc_id), int(r.toxic)) for r in chosen], "own_id long, toxic int")
    texts = short.join(F.broadcast(ids), F.col("doc_id") == F.col("own_id")).groupBy("own_id", "toxic").agg(F.min("text").alias("text"))
    return [(row.text, row.toxic) for row in sorted(texts.collect(), key=lambda row: row.own_id)]


def scored(docs: DataFrame, network: Network | None) -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 from 0.5)."""
    kept = docs.select(*[f"`{c}`" for c in docs.columns if c.lower() not in ("score", "predicted")])
    if network is None:
        return kept.withColumns({"score": F.lit(0.0), "predicted": F.lit(0)})
    prepared(docs.sparkSession)
    schema = T.StructType([*kept.schema.fields, T.StructField("score", T.DoubleType())])
    place = [c.lower() for c in kept.columns].index("text")
    name = kept.columns[place]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(network)
        for batch in slices(batches, name, SLICE):
            scores = scorer(batch.column(place).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names=[*batch.schema.names, "score"])

    return kept.mapInArrow(run, schema).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def toxicity(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Train on a sample of the labelled documents and score all documents."""
    return scored(docs, trained(sample(docs, labels, settings), settings))


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    told = toxicity(docs.select("doc_id", "text"), labels)
    return told.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
