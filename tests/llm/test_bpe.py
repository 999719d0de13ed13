"""Encoding against the tiktoken library, and the exact round trip."""

from __future__ import annotations

import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken

from tillsight.llm import bpe
from tillsight.llm.queries import VOCABULARY

PATH, PATTERN = public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def odd_texts():
    dice = random.Random(3)
    letters = "ab é ñ,.' \n\t\x1c\x85  　​12!?sd日本🙂̀"
    texts = ["", None, "a" * 500, "ab" * 300, "<|endoftext|>", "\0\x01 \n\n \t x", "é" * 99, " " * 77 + "x", "z" * 30_000]
    return texts + ["".join(dice.choice(letters) for _ in range(dice.randint(1, 60))) for _ in range(800)]


@pytest.mark.parametrize("spaced", [True, False])
@pytest.mark.parametrize("known", [0, 1 << 20])
def test_same_ids_as_the_library(library, spaced, known):
    encoder = bpe.Encoder(PATH, PATTERN, spaced, known)
    texts = odd_texts()
    for start in range(0, len(texts), 100):
        part = texts[start : start + 100]
        for text, ids in zip(part, encoder(part)):
            assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(text or "")


def test_frequent_words_are_merged_once():
    """What a full dictionary forgets is what was not met for longest."""
    encoder = bpe.Encoder(PATH, PATTERN, True, 160_000)
    replay, merged = encoder.vocabulary.replay, []
    frequent = [f"zq{chr(97 + n % 26)}xj{chr(97 + n // 26)}vk" for n in range(100)]

    class Counted:
        def replay(self, words):
            merged.extend(bytes(word).decode().strip() for word in words)
            return replay(words)

    encoder.vocabulary = Counted()
    for step in range(20):
        encoder([" ".join(["a", *frequent])])
        encoder([" ".join(["a", *(f"wq{chr(97 + n % 26)}{chr(97 + n // 26)}{chr(97 + step)}vk" for n in range(100))])])
    assert sum(word in frequent for word in merged) == 100
    assert len(merged) > 2000 and encoder.held <= 160_000


def test_the_pattern_runs_once_over_the_new_pieces_of_a_slice(library):
    encoder = bpe.Encoder(PATH, PATTERN, True)
    split, calls = encoder.split, []

    def counted(text):
        calls.append(text)
        return split(text)

    encoder.split = counted
    texts = ["It's one, two\n(three) 4four's", "five six's\nseven!? é日本1", "a"]
    assert [np.frombuffer(ids, "<u4").tolist() for ids in encoder(texts)] == list(map(library.encode_ordinary, texts))
    assert len(calls) == 1


def test_every_white_space_between_words(library):
    """Texts that are cut before the pattern runs and texts that are not share a dictionary."""
    spaces = [chr(n) for n in range(0x110000) if chr(n).isspace()] + ["\0", "\u200b", "\u180e", "\ufeff"]
    texts = [f"{a}one{b}two's{a}{b}3{b}{a}\n!?{a}" for a in spaces for b in (" ", "\n", "", a)]
    texts += [f"x{a}y" for a in spaces] + ["a  b", "a b", " ", "\n", " \n", "\n ", "b\nc"]
    encoder = bpe.Encoder(PATH, PATTERN, True)
    for part in (texts, texts[::-1], *([text] for text in texts)):
        assert [np.frombuffer(ids, "<u4").tolist() for ids in encoder(part)] == list(map(library.encode_ordinary, part))


def test_decoding_ids_of_any_layout(library):
    packed = [np.array(library.encode_ordinary(x), "<u4").tobytes() for x in ("", "é one two", "日本")]
    tokens = bpe.token_bytes(PATH)
    rows = pa.array([packed[1], None, *packed], pa.binary())
    assert bpe.decoded_bytes(rows, tokens).to_pylist() == ["é one two".encode(), b"", b"", "é one two".encode(), "日本".encode()]
    assert bpe.decoded_bytes(rows[1:4], tokens).to_pylist() == [b"", b"", "é one two".encode()]
    assert bpe.decoded_bytes(rows[1:3], tokens).to_pylist() == [b"", b""]
    for bad in (b"abc", np.array([1 << 30], "<u4").tobytes()):
        with pytest.raises((ValueError, IndexError)):
            bpe.decoded_bytes(pa.array([bad]), tokens)


def test_query(spark, folder, library):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    extra = spark.createDataFrame([(None, None), (-1, ""), (-2, "two"), (-2, "two")], "doc_id long, text string")
    every = docs.select("doc_id", "text").unionByName(extra)
    got = bpe.query(every, PATH, PATTERN).collect()

    def row(doc_id, text):
        ids = np.array(library.encode_ordinary(text or ""), dtype="<u4")
        sha = [hashlib.sha256(x).hexdigest() for x in (ids.tobytes(), (text or "").encode())]
        return (doc_id, len(ids), *sha)

    assert sorted(map(tuple, got), key=str) == sorted((row(*r) for r in every.collect()), key=str)


def test_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a b", "x", 2)], "doc_id long, text string, IDS string, decoded int")
    for out in (bpe.decode(bpe.encode(docs, PATH, PATTERN), PATH), bpe.round_trip(docs, PATH, PATTERN)):
        assert out.columns == ["doc_id", "text", "ids", "decoded"]
        assert bytes(out.first().decoded) == b"a b"
    assert bpe.query(docs.limit(0), PATH, PATTERN).count() == 0
