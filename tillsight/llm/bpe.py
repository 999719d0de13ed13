"""Byte-level BPE encoding and decoding by merge replay over a task's words.

A text is cut by the vocabulary's pattern. The distinct words of a slice of texts
that are not known yet form one corpus: their bytes lie side by side, linked to
their neighbours, and an inverted index leads from a pair of tokens (named by the
rank of its merge) to its positions. Merges are applied in rank order to all their
positions at once, and each touches only the two neighbouring pairs. Every different
piece of a slice is looked up once, and Arrow puts the ids of the texts together. Nothing is shuffled.

The replay gives what merging word by word gives: words are independent, and in a
word the lowest rank goes first, the leftmost position first. A merge may create a
pair of a lower rank than its own; the rest of that word then waits in the index
behind that pair. A word that is itself in the vocabulary is one token.

The dictionary of known words belongs to the Python worker and forgets those not
met for longest when it holds about ``KNOWN`` bytes, so memory is bounded; that changes no result. Ids are unsigned 32-bit little-endian
integers, one after the other, in a binary column.

Defined results: a missing or empty text has no ids and decodes to no bytes;
special tokens in a text are ordinary text; lone surrogates cannot occur in a Spark
string. Ids that the vocabulary lacks fail the decoder. Repeated rows are coded each. An
empty table gives an empty table. Extra columns pass through; columns named ``ids`` or ``decoded`` are replaced.
"""

from __future__ import annotations

import base64
import heapq
import re
from array import array
from collections.abc import Iterable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import prepared, slices

SLICE = 4 << 20
KNOWN = 32 << 20


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        pairs = (line.split() for line in lines if line.strip())
        return {base64.b64decode(token): int(rank) for token, rank in pairs}


class Vocabulary:
    """Ranks of a rank file, and the merges they mean."""

    def __init__(self, path: str):
        self.ranks = read_ranks(path)
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.bytes = np.array([self.ranks.get(bytes([b]), -1) for b in range(256)], dtype=np.int32)
        if (self.bytes < 0).any():
            raise ValueError("the vocabulary lacks single bytes")
        self.shift = max(self.tokens).bit_length()
        get = self.ranks.get
        keys, results = array("q"), array("i")
        for token, rank in self.ranks.items():
            for at in range(1, len(token)):
                head, tail = get(token[:at]), get(token[at:])
                if head is not None and tail is not None:
                    keys.append(head << self.shift | tail)
                    results.append(rank)
        order = np.argsort(keys)
        self.keys = np.array(keys, dtype=np.int64)[order]
        self.results = np.array(results, dtype=np.int32)[order]

    def merge(self, left: int, right: int) -> int:
        """The rank of the merge of two tokens, -1 if there is none."""
        return self.ranks.get(self.tokens[left] + self.tokens[right], -1)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The ranks of the merges of pairs of tokens, -1 where there is none."""
        keys = left.astype(np.int64) << self.shift | right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where((self.keys[at] == keys) & (left >= 0) & (right >= 0), self.results[at], -1)

    def replay(self, words: list[bytes]) -> list[bytes]:
        """The ids of every word, packed."""
        ranks = list(map(self.ranks.get, words))
        found = [None if rank is None else rank.to_bytes(4, "little") for rank in ranks]
        open_words = [n for n, rank in enumerate(ranks) if rank is None and words[n]]
        if open_words:
            corpus = Corpus(self, [words[n] for n in open_words])
            for n, ids in zip(open_words, corpus.merged()):
                found[n] = ids
        return [ids or b"" for ids in found]


class Corpus:
    """Words side by side: tokens, their neighbours, and an index from merges to positions."""

    #: Shorter lists of positions are faster in a loop than as arrays.
    FEW = 48

    def __init__(self, vocabulary: Vocabulary, words: list[bytes]):
        self.vocabulary = vocabulary
        text = np.frombuffer(b"".join(words), dtype=np.uint8)
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        self.ends = np.cumsum(lengths)
        total = len(text)
        self.token = vocabulary.bytes[text]
        self.right = np.arange(1, total + 1, dtype=np.int32)
        self.right[self.ends - 1] = -1
        self.left = np.arange(-1, total - 1, dtype=np.int32)
        self.left[self.ends - lengths] = -1
        self.word = np.repeat(np.arange(len(words), dtype=np.int32), lengths)
        self.index: dict[int, list[np.ndarray | int]] = {}
        self.queue: list[int] = []
        inside = np.flatnonzero(self.right >= 0)
        self.note(vocabulary.pair_ranks(self.token[inside], self.token[inside + 1]), inside)

    def note(self, ranks: np.ndarray, places: np.ndarray) -> None:
        """Enter pairs, given by the rank of their merge and their position."""
        known = ranks >= 0
        ranks, places = ranks[known], places[known]
        if not len(ranks):
            return
        order = np.argsort(ranks, kind="stable")
        ranks, places = ranks[order], places[order]
        starts = np.concatenate(([0], np.flatnonzero(np.diff(ranks)) + 1, [len(ranks)])).tolist()
        for start, stop in zip(starts, starts[1:]):
            self._enter(int(ranks[start]), places[start:stop])

    def _enter(self, rank: int, places: np.ndarray | int) -> None:
        if rank in self.index:
            self.index[rank].append(places)
        else:
            self.index[rank] = [places]
            heapq.heappush(self.queue, rank)

    def merged(self) -> list[bytes]:
        views = [memoryview(x) for x in (self.token, self.left, self.right, self.word)]
        while self.queue:
            rank = heapq.heappop(self.queue)
            parts = self.index.pop(rank)
            count = sum(1 if isinstance(part, int) else len(part) for part in parts)
            if count <= self.FEW:
                places = [at for part in parts for at in ([part] if isinstance(part, int) else part.tolist())]
                self._one_by_one(rank, sorted(places), *views)
            else:
                places = np.sort(np.concatenate([[part] if isinstance(part, int) else part for part in parts]))
                self._one_by_one(rank, self._together(rank, places), *views)
        live = self.token >= 0
        packed = self.token[live].astype("<u4").tobytes()
        stops = (np.cumsum(live)[self.ends - 1] * 4).tolist()
        return [packed[start:stop] for start, stop in zip([0, *stops], stops)]

    def _together(self, rank: int, places: np.ndarray) -> list[int]:
        """Merge at all positions at once; returns those in words with several, where the order matters."""
        token, left, right = self.token, self.left, self.right
        places = places[(token[places] >= 0) & (right[places] >= 0)]
        after = right[places]
        ok = self.vocabulary.pair_ranks(token[places], token[after]) == rank
        places, after = places[ok], after[ok]
        if not len(places):
            return []
        same = np.diff(self.word[places]) == 0
        shared = np.concatenate((same, [False])) | np.concatenate(([False], same))
        later = places[shared].tolist()
        places, after = places[~shared], after[~shared]
        beyond, before = right[after], left[places]
        new_right = np.where(beyond >= 0, self.vocabulary.pair_ranks(np.full(len(places), rank), token[beyond]), -1)
        new_left = np.where(before >= 0, self.vocabulary.pair_ranks(token[before], np.full(len(places), rank)), -1)
        token[places], token[after] = rank, -1
        right[places] = beyond
        left[beyond[beyond >= 0]] = places[beyond >= 0]
        self.note(np.concatenate((new_right, new_left)), np.concatenate((places, before)))
        return later

    def _one_by_one(self, rank: int, places: list[int], token, left, right, word) -> None:
        merge = self.vocabulary.merge
        waiting = -1  # a word in which a rank that goes first has come up
        for at in places:
            after = right[at]
            if after < 0 or token[at] < 0 or merge(token[at], token[after]) != rank:
                continue
            if word[at] == waiting:
                self._enter(rank, at)
                continue
            token[at], token[after] = rank, -1
            beyond = right[at] = right[after]
            if beyond >= 0:
                left[beyond] = at
                new = merge(rank, token[beyond])
                if new >= 0:
                    self._enter(new, at)
                    if new <= rank:
                        waiting = word[at]
            before = left[at]
            if before >= 0:
                new = merge(token[before], rank)
                if new >= 0:
                    self._enter(new, before)
                    if new <= rank:
                        waiting = word[at]


@lru_cache(maxsize=1)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


@lru_cache(maxsize=1)
def token_bytes(path: str) -> pa.BinaryArray:
    """The bytes of every id, which is all that decoding needs; null where the vocabulary has no such id."""
    tokens = {rank: token for token, rank in read_ranks(path).items()}
    return pa.array(map(tokens.get, range(max(tokens) + 1)), pa.binary(), size=max(tokens) + 1)


#: White space other than a space and a line break, and the character that joins words below.
RARE = re.compile("[\t\x0b\x0c\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\0]")
DOUBLE = ("  ", " \n", "\n ", "\n\n")
#: In pieces that only a match of the pattern gives: white space other than a space before the rest.
MATCHED = re.compile(rb"[\0\t-\r\x1c-\x1f]|(?!\A) | \Z|\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")
#: Stands between the pieces of a text in UTF-8, which has no such byte.
MARK = b"\xff"


def joined(values: pa.BinaryArray, starts: np.ndarray) -> pa.BinaryArray:
    """Neighbouring values as one: row n has those from ``starts[n]`` to ``starts[n + 1]``. No value is null."""
    if not len(values):
        return pa.array([b""] * (len(starts) - 1), pa.binary())
    _, offsets, data = values.buffers()
    bounds = np.frombuffer(offsets, np.int32)[starts + values.offset]
    return pa.Array.from_buffers(pa.binary(), len(starts) - 1, [None, pa.py_buffer(bounds), data])


class Encoder:
    """Texts to packed ids, with a bounded dictionary of the pieces met so far.

    ``spaced`` says that the pattern always starts a match at a space between two
    other characters or between a line break and another, and always matches a line
    break by itself that stands between two others or before such a space.
    Then a text is first cut there, and the pattern runs only over new pieces, put
    together with line breaks between them.

    The dictionary has two parts of about half its size: a piece that is met enters
    the first, and a full first part replaces the second. So what goes is what
    was not met for longest, and frequent pieces stay.
    """

    def __init__(self, path: str, pattern: str, spaced: bool = False, known: int = KNOWN):
        self.vocabulary = vocabulary(path)
        self.split = regex.compile(pattern).findall
        self.spaced = spaced
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.held, self.most = 0, known

    def marked(self, text: str | None) -> bytes:
        """A text with marks between its pieces."""
        if not text:
            return b""
        plain = self.spaced and not (text[0].isspace() or text[-1].isspace() or any(x in text for x in DOUBLE))
        if plain and not RARE.search(text):
            return text.encode().replace(b"\n", MARK + b"\n" + MARK).replace(b" ", MARK + b" ")
        return MARK.join([word.encode() for word in self.split(text)])

    def enter(self, pieces: list[bytes], ids: list[bytes]) -> None:
        """Put pieces into the dictionary; one takes about 200 bytes and four times its length."""
        self.known.update(zip(pieces, ids))
        self.held += 200 * len(pieces) + 4 * sum(map(len, pieces))

    def unknown(self, pieces: Iterable[bytes]) -> list[bytes]:
        """The pieces that the dictionary lacks; others move to its first part."""
        absent = [piece for piece in pieces if piece not in self.known]
        met = [piece for piece in absent if piece in self.older]
        if met:
            self.enter(met, [self.older[piece] for piece in met])
            absent = [piece for piece in absent if piece not in self.known]
        return absent

    def learn(self, pieces: list[bytes]) -> None:
        """Enter new pieces."""
        whole, parts = [], []
        for piece in pieces:
            (parts if self.spaced and piece and not MATCHED.search(piece) else whole).append(piece)
        split = "\0".join(self.split(b"\n".join(parts).decode())).encode().split(b"\0")
        words = self.unknown({*split, *whole} if parts else whole)
        self.enter(words, self.vocabulary.replay(words))
        known = self.known.__getitem__
        start, several, ids = 0, [], []
        stops = [*[at for at, word in enumerate(split) if word == b"\n"], len(split)]
        if parts and len(stops) != len(parts):
            raise ValueError("the pattern is not spaced")
        for piece, stop in zip(parts, stops):
            if stop - start > 1:
                several.append(piece)
                ids.append(b"".join(map(known, split[start:stop])))
            start = stop + 1
        self.enter(several, ids)

    def ids(self, pieces: list[bytes]) -> list[bytes]:
        """The packed ids of different pieces."""
        self.learn(self.unknown(pieces))
        found = [self.known[piece] for piece in pieces]
        if 2 * self.held > self.most:
            self.known, self.older, self.held = {}, self.known, 0
        return found

    def packed(self, texts: list[str | None]) -> pa.BinaryArray:
        """The packed ids of texts: every different piece is looked up once, Arrow puts them together."""
        cut = pc.split_pattern(pa.array(map(self.marked, texts), pa.large_binary(), size=len(texts)), MARK)
        coded = cut.flatten().dictionary_encode()
        ids = pa.array(self.ids(coded.dictionary.to_pylist()), pa.binary())
        return joined(ids.take(coded.indices), cut.offsets.to_numpy())

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        return self.packed(texts).to_pylist()


@lru_cache(maxsize=1)
def encoder(path: str, pattern: str, spaced: bool) -> Encoder:
    """The encoder of a Python worker, which keeps its dictionary from task to task."""
    return Encoder(path, pattern, spaced)


def _with(batch: pa.RecordBatch, name: str, values: pa.BinaryArray) -> pa.RecordBatch:
    names = [n for n in batch.schema.names if n.lower() != name]
    columns = [batch.column(batch.schema.get_field_index(n)) for n in names]
    return pa.RecordBatch.from_arrays([*columns, values], names=[*names, name])


def _schema(df: DataFrame, name: str) -> T.StructType:
    kept = [f for f in df.schema.fields if f.name.lower() != name]
    return T.StructType([*kept, T.StructField(name, T.BinaryType())])


def encode(df: DataFrame, path: str, pattern: str, spaced: bool = False, text: str = "text") -> DataFrame:
    """``df`` with the column ``ids``; ``path`` must name the same file on every executor."""

    prepared(df.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = encoder(path, pattern, spaced)
        for batch in slices(batches, text, SLICE):
            texts = batch.column(batch.schema.get_field_index(text)).to_pylist()
            yield _with(batch, "ids", ids_of.packed(texts))

    return df.mapInArrow(run, _schema(df, "ids"))


def decoded_bytes(packed: pa.Array, tokens: pa.BinaryArray) -> pa.BinaryArray:
    """The bytes that packed ids stand for."""
    packed = pc.fill_null(packed.cast(pa.binary()), b"")
    _, offsets, data = packed.buffers()
    bounds = np.frombuffer(offsets, np.int32)[packed.offset : packed.offset + len(packed) + 1]
    starts = bounds - bounds[0]
    if (starts % 4).any():
        raise ValueError("packed ids take four bytes each")
    numbers = np.frombuffer(data or b"", np.uint8)[bounds[0] : bounds[-1]].view("<u4").astype(np.uint32)
    found = tokens.take(pa.array(numbers))
    if found.null_count:
        raise ValueError("the vocabulary lacks an id")
    return joined(found, starts // 4)


def decode(df: DataFrame, path: str) -> DataFrame:
    """``df`` with the bytes of its ``ids`` in the column ``decoded``."""
    prepared(df.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = token_bytes(path)
        for batch in slices(batches, "ids", 2 * SLICE):
            packed = batch.column(batch.schema.get_field_index("ids"))
            yield _with(batch, "decoded", decoded_bytes(packed, tokens))

    return df.mapInArrow(run, _schema(df, "decoded"))


def round_trip(df: DataFrame, path: str, pattern: str, spaced: bool = False, text: str = "text") -> DataFrame:
    """``decode(encode(df))`` in one Python worker for each task instead of two."""
    prepared(df.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = encoder(path, pattern, spaced)
        tokens = token_bytes(path)
        for batch in slices(batches, text, SLICE):
            packed = ids_of.packed(batch.column(batch.schema.get_field_index(text)).to_pylist())
            yield _with(_with(batch, "ids", packed), "decoded", decoded_bytes(packed, tokens))

    both = T.StructType([*[f for f in _schema(df, "ids").fields if f.name.lower() != "decoded"], T.StructField("decoded", T.BinaryType())])
    return df.mapInArrow(run, both)


def digests(df: DataFrame, columns: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Counts and digests of encoded and decoded documents, next to ``columns``."""
    return df.select(
        *[f"`{c}`" for c in columns if c not in ("n_tokens", "ids_sha256", "decoded_sha256")],
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def query(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    return digests(round_trip(docs.select("doc_id", "text"), path, pattern, spaced=True))
