"""Substring dedup by sliding sentence spans.

A text is cut into tokens: a word with the white space and the ends of sentences
(``. ! ? 。 ！ ？`` or a line break) behind it; in scripts without spaces every character
is a word. A piece ends where a sentence ends. Inside long sentences, and in lists, it
also ends by content: behind a word whose hash is the smallest of those of the ``near``
words before it and behind it in its sentence. Such a cut depends on these words alone,
so a passage has the same pieces wherever it stands, but for ``near`` words at its ends.
The pieces joined give the text again. A run is the shortest one of at least ``span``
consecutive pieces and ``run_bytes`` bytes (UTF-8, without white space) that starts at a
piece, or that ends at one, so every piece of a longer passage lies in a run inside it.
Every run (its tokens, without the white space around them) is hashed to 128 bits. The
first occurrence of a run is the one in the smallest doc_id, there the earliest. The
pieces covered by any other occurrence are removed, all of them: what keeps chance
matches out is the length of a run alone.

The texts are hashed once, into a table of runs. Two shuffles of fixed-width rows find
the repeated ones: a combining aggregation to the first document of each run, kept where
a second document has it, and a join back on the whole run hash, which Spark can split
where one run holds many rows. A third brings every document its own set of repeated
runs, never more than twice its pieces.

Defined results: a missing text stays missing, an empty one empty; texts with fewer
pieces or bytes than a run are left alone. Rows without doc_id come last and count as one
document with each other, rows of equal doc_id too: among them only repeats inside a
text are removed. Repeated rows are therefore cut alike. A text whose every piece
is a repeat becomes empty; the row stays. A very long text is cut into pieces like any
other, in a slice of its own. An empty table gives an empty table. Extra columns pass
through; a column named ``removed_words`` is replaced.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name, id_key, prepared, slices, written

#: Thai, Lao, Burmese, Khmer, kana and Han are written without spaces.
UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff"
TOKENS = re.compile(
    rf"(?:[{UNSPACED}]|[^.!?。！？\n \t\r{UNSPACED}]*+)(?:[ \t\r]*[.!?。！？\n]+[ \t\r\n]*|[ \t\r]+)"
    rf"|[{UNSPACED}]|[^.!?。！？\n \t\r{UNSPACED}]++"
)
ENDS = re.compile(r"[.!?。！？\n]")
SPACE = " \t\r\n"
SLICE = 4 << 20
#: Odd bases of the two polynomials that hash a run, and their inverses modulo 2^64.
BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
INVERSES = tuple(pow(base, -1, 1 << 64) for base in BASES)


@dataclass(frozen=True)
class Spans:
    span: int = 3
    run_bytes: int = 100
    near: int = 3


class Tokens(dict):
    """Numbers of tokens, and by number what cutting and hashing need of them."""

    def __init__(self) -> None:
        super().__init__()
        self.held = 0
        self.digests: list[bytes] = []
        self.sizes: list[tuple[int, int, bool]] = []
        self.known = (np.empty((0, 2), dtype=np.uint64), np.empty((0, 3), dtype=np.int32))

    def __missing__(self, token: str) -> int:
        data = token.strip(SPACE).encode()
        self.digests.append(hashlib.md5(data).digest())
        self.sizes.append((len(data.translate(None, SPACE.encode())), len(token), ENDS.search(token) is not None))
        self.held += len(token)
        number = self[token] = len(self.known[0]) + len(self.digests) - 1
        return number

    def read(self, text: str) -> np.ndarray:
        # A list of tokens is faster; a very long text is read token by token.
        found = TOKENS.findall(text) if len(text) < SLICE else map(re.Match.group, TOKENS.finditer(text))
        return np.fromiter(map(self.__getitem__, found), dtype=np.int64)

    def columns(self, numbers: np.ndarray) -> list[np.ndarray]:
        """Both hashes, the order of cuts, bytes, characters, and whether it ends a sentence."""
        if self.digests:
            fresh = (np.frombuffer(b"".join(self.digests), dtype=">u8").reshape(-1, 2), np.array(self.sizes, dtype=np.int32))
            self.known = tuple(np.concatenate((old, new.astype(old.dtype))) for old, new in zip(self.known, fresh))
            self.digests, self.sizes = [], []
        one, two = self.known[0][numbers].T
        size, chars, ends = self.known[1][numbers].T
        return [one, two, one >> np.uint64(32), size.astype(np.int64), chars.astype(np.int64), ends > 0]

    def tidy(self) -> None:
        """Forget all, between slices, when there are many."""
        if len(self) > 250_000 or self.held > 32 << 20:
            self.clear()
            self.__init__()


def _upto(values: np.ndarray) -> np.ndarray:
    return np.concatenate((np.zeros(1, dtype=values.dtype), np.cumsum(values, dtype=values.dtype)))


def _powers(base: int, count: int) -> np.ndarray:
    powers = np.full(count, base, dtype=np.uint64)
    powers[:1] = 1
    return np.multiply.accumulate(powers)


@dataclass(frozen=True)
class Pieces:
    """The pieces of some texts, and their runs.

    By piece: ``text`` it belongs to, its first and last character there (``begin``, ``end``),
    its ``words``. By run: the ``first`` piece, the one behind its last (``stop``) and the hash.
    """

    text: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    words: np.ndarray
    first: np.ndarray
    stop: np.ndarray
    h1: np.ndarray
    h2: np.ndarray


def pieces(texts: list[str | None], known: Tokens, spans: Spans) -> Pieces:
    """Cut texts and hash the runs of their pieces, all at once."""
    numbers = [known.read(text) if text else np.empty(0, dtype=np.int64) for text in texts]
    counts = np.array([len(n) for n in numbers], dtype=np.int64)
    of_text = np.repeat(np.arange(len(texts)), counts)
    one, two, order, size, chars, ends = known.columns(np.concatenate([np.empty(0, dtype=np.int64), *numbers]))
    total, near = len(of_text), spans.near
    ends[np.cumsum(counts)[counts > 0] - 1] = True
    cut = ends.copy()
    if total > 2 * near:
        middle = order[near : total - near]
        least = np.ones(len(middle), dtype=bool)
        for at in range(2 * near + 1):
            least &= middle <= order[at : total - 2 * near + at]
        before = _upto(ends.astype(np.int64))
        # The words around are of one sentence, and the last of a text is no part of an open one.
        least &= before[2 * near : total] == before[: total - 2 * near]
        cut[near : total - near] |= least
    stops = np.flatnonzero(cut) + 1
    starts = np.concatenate((np.zeros(1, dtype=np.int64), stops[:-1]))[: len(stops)]
    text = of_text[starts]
    characters, sizes, words = _upto(chars), _upto(size), _upto((size > 0).astype(np.int64))
    origin = characters[(np.cumsum(counts) - counts)[text]]

    # Runs of one text that start at a piece, and that end at one.
    piece = np.arange(len(stops))
    low, high = np.searchsorted(text, text, "left"), np.searchsorted(text, text, "right")
    bounds = np.concatenate((np.zeros(1, dtype=np.int64), sizes[stops]))
    behind = np.maximum(piece + spans.span, np.searchsorted(bounds, bounds[:-1] + spans.run_bytes, "left"))
    ahead = np.minimum(piece + 1 - spans.span, np.searchsorted(bounds, bounds[1:] - spans.run_bytes, "right") - 1)
    forward, backward = behind <= high, ahead >= low
    first = np.concatenate((piece[forward], ahead[backward]))
    stop = np.concatenate((behind[forward], piece[backward] + 1))
    both = np.unique(first * (len(stops) + 1) + stop)
    first, stop = both // (len(stops) + 1), both % (len(stops) + 1)

    hashes = []
    a, z = starts[first], stops[stop - 1]
    for values, base, inverse in zip((one, two), BASES, INVERSES):
        # Tokens of white space alone have no place and no weight.
        sums = _upto(np.where(size > 0, values, 0) * _powers(base, total + 1)[words[:-1]])
        found = (sums[z] - sums[a]) * _powers(inverse, total + 1)[words[a]]
        hashes.append((found ^ (found >> np.uint64(32))).view(np.int64))
    return Pieces(text, characters[starts] - origin, characters[stops] - origin, words[stops] - words[starts], first, stop, *hashes)


def runs(docs: DataFrame, spans: Spans) -> DataFrame:
    """One row for every different run of every text: hash, document, row key, whether it is there twice."""
    kept = docs.select(
        id_key("doc_id").alias("doc"), F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text")).alias("key"), "text"
    )

    def emit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Tokens()
        for batch in slices(batches, "text", SLICE):
            known.tidy()
            found = pieces(batch.column(2).to_pylist(), known, spans)
            text = found.text[found.first]
            order = np.lexsort((found.h2, found.h1, text))
            h1, h2, text = found.h1[order], found.h2[order], text[order]
            new = np.ones(len(order), dtype=bool)
            new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1]) | (text[1:] != text[:-1])
            at = np.flatnonzero(new)
            twice = np.diff(at, append=len(order)) > 1
            doc, key = (batch.column(i).to_numpy(zero_copy_only=False)[text[at]] for i in (0, 1))
            columns = {"h1": h1[at], "h2": h2[at], "doc": doc, "key": key, "twice": twice}
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns.values()], names=list(columns))

    return kept.mapInArrow(emit, "h1 long, h2 long, doc long, key long, twice boolean")


def repeats(docs: DataFrame, spans: Spans) -> DataFrame:
    """Per row key of texts to cut: the first halves of the hashes of runs that an earlier document has.

    The list is empty where a run only repeats inside the text.
    """
    found = written(runs(docs, spans), "span-runs")
    firsts = found.groupBy("h1", "h2").agg(F.min("doc").alias("first"), F.max("doc").alias("last"))
    shared = written(firsts.where("first < last").select("h1", "h2", "first"), "span-firsts")
    later = found.join(shared, ["h1", "h2"]).where("doc > first").select("key", "h1")
    later = later.unionByName(found.where("twice").select("key", F.lit(None).cast("long").alias("h1")))
    return later.groupBy("key").agg(F.collect_set("h1").alias("later"))


def covered(found: Pieces, later: np.ndarray, of_text: np.ndarray) -> np.ndarray:
    """Which pieces go: those of runs listed for their text, and of runs that repeat inside it."""
    text = found.text[found.first]
    told = np.empty(len(text) + len(later), dtype=[("text", np.int64), ("hash", np.int64)])
    told["text"] = np.concatenate((text, of_text))
    told["hash"] = np.concatenate((found.h1, later))
    _, number = np.unique(told, return_inverse=True)
    number, listed = number[: len(text)], number[len(text) :]
    # Runs are in the order of their first pieces.
    gone = np.ones(len(text), dtype=bool)
    gone[np.unique(number, return_index=True)[1]] = False
    gone |= np.isin(number, listed)
    steps = np.zeros(len(found.text) + 1, dtype=np.int64)
    np.add.at(steps, found.first[gone], 1)
    np.add.at(steps, found.stop[gone], -1)
    return np.cumsum(steps)[:-1] > 0


def without_repeats(docs: DataFrame, spans: Spans = Spans()) -> DataFrame:
    """``docs`` with repeated spans cut from ``text``, and ``removed_words``."""
    prepared(docs.sparkSession)
    kept = docs.drop(*[c for c in docs.columns if c.lower() == "removed_words"])
    key, later = free_name(kept.columns, "key"), free_name(kept.columns, "later")
    found = repeats(kept.select("doc_id", "text"), spans).toDF(key, later)
    keyed = kept.withColumn(key, F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text")))
    joined = keyed.join(found, key, "left").select(*[f"`{c}`" for c in kept.columns], later)
    place = [c.lower() for c in kept.columns].index("text")
    schema = T.StructType([*kept.schema.fields, T.StructField("removed_words", T.LongType())])

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Tokens()
        for batch in slices(batches, batch_text, SLICE):
            known.tidy()
            texts = batch.column(place).to_pylist()
            listed = batch.column(batch.num_columns - 1)
            repeating = listed.is_valid().to_pylist()
            found = pieces([text if own else None for text, own in zip(texts, repeating)], known, spans)
            values = listed.flatten().to_numpy(zero_copy_only=False)
            lengths = np.array([len(own) if own.is_valid else 0 for own in listed], dtype=np.int64)
            gone = covered(found, values, np.repeat(np.arange(len(texts)), lengths))
            removed = np.bincount(found.text[gone], weights=found.words[gone], minlength=len(texts)).astype(np.int64)
            low, high = (np.searchsorted(found.text, np.arange(len(texts)), side) for side in ("left", "right"))
            for at in np.unique(found.text[gone]).tolist():
                left = np.arange(low[at], high[at])[~gone[low[at] : high[at]]]
                texts[at] = "".join(texts[at][a:z] for a, z in zip(found.begin[left].tolist(), found.end[left].tolist()))
            columns = batch.columns[:-1]
            columns[place] = pa.array(texts, batch.schema.field(place).type)
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(removed, pa.int64())], names=[*batch.schema.names[:-1], "removed_words"]
            )

    batch_text = kept.columns[place]
    return joined.mapInArrow(cut, schema)


ORACLE = r"""
WITH tokens AS (
  SELECT doc_id, unnest(regexp_extract_all(text, '(?:[@]|[^.!?。！？\n \t\r@]*)(?:[ \t\r]*[.!?。！？\n]+[ \t\r\n]*|[ \t\r]+)|[@]|[^.!?。！？\n \t\r@]+')) AS token,
    generate_subscripts(regexp_extract_all(text, '(?:[@]|[^.!?。！？\n \t\r@]*)(?:[ \t\r]*[.!?。！？\n]+[ \t\r\n]*|[ \t\r]+)|[@]|[^.!?。！？\n \t\r@]+'), 1) AS n
  FROM documents
), told AS (
  SELECT *, trim(token, chr(32) || chr(9) || chr(13) || chr(10)) AS bare, regexp_matches(token, '[.!?。！？\n]') AS ends,
    left(md5(trim(token, chr(32) || chr(9) || chr(13) || chr(10))), 8) AS h,
    lead(1) OVER (PARTITION BY doc_id ORDER BY n) IS NULL AS last
  FROM tokens
), cuts AS (
  SELECT *, ends OR last OR coalesce(
      count(*) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) = 7
      AND min(h) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) = h
      AND NOT bool_or(ends) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN 3 PRECEDING AND 2 FOLLOWING), false) AS cut
  FROM told
), placed AS (
  SELECT *, coalesce(sum(cut::INT) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS piece
  FROM cuts
), pieces AS (
  SELECT doc_id, piece, string_agg(token, '' ORDER BY n) AS part, string_agg(bare, ' ' ORDER BY n) FILTER (bare <> '') AS bare,
    count(*) FILTER (bare <> '') AS words, sum(strlen(regexp_replace(token, '[ \t\r\n]+', '', 'g'))) AS size
  FROM placed GROUP BY doc_id, piece
), counted AS (
  SELECT *, sum(size) OVER (PARTITION BY doc_id ORDER BY piece) AS upto FROM pieces
), long_enough AS (
  SELECT a.doc_id, a.piece AS a, z.piece AS z FROM counted a JOIN counted z
  ON z.doc_id = a.doc_id AND z.piece BETWEEN a.piece + 2 AND a.piece + 101 AND z.upto - a.upto + a.size >= 100
), spans AS (
  SELECT doc_id, a, min(z) AS z FROM long_enough GROUP BY doc_id, a
  UNION SELECT doc_id, max(a), z FROM long_enough GROUP BY doc_id, z
), runs AS (
  SELECT s.doc_id, a, z, md5(string_agg(bare, ' ' ORDER BY piece)) AS run
  FROM spans s JOIN counted c ON c.doc_id = s.doc_id AND c.piece BETWEEN a AND z GROUP BY s.doc_id, a, z
), later AS (
  SELECT doc_id, a, z FROM runs QUALIFY row_number() OVER (PARTITION BY run ORDER BY doc_id, a, z) > 1
), marks AS (
  SELECT DISTINCT doc_id, unnest(range(a, z + 1)) AS piece FROM later
), texts AS (
  SELECT c.doc_id, string_agg(part, '' ORDER BY c.piece) FILTER (m.piece IS NULL) AS text,
    coalesce(sum(words) FILTER (m.piece IS NOT NULL), 0)::BIGINT AS removed_words, bool_or(m.piece IS NOT NULL) AS cut
  FROM counted c LEFT JOIN marks m ON m.doc_id = c.doc_id AND m.piece = c.piece GROUP BY c.doc_id
)
SELECT d.doc_id, CASE WHEN t.cut THEN coalesce(t.text, '') ELSE d.text END AS text,
  coalesce(t.removed_words, 0)::BIGINT AS removed_words
FROM documents d LEFT JOIN texts t ON t.doc_id = d.doc_id
""".replace("@", r"\x{0E00}-\x{0EFF}\x{1000}-\x{109F}\x{1780}-\x{17FF}\x{3040}-\x{30FF}\x{3400}-\x{9FFF}")


def query(docs: DataFrame) -> DataFrame:
    return without_repeats(docs.select("doc_id", "text"))
