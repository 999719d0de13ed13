"""Target-distribution importance resampling.

Every run of words is hashed into one of a fixed number of buckets. What a bucket tells
about the target is the logarithm of its share there over its share in the corpus, both
counted over all texts; the gains are an array, and a document's weight is the sum of
the gains at its features' places. Gumbel noise from a hash of the id makes the highest
scores a sample without replacement, in proportion to the weights.

The cutoff is found without a sort of all scores, by weighted median-of-medians
selection: every partition tells the median of its remaining keys on either side of the
last pivot and how many they are; the median of these medians, weighted by the counts,
is the next pivot, so each round discards at least a quarter of what remains. What
remains is written anew when it has shrunk to a quarter of the table that is read. Below
``Settings.final`` keys the rest is read in order. A key is (score, id, features, row
number), unique, so the cutoff is exact. Only the winners are sorted, by range.

The driver sees one gain per bucket and one row per partition and round. Scored rows are
written once, so that later reads agree whatever executor was lost.

Defined results: a missing or empty text has no features and weight 0, but a score.
Documents under ``least_words`` words are scored and never drawn. A missing id is hashed
as an empty one and loses ties; rows of one id and score are drawn in the order of their
features, then of reading, which equal rows cannot tell. An empty table, or an empty
target (all counts 0), needs no special case. Extra columns are carried unless named
like a result column. A text is one array of words, however long.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower_words as words
from .common import id_key, written

RESULT = ("n_features", "weight", "score", "rank")
KEY = ("_low", "_id", "_n", "_row")


@dataclass(frozen=True)
class Settings:
    longest: int = 1
    buckets: int = 10_000
    seed: int = 2024
    least_words: int = 20
    percent: int = 10
    final: int = 10_000


def features(found: Column, longest: int) -> Column:
    """All runs of 1 to ``longest`` words, repeats included."""
    parts = [found]
    for n in range(2, longest + 1):
        starts = F.when(F.size(found) >= n, F.sequence(F.lit(1), F.size(found) - n + 1)).otherwise(F.array().cast("array<int>"))
        parts.append(F.transform(starts, lambda at, n=n: F.array_join(F.slice(found, at, n), " ")))
    return F.concat(*parts)


def bucket(feature: Column, how: Settings) -> Column:
    return (F.crc32(feature.cast("binary")) % how.buckets).cast("int")


def counts(texts: DataFrame, how: Settings) -> DataFrame:
    """``bucket, n`` over all features; tasks add up before the shuffle."""
    listed = texts.select(words(F.col("text")).alias("words")).select(features(F.col("words"), how.longest).alias("all"))
    each = listed.select(F.explode_outer("all").alias("feature")).where("feature is not null")
    return each.groupBy(bucket(F.col("feature"), how).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def gains(docs: DataFrame, target: DataFrame, how: Settings) -> list[int]:
    """The gain of every bucket, as many numbers as buckets."""
    places = docs.sparkSession.range(how.buckets).select(F.col("id").cast("int").alias("bucket"))
    both = places.join(counts(docs, how).withColumnRenamed("n", "s"), "bucket", "left")
    both = both.join(counts(target, how).withColumnRenamed("n", "t"), "bucket", "left")
    s, t = (F.coalesce(F.col(c), F.lit(0)).cast("double") for c in "st")
    # The windows run over one row per bucket.
    all_s, all_t = (F.sum(c).over(Window.partitionBy()) for c in (s, t))
    ratio = ((t + 1.0) * (all_s + float(how.buckets))) / ((s + 1.0) * (all_t + float(how.buckets)))
    told = both.select("bucket", F.floor(F.lit(1000.0) * F.log(ratio)).alias("gain")).collect()
    return [row["gain"] for row in sorted(told)]


def scored(docs: DataFrame, gain: Sequence[int], how: Settings, carry: Sequence[str]) -> DataFrame:
    """``row, n_words, n_features, weight, score`` of every document, and its key."""
    listed = F.split(F.lit(",".join(map(str, gain))), ",").cast("array<bigint>")
    found = docs.select(
        F.struct(*[f"`{c}`" for c in carry]).alias("row"), F.col("doc_id").alias("_doc"), words(F.col("text")).alias("words")
    )
    found = found.select("row", "_doc", F.size("words").alias("n_words"), features(F.col("words"), how.longest).alias("all"))
    weight = F.aggregate("all", F.lit(0).cast("long"), lambda held, f: held + F.get(listed, bucket(f, how)))
    digest = F.sha2(F.concat(F.lit(f"{how.seed}:"), F.coalesce(F.col("_doc").cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))
    found = found.select("row", "_doc", "n_words", F.size("all").cast("long").alias("n_features"), weight.alias("weight"), noise.alias("_noise"))
    found = found.withColumn("score", F.col("weight") + F.col("_noise"))
    return found.select(
        "row", "n_words", "n_features", "weight", "score",
        (-F.col("score")).alias("_low"), id_key("_doc").alias("_id"), F.col("n_features").alias("_n"),
        F.monotonically_increasing_id().alias("_row"),
    )


def _less(keys: np.ndarray, pivot: Sequence[int]) -> np.ndarray:
    """Which rows of ``keys`` (one column per part of the key) come before the pivot."""
    less, same = np.zeros(len(keys), bool), np.ones(len(keys), bool)
    for part, value in enumerate(pivot):
        less |= same & (keys[:, part] < value)
        same &= keys[:, part] == value
    return less


def _median(keys: np.ndarray) -> list[int]:
    order = np.lexsort(keys.T[::-1])
    return keys[order[len(keys) // 2]].tolist()


SIDES = pa.schema([("before", pa.int64()), ("at", pa.int64()), ("after", pa.int64()), *[
    (f"{side}{part}", pa.int64()) for side in "ba" for part in range(len(KEY))
]])
SIDES_DDL = ", ".join(f"{field.name} long" for field in SIDES)


def _sides(pivot: Sequence[int] | None, low: Sequence[int] | None, high: Sequence[int] | None):
    """Per partition: the remaining keys on either side of the pivot, and their medians."""

    def tell(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for batch in batches:
            keys = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], axis=1)
            if low is not None:
                keys = keys[~_less(keys, low) & (keys != np.array(low)).any(axis=1)]
            if high is not None:
                keys = keys[_less(keys, high)]
            held.append(keys)
        keys = np.concatenate(held) if held else np.zeros((0, len(KEY)), np.int64)
        if not len(keys):
            return
        before = _less(keys, pivot) if pivot is not None else np.zeros(len(keys), bool)
        at = (keys == np.array(pivot)).all(axis=1) if pivot is not None else np.zeros(len(keys), bool)
        after = ~before & ~at
        row = [int(before.sum()), int(at.sum()), int(after.sum())]
        for side in (before, after):
            row += _median(keys[side]) if side.any() else [None] * len(KEY)
        yield pa.RecordBatch.from_arrays([pa.array([v], pa.int64()) for v in row], schema=SIDES)

    return tell


def _weighted(rows: Sequence, count: str, side: str) -> list[int]:
    """The median of the partitions' medians, each as heavy as its remaining keys."""
    told = sorted(([row[f"{side}{p}"] for p in range(len(KEY))], row[count]) for row in rows if row[count])
    half, passed = sum(n for _, n in told) / 2, 0
    for key, n in told:
        passed += n
        if passed >= half:
            return key
    raise AssertionError("no keys are left")


def _compared(key: Sequence[int]) -> tuple[Column, Column]:
    return F.struct(*KEY), F.struct(*[F.lit(int(v)).alias(name) for name, v in zip(KEY, key)])


def cutoff(keys: DataFrame, wanted: int, total: int, final: int) -> list[int]:
    """The ``wanted``-th smallest of ``total`` unique keys (four long columns), 1 being the smallest."""
    base, size, left = keys, total, total
    pivot = low = high = None
    while left > max(1, final):
        rows = base.mapInArrow(_sides(pivot, low, high), SIDES_DDL).collect()
        before, at = sum(r["before"] for r in rows), sum(r["at"] for r in rows)
        if pivot is not None and before < wanted <= before + at:
            return pivot
        if wanted <= before:
            high, left, pivot = pivot, before, _weighted(rows, "before", "b")
        else:
            wanted, left = wanted - before - at, sum(r["after"] for r in rows)
            low, pivot = pivot, _weighted(rows, "after", "a")
        if left * 4 <= size and left > final:
            base, size = written(_between(base, low, high), "resample-left"), left
    return sorted(tuple(row) for row in _between(base, low, high).collect())[wanted - 1]


def _between(keys: DataFrame, low: Sequence[int] | None, high: Sequence[int] | None) -> DataFrame:
    for bound, above in ((low, True), (high, False)):
        if bound is not None:
            own, other = _compared(bound)
            keys = keys.where(F.col(KEY[0]) >= bound[0] if above else F.col(KEY[0]) <= bound[0])
            keys = keys.where(own > other if above else own < other)
    return keys


def ranked(rows: DataFrame) -> DataFrame:
    """``rows`` with their ``rank`` by key, from 1: sorted by range, then counted by partition."""
    local = rows.repartitionByRange(*KEY).sortWithinPartitions(*KEY).withColumn("_at", F.monotonically_increasing_id())
    stored = written(local, "resample-drawn")
    stored = stored.withColumn("_part", F.shiftright("_at", 33))
    sizes = stored.groupBy("_part").agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"))
    place = F.col("_offset") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    # One row per shuffle partition.
    return stored.join(offsets, "_part").withColumn("rank", place.cast("long")).drop("_part", "_at", "_offset")


def resampled(docs: DataFrame, target: DataFrame, how: Settings = Settings(), carry: Sequence[str] | None = None) -> DataFrame:
    """Every document's carried columns (all by default) and the result; ``rank`` is null where not drawn."""
    chosen = [c for c in (docs.columns if carry is None else carry) if c.lower() not in RESULT]
    rows = written(scored(docs, gains(docs, target, how), how, chosen), "resample-scored")
    fit = F.col("n_words") >= how.least_words
    total = rows.where(fit).count()
    wanted = total * how.percent // 100
    if wanted:
        own, last = _compared(cutoff(rows.where(fit).select(*KEY), wanted, total, how.final))
        drawn = fit & (own <= last)
        every = ranked(rows.where(drawn)).unionByName(rows.where(~drawn).withColumn("rank", F.lit(None).cast("long")))
    else:
        every = rows.withColumn("rank", F.lit(None).cast("long"))
    return every.select(*[f"row.`{c}`" for c in chosen], *RESULT)


def query(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return resampled(docs, benchmark, carry=["doc_id"])


ORACLE = r"""
WITH polynomial AS (
  SELECT list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0],
    lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crc_table
), docs AS (
  SELECT row_number() OVER () AS uid, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM documents
), target AS (
  SELECT unnest(regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word
  FROM benchmark
), used AS (
  SELECT uid, word, count(*) AS times FROM (SELECT uid, unnest(words) AS word FROM docs) GROUP BY uid, word
), vocabulary AS (
  SELECT word, hex(encode(word)) AS bytes FROM (SELECT word FROM used UNION SELECT word FROM target)
), hashed AS (
  SELECT word, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(length(bytes) // 2),
      lambda i: ('0x' || substr(bytes, (2 * i + 1)::INT, 2))::BIGINT)),
    lambda c, b: xor(c >> 8, crc_table[(xor(c, b) & 255) + 1])), 4294967295) % 10000 AS bucket
  FROM vocabulary, polynomial
), corpus AS (
  SELECT bucket, sum(times)::DOUBLE AS s FROM used JOIN hashed USING (word) GROUP BY bucket
), wanted AS (
  SELECT bucket, count(*)::DOUBLE AS t FROM target JOIN hashed USING (word) GROUP BY bucket
), totals AS (
  SELECT (SELECT coalesce(sum(s), 0) FROM corpus) AS all_s, (SELECT coalesce(sum(t), 0) FROM wanted) AS all_t
), gains AS (
  SELECT bucket, floor(1000 * ln(((coalesce(t, 0) + 1) * (all_s + 10000)) / ((s + 1) * (all_t + 10000))))::BIGINT AS gain
  FROM corpus LEFT JOIN wanted USING (bucket), totals
), weights AS (
  SELECT uid, sum(times * gain) AS weight FROM used JOIN hashed USING (word) JOIN gains USING (bucket) GROUP BY uid
), scores AS (
  SELECT doc_id, len(words)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
    (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || left(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 8))::BIGINT + 0.5::DOUBLE)
      / 4294967296::DOUBLE))))::BIGINT AS score
  FROM docs LEFT JOIN weights USING (uid)
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id NULLS LAST, n_features) AS place,
    count(*) FILTER (n_features >= 20) OVER () AS fit
  FROM scores
)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= 10 * fit // 100 THEN place END AS rank FROM placed
"""
