"""Mixing sources to target weights by Pareto order sampling.

Sizes are counted in words. Sources share a budget of words by weight; a target
stops at ``most`` times the size of its source and the excess is shared again by
weight among the others until none is above (water-filling, in closed form).

Within a source every document first gets the certain whole copies, ``floor(goal
/ size of source)``. The rest of the goal is an order sample of whole documents with
unequal odds: a document's inclusion probability is proportional to its size, those that
would exceed 1 are certain, and the expected words are the rest. A document's rank is its
random odds ``u / (1 - u)`` divided by its inclusion odds ``p / (1 - p)``, and documents
are taken by rising rank while they fit into the rest. What is then missing is closed by
the one document among the others whose size is nearest to it, if that is nearer than
taking none. Documents are taken whole, so a source ends near its target and not on it.

``u`` is a hash of seed, id and text: rows without id, or of one id, differ by their text,
and rows that agree in all of these give the same rows of the result whichever is taken.
So reruns agree, whatever the partitions. The rank at which a source ends is found with
two histograms of ranks (1,024 bins per source each) and an exact order of the different
documents inside one bin of the second, about a millionth of the source: no source is ever
sorted or counted in one task, and the texts are never shuffled. Inclusion probabilities
need one row per source and distinct size.

Defined results: a missing text has size 0; a missing source is a source of its
own, last in order; documents of size 0 are taken 0 times; repeated rows are documents of
their own, of which the sample may take some. A very long text is one document like any
other. An empty table gives an empty table. Extra columns pass through, and a column
named like a result column is replaced by the result.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Fixed value: a word is a run of characters other than these six.
WORD = r"[^\x20\x09-\x0D]+"
BINS = 1024
RESULT = ("size", "source_size", "target", "taken")


@dataclass(frozen=True)
class Mix:
    """Weights go to the sources in code point order, repeating."""

    weights: Sequence[int] = (3, 1, 2)
    share: float = 1.5
    most: int = 2
    seed: str = "mix"


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def uniform(doc_id: Column, text: Column, seed: str) -> Column:
    """A number in (0, 1) from 52 bits of a hash, the same in every run."""
    parts = [F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), text_hash(text)]
    digest = F.md5(F.concat(*parts).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(1 << 52))


def text_hash(text: Column) -> Column:
    return F.coalesce(F.md5(text.cast("binary")), F.lit(""))


def sized(docs: DataFrame, mix: Mix) -> DataFrame:
    """Every row of ``docs`` as ``row``, beside its id, source, size, random number and text hash."""
    kept = [f"`{c}`" for c in docs.columns if c.lower() not in RESULT]
    return docs.select(
        F.struct(*kept).alias("row"), "doc_id", "source", words(F.col("text")).alias("size"),
        uniform(F.col("doc_id"), F.col("text"), mix.seed).alias("_u"), text_hash(F.col("text")).alias("_h"),
    )


def targets(sizes: DataFrame, mix: Mix) -> DataFrame:
    """One row per source: its size, target, certain copies and the words that are sampled.

    The windows run over one row per source, not over documents.
    """
    per_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ordered = Window.orderBy(F.col("source").asc_nulls_last())
    weights = F.array(*[F.lit(int(w)) for w in mix.weights])
    place = (F.row_number().over(ordered) - 1) % len(mix.weights)
    weighed = per_source.select("source", "source_size", F.get(weights, place).alias("w"))
    by_limit = Window.orderBy(F.col("source_size") / F.col("w"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    limit = F.col("source_size") * mix.most
    before = F.sum(limit).over(by_limit.rowsBetween(Window.unboundedPreceding, -1))
    levels = weighed.select(
        "*",
        F.row_number().over(by_limit).alias("k"),
        limit.alias("most"),
        (
            (F.sum("source_size").over(everything) * F.lit(mix.share) - F.coalesce(before, F.lit(0)))
            / F.sum("w").over(by_limit.rowsBetween(Window.currentRow, Window.unboundedFollowing))
        ).alias("level"),
    )
    open_ = F.col("level") * F.col("w") <= F.col("most")
    level = F.min_by("level", F.when(open_, F.col("k"))).over(everything)
    target = F.least(F.col("most").cast("double"), F.coalesce(F.col("common") * F.col("w"), F.col("most").cast("double")))
    goal = F.floor(F.col("target") + 0.5)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("goal") / F.col("source_size"))).otherwise(F.lit(0))
    return (
        levels.withColumn("common", level)
        .withColumn("target", target)
        .withColumn("goal", goal)
        .withColumn("copies", whole.cast("long"))
        .withColumn("rest", F.col("goal") - F.col("copies") * F.col("source_size"))
        .select("source", "source_size", "target", "copies", "rest")
    )


def inclusion(sizes: DataFrame, plan: DataFrame) -> DataFrame:
    """``source, unit``: a document's inclusion probability is ``unit`` times its size, at most 1.

    From the largest size down, sizes are made certain until the unit that spreads the rest
    of the words over the smaller ones exceeds 1 for none of them.
    """
    held = sizes.where("size > 0").groupBy(F.col("source").alias("_s"), "size").agg(F.count(F.lit(1)).alias("n"))
    held = held.join(plan.where("rest > 0").select("source", "rest"), F.col("_s").eqNullSafe(F.col("source")))
    falling = Window.partitionBy("source").orderBy(F.col("size").desc())
    rising = Window.partitionBy("source").orderBy("size")
    certain = F.coalesce(F.sum(F.col("n") * F.col("size")).over(falling.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    squares = F.sum((F.col("n") * F.col("size")).cast("double") * F.col("size")).over(rising.rowsBetween(Window.unboundedPreceding, 0))
    units = held.select("source", "size", ((F.col("rest") - certain) / squares).alias("unit"))
    fit = units.where(F.col("unit") * F.col("size") <= 1.0)
    return fit.groupBy("source").agg(F.max_by("unit", "size").alias("unit"))


def rank() -> Column:
    """Random odds over inclusion odds: 0 for certain documents, null for those that cannot be taken."""
    p = F.col("unit") * F.col("size")
    odds = F.when(p < 1.0, (F.col("_u") / (1 - F.col("_u"))) / (p / (1 - p))).otherwise(F.lit(0.0))
    return F.when((F.col("size") > 0) & F.col("unit").isNotNull(), odds)


def _bins() -> Column:
    """The rank's place in (0, 1) in units of ``BINS ** -2``."""
    return F.floor(F.col("_q") / (1 + F.col("_q")) * BINS * BINS)


def _ranked(sizes: DataFrame, plan: DataFrame) -> DataFrame:
    joined = sizes.withColumnRenamed("source", "_source").join(
        plan, F.col("_source").eqNullSafe(F.col("source")), "left"
    )
    return joined.drop("_source").withColumn("_q", rank()).withColumn("_bin", _bins())


def _cut(ranked: DataFrame, plan: DataFrame, width: int, within: DataFrame | None) -> DataFrame:
    """Per source: the bin of ``width`` units in which the sample ends, and the words before it."""
    rows = ranked.where("_q is not null").select("source", "size", "_bin")
    if within is not None:
        inside = within.select(F.col("source").alias("_s"), F.col("bin").alias("_outer"))
        matches = F.col("source").eqNullSafe(F.col("_s")) & (F.floor(F.col("_bin") / (width * BINS)) == F.col("_outer"))
        rows = rows.join(inside, matches).drop("_s", "_outer")
    counted = rows.groupBy("source", F.floor(F.col("_bin") / width).alias("bin")).agg(F.sum("size").alias("held"))
    start = plan.select(F.col("source").alias("_s"), "rest")
    if within is not None:
        start = start.join(
            within.select(F.col("source").alias("_t"), "before"), F.col("_s").eqNullSafe(F.col("_t"))
        ).select("_s", (F.col("rest") - F.col("before")).alias("rest"), F.col("before").alias("_outside"))
    else:
        start = start.withColumn("_outside", F.lit(0))
    running = Window.partitionBy("source").orderBy("bin")
    ends = (
        counted.withColumn("before", F.sum("held").over(running) - F.col("held"))
        .join(start, F.col("source").eqNullSafe(F.col("_s")))
        .where((F.col("before") < F.col("rest")) & (F.col("before") + F.col("held") >= F.col("rest")))
    )
    return ends.select("source", "bin", (F.col("before") + F.col("_outside")).alias("before"))


#: What tells documents apart; rows that agree in these are interchangeable.
KEY = ("source", "_u", "_h", "doc_id", "size")


def _joined(left: DataFrame, right: DataFrame, columns: Sequence[str], how: str = "left") -> DataFrame:
    """``right``'s other columns beside ``left``, matched on columns that may be null."""
    there = right.withColumnsRenamed({c: f"_r_{c}" for c in columns})
    same = [F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in columns]
    return left.join(there, same, how).drop(*[f"_r_{c}" for c in columns])


def _special(ranked: DataFrame, ends: DataFrame) -> DataFrame:
    """``KEY, n, k``: documents of the bins in which samples end, and those that close a gap: ``k`` of ``n`` equal rows are taken.

    Only different documents are ordered; equal rows are one entry with their number.
    """
    open_ = _joined(ranked.where("_q is not null"), ends, ["source"]).where("_bin >= bin")
    last = open_.where("_bin = bin").groupBy(*KEY, "_q", "rest", "before").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("source").orderBy("_q", "_u", F.col("doc_id").asc_nulls_last(), "size", "_h")
    ahead = F.coalesce(F.sum(F.col("n") * F.col("size")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = F.col("rest") - F.col("before") - ahead
    # After the first entry that does not fit whole, nothing is left for any other.
    fits = F.least(F.col("n"), F.greatest(F.lit(0), F.floor(left / F.col("size"))))
    last = last.withColumn("k", fits)
    last = written(last, "mix-last")

    gaps = last.groupBy("source").agg((F.max("rest") - F.max("before") - F.sum(F.col("k") * F.col("size"))).alias("gap"))
    free = last.where("k < n").select(*KEY, "_q").unionByName(open_.where("_bin > bin").select(*KEY, "_q"))
    off = F.abs(F.col("gap") - F.col("size"))
    near = _joined(free, gaps, ["source"], "inner").where(off < F.col("gap"))
    choice = F.struct(off.alias("off"), "_q", "_u", F.col("doc_id").isNull().alias("no_id"), "doc_id", "size", "_h")
    nearest = near.groupBy("source").agg(F.min(choice).alias("c")).select(
        "source", "c._u", "c._h", "c.doc_id", "c.size", F.lit(1).cast("long").alias("more")
    )
    # One row per source: how many equal rows the closing document has.
    counts = _joined(ranked.where("_q is not null"), nearest, KEY, "inner").groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"))
    closing = counts.select(*KEY, "n", F.lit(1).cast("long").alias("k"))
    both = last.select(*KEY, "n", "k").unionByName(closing)
    return both.groupBy(*KEY).agg(F.max("n").alias("n"), F.sum("k").cast("long").alias("k"))


def mixed(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """``docs`` with ``size``, ``source_size``, ``target`` and ``taken``."""
    numbers = written(sized(docs, mix).drop("row"), "mix-numbers")
    plan = written(targets(numbers, mix), "mix-targets")
    plan = written(_joined(plan, inclusion(numbers, plan), ["source"]), "mix-plan")
    ranked = _ranked(numbers, plan)
    coarse = written(_cut(ranked, plan, BINS, None), "mix-coarse")
    fine = written(_cut(ranked, plan, 1, coarse), "mix-fine")
    special = written(_special(ranked, fine), "mix-special")

    placed = _joined(_ranked(sized(docs, mix), plan), fine, ["source"])
    placed = _joined(placed, special, KEY)
    # Equal rows of which some are taken are told apart by any order: the result is the same.
    some = F.col("k").isNotNull() & (F.col("k") > 0) & (F.col("k") < F.col("n"))
    certain = F.col("copies") * F.col("size")
    before = F.coalesce(F.col("_bin") < F.col("bin"), F.lit(False))
    sampled = F.when(F.col("k").isNotNull(), F.col("k") > 0).otherwise(before)
    settled = placed.where(~some).withColumn("taken", certain + F.when(sampled, F.col("size")).otherwise(F.lit(0)))
    equal = Window.partitionBy(*KEY).orderBy("k")
    split = placed.where(some).withColumn("_place", F.row_number().over(equal))
    split = split.withColumn("taken", certain + F.when(F.col("_place") <= F.col("k"), F.col("size")).otherwise(F.lit(0)))
    return settled.unionByName(split.drop("_place")).select("row.*", *RESULT)


def copies(taken: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The mix itself: every taken document, whole, as often as it was taken."""
    times = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size"))).otherwise(F.lit(0)).cast("int")
    whole = taken.withColumn("_times", times).where("_times > 0")
    whole = whole.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_times"))))
    return whole.select(*[f"`{c}`" for c in columns])


ORACLE = r"""
WITH sizes AS (
  SELECT doc_id, source,
    coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    coalesce(md5(text), '') AS h,
    (('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, '') || ':' || coalesce(md5(text), '')), 1, 13))::BIGINT + 0.5::DOUBLE)
      / 4503599627370496::DOUBLE AS u
  FROM documents
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sizes GROUP BY source
), weighed AS (
  SELECT *, [3, 1, 2][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w FROM sources
), stop AS (
  -- the level at which the words poured in equal the budget: try every number of full sources
  SELECT a.source_size::DOUBLE / a.w AS at_most,
    (SELECT sum(source_size)::DOUBLE * 1.5 FROM weighed) AS budget,
    (SELECT coalesce(sum(2 * source_size), 0)::DOUBLE FROM weighed b WHERE b.source_size::DOUBLE / b.w < a.source_size::DOUBLE / a.w) AS full_words,
    (SELECT sum(w)::DOUBLE FROM weighed b WHERE b.source_size::DOUBLE / b.w >= a.source_size::DOUBLE / a.w) AS open_weight
  FROM weighed a
), level AS (
  SELECT arg_min((budget - full_words) / open_weight, at_most) AS common
  FROM stop WHERE (budget - full_words) / open_weight <= 2 * at_most
), goals AS (
  SELECT source, source_size, least(2.0::DOUBLE * source_size, common * w) AS target FROM weighed, level
), plan AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(floor(target + 0.5) / source_size)::BIGINT ELSE 0 END AS copies FROM goals
), rests AS (
  SELECT *, floor(target + 0.5)::BIGINT - copies * source_size AS rest FROM plan
), units AS (
  -- the largest size for which no smaller document is more than certain
  SELECT source, arg_max(unit, size) AS unit FROM (
    SELECT source, size, (rest - coalesce(sum(n * size) OVER (PARTITION BY source ORDER BY size DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
      / sum((n * size)::DOUBLE * size) OVER (PARTITION BY source ORDER BY size) AS unit
    FROM (SELECT s.source, size, any_value(rest) AS rest, count(*) AS n FROM sizes s JOIN rests r ON s.source IS NOT DISTINCT FROM r.source
          WHERE size > 0 AND rest > 0 GROUP BY s.source, size))
  WHERE unit * size <= 1 GROUP BY source
), odds AS (
  SELECT s.*, r.source_size, r.target, r.copies, r.rest, row_number() OVER () AS uid, unit * size AS p
  FROM sizes s JOIN rests r ON s.source IS NOT DISTINCT FROM r.source LEFT JOIN units t ON s.source IS NOT DISTINCT FROM t.source
), ranked AS (
  SELECT *, CASE WHEN size > 0 THEN CASE WHEN p < 1 THEN (u / (1 - u)) / (p / (1 - p)) WHEN p >= 1 THEN 0 END END AS q FROM odds
), running AS (
  SELECT uid, source, size, rest, q, u, doc_id, h,
    sum(size) OVER (PARTITION BY source ORDER BY q, u, doc_id NULLS LAST, size, h ROWS UNBOUNDED PRECEDING) <= rest AS fits
  FROM ranked WHERE q IS NOT NULL
), gaps AS (
  SELECT source, max(rest) - coalesce(sum(size) FILTER (fits), 0) AS gap FROM running GROUP BY source
), closing AS (
  SELECT uid FROM running r JOIN gaps g ON r.source IS NOT DISTINCT FROM g.source
  WHERE NOT fits AND abs(gap - size) < gap
  QUALIFY row_number() OVER (PARTITION BY r.source ORDER BY abs(gap - size), q, u, doc_id NULLS LAST, size, h) = 1
)
SELECT doc_id, source, size, source_size, target,
  (copies * size + CASE WHEN uid IN (SELECT uid FROM running WHERE fits) OR uid IN (SELECT uid FROM closing) THEN size ELSE 0 END)::BIGINT AS taken
FROM ranked
"""


def query(docs: DataFrame) -> DataFrame:
    return mixed(docs).select("doc_id", "source", *RESULT)
