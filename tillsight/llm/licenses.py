"""License scans: diagonal voting of word k-grams, in SQL functions only.

A text's words (A-Z lower-cased) give a rolling hash for every run of three words. The
hashes are joined to the runs of the templates; a run that meets position ``p`` of a
template from word ``w`` of the text votes for the diagonal ``w - p``, the word at which
the template would start. The join compares the words too, so no vote rests on a hash.
Votes are added up by diagonal, neighbouring diagonals (a few words put in or left out)
are merged, and a merged span is verified: the share of the template's words that its
runs cover, and that the span is not much longer than what is covered.

Base templates are short phrases that must stand whole: one diagonal with every run.

The templates are a parameter, a few hundred runs, and Spark broadcasts them by their
size. Only votes and one row per document are shuffled, by a number that every row gets
when it is read; a document's votes meet in one task, copies of a text in many.

Defined results: a missing or empty text has no words, no places and a score of 0; texts
under three words have no runs. Rows without id or of equal id are scanned each for
itself; repeated rows give repeated results; an empty table an empty one. A phrase that
stands several times counts every time. A text is one array of words, however long.
Extra columns pass through if they are carried, under any name but those of the result.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import lookup_frame
from .common import ascii_lower_words as words

K = 3
RESULT = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")

#: Phrases that must stand whole, and their labels.
BASE = (
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
)
#: Notices of well-known licenses, of which most words must stand.
NOTICES = (
    ("apache-2", "licensed under the apache license version 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-nc", "licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("gpl-3", "this work is licensed under the gnu general public license version 3"),
    ("gpl-3", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal in the software without restriction"),
)


@dataclass(frozen=True)
class Scan:
    """Phrases and notices as (label, text), and when a notice counts as found.

    ``share`` of its words must be covered, and as much of the span in the text;
    diagonals are neighbours up to one word for every ``slack`` words of a notice.
    """

    base: Sequence[tuple[str, str]] = BASE
    notices: Sequence[tuple[str, str]] = NOTICES
    share: float = 0.75
    slack: int = 8


def with_runs(texts: DataFrame, *carry: str) -> DataFrame:
    """One row per word of ``words``: its place ``at`` and the hash of the run that starts there.

    A text without words is one row with nulls; the last words start no run.
    """
    every = texts.select(*carry, "words", F.posexplode_outer("words").alias("at", "word"))
    parts = [F.col("word"), *[F.get("words", F.col("at") + step) for step in range(1, K)]]
    return every.select(*carry, "words", "at", F.when(F.col("at") + K <= F.size("words"), F.xxhash64(*parts)).alias("hash"))


def template_runs(spark, scan: Scan) -> DataFrame:
    """One row per run of a template: ``h, run`` and what the template is."""
    listed = [(n, kind == 0, label, text) for n, (kind, label, text) in enumerate(
        [(0, *row) for row in scan.base] + [(1, *row) for row in scan.notices]
    )]
    schema = pa.schema([("template", pa.int32()), ("base", pa.bool_()), ("label", pa.string()), ("body", pa.string())])
    found = lookup_frame(spark, schema, listed).withColumn("words", words(F.col("body")))
    found = found.withColumn("length", F.size("words")).withColumn(
        "slack", F.when(F.col("base"), F.lit(0)).otherwise(F.floor(F.col("length") / scan.slack).cast("int"))
    )
    told = ("template", "base", "label", "length", "slack")
    runs = with_runs(found, *told).where("hash is not null")
    return runs.select(*told, F.col("at").alias("place"), F.col("hash").alias("h"), F.slice("words", F.col("at") + 1, K).alias("run"))


def votes(docs: DataFrame, scan: Scan, carry: Sequence[str]) -> DataFrame:
    """Every run that a template shares, and at least one row per document, by ``uid``."""
    read = docs.select(
        F.monotonically_increasing_id().alias("uid"),
        F.struct(*[f"`{c}`" for c in carry]).alias("row"),
        words(F.col("text")).alias("words"),
    )
    known = template_runs(docs.sparkSession, scan)
    met = with_runs(read, "uid", "row").join(known, F.col("hash") == F.col("h"), "left")
    # Only here are the words of a run cut out: for the few whose hash is known.
    same = F.col("template").isNotNull() & (F.slice("words", F.col("at") + 1, K) == F.col("run"))
    first = F.col("at").isNull() | (F.col("at") == 0)
    told = ("template", "base", "label", "length", "slack", "place")
    return met.where(first | same).select(
        "uid", F.when(first, F.col("row")).alias("row"), F.when(first, F.size("words")).cast("long").alias("n_words"),
        *[F.when(same, F.col(c)).alias(c) for c in told],
        F.when(same, F.col("at") - F.col("place")).alias("diagonal"),
    ).repartition("uid")


def spans(voted: DataFrame, scan: Scan) -> DataFrame:
    """Merged diagonals per document and template: first and last word, share, verdict.

    Rows of a document's own, without a template, pass through with nulls.
    """
    template = ["uid", "template", "base", "label", "length", "slack"]
    lines = voted.groupBy(*template, "diagonal").agg(
        F.first("row", ignorenulls=True).alias("row"), F.max("n_words").alias("n_words"),
        F.collect_set("place").alias("places"),
    )
    along = Window.partitionBy("uid", "template").orderBy("diagonal")
    apart = F.col("diagonal") - F.lag("diagonal").over(along) > F.col("slack")
    lines = lines.withColumn("_new", F.when(apart, 1).otherwise(0))
    lines = lines.withColumn("group", F.sum("_new").over(along.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    merged = lines.groupBy(*template, "group").agg(
        F.first("row", ignorenulls=True).alias("row"), F.max("n_words").alias("n_words"),
        F.array_distinct(F.flatten(F.collect_list("places"))).alias("places"),
        F.min(F.col("diagonal") + F.array_min("places")).cast("long").alias("first"),
        (F.max(F.col("diagonal") + F.array_max("places")) + K - 1).cast("long").alias("last"),
    )
    covered = F.size(F.array_distinct(F.flatten(F.transform("places", lambda p: F.sequence(p, p + K - 1)))))
    found = F.col("template").isNotNull()
    merged = merged.withColumn("covered", F.when(found, covered)).withColumn("share", F.col("covered") / F.col("length"))
    dense = F.col("covered") >= scan.share * (F.col("last") - F.col("first") + 1)
    kept = F.when(F.col("base"), F.col("covered") == F.col("length")).otherwise((F.col("share") >= scan.share) & dense)
    return merged.withColumn("kept", F.when(found, kept)).drop("places", "covered")


def scanned(docs: DataFrame, scan: Scan = Scan(), carry: Sequence[str] | None = None) -> DataFrame:
    """Every document's carried columns (all by default), the result and the kept ``spans``."""
    chosen = [c for c in (docs.columns if carry is None else carry) if c.lower() not in (*RESULT, "spans")]
    carried = [f"row.`{c}`" for c in chosen] or [F.lit(None).alias("_nothing")]
    found = spans(votes(docs, scan, chosen), scan)
    base = F.col("kept") & F.col("base")
    span = F.struct("first", "last", "label", "base", "share")
    told = found.groupBy("uid").agg(
        F.first("row", ignorenulls=True).alias("row"),
        F.max("n_words").alias("n_words"),
        F.count_if(base).alias("n_base"),
        F.min(F.when(base, F.col("first"))).alias("first_word"),
        F.max(F.when(base, F.col("first"))).alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(base, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("kept"), F.col("label")))), ",").alias("labels"),
        F.coalesce(F.max("share"), F.lit(0.0)).alias("score"),
        F.array_sort(F.collect_list(F.when(F.col("kept"), span))).alias("spans"),
    )
    return told.select(*carried, *RESULT, "spans")


def query(docs: DataFrame) -> DataFrame:
    return scanned(docs, carry=["doc_id"]).select("doc_id", *RESULT)


def _listed() -> str:
    rows = [("true", *row) for row in BASE] + [("false", *row) for row in NOTICES]
    return ", ".join(f"({n}, {base}, '{label}', '{text}')" for n, (base, label, text) in enumerate(rows))


ORACLE = r"""
WITH docs AS (
  SELECT row_number() OVER () AS uid, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM documents
), templates AS (
  SELECT *, string_split(body, ' ') AS words FROM (VALUES LISTED) t(template, base, label, body)
), known AS (
  SELECT template, base, label, len(words) AS length, CASE WHEN base THEN 0 ELSE len(words) // 8 END AS slack, p AS place,
    words[p + 1 : p + 3] AS run
  FROM (SELECT *, unnest(range(len(words) - 2)) AS p FROM templates)
), every AS (
  SELECT uid, w, words[w + 1 : w + 3] AS run FROM (SELECT uid, words, unnest(range(len(words) - 2)) AS w FROM docs)
), votes AS (
  SELECT DISTINCT uid, template, base, label, length, slack, place, w - place AS diagonal FROM every JOIN known USING (run)
), apart AS (
  SELECT *, diagonal - lag(diagonal) OVER (PARTITION BY uid, template ORDER BY diagonal) > slack AS fresh
  FROM (SELECT uid, template, base, label, length, slack, diagonal, list(place) AS places FROM votes GROUP BY ALL)
), grouped AS (
  SELECT *, sum(coalesce(fresh, false)::INT) OVER (PARTITION BY uid, template ORDER BY diagonal) AS grp FROM apart
), merged AS (
  SELECT uid, base, label, length, grp, min(diagonal + list_min(places)) AS first, max(diagonal + list_max(places)) + 2 AS last,
    len(list_distinct(flatten(list(flatten(list_transform(places, lambda p: [p, p + 1, p + 2])))))) AS covered
  FROM grouped GROUP BY uid, template, base, label, length, grp
), spans AS (
  SELECT *, covered::DOUBLE / length AS share,
    CASE WHEN base THEN covered = length ELSE covered::DOUBLE / length >= 0.75 AND covered >= 0.75 * (last - first + 1) END AS kept
  FROM merged
)
SELECT doc_id, len(words)::BIGINT AS n_words, count(*) FILTER (kept AND base) AS n_base,
  min(first) FILTER (kept AND base)::BIGINT AS first_word, max(first) FILTER (kept AND base)::BIGINT AS last_word,
  coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (kept AND base), '') AS base_labels,
  coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (kept), '') AS labels,
  coalesce(max(share), 0)::DOUBLE AS score
FROM docs LEFT JOIN spans USING (uid) GROUP BY uid, doc_id, words
""".replace("LISTED", _listed())
