"""Document fingerprints: Merkle trees over sections and paragraphs, in SQL functions.

A section is a line of the text, a paragraph a piece of a line up to ``. ! ?`` and a
space. A leaf is the SHA-256 of a paragraph, a section's node the SHA-256 of its
leaves, the root that of its sections' nodes; each kind is hashed with its own first
letter, and the pieces joined give the text again, so equal roots mean equal texts.

A fingerprint is one string, ``root,s<section>,<leaf>,<leaf>,s<section>,...``: the root
whole, 16 hex digits of a section's node, 8 of a leaf. The likeness of two
fingerprints is the Dice share of their distinct nodes: 1 for equal texts only, and
``changed`` lists the branches of one that the other lacks, which locates edits.

The next document in the order of doc_id comes without a global sort: ids are cut at
quantiles into ranges, a range is one window partition, and the first row of a range
is also sent to the range before it (the first of all to the last). The texts are
shuffled once; what the driver sees is the list of range ends.

Defined results: a missing text counts as empty; an empty text is one empty paragraph.
Missing doc_ids come last; rows of equal doc_id follow each other by a hash of the
text, then by the text. A single row is its own next. A very long text is one array of
nodes. An empty table gives an empty table. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import id_key, written


def _node(kind: str, parts: Column) -> Column:
    return F.sha2(F.concat(F.lit(kind), parts).cast("binary"), 256)


def branches(text: Column) -> Column:
    """Per section: its node ``h`` and its ``leaves``."""

    def section(line: Column) -> Column:
        pieces = F.split(F.regexp_replace(line, r"([.!?]) ", "$1 \n"), "\n", -1)
        return F.transform(pieces, lambda piece: _node("p", piece))

    def branch(leaves: Column) -> Column:
        return F.struct(_node("s", F.array_join(leaves, "")).alias("h"), leaves.alias("leaves"))

    return F.transform(F.transform(F.split(text, "\n", -1), section), branch)


def fingerprint(tree: Column) -> Column:
    """The string of a tree given by its branches."""
    root = _node("r", F.array_join(F.transform(tree, lambda b: b["h"]), ""))
    rest = F.transform(
        tree,
        lambda b: F.concat(
            F.lit("s"), F.left(b["h"], F.lit(16)), F.lit(","),
            F.array_join(F.transform(b["leaves"], lambda leaf: F.left(leaf, F.lit(8))), ","),
        ),
    )
    return F.concat(root, F.lit(","), F.array_join(rest, ","))


def likeness(nodes: Column, others: Column) -> Column:
    """Dice share of two sets of nodes, each an array without repeats."""
    return F.lit(2.0) * F.size(F.array_intersect(nodes, others)) / (F.size(nodes) + F.size(others))


def nodes(mark: Column) -> Column:
    return F.array_distinct(F.split(mark, ",", -1))


def changed(mark: Column, other: Column) -> Column:
    """The nodes of ``mark`` that ``other`` lacks, from the root down: the edited branches."""
    return F.array_except(nodes(mark), nodes(other))


def _range(key: Column, ends: list[int]) -> Column:
    """The number of ends that are not above the key, looked up in two steps."""
    width = max(1, int(len(ends) ** 0.5))
    groups = [ends[at : at + width] for at in range(0, len(ends), width)]
    if not groups:
        return F.lit(0)
    heads = F.lit([group[0] for group in groups])
    group = F.size(F.filter(heads, lambda end: end <= key)) - 1
    inside = F.size(F.filter(F.get(F.array(*[F.lit(g) for g in groups]), group), lambda end: end <= key))
    return F.when(group < 0, 0).otherwise(group * width + inside)


def with_next(docs: DataFrame, per_task: int = 8) -> DataFrame:
    """``doc_id, text, mark, next_text, next_mark``: every row beside the next one."""
    plain = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), id_key("doc_id").alias("key"))
    plain = plain.withColumn("h", F.xxhash64("text"))
    ranges = per_task * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shares = [n / ranges for n in range(1, ranges)]
    ids = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("key"))
    ends = sorted({int(end) for end in ids.approxQuantile("key", shares, 0.2 / ranges)})
    placed = plain.withColumn("part", _range(F.col("key"), ends))

    heads = placed.groupBy("part").agg(F.min(F.struct("key", "h")).alias("head"))
    # One row per range: the window over ranges stays small.
    around = Window.orderBy("part")
    before = F.coalesce(F.lag("part").over(around), F.max("part").over(Window.partitionBy()))
    heads = written(heads.select("part", before.alias("before"), "head.key", "head.h"), "range-heads")
    sent = placed.join(heads.withColumnRenamed("part", "own"), ["key", "h"], "left")
    here = F.struct(F.col("part").alias("part"), F.lit(False).alias("guest"))
    there = F.struct(F.col("before").alias("part"), F.lit(True).alias("guest"))
    is_head = F.col("own").eqNullSafe(F.col("part"))
    sent = sent.withColumn("to", F.explode(F.when(is_head, F.array(here, there)).otherwise(F.array(here))))
    told = sent.select("doc_id", "key", "h", "text", "to.part", "to.guest").repartition("part")
    told = told.withColumn("mark", fingerprint(branches(F.col("text"))))
    follow = Window.partitionBy("part").orderBy("guest", "key", "h", "text")
    return (
        told.withColumns({"next_text": F.lead("text").over(follow), "next_mark": F.lead("mark").over(follow)})
        .where("not guest")
        .select("doc_id", "text", "mark", "next_text", "next_mark")
    )


def query(docs: DataFrame) -> DataFrame:
    """Fingerprints of the texts, of their edited texts, and how near they are."""
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.left(F.col("text"), F.length("text") - half), F.left(F.col("next_text"), half))
    both = with_next(docs).select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), F.col("mark").alias("fingerprint"),
        edited.alias("edited"), "next_mark",
    )
    both = both.withColumn("edited_fingerprint", fingerprint(branches(F.col("edited"))))
    both = both.withColumns({"_own": nodes(F.col("fingerprint")), "_edited": nodes(F.col("edited_fingerprint")), "_next": nodes(F.col("next_mark"))})
    return both.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        "fingerprint", "edited_fingerprint",
        likeness(F.col("_own"), F.col("_edited")).alias("near_edited"),
        likeness(F.col("_own"), F.col("_next")).alias("near_next"),
    )


ORACLE = r"""
WITH plain AS (
  SELECT doc_id, coalesce(text, '') AS text FROM documents
), pairs AS (
  SELECT doc_id, text,
    coalesce(lead(text) OVER (ORDER BY doc_id), first_value(text) OVER (ORDER BY doc_id)) AS next_text
  FROM plain
), edits AS (
  SELECT *, left(text, length(text) - length(text) // 2) || left(next_text, length(text) // 2) AS edited FROM pairs
), trees AS (
  SELECT doc_id, kind, list_transform(string_split(body, chr(10)), lambda line: list_transform(
    string_split(regexp_replace(line, '([.!?]) ', '\1 ' || chr(10), 'g'), chr(10)), lambda piece: sha256('p' || piece))) AS leaves
  FROM (SELECT doc_id, 'own' AS kind, text AS body FROM edits
        UNION ALL SELECT doc_id, 'edited', edited FROM edits)
), nodes AS (
  SELECT doc_id, kind, leaves, list_transform(leaves, lambda l: sha256('s' || array_to_string(l, ''))) AS sections FROM trees
), marks AS (
  SELECT doc_id, kind, sha256('r' || array_to_string(sections, '')) || ',' || array_to_string(list_transform(
      list_zip(sections, leaves), lambda z: 's' || left(z[1], 16) || ',' || array_to_string(list_transform(z[2], lambda x: left(x, 8)), ',')), ',') AS mark
  FROM nodes
), beside AS (
  SELECT e.doc_id, length(e.text)::BIGINT AS n_chars, sha256(e.edited) AS edited_sha256, o.mark AS fingerprint, x.mark AS edited_fingerprint,
    coalesce(lead(o.mark) OVER (ORDER BY e.doc_id), first_value(o.mark) OVER (ORDER BY e.doc_id)) AS next_mark
  FROM edits e JOIN marks o ON o.doc_id = e.doc_id AND o.kind = 'own' JOIN marks x ON x.doc_id = e.doc_id AND x.kind = 'edited'
), parts AS (
  SELECT *, list_distinct(string_split(fingerprint, ',')) AS a, list_distinct(string_split(edited_fingerprint, ',')) AS b,
    list_distinct(string_split(next_mark, ',')) AS c FROM beside
)
SELECT doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
  2.0::DOUBLE * len(list_intersect(a, b)) / (len(a) + len(b)) AS near_edited,
  2.0::DOUBLE * len(list_intersect(a, c)) / (len(a) + len(c)) AS near_next
FROM parts
"""
