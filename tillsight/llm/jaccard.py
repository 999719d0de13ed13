"""N-gram Jaccard join: MinHash banding, then exact verification.

A text's words are its runs of letters, digits and underscores in lower case; its
set holds the 64-bit hashes of all runs of ``words`` words (of all its words, if
fewer). Texts with equal sets are one class, a node named by a 64-bit hash of the
set; copies are never expanded into pairs.

Banding of fixed depth replaces an LSH forest: there are ``trees`` bands, and a node's
label in a band is a prefix of ``depth()`` MinHash values. Nodes of equal prefixes meet
by a shuffle on them. Two sets of similarity s share a prefix of length d in some band
with probability 1 - (1 - s^d)^trees; the depth is the longest, ``longest`` at most, at
which that recall, at the threshold, reaches the target. It is known before data is
read: labels are neither sorted nor shortened by the data. The nodes under one prefix are tied to the smallest of them, which is linear in the nodes; the
connected components of these ties hold every candidate pair.

Within a component every pair is verified on the exact sets, in blocks: a component
is dealt out by hash into as many blocks as its nodes and hashes need, and one task
compares one pair of blocks as matrices. It returns one row per node, the number of
rows its links lead to and the smallest node it is linked to in that pair of blocks,
so rows follow the nodes and not the pairs. No bucket, component or partner list is
capped. Components of the verified links are the groups.

Defined results: texts without words (missing, empty, only signs) match nothing and
are groups of their own; a row without doc_id takes part and names its group only if
all of the group lack one, as null; repeated rows are rows of one class, linked to
each other. A very long text is one set of shingles, in a slice of its own. An empty table
gives an empty table. Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LAST_ID, free_name, id_key, prepared, slices, written
from .components import components

SLICE = 4 << 20
WORDS = re.compile(r"\w+")
#: Odd multipliers that mix 64-bit numbers.
MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


@dataclass(frozen=True)
class Forest:
    words: int = 5
    similarity: float = 0.8
    trees: int = 40
    longest: int = 10
    recall: float = 0.9999
    seed: int = 7
    #: One block of a component holds about this many nodes and hashes.
    block_nodes: int = 400
    block_hashes: int = 400_000

    def depth(self) -> int:
        """The longest prefix that reaches the target recall at the threshold."""
        for depth in range(self.longest, 0, -1):
            if 1 - (1 - self.similarity**depth) ** self.trees >= self.recall:
                return depth
        raise ValueError("the target recall needs more trees")


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * MIX[1]
    x = (x ^ (x >> np.uint64(27))) * MIX[2]
    return x ^ (x >> np.uint64(31))


class _WordHashes(dict):
    """Hashes of words, forgotten when there are many."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word.encode())
        return value


def shingles(text: str | None, words: int, known: dict[str, int]) -> np.ndarray:
    """The sorted set of hashes of a text's word runs."""
    found = WORDS.findall(text.lower()) if text else []
    single = np.fromiter(map(known.__getitem__, found), dtype=np.uint64, count=len(found))
    if not len(single):
        return single
    width = min(words, len(single))
    runs = np.zeros(len(single) - width + 1, dtype=np.uint64)
    for at in range(width):
        runs = _mixed(runs * MIX[0] + single[at : len(single) - width + 1 + at])
    return np.unique(runs)


def node_name(hashes: np.ndarray) -> int:
    return int.from_bytes(xxhash.xxh3_64_digest(hashes.tobytes()), "big", signed=True)


def prefixes(hashes: np.ndarray, factors: np.ndarray, trees: int) -> np.ndarray:
    """One hash per tree, of the first values of the node's label and the tree's number."""
    lowest = np.full(len(factors), np.iinfo(np.uint64).max, dtype=np.uint64)
    for start in range(0, len(hashes), 256):
        np.minimum(lowest, (hashes[start : start + 256, None] * factors).min(axis=0), out=lowest)
    out = np.arange(1, trees + 1, dtype=np.uint64)
    for value in lowest.reshape(trees, -1).T:
        out = _mixed(out * MIX[0] + value)
    return out.view(np.int64)


def described(docs: DataFrame, forest: Forest) -> DataFrame:
    """One narrow row per row of ``docs``: ids, node, size of its set, prefixes."""
    kept = docs.select(
        id_key("doc_id").alias("doc"), F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text")).alias("key"), "text"
    )
    depth = forest.depth()
    dice = np.random.default_rng(forest.seed)
    factors = dice.integers(0, 1 << 63, size=forest.trees * depth, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def emit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _WordHashes()
        for batch in slices(batches, "text", SLICE):
            nodes, sizes, labels = [], [], []
            for text in batch.column(2).to_pylist():
                own = shingles(text, forest.words, known)
                nodes.append(node_name(own) if len(own) else None)
                sizes.append(len(own))
                labels.append(prefixes(own, factors, forest.trees) if len(own) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()),
                 pa.array(labels, pa.list_(pa.int64()))],
                names=["doc", "key", "node", "n", "prefixes"],
            )

    return kept.mapInArrow(emit, "doc long, key long, node long, n long, prefixes array<long>")


def candidates(classes: DataFrame) -> DataFrame:
    """Components of the forest's prefixes: ``node, root`` for every node that shares one."""
    under = classes.select("node", F.explode("prefixes").alias("prefix"))
    shared = under.groupBy("prefix").agg(F.min("node").alias("first"), F.max("node").alias("last"))
    shared = written(shared.where("first <> last").select("prefix", "first"), "prefixes")
    ties = under.join(shared, "prefix").where("node <> first").select("node", "first").distinct()
    found = components(ties)
    return found.union(found.select("root", "root").distinct())


def _linked(sizes: np.ndarray, hashes: list[np.ndarray], similarity: Fraction) -> np.ndarray:
    """The matrix of links, from the sizes of all intersections."""
    _, columns, counts = np.unique(np.concatenate(hashes), return_inverse=True, return_counts=True)
    shared = counts > 1
    number = np.cumsum(shared) - 1
    rows = np.repeat(np.arange(len(hashes)), sizes)
    use = shared[columns]
    rows, columns = rows[use], number[columns[use]]
    order = np.argsort(columns, kind="stable")
    rows, columns = rows[order], columns[order]
    common = np.zeros((len(hashes), len(hashes)), dtype=np.float64)
    step = 4096
    for start in range(0, int(columns[-1]) + 1 if len(columns) else 0, step):
        low, high = np.searchsorted(columns, [start, start + step])
        part = np.zeros((len(hashes), step), dtype=np.float32)
        part[rows[low:high], columns[low:high] - start] = 1
        common += part @ part.T
    union = sizes[:, None] + sizes[None, :] - common
    linked = common * similarity.denominator >= union * similarity.numerator
    np.fill_diagonal(linked, False)
    return linked


def _smallest(linked: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    """The smallest node that each node reaches by links."""
    reached = nodes.copy()
    left = np.ones(len(nodes), dtype=bool)
    for first in np.argsort(nodes):
        if not left[first]:
            continue
        wave = np.zeros(len(nodes), dtype=bool)
        wave[first] = True
        while wave.any():
            reached[wave], left[wave] = nodes[first], False
            wave = linked[wave].any(axis=0) & left
    return reached


def verified(docs: DataFrame, classes: DataFrame, found: DataFrame, forest: Forest) -> DataFrame:
    """``node, links, peer``: exact links inside the components, by pair of blocks."""
    members = written(found.join(classes.select("node", "key", "n", "copies"), "node"), "members")
    sizes = members.groupBy("root").agg(
        F.greatest(
            F.ceil(F.count("*") / forest.block_nodes), F.ceil(F.sum("n") / forest.block_hashes)
        ).cast("int").alias("blocks")
    )
    sizes = written(sizes, "components")
    placed = members.join(sizes, "root").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text")).alias("key"), "text")
    told = texts.join(placed, "key").select("root", "blocks", "block", "node", "copies", "text")

    def sets(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _WordHashes()
        for batch in slices(batches, "text", SLICE):
            texts, nodes = batch.column(5).to_pylist(), batch.column(3).to_pylist()
            hashes = [shingles(text, forest.words, known) for text in texts]
            # Rows of equal doc_id may have other texts; theirs is another node.
            own = pa.array([bool(len(h)) and node_name(h) == node for h, node in zip(hashes, nodes)], pa.bool_())
            column = pa.array([h.tobytes() for h in hashes], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], column], names=[*batch.schema.names[:5], "hashes"]).filter(own)

    with_sets = told.mapInArrow(sets, "root long, blocks int, block int, node long, copies long, hashes binary")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    dealt = with_sets.select("*", other).select(
        "root", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "copies", "hashes"
    )
    dealt = dealt.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j", "node")
    similarity = Fraction(forest.similarity).limit_denominator(10_000)

    def compare(rows: list[tuple]) -> list[tuple]:
        i, j = rows[0][1:3]
        rows = [row for n, row in enumerate(rows) if not n or row[4] != rows[n - 1][4]]  # a node once
        hashes = [np.frombuffer(row[6], dtype=np.uint64) for row in rows]
        linked = _linked(np.array([len(h) for h in hashes]), hashes, similarity)
        block = np.array([row[3] for row in rows])
        if i != j:
            linked &= block[:, None] != block[None, :]
        nodes = np.array([row[4] for row in rows])
        links = linked @ np.array([row[5] for row in rows], dtype=np.float64)
        return list(zip(nodes.tolist(), links.astype(np.int64).tolist(), _smallest(linked, nodes).tolist()))

    def pairs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        out: list[tuple] = []

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=["node", "links", "peer"])

        for batch in batches:
            for row in zip(*(column.to_pylist() for column in batch.columns)):
                if held and held[0][:3] != row[:3]:
                    out += compare(held)
                    held = []
                    if len(out) > 10_000:
                        yield batch_of(out)
                        out = []
                held.append(row)
        if held:
            out += compare(held)
        if out:
            yield batch_of(out)

    return dealt.mapInArrow(pairs, "node long, links long, peer long")


def near_duplicates(docs: DataFrame, forest: Forest = Forest()) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, key, node, root, class_id, n_links``."""
    prepared(docs.sparkSession)
    rows = written(described(docs, forest), "jaccard-rows")
    classes = rows.where("node is not null").groupBy("node").agg(
        F.min("doc").alias("doc"), F.min("key").alias("key"), F.count("*").alias("copies"),
        F.any_value("n").alias("n"), F.any_value("prefixes").alias("prefixes"),
    )
    classes = written(classes, "jaccard-classes")
    checked = written(verified(docs, classes, candidates(classes), forest), "jaccard-links")
    links = checked.groupBy("node").agg(F.sum("links").alias("links"))
    groups = components(checked.where("node <> peer").select("node", "peer"))
    known = classes.select("node", "doc", "copies").join(groups, "node", "left").join(links, "node", "left")
    known = written(known.withColumn("root", F.coalesce("root", "node")), "jaccard-nodes")
    names = written(known.groupBy("root").agg(F.min("doc").alias("class_doc")), "jaccard-groups")
    named = written(
        known.join(names, "root").select("node", "root", "class_doc", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")),
        "jaccard-named",
    )
    told = rows.select("doc", "key", "node").join(named, "node", "left")

    def or_null(column: str) -> Column:
        return F.when(F.col(column) != LAST_ID, F.col(column))

    return told.select(
        or_null("doc").alias("doc_id"), "key", "node", "root",
        F.when(F.col("node").isNull(), or_null("doc")).otherwise(or_null("class_doc")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
    )


def one_of_each(docs: DataFrame, forest: Forest = Forest()) -> DataFrame:
    """``docs`` with one row of each group: the one of the smallest doc_id.

    Texts without words all stay. Where several rows of a group have the smallest id
    (or all lack one), the smallest node decides, and of equal texts one row stays.
    """
    found = written(near_duplicates(docs, forest), "jaccard-found")
    first = found.where("node is not null and doc_id <=> class_id")
    chosen = first.groupBy("root").agg(F.min(F.struct("node", "key")).alias("one")).select("one.key", "one.node")
    wordless = found.where("node is null").select("key", "node").distinct()
    keys = chosen.union(wordless).groupBy("key").agg(
        F.collect_set("node").alias("nodes"), F.max(F.col("node").isNull()).alias("wordless")
    )
    repeated = found.groupBy("key").agg(F.count("*").alias("rows")).where("rows > 1")
    keys = written(keys.join(repeated, "key", "left"), "jaccard-kept")

    names = docs.columns
    key, node, nodes, wordless, count = (free_name(names, f"{n}_of_row") for n in ("key", "node", "nodes", "wordless", "rows"))
    keyed = docs.withColumn(key, F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text")))
    kept = keyed.join(keys.toDF(key, nodes, wordless, count), key)
    single = kept.where(f"{count} is null").select(*[f"`{c}`" for c in names])
    place = [c.lower() for c in names].index("text")
    text_name = names[place]
    several = kept.where(f"{count} is not null").drop(count)

    def tell(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _WordHashes()
        for batch in slices(batches, text_name, SLICE):
            sets = [shingles(text, forest.words, known) for text in batch.column(place).to_pylist()]
            told_nodes = pa.array([node_name(own) if len(own) else None for own in sets], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, told_nodes], names=[*batch.schema.names, node])

    told = several.select(*[f"`{c}`" for c in names], key, nodes, wordless)
    told = told.mapInArrow(tell, T.StructType([*told.schema.fields, T.StructField(node, T.LongType())]))
    in_order = Window.partitionBy(key, node).orderBy(F.xxhash64(*[f"`{c}`" for c in names]))
    once = told.where(f"array_contains({nodes}, {node})").withColumn(count, F.row_number().over(in_order))
    signs = told.where(f"{node} is null and {wordless}")
    rest = once.where(f"{count} = 1").drop(count).unionByName(signs).select(*[f"`{c}`" for c in names])
    return single.unionByName(rest)


def query(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs).select("doc_id", "class_id", "n_links")
