"""Prefix tree of conversations: sorted neighbours, sparse tables, binary search.

A turn becomes a 128-bit digest of its role and text and the number of its code points;
texts are not shuffled. Conversations are sorted by their sequences of digests (then by
conv_id), by range, so a block is a run of neighbours in that order. Inside a block the
common prefix lengths of neighbours get a sparse table of range minima. Every candidate
prefix, that is every turn of every conversation of the block, searches its left and
right extent by itself, in steps of halving powers of two; equal prefixes find the same
interval and one of them is kept. An interval's members, smallest member, leaves,
children and saved tokens come from its ends by range minima and running sums.

Only prefixes of a block's first and last conversation can go on in other blocks. Their
parts add up by depth and path, since everything is counted at its first or last
conversation; what two neighbouring blocks both counted is their common prefix, and one
correction per depth of it is added. So no node's members ever meet in one task.

The ids of conversations that end at a node stand next to each other, in numeric order.
A block joins its own; a node that several blocks share is hashed over their pieces in
order, one piece in memory at a time.

Bounds: a task holds the digests (24 bytes a turn) of one block, a row those of one
conversation. The window over blocks has two conversations per block.

Defined results: rows without conv_id belong to no conversation and are left out. Turns
of equal number (or none) follow each other by role, then by digest; repeated rows are
turns of their own; a missing role or text is empty. A conversation without turns is a
member of the root alone. An empty table has no nodes. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

MEASURES = ("n_convs", "n_children", "n_leaves", "saved_tokens")
RESULT = ("conv_id", "depth", "parent_conv_id", *MEASURES, "ends_sha256")
NOTHING = hashlib.sha256(b"").hexdigest()
#: Kinds of rows that a block gives.
NODE, PART, PIECE, ENDS = 0, 1, 2, 3
GIVEN = pa.schema([
    ("kind", pa.int32()), ("depth", pa.int64()), ("conv_id", pa.int64()), ("parent_conv_id", pa.int64()),
    *[(name, pa.int64()) for name in MEASURES], ("ends_sha256", pa.string()),
    ("path", pa.binary()), ("parent_path", pa.binary()), ("piece", pa.binary()),
    ("first_id", pa.int64()), ("first", pa.list_(pa.binary())),
    ("last", pa.list_(pa.binary())), ("last_chars", pa.list_(pa.int64())),
])
GIVEN_DDL = (
    "kind int, depth long, conv_id long, parent_conv_id long, "
    + ", ".join(f"{name} long" for name in MEASURES)
    + ", ends_sha256 string, path binary, parent_path binary, piece binary, "
    "first_id long, first array<binary>, last array<binary>, last_chars array<long>"
)


@dataclass(frozen=True)
class Rebuild:
    """A conversation starts with the first ``crc32(id) % most`` turns of its group's first one."""

    group: int = 100
    most: int = 6


def digest(role: Column, text: Column) -> Column:
    """128 bits that tell a turn from every other."""
    return F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary")))


def sequences(turns: DataFrame) -> DataFrame:
    """``conv_id`` and its ``turns`` in order, each a digest ``d`` and code points ``n``."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    turn = F.struct(
        F.col("turn").cast("long").alias("turn"), role.alias("role"), digest(role, text).alias("d"),
        F.length(text).cast("long").alias("n"),
    )
    known = turns.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("turn"))
    return known.groupBy("conv_id").agg(F.array_sort(F.collect_list("turn")).alias("turns")).select(
        "conv_id", F.transform("turns", lambda t: F.struct(t["d"].alias("d"), t["n"].alias("n"))).alias("turns")
    )


def rebuilt(own: DataFrame, how: Rebuild) -> DataFrame:
    """Every conversation with the head of its group's first one in place of its own."""
    heads = own.where(F.col("conv_id") % how.group == 0).select(
        F.col("conv_id").alias("_base"), F.slice("turns", 1, how.most - 1).alias("head")
    )
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % how.most).cast("int")
    both = own.join(heads, F.col("conv_id") - F.col("conv_id") % how.group == F.col("_base"), "left")
    head = F.coalesce(F.slice("head", 1, h), F.array().cast("array<struct<d:binary,n:bigint>>"))
    rest = F.slice("turns", h + 1, F.greatest(F.size("turns"), F.lit(1)))
    return both.select("conv_id", F.concat(head, rest).alias("turns"))


def plain(own: DataFrame) -> DataFrame:
    """Conversations as they are, to build their tree without a common head."""
    return own.select("conv_id", "turns")


class _Minima:
    """Sparse table of the minima of all ranges whose length is a power of two."""

    def __init__(self, values: np.ndarray):
        self.levels = [values]
        while 2 << (len(self.levels) - 1) <= len(values):
            half, low = 1 << (len(self.levels) - 1), self.levels[-1]
            self.levels.append(np.minimum(low[:-half], low[half:]))

    def between(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Minimum of ``left..right``, both included."""
        level = np.frexp((right - left + 1).astype(float))[1] - 1
        out = np.empty(len(left), self.levels[0].dtype)
        for k in np.unique(level):
            at = level == k
            out[at] = np.minimum(self.levels[k][left[at]], self.levels[k][right[at] - (1 << k) + 1])
        return out

    def reach_right(self, start: np.ndarray, least: np.ndarray) -> np.ndarray:
        """The last place up to which all values from ``start`` on are at least ``least``, plus one."""
        at = start.copy()
        for k in range(len(self.levels) - 1, -1, -1):
            table = self.levels[k]
            inside = at < len(table)
            step = inside & (table[np.where(inside, at, 0)] >= least)
            at += step << k
        return at

    def reach_left(self, start: np.ndarray, least: np.ndarray) -> np.ndarray:
        """The first place from which all values before ``start`` are at least ``least``."""
        at = start.copy()
        for k in range(len(self.levels) - 1, -1, -1):
            table = self.levels[k]
            low = at - (1 << k)
            step = (low >= 0) & (table[np.maximum(low, 0)] >= least)
            at -= step << k
        return at


def _sums(values: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(values, dtype=np.int64)])


def _paths(digests: Iterable[bytes]) -> list[bytes]:
    """The name of every prefix of a conversation, from the empty one on."""
    out = [b""]
    for d in digests:
        out.append(hashlib.md5(out[-1] + d).digest())
    return out


def _joined(ids: np.ndarray) -> bytes:
    return ",".join(map(str, ids.tolist())).encode()


class Block:
    """Sorted conversations: ids, the digests of all turns (two numbers each) and their sizes."""

    def __init__(self, ids: np.ndarray, lengths: np.ndarray, digests: np.ndarray, chars: np.ndarray):
        self.ids, self.lengths, self.digests, self.chars = ids, lengths, digests, chars
        self.starts = _sums(lengths)

    def common(self) -> np.ndarray:
        """Length of the common prefix of every conversation and the next one."""
        n = len(self.ids)
        out = np.zeros(max(n - 1, 0), np.int64)
        shorter = np.minimum(self.lengths[:-1], self.lengths[1:])
        alive = np.arange(n - 1)
        depth = 0
        while len(alive):
            alive = alive[shorter[alive] > depth]
            here, there = self.starts[alive] + depth, self.starts[alive + 1] + depth
            alive = alive[(self.digests[here] == self.digests[there]).all(axis=1)]
            out[alive] += 1
            depth += 1
        return out

    def nodes(self) -> dict[str, np.ndarray]:
        """Every distinct prefix of the block: depth, members' interval, its parent and measures."""
        n, lengths = len(self.ids), self.lengths
        shared = self.common()
        minima = _Minima(shared) if n > 1 else None
        # Candidates: the empty prefix of the first conversation, and every turn of every one.
        conv = np.concatenate([[0], np.repeat(np.arange(n), lengths)])
        depth = np.concatenate([[0], np.arange(len(self.chars)) - np.repeat(self.starts[:-1], lengths) + 1])
        left = minima.reach_left(conv, depth) if minima else conv.copy()
        right = minima.reach_right(conv, depth) if minima else conv.copy()
        one = left == conv
        depth, left, right = depth[one], left[one], right[one]

        cum = _sums(self.chars)
        total = cum[self.starts[1:]] - cum[self.starts[:-1]]
        before = np.concatenate([[-1], shared])  # common with the conversation before, none for the first
        after = np.concatenate([shared, [-1]])
        upto = self.starts[:-1] + np.maximum(before, 0)
        fresh = total - (cum[upto] - cum[self.starts[:-1]])  # texts first seen at a conversation
        leaf = _sums(after < lengths)
        members = right - left + 1
        head = cum[self.starts[left] + np.maximum(depth - 1, 0)] - cum[self.starts[left]]
        totals, freshes = _sums(total), _sums(fresh)
        every = totals[right + 1] - totals[left] - members * head
        distinct = freshes[right + 1] - freshes[left + 1] + total[left] - head
        lowest = _Minima(self.ids).between(left, right)

        # A node's place by (first conversation, depth); its parent's first conversation may lie before.
        parent_left = minima.reach_left(left, depth - 1) if minima else left.copy()
        inner = depth > 0
        key = (left.astype(np.int64) << 32) + depth
        order = np.argsort(key)
        wanted = (parent_left.astype(np.int64) << 32) + depth - 1
        parent = np.full(len(depth), -1)
        parent[inner] = order[np.searchsorted(key[order], wanted[inner])]
        children = np.bincount(parent[inner], minlength=len(depth))
        # Conversations that end at a node stand first in its interval.
        ends = np.zeros(len(depth), np.int64)
        own_left = minima.reach_left(np.arange(n), lengths) if minima else np.arange(n)
        at = order[np.searchsorted(key[order], (own_left.astype(np.int64) << 32) + lengths)]
        np.add.at(ends, at, 1)
        return {
            "depth": depth, "left": left, "right": right, "parent": parent, "conv_id": lowest, "n_convs": members,
            "n_children": children, "n_leaves": leaf[right + 1] - leaf[left], "saved_tokens": every - distinct, "ends": ends,
        }


def _read(batches: Iterable[pa.RecordBatch]) -> Block | None:
    ids, lengths, digests, chars = [], [], [], []
    for batch in batches:
        if not batch.num_rows:
            continue
        ids.append(batch.column("conv_id").to_numpy(zero_copy_only=False))
        listed = batch.column("d")
        lengths.append(np.diff(listed.offsets.to_numpy()).astype(np.int64))
        flat = listed.flatten()
        digests.append(np.frombuffer(b"".join(flat.to_pylist()), np.uint64).reshape(-1, 2))
        chars.append(batch.column("n").flatten().to_numpy(zero_copy_only=False))
    if not ids:
        return None
    return Block(*(np.concatenate(parts) for parts in (ids, lengths, digests, chars)))


def _block(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    block = _read(batches)
    if block is None:
        return
    nodes = block.nodes()
    size, last = len(nodes["depth"]), len(block.ids) - 1

    def turns(conv: int) -> list[bytes]:
        return [row.tobytes() for row in block.digests[block.starts[conv] : block.starts[conv + 1]]]

    edge = (nodes["left"] == 0) | (nodes["right"] == last)
    paths: dict[int, bytes] = {}
    for conv in (0, last):
        own = _paths(turns(conv))
        held = np.flatnonzero((nodes["left"] <= conv) & (nodes["right"] >= conv))
        paths.update((int(at), own[nodes["depth"][at]]) for at in held)

    ends, pieces = [NOTHING] * size, []
    for at in np.flatnonzero(nodes["ends"]).tolist():
        first = int(nodes["left"][at])
        joined = _joined(block.ids[first : first + int(nodes["ends"][at])])
        if edge[at]:
            pieces.append((at, joined, int(block.ids[first])))
        else:
            ends[at] = hashlib.sha256(joined).hexdigest()

    def given(kind: list[int] | np.ndarray, **columns) -> pa.RecordBatch:
        arrays = [pa.array(kind, pa.int32())]
        arrays += [pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(len(kind), f.type) for f in list(GIVEN)[1:]]
        return pa.RecordBatch.from_arrays(arrays, schema=GIVEN)

    step = 50_000
    for low in range(0, size, step):
        span = slice(low, min(low + step, size))
        parent = nodes["parent"][span]
        known = (parent >= 0) & ~edge[parent]
        yield given(
            np.where(edge[span], PART, NODE), depth=nodes["depth"][span], conv_id=nodes["conv_id"][span],
            parent_conv_id=pa.array(nodes["conv_id"][parent], pa.int64(), mask=~known),
            **{name: nodes[name][span] for name in MEASURES},
            ends_sha256=[None if e else h for e, h in zip(edge[span], ends[span])],
            path=[paths.get(at) for at in range(span.start, span.stop)],
            parent_path=[paths.get(int(p)) if p >= 0 and edge[p] else None for p in parent],
        )
    for at, joined, first_id in pieces:
        yield given([PIECE], depth=[int(nodes["depth"][at])], path=[paths[at]], piece=[joined], first_id=[first_id])
    yield given(
        [ENDS], first=[turns(0)], first_id=[int(block.ids[0])], last=[turns(last)],
        last_chars=[block.chars[block.starts[last] :].tolist()],
    )


CORRECTED = pa.schema([("depth", pa.int64()), ("path", pa.binary()), *[(name, pa.int64()) for name in MEASURES]])
CORRECTED_DDL = "depth long, path binary, " + ", ".join(f"{name} long" for name in MEASURES)


def _corrections(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per pair of neighbouring blocks: what both counted, by depth of their common prefix."""
    for batch in batches:
        for row in batch.to_pylist():
            last, chars, first = row["last"], row["last_chars"], row["first"]
            shared = 0
            while shared < min(len(last), len(first)) and last[shared] == first[shared]:
                shared += 1
            cum = np.concatenate([[0], np.cumsum(chars, dtype=np.int64)])
            depths = list(range(shared + 1))
            columns = {
                "depth": depths, "path": _paths(last[:shared]), "n_convs": [0] * len(depths),
                "n_children": [-1 if d < shared else 0 for d in depths],
                "n_leaves": [-1 if shared == len(last) else 0] * len(depths),
                "saved_tokens": [int(cum[shared] - cum[max(d, 1) - 1]) if shared else 0 for d in depths],
            }
            yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in CORRECTED], schema=CORRECTED)


def _hashed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hash of every node's pieces, which come in order; one is held at a time."""
    node, state = None, None

    def told() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"path": [node[1]], "depth": [node[0]], "ends_sha256": [state.hexdigest()]})

    for batch in batches:
        for depth, path, piece in zip(*(batch.column(c).to_pylist() for c in ("depth", "path", "piece"))):
            if node != (depth, path):
                if node is not None:
                    yield told()
                node, state = (depth, path), hashlib.sha256(piece)
            else:
                state.update(b"," + piece)
    if node is not None:
        yield told()


def tree(conversations: DataFrame) -> DataFrame:
    """All nodes of the prefix tree of ``conv_id, turns`` (see ``sequences``)."""
    apart = conversations.select("conv_id", F.col("turns.d").alias("d"), F.col("turns.n").alias("n"))
    apart = written(apart, "prefix-conversations")
    order = ["d", "conv_id"]
    blocks = apart.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_block, GIVEN_DDL)
    blocks = written(blocks, "prefix-blocks")

    # Two conversations per block, in the order of the blocks.
    around = Window.orderBy("first", "first_id")
    fields = ["first", "first_id", "last", "last_chars"]
    pairs = blocks.where(F.col("kind") == ENDS).select(*fields).select(
        "last", "last_chars", F.lead("first").over(around).alias("first")
    )
    pairs = pairs.where("first is not null").mapInArrow(_corrections, CORRECTED_DDL)
    parts = blocks.where(F.col("kind") == PART)
    added = parts.select("depth", "path", "conv_id", *MEASURES).unionByName(pairs, allowMissingColumns=True)
    added = added.groupBy("depth", "path").agg(F.min("conv_id").alias("conv_id"), *[F.sum(m).alias(m) for m in MEASURES])

    pieces = blocks.where(F.col("kind") == PIECE).select("depth", "path", "first_id", "piece")
    pieces = pieces.repartition("depth", "path").sortWithinPartitions("depth", "path", "first_id")
    hashed = pieces.mapInArrow(_hashed, "path binary, depth long, ends_sha256 string")
    parents = parts.where("depth > 0").select("depth", "path", "parent_path").distinct()
    shared = added.join(hashed, ["depth", "path"], "left").join(parents, ["depth", "path"], "left")
    shared = written(shared.withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NOTHING))), "prefix-shared")

    # Only rows whose parent is shared between blocks need to look it up; the others stay out of the join.
    inner = blocks.where(F.col("kind") == NODE).select(*RESULT, "parent_path")
    open_ = inner.where("parent_path is not null").unionByName(
        shared.select(*[c for c in RESULT if c != "parent_conv_id"], "parent_path"), allowMissingColumns=True
    )
    named = shared.select(
        (F.col("depth") + 1).alias("_depth"), F.col("path").alias("_path"), F.col("conv_id").alias("_parent")
    )
    told = open_.join(named, (F.col("depth") == F.col("_depth")) & (F.col("parent_path") == F.col("_path")), "left")
    told = told.withColumn("parent_conv_id", F.col("_parent")).select(*RESULT)
    return inner.where("parent_path is null").select(*RESULT).unionByName(told)


def query(turns: DataFrame) -> DataFrame:
    return tree(rebuilt(sequences(turns), Rebuild()))


ORACLE = r"""
WITH polynomial AS (
  SELECT list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0],
    lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crc_table
), plain AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
), own AS (
  SELECT conv_id, role, text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(length(role)::VARCHAR || ':' || role || text)) AS place
  FROM plain
), heads AS (
  SELECT conv_id, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(length(bytes) // 2),
      lambda i: ('0x' || substr(bytes, (2 * i + 1)::INT, 2))::BIGINT)),
    lambda c, b: xor(c >> 8, crc_table[(xor(c, b) & 255) + 1])), 4294967295) % 6 AS h
  FROM (SELECT DISTINCT conv_id, hex(encode(conv_id::VARCHAR)) AS bytes FROM plain), polynomial
), rebuilt AS (
  SELECT h.conv_id, o.place, o.role, o.text FROM heads h JOIN own o ON o.conv_id = h.conv_id - h.conv_id % 100 AND o.place <= h.h
  UNION ALL
  SELECT h.conv_id, o.place + 1000000, o.role, o.text FROM heads h JOIN own o ON o.conv_id = h.conv_id AND o.place > h.h
), numbered AS (
  SELECT conv_id, text, row_number() OVER turns AS depth,
    md5(string_agg(md5(length(role)::VARCHAR || ':' || role || text), '') OVER turns) AS path
  FROM rebuilt WINDOW turns AS (PARTITION BY conv_id ORDER BY place ROWS UNBOUNDED PRECEDING)
), prefixes AS (
  SELECT conv_id, depth, path, lag(path, 1, '') OVER (PARTITION BY conv_id ORDER BY depth) AS parent, length(text) AS chars,
    depth = max(depth) OVER (PARTITION BY conv_id) AS ends
  FROM numbered
  UNION ALL
  SELECT conv_id, 0, '', NULL, 0, conv_id NOT IN (SELECT conv_id FROM numbered) FROM heads
), nodes AS (
  SELECT depth, path, any_value(parent) AS parent, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(chars) AS chars,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
  FROM prefixes GROUP BY depth, path
), families AS (
  SELECT depth - 1 AS depth, parent AS path, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY depth, parent
), above AS (
  -- every node below every prefix of its smallest member
  SELECT p.depth, p.path, n.depth AS under, n.path AS below, n.n_convs, n.chars
  FROM nodes n JOIN prefixes p ON p.conv_id = n.conv_id AND p.depth <= n.depth
), subtrees AS (
  SELECT a.depth, a.path, count(*) FILTER (f.n_children IS NULL) AS n_leaves, sum((a.n_convs - 1) * a.chars) AS saved_tokens
  FROM above a LEFT JOIN families f ON f.depth = a.under AND f.path = a.below GROUP BY a.depth, a.path
)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(f.n_children, 0) AS n_children, s.n_leaves,
  s.saved_tokens::BIGINT AS saved_tokens, n.ends_sha256
FROM nodes n JOIN subtrees s ON s.depth = n.depth AND s.path = n.path LEFT JOIN families f ON f.depth = n.depth AND f.path = n.path
LEFT JOIN nodes p ON p.depth = n.depth - 1 AND p.path = n.parent
"""
