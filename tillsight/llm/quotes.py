"""Quotation linking: reply-ordered conversations without their quotes.

A line's quote level is the number of ``>`` it starts with, spaces between them
ignored. Lines of level 0 are the message's own text; a line that announces a quote
("On ... wrote:") right above quoted lines goes with them. Quoted lines of one level
that follow each other form a passage. Passages, and their lines, are hashed in a
normal form (lower case, only letters and digits, single spaces); so are every
message's own text and its lines. Forms under ``min_chars`` are too common to link
conversations; inside a conversation forms of every length link.

A quoted form links to the message it is the own text (or a line) of: to the earliest
one of the same conversation before the quoting message, or else to the earliest one
of all conversations. Only one message per form, and per form and conversation,
takes part in the joins, found by combining aggregations, so a passage that a third
of the messages quote or contain meets one row. The parent of a message is the
original of its level-1 quotes with the most quoted characters; of equal ones, one of
its own conversation, then the latest. Its ancestor is the same for the lowest level of
which an original is found: the parent, or without one what deeper quotes lead to.

Threads are the trees of parents; a message's root and depth are found by pointer
doubling, which ends after about the logarithm of the longest chain of replies.
Sorting a thread by ``root_conv, root_turn, depth, conv_id, turn`` puts replies after
what they answer; ``reply_order`` is that key's part inside a root. ``thread_conv,
thread_turn, thread_depth`` are root and depth in the trees of ancestors, which also
hold messages whose direct original is missing.

Defined results: a missing text has no quotes and stays missing; a text of nothing
but quotes becomes empty; messages without conv_id or turn are kept and never linked;
repeated rows of one (conv_id, turn) are one message, each row keeps its own text.
A very long message is parsed in a slice of its own; an empty table gives an empty one.
Parents never form a ring: they are earlier messages of the same conversation, messages of
one with a smaller conv_id, or of one with a larger conv_id that itself quotes no other
conversation. Extra
columns pass through; result columns replace columns of their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import prepared, slices, written

SLICE = 4 << 20
MARKS = re.compile(r"[ \t]*((?:>[ \t]?)+)(.*)", re.S)
ANNOUNCES = re.compile(r".{0,200}\b(?:wrote|writes|schrieb|escribió|a écrit)[ \t]*:[ \t]*$")
SIGNS = re.compile(r"[\W_]+")
RESULT = (
    "own_text", "parent_conv", "parent_turn", "root_conv", "root_turn", "depth", "reply_order",
    "ancestor_conv", "ancestor_turn", "thread_conv", "thread_turn", "thread_depth",
)
FOUND = "forms array<struct<hash:long,chars:int>>, quotes array<struct<hash:long,chars:int,level:int>>"


@dataclass(frozen=True)
class Linking:
    min_chars: int = 20


def parsed(text: str) -> tuple[str, list[tuple[int, list[str]]]]:
    """The own text, and the quoted passages as (level, lines)."""
    own: list[str] = []
    passages: list[tuple[int, list[str]]] = []
    last = 0
    for line in text.split("\n"):
        quoted = MARKS.fullmatch(line.rstrip("\r"))
        level = quoted[1].count(">") if quoted else 0
        if not level:
            own.append(line)
        else:
            if not last and own and ANNOUNCES.fullmatch(own[-1].rstrip("\r")):
                own.pop()
            if level != last:
                passages.append((level, []))
            passages[-1][1].append(quoted[2])
        last = level
    return ("\n".join(own).strip("\n") if passages else text), passages


def normal(text: str) -> str:
    return SIGNS.sub(" ", text.lower()).strip()


def _forms(lines: list[str], least: int) -> dict[int, int]:
    """Hashes of the whole and of the lines, with their lengths."""
    forms = {}
    for text in (" ".join(lines), *lines):
        form = normal(text)
        if len(form) >= least:
            forms[xxhash.xxh3_64_intdigest(form.encode()) - (1 << 63)] = len(form)
    return forms


def read(messages: DataFrame) -> DataFrame:
    """``messages`` with own text, its forms and the quoted forms."""
    kept = messages.select(*[f"`{c}`" for c in messages.columns if c.lower() not in (*RESULT, "forms", "quotes")])
    place = [c.lower() for c in kept.columns].index("text")
    name = kept.columns[place]
    schema = T.StructType([*kept.schema.fields, *T.StructType.fromDDL(f"own_text string, {FOUND}").fields])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        form = pa.struct([("hash", pa.int64()), ("chars", pa.int32())])
        quote = pa.struct([("hash", pa.int64()), ("chars", pa.int32()), ("level", pa.int32())])
        for batch in slices(batches, name, SLICE):
            owns, forms, quotes = [], [], []
            for text in batch.column(place).to_pylist():
                own, passages = parsed(text) if text is not None else (None, [])
                owns.append(own)
                mine = _forms((own or "").split("\n"), 1)
                forms.append([{"hash": h, "chars": n} for h, n in mine.items()])
                told: dict[tuple[int, int], int] = {}
                for level, lines in passages:
                    told.update({(h, level): n for h, n in _forms(lines, 1).items()})
                quotes.append([{"hash": h, "chars": n, "level": level} for (h, level), n in told.items()])
            columns = [pa.array(owns, pa.string()), pa.array(forms, pa.list_(form)), pa.array(quotes, pa.list_(quote))]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *columns], names=[*batch.schema.names, "own_text", "forms", "quotes"]
            )

    return kept.mapInArrow(run, schema)


def parents(told: DataFrame, linking: Linking) -> DataFrame:
    """One row per message that quotes an earlier one: ``conv, turn``, its parent and its ancestor."""
    known = told.where("conv_id is not null and turn is not null")
    names = (F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"))
    quoted = known.select(*names, F.explode("quotes").alias("q")).select("conv", "turn", "q.hash", "q.chars", "q.level")
    quoted = written(quoted.distinct(), "quoted")
    asked = quoted.select("hash").distinct()
    forms = known.select(*names, F.explode("forms").alias("f")).select("conv", "turn", "f.hash", "f.chars")
    forms = forms.join(asked, "hash", "left_semi")
    near = forms.groupBy("hash", "conv").agg(F.min("turn").alias("first"), F.max("chars").alias("size"))
    near = written(near, "quoted-forms")
    common = F.col("size") < linking.min_chars
    far = near.where(~common).groupBy("hash").agg(F.min(F.struct("conv", "first")).alias("one"))
    far = written(far, "quoted-firsts")
    near = near.drop("size")
    same = quoted.join(near, ["hash", "conv"], "left").where("first is null or first < turn")
    missed = quoted.join(near, ["hash", "conv"], "left").where("first >= turn").drop("first")
    inside = same.where("first is not null").withColumn("to", F.col("conv"))
    outside = same.where("first is null").drop("first").unionByName(missed).where(F.col("chars") >= linking.min_chars).join(far, "hash")
    outside = outside.select("hash", "conv", "turn", "chars", "level", F.col("one.first").alias("first"), F.col("one.conv").alias("to"))
    outside = written(outside.where("to <> conv"), "quoted-outside")
    # Links to smaller conversations, or back inside one, form no ring. One to a larger conversation is
    # safe if that one has no links to others: every path from there ends inside it.
    busy = outside.select(F.col("conv").alias("to")).distinct()
    outside = outside.where("to < conv").unionByName(outside.where("to > conv").join(busy, "to", "left_anti").select(*outside.columns))
    weighed = inside.unionByName(outside).groupBy("conv", "turn", "level", "to", "first").agg(F.sum("chars").alias("chars"))
    order = F.struct((-F.col("level")).alias("near"), "chars", (F.col("to") == F.col("conv")).alias("own"), "to", "first")
    best = weighed.groupBy("conv", "turn").agg(F.max(order).alias("best"))
    direct = F.col("best.near") == -1
    return best.select(
        "conv", "turn", F.when(direct, F.col("best.to")).alias("parent_conv"), F.when(direct, F.col("best.first")).alias("parent_turn"),
        F.col("best.to").alias("ancestor_conv"), F.col("best.first").alias("ancestor_turn"),
    )


def rooted(links: DataFrame) -> DataFrame:
    """``links`` with roots and depths in the trees of parents and of ancestors, by pointer doubling."""
    links = written(links, "parents")
    steps = F.lit(1).cast("long").alias("steps")
    ups = [
        links.where(f"{kind}_conv is not null").select(
            F.lit(kind).alias("kind"), "conv", "turn", F.col(f"{kind}_conv").alias("up_conv"), F.col(f"{kind}_turn").alias("up_turn"), steps
        )
        for kind in ("parent", "ancestor")
    ]
    chain = written(ups[0].unionByName(ups[1]), "chain")
    while True:
        up = chain.select(
            "kind", F.col("conv").alias("up_conv"), F.col("turn").alias("up_turn"), F.col("up_conv").alias("next_conv"),
            F.col("up_turn").alias("next_turn"), F.col("steps").alias("more"),
        )
        joined = chain.join(up, ["kind", "up_conv", "up_turn"], "left")
        moved = written(
            joined.select(
                "kind", "conv", "turn", F.coalesce("next_conv", "up_conv").alias("up_conv"), F.coalesce("next_turn", "up_turn").alias("up_turn"),
                (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"), F.col("more").isNotNull().alias("moved"),
            ),
            "chain",
        )
        chain = moved.drop("moved")
        if moved.where("moved").isEmpty():
            break

    def ends(kind: str, conv: str, turn: str, depth: str) -> DataFrame:
        rows = chain.where(F.col("kind") == kind)
        return rows.select("conv", "turn", F.col("up_conv").alias(conv), F.col("up_turn").alias(turn), F.col("steps").alias(depth))

    found = links.join(ends("parent", "root_conv", "root_turn", "depth"), ["conv", "turn"], "left")
    return found.join(ends("ancestor", "thread_conv", "thread_turn", "thread_depth"), ["conv", "turn"], "left")


def linked(messages: DataFrame, linking: Linking = Linking()) -> DataFrame:
    """``messages`` with their own text, parent, root, depth and reply order."""
    prepared(messages.sparkSession)
    told = written(read(messages), "messages")
    found = written(rooted(parents(told, linking)), "threads")
    at = (told["conv_id"].cast("long") == found["conv"]) & (told["turn"].cast("long") == found["turn"])
    kept = [told[f"`{c}`"] for c in told.columns if c not in ("forms", "quotes", "own_text")]
    joined = told.join(found, at, "left")
    here = told["conv_id"].cast("long"), told["turn"].cast("long")
    depth = F.coalesce(found["depth"], F.lit(0))
    return joined.select(
        *kept, told["own_text"], found["parent_conv"], found["parent_turn"],
        F.coalesce(found["root_conv"], here[0]).alias("root_conv"), F.coalesce(found["root_turn"], here[1]).alias("root_turn"),
        depth.alias("depth"), F.struct(depth.alias("depth"), here[0].alias("conv"), here[1].alias("turn")).alias("reply_order"),
        found["ancestor_conv"], found["ancestor_turn"],
        F.coalesce(found["thread_conv"], here[0]).alias("thread_conv"), F.coalesce(found["thread_turn"], here[1]).alias("thread_turn"),
        F.coalesce(found["thread_depth"], F.lit(0)).alias("thread_depth"),
    )


def query(messages: DataFrame) -> DataFrame:
    told = linked(messages)
    return told.select("conv_id", "turn", "role", *[c for c in RESULT if c != "reply_order"])
