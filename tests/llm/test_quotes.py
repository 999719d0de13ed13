"""Quotation linking against brute force, and edge cases."""

from __future__ import annotations

import random

from tillsight.llm import quotes

SCHEMA = "conv_id long, turn long, role string, text string, depth string, hash int"


def run(spark, rows):
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA)
    out = quotes.linked(df)
    assert out.columns == ["conv_id", "turn", "role", "text", "hash", *quotes.RESULT]
    return out


def brute(rows):
    own, asked = {}, {}
    for conv, turn, _, text in rows:
        if conv is None or turn is None or text is None:
            continue
        mine, passages = quotes.parsed(text)
        own.setdefault((conv, turn), set()).update(quotes._forms(mine.split("\n"), 20))
        for level, lines in passages:
            if level == 1:
                asked.setdefault((conv, turn), {}).update(quotes._forms(lines, 20))
    # Conversations that quote others, at any level.
    busy = set()
    for conv, turn, _, text in rows:
        if conv is None or turn is None or text is None:
            continue
        for _, lines in quotes.parsed(text)[1]:
            for h in quotes._forms(lines, 20):
                holders = [k for k in own if h in own[k]]
                if not any(k[0] == conv and k[1] < turn for k in holders) and holders and min(holders)[0] != conv:
                    busy.add(conv)
    up = {}
    for at, forms in asked.items():
        weight = {}
        for h, n in forms.items():
            same = [k for k in own if h in own[k] and k[0] == at[0]]
            first = min(same) if same and min(same) < at else None
            if first is None:
                every = [k for k in own if h in own[k]]
                first = min(every) if every and (min(every)[0] < at[0] or min(every)[0] > at[0] and min(every)[0] not in busy) else None
            if first is not None:
                weight[first] = weight.get(first, 0) + n
        if weight:
            up[at] = max(weight, key=lambda k: (weight[k], k[0] == at[0], k))
    return up


def thread(up, at):
    depth = 0
    while at in up:
        at, depth = up[at], depth + 1
    return at, depth


def test_equals_brute_force(spark):
    dice = random.Random(6)
    rows = []
    for conv in range(25):
        texts = []
        for turn in range(dice.randint(1, 12)):
            lines = [f"Message {dice.randrange(60)} says something of its own here." for _ in range(dice.randint(1, 3))]
            parts = ["\n".join(lines)]
            for _ in range(dice.randint(0, 2)):
                source = dice.choice(texts) if texts and dice.random() < 0.8 else "\n".join(lines[:1])
                quoted = [f"{dice.choice(['>', '> ', '>> ', '> > '])}{x}" for x in source.split("\n")]
                parts.insert(0, "On Monday somebody wrote:\n" + "\n".join(quoted))
            texts.append("\n".join(lines))
            rows.append((conv, turn, "user", "\n".join(parts)))
    up = brute(rows)
    got = run(spark, rows).collect()
    assert len(got) == len(rows) and len(up) > 50
    for r in got:
        at = (r.conv_id, r.turn)
        parent = up.get(at, (None, None))
        root, depth = thread(up, at)
        assert (r.parent_conv, r.parent_turn) == parent and ((r.root_conv, r.root_turn), r.depth) == (root, depth)
        assert ">" not in r.own_text and "wrote:" not in r.own_text


def test_long_chain_and_levels(spark):
    rows = [(1, 0, "user", "The very first message of a long chain.")]
    for turn in range(1, 40):
        before = rows[-1][3].split("\n")
        rows.append((1, turn, "user", "\n".join([*(f"> {x}" for x in before), f"Answer number {turn} to what stands above."])))
    got = {r.turn: r for r in run(spark, rows).collect()}
    for turn in range(1, 40):
        assert (got[turn].parent_turn, got[turn].root_turn, got[turn].depth) == (turn - 1, 0, turn)
        assert got[turn].own_text == f"Answer number {turn} to what stands above."


def test_edge_cases(spark):
    long = "\n".join(f"line {i} of a very long message" for i in range(20_000))
    text = "Something that is long enough to link."
    rows = [
        (1, 0, "user", None), (1, 1, "user", ""), (1, 2, "user", "> "), (2, 0, "user", long), (2, 1, None, "> " + long.replace("\n", "\n> ")),
        (None, 0, "user", text), (3, None, "user", "> " + text), (4, 0, "user", text), (4, 1, "user", "> " + text), (4, 1, "user", "> " + text),
        (5, 0, "user", "> " + text + "\nyes"), (0, 0, "user", "> " + text + "\nno"), (6, 0, "user", "> " + text + "\n" + text),
    ]
    got = run(spark, rows).collect()
    assert len(got) == len(rows)
    by = {(r.conv_id, r.turn): r for r in got}
    assert by[1, 0].own_text is None and by[1, 1].own_text == "" and by[1, 2].own_text == ""
    assert by[2, 1].parent_turn == 0 and by[2, 1].own_text == ""
    assert by[3, None].parent_conv is None and by[None, 0].parent_conv is None
    assert (by[4, 1].parent_conv, by[4, 1].parent_turn) == (4, 0)
    assert (by[5, 0].parent_conv, by[5, 0].own_text) == (4, "yes")
    assert by[0, 0].parent_conv == 4 and by[6, 0].parent_conv == 4
    assert run(spark, []).count() == 0


def test_given_conversations(spark, folder):
    table = spark.read.parquet(f"{folder}/conversations.parquet")
    got = quotes.query(table).collect()
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in table.collect()]
    up = brute(rows)
    assert sorted((r.conv_id, r.turn) for r in got if r.parent_conv is not None) == sorted(up)
    assert sorted(r.own_text for r in got) == sorted(quotes.parsed(r[3])[0] for r in rows)


def test_deeper_quotes_lead_to_an_ancestor(spark):
    first, second = "The first message says a thing.", "The second message answers that thing."
    rows = [
        (1, 0, "user", first), (1, 1, "user", f"> {first}\n{second}"), (1, 2, "user", f">> {first}\nOnly the deeper one is quoted here."),
        (1, 3, "user", f"> {second} (changed)\n>> {first}\nThe direct original was changed before."),
        (1, 4, "user", f"> {second}\n>> {first}\n>>> {first}\nBoth originals are there to be found."),
        (1, 5, "user", "> The direct original was changed before.\nThis one answers the changed quote."),
        (2, 0, "user", f">>> {first}\nFrom another conversation, three levels down."),
    ]
    got = {(r.conv_id, r.turn): r for r in run(spark, rows).collect()}
    up = {at: (r.ancestor_conv, r.ancestor_turn) for at, r in got.items()}
    assert up == {
        (1, 0): (None, None), (1, 1): (1, 0), (1, 2): (1, 0), (1, 3): (1, 0), (1, 4): (1, 1), (1, 5): (1, 3), (2, 0): (1, 0),
    }
    assert all((r.thread_conv, r.thread_turn) == (1, 0) for r in got.values())
    assert [got[at].thread_depth for at in sorted(got)] == [0, 1, 1, 1, 2, 2, 1]
    assert (got[1, 4].parent_turn, got[1, 5].parent_turn, got[1, 2].parent_turn) == (1, 3, None)


def test_short_quotes_link_inside_a_conversation(spark):
    rows = [
        (1, 0, "user", "Can it be done by Friday?"), (1, 1, "user", "Yes, that works."), (1, 2, "user", "> Yes, that works.\nFine."),
        (1, 3, "user", "> Fine.\n> \n> ???\nok"), (2, 0, "user", "> Yes, that works.\nNot from here."), (2, 1, "user", "> ok\nno"),
    ]
    got = {(r.conv_id, r.turn): (r.parent_conv, r.parent_turn) for r in run(spark, rows).collect()}
    none = (None, None)
    assert got == {(1, 0): none, (1, 1): none, (1, 2): (1, 1), (1, 3): (1, 2), (2, 0): none, (2, 1): none}


def test_links_to_larger_conversations_form_no_ring(spark):
    one, two, three = (f"The {n} message says something of its own." for n in ("first", "second", "third"))
    rows = [
        (3, 0, "user", f"> {one}\nAn answer to a larger conversation."), (9, 0, "user", one), (9, 1, "user", f"> {one}\nInside."),
        # These two quote each other: only the link to the smaller one stays.
        (20, 0, "user", two), (20, 1, "user", f"> {three}\nyes"), (21, 0, "user", three), (21, 1, "user", f"> {two}\nno"),
    ]
    got = {(r.conv_id, r.turn): (r.parent_conv, r.parent_turn) for r in run(spark, rows).collect()}
    none = (None, None)
    assert got == {(3, 0): (9, 0), (9, 0): none, (9, 1): (9, 0), (20, 0): none, (20, 1): none, (21, 0): none, (21, 1): (20, 0)}
