"""Uploads in pieces: assembled first, then parsed."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tillsight.sources import chunked


def assembled(pieces):
    """Piece texts as one text: later headers dropped, pieces end with a line end."""
    whole = pieces[0]
    for piece in pieces[1:]:
        at = piece.find("\n")
        if at >= 0:
            whole += ("" if whole.endswith("\n") else "\n") + piece[at + 1 :]
    return whole


def parsed(whole):
    """The rows of a CSV text, character by character."""
    rows, row, value, inside, at = [], [], "", False, 0
    while at < len(whole):
        c = whole[at]
        if inside:
            if c == '"' and whole[at + 1 : at + 2] == '"':
                value, at = value + c, at + 1
            elif c == '"':
                inside = False
            else:
                value += c
        elif c == '"':
            inside = True
        elif c in ",\r\n":
            row, value = [*row, value], ""
            if c != ",":
                at += whole[at : at + 2] == "\r\n"
                rows, row = [*rows, row], []
        else:
            value += c
        at += 1
    if value or row:
        rows.append([*row, value])
    return [r for r in rows if r != [""]]


def read(spark, uploads, names):
    rows = [(u, 3 * n + 1, p) for u, pieces in uploads.items() for n, p in enumerate(pieces)]
    pieces = spark.createDataFrame(rows, "upload_id string, chunk_index int, csv_text string")
    got = chunked.read_pieces(pieces, {n: (n,) for n in names}).orderBy("upload_id", "place", "line_no").collect()
    return {u: [[r[n] for n in names] for r in got if r.upload_id == u] for u in uploads}


def padded(rows, width):
    return [(r + [""] * width)[:width] for r in rows]


def test_a_value_over_a_border(spark):
    pieces = ['id,name,phone\n1,Ann,5511111111\n2,"Bob', 'id,name,phone\n Jr",5512345679\n3,C,\n']
    assert read(spark, {"u": pieces}, ["id", "name", "phone"]) == {
        "u": [["1", "Ann", "5511111111"], ["2", "Bob\n Jr", "5512345679"], ["3", "C", ""]]
    }


def test_random_texts_cut_anywhere(spark):
    draw = random.Random(11)
    alphabet = ['"', '""', ",", "\n", "\r\n", "\r", "x", "é🙂", ' "q" ', "\n\n", '","', '"\n']
    uploads = {}
    for n in range(150):
        body = "".join(draw.choices(alphabet, k=draw.randrange(1, 120)))
        cuts = sorted(draw.randrange(len(body) + 1) for _ in range(draw.randrange(0, 7)))
        parts = [body[a:b] for a, b in zip([0, *cuts], [*cuts, len(body)])]
        uploads[f"u{n:03d}"] = ["a,b,c\n" + parts[0], *[draw.choice(["a,b,c\n", "x\n", ""]) + p for p in parts[1:]]]
    got = read(spark, uploads, ["a", "b", "c"])
    for name, pieces in uploads.items():
        assert got[name] == padded(parsed(assembled(pieces))[1:], 3), pieces


def test_a_value_over_a_hundred_pieces(spark):
    long = ["id,name\n" + '7,"start'] + [f"id,name\npart {n}, with comma" for n in range(100)] + ['id,name\nend"\n8,z']
    got = read(spark, {"u": long, "v": ["id,name\n1,2"]}, ["id", "name"])
    assert got["v"] == [["1", "2"]]
    assert got["u"] == [["7", "start\n" + "".join(f"part {n}, with comma\n" for n in range(100)) + "end"], ["8", "z"]]


@pytest.mark.parametrize("pieces", [[""], [None], ["a,b"], ["a,b\n\n", "a,b\n\n"], ["\n\na,b\n"]])
def test_nothing_but_headers(spark, pieces):
    assert read(spark, {"u": pieces}, ["a", "b"]) == {"u": []}


def test_files(spark, tmp_path):
    for index, body in enumerate(['﻿ContactID,FirstName\n1,"A', 'ContactID,FirstName\nB"\n2,C']):
        path = tmp_path / "u1" / f"{index}.csv"
        path.parent.mkdir(exist_ok=True)
        path.write_text(body, encoding="utf-8")
    rows = chunked.read_contact_pieces(chunked.piece_files(spark, str(tmp_path / "u1")))
    assert [(r.contact_id, r.first_name, r.upload_id) for r in rows.orderBy("chunk_place", "line_no").collect()] == [
        ("1", "A\nB", "u1"), ("2", "C", "u1"),
    ]


def test_texts_are_not_windowed(spark):
    """Only the numbers of a piece run through the window."""
    pieces = spark.createDataFrame([("u", 0, "a\n1")], "upload_id string, chunk_index int, csv_text string")
    states = chunked.piece_states(pieces)
    plan = states._jdf.queryExecution().optimizedPlan().toString()
    assert "csv_text" not in plan.split("Window")[1].split("Project")[0]
    assert states.select(F.col("inside")).first().inside == 0
