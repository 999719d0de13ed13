"""CSV uploads in pieces: texts are joined in order before they are parsed.

A piece may end anywhere a line ends, also inside a quoted value. Whether a piece starts
inside quotes follows from the number of quotes before it, so the pieces of an upload
are looked at one by one: each gives its count of quotes and whether it has a line end
outside of them, under either state at its start. These few numbers, one row per piece,
run through a window in piece order; every piece is then split at its true line ends,
and only the records that go over a border, at most one per border, are put together.

Quotes follow the uploader's rule: a quote opens a quoted section wherever it stands, and
two quotes inside one are a quote. A quote that never closes takes the rest of its upload
into one value. Records without any value are skipped, short ones are padded with empty
values, the first record of an upload is its header. NUL characters are removed.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text
from .csvfiles import CONTACT_HEADERS, header_key

#: Marks put into texts; values cannot hold them, since NUL is removed first.
RECORD_END, FIELD_END = "\0r", "\0f"
LINE_END = r"\r\n|\r|\n"
PIECE = ("upload_id", "chunk_index")


def _plain(piece: Column) -> Column:
    return F.regexp_replace(F.coalesce(piece, F.lit("")), "\0", "")


def _rest(piece: Column) -> Column:
    """A later piece without the header line that it repeats; nothing if it has no line end."""
    at = F.instr(piece, "\n")
    return F.when(at > 0, F.substring(piece, at + 1, F.length(piece))).otherwise(F.lit(""))


def _looked_at(body: Column, adds: Column) -> Column:
    """Quotes of a body, whether a line ends outside quotes for either state at its start, and whether it adds anything."""
    sections = F.split(body, '"', -1)

    def ends(inside: int) -> Column:
        return F.size(F.filter(sections, lambda s, at: ((at + inside) % 2 == 0) & s.rlike("[\r\n]"))) > 0

    return F.struct((F.size(sections) - 1).alias("quotes"), ends(0).alias("ends_0"), ends(1).alias("ends_1"), adds.alias("adds"))


def piece_states(pieces: DataFrame) -> DataFrame:
    """Per piece: its place, whether it starts inside quotes, and the piece that opened the record.

    The window runs over four small values per piece, not over texts.
    """
    body = _plain(F.col("csv_text"))
    looked = pieces.select(
        *PIECE, _looked_at(body, F.lit(True)).alias("first"),
        _looked_at(_rest(body), F.instr(body, "\n") > 0).alias("later"),
    )
    order = Window.partitionBy("upload_id").orderBy("chunk_index")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    looked = looked.withColumn("place", F.row_number().over(order))
    looked = looked.select(*PIECE, "place", F.when(F.col("place") == 1, F.col("first")).otherwise(F.col("later")).alias("it"))
    inside = F.coalesce(F.sum("it.quotes").over(before), F.lit(0)) % 2
    looked = looked.withColumn("inside", inside.cast("int"))
    line_ends = F.when(F.col("inside") == 0, F.col("it.ends_0")).otherwise(F.col("it.ends_1"))
    open_at_end = (F.col("inside") + F.col("it.quotes")) % 2 == 1
    # The record that is open at the end began here unless the whole piece lies in an older one.
    began = F.when(open_at_end & (line_ends | (F.col("inside") == 0)), F.col("place"))
    looked = looked.withColumns({"open_at_end": open_at_end, "began": began})
    return looked.select(
        *PIECE, "place", "inside", "open_at_end",
        F.last("began", ignorenulls=True).over(before).alias("opened_before"),
        (F.max(F.when(F.col("it.adds"), F.col("place"))).over(Window.partitionBy("upload_id")) == F.col("place")).alias("last"),
    )


def _marked(body: Column, inside: Column) -> Column:
    """A body whose line ends outside quotes are marked."""
    sections = F.transform(
        F.split(body, '"', -1),
        lambda s, at: F.when((at + inside) % 2 == 0, F.regexp_replace(s, LINE_END, RECORD_END)).otherwise(s),
    )
    return F.array_join(sections, '"')


def record_texts(pieces: DataFrame) -> DataFrame:
    """``upload_id, place, line_no, record`` of every record of an upload, in the order of the last two.

    ``place`` is the piece in which the record starts, ``line_no`` its number there.
    """
    body = _plain(F.col("csv_text"))
    joined = pieces.join(piece_states(pieces), list(PIECE))
    body = F.when(F.col("place") == 1, body).otherwise(_rest(body))
    body = F.when((body == "") | F.endswith(body, F.lit("\n")) | F.col("last"), body).otherwise(F.concat(body, F.lit("\n")))
    told = joined.select(
        "upload_id", "chunk_index", "place", "inside", "open_at_end", "opened_before",
        F.split(_marked(body, F.col("inside")), RECORD_END, -1).alias("parts"),
    )
    each = told.select("*", F.size("parts").alias("n"), F.posexplode("parts").alias("line_no", "part"))
    goes_on = (F.col("line_no") == 0) & (F.col("inside") == 1)
    stays_open = (F.col("line_no") == F.col("n") - 1) & F.col("open_at_end")
    each = each.withColumn("border", goes_on | stays_open)
    whole = each.where(~F.col("border")).select("upload_id", "place", "line_no", F.col("part").alias("record"))
    parts = each.where("border").select(
        "upload_id", F.when(goes_on, F.col("opened_before")).otherwise(F.col("place")).alias("start"),
        F.struct("place", "line_no", "part").alias("p"),
    )
    across = parts.groupBy("upload_id", "start").agg(F.array_sort(F.collect_list("p")).alias("ps"))
    across = across.select(
        "upload_id", F.col("ps")[0]["place"].alias("place"), F.col("ps")[0]["line_no"].alias("line_no"),
        F.array_join(F.transform("ps", lambda p: p["part"]), "").alias("record"),
    )
    return whole.unionByName(across).where(~F.col("record").isin("", '"', '""'))


def fields(record: Column) -> Column:
    """The values of a record, unquoted."""
    sections = F.split(record, '"', -1)
    last = F.size(sections) - 1
    # Nothing between two quoted sections is a doubled quote.
    doubled = lambda s, at: (s == "") & (at > 0) & (at < last)
    values = F.transform(
        sections,
        lambda s, at: F.when(at % 2 == 1, s).when(doubled(s, at), F.lit('"')).otherwise(F.replace(s, F.lit(","), F.lit(FIELD_END))),
    )
    return F.split(F.array_join(values, ""), FIELD_END, -1)


def read_pieces(pieces: DataFrame, wanted: Mapping[str, Sequence[str]]) -> DataFrame:
    """Rows of all uploads under the wanted names, with ``upload_id, place, line_no``.

    ``pieces`` has upload_id, chunk_index and csv_text, each piece once. Columns are found
    by the header of each upload: case-insensitive, the first spelling that occurs, the
    first of equal headers; a column that the header lacks is empty.
    """
    records = record_texts(pieces).select("upload_id", "place", "line_no", fields(F.col("record")).alias("values"))
    # The header is the first record that starts in the first piece: one row per upload.
    heads = records.where("place = 1").groupBy("upload_id").agg(F.min_by("values", "line_no").alias("head"), F.min("line_no").alias("head_line"))
    keys = F.transform("head", lambda name: F.lower(text.strip(name)))
    positions = {
        name: F.coalesce(*[F.nullif(F.array_position(keys, header_key(s)), F.lit(0)) for s in spellings]).cast("int")
        for name, spellings in wanted.items()
    }
    heads = heads.select("upload_id", "head_line", *[at.alias(f"_at_{name}") for name, at in positions.items()])
    rows = records.join(heads, "upload_id").where(~((F.col("place") == 1) & (F.col("line_no") == F.col("head_line"))))
    return rows.select(
        "upload_id", "place", "line_no",
        *[text.or_empty(F.get("values", F.col(f"_at_{name}") - 1)).alias(name) for name in wanted],
    )


def piece_files(spark: SparkSession, path: str) -> DataFrame:
    """Pieces from files ``<upload_id>/<chunk_index>.csv``, each read whole."""
    files = spark.read.text(path, wholetext=True).withColumn("file", F.col("_metadata.file_path"))
    return files.select(
        F.regexp_extract("file", r"([^/]+)/[0-9]+\.csv$", 1).alias("upload_id"),
        F.regexp_extract("file", r"([0-9]+)\.csv$", 1).cast("int").alias("chunk_index"),
        F.regexp_replace("value", "^﻿", "").alias("csv_text"),
    )


def read_contact_pieces(pieces: DataFrame) -> DataFrame:
    """Contact rows of uploads in pieces, with their position."""
    return read_pieces(pieces, CONTACT_HEADERS).withColumnRenamed("place", "chunk_place")
