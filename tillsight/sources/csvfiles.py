"""CSV exports: header resolution, quoted fields, chunked files."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions import text

# Header spellings of the exports, by output column, in order of preference.
CONTACT_HEADERS = {
    "contact_id": ("ContactID", "Contact ID", "contact_id", "id"),
    "first_name": ("FirstName", "first_name"),
    "last_name": ("LastName", "last_name"),
    "phone": ("PhoneNumber", "phone", "phone_number", "mobile"),
    "lifecycle": ("Lifecycle",),
    "assignee": ("Assignee", "Assigned Agent"),
    "ciudad": ("ciudad", "city"),
}
MESSAGE_HEADERS = {
    "message_id": ("message id", "message_id"),
    "datetime": ("date & time", "datetime"),
    "contact_id": ("contact id", "contact_id"),
    "message_type": ("message type",),
    "content_type": ("content type",),
    "content_raw": ("content",),
    "sender_type": ("sender type",),
    "channel_id": ("channel id",),
    "type_field": ("type",),
    "sub_type": ("sub type",),
}
MESSAGE_REQUIRED = ("message_id", "datetime", "contact_id")

FIRST = "first"
LAST = "last"


def header_key(name: str | None) -> str:
    return (name or "").strip(text.WHITE_SPACE).lower()


def resolve_headers(
    header: Sequence[str | None],
    wanted: Mapping[str, Sequence[str]],
    required: Sequence[str] = (),
    duplicates: str = FIRST,
) -> dict[str, int | None]:
    """Position of each wanted column: case-insensitive, first spelling that occurs.

    ``duplicates`` tells which of several equal headers is read.
    """
    positions: dict[str, int] = {}
    for index, name in enumerate(header):
        if duplicates == LAST or header_key(name) not in positions:
            positions[header_key(name)] = index
    found: dict[str, int | None] = {}
    for output, spellings in wanted.items():
        keys = (header_key(s) for s in spellings)
        found[output] = next((positions[k] for k in keys if k in positions), None)
    missing = [name for name in required if found.get(name) is None]
    if missing:
        raise ValueError(f"missing required columns: {', '.join(missing)}")
    return found


def _reader(spark: SparkSession, quoted_line_breaks: bool = True):
    return (
        spark.read.option("multiLine", quoted_line_breaks)
        .option("quote", '"')
        .option("escape", '"')
        .option("mode", "PERMISSIVE")
        .option("encoding", "UTF-8")
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
    )


def read_header(spark: SparkSession, path: str) -> list[str | None]:
    """The header line, as one row read by the driver."""
    first = _reader(spark).csv(path, header=False).limit(1).collect()
    if not first:
        raise ValueError(f"no header in {path}")
    return list(first[0])


def read_csv(
    spark: SparkSession,
    path: str,
    wanted: Mapping[str, Sequence[str]],
    required: Sequence[str] = (),
    duplicates: str = FIRST,
    quoted_line_breaks: bool = True,
) -> DataFrame:
    """Rows of all CSV files under a path, as strings under the wanted names.

    Columns that the export lacks are empty. Every file must have the same
    header line; Spark checks that where header names are unique. ``file`` and
    ``row_no`` order the rows: ``row_no`` is the start of the piece of the file a
    task read, and a number that grows within it.

    A file with quoted line breaks must be read from its start by one task;
    exports arrive as many small chunk files, which are read in parallel. Large
    files without line breaks in values are split with ``quoted_line_breaks=False``.
    """
    header = read_header(spark, path)
    positions = resolve_headers(header, wanted, required, duplicates)
    keys = [header_key(name) for name in header]
    unique = len(set(keys)) == len(keys) and all(keys)
    names = [name if unique else f"_c{i}" for i, name in enumerate(header)]
    schema = StructType([StructField(name, StringType()) for name in names])
    raw = _reader(spark, quoted_line_breaks).schema(schema).option("enforceSchema", not unique).csv(path, header=True)
    return raw.select(
        F.col("_metadata.file_path").alias("file"),
        F.struct(
            F.col("_metadata.file_block_start").alias("start"),
            F.monotonically_increasing_id().alias("row"),
        ).alias("row_no"),
        *[
            (F.lit("") if at is None else text.or_empty(F.col(f"`{names[at]}`"))).alias(output)
            for output, at in positions.items()
        ],
    )


def read_contacts(spark: SparkSession, path: str, quoted_line_breaks: bool = True) -> DataFrame:
    """Contact export; ``row_no`` orders the rows by file name and position.

    ``quoted_line_breaks=False`` lets several tasks read one large file, if its
    values have no line breaks; that is the caller's to know.
    """
    rows = read_csv(spark, path, CONTACT_HEADERS, quoted_line_breaks=quoted_line_breaks)
    return rows.withColumn("row_no", F.struct("file", F.col("row_no.start").alias("start"), F.col("row_no.row").alias("row")))


def read_messages(spark: SparkSession, path: str, quoted_line_breaks: bool = True) -> DataFrame:
    """Message export; ``arrival`` orders the rows by file name and position."""
    rows = read_csv(spark, path, MESSAGE_HEADERS, MESSAGE_REQUIRED, LAST, quoted_line_breaks)
    return rows.withColumn("arrival", F.struct("file", "row_no")).drop("file", "row_no")


def write_csv(df: DataFrame, path: str) -> None:
    """Write rows with a header; a value is quoted only when it has to be."""
    (
        df.write.option("header", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("emptyValue", "")
        .option("nullValue", "")
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )
