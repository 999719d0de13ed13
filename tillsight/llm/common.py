"""Helpers shared by the operators of this folder."""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator
from pathlib import Path

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import configure, scratch_path

#: Rows whose id is missing sort after every other row and count as one document.
LAST_ID = (1 << 63) - 1
#: Deletes the shuffles of a query once it has run.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def importable(spark: SparkSession) -> None:
    """Let Python workers that share this folder import the package from it.

    Elsewhere the package is installed or sent with ``--py-files``.
    """
    root = str(Path(__file__).resolve().parents[2])
    paths = spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, (root, *paths)))


def prepared(spark: SparkSession) -> None:
    """What operators with Python workers need of a session.

    Arrow batches are short, since a row may be a long text; workers find the package.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    importable(spark)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of the given tables, whole."""
    prepared(spark)
    return configure(spark).read.parquet(f"{folder}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: evaluated once, its lineage cut.

    The folder is the one that ``spark.checkpoint.dir`` names, so a lost executor
    loses nothing; whoever owns that folder empties it after the application. What was
    shuffled to write the table is not needed behind it and is deleted at once, so the
    shuffles of one step do not lie beside those of the next.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    before = spark.conf.get(SHUFFLE_CLEANUP)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def free_name(columns: Iterable[str], wanted: str) -> str:
    """``wanted``, lengthened until no column has that name (in any case)."""
    taken = {c.lower() for c in columns}
    while wanted.lower() in taken:
        wanted = "_" + wanted
    return wanted


#: Fixed value: what stands between words, which are runs of digits, a-z and characters beyond ASCII.
BETWEEN_WORDS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def ascii_lower_words(text: Column) -> Column:
    """The words of a whole text after A-Z are lower-cased; none for a missing one.

    Splitting is linear in the text, unlike ``regexp_extract_all``, which copies it for every match.
    """
    plain = F.translate(F.coalesce(text, F.lit("")), UPPER, UPPER.lower())
    return F.array_remove(F.split(plain, BETWEEN_WORDS), "")


def id_key(column: str) -> Column:
    return F.coalesce(F.col(column).cast("long"), F.lit(LAST_ID))


def slices(batches: Iterable[pa.RecordBatch], column: str, most_bytes: int) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut so that a slice holds about ``most_bytes`` of ``column``.

    A single longer text makes a slice of its own, so memory follows the longest
    text and not the number of rows that Spark puts into a batch.
    """
    for batch in batches:
        if batch.num_rows == 0:
            continue
        values = batch.column(batch.schema.get_field_index(column))
        sizes = pc.fill_null(pc.binary_length(values), 0).to_pylist()
        start, held = 0, 0
        for row, size in enumerate(sizes):
            if row > start and held + size > most_bytes:
                yield batch.slice(start, row - start)
                start, held = row, 0
            held += size
        yield batch.slice(start)
