"""Tables that micro-batches and runs write to, safely repeatable.

Every micro-batch owns one folder, named by its stream run and its number, and
replaces it as a whole. The run's name is the id that its checkpoint holds: a
repeated batch writes its own folder again, and a stream that starts anew with
another checkpoint writes beside the folders of the old one, which stay part of the
history that new rows are compared with.

Tables that are written in full each time keep a log of versions, one small row per
write; readers take the folder that the newest row names and look at no other.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BEFORE_FIRST = "start"
VERSIONS = "name string, seq bigint"


def create(spark: SparkSession, root: str, schema: str) -> None:
    """Make an empty table unless it exists."""
    spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{root}/batch={BEFORE_FIRST}")


def run_name(spark: SparkSession, checkpoint: str) -> str:
    """The id of the stream that a checkpoint belongs to, one line in its metadata."""
    return spark.read.schema("id string").json(f"{checkpoint}/metadata").first()["id"]


def batch_name(run: str, number: int) -> str:
    return f"{run}.{number:012d}"


def read(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """All rows with the batch that wrote them."""
    return spark.read.schema(f"{schema}, batch string").parquet(root)


def write(rows: DataFrame, root: str, batch: str) -> None:
    rows.write.mode("overwrite").option("compression", "zstd").parquet(f"{root}/batch={batch}")


def landed(rows: DataFrame, root: str, batch: str) -> DataFrame:
    """Rows written once and read back, so that several branches see the same ones.

    The folder is replaced if the batch is repeated; whoever owns the table may
    empty it between runs.
    """
    write(rows, root, batch)
    return rows.sparkSession.read.schema(rows.schema).parquet(f"{root}/batch={batch}")


DEALT = "name string, key string, buckets int"


def _dealt(root: str) -> str:
    return f"{root.rstrip('/')}-dealt"


def write_by(rows: DataFrame, key: str, root: str, batch: str) -> None:
    """Write a batch in files dealt by a key: joins, windows and groups by it need no shuffle.

    There are as many buckets as shuffle partitions, so other tables meet them; a small table
    beside this one tells how many. Rows that do not come by the key make a file per task and
    bucket: deal them first. The catalog forgets the folder at once; the files stay.
    """
    spark = rows.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Until the files are there, the folder counts as one that is not dealt.
    forget(spark, root, batch)
    name = f"dealt_{uuid.uuid4().hex}"
    writer = rows.write.mode("overwrite").format("parquet").option("compression", "zstd")
    writer.option("path", f"{root}/batch={batch}").bucketBy(buckets, key).saveAsTable(name)
    spark.sql(f"DROP TABLE {name}")
    row = spark.createDataFrame([(batch, key, buckets)], DEALT).coalesce(1)
    row.write.mode("overwrite").parquet(f"{_dealt(root)}/batch={batch}")


def forget(spark: SparkSession, root: str, batch: str) -> None:
    """The batch is about to change: how its files were dealt no longer counts."""
    spark.createDataFrame([], DEALT).write.mode("overwrite").parquet(f"{_dealt(root)}/batch={batch}")


def dealt_batches(spark: SparkSession, key: str, root: str) -> dict[str, int]:
    """The batches dealt by a key, with their number of buckets; one small row for each."""
    spark.createDataFrame([], DEALT).write.mode("ignore").parquet(f"{_dealt(root)}/batch={BEFORE_FIRST}")
    log = spark.read.schema(DEALT).parquet(_dealt(root)).filter(F.col("key") == key)
    return {row["name"]: row["buckets"] for row in log.collect()}


def read_by(spark: SparkSession, key: str, root: str, schema: str, batches: Sequence[str]) -> DataFrame:
    """All rows of some batches, with the batch, as they were dealt by a key.

    Batches dealt otherwise come along, and are then shuffled where that is needed.
    """
    dealt: dict[int, list[str]] = {}
    for name, buckets in dealt_batches(spark, key, root).items():
        if name in batches:
            dealt.setdefault(buckets, []).append(name)
    found = []
    for buckets, names in sorted(dealt.items()):
        # One name per folder and layout; the catalog holds no rows.
        table = "dealt_" + hashlib.md5(f"{root} {key} {buckets}".encode()).hexdigest()
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {table} ({schema}, batch string) USING parquet OPTIONS (path '{root}') "
            f"PARTITIONED BY (batch) CLUSTERED BY ({key}) INTO {buckets} BUCKETS"
        )
        spark.sql(f"ALTER TABLE {table} ADD IF NOT EXISTS " + " ".join(f"PARTITION (batch = '{name}')" for name in sorted(names)))
        spark.catalog.refreshTable(table)
        found.append(spark.table(table).filter(F.col("batch").isin(names)))
    rest = sorted(set(batches) - {name for names in dealt.values() for name in names})
    if rest or not found:
        found.append(read(spark, root, schema).filter(F.col("batch").isin(rest)))
    return reduce(DataFrame.unionByName, found)


def landed_by(rows: DataFrame, key: str, root: str, batch: str) -> DataFrame:
    """Like ``landed``, in files dealt by a key."""
    write_by(rows, key, root, batch)
    schema = ", ".join(f"`{field.name}` {field.dataType.simpleString()}" for field in rows.schema.fields)
    return read_by(rows.sparkSession, key, root, schema, [batch]).drop("batch")


def stored_batches(spark: SparkSession, root: str, schema: str) -> list[str]:
    """The batches that have rows."""
    return sorted(row["batch"] for row in read(spark, root, schema).select("batch").distinct().collect())


def of_batch(spark: SparkSession, root: str, schema: str, batch: str) -> DataFrame:
    """What one batch wrote."""
    return spark.read.schema(schema).parquet(f"{root}/batch={batch}")


def others(spark: SparkSession, root: str, schema: str, batch: str) -> DataFrame:
    """What all other batches wrote; the batch's own folder is pruned."""
    return read(spark, root, schema).filter(F.col("batch") != batch)


DONE = "done string"


def finished(spark: SparkSession, root: str, batch: str) -> None:
    """Note that everything that follows from a batch's rows of this table is written too."""
    spark.createDataFrame([(batch,)], DONE).coalesce(1).write.mode("overwrite").parquet(f"{root.rstrip('/')}-done/batch={batch}")


def unfinished(spark: SparkSession, root: str, schema: str) -> list[str]:
    """Batches whose rows are stored but from which not everything that follows was written.

    A stream that died between two writes and lost its checkpoint leaves such a batch: the
    next one finds its rows known. There is at most one for every such death.
    """
    spark.createDataFrame([], DONE).write.mode("ignore").parquet(f"{root.rstrip('/')}-done/batch={BEFORE_FIRST}")
    done = spark.read.schema(DONE).parquet(f"{root.rstrip('/')}-done").select(F.col("done").alias("batch"))
    stored = read(spark, root, schema).select("batch").distinct()
    rows = stored.filter(F.col("batch") != BEFORE_FIRST).join(done, "batch", "left_anti")
    return sorted(row["batch"] for row in rows.collect())


def _log(root: str) -> str:
    return f"{root.rstrip('/')}-versions"


def next_version(spark: SparkSession, root: str) -> int:
    """The number after the newest version; the log has one row per version."""
    create(spark, _log(root), VERSIONS)
    log = spark.read.schema(VERSIONS).parquet(_log(root))
    return (log.agg(F.max("seq").alias("seq")).first()["seq"] or 0) + 1


def write_version(rows: DataFrame, root: str, batch: str) -> None:
    """Write a full table and, once its files are there, make it the newest version."""
    spark = rows.sparkSession
    write(rows, root, batch)
    number = next_version(spark, root)
    row = spark.createDataFrame([(batch, number)], VERSIONS).coalesce(1)
    row.write.mode("overwrite").parquet(f"{_log(root)}/batch={batch}")


def newest_version(spark: SparkSession, root: str, schema: str, but: str | None = None) -> DataFrame:
    """The newest version (but one of a batch that is being repeated); other folders are not read."""
    create(spark, _log(root), VERSIONS)
    log = spark.read.schema(VERSIONS).parquet(_log(root))
    if but is not None:
        log = log.filter(F.col("name") != but)
    newest = log.agg(F.max_by("name", "seq").alias("name")).first()["name"]
    if newest is None:
        return spark.createDataFrame([], schema)
    return of_batch(spark, root, schema, newest)
