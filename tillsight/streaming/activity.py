"""Activity beacons as a stream: daily counts in local time, however late they come."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import times
from ..operators.activity import EVENT_COLUMNS
from ..params import LOCAL_ZONE
from . import tables

DAILY = (
    "file string, agent string, day date, "
    + ", ".join(f"{name} bigint" for name in EVENT_COLUMNS.values())
    + ", first_activity timestamp, last_activity timestamp"
)


def with_file(activity: DataFrame) -> DataFrame:
    """Beacons of a file stream with the file they came in."""
    return activity.withColumn("file", F.col("_metadata.file_path"))


def daily_counts(activity: DataFrame, zone: str = LOCAL_ZONE) -> DataFrame:
    """Counts per landed file, agent and local day."""
    counts = [F.count_if(F.col("event") == event).alias(name) for event, name in EVENT_COLUMNS.items()]
    return activity.groupBy("file", "agent", times.local_date(F.col("ts"), zone).alias("day")).agg(
        *counts, F.min("ts").alias("first_activity"), F.max("ts").alias("last_activity")
    )


def start_daily(activity: DataFrame, root: str, checkpoint: str, zone: str = LOCAL_ZONE) -> StreamingQuery:
    """Store the counts of every landed file; there is no watermark and no state.

    ``activity`` is a file stream with the column ``file`` (see ``with_file``). A file
    that a new checkpoint reads again gives the same rows again, which count once.
    """
    spark = activity.sparkSession
    tables.create(spark, root, DAILY)

    def store(batch: DataFrame, batch_id: int) -> None:
        name = tables.batch_name(tables.run_name(batch.sparkSession, checkpoint), batch_id)
        tables.write(daily_counts(batch, zone), root, name)

    return (
        activity.writeStream.foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def current_days(spark: SparkSession, root: str) -> DataFrame:
    """The counts of each agent and day over all landed files."""
    columns = [part.split()[0] for part in DAILY.split(", ")]
    once = tables.read(spark, root, DAILY).select(*columns).distinct()
    totals = [F.sum(name).alias(name) for name in EVENT_COLUMNS.values()]
    return once.groupBy("agent", "day").agg(
        *totals, F.min("first_activity").alias("first_activity"), F.max("last_activity").alias("last_activity")
    )
