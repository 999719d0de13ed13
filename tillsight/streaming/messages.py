"""Message feed as a stream: idempotent append over the whole history."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators import messages as ops
from ..operators.keep import known_keys
from ..schemas import MESSAGES
from . import tables

COUNTERS = (
    "rows_total bigint, rows_inserted bigint, rows_skipped bigint, "
    "skipped_no_id bigint, skipped_stored bigint, skipped_repeated bigint"
)


def start_ingest(stream: DataFrame, root: str, checkpoint: str) -> StreamingQuery:
    """Append new messages, first arrival per id, and log the counters of each batch.

    Runs over everything that is available and stops; started again with the
    same checkpoint it continues where it stopped. With a new checkpoint it reads
    everything again and stores nothing twice.
    """
    spark = stream.sparkSession
    tables.create(spark, f"{root}/messages", MESSAGES)
    tables.create(spark, f"{root}/counters", COUNTERS)

    told: set[str] = set()

    def count(session: SparkSession, arrived: DataFrame, name: str, new: bool) -> None:
        history = tables.others(session, f"{root}/messages", MESSAGES, name)
        stored = known_keys(history, arrived, ["message_id"])
        if new:
            tables.write(ops.new_messages(arrived, stored), f"{root}/messages", name)
        tables.write(ops.upload_counters(arrived, stored), f"{root}/counters", name)
        tables.finished(session, f"{root}/messages", name)

    def append(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        name = tables.batch_name(tables.run_name(session, checkpoint), batch_id)
        if not told:
            # Once per start: an earlier stream may have stored messages and died before it counted them.
            told.add(name)
            for lost in tables.unfinished(session, f"{root}/messages", MESSAGES):
                if lost != name:
                    count(session, session.read.parquet(f"{root}/arrived/batch={lost}"), lost, new=False)
        count(session, tables.landed(ops.normalize_messages(batch), f"{root}/arrived", name), name, new=True)

    return (
        stream.writeStream.foreachBatch(append)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def stored_messages(spark: SparkSession, root: str) -> DataFrame:
    return tables.read(spark, f"{root}/messages", MESSAGES).drop("batch")


def stored_counters(spark: SparkSession, root: str) -> DataFrame:
    return tables.read(spark, f"{root}/counters", COUNTERS)
