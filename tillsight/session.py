"""Session settings, scratch storage and small lookup tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

# Runtime settings every job relies on. A UTC session makes a day 24 hours and
# makes TIMESTAMP_NTZ <-> TIMESTAMP casts the identity. The skew-join settings
# let AQE split a hot key even when the split costs one extra shuffle.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session and return it."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


TASK_BYTES = "spark.sql.adaptive.advisoryPartitionSizeInBytes"


def small_tasks(spark: SparkSession) -> None:
    """AQE merges partitions to 8 MB and not 64 MB, unless the session has a size of its own.

    A ticket line becomes eight facts, so a task makes over ten times the bytes that it
    reads; and with a few tasks more than cores, most cores wait for the second round.
    """
    if spark.conf.get(TASK_BYTES, None) is None:
        spark.conf.set(TASK_BYTES, "8m")


SUBSET = "spark.sql.requireAllClusterKeysForCoPartition"


@contextmanager
def dealt_by_first_key(spark: SparkSession) -> Iterator[None]:
    """Joins run in here leave rows where they are that are dealt by one of the join's keys."""
    before = spark.conf.get(SUBSET)
    spark.conf.set(SUBSET, "false")
    try:
        yield
    finally:
        spark.conf.set(SUBSET, before)


def shuffle_partitions(
    input_bytes: int, total_cores: int, target_bytes: int = 128 << 20, blocks: int = 2_000_000_000
) -> int:
    """Shuffle partitions so that one holds about ``target_bytes`` of what is shuffled.

    ``input_bytes`` are the bytes after pruning. Never fewer than the cores; AQE
    merges the ones that turn out small. A shuffle has map tasks times partitions
    blocks, which the driver keeps track of: with a map task per ``target_bytes``
    too, there are at most ``blocks`` of them, and partitions grow instead.
    """
    maps = max(1, -(-input_bytes // target_bytes))
    return max(total_cores, min(maps, blocks // maps))


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    A local-mode session without one (tests) gets a temporary folder; a cluster
    without one is refused, because a machine-local folder would lose data.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if named:
        if context.getCheckpointDir() is None:
            context.setCheckpointDir(named)
        return named
    current = context.getCheckpointDir()
    if current is not None:
        return current
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    folder = tempfile.mkdtemp(prefix="run-")
    context.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path for an intermediate table, inside the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def lookup_frame(spark: SparkSession, schema: pa.Schema, rows: Sequence[tuple]) -> DataFrame:
    """A lookup table from parameter rows.

    It becomes a local relation whose row count Catalyst knows, so it compares
    the size with ``spark.sql.autoBroadcastJoinThreshold``: small tables are
    broadcast, larger ones are shuffled. No hint is given.
    """
    columns = list(zip(*rows)) if rows else [[] for _ in schema]
    arrays = [pa.array(list(values), type=field.type) for values, field in zip(columns, schema)]
    return spark.createDataFrame(pa.Table.from_arrays(arrays, schema=schema))
