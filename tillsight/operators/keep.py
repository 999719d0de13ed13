"""Keep one row per key, and keep only rows a table does not have yet.

``row_number() = 1`` is planned with a group limit before the shuffle, so each
map task sends at most one row per key: a key holding a large share of all rows
costs one row per task, not one huge group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """The first row per key; ``order`` must decide every tie that matters."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(window)).filter("_rank = 1").drop("_rank")


def keep_last(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row per key."""
    return keep_first(df, keys, [F.col(name).desc() for name in order])


def not_in(batch: DataFrame, table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of the batch whose key is absent from the table."""
    return batch.join(table.select(*keys), list(keys), "left_anti")


def known_keys(table: DataFrame, batch: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The keys of a batch that the table has already, each once.

    The first key bounds what is read: its lowest and highest value in the batch are
    literals that reach the scan, so files and row groups of the history that lie outside
    are skipped by their statistics. Tickets and message ids rise with time, and every
    batch has files of its own, so a batch of new ones reads next to nothing, however long
    the history; one that is sent again reads the files of its time.

    Only keys of the batch leave the table's scan: the batch's keys are the small
    side of the semi join (broadcast if small, else a filter before the shuffle), so
    what comes out, and every join after it, follows the batch and not the history.
    """
    first = F.col(keys[0])
    low, high = batch.agg(F.min(first), F.max(first)).first()
    if low is None:
        return table.select(*keys).limit(0)
    wanted = batch.select(*keys).distinct()
    near = table.select(*keys).filter(first.between(F.lit(low), F.lit(high)))
    return near.join(wanted, list(keys), "left_semi").distinct()
