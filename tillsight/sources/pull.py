"""Ticket lines of a store server as a stream: the offset is a mark per store.

``spark.readStream.format("store_pull")`` polls a table of ticket lines by ticket number,
store by store. A batch is a range of ticket numbers per store, so it always takes whole
tickets, is never cut by a page, and reads the same lines whenever it is read again. A
store whose numbers have not grown gives no partition.

The server stands behind two small functions: the highest number of each store, and the
lines of one store in a range of numbers. ``ParquetServer`` reads them from Parquet files
(one folder for all stores), whose footers hold the highest numbers; a database gives
them by ``MAX`` and ``BETWEEN``.

Options: ``path``, ``stores`` (comma-separated), ``tickets_per_batch`` (how many numbers
a batch spans per store at most; 0 takes all there are) and ``tickets_per_task``.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.dataset as ds
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from ..schemas import POS_LINES

NUMBER = "ticket_number"


class ParquetServer:
    """Ticket lines in Parquet, with the column ``ticket_number`` beside those of ``POS_LINES``."""

    def __init__(self, path: str):
        self.files = ds.dataset(path, format="parquet")

    def highest(self, stores: list[str]) -> dict[str, int]:
        """The highest number of each store that has lines; only two columns are read, batch by batch."""
        found: dict[str, int] = {}
        wanted = ds.field("store_code").isin(stores)
        for batch in self.files.to_batches(columns=["store_code", NUMBER], filter=wanted, use_threads=False):
            if batch.num_rows:
                table = pa.Table.from_batches([batch]).group_by("store_code").aggregate([(NUMBER, "max")])
                for row in table.to_pylist():
                    if row[f"{NUMBER}_max"] is not None:
                        found[row["store_code"]] = max(row[f"{NUMBER}_max"], found.get(row["store_code"], -1))
        return found

    def lines(self, store: str, above: int, upto: int, columns: list[str]) -> Iterator[pa.RecordBatch]:
        """Lines of a store with ``above < number <= upto``; row groups outside are skipped."""
        number = ds.field(NUMBER)
        wanted = (ds.field("store_code") == store) & (number > above) & (number <= upto)
        yield from self.files.to_batches(columns=columns, filter=wanted, use_threads=False)


@dataclass
class TicketRange(InputPartition):
    store: str
    above: int
    upto: int


class StorePull(DataSource):
    """The source; register it with ``spark.dataSource.register(StorePull)``."""

    @classmethod
    def name(cls) -> str:
        return "store_pull"

    def schema(self) -> str:
        return POS_LINES

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
        return StorePullReader(dict(self.options), [field.name for field in schema.fields])


class StorePullReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str], columns: list[str]):
        self.path = options["path"]
        self.stores = [s for s in options["stores"].split(",") if s]
        self.per_batch = int(options.get("tickets_per_batch", "0"))
        self.per_task = int(options.get("tickets_per_task", "100000"))
        self.columns = columns
        self.seen: dict[str, int] | None = None

    def initialOffset(self) -> dict:  # noqa: N802
        """Before the first ticket of every store; a number is never negative."""
        return {store: -1 for store in self.stores}

    def latestOffset(self) -> dict:  # noqa: N802
        """The marks of the next batch: what the server has, but at most a batch's span further."""
        highest = ParquetServer(self.path).highest(self.stores)
        start = self.seen if self.seen is not None else self.initialOffset()
        marks = {}
        for store in self.stores:
            last = max(start.get(store, -1), highest.get(store, -1))
            marks[store] = min(last, start.get(store, -1) + self.per_batch) if self.per_batch else last
        self.seen = marks
        return marks

    def partitions(self, start: dict, end: dict) -> list[TicketRange]:
        """Ranges of ticket numbers, several per store if there are many numbers."""
        out = []
        for store in sorted(end):
            low, high = start.get(store, -1), end[store]
            out += [TicketRange(store, at, min(at + self.per_task, high)) for at in range(low, high, self.per_task)]
        # What is read next starts here, also after a restart from a checkpoint.
        self.seen = {**start, **end}
        return out

    def read(self, partition: TicketRange) -> Iterator[pa.RecordBatch]:
        yield from ParquetServer(self.path).lines(partition.store, partition.above, partition.upto, self.columns)


def marks_of(offset: str) -> dict[str, int]:
    """The marks in an offset as the checkpoint holds it."""
    return {store: int(mark) for store, mark in json.loads(offset).items()}
