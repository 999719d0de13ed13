"""A customer table laid out for reads of single phones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text


def publish(customers: DataFrame, path: str, row_group_bytes: int = 8 << 20) -> None:
    """Write customers sorted by phone, each file a range of phones, with Bloom filters.

    A read of one phone skips files and row groups by their ranges, and the row group that
    is left by its filter if the phone is not there.
    """
    spread = customers.repartitionByRange("phone").sortWithinPartitions("phone")
    (
        spread.write.mode("overwrite")
        .option("parquet.bloom.filter.enabled#phone", "true")
        .option("parquet.block.size", str(row_group_bytes))
        .parquet(path)
    )


def customers_of(spark: SparkSession, path: str, raw_phones: list[str]) -> DataFrame:
    """The rows of some phones, as typed; a phone that does not normalise has none.

    The phones become literals, so the test reaches the scan.
    """
    typed = spark.createDataFrame([(p,) for p in raw_phones], "raw string")
    found = typed.select(text.normalize_phone(F.col("raw")).alias("phone")).where("phone IS NOT NULL").distinct()
    return spark.read.parquet(path).where(F.col("phone").isin([row["phone"] for row in found.collect()]))
