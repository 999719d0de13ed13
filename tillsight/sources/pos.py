"""Point-of-sale sources: JDBC tables and JSON result files."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text
from ..params import NAME_REQUIRED, TICKET_ONLY

# Names under which a field may arrive, in order of preference.
POS_FIELDS = {
    "ticket_id": ("ticket_id", "NO_REFEREN"),
    "purchase_date": ("purchase_date", "Fecha"),
    "seller": ("vendedor", "Vendedor"),
    "product_code_raw": ("product_code", "Articulo"),
    "description": ("product_name", "Descripcion"),
    "brand": ("product_brand", "Marca"),
    "qty": ("qty", "Cantidad"),
    "unit_price": ("unit_price", "Precio_Venta"),
    "payment_method": ("payment_method", "PAGO2"),
    "customer_name": ("customer_name", "CustCliente"),
    "phone_raw": ("phone", "CustPhone"),
    "lead_source": ("lead_source", "CustGUIA"),
    "movement": ("movement", "Movimiento"),
}


def canonical_lines(
    rows: DataFrame, store_code: str, fields: Mapping[str, Sequence[str]] = POS_FIELDS
) -> DataFrame:
    """Rows of one store under canonical names: per field the first non-empty alias.

    A source without a line number gives 0; equal numbers are ordered by content.
    """
    exact = set(rows.columns)

    def field(name: str) -> Column:
        present = [F.col(f"`{alias}`").cast("string") for alias in fields[name] if alias in exact]
        return text.first_non_empty(*present) if present else F.lit("")

    date = F.left(field("purchase_date"), F.lit(10)).try_cast("date")
    columns = [field(name).alias(name) for name in fields if name != "purchase_date"]
    line = F.col("line_no") if "line_no" in exact else F.lit(0)
    return rows.select(
        F.lit(store_code).alias("store_code"),
        date.alias("purchase_date"),
        line.cast("bigint").alias("line_no"),
        *columns,
    )


def source_filter(
    rows: DataFrame, rule: str | None = None, fields: Mapping[str, Sequence[str]] = POS_FIELDS
) -> Column:
    """What every line that ``rules.store_filter`` keeps fulfils, on the source's own columns.

    Only tests that a database or a Parquet file can answer itself: a phone, and by the
    store's rule a name or a movement, that is there and not empty under one of its names.
    The exact rules, which trim and compare in upper case, are applied to canonical lines.
    """
    needed = {NAME_REQUIRED: ["customer_name"], TICKET_ONLY: ["movement"]}.get(rule or "", [])
    wanted = F.lit(True)
    for name in ["phone_raw", *needed]:
        present = [alias for alias in fields[name] if alias in rows.columns]
        tests = [F.col(f"`{alias}`").isNotNull() & (F.col(f"`{alias}`") != "") for alias in present]
        wanted = wanted & (reduce(lambda a, b: a | b, tests) if tests else F.lit(False))
    return wanted


def source_lines(
    rows: DataFrame, store_code: str, rule: str | None = None, fields: Mapping[str, Sequence[str]] = POS_FIELDS
) -> DataFrame:
    """Canonical lines of one store, of which the source has left out what its rule drops anyway."""
    return canonical_lines(rows.filter(source_filter(rows, rule, fields)), store_code, fields)


def jdbc_options(
    url: str, table: str, ticket_column: str, low: int, high: int, partitions: int, fetch_size: int = 5_000
) -> dict[str, str]:
    """Reader options that split a store table into ticket ranges, read in parallel.

    Bounds only place the splits; no row outside them is lost.
    """
    if high <= low:
        raise ValueError("high must be above low")
    return {
        "url": url,
        "dbtable": f"(SELECT t.*, CAST({ticket_column} AS BIGINT) AS ticket_number FROM {table} t) lines",
        "partitionColumn": "ticket_number",
        "lowerBound": str(low),
        "upperBound": str(high),
        "numPartitions": str(max(1, partitions)),
        "fetchsize": str(fetch_size),
        "pushDownPredicate": "true",
    }


def read_jdbc(
    spark: SparkSession, store_code: str, options: Mapping[str, str], since: int = -1, rule: str | None = None
) -> DataFrame:
    """Lines of one store above a ticket number that its rule may keep; the filters run in the database."""
    rows = spark.read.format("jdbc").options(**options).load()
    return source_lines(rows.filter(F.col("ticket_number") > since), store_code, rule)


def envelope_rows(bodies: DataFrame, column: str, row: T.StructType) -> DataFrame:
    """Rows of JSON results that arrive as an array or under rows, recordset or data.

    The first envelope field that is present wins; other bodies give no rows.
    """
    many = T.ArrayType(row)
    envelope = T.StructType([T.StructField(name, many) for name in ("rows", "recordset", "data")])
    is_array = F.startswith(F.ltrim(F.col(column)), F.lit("["))
    parsed = bodies.select(
        F.from_json(F.when(is_array, F.col(column)), many).alias("top"),
        F.from_json(F.when(~is_array, F.col(column)), envelope).alias("env"),
    )
    found = F.coalesce("top", "env.rows", "env.recordset", "env.data")
    return parsed.select(F.inline(found))


def mixed_rows(bodies: DataFrame, column: str, row: T.StructType, keep: Sequence[str] = ()) -> DataFrame:
    """Rows of JSON results whose values may have any type, each judged for itself.

    Bodies are parsed into variants, so a row that does not fit costs no other row. A body
    is an array, or has one under the first of rows, recordset and data that is present;
    other bodies, and text that is not JSON, give one row with a reason. ``reject_reason``
    is null for a row whose values all fit; otherwise it names what does not, and those
    values are null. A missing or null value fits every type. ``keep`` are columns of the
    bodies that go along.
    """
    body = F.try_parse_json(column)
    many = "array<variant>"
    found = F.coalesce(*[F.try_variant_get("_body", path, many) for path in ("$", "$.rows", "$.recordset", "$.data")])
    parsed = bodies.withColumn("_body", body).select(*keep, F.col("_body"), found.alias("_rows"))
    each = parsed.select(*keep, F.col("_rows").isNull().alias("_none"), F.explode_outer("_rows").alias("_row"))
    # An empty array has no rows; a body without any array is one reject.
    each = each.where("_none OR _row IS NOT NULL")
    is_object = F.schema_of_variant("_row").startswith("OBJECT")
    typed = {f.name: F.try_variant_get("_row", f"$.{f.name}", f.dataType.simpleString()) for f in row.fields}

    def misfit(name: str) -> Column:
        raw = F.try_variant_get("_row", f"$.{name}", "variant")
        return F.when(raw.isNotNull() & ~F.is_variant_null(raw) & typed[name].isNull(), F.lit(name))

    wrong = F.array_join(F.array_compact(F.array(*[misfit(name) for name in typed])), ",")
    reason = (
        F.when(F.col("_none"), F.lit("no rows"))
        .when(~is_object, F.lit("not an object"))
        .when(wrong != "", F.concat(F.lit("type of "), wrong))
    )
    return each.select(*keep, *[value.alias(name) for name, value in typed.items()], reason.alias("reject_reason"))
