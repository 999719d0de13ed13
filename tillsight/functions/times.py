"""Time expressions. All of them assume the UTC session set by ``configure``."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip

# Accepted time stamps are ISO dates with an optional time and zone.
ISO_TIME = (
    r"^[0-9]{4}(-[0-9]{2}(-[0-9]{2}"
    r"([ T][0-9]{2}:[0-9]{2}(:[0-9]{2}(\.[0-9]+)?)?(Z|[+-][0-9]{2}:?[0-9]{2})?)?)?)?$"
)


def instant(as_of: dt.datetime) -> Column:
    """A literal time stamp; naive values are UTC."""
    if as_of.tzinfo is not None:
        as_of = as_of.astimezone(dt.timezone.utc).replace(tzinfo=None)
    return F.lit(as_of.isoformat(sep=" ")).cast("timestamp")


def parse_time(text: Column) -> Column:
    """ISO time stamp in UTC unless it names a zone; anything else is NULL."""
    shown = strip(text)
    return F.when(F.rlike(shown, F.lit(ISO_TIME)), shown.try_cast("timestamp"))


def format_time(moment: Column) -> Column:
    """``YYYY-MM-DD HH:MM:SS`` in UTC, empty for NULL."""
    return F.coalesce(F.date_format(moment, "yyyy-MM-dd HH:mm:ss"), F.lit(""))


def local_date(moment: Column, zone: str) -> Column:
    """Calendar date of an instant in a time zone."""
    return F.to_date(F.from_utc_timestamp(moment, zone))


def days_before(as_of: dt.datetime, days: int) -> Column:
    """The instant exactly ``days`` times 24 hours before ``as_of``."""
    return instant(as_of) - F.expr(f"INTERVAL {int(days)} DAYS")


def hours_before(as_of: dt.datetime, hours: int) -> Column:
    return instant(as_of) - F.expr(f"INTERVAL {int(hours)} HOURS")


def months_before(as_of: dt.datetime, months: int) -> Column:
    """Calendar months back; the day is clamped to the end of a shorter month."""
    return instant(as_of) - F.expr(f"INTERVAL {int(months)} MONTHS")
