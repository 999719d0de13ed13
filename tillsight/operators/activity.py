"""Agent activity: accept beacons and check-ins, count by local day."""

from __future__ import annotations

import datetime as dt
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text, times
from ..params import LOCAL_ZONE

# Event names and the columns that count them.
EVENT_COLUMNS = {
    "page_open": "opens",
    "tab_click": "tab_clicks",
    "whatsapp_click": "whatsapp_clicks",
    "call_click": "call_clicks",
    "search_use": "searches",
    "heartbeat": "heartbeats",
    "session_end": "sessions_ended",
}

CHECKIN_FIELDS = (
    "agent", "contact_id", "name", "phone", "action", "notes", "score", "priority", "city", "lifecycle",
)


def _trimmed_beacons(beacons: DataFrame, as_of: dt.datetime) -> DataFrame:
    return beacons.select(
        text.strip(text.or_empty(F.col("agent"))).alias("agent"),
        text.strip(text.or_empty(F.col("event"))).alias("event"),
        "detail",
        F.coalesce(_moment(beacons), times.instant(as_of)).alias("ts"),
        _unreadable(beacons).alias("unreadable"),
    )


def _moment(beacons: DataFrame) -> Column:
    """A beacon's time; null if it is missing, blank or no time."""
    if isinstance(beacons.schema["ts"].dataType, T.StringType):
        return text.strip(F.col("ts")).try_cast("timestamp")
    return F.col("ts").cast("timestamp")


def _unreadable(beacons: DataFrame) -> Column:
    """Whether there is a time that is not one."""
    return (text.strip(text.or_empty(F.col("ts").cast("string"))) != "") & _moment(beacons).isNull()


def _named() -> Column:
    return (F.col("agent") != "") & (F.col("event") != "")


def accept_beacons(beacons: DataFrame, as_of: dt.datetime) -> DataFrame:
    """Activity rows; agent and event are required.

    A time that is missing, blank or unreadable is ``as_of``; ``beacon_counts`` tells
    how many were unreadable.
    """
    return _trimmed_beacons(beacons, as_of).filter(_named()).drop("unreadable")


def beacon_counts(beacons: DataFrame, as_of: dt.datetime) -> DataFrame:
    """Accepted and rejected beacons, and accepted ones whose time cannot be read."""
    return _trimmed_beacons(beacons, as_of).agg(
        F.count_if(_named()).alias("accepted"), F.count_if(~_named()).alias("rejected"),
        F.count_if(_named() & F.col("unreadable")).alias("unreadable_times"),
    )


def accept_checkins(checkins: DataFrame, as_of: dt.datetime) -> DataFrame:
    """Check-in rows; a missing field is the empty string."""

    def field(name: str) -> Column:
        if name not in checkins.columns:
            return F.lit("").alias(name)
        value = F.col(name).cast("string")
        if name == "score" and isinstance(checkins.schema[name].dataType, T.NumericType):
            value = F.when(F.col(name) != 0, value)  # a score of zero counts as none
        return text.or_empty(value).alias(name)

    return checkins.select(*[field(name) for name in CHECKIN_FIELDS], times.instant(as_of).alias("logged_at"))


def _count(event: str, name: str) -> Column:
    return F.count_if(F.col("event") == event).alias(name)


def since(activity: DataFrame, as_of: dt.datetime, days: int) -> DataFrame:
    return activity.filter(F.col("ts") >= times.days_before(as_of, days))


def daily_activity(
    activity: DataFrame, as_of: dt.datetime, days: int = 7, zone: str = LOCAL_ZONE
) -> DataFrame:
    """Counts per agent and local day, newest day first."""
    recent = since(activity, as_of, days)
    return (
        recent.groupBy("agent", times.local_date(F.col("ts"), zone).alias("day"))
        .agg(
            *[_count(event, name) for event, name in EVENT_COLUMNS.items()],
            F.min("ts").alias("first_activity"),
            F.max("ts").alias("last_activity"),
        )
        .orderBy(F.col("day").desc(), "agent")
    )


def local_today(as_of: dt.datetime, zone: str = LOCAL_ZONE) -> dt.date:
    moment = as_of if as_of.tzinfo else as_of.replace(tzinfo=dt.timezone.utc)
    return moment.astimezone(ZoneInfo(zone)).date()


def _local_midnight(day: dt.date, zone: str) -> dt.datetime:
    local = dt.datetime.combine(day, dt.time(), tzinfo=ZoneInfo(zone))
    return local.astimezone(dt.timezone.utc)


def today_activity(activity: DataFrame, as_of: dt.datetime, zone: str = LOCAL_ZONE) -> DataFrame:
    """Counts per agent for the local day that contains ``as_of``.

    The day is widened to a time range first, so the scan can skip other days.
    """
    today = local_today(as_of, zone)
    low = _local_midnight(today - dt.timedelta(days=1), zone)
    high = _local_midnight(today + dt.timedelta(days=2), zone)
    near = activity.filter((F.col("ts") >= times.instant(low)) & (F.col("ts") < times.instant(high)))
    rows = near.filter(times.local_date(F.col("ts"), zone) == F.lit(today))
    return rows.groupBy("agent").agg(
        _count("page_open", "opens"),
        _count("whatsapp_click", "wa"),
        _count("call_click", "calls"),
        _count("heartbeat", "heartbeats"),
        F.min("ts").alias("first_open"),
        F.max("ts").alias("last_seen"),
    )


def recent_sessions(
    activity: DataFrame, as_of: dt.datetime, days: int = 7, limit: int = 100
) -> DataFrame:
    """The newest session ends."""
    ended = since(activity, as_of, days).filter(F.col("event") == "session_end")
    return (
        ended.select("agent", "ts", "detail")
        .orderBy(F.col("ts").desc(), "agent", "detail")
        .limit(limit)
    )
