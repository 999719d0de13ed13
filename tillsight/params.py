"""Parameters: thresholds, rules and lookup tables.

Defaults of numbers are the business defaults. Lookup tables have no default
content: agents, sellers, cities and area codes belong to the shop that uses
this package.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .session import lookup_frame

UNASSIGNED = "Unassigned"
ONLINE = "agent_online"
WALKIN = "walkin"

NAME_REQUIRED = "name_required"
TICKET_ONLY = "ticket_movement_only"

ALWAYS_ONLINE = "always"
ONLINE_BEFORE_CUTOFF = "cutoff"

LOCAL_ZONE = "America/Mexico_City"


@dataclass(frozen=True)
class Thresholds:
    """Limits of the customer roll-up."""

    vip_lifetime: int = 50_000
    vip_orders: int = 15
    regular_lifetime: int = 10_000
    lapsed_days: int = 60
    seller_cutoff: dt.date = dt.date(2026, 5, 3)


@dataclass(frozen=True)
class PriorityCity:
    """A city worth flagging; list order decides between partial matches."""

    key: str
    state: str
    priority: int


@dataclass(frozen=True)
class Lookups:
    """The lookup tables, as parameter rows.

    store_rules   (store_code, rule), rule is NAME_REQUIRED or TICKET_ONLY
    categories    (suffix, category), suffix = last two letters of a code
    sellers       (seller, agent, rule), rule is ALWAYS_ONLINE or ONLINE_BEFORE_CUTOFF
    agents        (email, agent)
    areas         (prefix, city, state), prefix has two or three digits
    cities        PriorityCity entries in match order
    """

    store_rules: tuple[tuple[str, str], ...] = ()
    categories: tuple[tuple[str, str], ...] = ()
    sellers: tuple[tuple[str, str, str], ...] = ()
    agents: tuple[tuple[str, str], ...] = ()
    areas: tuple[tuple[str, str, str], ...] = ()
    cities: tuple[PriorityCity, ...] = ()

    def __post_init__(self) -> None:
        for name in ("categories", "sellers", "agents", "areas"):
            keys = [row[0] for row in getattr(self, name)]
            if len(keys) != len(set(keys)):
                raise ValueError(f"{name}: a key occurs twice, joins would repeat rows")

    def category_frame(self, spark: SparkSession) -> DataFrame:
        return _strings(spark, ("suffix", "category"), self.categories)

    def seller_frame(self, spark: SparkSession) -> DataFrame:
        return _strings(spark, ("seller_key", "agent_name", "channel_rule"), self.sellers)

    def agent_frame(self, spark: SparkSession) -> DataFrame:
        return _strings(spark, ("email_key", "agent"), self.agents)

    def area_frame(self, spark: SparkSession) -> DataFrame:
        return _strings(spark, ("prefix", "area_city", "area_state"), self.areas)

    def agent_names(self, spark: SparkSession) -> DataFrame:
        """Each known agent once, and the catch-all."""
        names = sorted({agent for _, agent in self.agents} | {UNASSIGNED})
        return _strings(spark, ("agent",), [(name,) for name in names])


def _strings(spark: SparkSession, names: tuple[str, ...], rows) -> DataFrame:
    return lookup_frame(spark, pa.schema([(name, pa.string()) for name in names]), rows)


def at_least(value: int | None, low: int, default: int) -> int:
    """``value``, or the default when missing; one below ``low`` is an error."""
    chosen = default if value is None else int(value)
    if chosen < low:
        raise ValueError(f"{chosen} is less than {low}")
    return chosen


def window_days(value: int | None = None) -> int:
    """Length of a message window in days."""
    return at_least(value, 1, 7)


def message_page_size(value: int | None = None) -> int:
    return at_least(value, 1, 5_000)


def customer_list_size(value: int | None = None) -> int:
    return at_least(value, 1, 1_000)
