"""Customer list: contact enrichment, area codes, city flags, statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules, text
from ..params import ONLINE, UNASSIGNED, WALKIN, Lookups, PriorityCity
from .customers import MONEY
from .keep import keep_last


def map_agents(df: DataFrame, email: str, lookups: Lookups, output: str = "agent") -> DataFrame:
    """Agent of an e-mail address; unknown, empty and NULL give the catch-all."""
    agents = lookups.agent_frame(df.sparkSession).withColumnRenamed("agent", "_agent")
    keyed = df.withColumn("email_key", F.lower(text.strip(F.col(email))))
    joined = keyed.join(agents, "email_key", "left").drop("email_key")
    return joined.withColumn(output, F.coalesce("_agent", F.lit(UNASSIGNED))).drop("_agent")


def contact_index(contacts: DataFrame, lookups: Lookups) -> DataFrame:
    """Agent and city per phone from a contact snapshot; the last row of a phone wins.

    An empty assignee gives no agent, an unknown one gives the catch-all.
    """
    valid = contacts.select(
        text.normalize_phone(F.col("phone")).alias("phone"),
        "row_no",
        text.strip(text.or_empty(F.col("assignee"))).alias("assignee"),
        text.non_empty(text.strip(text.or_empty(F.col("ciudad")))).alias("contact_city"),
    ).filter(F.col("phone").isNotNull())
    last = keep_last(valid, ["phone"], ["row_no", "assignee", "contact_city"])
    mapped = map_agents(last, "assignee", lookups, output="_mapped")
    return mapped.select(
        "phone",
        F.when(F.col("assignee") != "", F.col("_mapped")).alias("respond_agent"),
        "contact_city",
    )


def with_area(df: DataFrame, lookups: Lookups, phone: str = "phone") -> DataFrame:
    """Add ``area_city`` and ``area_state`` of a ten-digit phone.

    The three-digit area code is tried first, then the two-digit one.
    """
    areas = lookups.area_frame(df.sparkSession)
    whole = F.length(phone) == 10
    for digits in (3, 2):
        renamed = areas.select(
            F.col("prefix").alias(f"_code{digits}"),
            F.struct("area_city", "area_state").alias(f"_area{digits}"),
        )
        df = df.withColumn(f"_code{digits}", F.when(whole, F.left(phone, F.lit(digits))))
        df = df.join(renamed, f"_code{digits}", "left").drop(f"_code{digits}")
    area = F.coalesce("_area3", "_area2")
    return df.withColumns({"area_city": area["area_city"], "area_state": area["area_state"]}).drop(
        "_area3", "_area2"
    )


def top_customers(customers: DataFrame, limit: int) -> DataFrame:
    """Biggest lifetime amounts first; the phone decides ties."""
    return customers.orderBy(F.col("total_lifetime").desc_nulls_last(), "phone").limit(limit)


def listed_contacts(contacts: DataFrame, customers: DataFrame) -> DataFrame:
    """Contacts with the phone of a listed customer, for lists much shorter than the contacts."""
    phones = customers.select(F.col("phone").alias("_phone"))
    return contacts.join(phones, text.normalize_phone(F.col("phone")) == F.col("_phone"), "left_semi")


def with_contact(customers: DataFrame, contacts: DataFrame, lookups: Lookups) -> DataFrame:
    """Add respond_agent and respond_city; stored columns stay.

    The area-code city is used only when neither the contact nor the customer
    has a city. Both sides are unique by phone before they meet.
    """
    joined = customers.join(contact_index(contacts, lookups), "phone", "left")
    no_city = F.col("contact_city").isNull() & (text.strip(text.or_empty(F.col("city"))) == "")
    city = F.when(no_city, F.col("area_city")).otherwise(F.col("contact_city"))
    return (
        with_area(joined, lookups)
        .withColumn("respond_city", city)
        .drop("contact_city", "area_city", "area_state")
    )


def enrich_customers(customers: DataFrame, contacts: DataFrame, lookups: Lookups) -> DataFrame:
    """Add the contact's agent and city, and the effective agent of each customer."""
    agent = F.coalesce(
        text.non_empty(F.col("respond_agent")),
        text.non_empty(F.col("favorite_agent")),
        F.lit(UNASSIGNED),
    )
    return with_contact(customers, contacts, lookups).withColumn("effective_agent", agent)


def flag_cities(
    customers: DataFrame, cities: Sequence[PriorityCity], city: str = "city"
) -> DataFrame:
    """Set is_priority_city, city_priority_score and state from a city column.

    Existing flags of a row without a city stay; a known state is kept.
    """
    has_city = F.col(city).isNotNull() & (F.col(city) != "")
    normal = customers.withColumn("_city", text.normalize_city(F.col(city)))
    found = normal.withColumn("_found", rules.priority_city(F.col("_city"), cities))

    def existing(name: str, kind: str) -> Column:
        return F.col(name) if name in customers.columns else F.lit(None).cast(kind)

    return found.withColumns(
        {
            "is_priority_city": F.when(has_city, F.col("_found").isNotNull()).otherwise(
                F.coalesce(existing("is_priority_city", "boolean"), F.lit(False))
            ),
            "city_priority_score": F.when(has_city, F.col("_found.priority")).otherwise(
                existing("city_priority_score", "int")
            ),
            "state": F.coalesce(existing("state", "string"), F.col("_found.state")),
        }
    ).drop("_city", "_found")


def match_cities(rows: DataFrame, city: str, keys: DataFrame) -> DataFrame:
    """``state`` and ``priority`` of each row's normalised city, from any number of keys.

    ``keys`` has key, rank, state and priority. An exact name wins; otherwise the key of
    the lowest rank that the name contains. Every different city is cut into its runs of
    letters of the lengths that keys have, and a run meets the equal key: an equi-join
    whose matches are all true ones, so there is no test of every key on every city.
    """
    listed = keys.where("key <> ''").groupBy("key").agg(F.min(F.struct("rank", "state", "priority")).alias("entry"))
    # As many numbers as keys have lengths.
    lengths = sorted(row["n"] for row in listed.select(F.length("key").alias("n")).distinct().collect())
    names = rows.select(F.col(city).alias("_name")).where(F.col("_name").isNotNull()).distinct()
    cut = F.flatten(F.transform(
        F.filter(F.lit(lengths).cast("array<int>"), lambda n: n <= F.length("_name")),
        lambda n: F.transform(F.sequence(F.lit(1), F.length("_name") - n + 1), lambda at: F.substring("_name", at, n)),
    ))
    runs = names.select("_name", F.explode(F.array_distinct(cut)).alias("key"))
    best = F.min(F.struct((F.col("key") != F.col("_name")).alias("part"), "entry"))
    found = runs.join(listed, "key").groupBy("_name").agg(best.alias("_best"))
    joined = rows.join(found, F.col(city) == F.col("_name"), "left")
    return joined.withColumns({"state": F.col("_best.entry.state"), "priority": F.col("_best.entry.priority")}).drop("_name", "_best")


def flag_best_city(customers: DataFrame, lookups: Lookups) -> DataFrame:
    """City flags from the stored city, else from the contact's."""
    best = F.coalesce(text.non_empty(F.col("city")), F.col("respond_city"))
    return flag_cities(customers.withColumn("best_city", best), lookups.cities, "best_city")


def customer_stats(customers: DataFrame) -> DataFrame:
    """Counts and amounts over the whole customer table, as one row."""

    return customers.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("buyer_tier") == "VIP").alias("vip"),
        F.count_if(F.col("buyer_tier") == "Regular").alias("regular"),
        F.count_if(F.col("is_lapsed")).alias("lapsed"),
        F.count_if(F.col("total_online_orders") > 0).alias("online"),
        F.count_if(F.col("total_walkin_orders") > 0).alias("walkin"),
        F.count_if(F.col("is_priority_city")).alias("priority_city"),
        F.avg("total_lifetime").cast(MONEY).alias("avg_lifetime"),
        F.max("total_lifetime").alias("top_spender"),
    )


def agent_counts(enriched: DataFrame, lookups: Lookups) -> DataFrame:
    """Customers per effective agent; every known agent gets a row.

    Names that are not a known agent count for the catch-all.
    """
    names = lookups.agent_names(enriched.sparkSession)
    known = sorted({agent for _, agent in lookups.agents})
    agent = F.when(F.col("effective_agent").isin(known), F.col("effective_agent")).otherwise(
        F.lit(UNASSIGNED)
    )
    counts = enriched.groupBy(agent.alias("agent")).agg(F.count(F.lit(1)).alias("customers"))
    return names.join(counts, "agent", "left").select(
        "agent", F.coalesce("customers", F.lit(0)).alias("customers")
    )


def sync_totals(purchases: DataFrame, customers: DataFrame) -> DataFrame:
    """Eight counts over the purchase and customer tables, as one row."""
    bought = purchases.agg(
        F.count(F.lit(1)).alias("purchases"),
        F.count_if(F.col("sales_channel") == ONLINE).alias("online_purchases"),
        F.count_if(F.col("sales_channel") == WALKIN).alias("walkin_purchases"),
    )
    people = customers.agg(
        F.count(F.lit(1)).alias("customers"),
        F.count_if(F.col("total_online_orders") > 0).alias("online_customers"),
        F.count_if(F.col("is_priority_city")).alias("priority_city_customers"),
        F.count_if(F.col("buyer_tier") == "VIP").alias("vip_customers"),
        F.count_if(F.col("is_lapsed")).alias("lapsed_customers"),
    )
    return one_row(bought, people)


def one_row(*parts: DataFrame) -> DataFrame:
    """Put one-row frames with different columns side by side, without a cross join."""
    stacked = parts[0]
    for part in parts[1:]:
        stacked = stacked.unionByName(part, allowMissingColumns=True)
    return stacked.agg(*[F.max(name).alias(name) for name in stacked.columns])
