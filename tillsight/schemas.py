"""Schemas of the stored tables and feeds (additive evolution: read with these)."""

from __future__ import annotations

POS_LINES = (
    "store_code string, ticket_id string, line_no bigint, movement string, purchase_date date, "
    "seller string, product_code_raw string, description string, brand string, "
    "qty decimal(12,2), unit_price decimal(12,2), payment_method string, "
    "customer_name string, phone_raw string, lead_source string"
)

PURCHASES = (
    "phone string, purchase_date date, store_code string, seller string, agent_name string, "
    "sales_channel string, ticket_id string, product_code string, product_name string, "
    "category string, qty int, unit_price decimal(12,2), line_total decimal(12,2), "
    "payment_method string, lead_source string, raw_customer_name string, raw_city string"
)

CUSTOMERS = (
    "phone string, name string, city string, state string, is_priority_city boolean, "
    "city_priority_score int, total_orders bigint, total_lifetime decimal(28,2), "
    "total_online_orders bigint, total_online decimal(28,2), "
    "total_walkin_orders bigint, total_walkin decimal(28,2), "
    "first_purchase_date date, last_purchase_date date, days_since_last_purchase int, "
    "favorite_category string, favorite_product string, favorite_store string, "
    "favorite_seller string, favorite_agent string, favorite_payment string, "
    "top_lead_source string, buyer_tier string, is_lapsed boolean, "
    "last_synced_at timestamp, created_at timestamp"
)

# What a roll-up gives: the customer table without the columns it owns itself.
SUMMARY = ", ".join(
    column
    for column in CUSTOMERS.split(", ")
    if column.split()[0] not in ("state", "is_priority_city", "city_priority_score", "created_at")
)

MESSAGES = (
    "message_id string, contact_id string, datetime timestamp, message_type string, "
    "content_type string, content_raw string, sender_type string, channel_id string, "
    "type_field string, sub_type string"
)

ACTIVITY = "agent string, event string, detail string, ts timestamp"

CHECKINS = (
    "agent string, contact_id string, name string, phone string, action string, notes string, "
    "score string, priority string, city string, lifecycle string, logged_at timestamp"
)

IMPORT_LOG = (
    "id bigint, kind string, source string, upload_id string, chunk_index int, total_chunks int, "
    "rows_total bigint, rows_inserted bigint, rows_skipped bigint, status string, details string, "
    "performed_at timestamp"
)

SYNC_STATE = (
    "sync_key string, last_run_at timestamp, last_cursor string, rows_synced bigint, "
    "status string, error_message string"
)

KNOWN_CONTACTS = "contact_id string, first_seen timestamp"


def column_names(schema: str) -> list[str]:
    """Column names of a DDL string, in order."""
    return [part.split()[0] for part in schema.split(", ")]
