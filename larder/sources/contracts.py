"""Field lists of the tables that other systems hand over (op A11)."""

from __future__ import annotations

from pyspark.sql import DataFrame

from larder.sources.files import schema_diff

# Names and types as exported beside the tables.
TICKETS = (
    "ticket_id string, status string, priority string, source string, issue_category string, issue_subcategory string, "
    "issue_description string, unit_id int, store_name string, lat double, lon double, type string, caller_name string, "
    "caller_role string, support_department string, vendor_involved string, created_time timestamp, close_time timestamp, "
    "operational_cost double, call_sentiment_score double, csat_score double, first_time_resolution boolean, "
    "agent_experience_level int, hold_time_seconds int, transfer_count int, escalated boolean")
OWN_BRAND = (
    "fdc_id int, description string, brand_owner string, brand_name string, subbrand_name string, gtin_upc string, "
    "ingredients string, serving_size double, serving_size_unit string, household_serving_full_text string, data_type string, "
    "published_date string, publication_date string, market_country string, food_category string, food_category_id int, "
    "modified_date string, data_source string, package_weight string, short_description string, trade_channel string, "
    "allHighlightFields string, score double, collection_timestamp timestamp, page_number int, "
    "product_description_generation string")


def fields(contract: str) -> list[tuple[str, str]]:
    return [tuple(f.split(" ")) for f in contract.split(", ")]


def breaches(df: DataFrame, contract: str) -> list[tuple[str, str, str]]:
    """Fields of ``df`` that miss the contract: (name, expected, found)."""
    return schema_diff(df.schema, fields(contract))
