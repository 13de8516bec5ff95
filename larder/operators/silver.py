"""Bronze -> silver cleaning (ops B2-B7).

Both jobs are a single narrow stage (projection + filter): no shuffle, so they
scale with the number of input splits and run inside one codegen span.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SALES_SILVER_DDL = (
    "transaction_id STRING, line_number INT, store_id STRING, product_id STRING, "
    "quantity INT, unit_price DOUBLE, discount DOUBLE, total_amount DOUBLE, "
    "payment_type STRING, channel STRING, loyalty_id STRING, "
    "transaction_ts TIMESTAMP_NTZ, event_date DATE"
)
COMPETITOR_SILVER_DDL = (
    "competitor STRING, product_id STRING, price DOUBLE, scrape_ts TIMESTAMP_NTZ, event_date DATE"
)


def _d(name: str) -> Column:
    return F.col(name).try_cast("double")


def _impute(target: str, formula: Column, *needs: str) -> Column:
    """COALESCE(parsed value, formula when the *raw* inputs are present).

    The presence test reads the raw text columns, not imputed values, so a
    row missing two of the three amounts keeps a NULL (as the SQL is written).
    """
    present = None
    for n in needs:
        t = F.col(n).isNotNull()
        present = t if present is None else present & t
    return F.coalesce(_d(target), F.when(present, formula)).alias(target)


def clean_sales(raw: DataFrame, strict: bool = False) -> DataFrame:
    """Typed, imputed silver sales lines.

    ``strict=False`` keeps the rule as written: only the raw timestamp, date and
    quantity text must be present, so unparsable values survive as NULL.
    ``strict=True`` applies the stated intent: the three must also parse.
    The invariant ``quantity * (unit_price - discount) = total_amount`` fills
    one missing amount; division by a zero quantity yields NULL, not an error.
    """
    qty = _d("quantity")
    # reports that read neither leave the order's columns out
    of_order = [F.col(c).try_cast("string").alias(c) for c in ("payment_type", "loyalty_id") if c in raw.columns]
    names = [c.strip().split(" ")[0] for c in SALES_SILVER_DDL.split(",")]
    out = raw.select(
        F.col("transaction_id").try_cast("string").alias("transaction_id"),
        F.col("line_number").try_cast("int").alias("line_number"),
        F.col("store_id").try_cast("string").alias("store_id"),
        F.col("product_id").try_cast("string").alias("product_id"),
        F.col("quantity").try_cast("int").alias("quantity"),
        _impute("unit_price", F.try_divide(_d("total_amount"), qty) + _d("discount"),
                "total_amount", "discount", "quantity"),
        _impute("discount", _d("unit_price") - F.try_divide(_d("total_amount"), qty),
                "total_amount", "unit_price", "quantity"),
        _impute("total_amount", qty * (_d("unit_price") - _d("discount")),
                "unit_price", "discount", "quantity"),
        *of_order,
        F.col("channel").try_cast("string").alias("channel"),
        F.col("transaction_ts").try_cast("timestamp_ntz").alias("transaction_ts"),
        F.col("event_date").try_cast("date").alias("event_date"),
        # raw presence flags, used by the filter and then dropped
        F.col("transaction_ts").isNotNull().alias("_ts_present"),
        F.col("event_date").isNotNull().alias("_date_present"),
        F.col("quantity").isNotNull().alias("_qty_present"),
    )
    keep = (F.col("_ts_present") & F.col("_date_present") & F.col("_qty_present")
            & F.col("transaction_id").isNotNull() & F.col("line_number").isNotNull()
            & F.col("store_id").isNotNull() & F.col("product_id").isNotNull())
    if strict:
        keep = keep & F.col("transaction_ts").isNotNull() & F.col("event_date").isNotNull() \
            & F.col("quantity").isNotNull()
    return out.filter(keep).select([c for c in names if c in out.columns])


def clean_competitor(raw: DataFrame) -> DataFrame:
    """Strict typed cleaning: every field parses and nothing was rescued."""
    out = raw.select(
        F.col("competitor").try_cast("string").alias("competitor"),
        F.col("product_id").try_cast("string").alias("product_id"),
        F.col("price").try_cast("double").alias("price"),
        F.col("scrape_ts").try_cast("timestamp_ntz").alias("scrape_ts"),
        F.col("event_date").try_cast("date").alias("event_date"),
        F.col("_rescued_data").isNull().alias("_clean"),
    )
    keep = F.col("_clean")
    for c in ("competitor", "product_id", "price", "scrape_ts", "event_date"):
        keep = keep & F.col(c).isNotNull()
    return out.filter(keep).drop("_clean")
