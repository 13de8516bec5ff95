"""Price-competition and regional analyses (ops B8, B9, C4-C6, D1-D3, E1).

Every aggregate is keyed so Spark combines map-side before the shuffle; the
per-group top-1 is a grouped ``min`` of a struct rather than a window, so a
hot (product, day) never collects its rows into one task.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.functions.columns import money_sum


def month_bounds(year: int, month: int) -> tuple[_dt.date, _dt.date]:
    start = _dt.date(year, month, 1)
    end = _dt.date(year + (month == 12), month % 12 + 1, 1)
    return start, end


def daily_sales_month(sales: DataFrame, year: int, month: int) -> DataFrame:
    """Total sales per day of one calendar month (B8 + D1).

    The month is a half-open date range, which Parquet can prune on, unlike
    ``year(d) = y AND month(d) = m``.
    """
    start, end = month_bounds(year, month)
    return (sales.filter((F.col("event_date") >= F.lit(start)) & (F.col("event_date") < F.lit(end)))
            .groupBy("event_date")
            .agg(money_sum(F.col("total_amount")).alias("total_amount"))
            .orderBy("event_date"))


def min_competitor_price(competitor: DataFrame) -> DataFrame:
    """Lowest competitor price per (product, day)."""
    return (competitor.groupBy("product_id", "event_date")
            .agg(F.min("price").alias("min_comp_price")))


def best_competitor(competitor: DataFrame) -> DataFrame:
    """Cheapest competitor per (product, day); name breaks price ties.

    Same answer as ``row_number() over (partition by product, day order by
    price, competitor) = 1`` (NULL prices last), but as one aggregate with a
    map-side partial: a hot key is reduced before it is shuffled.
    """
    best = F.min(F.struct(F.col("price").isNull().alias("nul"), F.col("price").alias("p"),
                          F.col("competitor").alias("c")))
    return (competitor.groupBy("product_id", "event_date").agg(best.alias("b"))
            .select("product_id", "event_date", F.col("b.c").alias("best_competitor"),
                    F.col("b.p").alias("min_comp_price")))


def best_vendor(best: DataFrame, products: DataFrame) -> DataFrame:
    """Per (product, day): 'us' when our base price is known and not above the
    cheapest competitor (or there is none), else that competitor (B9, C4)."""
    p = products.select("product_id", "base_price")
    j = best.join(p, "product_id", "left")
    ours = F.col("base_price").isNotNull() & (
        F.col("min_comp_price").isNull() | (F.col("base_price") <= F.col("min_comp_price")))
    return j.select("product_id", "event_date",
                    F.when(ours, F.lit("us")).otherwise(F.col("best_competitor")).alias("best_vendor"),
                    F.when(ours, F.col("base_price")).otherwise(F.col("min_comp_price"))
                    .alias("best_price"))


def sales_by_region(sales: DataFrame, stores: DataFrame) -> DataFrame:
    """Total sales per store region, largest first.

    The lesson's cartesian-then-filter form (C6) is the same plan (a test shows
    it): Catalyst turns ``crossJoin().filter(a == b)`` into an equi join.  Sales are
    partial-summed per store before the join would ever need to move them.
    """
    per_store = sales.groupBy("store_id").agg(
        F.sum(F.col("total_amount").cast("decimal(38,10)")).alias("total_amount"))
    j = per_store.join(stores.select("store_id", "region"), "store_id", "inner")
    return (j.groupBy("region").agg(F.sum("total_amount").cast("double").alias("total_amount"))
            .orderBy(F.col("total_amount").desc_nulls_last(), "region"))

