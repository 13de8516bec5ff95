"""Retail demand-sensing queries: medallion tables and price/region analyses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.operators import analysis, gold, silver
from larder.plans.oracle_fixtures import with_ctes
from larder.plans.registry import register
from larder.sources import fixtures as fx
from larder.sources.tables import TABLES, table

# The test data's stand-in for the lesson's "August 2025".
MONTH = (2000, 8)


def sales(spark: SparkSession, sf: str, strict: bool = False) -> DataFrame:
    return silver.clean_sales(fx.sales_raw(spark, sf), strict=strict)


def sales_lines(spark: SparkSession, sf: str, days: tuple | None = None) -> DataFrame:
    """Silver sales without the order's columns: no join, and ``days`` reaches the scan."""
    return silver.clean_sales(fx.sales_lines_raw(spark, sf, days))


def competitor(spark: SparkSession, sf: str) -> DataFrame:
    return silver.clean_competitor(fx.competitor_raw(spark, sf))


def gold_parts(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Gold rows of most products, and of those with very many lines."""
    return gold.gold_parts(sales(spark, sf), fx.products(spark, sf), fx.stores(spark, sf), competitor(spark, sf),
                           gold.heavy_products(sales_lines(spark, sf)))


def gold_rows(spark: SparkSession, sf: str) -> DataFrame:
    rest, heavy = gold_parts(spark, sf)
    return rest.unionByName(heavy)


_SALES_COLS = ("transaction_id, line_number, store_id, product_id, quantity, "
               "round(unit_price, 4) AS unit_price, round(discount, 4) AS discount, "
               "round(total_amount, 4) AS total_amount, payment_type, channel, loyalty_id, "
               "transaction_ts, event_date")


@register("silver_sales", with_ctes("sales") + f"SELECT {_SALES_COLS} FROM sales")
def q_silver_sales(spark, sf):
    """B2-B6 as written: typed, imputed, raw-presence filter."""
    return sales(spark, sf)


@register("silver_sales_strict", with_ctes("sales_strict") + f"SELECT {_SALES_COLS} FROM sales_strict")
def q_silver_sales_strict(spark, sf):
    """B6 as stated in prose: timestamp, date and quantity must also parse."""
    return sales(spark, sf, strict=True)


@register("silver_competitor", with_ctes("competitor") + """
SELECT competitor, product_id, round(price, 4) AS price, scrape_ts, event_date FROM competitor""")
def q_silver_competitor(spark, sf):
    """Strict typed cleaning of competitor scrapes."""
    return competitor(spark, sf)


@register("gold_feature_set", with_ctes("gold") + """
SELECT transaction_id, line_number, store_id, product_id, quantity, round(unit_price, 4) AS unit_price,
       round(discount, 4) AS discount, round(total_amount, 4) AS total_amount, payment_type, channel,
       loyalty_id, transaction_ts, event_date, sku, product_name, category, brand,
       round(base_price, 4) AS base_price, product_unit, store_name, store_manager_id, address,
       store_city, store_state, competitor, round(competitor_price, 4) AS competitor_price,
       competitor_scrape_ts, competitor_event_date
FROM gold""")
def q_gold_feature_set(spark, sf):
    """Sales x products x stores x competitor (fan-out kept)."""
    return gold_rows(spark, sf)


@register("gold_fanout_audit", with_ctes("gold") + """
SELECT cast(count(*) AS BIGINT) AS sales_lines, cast(sum(n) AS BIGINT) AS gold_rows,
       cast(sum(matched) AS BIGINT) AS matched_rows,
       cast(count(*) FILTER (WHERE matched = 0) AS BIGINT) AS unmatched_lines,
       cast(max(n) AS BIGINT) AS max_fanout, round(sum(n) / count(*), 4) AS fanout_factor
FROM (SELECT transaction_id, line_number, count(*) AS n, count(competitor) AS matched
      FROM gold GROUP BY transaction_id, line_number) t""")
def q_gold_fanout_audit(spark, sf):
    """How many gold rows each sale line became (decision 6)."""
    return gold.fanout_audit(gold_rows(spark, sf))


@register("sales_by_region", with_ctes("sales", "stores") + """
SELECT region, round(cast(sum(cast(total_amount AS DECIMAL(38,10))) AS DOUBLE), 4) AS total_amount
FROM sales JOIN stores ON sales.store_id = stores.store_id
GROUP BY region ORDER BY total_amount DESC""")
def q_sales_by_region(spark, sf):
    """C5 + D3 + F1: the flagship query."""
    return analysis.sales_by_region(sales_lines(spark, sf), fx.stores(spark, sf))


@register("daily_sales_month", with_ctes("sales") + f"""
SELECT event_date, round(cast(sum(cast(total_amount AS DECIMAL(38,10))) AS DOUBLE), 4) AS total_amount
FROM sales
WHERE event_date >= DATE '{MONTH[0]}-{MONTH[1]:02d}-01'
  AND event_date < DATE '{MONTH[0]}-{MONTH[1]:02d}-01' + INTERVAL 1 MONTH
GROUP BY event_date ORDER BY event_date""")
def q_daily_sales_month(spark, sf):
    """B8 + D1: one month of daily totals."""
    return analysis.daily_sales_month(sales_lines(spark, sf, analysis.month_bounds(*MONTH)), *MONTH)


@register("min_competitor_price", with_ctes("competitor") + """
SELECT product_id, event_date, round(min(price), 4) AS min_comp_price
FROM competitor GROUP BY product_id, event_date""")
def q_min_competitor_price(spark, sf):
    """Lowest competitor price per product and day."""
    return analysis.min_competitor_price(competitor(spark, sf))


_BEST_SQL = """
best AS (SELECT product_id, event_date, competitor AS best_competitor, price AS min_comp_price
         FROM (SELECT *, row_number() OVER (PARTITION BY product_id, event_date
                                            ORDER BY price ASC NULLS LAST, competitor) AS rn
               FROM competitor) t WHERE rn = 1)
"""


@register("best_competitor", with_ctes("competitor") + "," + _BEST_SQL + """
SELECT product_id, event_date, best_competitor, round(min_comp_price, 4) AS min_comp_price FROM best""")
def q_best_competitor(spark, sf):
    """Cheapest competitor per product and day."""
    return analysis.best_competitor(competitor(spark, sf))


@register("best_vendor", with_ctes("competitor", "products") + "," + _BEST_SQL + """
SELECT b.product_id, b.event_date,
       CASE WHEN p.base_price IS NOT NULL AND (b.min_comp_price IS NULL OR p.base_price <= b.min_comp_price)
            THEN 'us' ELSE b.best_competitor END AS best_vendor,
       round(CASE WHEN p.base_price IS NOT NULL AND (b.min_comp_price IS NULL OR p.base_price <= b.min_comp_price)
            THEN p.base_price ELSE b.min_comp_price END, 4) AS best_price
FROM best b LEFT JOIN products p ON b.product_id = p.product_id""")
def q_best_vendor(spark, sf):
    """B9 + C4: us or the cheapest competitor, per product and day."""
    return analysis.best_vendor(analysis.best_competitor(competitor(spark, sf)),
                                fx.products(spark, sf))


@register("row_counts", with_ctes("sales_raw", "sales", "competitor_raw", "competitor", "products",
                                  "stores") + """
SELECT 'sales_bronze' AS table_name, cast(count(*) AS BIGINT) AS n_rows FROM sales_raw
UNION ALL SELECT 'sales_silver', count(*) FROM sales
UNION ALL SELECT 'competitor_bronze', count(*) FROM competitor_raw
UNION ALL SELECT 'competitor_silver', count(*) FROM competitor
UNION ALL SELECT 'products', count(*) FROM products
UNION ALL SELECT 'stores', count(*) FROM stores""")
def q_row_counts(spark, sf):
    """Row count of every medallion table (one aggregate per table)."""
    parts = {
        "sales_bronze": fx.sales_raw(spark, sf), "sales_silver": sales(spark, sf),
        "competitor_bronze": fx.competitor_raw(spark, sf),
        "competitor_silver": competitor(spark, sf),
        "products": fx.products(spark, sf), "stores": fx.stores(spark, sf),
    }
    out = None
    for name, df in parts.items():
        c = df.agg(F.count(F.lit(1)).cast("bigint").alias("n_rows")).select(
            F.lit(name).alias("table_name"), "n_rows")
        out = c if out is None else out.unionByName(c)
    return out


@register("table_manifest", " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, cast((SELECT count(*) FROM {t}) AS BIGINT) AS n_rows, "
    f"cast((SELECT count(*) FROM information_schema.columns WHERE table_name = '{t}') AS BIGINT) "
    f"AS n_columns" for t in TABLES))
def q_table_manifest(spark, sf):
    """Rows and columns of every source table."""
    from larder.sources.files import manifest
    return manifest(spark, {t: table(spark, sf, t) for t in TABLES}).select(
        "table_name", "n_rows", "n_columns")


@register("table_files")
def q_table_files(spark, sf):
    """Files and bytes of every source table (known to the file system alone, so without SQL)."""
    from larder.sources.files import manifest
    return manifest(spark, {t: table(spark, sf, t) for t in TABLES})


@register("gold_dedup", with_ctes("gold") + """
SELECT transaction_id, line_number, competitor, round(competitor_price, 4) AS competitor_price, quantity,
       round(total_amount, 4) AS total_amount
FROM (SELECT *, row_number() OVER (PARTITION BY transaction_id, line_number
                                   ORDER BY competitor_price ASC NULLS LAST, competitor ASC NULLS LAST) AS rn
      FROM gold) t
WHERE rn = 1""")
def q_gold_dedup(spark, sf):
    """Decision 6: one gold row per sale line (the cheapest competitor)."""
    return gold.gold_dedup(gold_rows(spark, sf)).select(
        "transaction_id", "line_number", "competitor", "competitor_price", "quantity", "total_amount")
