"""Silver + dimensions -> gold feature set (ops C1-C3) and its fan-out audit.

The sale lines, by far the widest rows, move once: products and competitor scrapes are
gathered to one row per product (a product's scrapes as a map by day), so both joins go
by the product alone, and the stores (some 100 bytes each) are sent to every task.  Rows
stay dealt by product; a window over series of a product needs no further exchange.

Products with more lines than one task should hold (``heavy_products``) are joined apart:
there are few of them, so their rows of the dimension go to the lines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

GOLD_COLUMNS = [
    "transaction_id", "line_number", "store_id", "product_id", "quantity", "unit_price",
    "discount", "total_amount", "payment_type", "channel", "loyalty_id", "transaction_ts",
    "event_date", "sku", "product_name", "category", "brand", "base_price", "product_unit",
    "store_name", "store_manager_id", "address", "store_city", "store_state", "competitor",
    "competitor_price", "competitor_scrape_ts", "competitor_event_date",
]


#: Lines of a product that one task holds at most.
HEAVY = 1_000_000


def heavy_products(lines: DataFrame, most: int = HEAVY) -> DataFrame:
    """(product_id) of the products with more than ``most`` lines: lines / ``most`` rows at the most."""
    n = lines.groupBy("product_id").agg(F.count(F.lit(1)).alias("n"))
    return n.filter(F.col("product_id").isNotNull() & (F.col("n") > most)).select("product_id")


def product_days(products: DataFrame, competitor: DataFrame) -> DataFrame:
    """(product_id, rows, days): a product's dimension rows and, by day, its scrapes of that day.

    One exchange for both tables.  A list holds a product's scrapes, never its sales: as many
    as there are days and competitors.
    """
    p = products.select("product_id", F.struct("sku", F.col("name").alias("product_name"), "category", "brand", "base_price",
                                               F.col("unit").alias("product_unit")).alias("row"))
    c = competitor.filter("event_date is not null").select(
        "product_id", F.col("event_date").alias("day"),
        F.struct("competitor", F.col("price").alias("competitor_price"), F.col("scrape_ts").alias("competitor_scrape_ts"),
                 F.col("event_date").alias("competitor_event_date")).alias("scrape"))
    both = p.unionByName(c, allowMissingColumns=True).filter("product_id is not null").repartition("product_id")
    daily = both.groupBy("product_id", "day").agg(F.collect_list("row").alias("rows"), F.collect_list("scrape").alias("scrapes"))
    return daily.groupBy("product_id").agg(
        F.flatten(F.collect_list("rows")).alias("rows"),
        F.map_from_entries(F.collect_list(F.when(F.col("day").isNotNull(), F.struct("day", "scrapes")))).alias("days"))


def gold_parts(sales: DataFrame, products: DataFrame, stores: DataFrame, competitor: DataFrame,
               heavy: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Gold rows of the products that aren't in ``heavy``, dealt by product, and of those that are, spread."""
    few = F.broadcast(heavy)
    days = product_days(products, competitor)
    rest = _joined(sales.join(few, "product_id", "left_anti"), days, stores)
    return rest, _joined(sales.join(few, "product_id", "left_semi"), F.broadcast(days.join(few, "product_id", "left_semi")), stores)


def gold_feature_set(sales: DataFrame, products: DataFrame, stores: DataFrame,
                     competitor: DataFrame, heavy: DataFrame | None = None) -> DataFrame:
    """28-column gold rows: one per sale line and competitor seen that day.

    A line with no competitor that day keeps one row with NULL competitor
    columns.  ``store_manager_id`` and ``address`` are not in the store
    dimension and stay typed NULLs so the column contract holds.  ``heavy`` may
    be ``heavy_products`` of any frame with the lines of the sales, or of more.
    """
    rest, spread = gold_parts(sales, products, stores, competitor, heavy_products(sales) if heavy is None else heavy)
    return rest.unionByName(spread)


def _joined(sales: DataFrame, days: DataFrame, stores: DataFrame) -> DataFrame:
    st = stores.select("store_id", F.col("name").alias("store_name"),
                       F.col("city").alias("store_city"),
                       F.col("state").alias("store_state"))
    j = (sales.join(days, "product_id", "left").join(F.broadcast(st), "store_id", "left")
         .select(*sales.columns, "store_name", "store_city", "store_state", F.explode_outer("rows").alias("row"), "days")
         .select(*sales.columns, "store_name", "store_city", "store_state", "row.*",
                 F.inline_outer(F.col("days")[F.col("event_date")])))
    return j.withColumns({"store_manager_id": F.lit(None).cast("bigint"), "address": F.lit(None).cast("string")}).select(*GOLD_COLUMNS)


def fanout_audit(gold: DataFrame) -> DataFrame:
    """One row: how much the competitor join multiplies the sale lines.

    Every sale line survives the left joins, so the line count is the number
    of line keys in gold.  Counts are partial-aggregated map-side; the
    per-line fan-out is one aggregate keyed on the line key.
    """
    per_line = (gold.groupBy("transaction_id", "line_number")
                .agg(F.count(F.lit(1)).alias("n"),
                     F.count("competitor").alias("matched")))
    g = per_line.agg(F.count(F.lit(1)).alias("sales_lines"),
                     F.sum("n").alias("gold_rows"),
                     F.sum("matched").alias("matched_rows"),
                     F.count_if(F.col("matched") == 0).alias("unmatched_lines"),
                     F.max("n").alias("max_fanout"))
    return g.select(
        F.col("sales_lines").cast("bigint").alias("sales_lines"),
        F.col("gold_rows").cast("bigint").alias("gold_rows"),
        F.col("matched_rows").cast("bigint").alias("matched_rows"),
        F.col("unmatched_lines").cast("bigint").alias("unmatched_lines"),
        F.col("max_fanout").cast("bigint").alias("max_fanout"),
        F.round(F.col("gold_rows") / F.col("sales_lines"), 4).alias("fanout_factor"))


def gold_dedup(gold: DataFrame) -> DataFrame:
    """One gold row per sale line: the cheapest competitor (name breaks ties).

    A sale line fans out to at most one row per competitor, so the window
    partition is bounded by the number of competitors.
    """
    w = Window.partitionBy("transaction_id", "line_number").orderBy(
        F.col("competitor_price").asc_nulls_last(), F.col("competitor").asc_nulls_last())
    return gold.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")
