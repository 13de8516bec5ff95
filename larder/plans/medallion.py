"""Materialise the medallion tables (what a scheduled job writes).

Silver and gold are written partitioned by ``event_date`` so date-range
queries prune whole folders; the dimensions are written once.  Writing a
table also cuts lineage: later jobs read files, not the raw-to-gold plan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from larder.operators import gold, silver
from larder.sources import fixtures as fx


def _by_date(df: DataFrame, *tiebreak: str) -> DataFrame:
    """Range-partition on (date, key) before a date-partitioned write.

    Each task then holds a contiguous slice of dates, so it writes few files;
    and because boundaries come from a sample of the keys, one very large
    date is split over several tasks instead of landing in one.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartitionByRange(n, "event_date", *tiebreak)


def write_sales_silver(spark: SparkSession, sf_dir: str, path: str) -> str:
    """Silver sales only, partitioned by date."""
    (_by_date(silver.clean_sales(fx.sales_raw(spark, sf_dir)), "transaction_id", "line_number")
     .write.mode("overwrite").partitionBy("event_date").parquet(path))
    return path


def write_medallion(spark: SparkSession, sf_dir: str, root: str) -> dict[str, str]:
    """Write bronze, silver, dimensions and gold under ``root``; return their paths."""
    paths = {n: f"{root.rstrip('/')}/{n}" for n in
             ("sales_bronze", "competitor_bronze", "sales_silver", "competitor_silver", "products", "stores",
              "gold")}
    fx.sales_raw(spark, sf_dir).write.mode("overwrite").parquet(paths["sales_bronze"])
    fx.competitor_raw(spark, sf_dir).write.mode("overwrite").parquet(paths["competitor_bronze"])
    sales_b = spark.read.parquet(paths["sales_bronze"])
    comp_b = spark.read.parquet(paths["competitor_bronze"])
    (_by_date(silver.clean_sales(sales_b), "transaction_id", "line_number")
     .write.mode("overwrite").partitionBy("event_date")
     .parquet(paths["sales_silver"]))
    (_by_date(silver.clean_competitor(comp_b), "product_id", "competitor")
     .write.mode("overwrite").partitionBy("event_date")
     .parquet(paths["competitor_silver"]))
    fx.products(spark, sf_dir).write.mode("overwrite").parquet(paths["products"])
    fx.stores(spark, sf_dir).write.mode("overwrite").parquet(paths["stores"])
    g = gold.gold_feature_set(spark.read.parquet(paths["sales_silver"]), spark.read.parquet(paths["products"]),
                              spark.read.parquet(paths["stores"]), spark.read.parquet(paths["competitor_silver"]))
    (_by_date(g, "transaction_id", "line_number", "competitor")
     .write.mode("overwrite").partitionBy("event_date").parquet(paths["gold"]))
    return paths
