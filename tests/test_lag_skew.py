"""The lag over moments equals the plain window lag, also when one series dominates."""

from pyspark.sql import functions as F

from conftest import SF_SMOKE
from larder.operators import features as ft
from larder.operators import gold
from larder.plans.retail import competitor, fx, gold_parts, gold_rows, sales

COLS = ft.LINE_KEY + ["quantity_lag_1", "quantity_lag_7"]


def _same(a, b):
    return a.select(*COLS).exceptAll(b.select(*COLS)).count() == 0 and \
        b.select(*COLS).exceptAll(a.select(*COLS)).count() == 0


def _skewed(spark):
    # a third of all rows in one (store, product) series, some of them without a time or quantity
    g = gold_rows(spark, SF_SMOKE)
    h = F.abs(F.hash("transaction_id"))
    hot = h % 3 == 0
    return (g.withColumn("store_id", F.when(hot, F.lit("S0")).otherwise(F.col("store_id")))
            .withColumn("product_id", F.when(hot, F.lit("P0")).otherwise(F.col("product_id")))
            .withColumn("quantity", F.when(h % 5 != 0, F.col("quantity")))
            .withColumn("event_date", F.when(h % 7 != 0, F.col("event_date"))))


def test_lag_equals_window_lag(spark):
    g = gold_rows(spark, SF_SMOKE)
    assert _same(ft.lag_features(g), ft.lag_features_window(g))


def test_lag_of_a_dominant_series(spark):
    skewed = _skewed(spark)
    assert _same(ft.lag_features(skewed), ft.lag_features_window(skewed))


def test_dominant_series_is_spread_over_tasks(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        hot = ft.lag_features(_skewed(spark)).filter("store_id = 'S0' and product_id = 'P0'")
        assert hot.groupBy(F.spark_partition_id().alias("p")).count().count() > 1
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_lag_without_rows(spark):
    assert ft.lag_features(gold_rows(spark, SF_SMOKE).limit(0)).count() == 0


def test_lag_of_parts_equals_lag_of_all(spark):
    """Series of heavy products over their moments, the others by window."""
    lines = sales(spark, SF_SMOKE)
    heavy = gold.heavy_products(lines, 30)
    assert 0 < heavy.count() < lines.select("product_id").distinct().count()
    rest, spread = gold.gold_parts(lines, fx.products(spark, SF_SMOKE), fx.stores(spark, SF_SMOKE), competitor(spark, SF_SMOKE), heavy)
    want = ft.feature_table(gold_rows(spark, SF_SMOKE))
    assert rest.count() and spread.count()
    assert _same(ft.feature_table(rest, spread), want) and _same(ft.lag_features_parts(rest, spread), ft.lag_features_window(gold_rows(spark, SF_SMOKE)))


def test_lag_of_small_products_moves_no_row(spark):
    rest = gold_parts(spark, SF_SMOKE)[0]
    exchanges = lambda df: df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
    assert exchanges(ft.lag_features_window(rest)) == exchanges(rest)
