"""Cleaning and gold decisions on hand-made rows and on the fixtures."""

from datetime import date, datetime

from pyspark.sql import Row
from pyspark.sql import functions as F

from conftest import SF_SMALL
from larder.operators import gold, silver
from larder.plans import retail

RAW_COLS = ["transaction_id", "line_number", "store_id", "product_id", "quantity", "unit_price",
            "discount", "total_amount", "payment_type", "channel", "loyalty_id", "transaction_ts",
            "event_date"]


def _raw(spark, rows):
    return spark.createDataFrame([Row(**dict(zip(RAW_COLS, r))) for r in rows],
                                 ", ".join(f"{c} string" for c in RAW_COLS))


def test_fixture_counts_as_written_and_strict(spark):
    # expected figures of the fixture description
    assert retail.sales(spark, SF_SMALL).count() == 56752
    assert retail.sales(spark, SF_SMALL, strict=True).count() == 54224


def test_imputation_and_zero_quantity(spark):
    rows = [
        ("T1", "1", "S1", "P1", "2", None, "1.00", "18.00", "x", "pickup", "L", "2024-01-01 10:00:00", "2024-01-01"),
        ("T2", "1", "S1", "P1", "2", "10.00", None, "18.00", "x", "pickup", "L", "2024-01-01 10:00:00", "2024-01-01"),
        ("T3", "1", "S1", "P1", "2", "10.00", "1.00", None, "x", "pickup", "L", "2024-01-01 10:00:00", "2024-01-01"),
        # two amounts missing: the formula reads raw columns, so both stay NULL
        ("T4", "1", "S1", "P1", "2", None, None, "18.00", "x", "pickup", "L", "2024-01-01 10:00:00", "2024-01-01"),
        # zero quantity: NULL instead of a division error under ANSI
        ("T5", "1", "S1", "P1", "0", None, "1.00", "18.00", "x", "pickup", "L", "2024-01-01 10:00:00", "2024-01-01"),
    ]
    out = {r.transaction_id: r for r in silver.clean_sales(_raw(spark, rows)).collect()}
    assert out["T1"].unit_price == 10.0
    assert out["T2"].discount == 1.0
    assert out["T3"].total_amount == 18.0
    assert out["T4"].unit_price is None and out["T4"].discount is None
    assert out["T5"].unit_price is None


def test_as_written_keeps_unparsable_values_strict_drops_them(spark):
    rows = [
        ("T1", "1", "S1", "P1", "bad", "1.00", "0.00", "1.00", "x", "pickup", "L", "n/a", "2024-01-01"),
        ("T2", "1", "S1", "P1", None, "1.00", "0.00", "1.00", "x", "pickup", "L", "2024-01-01 00:00:00", "2024-01-01"),
        ("T3", "x", "S1", "P1", "1", "1.00", "0.00", "1.00", "x", "pickup", "L", "2024-01-01 00:00:00", "2024-01-01"),
    ]
    loose = silver.clean_sales(_raw(spark, rows)).collect()
    assert [r.transaction_id for r in loose] == ["T1"]
    assert loose[0].quantity is None and loose[0].transaction_ts is None
    assert silver.clean_sales(_raw(spark, rows), strict=True).count() == 0


def test_gold_contract_and_fanout(spark):
    from larder.sources import fixtures as fx
    from larder.sources.files import schema_diff

    g = retail.gold_rows(spark, SF_SMALL)
    assert g.columns == gold.GOLD_COLUMNS and len(g.columns) == 28
    contract = [(f.name, f.dataType.simpleString()) for f in g.schema.fields]
    assert schema_diff(g.schema, contract) == []
    broken = contract[:-1] + [("competitor_event_date", "string")]
    assert schema_diff(g.schema, broken) == [("competitor_event_date", "string", "date")]
    audit = gold.fanout_audit(g).first()
    assert audit.sales_lines == retail.sales(spark, SF_SMALL).count()
    assert audit.gold_rows == g.count() and audit.max_fanout <= 3
    dedup = gold.gold_dedup(g)
    assert dedup.count() == audit.sales_lines
    assert fx.stores(spark, SF_SMALL).filter(F.col("region").isNull()).count() == 0


SALES_TYPES = ("transaction_id string, line_number int, store_id string, product_id string, quantity int, unit_price double, discount double, "
               "total_amount double, payment_type string, channel string, loyalty_id string, transaction_ts timestamp_ntz, event_date date")


def _small_tables(spark):
    """Repeated and null keys on every side, days and products without a match."""
    keys = [(s, p, d) for s in ("S1", "S9", None) for p in ("P1", "P2", "P3", "P9", None) for d in (0, 1, 2, 3)] + [("S1", "P1", 1)] * 3
    rows = [(f"T{i}", i % 3, s, p, i % 5, 1.0, 0.0, float(i), "x", "pickup", "L", datetime(2024, 1, 1, i % 4), date(2024, 1, d) if d else None)
            for i, (s, p, d) in enumerate(keys)]
    sales = spark.createDataFrame(rows, SALES_TYPES)
    products = spark.createDataFrame([("P1", "A"), ("P2", "B"), ("P2", "C"), (None, "D"), ("P7", "E")], "product_id string, sku string").selectExpr(
        "product_id", "sku", "'n' as name", "'c' as category", "'b' as brand", "2e0 as base_price", "'EA' as unit")
    stores = spark.createDataFrame([("S1", "a"), ("S1", "b"), (None, "c")], "store_id string, name string").selectExpr("store_id", "name", "'x' as city", "'y' as state")
    competitor = spark.createDataFrame(
        [("C0", "P1", 1.0, 1), ("C1", "P1", 2.0, 1), ("C1", "P1", 2.0, 1), ("C0", "P2", 1.0, 2), (None, "P3", None, 1), ("C0", "P3", 1.0, 0), ("C0", None, 1.0, 1), ("C0", "P9", 3.0, 3)],
        "competitor string, product_id string, price double, d int").selectExpr(
        "competitor", "product_id", "price", "timestamp_ntz '2024-01-01 06:00:00' as scrape_ts", "case when d > 0 then date_add(date '2023-12-31', d) end as event_date")
    return sales, products, stores, competitor


def test_gold_equals_the_plain_joins(spark):
    """However many products count as heavy, the rows are those of three left joins."""
    sales, products, stores, competitor = _small_tables(spark)
    for name, df in zip(("s", "p", "st", "c"), (sales, products, stores, competitor)):
        df.createOrReplaceTempView(f"plain_{name}")
    want = spark.sql("""select s.*, p.sku, p.name, p.category, p.brand, p.base_price, p.unit, st.name, cast(null as bigint), cast(null as string), st.city, st.state,
        c.competitor, c.price, c.scrape_ts, c.event_date
        from plain_s s left join plain_p p on s.product_id = p.product_id left join plain_st st on s.store_id = st.store_id
        left join plain_c c on s.product_id = c.product_id and s.event_date = c.event_date""").toDF(*gold.GOLD_COLUMNS)
    assert want.count() > sales.count()
    for heavy in (None, gold.heavy_products(sales, 0), gold.heavy_products(sales, 12)):
        got = gold.gold_feature_set(sales, products, stores, competitor, heavy)
        assert got.schema.simpleString() == want.schema.simpleString()
        assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    assert [r.product_id for r in gold.heavy_products(sales, 12).collect()] == ["P1"]


def test_gold_moves_the_sale_lines_once(spark):
    """Whatever the size of the dimensions: one exchange by product for both joins, none by day or store."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        p = retail.gold_parts(spark, SF_SMALL)[0]._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "hashpartitioning(store_id" not in p and "event_date" not in "".join(x.split(")")[0] for x in p.split("hashpartitioning(")[1:])
    assert p.count("Exchange hashpartitioning(product_id") == 3  # lines, dimension, counts of the heavy products
