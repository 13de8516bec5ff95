"""Demand profiling, feature and model-evaluation queries (over gold)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from larder.operators import features as ft
from larder.operators import ml, profiles
from larder.operators import sketches as sk
from larder.operators.gold import GOLD_COLUMNS
from larder.plans.oracle_fixtures import with_ctes
from larder.plans.registry import register
from larder.plans.retail import gold_parts, gold_rows, sales, sales_lines
from larder.session import stored_dir
from larder.sources.tables import state

#: Stored daily sketches: of distinct values, per column.
SKETCHED = ["product_id", "store_id"]
DISTINCTS = {"product_id": "n_products", "store_id": "n_stores"}

GOLD_DOUBLES = {"unit_price", "discount", "total_amount", "base_price", "competitor_price"}
GOLD_INTS = {"line_number", "quantity", "store_manager_id"}


def _missing_sql() -> str:
    aggs = []
    for c in GOLD_COLUMNS:
        cond = f"{c} IS NULL OR isnan({c})" if c in GOLD_DOUBLES else f"{c} IS NULL"
        aggs.append(f"count(*) FILTER (WHERE {cond}) AS {c}")
    body = ", ".join(aggs)
    rows = " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, cast({c} AS BIGINT) AS missing_count FROM m" for c in GOLD_COLUMNS)
    return with_ctes("gold") + f", m AS (SELECT {body} FROM gold)\n" + rows


@register("missing_profile", _missing_sql())
def q_missing_profile(spark, sf):
    """D4 + B18: missing values per gold column, one pass."""
    return profiles.missing_profile(gold_rows(spark, sf))


@register("numeric_profile", with_ctes("gold") + " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, cast(count({c}) AS BIGINT) AS count, round(avg({c}), 4) AS mean, "
    f"round(stddev_samp({c}), 4) AS stddev, round(cast(min({c}) AS DOUBLE), 4) AS min, "
    f"round(cast(max({c}) AS DOUBLE), 4) AS max FROM gold" for c in profiles.PROFILE_NUMERIC))
def q_numeric_profile(spark, sf):
    """count/mean/stddev/min/max of six gold columns."""
    return profiles.numeric_profile(gold_rows(spark, sf))


@register("date_range_profile", with_ctes("gold") + """
SELECT min(event_date) AS min_date, max(event_date) AS max_date,
       min(competitor_event_date) AS min_competitor_date, max(competitor_event_date) AS max_competitor_date
FROM gold""")
def q_date_range_profile(spark, sf):
    """D6 + D7: date ranges."""
    return profiles.date_range_profile(gold_rows(spark, sf))


@register("distinct_profile", with_ctes("gold") + """
SELECT count(DISTINCT product_id) AS n_products, count(DISTINCT store_id) AS n_stores,
       count(DISTINCT category) AS n_categories, round(avg(quantity), 4) AS avg_quantity,
       round(avg(total_amount), 4) AS avg_total_amount FROM gold""")
def q_distinct_profile(spark, sf):
    """D8 + D9: exact distinct counts and means."""
    return profiles.distinct_profile(gold_rows(spark, sf), sales_lines(spark, sf))


def stored_sketches(spark, sf):
    """The daily sketches of the sales as they are now; one pass over the lines writes them where there are none."""
    path = stored_dir(spark, f"daily-sketches/{state(spark, sf, 'lineitem')}")
    try:
        return sk.read(spark, path)
    except AnalysisException:
        sk.write(sk.daily(sales_lines(spark, sf), "event_date", SKETCHED), path)
        return sk.read(spark, path)


def _two_digits_sql(n: str) -> str:
    unit = f"cast(pow(10, greatest(length(cast({n} AS VARCHAR)) - 2, 0)) AS BIGINT)"
    return f"(({n} + {unit} // 2) // {unit}) * {unit}"


@register("distinct_estimate", with_ctes("sales") + f"""
, counts AS (
  SELECT strftime(event_date, '%Y-%m') AS month, count(DISTINCT product_id) AS p, count(DISTINCT store_id) AS s FROM sales GROUP BY 1
  UNION ALL SELECT 'all', count(DISTINCT product_id), count(DISTINCT store_id) FROM sales)
SELECT month, {_two_digits_sql('p')} AS n_products, {_two_digits_sql('s')} AS n_stores FROM counts""")
def q_distinct_estimate(spark, sf):
    """Distinct products and stores of each month and of all time, merged from stored daily sketches.

    Both engines give two significant digits: the oracle those of the exact counts, this query those of estimates.
    """
    days = stored_sketches(spark, sf)
    month = sk.estimates(days.withColumn("month", F.date_format("event_date", "yyyy-MM")), ["month"], DISTINCTS)
    both = month.unionByName(sk.estimates(days.withColumn("month", F.lit("all")), ["month"], DISTINCTS))
    return both.select("month", *[sk.two_digits(F.col(c)).alias(c) for c in DISTINCTS.values()])


@register("quantile_ranks", with_ctes("gold") + f"""
SELECT category, q, n, true AS low_enough, true AS high_enough FROM (
  SELECT category, cast(unnest([0.0, 0.25, 0.5, 0.75, 0.9, 1.0]) AS DOUBLE) AS q, cast(count(total_amount) AS BIGINT) AS n FROM gold
  WHERE total_amount IS NOT NULL GROUP BY category) x""")
def q_quantile_ranks(spark, sf):
    """Quantiles of each category's amounts from merged sketches, held against the rows' true ranks."""
    rows = gold_rows(spark, sf).filter("total_amount is not null")
    per_day = sk.quantile_sketches(rows, ["category", "event_date"], "total_amount")
    found = sk.quantiles(sk.merged_quantiles(per_day, ["category"]), ["category"], [0.0, 0.25, 0.5, 0.75, 0.9, 1.0])
    return sk.rank_check(rows, found, "category", "total_amount")


@register("daily_demand", with_ctes("gold") + """
SELECT event_date, cast(sum(quantity) AS BIGINT) AS total_quantity FROM gold
GROUP BY event_date ORDER BY event_date""")
def q_daily_demand(spark, sf):
    """Units per day."""
    return profiles.daily_demand(gold_rows(spark, sf))


@register("category_demand", with_ctes("gold") + """
SELECT category, cast(sum(quantity) AS BIGINT) AS total_quantity FROM gold
GROUP BY category ORDER BY total_quantity DESC, category""")
def q_category_demand(spark, sf):
    """Units per category."""
    return profiles.category_demand(gold_rows(spark, sf))


@register("channel_split", with_ctes("gold") + """
SELECT channel, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 4) AS share
FROM gold GROUP BY channel""")
def q_channel_split(spark, sf):
    """Channel counts and shares."""
    return profiles.channel_split(gold_rows(spark, sf))


@register("price_competitiveness", with_ctes("gold") + """
SELECT count(*) AS n_rows, round(avg(unit_price / NULLIF(competitor_price, 0)), 4) AS mean_price_ratio
FROM gold WHERE unit_price IS NOT NULL AND competitor_price IS NOT NULL""")
def q_price_competitiveness(spark, sf):
    """B11 + D13: mean price ratio over complete rows."""
    return profiles.price_competitiveness(gold_rows(spark, sf))


@register("peak_demand_day", with_ctes("gold") + """
SELECT event_date, cast(sum(quantity) AS BIGINT) AS total_quantity FROM gold
GROUP BY event_date ORDER BY total_quantity DESC, event_date LIMIT 1""")
def q_peak_demand_day(spark, sf):
    """Arg-max day, earliest on a tie."""
    return profiles.peak_demand_day(gold_rows(spark, sf))


@register("hash_sample", with_ctes("sales") + """
SELECT transaction_id, line_number, store_id, product_id, quantity, round(unit_price, 4) AS unit_price,
       round(discount, 4) AS discount, round(total_amount, 4) AS total_amount, payment_type, channel,
       loyalty_id, transaction_ts, event_date
FROM sales
WHERE ('0x' || substr(md5(concat_ws('|', '42', transaction_id, cast(line_number AS VARCHAR))), 1, 8))::BIGINT
      < 214748364""")
def q_hash_sample(spark, sf):
    """5 % key-hash sample of silver sales (partition-independent)."""
    return profiles.hash_sample(sales(spark, sf), 0.05, ["transaction_id", "line_number"])


_KEYS = "transaction_id, line_number, competitor"


@register("calendar_features", with_ctes("gold") + f"""
SELECT {_KEYS}, cast(dayofweek(event_date) + 1 AS INTEGER) AS day_of_week,
       cast(hour(transaction_ts) AS INTEGER) AS hour_of_day, cast(month(event_date) AS INTEGER) AS month,
       cast(weekofyear(event_date) AS INTEGER) AS week_of_year,
       CASE WHEN dayofweek(event_date) IN (0, 6) THEN 1 ELSE 0 END AS is_weekend
FROM gold""")
def q_calendar_features(spark, sf):
    """H1: calendar features per gold row."""
    return ft.calendar_features(gold_rows(spark, sf)).select(
        *ft.LINE_KEY, "day_of_week", "hour_of_day", "month", "week_of_year", "is_weekend")


_PRICE_SQL = """
CASE WHEN competitor_price IS NOT NULL AND competitor_price > 0 THEN unit_price / competitor_price ELSE 1.0 END
  AS price_ratio,
CASE WHEN unit_price > 0 THEN discount / unit_price ELSE 0.0 END AS discount_rate,
CASE WHEN base_price > 0 THEN unit_price / base_price ELSE 1.0 END AS price_vs_base"""


@register("price_features", with_ctes("gold") + f"""
SELECT {_KEYS}, round(price_ratio, 4) AS price_ratio, round(discount_rate, 4) AS discount_rate,
       round(price_vs_base, 4) AS price_vs_base
FROM (SELECT *, {_PRICE_SQL} FROM gold) t""")
def q_price_features(spark, sf):
    """H2 + B10: price ratios with defaults."""
    return ft.price_features(gold_rows(spark, sf)).select(
        *ft.LINE_KEY, "price_ratio", "discount_rate", "price_vs_base")


_SERIES = ("PARTITION BY store_id, product_id ORDER BY event_date ASC NULLS LAST, "
           "transaction_ts ASC NULLS LAST, transaction_id ASC NULLS LAST, "
           "line_number ASC NULLS LAST, competitor ASC NULLS LAST")


@register("lag_features", with_ctes("gold") + f"""
SELECT {_KEYS}, store_id, product_id, event_date, quantity,
       lag(quantity, 1) OVER ({_SERIES}) AS quantity_lag_1,
       lag(quantity, 7) OVER ({_SERIES}) AS quantity_lag_7
FROM gold""")
def q_lag_features(spark, sf):
    """E3 + E4: quantity 1 and 7 rows earlier in each (store, product) series."""
    parts = [g.select(*ft.LINE_KEY, "store_id", "product_id", "event_date", "transaction_ts", "quantity") for g in gold_parts(spark, sf)]
    return ft.lag_features_parts(*parts).select(
        *ft.LINE_KEY, "store_id", "product_id", "event_date", "quantity",
        "quantity_lag_1", "quantity_lag_7")


_CLEAN_OUT = ["transaction_id", "line_number", "competitor", "quantity_lag_1", "quantity_lag_7",
              "price_ratio", "discount_rate", "price_vs_base", "competitor_price", "unit_price",
              "discount", "total_amount", "base_price", "payment_type", "channel", "category", "brand"]


@register("clean_features", with_ctes("gold") + f"""
SELECT transaction_id, line_number, coalesce(competitor, 'unknown') AS competitor,
       coalesce(quantity_lag_1, 0) AS quantity_lag_1, coalesce(quantity_lag_7, 0) AS quantity_lag_7,
       round(coalesce(price_ratio, 1.0), 4) AS price_ratio, round(coalesce(discount_rate, 0.0), 4) AS discount_rate,
       round(coalesce(price_vs_base, 1.0), 4) AS price_vs_base,
       round(coalesce(competitor_price, 0.0), 4) AS competitor_price, round(coalesce(unit_price, 0.0), 4) AS unit_price,
       round(coalesce(discount, 0.0), 4) AS discount, round(coalesce(total_amount, 0.0), 4) AS total_amount,
       round(coalesce(base_price, 0.0), 4) AS base_price, coalesce(payment_type, 'unknown') AS payment_type,
       coalesce(channel, 'unknown') AS channel, coalesce(category, 'unknown') AS category,
       coalesce(brand, 'unknown') AS brand
FROM (SELECT *, {_PRICE_SQL},
             lag(quantity, 1) OVER ({_SERIES}) AS quantity_lag_1,
             lag(quantity, 7) OVER ({_SERIES}) AS quantity_lag_7 FROM gold) t""")
def q_clean_features(spark, sf):
    """The full feature table with per-column defaults."""
    return ft.feature_table(*gold_parts(spark, sf)).select(*_CLEAN_OUT)


_SPLIT_SQL = """
m AS (SELECT * FROM gold WHERE quantity IS NOT NULL),
b AS (SELECT min(event_date) AS lo, max(event_date) AS hi, date_diff('day', min(event_date), max(event_date)) AS total
      FROM m),
bb AS (SELECT lo, lo + cast(floor(total * 0.6) AS INTEGER) AS train_end,
              lo + cast(floor(total * 0.6) AS INTEGER) + cast(floor(total * 0.2) AS INTEGER) AS val_end FROM b),
s AS (SELECT m.*, CASE WHEN event_date <= train_end THEN 'train' WHEN event_date <= val_end THEN 'validation'
                       ELSE 'test' END AS split FROM m, bb)
"""


@register("time_split", with_ctes("gold") + "," + _SPLIT_SQL + """
SELECT split, count(*) AS n_rows, min(event_date) AS first_date, max(event_date) AS last_date
FROM s GROUP BY split""")
def q_time_split(spark, sf):
    """K5 + B14: 60/20/20 split by day count; summary per part."""
    s = ft.time_split(gold_rows(spark, sf), dates=sales_lines(spark, sf))
    return s.groupBy("split").agg(F.count(F.lit(1)).alias("n_rows"),
                                  F.min("event_date").alias("first_date"),
                                  F.max("event_date").alias("last_date"))


@register("category_index", with_ctes("gold") + " UNION ALL ".join(
    f"""SELECT column_name, value, n, cast(row_number() OVER (ORDER BY n DESC, value ASC NULLS LAST) - 1 AS INTEGER) AS idx
        FROM (SELECT '{c}' AS column_name, {c} AS value, count(*) AS n FROM gold GROUP BY {c}) t{i}"""
    for i, c in enumerate(ft.CATEGORICAL)))
def q_category_index(spark, sf):
    """K1: frequency-descending label index of each categorical column."""
    return ft.category_index(gold_rows(spark, sf))


@register("one_hot_features", with_ctes("gold") + """,
c AS (SELECT category AS v, cast(row_number() OVER (ORDER BY count(*) DESC, category ASC NULLS LAST) - 1 AS INTEGER) AS idx
      FROM gold WHERE channel <> 'pickup' GROUP BY category),
n AS (SELECT cast(count(*) AS INTEGER) AS n FROM c)
SELECT transaction_id, line_number, competitor, category, coalesce(c.idx, n.n) AS category_idx, c.idx AS category_slot
FROM gold LEFT JOIN c ON gold.category IS NOT DISTINCT FROM c.v, n""")
def q_one_hot_features(spark, sf):
    """K2: index and one-hot slot of each row's category, by the index of the sales that aren't picked up."""
    g = gold_rows(spark, sf).select(*ft.LINE_KEY, "category", "channel")
    index = ft.category_index(g.filter("channel <> 'pickup'"), ["category"])
    return ml.one_hot(g, index, "category").select(*ft.LINE_KEY, "category", "category_idx", "category_slot")


_SCALE = ["quantity", "unit_price", "discount", "total_amount"]


@register("standard_scale", with_ctes("sales") + "SELECT transaction_id, line_number, " + ", ".join(
    f"round(CASE WHEN stddev_pop({c}) OVER () > 0 THEN ({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER () "
    f"ELSE 0.0 END, 4) AS {c}_scaled" for c in _SCALE) + " FROM sales")
def q_standard_scale(spark, sf):
    """K3: zero mean, unit population deviation."""
    return ft.standard_scale(sales(spark, sf), _SCALE, ["transaction_id", "line_number"])


_PRED_SQL = """,
means AS (SELECT category, avg(cast(quantity AS DOUBLE)) AS key_mean FROM s WHERE split = 'train' GROUP BY category),
om AS (SELECT avg(cast(quantity AS DOUBLE)) AS overall FROM s WHERE split = 'train'),
p AS (SELECT cast(s.quantity AS DOUBLE) AS y, coalesce(means.key_mean, om.overall) AS yhat
      FROM s LEFT JOIN means ON s.category = means.category, om WHERE s.split = 'test')
"""


def _predictions(spark, sf):
    g = gold_rows(spark, sf).select("category", "quantity", "event_date")
    return ml.category_mean_predictor(ft.time_split(g, dates=sales_lines(spark, sf)))


@register("regression_metrics", with_ctes("gold") + "," + _SPLIT_SQL + _PRED_SQL + """
SELECT count(*) AS n, round(sqrt(sum((y - yhat) * (y - yhat)) / count(*)), 4) AS rmse,
       round(avg(abs(y - yhat)), 4) AS mae,
       round(1 - sum((y - yhat) * (y - yhat)) / (var_pop(y) * count(*)), 4) AS r2
FROM p""")
def q_regression_metrics(spark, sf):
    """RMSE/MAE/R² of the category-mean baseline on the test split."""
    return ml.regression_metrics(_predictions(spark, sf))


@register("error_quantiles", with_ctes("gold") + "," + _SPLIT_SQL + _PRED_SQL + """
SELECT round(avg(abs(y - yhat)), 4) AS mean_abs_error,
       round(quantile_cont(abs(y - yhat), 0.5), 4) AS median_abs_error,
       round(quantile_cont(abs(y - yhat), 0.9), 4) AS p90_abs_error FROM p""")
def q_error_quantiles(spark, sf):
    """Mean / median / P90 absolute error (exact percentiles)."""
    return ml.error_quantiles(_predictions(spark, sf))
