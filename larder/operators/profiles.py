"""Data profiling and demand summaries (ops B11, B15, B18, D4-D14).

Each profile is one aggregate pass (map-side partial, one tiny shuffle); the
long (one row per column) forms are produced by exploding the single
aggregated row, never by re-scanning per column.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

PROFILE_NUMERIC = ["quantity", "unit_price", "discount", "total_amount", "base_price",
                   "competitor_price"]


def missing_profile(df: DataFrame) -> DataFrame:
    """Missing values of every column in one pass.

    Numeric columns count NULL or NaN, others NULL only.
    """
    aggs = []
    for f in df.schema.fields:
        c = F.col(f.name)
        miss = c.isNull() | F.isnan(c) if isinstance(f.dataType, NumericType) else c.isNull()
        aggs.append(F.count_if(miss).cast("bigint").alias(f.name))
    one = df.agg(*aggs)
    pairs = F.array(*[F.struct(F.lit(n).alias("column_name"), F.col(n).alias("missing_count"))
                      for n in df.columns])
    return one.select(F.inline(pairs))


def numeric_profile(df: DataFrame, cols: list[str] = PROFILE_NUMERIC) -> DataFrame:
    """count, mean, stddev (sample), min, max per column, typed."""
    aggs = []
    for c in cols:
        x = F.col(c).cast("double")
        aggs += [F.count(x).alias(f"{c}__n"), F.avg(x).alias(f"{c}__mean"),
                 F.stddev_samp(x).alias(f"{c}__sd"), F.min(x).alias(f"{c}__min"),
                 F.max(x).alias(f"{c}__max")]
    one = df.agg(*aggs)
    rows = F.array(*[F.struct(F.lit(c).alias("column_name"),
                              F.col(f"{c}__n").cast("bigint").alias("count"),
                              F.col(f"{c}__mean").alias("mean"),
                              F.col(f"{c}__sd").alias("stddev"),
                              F.col(f"{c}__min").alias("min"),
                              F.col(f"{c}__max").alias("max")) for c in cols])
    return one.select(F.inline(rows))


def date_range_profile(df: DataFrame) -> DataFrame:
    """Date ranges of sale and competitor dates (D6, D7 both written out)."""
    return df.agg(F.min("event_date").alias("min_date"), F.max("event_date").alias("max_date"),
                  F.min("competitor_event_date").alias("min_competitor_date"),
                  F.max("competitor_event_date").alias("max_competitor_date"))


def distinct_profile(df: DataFrame, lines: DataFrame) -> DataFrame:
    """Exact distinct products/stores/categories and two means.

    Products and stores are those of the sale lines, which the joined rows
    repeat; each count is a distinct of its own with map-side partials, and the
    joined rows are read once, for the categories and the means.
    """
    per = df.groupBy("category").agg(F.sum("quantity").alias("q"), F.count("quantity").alias("nq"),
                                     F.sum("total_amount").alias("t"), F.count("total_amount").alias("nt"))
    one = per.agg(F.count("category").alias("n_categories"), (F.sum("q") / F.sum("nq")).alias("avg_quantity"),
                  (F.sum("t") / F.sum("nt")).alias("avg_total_amount"))
    for c, name in (("product_id", "n_products"), ("store_id", "n_stores")):
        one = one.crossJoin(lines.select(c).distinct().agg(F.count(c).alias(name)))
    return one.select("n_products", "n_stores", "n_categories", "avg_quantity", "avg_total_amount")


def daily_demand(df: DataFrame) -> DataFrame:
    """Units per day."""
    return (df.groupBy("event_date").agg(F.sum("quantity").cast("bigint").alias("total_quantity"))
            .orderBy("event_date"))


def category_demand(df: DataFrame) -> DataFrame:
    """Units per category, largest first."""
    return (df.groupBy("category").agg(F.sum("quantity").cast("bigint").alias("total_quantity"))
            .orderBy(F.col("total_quantity").desc_nulls_last(), F.col("category").asc_nulls_last()))


def channel_split(df: DataFrame) -> DataFrame:
    """Rows per channel and share of all rows.

    The share's denominator is a window over the already aggregated rows
    (one per channel), not over the input.
    """
    per = df.groupBy("channel").agg(F.count(F.lit(1)).alias("n"))
    from pyspark.sql import Window
    return per.select("channel", "n", (F.col("n") / F.sum("n").over(Window.partitionBy())).alias("share"))


def price_competitiveness(df: DataFrame) -> DataFrame:
    """Mean of our price / competitor price over rows with both."""
    both = df.dropna(subset=["unit_price", "competitor_price"])
    return both.agg(F.count(F.lit(1)).alias("n_rows"),
                    F.avg(F.try_divide(F.col("unit_price"), F.col("competitor_price")))
                    .alias("mean_price_ratio"))


def peak_demand_day(df: DataFrame) -> DataFrame:
    """Day with the most units, earliest on a tie (D14): a top-1 report."""
    return (daily_demand(df).orderBy(F.col("total_quantity").desc_nulls_last(), "event_date")
            .limit(1))


def hash_bucket(*keys: str, seed: int = 42) -> F.Column:
    """Portable 32-bit bucket of the key columns: first 8 hex digits of md5."""
    txt = F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys])
    return F.conv(F.substring(F.md5(txt), 1, 8), 16, 10).cast("bigint")


def hash_sample(df: DataFrame, fraction: float, keys: list[str], seed: int = 42) -> DataFrame:
    """Deterministic Bernoulli-style sample on a key hash.

    Unlike ``sample(fraction, seed)`` the kept rows do not depend on how the
    input is split into partitions, so reruns and other engines agree.
    """
    return df.filter(hash_bucket(*keys, seed=seed) < F.lit(int(fraction * 2 ** 32)))
