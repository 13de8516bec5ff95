"""Feature projections, fills, time split, indexing and scaling (B10, B12-B14,
E3-E4, H1-H2, K1, K3, K5).

Projections are narrow (no shuffle).  Statistics a later step needs as
constants (split dates, means, deviations) come from one aggregate row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larder.functions.columns import safe_ratio

LINE_KEY = ["transaction_id", "line_number", "competitor"]
# Total order inside a (store, product) series: the date alone has ties.
SERIES_ORDER = ["event_date", "transaction_ts", "transaction_id", "line_number", "competitor"]

# Fill defaults of the feature table.
NUMERIC_FILLS = {
    "quantity_lag_1": 0, "quantity_lag_7": 0, "price_ratio": 1.0, "discount_rate": 0.0,
    "price_vs_base": 1.0, "competitor_price": 0.0, "unit_price": 0.0, "discount": 0.0,
    "total_amount": 0.0, "base_price": 0.0,
}
STRING_FILLS = {"payment_type": "unknown", "channel": "unknown", "category": "unknown",
                "brand": "unknown", "competitor": "unknown"}
# Columns of the model.
CATEGORICAL = ["payment_type", "channel", "category", "brand", "competitor"]
NUMERICAL = ["unit_price", "discount", "base_price", "competitor_price", "day_of_week",
             "hour_of_day", "month", "week_of_year", "is_weekend", "price_ratio",
             "discount_rate", "price_vs_base", "quantity_lag_1", "quantity_lag_7"]


def calendar_features(df: DataFrame) -> DataFrame:
    """day_of_week (1 = Sunday), hour_of_day, month, ISO week, weekend flag (H1)."""
    dow = F.dayofweek("event_date")
    return df.withColumns({
        "day_of_week": dow,
        "hour_of_day": F.hour("transaction_ts"),
        "month": F.month("event_date"),
        "week_of_year": F.weekofyear("event_date"),
        "is_weekend": F.when(dow.isin(1, 7), 1).otherwise(0),
    })


def price_features(df: DataFrame) -> DataFrame:
    """Price ratios with defaults.

    A NULL numerator stays NULL (the default applies only when the
    denominator is missing or not positive); the fill step handles it later.
    """
    comp = F.col("competitor_price")
    return df.withColumns({
        "price_ratio": F.when(comp.isNotNull() & (comp > 0),
                              F.try_divide(F.col("unit_price"), comp)).otherwise(F.lit(1.0)),
        "discount_rate": safe_ratio(F.col("discount"), F.col("unit_price"), 0.0),
        "price_vs_base": safe_ratio(F.col("unit_price"), F.col("base_price"), 1.0),
    })


def lag_features(df: DataFrame, lags=(1, 7)) -> DataFrame:
    """Quantity ``n`` rows earlier in the same (store, product) series.

    The series order is made total with the line key; NULLs sort last.  Rows
    are windowed per (series, day, time), never per series, so a series with a
    third of all rows is spread over as many tasks as it has moments.  The rows
    that the first of a moment need are the last ones before it: each moment's
    last rows (at most ``max(lags)``) are handed on along the series, which is a
    window over one small row per moment.
    """
    most = max(lags)
    keys, moment = ["store_id", "product_id"], ["event_date", "transaction_ts"]
    at = [F.col(c).asc_nulls_last() for c in SERIES_ORDER if c not in moment]
    own = Window.partitionBy(*keys, *moment)
    in_moment = own.orderBy(*at)
    rows = df.withColumns({"__rn": F.row_number().over(in_moment), **{f"__lag_{n}": F.lag("quantity", n).over(in_moment) for n in lags}})
    last = (df.withColumn("__back", F.row_number().over(own.orderBy(*[F.col(c).desc_nulls_first() for c in SERIES_ORDER if c not in moment])))
            .filter(F.col("__back") <= most)
            .groupBy(*keys, *moment).agg(F.array_sort(F.collect_list(F.struct((-F.col("__back")).alias("at"), "quantity"))).alias("__tail")))
    # every moment has a row, so the moments that ``most`` rows reach back to are the ``most`` before
    series = Window.partitionBy(*keys).orderBy(*[F.col(c).asc_nulls_last() for c in moment]).rowsBetween(-most, -1)
    earlier = last.select(*[F.col(c).alias(f"__{c}") for c in keys + moment],
                          F.flatten(F.collect_list("__tail").over(series)).alias("__before"))
    same = None
    for c in keys + moment:
        one = F.col(c).eqNullSafe(F.col(f"__{c}"))
        same = one if same is None else same & one
    rows = rows.join(earlier, same, "left")
    out = {}
    for n in lags:
        back = F.size("__before") + F.col("__rn") - n  # place, from 1, among the rows before the moment
        carried = F.when(back >= 1, F.get(F.col("__before"), (back - 1).cast("int"))["quantity"])
        out[f"quantity_lag_{n}"] = F.when(F.col("__rn") > n, F.col(f"__lag_{n}")).otherwise(carried)
    return rows.withColumns(out).select(*df.columns, *out)


def lag_features_window(df: DataFrame, lags=(1, 7)) -> DataFrame:
    """Plain window form of ``lag_features``: one Window node for both lags.

    Fine while every series is small: the window sends a whole series to one
    task.  Rows that are dealt by product stay where they are.
    """
    w = Window.partitionBy("store_id", "product_id").orderBy(
        *[F.col(c).asc_nulls_last() for c in SERIES_ORDER])
    return df.withColumns({f"quantity_lag_{n}": F.lag("quantity", n).over(w) for n in lags})


def lag_features_parts(rest: DataFrame, heavy: DataFrame, lags=(1, 7)) -> DataFrame:
    """``lag_features`` of all rows, given those of small products and those of products that no task should hold.

    No product is in both, so each series is whole in one of them.
    """
    return lag_features_window(rest, lags).unionByName(lag_features(heavy, lags))


def clean_features(df: DataFrame) -> DataFrame:
    """Per-column defaults for numeric and categorical gaps."""
    return df.fillna(NUMERIC_FILLS).fillna(STRING_FILLS)


def feature_table(gold: DataFrame, heavy: DataFrame | None = None) -> DataFrame:
    """Gold (or its two parts) -> calendar, price and lag features -> filled."""
    if heavy is None:
        return clean_features(lag_features(price_features(calendar_features(gold))))
    rest, spread = (price_features(calendar_features(g)) for g in (gold, heavy))
    return clean_features(lag_features_parts(rest, spread))


def split_bounds(dates: DataFrame, train: float = 0.6, val: float = 0.2) -> DataFrame:
    """One row (lo, train_end, val_end, hi) of the dates of the rows with a target (K5).

    ``dates`` may be any frame with the model rows' dates and targets: left joins
    change neither, so the cleaned sales give the bounds of the joined rows.
    """
    b = dates.filter(F.col("quantity").isNotNull()).agg(F.min("event_date").alias("lo"), F.max("event_date").alias("hi"))
    total = F.date_diff("hi", "lo")
    b = b.withColumn("train_end", F.date_add("lo", F.floor(total * F.lit(train)).cast("int")))
    return b.select("lo", "train_end", F.date_add("train_end", F.floor(total * F.lit(val)).cast("int")).alias("val_end"), "hi")


def time_split(df: DataFrame, train: float = 0.6, val: float = 0.2, dates: DataFrame | None = None) -> DataFrame:
    """Label rows train / validation / test by date.

    train: date <= train_end; validation: (train_end, val_end]; test: later.
    Rows without a target are dropped first.  The bounds are one aggregated
    row that joins in the same job; ``dates`` as for ``split_bounds``.
    """
    model = df.filter(F.col("quantity").isNotNull())
    bounds = split_bounds(df if dates is None else dates, train, val).select(
        F.col("train_end").alias("__train_end"), F.col("val_end").alias("__val_end"))
    d = F.col("event_date")
    split = F.when(d <= F.col("__train_end"), "train").when(d <= F.col("__val_end"), "validation").otherwise("test")
    return model.crossJoin(F.broadcast(bounds)).withColumn("split", split).drop("__train_end", "__val_end")


def category_index(df: DataFrame, cols=CATEGORICAL) -> DataFrame:
    """Frequency-descending index per categorical column (K1).

    Same order as ``StringIndexer(stringOrderType="frequencyDesc")``: count
    descending, value ascending on ties; index = rank - 1.  Unknown values at
    scoring time get index = number of labels (``handleInvalid="keep"``).
    One scan: every row yields a (column, value) pair per categorical column,
    counted with map-side partials; the window runs over the counts only.
    """
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value"))
                      for c in cols])
    out = (df.select(F.inline(pairs)).groupBy("column_name", "value")
           .agg(F.count(F.lit(1)).alias("n")))
    w = Window.partitionBy("column_name").orderBy(F.col("n").desc(), F.col("value").asc_nulls_last())
    return out.withColumn("idx", (F.row_number().over(w) - 1).cast("int"))


def standard_scale(df: DataFrame, cols: list[str], keys: list[str]) -> DataFrame:
    """(x - mean) / population std per column (K3).

    The statistics are one aggregate row beside every row, so no job starts while
    the plan is built; a zero deviation scales to 0.
    """
    x = {c: F.col(c).cast("double") for c in cols}
    stats = df.agg(*[f(x[c]).alias(f"__{c}__{n}") for c in cols for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    scaled = [F.when(F.col(f"__{c}__s") > 0, (x[c] - F.col(f"__{c}__m")) / F.col(f"__{c}__s"))
              .when(F.col(f"__{c}__s").isNotNull(), F.lit(0.0)).alias(f"{c}_scaled") for c in cols]
    return df.crossJoin(F.broadcast(stats)).select(*keys, *scaled)
