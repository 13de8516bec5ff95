"""Mergeable sketches: distinct counts and quantiles that are stored once and merged to any range.

A sketch has at most some 64 KB, whatever it was made from.  Partial sketches are made where the rows are,
so a shuffle moves sketches; those of days merge to those of a month, a year or all time, and the
rows needn't be read again.

Distinct counts: HyperLogLog with ``2**LOG_K`` registers, a relative standard error of about
1.04 / sqrt(2**LOG_K) = 0.3 %; up to about 12,000 values it holds their hashes and is all but exact.
Quantiles: KLL, whose values' ranks are off by up to ``RANK_ERROR`` of the count (99 % sure).

Cases: nulls don't count and have no rank; a group of nulls only has no distinct value, and no
quantile sketch; an empty table has no group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LOG_K = 17
#: Size of the quantile sketches, and the normalised rank error that belongs to it (with some room).
KLL_K, RANK_ERROR = 400, 0.01


def daily(rows: DataFrame, day: str, columns: list[str], log_k: int = LOG_K) -> DataFrame:
    """One row a day: a sketch of each column's distinct values, under the column's name."""
    return rows.groupBy(day).agg(*[F.hll_sketch_agg(c, log_k).alias(c) for c in columns])


def write(sketches: DataFrame, path: str) -> None:
    """Days are few and sketches small: one file each task that has some."""
    sketches.write.mode("overwrite").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def estimates(sketches: DataFrame, by: list[str], named: dict[str, str]) -> DataFrame:
    """Distinct counts of groups of sketches, under the given names."""
    union = sketches.groupBy(*by).agg(*[F.hll_union_agg(c).alias(c) for c in named])
    return union.select(*by, *[F.hll_sketch_estimate(c).alias(n) for c, n in named.items()])


def two_digits(n: Column) -> Column:
    """A count to two significant digits, halves up: what an estimate of this error can promise."""
    unit = F.pow(F.lit(10.0), F.greatest(F.length(n.cast("string")) - 2, F.lit(0))).cast("long")
    return F.floor((n + F.floor(unit / 2)) / unit).cast("long") * unit


def quantile_sketches(rows: DataFrame, by: list[str], value: str, k: int = KLL_K) -> DataFrame:
    """A quantile sketch of each group that has values."""
    return rows.filter(F.col(value).isNotNull()).groupBy(*by).agg(F.kll_sketch_agg_double(F.col(value).cast("double"), F.lit(k)).alias("sketch"))


def merged_quantiles(sketches: DataFrame, by: list[str]) -> DataFrame:
    return sketches.groupBy(*by).agg(F.kll_merge_agg_double("sketch").alias("sketch"))


def quantiles(sketches: DataFrame, by: list[str], wanted: list[float]) -> DataFrame:
    """(by, q, n, value) of each group and wanted quantile."""
    values = F.array(*[F.struct(F.lit(q).alias("q"), F.kll_sketch_get_quantile_double("sketch", F.lit(q)).alias("value")) for q in wanted])
    return sketches.select(*by, F.kll_sketch_get_n_double("sketch").alias("n"), F.inline(values))


def rank_check(rows: DataFrame, found: DataFrame, by: str, value: str, error: float = RANK_ERROR) -> DataFrame:
    """(by, q, n, low_enough, high_enough): do the true ranks of found values lie within the stated error of ``q``?

    One pass counts the rows below and up to each value; a group's values are an array of a few numbers.
    """
    per = found.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("q", "value"))).alias("found"), F.max("n").alias("n"))
    at = rows.join(F.broadcast(per), by).select(by, "n", F.col(value).cast("double").alias("x"), F.explode("found").alias("f"))
    counts = at.groupBy(by, "n", F.col("f.q").alias("q")).agg(F.sum((F.col("x") < F.col("f.value")).cast("long")).alias("below"),
                                                              F.sum((F.col("x") <= F.col("f.value")).cast("long")).alias("up_to"))
    slack = error * F.col("n") + 1
    return counts.select(by, "q", "n", (F.col("below") <= F.col("q") * F.col("n") + slack).alias("low_enough"),
                         (F.col("up_to") >= F.col("q") * F.col("n") - slack).alias("high_enough"))
