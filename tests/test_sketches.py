"""Mergeable sketches against exact counts and ranks."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from larder.operators import sketches as sk
from larder.plans import demand


def days(spark, n, per_day):
    """(day, value): each day has ``per_day`` values, which overlap with the next day's by half."""
    rows = spark.range(n * per_day).select((F.col("id") / per_day).cast("int").alias("day"), (F.col("id") % per_day).alias("i"))
    return rows.select("day", (F.col("day") * (per_day // 2) + F.col("i")).alias("value"))


@pytest.mark.parametrize("log_k, per_day", [(12, 2000), (14, 20000), (17, 20000)])
def test_merged_counts_are_within_the_stated_error(spark, log_k, per_day):
    rows = days(spark, 12, per_day)
    sketches = sk.daily(rows, "day", ["value"], log_k)
    for by, n in ((F.lit(0), 1), (F.floor(F.col("day") / 3), 4)):
        got = {r.g: r.n for r in sk.estimates(sketches.withColumn("g", by), ["g"], {"value": "n"}).collect()}
        want = {r.g: r.n for r in rows.withColumn("g", by).groupBy("g").agg(F.countDistinct("value").alias("n")).collect()}
        assert set(got) == set(want) and len(want) == n
        # four standard errors; a wrong merge (sums of days, say) is off by half
        assert all(abs(got[g] / want[g] - 1) < 4 * 1.04 / math.sqrt(2**log_k) for g in want)


def test_few_values_count_exactly_and_nulls_do_not(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "b"), (1, None), (2, "b"), (2, "c"), (3, None)], "day int, v string")
    sketches = sk.daily(rows, "day", ["v"])
    assert {r.day: r.n for r in sk.estimates(sketches, ["day"], {"v": "n"}).collect()} == {1: 2, 2: 2, 3: 0}
    assert sk.estimates(sketches.withColumn("g", F.lit(1)), ["g"], {"v": "n"}).first().n == 3
    assert sk.estimates(sk.daily(rows.limit(0), "day", ["v"]), ["day"], {"v": "n"}).collect() == []


def test_no_exact_distinct_in_the_plan(spark):
    df = demand.q_distinct_estimate(spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "hll_union_agg" in plan and "distinct" not in plan.lower().replace("_distinct", "") and "lineitem" not in plan


def test_merged_quantiles_have_the_stated_ranks(spark):
    rng = np.random.default_rng(3)
    values = np.concatenate([rng.lognormal(size=60_000), np.zeros(20_000), rng.integers(0, 5, 20_000)])
    rng.shuffle(values)
    rows = spark.createDataFrame([("a" if i % 3 else "b", i % 17, float(v)) for i, v in enumerate(values)] + [("c", 1, None), ("d", 1, 2.5)], "g string, day int, v double")
    merged = sk.merged_quantiles(sk.quantile_sketches(rows, ["g", "day"], "v"), ["g"])
    found = sk.quantiles(merged, ["g"], [0.0, 0.1, 0.5, 0.9, 0.99, 1.0])
    for r in found.collect():
        own = np.sort(np.array([2.5] if r.g == "d" else [v for i, v in enumerate(values) if ("a" if i % 3 else "b") == r.g]))
        assert r.n == len(own)
        slack = sk.RANK_ERROR * len(own) + 1
        assert np.searchsorted(own, r.value, "left") <= r.q * len(own) + slack and np.searchsorted(own, r.value, "right") >= r.q * len(own) - slack
    assert {r.g for r in found.collect()} == {"a", "b", "d"}
    checked = sk.rank_check(rows.filter("v is not null"), found, "g", "v").collect()
    assert len(checked) == 18 and all(r.low_enough and r.high_enough for r in checked)
    wrong = found.withColumn("value", F.col("value") + 1)
    assert not all(r.low_enough and r.high_enough for r in sk.rank_check(rows.filter("v is not null"), wrong, "g", "v").collect())


def test_two_digits(spark):
    want = {0: 0, 7: 7, 99: 99, 100: 100, 104: 100, 105: 110, 995: 1000, 1949: 1900, 1950: 2000, 1999: 2000, 123456: 120000}
    rows = spark.createDataFrame([(n,) for n in want], "n long").select("n", sk.two_digits(F.col("n")).alias("m")).collect()
    assert {r.n: r.m for r in rows} == want
