"""Demand model: pipeline, determinism, metrics cross-check, search, importances, run log."""

import math

import pytest
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.sql import functions as F

from conftest import SF_SMOKE
from larder.operators import features as ft
from larder.operators import ml
from larder.plans.retail import gold_rows


@pytest.fixture(scope="module")
def splits(spark):
    s = ft.time_split(ft.feature_table(gold_rows(spark, SF_SMOKE))).persist()
    yield {k: s.filter(F.col("split") == k) for k in ("train", "validation", "test")}
    s.unpersist()


def test_split_has_no_date_leakage(splits):
    tr = splits["train"].agg(F.max("event_date")).first()[0]
    va = splits["validation"].agg(F.min("event_date"), F.max("event_date")).first()
    te = splits["test"].agg(F.min("event_date")).first()[0]
    assert tr < va[0] and va[1] < te


def test_forest_is_deterministic_and_metrics_agree(splits):
    pipe = ml.build_pipeline(num_trees=50, max_depth=10, seed=42)
    m1 = pipe.fit(splits["train"])
    p1 = m1.transform(splits["test"])
    ours = ml.regression_metrics(p1).first()
    ev = RegressionEvaluator(labelCol="quantity", predictionCol="prediction")
    assert math.isclose(ours.rmse, ev.setMetricName("rmse").evaluate(p1), rel_tol=1e-9)
    assert math.isclose(ours.mae, ev.setMetricName("mae").evaluate(p1), rel_tol=1e-9)
    assert math.isclose(ours.r2, ev.setMetricName("r2").evaluate(p1), rel_tol=1e-6)
    assert 0 < ours.rmse < 50 and ours.r2 < 1
    again = ml.regression_metrics(pipe.fit(splits["train"]).transform(splits["test"])).first()
    assert again.rmse == ours.rmse
    top = ml.feature_importances(m1, p1)
    assert len(top) == 10 and all(v >= 0 for _, v in top)
    assert top == sorted(top, key=lambda p: (-p[1], p[0]))


def test_search_picks_lowest_validation_rmse(splits):
    pipe = ml.build_pipeline(num_trees=5, max_depth=3, seed=42)
    best, results = ml.search(splits["train"], splits["validation"], trials=3, seed=7, pipeline=pipe)
    assert len(results) == 3 and len(ml.param_grid(pipe)) == 27
    assert best == min(results, key=lambda r: r[1])[0]


def test_error_quantiles_exact(spark):
    df = spark.createDataFrame([(float(y), 0.0) for y in range(1, 11)], "quantity double, prediction double")
    q = ml.error_quantiles(df).first()
    assert (q.mean_abs_error, q.median_abs_error, q.p90_abs_error) == (5.5, 5.5, 9.1)


def test_run_metrics_log_appends(spark, scratch):
    path = f"{scratch}/runs"
    ml.log_run_metrics(spark, path, "r1", {"rmse": 1.5}, {"numTrees": 50, "model_type": "forest", "tuned": True})
    ml.log_run_metrics(spark, path, "r2", {"rmse": 1.2})
    rows = {(r.run_id, r.name): (r.value, r.text) for r in spark.read.parquet(path).collect()}
    assert rows == {("r1", "rmse"): (1.5, None), ("r1", "numTrees"): (50.0, "50"), ("r1", "model_type"): (None, "forest"),
                    ("r1", "tuned"): (None, "True"), ("r2", "rmse"): (1.2, None)}


def test_unseen_category_is_all_zeros(spark, splits):
    pipe = ml.build_pipeline(num_trees=2, max_depth=2)
    model, _ = ml.prepare(splits["train"], pipe)
    row = splits["test"].limit(1).withColumn("category", F.lit("never seen"))
    encoded = model.transform(row).first()["category_encoded"]
    known = splits["train"].select("category").distinct().count()
    assert encoded.size == known and encoded.numNonzeros() == 0
    index = ft.category_index(splits["train"], ["category"])
    one = ml.one_hot(row, index, "category").first()
    assert one.category_idx == known and one.category_slot is None


def test_error_quantiles_of_awkward_errors(spark):
    import numpy as np

    values = [0.0] * 5 + [1e-12, 3.0, 3.0, 3.0, 1e9, 7.25] + [float(x) for x in range(50)]
    df = spark.createDataFrame([(v, 0.0) for v in values] + [(None, 0.0)], "quantity double, prediction double")
    q = ml.error_quantiles(df).first()
    assert math.isclose(q.median_abs_error, np.quantile(values, 0.5)) and math.isclose(q.p90_abs_error, np.quantile(values, 0.9))


def test_random_holdout_partitions_rows(spark):
    df = spark.range(2000)
    kept, _ = ml.random_holdout(df, (0.3, 0.7), seed=42)
    train, test = ml.random_holdout(kept, (0.7, 0.3), seed=42)
    assert train.count() + test.count() == kept.count()
    assert train.join(test, "id").count() == 0
    assert 400 < kept.count() < 800


def test_refit_compares_with_baseline(splits):
    pipe = ml.build_pipeline(num_trees=5, max_depth=3, seed=42)
    base = ml.regression_metrics(pipe.fit(splits["train"]).transform(splits["validation"])).first().rmse
    out = ml.refit_and_compare(splits["train"], splits["validation"], {"numTrees": 5, "maxDepth": 3,
                                                                 "minInstancesPerNode": 1}, base, pipeline=pipe)
    assert abs(out["rmse_change_pct"]) < 1e-9 and out["n"] > 0
