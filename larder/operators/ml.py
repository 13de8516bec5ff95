"""Demand model: Spark ML pipeline, search, scoring, metrics.

Everything trains on the full training split inside Spark ML; only metrics,
importances and chosen parameters reach the driver.
"""

from __future__ import annotations

import random
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import OneHotEncoder, SQLTransformer, StringIndexer, VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.ml.tuning import ParamGridBuilder
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larder.operators.features import CATEGORICAL, NUMERICAL

LABEL = "quantity"


def build_pipeline(num_trees: int = 50, max_depth: int = 10, seed: int = 42,
                   min_instances: int = 1) -> Pipeline:
    """Zero-fill numerics -> index -> one-hot (unknown = all zeros) -> assemble -> forest.

    The zero fill (B13) is a pipeline stage, so scoring applies the same rule.
    Unknown values get an index of their own, the last, and the encoder leaves
    out the last slot, so their vector is all zeros.
    """
    fill = SQLTransformer(statement="SELECT *, " + ", ".join(
        f"coalesce(cast({c} AS DOUBLE), 0.0) AS {c}_f" for c in NUMERICAL) + " FROM __THIS__")
    idx = [StringIndexer(inputCol=c, outputCol=f"{c}_idx", handleInvalid="keep",
                         stringOrderType="frequencyDesc") for c in CATEGORICAL]
    ohe = OneHotEncoder(inputCols=[f"{c}_idx" for c in CATEGORICAL],
                        outputCols=[f"{c}_encoded" for c in CATEGORICAL],
                        dropLast=True, handleInvalid="error")
    asm = VectorAssembler(inputCols=[f"{c}_f" for c in NUMERICAL] + [f"{c}_encoded" for c in CATEGORICAL],
                          outputCol="features", handleInvalid="keep")
    rf = RandomForestRegressor(featuresCol="features", labelCol=LABEL, numTrees=num_trees,
                               maxDepth=max_depth, seed=seed, featureSubsetStrategy="all",
                               minInstancesPerNode=min_instances, checkpointInterval=10)
    return Pipeline(stages=[fill] + idx + [ohe, asm, rf])


def regression_metrics(pred: DataFrame, label: str = LABEL, prediction: str = "prediction") -> DataFrame:
    """RMSE, MAE and R² in one aggregate pass.

    R² = 1 - SSE / SST with SST = n * population variance of the label.
    """
    y, p = F.col(label).cast("double"), F.col(prediction).cast("double")
    e = y - p
    a = pred.agg(F.count(F.lit(1)).alias("n"), F.sum(e * e).alias("sse"), F.avg(F.abs(e)).alias("mae"),
                 F.var_pop(y).alias("vy"))
    return a.select(
        F.col("n").cast("bigint").alias("n"),
        F.sqrt(F.col("sse") / F.col("n")).alias("rmse"),
        F.col("mae"),
        (F.lit(1.0) - F.try_divide(F.col("sse"), F.col("vy") * F.col("n"))).alias("r2"))


def error_quantiles(pred: DataFrame, label: str = LABEL, prediction: str = "prediction") -> DataFrame:
    """Mean, median and P90 of absolute error, exact with linear interpolation.

    Equal errors are counted first.  Counts per bucket, a bucket being a range of
    the error's logarithm, tell which buckets hold the ranks; only those are
    ordered, so no task sees all errors.
    """
    err = F.abs(F.col(label).cast("double") - F.col(prediction).cast("double"))
    counts = pred.select(err.alias("e")).filter("e is not null").groupBy("e").agg(F.count(F.lit(1)).alias("n"))
    bucket = F.when(F.col("e") == 0, F.lit(-(2**31))).otherwise(F.floor(F.log2("e") * 1024)).cast("long")
    counts = counts.withColumn("bucket", bucket)
    ordered = Window.partitionBy(F.lit(0)).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    per = counts.groupBy("bucket").agg(F.sum("n").alias("m"), F.sum(F.col("e") * F.col("n")).alias("s"))
    per = per.withColumn("before", F.coalesce(F.sum("m").over(ordered), F.lit(0)))
    every = Window.partitionBy(F.lit(0))
    per = per.withColumn("total", F.sum("m").over(every)).withColumn("mean", F.sum("s").over(every) / F.col("total"))
    place = {q: F.lit(q) * (F.col("total") - 1) for q in (0.5, 0.9)}
    wanted = F.array(*[x for q in place.values() for x in (F.floor(q), F.ceil(q))])
    per = per.withColumn("want", wanted).filter(F.exists("want", lambda r: (r >= F.col("before")) & (r < F.col("before") + F.col("m"))))
    inner = Window.partitionBy("bucket").orderBy("e").rowsBetween(Window.unboundedPreceding, -1)
    hits = counts.join(per.select("bucket", "before", "total", "mean"), "bucket")
    hits = hits.withColumn("from", F.col("before") + F.coalesce(F.sum("n").over(inner), F.lit(0)))

    def at(rank):
        return F.max(F.when((rank >= F.col("from")) & (rank < F.col("from") + F.col("n")), F.col("e")))

    one = hits.groupBy("total", "mean").agg(*[f(F.lit(q) * (F.col("total") - 1)) for q in (0.5, 0.9)
                                             for f in (lambda x: at(F.floor(x)), lambda x: at(F.ceil(x)))])
    one = one.toDF("total", "mean", "lo5", "hi5", "lo9", "hi9")

    def between(q, lo, hi):
        x = F.lit(q) * (F.col("total") - 1)
        return F.col(lo) + (F.col(hi) - F.col(lo)) * (x - F.floor(x))

    return one.select(F.col("mean").alias("mean_abs_error"), between(0.5, "lo5", "hi5").alias("median_abs_error"),
                      between(0.9, "lo9", "hi9").alias("p90_abs_error"))


def category_mean_predictor(split_df: DataFrame, key: str = "category") -> DataFrame:
    """Deterministic baseline: test rows scored with their key's train mean.

    Keys unseen in training get the overall train mean.  Sums and counts per
    key (one row per key) give both, and join back in the same job.
    """
    train = split_df.filter(F.col("split") == "train")
    y = F.col(LABEL).cast("double")
    sums = train.groupBy(key).agg(F.sum(y).alias("s"), F.count(y).alias("c"))
    means = sums.select(F.col(key).alias("__key"), (F.col("s") / F.col("c")).alias("key_mean"))
    overall = sums.agg((F.sum("s") / F.sum("c")).alias("overall_mean"))
    test = split_df.filter(F.col("split") == "test")
    scored = test.join(means, F.col(key) == F.col("__key"), "left").drop("__key").crossJoin(F.broadcast(overall))
    return scored.withColumn("prediction", F.coalesce("key_mean", "overall_mean"))


def one_hot(df: DataFrame, index: DataFrame, column: str) -> DataFrame:
    """``df`` with ``<column>_idx`` and the one set slot ``<column>_slot`` of its one-hot vector (K2).

    ``index`` is ``category_index``.  A value that the index doesn't know gets the
    index after the last and no slot: its vector is all zeros.
    """
    own = index.filter(F.col("column_name") == column).select(F.col("value").alias("__value"), F.col("idx").alias("__idx"))
    size = own.agg(F.count(F.lit(1)).cast("int").alias("__size"))
    out = df.join(own, F.col(column).cast("string").eqNullSafe(F.col("__value")), "left").crossJoin(F.broadcast(size))
    return out.withColumns({f"{column}_idx": F.coalesce("__idx", "__size"), f"{column}_slot": F.col("__idx")}).drop("__value", "__idx", "__size")


def param_grid(pipeline: Pipeline):
    """27-point grid: trees x depth x min instances per node (K9)."""
    rf = pipeline.getStages()[-1]
    return (ParamGridBuilder()
            .addGrid(rf.numTrees, [20, 50, 100])
            .addGrid(rf.maxDepth, [5, 10, 15])
            .addGrid(rf.minInstancesPerNode, [1, 2, 4])
            .build())


def prepare(train: DataFrame, pipeline: Pipeline | None = None):
    """The fitted preprocessing of a pipeline, and its last stage (the forest), as it is."""
    stages = (pipeline or build_pipeline()).getStages()
    return Pipeline(stages=stages[:-1]).fit(train), stages[-1]


def search(train: DataFrame, val: DataFrame, trials: int = 10, seed: int = 42,
           pipeline: Pipeline | None = None, parallelism: int = 4):
    """Seeded random search: ``trials`` points of the grid, scored by validation RMSE.

    Preprocessing is fitted once and the assembled rows are kept for all trials;
    ``parallelism`` trials are under way at a time, each a distributed job.
    Returns (best_params, [(params, rmse)...]).
    """
    pipeline = pipeline or build_pipeline()
    grid = param_grid(pipeline)
    picks = random.Random(seed).sample(range(len(grid)), min(trials, len(grid)))
    ready, forest = prepare(train, pipeline)
    fit_rows = ready.transform(train).select("features", LABEL).persist()
    val_rows = ready.transform(val).select("features", LABEL).persist()

    def trial(i):
        rmse = regression_metrics(forest.fit(fit_rows, grid[i]).transform(val_rows)).first()["rmse"]
        return {p.name: v for p, v in grid[i].items()}, rmse

    try:
        with ThreadPool(parallelism) as pool:
            results = pool.map(inheritable_thread_target(trial), picks)
    finally:
        fit_rows.unpersist()
        val_rows.unpersist()
    best = min(results, key=lambda r: (r[1], sorted(r[0].items())))
    return best[0], results


def feature_importances(model: PipelineModel, scored: DataFrame, top: int = 10) -> list[tuple[str, float]]:
    """Importance per named feature slot, largest first."""
    rf = model.stages[-1]
    meta = scored.schema["features"].metadata.get("ml_attr", {}).get("attrs", {})
    names = {}
    for group in meta.values():
        for a in group:
            names[a["idx"]] = a["name"]
    imp = rf.featureImportances.toArray()
    pairs = [(names.get(i, f"f{i}"), float(v)) for i, v in enumerate(imp)]
    return sorted(pairs, key=lambda p: (-p[1], p[0]))[:top]


def log_run_metrics(spark: SparkSession, path: str, run_id: str, metrics: dict[str, float],
                    params: dict | None = None) -> None:
    """Append (run_id, kind, name, value, text) rows to the run-metrics table.

    Numbers are in ``value``; parameters are in ``text`` as well, as they were given.
    """
    number = lambda v: float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else None
    rows = [(run_id, "metric", k, float(v), None) for k, v in metrics.items()]
    rows += [(run_id, "param", k, number(v), str(v)) for k, v in (params or {}).items()]
    df = spark.createDataFrame(rows, "run_id string, kind string, name string, value double, text string")
    df.write.mode("append").parquet(path)


def random_holdout(df: DataFrame, fractions=(0.7, 0.3), seed: int = 42) -> list[DataFrame]:
    """Random split by the given fractions (B16), e.g. keep 30 %, then 70/30 of that.

    ``randomSplit`` samples each partition with the seed, so the split is
    stable for a fixed input layout; ``hash_sample`` gives a layout-free one.
    """
    return df.randomSplit(list(fractions), seed=seed)


def refit_and_compare(train: DataFrame, validation: DataFrame, best_params: dict, baseline_rmse: float,
                      pipeline: Pipeline | None = None) -> dict:
    """Refit at the chosen parameters and compare with the baseline on the validation split.

    Returns the validation metrics plus ``rmse_change_pct`` = (new - baseline) / baseline * 100.
    Scoring keeps every input column, so ids travel with the predictions (K7).
    """
    pipeline = pipeline or build_pipeline()
    rf = pipeline.getStages()[-1]
    params = {getattr(rf, k): v for k, v in best_params.items()}
    model = pipeline.fit(train, params)
    m = regression_metrics(model.transform(validation)).first().asDict()
    m["rmse_change_pct"] = (m["rmse"] - baseline_rmse) / baseline_rmse * 100.0 if baseline_rmse else None
    return m
