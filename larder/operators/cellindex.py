"""A stored inverted-file index of vectors with an exact stop.

Vectors are put in cells around the centres of a k-means clustering, which is fitted on a bounded
sample (``FIT_ROWS``); every vector is indexed.  A vector x of a cell with unit centre c is stored
with its length along the centre, a = x.c, and beside it, b = |x - a c|.  For a query q with
s = q.c and t = |q - s c| it holds that

    q.x = s a + (q - s c).(x - a c) <= s a + t b,

which bounds a vector's score without its components, and with the cell's extremes of a and b a
cell's.  A search scores the cells with the highest bounds until ``FIRST`` vectors are seen; the
k-th best of them is a floor.  Then it visits the cells, and in them scores the vectors, whose bound
reaches the floor.  The others can't be among the best, so the result is exact, whatever the
clustering; the clustering decides how much is scored (``scored`` tells).

Rows are stored in the order of the cells, so the cells that are visited are row groups that are read.

Cases: vectors that are null, of no components, or with a null component are not indexed; zero vectors
are; a centre of zero has length 0 along it; an empty table has no cells and no results.
"""

from __future__ import annotations

import math

from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from larder.operators.retrieval import dot

#: Rows the centres are fitted on, cells at most (their centres are broadcast), and rounds of the clustering.
FIT_ROWS, CELLS, ROUNDS, SEED = 50_000, 1024, 8, 11
#: Vectors scored before there is a floor.
FIRST = 256
#: Bounds give way by more than their rounding.
SLACK = 1e-9
ROWS = "vec_id bigint, label int, embedding array<double>, cell int, along double, beside double"
CENTRES = "cell int, centre array<double>, n bigint, least double, most double, beside double"


def _length(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def _beside(square: Column, along: Column) -> Column:
    """Length of what stands beside a direction; never less than it is, but for rounding."""
    return F.sqrt(F.greatest(square - along * along, F.lit(0.0)))


def build(emb: DataFrame, path: str, cells: int | None = None) -> None:
    """Write the index of ``emb`` (vec_id, label, embedding) to ``path``: folders rows and centres, the latter last."""
    spark = emb.sparkSession
    v = F.transform("embedding", lambda x: x.cast("double"))
    rows = emb.select("vec_id", F.col("label").cast("int").alias("label"), v.alias("embedding"))
    rows = rows.filter((F.size("embedding") > 0) & ~F.exists("embedding", lambda x: x.isNull()))
    n = rows.count()
    if n:
        k = max(2, cells or min(CELLS, math.ceil(math.sqrt(n))))
        share = min(1.0, FIT_ROWS / n)
        sample = rows.filter(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)) < F.lit(int(share * (1 << 30))))
        model = KMeans(k=k, maxIter=ROUNDS, seed=SEED, featuresCol="v", predictionCol="cell").fit(sample.select(array_to_vector("embedding").alias("v")))
        centres = spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())], "cell int, centre array<double>")
        # unit centres; a centre of zero stays one
        unit = F.transform("centre", lambda x: F.coalesce(F.try_divide(x, _length(F.col("centre"))), F.lit(0.0)))
        centres = centres.select("cell", unit.alias("centre"))
        rows = model.transform(rows.withColumn("v", array_to_vector("embedding"))).drop("v")
        rows = rows.join(F.broadcast(centres), "cell").withColumn("along", dot(F.col("embedding"), F.col("centre"))).drop("centre")
        rows = rows.withColumn("beside", _beside(dot(F.col("embedding"), F.col("embedding")), F.col("along")))
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        columns = [f.split()[0] for f in ROWS.split(", ")]
        rows.select(*columns).repartitionByRange(parts, "cell", "vec_id").sortWithinPartitions("cell").write.mode("overwrite").parquet(f"{path}/rows")
    else:
        spark.createDataFrame([], ROWS).write.mode("overwrite").parquet(f"{path}/rows")
        centres = spark.createDataFrame([], "cell int, centre array<double>")
    facts = spark.read.schema(ROWS).parquet(f"{path}/rows").groupBy("cell").agg(
        F.count(F.lit(1)).alias("n"), F.min("along").alias("least"), F.max("along").alias("most"), F.max("beside").alias("beside"))
    centres.join(facts, "cell").select(*[f.split()[0] for f in CENTRES.split(", ")]).coalesce(1).write.mode("overwrite").parquet(f"{path}/centres")


def stored(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.parquet(f"{path}/centres")
    except AnalysisException:
        return False
    return True


def _bounds(spark: SparkSession, path: str, queries: DataFrame) -> DataFrame:
    """(query_id, v, cell, n, s, t, upper): each query with each of the centres, of which there are ``CELLS`` at most."""
    centres = F.broadcast(spark.read.schema(CENTRES).parquet(f"{path}/centres"))
    pairs = queries.crossJoin(centres).withColumn("s", dot(F.col("centre"), F.col("v")))
    pairs = pairs.withColumn("t", _beside(dot(F.col("v"), F.col("v")), F.col("s")))
    upper = F.greatest(F.col("s") * F.col("least"), F.col("s") * F.col("most")) + F.col("t") * F.col("beside")
    return pairs.select("query_id", "v", "cell", "n", "s", "t", upper.alias("upper"))


def _visited(spark: SparkSession, path: str, pairs: DataFrame) -> DataFrame:
    """Rows of the pairs' cells, beside them; the numbers of the cells reach the scan (``CELLS`` at most)."""
    some = sorted(r["cell"] for r in pairs.select("cell").distinct().collect())
    rows = spark.read.schema(ROWS).parquet(f"{path}/rows").filter(F.col("cell").isin(some))
    return rows.join(pairs, "cell")


def _floor(spark: SparkSession, path: str, bounds: DataFrame, k: int) -> DataFrame:
    """(query_id, floor): the k-th best score of the first cells; null where they hold fewer than k."""
    first = max(FIRST, k)
    ahead = Window.partitionBy("query_id").orderBy(F.col("upper").desc(), "cell").rowsBetween(Window.unboundedPreceding, -1)
    probe = bounds.withColumn("seen", F.coalesce(F.sum("n").over(ahead), F.lit(0))).filter(F.col("seen") < first)
    scores = _visited(spark, path, probe.select("query_id", "v", "cell")).select("query_id", dot(F.col("embedding"), F.col("v")).alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc()))
    best = scores.withColumn("r", rank).filter(F.col("r") <= k)
    return best.groupBy("query_id").agg(F.when(F.count(F.lit(1)) == k, F.min("score")).alias("floor"))


def reached(spark: SparkSession, path: str, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, v, vec_id, label, embedding) of the pairs whose bound reaches the floor."""
    bounds = _bounds(spark, path, queries)
    near = bounds.join(_floor(spark, path, bounds, k), "query_id", "left")
    reach = lambda bound: F.col("floor").isNull() | (bound >= F.col("floor") - SLACK)
    rows = _visited(spark, path, near.filter(reach(F.col("upper"))).select("query_id", "v", "cell", "s", "t", "floor"))
    rows = rows.filter(reach(F.col("s") * F.col("along") + F.col("t") * F.col("beside")))
    return rows.select("query_id", "v", "vec_id", "label", "embedding")


def search(spark: SparkSession, path: str, queries: DataFrame, k: int = 3) -> DataFrame:
    """The exact top ``k`` vectors by dot product of each query (query_id, v)."""
    scores = reached(spark, path, queries, k).select("query_id", "vec_id", "label", dot(F.col("embedding"), F.col("v")).alias("score"))
    rank = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id"))
    return scores.withColumn("rank", F.row_number().over(rank)).filter(F.col("rank") <= k)


def scored(spark: SparkSession, path: str, queries: DataFrame, k: int = 3) -> float:
    """Share of all pairs of query and vector that a search scores in its second pass."""
    total = spark.read.schema(CENTRES).parquet(f"{path}/centres").agg(F.sum("n")).first()[0] or 0
    pairs = reached(spark, path, queries, k).count()
    return pairs / max(1, total * queries.count())
