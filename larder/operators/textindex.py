"""A stored inverted index over whole documents, searched by block maxima (R2).

Documents are put in ranges of ``RANGE`` in the order of their ids.  A block holds the
postings of one term in one range, with the greatest term frequency among them.  Ranges
are the same for all terms, so for a search

- the sum of the terms' block maxima, weighted, bounds all scores of a range from above;
- the greatest of them is reached by some document of the range, so the k-th greatest of
  these over the ranges (whose documents differ) bounds the k-th best score from below.

A first pass reads the maxima alone (two numbers a block), a second one the postings of the
ranges whose upper bound reaches the lower one; the others can't hold a result.  Both read
only the partitions (terms dealt by hash) and row groups (sorted by term) of the terms asked for.

A hot term is spread over as many blocks as ranges hold it, and blocks over files.

Cases: rows without an id aren't indexed; rows of one id are one document; null and empty texts
have no terms but count as documents; an unknown term finds nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from larder.functions.columns import round_half_up
from larder.operators.retrieval import tokens

#: Documents of a range, and partitions that terms are dealt to.
RANGE, PARTS = 256, 32
#: Ranks go by scores rounded to 9 places; bounds give way by more than that.
SLACK = 1e-8


BLOCKS = "term string, range bigint, most bigint, n bigint, postings array<struct<doc_id:bigint,tf:bigint>>, part int"
TERMS = "term string, df bigint, blocks bigint, part int"


def _read(spark: SparkSession, path: str, name: str, parts: list[int] | None = None) -> DataFrame:
    """A folder of the index, or the given partitions of it."""
    rows = spark.read.schema({"blocks": BLOCKS, "terms": TERMS}[name]).parquet(f"{path}/{name}")
    return rows if parts is None else rows.filter(F.col("part").isin(parts))


def term_part(term: Column, parts: int = PARTS) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(parts)).cast("int")


def ranges(docs: DataFrame, size: int = RANGE) -> DataFrame:
    """(doc_id, range): distinct ids, ``size`` neighbours a range; Spark's range partitioner deals the ids out."""
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ids = docs.select("doc_id").distinct().repartitionByRange(n, "doc_id").withColumn("slice", F.spark_partition_id())
    place = F.row_number().over(Window.partitionBy("slice").orderBy("doc_id")) - 1
    return ids.select("doc_id", (F.col("slice").cast("long") * F.lit(1 << 32) + F.floor(place / size)).alias("range"))


def build(docs: DataFrame, path: str, size: int = RANGE, parts: int = PARTS) -> None:
    """Write the index of ``docs`` (doc_id, text) to ``path``: folders ranges, blocks, terms and stats, the last written last.

    The ranges are written first: they are read twice and must not be dealt out anew.
    """
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = docs.filter("doc_id is not null")
    ranges(docs, size).write.mode("overwrite").parquet(f"{path}/ranges")
    placed = spark.read.parquet(f"{path}/ranges")
    # dealt by document, so that a document's words are counted where they are
    words = tokens(docs.repartition(n, "doc_id").join(placed, "doc_id"), "text", "doc_id", "range").groupBy("doc_id", "range", "term").agg(F.count(F.lit(1)).alias("tf"))
    # postings move once: to the partition of their term, in as many slices of ranges as give each task some
    slices = -(-4 * n // parts)
    words = words.withColumns({"part": term_part(F.col("term"), parts), "slice": F.pmod(F.xxhash64("range"), F.lit(slices)).cast("int")})
    blocks = words.repartition(n, "part", "slice").groupBy("part", "slice", "term", "range").agg(
        F.max("tf").alias("most"), F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.struct("doc_id", "tf"))).alias("postings"))
    blocks = blocks.select("term", "range", "most", "n", "postings", "part").sortWithinPartitions("part", "term", "range")
    blocks.write.mode("overwrite").partitionBy("part").option("parquet.bloom.filter.enabled#term", "true").parquet(f"{path}/blocks")
    terms = _read(spark, path, "blocks").groupBy("part", "term").agg(F.sum("n").alias("df"), F.count(F.lit(1)).alias("blocks"))
    terms.repartition("part").sortWithinPartitions("part", "term").write.mode("overwrite").partitionBy("part").parquet(f"{path}/terms")
    placed.agg(F.count(F.lit(1)).cast("double").alias("n_docs"), F.lit(size).alias("size"), F.lit(parts).alias("parts")).write.mode("overwrite").parquet(f"{path}/stats")


def stats(spark: SparkSession, path: str):
    """(n_docs, size, parts) of a finished index, None where there is none."""
    try:
        return spark.read.parquet(f"{path}/stats").first()
    except AnalysisException:
        return None


def _asked(spark: SparkSession, path: str, queries: DataFrame, parts: int) -> tuple[DataFrame, list[int]]:
    """(query_id, term, part) of the distinct lower-cased terms, and the partitions they are in (as many as there are, at most)."""
    q = queries.select("query_id", F.lower("term").alias("term")).distinct().withColumn("part", term_part(F.col("term"), parts))
    return q, sorted(r["part"] for r in q.select("part").distinct().collect())


def _weights(spark: SparkSession, path: str, queries: DataFrame) -> tuple[DataFrame, list[int]]:
    """(query_id, part, term, weight) of the terms that occur, and the partitions they are in."""
    n_docs, _, parts = stats(spark, path)
    q, some = _asked(spark, path, queries, parts)
    weight = F.log(F.lit(n_docs) / F.col("df"))
    return _read(spark, path, "terms", some).join(q, ["part", "term"]).select("query_id", "part", "term", weight.alias("weight")), some


def bounds(spark: SparkSession, path: str, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, range, upper, least, wanted): bounds of each range that holds a term, and whether it is searched."""
    return _bounds(spark, path, *_weights(spark, path, queries), k)


def _bounds(spark: SparkSession, path: str, terms: DataFrame, some: list[int], k: int) -> DataFrame:
    maxima = _read(spark, path, "blocks", some).select("part", "term", "range", "most")
    per = maxima.join(terms, ["part", "term"]).groupBy("query_id", "range").agg(
        F.sum(F.col("most") * F.col("weight")).alias("upper"), F.max(F.col("most") * F.col("weight")).alias("reached"))
    best = Window.partitionBy("query_id").orderBy(F.col("reached").desc(), "range")
    floor = per.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= k).groupBy("query_id").agg(
        F.when(F.count(F.lit(1)) == k, F.min("reached")).alias("least"))
    per = per.join(floor, "query_id")
    return per.select("query_id", "range", "upper", "least", (F.col("least").isNull() | (F.col("upper") >= F.col("least") - SLACK)).alias("wanted"))


def search(spark: SparkSession, path: str, queries: DataFrame, k: int = 5) -> DataFrame:
    """The top ``k`` documents of each query (query_id, term), as ``term_search`` gives them."""
    terms, some = _weights(spark, path, queries)
    wanted = _bounds(spark, path, terms, some, k).filter("wanted").select("query_id", "range")
    blocks = _read(spark, path, "blocks", some).select("part", "term", "range", "postings")
    hits = blocks.join(terms, ["part", "term"]).join(wanted, ["query_id", "range"]).select("query_id", "weight", F.inline("postings"))
    per = hits.groupBy("query_id", "doc_id").agg(F.sum(F.col("tf") * F.col("weight")).alias("score"), F.count(F.lit(1)).alias("matched_terms"))
    rank = Window.partitionBy("query_id").orderBy(round_half_up(F.col("score"), 9).desc(), F.col("doc_id"))
    return per.withColumn("rank", F.row_number().over(rank)).filter(F.col("rank") <= k)
