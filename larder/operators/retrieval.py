"""Transcript retrieval with citations.

* chunking is row-local array work over each whole text;
* term search joins the postings with the query terms, so its output grows
  with the postings of those terms, never with query x document pairs; the
  runtime decides by their size how the terms are joined;
* vector top-k scores the vectors against the queries in blocks, each pair once,
  and ranks within the tasks before anything is moved (``cellindex`` has the
  stored index).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.functions.columns import round_half_up

# Fixed value: the grounding rule's reply when nothing was retrieved.
NOT_FOUND = ("I don't see that in the transcripts provided, but if you could search for {terms}, "
             "I might find something!")
TOKEN_SPLIT = r"[^\p{L}\p{N}]+"
QUERY_BLOCK = 256   # query vectors scored in one pass over a row


def chunk_documents(docs: DataFrame, size: int = 200, overlap: int = 50) -> DataFrame:
    """Fixed-size overlapping character chunks of every whole document.

    Chunks start every ``size - overlap`` characters; the last one reaches the
    end of the text.  A text no longer than ``size`` is one chunk.
    """
    step = size - overlap
    n = F.length("text")
    n_chunks = F.when(n <= size, F.lit(1)).otherwise(F.ceil((n - size) / F.lit(step)).cast("int") + 1)
    starts = F.sequence(F.lit(0), (n_chunks - 1) * step, F.lit(step))
    return docs.select("doc_id", F.posexplode(starts).alias("chunk_id", "start"), "text").select(
        "doc_id", "chunk_id", "start", F.substring(F.col("text"), F.col("start") + 1, F.lit(size)).alias("chunk"))


def tokens(docs: DataFrame, text: str = "text", *keys: str) -> DataFrame:
    """(keys, by default doc_id, and term) rows of lower-cased letter/digit runs of the whole text."""
    return (docs.select(*(keys or ["doc_id"]), F.explode(F.split(F.lower(F.col(text)), TOKEN_SPLIT)).alias("term"))
            .filter(F.col("term") != ""))


def term_search(docs: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """TF-IDF ranked documents per query, top ``k`` (R2).

    ``queries`` is (query_id, term).  score = sum over matched query terms of
    tf(term, doc) * ln(N / df(term)); ties go to the smaller doc id.
    """
    q = queries.select("query_id", F.lower("term").alias("term")).distinct()
    post = tokens(docs).join(q.select("term").distinct(), "term", "left_semi")
    tf = post.groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("tf"))
    df_ = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    n_docs = docs.select("doc_id").distinct().agg(F.count(F.lit(1)).cast("double").alias("n_docs"))
    scored = (tf.join(df_, "term").join(q, "term").crossJoin(F.broadcast(n_docs))
              .withColumn("w", F.col("tf") * F.log(F.col("n_docs") / F.col("df"))))
    per = scored.groupBy("query_id", "doc_id").agg(
        F.sum("w").alias("score"), F.count(F.lit(1)).alias("matched_terms"))
    # rank on the score rounded to 9 places, so summation order cannot flip a tie
    w = Window.partitionBy("query_id").orderBy(round_half_up(F.col("score"), 9).desc(), F.col("doc_id"))
    return per.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def cited_answers(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """Per query: the cited document ids, or the not-found reply."""
    terms = queries.groupBy("query_id").agg(F.array_sort(F.collect_set("term")).alias("terms"))
    got = hits.groupBy("query_id").agg(F.array_sort(F.collect_list("doc_id")).alias("cited_ids"))
    j = terms.join(got, "query_id", "left")
    pre, post = NOT_FOUND.split("{terms}")
    found = F.concat(F.lit("According to documents "),
                     F.array_join(F.transform("cited_ids", lambda x: x.cast("string")), ", "), F.lit("."))
    missing = F.concat(F.lit(pre), F.array_join("terms", " "), F.lit(post))
    return j.select("query_id", F.coalesce("cited_ids", F.array().cast("array<bigint>")).alias("cited_ids"),
                    F.when(F.col("cited_ids").isNull(), missing).otherwise(found).alias("answer"))


def label_centroids(emb: DataFrame) -> DataFrame:
    """Mean vector of each label (query_id, v): one keyed aggregate."""
    per_dim = (emb.select("label", F.posexplode("embedding").alias("dim", "x"))
               .groupBy("label", "dim").agg(F.avg(F.col("x").cast("double")).alias("m")))
    vec = per_dim.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("dim", "m"))).alias("v"))
    return vec.select(F.col("label").alias("query_id"), F.transform("v", lambda s: s["m"]).alias("v"))


def dot(v: Column, q: Column) -> Column:
    """Dot product, summed in the order of the dimensions."""
    return F.aggregate(F.zip_with(v, q, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, x: s + x)


def _scores(emb: DataFrame, queries: DataFrame) -> DataFrame:
    """(vec_id, label, query_id, score): every vector against the queries, a block of about ``QUERY_BLOCK`` a pass.

    Queries are dealt to blocks by a hash of their id, and vectors to tasks by theirs: a table of
    few large row groups would else be scored by few tasks.
    """
    tasks = int(emb.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n = queries.agg(F.ceil(F.count(F.lit(1)) / QUERY_BLOCK).alias("n"))
    block = queries.crossJoin(F.broadcast(n)).groupBy(F.pmod(F.xxhash64("query_id"), F.col("n")).alias("b")).agg(
        F.collect_list(F.struct("query_id", "v")).alias("qs")).select("qs")
    pairs = F.transform("qs", lambda q: F.struct(q["query_id"].alias("query_id"), dot(F.col("embedding"), q["v"]).alias("score")))
    return emb.repartition(tasks, "vec_id").crossJoin(block).select("vec_id", "label", F.inline(pairs))


def vector_topk(emb: DataFrame, queries: DataFrame, k: int = 3) -> DataFrame:
    """Exact top-k vectors by dot product for each query vector.

    ``queries``: (query_id, v).  Each pair is scored once; a task hands on the k best
    of what it has scored for a query, so the shuffle moves k rows a query and task.
    """
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id"))
    return _scores(emb, queries).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
