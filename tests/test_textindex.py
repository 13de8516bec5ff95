"""The stored inverted index against the search that reads the whole corpus."""

import random

import pytest
from pyspark.sql import functions as F

from larder.operators import retrieval as rt
from larder.operators import textindex as ti
from larder.plans import retrieval as plans


def found(df):
    return sorted((r.query_id, r["rank"], r.doc_id, round(r.score, 9), r.matched_terms) for r in df.collect())


@pytest.mark.parametrize("size", [1, 7, 1000])
def test_search_equals_whole_search(spark, scratch, size):
    """Also with ties, terms of all documents (weight 0), unknown ones, repeated rows and empty texts."""
    rng = random.Random(size)
    vocabulary = [f"w{i}" for i in range(40)]
    rows = [(i * 3, " ".join(["The", *rng.choices(vocabulary, weights=range(40, 0, -1), k=rng.randrange(60))])) for i in range(300)]
    rows += [(3, "the w1 w1 w39"), (1001, None), (1002, ""), (1003, "the W39 w39, w39! " * 9), (1004, "the w39 " * 27)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    queries = spark.createDataFrame([(q, t) for q, ts in enumerate((["w39"], ["w1", "W38"], ["the"], ["the", "w5", "w5"], ["none"], ["w0", "w39", "none"])) for t in ts],
                                    "query_id int, term string")
    ti.build(docs, scratch, size, 4)
    for k in (1, 5, 2000):
        assert found(ti.search(spark, scratch, queries, k)) == found(rt.term_search(docs, queries, k))


def test_index_of_nothing(spark, scratch):
    docs = spark.createDataFrame([], "doc_id long, text string")
    ti.build(docs, scratch)
    assert ti.search(spark, scratch, spark.createDataFrame([(1, "a")], "query_id int, term string")).collect() == []
    assert ti.stats(spark, scratch + "/none") is None


def test_ranges_that_hold_no_result_are_not_read(spark, scratch):
    """A range is searched just if its upper bound reaches the k-th best sure score; the best documents' ranges are."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    ti.build(docs, scratch, 4)
    queries = plans._queries(spark)
    bounds = ti.bounds(spark, scratch, queries, 5)
    counted = {r.query_id: (r.n, r.m) for r in bounds.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("wanted").cast("int")).alias("m")).collect()}
    assert all(m <= n for n, m in counted.values()) and sum(m for _, m in counted.values()) < 0.5 * sum(n for n, _ in counted.values())
    kept = {(r.query_id, r.doc_id) for r in rt.term_search(docs, queries, 5).collect()}
    placed = {r.doc_id: r.range for r in spark.read.parquet(f"{scratch}/ranges").collect()}
    wanted = {(r.query_id, r.range) for r in bounds.filter("wanted").collect()}
    assert all((q, placed[d]) in wanted for q, d in kept)


def test_search_reads_the_terms_partitions_only(spark):
    df = plans.q_term_search_index(spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [part#" in plan and "documents.parquet" not in plan
    assert plan.count("postings") and "ReadSchema: struct<term:string,range:bigint,most:bigint>" in plan


def test_build_moves_the_postings_once(spark, scratch, monkeypatch):
    """They aren't dealt by range, which would make the lists twice, once for the sample."""
    from pyspark.sql import DataFrameWriter

    plans_of, write = {}, DataFrameWriter.parquet
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, path, *a, **k: (
        plans_of.__setitem__(path.rsplit("/", 1)[1], self._df._jdf.queryExecution().executedPlan().toString()), write(self, path, *a, **k))[1])
    docs = spark.createDataFrame([(i, f"the w{i % 7}") for i in range(500)], "doc_id long, text string")
    ti.build(docs, scratch, 16, 4)
    assert "rangepartitioning" not in plans_of["blocks"]
    assert plans_of["blocks"].count("Exchange hashpartitioning(part") == 1 and "hashpartitioning(term" not in plans_of["blocks"]
    blocks = spark.read.parquet(f"{scratch}/blocks")
    assert blocks.select(F.sum("n")).first()[0] == 1000 and blocks.groupBy("term", "range").count().filter("count > 1").count() == 0
    hot = blocks.filter("term = 'the'").select(F.input_file_name().alias("f")).distinct().count()
    assert hot > 1
