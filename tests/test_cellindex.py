"""The exact inverted-file index against the search that scores every vector."""

import numpy as np
import pytest

from larder.operators import cellindex as ci
from larder.operators import retrieval as rt


def found(df):
    return sorted((r.query_id, r["rank"], r.vec_id, r.label, round(r.score, 12)) for r in df.collect())


def vectors(spark, x, labels=None):
    rows = [(i, int(labels[i]) if labels is not None else i % 3, [float(c) for c in v]) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")


@pytest.mark.parametrize("kind, cells", [("clusters", 12), ("clusters", 2), ("noise", 9), ("ties", 5)])
def test_search_is_exact(spark, scratch, kind, cells):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(12, 16)) * 3
    label = rng.integers(0, 12, 600)
    x = centres[label] + 0.1 * rng.normal(size=(600, 16)) if kind == "clusters" else rng.normal(size=(600, 16))
    if kind == "ties":
        x = np.round(x[:40])[rng.integers(0, 40, 600)]
        x[::7] = 0
    emb = vectors(spark, x, label)
    queries = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate([*x[:5], *rng.normal(size=(3, 16)), np.zeros(16), -x[0]])],
                                    "query_id int, v array<double>")
    ci.build(emb, scratch, cells)
    for k in (1, 3, 700):
        assert found(ci.search(spark, scratch, queries, k)) == found(rt.vector_topk(emb, queries, k))
    if kind == "clusters" and cells > 2:  # most of the table lies in cells that can't reach the floor
        assert ci.scored(spark, scratch, queries.filter("query_id < 5"), 3) < 0.3


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.1"])
def test_index_of_whole_tables_is_exact(spark, scratch, sf):
    emb = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").select("vec_id", "label", "embedding").cache()
    queries = rt.label_centroids(emb).cache()
    ci.build(emb, scratch)
    want = found(rt.vector_topk(emb, queries, 3))
    assert found(ci.search(spark, scratch, queries, 3)) == want and len(want) == 3 * queries.count()


def test_index_of_few_and_odd_vectors(spark, scratch):
    queries = spark.createDataFrame([(1, [1.0, 0.0])], "query_id int, v array<double>")
    ci.build(vectors(spark, []), f"{scratch}/none")
    assert ci.search(spark, f"{scratch}/none", queries).collect() == []
    rows = [(1, 0, [0.0, 0.0]), (2, 0, None), (3, 1, []), (4, 1, [None, 1.0]), (5, None, [2.0, 1.0]), (5, 2, [2.0, 1.0])]
    odd = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")
    ci.build(odd, f"{scratch}/odd")
    got = [(r.vec_id, r.label, r.score) for r in ci.search(spark, f"{scratch}/odd", queries, 3).collect()]
    assert sorted(got, key=str) == sorted([(5, None, 2.0), (5, 2, 2.0), (1, 0, 0.0)], key=str)


def test_scores_are_made_once(spark):
    """No pass but one over the pairs, and ranks within tasks before the exchange."""
    from larder.plans import retrieval as plans

    plan = plans.q_vector_topk(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastNestedLoopJoin") + plan.count("CartesianProduct") == 2  # the queries' number, the pairs
    assert plan.count("WindowGroupLimit") == 2 and "SinglePartition" not in plan.split("WindowGroupLimit")[-1].split("Generate")[0]
