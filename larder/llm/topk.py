"""Exact top-k search by columnar branch and bound.

Vectors stand in blocks with one array per dimension (vertical layout).  A query
adds up inner products ``STEP`` dimensions at a time, those where the query is
largest first.  What the other dimensions can add is at most the product of the
norms of what is left (Cauchy-Schwarz), so after each step candidates whose
upper bound is under the k-th best lower bound go, and the rest is compacted.

Query blocks and candidate blocks meet once per pair of blocks, under a key of
both blocks' groups, so the work spreads over (query blocks x candidate blocks) keys
and a task holds two blocks at a time.  Only the two numbers of blocks reach the driver.
Each pair gives k rows a query; a window with a partial group limit ranks them.

Cases: vectors that are null, hold null or non-finite components, or have no id
take no part; shorter vectors count as filled up with zeros; ties go to the
smaller id; repeated candidate rows are ranked one by one, repeated query rows
are answered once; of query rows of one id with unlike vectors the least vector is
the query; rows with the query's id are no candidates of it; fewer candidates than k
give fewer rows; inner products beyond the range of a long are held to it; an empty
table gives none; vectors may have any length (a block holds that of its rows).  Columns that are
not read may have any name.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larder.llm.common import checkpointed

K = 5
SCALE = 256
EVERY = 50
STEP = 16
QUERY_BLOCK, ROW_BLOCK = 2048, 4096
BLOCK_FIELDS = "block long, n int, dims int, ids binary, data binary"


def valid(vectors: DataFrame, name: str = "embedding", *, keep: tuple = ()) -> DataFrame:
    """(vec_id, x) and the columns of ``keep``: the rows that take part, ``x`` as doubles."""
    x = F.transform(F.col(name), lambda e: e.cast("double"))
    good = F.forall("x", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))))
    return vectors.select("vec_id", x.alias("x"), *keep).filter("vec_id is not null and x is not null").filter(good)


def scaled(rows: DataFrame, scale: int = SCALE) -> DataFrame:
    """Components as floor(scale * x), kept as doubles (a double's floor is a double)."""
    return rows.select("vec_id", F.transform("x", lambda e: F.lit(float(scale)) * e).alias("x"))


def _packer(most: int):
    def pack(frames):
        from pyspark import TaskContext

        first, n, held, size = TaskContext.get().partitionId() << 32, 0, [], 0

        def block(pdf):
            ids = pdf["vec_id"].to_numpy(np.int64)
            lengths = pdf["x"].map(len).to_numpy()
            flat = np.concatenate([np.zeros(0), *pdf["x"].to_list()])
            data = np.zeros((len(ids), max(int(lengths.max()), 1)))
            inside = np.arange(data.shape[1]) < lengths[:, None]
            data[inside] = np.floor(flat)
            return pd.DataFrame({"block": [first + n], "n": [len(ids)], "dims": [data.shape[1]], "ids": [ids.tobytes()], "data": [data.T.copy().tobytes()]})

        for pdf in frames:
            held.append(pdf)
            size += len(pdf)
            while size >= most:
                rows = pd.concat(held)
                yield block(rows[:most])
                n, held, size = n + 1, [rows[most:]], size - most
        if size:
            yield block(pd.concat(held))

    return pack


def blocks(rows: DataFrame, most: int) -> DataFrame:
    return rows.mapInPandas(_packer(most), BLOCK_FIELDS)


def search(query: np.ndarray, columns: np.ndarray, norm2: np.ndarray, k: int, step: int = STEP) -> tuple[np.ndarray, np.ndarray]:
    """Places and inner products of what may be among the k best columns; ties with the k-th are all there.

    ``columns``: dimensions x vectors, whole numbers whose inner products a double holds exactly.
    """
    order = np.argsort(-np.abs(query), kind="stable")
    left = np.cumsum((query[order] ** 2)[::-1])[::-1]
    alive, part, rest = None, np.zeros(columns.shape[1]), norm2.copy()
    for at in range(0, len(order), step):
        dims = order[at:at + step]
        if alive is None:
            x = columns[dims]
        else:
            x = columns[dims[:, None], alive]
        part += query[dims] @ x
        if at + step >= len(order):
            break
        rest -= np.einsum("ij,ij->j", x, x)
        reach = np.sqrt(left[at + step] * np.maximum(rest, 0)) * (1 + 1e-9) + 1e-6
        if len(part) > k:
            floor = np.partition(part - reach, len(part) - k)[len(part) - k]
            keep = part + reach >= floor
            if keep.sum() < 0.8 * len(part):
                alive = np.flatnonzero(keep) if alive is None else alive[keep]
                part, rest = part[keep], rest[keep]
    return (np.arange(columns.shape[1]) if alive is None else alive), part


def _best(k: int):
    def best(frames):
        for pdf in frames:
            for r in pdf.itertuples():
                q_ids, c_ids = np.frombuffer(r.q_ids, np.int64), np.frombuffer(r.ids, np.int64)
                q, c = np.frombuffer(r.q_data).reshape(r.q_dims, -1).T, np.frombuffer(r.data).reshape(r.dims, -1)
                dims = min(q.shape[1], c.shape[0])
                q, c = np.ascontiguousarray(q[:, :dims]), np.ascontiguousarray(c[:dims])
                exact = np.abs(q).max(initial=0) * np.abs(c).max(initial=0) * max(dims, 1) < 2.0**53
                norm2 = np.einsum("ij,ij->j", c, c) if exact else None
                out = []
                for i, own in enumerate(q_ids):
                    if exact:
                        at, score = search(q[i], c, norm2, k + int((c_ids == own).sum()))
                        score = score.astype(np.int64)
                    else:  # whole numbers of any size, held to the range of a long
                        at = np.arange(len(c_ids))
                        whole = [int(x) for x in q[i]]
                        score = np.array([max(-(2**63), min(2**63 - 1, sum(a * int(b) for a, b in zip(whole, c[:, j])))) for j in at], np.int64)
                    other = c_ids[at] != own
                    at, score = at[other], score[other]
                    top = np.lexsort((c_ids[at], ~score))[:k]  # ~score falls as score rises, without overflow
                    out.append((np.full(len(top), own), c_ids[at[top]], score[top]))
                if out:
                    yield pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), map(np.concatenate, zip(*out)))))

    return best


def top_k(rows: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """The k best rows of each query by inner product; both frames are (vec_id, x)."""
    q = checkpointed(blocks(queries.groupBy("vec_id").agg(F.min("x").alias("x")), QUERY_BLOCK))
    q = q.select(F.col("block").alias("q_block"), F.col("dims").alias("q_dims"), F.col("ids").alias("q_ids"), F.col("data").alias("q_data"))
    c = checkpointed(blocks(rows, ROW_BLOCK))
    # blocks are dealt to as many groups as there are of them; each pair of blocks meets in the one pair of groups
    # that the two are in, and only the two numbers of blocks are known to the driver
    q_groups, c_groups = max(q.count(), 1), max(c.count(), 1)
    group = lambda block, n: F.pmod(F.xxhash64(block), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = q.withColumn("q_group", group("q_block", q_groups)).withColumn("group", every(c_groups))
    c = c.withColumn("group", group("block", c_groups)).withColumn("q_group", every(q_groups))
    found = c.join(q, ["group", "q_group"]).mapInPandas(_best(k), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def digest(vectors: DataFrame) -> DataFrame:
    """Contract columns of the top-k query."""
    rows = scaled(valid(vectors.select("vec_id", "embedding")))
    return top_k(rows, rows.filter(F.col("vec_id") % EVERY == 0))


ORACLE = f"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * CAST(x AS DOUBLE))) AS x
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
q AS (SELECT vec_id AS query_id, min(x) AS x FROM v WHERE vec_id % {EVERY} = 0 GROUP BY vec_id),
s AS (SELECT q.query_id, v.vec_id, CAST(list_dot_product(q.x, v.x) AS BIGINT) AS score FROM q JOIN v ON v.vec_id <> q.query_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {K}
"""
