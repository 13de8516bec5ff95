"""Retrieval queries over documents and embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from larder.operators import cellindex as ci
from larder.operators import retrieval as rt
from larder.operators import textindex as ti
from larder.plans.registry import register
from larder.session import stored_dir
from larder.sources.tables import state, table

CHUNK, OVERLAP = 200, 50
TOP_K_TERMS = 5
TOP_K_VECTORS = 3

# Search requests (a parameter, like a user's question): hand-picked words of
# the test corpus, plus one that never occurs.
SEARCH_TERMS = [
    (1, "thtion"), (1, "attion"),
    (2, "eriner"), (2, "thanedble"), (2, "ontion"),
    (3, "queque"),
    (4, "einverlich"), (4, "chung"),
    (5, "zzzqqq"),
]
_Q_SQL = "q(query_id, term) AS (VALUES " + ", ".join(f"({i}, '{t}')" for i, t in SEARCH_TERMS) + ")"


def _queries(spark):
    return spark.createDataFrame(SEARCH_TERMS, "query_id int, term string")


def _hits(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return rt.term_search(docs, _queries(spark), k=TOP_K_TERMS)


@register("document_chunks", f"""
SELECT doc_id, cast(chunk_id AS INTEGER) AS chunk_id, cast(start AS INTEGER) AS start,
       substr(text, cast(start AS BIGINT) + 1, {CHUNK}) AS chunk
FROM (SELECT doc_id, text, generate_subscripts(st, 1) - 1 AS chunk_id, unnest(st) AS start
      FROM (SELECT doc_id, text,
                   range(0, (CASE WHEN length(text) <= {CHUNK} THEN 1
                                  ELSE cast(ceil((length(text) - {CHUNK}) / {float(CHUNK - OVERLAP)}) AS BIGINT) + 1 END)
                            * {CHUNK - OVERLAP}, {CHUNK - OVERLAP}) AS st
            FROM documents) a) b""")
def q_document_chunks(spark, sf):
    """200-character chunks overlapping by 50, over every whole document."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return rt.chunk_documents(docs, CHUNK, OVERLAP)


_TERM_SQL = f"""WITH {_Q_SQL},
tok AS (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+')) AS term FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM tok WHERE term IN (SELECT term FROM q) GROUP BY doc_id, term),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
n AS (SELECT count(DISTINCT doc_id) AS n FROM documents),
per AS (SELECT query_id, doc_id, sum(tf * ln(n / df)) AS score, count(*) AS matched_terms
        FROM q JOIN tf USING (term) JOIN df USING (term), n GROUP BY query_id, doc_id),
hits AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id
                                                     ORDER BY round(score, 9) DESC, doc_id) AS rank FROM per) r
         WHERE rank <= {TOP_K_TERMS})
"""


@register("term_search", _TERM_SQL + """
SELECT query_id, doc_id, round(score, 4) AS score, matched_terms, cast(rank AS INTEGER) AS rank FROM hits""")
def q_term_search(spark, sf):
    """R2: TF-IDF top documents per search request."""
    h = _hits(spark, sf)
    return h.select("query_id", "doc_id", "score", "matched_terms", "rank")


def text_index(spark, sf) -> str:
    """Folder of the index of the documents as they are now; built where there is none."""
    path = stored_dir(spark, f"text-index/{state(spark, sf, 'documents')}")
    if ti.stats(spark, path) is None:
        ti.build(table(spark, sf, "documents").select("doc_id", "text"), path)
    return path


@register("term_search_index", _TERM_SQL + """
SELECT query_id, doc_id, round(score, 4) AS score, matched_terms, cast(rank AS INTEGER) AS rank FROM hits""")
def q_term_search_index(spark, sf):
    """R2: the same search over the stored inverted index, by block maxima."""
    h = ti.search(spark, text_index(spark, sf), _queries(spark), TOP_K_TERMS)
    return h.select("query_id", "doc_id", "score", "matched_terms", "rank")


_PRE, _POST = rt.NOT_FOUND.replace("'", "''").split("{terms}")


@register("cited_hits", _TERM_SQL + f"""
, terms AS (SELECT query_id, list_sort(list_distinct(list(term))) AS terms FROM q GROUP BY query_id),
got AS (SELECT query_id, list_sort(list(doc_id)) AS cited_ids FROM hits GROUP BY query_id)
SELECT t.query_id, coalesce(g.cited_ids, []::BIGINT[]) AS cited_ids,
       CASE WHEN g.cited_ids IS NULL THEN '{_PRE}' || array_to_string(t.terms, ' ') || '{_POST}'
            ELSE 'According to documents ' || array_to_string(g.cited_ids, ', ') || '.' END AS answer
FROM terms t LEFT JOIN got g ON t.query_id = g.query_id""")
def q_cited_hits(spark, sf):
    """Cited document ids per request, or the not-found reply."""
    return rt.cited_answers(_queries(spark), _hits(spark, sf))


_VECTOR_SQL = f"""
WITH c AS (SELECT label AS query_id, list(m ORDER BY dim) AS q
           FROM (SELECT label, dim, avg(cast(x AS DOUBLE)) AS m
                 FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS dim
                       FROM embeddings) u GROUP BY label, dim) a GROUP BY label),
s AS (SELECT c.query_id, e.vec_id, e.label,
             list_reduce(list_transform(range(1, len(e.embedding) + 1),
                                        lambda i: cast(e.embedding[i] AS DOUBLE) * c.q[i]),
                         lambda a, b: a + b) AS score
      FROM embeddings e, c)
SELECT query_id, vec_id, label, round(score, 6) AS score, cast(rank AS INTEGER) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) r
WHERE rank <= {TOP_K_VECTORS}"""


@register("vector_topk", _VECTOR_SQL, digits=6)
def q_vector_topk(spark, sf):
    """The 3 vectors closest (dot product) to each label's mean vector."""
    emb = table(spark, sf, "embeddings").select("vec_id", "label", "embedding")
    return rt.vector_topk(emb, rt.label_centroids(emb), k=TOP_K_VECTORS).select(
        F.col("query_id").cast("int").alias("query_id"), "vec_id", "label", "score", "rank")


def vector_index(spark, sf) -> str:
    """Folder of the index of the vectors as they are now; built where there is none."""
    path = stored_dir(spark, f"vector-index/{state(spark, sf, 'embeddings')}")
    if not ci.stored(spark, path):
        ci.build(table(spark, sf, "embeddings").select("vec_id", "label", "embedding"), path)
    return path


@register("vector_topk_cells", _VECTOR_SQL, digits=6)
def q_vector_topk_cells(spark, sf):
    """The same, exactly, over the stored inverted-file index."""
    emb = table(spark, sf, "embeddings").select("vec_id", "label", "embedding")
    hits = ci.search(spark, vector_index(spark, sf), rt.label_centroids(emb), TOP_K_VECTORS)
    return hits.select(F.col("query_id").cast("int").alias("query_id"), "vec_id", "label", "score", "rank")
