"""Corpus pipeline: documents in, encoded training rows out.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept;
all but the last return the columns of documents.

1. quality: documents that the factorisation machine rejects go.
2. near duplicates: one document of each group (links at a Jaccard of 0.8 or more) stays.
3. secrets: spans are replaced in the texts.
4. mix: each source contributes its target; copies are rows, the last may be cut.
5. pieces: texts become ids (columns ``ids`` and ``n_tokens`` are added).

Cases: null and empty texts are scored like any other, link with nothing, hold no secret and
take no words, so the mix is without them; rows without an id are kept
as documents of their own; of rows with equal id and text one stays, rows of one id with
unlike texts are documents of their own; a null source is a source; without labels nothing
is rejected; empty tables give an empty result; texts may have any length; further columns,
whatever their names, go through unchanged.

Results aren't expressible in SQL (they rest on trained models and hashes of one
function), so tests hold ``run`` against the stages' brute-force versions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.llm import mixing, neardup, pieces, quality, secrets
from larder.llm.common import checkpointed, read


#: The least similarity of near duplicates.
NEAR = (80, 100)


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep(docs, read(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.deduplicated(docs, NEAR)


def remove_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redacted(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pieces.encoded(docs).withColumn("n_tokens", F.size("ids").cast("long"))


STAGES = [
    ("quality", keep_good),
    ("near_duplicates", drop_near_duplicates),
    ("secrets", remove_secrets),
    ("mix", mix_sources),
    ("pieces", encode_pieces),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each keeps is written before the next reads it."""
    docs = read(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = checkpointed(docs)
    return docs
