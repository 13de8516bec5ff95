"""The operators' registered queries, and DuckDB SQL where SQL can express one."""

from __future__ import annotations

from larder.llm import embeddings, language, mixing, multiset, neardup, pieces, quality, repair, secrets, sharding, tokens, topk, trie
from larder.llm.common import read

QUERIES = {
    "op1_quality": lambda spark, d: quality.digest(read(spark, d, "documents"), read(spark, d, "labels")),
    "op2_secret_scan": lambda spark, d: secrets.digest(read(spark, d, "documents")),
    "op3_near_dups": lambda spark, d: neardup.groups(read(spark, d, "documents"), (85, 100)),
    "op4_mix_sources": lambda spark, d: mixing.digest(read(spark, d, "documents")),
    "op5_embedding_dups": lambda spark, d: embeddings.digest(read(spark, d, "embeddings")),
    "op6_token_counts": lambda spark, d: tokens.digest(read(spark, d, "documents")),
    "op7_language": lambda spark, d: language.digest(read(spark, d, "documents")),
    "op8_shard": lambda spark, d: sharding.digest(read(spark, d, "documents")),
    "op9_pieces": lambda spark, d: pieces.digest(read(spark, d, "documents")),
    "op10_topk": lambda spark, d: topk.digest(read(spark, d, "embeddings")),
    "op11_prefix_trie": lambda spark, d: trie.digest(read(spark, d, "conversations")),
    "op12_repair": lambda spark, d: repair.digest(read(spark, d, "conversations")),
    "op13_fingerprint": lambda spark, d: multiset.digest(read(spark, d, "documents")),
}

ORACLE: dict[str, str] = {"op10_topk": topk.ORACLE, "op11_prefix_trie": trie.ORACLE, "op12_repair": repair.ORACLE}
