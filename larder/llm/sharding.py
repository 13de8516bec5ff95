"""Sharding by jump consistent hashing (DataFrame functions only).

The shard of a row depends on its key and the number of shards alone.  There is
no ring table: a key jumps from bucket to bucket, ``b -> floor((b + 1) / u)``
with ``u`` a uniform draw that the key and ``b`` decide, and stays in the last
bucket below the number of shards.  Appending a shard therefore moves only the
rows whose next jump lands on it.

Cases: a null id is one key like any other; null and empty texts have size 8
and crc32 0; repeated rows share a shard and have slots of their own; an empty
table gives an empty result; other columns, whatever their names, are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

N_SHARDS = 24
ROW_BYTES = 8
#: Each shard's rows are numbered in this many parts, so that no task orders a whole shard.
PARTS = 4096
#: Steps of the first loop; a key has about ln(shards) + 1 jumps, the rest is a rare second loop.
STEPS = 32


def _draw(key: Column, bucket: Column) -> Column:
    """Uniform in (0, 1] from the key and the bucket it leaves."""
    return (F.shiftrightunsigned(F.xxhash64(key, bucket.cast("long")), 11) + 1) / F.lit(float(1 << 53))


def jump(key: Column, n_shards: int) -> Column:
    """Struct (shard, next): the key's bucket among ``n_shards``, and the bucket it would jump to next."""

    def step(s: Column, _: Column) -> Column:
        onward = F.struct(s["next"].alias("shard"), F.floor((s["next"] + 1) / _draw(key, s["next"])).cast("double").alias("next"))
        return F.when(s["next"] < n_shards, onward).otherwise(s)

    start = F.struct(F.lit(-1.0).alias("shard"), F.lit(0.0).alias("next"))
    first = F.aggregate(F.sequence(F.lit(1), F.lit(min(n_shards, STEPS))), start, step)
    if n_shards <= STEPS:
        return first
    return F.when(first["next"] >= n_shards, first).otherwise(
        F.aggregate(F.sequence(F.lit(1), F.lit(n_shards)), first, step))


def shard_rows(docs: DataFrame, n_shards: int = N_SHARDS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with ``size``, ``text_crc32``, ``law``, ``shard``, ``slot`` and ``grown_shard``.

    ``slot`` numbers a shard's rows from 0 without gaps.  Rows are ordered
    within (shard, part), the part being a range of a hash of the row; the
    part's first slot is a running sum over the parts' counts.  Input columns
    with the name of a result column are replaced.
    """
    made = ["size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    body = F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8")
    spread = F.when(F.col(key).isNull(), F.xxhash64(F.lit("slot"), F.col(text))).otherwise(F.xxhash64(F.lit("slot"), F.col(key)))
    rest = [c for c in docs.columns if c not in made]
    at = jump(F.xxhash64(F.lit("shard"), F.col(key)), n_shards)
    rows = docs.select(*rest, (F.octet_length(body) + ROW_BYTES).cast("long").alias("size"), F.crc32(body).alias("text_crc32"),
                       at.alias("__at"), spread.alias("__hash"))
    rows = rows.select("*", F.col("__at.shard").cast("int").alias("shard"),
                       F.when(F.col("__at.next") == n_shards, F.lit(n_shards)).otherwise(F.col("__at.shard")).cast("int").alias("grown_shard"),
                       F.pmod(F.col("__hash"), F.lit(PARTS)).cast("int").alias("__part"))
    before = Window.partitionBy("shard").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy("shard", "__part").agg(F.count(F.lit(1)).alias("__n")).select(
        "shard", "__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__first"))
    order = Window.partitionBy("shard", "__part").orderBy("__hash", F.col(key).asc_nulls_last(), "text_crc32", "size")
    return (rows.join(parts, ["shard", "__part"])
            .withColumn("slot", F.col("__first") + F.row_number().over(order) - 1)
            .select(*rest, "size", "text_crc32", F.lit("key").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), "grown_shard"))


def write_shards(docs: DataFrame, path: str, n_shards: int = N_SHARDS, files: int = 16) -> None:
    """One folder per shard, each of ``files`` slot ranges or less."""
    rows = shard_rows(docs, n_shards)
    (rows.repartition(F.col("shard"), F.pmod(F.col("slot"), F.lit(files))).sortWithinPartitions("shard", "slot")
     .write.partitionBy("shard").mode("overwrite").parquet(path))


def digest(docs: DataFrame, n_shards: int = N_SHARDS) -> DataFrame:
    """Contract columns of the sharding query."""
    return shard_rows(docs.select("doc_id", "text"), n_shards).select(
        "doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
