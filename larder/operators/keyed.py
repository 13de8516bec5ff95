"""Chat tables dealt to buckets by a key, changed bucket by bucket.

A table is a folder of Parquet files, partitioned by a bucket of its ``by`` column (the chat, say, so
that a chat's rows lie together).  An append, update or delete reads and rewrites the buckets of the
keys it names, and leaves all other files as they are.  Buckets are replaced as a whole and at once
(dynamic partition overwrite), after their new rows have been written to the shared folder, so a job
that fails in between leaves the old ones and may run again: each operation is idempotent.

Every bucket that was ever written keeps a row without an id, which is never shown: a bucket whose
rows are all deleted is replaced by that row alone.

Cases: a row's ``by`` never changes (a message stays in its chat); rows without an id are refused (they could be neither updated nor deleted); of new rows with
equal ids one is taken, for updates the one with the greatest ``order``; a table that isn't there yet
is made by the first append or update, and a delete from it does nothing.  The number of buckets is a
table's own: it is read from the table's folder, and given for the first write only.
"""

from __future__ import annotations

import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.utils import AnalysisException

from larder.session import stored_dir

BUCKETS = 64
BUCKET, COUNT = "key_bucket", "key_buckets"


def _bucket(by: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.col(by)), F.lit(buckets)).cast("int")


def _stored(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return None


def _buckets(there: DataFrame | None, first: int) -> int:
    """The table's number of buckets; every row has it, and files keep it as one dictionary entry."""
    row = there.select(COUNT).first() if there is not None else None
    return row[0] if row else first


def read(spark: SparkSession, path: str, key: str = "id") -> DataFrame:
    return spark.read.parquet(path).filter(F.col(key).isNotNull()).drop(BUCKET, COUNT)


def _touched(rows: DataFrame) -> list[int]:
    """Buckets of some rows: as many as the table has, at most."""
    return sorted(r[0] for r in rows.select(BUCKET).distinct().collect())


def _put(spark: SparkSession, path: str, rows: DataFrame, touched: list[int], buckets: int, key: str, mode: str) -> None:
    """Write rows (with their bucket) and the touched buckets' hidden rows."""
    hidden = spark.createDataFrame([(b,) for b in touched], f"{BUCKET} int")
    hidden = hidden.select(*[F.col(BUCKET) if c == BUCKET else F.lit(None).cast(t).alias(c) for c, t in rows.dtypes])
    out = (rows.union(hidden) if mode == "overwrite" else rows).withColumn(COUNT, F.lit(buckets))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # a bucket is one task's, unless it is large: AQE then splits it
    out.repartition(n, BUCKET).write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(path)


def append_new(path: str, new: DataFrame, key: str = "id", by: str | None = None, buckets: int = BUCKETS) -> None:
    """Append rows whose key isn't in the table yet; only the keys of their buckets are read."""
    spark = new.sparkSession
    there = _stored(spark, path)
    n = _buckets(there, buckets)
    rows = new.filter(F.col(key).isNotNull()).dropDuplicates([key]).withColumn(BUCKET, _bucket(by or key, n))
    if there is None:
        _put(spark, path, rows, _touched(rows), n, key, "overwrite")
        return
    touched = _touched(rows)
    known = there.filter(F.col(BUCKET).isin(touched)).filter(F.col(key).isNotNull())
    rows = rows.select(*[c for c in there.columns if c not in (BUCKET, COUNT)], BUCKET)
    fresh = rows.join(known.select(key), key, "left_anti").select(rows.columns)
    # buckets that have no file yet get their hidden row with their first rows
    _put(spark, path, fresh, [], n, key, "append")
    missing = sorted(set(touched) - set(_touched(there.filter(F.col(key).isNull() & F.col(BUCKET).isin(touched)))))
    if missing:
        hidden = spark.createDataFrame([(b,) for b in missing], f"{BUCKET} int").select(
            *[F.col(BUCKET) if c == BUCKET else F.lit(None).cast(t).alias(c) for c, t in rows.dtypes], F.lit(n).alias(COUNT))
        hidden.write.mode("append").partitionBy(BUCKET).parquet(path)


def _rewrite(path: str, named: DataFrame, by: str, key: str, change) -> int:
    """Replace the buckets that ``named`` (with column ``by``) touches by what ``change`` makes of their rows; their number."""
    spark = named.sparkSession
    there = _stored(spark, path)
    if there is None:
        return 0
    n = _buckets(there, BUCKETS)
    touched = _touched(named.select(_bucket(by, n).alias(BUCKET)))
    if not touched:
        return 0
    columns = [c for c in there.columns if c not in (BUCKET, COUNT)]
    old = there.filter(F.col(BUCKET).isin(touched)).filter(F.col(key).isNotNull()).select(*columns)
    new = change(old).select(*columns).withColumn(BUCKET, _bucket(by, n))
    # written first: the files that are read are about to be replaced
    draft = stored_dir(spark, f"drafts/{spark.sparkContext.applicationId}-{zlib.crc32(path.encode()):08x}")
    new.write.mode("overwrite").parquet(draft)
    _put(spark, path, spark.read.schema(new.schema).parquet(draft), touched, n, key, "overwrite")
    return len(touched)


def delete(path: str, doomed: DataFrame, by: str, key: str = "id") -> int:
    """Delete all rows whose ``by`` is among ``doomed`` (by); the number of buckets that were rewritten."""
    named = doomed.select(by).distinct()
    return _rewrite(path, named, by, key, lambda old: old.join(named, by, "left_anti"))


def delete_trailing(path: str, cutoffs: DataFrame, by: str = "chat_id", at: str = "created_at", key: str = "id") -> int:
    """Delete each named chat's rows at or after its least ``cutoff``."""
    least = cutoffs.groupBy(by).agg(F.min("cutoff").alias("__cutoff"))
    keep = F.col("__cutoff").isNull() | F.col(at).isNull() | (F.col(at) < F.col("__cutoff"))
    return _rewrite(path, least, by, key, lambda old: old.join(least, by, "left").filter(keep))


def update(path: str, changed: DataFrame, key: str = "id", by: str | None = None, order: str | None = None, buckets: int = BUCKETS) -> int:
    """Put rows in place of those with their keys, or beside the others (latest version wins)."""
    by = by or key
    rows = changed.filter(F.col(key).isNotNull())
    if order:
        rest = [c for c in rows.columns if c != key]
        rows = rows.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(order)).alias("s")).select(key, "s.*")
    else:
        rows = rows.dropDuplicates([key])
    if _stored(changed.sparkSession, path) is None:
        append_new(path, rows, key, by, buckets)
        return 0
    return _rewrite(path, rows, by, key, lambda old: old.join(rows.select(key), key, "left_anti").unionByName(rows.select(old.columns)))


def append_stream(stream: DataFrame, path: str, checkpoint: str, key: str = "id", by: str | None = None,
                  at: str = "created_at", within: str = "1 hour", buckets: int = BUCKETS) -> StreamingQuery:
    """Append a stream's rows once each: repeats within the watermark never leave the state, later or replayed ones find their key there."""
    once = stream.withWatermark(at, within).dropDuplicatesWithinWatermark([key])
    return (once.writeStream.foreachBatch(lambda rows, _: append_new(path, rows, key, by, buckets))
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
