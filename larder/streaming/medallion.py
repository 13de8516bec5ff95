"""Incremental medallion ingest as Structured Streaming jobs.

* S1: each new CSV file in the landing folder is read exactly once; the file
  source log in the checkpoint remembers what was consumed.
* S2: silver is a stateless streaming projection of bronze, so a rerun with
  the same checkpoint appends nothing twice.
* S3: daily totals with an event-time watermark; rows that arrive later than
  the allowed lateness are told apart per micro-batch, by marks per batch.

Checkpoints and tables live under the shared folder named by
``spark.checkpoint.dir`` (see ``larder.session.shared_dir``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException
from pyspark.sql.streaming import StreamingQuery

from larder.operators.silver import clean_sales
from larder.sources.files import all_string_schema, stream_csv_dir

SALES_COLUMNS = ["transaction_id", "line_number", "store_id", "product_id", "quantity", "unit_price",
                 "discount", "total_amount", "payment_type", "channel", "loyalty_id", "transaction_ts",
                 "event_date"]


def ingest_bronze(spark: SparkSession, landing: str, bronze_path: str, checkpoint: str,
                  columns: list[str] = SALES_COLUMNS, rescued: bool = True,
                  max_files: int | None = None) -> StreamingQuery:
    """Append every not-yet-seen CSV file of ``landing`` to the bronze table."""
    schema = all_string_schema(columns, rescued=rescued)
    src = stream_csv_dir(spark, landing, schema, max_files=max_files).withColumn(
        "_source_file", F.col("_metadata.file_path"))
    return (src.writeStream.format("parquet").option("path", bronze_path)
            .option("checkpointLocation", checkpoint).outputMode("append")
            .trigger(availableNow=True).start())


def bronze_to_silver(spark: SparkSession, bronze_path: str, silver_path: str, checkpoint: str,
                     strict: bool = False) -> StreamingQuery:
    """Stateless clean of newly appended bronze rows into silver."""
    bronze_schema = spark.read.parquet(bronze_path).schema
    src = spark.readStream.schema(bronze_schema).parquet(bronze_path)
    out = clean_sales(src, strict=strict)
    return (out.writeStream.format("parquet").option("path", silver_path).partitionBy("event_date")
            .option("checkpointLocation", checkpoint).outputMode("append")
            .trigger(availableNow=True).start())


def daily_totals_stream(silver_stream: DataFrame, lateness: str = "1 day") -> DataFrame:
    """Per-day sales totals, finalised once the watermark passes the day (S3).

    Watermarks need an instant type, so the wall-clock column is read as a
    UTC timestamp (the session zone) and the day start is returned wall-clock.
    """
    s = silver_stream.withColumn("_et", F.col("transaction_ts").cast("timestamp"))
    return (s.withWatermark("_et", lateness)
            .groupBy(F.window("_et", "1 day"))
            .agg(F.sum("total_amount").alias("total_amount"), F.count(F.lit(1)).alias("n_lines"))
            .select(F.col("window.start").cast("timestamp_ntz").alias("day_start"), "total_amount", "n_lines"))


def late_data_check(stream: DataFrame, root: str, checkpoint: str, lateness_hours: int = 24,
                    ts: str = "transaction_ts", amount: str = "total_amount") -> StreamingQuery:
    """Flag rows that arrive more than ``lateness_hours`` behind the newest time seen (S3).

    Each micro-batch is compared with the newest time of the batches before it,
    then per-day partial totals, split into on-time and late, are written under
    ``batch_id=<n>``, and the newest time up to this batch under ``marks/batch_id=<n>``.
    A batch reads the mark of the batch before it only, so its work doesn't grow with the
    number of batches, and one that is replayed after a failure decides as it did at first
    and overwrites what it wrote.
    """
    marks, daily = f"{root.rstrip('/')}/marks", f"{root.rstrip('/')}/daily"

    def marks_before(spark: SparkSession, kind: str, batch_id: int) -> DataFrame:
        """The mark of the batch before; of all lower numbers where that one had no rows and so no mark."""
        try:
            if batch_id:
                return spark.read.schema(f"mark {kind}").parquet(f"{marks}/batch_id={batch_id - 1}")
        except AnalysisException:
            return spark.read.schema(f"mark {kind}, batch_id long").parquet(marks).filter(F.col("batch_id") < batch_id).select("mark")
        return spark.createDataFrame([], f"mark {kind}")

    def per_batch(df: DataFrame, batch_id: int) -> None:
        spark = df.sparkSession
        kind = df.schema[ts].dataType.simpleString()
        seen = marks_before(spark, kind, batch_id)
        rows = df.select(ts, amount).persist()
        try:
            mark = seen.agg(F.max("mark").alias("mark"))
            late = F.coalesce(F.col(ts) < F.col("mark") - F.make_dt_interval(hours=F.lit(lateness_hours)), F.lit(False))
            parts = (rows.crossJoin(F.broadcast(mark)).groupBy(late.alias("late"), F.to_date(ts).alias("day"))
                     .agg(F.sum(amount).alias("total_amount"), F.count(F.lit(1)).alias("n_rows")))
            parts.write.mode("overwrite").parquet(f"{daily}/batch_id={batch_id}")
            # written last: a batch with a mark has written its totals
            newest = rows.agg(F.max(ts).alias("mark")).union(seen.select("mark")).agg(F.max("mark").alias("mark"))
            newest.write.mode("overwrite").parquet(f"{marks}/batch_id={batch_id}")
        finally:
            rows.unpersist()

    return (stream.writeStream.foreachBatch(per_batch).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def late_rows_by_batch(spark: SparkSession, root: str) -> DataFrame:
    """(batch_id, late rows) written by ``late_data_check``."""
    d = spark.read.parquet(f"{root.rstrip('/')}/daily")
    return d.groupBy("batch_id").agg(F.sum(F.when(F.col("late"), F.col("n_rows")).otherwise(0)).alias("late_rows"))
