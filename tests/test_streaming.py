"""Streaming jobs: once-per-file ingest, stream = batch, late rows, sessions, stateful boundaries."""

import os

import pandas as pd
from pyspark.sql import functions as F

from conftest import SF_SMOKE
from larder.operators import agentlog as al
from larder.operators.silver import clean_sales
from larder.sources import fixtures as fx
from larder.sources.agentlogs import sse_bodies
from larder.streaming import agent_streams as ast
from larder.streaming import medallion as md


def _landing_files(spark, folder, n_files):
    raw = fx.sales_raw(spark, SF_SMOKE).toPandas()
    os.makedirs(folder, exist_ok=True)
    parts = [raw.iloc[i::n_files] for i in range(n_files)]
    for i, p in enumerate(parts):
        p.to_csv(os.path.join(folder, f"part{i}.csv"), index=False)
    return raw, parts


def test_bronze_ingest_reads_each_file_once_and_silver_matches_batch(spark, scratch):
    land, bronze, silver = f"{scratch}/landing", f"{scratch}/bronze", f"{scratch}/silver"
    raw = fx.sales_raw(spark, SF_SMOKE).toPandas()
    os.makedirs(land)
    raw.iloc[:3000].to_csv(f"{land}/a.csv", index=False)
    md.ingest_bronze(spark, land, bronze, f"{scratch}/ck_bronze").awaitTermination()
    assert spark.read.parquet(bronze).count() == 3000
    raw.iloc[3000:].to_csv(f"{land}/b.csv", index=False)
    md.ingest_bronze(spark, land, bronze, f"{scratch}/ck_bronze").awaitTermination()
    md.ingest_bronze(spark, land, bronze, f"{scratch}/ck_bronze").awaitTermination()  # nothing new
    b = spark.read.parquet(bronze)
    assert b.count() == len(raw)
    assert b.filter(F.col("_rescued_data").isNotNull()).count() == 0
    md.bronze_to_silver(spark, bronze, silver, f"{scratch}/ck_silver").awaitTermination()
    md.bronze_to_silver(spark, bronze, silver, f"{scratch}/ck_silver").awaitTermination()  # idempotent
    got = spark.read.parquet(silver)
    assert any(n.startswith("event_date=") for n in os.listdir(silver))
    want = clean_sales(fx.sales_raw(spark, SF_SMOKE))
    assert got.count() == want.count()
    assert got.select("transaction_id", "line_number").exceptAll(
        want.select("transaction_id", "line_number")).count() == 0


def test_late_rows_are_counted_per_batch(spark, scratch):
    src = f"{scratch}/late"
    os.makedirs(src)
    day = pd.Timestamp("2024-01-10")
    on_time = pd.DataFrame({"transaction_ts": [day + pd.Timedelta(days=d) for d in range(5)],
                            "total_amount": [1.0] * 5})
    late = pd.DataFrame({"transaction_ts": [day - pd.Timedelta(days=3), day + pd.Timedelta(days=6)],
                         "total_amount": [7.0, 1.0]})
    spark.createDataFrame(on_time).coalesce(1).write.parquet(f"{src}/b1")
    spark.createDataFrame(late).coalesce(1).write.parquet(f"{src}/b2")
    schema = "transaction_ts timestamp_ntz, total_amount double"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option(
        "recursiveFileLookup", "true").parquet(src)
    md.late_data_check(stream, f"{scratch}/late_out", f"{scratch}/ck_late").awaitTermination()
    by_batch = {r.batch_id: r.late_rows for r in md.late_rows_by_batch(spark, f"{scratch}/late_out").collect()}
    assert by_batch == {0: 0, 1: 1}        # the row three days behind the newest one
    # the watermarked window aggregation gives the finalised daily totals
    q = (md.daily_totals_stream(spark.readStream.schema(schema).parquet(f"{src}/b1"))
         .writeStream.format("memory").queryName("days").outputMode("append")
         .option("checkpointLocation", f"{scratch}/ck_days").start())
    q.processAllAvailable()
    q.stop()
    assert spark.table("days").count() == 3   # days older than the newest minus one day are final


def test_replayed_batch_decides_as_before(spark, scratch):
    """The same batch again, as after a failure between its writes and the commit."""
    src, out = f"{scratch}/src", f"{scratch}/out"
    day = pd.Timestamp("2024-01-10")
    for i, at in enumerate([day, day + pd.Timedelta(days=5), day + pd.Timedelta(days=1)]):
        spark.createDataFrame(pd.DataFrame({"transaction_ts": [at], "total_amount": [1.0]})).coalesce(1).write.parquet(f"{src}/b{i}")
    schema = "transaction_ts timestamp_ntz, total_amount double"

    def run(checkpoint):
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(src)
        md.late_data_check(stream, out, checkpoint).awaitTermination()
        return {r.batch_id: r.late_rows for r in md.late_rows_by_batch(spark, out).collect()}

    first = run(f"{scratch}/ck_1")
    assert first == {0: 0, 1: 0, 2: 1}
    # a new checkpoint runs all batches again over what they wrote before
    assert run(f"{scratch}/ck_2") == first


def _event_files(spark, scratch, extra_streams=None):
    bodies = sse_bodies(spark, SF_SMOKE, "responses")
    ev = al.with_arrival_times(al.sse_events(bodies, keep_done=True))
    pdf = ev.toPandas()
    folder = f"{scratch}/events"
    os.makedirs(folder)
    # arrival batches by event time, so the six-minute stalls fall between and within them;
    # one stream is late by a batch
    schema = ev.schema
    late = pdf["stream_id"].iloc[0]
    batch = pd.qcut(pdf["ts"].rank(method="first"), 5, labels=False) + (pdf["stream_id"] == late)
    for i in sorted(batch.unique()):
        spark.createDataFrame(pdf[batch == i], schema).coalesce(1).write.parquet(f"{folder}/{i}")
    # a far-future event moves the watermark past every real session
    sentinel = pd.DataFrame({"stream_id": ["~"], "chat_id": [0], "started_at": [pd.Timestamp("2030-01-01")],
                             "seq": [0], "payload": ["[DONE]"], "ts": [pd.Timestamp("2030-01-01")]})
    spark.createDataFrame(sentinel, schema).coalesce(1).write.parquet(f"{folder}/9")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option(
        "recursiveFileLookup", "true").parquet(folder)
    return ev, stream


def test_idle_sessions_stream_equals_batch(spark, scratch):
    ev, stream = _event_files(spark, scratch)
    q = (ast.idle_sessions_stream(stream, delay="30 days").writeStream.format("memory").queryName("sessions")
         .outputMode("append").option("checkpointLocation", f"{scratch}/ck_s").start())
    q.processAllAvailable()
    q.stop()
    got = spark.table("sessions").filter(F.col("stream_id") != "~")
    want = al.idle_sessions(ev)
    assert got.count() == want.count() > 0
    assert got.exceptAll(want.select(*got.columns)).count() == 0


def test_stateful_boundaries_stream_equals_batch(spark, scratch):
    ev, stream = _event_files(spark, scratch)
    q = (ast.boundaries_stream(stream).writeStream.format("memory").queryName("bounds")
         .outputMode("append").option("checkpointLocation", f"{scratch}/ck_b").start())
    q.processAllAvailable()
    q.stop()
    got = spark.table("bounds")
    assert {f for f in al.PART_FIELDS} <= set(got.columns) and got.filter("tool_call_id is not null").count() > 0
    batch_events = ev.filter(F.col("payload") != "[DONE]")
    want = al.with_boundaries(al.normalise_responses(batch_events)).select(*got.columns)
    assert got.count() == want.count() > 0
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
