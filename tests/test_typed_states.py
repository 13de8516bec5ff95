"""Boundaries with typed state: stream = batch over few and many batches with a restart, and what the state holds."""

import os

import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import SF_SMOKE
from larder.operators import agentlog as al
from larder.operators import features
from larder.operators.silver import clean_sales
from larder.sources import fixtures as fx
from larder.sources.agentlogs import sse_bodies
from larder.streaming import typed_states as ts


@pytest.fixture(autouse=True)
def usual_provider_afterwards(spark):
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


@pytest.fixture(scope="module")
def events(spark):
    ev = al.with_arrival_times(al.sse_events(sse_bodies(spark, SF_SMOKE, "responses"), keep_done=True))
    return ev.toPandas().sort_values(["ts", "stream_id", "seq"], kind="stable"), ev.schema


def run(spark, schema, folder, out, checkpoint):
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    q = ts.boundaries_stream(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    assert q.exception() is None


def land(spark, pdf, schema, folder):
    os.makedirs(folder, exist_ok=True)
    spark.createDataFrame(pdf, schema).coalesce(1).write.mode("append").parquet(folder)


@pytest.mark.parametrize("batches", [2, 4, 20])
def test_stream_equals_batch_with_a_restart(spark, scratch, events, batches):
    pdf, schema = events
    folder, out, checkpoint = (f"{scratch}/{x}" for x in ("in", "out", "cp"))
    part = pd.qcut(pdf["ts"].rank(method="first"), batches, labels=False)
    for i in range(batches):
        land(spark, pdf[part == i], schema, folder)
        if i == batches // 2 - 1:
            run(spark, schema, folder, out, checkpoint)
    run(spark, schema, folder, out, checkpoint)
    got = spark.read.parquet(out)
    whole = spark.createDataFrame(pdf, schema).filter(F.col("payload") != "[DONE]")
    want = al.with_boundaries(al.normalise_responses(whole)).select(*got.columns)
    assert got.count() == want.count() > 0
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_state_is_kept_by_ended_key_and_silence_closes_a_stream(spark, scratch):
    schema = "stream_id string, chat_id long, started_at timestamp_ntz, seq long, payload string, ts timestamp_ntz"
    start = pd.Timestamp("2024-01-01")
    said = lambda i, x: '{"type":"response.output_text.delta","item_id":"%s","delta":"%s"}' % (i, x)
    rows = [("s", 1, start, k, said(i, "x"), start + pd.Timedelta(seconds=k)) for k, i in enumerate(["a", "b", "c", "a", "d"])]
    folder, out, checkpoint = (f"{scratch}/{x}" for x in ("in", "out", "cp"))
    land(spark, pd.DataFrame(rows[:4], columns=schema.replace(",", "").split()[::2]), schema, folder)
    run(spark, schema, folder, out, checkpoint)
    state = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "ended").load()
    assert {r.user_map_key["name"] for r in state.collect()} == {"text:a", "text:b", "text:c"}
    land(spark, pd.DataFrame(rows[4:], columns=schema.replace(",", "").split()[::2]), schema, folder)
    # another stream two days later lets the first one's timer expire, with its last delta closed
    late = start + pd.Timedelta(days=2)
    for k in range(2):
        land(spark, pd.DataFrame([("z", 2, late, k, said("q", "y"), late + pd.Timedelta(minutes=k))], columns=schema.replace(",", "").split()[::2]), schema, folder)
    run(spark, schema, folder, out, checkpoint)
    own = spark.read.parquet(out).filter("stream_id = 's'").orderBy("ord").collect()
    assert [(r.type, r.id) for r in own][-1] == ("text-end", "d") and own[-1].is_flush
    assert [r.type for r in own if r.id == "a"] == ["text-start", "text-delta", "text-end"]
    state = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "ended").load()
    assert not [r for r in state.collect() if r.user_map_key["name"] in ("text:a", "text:b", "text:c")]


def lagged(spark, schema, folder, out, checkpoint):
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    q = ts.lags_stream(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    assert q.exception() is None


def test_lags_of_ordered_batches_equal_the_batch_job(spark, scratch):
    """Series are few here, so that they go through all batches; nulls and ties are among the rows."""
    whole = clean_sales(fx.sales_raw(spark, SF_SMOKE)).filter("transaction_ts is not null").limit(1500).withColumn(
        "product_id", F.concat(F.lit("P"), (F.length("product_id") % 3).cast("string"))).withColumn("store_id", F.lit("S1"))
    whole = whole.withColumn("quantity", F.when(F.col("line_number") == 3, None).otherwise(F.col("quantity")))
    pdf = whole.toPandas()
    schema = whole.schema
    keys = ["transaction_id", "line_number"]
    pdf = pdf.drop_duplicates(keys)
    cuts = pd.qcut(pdf["transaction_ts"].rank(method="dense"), 5, labels=False)
    folder, out, checkpoint = (f"{scratch}/{x}" for x in ("in", "out", "cp"))
    for i in range(5):
        land(spark, pdf[cuts == i], schema, folder)
        if i in (2, 4):
            lagged(spark, schema, folder, out, checkpoint)
    got = spark.read.parquet(out)
    want = features.lag_features(spark.createDataFrame(pdf, schema).withColumn("competitor", F.lit("none")))
    assert got.filter("is_late").count() == 0 and got.count() == len(pdf)
    columns = [*keys, "quantity", "quantity_lag_1", "quantity_lag_7"]
    number = lambda df: df.select(*[F.col(c).cast("string").alias(c) for c in columns])
    assert number(got).exceptAll(number(want)).count() == 0 and number(want).exceptAll(number(got)).count() == 0


def test_late_rows_stand_where_they_arrive(spark, scratch):
    whole = clean_sales(fx.sales_raw(spark, SF_SMOKE)).filter("transaction_ts is not null and quantity is not null")
    one = whole.limit(12).toPandas().assign(store_id="S", product_id="P", line_number=range(12), quantity=range(100, 112))
    one["transaction_ts"] = [pd.Timestamp("2024-01-01") + pd.Timedelta(days=i) for i in range(12)]
    one["event_date"] = [t.date() for t in one["transaction_ts"]]
    folder, out, checkpoint = (f"{scratch}/{x}" for x in ("in", "out", "cp"))
    for rows in (one.iloc[[0, 1, 2, 3, 4, 5, 6, 8, 9]], one.iloc[[7, 10, 11]]):
        land(spark, rows, whole.schema, folder)
    lagged(spark, whole.schema, folder, out, checkpoint)
    got = {r.quantity: (r.quantity_lag_1, r.quantity_lag_7, r.is_late) for r in spark.read.parquet(out).collect()}
    assert got[107] == (109, 102, True) and got[110] == (107, 103, False) and got[109] == (108, 101, False) and got[100] == (None, None, False)
