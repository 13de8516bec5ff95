"""Bucketed chat tables: what an operation touches, and that it may run again."""

import datetime as dt
import os

from pyspark.sql import functions as F

from larder.operators import keyed

MESSAGES = "id string, chat_id long, created_at timestamp, text string"


def at(minute):
    return dt.datetime(2024, 5, 1, 12) + dt.timedelta(minutes=minute)


def messages(spark, chats, per=3, text="t"):
    return spark.createDataFrame([(f"c{c}m{i}", c, at(i), f"{text}{i}") for c in chats for i in range(per)], MESSAGES)


def files(path):
    return {os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def rows(spark, path):
    return sorted((r.id, r.chat_id, r.text) for r in keyed.read(spark, path).collect())


def test_first_append_makes_the_table_and_a_replay_adds_nothing(spark, scratch):
    path = f"{scratch}/t"
    new = messages(spark, range(20))
    keyed.append_new(path, new.union(new), by="chat_id", buckets=8)
    assert rows(spark, path) == sorted((f"c{c}m{i}", c, f"t{i}") for c in range(20) for i in range(3))
    keyed.append_new(path, new, by="chat_id")
    more = messages(spark, range(18, 25)).select("text", "id", "created_at", "chat_id")
    keyed.append_new(path, more, by="chat_id")
    keyed.append_new(path, more, by="chat_id")
    assert rows(spark, path) == sorted((f"c{c}m{i}", c, f"t{i}") for c in range(25) for i in range(3))
    assert spark.read.parquet(path).select(keyed.COUNT).distinct().collect() == [(8,)]
    keyed.append_new(path, spark.createDataFrame([(None, 1, at(0), "x")], MESSAGES), by="chat_id")
    assert keyed.read(spark, path).count() == 75


def test_deleting_a_chat_rewrites_one_bucket(spark, scratch):
    path = f"{scratch}/t"
    keyed.append_new(path, messages(spark, range(60)), by="chat_id", buckets=16)
    before = files(path)
    doomed = spark.createDataFrame([(7,), (7,)], "chat_id long")
    assert keyed.delete(path, doomed, "chat_id") == 1
    gone, kept = before - files(path), before & files(path)
    folders = lambda some: {os.path.dirname(f) for f in some}
    assert len(folders(gone)) == 1 and folders(kept) == folders(before) - folders(gone)
    want = sorted((f"c{c}m{i}", c, f"t{i}") for c in range(60) if c != 7 for i in range(3))
    assert rows(spark, path) == want
    keyed.delete(path, doomed, "chat_id")
    assert rows(spark, path) == want


def test_buckets_may_become_empty_and_fill_again(spark, scratch):
    path = f"{scratch}/t"
    assert keyed.delete(path, spark.createDataFrame([(1,)], "chat_id long"), "chat_id") == 0
    keyed.append_new(path, messages(spark, range(5)), by="chat_id", buckets=4)
    keyed.delete(path, spark.range(5).select(F.col("id").alias("chat_id")), "chat_id")
    assert rows(spark, path) == []
    keyed.append_new(path, messages(spark, [3]), by="chat_id")
    assert [r[0] for r in rows(spark, path)] == ["c3m0", "c3m1", "c3m2"]


def test_trailing_delete_and_updates(spark, scratch):
    path = f"{scratch}/t"
    keyed.append_new(path, messages(spark, range(6)), by="chat_id", buckets=4)
    cut = spark.createDataFrame([(2, at(1)), (2, at(2)), (4, at(0)), (99, at(0))], "chat_id long, cutoff timestamp")
    keyed.delete_trailing(path, cut)
    left = [r[0] for r in rows(spark, path)]
    assert "c2m0" in left and not {"c2m1", "c2m2", "c4m0", "c4m1", "c4m2"} & set(left) and len(left) == 13
    new = spark.createDataFrame([("c1m1", 1, at(1), "old"), ("c1m1", 1, at(9), "new"), ("c9m0", 9, at(0), "made")], MESSAGES)
    keyed.update(path, new, by="chat_id", order="created_at")
    keyed.update(path, new, by="chat_id", order="created_at")
    got = {r[0]: r[2] for r in rows(spark, path)}
    assert got["c1m1"] == "new" and got["c9m0"] == "made" and got["c1m0"] == "t0" and len(rows(spark, path)) == 14


def test_an_operation_reads_its_buckets_only(spark, scratch):
    path = f"{scratch}/t"
    keyed.append_new(path, messages(spark, range(60)), by="chat_id", buckets=16)
    plan = spark.read.parquet(path).filter(F.col(keyed.BUCKET).isin([3]))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(key_bucket" in plan or "PartitionFilters: [(key_bucket" in plan


def test_append_stream_takes_each_row_once(spark, scratch):
    source, path = f"{scratch}/in", f"{scratch}/t"
    messages(spark, range(4)).write.parquet(source)
    messages(spark, range(2, 6)).write.mode("append").parquet(source)
    stream = lambda: spark.readStream.schema(MESSAGES).option("maxFilesPerTrigger", "1").parquet(source)
    keyed.append_stream(stream(), path, f"{scratch}/cp", by="chat_id", buckets=4).awaitTermination()
    want = sorted((f"c{c}m{i}", c, f"t{i}") for c in range(6) for i in range(3))
    assert rows(spark, path) == want
    # all over again with a checkpoint that was lost
    keyed.append_stream(stream(), path, f"{scratch}/cp2", by="chat_id").awaitTermination()
    assert rows(spark, path) == want
