"""Chat-table and ticket decisions on hand-made rows."""

import datetime as dt

from pyspark.sql import functions as F

from larder.operators import chats as ch
from larder.operators import tickets as tk

T = dt.datetime


def test_access_order_public_before_owner_and_missing_is_not_found(spark):
    c = spark.createDataFrame([(1, "U1", "public"), (2, "U1", "private")], "id long, user_id string, visibility string")
    r = spark.createDataFrame([("a", 1, "U2"), ("b", 2, "U2"), ("c", 2, "U1"), ("d", 3, "U1")],
                              "request_id string, chat_id long, user_id string")
    got = {x.request_id: x.access for x in ch.access(r, c).collect()}
    assert got == {"a": "ok", "b": "forbidden", "c": "ok", "d": "not_found"}


def test_history_paging_and_starting_after_quirk(spark):
    rows = [(i, "U1", T(2024, 1, 1) + dt.timedelta(hours=i)) for i in range(1, 8)]
    c = spark.createDataFrame(rows, "id long, user_id string, created_at timestamp_ntz")
    first = ch.history_page(c, 3).orderBy("rn").collect()
    assert [x.id for x in first] == [7, 6, 5] and all(x.has_more for x in first)
    cur = spark.createDataFrame([("U1", 5)], "user_id string, cursor_id long")
    older = ch.history_page(c, 3, cur, "ending_before").orderBy("rn").collect()
    assert [x.id for x in older] == [4, 3, 2] and older[0].has_more
    newer = ch.history_page(c, 3, cur, "starting_after").orderBy("rn").collect()
    assert [x.id for x in newer] == [7, 6] and not newer[0].has_more   # newest first, not adjacent


def test_recency_buckets_in_order(spark):
    now = T(2024, 3, 15, 12)
    ts = [T(2024, 3, 15, 1), T(2024, 3, 14, 23), T(2024, 3, 10), T(2024, 2, 20), T(2024, 2, 1),
          T(2024, 3, 20)]
    df = spark.createDataFrame([(t,) for t in ts], "ts timestamp_ntz")
    got = [r.b for r in df.select(ch.recency_bucket(F.col("ts"), now).alias("b")).collect()]
    assert got == ["today", "yesterday", "lastWeek", "lastMonth", "older", "lastWeek"]


def test_trailing_delete_is_inclusive_and_cascade_removes_messages(spark):
    m = spark.createDataFrame([("m1", 1, T(2024, 1, 1, 0, 1)), ("m2", 1, T(2024, 1, 1, 0, 2)),
                               ("m3", 1, T(2024, 1, 1, 0, 3)), ("m4", 2, T(2024, 1, 1, 0, 1))],
                              "id string, chat_id long, created_at timestamp_ntz")
    req = spark.createDataFrame([(1, T(2024, 1, 1, 0, 2))], "chat_id long, cutoff timestamp_ntz")
    assert sorted(r.id for r in ch.delete_trailing(m, req).collect()) == ["m1", "m4"]
    c = spark.createDataFrame([(1,), (2,)], "id long")
    kept_c, kept_m = ch.delete_chats(c, m, spark.createDataFrame([(1,)], "chat_id long"))
    assert [r.id for r in kept_c.collect()] == [2] and [r.id for r in kept_m.collect()] == ["m4"]
    assert [r.id for r in ch.orphans(m, kept_c).orderBy("id").collect()] == ["m1", "m2", "m3"]


def test_latest_version_wins_and_sanitize_first_marker_only(spark):
    v = spark.createDataFrame([(1, "private", 0), (1, "public", 2), (1, "private", 1)],
                              "id long, visibility string, version int")
    assert ch.current_state(v).first().visibility == "public"
    df = spark.createDataFrame([("a<has_function_call>b<has_function_call>",), ("plain",)], "t string")
    assert [r.s for r in df.select(ch.sanitize(F.col("t")).alias("s")).collect()] == \
        ["ab<has_function_call>", "plain"]


def test_validation_reasons(spark):
    good = "123e4567-e89b-12d3-a456-426614174000"
    part = "struct<type:string,text:string,media_type:string,name:string,url:string>"
    rows = [
        ("ok", good, good, "user", [("text", "hi", None, None, None)], "chat-model", "private"),
        ("bad", "nope", good, "assistant",
         [("text", "", None, None, None), ("file", None, "image/gif", "a.gif", "https://x.test/a")],
         "other", "secret"),
    ]
    req = spark.createDataFrame(rows, f"request_id string, chat_uuid string, message_uuid string, role string, "
                                      f"parts array<{part}>, selected_model string, visibility string")
    got = {r.request_id: (r.accepted, r.reasons) for r in ch.validate_requests(req).collect()}
    assert got == {"ok": (True, ""), "bad": (False, "chat_id,role,parts,model,visibility")}


def test_ticket_bodies_and_weekly_change(spark):
    df = spark.createDataFrame([("s", "m", ""), ("s", "m", "u7")], "summary string, message string, user string")
    bodies = [r.b for r in df.select(tk.escalation_body(F.col("summary"), F.col("message"), F.col("user"))
                                     .alias("b")).collect()]
    assert bodies == ["User: agent_supervisor\nUser Message: m\nAgent Summary: s",
                      "User: u7\nUser Message: m\nAgent Summary: s"]
    cp = spark.createDataFrame([("u", "  "), ("u", "hello")], "u string, m string")
    assert [r.b for r in cp.select(tk.checkpoint_body(F.col("u"), F.col("m")).alias("b")).collect()] == \
        ["User: u", "User: u\nhello"]
    t = spark.createDataFrame([(1, "error", T(2024, 1, 1), None), (2, "error", T(2024, 1, 8), None),
                               (3, "error", T(2024, 1, 9), None)],
                              "ticket_id long, issue_category string, created_time timestamp_ntz, "
                              "close_time timestamp_ntz")
    w = {r.week_start.isoformat(): (r.n_tickets, r.wow_change) for r in tk.ticket_wow(t).collect()}
    assert w == {"2024-01-01": (1, None), "2024-01-08": (2, 1.0)}


def test_weeks_are_compared_by_the_calendar(spark):
    t = spark.createDataFrame([(1, "error", T(2024, 1, 1), None), (2, "error", T(2024, 1, 22), None), (3, "error", T(2024, 1, 23), None),
                               (4, "error", T(2024, 1, 30), None)],
                              "ticket_id long, issue_category string, created_time timestamp_ntz, close_time timestamp_ntz")
    w = {r.week_start.isoformat(): (r.prev_n_tickets, r.wow_change) for r in tk.ticket_wow(t).collect()}
    assert w == {"2024-01-01": (None, None), "2024-01-22": (None, None), "2024-01-29": (2, -0.5)}


def test_pages_with_ties_and_unknown_cursors(spark):
    at = T(2024, 1, 1)
    rows = [(i, "U1", at + dt.timedelta(hours=i // 3)) for i in range(9)] + [(100, "U2", at)]
    c = spark.createDataFrame(rows, "id long, user_id string, created_at timestamp_ntz")
    seen, cursor = [], None
    while True:
        page = ch.history_page(c.filter("user_id = 'U1'"), 2, cursor).orderBy("rn").collect()
        seen += [r.id for r in page]
        if not page or not page[0].has_more:
            break
        cursor = spark.createDataFrame([("U1", page[-1].id)], "user_id string, cursor_id long")
    assert seen == list(range(8, -1, -1))          # every chat once, ties included
    asked = spark.createDataFrame([("U1", 4), ("U2", 77)], "user_id string, cursor_id long")
    assert {r.user_id: r.outcome for r in ch.cursor_outcomes(c, asked).collect()} == {"U1": "ok", "U2": "not_found"}
    assert {r.user_id for r in ch.history_page(c, 2, asked).collect()} == {"U1"}


def test_similar_cases_cite_every_ticket(spark):
    t = spark.createDataFrame([(i, "a" if i % 4 else "b", "open") for i in range(40)], "ticket_id long, issue_category string, status string")
    rows = tk.similar_cases(t).collect()
    assert sorted(r.ticket_id for r in rows) == list(range(40))
    assert {(r.issue_category, r.n_cases) for r in rows} == {("a", 30), ("b", 10)}


def test_append_leaves_out_what_is_there(spark, scratch):
    path = f"{scratch}/messages"
    spark.createDataFrame([("m1", 1)], "id string, chat_id long").write.parquet(path)
    new = spark.createDataFrame([(2, "m2"), (2, "m2"), (9, "m1")], "chat_id long, id string")
    ch.append_new(path, new)
    ch.append_new(path, new)
    assert sorted(map(tuple, spark.read.parquet(path).collect())) == [("m1", 1), ("m2", 2)]


def test_first_append_makes_the_table(spark, scratch):
    path = f"{scratch}/made"
    ch.append_new(path, spark.createDataFrame([("m1", 1), ("m1", 1)], "id string, chat_id long"))
    ch.append_new(path, spark.createDataFrame([("m1", 1), ("m2", 1)], "id string, chat_id long"))
    assert sorted(map(tuple, spark.read.parquet(path).collect())) == [("m1", 1), ("m2", 1)]


def test_lookup_by_id(spark):
    m = spark.createDataFrame([("m1", 1), ("m2", 1)], "id string, chat_id long")
    ids = spark.createDataFrame([("m2",), ("m2",), ("none",)], "message_id string")
    assert [r.id for r in ch.lookup(m, ids).collect()] == ["m2"]


def test_checkpoint_rows(spark):
    rows = spark.createDataFrame([(1, "u", "Part 1", " "), (2, "u", "Part 2", "done")], "checkpoint_id long, user_id string, name string, message string")
    got = [(r.title, r.body, r.result) for r in tk.checkpoint_log(rows).orderBy("checkpoint_id").collect()]
    assert got == [("Checkpoint - Part 1", "User: u", "Checkpoint: Part 1"), ("Checkpoint - Part 2", "User: u\ndone", "Checkpoint: Part 2")]
