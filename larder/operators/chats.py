"""Chat and message table jobs.

The reference does these per request against a row store; here each is a
bulk job over the whole chat/message tables.  Updates and deletes become
latest-version-wins aggregates and anti joins, since Parquet tables are
rewritten, not updated in place.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

# Accepted enumerations of an incoming chat request.
ALLOWED_ROLES = ["user"]
ALLOWED_MEDIA_TYPES = ["image/jpeg", "image/png"]
ALLOWED_MODELS = ["chat-model", "chat-model-reasoning"]
ALLOWED_VISIBILITY = ["public", "private"]
UUID_PATTERN = "^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"
URL_PATTERN = "^[A-Za-z][A-Za-z0-9+.-]*://[^ ]+$"
FUNCTION_CALL_MARKER = "<has_function_call>"
PAGE_SIZE = 20


def access(requests: DataFrame, chats: DataFrame) -> DataFrame:
    """Access decision per (chat, user) request.

    Missing chat -> 'not_found'; public -> 'ok'; private and not the owner ->
    'forbidden'.  Visibility is checked before ownership.
    """
    c = chats.select(F.col("id").alias("chat_id"), F.col("user_id").alias("owner_id"), "visibility")
    j = requests.join(c, "chat_id", "left")
    decision = (F.when(F.col("owner_id").isNull() & F.col("visibility").isNull(), "not_found")
                .when(F.col("visibility") == "public", "ok")
                .when((F.col("visibility") == "private") & ~F.col("user_id").eqNullSafe(F.col("owner_id")),
                      "forbidden")
                .otherwise("ok"))
    return j.select("request_id", "chat_id", "user_id", decision.alias("access"))


def validate_requests(req: DataFrame) -> DataFrame:
    """Accept or reject incoming chat requests, with the reasons."""
    def bad_part(p: Column) -> Column:
        text_ok = (p["type"] == "text") & p["text"].isNotNull() & (F.length(p["text"]) >= 1)
        file_ok = ((p["type"] == "file") & p["media_type"].isin(*ALLOWED_MEDIA_TYPES)
                   & p["name"].isNotNull() & (F.length(p["name"]) >= 1)
                   & F.coalesce(p["url"].rlike(URL_PATTERN), F.lit(False)))
        return ~F.coalesce(text_ok | file_ok, F.lit(False))

    checks = [
        ("chat_id", ~F.coalesce(F.col("chat_uuid").rlike(UUID_PATTERN), F.lit(False))),
        ("message_id", ~F.coalesce(F.col("message_uuid").rlike(UUID_PATTERN), F.lit(False))),
        ("role", ~F.coalesce(F.col("role").isin(*ALLOWED_ROLES), F.lit(False))),
        ("parts", F.coalesce(F.exists("parts", bad_part), F.lit(True))),
        ("model", ~F.coalesce(F.col("selected_model").isin(*ALLOWED_MODELS), F.lit(False))),
        ("visibility", ~F.coalesce(F.col("visibility").isin(*ALLOWED_VISIBILITY), F.lit(False))),
    ]
    reasons = F.concat_ws(",", *[F.when(cond, F.lit(name)) for name, cond in checks])
    return req.select("request_id", (reasons == "").alias("accepted"), reasons.alias("reasons"))


def history_page(chats: DataFrame, limit: int = PAGE_SIZE, cursors: DataFrame | None = None,
                 direction: str = "ending_before") -> DataFrame:
    """One page of every user's chats, newest first, with ``has_more``.

    ``cursors`` (user_id, cursor_id) pages relative to a chat: ``ending_before``
    keeps older chats, ``starting_after`` keeps newer ones but still lists them
    newest first (so it is not the adjacent page, as in the source).  Chats of
    one moment are ordered by id, so none is skipped between pages.  Users whose
    cursor isn't there get no page; ``cursor_outcomes`` names them.
    ``row_number <= limit + 1`` is planned as a group limit before the shuffle,
    so a user with very many chats sends at most ``limit + 1`` rows per task.
    """
    c = chats
    if cursors is not None:
        cur = cursors.join(chats.select(F.col("id").alias("cursor_id"),
                                        F.struct(F.col("created_at").alias("t"), F.col("id").alias("i")).alias("at")), "cursor_id")
        c = c.join(cur.select("user_id", "at"), "user_id")
        own = F.struct(F.col("created_at").alias("t"), F.col("id").alias("i"))
        c = c.filter(own < F.col("at") if direction == "ending_before" else own > F.col("at")).drop("at")
    w = Window.partitionBy("user_id").orderBy(F.col("created_at").desc(), F.col("id").desc())
    ranked = c.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= limit + 1)
    more = F.max("rn").over(Window.partitionBy("user_id")) > limit
    return ranked.withColumn("has_more", more).filter(F.col("rn") <= limit)


def cursor_outcomes(chats: DataFrame, cursors: DataFrame) -> DataFrame:
    """Is the chat that a page request names there?"""
    ids = chats.select(F.col("id").alias("cursor_id"), F.lit("ok").alias("found")).distinct()
    return cursors.join(ids, "cursor_id", "left").select(
        "user_id", "cursor_id", F.coalesce("found", F.lit("not_found")).alias("outcome"))


def lookup(table: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """Rows by id, for all requested ids at once (F6); ids that aren't there give no row."""
    return table.join(ids.select(F.col(ids.columns[0]).alias(key)).distinct(), key, "left_semi")


def transcript(messages: DataFrame) -> DataFrame:
    """Messages of every chat in time order.

    A global sort is range-partitioned, so one very long chat is spread over
    several tasks instead of landing in one window partition.
    """
    return messages.orderBy("chat_id", "created_at", "id")


def month_before(t: _dt.datetime) -> _dt.datetime:
    y, m = (t.year, t.month - 1) if t.month > 1 else (t.year - 1, 12)
    import calendar
    return t.replace(year=y, month=m, day=min(t.day, calendar.monthrange(y, m)[1]))


def recency_bucket(ts: Column, now: _dt.datetime) -> Column:
    """today / yesterday / lastWeek / lastMonth / older against ``now`` (H3).

    The reference time is a parameter (never the wall clock), checked in
    this order; a week and a month are calendar arithmetic on ``now``.
    """
    today = now.date()
    d = ts.cast("date")
    return (F.when(d == F.lit(today), "today")
            .when(d == F.lit(today - _dt.timedelta(days=1)), "yesterday")
            .when(ts > F.lit(now - _dt.timedelta(days=7)), "lastWeek")
            .when(ts > F.lit(month_before(now)), "lastMonth")
            .otherwise("older"))


def delete_chats(chats: DataFrame, messages: DataFrame, doomed: DataFrame):
    """Delete chats and, in cascade, their messages (C8) -> (chats, messages)."""
    ids = doomed.select(F.col("chat_id").alias("id")).distinct()
    kept_chats = chats.join(ids, "id", "left_anti")
    kept_msgs = messages.join(ids.withColumnRenamed("id", "chat_id"), "chat_id", "left_anti")
    return kept_chats, kept_msgs


def delete_trailing(messages: DataFrame, requests: DataFrame) -> DataFrame:
    """Drop each requested chat's messages at or after the cutoff (C8, inclusive)."""
    cut = requests.groupBy("chat_id").agg(F.min("cutoff").alias("cutoff"))
    j = messages.join(cut, "chat_id", "left")
    return j.filter(F.col("cutoff").isNull() | (F.col("created_at") < F.col("cutoff"))).drop("cutoff")


def orphans(messages: DataFrame, chats: DataFrame) -> DataFrame:
    """Messages whose chat does not exist."""
    return messages.join(chats.select(F.col("id").alias("chat_id")), "chat_id", "left_anti")


def current_state(versions: DataFrame, key: str = "id", order: str = "version") -> DataFrame:
    """Latest version of each key wins (M2): one aggregate with map-side partials."""
    cols = [c for c in versions.columns if c != key]
    latest = F.max_by(F.struct(*cols), F.col(order))
    return versions.groupBy(key).agg(latest.alias("s")).select(key, "s.*")


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, " "), lambda w: w != ""))


def usage_of(messages: DataFrame) -> DataFrame:
    """Token usage per assistant message, derived from its whole text."""
    a = messages.filter(F.col("role") == "assistant")
    completion = word_count(F.col("text"))
    prompt = (F.col("turn") * 10 + F.length("text") % 50).cast("bigint")
    return a.select("id", "chat_id", "created_at", prompt.alias("prompt_tokens"),
                    completion.cast("bigint").alias("completion_tokens"),
                    (prompt + completion).cast("bigint").alias("total_tokens"))


def last_context(usage: DataFrame) -> DataFrame:
    """Latest usage per chat, last write wins."""
    latest = F.max_by(F.struct("prompt_tokens", "completion_tokens", "total_tokens", "created_at"),
                      F.struct("created_at", "id"))
    return usage.groupBy("chat_id").agg(latest.alias("u")).select(
        "chat_id", "u.prompt_tokens", "u.completion_tokens", "u.total_tokens",
        F.col("u.created_at").alias("updated_at"))


def usage_totals(usage: DataFrame, chats: DataFrame) -> DataFrame:
    """Token totals per user (D23): usage pre-summed per chat, then joined."""
    per_chat = usage.groupBy("chat_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("prompt_tokens").alias("p"),
        F.sum("completion_tokens").alias("c"), F.sum("total_tokens").alias("t"))
    j = per_chat.join(chats.select(F.col("id").alias("chat_id"), "user_id"), "chat_id", "inner")
    return j.groupBy("user_id").agg(
        F.sum("n").cast("bigint").alias("n_responses"), F.sum("p").cast("bigint").alias("prompt_tokens"),
        F.sum("c").cast("bigint").alias("completion_tokens"), F.sum("t").cast("bigint").alias("total_tokens"))


def active_stream(streams: DataFrame) -> DataFrame:
    """The newest stream of each chat replaces older ones."""
    newest = F.max_by(F.struct("stream_id", "started_at"), F.struct("started_at", "stream_id"))
    return streams.groupBy("chat_id").agg(newest.alias("s")).select(
        "chat_id", F.col("s.stream_id").alias("active_stream_id"), F.col("s.started_at").alias("started_at"))


def sanitize(text: Column) -> Column:
    """Remove the first function-call marker only (H8)."""
    pos = F.instr(text, FUNCTION_CALL_MARKER)
    n = len(FUNCTION_CALL_MARKER)
    return F.when(pos > 0, F.concat(F.substring(text, F.lit(1), pos - 1),
                                    F.substring(text, pos + n, F.length(text)))).otherwise(text)


def append_new(path: str, new: DataFrame, key: str = "id") -> None:
    """Append chats or messages to the table at ``path``, which the first append makes (M1).

    Rows whose key is in the table already are left out, so a job that runs
    again after a failure appends nothing twice.  ``keyed`` has tables that are
    dealt to buckets, where an append reads only the buckets of its keys.
    """
    rows = new.dropDuplicates([key])
    try:
        there = new.sparkSession.read.parquet(path)
    except AnalysisException:
        rows.write.parquet(path)
        return
    rows.join(there.select(key), key, "left_anti").select(there.columns).write.mode("append").parquet(path)
