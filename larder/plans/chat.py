"""Chat / message table queries."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import functions as F

from larder.operators import chats as ch
from larder.plans.oracle_fixtures import with_ctes
from larder.plans.registry import register
from larder.sources import fixtures as fx

HISTORY_LIMIT = 5
RECENCY_NOW = _dt.datetime(2024, 1, 5, 12, 0, 0)


@register("accessible_chats", with_ctes("access_requests", "chats_present") + """
SELECT r.request_id, r.chat_id, r.user_id,
       CASE WHEN c.id IS NULL THEN 'not_found' WHEN c.visibility = 'public' THEN 'ok'
            WHEN c.visibility = 'private' AND r.user_id IS DISTINCT FROM c.user_id THEN 'forbidden'
            ELSE 'ok' END AS access
FROM access_requests r LEFT JOIN chats_present c ON r.chat_id = c.id""")
def q_accessible_chats(spark, sf):
    """Access decision for every read request."""
    return ch.access(fx.access_requests(spark, sf), fx.chats_present(spark, sf))


_UUID = "'" + ch.UUID_PATTERN + "'"
_URL = "'" + ch.URL_PATTERN + "'"


@register("message_validation", with_ctes("chat_requests") + f"""
, v AS (SELECT request_id, concat_ws(',',
    CASE WHEN NOT coalesce(regexp_matches(chat_uuid, {_UUID}), false) THEN 'chat_id' END,
    CASE WHEN NOT coalesce(regexp_matches(message_uuid, {_UUID}), false) THEN 'message_id' END,
    CASE WHEN NOT coalesce(role IN ('user'), false) THEN 'role' END,
    CASE WHEN coalesce(len(list_filter(parts, lambda p: NOT coalesce(
          (p.type = 'text' AND p.text IS NOT NULL AND length(p.text) >= 1)
          OR (p.type = 'file' AND p.media_type IN ('image/jpeg', 'image/png') AND p.name IS NOT NULL
              AND length(p.name) >= 1 AND coalesce(regexp_matches(p.url, {_URL}), false)), false))) > 0, true)
         THEN 'parts' END,
    CASE WHEN NOT coalesce(selected_model IN ('chat-model', 'chat-model-reasoning'), false) THEN 'model' END,
    CASE WHEN NOT coalesce(visibility IN ('public', 'private'), false) THEN 'visibility' END) AS reasons
  FROM chat_requests)
SELECT request_id, reasons = '' AS accepted, reasons FROM v""")
def q_message_validation(spark, sf):
    """Accepted / rejected incoming requests with reasons."""
    return ch.validate_requests(fx.chat_requests(spark, sf))


@register("chat_history_page", with_ctes("chats") + f"""
, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, id DESC) AS rn FROM chats)
SELECT id, user_id, title, visibility, created_at, cast(rn AS INTEGER) AS rn,
       max(rn) OVER (PARTITION BY user_id) > {HISTORY_LIMIT} AS has_more
FROM r WHERE rn <= {HISTORY_LIMIT + 1}
QUALIFY rn <= {HISTORY_LIMIT}""")
def q_chat_history_page(spark, sf):
    """First history page of every user, with has_more."""
    return ch.history_page(fx.chats(spark, sf), limit=HISTORY_LIMIT).select(
        "id", "user_id", "title", "visibility", "created_at", "rn", "has_more")


@register("chat_transcript", with_ctes("messages") + """
SELECT chat_id, id, turn, role, created_at FROM messages ORDER BY chat_id, created_at, id""")
def q_chat_transcript(spark, sf):
    """every chat's messages in time order."""
    return ch.transcript(fx.messages(spark, sf)).select("chat_id", "id", "turn", "role", "created_at")


@register("chat_recency", with_ctes("chats") + f"""
SELECT id, created_at,
  CASE WHEN cast(created_at AS DATE) = DATE '{RECENCY_NOW.date()}' THEN 'today'
       WHEN cast(created_at AS DATE) = DATE '{RECENCY_NOW.date()}' - INTERVAL 1 DAY THEN 'yesterday'
       WHEN created_at > TIMESTAMP '{RECENCY_NOW}' - INTERVAL 7 DAY THEN 'lastWeek'
       WHEN created_at > TIMESTAMP '{RECENCY_NOW}' - INTERVAL 1 MONTH THEN 'lastMonth'
       ELSE 'older' END AS bucket
FROM chats""")
def q_chat_recency(spark, sf):
    """H3: sidebar recency bucket of every chat against a fixed reference time."""
    c = fx.chats(spark, sf)
    return c.select("id", "created_at", ch.recency_bucket(F.col("created_at"), RECENCY_NOW).alias("bucket"))


@register("delete_chat_cascade", with_ctes("messages", "delete_requests") + """
SELECT id, chat_id FROM messages WHERE chat_id NOT IN (SELECT chat_id FROM delete_requests)""")
def q_delete_chat_cascade(spark, sf):
    """Messages left after deleting the requested chats (anti join)."""
    _, msgs = ch.delete_chats(fx.chats(spark, sf), fx.messages(spark, sf), fx.delete_requests(spark, sf))
    return msgs.select("id", "chat_id")


@register("trailing_delete", with_ctes("messages", "trailing_requests") + """
SELECT m.id, m.chat_id, m.created_at FROM messages m
LEFT JOIN (SELECT chat_id, min(cutoff) AS cutoff FROM trailing_requests GROUP BY chat_id) r ON m.chat_id = r.chat_id
WHERE r.cutoff IS NULL OR m.created_at < r.cutoff""")
def q_trailing_delete(spark, sf):
    """Messages left after edit-and-truncate requests (inclusive cutoff)."""
    return ch.delete_trailing(fx.messages(spark, sf), fx.trailing_delete_requests(spark, sf)).select(
        "id", "chat_id", "created_at")


@register("orphan_messages", with_ctes("messages", "chats_present") + """
SELECT id, chat_id FROM messages WHERE chat_id NOT IN (SELECT id FROM chats_present)""")
def q_orphan_messages(spark, sf):
    """Messages whose chat row is missing."""
    return ch.orphans(fx.messages(spark, sf), fx.chats_present(spark, sf)).select("id", "chat_id")


@register("chat_current_state", with_ctes("chat_versions") + """
SELECT id, arg_max(visibility, version) AS visibility, max(version) AS version,
       arg_max(updated_at, version) AS updated_at
FROM chat_versions GROUP BY id""")
def q_chat_current_state(spark, sf):
    """M2: latest version of every chat wins."""
    return ch.current_state(fx.chat_versions(spark, sf)).select("id", "visibility", "version", "updated_at")


@register("chat_last_context", with_ctes("usage") + """
SELECT chat_id, arg_max(prompt_tokens, (created_at, id)) AS prompt_tokens,
       arg_max(completion_tokens, (created_at, id)) AS completion_tokens,
       arg_max(total_tokens, (created_at, id)) AS total_tokens, max(created_at) AS updated_at
FROM usage GROUP BY chat_id""")
def q_chat_last_context(spark, sf):
    """Latest usage per chat."""
    return ch.last_context(ch.usage_of(fx.messages(spark, sf)))


@register("usage_totals", with_ctes("usage", "chats") + """
SELECT c.user_id, cast(count(*) AS BIGINT) AS n_responses, cast(sum(prompt_tokens) AS BIGINT) AS prompt_tokens,
       cast(sum(completion_tokens) AS BIGINT) AS completion_tokens, cast(sum(total_tokens) AS BIGINT) AS total_tokens
FROM usage u JOIN chats c ON u.chat_id = c.id GROUP BY c.user_id""")
def q_usage_totals(spark, sf):
    """Token usage totals per user."""
    return ch.usage_totals(ch.usage_of(fx.messages(spark, sf)), fx.chats(spark, sf))


@register("active_stream", with_ctes("streams") + """
SELECT chat_id, arg_max(stream_id, (started_at, stream_id)) AS active_stream_id, max(started_at) AS started_at
FROM streams GROUP BY chat_id""")
def q_active_stream(spark, sf):
    """One active stream per chat, the newest."""
    return ch.active_stream(fx.streams(spark, sf))


NEXT_LIMIT = 2  # small pages, so that pages go on in the test data


def _page_sql(op: str) -> str:
    return with_ctes("chats", "page_requests") + f"""
, cur AS (SELECT p.user_id, c.created_at AS t, c.id AS i FROM page_requests p JOIN chats c ON c.id = p.cursor_id),
c2 AS (SELECT c.* FROM chats c JOIN cur ON c.user_id = cur.user_id
       WHERE c.created_at {op} cur.t OR (c.created_at = cur.t AND c.id {op} cur.i)),
r2 AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, id DESC) AS rn FROM c2)
SELECT id, user_id, created_at, cast(rn AS INTEGER) AS rn,
       max(rn) OVER (PARTITION BY user_id) > {NEXT_LIMIT} AS has_more
FROM r2 WHERE rn <= {NEXT_LIMIT + 1}
QUALIFY rn <= {NEXT_LIMIT}"""


def _page(spark, sf, direction):
    return ch.history_page(fx.chats(spark, sf), NEXT_LIMIT, fx.page_requests(spark, sf), direction).select(
        "id", "user_id", "created_at", "rn", "has_more")


@register("chat_history_next_page", _page_sql("<"))
def q_chat_history_next_page(spark, sf):
    """The page of older chats that each user asks for."""
    return _page(spark, sf, "ending_before")


@register("chat_history_newer_page", _page_sql(">"))
def q_chat_history_newer_page(spark, sf):
    """The page of newer chats that each user asks for, newest first."""
    return _page(spark, sf, "starting_after")


@register("chat_history_cursors", with_ctes("chats", "page_requests") + """
SELECT user_id, cursor_id, CASE WHEN cursor_id IN (SELECT id FROM chats) THEN 'ok' ELSE 'not_found' END AS outcome
FROM page_requests""")
def q_chat_history_cursors(spark, sf):
    """Page requests whose chat isn't there."""
    return ch.cursor_outcomes(fx.chats(spark, sf), fx.page_requests(spark, sf))


@register("message_lookup", with_ctes("messages", "lookup_requests") + """
SELECT id, chat_id, role, text, created_at FROM messages WHERE id IN (SELECT message_id FROM lookup_requests)""")
def q_message_lookup(spark, sf):
    """messages by id."""
    return ch.lookup(fx.messages(spark, sf), fx.lookup_requests(spark, sf)).select(
        "id", "chat_id", "role", "text", "created_at")
