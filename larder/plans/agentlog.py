"""Agent response-stream queries (three wire dialects)."""

from __future__ import annotations

from pyspark.sql import functions as F

from larder.operators import agentlog as al
from larder.plans import oracle_agentlog  # noqa: F401  (registers the CTEs)
from larder.plans.oracle_fixtures import with_ctes
from larder.plans.registry import register
from larder.sources import fixtures as fx
from larder.sources.agentlogs import GAP_EVERY, GAP_SECONDS, STEP_SECONDS, sse_bodies, whole_responses

PARTS_OUT = ["stream_id", "seq", "sub"] + al.PART_FIELDS
_PARTS_SQL = ", ".join(PARTS_OUT)


def events(spark, sf, dialect="responses"):
    return al.sse_events(sse_bodies(spark, sf, dialect))


def parts(spark, sf, dialect="responses"):
    ev = events(spark, sf, dialect)
    fn = {"responses": al.normalise_responses, "completions": al.normalise_completions,
          "chat_agent": al.normalise_chat_agent}[dialect]
    return fn(ev)


def stream_parts(spark, sf):
    return al.with_boundaries(parts(spark, sf))


def ui(spark, sf):
    return al.ui_parts(stream_parts(spark, sf))


@register("sse_events", with_ctes("events_responses") + "SELECT stream_id, seq, payload FROM events_responses")
def q_sse_events(spark, sf):
    """M3: event-stream bodies to one row per data payload."""
    return events(spark, sf).select("stream_id", "seq", "payload")


@register("normalise_responses", with_ctes("parts_responses") + f"SELECT {_PARTS_SQL} FROM parts_responses")
def q_normalise_responses(spark, sf):
    """M6: typed response events to stream parts."""
    return parts(spark, sf).select(*PARTS_OUT)


@register("normalise_completions", with_ctes("parts_completions") + f"SELECT {_PARTS_SQL} FROM parts_completions")
def q_normalise_completions(spark, sf):
    """M4 + M8: completion chunks (string or item-array content, tagged tools) to parts."""
    return parts(spark, sf, "completions").select(*PARTS_OUT)


@register("normalise_chat_agent", with_ctes("parts_chat_agent") + f"SELECT {_PARTS_SQL} FROM parts_chat_agent")
def q_normalise_chat_agent(spark, sf):
    """M5: role-discriminated deltas to parts."""
    return parts(spark, sf, "chat_agent").select(*PARTS_OUT)


@register("tagged_tool_calls", with_ctes("parts_completions") + """
SELECT stream_id, seq, sub, type, tool_call_id, tool_name, input, result FROM parts_completions
WHERE type IN ('tool-call', 'tool-result')""")
def q_tagged_tool_calls(spark, sf):
    """M8: tool calls / results recovered from tagged text (both tag generations)."""
    p = parts(spark, sf, "completions")
    return p.filter(F.col("type").isin("tool-call", "tool-result")).select(
        "stream_id", "seq", "sub", "type", "tool_call_id", "tool_name", "input", "result")


@register("serialise_tool_calls", with_ctes("parts_completions") + """
SELECT stream_id, seq, sub, type,
       CASE WHEN type = 'tool-call' THEN '<tool_call>' ||
              CASE WHEN input IS NULL THEN json_object('id', tool_call_id, 'name', tool_name)
                   ELSE json_object('id', tool_call_id, 'name', tool_name, 'arguments', input) END || '</tool_call>'
            ELSE '<tool_call_result>' ||
              CASE WHEN result IS NULL THEN json_object('id', tool_call_id)
                   ELSE json_object('id', tool_call_id, 'content', result) END || '</tool_call_result>' END AS tagged
FROM parts_completions WHERE type IN ('tool-call', 'tool-result')""")
def q_serialise_tool_calls(spark, sf):
    """Tool parts back to the current tag form."""
    return al.serialise_tool_parts(parts(spark, sf, "completions"))


@register("tool_call_pairs", with_ctes("parts_responses") + """
SELECT c.stream_id, c.tool_call_id, c.tool_name AS call_tool_name, c.input, c.seq AS call_seq, r.result
FROM (SELECT * FROM parts_responses WHERE type = 'tool-call') c
LEFT JOIN (SELECT stream_id, tool_call_id, arg_min(result, (seq, sub)) AS result FROM parts_responses
           WHERE type = 'tool-result' GROUP BY stream_id, tool_call_id) r
  ON c.stream_id = r.stream_id AND c.tool_call_id = r.tool_call_id""")
def q_tool_call_pairs(spark, sf):
    """Each tool call with its result by call id."""
    return al.tool_call_pairs(parts(spark, sf))


@register("delta_boundaries", with_ctes("stream_parts") + """
SELECT stream_id, ord, type, id, delta, is_flush FROM stream_parts""")
def q_delta_boundaries(spark, sf):
    """E8 + E9 + S6 batch twin: injected start/end parts, parts after an end dropped."""
    return stream_parts(spark, sf).select("stream_id", "ord", "type", "id", "delta", "is_flush")


@register("assembled_text", with_ctes("assembled") + "SELECT stream_id, id, kind, first_ord, text FROM assembled")
def q_assembled_text(spark, sf):
    """M9: streamed deltas assembled per item."""
    return al.assembled_text(stream_parts(spark, sf))


@register("message_segments", with_ctes("segments") + """
SELECT stream_id, pos, type, cast(segment AS BIGINT) AS segment FROM segments""")
def q_message_segments(spark, sf):
    """Render segments of each message's parts."""
    return al.segments(ui(spark, sf)).select("stream_id", "pos", "type",
                                             F.col("segment").cast("bigint").alias("segment"))


_CITE = ("'[' || CASE WHEN coalesce(title, '') <> '' THEN title ELSE url END || '](' || url || "
         f"'{al.CITATION_SUFFIX})'")


@register("message_markdown", with_ctes("segments") + f"""
, a AS (SELECT *, max(CASE WHEN type = 'text' THEN pos END) OVER (
                    PARTITION BY stream_id, segment ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
                    AS anchor FROM segments),
p AS (SELECT stream_id, segment, anchor,
             max(CASE WHEN pos = anchor THEN text END) AS atext,
             string_agg(' ' || {_CITE}, '' ORDER BY pos) FILTER (WHERE type = 'source-url') AS cites
      FROM a GROUP BY stream_id, segment, anchor)
SELECT stream_id, cast(segment AS BIGINT) AS segment,
       string_agg(CASE WHEN anchor IS NULL THEN coalesce(cites, '')
                       WHEN ends_with(atext, '|') AND cites IS NOT NULL
                         THEN substr(atext, 1, length(atext) - 1) || cites || '|'
                       ELSE atext || coalesce(cites, '') END, '' ORDER BY coalesce(anchor, -1)) AS markdown
FROM p GROUP BY stream_id, segment""")
def q_message_markdown(spark, sf):
    """H6: each segment joined to markdown with citations (table-pipe rule)."""
    md = al.segment_markdown(al.segments(ui(spark, sf)))
    return md.select("stream_id", F.col("segment").cast("bigint").alias("segment"), "markdown")


@register("speaker_names", with_ctes("ui_parts") + """
SELECT stream_id, pos, regexp_replace(regexp_replace(text, '<name>', ''), '</name>', '') AS name
FROM ui_parts WHERE type = 'text' AND starts_with(text, '<name>') AND ends_with(text, '</name>')""")
def q_speaker_names(spark, sf):
    """H7: speaker-name parts and the names they carry."""
    u = ui(spark, sf)
    return u.filter(al.is_name_part(F.col("type"), F.col("text"))).select(
        "stream_id", "pos", al.speaker_name(F.col("text")).alias("name"))


@register("message_text", with_ctes("ui_parts") + """
SELECT stream_id, regexp_replace(string_agg(text, '' ORDER BY pos), '<has_function_call>', '') AS text
FROM ui_parts WHERE type = 'text' GROUP BY stream_id""")
def q_message_text(spark, sf):
    """H5 + H8: plain text of each streamed message, marker removed once."""
    return al.message_text(ui(spark, sf))


DIALECTS = ("responses", "completions", "chat_agent")


@register("stream_errors", with_ctes(*[f"parts_{d}" for d in DIALECTS]) + " UNION ALL ".join(f"""
SELECT '{d}' AS dialect, stream_id, count(*) AS n_parts, count(*) FILTER (WHERE type = 'error') AS n_errors,
       count(*) FILTER (WHERE type = 'error' AND error = 'parse_error') AS n_failed_parses,
       CASE WHEN count(*) FILTER (WHERE type = 'error' AND error = 'parse_error') > 0 THEN 'error'
            ELSE 'unknown' END AS finish_reason
FROM parts_{d} GROUP BY stream_id""" for d in DIALECTS))
def q_stream_errors(spark, sf):
    """Error parts, failed parses and finish reason per stream, for every dialect."""
    out = None
    for d in DIALECTS:
        one = al.stream_errors(parts(spark, sf, d)).select(F.lit(d).alias("dialect"), "*")
        out = one if out is None else out.unionByName(one)
    return out


@register("resume_from_cursor", with_ctes("events_responses") + """
SELECT stream_id, seq, payload FROM events_responses WHERE seq >= (chat_id % 10) * 5""")
def q_resume_from_cursor(spark, sf):
    """Events a reconnecting reader replays from its cursor (one cursor per stream)."""
    cur = fx.streams(spark, sf).select("stream_id", ((F.col("chat_id") % 10) * 5).alias("cursor"))
    return al.resume_from_cursor(events(spark, sf), cur).select("stream_id", "seq", "payload")


@register("idle_sessions", with_ctes("events_responses") + f"""
, t AS (SELECT stream_id, started_at + to_seconds(cast(seq * {STEP_SECONDS} + (seq // {GAP_EVERY}) * {GAP_SECONDS}
                                                        AS BIGINT)) AS ts FROM events_responses),
g AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 5 MINUTE THEN 1 ELSE 0 END AS nw
      FROM t WINDOW w AS (PARTITION BY stream_id ORDER BY ts)),
s AS (SELECT *, sum(nw) OVER (PARTITION BY stream_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
               AS sid FROM g)
SELECT stream_id, min(ts) AS session_start, max(ts) + INTERVAL 5 MINUTE AS session_end, count(*) AS n_events
FROM s GROUP BY stream_id, sid""")
def q_idle_sessions(spark, sf):
    """S4 batch twin: activity sessions closed after 5 idle minutes."""
    ev = al.with_arrival_times(events(spark, sf), STEP_SECONDS, GAP_EVERY, GAP_SECONDS)
    return al.idle_sessions(ev)


@register("normalise_whole_responses",
          with_ctes("whole_responses", "whole_completions", "whole_chat_agent") + oracle_agentlog.WHOLE_SQL)
def q_normalise_whole_responses(spark, sf):
    """M7: non-streamed responses of all three dialects to content parts."""
    out = None
    for d in DIALECTS:
        part = al.normalise_whole_responses(whole_responses(spark, sf, d), d).select(
            F.lit(d).alias("dialect"), "*")
        out = part if out is None else out.unionByName(part)
    return out
