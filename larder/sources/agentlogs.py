"""Agent response streams (server-sent events) derived from the conversations.

Every assistant message becomes one response stream: its whole text is cut
into pieces (a word with the white space beside it, so that the pieces joined
are the text), and each piece emits one or more ``data:`` lines in the chosen
wire dialect.  Position rules add the other event kinds (reasoning, tool calls
and results, citations, item-done events, errors, malformed, incomplete and
unknown lines) so every branch of the normalisers is exercised.  Texts enter
JSON through the encoder only.  All of it is row-local array work on one message;
the messages are dealt by stream id first, as the per-stream windows behind need.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.sources.fixtures import messages

STEP_SECONDS = 2        # arrival spacing of consecutive lines
GAP_EVERY = 40          # every GAP_EVERY lines the stream stalls ...
GAP_SECONDS = 360       # ... for six minutes (longer than the idle limit)

SPACE = r"[\x20\x09-\x0D]"
PIECE = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+[\x20\x09-\x0D]*"


def words(text: Column) -> Column:
    """The whole text as words, each with the white space around it."""
    return F.regexp_extract_all(text, F.lit(PIECE), F.lit(0))


def bare(word: Column) -> Column:
    return F.regexp_replace(word, SPACE, "")


def _text(*pieces) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in pieces])


def quoted(*pieces) -> Column:
    """The pieces, joined, as a JSON string; encoded once, as an array of one whose brackets go."""
    return F.btrim(F.to_json(F.array(_text(*pieces))), F.lit("[]"))


def _data(*pieces) -> Column:
    return _text("data: ", *pieces)


def _when(cond: Column, *lines: Column) -> Column:
    return F.when(cond, F.array(*lines)).otherwise(F.array().cast("array<string>"))


def _responses_lines(w: Column, i: Column, conv: Column) -> Column:
    """Dialect 3 (typed response events) lines for piece ``w`` at position ``i``."""
    blk = F.floor(i / 5).cast("string")
    pos = i.cast("string")
    t = bare(w)

    def delta(text: Column) -> Column:
        return _data('{"type":"response.output_text.delta","item_id":"i', blk, '","delta":', text, "}")

    def item(kind: str, prefix: str, of: Column, body: str, *text) -> Column:
        return _data('{"type":"response.output_item.done","output_index":0,"item":{"type":"', kind, '","id":"', prefix, of, '",', body, *text)

    return F.concat(
        _when((i == 0) & (conv % 5 == 0), _data(
            '{"type":"response.output_item.done","output_index":0,"item":{"type":"message","id":"n0",'
            '"content":[{"type":"output_text","text":"<name>agent</name>"}]}}')),
        _when(i % 7 == 3, _data('{"type":"response.reasoning_summary_text.delta","item_id":"r', blk,
                                '","summary_index":0,"delta":', quoted("think ", t, " "), "}")),
        F.array(delta(quoted(w))),
        _when(i % 11 == 5,
              item("function_call", "f", pos, '"call_id":"call', pos, '","name":"lookup","arguments":',
                   quoted('{"q":', quoted(t), "}"), "}}"),
              _data('{"type":"function_call_output","call_id":"call', pos, '","output":', quoted("result ", t), "}")),
        _when(i % 13 == 7, _data('{"type":"response.output_text.annotation.added","annotation":{"type":"url_citation","url":',
                                 quoted("https://docs.test/", t), ',"title":', quoted("Doc ", t), "}}")),
        _when(i % 17 == 9, item("message", "i", blk, '"content":[{"type":"output_text","text":', quoted(t), "}]}}")),
        _when(i % 19 == 18, item("message", "m", pos, '"content":[{"type":"output_text","text":', quoted(t, " complete"), "}]}}")),
        _when(i % 23 == 11, _data('{"type":"response.output_text.delta","item_id":"i', blk, '"')),
        _when(i % 29 == 4, _data('{"type":"response.created","sequence_number":', pos, "}")),
        _when(i % 31 == 15, _data('{"type":"error","code":"rate_limit","message":', quoted("slow ", t),
                                  ',"sequence_number":', pos, "}")),
        _when(i % 37 == 6, item("reasoning", "r", pos, '"summary":[{"type":"summary_text","text":', quoted("why ", t), "}]}}")),
        _when(i % 41 == 8, _data('{"type":"response.function_call_arguments.delta","item_id":"f', pos,
                                 '","delta":"{","output_index":0,"sequence_number":', pos, "}")),
        _when((i % 43 == 20) & (conv % 6 == 0), delta(F.lit('"<has_function_call> "'))),
        _when(i % 47 == 12, delta(quoted("| ", t, " |")),
              _data('{"type":"response.output_text.annotation.added","annotation":{"type":"url_citation","url":',
                    quoted("https://docs.test/t", t), ',"title":""}}')),
    )


_USAGE = '"usage":{"prompt_tokens":1,"completion_tokens":1,"total_tokens":2},'
_CHUNK = '"object":"chat.completion.chunk","choices":[{"index":0,"delta":{"content":'


def _completions_lines(w: Column, i: Column, sid: Column) -> Column:
    """Dialect 1 (completion chunks) lines: text, tagged tools, content arrays, incomplete envelopes."""
    pos = i.cast("string")
    t = bare(w)

    def chunk(content, envelope: str = '","created":1,"model":"m",' + _USAGE) -> Column:
        return _data('{"id":', F.rtrim(quoted("cc-", sid), F.lit('"')), envelope, _CHUNK, content, "}}]}")

    return F.concat(
        F.array(chunk(quoted(w))),
        _when(i % 9 == 4, chunk(quoted('<tool_call>{"id":"t', pos, '","name":"lookup","arguments":{"q":', quoted(t), "}}</tool_call>"))),
        _when(i % 9 == 5, chunk(quoted('before <tool_call_result>{"id":"t', pos, '","content":', quoted("ok ", t), "}</tool_call_result> after"))),
        _when(i % 11 == 7, chunk(quoted('<uc_function_call>{"id":"u', pos, '","name":"legacy","arguments":', quoted(t), "}</uc_function_call>"))),
        _when(i % 13 == 8, chunk(quoted('<uc_function_result>{"id":"u', pos, '","content":"done"}</uc_function_result>'))),
        _when(i % 17 == 3, chunk(quoted("<tool_call>not json</tool_call>"))),
        _when(i % 19 == 6, chunk(quoted('<tool_call>{"id":"x",\n"name":"y"}</tool_call> x'))),
        _when(i % 23 == 10, chunk(quoted('<tool_call>\n{"id":"v', pos, '","name":"z"}</tool_call>'))),
        _when(i % 7 == 2, chunk(_text('[{"type":"text","text":', quoted(t, "+"), '},{"type":"image","image_url":"x"},'
                                      '{"type":"reasoning","summary":[{"type":"summary_text","text":', quoted("hmm ", t),
                                      '},{"type":"summary_encrypted_text","data":"zz"}]}]'))),
        _when(i % 29 == 14, _data('{"id":"cc","choices":[{"index":0,"delta":{"role":"assistant"}}]}')),
        _when(i % 31 == 20, _data('{"id":"cc","choices":')),
        # not JSON by the letter: single quotes, something behind the object
        _when(i % 37 == 11, chunk(quoted("<tool_call>{'id':'x','name':'y'}</tool_call>"))),
        _when(i % 41 == 13, chunk(quoted('<tool_call>{"id":"x","name":"y"} junk</tool_call>'))),
        # incomplete envelopes
        _when(i % 43 == 17, chunk(quoted("no usage ", t), '","created":1,"model":"m",')),
        _when(i % 47 == 19, chunk(quoted("no model ", t), '","created":1,' + _USAGE)),
        _when(i % 53 == 23, chunk(quoted("no number ", t), '","created":"1","model":"m",' + _USAGE)),
        _when(i % 59 == 29, chunk(F.lit("null"))),
        _when(i % 61 == 31, chunk(_text('[{"type":"sound","text":', quoted(t), "}]"))),
    )


def _chat_agent_lines(w: Column, i: Column, sid: Column) -> Column:
    """Dialect 2 (role-discriminated deltas) lines: assistant text, tool calls, tool results."""
    blk = F.floor(i / 5).cast("string")
    pos = i.cast("string")
    t = bare(w)
    said = ['{"id":"ev', pos, '","delta":{"role":"assistant","id":"a', blk, '","content":']
    return F.concat(
        F.array(_data(*said, quoted(w), "}}")),
        _when(i % 8 == 3, _data(*said, '"","tool_calls":[{"type":"function","id":"tc', pos,
                                '","function":{"name":"lookup","arguments":', quoted('{"q":', quoted(t), "}"),
                                '}},{"type":"function","id":"td', pos, '","function":{"name":"fetch","arguments":"[1]"}}]}}')),
        _when(i % 8 == 4, _data('{"id":"ev', pos, '","delta":{"role":"tool","name":"lookup","id":"o', pos,
                                '","tool_call_id":"tc', pos, '","content":', quoted("found ", t), "}}")),
        _when(i % 13 == 6, _data('{"id":"ev', pos, '","delta":{"role":"user","id":"u', pos,
                                 '","content":"ignored"}}')),
        _when(i % 17 == 9, _data(*said, "x", t, "}}")),
        # tool calls that are none
        _when(i % 19 == 7, _data(*said, '"","tool_calls":[{"type":"function","id":5,"function":{"name":"f","arguments":"{}"}}]}}')),
        _when(i % 23 == 8, _data(*said, '"","tool_calls":[{"type":"function","id":"e', pos, '","function":{}}]}}')),
    )


_DIALECTS = {"responses": _responses_lines, "completions": _completions_lines,
             "chat_agent": _chat_agent_lines}


def _said(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = messages(spark, sf_dir).filter(F.col("role") == "assistant")
    # a stated number of tasks: a few MB of messages become many times that of log lines behind this exchange
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return m.withColumnRenamed("id", "stream_id").repartition(tasks, "stream_id")


def sse_bodies(spark: SparkSession, sf_dir: str, dialect: str = "responses") -> DataFrame:
    """One row per response stream: (stream_id, chat_id, started_at, body)."""
    m = _said(spark, sf_dir)
    make = _DIALECTS[dialect]
    key = F.col("chat_id") if dialect == "responses" else F.col("stream_id")
    lines = F.flatten(F.transform(words(F.col("text")), lambda w, i: make(w, i, key)))
    body = F.concat(F.array_join(F.concat(lines, F.array(F.lit("data: [DONE]"))), "\n\n"), F.lit("\n\n"))
    return m.select("stream_id", "chat_id", F.col("created_at").alias("started_at"), body.alias("body"))


def whole_responses(spark: SparkSession, sf_dir: str, dialect: str) -> DataFrame:
    """One non-streamed response JSON per assistant message: (stream_id, response).

    The text is the message's whole text; rules on the chat and turn numbers add
    tool calls, tool results, reasoning and item arrays.
    """
    m = _said(spark, sf_dir)
    text = F.col("text")
    c, t = F.col("chat_id"), F.col("turn")
    ts = t.cast("string")
    if dialect == "responses":
        half = F.floor(F.length(text) / 2).cast("int")
        items = F.concat_ws(
            ",",
            _text('{"type":"message","id":"m","content":[{"type":"output_text","text":', quoted(F.substring(text, F.lit(1), half)),
                  '},{"type":"output_text","text":', quoted(F.substring(text, half + 1, F.length(text))), "}]}"),
            F.when(c % 2 == 0, _text('{"type":"function_call","id":"f","call_id":"c', ts,
                                     '","name":"lookup","arguments":"{}"},{"type":"function_call_output","call_id":"c', ts,
                                     '","output":"found"}')),
            F.when(t % 3 == 1, F.lit('{"type":"reasoning","id":"r","summary":[{"type":"summary_text","text":"why"},'
                                     '{"type":"summary_text","text":"because"}]}')))
        body = _text('{"id":"resp","output":[', items, "]}")
    elif dialect == "completions":
        content = (F.when(c % 3 == 0, quoted(' <tool_call>{"id":"k', ts, '","name":"lookup","arguments":', quoted(text), "}</tool_call> "))
                   .when(c % 3 == 1, _text('[{"type":"text","text":', quoted(text), '},{"type":"image","image_url":"u"},'
                                           '{"type":"reasoning","summary":[{"type":"summary_text","text":"hmm"}]}]'))
                   .otherwise(quoted(text, ' <tool_call>{"id":"z","name":"n"}</tool_call>')))
        body = _text('{"id":"cc","created":1,"model":"m",' + _USAGE + '"choices":[{"index":0,"message":{"role":"assistant","content":',
                     content, "}}]}")
    else:
        calls = F.when(c % 2 == 0, _text(',"tool_calls":[{"type":"function","id":"c', ts,
                                         '","function":{"name":"lookup","arguments":"{}"}}]')).otherwise("")
        tool = F.when(c % 2 == 0, _text(',{"role":"tool","name":"lookup","id":"o","tool_call_id":"c', ts,
                                        '","content":"found"}')).otherwise("")
        body = _text('{"id":"ca","messages":[{"role":"user","id":"u","content":"q"},{"role":"assistant","id":"a","content":',
                     quoted(text), calls, "}", tool, "]}")
    return m.select("stream_id", body.alias("response"))
