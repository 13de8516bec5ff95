"""Hand-written golden event logs for the three dialects and the UI-part jobs."""

import datetime as dt
import json

import pytest

from larder.operators import agentlog as al

T0 = dt.datetime(2024, 1, 1)


def _bodies(spark, streams):
    rows = [(sid, 1, T0, "".join(f"data: {ln}\n\n" for ln in lines) + "data: [DONE]\n\n")
            for sid, lines in streams.items()]
    return spark.createDataFrame(rows, "stream_id string, chat_id long, started_at timestamp_ntz, body string")


RESPONSES = [
    '{"type":"response.output_text.delta","item_id":"a","delta":"Hel"}',
    '{"type":"response.output_text.delta","item_id":"a","delta":"lo"}',
    '{"type":"response.output_item.done","output_index":0,"item":{"type":"function_call","id":"f1",'
    '"call_id":"c1","name":"search","arguments":"{}"}}',
    '{"type":"function_call_output","call_id":"c1","output":"42"}',
    '{"type":"response.output_text.delta","item_id":"a","delta":" again"}',
    '{"type":"response.output_item.done","output_index":0,"item":{"type":"message","id":"a",'
    '"content":[{"type":"output_text","text":"Hello"}]}}',
    '{"type":"response.output_item.done","output_index":0,"item":{"type":"message","id":"b",'
    '"content":[{"type":"output_text","text":"Whole"}]}}',
    '{not json',
    '{"type":"response.created"}',
    '{"type":"response.output_text.annotation.added","annotation":{"type":"url_citation","url":"u1","title":"T1"}}',
    '{"type":"response.output_text.delta","item_id":"c","delta":"tail"}',
]


def test_responses_boundaries_golden(spark):
    ev = al.sse_events(_bodies(spark, {"s1": RESPONSES}))
    parts = al.normalise_responses(ev)
    assert parts.filter("type = 'error'").count() == 1          # malformed line
    out = al.with_boundaries(parts).orderBy("ord").collect()
    assert [(r.type, r.id) for r in out] == [
        ("text-start", "a"), ("text-delta", "a"), ("text-delta", "a"), ("text-end", "a"),
        ("tool-call", None), ("tool-result", None),
        # resumed delta of 'a' and its finished item are dropped: 'a' already ended
        ("text-start", "b"), ("text-start", "b"), ("text-delta", "b"), ("text-end", "b"),
        ("error", None), ("source", "s1:9"),
        ("text-start", "c"), ("text-delta", "c"), ("text-end", "c"),   # dangling delta flushed
    ]
    assert out[-1].is_flush and not any(r.is_flush for r in out[:-1])
    text = {r.id: r.text for r in al.assembled_text(al.with_boundaries(parts)).collect()}
    assert text == {"a": "Hello", "b": "Whole", "c": "tail"}
    tool = al.tool_call_pairs(parts).first()
    assert (tool.tool_call_id, tool.call_tool_name, tool.result) == ("c1", al.TOOL_NAME, "42")
    err = al.stream_errors(parts).first()
    assert (err.n_errors, err.n_failed_parses, err.finish_reason) == (1, 1, "error")


def _chunk(content):
    return json.dumps({"id": "x", "created": 1, "model": "m",
                       "usage": {"prompt_tokens": 1, "completion_tokens": 1, "total_tokens": 2},
                       "object": "chat.completion.chunk", "choices": [{"index": 0, "delta": {"content": content}}]})


def test_completions_tags_golden(spark):
    lines = [
        _chunk('Hi <tool_call>{"id":"t1","name":"f","arguments":{"a":1}}</tool_call> there'),
        _chunk('<tool_call>{"id":"t2",\n"name":"g"}</tool_call> after'),       # spans lines: stays text
        _chunk("<uc_function_result>{oops}</uc_function_result>"),              # bad JSON: stays text
        _chunk('<uc_function_result>{"id":"t1","content":"ok"}</uc_function_result>'),
        _chunk('<tool_call>{"name":"no id"}</tool_call>'),                      # no id: stays text
        _chunk([{"type": "text", "text": "A"}, {"type": "image", "image_url": "u"},
                {"type": "reasoning", "summary": [{"type": "summary_text", "text": "R"},
                                                  {"type": "summary_encrypted_text", "data": "z"}]}]),
        json.dumps({"id": "x", "choices": [{"index": 0, "delta": {"content": "no envelope"}}]}),
    ]
    parts = al.normalise_completions(al.sse_events(_bodies(spark, {"s": lines}))).orderBy("seq", "sub").collect()
    got = [(r.type, r.delta, r.tool_call_id, r.tool_name, r.input, r.result) for r in parts]
    assert got == [
        ("text-delta", "Hi ", None, None, None, None),
        ("tool-call", None, "t1", "f", '{"a":1}', None),
        ("text-delta", " there", None, None, None, None),
        ("text-delta", '<tool_call>{"id":"t2",\n"name":"g"}</tool_call> after', None, None, None, None),
        ("text-delta", "<uc_function_result>{oops}</uc_function_result>", None, None, None, None),
        ("tool-result", None, "t1", al.TOOL_NAME, None, "ok"),
        ("text-delta", '<tool_call>{"name":"no id"}</tool_call>', None, None, None, None),
        ("text-delta", "A", None, None, None, None),
        ("reasoning-delta", "R", None, None, None, None),
        ("error", None, None, None, None, None),
    ]
    tagged = {r.tagged for r in al.serialise_tool_parts(
        al.normalise_completions(al.sse_events(_bodies(spark, {"s": lines})))).collect()}
    assert tagged == {'<tool_call>{"id":"t1","name":"f","arguments":"{\\"a\\":1}"}</tool_call>',
                      '<tool_call_result>{"id":"t1","content":"ok"}</tool_call_result>'}


def test_chat_agent_golden(spark):
    lines = [
        '{"id":"1","delta":{"role":"assistant","id":"m1","content":"Hey"}}',
        '{"id":"2","delta":{"role":"assistant","id":"m1","content":"","tool_calls":[{"type":"function",'
        '"id":"c9","function":{"name":"lookup","arguments":"{}"}}]}}',
        '{"id":"3","delta":{"role":"tool","name":"lookup","id":"o1","tool_call_id":"c9","content":"found"}}',
        '{"id":"4","delta":{"role":"user","id":"u","content":"x"}}',
        '{"id":"5","delta":{"role":"assistant"}}',
    ]
    parts = al.normalise_chat_agent(al.sse_events(_bodies(spark, {"s": lines}))).orderBy("seq", "sub").collect()
    assert [(r.type, r.id, r.delta, r.tool_call_id, r.tool_name, r.result) for r in parts] == [
        ("text-delta", "m1", "Hey", None, None, None),
        ("tool-call", None, None, "c9", "lookup", None),
        ("tool-result", None, None, "c9", al.TOOL_NAME, "found"),
        ("error", None, None, None, None, None),
    ]


def test_segments_markdown_names_and_text(spark):
    ui = spark.createDataFrame([
        ("s", 1, "text", "<name>Bot</name>", None, None),
        ("s", 2, "text", "Hello", None, None),
        ("s", 3, "source-url", None, "u1", "T1"),
        ("s", 4, "text", "| a |", None, None),
        ("s", 5, "source-url", None, "u2", ""),
        ("s", 6, "tool", "{}", None, None),
        ("s", 7, "text", "x <has_function_call> y <has_function_call>", None, None),
    ], "stream_id string, pos long, type string, text string, url string, title string")
    seg = {r.pos: r.segment for r in al.segments(ui).collect()}
    assert seg == {1: 1, 2: 2, 3: 2, 4: 2, 5: 2, 6: 3, 7: 4}
    md = {r.segment: r.markdown for r in al.segment_markdown(al.segments(ui)).collect()}
    assert md[2] == "Hello [T1](u1::source_citation)| a  [u2](u2::source_citation)|"
    names = [r.asDict() for r in ui.filter(al.is_name_part(ui.type, ui.text)).select(
        al.speaker_name(ui.text).alias("n")).collect()]
    assert names == [{"n": "Bot"}]
    txt = al.message_text(ui).first().text
    assert txt == "<name>Bot</name>Hello| a |x  y <has_function_call>"


def test_strict_tags_and_envelopes(spark):
    usage = {"prompt_tokens": 1, "completion_tokens": 1, "total_tokens": 2}
    whole = {"id": "x", "created": 1, "model": "m", "usage": usage, "object": "chat.completion.chunk",
             "choices": [{"index": 0, "delta": {"content": "ok"}}]}
    lines = [_chunk("<tool_call>{'id':'x','name':'y'}</tool_call>"), _chunk('<tool_call>{"id":"x","name":"y"} junk</tool_call>'),
             _chunk("a \u0001 b <tool_call>{\"id\":1,\"name\":\"n\"}</tool_call>"), json.dumps(whole)]
    lines += [json.dumps({k: v for k, v in whole.items() if k != f}) for f in whole]
    lines += [json.dumps({**whole, **bad}) for bad in (
        {"created": "1"}, {"usage": {"prompt_tokens": 1}}, {"choices": [{"index": 0}]}, {"choices": [{"index": 0, "delta": {"content": None}}]},
        {"choices": [{"index": 0, "delta": {"role": "user", "content": "x"}}]}, {"choices": [{"index": 0, "delta": {"content": [{"type": "image"}]}}]})]
    rows = al.normalise_completions(al.sse_events(_bodies(spark, {"s": lines}))).orderBy("seq", "sub").collect()
    assert [(r.type, r.delta or r.tool_call_id) for r in rows[:5]] == [
        ("text-delta", "<tool_call>{'id':'x','name':'y'}</tool_call>"), ("text-delta", '<tool_call>{"id":"x","name":"y"} junk</tool_call>'),
        ("text-delta", "a \u0001 b "), ("tool-call", "1"), ("text-delta", "ok")]
    assert {r.type for r in rows[5:]} == {"error"} and len(rows[5:]) == len(lines) - 4


def test_chat_agent_tool_calls_are_checked(spark):
    head = '{"id":"1","delta":{"role":"assistant","id":"m","content":"t","tool_calls":'
    lines = [head + calls + "}}" for calls in (
        '[{"type":"function","id":5,"function":{"name":"f","arguments":"{}"}}]', '[{"type":"function","id":"a","function":{}}]',
        '[{"type":"other","id":"a","function":{"name":"f","arguments":"{}"}}]', '"none"', "[]")]
    rows = al.normalise_chat_agent(al.sse_events(_bodies(spark, {"s": lines}))).orderBy("seq", "sub").collect()
    assert [r.type for r in rows] == ["error"] * 4 + ["text-delta"]


def test_many_parts_in_one_payload_stay_in_order(spark):
    many = _chunk([{"type": "text", "text": f"{i} "} for i in range(40)])
    ev = al.sse_events(_bodies(spark, {"s": [many, _chunk("last")]}))
    parts = al.normalise_completions(ev)
    out = al.with_boundaries(parts)
    text = al.assembled_text(out).first().text
    assert text == "".join(f"{i} " for i in range(40)) + "last"
    ords = [r.ord for r in out.orderBy("ord").collect()]
    assert ords == list(range(1, len(ords) + 1))


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_streams_hold_the_whole_messages(spark, sf):
    from larder.plans.agentlog import parts
    from larder.sources.fixtures import messages

    said = {r.id: r.text for r in messages(spark, sf).filter("role = 'assistant'").collect()}
    rows = parts(spark, sf, "chat_agent").filter("type = 'text-delta'").orderBy("stream_id", "seq", "sub").collect()
    streamed = {}
    for r in rows:
        streamed[r.stream_id] = streamed.get(r.stream_id, "") + r.delta
    assert streamed == {i: t for i, t in said.items() if t.strip(" \t\n\v\f\r")}


@pytest.mark.parametrize("dialect", ["responses", "completions", "chat_agent"])
def test_fixture_streams_cover_every_part_type(spark, dialect):
    from larder.plans.agentlog import parts
    types = {r.type for r in parts(spark, "/root/testdata/sf0.001", dialect).select("type").distinct().collect()}
    want = {"responses": {"text-delta", "reasoning-delta", "tool-call", "tool-result", "source", "error",
                          "text-start", "text-end", "reasoning-start", "reasoning-end"},
            "completions": {"text-delta", "reasoning-delta", "tool-call", "tool-result", "error"},
            "chat_agent": {"text-delta", "tool-call", "tool-result", "error"}}[dialect]
    assert want <= types


def test_values_are_written_once_in_the_plan(spark):
    # a generator evaluates an expression as often as it is written, lambdas too
    ev = al.sse_events(_bodies(spark, {"s1": RESPONSES}))
    for fn, parses, schemas in ((al.normalise_completions, 3, 13), (al.normalise_chat_agent, 1, 8), (al.normalise_responses, 1, 1)):
        plan = fn(ev)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("parseJson(") <= parses and plan.count("schemaOfVariant(") <= schemas, fn.__name__


def test_completion_fields_of_other_types(spark):
    good = {"id": "c", "created": 1, "model": "m", "object": "chat.completion.chunk",
            "usage": {"prompt_tokens": 1, "completion_tokens": 1.5, "total_tokens": 2},
            "choices": [{"index": 0, "delta": {"content": "hi"}}]}
    odd = [{"id": 5}, {"usage": [1]}, {"usage": None}, {"choices": {}}, {"choices": [7]}, {"choices": [{"index": 0, "delta": "x"}]},
           {"choices": [{"index": 0, "delta": {"content": None}}]}, {"choices": [{"index": "0", "delta": {}}]}]
    fine = [{}, {"choices": []}, {"choices": [{"index": 0, "delta": {}}]}]
    rows = {f"odd{i}": [json.dumps({**good, **o})] for i, o in enumerate(odd)} | {f"fine{i}": [json.dumps({**good, **o})] for i, o in enumerate(fine)}
    got = {r["stream_id"]: (r["type"], r["delta"]) for r in al.normalise_completions(al.sse_events(_bodies(spark, rows))).collect()}
    assert got == {f"odd{i}": ("error", None) for i in range(len(odd))} | {"fine0": ("text-delta", "hi")}
