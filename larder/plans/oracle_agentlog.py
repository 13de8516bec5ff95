"""DuckDB spellings of the agent event-log fixtures and stream jobs.

Written independently of the Spark code: the same rules expressed with
DuckDB list lambdas, JSON functions and window functions.
"""

from __future__ import annotations

from larder.plans.oracle_fixtures import cte

PART_FIELDS = ["type", "id", "delta", "tool_call_id", "tool_name", "input", "result", "url", "title",
               "error", "item_id", "source_tool_name"]
TOOL_NAME = "'hosted-tool-call'"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


class R(str):
    """Raw SQL piece (not quoted)."""


def joined(*pieces) -> str:
    return "concat(" + ", ".join(p if isinstance(p, R) else q(p) for p in pieces) + ")"


def data(*pieces) -> str:
    return joined("data: ", *pieces)


def js_text(*pieces) -> R:
    """The pieces, joined, as a JSON string."""
    return R(f"cast(to_json({joined(*pieces)}) AS VARCHAR)")


def when(cond: str, *lines: str) -> str:
    return f"(CASE WHEN {cond} THEN [{', '.join(lines)}] ELSE []::VARCHAR[] END)"


SPACE = r"[\x20\x09-\x0D]"
PIECE = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+[\x20\x09-\x0D]*"
I = "(j - 1)"
BLK = R(f"cast({I} // 5 AS VARCHAR)")
POS = R(f"cast({I} AS VARCHAR)")
W = R("w")
T = R(f"regexp_replace(w, '{SPACE}', '', 'g')")


def responses_lines(conv: str) -> str:
    delta = lambda x: data('{"type":"response.output_text.delta","item_id":"i', BLK, '","delta":', x, "}")
    item = lambda kind, pre, of, *rest: data(
        '{"type":"response.output_item.done","output_index":0,"item":{"type":"' + kind + '","id":"' + pre, of, '",', *rest)
    return " || ".join([
        when(f"{I} = 0 AND {conv} % 5 = 0", data(
            '{"type":"response.output_item.done","output_index":0,"item":{"type":"message","id":"n0",'
            '"content":[{"type":"output_text","text":"<name>agent</name>"}]}}')),
        when(f"{I} % 7 = 3", data('{"type":"response.reasoning_summary_text.delta","item_id":"r', BLK,
                                  '","summary_index":0,"delta":', js_text("think ", T, " "), "}")),
        "[" + delta(js_text(W)) + "]",
        when(f"{I} % 11 = 5",
             item("function_call", "f", POS, '"call_id":"call', POS, '","name":"lookup","arguments":',
                  js_text('{"q":', js_text(T), "}"), "}}"),
             data('{"type":"function_call_output","call_id":"call', POS, '","output":', js_text("result ", T), "}")),
        when(f"{I} % 13 = 7", data('{"type":"response.output_text.annotation.added","annotation":{"type":"url_citation",'
                                   '"url":', js_text("https://docs.test/", T), ',"title":', js_text("Doc ", T), "}}")),
        when(f"{I} % 17 = 9", item("message", "i", BLK, '"content":[{"type":"output_text","text":', js_text(T), "}]}}")),
        when(f"{I} % 19 = 18", item("message", "m", POS, '"content":[{"type":"output_text","text":',
                                    js_text(T, " complete"), "}]}}")),
        when(f"{I} % 23 = 11", data('{"type":"response.output_text.delta","item_id":"i', BLK, '"')),
        when(f"{I} % 29 = 4", data('{"type":"response.created","sequence_number":', POS, '}')),
        when(f"{I} % 31 = 15", data('{"type":"error","code":"rate_limit","message":', js_text("slow ", T),
                                    ',"sequence_number":', POS, '}')),
        when(f"{I} % 37 = 6", item("reasoning", "r", POS, '"summary":[{"type":"summary_text","text":',
                                   js_text("why ", T), "}]}}")),
        when(f"{I} % 41 = 8", data('{"type":"response.function_call_arguments.delta","item_id":"f', POS,
                                   '","delta":"{","output_index":0,"sequence_number":', POS, '}')),
        when(f"{I} % 43 = 20 AND {conv} % 6 = 0", delta(R("'\"<has_function_call> \"'"))),
        when(f"{I} % 47 = 12", delta(js_text("| ", T, " |")),
             data('{"type":"response.output_text.annotation.added","annotation":{"type":"url_citation",'
                  '"url":', js_text("https://docs.test/t", T), ',"title":""}}')),
    ])


_USAGE = '"usage":{"prompt_tokens":1,"completion_tokens":1,"total_tokens":2},'


def completions_lines(sid: str) -> str:
    def chunk(content, envelope='"created":1,"model":"m",' + _USAGE):
        return data('{"id":"cc-', R(sid), '",' + envelope + '"object":"chat.completion.chunk",'
                    '"choices":[{"index":0,"delta":{"content":', content, "}}]}")

    return " || ".join([
        "[" + chunk(js_text(W)) + "]",
        when(f"{I} % 9 = 4", chunk(js_text('<tool_call>{"id":"t', POS, '","name":"lookup","arguments":{"q":', js_text(T),
                                           "}}</tool_call>"))),
        when(f"{I} % 9 = 5", chunk(js_text('before <tool_call_result>{"id":"t', POS, '","content":', js_text("ok ", T),
                                           "}</tool_call_result> after"))),
        when(f"{I} % 11 = 7", chunk(js_text('<uc_function_call>{"id":"u', POS, '","name":"legacy","arguments":',
                                            js_text(T), "}</uc_function_call>"))),
        when(f"{I} % 13 = 8", chunk(js_text('<uc_function_result>{"id":"u', POS, '","content":"done"}</uc_function_result>'))),
        when(f"{I} % 17 = 3", chunk(js_text("<tool_call>not json</tool_call>"))),
        when(f"{I} % 19 = 6", chunk(js_text('<tool_call>{"id":"x",\n"name":"y"}</tool_call> x'))),
        when(f"{I} % 23 = 10", chunk(js_text('<tool_call>\n{"id":"v', POS, '","name":"z"}</tool_call>'))),
        when(f"{I} % 7 = 2", chunk(R(joined('[{"type":"text","text":', js_text(T, "+"), '},{"type":"image","image_url":"x"},'
                                            '{"type":"reasoning","summary":[{"type":"summary_text","text":',
                                            js_text("hmm ", T), '},{"type":"summary_encrypted_text","data":"zz"}]}]')))),
        when(f"{I} % 29 = 14", data('{"id":"cc","choices":[{"index":0,"delta":{"role":"assistant"}}]}')),
        when(f"{I} % 31 = 20", data('{"id":"cc","choices":')),
        when(f"{I} % 37 = 11", chunk(js_text("<tool_call>{'id':'x','name':'y'}</tool_call>"))),
        when(f"{I} % 41 = 13", chunk(js_text('<tool_call>{"id":"x","name":"y"} junk</tool_call>'))),
        when(f"{I} % 43 = 17", chunk(js_text("no usage ", T), '"created":1,"model":"m",')),
        when(f"{I} % 47 = 19", chunk(js_text("no model ", T), '"created":1,' + _USAGE)),
        when(f"{I} % 53 = 23", chunk(js_text("no number ", T), '"created":"1","model":"m",' + _USAGE)),
        when(f"{I} % 59 = 29", chunk(R("'null'"))),
        when(f"{I} % 61 = 31", chunk(R(joined('[{"type":"sound","text":', js_text(T), "}]")))),
    ])


def chat_agent_lines(sid: str) -> str:
    said = ['{"id":"ev', POS, '","delta":{"role":"assistant","id":"a', BLK, '","content":']
    return " || ".join([
        "[" + data(*said, js_text(W), "}}") + "]",
        when(f"{I} % 8 = 3", data(*said, '"","tool_calls":[{"type":"function","id":"tc', POS,
                                  '","function":{"name":"lookup","arguments":', js_text('{"q":', js_text(T), "}"),
                                  '}},{"type":"function","id":"td', POS,
                                  '","function":{"name":"fetch","arguments":"[1]"}}]}}')),
        when(f"{I} % 8 = 4", data('{"id":"ev', POS, '","delta":{"role":"tool","name":"lookup","id":"o', POS,
                                  '","tool_call_id":"tc', POS, '","content":', js_text("found ", T), "}}")),
        when(f"{I} % 13 = 6", data('{"id":"ev', POS, '","delta":{"role":"user","id":"u', POS,
                                   '","content":"ignored"}}')),
        when(f"{I} % 17 = 9", data(*said, "x", T, "}}")),
        when(f"{I} % 19 = 7", data(*said, '"","tool_calls":[{"type":"function","id":5,'
                                   '"function":{"name":"f","arguments":"{}"}}]}}')),
        when(f"{I} % 23 = 8", data(*said, '"","tool_calls":[{"type":"function","id":"e', POS, '","function":{}}]}}')),
    ])


NL2 = "chr(10) || chr(10)"


def _bodies(lines_sql: str) -> str:
    return f"""
SELECT id AS stream_id, chat_id, created_at AS started_at,
       array_to_string(flatten(list_transform(ws, lambda w, j: {lines_sql})) || ['data: [DONE]'], {NL2}) || {NL2}
         AS body
FROM (SELECT *, regexp_extract_all(text, '{PIECE}') AS ws FROM messages WHERE role = 'assistant') m"""


def _events(bodies: str) -> str:
    return f"""
SELECT stream_id, chat_id, started_at, cast(generate_subscripts(ps, 1) - 1 AS INTEGER) AS seq,
       unnest(ps) AS payload
FROM (SELECT *, list_filter(list_transform(list_filter(string_split(body, chr(10)),
                                                       lambda l: starts_with(l, 'data:')),
                                           lambda l: trim(substr(l, 6))), lambda x: x <> '[DONE]') AS ps
      FROM {bodies}) b"""


def P(**kw) -> str:
    """DuckDB struct literal of one part; values are SQL expressions."""
    return "{" + ", ".join(f"'{f}': cast({kw.get(f, 'NULL')} AS VARCHAR)" for f in PART_FIELDS) + "}"


NONE = f"[]::STRUCT({', '.join(f'{f} VARCHAR' for f in PART_FIELDS)})[]"


def _explode(src: str, parts_sql: str) -> str:
    fields = ", ".join(f"pp.{f} AS {f}" for f in PART_FIELDS)
    return f"""
SELECT stream_id, chat_id, started_at, seq, sub, {fields}
FROM (SELECT stream_id, chat_id, started_at, seq, cast(generate_subscripts(ps, 1) - 1 AS INTEGER) AS sub,
             unnest(ps) AS pp
      FROM (SELECT *, {parts_sql} AS ps
            FROM (SELECT *, CASE WHEN json_valid(payload) THEN payload END AS jj FROM {src}) v) x) y"""


def js(path: str) -> str:
    return f"json_extract_string(jj, '{path}')"


def is_str(path: str) -> str:
    return f"coalesce(json_type(jj, '{path}') = 'VARCHAR', false)"


IS_OBJ = "coalesce(json_type(jj) = 'OBJECT', false)"
PARSE_ERR = P(type="'error'", error="'parse_error'")

_T, _IT, _IID = js("$.type"), js("$.item.type"), js("$.item.id")
RESPONSES_PARTS = f"""CASE
  WHEN NOT ({IS_OBJ} AND {is_str('$.type')}) THEN [{PARSE_ERR}]
  WHEN {_T} = 'response.output_text.delta' THEN
    [{P(type="'text-delta'", id=js('$.item_id'), delta=js('$.delta'), item_id=js('$.item_id'))}]
  WHEN {_T} = 'response.reasoning_summary_text.delta' THEN
    [{P(type="'reasoning-delta'", id=js('$.item_id'), delta=js('$.delta'), item_id=js('$.item_id'))}]
  WHEN {_T} = 'function_call_output' THEN
    [{P(type="'tool-result'", tool_call_id=js('$.call_id'), result=js('$.output'), tool_name=TOOL_NAME)}]
  WHEN {_T} = 'response.output_item.done' AND {_IT} = 'message' THEN
    [{P(type="'text-start'", id=_IID)}, {P(type="'text-delta'", id=_IID, delta=js('$.item.content[0].text'),
                                         item_id=_IID)}, {P(type="'text-end'", id=_IID)}]
  WHEN {_T} = 'response.output_item.done' AND {_IT} = 'function_call' THEN
    [{P(type="'tool-call'", tool_call_id=js('$.item.call_id'), tool_name=TOOL_NAME, input=js('$.item.arguments'),
        source_tool_name=js('$.item.name'), item_id=_IID)}]
  WHEN {_T} = 'response.output_item.done' AND {_IT} = 'function_call_output' THEN
    [{P(type="'tool-result'", tool_call_id=js('$.item.call_id'), result=js('$.item.output'), tool_name=TOOL_NAME)}]
  WHEN {_T} = 'response.output_item.done' AND {_IT} = 'reasoning' THEN
    [{P(type="'reasoning-start'", id=_IID)}, {P(type="'reasoning-delta'", id=_IID,
                                              delta=js('$.item.summary[0].text'), item_id=_IID)},
     {P(type="'reasoning-end'", id=_IID)}]
  WHEN {_T} = 'response.output_text.annotation.added' THEN
    [{P(type="'source'", url=js('$.annotation.url'), title=js('$.annotation.title'),
        id="concat_ws(':', stream_id, cast(seq AS VARCHAR))")}]
  WHEN {_T} = 'error' THEN [{P(type="'error'", error='payload')}]
  ELSE {NONE} END"""

_TAGS = [("<uc_function_call>", "</uc_function_call>"), ("<tool_call>", "</tool_call>"),
         ("<uc_function_result>", "</uc_function_result>"), ("<tool_call_result>", "</tool_call_result>")]
_PATTERN = "(" + "|".join(f"{a}.*?{b}" for a, b in _TAGS) + ")"


def _inner(seg: str, tags) -> str:
    t = f"regexp_replace({seg}, '^\\s+|\\s+$', '', 'g')"
    arms = " ".join(
        f"WHEN starts_with({t}, '{a}') AND ends_with({t}, '{b}') AND length({t}) >= {len(a) + len(b)} "
        f"THEN substr({t}, {len(a) + 1}, length({t}) - {len(a) + len(b)})" for a, b in tags)
    return f"(CASE {arms} END)"


def _valid(inner: str) -> str:
    return f"(CASE WHEN json_valid({inner}) THEN {inner} END)"


def _obj_has(inner: str, *keys: str) -> str:
    v = _valid(inner)
    conds = " AND ".join(f"list_contains(json_keys({v}), '{k}')" for k in keys)
    return f"coalesce(json_type({v}) = 'OBJECT' AND {conds}, false)"


def _jx(inner: str, key: str) -> str:
    return f"json_extract_string({_valid(inner)}, '$.{key}')"


def _tag_part(seg: str, cid: str) -> str:
    ci, ri = _inner(seg, _TAGS[:2]), _inner(seg, _TAGS[2:])
    call = P(type="'tool-call'", tool_call_id=_jx(ci, "id"), tool_name=_jx(ci, "name"),
             input=_jx(ci, "arguments"))
    res = P(type="'tool-result'", tool_call_id=_jx(ri, "id"), result=_jx(ri, "content"), tool_name=TOOL_NAME)
    text = P(type="'text-delta'", id=cid, delta=seg)
    return f"CASE WHEN {_obj_has(ci, 'id', 'name')} THEN {call} WHEN {_obj_has(ri, 'id')} THEN {res} ELSE {text} END"


_CONTENT = "$.choices[0].delta.content"
_CID = js("$.id")
_TEXT1 = js(_CONTENT)
_SEGS = (f"list_filter(flatten(list_transform(regexp_split_to_array({_TEXT1}, '{_PATTERN}'), lambda s, n: "
         f"[s, coalesce(regexp_extract_all({_TEXT1}, '{_PATTERN}')[n], '')])), lambda s: s <> '')")
_ITEMS = f"cast(json_extract(jj, '{_CONTENT}') AS JSON[])"


def kind_of(j: str, path: str) -> str:
    return f"json_type({j}, '{path}')"


def str_in(j: str, path: str) -> str:
    return f"coalesce({kind_of(j, path)} = 'VARCHAR', false)"


def num_in(j: str, path: str) -> str:
    return f"coalesce({kind_of(j, path)} IN ('UBIGINT', 'BIGINT', 'DOUBLE'), false)"


def all_in(j: str, path: str, var: str, test: str) -> str:
    """A list of which no element fails the test."""
    return (f"(coalesce({kind_of(j, path)} = 'ARRAY', false) AND len(list_filter("
            f"CASE WHEN {kind_of(j, path)} = 'ARRAY' THEN cast(json_extract({j}, '{path}') AS JSON[]) ELSE []::JSON[] END, "
            f"lambda {var}: NOT coalesce({test}, false))) = 0)")


def x(j: str, path: str) -> str:
    return f"json_extract_string({j}, '{path}')"


_SUMMARY_OK = (f"({x('sm', '$.type')} = 'summary_text' AND {str_in('sm', '$.text')}) OR "
               f"({x('sm', '$.type')} = 'summary_encrypted_text' AND {str_in('sm', '$.data')})")
_ITEM_OK = (f"({x('ci', '$.type')} = 'text' AND {str_in('ci', '$.text')}) OR "
            f"({x('ci', '$.type')} = 'image' AND {str_in('ci', '$.image_url')}) OR "
            f"({x('ci', '$.type')} = 'reasoning' AND {all_in('ci', '$.summary', 'sm', _SUMMARY_OK)})")
_CHOICE_OK = (f"{num_in('ch', '$.index')} AND coalesce({kind_of('ch', '$.delta')} = 'OBJECT', false) "
              f"AND coalesce({x('ch', '$.delta.role')}, 'assistant') = 'assistant' "
              f"AND ({kind_of('ch', '$.delta.content')} IS NULL OR {str_in('ch', '$.delta.content')} "
              f"OR {all_in('ch', '$.delta.content', 'ci', _ITEM_OK)})")
_CHUNK_OK = " AND ".join([IS_OBJ, is_str("$.id"), num_in("jj", "$.created"), is_str("$.model"),
                          *[num_in("jj", f"$.usage.{f}") for f in ("prompt_tokens", "completion_tokens", "total_tokens")],
                          f"{js('$.object')} IS NOT DISTINCT FROM 'chat.completion.chunk'",
                          all_in("jj", "$.choices", "ch", _CHOICE_OK)])
COMPLETIONS_PARTS = f"""CASE
  WHEN NOT ({_CHUNK_OK}) THEN [{PARSE_ERR}]
  WHEN json_type(jj, '{_CONTENT}') = 'VARCHAR' THEN list_transform({_SEGS}, lambda seg: {_tag_part('seg', _CID)})
  WHEN json_type(jj, '{_CONTENT}') = 'ARRAY' THEN flatten(list_transform({_ITEMS}, lambda it:
    CASE json_extract_string(it, '$.type')
      WHEN 'text' THEN [{P(type="'text-delta'", id=_CID, delta="json_extract_string(it, '$.text')")}]
      WHEN 'reasoning' THEN list_transform(
        list_filter(cast(json_extract(it, '$.summary') AS JSON[]),
                    lambda sm: json_extract_string(sm, '$.type') = 'summary_text'),
        lambda sm: {P(type="'reasoning-delta'", id=_CID, delta="json_extract_string(sm, '$.text')")})
      ELSE {NONE} END))
  ELSE {NONE} END"""


def _dstr(f: str) -> str:
    return is_str("$.delta." + f)


_ROLE = js("$.delta.role")
_CONTENT2 = js("$.delta.content")
_CALL_OK = (f"{x('tc', '$.type')} = 'function' AND {str_in('tc', '$.id')} AND {str_in('tc', '$.function.name')} "
            f"AND {str_in('tc', '$.function.arguments')}")
_CALLS_OK = f"({kind_of('jj', '$.delta.tool_calls')} IS NULL OR {all_in('jj', '$.delta.tool_calls', 'tc', _CALL_OK)})"
CHAT_AGENT_PARTS = f"""CASE
  WHEN NOT ({IS_OBJ} AND {is_str('$.id')} AND (
        ({_ROLE} = 'assistant' AND {_dstr('content')} AND {_dstr('id')} AND {_CALLS_OK})
     OR ({_ROLE} = 'tool' AND {_dstr('name')} AND {_dstr('content')} AND {_dstr('tool_call_id')} AND {_dstr('id')})
     OR ({_ROLE} = 'user' AND {_dstr('content')} AND {_dstr('id')}))) THEN [{PARSE_ERR}]
  WHEN {_ROLE} = 'assistant' THEN
    (CASE WHEN {_CONTENT2} <> '' THEN [{P(type="'text-delta'", id=js('$.delta.id'), delta=_CONTENT2)}] ELSE {NONE} END)
    || coalesce(list_transform(cast(json_extract(jj, '$.delta.tool_calls') AS JSON[]), lambda c:
         {P(type="'tool-call'", tool_call_id="json_extract_string(c, '$.id')",
            input="json_extract_string(c, '$.function.arguments')",
            tool_name="json_extract_string(c, '$.function.name')")}), {NONE})
  WHEN {_ROLE} = 'tool' THEN
    [{P(type="'tool-result'", tool_call_id=js('$.delta.tool_call_id'), result=_CONTENT2, tool_name=TOOL_NAME)}]
  ELSE {NONE} END"""

cte("bodies_responses", _bodies(responses_lines("chat_id")), ("messages",))
cte("bodies_completions", _bodies(completions_lines("id")), ("messages",))
cte("bodies_chat_agent", _bodies(chat_agent_lines("id")), ("messages",))
cte("events_responses", _events("bodies_responses"), ("bodies_responses",))
cte("events_completions", _events("bodies_completions"), ("bodies_completions",))
cte("events_chat_agent", _events("bodies_chat_agent"), ("bodies_chat_agent",))
cte("parts_responses", _explode("events_responses", RESPONSES_PARTS), ("events_responses",))
cte("parts_completions", _explode("events_completions", COMPLETIONS_PARTS), ("events_completions",))
cte("parts_chat_agent", _explode("events_chat_agent", CHAT_AGENT_PARTS), ("events_chat_agent",))


def _grp(t: str) -> str:
    return f"(CASE WHEN starts_with({t}, 'text-') THEN 'text' WHEN starts_with({t}, 'reasoning-') THEN 'reasoning' END)"


def _isd(t: str) -> str:
    return f"coalesce({t} IN ('text-delta', 'reasoning-delta'), false)"


_CUR = "{" + ", ".join(f"'{f}': {f}" for f in PART_FIELDS) + "}"
_PF = ", ".join(f"pp.{f} AS {f}" for f in PART_FIELDS)
_FLUSH = P(type=f"{_grp('type')} || '-end'", id="id")
cte("stream_parts", f"""
SELECT stream_id, chat_id, started_at, ord, is_flush, {", ".join(PART_FIELDS)} FROM (
  SELECT *, min(CASE WHEN type IN ('text-end', 'reasoning-end') AND NOT is_flush THEN ord END)
              OVER (PARTITION BY stream_id, end_key) AS fe
  FROM (
    SELECT *, CASE WHEN {_grp('type')} IS NOT NULL AND id IS NOT NULL THEN {_grp('type')} || ':' || id END AS end_key
    FROM (
      SELECT stream_id, chat_id, started_at, k > n_out AS is_flush, {_PF},
             cast(row_number() OVER (PARTITION BY stream_id ORDER BY seq, sub, k) AS BIGINT) AS ord
      FROM (SELECT *, len(outl) AS n_out, generate_subscripts(outl || fl, 1) AS k, unnest(outl || fl) AS pp FROM (
        SELECT *, CASE WHEN m THEN [{_CUR}]
                  ELSE (CASE WHEN {_isd('prev_t')} THEN [{P(type=f"{_grp('prev_t')} || '-end'", id='prev_id')}]
                             ELSE {NONE} END)
                    || (CASE WHEN {_isd('type')} THEN [{P(type=f"{_grp('type')} || '-start'", id='id')}, {_CUR}]
                             ELSE [{_CUR}] END) END AS outl,
                  CASE WHEN is_last AND {_isd('type')} THEN [{_FLUSH}] ELSE {NONE} END AS fl
        FROM (SELECT *, coalesce({_isd('prev_t')} AND {_isd('type')} AND {_grp('prev_t')} = {_grp('type')}
                                 AND id IS NOT NULL AND prev_id IS NOT NULL AND id = prev_id, false) AS m
              FROM (SELECT *, lag(type) OVER w AS prev_t, lag(id) OVER w AS prev_id,
                           lead(sub) OVER w IS NULL AS is_last
                    FROM parts_responses WINDOW w AS (PARTITION BY stream_id ORDER BY seq, sub)) a) b) c) d) g) g2) h
WHERE end_key IS NULL OR is_flush OR fe IS NULL OR ord <= fe""", ("parts_responses",))

cte("assembled", f"""
SELECT stream_id, id, {_grp('type')} AS kind, min(ord) AS first_ord, string_agg(delta, '' ORDER BY ord) AS text
FROM stream_parts WHERE type IN ('text-delta', 'reasoning-delta') GROUP BY stream_id, id, {_grp('type')}""",
    ("stream_parts",))

cte("ui_parts", """
SELECT stream_id, first_ord AS pos, kind AS type, text, NULL::VARCHAR AS url, NULL::VARCHAR AS title FROM assembled
UNION ALL SELECT stream_id, ord, 'source-url', NULL::VARCHAR, url, title FROM stream_parts WHERE type = 'source'
UNION ALL SELECT stream_id, ord, 'tool', input, NULL::VARCHAR, NULL::VARCHAR FROM stream_parts WHERE type = 'tool-call'""",
    ("assembled", "stream_parts"))

cte("segments", """
SELECT *, sum(CASE WHEN new THEN 1 ELSE 0 END) OVER (PARTITION BY stream_id ORDER BY pos
                                                     ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS segment
FROM (SELECT *, CASE WHEN type = 'source-url' THEN NOT coalesce(prev_t IN ('text', 'source-url'), false)
                     WHEN type = 'text' THEN nm OR coalesce(last_nm, true) ELSE true END AS new
      FROM (SELECT *, last_value(CASE WHEN type = 'text' THEN nm END IGNORE NULLS) OVER (
                        PARTITION BY stream_id, run ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
                        AS last_nm
            FROM (SELECT *, coalesce(type = 'text' AND starts_with(text, '<name>') AND ends_with(text, '</name>'),
                                     false) AS nm,
                         sum(CASE WHEN type IN ('text', 'source-url') THEN 0 ELSE 1 END) OVER (
                           PARTITION BY stream_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
                           AS run,
                         lag(type) OVER (PARTITION BY stream_id ORDER BY pos) AS prev_t
                  FROM ui_parts) a) b) c""", ("ui_parts",))


# ----------------------------------------------------------------------------- whole responses (M7)

def _whole(body: str) -> str:
    return f"""
SELECT id AS stream_id, {body} AS response
FROM (SELECT *, cast(floor(length(text) / 2) AS BIGINT) AS half, cast(turn AS VARCHAR) AS ts, chat_id AS c, turn AS t
      FROM messages WHERE role = 'assistant') m"""


_TXT, _TS = R("text"), R("ts")
cte("whole_responses", _whole(joined(
    '{"id":"resp","output":[',
    R("concat_ws(',', " + joined('{"type":"message","id":"m","content":[{"type":"output_text","text":',
                                 js_text(R("substr(text, 1, half)")), '},{"type":"output_text","text":',
                                 js_text(R("substr(text, half + 1)")), "}]}")
      + ", CASE WHEN c % 2 = 0 THEN " + joined('{"type":"function_call","id":"f","call_id":"c', _TS,
                                               '","name":"lookup","arguments":"{}"},'
                                               '{"type":"function_call_output","call_id":"c', _TS, '","output":"found"}')
      + " END, CASE WHEN t % 3 = 1 THEN " + q('{"type":"reasoning","id":"r","summary":[{"type":"summary_text","text":"why"},'
                                              '{"type":"summary_text","text":"because"}]}') + " END)"), "]}")), ("messages",))

cte("whole_completions", _whole(joined(
    '{"id":"cc","created":1,"model":"m",' + _USAGE + '"choices":[{"index":0,"message":{"role":"assistant","content":',
    R("CASE WHEN c % 3 = 0 THEN " + js_text(' <tool_call>{"id":"k', _TS, '","name":"lookup","arguments":', js_text(_TXT),
                                            "}</tool_call> ")
      + " WHEN c % 3 = 1 THEN " + joined('[{"type":"text","text":', js_text(_TXT), '},{"type":"image","image_url":"u"},'
                                         '{"type":"reasoning","summary":[{"type":"summary_text","text":"hmm"}]}]')
      + " ELSE " + js_text(_TXT, ' <tool_call>{"id":"z","name":"n"}</tool_call>') + " END"), "}}]}")), ("messages",))

cte("whole_chat_agent", _whole(joined(
    '{"id":"ca","messages":[{"role":"user","id":"u","content":"q"},{"role":"assistant","id":"a","content":', js_text(_TXT),
    R("CASE WHEN c % 2 = 0 THEN " + joined(',"tool_calls":[{"type":"function","id":"c', _TS,
                                           '","function":{"name":"lookup","arguments":"{}"}}]') + " ELSE '' END"), "}",
    R("CASE WHEN c % 2 = 0 THEN " + joined(',{"role":"tool","name":"lookup","id":"o","tool_call_id":"c', _TS,
                                           '","content":"found"}') + " ELSE '' END"), "]}")), ("messages",))

CFIELDS = ["type", "text", "tool_call_id", "tool_name", "input", "result", "item_id"]


def C(**kw) -> str:
    return "{" + ", ".join(f"'{f}': cast({kw.get(f, 'NULL')} AS VARCHAR)" for f in CFIELDS) + "}"


CNONE = f"[]::STRUCT({', '.join(f'{f} VARCHAR' for f in CFIELDS)})[]"


def jo(x: str, path: str) -> str:
    return f"json_extract_string({x}, '{path}')"


def jl(x: str, path: str) -> str:
    return f"cast(json_extract({x}, '{path}') AS JSON[])"


_RESP_WHOLE = f"""flatten(list_transform({jl('jj', '$.output')}, lambda o: CASE {jo('o', '$.type')}
  WHEN 'message' THEN list_transform(list_filter({jl('o', '$.content')}, lambda c: {jo('c', '$.type')} = 'output_text'),
                                     lambda c: {C(type="'text'", text=jo('c', '$.text'), item_id=jo('o', '$.id'))})
  WHEN 'function_call' THEN [{C(type="'tool-call'", tool_call_id=jo('o', '$.call_id'), tool_name=jo('o', '$.name'),
                                input=jo('o', '$.arguments'), item_id=jo('o', '$.id'))}]
  WHEN 'reasoning' THEN list_transform(list_filter({jl('o', '$.summary')}, lambda s: {jo('s', '$.type')} = 'summary_text'),
                                       lambda s: {C(type="'reasoning'", text=jo('s', '$.text'), item_id=jo('o', '$.id'))})
  WHEN 'function_call_output' THEN [{C(type="'tool-result'", tool_call_id=jo('o', '$.call_id'),
                                       result=jo('o', '$.output'), tool_name=TOOL_NAME)}]
  ELSE {CNONE} END))"""

_WC = "$.choices[0].message.content"
_WT = jo("jj", _WC)
_CI, _RI = _inner(_WT, _TAGS[:2]), _inner(_WT, _TAGS[2:])
_COMP_WHOLE = f"""CASE json_type(jj, '{_WC}')
  WHEN 'VARCHAR' THEN (CASE
      WHEN {_obj_has(_CI, 'id', 'name')} THEN [{C(type="'tool-call'", tool_call_id=_jx(_CI, 'id'),
                                                  tool_name=_jx(_CI, 'name'), input=_jx(_CI, 'arguments'))}]
      WHEN {_obj_has(_RI, 'id')} THEN [{C(type="'tool-result'", tool_call_id=_jx(_RI, 'id'),
                                           result=_jx(_RI, 'content'), tool_name=TOOL_NAME)}]
      ELSE [{C(type="'text'", text=_WT)}] END)
  WHEN 'ARRAY' THEN flatten(list_transform({jl('jj', _WC)}, lambda it: CASE {jo('it', '$.type')}
      WHEN 'text' THEN [{C(type="'text'", text=jo('it', '$.text'))}]
      WHEN 'reasoning' THEN list_transform(list_filter({jl('it', '$.summary')},
                                                       lambda s: {jo('s', '$.type')} = 'summary_text'),
                                           lambda s: {C(type="'reasoning'", text=jo('s', '$.text'))})
      ELSE {CNONE} END))
  ELSE {CNONE} END"""

_CA_WHOLE = f"""flatten(list_transform({jl('jj', '$.messages')}, lambda m: CASE {jo('m', '$.role')}
  WHEN 'assistant' THEN [{C(type="'text'", text=jo('m', '$.content'))}]
    || coalesce(list_transform({jl('m', '$.tool_calls')}, lambda tc: {C(type="'tool-call'", tool_call_id=jo('tc', '$.id'),
                                                                          tool_name=jo('tc', '$.function.name'),
                                                                          input=jo('tc', '$.function.arguments'))}),
                {CNONE})
  WHEN 'tool' THEN [{C(type="'tool-result'", tool_call_id=jo('m', '$.tool_call_id'), result=jo('m', '$.content'),
                       tool_name=TOOL_NAME)}]
  ELSE {CNONE} END))"""


def whole_parts_sql(src: str, parts: str, dialect: str) -> str:
    fields = ", ".join(f"cc.{f} AS {f}" for f in CFIELDS)
    return f"""SELECT '{dialect}' AS dialect, stream_id, idx, {fields}
FROM (SELECT stream_id, cast(generate_subscripts(ps, 1) - 1 AS INTEGER) AS idx, unnest(ps) AS cc
      FROM (SELECT stream_id, {parts} AS ps
            FROM (SELECT *, CASE WHEN json_valid(response) THEN response END AS jj FROM {src}) a) b) c"""


WHOLE_SQL = " UNION ALL ".join([whole_parts_sql("whole_responses", _RESP_WHOLE, "responses"),
                                whole_parts_sql("whole_completions", _COMP_WHOLE, "completions"),
                                whole_parts_sql("whole_chat_agent", _CA_WHOLE, "chat_agent")])
