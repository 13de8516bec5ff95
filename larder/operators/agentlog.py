"""Bulk jobs over agent response streams.

The source material converts one chunk at a time inside a web server; here a
whole event log is one DataFrame.  Per-line work is array/JSON expressions on
one row; per-stream order work (boundaries, dedup, segments) is a window
partitioned by ``stream_id``.  A stream is one model response, so a window
partition is bounded by the longest response, not by the size of the log.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Tool-name placeholder, tag pairs (two generations), citation
# link suffix and the tag-splitting pattern (no dot-all: tags spanning lines
# stay text).
TOOL_NAME = "hosted-tool-call"
CALL_TAGS = [("<uc_function_call>", "</uc_function_call>"), ("<tool_call>", "</tool_call>")]
RESULT_TAGS = [("<uc_function_result>", "</uc_function_result>"), ("<tool_call_result>", "</tool_call_result>")]
NEW_CALL, NEW_RESULT = CALL_TAGS[1], RESULT_TAGS[1]
TAG_PATTERN = ("(<uc_function_call>.*?</uc_function_call>|<uc_function_result>.*?</uc_function_result>|"
               "<tool_call>.*?</tool_call>|<tool_call_result>.*?</tool_call_result>)")
CITATION_SUFFIX = "::source_citation"

PART_FIELDS = ["type", "id", "delta", "tool_call_id", "tool_name", "input", "result", "url", "title",
               "error", "item_id", "source_tool_name"]


def part(**kw) -> Column:
    """One stream part: a wide nullable struct with a ``type`` discriminator."""
    cols = []
    for f in PART_FIELDS:
        v = kw.get(f)
        c = v if isinstance(v, Column) else F.lit(v)
        cols.append(c.cast("string").alias(f))
    return F.struct(*cols)


def _none() -> Column:
    return F.array().cast(f"array<{_PART_DDL}>")


_PART_DDL = "struct<" + ",".join(f"{f}:string" for f in PART_FIELDS) + ">"


# --------------------------------------------------------------------------- M3

def sse_events(bodies: DataFrame, keep_done: bool = False) -> DataFrame:
    """Event-stream bodies -> one row per ``data:`` payload (M3).

    Lines not starting with ``data:`` are ignored, as is the ``[DONE]``
    sentinel (kept with ``keep_done`` for the streaming twin, which uses it to
    end a stream); ``seq`` is the payload's index in its stream.  Row-local.
    """
    lines = F.filter(F.split(F.col("body"), "\n"), lambda l: l.startswith("data:"))
    payloads = F.transform(lines, lambda l: F.trim(F.substring(l, F.lit(6), F.length(l))))
    if not keep_done:
        payloads = F.filter(payloads, lambda p: p != "[DONE]")
    keep = [c for c in bodies.columns if c != "body"]
    return bodies.select(*keep, F.posexplode(payloads).alias("seq", "payload"))


def with_arrival_times(events: DataFrame, step_s: int = 2, gap_every: int = 40,
                       gap_s: int = 360) -> DataFrame:
    """Arrival time of each event: ``step_s`` apart, stalling ``gap_s`` every ``gap_every``."""
    secs = F.col("seq") * step_s + F.floor(F.col("seq") / gap_every) * gap_s
    return events.withColumn("ts", F.col("started_at") + F.make_dt_interval(secs=secs.cast("int")))


def _explode_parts(events: DataFrame, parts: Column) -> DataFrame:
    keep = [c for c in events.columns if c != "payload" and not c.startswith("_")]
    return (events.select(*keep, F.posexplode(parts).alias("sub", "p"))
            .select(*keep, "sub", *[F.col(f"p.{f}").alias(f) for f in PART_FIELDS]))


def _parsed(events: DataFrame, **read: Column) -> DataFrame:
    """Parse each payload once into a variant column ``_v`` (NULL if not JSON), and ``read`` from it.

    A generator evaluates an expression as often as it is written, so what the parts
    are made of are columns below it.
    """
    return events.withColumn("_v", F.try_parse_json(F.col("payload"))).withColumns(read)


def _once(value: Column, use) -> Column:
    """``use`` of a value that is evaluated once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _vget(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "string")


def _is_string(v: Column, path: str) -> Column:
    return F.coalesce(F.schema_of_variant(F.try_variant_get(v, path, "variant")) == "STRING", F.lit(False))


def _fields(v: Column, ddl: str) -> Column:
    """The named fields of an object, read in one pass; NULL for anything but an object."""
    return F.try_variant_get(v, "$", f"struct<{ddl}>")


def _string_kind(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v) == "STRING", F.lit(False))


def _number_kind(v: Column) -> Column:
    return F.coalesce(_once(F.schema_of_variant(v), lambda k: k.isin("BIGINT", "DOUBLE", "FLOAT") | k.startswith("DECIMAL")), F.lit(False))


def _is_object(v: Column) -> Column:
    # the schema's text would name every field of it
    return F.try_variant_get(v, "$", "struct<>").isNotNull()


def _at(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "variant")


def _is_list(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "array<variant>").isNotNull()


def _absent(v: Column, path: str) -> Column:
    return _at(v, path).isNull()


def _all_of(v: Column, path: str, test) -> Column:
    """Is it a list whose elements all pass ``test``?"""
    return _is_list(v, path) & F.coalesce(F.forall(F.try_variant_get(v, path, "array<variant>"), test), F.lit(False))


PARSE_ERROR = "parse_error"


# --------------------------------------------------------------------------- M6

def normalise_responses(events: DataFrame) -> DataFrame:
    """Dialect 3 (typed response events) -> stream parts (M6).

    Seven event kinds map to parts; unknown kinds give none; a payload that
    is not a JSON object with a string ``type`` gives one error part.  Of a
    finished item only the first content / summary entry is read.
    """
    v = F.col("_v")
    events = _parsed(events, _f=_fields(v, "type:variant,item:struct<type:string,id:string>"))
    events = events.withColumns({"_ok": _string_kind(F.col("_f.type")), "_type": _vget(F.col("_f.type"), "$"),
                                 "_item": F.col("_f.item.type"), "_item_id": F.col("_f.item.id")})
    ok, t, it, iid = (F.col(c) for c in ("_ok", "_type", "_item", "_item_id"))
    parts = (
        F.when(~ok, F.array(part(type="error", error=F.lit(PARSE_ERROR))))
        .when(t == "response.output_text.delta",
              F.array(part(type="text-delta", id=_vget(v, "$.item_id"), delta=_vget(v, "$.delta"),
                           item_id=_vget(v, "$.item_id"))))
        .when(t == "response.reasoning_summary_text.delta",
              F.array(part(type="reasoning-delta", id=_vget(v, "$.item_id"), delta=_vget(v, "$.delta"),
                           item_id=_vget(v, "$.item_id"))))
        .when(t == "function_call_output",
              F.array(part(type="tool-result", tool_call_id=_vget(v, "$.call_id"),
                           result=_vget(v, "$.output"), tool_name=TOOL_NAME)))
        .when((t == "response.output_item.done") & (it == "message"),
              F.array(part(type="text-start", id=iid),
                      part(type="text-delta", id=iid, delta=_vget(v, "$.item.content[0].text"), item_id=iid),
                      part(type="text-end", id=iid)))
        .when((t == "response.output_item.done") & (it == "function_call"),
              F.array(part(type="tool-call", tool_call_id=_vget(v, "$.item.call_id"), tool_name=TOOL_NAME,
                           input=_vget(v, "$.item.arguments"), source_tool_name=_vget(v, "$.item.name"),
                           item_id=iid)))
        .when((t == "response.output_item.done") & (it == "function_call_output"),
              F.array(part(type="tool-result", tool_call_id=_vget(v, "$.item.call_id"),
                           result=_vget(v, "$.item.output"), tool_name=TOOL_NAME)))
        .when((t == "response.output_item.done") & (it == "reasoning"),
              F.array(part(type="reasoning-start", id=iid),
                      part(type="reasoning-delta", id=iid, delta=_vget(v, "$.item.summary[0].text"),
                           item_id=iid),
                      part(type="reasoning-end", id=iid)))
        .when(t == "response.output_text.annotation.added",
              F.array(part(type="source", url=_vget(v, "$.annotation.url"),
                           title=_vget(v, "$.annotation.title"),
                           id=F.concat_ws(":", F.col("stream_id"), F.col("seq").cast("string")))))
        .when(t == "error", F.array(part(type="error", error=F.col("payload"))))
        .otherwise(_none()))
    return _explode_parts(events, parts)


# --------------------------------------------------------------------------- M8

def _trim_ws(s: Column) -> Column:
    """Strip leading/trailing whitespace of any kind (spaces, tabs, newlines)."""
    return F.regexp_replace(s, r"^\s+|\s+$", "")


def _strip_tag(s: Column, tags) -> Column:
    """Inner text when the trimmed segment is enclosed by one of ``tags``."""
    out = None
    for open_, close in tags:
        hit = s.startswith(open_) & s.endswith(close) & (F.length(s) >= len(open_) + len(close))
        inner = F.substring(s, len(open_) + 1, F.length(s) - len(open_) - len(close))
        out = F.when(hit, inner) if out is None else out.when(hit, inner)
    return out


def _strict_json(text: Column) -> Column:
    """The parsed text if it is one JSON value with nothing behind it, else NULL."""
    return _once(text, lambda t: F.when(F.json_array_length(F.concat(F.lit("["), t, F.lit("]"))) == 1, F.try_parse_json(t)))


def _tag_part(seg: Column, chunk_id: Column) -> Column:
    """Classify one split segment: tool call, tool result, or text (M8)."""
    plain = part(type="text-delta", id=chunk_id, delta=seg)

    def result(res: Column) -> Column:
        ok = _is_object(res) & ~_absent(res, "$.id")
        return F.when(ok, part(type="tool-result", tool_call_id=_vget(res, "$.id"), result=_vget(res, "$.content"),
                               tool_name=TOOL_NAME)).otherwise(plain)

    def tagged(s: Column) -> Column:
        def call(c: Column) -> Column:
            ok = _is_object(c) & ~_absent(c, "$.id") & ~_absent(c, "$.name")
            return F.when(ok, part(type="tool-call", tool_call_id=_vget(c, "$.id"), tool_name=_vget(c, "$.name"),
                                   input=_vget(c, "$.arguments"))
                          ).otherwise(_once(_strict_json(_strip_tag(s, RESULT_TAGS)), result))
        return _once(_strict_json(_strip_tag(s, CALL_TAGS)), call)

    return F.when(F.instr(seg, "<") == 0, plain).otherwise(_once(_trim_ws(seg), tagged))


def split_tagged(text: Column) -> Column:
    """Split text around tool tags, keeping the tags and dropping empty pieces."""
    tags = F.regexp_extract_all(text, F.lit(TAG_PATTERN), F.lit(0))
    between = F.split(text, TAG_PATTERN, -1)
    pairs = F.zip_with(between, tags, lambda b, t: F.array(b, F.coalesce(t, F.lit(""))))
    return F.filter(F.flatten(pairs), lambda s: s != "")


# --------------------------------------------------------------------------- M4

def _item_ok(it: Column) -> Column:
    """Text with a text, image with an address, or reasoning with summaries."""
    kind = _vget(it, "$.type")
    summaries = _all_of(it, "$.summary", lambda s: F.coalesce(
        ((_vget(s, "$.type") == "summary_text") & _is_string(s, "$.text"))
        | ((_vget(s, "$.type") == "summary_encrypted_text") & _is_string(s, "$.data")), F.lit(False)))
    return F.coalesce(((kind == "text") & _is_string(it, "$.text")) | ((kind == "image") & _is_string(it, "$.image_url"))
                      | ((kind == "reasoning") & summaries), F.lit(False))


_CHUNK_FIELDS = ("id:variant,created:variant,model:variant,object:string,"
                 "usage:struct<prompt_tokens:variant,completion_tokens:variant,total_tokens:variant>,"
                 "choices:array<struct<index:variant,delta:struct<role:string,content:variant>>>")


def _chunk_ok(c: Column) -> Column:
    """The required fields of a completion chunk (its ``_CHUNK_FIELDS``), of the required types."""
    usage = [_number_kind(c["usage"][f]) for f in ("prompt_tokens", "completion_tokens", "total_tokens")]

    def choice(one: Column) -> Column:
        delta = one["delta"]
        content = delta["content"].isNull() | _string_kind(delta["content"]) | _all_of(delta["content"], "$", _item_ok)
        role = F.coalesce(delta["role"], F.lit("assistant")) == "assistant"
        return _number_kind(one["index"]) & delta.isNotNull() & role & content

    return (_string_kind(c["id"]) & _number_kind(c["created"]) & _string_kind(c["model"])
            & usage[0] & usage[1] & usage[2] & F.coalesce(c["object"] == "chat.completion.chunk", F.lit(False))
            & F.coalesce(F.forall(c["choices"], choice), F.lit(False)))


_CONTENT_ITEMS = "array<struct<type:string,text:string,summary:array<struct<type:string,text:string>>>>"


def normalise_completions(events: DataFrame) -> DataFrame:
    """Dialect 1 (completion chunks) -> stream parts (M4, M8).

    ``content`` is either a string (split around tool tags; tagged JSON that
    is not an object with the required keys stays text) or an array of items
    (text -> delta, image dropped, reasoning -> one delta per summary text).
    A payload that is no complete completion chunk (``_chunk_ok``) gives one
    error part.
    """
    v = F.col("_v")
    said = F.get("_f.choices", F.lit(0))["delta"]["content"]
    events = _parsed(events, _f=_fields(v, _CHUNK_FIELDS)).withColumns(
        {"_ok": _chunk_ok(F.col("_f")), "_id": _vget(F.col("_f.id"), "$"), "_said": said, "_kind": F.schema_of_variant(said)})
    events = events.withColumns({"_content": F.when(F.col("_kind") == "STRING", _vget(F.col("_said"), "$")),
                                 "_items": F.when(F.col("_kind").startswith("ARRAY"), F.try_variant_get("_said", "$", _CONTENT_ITEMS))})
    ok, cid, kind, items = (F.col(c) for c in ("_ok", "_id", "_kind", "_items"))
    from_items = F.flatten(F.transform(items, lambda it: (
        F.when(it["type"] == "text", F.array(part(type="text-delta", id=cid, delta=it["text"])))
        .when(it["type"] == "reasoning",
              F.transform(F.filter(it["summary"], lambda s: s["type"] == "summary_text"),
                          lambda s: part(type="reasoning-delta", id=cid, delta=s["text"])))
        .otherwise(_none()))))
    from_text = F.transform(split_tagged(F.col("_content")), lambda seg: _tag_part(seg, cid))
    parts = (F.when(~ok, F.array(part(type="error", error=F.lit(PARSE_ERROR))))
             .when(kind == "STRING", from_text)
             .when(kind.startswith("ARRAY"), from_items)
             .otherwise(_none()))
    return _explode_parts(events, parts)


# --------------------------------------------------------------------------- M5

def normalise_chat_agent(events: DataFrame) -> DataFrame:
    """Dialect 2 (role-discriminated deltas) -> stream parts (M5).

    assistant: text delta when content is non-empty, then one tool call per
    entry of ``tool_calls``; tool: a tool result; user: nothing.  A payload
    missing the role's required string fields, or with a tool call that isn't
    a function with id, name and arguments, gives one error part.
    """
    v = F.col("_v")
    delta = F.col("_f.delta")
    role = delta["role"]
    s = lambda p: _string_kind(delta[p])
    calls_ok = delta["tool_calls"].isNull() | _all_of(delta["tool_calls"], "$", lambda c: (
        F.coalesce(_vget(c, "$.type") == "function", F.lit(False)) & _is_string(c, "$.id")
        & _is_string(c, "$.function.name") & _is_string(c, "$.function.arguments")))
    ok = _string_kind(F.col("_f.id")) & F.coalesce(
        ((role == "assistant") & s("content") & s("id") & calls_ok)
        | ((role == "tool") & s("name") & s("content") & s("tool_call_id") & s("id"))
        | ((role == "user") & s("content") & s("id")), F.lit(False))
    events = _parsed(events, _f=_fields(v, "id:variant,delta:struct<role:string,content:variant,id:variant,name:variant,"
                                        "tool_call_id:variant,tool_calls:variant>"))
    events = events.withColumns({"_ok": ok, "_role": role, "_content": _vget(delta["content"], "$"), "_calls": F.try_variant_get(
        delta["tool_calls"], "$", "array<struct<id:string,function:struct<name:string,arguments:string>>>")})
    ok, role, content, calls = (F.col(c) for c in ("_ok", "_role", "_content", "_calls"))
    assistant = F.concat(
        F.when(content != "", F.array(part(type="text-delta", id=_vget(v, "$.delta.id"), delta=content)))
        .otherwise(_none()),
        F.coalesce(F.transform(calls, lambda c: part(type="tool-call", tool_call_id=c["id"],
                                                     input=c["function"]["arguments"],
                                                     tool_name=c["function"]["name"])), _none()))
    parts = (F.when(~ok, F.array(part(type="error", error=F.lit(PARSE_ERROR))))
             .when(role == "assistant", assistant)
             .when(role == "tool", F.array(part(type="tool-result", tool_call_id=_vget(v, "$.delta.tool_call_id"),
                                                result=content, tool_name=TOOL_NAME)))
             .otherwise(_none()))
    return _explode_parts(events, parts)


# --------------------------------------------------------------------------- E8/E9

def _group(t: Column) -> Column:
    return F.when(t.startswith("text-"), "text").when(t.startswith("reasoning-"), "reasoning")


def _is_delta(t: Column) -> Column:
    return F.coalesce(t.isin("text-delta", "reasoning-delta"), F.lit(False))


def with_boundaries(parts: DataFrame) -> DataFrame:
    """Inject start/end parts around delta runs, then drop parts after an end.

    For each part, with ``prev`` the previous converted part of the stream:
    a delta continuing prev's (group, id) passes alone; otherwise prev's run
    is closed (``<group>-end``) if prev was a delta, and a delta opens a new
    run (``<group>-start``).  At the end a trailing delta is closed (flush).
    Then, per (stream, group, id), the first end is kept and every later part
    of that group and id is dropped; the flush end is not subject to it.
    ``ord`` numbers a stream's parts, before any is dropped, from 1.
    """
    w = Window.partitionBy("stream_id").orderBy("seq", "sub")
    beside = {"_pt": F.lag("type").over(w), "_pi": F.lag("id").over(w), "_last": F.lead("sub").over(w).isNull()}
    prev_t, prev_id, is_last = map(F.col, beside)
    cur = F.struct(*[F.col(f).alias(f) for f in PART_FIELDS])
    t, i = F.col("type"), F.col("id")
    matches = (_is_delta(prev_t) & _is_delta(t) & (_group(prev_t) == _group(t))
               & i.isNotNull() & prev_id.isNotNull() & (i == prev_id))
    close_prev = F.when(_is_delta(prev_t), F.array(part(type=F.concat(_group(prev_t), F.lit("-end")), id=prev_id)))
    open_cur = F.when(_is_delta(t), F.array(part(type=F.concat(_group(t), F.lit("-start")), id=i), cur)
                      ).otherwise(F.array(cur))
    out = F.when(F.coalesce(matches, F.lit(False)), F.array(cur)).otherwise(
        F.concat(F.coalesce(close_prev, _none()), open_cur))
    flush = F.when(is_last & _is_delta(t), part(type=F.concat(_group(t), F.lit("-end")), id=i))
    keep = [c for c in parts.columns if c not in PART_FIELDS + ["sub"]]
    marked = F.concat(F.transform(out, lambda p: F.struct(p.alias("p"), F.lit(False).alias("is_flush"))),
                      F.when(flush.isNotNull(), F.array(F.struct(flush.alias("p"), F.lit(True).alias("is_flush"))))
                      .otherwise(F.array().cast(f"array<struct<p:{_PART_DDL},is_flush:boolean>>")))
    allp = parts.withColumns(beside).select(*keep, "sub", F.posexplode(marked).alias("k", "m"))
    in_order = Window.partitionBy("stream_id").orderBy("seq", "sub", "k")
    allp = allp.select(*keep, F.row_number().over(in_order).cast("bigint").alias("ord"), "m.is_flush",
                       *[F.col(f"m.p.{f}").alias(f) for f in PART_FIELDS])
    key = F.when(_group(F.col("type")).isNotNull() & F.col("id").isNotNull(),
                 F.concat(_group(F.col("type")), F.lit(":"), F.col("id")))
    allp = allp.withColumn("end_key", key)
    is_end = F.col("type").isin("text-end", "reasoning-end") & ~F.col("is_flush")
    first_end = F.min(F.when(is_end, F.col("ord"))).over(Window.partitionBy("stream_id", "end_key"))
    kept = allp.withColumn("_fe", first_end).filter(
        F.col("end_key").isNull() | F.col("is_flush") | F.col("_fe").isNull() | (F.col("ord") <= F.col("_fe")))
    return kept.drop("_fe", "end_key")


# --------------------------------------------------------------------------- M9

def assembled_text(stream_parts: DataFrame) -> DataFrame:
    """Text of each (stream, item id): its deltas concatenated in order (M9)."""
    d = stream_parts.filter(F.col("type").isin("text-delta", "reasoning-delta"))
    g = d.groupBy("stream_id", "id", _group(F.col("type")).alias("kind")).agg(
        F.array_sort(F.collect_list(F.struct("ord", "delta"))).alias("xs"),
        F.min("ord").alias("first_ord"))
    return g.select("stream_id", "id", "kind", "first_ord",
                    F.array_join(F.transform("xs", lambda x: x["delta"]), "").alias("text"))


# --------------------------------------------------------------------------- UI parts, E7, H5-H8

def ui_parts(stream_parts: DataFrame) -> DataFrame:
    """Message parts as a client shows them: one text / reasoning part per item
    (assembled), one ``source-url`` per citation, one ``tool`` per call.

    One aggregate keyed by (stream, item) for deltas and by (stream, ordinal)
    for the rest; it reuses the stream partitioning of the boundary step.
    """
    t = F.col("type")
    delta = t.isin("text-delta", "reasoning-delta")
    keep = stream_parts.filter(delta | t.isin("source", "tool-call"))
    key = F.when(delta, F.concat(_group(t), F.lit(":"), F.col("id"))).otherwise(
        F.concat(F.lit("#"), F.col("ord").cast("string")))
    g = keep.groupBy("stream_id", key.alias("_k")).agg(
        F.min("ord").alias("pos"),
        F.max(F.when(delta, _group(t)).when(t == "source", "source-url").otherwise("tool")).alias("type"),
        F.array_sort(F.collect_list(F.struct("ord", F.when(delta, F.col("delta")).alias("d")))).alias("xs"),
        F.max("input").alias("input"), F.max("url").alias("url"), F.max("title").alias("title"))
    text = F.when(F.col("type").isin("text", "reasoning"),
                  F.array_join(F.transform("xs", lambda x: x["d"]), "")).when(
        F.col("type") == "tool", F.col("input"))
    return g.select("stream_id", "pos", "type", text.alias("text"), "url", "title")


def is_name_part(t: Column, text: Column) -> Column:
    """A text part that is exactly a ``<name>…</name>`` speaker tag (H7)."""
    return F.coalesce((t == "text") & text.startswith("<name>") & text.endswith("</name>"), F.lit(False))


def _replace_first(s: Column, old: str) -> Column:
    p = F.instr(s, old)
    return F.when(p > 0, F.concat(F.substring(s, F.lit(1), p - 1),
                                  F.substring(s, p + len(old), F.length(s)))).otherwise(s)


def speaker_name(text: Column) -> Column:
    return _replace_first(_replace_first(text, "<name>"), "</name>")


def segments(ui: DataFrame) -> DataFrame:
    """Adjacent parts grouped into render segments (E7), without a loop.

    A source joins when the previous part is text or source; a plain text
    joins when the latest earlier text of its text/source run is plain (not a
    speaker tag); everything else starts a segment.
    """
    w = Window.partitionBy("stream_id").orderBy("pos")
    t = F.col("type")
    name = is_name_part(t, F.col("text"))
    textish = t.isin("text", "source-url")
    df = ui.withColumn("_name", name).withColumn(
        "_run", F.sum(F.when(textish, 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    wr = Window.partitionBy("stream_id", "_run").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    last_text_is_name = F.last(F.when(t == "text", F.col("_name")), ignorenulls=True).over(wr)
    prev_t = F.lag("type").over(w)
    new = (F.when(t == "source-url", ~F.coalesce(prev_t.isin("text", "source-url"), F.lit(False)))
           .when(t == "text", F.col("_name") | F.coalesce(last_text_is_name, F.lit(True)))
           .otherwise(F.lit(True)))
    df = df.withColumn("_new", new.cast("int"))
    return df.withColumn("segment", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop(
        "_run", "_new")


def citation(url: Column, title: Column) -> Column:
    """``[title or url](url::suffix)`` (H6)."""
    label = F.when(F.coalesce(title, F.lit("")) != "", title).otherwise(url)
    return F.concat(F.lit("["), label, F.lit("]("), url, F.lit(CITATION_SUFFIX + ")"))


def segment_markdown(seg: DataFrame) -> DataFrame:
    """Join each segment into markdown; a citation after a table pipe goes inside it (H6).

    A text's closing pipe stands behind the citations that follow it, before the next
    text that isn't empty or at the end.  So each part gives one piece, which depends on
    the last text before it only, and the pieces are joined once.
    """
    text = F.col("type") == "text"
    own = F.coalesce(F.when(text, F.col("text")), F.lit(""))
    piped = F.when(own != "", own.endswith("|"))
    before = Window.partitionBy("stream_id", "segment").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    held = F.coalesce(F.last(piped, ignorenulls=True).over(before), F.lit(False))
    body = F.when(piped, F.substring(own, F.lit(1), F.length(own) - 1)).otherwise(own)
    piece = (F.when(own != "", F.concat(F.when(held, "|").otherwise(""), body))
             .when(F.col("type") == "source-url", F.concat(F.lit(" "), citation(F.col("url"), F.col("title")))).otherwise(""))
    g = seg.select("stream_id", "segment", "pos", piece.alias("piece"), piped.alias("piped")).groupBy("stream_id", "segment").agg(
        F.array_sort(F.collect_list(F.struct("pos", "piece"))).alias("xs"), F.max_by("piped", F.when(F.col("piped").isNotNull(), F.col("pos"))).alias("held"))
    end = F.when(F.col("held"), "|").otherwise("")
    return g.select("stream_id", "segment", F.concat(F.array_join(F.col("xs.piece"), ""), end).alias("markdown"))


def message_text(ui: DataFrame) -> DataFrame:
    """Plain text of each message: text parts joined in order, first marker removed (H5, H8)."""
    from larder.operators.chats import sanitize
    g = ui.filter(F.col("type") == "text").groupBy("stream_id").agg(
        F.array_sort(F.collect_list(F.struct("pos", "text"))).alias("xs"))
    raw = F.array_join(F.transform("xs", lambda x: x["text"]), "")
    return g.select("stream_id", sanitize(raw).alias("text"))


# --------------------------------------------------------------------------- C7, M10, M11

def tool_call_pairs(parts: DataFrame) -> DataFrame:
    """Each tool call with its result, matched by call id within the stream."""
    at = F.struct("seq", "sub")
    call, result = F.col("type") == "tool-call", F.col("type") == "tool-result"
    fields = F.struct(F.col("tool_name").alias("call_tool_name"), "input", F.col("seq").alias("call_seq"), "sub")
    both = parts.filter(call | result).groupBy("stream_id", "tool_call_id").agg(
        F.collect_list(F.when(call, fields)).alias("calls"),
        F.min_by(F.when(result, F.col("result")), F.when(result, at)).alias("result"))
    return both.select("stream_id", "tool_call_id", F.inline("calls"), "result").drop("sub")


def serialise_tool_parts(parts: DataFrame) -> DataFrame:
    """Tool calls and results back to the current tag form."""
    call = F.concat(F.lit(NEW_CALL[0]),
                    F.to_json(F.struct(F.col("tool_call_id").alias("id"), F.col("tool_name").alias("name"),
                                       F.col("input").alias("arguments"))), F.lit(NEW_CALL[1]))
    res = F.concat(F.lit(NEW_RESULT[0]),
                   F.to_json(F.struct(F.col("tool_call_id").alias("id"), F.col("result").alias("content"))),
                   F.lit(NEW_RESULT[1]))
    t = parts.filter(F.col("type").isin("tool-call", "tool-result"))
    return t.select("stream_id", "seq", "sub", "type",
                    F.when(F.col("type") == "tool-call", call).otherwise(res).alias("tagged"))


def stream_errors(parts: DataFrame) -> DataFrame:
    """Per stream: error parts, failed parses and the finish reason."""
    g = parts.groupBy("stream_id").agg(
        F.count(F.lit(1)).alias("n_parts"),
        F.count_if(F.col("type") == "error").alias("n_errors"),
        F.count_if((F.col("type") == "error") & (F.col("error") == PARSE_ERROR)).alias("n_failed_parses"))
    return g.withColumn("finish_reason", F.when(F.col("n_failed_parses") > 0, "error").otherwise("unknown"))


# --------------------------------------------------------------------------- S4, S5

def resume_from_cursor(events: DataFrame, cursors: DataFrame) -> DataFrame:
    """Events a reconnecting reader still needs: index >= its cursor."""
    j = events.join(cursors, "stream_id", "inner")
    return j.filter(F.col("seq") >= F.col("cursor")).drop("cursor")


def idle_sessions(events: DataFrame, gap: str = "5 minutes") -> DataFrame:
    """Activity sessions of each stream; a session ends ``gap`` after its last event."""
    s = events.groupBy("stream_id", F.session_window("ts", gap).alias("w")).agg(
        F.count(F.lit(1)).alias("n_events"))
    return s.select("stream_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"),
                    "n_events")


# --------------------------------------------------------------------------- M7

CONTENT_FIELDS = ["type", "text", "tool_call_id", "tool_name", "input", "result", "item_id"]


def content(**kw) -> Column:
    """One content part of a whole (non-streamed) response."""
    return F.struct(*[(kw[f] if isinstance(kw.get(f), Column) else F.lit(kw.get(f))).cast("string").alias(f)
                      for f in CONTENT_FIELDS])


_NO_CONTENT = "array<struct<" + ",".join(f"{f}:string" for f in CONTENT_FIELDS) + ">>"
_RESP_ITEMS = ("array<struct<type:string,id:string,call_id:string,name:string,arguments:string,output:string,"
               "content:array<struct<type:string,text:string>>,summary:array<struct<type:string,text:string>>>>")
_CA_MSGS = ("array<struct<role:string,content:string,tool_call_id:string,"
            "tool_calls:array<struct<id:string,function:struct<name:string,arguments:string>>>>>")


def _none_content() -> Column:
    return F.array().cast(_NO_CONTENT)


def _whole_text_tool(text: Column) -> Column:
    """Whole-content tag check: the entire trimmed text is one tool call or result."""
    p = _tag_part(text, F.lit(None))
    return F.when(p["type"] == "text-delta", F.array(content(type="text", text=text))).otherwise(
        F.array(content(type=p["type"], tool_call_id=p["tool_call_id"], tool_name=p["tool_name"],
                        input=p["input"], result=p["result"])))


def normalise_whole_responses(resp: DataFrame, dialect: str) -> DataFrame:
    """Non-streamed responses -> content parts, for each dialect (M7).

    Unlike the chunk converters, every content / summary entry is read, and
    the real tool name is kept on calls.  Completion text is checked for tags
    as a whole (it is not split).
    """
    v = F.try_parse_json(F.col("response"))
    if dialect == "responses":
        items = F.try_variant_get(v, "$.output", _RESP_ITEMS)
        parts = F.flatten(F.transform(items, lambda o: (
            F.when(o["type"] == "message",
                   F.transform(F.filter(o["content"], lambda c: c["type"] == "output_text"),
                               lambda c: content(type="text", text=c["text"], item_id=o["id"])))
            .when(o["type"] == "function_call",
                  F.array(content(type="tool-call", tool_call_id=o["call_id"], tool_name=o["name"],
                                  input=o["arguments"], item_id=o["id"])))
            .when(o["type"] == "reasoning",
                  F.transform(F.filter(o["summary"], lambda s: s["type"] == "summary_text"),
                              lambda s: content(type="reasoning", text=s["text"], item_id=o["id"])))
            .when(o["type"] == "function_call_output",
                  F.array(content(type="tool-result", tool_call_id=o["call_id"], result=o["output"],
                                  tool_name=TOOL_NAME)))
            .otherwise(_none_content()))))
    elif dialect == "completions":
        path = "$.choices[0].message.content"
        kind = F.schema_of_variant(F.try_variant_get(v, path, "variant"))
        items = F.try_variant_get(v, path, _CONTENT_ITEMS)
        from_items = F.flatten(F.transform(items, lambda it: (
            F.when(it["type"] == "text", F.array(content(type="text", text=it["text"])))
            .when(it["type"] == "reasoning",
                  F.transform(F.filter(it["summary"], lambda s: s["type"] == "summary_text"),
                              lambda s: content(type="reasoning", text=s["text"])))
            .otherwise(_none_content()))))
        parts = (F.when(kind == "STRING", _whole_text_tool(_vget(v, path)))
                 .when(kind.startswith("ARRAY"), from_items).otherwise(_none_content()))
    else:
        msgs = F.try_variant_get(v, "$.messages", _CA_MSGS)
        parts = F.flatten(F.transform(msgs, lambda m: (
            F.when(m["role"] == "assistant", F.concat(
                F.array(content(type="text", text=m["content"])),
                F.coalesce(F.transform(m["tool_calls"], lambda c: content(
                    type="tool-call", tool_call_id=c["id"], tool_name=c["function"]["name"],
                    input=c["function"]["arguments"])), _none_content())))
            .when(m["role"] == "tool", F.array(content(type="tool-result", tool_call_id=m["tool_call_id"],
                                                       result=m["content"], tool_name=TOOL_NAME)))
            .otherwise(_none_content()))))
    return resp.select("stream_id", F.posexplode(parts).alias("idx", "c")).select(
        "stream_id", "idx", *[F.col(f"c.{f}").alias(f) for f in CONTENT_FIELDS])
