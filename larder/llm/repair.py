"""Conversation structure repair: Knuth's lightest derivation over an agenda.

Role initials of a sound conversation read ``(s?(ua)+)?``.  Rows are kept, given another role or
deleted, and empty turns inserted, at the least cost; of the cheapest ways the one whose edits'
initials come first in ASCII order.

Items are weighted deductions: prefix item (i, q) says that the first i rows are repaired and the
automaton of the roles is in state q, edit item (i, e) that row i gets edit e.  A prefix and an
edit item derive a longer prefix (a hyperedge with two tails), a prefix alone derives another by
an insertion.  A derived value is (sum of the costs, tails' edits in order): a superior function,
as it is never below a tail's value and, for prefixes of the same rows, monotone (of two equal
costs no edits are a proper prefix of the other's).  So an agenda that pops the least value
finalises each item at its lightest derivation.

Rows are worked on by blocks: spans of ``SPAN`` turn numbers, of ``BLOCK`` rows at most.  A block
item (p, q) is the lightest derivation from state p before it to state q after it; blocks of long
conversations are derived apart, and a last deduction joins prefix and block items to the goal.
Blocks of the same shape (one symbol a row) are derived once per worker.

Repaired texts pass a task row by row, behind the edits of their conversation; none is held, and a
digest of a repaired conversation is one SHA-256 over its rows in order.

Cases: in the query a null conversation id, turn, role or text counts as one space (rows without
an id are one conversation, with id null); null turns come first, equal turns are ordered by the
turn's MD5, so repeated rows are neighbours and all but the first are duplicates; a role whose
initial is none of s, u and a can't be kept, nor can an empty one; a conversation without rows has
zeros and no edits; an empty table gives an empty result; texts may have any length; columns that
are not read may have any name.
"""

from __future__ import annotations

import functools
import hashlib
import heapq

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larder.llm.common import crc32_sql, turn_id

#: Turn numbers and rows of a block.
SPAN, BLOCK = 1024, 1024
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
#: The automaton of the role initials: state and initial to state; 0 and 3 are accepting.
STEPS = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
STATES, ACCEPTING = 4, (0, 3)
#: What white space is.
BLANKS = " \t\n\x0b\x0c\r"
STATS = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
ROW = "conv_id long, edits long, place long, role string, text string, edit string"


def _edits(symbol: str) -> list[list[tuple[int, str, int]]]:
    """Per state, the edit items of a row: (cost, initial of the edit, state after it)."""
    out = []
    for q in range(STATES):
        found = [(DELETE, "D", q)]
        if symbol != "d":
            more, initial = (TRUNCATED if symbol.isupper() else 0), symbol.lower()
            if (q, initial) in STEPS:
                found.append((KEEP + more, "K", STEPS[q, initial]))
            found += [(REROLE + more, "R", STEPS[q, r]) for r in "ua" if (q, r) in STEPS]
        out.append(found)
    return out


#: A row's symbol: its role's initial or x, a capital if truncated; d if it must go.
EDITS = {c: _edits(c) for c in "suaxSUAXd"}
INSERTIONS = [[(INSERT, "I", STEPS[q, r]) for r in "ua" if (q, r) in STEPS] for q in range(STATES)]


@functools.lru_cache(1 << 14)
def derived(shape: str, entry: int) -> tuple:
    """Per state after the rows of ``shape``, the lightest (cost, edits) from ``entry``; None where there is none."""
    final: dict[tuple[int, int], tuple[int, str]] = {}
    agenda = [(0, "", 0, entry)]
    while agenda:
        cost, edits, i, q = heapq.heappop(agenda)
        if (i, q) in final:
            continue
        final[i, q] = cost, edits
        for more, e, to in INSERTIONS[q]:
            if (i, to) not in final:
                heapq.heappush(agenda, (cost + more, edits + e, i, to))
        if i < len(shape):
            for more, e, to in EDITS[shape[i]][q]:
                if (i + 1, to) not in final:
                    heapq.heappush(agenda, (cost + more, edits + e, i + 1, to))
    return tuple(final.get((len(shape), q)) for q in range(STATES))


def joined(prefix: list, block: list[list]) -> list:
    """Prefix items behind a block, from those before it and the block's items."""
    out = []
    for q in range(STATES):
        ways = [(prefix[p][0] + block[p][q][0], prefix[p][1] + block[p][q][1]) for p in range(STATES) if prefix[p] and block[p][q]]
        out.append(min(ways, default=None))
    return out


def goal(prefix: list) -> tuple[int, str]:
    return min(prefix[q] for q in ACCEPTING if prefix[q])


# ---- rows

def damaged(conversations: DataFrame) -> DataFrame:
    """The query's damaged rows (conv_id, turn, role, text), ``gone`` where a row was dropped."""
    text_of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    harm = F.crc32(F.encode(F.concat(text_of("conv_id"), F.lit(":"), text_of("turn")), "UTF-8")) % 20
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                                text_of("role").alias("role"), text_of("text").alias("text"), harm.alias("harm"))
    rows = rows.withColumn("text", F.when(F.col("harm") == 1, "").when(F.col("harm") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")))
    rows = rows.withColumn("role", F.when(F.col("harm") == 4, "user").otherwise(F.col("role")))
    twice = F.explode(F.when(F.col("harm") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.withColumn("copy", twice).select("conv_id", "turn", "role", "text", (F.col("harm") == 0).alias("gone"))


def _order(*first: str) -> list:
    return [*map(F.col, first), F.col("turn").asc_nulls_first(), F.col("id")]


def faulty(rows: DataFrame) -> DataFrame:
    """What repair goes by: (conv_id, turn, id, span, initial, fault) without the texts; ``fault`` is None, blank, duplicate or truncated.

    A row that is ``gone`` stays as one with that fault, so that its conversation is known.
    """
    bare = F.rtrim("text", F.lit(BLANKS))
    slim = rows.select("conv_id", "turn", turn_id(F.col("role"), F.col("text")).alias("id"), F.substring("role", 1, 1).alias("initial"),
                       (bare == "").alias("blank"), (~F.substring(bare, -1, 1).isin(".", "!", "?")).alias("truncated"), "gone")
    again = F.row_number().over(Window.partitionBy("conv_id", "gone", "id").orderBy(F.col("turn").asc_nulls_first())) > 1
    fault = F.when(F.col("gone"), "gone").when(F.col("blank"), "blank").when(again, "duplicate").when(F.col("truncated"), "truncated")
    return slim.select("conv_id", "turn", "id", F.coalesce(F.expr(f"turn div {SPAN}"), F.lit(-(1 << 62))).alias("span"), "initial", fault.alias("fault"))


BLOCKS = ("conv_id long, span long, part long, least long, most long, turns long, blank long, duplicate long, truncated long, illegal long, "
          "first string, last string, cost array<long>, edits array<string>")


def _batch(rows: list, schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "string": pa.string(), "array<long>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string())}
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(x, kinds[k]) for x, (_, k) in zip(zip(*rows), fields)], [n for n, _ in fields])


def _pairs_broken(initials: list[str]) -> int:
    return sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))


def _block(key, part: int, rows: list) -> tuple:
    stay = [r for r in rows if r[2] != "gone"]
    turns = {r[0] for r in stay if r[0] is not None}
    faults = [r[2] for r in stay]
    initials = [r[1] for r in stay]
    shape = "".join("d" if f in ("blank", "duplicate") else (c if c in ("s", "u", "a") else "x") if f is None else (c if c in ("s", "u", "a") else "x").upper()
                    for c, f in zip(initials, faults))
    items = [x for p in range(STATES) for x in derived(shape, p)]
    return (*key, part, min(turns, default=None), max(turns, default=None), len(turns), *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
            _pairs_broken(initials), initials[0] if stay else None, initials[-1] if stay else None,
            [x and x[0] for x in items], [x and x[1] for x in items])


def _blocks(batches):
    """Block items of rows sorted by (conv_id, span, turn, id).  A turn number that two blocks share counts in the first."""
    now, part, held, last = None, 0, [], None

    def done():
        nonlocal last
        out = _block(now, part, held)
        turns = [r[0] for r in held if r[0] is not None and r[2] != "gone"]
        if turns:
            if turns[0] == last:
                out = (*out[:5], out[5] - 1, *out[6:])
            last = turns[-1]
        return out

    for b in batches:
        out = []
        for c, s, *row in zip(*(b.column(x).to_pylist() for x in ("conv_id", "span", "turn", "initial", "fault"))):
            if (c, s) != now or len(held) == BLOCK:
                if held:
                    out.append(done())
                if (c, s) == now:
                    part += 1
                else:
                    part, last = 0, None
                now, held = (c, s), []
            held.append(row)
        if out:
            yield _batch(out, BLOCKS)
    if held:
        yield _batch([done()], BLOCKS)


def _goals(batches):
    """(conv_id, STATS) from blocks sorted by (conv_id, span, part)."""
    schema = "conv_id long, " + STATS
    now, known, state = None, False, None

    def done():
        cost, edits = goal(state["prefix"])
        gaps = state["most"] - state["least"] + 1 - state["turns"] if state["turns"] else 0
        return (now, gaps, *state["faults"], state["illegal"], cost, edits)

    for b in batches:
        out = []
        for r in b.to_pylist():
            if not known or r["conv_id"] != now:
                if known:
                    out.append(done())
                now, known = r["conv_id"], True
                state = {"prefix": [(0, ""), None, None, None], "least": None, "most": None, "turns": 0, "faults": [0, 0, 0], "illegal": 0, "last": None}
            items = [x if x[0] is not None else None for x in zip(r["cost"], r["edits"])]
            state["prefix"] = joined(state["prefix"], [items[STATES * p:STATES * (p + 1)] for p in range(STATES)])
            if r["turns"] or r["least"] is not None:
                state["least"] = r["least"] if state["least"] is None else min(state["least"], r["least"])
                state["most"] = r["most"] if state["most"] is None else max(state["most"], r["most"])
                state["turns"] += r["turns"]
            state["faults"] = [x + r[f] for x, f in zip(state["faults"], ("blank", "duplicate", "truncated"))]
            state["illegal"] += r["illegal"]
            if r["first"] is not None:
                state["illegal"] += _pairs_broken([x for x in (state["last"], r["first"]) if x is not None])
                state["last"] = r["last"]
        if out:
            yield _batch(out, schema)
    if known:
        yield _batch([done()], schema)


def repairs(rows: DataFrame) -> DataFrame:
    """(conv_id, STATS) of each conversation of ``rows`` (conv_id, turn, role, text, gone): its faults, and its cheapest edits."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    slim = faulty(rows).repartition(n, "conv_id", "span").sortWithinPartitions(*_order("conv_id", "span"))
    blocks = slim.mapInArrow(_blocks, BLOCKS).repartition(n, "conv_id").sortWithinPartitions("conv_id", "span", "part")
    return blocks.mapInArrow(_goals, "conv_id long, " + STATS)


def _applied(batches):
    """Repaired rows (ROW and STATS) of rows sorted behind their conversation's edits.

    A conversation begins with a row of its STATS (``edits`` 0); ``edits`` numbers the edits, ``place`` the rows that stay.
    """
    fields = ROW + ", " + STATS
    none = (None,) * len(STATS.split(", "))
    now, known, edits, at, place, last = None, False, "", 0, 0, ""

    def inserted(out):
        nonlocal at, place, last
        while at < len(edits) and edits[at] == "I":
            at, place, last = at + 1, place + 1, "a" if last == "u" else "u"
            out.append((now, at, place, "user" if last == "u" else "assistant", "", "I", *none))

    for b in batches:
        out = []
        names = b.schema.names
        for r in zip(*(b.column(c).to_pylist() for c in names)):
            r = dict(zip(names, r))
            if r["head"]:
                now, known, edits, at, place, last = r["conv_id"], True, r["audit"], 0, 0, ""
                out.append((now, 0, 0, None, None, None, *(r[f.split()[0]] for f in STATS.split(", "))))
                inserted(out)
                continue
            e, at = edits[at], at + 1
            if e == "D":
                out.append((now, at, None, r["role"], r["text"], "D", *none))
            else:
                place += 1
                last = r["role"][0] if e == "K" else "a" if last == "u" else "u"
                out.append((now, at, place, r["role"] if e == "K" else "user" if last == "u" else "assistant", r["text"], e, *none))
            inserted(out)
        if out:
            yield _batch(out, fields)


def applied(rows: DataFrame) -> DataFrame:
    """Repaired conversations: for each a row of STATS (``edits`` 0), then its edited rows (ROW) in order, deleted ones without a place."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    stats = [f.split() for f in STATS.split(", ")]
    heads = repairs(rows).select("conv_id", F.lit(True).alias("head"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("id"),
                                 F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"), *[c for c, _ in stats])
    texts = rows.filter("not gone").select("conv_id", F.lit(False).alias("head"), "turn", turn_id(F.col("role"), F.col("text")).alias("id"), "role", "text",
                                           *[F.lit(None).cast(k if k == "string" else "long").alias(c) for c, k in stats])
    behind = [F.col("conv_id"), F.col("head").desc(), *_order()]
    rows = heads.union(texts).repartition(n, "conv_id").sortWithinPartitions(*behind).drop("turn", "id")
    return rows.mapInArrow(_applied, ROW + ", " + STATS)


def repaired(rows: DataFrame) -> DataFrame:
    """The sound conversations: (conv_id, turn, role, text, edit), turns numbered from 0."""
    rows = rows if "gone" in rows.columns else rows.select("conv_id", "turn", "role", "text", F.lit(False).alias("gone"))
    return applied(rows).filter("place > 0").select("conv_id", (F.col("place") - 1).alias("turn"), "role", "text", "edit")


DIGEST = "conv_id long, " + STATS + ", repaired_sha256 string"


def _digests(batches):
    """DIGEST of conversations from their applied rows, in order."""
    head, sha, any_row = None, None, False
    for b in batches:
        out = []
        names = [f.split()[0] for f in STATS.split(", ")]
        columns = [b.column(c).to_pylist() for c in ("conv_id", "edits", "place", "role", "text", *names)]
        for conv, edits, place, role, text, *stats in zip(*columns):
            if edits == 0:
                if head:
                    out.append((*head, sha.hexdigest()))
                head, sha, any_row = (conv, *stats), hashlib.sha256(), False
            elif place:
                sha.update(("\n" * any_row + f"{role}:{text}").encode())
                any_row = True
        if out:
            yield _batch(out, DIGEST)
    if head:
        yield _batch([(*head, sha.hexdigest())], DIGEST)


def digest(conversations: DataFrame) -> DataFrame:
    """Contract columns of the repair of the damaged conversations."""
    rows = damaged(conversations.select("conv_id", "turn", "role", "text"))
    return applied(rows).mapInArrow(_digests, DIGEST)


# ---- SQL: a fold over the symbols of each conversation, with the best of the four states as text (nine digits
# of cost, then the edits; ~ for none), so that the least text is the lightest

def _sql_plus(state: str, cost, edit: str) -> str:
    return f"CASE WHEN {state} = '~' THEN '~' ELSE lpad(cast(cast({state}[1:9] AS BIGINT) + {cost} AS VARCHAR), 9, '0') || {state}[10:] || '{edit}' END"


def _sql_row() -> str:
    """The states ``s`` (from 1) after a row of symbol ``c[1]``."""
    more = "(CASE WHEN c[1] IN ('S', 'U', 'A', 'X') THEN 1 ELSE 0 END)"
    out = []
    for to in range(STATES):
        ways = [_sql_plus(f"s[{to + 1}]", DELETE, "D")]
        for (q, initial), after in STEPS.items():
            if after == to:
                ways.append(f"CASE WHEN lower(c[1]) = '{initial}' THEN {_sql_plus(f's[{q + 1}]', more, 'K')} ELSE '~' END")
                if initial != "s":
                    ways.append(f"CASE WHEN c[1] <> 'd' THEN {_sql_plus(f's[{q + 1}]', f'{REROLE} + {more}', 'R')} ELSE '~' END")
        out.append(f"least({', '.join(ways)})")
    return f"[{', '.join(out)}]"


def _sql_inserted(states: str) -> str:
    """States after insertions: of a user, then of an assistant (more would only add to the cost)."""
    user = ", ".join(_sql_plus(f"t[{q + 1}]", INSERT, "I") for q in (0, 1, 3))
    first = f"lambda t: [t[1], t[2], least(t[3], {user}), t[4]]"
    second = f"lambda t: [t[1], t[2], t[3], least(t[4], {_sql_plus('t[3]', INSERT, 'I')})]"
    return f"list_transform(list_transform([{states}], {first}), {second})[1]"


_START = _sql_inserted("['000000000', '~', '~', '~']")
_FOLD = f"list_reduce(list_prepend({_START}, symbols), lambda s, c: list_transform([{_sql_row()}], lambda n: {_sql_inserted('n')})[1])"

ORACLE = f"""
WITH harmed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         {crc32_sql("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS harm FROM conversations),
copies AS (
  SELECT conv_id, turn, CASE WHEN harm = 4 THEN 'user' ELSE role END AS role,
         CASE WHEN harm = 1 THEN '' WHEN harm = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(CASE WHEN harm = 3 THEN [0, 1] ELSE [0] END) AS copy FROM harmed WHERE harm <> 0),
placed AS (
  SELECT *, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(length(role)::VARCHAR || ':' || role || text), copy) AS pos FROM copies),
judged AS (
  SELECT *, CASE WHEN bare = '' THEN 'blank'
                 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 THEN 'duplicate'
                 WHEN bare[-1] NOT IN ('.', '!', '?') THEN 'truncated' ELSE 'sound' END AS fault,
         CASE WHEN role[1] IN ('s', 'u', 'a') THEN role[1] ELSE 'x' END AS initial,
         lag(role[1]) OVER (PARTITION BY conv_id ORDER BY pos) || role[1] AS beside,
         pos > 1 AS follows FROM placed),
talks AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
         count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
         count(*) FILTER (follows AND beside NOT IN ('su', 'ua', 'au')) AS illegal,
         list([CASE WHEN fault IN ('blank', 'duplicate') THEN 'd' WHEN fault = 'truncated' THEN upper(initial) ELSE initial END] ORDER BY pos) AS symbols
  FROM judged GROUP BY conv_id),
best AS (SELECT *, {_FOLD} AS ends FROM talks),
solved AS (SELECT *, cast(least(ends[1], ends[4])[1:9] AS BIGINT) AS cost, least(ends[1], ends[4])[10:] AS audit FROM best),
letters AS (SELECT conv_id, unnest(string_split(audit, '')) AS e, unnest(range(1, len(audit) + 1)) AS i FROM solved WHERE audit <> ''),
numbered AS (
  SELECT *, sum((e <> 'I')::BIGINT) OVER w AS pos, sum((e <> 'D')::BIGINT) OVER w AS place FROM letters WINDOW w AS (PARTITION BY conv_id ORDER BY i)),
kept AS (
  SELECT n.conv_id, n.i, n.e, n.place, j.role, CASE WHEN n.e = 'I' THEN '' ELSE j.text END AS text,
         max((n.e = 'K' AND j.initial = 's')::BIGINT) OVER (PARTITION BY n.conv_id) AS led
  FROM numbered n JOIN judged j ON j.conv_id IS NOT DISTINCT FROM n.conv_id AND j.pos = greatest(n.pos, 1) WHERE n.e <> 'D'),
texts AS (
  SELECT conv_id, string_agg(CASE WHEN e = 'K' THEN role WHEN (place - led) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY i) AS text
  FROM kept GROUP BY conv_id)
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
       coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit,
       sha256(coalesce(x.text, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c
LEFT JOIN solved s ON s.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN texts x ON x.conv_id IS NOT DISTINCT FROM c.conv_id
"""
