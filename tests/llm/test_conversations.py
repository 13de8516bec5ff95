"""Prefix trie and structure repair of conversations against brute force, and their cases."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import duckdb
import pyarrow as pa
import pytest

from larder.llm import repair, trie

from .helpers import WORD

ROWS = "conv_id long, turn long, role string, text string"


def md5(role, text):
    return hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()


def talks(seed=5):
    """Conversations that share starts of every length, long ones, equal ones, and rows with nulls and repeats."""
    rng, rows = random.Random(seed), []
    long = [("user" if i % 2 == 0 else "assistant", f"t{i}") for i in range(70)]
    for c in [*range(90), -7, -20, 10**12]:
        kind = rng.randrange(5)
        if kind == 0:
            turns = long[:rng.randrange(1, 71)]
        elif kind == 1:
            turns = [("user", "hello there now"), ("assistant", "hi")][:rng.randrange(1, 3)]
        elif kind == 2:
            turns = [(rng.choice(["user", None, "system"]), rng.choice(["a b", "c", None, ""])) for _ in range(rng.randrange(1, 6))]
        elif kind == 3:
            turns = long[:10] + [("x", str(rng.randrange(3))) for _ in range(rng.randrange(1, 15))]
        else:
            continue
        rows += [(c, None if i == 0 and kind == 2 else i * 700, *t) for i, t in enumerate(turns)]
    return rows + rows[:5] + [(None, 1, "user", "x")]


def brute_trie(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, md5(role or "", text or ""), role or "", text or ""))
    own = {c: [t[3:] for t in sorted(x)] for c, x in own.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (abs(c) % 20) * (1 if c >= 0 else -1)
        path = tuple(own.get(base, [])[:h] + turns[h:])
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
        ends[path].append(c)
    parents = {n[:-1] for n in members if n}
    out = []
    below = {n: [0, 0, 0] for n in members}
    for n, who in members.items():
        saved = (len(who) - 1) * len(WORD.findall(n[-1][1])) if n else 0
        for d in range(len(n) + 1):
            below[n[:d]][0] += n not in parents
            below[n[:d]][1] += saved
        if n:
            below[n[:-1]][2] += 1
    for n, who in members.items():
        sha = hashlib.sha256(",".join(map(str, sorted(ends[n]))).encode()).hexdigest() if n in ends else trie.EMPTY_SHA
        out.append((min(who), len(n), min(members[n[:-1]]) if n else None, len(who), below[n][2], below[n][0], below[n][1], sha))
    return sorted(out, key=str)


@pytest.mark.parametrize("width, chunk", [(32, 1 << 18), (5, 20), (6, 1 << 18), (3, 7), (32, 9)])
def test_trie_equals_brute_force(spark, width, chunk):
    """Also where conversations take many blocks, and chunks cut most nodes."""
    rows = talks()
    frame = spark.createDataFrame(rows, ROWS).repartition(3)
    got = trie.trie(*trie.rebuilt(frame), width, chunk).select(*trie.COLUMNS).collect()
    assert sorted(map(tuple, got), key=str) == brute_trie(rows)


def test_trie_of_equal_conversations_is_cut_into_pieces(spark):
    rows = [(c, t, "user", f"{t} words here") for c in range(1500) for t in range(3)]
    frame = spark.createDataFrame(rows, ROWS)
    got = trie.trie(*trie.rebuilt(frame), 32, 500).collect()
    assert sorted(map(tuple, got), key=str) == brute_trie(rows)


def test_trie_cases(spark):
    none = spark.createDataFrame([], ROWS)
    assert trie.digest(none).collect() == []
    # every turn is lent by an absent conversation: one member, no turns
    bare = next(c for c in range(1, 99) if c % 20 and zlib.crc32(str(c).encode()) % 4 == 3)
    alone = spark.createDataFrame([(bare, 0, None, None)], ROWS)
    assert [tuple(r) for r in trie.digest(alone).collect()] == [
        (bare, 0, None, 1, 0, 1, 0, hashlib.sha256(str(bare).encode()).hexdigest())]
    # a text of some megabytes, and columns that clash with names used inside
    rows = [(20, 0, "user", "word " * 500_000), (21, 0, "user", "b")]
    frame = spark.createDataFrame([(*r, 1, "x", 2.0) for r in rows], ROWS + ", n long, at string, block double")
    assert sorted(map(tuple, trie.digest(frame).collect()), key=str) == brute_trie(rows)


# ---- structure repair

SOUND = re.compile("(s?(ua)+)?")


def brute_rows(rows):
    """Damaged rows of each conversation, in order."""
    out = {}
    for c, turn, role, text in rows:
        own = out.setdefault(c, [])
        role, text = " " if role is None else role, " " if text is None else text
        harm = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
        if harm == 1:
            text = ""
        elif harm == 2:
            text = re.sub("[.!?]", "", text)
        elif harm == 4:
            role = "user"
        own += [(turn, role, text)] * (0 if harm == 0 else 2 if harm == 3 else 1)
    return {c: sorted(x, key=lambda r: (r[0] is not None, r[0] or 0, md5(*r[1:]))) for c, x in out.items()}


def brute_faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        bare = text.strip(" \t\n\x0b\x0c\r")
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


def all_repairs(rows, faults, inserts):
    """Every way with up to ``inserts`` insertions in a row, that gives a sound conversation."""
    def ways(i, room):
        if room:
            for r in ("user", "assistant"):
                for cost, audit, out in ways(i, room - 1):
                    yield cost + 2, "I" + audit, [(r, ""), *out]
        if i == len(rows):
            yield 0, "", []
            return
        for cost, audit, out in ways(i + 1, inserts):
            yield cost + 3, "D" + audit, out
            if faults[i] in ("blank", "duplicate"):
                continue
            more = faults[i] == "truncated"
            yield cost + more, "K" + audit, [rows[i][1:], *out]
            for r in ("user", "assistant"):
                yield cost + 2 + more, "R" + audit, [(r, rows[i][2]), *out]

    return min((x for x in ways(0, inserts) if SOUND.fullmatch("".join(r[:1] or "?" for r, _ in x[2]))), key=lambda x: x[:2])


def folded_repairs(rows, faults):
    """The same, by going through the rows with the best of each state; for longer conversations."""
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    name = {"u": "user", "a": "assistant"}

    def relaxed(best):
        for _ in range(3):
            for q, (cost, audit, out) in list(best.items()):
                for r in "ua":
                    if (q, r) in step:
                        way = cost + 2, audit + "I", [*out, (name[r], "")]
                        best[step[q, r]] = min(best.get(step[q, r], way), way, key=lambda x: x[:2])
        return best

    best = relaxed({"": (0, "", [])})
    for (_, role, text), fault in zip(rows, faults):
        after = {}
        for q, (cost, audit, out) in best.items():
            ways = [(q, (cost + 3, audit + "D", out))]
            if fault not in ("blank", "duplicate"):
                more = fault == "truncated"
                if (q, role[:1]) in step:
                    ways.append((step[q, role[:1]], (cost + more, audit + "K", [*out, (role, text)])))
                ways += [(step[q, r], (cost + 2 + more, audit + "R", [*out, (name[r], text)])) for r in "ua" if (q, r) in step]
            for to, way in ways:
                after[to] = min(after.get(to, way), way, key=lambda x: x[:2])
        best = relaxed(after)
    return min((best[q] for q in ("", "a") if q in best), key=lambda x: x[:2])


def brute_repair(rows, solve=folded_repairs):
    out = []
    for c, own in brute_rows(rows).items():
        faults = brute_faults(own)
        turns = {t for t, _, _ in own if t is not None}
        cost, audit, kept = solve(own, faults)
        text = "\n".join(f"{r}:{t}" for r, t in kept)
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        out.append((c, max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
                    illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=str)


def broken(seed, conversations, longest):
    rng, rows = random.Random(seed), []
    for c in range(conversations):
        for i in range(rng.randrange(1, longest + 1)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None, "", "ux"])
            text = rng.choice(["a b.", "c!", "d", "", " \t", None, "e f? \n", f"long {i}.", f"{i} é"])
            rows.append((c, rng.choice([i, i, i, 2 * i, None]), role, text))
    return rows + rows[:3] + [(None, 1, "user", "no id."), (None, None, "assistant", "nor here."), (-3, 5, "user", "x.")]


def repaired_digest(spark, rows):
    return sorted(map(tuple, repair.digest(spark.createDataFrame(rows, ROWS).repartition(3)).collect()), key=str)


def test_folding_equals_every_way():
    rows = broken(11, 150, 3)
    assert brute_repair(rows) == brute_repair(rows, lambda own, faults: all_repairs(own[:4], faults[:4], 2) if len(own) < 5 else folded_repairs(own, faults))


def test_repair_equals_brute_force(spark):
    rows = broken(3, 300, 12)
    assert repaired_digest(spark, rows) == brute_repair(rows)


def test_repair_of_long_conversations_by_blocks(spark):
    """Several spans of turn numbers, a span of more rows than a block, and one turn number for all rows."""
    rng = random.Random(1)
    rows = [(1, t, rng.choice(["user", "assistant", "tool"]), f"turn {t}{rng.choice(['.', ''])}") for t in range(2500)]
    rows += [(2, None if t % 3 else t, rng.choice(["user", "assistant"]), f"turn {t}.") for t in range(2200)]
    rows += [(3, 7, rng.choice(["user", "assistant"]), f"turn {t}.") for t in range(1500)]
    rows += [(4, t, "user", "same text.") for t in range(1200)]
    assert repaired_digest(spark, rows) == brute_repair(rows)


def test_repair_cases(spark):
    assert repair.digest(spark.createDataFrame([], ROWS)).collect() == []
    gone = next(t for t in range(99) if zlib.crc32(f"5:{t}".encode()) % 20 == 0)
    rows = [(5, gone, "user", "dropped."), (6, 1, "user", "word " * 400_000 + "."), (6, 2, "assistant", "." * 10**6)]
    assert repaired_digest(spark, rows) == brute_repair(rows)
    assert (5, 0, 0, 0, 0, 0, 0, "", repair.hashlib.sha256(b"").hexdigest()) in repaired_digest(spark, rows)
    clashing = spark.createDataFrame([(*r, True, "x", 1) for r in rows], ROWS + ", gone boolean, id string, place int")
    assert sorted(map(tuple, repair.digest(clashing).collect()), key=str) == brute_repair(rows)


def test_repaired_rows_are_sound(spark):
    rows = spark.createDataFrame(broken(8, 60, 9), ROWS).na.fill({"role": " ", "text": " "})
    talks = defaultdict(list)
    for r in repair.repaired(rows).orderBy("conv_id", "turn").collect():
        talks[r.conv_id].append(r)
    for own in talks.values():
        assert [r.turn for r in own] == list(range(len(own)))
        assert SOUND.fullmatch("".join(r.role[:1] for r in own))
        assert all(r.text == "" for r in own if r.edit == "I")


# ---- SQL

def in_sql(rows, sql):
    conversations = pa.table({k: pa.array([r[i] for r in rows], pa.int64() if i < 2 else pa.string())
                              for i, k in enumerate(("conv_id", "turn", "role", "text"))})
    with duckdb.connect() as con:
        con.register("conversations", conversations)
        return sorted(con.sql(sql).fetchall(), key=str)


def test_sql_equals_brute_force():
    for rows in (broken(3, 200, 12), broken(11, 100, 3)):
        assert in_sql(rows, repair.ORACLE) == brute_repair(rows)
    assert in_sql(talks(), trie.ORACLE) == brute_trie(talks())
