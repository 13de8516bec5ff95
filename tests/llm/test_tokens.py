"""Token counts by offsets, pieces, and the pipeline."""

import random
import sys

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from larder.llm import pieces, tokens

from .helpers import awkward, frame

TEXTS = ["", " ", "\n", "a\n\nb\n", "plain words here", "  two  spaces \n\n\n end", "é中\U0001F600 x\ny", "don't\nstop", "x" * 3000 + "\n" + "y z " * 50, "\r\n\ttabs\r\n"]


@pytest.fixture(scope="module")
def table():
    return tokens.ranks()


def offsets(text, table):
    """Spans of tokens by decoding each on its own."""
    encode, _ = tokens.encoder(table)
    raw, out, at = text.encode(), [], 0
    for t in encode.encode_ordinary(text):
        n = len(encode.decode_single_token_bytes(t))
        first, last = at, at + n - 1
        char = lambda b: sum((x & 0xC0) != 0x80 for x in raw[:b + 1]) - 1
        out.append((char(first), char(last) + 1))
        at += n
    assert at == len(raw)
    return out


@pytest.mark.parametrize("text", TEXTS[2:])
def test_spans(table, text):
    start, end = tokens.token_spans(text, table)
    assert list(zip(start.tolist(), end.tolist())) == offsets(text, table)


@pytest.mark.parametrize("rule", ["most", "first", "split"])
def test_attribution_equals_brute_force(rule):
    rng = random.Random(2)
    for _ in range(200):
        cuts = sorted(rng.sample(range(60), rng.randint(2, 12)))
        spans = list(zip(cuts[::2], cuts[1::2])) if rng.random() < 0.5 else list(zip(cuts, cuts[1:]))
        marks = sorted({0, 60, *rng.sample(range(60), 15)})
        own = list(zip(marks, marks[1:]))
        want = [0.0] * len(spans)
        for s, e in own:
            shared = [max(0, min(e, b) - max(s, a)) for a, b in spans]
            if rule == "split":
                want = [w + x / (e - s) for w, x in zip(want, shared)]
            elif rule == "first":
                for i, (a, b) in enumerate(spans):
                    want[i] += a <= s < b
            elif max(shared) > 0:
                want[shared.index(max(shared))] += 1
        a, b = map(np.array, zip(*own))
        f, g = map(np.array, zip(*spans))
        assert np.allclose(tokens.attribute(a, b, f, g, rule), want)


def test_line_counts(spark, table):
    rows = [(600 + i, t, "en", "s") for i, t in enumerate(TEXTS)] + awkward() + [(604, TEXTS[4], "en", "s")]
    got = tokens.digest(frame(spark, rows).withColumn("section", F.lit("x"))).collect()
    per, lines = {}, {}
    for r in got:
        per[r.doc_id] = per.get(r.doc_id, 0) + r.n_tokens
        lines.setdefault(r.doc_id, []).append(r)
    encode, _ = tokens.encoder(table)
    for i, t, *_ in rows:
        if i in (7, 604) or i is None:
            continue
        text = t or ""
        assert per[i] == len(encode.encode_ordinary(text))
        own = sorted(lines[i], key=lambda r: r.section)
        assert [r.section for r in own] == list(range(len(own)))
        assert "".join(text[r.start:r.end] for r in own) == text
        assert all("\n" not in text[r.start:r.end - 1] for r in own)
    assert tokens.digest(frame(spark, [])).collect() == []


def test_given_sections(spark, table):
    docs = frame(spark, [(1, "one two three four", "en", "s"), (2, "five", "en", "s"), (3, None, "en", "s")])
    sections = spark.createDataFrame([(1, "b", 7, 18), (1, "a", 0, 5), (3, "c", 0, 0), (9, "d", 0, 4)], "doc_id long, section string, start long, end long")
    got = {(r.doc_id, r.section): r.n_tokens for r in tokens.section_counts(docs, sections).collect()}
    assert got == {(1, "a"): 2, (1, "b"): 2, (3, "c"): 0}
    part = {(r.doc_id, r.section): r.n_tokens for r in tokens.section_counts(docs, sections, rule="split").collect()}
    assert part[1, "a"] == 1.5 and part[1, "b"] == 2.0


# ---- pieces

@pytest.fixture(scope="module")
def model():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)


@pytest.fixture(scope="module")
def ours():
    return pieces.Pieces()


def ids_of(p, texts, cache=None):
    ids, n = p.encode(pa.array(texts, pa.string()), {} if cache is None else cache)
    ends = np.cumsum(n)
    return [ids[a:b].tolist() for a, b in zip(ends - n, ends)]


def strange():
    rng = random.Random(6)
    alphabet = "abc deé中\U0001F600\n\t  ▁ß9-.'" + "the ing on "
    out = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(400)]
    return out + TEXTS + [" " * k + x for k in range(20) for x in ("", "a", "中", "\U0001F600")] + ["a" * 500, "日本語 テキスト", "the the  the"]


def test_ids_equal_the_library(ours, model):
    texts = strange()
    assert ids_of(ours, texts) == model.encode(texts)
    cache = {}
    assert ids_of(ours, texts[:200], cache) + ids_of(ours, texts[100:], cache) == model.encode(texts[:200]) + model.encode(texts[100:])


def test_round_trip(ours, model):
    texts = strange()
    ids, n = ours.encode(pa.array(texts), {})
    assert ours.decode(ids, n).to_pylist() == [t.replace("▁", " ") for t in texts]
    lists = model.encode([t for t in texts if t])
    flat, sizes = np.concatenate([np.array(x, np.int64) for x in lists]), np.array(list(map(len, lists)))
    assert ours.decode(flat, sizes).to_pylist() == model.decode(lists)
    bad = ours.byte_id[np.array([0xE2, 0x41])]
    assert ours.decode(np.asarray(bad, np.int64), np.array([2])).to_pylist() == ["�A"]


def test_unigram_reading_has_the_greatest_score(ours):
    uni = pieces.Pieces(kind="unigram")
    score = dict(zip(uni.id.tolist(), uni.score.tolist()))
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    value = {model.id_to_piece(i): s for i, s in score.items()}
    for word in ["therefore", "xylophone", "a", "Handlung", "zzzz", "été"]:
        s = "▁" + word
        best = [0.0] + [-np.inf] * len(s)
        for e in range(1, len(s) + 1):
            best[e] = max(best[b] + value.get(s[b:e], uni.unknown_score if e - b == 1 else -np.inf) for b in range(e))
        assert sum(score[i] for i in ids_of(uni, [word])[0]) == best[-1]


def test_pieces_of_rows(spark, model):
    rows = awkward() + [(400 + i, t, "en", "s") for i, t in enumerate(strange()[:50])]
    df = frame(spark, rows).withColumn("ids", F.lit("own")).withColumn("n_tokens", F.lit(1))
    out = pieces.digest(df.repartition(4)).collect()
    assert len(out) == len(rows) and all(r.round_trip for r in out)
    want = {r[0]: model.encode(r[1] or "") for r in rows if r[0] is not None}
    assert all(r.ids == want[r.doc_id] and r.n_tokens == len(r.ids) for r in out if r.doc_id is not None)
    assert pieces.digest(frame(spark, [])).collect() == []


@pytest.mark.parametrize("kind", ["spaces", "one word", "words", "marks"])
def test_five_megabytes(spark, kind):
    """Long texts take time in proportion to their length, and get the libraries' ids."""
    import sentencepiece

    text = {"spaces": " " * 5_000_000, "one word": "x" * 200_000, "words": "many words " * 450_000, "marks": "!" * 100_000 + " \n" * 1_000_000}[kind]
    rows = [(1, text, "en", "s"), (2, f"a{text}b", "en", "s"), (3, "short", "en", "s")]
    model = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    for r in pieces.encoded(frame(spark, rows)).collect():
        if kind != "spaces" or r.doc_id == 3:  # on these the library itself takes minutes
            assert r.ids == model.encode(r.text)
        else:
            assert len(r.ids) == pytest.approx(5_000_000 / 16, abs=20)
    total = {}
    for r in tokens.digest(frame(spark, rows)).collect():
        total[r.doc_id] = total.get(r.doc_id, 0) + r.n_tokens
    assert total[3] == 1 and total[1] > 500 and abs(total[2] - total[1]) < 5


def test_runs_of_white_space(table, model):
    """As the libraries encode them, wherever the runs stand."""
    encode, _ = tokens.encoder(table)
    for n in [*range(1, 70), 100, 999, 1000, 1001, 2500, 20_000]:
        for run in (" " * n, "\n" * n, (" \t\n" * n)[:n], ("\u3000 " * n)[:n], ("\x1c" * n)):
            for text in (run, f"a{run}", f"{run}b", f"a{run}b. {run}!"):
                assert tokens.encoded(text, encode) == encode.encode_ordinary(text)
    own = pieces.Pieces()
    for n in [*range(1, 200), 255, 256, 257, 1000, 1023]:
        texts = [" " * n, "a" + " " * n, " " * n + "b", "a" + " " * n + "b"]
        ids, numbers = own.encode(pa.array(texts), {})
        ends = np.cumsum(numbers)
        assert [ids[e - k:e].tolist() for e, k in zip(ends, numbers)] == [model.encode(t) for t in texts]


# ---- pipeline

def test_pipeline_stages(spark, scratch):
    import corpus_pipeline as c

    from .test_dups import brute
    from .test_native import brute as secrets_of

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, seen = docs.columns, {}
    for i, (name, stage) in enumerate(c.STAGES):
        stage(spark, docs, sf).write.parquet(f"{scratch}/{i}")
        docs = spark.read.parquet(f"{scratch}/{i}")
        seen[name] = docs.collect()
        if i < len(c.STAGES) - 1:
            assert docs.columns == columns
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    first = {r.doc_id for r in seen["quality"]}
    assert np.mean([(i in first) == bool(q) for i, q in labels.items()]) > 0.95
    groups = brute([(r.doc_id, r.text) for r in seen["quality"]], *c.NEAR)
    assert sorted(r.doc_id for r in seen["near_duplicates"]) == sorted({comp for _, comp in groups.values()})
    assert len(seen["secrets"]) == len(seen["near_duplicates"]) and not any(secrets_of(r.text) for r in seen["secrets"])
    whole = {r.doc_id: r.text for r in seen["secrets"]}
    assert all(whole[r.doc_id].startswith(r.text) for r in seen["mix"])
    assert sum(len(r.text.split()) for r in seen["mix"]) == pytest.approx(1.5 * sum(len(t.split()) for t in whole.values()), rel=0.02)
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    assert all(r.ids == model.encode(r.text) for r in seen["pieces"][:50])


def test_pipeline_cases(spark, scratch):
    """Nulls in any column, empty and long texts, ties, repeated rows and clashing names, and empty tables."""
    import corpus_pipeline as c

    labels = "doc_id long, quality int, toxic int"
    rows = [(i, f"{'plain words that make a sound text. ' * (2 + i % 3)}Number {i} of them.", "en", f"s{i % 3}") for i in range(60)]
    rows = [r for r in awkward() if r[0] != 106] + [(200 + i, *r[1:]) for i, r in enumerate(rows)]
    clash = ("__score", "__row", "__id", "__rows", "size", "pieces", "h", "rows", "found", "base", "text2", "key", "block")
    docs = frame(spark, rows).select("*", *[F.lit(i).alias(n) for i, n in enumerate(clash)])
    for case, table, known in (("some", docs, [(r[0], i % 2, None) for i, r in enumerate(rows) if r[0] is not None]), ("none", docs.limit(0), []), ("unlabelled", docs, [])):
        sf = f"{scratch}/{case}"
        spark.createDataFrame(known, labels).write.parquet(f"{sf}/labels.parquet")
        table.write.parquet(f"{sf}/documents.parquet")
        out = c.run(spark, sf)
        assert out.columns == [*docs.columns, "ids", "n_tokens"]
        got = out.collect()
        assert all(r.n_tokens == len(r.ids) > 0 and [r[n] for n in clash] == list(range(len(clash))) for r in got)
        assert not got if case == "none" else {r.doc_id for r in got} <= {r[0] for r in rows}
        assert case == "none" or len({r.doc_id for r in got}) > 5


def test_entry_has_them_all():
    import __spark_entry__ as e

    names = e.queries()
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 14)) and "pipeline" in names
    assert "larder.llm" in sys.modules
