"""Homomorphic fingerprints against brute force, and their cases."""

import hashlib
import random
import re
import struct

import pytest
import xxhash
from pyspark.sql import functions as F

from larder.llm import multiset

from .helpers import awkward, frame

BREAK = re.compile(r"[\n\r]+|(?<=[.!?])[ \t]+")


def parts_of(text):
    return [p for p in BREAK.split(text) if p]


def hashed(k, part):
    seed = xxhash.xxh64(struct.pack("<i", k), seed=42).intdigest()
    return xxhash.xxh64(part.encode(), seed=seed).intdigest()


def brute_vector(text):
    """(n, lanes, sums) of a text's paragraphs."""
    lanes, sums = [[0] * 64 for _ in range(2)], [[0, 0] for _ in range(4)]
    parts = parts_of(text)
    for p in parts:
        for k in range(4):
            h = hashed(k, p)
            sums[k][0] += h & (2**32 - 1)
            sums[k][1] += h >> 32
            if k < 2:
                lanes[k] = [c + (h >> i & 1) for i, c in enumerate(lanes[k])]
    return len(parts), [*lanes[0][:32], *lanes[1][:32], *lanes[0][32:], *lanes[1][32:]], [x % 2**32 for s in sums for x in s]


def brute_fingerprint(text):
    n, lanes, sums = brute_vector(text)
    return "".join(f"{x % 2**32:08x}" for x in [n, *sums]) + "".join(f"{x % 2**16:04x}" for x in lanes)


def brute_likeness(a, b):
    (n, x, _), (m, y, _) = brute_vector(a), brute_vector(b)
    apart = sum((2 * (c - d) - (n - m)) ** 2 for c, d in zip(x, y))
    both = sum((2 * c - n) ** 2 for c in x) + sum((2 * d - m) ** 2 for d in y)
    return (1.0 if apart == 0 else 0.0) if both == 0 else max(0.0, min(1.0, 1 - apart / both))


def text_hash(text):
    return struct.unpack("<q", struct.pack("<Q", xxhash.xxh64(text.encode(), seed=42).intdigest()))[0]


def brute(rows):
    docs = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0), text_hash(r[1])))
    out = []
    for at, (i, text) in enumerate(docs):
        after, half = docs[(at + 1) % len(docs)][1], len(text) // 2
        edited = text[:len(text) - half] + after[:half]
        out.append((i, len(text), hashlib.sha256(edited.encode()).hexdigest(), brute_fingerprint(text), brute_fingerprint(edited),
                    round(brute_likeness(text, edited), 9), round(brute_likeness(text, after), 9)))
    return sorted(out, key=str)


def digested(df):
    out = multiset.digest(df)
    assert not re.search("Python|Pandas|Arrow", out._jdf.queryExecution().executedPlan().toString())
    return sorted(((*r[:5], round(r[5], 9), round(r[6], 9)) for r in out.collect()), key=str)


def test_fingerprints_equal_brute_force(spark):
    rows = awkward()
    assert digested(frame(spark, rows).repartition(5)) == brute([r[:2] for r in rows])


def test_cut_anywhere(spark):
    """Cuts within runs of separators, at sentence ends, and in texts of a paragraph or none."""
    rng = random.Random(4)
    rows = [(i, "".join(rng.choice(["a", "b. ", ".", " ", "\n", "\n\n", "! ", "é", "\U0001F600", "\r\n"]) for _ in range(rng.randrange(30))), None, None)
            for i in range(400)]
    assert digested(frame(spark, rows).repartition(7)) == brute([r[:2] for r in rows])


@pytest.mark.parametrize("rows", [[], [(1, "alone. Really", None, None)], [(1, None, None, None), (None, "x", None, None)], [(3, "same", None, None)] * 5])
def test_few_rows(spark, rows):
    assert digested(frame(spark, rows)) == brute([r[:2] for r in rows])


def test_very_long_texts(spark):
    rows = [(1, "word " * 1_000_000, None, None), (2, " " * 5_000_000, None, None), (3, "x" * 5_000_000, None, None), (4, "One sentence. " * 60_000, None, None)]
    got = {r.doc_id: r for r in multiset.digest(frame(spark, rows)).collect()}
    assert [got[i].n_chars for i in (1, 2, 3, 4)] == [5_000_000, 5_000_000, 5_000_000, 840_000]
    assert got[4].fingerprint[:8] == f"{60_000:08x}"
    assert got[3].edited_sha256 == hashlib.sha256(("x" * 2_500_000 + " " * 2_500_000).encode()).hexdigest()


def test_order_insertion_and_deletion(spark):
    rows = [(["one.", "two", "three", "three"], ["four!", "one."])]
    df = spark.createDataFrame(rows, "a array<string>, b array<string>").repartition(1)
    whole = multiset.vector(F.concat("a", "b"))
    got = df.select(multiset.fingerprint(whole).alias("whole"),
                    multiset.fingerprint(multiset.vector(F.concat("b", "a"))).alias("turned"),
                    multiset.fingerprint(multiset.inserted(multiset.vector(F.col("a")), F.col("b"))).alias("inserted"),
                    multiset.fingerprint(multiset.deleted(whole, F.col("b"))).alias("deleted"),
                    multiset.fingerprint(multiset.vector(F.col("a"))).alias("a")).first()
    assert got.whole == got.turned == got.inserted and got.deleted == got.a != got.whole
    assert got.whole == brute_fingerprint("three\ntwo\none.\nfour!\none.\nthree")


def test_equal_ids_and_clashing_columns(spark):
    rows = [(i % 3, f"text {i}. And more {i % 5}") for i in range(50)]
    df = spark.createDataFrame([(*r, 1, "k", True, 2) for r in rows], "doc_id long, text string, key int, next string, lent boolean, range int")
    assert digested(df.repartition(4)) == brute(rows)
