"""Fixtures of the operators' tests: awkward documents, and words as the contracts define them."""

import re

from pyspark.sql import types as T

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                     T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                     T.StructField("n_chars", T.LongType())])


def frame(spark, rows):
    """Documents from (doc_id, text, lang, source) rows."""
    return spark.createDataFrame([(*r, None if r[1] is None else len(r[1])) for r in rows], DOCS)


def awkward():
    """Nulls in every column, empty and wordless texts, a very long one, ties and repeated rows."""
    base = "the quick brown fox jumps over the lazy dog and runs away from all the other animals here "
    rows = [(i, f"{base}number {i} " * (1 + i % 4), "en", f"s{i % 3}") for i in range(30)]
    rows += [(100, None, "en", "s0"), (101, "", "en", "s0"), (102, " \t\n", None, "s1"), (None, "no id at all", "en", "s1"),
             (103, "no source here", "en", None), (104, "wörter mit ümlaut \U0001F600 und mehr", "de", "é"),
             (105, "long " * 30000, "en", "s2"), (106, "x" * 100000, "en", "s2"), (7, f"{base}number 7 " * 4, "en", "s1"),
             (7, f"{base}number 7 " * 4, "en", "s1"), (107, "one", "en", "s0"), (108, None, None, None)]
    return rows
