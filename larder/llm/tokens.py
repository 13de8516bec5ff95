"""Token counts of fields or sections, attributed by character offsets.

A document is encoded once, as a whole, so no token differs from the document's
own.  Byte lengths of the tokens give their spans of characters (a token that
holds part of a character's bytes touches that character).  Token spans are then
joined to the section spans by position.  Sections are disjoint and in order.

A token that crosses a boundary goes to the section with most of its characters,
the earlier one if there are several (``rule="most"``), to the section of its
first character (``"first"``), or to each in proportion (``"split"``, in which case
counts are fractions).  Tokens outside all sections aren't counted.

The query's sections are lines, each with its line feed, so that every token has
a section and a document's counts add up to its tokens.

The vocabulary is a file of ranks (a parameter); it is read once by the driver, and
its tokens, a fixed number, are broadcast.

The tokenizer's pattern goes back over a run of white space, which overflows its stack
on a long one.  Runs of ``LONG_RUN`` or more are cut out as the pattern would cut them: all
but the last character if something follows, else all, are one piece.

Cases: a null or empty text has one empty section, with 0 tokens; repeated rows
get equal rows; an empty table gives none; texts may have any length, also without
any space or of spaces only.  Columns that are not read may have any name.
"""

from __future__ import annotations

import base64
import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pattern that belongs to the ranks.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
RULE = "most"

LONG_RUN = 1000
# Fixed value: what the tokenizer's pattern calls white space.
RUN = re.compile(f"[\\t\\n\\x0b\\x0c\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]{{{LONG_RUN},}}")

_encoders: dict[str, tuple] = {}


def ranks(path: str = RANKS) -> tuple[str, dict[bytes, int]]:
    """A digest of the file, by which workers know the tokenizer, and its tokens' ranks."""
    with open(path, "rb") as f:
        data = f.read()
    return hashlib.sha256(data).hexdigest(), {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}


def encoder(table: tuple[str, dict[bytes, int]]) -> tuple:
    """The tokenizer and its tokens' byte lengths; made once per worker."""
    name, found = table
    if name not in _encoders:
        import tiktoken

        lengths = np.zeros(max(found.values()) + 1, np.int64)
        for token, rank in found.items():
            lengths[rank] = len(token)
        _encoders[name] = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=found, special_tokens={}), lengths
    return _encoders[name]


def encoded(text: str, encode) -> list[int]:
    """Ids of a text, with its long runs of white space cut out first."""
    ids, at = [], 0
    for run in RUN.finditer(text):
        first, last = run.start(), run.end() - (run.end() < len(text))
        ids += encode.encode_ordinary(text[at:first])
        ids += encode._encode_single_piece(text[first:last])
        at = last
    return ids + encode.encode_ordinary(text[at:])


def token_spans(text: str, table: tuple[str, dict[bytes, int]]) -> tuple[np.ndarray, np.ndarray]:
    """First character and end of each token."""
    encode, lengths = encoder(table)
    ids = np.asarray(encoded(text, encode), np.int64)
    ends = np.cumsum(lengths[ids])
    # the character of each byte
    char = np.cumsum((np.frombuffer(text.encode("utf-8"), np.uint8) & 0xC0) != 0x80) - 1
    return char[ends - lengths[ids]], char[ends - 1] + 1


def line_spans(text: str) -> tuple[np.ndarray, np.ndarray]:
    codes = np.frombuffer(text.encode("utf-32-le"), "<u4")
    ends = np.flatnonzero(codes == 0x0A) + 1
    if not len(ends) or ends[-1] < len(codes):
        ends = np.append(ends, len(codes))
    return np.concatenate([[0], ends[:-1]]), ends


def attribute(start: np.ndarray, end: np.ndarray, first: np.ndarray, last: np.ndarray, rule: str = RULE) -> np.ndarray:
    """Tokens [start, end) per section [first, last)."""
    if not len(first):
        return np.zeros(0)
    lo, hi = np.searchsorted(last, start, "right"), np.searchsorted(first, end, "left")
    n = np.maximum(hi - lo, 0)
    if rule == "first":
        inside = (n > 0) & (first[np.minimum(lo, len(first) - 1)] <= start)
        return np.bincount(lo[inside], minlength=len(first)).astype(float)
    one = n == 1
    out = np.zeros(len(first))
    if rule != "split":
        out += np.bincount(lo[one], minlength=len(first))
        many = np.flatnonzero(n > 1)
    else:
        many = np.flatnonzero(n > 0)
    if len(many):
        token = np.repeat(many, n[many])
        place = np.cumsum(n[many]) - n[many]
        section = np.arange(len(token)) - np.repeat(place, n[many]) + np.repeat(lo[many], n[many])
        shared = np.minimum(end[token], last[section]) - np.maximum(start[token], first[section])
        if rule == "split":
            out += np.bincount(section, weights=shared / (end - start)[token], minlength=len(first))
        else:
            best = np.lexsort((section, -shared, token))
            out += np.bincount(section[best[place]], minlength=len(first))
    return out


def counts(text: Column, spark: SparkSession, sections: Column | None = None, path: str = RANKS, rule: str = RULE) -> Column:
    """Array of struct(start, end, n_tokens), one per section.

    ``sections``: a column of disjoint, sorted array<struct<start, end>> spans of
    characters; without it, the lines of the text.
    """
    shared = spark.sparkContext.broadcast(ranks(path))
    kind = "double" if rule == "split" else "bigint"

    def of(texts: pa.Array, spans) -> pa.Array:
        sizes, starts, ends, totals = [], [], [], []
        for i, text in enumerate(texts):
            text = text.as_py() or ""
            if spans is None:
                first, last = line_spans(text)
            else:
                own = spans[i].as_py() or []
                first, last = np.array([s["start"] for s in own], np.int64), np.array([s["end"] for s in own], np.int64)
            n = attribute(*token_spans(text, shared.value), first, last, rule) if text else np.zeros(len(first))
            sizes.append(len(first))
            starts.append(first)
            ends.append(last)
            totals.append(n)
        flat = lambda x, t: np.concatenate([np.zeros(0), *x]).astype(t)
        rows = pa.StructArray.from_arrays([pa.array(flat(starts, np.int64)), pa.array(flat(ends, np.int64)),
                                           pa.array(flat(totals, float if rule == "split" else np.int64))], ["start", "end", "n_tokens"])
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), rows)

    made = f"array<struct<start:bigint,end:bigint,n_tokens:{kind}>>"
    if sections is None:
        @F.arrow_udf(made)
        def lines(texts: pa.Array) -> pa.Array:
            return of(texts, None)

        return lines(text)

    @F.arrow_udf(made)
    def given(texts: pa.Array, spans: pa.Array) -> pa.Array:
        return of(texts, spans)

    return given(text, sections)


def section_counts(docs: DataFrame, sections: DataFrame, path: str = RANKS, rule: str = RULE) -> DataFrame:
    """(doc_id, section, start, end, n_tokens) for a table ``sections`` of (doc_id, section, start, end).

    A document's sections are gathered beside its text, so the join is one per
    document, not one per token.
    """
    own = sections.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start", "end", "section"))).alias("__own"))
    rows = docs.select("doc_id", "text").join(own, "doc_id")
    spans = F.transform("__own", lambda s: F.struct(s["start"].cast("long").alias("start"), s["end"].cast("long").alias("end")))
    rows = rows.withColumn("__n", counts(F.col("text"), docs.sparkSession, spans, path, rule))
    rows = rows.select("doc_id", F.explode(F.arrays_zip("__own", "__n")).alias("s"))
    return rows.select("doc_id", F.col("s.__own.section").alias("section"), F.col("s.__own.start").alias("start"),
                       F.col("s.__own.end").alias("end"), F.col("s.__n.n_tokens").alias("n_tokens"))


def digest(docs: DataFrame, path: str = RANKS) -> DataFrame:
    """Tokens of each line of each document: doc_id, section (from 0), start, end, n_tokens."""
    rows = docs.select("doc_id", counts(F.col("text"), docs.sparkSession, path=path).alias("lines"))
    rows = rows.select("doc_id", F.posexplode("lines").alias("section", "line"))
    return rows.select("doc_id", "section", "line.start", "line.end", "line.n_tokens")
