"""Quality classifier: a factorisation machine over whole texts.

Features are the distinct words of a text, hashed into ``2**WORD_BITS`` slots
and weighted by damped counts, structure statistics in steps (lengths, shares of
character classes, repeated words and lines) and metadata (the stated number of
characters and how it agrees with the text).  A score is

    sigmoid(w0 + sum w_i x_i + 1/2 sum_f [(sum v_if x_i)^2 - sum v_if^2 x_i^2])

so the pairwise part takes time linear in the number of features.  Label, lang,
source and id are no features.

The machine is fitted on at most about ``FIT_ROWS`` labelled rows (picked by a hash
of the id), in one task that gets their features; the model's size is fixed.
Documents are scored inside an Arrow UDF that sees the text and ``n_chars``.

Cases: null and empty texts have no words and get the score of their structure
features; a null or absent ``n_chars`` is a feature of its own; null labels are
left out and a document's label is the majority of its rows in ``labels``; repeated
rows get equal scores; without labels every score is 0.5, which counts as kept;
an empty table gives an empty result.  Columns that are not read may have any name.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.llm.common import held_out, learning_rows
from larder.llm.textvec import Words, chunks, sums

WORD_BITS = 16
FACTORS = 6
FIT_ROWS = 6000
STEPS = 70
RATE, WORD_DECAY, FACTOR_DECAY = 0.05, 2e-4, 1e-3
SEED = 11
#: Steps of each structure statistic; a statistic in (edge i-1, edge i] has step i.
EDGES = {
    "words": [0, 5, 10, 20, 40, 80, 160, 320, 640, 1280, 2560, 5120],
    "word_length": [0, 2, 3, 4, 4.5, 5, 5.5, 6, 7, 8, 10, 14, 20],
    "distinct": [0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.97],
    "repeats": [0, 0.005, 0.01, 0.02, 0.05, 0.1, 0.2, 0.4, 0.7],
    "lines": [0, 0.002, 0.005, 0.01, 0.02, 0.05, 0.1, 0.2, 0.5],
    "same_lines": [0, 0.02, 0.05, 0.1, 0.2, 0.4, 0.6, 0.8],
    "upper": [0, 0.005, 0.01, 0.02, 0.04, 0.08, 0.2, 0.5, 0.8],
    "digits": [0, 0.002, 0.005, 0.01, 0.02, 0.05, 0.1, 0.3],
    "stops": [0, 0.005, 0.01, 0.02, 0.03, 0.05, 0.1],
    "marks": [0, 0.001, 0.002, 0.005, 0.01, 0.02, 0.05, 0.1, 0.2, 0.4],
    "top_word": [0.01, 0.02, 0.04, 0.06, 0.1, 0.2, 0.4, 0.7],
    "stated": [-1, 0, 100, 300, 1000, 3000, 10000, 30000],
    "agrees": [-1, 0],
}
STEP_COUNT = 16
FEATURES = (1 << WORD_BITS) + STEP_COUNT * len(EDGES)
STATISTIC_WEIGHT = 0.35


def _classes() -> np.ndarray:
    """Per byte: 1 upper case, 2 digit, 3 full stop or comma, 4 other mark, else 0."""
    kind = np.zeros(256, np.uint8)
    kind[ord("A"):ord("Z") + 1] = 1
    kind[ord("0"):ord("9") + 1] = 2
    for c in range(33, 127):
        if not chr(c).isalnum():
            kind[c] = 3 if chr(c) in ".," else 4
    return kind


CLASSES = _classes()


def _line_repeats(data: np.ndarray, offsets: np.ndarray, words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Per text: lines that hold words, and the share of them that equal another one of the text."""
    if not len(words.start):
        return np.zeros(n), np.zeros(n)
    breaks = np.concatenate([[0], np.cumsum(data == 0x0A)])
    line = breaks[words.start]
    new = np.ones(len(line), bool)
    new[1:] = (line[1:] != line[:-1]) | (words.doc[1:] != words.doc[:-1])
    first = np.flatnonzero(new)
    place = np.arange(len(line)) - first[np.cumsum(new) - 1]
    value = np.add.reduceat(words.hash * (2 * place.astype(np.uint64) + np.uint64(1)), first)
    doc = words.doc[first]
    order = np.lexsort((value, doc))
    v, d = value[order], doc[order]
    same = np.zeros(len(v), bool)
    same[1:] = (v[1:] == v[:-1]) & (d[1:] == d[:-1])
    lines = np.bincount(doc, minlength=n)
    return lines, sums(same, d, n) / np.maximum(lines, 1)


def features(texts: pa.Array, stated: np.ndarray):
    """Per chunk of rows: (first row, number of rows, row, feature and value of each entry); ``stated`` is NaN where unknown."""
    for first, data, offsets in chunks(texts):
        n = len(offsets) - 1
        words = Words(data, offsets)
        key = np.sort((words.doc.astype(np.uint64) << np.uint64(32)) | (words.hash >> np.uint64(64 - WORD_BITS)))
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        at = np.flatnonzero(new)
        times = np.diff(np.append(at, len(key)))
        doc = (key[at] >> np.uint64(32)).astype(np.int64)
        slot = (key[at] & np.uint64((1 << WORD_BITS) - 1)).astype(np.int64)
        weight = 1 + np.log(times)
        norm = np.sqrt(sums(weight**2, doc, n))
        weight = weight / np.maximum(norm[doc], 1e-9)
        size = np.diff(offsets)
        chars = sums((data & 0xC0) != 0x80, np.repeat(np.arange(n), size), n)
        kinds = np.zeros((5, n))
        owner = np.repeat(np.arange(n), size)
        np.add.at(kinds, (CLASSES[data], owner), 1)
        count, each = np.maximum(words.count, 1), np.maximum(chars, 1)
        again = np.zeros(len(words.hash), bool)
        again[1:] = (words.hash[1:] == words.hash[:-1]) & (words.doc[1:] == words.doc[:-1])
        top = np.zeros(n)
        np.maximum.at(top, doc, times)
        lines, same = _line_repeats(data, offsets, words, n)
        claim = stated[first:first + n]
        known = ~np.isnan(claim)
        values = {
            "words": words.count, "word_length": sums(words.end - words.start, words.doc, n) / count, "distinct": np.bincount(doc, minlength=n) / count,
            "repeats": sums(again, words.doc, n) / count, "lines": lines / each * 10, "same_lines": same, "upper": kinds[1] / each, "digits": kinds[2] / each,
            "stops": kinds[3] / each, "marks": kinds[4] / each, "top_word": top / count, "stated": np.where(known, claim, -1),
            "agrees": np.where(known, (claim == chars) * 1.0, -1),
        }
        steps = [np.searchsorted(EDGES[k], v) + (1 << WORD_BITS) + STEP_COUNT * i for i, (k, v) in enumerate(values.items())]
        rows = np.concatenate([doc, *[np.arange(n)] * len(steps)])
        yield (first, n, rows, np.concatenate([slot, *steps]),
               np.concatenate([weight, np.full(n * len(steps), STATISTIC_WEIGHT)]).astype(np.float32))


class Machine:
    """w0, w (features) and v (features x factors)."""

    def __init__(self, w0: float, w: np.ndarray, v: np.ndarray):
        self.w0, self.w, self.v = w0, w, v

    def raw(self, n: int, row: np.ndarray, feature: np.ndarray, value: np.ndarray) -> np.ndarray:
        total = sums(self.w[feature] * value, row, n) + self.w0
        for f in range(self.v.shape[1]):
            part = self.v[feature, f] * value
            total += 0.5 * (sums(part, row, n) ** 2 - sums(part**2, row, n))
        return total

    def score(self, texts: pa.Array, stated: np.ndarray) -> np.ndarray:
        out = np.full(len(texts), 0.5)
        for first, n, row, feature, value in features(texts, stated):
            out[first:first + n] = 1 / (1 + np.exp(-np.clip(self.raw(n, row, feature, value), -30, 30)))
        return out


def fit(label: np.ndarray, row: np.ndarray, feature: np.ndarray, value: np.ndarray) -> Machine:
    """Full-batch Adam on the logistic loss, both labels weighing alike up to a factor of four."""
    n = len(label)
    if not n:
        return Machine(0.0, np.zeros(FEATURES, np.float32), np.zeros((FEATURES, FACTORS), np.float32))
    used, feature = np.unique(feature, return_inverse=True)
    by = np.argsort(feature, kind="stable")
    first = np.searchsorted(feature[by], np.arange(len(used)))
    row_by, value_by = row[by], value[by]
    share = np.clip(label.mean(), 0.2, 0.8)
    weight = np.where(label == 1, 0.5 / share, 0.5 / (1 - share)) / n
    rng = np.random.default_rng(SEED)
    m = Machine(0.0, np.zeros(len(used)), rng.normal(0, 0.03, (len(used), FACTORS)))
    decay = np.concatenate([[0.0], np.full(len(used), WORD_DECAY), np.full(len(used) * FACTORS, FACTOR_DECAY)])
    p = np.concatenate([[m.w0], m.w, m.v.ravel()])
    mean, square = np.zeros_like(p), np.zeros_like(p)
    for t in range(1, STEPS + 1):
        m.w0, m.w, m.v = p[0], p[1:1 + len(used)], p[1 + len(used):].reshape(len(used), FACTORS)
        total = sums(m.w[feature] * value, row, n) + m.w0
        inner = []
        for f in range(FACTORS):
            part = m.v[feature, f] * value
            inner.append(sums(part, row, n))
            total += 0.5 * (inner[-1] ** 2 - sums(part**2, row, n))
        loss = (1 / (1 + np.exp(-np.clip(total, -30, 30))) - label) * weight
        pull = loss[row_by] * value_by
        g = np.empty_like(p)
        g[0] = loss.sum()
        g[1:1 + len(used)] = np.add.reduceat(pull, first)
        gv = g[1 + len(used):].reshape(len(used), FACTORS)
        own = np.add.reduceat(pull * value_by, first)
        for f in range(FACTORS):
            gv[:, f] = np.add.reduceat(pull * inner[f][row_by], first) - m.v[:, f] * own
        g += decay * p / n * 100
        mean = 0.9 * mean + 0.1 * g
        square = 0.99 * square + 0.01 * g * g
        p = p - RATE * (mean / (1 - 0.9**t)) / (np.sqrt(square / (1 - 0.99**t)) + 1e-9)
    w, v = np.zeros(FEATURES, np.float32), np.zeros((FEATURES, FACTORS), np.float32)
    w[used], v[used] = p[1:1 + len(used)], p[1 + len(used):].reshape(len(used), FACTORS)
    return Machine(float(p[0]), w, v)


def _stated(values) -> np.ndarray:
    return np.asarray(values.to_numpy(zero_copy_only=False), np.float64)


def _entries(batches):
    """Arrow batches of (text, stated, label) to rows of (label, feature array, value array)."""
    for b in batches:
        stated = _stated(b.column("stated"))
        for first, n, row, feature, value in features(b.column("text"), stated):
            order = np.argsort(row, kind="stable")
            cut = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=n))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([
                b.column("label").slice(first, n),
                pa.ListArray.from_arrays(pa.array(cut), pa.array(feature[order].astype(np.int32))),
                pa.ListArray.from_arrays(pa.array(cut), pa.array(value[order]))], ["label", "feature", "value"])


def _fitted(frames):
    parts = list(frames)
    pdf = pd.concat(parts) if parts else pd.DataFrame({"label": [], "feature": [], "value": []})
    sizes = np.array([len(x) for x in pdf["feature"]], np.int64)
    flat = lambda c, kind: np.concatenate([np.zeros(0, kind), *pdf[c].to_list()]).astype(kind)
    # the order of rows depends on the tasks before; sums of floats shouldn't
    row = np.repeat(np.arange(len(pdf)), sizes)
    m = fit(pdf["label"].to_numpy(np.float64), row, flat("feature", np.int64), flat("value", np.float64))
    yield pd.DataFrame({"w0": [m.w0], "w": [m.w.astype("<f4").tobytes()], "v": [m.v.astype("<f4").tobytes()]})


def with_stated(docs: DataFrame) -> Column:
    return F.col("n_chars").try_cast("double") if "n_chars" in docs.columns else F.lit(None).cast("double")


def train(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Machine:
    """The machine of the labelled rows that may be learnt from."""
    known = (labels.filter("quality is not null and doc_id is not null").groupBy("doc_id")
             .agg((F.avg("quality") >= 0.5).cast("int").alias("label")).filter(~held_out(F.col("doc_id"))))
    known = learning_rows(known, "doc_id", fit_rows)
    rows = docs.select("doc_id", "text", with_stated(docs).alias("stated")).join(known, "doc_id")
    rows = rows.select("text", "stated", "label").mapInArrow(_entries, "label int, feature array<int>, value array<float>")
    rows = rows.repartition(1).sortWithinPartitions(F.xxhash64("feature"), "label")
    row = rows.mapInPandas(_fitted, "w0 double, w binary, v binary").collect()
    if not row:
        return fit(np.zeros(0), *[np.zeros(0, np.int64)] * 3)
    return Machine(row[0].w0, np.frombuffer(row[0].w, "<f4"), np.frombuffer(row[0].v, "<f4").reshape(FEATURES, FACTORS))


def scored(docs: DataFrame, machine: Machine, name: str = "score") -> DataFrame:
    """``docs`` with the score in column ``name`` (replaced if there is one)."""
    model = docs.sparkSession.sparkContext.broadcast((machine.w0, machine.w, machine.v))

    @F.arrow_udf("double")
    def score(text: pa.Array, stated: pa.Array) -> pa.Array:
        return pa.array(Machine(*model.value).score(text, _stated(stated)))

    return docs.withColumn(name, score(F.col("text"), with_stated(docs)))


def keep(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents with a score of 0.5 or more, columns as they were."""
    name = "__score"
    while name in docs.columns:
        name += "_"
    return scored(docs, train(docs, labels), name).filter(F.col(name) >= 0.5).drop(name)


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Contract columns of the quality query."""
    rows = docs.select("doc_id", "text", with_stated(docs).alias("n_chars"))
    rows = scored(rows, train(rows, labels))
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
