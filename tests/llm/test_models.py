"""Quality and language models: held-out accuracy, the machine's identity, Kneser-Ney by brute force, cases."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from larder.llm import language, quality

from .helpers import awkward, frame

SF = "/root/testdata/sf0.01"


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 3 == 1


# ---- quality

def labelled(n=300):
    rng = random.Random(1)
    rows, labels = [], []
    for i in range(n):
        good = i % 3 != 0
        words = [rng.choice(["river", "stone", "paper", "cloud", "garden", "window"]) for _ in range(rng.randint(5, 60))]
        text = " ".join(words).capitalize() + "." if good else "BUY NOW!! " * rng.randint(3, 20)
        rows.append((i, text, "en", "s"))
        labels.append((i, int(good), 0))
    return rows, labels


def test_quality_of_held_out_rows(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    out = quality.digest(docs, labels)
    assert out.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = {r.doc_id: r for r in out.collect()}
    assert len(rows) == docs.count()
    truth = {r.doc_id: r.quality for r in labels.collect()}
    assert all(r.held_out == held(i) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for i, r in rows.items())
    test = [i for i in truth if held(i)]
    assert np.mean([rows[i].predicted == truth[i] for i in test]) >= 0.95


def test_labels_of_held_out_rows_change_nothing(spark):
    rows, labels = labelled()
    turned = [(i, 1 - q if held(i) else q, t) for i, q, t in labels]
    schema = "doc_id long, quality int, toxic int"
    a = {r.doc_id: r.score for r in quality.digest(frame(spark, rows), spark.createDataFrame(labels, schema)).collect()}
    b = {r.doc_id: r.score for r in quality.digest(frame(spark, rows), spark.createDataFrame(turned, schema)).collect()}
    assert all(math.isclose(a[i], b[i], abs_tol=1e-9) for i in a)


def test_scores_depend_on_text_and_stated_length_alone(spark):
    rows, labels = labelled()
    labels = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    df = frame(spark, rows)
    machine = quality.train(df, labels)
    a = {r.doc_id: r.score for r in quality.scored(df, machine).collect()}
    other = df.select((F.col("doc_id") + 7000).alias("doc_id"), "text", F.lit("xx").alias("lang"), F.lit(None).cast("string").alias("source"), "n_chars")
    b = {r.doc_id - 7000: r.score for r in quality.scored(other.repartition(3), machine).collect()}
    assert a == b


def test_sum_of_squares_identity():
    rng = np.random.default_rng(0)
    n, k = 12, 3
    w, v = rng.normal(size=n), rng.normal(size=(n, k))
    m = quality.Machine(0.3, w, v)
    x = rng.normal(size=(2, n))
    row, feature = np.repeat([0, 1], n), np.tile(np.arange(n), 2)
    got = m.raw(2, row, feature, x.ravel())
    for r in range(2):
        pairs = sum(v[i] @ v[j] * x[r, i] * x[r, j] for i in range(n) for j in range(i + 1, n))
        assert math.isclose(got[r], 0.3 + w @ x[r] + pairs, rel_tol=1e-9)


def test_quality_cases(spark):
    _, labels = labelled()
    labels = labels + [(None, 1, 0), (3, None, 0), (5, 0, None), (5, 0, 0)]
    labels = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    rows = awkward() + labelled()[0][50:]
    out = quality.digest(frame(spark, rows), labels).collect()
    assert Counter(r.doc_id for r in out) == Counter(r[0] for r in rows)
    assert all(r.score is not None and 0 <= r.score <= 1 for r in out)
    assert len({r.score for r in out if r.doc_id == 7}) == 1 or sum(r[0] == 7 for r in rows) > 3
    empty = quality.digest(frame(spark, []), labels)
    assert empty.collect() == []
    unknown = quality.digest(frame(spark, awkward()), labels.limit(0)).collect()
    assert {(r.score, r.predicted) for r in unknown} == {(0.5, 1)}


def test_kept_rows_keep_their_columns(spark):
    rows, labels = labelled()
    labels = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    df = frame(spark, rows).withColumn("score", F.lit("own")).withColumn("label", F.lit(9))
    out = quality.keep(df, labels)
    assert out.columns == df.columns
    kept = {r.doc_id for r in out.collect()}
    good = {i for i, r in enumerate(rows) if not r[1].startswith("BUY")}
    assert len(kept & good) >= 0.98 * len(good) and len(kept - good) <= 0.02 * len(rows)
    bare = quality.keep(df.drop("n_chars"), labels)
    assert bare.count() > 0.5 * len(rows)


def test_learning_sample_is_bounded(spark):
    from larder.llm.common import learning_rows

    df = spark.range(20000).withColumnRenamed("id", "doc_id")
    n = learning_rows(df, "doc_id", 1000).count()
    assert 800 < n < 1200 and learning_rows(df, "doc_id", 30000).count() == 20000


# ---- language

def test_languages_of_held_out_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = language.digest(docs)
    truth = {r.doc_id: r.lang for r in docs.collect()}
    rows = {r.doc_id: r for r in out.collect()}
    assert len(rows) == len(truth)
    assert all(r.held_out == held(i) and 0 <= r.score <= 1 for i, r in rows.items())
    assert np.mean([rows[i].lang_pred == truth[i] for i in truth if held(i)]) >= 0.98


def kneser_ney(words, order, symbols):
    """Interpolated Kneser-Ney in plain Python: log-probability of a word."""
    counts = [Counter() for _ in range(order + 1)]
    for word, n in words.items():
        s = ["^", *word, "$"]
        for i in range(1, len(s)):
            for k in range(1, min(order, i + 1) + 1):
                counts[k][tuple(s[i - k + 1:i + 1])] += n
    used = [None] * (order + 1)
    for k in range(1, order + 1):
        if k == order:
            used[k] = counts[k]
            continue
        left = defaultdict(set)
        for g in counts[k + 1]:
            left[g[1:]].add(g[0])
        used[k] = {g: c if g[0] == "^" or g not in left else len(left[g]) for g, c in counts[k].items()}
    less, total, kinds = {}, defaultdict(float), Counter()
    for k in range(1, order + 1):
        ones, twos = sum(c == 1 for c in used[k].values()), sum(c == 2 for c in used[k].values())
        less[k] = ones / (ones + 2 * twos) if ones and twos else 0.5
        for g, c in used[k].items():
            total[k, g[:-1]] += c
            kinds[k, g[:-1]] += 1

    def p(g):
        k = len(g)
        if k == 0:
            return 1 / symbols
        lower = p(g[1:])
        if (k, g[:-1]) not in total:
            return lower
        t = total[k, g[:-1]]
        return max(used[k].get(g, 0) - less[k], 0) / t + less[k] * kinds[k, g[:-1]] / t * lower

    def log_p(word):
        s = ["^", *word, "$"]
        return sum(math.log(p(tuple(s[max(0, i - order + 1):i + 1]))) for i in range(1, len(s)))

    return log_p


def test_models_equal_brute_force(spark):
    rng = random.Random(3)
    make = lambda letters: " ".join("".join(rng.choice(letters) for _ in range(rng.randint(1, 7))) for _ in range(120))
    texts = [(make("abcde"), 0), (make("cdefgé"), 1), (make("abcde"), 0)]
    df = spark.createDataFrame(texts, "text string, lang int")
    grams = df.mapInArrow(language._counted, language.GRAMS).groupBy("lang", "k", "gram", "context", "rest", "opens").agg(F.sum("n").alias("n"))
    models = language.Models(["a", "b"], grams.toPandas())
    words = [Counter(), Counter()]
    for t, lang in texts:
        words[lang].update(t.split())
    probes = ["abc", "é", "gfedc", "aaaaaaaaaa", "zq", "bad", "cafés"]
    e, size = models.entropies(pa.array(probes), {})
    symbols = len({c for w in words for x in w for c in x} | {"$"}) + 1
    assert models.symbols == symbols
    for lang in (0, 1):
        log_p = kneser_ney(words[lang], language.ORDER, symbols)
        for i, w in enumerate(probes):
            assert math.isclose(-e[i, lang] * size[i], log_p(w), rel_tol=1e-4), (lang, w)


def test_language_cases(spark):
    rows = awkward() + [(200, "12345 !!! --", "en", "s"), (201, "ΑΒΓ δεζ", "en", "s"), (202, "x", None, "s")]
    out = {r.doc_id: r for r in language.digest(frame(spark, rows).repartition(4)).collect()}
    assert {out[i].lang_pred for i in (100, 101, 102, 200)} == {"und"} and out[100].score == 0
    assert out[201].lang_pred in ("de", "en") and out[104].lang_pred in ("de", "en")
    assert language.digest(frame(spark, [])).collect() == []
    none = language.digest(frame(spark, [(1, "words", None, "s"), (2, None, None, None)])).collect()
    assert {(r.lang_pred, r.score) for r in none} == {("und", 0.0)}
    clash = frame(spark, rows).withColumn("language", F.lit(1)).withColumn("score", F.lit(2))
    assert language.digest(clash).count() == len(rows)


def test_rejection(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    models = language.train(docs)
    out = models.decide(pa.array(["zzxq jjkw vvpf qqzx kkjh wwqz " * 20, docs.filter("lang = 'en'").first().text]), {})
    assert list(out["rejected"]) == [True, False]


@pytest.mark.parametrize("text,words", [("ab cd", 2), ("ab1cd", 2), ("Éa\U0001F600b", 2), ("", 0), ("don't", 2)])
def test_letter_words(text, words):
    from larder.llm.textvec import chunks

    found = [language.LetterWords(d, o) for _, d, o in chunks(pa.array([text, text]))]
    assert sum(len(w.start) for w in found) == 2 * words
