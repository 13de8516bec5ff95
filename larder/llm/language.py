"""Language identification by interpolated Kneser-Ney character models.

Each language has a model of the characters of its words (runs of letters,
lower-cased, with a mark at either end) of order ``ORDER``.  N-grams are 64-bit
hashes in one sorted array per order, with a column of discounted probabilities
per language; contexts are another sorted array with the weights of the lower
order.  A text gets the language with the lowest cross-entropy per character.

The models learn from at most about ``FIT_ROWS`` documents of each language
(picked by a hash of the id), of which one in ``CALIBRATION`` is put aside.  The
documents put aside set the temperature that turns cross-entropies into a
score, and each language's usual cross-entropy: a text far above that is
``rejected`` as none of the languages (the query reports the best language
all the same, as its contract asks for).

N-grams are counted in numpy batch by batch and summed in Spark; what reaches
the driver is the table of n-grams of the bounded sample.

Cases: texts that are null, empty or without letters are ``und`` with score 0;
ties go to the smaller language name; letters no model knows cost the same in
every language; null languages teach nothing; without any language all is
``und``; repeated rows get equal results; an empty table gives an empty result.
Columns that are not read may have any name.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.common import held_out
from larder.llm.textvec import BASE, BASE_INVERSE, _power, chunks, mixed

ORDER = 5
FIT_ROWS = 1500
CALIBRATION = 5
#: Words whose results a worker keeps.
CACHE_WORDS = 500_000
TEMPERATURES = (1, 2, 4, 8, 16, 32, 64, 128)
FAR = 6.0
UNKNOWN = "und"
START, END = 0x110000, 0x110001

_letters: list[np.ndarray] = []


def _letter_tables() -> tuple[np.ndarray, np.ndarray]:
    """Per code point: is it a letter, and its lower case (itself where that isn't one character)."""
    if not _letters:
        letter = np.zeros(sys.maxunicode + 1, bool)
        lower = np.arange(sys.maxunicode + 1, dtype=np.uint32)
        for c in range(sys.maxunicode + 1):
            x = chr(c)
            if x.isalpha():
                letter[c] = True
                y = x.lower()
                if len(y) == 1:
                    lower[c] = ord(y)
        _letters.extend([letter, lower])
    return _letters[0], _letters[1]


class LetterWords:
    """The words of a chunk as runs of letters: ``doc``, ``start``, ``end`` (characters) and ``hash``; ``codes`` are lower-cased."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        letter, lower = _letter_tables()
        at = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
        codes = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), "<u4")
        word = letter[codes]
        self.codes = lower[codes]
        edge = np.zeros(len(codes) + 1, bool)
        edge[at] = True
        if len(codes):
            after = np.concatenate([[False], word[:-1]])
            before = np.concatenate([word[1:], [False]])
            self.start = np.flatnonzero(word & (~after | edge[:-1]))
            self.end = np.flatnonzero(word & (~before | edge[1:])) + 1
        else:
            self.start = self.end = np.zeros(0, np.int64)
        self.doc = np.searchsorted(at, self.start, "right") - 1
        total = np.empty(len(codes) + 1, np.uint64)
        total[0] = 0
        np.multiply(self.codes.astype(np.uint64) + np.uint64(1), _power(BASE, len(codes))[:len(codes)], out=total[1:])
        np.cumsum(total, out=total)
        self.hash = mixed((total[self.end] - total[self.start]) * _power(BASE_INVERSE, len(codes) + 1)[self.start])

    def symbols(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The chosen words one after another, each with START before and END after; and each word's first place."""
        length = (self.end - self.start)[which] + 2
        first = np.cumsum(length) - length
        out = np.empty(int(length.sum()), np.uint64)
        inner = np.ones(len(out), bool)
        inner[first] = inner[first + length - 1] = False
        place = np.arange(len(out)) - np.repeat(first, length) - 1 + np.repeat(self.start[which], length)
        out[inner] = self.codes[place[inner]]
        out[first], out[first + length - 1] = START, END
        return out, first


def ngrams(symbols: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Place of each symbol in its word, and for k = 0 .. ORDER the hash of the k symbols that end at each symbol."""
    place = np.arange(len(symbols)) - np.repeat(first, np.diff(np.append(first, len(symbols))))
    out = [np.zeros(len(symbols), np.uint64)]
    for k in range(1, ORDER + 1):
        back = np.zeros(len(symbols), np.uint64)
        back[k - 1:] = symbols[:len(symbols) - k + 1]
        out.append(mixed(out[-1] * np.uint64(BASE) + back + np.uint64(k)))
    return place, out


def _counted(batches):
    """Arrow batches of (text, lang) to rows of n-grams with their counts in the batch."""
    for b in batches:
        langs = b.column("lang").to_numpy(zero_copy_only=False)
        for first, data, offsets in chunks(b.column("text")):
            words = LetterWords(data, offsets)
            of = langs[first:first + len(offsets) - 1][words.doc].astype(np.uint64)
            if not len(of):
                continue
            _, at, times = np.unique(words.hash ^ mixed(of + np.uint64(1)), return_index=True, return_counts=True)
            symbols, start = words.symbols(at)
            length = np.diff(np.append(start, len(symbols)))
            lang, count = np.repeat(of[at], length), np.repeat(times, length)
            place, h = ngrams(symbols, start)
            for k in range(1, ORDER + 1):
                use = np.flatnonzero((place >= k - 1) & (place > 0))
                gram, context, rest = h[k][use], np.zeros(len(use), np.uint64), h[k - 1][use]
                if k > 1:
                    context = h[k - 1][use - 1]
                opens = place[use] == k - 1
                key = gram ^ mixed(lang[use] + np.uint64(1))
                _, one, back = np.unique(key, return_index=True, return_inverse=True)
                total = np.bincount(back, weights=count[use])
                yield pa.RecordBatch.from_arrays([
                    pa.array(lang[use][one].astype(np.int32)), pa.array(np.full(len(one), k, np.int32)), pa.array(gram[one].view(np.int64)),
                    pa.array(context[one].view(np.int64)), pa.array(rest[one].view(np.int64)), pa.array(opens[one]),
                    pa.array(total.astype(np.int64))], ["lang", "k", "gram", "context", "rest", "opens", "n"])


GRAMS = "lang int, k int, gram long, context long, rest long, opens boolean, n long"


class Models:
    """Kneser-Ney models of all languages over shared sorted hash arrays."""

    def __init__(self, langs: list[str], grams=None):
        self.langs, self.tables = langs, []
        self.temperature, self.usual, self.spread = 8.0, np.full(len(langs), np.inf), np.zeros(len(langs))
        self.symbols = 1
        if grams is not None and len(grams):
            self._build(grams)

    def _build(self, g) -> None:
        g = {c: g[c].to_numpy() for c in ("lang", "k", "gram", "context", "rest", "opens", "n")}
        for c in ("gram", "context", "rest"):
            g[c] = g[c].astype(np.int64).view(np.uint64)
        n_langs = len(self.langs)
        # symbols of all languages, and one for what none has seen
        self.symbols = len(np.unique(g["gram"][g["k"] == 1])) + 1
        of_lang = lambda h, lang: h ^ mixed(lang.astype(np.uint64) + np.uint64(1))
        for k in range(1, ORDER + 1):
            own = g["k"] == k
            lang, gram, context, n, opens = (g[c][own] for c in ("lang", "gram", "context", "n", "opens"))
            if k < ORDER:
                # how many symbols stand before the n-gram; those that open a word keep their counts
                up = g["k"] == k + 1
                keys, left = np.unique(of_lang(g["rest"][up], g["lang"][up]), return_counts=True)
                key = of_lang(gram, lang)
                at = np.minimum(np.searchsorted(keys, key), max(len(keys) - 1, 0))
                found = (keys[at] == key) if len(keys) else np.zeros(len(key), bool)
                n = np.where(opens | ~found, n, left[at] if len(keys) else 0)
            n = n.astype(np.float64)
            grams, row = np.unique(gram, return_inverse=True)
            contexts, of = np.unique(context, return_inverse=True)
            value, weight = np.zeros((len(grams), n_langs), np.float32), np.ones((len(contexts), n_langs), np.float32)
            for x in range(n_langs):
                mine = lang == x
                if not mine.any():
                    continue
                ones, twos = (n[mine] == 1).sum(), (n[mine] == 2).sum()
                less = ones / (ones + 2 * twos) if ones and twos else 0.5
                total = np.bincount(of[mine], weights=n[mine], minlength=len(contexts))
                kinds = np.bincount(of[mine], minlength=len(contexts))
                value[row[mine], x] = (n[mine] - less) / total[of[mine]]
                seen = total > 0
                weight[seen, x] = less * kinds[seen] / total[seen]
            self.tables.append((grams, value, contexts, weight))

    def words(self, symbols: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Log-probability of each word under each language."""
        place, h = ngrams(symbols, first)
        use = np.flatnonzero(place > 0)
        p = np.full((len(use), len(self.langs)), 1.0 / self.symbols, np.float32)
        for k, (grams, value, contexts, weight) in enumerate(self.tables, 1):
            on = np.flatnonzero(place[use] >= k - 1)
            gram = h[k][use[on]]
            context = h[k - 1][use[on] - 1] if k > 1 else np.zeros(len(on), np.uint64)
            at = np.minimum(np.searchsorted(contexts, context), len(contexts) - 1)
            known = contexts[at] == context
            on, gram, at = on[known], gram[known], at[known]
            lower = p[on] * weight[at]
            at = np.minimum(np.searchsorted(grams, gram), len(grams) - 1)
            lower += np.where((grams[at] == gram)[:, None], value[at], 0)
            p[on] = lower
        return np.add.reduceat(np.log(np.maximum(p, 1e-30)), first - np.arange(len(first)), axis=0)

    def entropies(self, texts: pa.Array, cache: dict) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy of each text per character and language, and its characters; ``cache`` keeps words' results."""
        total, size = np.zeros((len(texts), len(self.langs))), np.zeros(len(texts))
        for first, data, offsets in chunks(texts):
            n = len(offsets) - 1
            words = LetterWords(data, offsets)
            if not len(words.start):
                continue
            if len(cache.setdefault("key", np.zeros(0, np.uint64))) > CACHE_WORDS:
                cache.clear()
                cache["key"] = np.zeros(0, np.uint64)
            cache.setdefault("value", np.zeros((0, len(self.langs)), np.float32))
            hashes, at, back = np.unique(words.hash, return_index=True, return_inverse=True)
            where = np.searchsorted(cache["key"], hashes)
            old = np.zeros(len(hashes), bool)
            inside = where < len(cache["key"])
            old[inside] = cache["key"][where[inside]] == hashes[inside]
            result = np.empty((len(hashes), len(self.langs)), np.float32)
            result[old] = cache["value"][where[old]]
            if not old.all():
                result[~old] = self.words(*words.symbols(at[~old]))
                cache["value"] = np.insert(cache["value"], where[~old], result[~old], axis=0)
                cache["key"] = np.insert(cache["key"], where[~old], hashes[~old])
            for x in range(len(self.langs)):
                total[first:first + n, x] += np.bincount(words.doc, weights=result[back, x], minlength=n)
            size[first:first + n] += np.bincount(words.doc, weights=words.end - words.start + 1, minlength=n)
        return -total / np.maximum(size, 1)[:, None], size

    def decide(self, texts: pa.Array, cache: dict) -> dict[str, np.ndarray]:
        """Best language, score, cross-entropy and rejection of each text."""
        if not self.langs:
            n = len(texts)
            return {"lang": np.full(n, UNKNOWN, object), "score": np.zeros(n), "entropy": np.full(n, np.nan), "rejected": np.ones(n, bool)}
        entropy, size = self.entropies(texts, cache)
        best = entropy.argmin(axis=1)
        low = entropy[np.arange(len(best)), best]
        score = 1 / np.exp(-self.temperature * (entropy - low[:, None])).sum(axis=1)
        some = size > 0
        far = low > self.usual[best] + FAR * self.spread[best] * (1 + 8 / np.sqrt(np.maximum(size, 1)))
        return {"lang": np.where(some, np.array(self.langs, object)[best], UNKNOWN), "score": np.where(some, score, 0.0),
                "entropy": np.where(some, low, np.nan), "rejected": ~some | far}


def _sample(docs: DataFrame, fit_rows: int) -> tuple[list[str], DataFrame]:
    """Languages, and (doc_id, text, lang index, aside) of the documents to learn from."""
    known = docs.select("doc_id", "text", "lang").filter("text is not null and lang is not null").filter(~held_out(F.col("doc_id")))
    counts = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    langs = sorted(counts)
    if not langs:
        return [], known
    cut = {x: (2**63 - 1 if counts[x] <= fit_rows else int((2 * fit_rows / counts[x] - 1) * (2**63 - 1))) for x in langs}
    pairs = F.create_map(*[y for i, x in enumerate(langs) for y in (F.lit(x), F.struct(F.lit(i).alias("i"), F.lit(cut[x]).cast("long").alias("cut")))])
    known = known.withColumn("__of", F.element_at(pairs, F.col("lang"))).withColumn("__h", F.xxhash64(F.lit("learn"), "doc_id"))
    known = known.filter(F.col("__h") <= F.col("__of.cut"))
    aside = F.pmod(F.xxhash64(F.lit("aside"), "doc_id"), F.lit(CALIBRATION)) == 0
    return langs, known.select("doc_id", "text", F.col("__of.i").alias("lang"), aside.alias("aside"))


def train(docs: DataFrame, fit_rows: int = FIT_ROWS) -> Models:
    langs, rows = _sample(docs, fit_rows)
    if not langs:
        return Models([])
    grams = rows.filter("not aside").select("text", "lang").mapInArrow(_counted, GRAMS)
    grams = grams.groupBy("lang", "k", "gram", "context", "rest", "opens").agg(F.sum("n").alias("n"))
    models = Models(langs, grams.toPandas())
    if models.tables:
        _calibrate(models, rows.filter("aside"))
    return models


def _calibrate(models: Models, rows: DataFrame) -> None:
    """Temperature with the least log-loss, and each language's usual cross-entropy, on the documents put aside."""
    shared = rows.sparkSession.sparkContext.broadcast(models)
    kept: dict = {}

    @F.arrow_udf("array<double>")
    def entropies(text: pa.Array) -> pa.Array:
        e, size = shared.value.entropies(text, kept)
        return pa.array([row.tolist() if n else None for row, n in zip(e, size)], pa.list_(pa.float64()))

    e = rows.select("lang", entropies("text").alias("e")).filter("e is not null")
    own = F.get("e", F.col("lang"))

    def loss(t: float):
        return F.avg(F.log(F.aggregate("e", F.lit(0.0), lambda s, x: s + F.exp(t * (own - x))))).alias(f"t{t}")

    losses = [loss(t) for t in TEMPERATURES]
    found = e.withColumn("own", own).groupBy("lang").agg(F.avg("own").alias("usual"), F.stddev_pop("own").alias("spread"), F.count(F.lit(1)).alias("n"), *losses).collect()
    if not found:
        return
    total = sum(r.n for r in found)
    models.temperature = float(min(TEMPERATURES, key=lambda t: sum(r[f"t{t}"] * r.n for r in found) / total))
    for r in found:
        models.usual[r.lang], models.spread[r.lang] = r.usual, r.spread + 0.02


def identified(docs: DataFrame, models: Models, name: str = "language") -> DataFrame:
    """``docs`` with a struct (lang, score, entropy, rejected) in column ``name``."""
    shared = docs.sparkSession.sparkContext.broadcast(models)
    kept: dict = {}

    @F.arrow_udf("struct<lang:string,score:double,entropy:double,rejected:boolean>")
    def identify(text: pa.Array) -> pa.Array:
        out = shared.value.decide(text, kept)
        return pa.StructArray.from_arrays([pa.array(out["lang"], pa.string()), pa.array(out["score"]), pa.array(out["entropy"]), pa.array(out["rejected"])],
                                          ["lang", "score", "entropy", "rejected"])

    return docs.withColumn(name, identify(F.col("text")))


def digest(docs: DataFrame) -> DataFrame:
    """Contract columns of the language query."""
    rows = docs.select("doc_id", "text", "lang")
    rows = identified(rows.select("doc_id", "text"), train(rows))
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("language.lang").alias("lang_pred"),
                       F.col("language.score").alias("score"), F.col("language.rejected").alias("rejected"))
