"""Secret scan (DataFrame functions only).

Three patterns give the base spans (assignments, access keys, hex strings).  The
method adds spans of kind ``random``: tokens, or what base spans leave of them, whose
characters follow a first-order Markov model of random strings rather than one of
ordinary identifiers, by log-likelihood ratio.

Both models are counts of character pairs, learnt from labelled samples in
``FIT_DOCS`` documents, picked by a hash of their id.  Ordinary: the words,
identifiers and numbers of the texts, without base spans, dates, counts and
numbered words made from hashes of the ids, and some words in capitals.  Random: the values of the base spans, and digests of
the ids in the usual alphabets (hex in either case, base 64, base 36), so that
alphabets without a base span are known as well.

Only pairs of letters and digits count.  Paths, addresses and joined words hold
``/``, ``+``, ``=``, ``_`` and ``-`` as encoded bytes do, so a token's parts between them
are scored, and their pairs say nothing for either side.  Tokens of digits alone are
numbers.

Positions: ``split`` gives the text between the matches of a pattern and
``regexp_extract_all`` the matches, so a running sum of their lengths, made by doubling,
gives each start.  They count code points, ends exclusive.  Texts are cut at positions in
UTF-32, where a piece costs its own length, and joined once.  So the work for a text of n
characters and m spans is about n + m log m, and texts may have any length.

Cases: a null text is an empty one and has no spans; repeated rows get equal
spans; without any learnable document both models are uniform and add nothing;
an empty table gives an empty result.  Columns that are not read may have any
name.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.llm.common import computed_once, learning_rows, running

# Fixed values of the contract: the kinds in their order, their patterns and least lengths.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}"
ASSIGN_VALUE, ACCESS_LENGTH = 6, 20

KINDS = ("assign", "access", "hex", "random")
#: Rulers and repeated characters, which neither model has seen, have fewer characters of their own than this.
LEAST_DISTINCT = 8
TOKEN = rf"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{{{LEAST_DISTINCT},}}"
#: Words, identifiers and numbers, each a sequence of small, capital or capitalised words and of figures: tokens
#: of a lone letter here and there may be what is looked for, and may not teach what is ordinary, nor may long ones.
ORDINARY = (r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z0-9_-]{4,19}(?![A-Za-z0-9+/_=-]))"
            r"(?:(?:[A-Z]?[a-z]{2,}+|[A-Z]{2,}+|[0-9]++)[_-]*+)++(?![A-Za-z0-9+/_=-])")
SYMBOLS = 62
FIT_DOCS = 4000
#: One word in so many, by its hash, is learnt in capitals as well.
CAPITAL_EVERY = 16
#: A token is a secret if the ratio favours random by this many nats in all, and by so many a character.
LEAST_NATS, LEAST_NATS_EACH = 12.0, 0.45
MARK = "[SECRET]"


def _matches(text: Column, pattern: str) -> Column:
    """Array of struct(start, end, value) of a pattern's matches."""
    found, between = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    sizes = F.zip_with(found, F.slice(F.transform(between, lambda g: F.char_length(g)), 1, F.size(found)), lambda m, g: F.struct(
        m.alias("value"), F.char_length(m).alias("own"), (F.char_length(m) + g).alias("size")))
    spans = computed_once(sizes, lambda a: F.zip_with(a, running(a["size"], lambda x, y: x + y), lambda m, end: F.struct(
        (end - m["own"]).alias("start"), end.alias("end"), m["value"].alias("value"))))
    return F.when(F.regexp_like(text, F.lit(pattern)), spans).otherwise(F.array().cast("array<struct<start:int,end:int,value:string>>"))


def base_spans(text: Column) -> Column:
    """Array of struct(start, kind, end, value); ``kind`` is the place in KINDS.  ``text`` isn't null."""

    def of(kind: int, pattern: str, keep) -> Column:
        return F.transform(F.filter(_matches(text, pattern), keep), lambda m: F.struct(
            m["start"].alias("start"), F.lit(kind).alias("kind"), m["end"].alias("end"), m["value"].alias("value")))

    return F.concat(
        of(0, ASSIGN, lambda m: F.char_length(F.regexp_extract(m["value"], ASSIGN, 2)) >= ASSIGN_VALUE),
        of(1, ACCESS, lambda m: F.char_length(m["value"]) >= ACCESS_LENGTH),
        of(2, HEX, lambda m: F.lit(True)))


def _pairs(tokens: Column) -> Column:
    return F.flatten(F.transform(tokens, lambda t: F.transform(
        F.sequence(F.lit(1), F.greatest(F.char_length(t) - 1, F.lit(1))), lambda i: F.substring(t, i, F.lit(2)))))


def train(docs: DataFrame, fit_docs: int = FIT_DOCS) -> list[float]:
    """Log-likelihood ratios, random against ordinary, at 128 * first + second character.

    What reaches the driver are counts of pairs of the 62 letters and digits, whatever the input.
    """
    sample = learning_rows(docs.select("doc_id", "text").filter("text is not null"), "doc_id", fit_docs)
    sample = sample.withColumn("base", base_spans(F.col("text")))
    clean = F.regexp_replace(F.regexp_replace(F.regexp_replace("text", ASSIGN, " "), ACCESS, " "), HEX, " ")
    clean = F.when(F.size("base") > 0, clean).otherwise(F.col("text"))
    seed = F.concat(F.lit("sample"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    digest = F.sha2(seed, 256)
    made = F.array(F.sha1(seed), F.upper(F.md5(seed)), F.regexp_replace(F.base64(F.unhex(digest)), "[=]", ""),
                   F.conv(F.substring(digest, 1, 15), 16, 36), F.lower(F.conv(F.substring(digest, 20, 15), 16, 36)))
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.pmod(F.xxhash64(F.lit("day"), seed), F.lit(40000)).cast("int"))
    count = F.pmod(F.xxhash64(F.lit("count"), seed), F.lit(10**9))
    words = F.regexp_extract_all(clean, F.lit(ORDINARY), F.lit(0))
    numbers = F.array(F.date_format(day, "yyyyMMdd"), count.cast("string"),
                      F.concat(F.coalesce(F.get(words, F.lit(0)), F.lit("")), (count % 1000).cast("string")))
    capitals = F.transform(F.filter(words, lambda w: F.pmod(F.xxhash64(w), F.lit(CAPITAL_EVERY)) == 0), F.upper)
    values = F.transform("base", lambda s: F.when(s["kind"] == 0, F.regexp_extract(s["value"], ASSIGN, 2)).otherwise(s["value"]))
    sides = F.array(F.struct(F.lit("r").alias("side"), _pairs(F.concat(values, made)).alias("pairs")),
                    F.struct(F.lit("o").alias("side"), _pairs(F.concat(words, numbers, capitals)).alias("pairs")))
    counts = (sample.select(F.explode(sides).alias("s")).select("s.side", F.explode("s.pairs").alias("pair"))
              .filter(F.regexp_like("pair", F.lit(r"^[A-Za-z0-9]{2}$")))
              .groupBy("side", "pair").count().collect())
    pair, first, second, total = {}, {}, {}, {"r": 0, "o": 0}
    for side, p, n in counts:
        pair[side, p] = n
        first[side, p[0]] = first.get((side, p[0]), 0) + n
        second[side, p[1]] = second.get((side, p[1]), 0) + n
        total[side] += n
    symbols = [chr(c) for c in range(128) if chr(c).isalnum()]

    def p(side: str, a: str, b: str) -> float:
        alone = (second.get((side, b), 0) + 1) / (total[side] + SYMBOLS)
        return (pair.get((side, a + b), 0) + 8 * alone) / (first.get((side, a), 0) + 8)

    out = [0.0] * (128 * 128)
    for a in symbols:
        for b in symbols:
            out[128 * ord(a) + ord(b)] = math.log(p("r", a, b) / p("o", a, b))
    return out


def _replaced(text: Column, spans: Column, by) -> Column:
    """``text`` with what ``by`` makes of each span's start, end and of the end of all before; the gaps stay."""

    def of(s: Column) -> Column:
        whole, spans = s["whole"], s["spans"]
        cut = lambda at, size: F.decode(F.substring(whole, 4 * at + 1, 4 * size), "UTF-32")
        ends = s["ends"]
        pieces = F.transform(spans, lambda x, i: computed_once(F.coalesce(F.get(ends, i - 1), F.lit(0)), lambda before: F.concat(
            cut(before, F.greatest(x["start"] - before, F.lit(0))), by(x["start"], x["end"], before))))
        last = F.element_at(ends, -1)
        return F.concat(F.array_join(pieces, ""), cut(last, F.greatest((F.octet_length(whole) / 4).cast("int") - last, F.lit(0))))

    order = F.array_sort(F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))))
    made = computed_once(order, lambda o: F.struct(F.encode(text, "UTF-32").alias("whole"), o.alias("spans"),
                                                   running(o["end"], lambda x, y: F.greatest(x, y)).alias("ends")))
    return F.when(F.size(spans) > 0, computed_once(made, of)).otherwise(text)


def _without(text: Column, spans: Column) -> Column:
    """``text`` with spaces in place of its spans, so that all else keeps its position."""
    return _replaced(text, spans, lambda start, end, before: F.repeat(F.lit(" "), F.greatest(end - F.greatest(before, start), F.lit(0))))


def random_spans(text: Column, ratios: list[float]) -> Column:
    """Spans of tokens that the models call random; ``text`` holds no base span."""
    table = F.split(F.lit(",".join(f"{x:.6g}" for x in ratios)), ",").cast("array<double>")

    def nats(token: Column) -> Column:
        codes = F.transform(F.split(token, ""), lambda c: F.ascii(c))
        start = F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("last"))
        return F.aggregate(codes, start, lambda s, c: F.when(c == 0, s).otherwise(F.struct(
            (s["sum"] + F.get(table, 128 * s["last"] + c)).alias("sum"), c.alias("last"))), lambda s: s["sum"])

    likely = lambda m: nats(m["value"]) >= F.greatest(F.lit(LEAST_NATS), LEAST_NATS_EACH * F.char_length(m["value"]))
    varied = lambda m: F.size(F.array_distinct(F.split(m["value"], ""))) >= LEAST_DISTINCT
    candidates = F.filter(_matches(text, TOKEN), varied)
    return F.transform(F.filter(candidates, likely), lambda m: F.struct(
        m["start"].alias("start"), F.lit(3).alias("kind"), m["end"].alias("end")))


def scan(docs: DataFrame, ratios: list[float] | None = None) -> DataFrame:
    """``docs`` with ``base`` and ``found``: arrays of struct(start, kind, end), sorted; ``found`` holds both sorts.

    Input columns of these names are replaced.
    """
    ratios = train(docs) if ratios is None else ratios
    rest = [c for c in docs.columns if c not in ("base", "found")]
    rows = docs.select(*rest, F.coalesce("text", F.lit("")).alias("__text"))
    rows = rows.withColumn("__base", base_spans(F.col("__text")))
    rows = rows.withColumn("__rest", _without(F.col("__text"), F.col("__base")))
    rows = rows.withColumn("__more", random_spans(F.col("__rest"), ratios))
    rows = rows.withColumn("base", F.array_sort(F.transform("__base", lambda s: F.struct(
        s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))))
    return rows.select(*rest, "base", F.array_sort(F.concat("base", "__more")).alias("found"))


def _joined(spans: Column) -> Column:
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"], s["end"])), ",")


def redacted(docs: DataFrame, ratios: list[float] | None = None, mark: str = MARK) -> DataFrame:
    """``docs`` with each stretch of spans in ``text`` replaced by ``mark``, and ``n_chars`` brought up to date."""
    text = F.col("__row.text")
    rows = scan(docs.select("doc_id", "text", F.struct(*docs.columns).alias("__row")), ratios)
    clean = _replaced(text, F.col("found"), lambda start, end, before: F.when(start >= before, mark).otherwise(""))
    rows = rows.withColumn("__clean", clean)
    changed = {"text": F.col("__clean"), "n_chars": F.when(F.size("found") > 0, F.char_length("__clean").cast("long"))}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.coalesce(changed["n_chars"], F.col("__row.n_chars"))
    return rows.select(*[changed[c].alias(c) if c in changed else F.col(f"__row.`{c}`").alias(c) for c in docs.columns])


def digest(docs: DataFrame) -> DataFrame:
    """Contract columns of the secret scan."""
    rows = scan(docs.select("doc_id", "text"))
    n = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return rows.select("doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"),
                       F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.col("found")).alias("spans"))
