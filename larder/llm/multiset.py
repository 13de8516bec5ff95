"""Homomorphic document fingerprints (DataFrame functions only).

A text is the multiset of its paragraphs: what line breaks and sentence ends leave.  Each paragraph
is hashed to a wide vector, and the text's vector is the sum: the order of paragraphs doesn't count,
a paragraph is inserted by adding its vector and deleted by subtracting it.  The vector has

- ``n``, the number of paragraphs;
- ``LANES`` lanes that count the paragraphs whose hash has that bit, modulo 2^16 in the fingerprint;
- eight sums of 32-bit hashes modulo 2^32, which tell unlike multisets apart.

Texts of equal multisets have equal fingerprints; unlike ones differ but for a chance of about 2^-256.

Likeness comes from the lanes alone.  With a bit as +1 or -1 a lane holds 2 * count - n, and the
mean square of the lanes' differences estimates the squared distance of the two multisets, that of
a vector the square of its length.  Likeness is 1 - distance / (sum of the squares), from 0 to 1:
1 for equal multisets, about the share of common paragraphs for others, with a standard error of
about 1 / sqrt(LANES).  A lane that differs by 2^15 or more is read modulo 2^16.

A paragraph adds 64 bits of two lanes to 32 long sums, 32 bits apart; a text of 2^31 bytes can't
overflow them.

Order of the query: documents by descending id, then by a hash of the text.  Rows get the bounds
of that order from Spark's range partitioner over (id, hash) alone, so the texts are shuffled once;
the first row of each range is also sent to the range before it.

Cases: a null text is an empty one, and an empty text or one of separators has no paragraph (all
sums 0; two such are alike: 1); null ids come last; rows with equal id and text stand next to each
other, so that the next of one is its copy; a single document is its own next one; an empty table
gives an empty result; texts may have any length; columns that are not read may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.llm.common import computed_once

#: Where a paragraph ends.
BREAK = r"[\n\r]+|(?<=[.!?])[\x20\t]+"
LANES = 128
#: Hashes of a paragraph; the first LANES / 64 give lanes, all give sums.
HASHES = 4
PAIR = (1 << 32) + 1
LOW = (1 << 32) - 1


def paragraphs(text: Column) -> Column:
    """The paragraphs of a text that isn't null, in order."""
    return F.filter(F.split(text, BREAK, -1), lambda p: p != "")


def _lanes(hashes: Column) -> Column:
    """Sums of one hash' bits over paragraphs: 32 longs, each of lane i and, 32 bits higher, lane i + 32."""
    return F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.aggregate(
        hashes, F.lit(0).cast("long"), lambda s, h: s + F.call_function("shiftrightunsigned", h, i).bitwiseAND(F.lit(PAIR))))


def vector(parts: Column) -> Column:
    """The vector of an array of paragraphs: array of longs: n, and for each hash its lanes (packed by two) and two sums."""
    total = lambda h, part: F.aggregate(h, F.lit(0).cast("long"), lambda s, x: (s + part(x)).bitwiseAND(F.lit(LOW)))
    sums = lambda h: F.array(total(h, lambda x: x.bitwiseAND(F.lit(LOW))), total(h, lambda x: F.shiftrightunsigned(x, 32)))
    hashes = lambda ps, k: F.transform(ps, lambda p: F.xxhash64(F.lit(k), p))

    def of(ps: Column) -> Column:
        some = [computed_once(hashes(ps, k), (lambda h: F.concat(_lanes(h), sums(h))) if k < LANES // 64 else sums) for k in range(HASHES)]
        return F.flatten(F.array(F.array(F.size(ps).cast("long")), *some))

    return computed_once(parts, of)


def inserted(of: Column, parts: Column) -> Column:
    """``of`` with paragraphs inserted; only these are hashed."""
    return F.zip_with(of, vector(parts), lambda a, b: a + b)


def deleted(of: Column, parts: Column) -> Column:
    """``of`` without paragraphs that it holds; only these are hashed."""
    return F.zip_with(of, vector(parts), lambda a, b: a - b)


#: Places of the lanes and of the sums in a vector, from 0.
AT_LANES = [1 + 34 * k + i for k in range(LANES // 64) for i in range(32)]
AT_SUMS = [i for i in range(1 + 34 * (LANES // 64) + 2 * (HASHES - LANES // 64)) if i not in AT_LANES]


def _at(of: Column, places: list[int]) -> Column:
    return F.transform(F.array(*map(F.lit, places)), lambda i: F.get(of, i))


def lanes(of: Column) -> Column:
    """The lanes of a vector, whole."""
    packed = _at(of, AT_LANES)
    return F.concat(F.transform(packed, lambda x: x.bitwiseAND(F.lit(LOW))), F.transform(packed, lambda x: F.shiftrightunsigned(x, 32)))


def fingerprint(of: Column) -> Column:
    """A vector as hex text: n and the sums modulo 2^32, lanes modulo 2^16."""
    low = lambda x, bits: F.lpad(F.lower(F.hex(x.bitwiseAND(F.lit((1 << bits) - 1)))), bits // 4, "0")
    return computed_once(of, lambda v: F.concat(F.array_join(F.transform(_at(v, AT_SUMS), lambda x: low(x, 32)), ""),
                                        F.array_join(F.transform(lanes(v), lambda x: low(x, 16)), "")))


def likeness(a: Column, b: Column) -> Column:
    """Likeness of two vectors, 0 to 1."""
    signed = lambda x: F.pmod(x + F.lit(1 << 15), F.lit(1 << 16)) - F.lit(1 << 15)
    square = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v * v)
    counted = lambda v: computed_once(v, lambda x: F.struct(F.get(x, F.lit(0)).alias("n"), lanes(x).alias("lanes")))
    own = lambda v: square(F.transform(v["lanes"], lambda c: (2 * c - v["n"]).cast("double")))

    def of(pair: Column) -> Column:
        x, y = pair["a"], pair["b"]
        apart = square(F.zip_with(x["lanes"], y["lanes"], lambda c, d: (2 * signed(c - d) - (x["n"] - y["n"])).cast("double")))
        return computed_once(F.struct(apart.alias("apart"), (own(x) + own(y)).alias("both")), lambda s: F.when(
            s["both"] == 0, F.when(s["apart"] == 0, 1.0).otherwise(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - s["apart"] / s["both"]))))

    return computed_once(F.struct(counted(a).alias("a"), counted(b).alias("b")), of)


def _place(text: Column) -> Column:
    """Ascending in this is the order of the query: descending ids, null ids last, then a hash of the text."""
    return F.struct(F.col("doc_id").isNull().alias("none"), (-F.col("doc_id").cast("decimal(20,0)")).alias("id"), F.xxhash64(text).alias("hash"))


PLACES = "array<struct<none:boolean,id:decimal(20,0),hash:bigint>>"


def followed(docs: DataFrame, made: dict[str, Column]) -> DataFrame:
    """``docs`` (doc_id, text) and the columns ``made`` of them, with ``next``, a struct of text and these of the next row in the order.

    One (id, hash) a partition reaches the driver and the plan, as in any range partitioning.
    """
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.withColumn("key", _place(F.col("text")))
    ranges = rows.select("key").repartitionByRange(n, "key").groupBy(F.spark_partition_id().alias("range")).agg(F.min("key").alias("first"))
    firsts = [r["first"] for r in ranges.select(F.to_json("first").alias("first")).collect()]
    bounds = F.array_sort(F.from_json(F.lit(f"[{','.join(firsts)}]"), PLACES))
    steps = F.sequence(F.lit(1), F.lit(max(len(firsts), 1).bit_length()))

    def halved(s: Column, _: Column) -> Column:
        middle = F.floor((s["low"] + s["high"]) / 2).cast("int")
        found = F.get(bounds, middle) <= F.col("key")
        narrowed = F.struct(F.when(found, middle).otherwise(s["low"]).alias("low"), F.when(found, s["high"]).otherwise(middle).alias("high"))
        return F.when(s["high"] - s["low"] > 1, narrowed).otherwise(s)

    span = F.struct(F.lit(0).alias("low"), F.lit(len(firsts)).alias("high"))
    rows = rows.withColumn("range", F.aggregate(steps, span, halved, lambda s: s["low"]))
    # each range's first row, once, for the range before
    first = F.row_number().over(Window.partitionBy("range").orderBy("key"))
    heads = rows.filter(F.array_contains(bounds, F.col("key"))).withColumn("__n", first).filter("__n = 1").drop("__n")
    heads = heads.withColumn("range", F.pmod(F.col("range") - 1, F.lit(max(len(firsts), 1))))
    rows = rows.withColumns(made).withColumn("lent", F.lit(False)).union(heads.withColumns(made).withColumn("lent", F.lit(True)))
    order = Window.partitionBy("range").orderBy("lent", "key")
    return rows.withColumn("next", F.lead(F.struct("text", *made)).over(order)).filter("not lent").drop("key", "range", "lent")


def edited(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, text, edited, vector, edited_vector, next_vector) of ``docs`` (doc_id, text).

    The edited text has its last half replaced by as much of the next document's beginning.  Its vector is the
    document's, with the paragraphs from the cut on deleted and the new ones inserted.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = followed(rows, {"n_chars": F.char_length("text").cast("long"), "vector": vector(paragraphs(F.col("text")))})
    half = F.floor(F.col("n_chars") / 2).cast("int")
    rows = rows.withColumn("head", F.substring("text", F.lit(1), (F.col("n_chars") - half).cast("int")))
    rows = rows.withColumn("edited", F.concat("head", F.substring(F.col("next.text"), F.lit(1), half)))
    # paragraphs that end within the head, with which both texts begin; the letter is the start of one that doesn't
    whole = F.size(paragraphs(F.concat("head", F.lit("x")))) - 1
    rest = lambda text: computed_once(F.struct(paragraphs(F.col(text)).alias("all"), whole.alias("whole")), lambda s: F.slice(
        s["all"], s["whole"] + 1, F.greatest(F.size(s["all"]), F.lit(1))))
    changed = inserted(deleted(F.col("vector"), rest("text")), rest("edited"))
    return rows.select("doc_id", "n_chars", "text", "edited", "vector", changed.alias("edited_vector"), F.col("next.vector").alias("next_vector"))


def digest(docs: DataFrame) -> DataFrame:
    """Contract columns of the fingerprints."""
    rows = edited(docs.select("doc_id", "text"))
    return rows.select("doc_id", "n_chars", F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"), fingerprint(F.col("vector")).alias("fingerprint"),
                       fingerprint(F.col("edited_vector")).alias("edited_fingerprint"), likeness(F.col("vector"), F.col("edited_vector")).alias("near_edited"),
                       likeness(F.col("vector"), F.col("next_vector")).alias("near_next"))
