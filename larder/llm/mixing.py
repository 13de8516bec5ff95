"""Mixing sources to target weights (DataFrame functions only).

Sizes are words.  A source's target is its weighted share of the mix, stopped at
``REPEATS`` times its size, the excess going to the others by weight.  The mix
is cut into blocks of ``BLOCK`` words that sources win by Sainte-Laguë: block
after block goes to the highest quotient target / (2 k + 1), k being what the
source has won.  Divisors are not walked one by one: rounding target / divisor
gives all but a few blocks per source, and only the quotients next to that are
ranked.  The method is house monotone, so the quota of a shard is the
difference of two apportionments.

Each source's documents stand in a seeded order and are cut into blocks of
equal words in it; a source's blocks are taken in that order, all of them before
any again.  Positions come from the sizes of (source, part) groups, a part
being a range of the seeded hash, so no task orders a whole source.

Cases: a null source is a source and comes last; null, empty and wordless texts
have size 0 and take 0; sources without words have target 0; rows with equal ids
are placed one by one; equal rows may swap places, which changes nothing; an
empty table gives an empty mix.  Columns that are not read may have any name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larder.llm.common import checkpointed, word_count

WEIGHTS = (5, 2, 1)
SHARE = 1.5
REPEATS = 2
BLOCK = 32
N_SHARDS = 16
SEED = 17
#: Parts of each source in the seeded order.
PARTS = 4096
PIECE = "array<struct<shard:int,copy:int,word_start:bigint,word_end:bigint>>"


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, repeats: int = REPEATS) -> DataFrame:
    """One row per source: rank, size, weight, target.  ``sizes``: (source, source_size), a row per source.

    Sorted by limit / weight, the sources at their limit come first; the level
    that the others share is the greatest of (what is left) / (weight left).
    """
    every = Window.partitionBy(F.lit(0))
    rank = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())) - 1
    t = sizes.withColumn("rank", rank).withColumn("weight", F.get(F.array(*map(F.lit, weights)), F.col("rank") % len(weights)).cast("double"))
    t = t.withColumn("limit", F.col("source_size") * repeats).withColumn("mix", F.sum("source_size").over(every) * F.lit(float(share)))
    order = Window.partitionBy(F.lit(0)).orderBy(F.col("limit") / F.col("weight"), "rank")
    used = F.coalesce(F.sum("limit").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    t = t.withColumn("level", (F.col("mix") - used) / left)
    level = F.max("level").over(every)
    return t.select("source", "rank", "source_size", "weight", "mix",
                    F.least(F.col("limit").cast("double"), level * F.col("weight")).alias("target"))


def apportion(plan: DataFrame, block: int = BLOCK, n_shards: int = N_SHARDS, repeats: int = REPEATS) -> DataFrame:
    """``plan`` with ``blocks`` (a source's blocks) and ``won``: blocks won after each of the shards, from 0 on."""
    t = plan.withColumn("blocks", F.ceil(F.col("source_size") / F.lit(block)).cast("long"))
    t = t.withColumn("total", F.round(F.col("mix") / block).cast("long"))
    t = t.withColumn("house", F.explode(F.sequence(F.lit(1), F.lit(n_shards))))
    t = t.withColumn("seats", F.floor(F.col("total") * F.col("house") / F.lit(n_shards)).cast("long"))
    part = F.col("target") / F.col("mix") * F.col("seats")
    t = t.withColumn("share", F.when(F.col("mix") > 0, part).otherwise(0.0))
    t = t.withColumn("base", F.least(F.floor(F.col("share") + 0.5).cast("long"), F.col("blocks") * repeats))
    house = Window.partitionBy("house")
    t = t.withColumn("open", F.col("seats") - F.sum("base").over(house))
    near = F.ceil(2 * F.col("share") / F.greatest(F.col("seats"), F.lit(1)) * (F.abs("open") + F.count(F.lit(1)).over(house))) + 2
    t = t.withColumn("near", F.least(F.abs("open"), near.cast("long")))
    step = F.explode(F.when(F.col("near") > 0, F.sequence(F.lit(0).cast("long"), F.col("near") - 1)))
    c = t.filter("near > 0").select("house", "rank", "target", "base", "blocks", "open", step.alias("i"))
    c = c.withColumn("k", F.when(F.col("open") > 0, F.col("base") + F.col("i")).otherwise(F.col("base") - 1 - F.col("i")))
    c = c.filter((F.col("k") >= 0) & (F.col("k") < F.col("blocks") * repeats))
    quotient = F.col("target") / (2 * F.col("k") + 1) * F.signum("open")
    tie = F.col("rank") * F.signum("open")
    c = c.withColumn("place", F.row_number().over(Window.partitionBy("house").orderBy(quotient.desc(), tie)))
    c = c.filter(F.col("place") <= F.abs("open")).groupBy("house", "rank").agg(F.sum(F.signum("open")).cast("long").alias("more"))
    t = t.join(c, ["house", "rank"], "left").withColumn("won", F.col("base") + F.coalesce("more", F.lit(0)))
    won = F.array_sort(F.collect_list(F.struct("house", "won")))
    out = t.groupBy("rank").agg(won.alias("won")).select("rank", F.concat(F.array(F.lit(0).cast("long")), F.col("won.won")).alias("won"))
    return plan.withColumn("blocks", F.ceil(F.col("source_size") / F.lit(block)).cast("long")).join(out, "rank")


def allocate(docs: DataFrame, block: int = BLOCK, n_shards: int = N_SHARDS, seed: int = SEED) -> DataFrame:
    """``docs`` with ``size``, ``source_size``, ``target``, ``pieces`` and ``taken``.

    ``pieces`` lists what the mix takes of the text, as word ranges with the
    output shard and the number of the copy.  Input columns with the name of a
    result column are replaced.
    """
    made = ["size", "source_size", "target", "pieces", "taken"]
    rest = [c for c in docs.columns if c not in made]
    h = F.xxhash64(F.lit(seed), F.col("doc_id"))
    h = F.when(F.col("doc_id").isNull(), F.xxhash64(F.lit(seed), F.col("text"))).otherwise(h)
    rows = docs.select(*rest, F.col("source").alias("__source"), word_count(F.col("text")).alias("size"), h.alias("__hash"))
    rows = rows.withColumn("__part", F.pmod(F.col("__hash"), F.lit(PARTS)).cast("int"))
    parts = checkpointed(rows.groupBy("__source", "__part").agg(F.sum("size").alias("__size")))
    plan = targets(parts.groupBy(F.col("__source").alias("source")).agg(F.sum("__size").alias("source_size")))
    plan = apportion(plan, block, n_shards).select(F.col("source").alias("__of"), "source_size", "target", "blocks", "won")
    before = Window.partitionBy("__source").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("__first", F.coalesce(F.sum("__size").over(before), F.lit(0)))
    parts = parts.join(plan, F.col("__source").eqNullSafe(F.col("__of"))).select(
        F.col("__source").alias("__of"), F.col("__part").alias("__in"), "__first",
        F.struct("source_size", "target", "blocks", "won").alias("__plan"))
    rows = rows.join(parts, F.col("__source").eqNullSafe(F.col("__of")) & (F.col("__part") == F.col("__in")))
    order = Window.partitionBy("__of", "__in").orderBy("__hash", F.col("doc_id").asc_nulls_last(), "size")
    ahead = F.coalesce(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("__from", F.col("__first") + ahead)
    rows = rows.select(*rest, "size", "__plan", "__from")
    won, blocks = F.col("__plan.won"), F.col("__plan.blocks")
    taken = F.element_at(won, -1)

    def of_block(b):
        start = F.greatest(b * block - F.col("__from"), F.lit(0).cast("long"))
        end = F.least((b + 1) * block - F.col("__from"), F.col("size"))
        copies = F.floor((taken - 1 - b) / blocks).cast("int")  # the last copy that is taken

        def of_copy(k):
            place = k * blocks + b
            shard = F.size(F.filter(won, lambda x: x <= place)) - 1
            return F.struct(shard.cast("int").alias("shard"), k.cast("int").alias("copy"), start.alias("word_start"), end.alias("word_end"))

        return F.when(b < taken, F.transform(F.sequence(F.lit(0), copies), of_copy)).otherwise(F.array().cast(PIECE))

    first, last = F.floor(F.col("__from") / block), F.floor((F.col("__from") + F.col("size") - 1) / block)
    pieces = F.flatten(F.transform(F.sequence(first, last), of_block))
    rows = rows.withColumn("pieces", F.when(F.col("size") > 0, pieces).otherwise(F.array().cast(PIECE)))
    total = F.aggregate("pieces", F.lit(0).cast("long"), lambda s, p: s + p["word_end"] - p["word_start"])
    return rows.select(*rest, "size", F.col("__plan.source_size").alias("source_size"), F.col("__plan.target").alias("target"),
                       "pieces", total.alias("taken"))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: a row of ``docs`` for each copy of a document, with the words that copy takes.

    The blocks that a copy takes of a document follow each other from its first
    word on, so a copy is the whole text or its first words.  ``n_chars`` is
    brought up to date where it is a column.
    """
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = allocate(docs.select("doc_id", "text", "source", whole.alias("__row")), **options)
    per_copy = F.aggregate("pieces", F.array(F.lit(0).cast("long"), F.lit(0).cast("long")), lambda s, p: F.when(
        p["copy"] == 0, F.array(s[0] + p["word_end"] - p["word_start"], s[1])).otherwise(
        F.array(s[0], s[1] + p["word_end"] - p["word_start"])))
    rows = rows.select("__row", "size", F.explode(per_copy).alias("words")).filter("words > 0")
    piece = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+[\x20\x09-\x0D]*"
    cut = F.array_join(F.slice(F.regexp_extract_all(F.col("__row.text"), F.lit(piece), 0), F.lit(1), F.col("words").cast("int")), "")
    text = F.when(F.col("words") >= F.col("size"), F.col("__row.text")).otherwise(cut)
    rows = rows.withColumn("__text", text)
    new = {"text": F.col("__text"), "n_chars": F.char_length("__text").cast("long")}
    return rows.select(*[new.get(c, F.col(f"__row.`{c}`")).alias(c) for c in docs.columns])


def digest(docs: DataFrame) -> DataFrame:
    """Contract columns of the mixing query."""
    return allocate(docs.select("doc_id", "text", "source")).select("doc_id", "size", "source_size", "target", "taken")
