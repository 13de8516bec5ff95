"""MinHash near-duplicates: bottom-k sketches from one hash function.

A text's set holds the hashes of its distinct five-word shingles (its whole
sequence of words as one shingle if it has fewer).  Texts with equal sets are one, a
set being known by its size and two sums of its hashes; a number of its own stands for
it until the components are found.  The sketch keeps the ``SKETCH`` least hashes.

Candidates come from inverted lists of retained values.  A text is entered under
its ``posts`` least retained values (so many as prove a common one, if it has few
shingles), taking values that over ``LIST`` texts retain last: they are passages
that many documents share, and texts that share little else needn't meet.  Texts
that consist of such values to ``SHARED`` or more are also entered under their least
common values.

- In a list of a value that few retain, each pair is estimated from the sketch of
  its union: the share of the union's least hashes that both have.  Pairs with fewer in
  common than all but ``MISS`` of the pairs at the threshold go; the others are
  verified on the full sets.
- In a list of a common value, texts bring their full sets.  A list of any length is cut
  by size: a link is only possible within a band of sizes or between neighbouring bands
  (a band's sizes differ by less than the threshold).  Bands are cut in blocks of ``BLOCK``
  that meet pair by pair; Jaccard similarities are exact there, and only a spanning forest
  of the links leaves.

A pair counts in its first common list only.  Nothing is capped: pairs of similar
texts are lost only if all their least values differ, or if the estimate falls so
low.  Lists and cut follow from the threshold, so that for a pair at the threshold the
chance of the first is about ``MISS`` and that of the second no more than it.
Components come from the verified links.

Cases: null, empty and wordless texts have empty sets, link with nothing and are
kept; rows without an id likewise; repeated rows are equal texts; rows of one id with
unlike texts are documents of their own, which the id alone doesn't link; ties in a
sketch can't occur, as sets are distinct; an empty table gives an empty result; texts may
have any length (a task holds one text's shingles).  Columns may have any name.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.common import checkpointed
from larder.llm.graph import components
from larder.llm.textvec import BASE, Words, chunks, mixed

SHINGLE = 5
#: The least similarity of a link, as a fraction of whole numbers: the contract's, where none is given.
THRESHOLD = (85, 100)
SKETCH, INDEX = 64, 32
LIST = 50
SHARED = 0.4
MISS = 1e-6
BLOCK = 1024


def posts(threshold: tuple[int, int]) -> tuple[int, int]:
    """Lists under which a text is entered, and common ones if it consists of such values.

    All of k least values differ with the chance (1 - similarity)^k.  Texts that aren't
    entered under common values have up to ``SHARED`` of them, and may differ in the others only.
    """
    apart = 1 - threshold[0] / threshold[1]
    count = lambda x: min(INDEX, math.ceil(math.log(MISS) / math.log(min(max(x, MISS), 0.99))))
    return count(apart / (1 - SHARED)), count(apart)


@functools.cache
def least_common(threshold: tuple[int, int]) -> int:
    """Of a union's ``SKETCH`` least hashes, so many or more are common to a pair at the threshold, but for a chance of ``MISS``."""
    share, below = threshold[0] / threshold[1], 0.0
    for common in range(SKETCH + 1):
        below += math.comb(SKETCH, common) * share**common * (1 - share) ** (SKETCH - common)
        if below > MISS:
            return common
    return SKETCH


def shingle_sets(texts: pa.Array):
    """Per chunk: first row, number of rows, the rows' distinct hashes one after another (sorted), and their numbers."""
    step = np.uint64(BASE)
    for first, data, offsets in chunks(texts):
        n = len(offsets) - 1
        words = Words(data, offsets)
        h, doc = words.hash, words.doc
        full = max(len(h) - SHINGLE + 1, 0)
        value = np.full(full, SHINGLE, np.uint64)
        for j in range(SHINGLE):
            value = mixed(value * step + h[j:j + full])
        inside = doc[:full] == doc[SHINGLE - 1:SHINGLE - 1 + full]
        value, owner = value[inside], doc[:full][inside]
        few = np.flatnonzero((words.count > 0) & (words.count < SHINGLE))
        if len(few):
            start = np.searchsorted(doc, few)
            whole = words.count[few].astype(np.uint64)
            for j in range(SHINGLE - 1):
                at = np.minimum(start + j, len(h) - 1)
                whole = np.where(j < words.count[few], mixed(whole * step + h[at]), whole)
            value, owner = np.concatenate([value, whole]), np.concatenate([owner, few])
        order = np.lexsort((value, owner))
        value, owner = value[order], owner[order]
        new = np.ones(len(value), bool)
        new[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
        value, owner = value[new], owner[new]
        yield first, n, value, np.bincount(owner, minlength=n)


def _sketches(batches):
    for b in batches:
        for first, n, value, count in shingle_sets(b.column("text")):
            start = np.cumsum(count) - count
            total = np.concatenate([[np.uint64(0)], np.cumsum(value)])
            other = np.concatenate([[np.uint64(0)], np.cumsum(mixed(value ^ np.uint64(BASE)))])
            kept = np.minimum(count, SKETCH)
            ends = np.cumsum(kept)
            place = np.arange(int(kept.sum())) - np.repeat(ends - kept, kept) + np.repeat(start, kept)
            offsets = pa.array(np.concatenate([[0], ends]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([
                b.column("doc_id").slice(first, n), b.column("h").slice(first, n), pa.array(count.astype(np.int64)),
                pa.array((total[start + count] - total[start]).view(np.int64)), pa.array((other[start + count] - other[start]).view(np.int64)),
                pa.ListArray.from_arrays(offsets, pa.array(value[place].view(np.int64)))], ["doc_id", "h", "n", "sum1", "sum2", "sketch"])


def _sets(batches):
    """(rep, shingles) of the texts whose sets are those that are asked for."""
    for b in batches:
        want = [b.column(c).to_pylist() for c in ("rep", "n", "sum1", "sum2")]
        for first, n, value, count in shingle_sets(b.column("text")):
            offsets = np.concatenate([[0], np.cumsum(count)])
            reps, sets = [], []
            for i in range(n):
                own = value[offsets[i]:offsets[i + 1]]
                rep, *known = (w[first + i] for w in want)
                if [len(own), *(int(x.view(np.int64)) for x in (own.sum(), mixed(own ^ np.uint64(BASE)).sum()))] == known:
                    reps.append(rep)
                    sets.append(own.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(reps, pa.int64()), pa.array(sets, pa.binary())], ["rep", "shingles"])


def _overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairs' intersections."""
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    new = np.ones(len(flat), bool)
    new[1:] = flat[1:] != flat[:-1]
    column = np.cumsum(new) - 1
    shared = np.bincount(column) > 1
    use = shared[column]
    column, owner = (np.cumsum(shared) - 1)[column[use]], owner[use]
    out = np.zeros((len(sets), len(sets)), np.float32)
    for at in range(0, int(shared.sum()), 4096):
        part = (column >= at) & (column < at + 4096)
        m = np.zeros((len(sets), min(4096, int(shared.sum()) - at)), np.float32)
        m[owner[part], column[part] - at] = 1
        out += m @ m.T
    return out


def _forest(a: np.ndarray, b: np.ndarray) -> list[int]:
    """Places of the links that join two trees."""
    parent: dict = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    keep = []
    for i, (x, y) in enumerate(zip(a.tolist(), b.tolist())):
        x, y = root(x), root(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
            keep.append(i)
    return keep


def _union_estimate(a: np.ndarray, b: np.ndarray, na: int, nb: int, threshold: tuple[int, int] = THRESHOLD) -> tuple[float, float, bool]:
    """Similarity estimated from the least hashes of the union, its standard error, and whether it is exact."""
    union = np.union1d(a, b)
    exact = na <= SKETCH and nb <= SKETCH
    if not exact:
        union = union[:SKETCH]
    both = np.intersect1d(a, b, assume_unique=True)
    part = np.searchsorted(both, union[-1], "right") / len(union)
    least = threshold[0] / threshold[1]
    return part, np.sqrt(least * (1 - least) / len(union)), exact


def _runs(frames, keys: list[str], least: int):
    """Batches of sorted rows, gathered so that no run of equal keys is cut."""
    held, size = [], 0
    for pdf in frames:
        held.append(pdf)
        size += len(pdf)
        if size < least:
            continue
        rows = pd.concat(held, ignore_index=True)
        change = np.zeros(len(rows), bool)
        for k in keys:
            x = rows[k].to_numpy()
            change[1:] |= x[1:] != x[:-1]
        cut = np.flatnonzero(change)
        if len(cut):
            yield rows[:cut[-1]]
            rows = rows[cut[-1]:]
        held, size = [rows], len(rows)
    if size:
        yield pd.concat(held, ignore_index=True)


def _estimated(frames, threshold):
    """Rows of rare lists, sorted by value, to pairs (a, b, exact) that may be similar."""
    for rows in _runs(frames, ["value"], 2048):
        value, rep, n = rows["value"].to_numpy(), rows["rep"].to_numpy(), rows["n"].to_numpy()
        sketch = [np.asarray(s, np.int64).view(np.uint64) for s in rows["sketch"]]
        posts = [np.asarray(p) for p in rows["posts"]]
        start = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1]]))
        out = []
        for s, e in zip(start, np.append(start[1:], len(rows))):
            for i in range(s, e):
                for j in range(i + 1, e):
                    if min(n[i], n[j]) * threshold[1] < max(n[i], n[j]) * threshold[0]:
                        continue
                    common = posts[i][np.isin(posts[i], posts[j])]
                    if common.min() != value[i]:
                        continue
                    part, _, exact = _union_estimate(sketch[i], sketch[j], n[i], n[j], threshold)
                    least = threshold[0] / threshold[1]
                    if part >= least - 1e-9 if exact else round(part * SKETCH) >= least_common(threshold):
                        out.append((rep[i], rep[j], exact))
        yield pd.DataFrame(out, columns=["a", "b", "exact"])


def _verified(frames, threshold):
    for pdf in frames:
        keep = []
        for x, y in zip(pdf["x"], pdf["y"]):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(threshold[1] * both >= threshold[0] * (len(x) + len(y) - both))
        yield pdf[["a", "b"]][np.array(keep, bool)]


def _met(frames, threshold):
    """Rows of common lists, sorted by (value, lower, upper) block, to spanning forests of the exact links."""
    for rows in _runs(frames, ["value", "lower", "upper"], 1):
        key = rows[["value", "lower", "upper"]].to_numpy()
        start = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]).any(axis=1)]))
        for s, e in zip(start, np.append(start[1:], len(rows))):
            block = rows[s:e].sort_values("n", kind="stable")
            sets = [np.frombuffer(x, np.uint64) for x in block["shingles"]]
            n, rep, part = block["n"].to_numpy(), block["rep"].to_numpy(), block["part"].to_numpy()
            cross = key[s][1] != key[s][2]
            a_all, b_all = [], []
            # texts by size: those too short or too long for each other needn't be compared
            for at in range(0, len(sets), 256):
                last = int(np.searchsorted(n, n[min(at + 255, len(n) - 1)] * threshold[1] / threshold[0], "right"))
                for to in range(at, last, 256):
                    left, right = np.arange(at, min(at + 256, len(sets))), np.arange(to, min(to + 256, len(sets)))
                    both = _overlaps([sets[i] for i in left] + [sets[i] for i in right])[:len(left), len(left):]
                    i, j = np.nonzero(threshold[1] * both >= threshold[0] * (n[left][:, None] + n[right][None, :] - both))
                    i, j = left[i], right[j]
                    use = (i < j) & ((part[i] != part[j]) if cross else True)
                    a_all.append(i[use])
                    b_all.append(j[use])
            a, b = np.concatenate(a_all), np.concatenate(b_all)
            keep = _forest(a, b)
            yield pd.DataFrame({"a": rep[a[keep]], "b": rep[b[keep]]})


def _posted(reps: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """Representatives with ``posts``: the values under which they are entered, and ``common``, those of them that many retain."""
    index = F.slice("sketch", 1, INDEX)
    least, least_common = posts(threshold)
    values = reps.select("rep", F.explode(index).alias("value"))
    often = values.groupBy("value").agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > LIST).select("value")
    often = checkpointed(often)
    own = values.join(often, "value").groupBy("rep").agg(F.collect_set("value").alias("often"))
    rows = reps.join(own, "rep", "left").withColumn("often", F.coalesce("often", F.array().cast("array<long>")))
    rare, common = F.array_except(index, "often"), F.array_intersect(index, "often")
    few = F.col("n") <= INDEX
    need = F.when(few, F.floor(F.col("n") * (threshold[1] - threshold[0]) / threshold[1]).cast("int") + 1).otherwise(least)
    shared = (F.size("common") >= SHARED * F.size(index)) & ~few
    rows = rows.withColumn("rare", rare).withColumn("common", common)
    under = F.concat(F.slice(F.concat("rare", "common"), F.lit(1), need), F.when(shared, F.slice("common", 1, least_common)).otherwise(F.array().cast("array<long>")))
    return rows.withColumn("posts", F.array_distinct(under)).select("rep", "n", "sketch", "posts", F.array_intersect("posts", "common").alias("common"))


SET = ["n", "sum1", "sum2"]


def _bands(entries: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """Entries of common lists by the blocks that meet: (rep, n, value, part, lower, upper), blocks numbered within a list."""
    # a little wider than the threshold, so that no rounding parts neighbours by two bands
    size = F.log("n") / math.log(1.001 * threshold[1] / threshold[0])
    entries = entries.withColumn("band", F.floor(size).cast("long"))
    bands = entries.groupBy("value", "band").agg(F.count(F.lit(1)).alias("size"))
    parts = bands.select("value", "band", F.ceil(F.col("size") / BLOCK).cast("int").alias("parts"), "size")
    # the band above, where the list has one: a list's bands are few, whatever its length
    above = parts.select("value", (F.col("band") - 1).alias("band"), F.col("parts").alias("above"))
    below = parts.select("value", (F.col("band") + 1).alias("band"), F.col("parts").alias("below"))
    parts = parts.join(above, ["value", "band"], "left").join(below, ["value", "band"], "left")
    parts = parts.filter("size > 1 or above is not null or below is not null").drop("size")
    rows = entries.join(parts, ["value", "band"]).withColumn("own", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))
    block = lambda band, part: band * F.lit(1 << 32) + part
    row = lambda band, n: F.transform(F.sequence(F.lit(0), n - 1), lambda p: block(band, p))
    none = F.array().cast("array<long>")
    others = F.concat(row(F.col("band"), F.col("parts")), F.when(F.col("above").isNull(), none).otherwise(row(F.col("band") + 1, F.col("above"))),
                      F.when(F.col("below").isNull(), none).otherwise(row(F.col("band") - 1, F.col("below"))))
    rows = rows.select("rep", "n", "value", block(F.col("band"), F.col("own")).alias("part"), F.explode(others).alias("other"))
    return rows.select("rep", "n", "value", "part", F.least("part", "other").alias("lower"), F.greatest("part", "other").alias("upper"))


def _grouped(docs: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """(doc_id, h, n, first) of every row of ``docs`` (doc_id, text): ``h`` a hash of the text, ``first`` the least (doc_id, h) of its group."""
    at = lambda f: lambda frames: f(frames, threshold)
    docs = docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"))
    slim = checkpointed(docs.mapInArrow(_sketches, "doc_id long, h long, n long, sum1 long, sum2 long, sketch array<long>"))
    some = slim.filter("n > 0 and doc_id is not null")
    reps = some.groupBy(*SET).agg(F.min(F.struct("doc_id", "h", "sketch")).alias("least"))
    reps = checkpointed(reps.select(F.monotonically_increasing_id().alias("rep"), *SET, "least.doc_id", "least.h", "least.sketch"))
    rows = checkpointed(_posted(reps.select("rep", "n", "sketch"), threshold))

    entries = rows.select("rep", F.explode(F.array_except("posts", "common")).alias("value"))
    lists = entries.groupBy("value").agg(F.count(F.lit(1)).alias("__n")).filter("__n > 1").select("value")
    entries = entries.join(lists, "value").join(rows.select("rep", "n", "sketch", "posts"), "rep")
    entries = entries.repartition("value").sortWithinPartitions("value")
    pairs = checkpointed(entries.mapInPandas(at(_estimated), "a long, b long, exact boolean"))
    met = checkpointed(_bands(rows.select("rep", "n", F.explode("common").alias("value")), threshold))

    # full sets, of the texts that are in question only
    open_pairs = pairs.filter("not exact").select("a", "b")
    needed = open_pairs.select(F.col("a").alias("rep")).union(open_pairs.select("b")).union(met.select("rep")).distinct()
    needed = reps.drop("sketch").join(needed, "rep", "left_semi")
    sets = docs.join(needed, ["doc_id", "h"]).select("text", "rep", *SET).mapInArrow(_sets, "rep long, shingles binary")
    sets = checkpointed(sets.dropDuplicates(["rep"]))
    x = sets.select(F.col("rep").alias("a"), F.col("shingles").alias("x"))
    y = sets.select(F.col("rep").alias("b"), F.col("shingles").alias("y"))
    proven = open_pairs.join(x, "a").join(y, "b").mapInPandas(at(_verified), "a long, b long")

    met = met.join(sets, "rep").repartition("value", "lower", "upper").sortWithinPartitions("value", "lower", "upper")
    links = proven.union(pairs.filter("exact").select("a", "b")).union(met.mapInPandas(at(_met), "a long, b long"))

    parts = components(links).withColumnRenamed("node", "rep")
    info = reps.join(parts, "rep", "left").select(*SET, F.struct("doc_id", "h").alias("own"), F.coalesce("component", "rep").alias("component"))
    info = info.join(info.groupBy("component").agg(F.min("own").alias("first")), "component").select(*SET, "first")
    done = some.select("doc_id", "h", *SET).join(info, SET).select("doc_id", "h", "n", "first")
    return done.union(slim.filter("n = 0 or doc_id is null").select("doc_id", "h", "n", F.struct("doc_id", "h")))


def groups(docs: DataFrame, threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of ``docs`` (doc_id, text)."""
    component = F.col("first.doc_id")
    return _grouped(docs, threshold).select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"),
                                            F.col("doc_id").eqNullSafe(component).alias("kept"))


def deduplicated(docs: DataFrame, threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """One document of each group, columns as they were: the least id's; of rows with equal id and text one stays, as do rows without an id."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    found = _grouped(docs, threshold).filter(F.col("doc_id").isNotNull() & (F.struct("doc_id", "h") == F.col("first")))
    kept = checkpointed(found.groupBy("doc_id", "h").agg(F.count(F.lit(1)).alias("rows")))
    rows = docs.select(whole, F.col("doc_id").alias("id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"))
    same = rows.join(kept.withColumnRenamed("doc_id", "id"), ["id", "h"])
    one, many = same.filter("rows = 1").select("row"), same.filter("rows > 1").dropDuplicates(["id", "h"]).select("row")
    return one.union(many).union(rows.filter("id is null").select("row")).select("row.*")
