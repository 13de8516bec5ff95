"""Near-duplicates among embeddings of equal label, by rotated binary codes.

A seeded random rotation turns a unit vector into a code of as many signs as it has dimensions
(at least ``LEAST_BITS``; it is filled up with zeros) and a correction factor, the product of the
turned vector and its code.  The turned vector is also kept in steps of four bits, rounded at
random so that its expectation is the vector.  For a pair, (code of a) . (steps of b) / factor(a)
is an unbiased estimate of their cosine, with an error of about
sqrt((1 - f^2) / f^2 / (bits - 1) + (step / 2 f)^2).  Pairs whose estimate lies more than
``ERRORS`` such errors under the threshold go; the others are recomputed exactly, in doubles.

Pairs meet in buckets: signs of another rotation are cut into groups of bits, and vectors of one
label with equal bits of some group share a bucket.  Bits and groups follow from the size of the
largest label, so that buckets of unlike vectors stay small and a pair at the threshold misses all
buckets with probability ``MISS`` at most.  A pair counts in its first common bucket only.

Buckets get codes, steps and factors first, not vectors.  Only members with some pair that its
bound leaves meet again with their vectors.  Equal vectors are one, with a number of copies.
Buckets with one vector go before anything else moves; a bucket of over ``BLOCK`` is cut in blocks
that meet pair by pair, so a task holds two blocks.  Links leave a bucket as sums per vector and a
spanning forest, never as all pairs.

Cases: vectors that are null, zero, or hold null or non-finite components, and
rows without label or id, link with nothing and are kept as their own component;
a shorter vector counts as filled up with zeros; repeated rows are vectors that
link with each other, and so may be rows of one id with unlike vectors, which the id
alone doesn't link; vectors may have any length (a task holds two blocks of them); an empty table gives an empty result.  Columns that are not
read may have any name.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.common import checkpointed
from larder.llm.graph import components
from larder.llm.textvec import BASE, mixed
from larder.llm.topk import valid

THRESHOLD = 0.98
MISS = 1e-7
ERRORS = 5.0
BLOCK = 512
SEED = 5
#: Pairs that are compared at once.
PAIRS = 16384
LEAST_BITS = 64


def shape(largest: int, threshold: float = THRESHOLD) -> tuple[int, int]:
    """Bits of a group and number of groups, for a largest label of so many vectors."""
    bits = max(8, math.ceil(math.log2(max(largest, 2))) + 3)
    meet = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(MISS) / math.log(1 - meet))


def rotation(length: int, dims: int) -> np.ndarray:
    """``dims`` orthonormal columns of a random rotation of ``length`` dimensions."""
    return np.linalg.qr(np.random.default_rng(SEED).normal(size=(length, dims)))[0]


def unit(x: np.ndarray) -> np.ndarray:
    # a power of two first: squares of very large or small components stay in range
    scale = np.exp2(-np.floor(np.log2(np.abs(x).max(axis=1, keepdims=True))))
    x = x * scale
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _dense(values, dims: int) -> np.ndarray:
    out = np.zeros((len(values), dims))
    for i, v in enumerate(values):
        out[i, :len(v)] = v
    return out


def code_bits(dims: int) -> int:
    return max(LEAST_BITS, 8 * math.ceil(dims / 8))


CODE = "keys binary, code binary, factor double, steps binary, low double, step double"


def encode(u: np.ndarray, rep: np.ndarray) -> dict[str, np.ndarray]:
    """Signs, factor, and four-bit steps of unit vectors; the rounding goes by the id and the place."""
    turned = u @ rotation(code_bits(u.shape[1]), u.shape[1]).T
    low = turned.min(axis=1)
    step = np.maximum((turned.max(axis=1) - low) / 15, 1e-300)
    place = (turned - low[:, None]) / step[:, None]
    chance = mixed(rep.astype(np.int64).view(np.uint64)[:, None] * np.uint64(BASE) + np.arange(turned.shape[1], dtype=np.uint64)) >> np.uint64(11)
    steps = np.clip(np.floor(place + chance * 2.0**-53), 0, 15).astype(np.uint8)
    return {"sign": turned > 0, "factor": np.abs(turned).sum(axis=1) / math.sqrt(turned.shape[1]), "steps": steps, "low": low, "step": step}


def _coder(dims: int, bits: int, groups: int):
    def code(frames):
        bucketing = rotation(max(bits * groups, dims), dims)[:bits * groups]
        weights = 1 << np.arange(bits, dtype=np.int64)
        for pdf in frames:
            if not len(pdf):
                continue
            u = unit(_dense(pdf["x"], dims))
            sign = u @ bucketing.T > 0
            own = encode(u, pdf["rep"].to_numpy(np.int64))
            half = own["steps"].reshape(len(u), -1, 2)
            packed = lambda x: [r.tobytes() for r in x]
            yield pd.DataFrame({"rep": pdf["rep"], "label": pdf["label"], "copies": pdf["copies"], "buckets": list(sign.reshape(len(u), groups, bits) @ weights),
                                "keys": packed(np.packbits(sign, axis=1)), "code": packed(np.packbits(own["sign"], axis=1)), "factor": own["factor"],
                                "steps": packed(half[:, :, 0] << 4 | half[:, :, 1]), "low": own["low"], "step": own["step"]})

    return code


def _first_links(labels: np.ndarray, n: int) -> np.ndarray:
    """Of links (pairs of places), those that join two trees: a spanning forest."""
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    keep = []
    for i, (a, b) in enumerate(labels):
        a, b = root(a), root(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
            keep.append(i)
    return np.array(keep, np.int64)


def _pairs(start: np.ndarray, size: np.ndarray):
    """Pairs of places within each run, some at a time."""
    place = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    later = np.repeat(size, size) - place - 1
    first = np.repeat(start, size) + place
    ends = np.cumsum(later)
    at = 0
    while at < len(first):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, "right")))
        n = later[at:stop]
        a = np.repeat(first[at:stop], n)
        yield a, a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n)
        at = stop


BLOCK_KEYS = ["label", "g", "key", "lower", "upper"]


def bounded(code: dict[str, np.ndarray], a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """May the pairs reach the threshold?  Estimates from the signs of a and the steps of b, with their errors."""
    n = code["signs"].shape[1]
    product = np.einsum("ij,ij->i", code["signs"][a], code["steps"][b]) * code["step"][b] + code["total"][a] * code["low"][b]
    f = code["factor"][a]
    error = np.sqrt(np.maximum(1 - f**2, 0) / f**2 / max(n - 1, 1) + (code["step"][b] / 2 / f) ** 2)
    return product / math.sqrt(n) / f + ERRORS * error >= threshold


def _left(pdf: pd.DataFrame, bits: int, groups: int, threshold: float):
    """Pairs of places in sorted rows, whole blocks of buckets, that the bound leaves."""
    unpacked = lambda c: np.unpackbits(np.frombuffer(b"".join(pdf[c]), np.uint8).reshape(len(pdf), -1), axis=1)
    weights = 1 << np.arange(bits, dtype=np.int64)
    keys = unpacked("keys")[:, :bits * groups].reshape(len(pdf), groups, bits) @ weights
    packed = np.frombuffer(b"".join(pdf["steps"]), np.uint8).reshape(len(pdf), -1)
    steps = np.stack([packed >> 4, packed & 15], axis=2).reshape(len(pdf), -1)
    signs = unpacked("code")[:, :steps.shape[1]] * np.float32(2) - 1
    code = {"signs": signs, "total": signs.sum(axis=1), "steps": steps.astype(np.float32), **{c: pdf[c].to_numpy() for c in ("factor", "low", "step")}}
    group = pdf["g"].to_numpy()
    part, lower, upper = (pdf[c].to_numpy() for c in ("part", "lower", "upper"))
    run = np.ones(len(pdf), bool)
    for c in BLOCK_KEYS:
        x = pdf[c].to_numpy()
        run[1:] &= x[1:] == x[:-1]
    run = ~run
    run[0] = True
    start = np.flatnonzero(run)
    for a, b in _pairs(start, np.diff(np.append(start, len(pdf)))):
        # two blocks meet: pairs within one block are compared where the block meets itself
        use = (lower[a] == upper[a]) | (part[a] != part[b])
        a, b = a[use], b[use]
        use = (keys[a] == keys[b]).argmax(axis=1) == group[a]
        a, b = a[use], b[use]
        use = bounded(code, a, b, threshold)
        yield a[use], b[use]


def _whole_blocks(frames):
    """Batches of sorted rows, gathered so that no block is cut."""
    held = None
    for pdf in frames:
        held = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
        if len(held) < 4 * BLOCK:
            continue
        # the last block may go on in the next batch
        last = held.iloc[-1]
        same = np.ones(len(held), bool)
        for c in BLOCK_KEYS:
            same &= (held[c] == last[c]).to_numpy()
        cut = int(same.argmax())
        if cut:
            yield held[:cut].reset_index(drop=True)
            held = held[cut:].reset_index(drop=True)
    if held is not None and len(held):
        yield held


def _candidates(bits: int, groups: int, threshold: float):
    """Entries that have some pair left."""
    def some(frames):
        for pdf in _whole_blocks(frames):
            has = np.zeros(len(pdf), bool)
            for a, b in _left(pdf, bits, groups, threshold):
                has[a] = has[b] = True
            yield pdf.loc[has, ["rep", "label", "g", "key", "part", "lower", "upper"]]

    return some


def _linker(dims: int, bits: int, groups: int, threshold: float):
    """Links of entries with their vectors: sums (a, a, n) and forests (a, b, 0); ``exact`` counts the recomputed pairs."""
    def link(frames):
        for pdf in _whole_blocks(frames):
            u = unit(_dense(pdf["x"], dims))
            rep, copies = pdf["rep"].to_numpy(np.int64), pdf["copies"].to_numpy(np.int64)
            links, found, exact = np.zeros(len(pdf), np.int64), [], 0
            for a, b in _left(pdf, bits, groups, threshold):
                exact += len(a)
                use = np.einsum("ij,ij->i", u[a], u[b]) >= threshold
                a, b = a[use], b[use]
                np.add.at(links, a, copies[b])
                np.add.at(links, b, copies[a])
                found.append(np.stack([a, b], axis=1))
            pairs = np.concatenate([np.zeros((0, 2), np.int64), *found])
            pairs = pairs[_first_links(pairs, len(pdf))]
            some = np.flatnonzero(links)
            yield pd.DataFrame({"a": rep[some], "b": rep[some], "n": links[some], "exact": np.zeros(len(some), np.int64)})
            yield pd.DataFrame({"a": rep[pairs[:, 0]], "b": rep[pairs[:, 1]], "n": np.zeros(len(pairs), np.int64), "exact": np.zeros(len(pairs), np.int64)})
            yield pd.DataFrame({"a": rep[:1], "b": rep[:1], "n": [0], "exact": [exact]})

    return link


def links(reps: DataFrame, dims: int, largest: int, threshold: float = THRESHOLD) -> DataFrame:
    """(a, b, n, exact) of distinct vectors (rep, label, copies, x): see ``_linker``."""
    bits, groups = shape(largest, threshold)
    label = dict(reps.dtypes)["label"]
    coded = checkpointed(reps.select("rep", "label", "copies", "x").mapInPandas(
        _coder(dims, bits, groups), f"rep long, label {label}, copies long, buckets array<long>, {CODE}"))
    entries = coded.select("rep", "label", F.posexplode("buckets").alias("g", "key"))
    buckets = entries.groupBy("label", "g", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    entries = entries.join(buckets, ["label", "g", "key"]).withColumn("parts", F.ceil(F.col("n") / BLOCK).cast("int"))
    entries = entries.withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))
    entries = entries.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    entries = entries.select("rep", "g", "key", "part", F.least("part", "other").alias("lower"), F.greatest("part", "other").alias("upper"))
    codes = coded.drop("buckets")
    dealt = lambda rows: rows.repartition(*BLOCK_KEYS).sortWithinPartitions(*BLOCK_KEYS)
    left = dealt(entries.join(codes.drop("copies"), "rep")).mapInPandas(
        _candidates(bits, groups, threshold), f"rep long, label {label}, g int, key long, part int, lower int, upper int")
    left = checkpointed(left)
    met = left.join(codes.drop("label"), "rep").join(reps.select("rep", "x"), "rep")
    return dealt(met).mapInPandas(_linker(dims, bits, groups, threshold), "a long, b long, n long, exact long")


def linked(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``vec_id``, ``n_links``, ``component_id`` and ``kept`` of every row."""
    rows = vectors.select("vec_id", "label", F.transform("embedding", lambda e: e.cast("double")).alias("x"))
    good = valid(rows.filter("label is not null"), "x", keep=("label",))
    good = good.filter(F.exists("x", lambda e: e != 0)).select("vec_id", "label", F.transform("x", lambda e: e + 0.0).alias("x"))
    good = checkpointed(good)
    reps = good.groupBy("label", "x").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("copies"))
    # a number of its own stands for each distinct vector, as one id may have several
    reps = checkpointed(reps.withColumn("rep", F.monotonically_increasing_id()))
    facts = reps.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.max(F.size("x")).alias("d")).agg(F.max("n"), F.max("d")).first()
    found = checkpointed(links(reps, facts[1] or 1, facts[0] or 1, threshold))
    counts = found.filter("n > 0").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n"))
    parts = components(found.filter("a <> b").select("a", "b")).withColumnRenamed("node", "rep")
    info = reps.join(counts, "rep", "left").join(parts, "rep", "left").select(
        "label", "x", "least", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component"))
    info = info.join(info.groupBy("component").agg(F.min("least").alias("component_id")), "component").drop("component", "least")
    done = good.join(info, ["label", "x"]).select("vec_id", "n_links", "component_id")
    zero = lambda: ~F.coalesce(F.exists("x", lambda e: e != 0), F.lit(False))
    bad = F.exists("x", lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == F.lit(float("inf"))))
    rest = rows.filter(F.col("vec_id").isNull() | F.col("label").isNull() | F.col("x").isNull() | F.coalesce(bad, F.lit(True)) | zero())
    out = done.union(rest.select("vec_id", F.lit(0).cast("long"), "vec_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def digest(vectors: DataFrame) -> DataFrame:
    """Contract columns of the embedding near-duplicate query."""
    return linked(vectors.select("vec_id", "label", "embedding"))
