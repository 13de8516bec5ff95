"""Near-duplicates of texts and of embeddings, and top-k, against brute force."""

import math
import random
from collections import defaultdict

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from larder.llm import embeddings, graph, neardup, topk

from .helpers import WORD, awkward, frame

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


class Sets:
    def __init__(self):
        self.up = {}

    def root(self, x):
        while self.up.setdefault(x, x) != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)


def shingles(text):
    words = WORD.findall((text or "").translate(LOWER))
    return frozenset({tuple(words)} if 0 < len(words) < 5 else {tuple(words[i:i + 5]) for i in range(len(words) - 4)})


def brute(rows, least=85, of=100):
    """{id: (set size, component)} of rows with an id."""
    sets, joined = {r[0]: shingles(r[1]) for r in rows if r[0] is not None}, Sets()
    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1:]:
            x, y = sets[a], sets[b]
            if x and y and of * len(x & y) >= least * len(x | y):
                joined.join(a, b)
    return {i: (len(sets[i]), joined.root(i)) for i in ids}


def words(rng, n):
    return [rng.choice("abcdefghij") + str(rng.randint(0, 400)) for _ in range(n)]


def near_rows(seed=4):
    rng = random.Random(seed)
    rows, at = [], 0

    def add(text, source="s"):
        nonlocal at
        rows.append((at, text, "en", source))
        at += 1

    for _ in range(30):  # small groups at all similarities
        base = words(rng, rng.choice([6, 12, 30, 120, 400]))
        for _ in range(4):
            own = list(base)
            for _ in range(rng.randint(0, max(1, len(own) // 40))):
                own[rng.randrange(len(own))] = "x" + str(rng.randint(0, 9999))
            add(" ".join(own).upper() if rng.random() < 0.3 else "\n".join(own))
    base = words(rng, 150)  # a large group of near copies, and exact ones
    for i in range(150):
        own = list(base)
        for _ in range(rng.randint(0, 4)):
            own[rng.randrange(len(own))] = "y" + str(rng.randint(0, 9999))
        add(" ".join(own if i % 3 else base))
    passage = words(rng, 60)  # a passage that many unlike texts share
    for _ in range(120):
        add(" ".join(words(rng, 40) + passage + words(rng, 40)))
    line = words(rng, 14)  # short texts about a common line
    for _ in range(120):
        add(" ".join(line + words(rng, rng.randint(0, 3))))
    for _ in range(100):
        add(" ".join(words(rng, rng.randint(0, 60))))
    add("Same words, same ORDER here")
    add("same words, same order here")
    add("four words only here")
    add("FOUR WORDS ONLY HERE")
    return rows


@pytest.mark.parametrize("seed", [4, 5])
def test_groups_equal_brute_force(spark, monkeypatch, seed):
    monkeypatch.setattr(neardup, "BLOCK", 40)
    rows = near_rows(seed)
    got = neardup.groups(frame(spark, rows).repartition(6)).collect()
    want = brute(rows)
    assert len(got) == len(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def brute_at(rows, part):
    """Components of rows with an id at any least similarity (a percentage)."""
    sets, joined = {r[0]: shingles(r[1]) for r in rows if r[0] is not None}, Sets()
    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1:]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= part * len(x | y):
                joined.join(a, b)
    return {i: joined.root(i) for i in ids}


def between_rows(seed=6):
    """Texts whose similarities lie about 0.8 and 0.85: a stretch of one is exchanged."""
    rng, rows = random.Random(seed), []
    for g in range(60):
        base = words(rng, rng.choice([25, 60, 150, 400]))
        n = len(base) - 4
        share = rng.choice([0.76, 0.79, 0.81, 0.83, 0.84, 0.86])
        gone = max(1, round(n * (1 - share) / (1 + share)) - 4)
        rows += [(2 * g, " ".join(base), "en", "s"), (2 * g + 1, " ".join([*base[:9], *(f"z{g}x{i}" for i in range(gone)), *base[9 + gone:]]), "en", "s")]
    return rows


@pytest.mark.parametrize("part", [80, 85])
def test_groups_at_either_threshold(spark, part):
    rows = near_rows(7) + [(10000 + r[0], *r[1:]) for r in between_rows()]
    got = {r.doc_id: r.component_id for r in neardup.groups(frame(spark, rows).repartition(6), (part, 100)).collect()}
    assert got == brute_at(rows, part)
    assert brute_at(rows, 80) != brute_at(rows, 85)


def test_pipeline_links_at_four_fifths(spark):
    import corpus_pipeline as c

    rows = between_rows()
    out = c.drop_near_duplicates(spark, frame(spark, rows), "")
    assert sorted(r.doc_id for r in out.collect()) == sorted(set(brute_at(rows, 80).values()))


@pytest.mark.parametrize("threshold", [(80, 100), (85, 100), (95, 100)])
def test_estimates_let_go_at_the_stated_chance(threshold):
    share, cut = threshold[0] / threshold[1], neardup.least_common(threshold)
    below = [sum(math.comb(64, i) * share**i * (1 - share) ** (64 - i) for i in range(c)) for c in (cut, cut + 1)]
    assert below[0] <= neardup.MISS < below[1]
    for common in (cut, cut - 1):
        # of the union's least 64 values, so many are common; the rest are the first text's own
        union = np.arange(1, 65, dtype=np.int64)
        a, b = union, np.concatenate([union[:common], np.arange(1000, 1064 - common, dtype=np.int64)])
        rows = pd.DataFrame({"value": [1, 1], "rep": [1, 2], "n": [1000, 1000], "sketch": [a, b], "posts": [a[:10], b[:10]]})
        found = pd.concat(neardup._estimated([rows], threshold))
        assert len(found) == (common == cut)


def test_lists_follow_the_threshold():
    assert neardup.posts((85, 100)) == (10, 8) and neardup.posts((80, 100)) == (13, 9)


def test_groups_of_awkward_rows(spark):
    rows = awkward()
    got = neardup.groups(frame(spark, rows)).collect()
    want = brute(rows)
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert r.kept and r.component_id is None
        else:
            assert (r.n_shingles, r.component_id) == want[r.doc_id]
    assert neardup.groups(frame(spark, [])).collect() == []


def test_one_of_each_group_stays(spark):
    rows = awkward() + [(300 + i, t, la, s) for i, (_, t, la, s) in enumerate(near_rows()[:60])]
    df = frame(spark, rows).withColumn("kept", F.lit("own")).withColumn("n", F.lit(0)).withColumn("rep", F.lit(1.0))
    out = neardup.deduplicated(df)
    assert out.columns == df.columns
    got = sorted((r.doc_id for r in out.collect()), key=lambda x: (x is None, x))
    want = sorted({c if n else i for i, (n, c) in brute(rows).items()})
    assert got == [*want, None]


def test_one_id_with_two_texts(spark):
    """They are documents of their own: groups of either text are found, and one document of each group stays."""
    rng = random.Random(9)
    a, b = words(rng, 200), words(rng, 200)
    near = lambda w: " ".join(w[:199] + ["changed"])
    rows = [(1, " ".join(a), "en", "s"), (1, " ".join(b), "en", "s"), (2, near(a), "en", "s"), (3, near(b), "en", "s"),
            (4, " ".join(words(rng, 50)), "en", "s"), (4, None, "en", "s"), (5, near(a), "en", "s"), (1, " ".join(b), "en", "s")]
    got = sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in neardup.groups(frame(spark, rows).repartition(3)).collect())
    assert got == [(1, 196, 1, True)] * 3 + [(2, 196, 1, False), (3, 196, 1, False), (4, 0, 4, True), (4, 46, 4, True), (5, 196, 1, False)]
    clashing = frame(spark, rows).selectExpr("*", "1 AS id", "2 AS h", "3 AS rows", "4 AS row", "5 AS __rows")
    out = neardup.deduplicated(clashing.repartition(3))
    assert out.columns == clashing.columns
    kept = sorted((r.doc_id, r.text or "") for r in out.collect())
    assert kept == sorted([(1, " ".join(a)), (1, " ".join(b)), (4, rows[4][1]), (4, "")])
    both = [(7, " ".join(a), "en", "s"), (7, near(a), "en", "s"), (8, near(a), "en", "s")]
    assert neardup.deduplicated(frame(spark, both)).count() == 1


def test_bands_meet_whatever_can_link(spark):
    """Every pair within the threshold's ratio of sizes meets in just one block."""
    sizes = [33, 34, 38, 39, 40, 46, 47, 55, 100, 117, 118, 1000, 1176, 1177, 5000] * 3
    frame_ = spark.createDataFrame([(i, n, 7) for i, n in enumerate(sizes)], "rep long, n long, value long")
    blocks, part = {}, {}
    for r in neardup._bands(frame_, (85, 100)).collect():
        blocks.setdefault((r.lower, r.upper), set()).add(r.rep)
        part[r.rep] = r.part
    for i, a in enumerate(sizes):
        for j in range(i):
            met = [k for k, who in blocks.items() if i in who and j in who and (k[0] == k[1] or part[i] != part[j])]
            assert len(met) == 1 if 100 * min(a, sizes[j]) >= 85 * max(a, sizes[j]) else len(met) <= 1


def test_union_estimate():
    rng = np.random.default_rng(1)
    for share in (0.6, 0.85, 0.95):
        a = np.unique(rng.integers(0, 2**63, 3000).astype(np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) < share], rng.integers(0, 2**63, 200).astype(np.uint64)]))
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        part, error, exact = neardup._union_estimate(a[:neardup.SKETCH], b[:neardup.SKETCH], len(a), len(b))
        assert not exact and abs(part - true) < 5 * max(error, 0.06)
        x, y = a[:30], a[10:40]
        assert neardup._union_estimate(x, y, 30, 30)[0] == 20 / 40 and neardup._union_estimate(x, y, 30, 30)[2]


def test_components_of_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(0, 60)]
    star = [(1000, 1000 + i) for i in range(1, 200)] + [(5000, 1100), (5001, 5000)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(chain[::-1] + star + star, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(61)) and all(got[x] == 1000 for x in [*range(1000, 1200), 5000, 5001])
    assert graph.components(spark.createDataFrame([], "a long, b long")).collect() == []


# ---- embeddings

def vectors(seed=2, dims=24):
    rng = np.random.default_rng(seed)
    rows = [(i, rng.normal(size=dims).tolist(), int(i % 4)) for i in range(300)]
    for g in range(12):
        base = rng.normal(size=dims)
        for i in range(2 + 8 * (g % 3)):
            rows.append((1000 + 50 * g + i, (base * rng.uniform(0.1, 5) + rng.normal(size=dims) * np.linalg.norm(base) * 0.025).tolist(), g % 4))
    hot = rng.normal(size=dims)
    rows += [(3000 + i, (hot + rng.normal(size=dims) * 0.13).tolist(), 1) for i in range(180)]
    rows += [(4000 + i, hot.tolist(), 1) for i in range(60)] + [(4100, (hot * 2).tolist(), 1), (4101, hot.tolist(), 2)]
    bad = [(5000, None, 1), (5001, [0.0] * dims, 1), (5002, [float("nan")] * dims, 1), (5003, [float("inf")] + [1.0] * (dims - 1), 1), (5004, [], 1),
           (5005, [None] + [1.0] * (dims - 1), 1), (5006, hot.tolist(), None), (None, hot.tolist(), 1), (3000, rows[[r[0] for r in rows].index(3000)][1], 1),
           (5007, [1e-170] * dims, 3), (5008, [1e170] * dims, 3), (5009, [1.0] * (dims - 1), 3)]
    return rows + bad


def brute_vectors(rows):
    dims = max(len(r[1] or []) for r in rows)
    use = [r for r in rows if r[0] is not None and r[2] is not None and r[1] and all(x is not None and math.isfinite(x) for x in r[1]) and any(r[1])]
    joined, links = Sets(), defaultdict(int)
    x = np.array([r[1] + [0.0] * (dims - len(r[1])) for r in use])
    x /= np.abs(x).max(axis=1, keepdims=True)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    c = x @ x.T
    for i in range(len(use)):
        for j in range(len(use)):
            if i != j and use[i][2] == use[j][2] and c[i, j] >= 0.98:
                links[i] += 1
                joined.join(use[i][0], use[j][0])
    return sorted((r[0], links[i], joined.root(r[0])) for i, r in enumerate(use))


def test_embedding_links_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "BLOCK", 50)
    rows = vectors()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("key", F.lit(1)).withColumn("n", F.lit("x"))
    got = embeddings.digest(df.repartition(5)).collect()
    assert len(got) == len(rows)
    want = brute_vectors(rows)
    linked = {w[0] for w in want}
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got if r.vec_id in linked) == want
    for r in got:
        if r.vec_id not in linked:
            assert (r.n_links, r.component_id, r.kept) == (0, r.vec_id, True)
        else:
            assert r.kept == (r.vec_id == r.component_id)


def test_embeddings_of_nothing(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert embeddings.digest(none).collect() == []
    bad = spark.createDataFrame([(1, None, 1), (2, [1.0], None)], "vec_id long, embedding array<float>, label int")
    assert sorted(tuple(r) for r in embeddings.digest(bad).collect()) == [(1, 0, 1, True), (2, 0, 2, True)]


def test_estimates_are_unbiased_within_their_errors():
    rng = np.random.default_rng(0)
    turn = embeddings.rotation(256, 32)
    assert np.allclose(turn.T @ turn, np.eye(32))
    a = embeddings.unit(rng.normal(size=(400, 32)))
    b = embeddings.unit(a + 0.1 * rng.normal(size=a.shape))
    ra, rb = a @ turn.T, b @ turn.T
    factor = np.abs(ra).sum(axis=1) / 16
    estimate = (np.sign(ra) * rb).sum(axis=1) / 16 / factor
    true = (a * b).sum(axis=1)
    error = np.sqrt((1 - factor**2) / factor**2 / 255)
    assert abs((estimate - true).mean()) < 0.01 and (np.abs(estimate - true) < embeddings.ERRORS * error).all()


def test_codes_are_short_unbiased_and_bound_their_errors():
    """As many signs as dimensions, four bits a dimension beside them; no pair over the threshold is lost, few others stay."""
    rng = np.random.default_rng(1)
    a = embeddings.unit(rng.normal(size=(1500, 64)))
    near = embeddings.unit(a + 0.02 * rng.normal(size=a.shape))
    both = np.concatenate([a, near])
    own = embeddings.encode(both, np.arange(len(both)))
    assert own["sign"].shape == (3000, 64) and own["steps"].max() == 15
    signs = own["sign"] * np.float32(2) - 1
    code = {"signs": signs, "total": signs.sum(axis=1), "steps": own["steps"].astype(np.float32), **{c: own[c] for c in ("factor", "low", "step")}}
    turned = both @ embeddings.rotation(64, 64).T
    assert abs((own["steps"] * own["step"][:, None] + own["low"][:, None] - turned).mean()) < 1e-3
    i = np.arange(1500)
    true = (a * near).sum(axis=1)
    assert embeddings.bounded(code, i, i + 1500, 0.98)[true >= 0.98].all() and (true >= 0.98).sum() > 500
    unlike = embeddings.bounded(code, np.repeat(i[:300], 300), np.tile(i[300:600], 300), 0.98)
    assert unlike.mean() < 0.005


def test_few_pairs_are_recomputed(spark):
    """Vectors move for pairs that the bound leaves; of the pairs that share a bucket those are few."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(1500, 64))
    x[1000:] = x[:500] + 0.01 * rng.normal(size=(500, 64))
    rows = [(i, 1, 1, [float(v) for v in r]) for i, r in enumerate(x)]
    reps = spark.createDataFrame(rows, "rep long, label int, copies long, x array<double>")
    found = embeddings.links(reps, 64, 1500).collect()
    n = sum(r.exact for r in found)
    assert 500 <= n <= 600 and sum(r.n for r in found) == 1000


def test_one_id_with_two_vectors(spark):
    rows = [(1, [1.0, 0.0], 1), (1, [0.0, 1.0], 1), (2, [1.0, 0.01], 1), (3, [0.01, 1.0], 1), (4, [-1.0, 0.0], 1), (1, [1.0, 0.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in embeddings.digest(df).collect())
    assert got == [(1, 1, 1, True), (1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), (3, 1, 1, False), (4, 0, 4, True)]


# ---- top-k

def top_rows(seed=7):
    rng = np.random.default_rng(seed)
    rows = [(i, rng.normal(size=20).round(2).tolist()) for i in range(400)]
    rows += [(1000 + i, rows[i % 3][1]) for i in range(30)]
    rows += [(2000, None), (2050, [float("nan")] * 20), (2051, [1.0, None] + [0.0] * 18), (None, [1.0] * 20), (350, rows[350][1]), (7, rows[7][1]),
             (3000, [0.5] * 10), (3050, [])]
    return rows


def brute_top(rows, k=5):
    use = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q in sorted({i for i, _ in use if i % 50 == 0}):
        own = min(v for i, v in use if i == q)
        found = sorted((-max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(own, v)))), i) for i, v in use if i != q)[:k]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(found)]
    return out


@pytest.mark.parametrize("blocks", [(3, 37), (64, 4096)])
def test_top_k_equals_brute_force(spark, monkeypatch, blocks):
    monkeypatch.setattr(topk, "QUERY_BLOCK", blocks[0])
    monkeypatch.setattr(topk, "ROW_BLOCK", blocks[1])
    rows = top_rows()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("rank", F.lit(1)).withColumn("block", F.lit("x"))
    got = sorted(tuple(r) for r in topk.digest(df.repartition(4)).select("query_id", "rank", "vec_id", "score").collect())
    assert got == brute_top(rows)


def test_top_k_of_few_and_large(spark):
    schema = "vec_id long, embedding array<double>"
    assert topk.digest(spark.createDataFrame([], schema)).collect() == []
    assert topk.digest(spark.createDataFrame([(50, [1.0])], schema)).collect() == []
    rows = [(0, [3e8, 1.0]), (1, [3e8, -7.0]), (2, [1.0, 1.0]), (3, [-3e8, 2.0])]
    got = sorted(tuple(r) for r in topk.digest(spark.createDataFrame(rows, schema)).select("query_id", "rank", "vec_id", "score").collect())
    assert got == brute_top(rows)


def test_top_k_of_one_id_with_two_vectors(spark):
    """The least of its vectors is the query, in Spark and in SQL; no block numbers stand in the plan."""
    import duckdb
    import pyarrow as pa

    rng = np.random.default_rng(6)
    rows = [(i % 150, [float(x) for x in rng.normal(size=8)]) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    out = topk.digest(df.repartition(5))
    assert "[0, 4294967296" not in out._jdf.queryExecution().optimizedPlan().toString()
    with duckdb.connect() as con:
        con.register("embeddings", pa.table({"vec_id": [r[0] for r in rows], "embedding": [r[1] for r in rows]}))
        want = sorted(con.sql(topk.ORACLE).fetchall())
    assert sorted(map(tuple, out.collect())) == want and len(want) == 15


def test_bounds_keep_the_best():
    rng = np.random.default_rng(3)
    c = np.floor(256 * rng.normal(size=(64, 3000)))
    q = np.floor(256 * rng.normal(size=64))
    c[:, 5:9] = q[:, None]
    at, score = topk.search(q, c, np.einsum("ij,ij->j", c, c), 5)
    true = q @ c
    best = np.lexsort((np.arange(3000), -true))[:5]
    assert set(best) <= set(at) and len(at) < 300 and np.array_equal(score, true[at])


def test_top_k_equals_sql(spark):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{sf}/embeddings.parquet')")
    want = sorted(con.execute(topk.ORACLE).fetchall())
    got = sorted(tuple(r) for r in topk.digest(spark.read.parquet(f"{sf}/embeddings.parquet")).select("query_id", "rank", "vec_id", "score").collect())
    assert got == want


def test_shingle_hashes_follow_the_words():
    a, b = "The quick brown fox jumps over it", "the\tQUICK brown\nfox  jumps over it"
    found = [v for _, _, v, _ in neardup.shingle_sets(pa.array([a, b]))][0]
    half = len(found) // 2
    assert np.array_equal(found[:half], found[half:]) and half == 3
