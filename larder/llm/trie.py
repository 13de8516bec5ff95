"""Conversation prefix trie: padded turn-id matrices, sorted and cut where a prefix changes.

A turn's id is the MD5 of its role and text.  A conversation is cut into blocks of ``WIDTH``
turns; a block is one row: the key of the prefix before it, and the ids of its turns.  Rows are
range-sharded by (prefix, first ids, conversation), so shards hold neighbours, and a hot prefix
or a group of equal conversations is spread over shards by the conversation.

In a shard, some ``CHUNK`` turns at a time become a matrix of id codes padded with 0.  A
``lexsort`` orders its rows; where a column differs from the row above, a change mask is set, and
OR-accumulated along the row it marks where a node of that depth starts.  ``reduceat`` over these
starts aggregates every depth at once: members, least member, ends.  What a subtree holds is
summed the same way, after a running sum along the row over the nodes that start there.

Nodes that touch an end of a chunk, or that a longer conversation leaves for its next block, are
only known in part.  These boundary nodes are recombined by key.  A boundary node belongs to its
least member; a member's own nodes are the end of its path, so sums along the paths of such
members, added up by node, give the subtrees.  No step walks the trie depth by depth.

The digest of the conversations that end in a node is one SHA-256 over their ids in order: ids
come in sorted pieces of ``PIECE`` from the shards, and one task reads the pieces of a node one
after the other without holding them.

Cases: a null role or text is an empty one; null turns come first, equal turns are ordered by
their id, repeated rows are turns of their own; rows without a conversation id take no part; a
conversation without turns ends in the root; an empty table has no node; texts and conversations
may have any length (a task holds blocks, not conversations); columns that are not read may have
any name.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larder.llm.common import checkpointed, crc32_sql, turn_id, word_count
from larder.llm.textvec import mixed

#: Turns in a row of the matrix, and turns of a chunk.
WIDTH, CHUNK = 32, 1 << 18
#: Turns of a row that its shard goes by, each an id of 16 bytes.
SHARD_TURNS, ID_BYTES = 4, 16
#: Turn numbers of a conversation that are put in order together, and ids in a piece of a digest.
SPAN, PIECE = 1024, 256
EMPTY_SHA = hashlib.sha256(b"").hexdigest()
#: Of the query: a conversation begins with fewer than MOST_SHARED turns of the one whose number SHARED_BY divides.
SHARED_BY, MOST_SHARED = 20, 4

COMPLETE, PARTIAL, PATH, ENDS, CREDIT = range(5)
FOUND = ("kind int, k1 long, k2 long, p1 long, p2 long, conv_id long, depth long, parent_conv_id long, n_convs long, "
         "ends long, words long, n_children long, n_leaves long, saved_tokens long, sha string")
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def placed(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, n) of each conversation, and its turns (conv_id, at, id, words), ``at`` from 0.

    A conversation's turns are numbered by spans of turn numbers, so a long one isn't ordered in one task.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turns = conversations.filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        turn_id(role, text).alias("id"), word_count(text).alias("words"))
    turns = checkpointed(turns.withColumn("span", F.coalesce(F.expr(f"turn div {SPAN}"), F.lit(-(1 << 62)))))
    whole = Window.partitionBy("conv_id")
    spans = turns.groupBy("conv_id", "span").agg(F.count(F.lit(1)).alias("__n"))
    spans = spans.select("conv_id", "span", F.sum("__n").over(whole).alias("n"),
                         (F.sum("__n").over(whole.orderBy("span")) - F.col("__n")).alias("first"))
    order = Window.partitionBy("conv_id", "span").orderBy(F.col("turn").asc_nulls_first(), "id")
    at = turns.join(spans.drop("n"), ["conv_id", "span"]).withColumn("at", F.col("first") + F.row_number().over(order) - 1)
    return spans.groupBy("conv_id").agg(F.max("n").alias("n")), at.select("conv_id", "at", "id", "words")


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Lengths (conv_id, n) and turns (conv_id, at, id, words) of the query's rebuilt conversations."""
    own, turns = placed(conversations)
    turns = checkpointed(turns)
    convs = own.select("conv_id", "n", (F.col("conv_id") - F.col("conv_id") % SHARED_BY).alias("base"),
                       (F.crc32(F.encode(F.col("conv_id").cast("string"), "UTF-8")) % MOST_SHARED).alias("h"))
    base = own.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    convs = convs.join(base, "base", "left").withColumn("lent", F.least("h", F.coalesce("base_n", F.lit(0))))
    convs = checkpointed(convs.select("conv_id", "base", "h", "lent", (F.col("lent") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("n")))
    rest = turns.join(convs, "conv_id").filter("at >= h").select("conv_id", (F.col("at") - F.col("h") + F.col("lent")).alias("at"), "id", "words")
    heads = turns.filter(f"at < {MOST_SHARED} and conv_id % {SHARED_BY} = 0").withColumnRenamed("conv_id", "base")
    lent = heads.join(convs.filter("lent > 0"), "base").filter("at < lent").select("conv_id", "at", "id", "words")
    return convs.select("conv_id", "n"), rest.union(lent)


def blocks(convs: DataFrame, turns: DataFrame, width: int = WIDTH) -> DataFrame:
    """Rows of the matrix: block, keys of the prefix before (s1, s2) and after (e1, e2), ids, words, length of the conversation.

    A prefix' key is the XOR of its turns' hashes, each with its place: it adds up over blocks in any order.
    """
    at = F.struct("at", "id", "words")
    rows = turns.groupBy("conv_id", F.floor(F.col("at") / width).alias("block")).agg(
        F.array_sort(F.collect_list(at)).alias("t"), F.bit_xor(F.xxhash64("at", "id")).alias("x1"), F.bit_xor(F.xxhash64("id", "at")).alias("x2"))
    rows = rows.select("conv_id", "block", "x1", "x2", F.unhex(F.array_join(F.col("t.id"), "")).alias("ids"),
                       F.transform("t.words", lambda w: w.cast("long")).alias("words"))
    rows = checkpointed(rows)
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    long = rows.join(convs.filter(F.col("n") > width).select("conv_id"), "conv_id", "left_semi")
    starts = long.select("conv_id", "block", F.coalesce(F.bit_xor("x1").over(before), F.lit(0)).alias("s1"),
                         F.coalesce(F.bit_xor("x2").over(before), F.lit(0)).alias("s2"))
    rows = rows.join(convs, "conv_id").join(starts, ["conv_id", "block"], "left")
    s1, s2 = F.coalesce("s1", F.lit(0)), F.coalesce("s2", F.lit(0))
    rows = rows.select("conv_id", "block", s1.alias("s1"), s2.alias("s2"), s1.bitwiseXOR(F.col("x1")).alias("e1"), s2.bitwiseXOR(F.col("x2")).alias("e2"),
                       F.col("n").alias("length"), "ids", "words")
    none = F.lit(0).cast("long")
    turnless = convs.filter("n = 0").select("conv_id", *[none.alias(c) for c in ("block", "s1", "s2", "e1", "e2", "length")],
                                            F.unhex(F.lit("")).alias("ids"), F.array().cast("array<long>").alias("words"))
    return rows.union(turnless)


def _gathered(batches, chunk):
    """Tables of about ``chunk`` turns, in order."""
    held, size = [], 0
    for b in batches:
        n = np.maximum(np.asarray(pc.binary_length(b.column("ids"))) // ID_BYTES, 1)
        ends, first = np.cumsum(n), 0
        while first < len(n):
            done = int(ends[first - 1]) if first else 0
            last = max(first + 1, int(np.searchsorted(ends, done + chunk - size, "right")))
            held.append(b.slice(first, last - first))
            size += int(ends[last - 1]) - done
            first = last
            if size >= chunk:
                yield pa.Table.from_batches(held)
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def _codes(ids: np.ndarray) -> np.ndarray:
    """Small numbers from 1 for ids of two halves: equal ones for equal ids."""
    order = np.lexsort((ids[:, 1], ids[:, 0]))
    new = np.ones(len(ids), bool)
    new[1:] = (ids[order[1:]] != ids[order[:-1]]).any(axis=1)
    out = np.empty(len(ids), np.int32)
    out[order] = np.cumsum(new)
    return out


def _pieces(conv: np.ndarray, most: int):
    return [(int(conv[i]), ",".join(map(str, conv[i:i + most].tolist()))) for i in range(0, len(conv), most)]


def _sha(conv: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, conv.tolist())).encode()).hexdigest()


def _filled(kind: int, n: int, **columns) -> pa.RecordBatch:
    arrays = {"kind": pa.array(np.full(n, kind, np.int32))}
    for field in FOUND.split(", ")[1:]:
        name, of = field.split()
        x = columns.get(name)
        if of == "string":
            arrays[name] = pa.nulls(n, pa.string()) if x is None else pa.array(x, pa.string())
        elif isinstance(x, pa.Array):
            arrays[name] = x
        else:
            arrays[name] = pa.nulls(n, pa.int64()) if x is None else pa.array(np.ascontiguousarray(x).view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64))
    return pa.RecordBatch.from_pydict(arrays)


def _nodes(batches, width, chunk):
    for table in _gathered(batches, chunk):
        table = table.combine_chunks()
        col = lambda name: table.column(name).to_numpy()
        buffers = table.column("ids").chunk(0)
        n_turn = np.asarray(pc.binary_length(buffers)).astype(np.int64) // ID_BYTES
        conv = col("conv_id")
        if (bare := n_turn == 0).any():  # conversations without turns end in the root
            found = _pieces(np.sort(conv[bare]), PIECE)
            zero = np.zeros(len(found), np.int64)
            yield _filled(ENDS, len(found), k1=zero, k2=zero, conv_id=np.array([x for x, _ in found]), sha=[x for _, x in found])
            table = table.filter(pa.array(~bare)).combine_chunks()
            if not table.num_rows:
                continue
            buffers, n_turn, conv = table.column("ids").chunk(0), n_turn[~bare], conv[~bare]
        ids = np.frombuffer(b"".join(buffers.to_pylist()), ">u8").reshape(-1, 2).astype(np.uint64)
        yield from _matrix(conv, col("block"), np.stack([col("s1"), col("s2")]).view(np.uint64), np.stack([col("e1"), col("e2")]).view(np.uint64),
                           col("length"), n_turn, ids, table.column("words").combine_chunks().flatten().to_numpy(), width)


def _matrix(conv, block, start, end, length, n_turn, ids, words, most):
    """Nodes of one chunk; its rows, of ``most`` turns at most, are neighbours in the order of the shards."""
    n, width = len(conv), int(n_turn.max())
    first = np.cumsum(n_turn) - n_turn
    row = np.repeat(np.arange(n), n_turn)
    place = np.arange(len(ids)) - np.repeat(first, n_turn)
    padded = np.zeros((n, width), np.int32)
    padded[row, place] = _codes(ids)
    word = np.zeros((n, width), np.int64)
    word[row, place] = words
    where = mixed(place.astype(np.uint64) + np.uint64(1))
    keys = np.zeros((2, n, width), np.uint64)
    keys[0, row, place] = mixed(ids[:, 0] + mixed(ids[:, 1] ^ where))
    keys[1, row, place] = mixed(ids[:, 1] + mixed(ids[:, 0] ^ mixed(where)))
    group = np.zeros(n, np.int64)
    group[1:] = np.cumsum((block[1:] != block[:-1]) | (start[:, 1:] != start[:, :-1]).any(axis=0))
    edge = np.zeros(n, bool)
    edge[[0, -1]] = True

    order = np.lexsort((conv, *padded.T[::-1], group))
    conv, block, length, n_turn, group, edge, padded, word = (x[order] for x in (conv, block, length, n_turn, group, edge, padded, word))
    start, end, keys = start[:, order], end[:, order], keys[:, order]
    changed = np.ones((n, width), bool)
    changed[1:] = (padded[1:] != padded[:-1]) | (group[1:] != group[:-1])[:, None]
    changed = np.logical_or.accumulate(changed, axis=1)
    keys = np.bitwise_xor.accumulate(keys, axis=2) ^ start[:, :, None]
    if width == most:  # what continues elsewhere goes by the key of the next block's prefix
        keys[:, :, -1] = end

    # entries by depth, then row; a node's entries are neighbours
    entry = np.flatnonzero((padded > 0).T.ravel())
    depth, row = entry // n, entry % n
    head = np.flatnonzero(changed.T.ravel()[entry])
    node = np.cumsum(changed.T.ravel()[entry]) - 1
    count = np.diff(np.append(head, len(entry)))
    least = np.minimum.reduceat(conv[row], head)
    ending = length[row] == block[row] * most + depth + 1
    ends = np.add.reduceat(ending.astype(np.int64), head)
    leaving = np.logical_or.reduceat(length[row] > (block[row] + 1) * most, head)
    cut = np.logical_or.reduceat(edge[row], head)[node]
    if width > SHARD_TURNS:  # deeper nodes lie in the shards as the node above that has the last turn shards go by
        grid = np.zeros((width, n), bool)
        grid.ravel()[entry] = cut
        deep = depth >= SHARD_TURNS
        cut[deep] = grid[SHARD_TURNS - 1, row[deep]]
    cut = cut[head]
    complete = ~(cut | leaving)
    depth_of, row_of = depth[head], row[head]
    text_words = word[row_of, depth_of]

    def summed(value, along=True):
        """Per node, the sum of ``value`` over the complete nodes that start in it."""
        grid = np.zeros((width + 1, n), np.int64)
        grid[depth_of, row_of] = np.where(complete, value, 0)
        grid = np.cumsum(grid[::-1], axis=0)[::-1] if along else np.roll(grid, -1, axis=0)
        return np.add.reduceat(grid[depth, row], head)

    saved = summed((count - 1) * text_words)
    leaves = summed((ends == count).astype(np.int64))
    children = summed(np.ones(len(head), np.int64), along=False)
    key = keys[:, row_of, depth_of]
    up = np.maximum(depth_of - 1, 0)
    above = np.where(depth_of > 0, keys[:, row_of, up], start[:, row_of])
    grid = np.zeros((width, n), np.int64)
    grid.ravel()[entry] = node
    upper = grid[up, row_of]
    known = (depth_of > 0) & ~cut[upper]
    parent = pa.array(least[upper], pa.int64(), mask=~known)
    level = block[row_of] * most + depth_of + 1

    # digests of what ends in a node that is whole here; of the others, sorted pieces
    sha = np.full(len(head), EMPTY_SHA, object)
    over, pieces = node[ending], []
    over_conv = conv[row[ending]]
    cuts = np.flatnonzero(np.diff(over, prepend=-1))
    for a, b in zip(cuts.tolist(), np.append(cuts[1:], len(over)).tolist()):
        at = int(over[a])
        if cut[at]:
            sha[at] = None
            pieces += [(at, *x) for x in _pieces(over_conv[a:b], PIECE)]
        else:
            sha[at] = _sha(over_conv[a:b])
    sha[cut] = None

    def some(kind, use, **more):
        return _filled(kind, int(use.sum()), **{k: (x.filter(pa.array(use)) if isinstance(x, pa.Array) else x[use]) for k, x in more.items()})

    stats = {"p1": above[0], "p2": above[1], "conv_id": least, "depth": level, "n_convs": count, "n_children": children, "n_leaves": leaves, "saved_tokens": saved, "sha": sha}
    yield some(COMPLETE, complete, parent_conv_id=parent, **stats)
    yield some(PARTIAL, ~complete, k1=key[0], k2=key[1], ends=ends, words=text_words, **stats)
    # the last node of the block before gets what is complete in this one
    credit = (depth_of == 0) & (level > 1)
    yield some(CREDIT, credit, k1=above[0], k2=above[1], n_children=complete.astype(np.int64), n_leaves=leaves, saved_tokens=saved)
    # paths of conversations that may own a boundary node
    open_entry = ~complete[node]
    own = length > (block + 1) * most
    np.logical_or.at(own, row[open_entry & (conv[row] == least[node])], True)
    use = open_entry & own[row]
    path = keys[:, row[use], depth[use]]
    yield _filled(PATH, int(use.sum()), k1=path[0], k2=path[1], conv_id=conv[row[use]], depth=(block[row] * most + depth + 1)[use])
    if pieces:
        at = np.array([x for x, _, _ in pieces])
        yield _filled(ENDS, len(at), k1=key[0][at], k2=key[1][at], conv_id=np.array([x for _, x, _ in pieces]), sha=[x for _, _, x in pieces])


def _digests(batches):
    """(k1, k2, sha) of pieces sorted by (k1, k2, first id), read one after the other."""
    now, digest = None, None
    for b in batches:
        out = []
        for k1, k2, ids in zip(*(b.column(c).to_pylist() for c in ("k1", "k2", "sha"))):
            if (k1, k2) != now:
                if now is not None:
                    out.append((*now, digest.hexdigest()))
                now, digest = (k1, k2), hashlib.sha256(ids.encode())
            else:
                digest.update(b"," + ids.encode())
        if out:
            yield pa.RecordBatch.from_pydict({c: pa.array(x) for c, x in zip(("k1", "k2", "sha"), zip(*out))})
    if now is not None:
        yield pa.RecordBatch.from_pydict({"k1": pa.array([now[0]]), "k2": pa.array([now[1]]), "sha": pa.array([digest.hexdigest()])})


def _boundary(found: DataFrame, width: int) -> DataFrame:
    """The boundary nodes, whole: keys and parent's keys, and COLUMNS without the digest and the parent."""
    key = ["k1", "k2"]
    parts = found.filter(F.col("kind") == PARTIAL).groupBy(*key).agg(
        F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"), F.max("p1").alias("p1"), F.max("p2").alias("p2"), F.sum("n_convs").alias("n_convs"),
        F.sum("ends").alias("ends"), F.max("words").alias("words"), F.sum("n_children").alias("children"), F.sum("n_leaves").alias("leaves"),
        F.sum("saved_tokens").alias("saved"), F.max("sha").alias("sha"))
    credit = found.filter(F.col("kind") == CREDIT).groupBy(*key).agg(
        F.sum("n_children").alias("c_children"), F.sum("n_leaves").alias("c_leaves"), F.sum("saved_tokens").alias("c_saved"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    nodes = parts.join(credit, key, "left")
    nodes = checkpointed(nodes.withColumn("v_saved", (F.col("n_convs") - 1) * F.col("words") + zero("c_saved"))
                         .withColumn("v_leaves", (F.col("ends") == F.col("n_convs")).cast("long") + zero("c_leaves"))
                         .withColumn("children", F.col("children") + zero("c_children")).drop("c_children", "c_leaves", "c_saved"))
    # along the paths of the owners: what they own from each depth on
    paths = found.filter(F.col("kind") == PATH).select("k1", "k2", "conv_id", "depth", F.floor((F.col("depth") - 1) / width).alias("block"))
    paths = paths.join(nodes.select(*key, "conv_id", "v_saved", "v_leaves"), [*key, "conv_id"], "left")
    paths = paths.select(*key, "conv_id", "depth", "block", zero("v_saved").alias("v_saved"), zero("v_leaves").alias("v_leaves"))
    after = Window.partitionBy("conv_id").orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    later = paths.groupBy("conv_id", "block").agg(F.sum("v_saved").alias("b_saved"), F.sum("v_leaves").alias("b_leaves"))
    later = later.select("conv_id", "block", *[zero(F.sum(c).over(after)).alias(c) for c in ("b_saved", "b_leaves")])
    onward = Window.partitionBy("conv_id", "block").orderBy(F.desc("depth"))
    paths = paths.join(later, ["conv_id", "block"]).select(*key, *[(F.sum(f"v_{c}").over(onward) + F.col(f"b_{c}")).alias(c) for c in ("saved", "leaves")])
    none = F.lit(0).cast("long")
    sums = (paths.filter("saved > 0 or leaves > 0").select(*key, "saved", "leaves", none.alias("children"))
            .union(nodes.select(*key, "saved", "leaves", "children"))
            .union(nodes.select(F.col("p1").alias("k1"), F.col("p2").alias("k2"), none, none, F.lit(1).cast("long"))))
    sums = sums.groupBy(*key).agg(*[F.sum(c).alias(n) for c, n in (("saved", "saved_tokens"), ("leaves", "n_leaves"), ("children", "n_children"))])
    return nodes.select(*key, "p1", "p2", "conv_id", "depth", "n_convs", "sha").join(sums, key)


def trie(convs: DataFrame, turns: DataFrame, width: int = WIDTH, chunk: int = CHUNK) -> DataFrame:
    """COLUMNS of every node, from lengths (conv_id, n) and turns (conv_id, at, id, words)."""
    spark = convs.sparkSession
    rows = blocks(convs, turns, width).withColumn("__lead", F.substring("ids", 1, SHARD_TURNS * ID_BYTES))
    order = ["block", "s1", "s2", "__lead", "conv_id"]
    rows = rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order).drop("__lead")
    found = checkpointed(rows.mapInArrow(lambda batches: _nodes(batches, width, chunk), FOUND))

    key = ["k1", "k2"]
    pieces = found.filter(F.col("kind") == ENDS).select(*key, "conv_id", "sha").repartition(*key).sortWithinPartitions(*key, "conv_id")
    ended = pieces.mapInArrow(_digests, "k1 long, k2 long, sha string").withColumnRenamed("sha", "ended")
    ended = checkpointed(ended)
    boundary = checkpointed(_boundary(found, width).join(ended, key, "left").withColumn("ends_sha256", F.coalesce("ended", "sha", F.lit(EMPTY_SHA))).drop("ended", "sha"))

    made = ["conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256", "p1", "p2"]
    complete = found.filter(F.col("kind") == COMPLETE).withColumnRenamed("sha", "ends_sha256")
    lower = complete.filter("parent_conv_id is null").select(*made).union(boundary.select(*made))
    upper = boundary.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    least = convs.agg(F.min("conv_id").alias("__least"), F.count(F.lit(1)).alias("__all"))
    lower = lower.join(upper, ["p1", "p2"], "left").crossJoin(F.broadcast(least))
    lower = lower.withColumn("parent_conv_id", F.when(F.col("depth") == 1, F.col("__least")).otherwise(F.col("parent_conv_id")))
    top = lower.filter("depth = 1").agg(F.count(F.lit(1)).alias("n_children"), F.sum("n_leaves").alias("leaves"), F.coalesce(F.sum("saved_tokens"), F.lit(0)).alias("saved_tokens"))
    turnless = ended.filter("k1 = 0 and k2 = 0").agg(F.coalesce(F.max("ended"), F.lit(EMPTY_SHA)).alias("ends_sha256"))
    root = least.filter("__all > 0").crossJoin(top).crossJoin(turnless).select(
        F.col("__least").alias("conv_id"), F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"),
        F.col("__all").alias("n_convs"), "n_children", F.coalesce("leaves", F.lit(1)).alias("n_leaves"), "saved_tokens", "ends_sha256")
    return complete.filter("parent_conv_id is not null").select(*COLUMNS).union(lower.select(*COLUMNS)).union(root.select(*COLUMNS))


def digest(conversations: DataFrame) -> DataFrame:
    """Contract columns of the prefix trie of the rebuilt conversations."""
    return trie(*rebuilt(conversations.select("conv_id", "turn", "role", "text")))


ORACLE = f"""
WITH own AS (
  SELECT conv_id, struct_pack(r := coalesce(role, ''), x := coalesce(text, '')) AS t,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, ''))) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
lists AS (SELECT conv_id, list(t ORDER BY pos) AS ts FROM own GROUP BY conv_id),
rebuilt AS (
  SELECT a.conv_id, list_concat(list_slice(coalesce(b.ts, a.ts[1:0]), 1, h), list_slice(a.ts, h + 1, len(a.ts))) AS ts
  FROM (SELECT *, {crc32_sql('conv_id::VARCHAR')} % 4 AS h FROM lists) a LEFT JOIN lists b ON b.conv_id = a.conv_id - a.conv_id % 20),
members AS (
  SELECT conv_id, d, md5(to_json(list_slice(ts, 1, d))::VARCHAR) AS k, d = len(ts) AS final, ts[d].x AS x
  FROM (SELECT conv_id, ts, unnest(range(0, len(ts) + 1)) AS d FROM rebuilt)),
nodes AS (
  SELECT d, k, min(conv_id) AS conv_id, count(*) AS n, count(*) FILTER (final) AS ends,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (final), '')) AS ends_sha256,
         CASE WHEN d = 0 THEN 0 ELSE (count(*) - 1) * len(regexp_extract_all(min(x), '[^\\x20\\x09-\\x0D]+')) END AS saved
  FROM members GROUP BY d, k),
below AS (
  SELECT m.d, m.k, sum((n.ends = n.n)::BIGINT) AS n_leaves, sum(n.saved) AS saved_tokens, count(*) FILTER (n.d = m.d + 1) AS n_children
  FROM nodes n JOIN members m ON m.conv_id = n.conv_id AND m.d <= n.d GROUP BY m.d, m.k)
SELECT n.conv_id, n.d AS depth, p.conv_id AS parent_conv_id, n.n AS n_convs, b.n_children, b.n_leaves::BIGINT AS n_leaves,
       b.saved_tokens::BIGINT AS saved_tokens, n.ends_sha256
FROM nodes n JOIN below b USING (d, k)
LEFT JOIN members u ON u.conv_id = n.conv_id AND u.d = n.d - 1 LEFT JOIN nodes p ON p.k = u.k AND p.d = u.d
"""
