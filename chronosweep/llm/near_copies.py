"""Near copies: documents linked by a Jaccard similarity of word shingles of 0.8 or more.

SimHash with a self-join of binary tries finds who may be alike, whole shingle sets decide.
Documents of one shingle set are one node, with a fingerprint of ``WIDE`` bits: each bit the
majority over a hash of its shingles.  Two sets at the threshold differ in 15 of 100 bits
(two of four and five shingles, the worst, in 19), too many for one trie with a budget to
drop anything.  So there are many tries: each takes other 64 bits of the fingerprint, deals
them by its upper levels, walks only nodes together that agree in the upper ``depth`` levels
and adds up differing bits below, up to ``BUDGET``.  Depth and number of tries follow the
number of nodes, so that a pair at the threshold is expected in ``MEETINGS`` of them and
a node of depth holds few leaves.

Each task contracts the links of its subtrees to groups, and a group that several tries
find is one.  A large group of near copies is found by each trie in other parts, so groups
of ``JOINED`` and more nodes that share some become one cluster, which holds each node once
in place of once a trie, unless its pairs are more than those of its groups.  Groups that lie
in one cluster go, as all nodes of a cluster meet.

Sets are worked out and sent for nodes of groups only.  They are compared inside tasks, which
hand on one link for every two components that they join, never pairs: a first round joins
what it can within blocks of the clusters and of the groups of a few tries, and a second
compares what has not met yet, only nodes that stand in different components after the first.
Groups of many nodes are cut into blocks, and each pair of blocks that holds several
components is a task of its own.  No link is left out; what still grows with the square is
the comparing inside tasks of nodes that share a group and belong to no common component.  A
node is sent once for each block of a value: up to ``SPREAD`` times, or more where a value
holds more than so many times ``HEAVY`` shingles, which no task takes at once.

Defined results: null, empty and blank texts have the same, empty set; texts of fewer
words are one shingle of all their words; letters are compared in lower case (ASCII);
shingles are compared by 64-bit hashes; null ids come last; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronosweep.llm.common import cut, forget, slices, text_of
from chronosweep.llm.components import components, roots
from chronosweep.llm.simhash import BITS, PAIRS, shingle_hashes, subtree_links

WORDS = 5
#: Bits of a fingerprint, tries in which a pair at the threshold is expected to agree above, differing bits below.
WIDE, MEETINGS, BUDGET = 1024, 17.8, 13
#: Share of bits in which two sets at the threshold agree.
AGREE = 0.8485
#: Leaves that a node of the depth is meant to hold, and a task; parts of more than CROWD are cut into blocks.
LEAVES, DEALT, CROWD = 512, 1 << 16, 1 << 18
#: Sets of fewer shingles are in more tries, as their majorities hang on a few.
SMALL, MORE = 6, 1.5
#: Tries of the first round.
FIRST = 8
#: Nodes of a group that joins a cluster.
JOINED = 8
#: Nodes and shingles of a value that make a block, and shingles that share a task's call.
BLOCK, HEAVY, UNIT = 1000, 1 << 20, 1 << 21
#: Blocks that a value is cut into for the sake of its nodes, each of which is sent once a block; more only for its shingles.
SPREAD = 8
#: Nodes whose numbers may be sent to all tasks.
SENT = 2_000_000
SEED = 4
_draw = np.random.default_rng(SEED).integers(1, 1 << 63, (2, WIDE // 64), dtype="u8")
_TIMES, _PLUS = _draw[0] * np.uint64(2) + np.uint64(1), _draw[1]
_PRIME = np.uint64(0x9E3779B97F4A7C15)
#: Shingles whose bits are added up at once, in bytes.
STRETCH = 255


def shingle_set(text: str, words: int = WORDS) -> np.ndarray:
    return np.unique(np.array(shingle_hashes(text, words), "u8"))


def wide_print(shingles: np.ndarray) -> np.ndarray:
    """The bytes of a fingerprint: each bit is 1 if set in over half of the shingles' hashes."""
    ones = np.zeros(WIDE, np.int32)
    for at in range(0, len(shingles), STRETCH):
        hashed = shingles[at : at + STRETCH, None] * _TIMES + _PLUS
        hashed = (hashed ^ hashed >> np.uint64(31)) * _PRIME
        hashed ^= hashed >> np.uint64(29)
        ones += np.unpackbits(hashed.view("u1"), axis=1).sum(0, dtype="u1")
    return np.packbits(2 * ones > len(shingles))


def shape(n: int) -> tuple[int, int]:
    """Depth and number of tries for n nodes."""
    depth = min(32, max(12, math.ceil(math.log2(max(n, 1) / LEAVES))))
    return depth, math.ceil(MEETINGS / AGREE**depth)


def trie_bits(tries: int) -> np.ndarray:
    """Which bits of a fingerprint each trie takes, from the top down."""
    rng = np.random.default_rng(SEED + 1)
    return np.array([rng.choice(WIDE, BITS, replace=False) for _ in range(tries)])


def trie_prints(wide: np.ndarray, taken: np.ndarray) -> np.ndarray:
    """(rows, tries): the 64-bit fingerprints of rows (rows, bytes) in each trie."""
    bits = np.unpackbits(wide, axis=1)
    out = np.zeros((len(wide), len(taken)), "u8")
    for k, at in enumerate(taken):
        out[:, k] = np.packbits(bits[:, at].ravel()).view(">u8")
    return out


def band_values(shingles: np.ndarray, n: int = 1) -> np.ndarray:
    """The node of the depth that a set stands in, for each trie of n nodes, or none for an empty set."""
    if not len(shingles):
        return np.zeros(0, "i8")
    depth, tries = shape(n)
    return (trie_prints(wide_print(shingles)[None], trie_bits(tries))[0] >> np.uint64(BITS - depth)).astype("i8")


def _sketches(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in slices(batches):
            sets = [shingle_set(t, words) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([xxhash.xxh3_128_digest(s) for s in sets], pa.binary()), pa.array([len(s) for s in sets], pa.int32()), pa.array([wide_print(s).tobytes() for s in sets], pa.binary())], ["key", "digest", "n", "print"])

    return run


def _leaves(tries: int, upper: int):
    """Rows (node, n, print) to a row for each trie, parted by its upper levels."""

    def rows(batch: pa.RecordBatch, first: int, taken: np.ndarray) -> pa.RecordBatch:
        prints = trie_prints(np.frombuffer(b"".join(batch.column(2).to_pylist()), "u1").reshape(-1, WIDE // 8), taken).T.ravel()
        trie = first + np.repeat(np.arange(len(taken)), batch.num_rows)
        part = trie << upper | (prints >> np.uint64(1) >> np.uint64(BITS - 1 - upper)).astype(np.int64)
        node, n = (np.tile(batch.column(c).to_numpy(), len(taken)) for c in (0, 1))
        return pa.RecordBatch.from_arrays([pa.array(part), pa.array(prints.view("i8")), pa.array(node), pa.array(n)], ["part", "fp", "node", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        taken = trie_bits(math.ceil(MORE * tries))
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                yield rows(batch, 0, taken[:tries])
                small = batch.filter(pc.less(batch.column(1), SMALL))
                if small.num_rows:
                    yield rows(small, tries, taken[tries:])

    return run


def _groups(depth: int, upper: int):
    """value, node, n, trie, least, k: nodes that links within the budget join in one part of a trie; the value names the group by its nodes, of which there are k."""

    def run(part: pa.Table) -> pa.Table:
        fp, node, n = part.column("fp").to_numpy().view("u8"), part.column("node").to_numpy(), part.column("n").to_numpy()
        order = np.lexsort((node, fp))
        fp, node, n = fp[order], node[order], n[order]
        root = np.arange(len(fp))
        for i, j in subtree_links(fp, depth, BUDGET):
            for at in range(0, len(i), PAIRS // 4):
                x, y = i[at : at + PAIRS // 4], j[at : at + PAIRS // 4]
                near = (root[x] != root[y]) & (5 * np.minimum(n[x], n[y]) >= 4 * np.maximum(n[x], n[y]))
                if near.any():
                    every = np.arange(len(root))
                    root = roots(len(root), np.concatenate([every, x[near]]), np.concatenate([root, y[near]]))
        members = np.flatnonzero(np.bincount(root, minlength=len(root))[root] > 1)
        members = members[np.lexsort((node[members], root[members]))]
        edges = np.flatnonzero(np.diff(root[members], prepend=-1, append=-1))
        sizes = np.diff(edges)
        names = np.array([xxhash.xxh3_64_intdigest(node[members[lo:hi]].tobytes()) for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)], "u8").view("i8")
        trie = part.column("part")[0].as_py() >> upper
        least = node[members[edges[:-1]]]
        columns = {"value": np.repeat(names, sizes), "node": node[members], "n": n[members], "trie": np.full(len(members), trie), "least": np.repeat(least, sizes), "k": np.repeat(sizes, sizes)}
        return pa.table({c: pa.array(v, pa.int32() if c in ("n", "trie", "k") else pa.int64()) for c, v in columns.items()})

    return run


def _blocked(leaves: DataFrame, count: int) -> DataFrame:
    """leaves with i, j: which two blocks of its part a row meets in.  Every two blocks meet, so each pair of rows does."""
    if count <= CROWD:  # a part holds a node once
        return leaves.withColumns({"i": F.lit(0), "j": F.lit(0)})
    # fewer rows than tries times count / CROWD
    crowded = cut(leaves.groupBy("part").agg(F.ceil(F.count("*") / F.lit(CROWD)).alias("blocks")).where("blocks > 1"))
    sized = leaves.join(F.broadcast(crowded), "part", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    dealt = sized.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks"))).withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    return dealt.select("part", "fp", "node", "n", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"))


def trie_groups(classes: DataFrame) -> DataFrame:
    """value, node, n, trie, least, k: groups of nodes that a trie finds, each once with the first trie that does.  classes: node, n, print."""
    count = classes.count()
    depth, tries = shape(count)
    upper = min(depth, max(0, math.ceil(math.log2(max(count, 1) / DEALT))))
    # an empty set is like no other
    leaves = classes.where("n > 0").select("node", "n", "print").mapInArrow(_leaves(tries, upper), "part long, fp long, node long, n int")
    found = _blocked(leaves, count).groupBy("part", "i", "j").applyInArrow(_groups(depth, upper), "value long, node long, n int, trie int, least long, k int")
    return found.groupBy("value", "node").agg(F.first("n").alias("n"), F.min("trie").alias("trie"), F.first("least").alias("least"), F.first("k").alias("k"))


def clustered(groups: DataFrame) -> DataFrame:
    """value, node, n, trie: clusters of groups that share nodes in place of the groups.  Every two nodes of a group share a value as before.  groups: as trie_groups gives them."""
    large, small = groups.where(F.col("k") >= JOINED), groups.where(F.col("k") < JOINED)
    placed = cut(components(large.select(F.col("least").alias("a"), F.col("node").alias("b"))))
    pairs = large.where("node = least").join(placed, "node").groupBy("component").agg(F.sum(F.col("k").cast("double") * F.col("k")).alias("pairs"))
    worth = placed.groupBy("component").agg(F.count("*").cast("double").alias("size")).join(pairs, "component").where("size * size <= pairs").select("component")
    placed = cut(placed.join(worth, "component", "left_semi").select("node", "component"))
    clusters = large.select("node", "n").distinct().join(placed, "node").select(F.xxhash64("component").alias("value"), "node", "n", F.lit(0).alias("trie"))
    others = large.join(placed.select(F.col("node").alias("least")), "least", "left_anti")
    within = small.join(placed, "node", "left").groupBy("value").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("component").alias("held"), F.first("k").alias("k")).where("low = high AND held = k")
    columns = ["value", "node", "n", "trie"]
    return clusters.unionByName(others.select(columns)).unionByName(small.join(within, "value", "left_anti").select(columns))


def _sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingle_set(t, words).view("i8") for t in batch.column(1).to_pylist()], pa.list_(pa.int64()))], ["node", "held"])

    return run


def _joining(ids: np.ndarray, starts: np.ndarray, sizes: np.ndarray, group: np.ndarray, left: np.ndarray, right: np.ndarray) -> Iterator[tuple[int, int]]:
    """Links (place, place) that join the groups of sets with others alike.  ids: the sets' shingles one after another, numbered; left, right: which sets meet."""
    same, seen = bool((left == right).all()), np.zeros(int(ids.max()) + 1, bool)
    for a in np.flatnonzero(left):
        apart = right & (group != group[a]) & (5 * np.minimum(sizes, sizes[a]) >= 4 * np.maximum(sizes, sizes[a]))
        if same:
            apart[: a + 1] = False
        near = np.flatnonzero(apart)
        if not len(near):
            continue
        own = ids[starts[a] : starts[a] + sizes[a]]
        seen[own] = True
        if 8 * len(near) < len(sizes):
            both = np.array([np.count_nonzero(seen[ids[starts[b] : starts[b] + sizes[b]]]) for b in near])
        else:
            both = np.add.reduceat(seen[ids].astype(np.int32), starts)[near]
        seen[own] = False
        for b in near[5 * both >= 4 * (sizes[a] + sizes[near] - both)]:
            if group[b] != group[a]:
                yield int(a), int(b)
                group[group == group[b]] = group[a]


def _compare(unit: pa.Table) -> pa.Table:
    """a, b: nodes of one unit whose link joins two groups."""
    unit = unit.sort_by("value")
    value, node, chunk, component = (unit.column(c).to_numpy() for c in ("value", "node", "chunk", "component"))
    i, j = unit.column("i")[0].as_py(), unit.column("j")[0].as_py()
    held = unit.column("held").combine_chunks()
    flat, bounds = held.flatten().to_numpy(), held.offsets.to_numpy() - held.offsets[0].as_py()
    edges = np.flatnonzero(np.diff(value, prepend=value[0] - 1, append=value[-1] + 1))
    found: list[tuple[int, int]] = []
    for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        if hi - lo < 2 or (component[lo:hi] == component[lo]).all():
            continue
        _, ids = np.unique(flat[bounds[lo] : bounds[hi]], return_inverse=True)
        every = np.ones(hi - lo, bool)
        left, right = (every, every) if i == j else (chunk[lo:hi] == i, chunk[lo:hi] == j)
        starts = bounds[lo:hi] - bounds[lo]
        found += [(node[lo + a], node[lo + b]) for a, b in _joining(ids, starts, np.diff(bounds[lo : hi + 1]), component[lo:hi].copy(), left, right)]
    return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})


def _links(shared: DataFrame, sets: DataFrame, across: bool) -> DataFrame:
    """a, b: what the comparing of `shared` (value, blocks, chunk, node, n, trie, component) finds: within blocks, or across them and within those that the first round left out."""
    units = max(1, math.ceil((shared.agg(F.sum("n")).first()[0] or 0) / UNIT))
    others = F.filter(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda other: (other != F.col("chunk")) | (F.col("trie") >= FIRST)) if across else F.array("chunk")
    dealt = shared.withColumn("with", F.explode(others)).select("value", "node", "chunk", "component", F.least("chunk", "with").alias("i"), F.greatest("chunk", "with").alias("j"), F.when(F.col("blocks") > 1, F.col("value")).alias("crowd"))
    # a pair of blocks of one group has nothing to join
    mixed = dealt.groupBy("value", "i", "j").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("value", "i", "j")
    tasks = dealt.join(mixed, ["value", "i", "j"], "left_semi").withColumn("unit", F.pmod(F.xxhash64("value"), F.lit(units))).join(sets, "node")
    return cut(tasks.groupBy("unit", "crowd", "i", "j").applyInArrow(_compare, "a long, b long"))


def jaccard_links(classes: DataFrame, rows: DataFrame, words: int = WORDS) -> DataFrame:
    """a, b: links between nodes that join all whose sets are alike.  classes: node, n, print; rows: node, t."""
    dealt = cut(clustered(cut(trie_groups(classes))))
    crowded = dealt.groupBy("value").agg(F.count("*").alias("k"), F.sum("n").alias("size"))
    crowded = crowded.select("value", F.greatest(F.least(F.ceil(F.col("k") / BLOCK), F.lit(SPREAD)), F.ceil(F.col("size") / HEAVY)).alias("blocks"))
    shared = cut(dealt.join(crowded, "value").withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("blocks"))))
    named = shared.select("node").distinct()
    named = F.broadcast(named) if named.count() <= SENT else named
    sets = cut(rows.join(named, "node", "left_semi").mapInArrow(_sets(words), "node long, held array<long>"))
    first = _links(shared.where(F.col("trie") < FIRST).withColumn("component", F.col("node")), sets, False)
    groups = cut(components(first))
    more = _links(shared.join(groups, "node", "left").withColumn("component", F.coalesce("component", "node")), sets, True)
    return first.unionByName(more)


def drop_near_copies(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS) -> DataFrame:
    """documents with one row of each group left, that of the least id.  `documents` must give its rows in the same order each time, as files and checkpoints do."""
    row = F.monotonically_increasing_id()
    key = F.struct(F.col(doc_id).isNull().alias("none"), F.col(doc_id).alias("id"), row.alias("row"))
    read = documents.select(key.alias("key"), text_of(text).alias("t"))
    keyed = cut(read.mapInArrow(_sketches(words), f"key {read.schema['key'].dataType.simpleString()}, digest binary, n int, print binary"))
    # the fingerprint of a class is that of any of its rows
    classes = cut(keyed.groupBy("digest").agg(F.min("key").alias("least"), F.first("n").alias("n"), F.first("print").alias("print")).select(F.col("least.row").alias("node"), "least", "n", "print"))
    groups = components(jaccard_links(classes, read.select(F.col("key.row").alias("node"), "t"), words))
    kept = classes.join(groups, "node", "left").groupBy(F.coalesce("component", "node")).agg(F.min("least").alias("least")).select(F.col("least.row").alias("row"))
    numbered = documents.select(F.struct(*documents.columns).alias("c"), row.alias("row"))
    return numbered.join(kept, "row", "left_semi").select("c.*")
