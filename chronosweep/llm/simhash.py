"""SimHash near-dedup by a self-join of a binary trie.

A document's fingerprint takes, for each of 64 bits, the majority over the hashes
of its word shingles.  Distinct fingerprints form a binary trie; node pairs are
walked down together, differing bits add up, and a pair is dropped once they pass
the error budget.  Spark deals the pairs of nodes of the trie's upper ``depth``
levels to tasks, and each task walks the rest of its two subtrees in numpy arrays.
Nodes that hold more than ``BLOCK`` fingerprints are cut into blocks by hash, and
every pair of blocks is a task of its own.

Tasks contract the links that they find to stars before handing them on, so a
group of copies yields rows in proportion to its size; equal fingerprints are one
leaf.  ``components`` then joins the stars.

Defined results: null text has no words and so fingerprint zero, like empty text;
null ids are kept and never name a component unless it holds nothing else; repeated
rows each give a row; an empty table gives no rows; other columns are ignored by
``simhash_groups`` and kept by ``drop_near_copies``.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronosweep.llm.common import cut, slices, text_of
from chronosweep.llm.components import components, roots

BITS = 64
BUDGET = 4
SEED = 42
#: Fingerprints that a node at the dealt depth is meant to hold.
LEAVES = 1 << 16
#: Fingerprints of one node that a task gets; a node with more is dealt in blocks.
BLOCK = 1 << 20
#: Node pairs and leaf pairs that a task holds at once.
FRONT, PAIRS = 1 << 17, 1 << 20


def shingle_hashes(text: str, words: int) -> list[int]:
    parts = text.encode().lower().split()
    if not parts:
        return []
    data = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(words, len(parts))
    digest = xxhash.xxh64_intdigest
    return [digest(data[s:e], SEED) for s, e in zip(starts[: len(parts) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)]


def _fingerprints(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = np.zeros(batch.num_rows, "u8")
            for i, text in enumerate(batch.column(1).to_pylist()):
                hashes = shingle_hashes(text, words)
                ones = np.zeros(BITS, np.int64)
                for at in range(0, len(hashes), 4096):
                    ones += np.unpackbits(np.array(hashes[at : at + 4096], ">u8").view("u1").reshape(-1, 8), axis=1).sum(0, dtype=np.int32)
                out[i] = int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out.view("i8"))], ["key", "fp"])

    return run


def fingerprints(documents: DataFrame, key: Column, text: str = "text", words: int = 4) -> DataFrame:
    """key, fp: the fingerprint as a signed 64-bit integer."""
    keyed = documents.select(key.alias("key"), text_of(text).alias("t"))
    kind = keyed.schema["key"].dataType.simpleString()
    return keyed.mapInArrow(_fingerprints(words), f"key {kind}, fp long")


def _leaf_links(a: np.ndarray, b: np.ndarray, front: list[np.ndarray], budget: int, same: bool, links: list) -> None:
    """Compare the leaves below pairs of small nodes."""
    al, ah, bl, bh = front
    size = (ah - al) * (bh - bl)
    for part in np.array_split(np.arange(len(size)), max(1, int(size.sum()) // PAIRS + 1)):
        n = size[part]
        pair = np.repeat(part, n)
        k = np.arange(len(pair)) - np.repeat(np.cumsum(n) - n, n)
        wide = (bh - bl)[pair]
        i, j = al[pair] + k // wide, bl[pair] + k % wide
        near = np.bitwise_count(a[i] ^ b[j]) <= budget
        if same:
            near &= i < j
        links.append((i[near], j[near]))


def trie_links(a: np.ndarray, b: np.ndarray, depth: int, budget: int, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Indices into two sorted fingerprint arrays, each of one node at `depth`, of all pairs within the budget."""
    if not len(a) or not len(b):
        return
    start = (int(a[0]) ^ int(b[0])) >> (BITS - depth) if depth else 0
    yield from _descend(a, b, depth, np.array([[0], [len(a)], [0], [len(b)], [start.bit_count()]]), budget, same)


def subtree_links(a: np.ndarray, depth: int, budget: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Indices into a sorted fingerprint array of all pairs that agree in the upper `depth` bits and are within the budget below."""
    if len(a):
        upper = a >> np.uint64(BITS - depth)
        edges = np.concatenate([[0], np.flatnonzero(upper[1:] != upper[:-1]) + 1, [len(a)]])
        lo, hi = edges[:-1], edges[1:]
        lo, hi = lo[hi - lo > 1], hi[hi - lo > 1]
        if len(lo):
            yield from _descend(a, a, depth, np.array([lo, hi, lo, hi, np.zeros(len(lo), np.int64)]), budget, True)


def _descend(a: np.ndarray, b: np.ndarray, depth: int, nodes: np.ndarray, budget: int, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Walk down pairs of nodes: from and to in a, from and to in b, differing bits so far."""
    stack = [(depth, nodes)]
    while stack:
        level, front = stack.pop()
        if front.shape[1] > FRONT:
            stack += [(level, x) for x in np.array_split(front, front.shape[1] // FRONT + 1, axis=1)]
            continue
        small = ((front[1] - front[0]) * (front[3] - front[2]) <= 32) | (level == BITS)
        if small.any():
            found: list = []
            _leaf_links(a, b, list(front[:4, small]), budget, same, found)
            yield from found
        al, ah, bl, bh, err = front[:, ~small]
        if not len(al):
            continue
        keep, bit = np.uint64((1 << BITS) - (1 << (BITS - level))), np.uint64(1 << (BITS - 1 - level))
        am, bm = np.searchsorted(a, a[al] & keep | bit), np.searchsorted(b, b[bl] & keep | bit)
        twins = (al == bl) & same
        children = [(al, am, bl, bm, err), (am, ah, bm, bh, err), (al, am, bm, bh, err + 1), (am, ah, bl, bm, np.where(twins, budget + 1, err + 1))]
        below = np.concatenate([np.array(c) for c in children], axis=1)
        below = below[:, (below[0] < below[1]) & (below[2] < below[3]) & (below[4] <= budget)]
        if below.shape[1]:
            stack.append((level + 1, below))


def _walk(depth: int, budget: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        same = rows["x"].iat[0] == rows["y"].iat[0] and rows["i"].iat[0] == rows["j"].iat[0]
        left = rows["left"].to_numpy()
        values = rows["fp"].to_numpy().view("u8")
        a = np.sort(values[left])
        b = a if same else np.sort(values[~left])
        every = a if same else np.concatenate([a, b])
        shift = 0 if same else len(a)
        root, held, count = np.arange(len(every)), [], 0

        def contract() -> np.ndarray:
            u = np.concatenate([np.arange(len(every)), *(h[0] for h in held)])
            v = np.concatenate([root, *(h[1] for h in held)])
            return roots(len(every), u, v)

        for i, j in trie_links(a, b, depth, budget, same):
            held.append((i, j + shift))
            count += len(i)
            if count > PAIRS:
                root, held, count = contract(), [], 0
        root = contract()
        moved = np.flatnonzero(root != np.arange(len(root)))
        return pd.DataFrame({"a": every[moved].view("i8"), "b": every[root[moved]].view("i8")})

    return run


def near_links(distinct: DataFrame, fp: str = "fp", budget: int = BUDGET) -> DataFrame:
    """a, b: links between distinct fingerprints that join all whose distance is within the budget."""
    n = distinct.count()
    depth = min(12, max(5, math.ceil(math.log2(max(n, 1) / LEAVES))))
    masks = [sum(1 << i for i in bits) for k in range(min(budget, depth) + 1) for bits in itertools.combinations(range(depth), k)]
    node = F.shiftrightunsigned(F.col(fp), BITS - depth)
    dealt = distinct.select(F.col(fp).alias("fp"), node.alias("node")).select("fp", "node", F.explode(F.transform(F.lit(masks).cast("array<bigint>"), lambda m: F.col("node").bitwiseXOR(m))).alias("other"))
    paired = dealt.select("fp", "node", "other", F.least("node", "other").alias("x"), F.greatest("node", "other").alias("y"), (F.col("node") <= F.col("other")).alias("left"))
    return _blocked(paired, distinct.select(node.alias("node"))).groupBy("x", "y", "i", "j").applyInPandas(_walk(depth, budget), "a long, b long")


def _blocked(paired: DataFrame, nodes: DataFrame) -> DataFrame:
    """paired with i, j: which block of node x meets which of node y.  All blocks of one node meet all of the other, and those of a node meet each other once."""
    # a row for each of the 4,096 nodes at most
    crowded = cut(nodes.groupBy("node").agg(F.ceil(F.count("*") / F.lit(BLOCK)).alias("blocks")).where("blocks > 1"))
    counts = lambda name, count: F.broadcast(crowded.select(F.col("node").alias(name), F.col("blocks").alias(count)))
    sized = paired.join(counts("node", "mine"), "node", "left").join(counts("other", "theirs"), "other", "left")
    sized = sized.withColumn("block", F.pmod(F.xxhash64("fp"), F.coalesce("mine", F.lit(1))))
    met = sized.withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("theirs", F.lit(1)) - 1)))
    i, j = F.when(F.col("left"), F.col("block")).otherwise(F.col("with")), F.when(F.col("left"), F.col("with")).otherwise(F.col("block"))
    twin = F.col("x") == F.col("y")
    # within one node the lesser block is the left one
    return met.select("fp", "x", "y", F.when(twin, F.least("block", "with")).otherwise(i).alias("i"), F.when(twin, F.greatest("block", "with")).otherwise(j).alias("j"), F.when(twin, F.col("block") <= F.col("with")).otherwise(F.col("left")).alias("left"))


def _labelled(keyed: DataFrame, budget: int) -> DataFrame:
    """fp, component_id: for each distinct fingerprint the least key of all that can be reached from it."""
    classes = cut(keyed.groupBy("fp").agg(F.min("key").alias("least")))
    groups = components(near_links(classes, "fp", budget))
    joined = groups.join(classes, groups["node"] == classes["fp"]).select("fp", "component", "least")
    least = cut(joined.groupBy("component").agg(F.min("least").alias("component_id")))
    moved = joined.join(least, "component").select("fp", "component_id")
    return cut(classes.join(moved, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id")))


def simhash_groups(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 4, budget: int = BUDGET) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id."""
    keyed = cut(fingerprints(documents, F.col(doc_id), text, words))
    joined = keyed.join(_labelled(keyed, budget), "fp", "left")
    return joined.select(F.col("key").alias(doc_id), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_copies(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 5, budget: int = BUDGET) -> DataFrame:
    """documents with one row of each group left, that of the least id.  `documents` must give its rows in the same order each time, as files and checkpoints do."""
    row = F.monotonically_increasing_id()
    keyed = cut(fingerprints(documents, F.struct(F.col(doc_id).isNull().alias("none"), F.col(doc_id).alias("id"), row.alias("row")), text, words))
    kept = _labelled(keyed, budget).select(F.col("component_id.row").alias("row")).distinct()
    numbered = documents.select(F.struct(*documents.columns).alias("c"), row.alias("row"))
    return numbered.join(kept, "row", "left_semi").select("c.*")
