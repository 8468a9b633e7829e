"""Embedding near-dedup: cross-polytope hashing with multiprobe buckets and verified pairs.

Each of ``TABLES`` tables rotates a vector twice by sign flips and fast Hadamard
transforms and hashes each rotation to the nearest vertex of the cross-polytope.
A vector lives in the bucket of its nearest vertices and also looks into those of
its next nearest ones; two meet where one lives in a bucket that the other lives in
or looks into.  Pairs that meet are verified by cosine in double precision.

Equal vectors are one class and are hashed once.  Buckets of more than ``BLOCK``
entries are cut into blocks, and every pair of blocks is a task of its own, so no
task gets an unbounded bucket and none is sampled.  A pair is counted in the first
bucket only where it meets, and tasks hand on sums and contracted links, never
pairs.

Defined results: vectors that are null, empty, zero, or hold null or non-finite
components link with nothing, nor do vectors of different lengths; repeated rows
and ids each give a row; ties don't arise, as the component is the least id; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronosweep.llm.common import BYTES, cut, slices
from chronosweep.llm.components import components, roots

TABLES = 6
#: Nearest vertices of each of a table's two rotations that make its probes.
NEAREST = 2
PROBES = NEAREST * NEAREST
#: Entries to a block of a bucket, entries that share a task's call, and pairs that it holds at once.
BLOCK, UNIT, PAIRS = 2000, 4000, 200_000
SEED = 20240229


def _hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows, whose length is a power of two."""
    n, step = x.shape[1], 1
    while step < n:
        pairs = x.reshape(len(x), n // (2 * step), 2, step)
        x = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(len(x), n)
        step *= 2
    return x / np.sqrt(n)


def bucket_codes(vectors: np.ndarray, tables: int = TABLES) -> np.ndarray:
    """Buckets (row, table, probe) of unit vectors; probe 0 is where the vector lives."""
    size = 1 << max(1, (vectors.shape[1] - 1).bit_length())
    padded = np.zeros((len(vectors), size))
    padded[:, : vectors.shape[1]] = vectors
    signs = np.random.default_rng(SEED).choice([-1.0, 1.0], (tables, 2, 3, size))
    out = np.zeros((len(vectors), tables, PROBES), "i8")
    rows = np.arange(len(vectors))[:, None]
    for t in range(tables):
        best = []
        for r in range(2):
            x = padded
            for flips in signs[t, r]:
                x = _hadamard(x * flips)
            top = np.argsort(-np.abs(x), axis=1, kind="stable")[:, :NEAREST]
            best.append(2 * top + (x[rows, top] < 0))
        out[:, t] = (best[0][:, :, None] * (2 * size) + best[1][:, None, :]).reshape(-1, PROBES)
    return out


def code_kind(size: int) -> str:
    """The integers that hold the buckets of vectors of this size."""
    return "i4" if (2 << max(1, (size - 1).bit_length())) ** 2 <= 2**31 else "i8"


def _packed(vector: list[float]) -> bytes:
    """A vector's components in 32 bits if none loses anything by it, else in 64."""
    whole = np.array(vector, "f8")
    with np.errstate(over="ignore"):
        half = whole.astype("f4")
    return half.tobytes() if (half == whole).all() else whole.tobytes()


def _unpacked(vectors: list[bytes], size: int) -> np.ndarray:
    out = np.empty((len(vectors), size))
    short = np.array([len(v) == 4 * size for v in vectors])
    for kind, some in (("f4", short), ("f8", ~short)):
        if some.any():
            out[some] = np.frombuffer(b"".join(v for v, s in zip(vectors, some.tolist(), strict=True) if s), kind).reshape(-1, size)
    return out


def _coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices([batch], 2048, BYTES):
            vectors = part.column(1).to_pylist()
            codes: list = [None] * len(vectors)
            for size in {len(v) for v in vectors}:
                which = [i for i, v in enumerate(vectors) if len(v) == size]
                x = np.array([vectors[i] for i in which], "f8")
                x /= np.abs(x).max(axis=1, keepdims=True)
                for i, c in zip(which, bucket_codes(x / np.linalg.norm(x, axis=1, keepdims=True)), strict=True):
                    codes[i] = c.ravel().tolist()
            packed = [_packed(v) for v in vectors], [np.array(c, code_kind(len(v))).tobytes() for v, c in zip(vectors, codes, strict=True)]
            arrays = [pa.array(x, pa.binary()) for x in packed]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array([len(v) for v in vectors], pa.int32()), *arrays, pa.array(codes, pa.list_(pa.int64()))], ["cid", "n", "dim", "vec", "codes", "places"])


def _meets(a: np.ndarray, b: np.ndarray, table: int, bucket: np.ndarray) -> np.ndarray:
    """Whether pairs of codes (pair, table, probe) first meet in these buckets of this table."""
    met = np.zeros(len(a), bool)
    for t in range(table):
        met |= (a[:, t, :] == b[:, t, :1]).any(1) | (b[:, t, :] == a[:, t, :1]).any(1)
    in_a, in_b = a[:, table, 0], b[:, table, 0]
    here = (in_a == bucket) | (in_b == bucket)
    # the two live in different buckets and look into each other's: the lesser counts
    lesser = np.where(in_a == bucket, in_b, in_a)
    both = (b[:, table, :] == in_a[:, None]).any(1) & (a[:, table, :] == in_b[:, None]).any(1)
    return here & ~met & ~(both & (lesser < bucket))


def _verify(threshold: float):
    def run(unit: pa.Table) -> pa.Table:
        unit = unit.sort_by("bucket")
        table, i, j = (unit.column(c)[0].as_py() for c in ("t", "i", "j"))
        bucket, chunk, ids, times = (unit.column(c).to_numpy() for c in ("bucket", "chunk", "cid", "n"))
        raw = _unpacked(unit.column("vec").to_pylist(), unit.column("dim")[0].as_py())
        # scaled by powers of two, which changes no cosine, so that no square is lost or overflows
        raw = raw * np.exp2(-np.frexp(np.abs(raw).max(axis=1))[1].astype(float))[:, None]
        codes = np.frombuffer(b"".join(unit.column("codes").to_pylist()), code_kind(raw.shape[1])).reshape(len(ids), -1, PROBES)
        norm = np.sqrt((raw * raw).sum(1))
        unit_rows = raw / norm[:, None]
        links, root, held, count = np.zeros(len(ids), "i8"), np.arange(len(ids)), [], 0

        def settle() -> np.ndarray:
            """Verify the pairs held, count their links and contract them."""
            x, y = (np.concatenate(z) for z in zip(*held, strict=True))
            sure = _meets(codes[x], codes[y], table, bucket[x])
            x, y = x[sure], y[sure]
            sure = np.einsum("ij,ij->i", raw[x], raw[y]) / (norm[x] * norm[y]) >= threshold
            x, y = x[sure], y[sure]
            np.add.at(links, x, times[y])
            np.add.at(links, y, times[x])
            return roots(len(ids), np.concatenate([np.arange(len(ids)), x]), np.concatenate([root, y]))

        edges = np.flatnonzero(np.diff(bucket, prepend=bucket[0] - 1, append=bucket[-1] + 1))
        lives = codes[:, table, 0] == bucket
        for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            if hi - lo < 2 or not lives[lo:hi].any():
                continue
            here = np.arange(lo, hi)
            first, second = (here, here) if i == j else (here[chunk[lo:hi] == i], here[chunk[lo:hi] == j])
            for at in range(0, len(first), 512):
                some = first[at : at + 512]
                a, b = np.nonzero(unit_rows[some] @ unit_rows[second].T >= threshold - 1e-9)
                a, b = some[a], second[b]
                if i == j:
                    a, b = a[a < b], b[a < b]
                held.append((a, b))
                count += len(a)
                if count > PAIRS:
                    root, held, count = settle(), [], 0
        if held:
            root = settle()
        some = np.flatnonzero(links)
        return pa.table({"cid": ids[some], "links": links[some], "root": ids[root[some]]})

    return run


def embedding_groups(embeddings: DataFrame, threshold: float = 0.9, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id, kept."""
    held = embeddings.select(F.col(vec_id).alias("id"), F.col(embedding).alias("vec"))
    sound = F.coalesce((F.size("vec") > 0) & F.exists("vec", lambda x: x != 0) & F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
    classes = held.where(sound).groupBy("vec").agg(F.min("id").alias("least"), F.count("*").alias("n"))
    classes = cut(classes.select(F.monotonically_increasing_id().alias("cid"), "vec", "n", "least"))
    coded = cut(classes.select("cid", "vec", "n").mapInArrow(_coded, "cid long, n long, dim int, vec binary, codes binary, places array<long>"))
    place = coded.select("cid", "n", "dim", "vec", "codes", F.posexplode("places").alias("p", "bucket")).withColumn("t", F.floor(F.col("p") / PROBES).cast("int"))
    units = max(1, math.ceil(coded.count() * PROBES / UNIT))
    crowded = cut(place.groupBy("dim", "t", "bucket").agg(F.ceil(F.count("*") / BLOCK).alias("blocks")).where("blocks > 1"))
    split = place.join(crowded, ["dim", "t", "bucket"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    split = split.withColumn("chunk", F.pmod(F.xxhash64("cid"), F.col("blocks"))).withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    tasks = split.select("dim", "t", F.pmod(F.xxhash64("bucket"), F.lit(units)).alias("unit"), F.when(F.col("blocks") > 1, F.col("bucket")).alias("crowd"), F.least("chunk", "with").alias("i"), F.greatest("chunk", "with").alias("j"), "bucket", "chunk", "cid", "n", "vec", "codes")
    found = cut(tasks.groupBy("dim", "t", "unit", "crowd", "i", "j").applyInArrow(_verify(threshold), "cid long, links long, root long"))
    links = found.groupBy("cid").agg(F.sum("links").alias("links"))
    groups = components(found.select(F.col("cid").alias("a"), F.col("root").alias("b")))
    joined = groups.join(classes, groups["node"] == classes["cid"]).select("cid", "component", "least")
    least = cut(joined.groupBy("component").agg(F.min("least").alias("group")))
    moved = joined.join(least, "component").select("cid", "group")
    labels = cut(classes.join(links, "cid", "left").join(moved, "cid", "left").select("vec", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("group", "least").alias("component_id")))
    out = held.join(labels, "vec", "left").select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
    return out.select(F.col("id").alias(vec_id), "n_links", "component_id", F.col("component_id").eqNullSafe(F.col("id")).alias("kept"))
