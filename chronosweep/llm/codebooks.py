"""Vector code compression: product quantisation whose codebooks are trained by Lloyd's rounds with Elkan's bounds.

Components are integers, floor(scale * x), and every distance that decides is an
integer, so results don't depend on batches, partitions or the order of rows.

The state of a vector (its entry in each part, an upper bound of the distance to it
and a lower bound for each entry) is a table that is written after every round.  A
round passes over the table once: an entry is left out where the triangle inequality
says that it is strictly further away than the one held, by its lower bound or by half
the distance between the two entries; all others are compared by integers, and of
equal ones the lower index wins.  After the entries have moved, upper bounds grow and
lower bounds shrink by as far.  Bounds are 32-bit floats rounded to the safe side.

What reaches the driver is one sum for each entry and component, whatever the number
of vectors; sums are taken in tasks first.

Defined results: vectors that are null, empty, or hold null or non-finite components
are dropped, and so are those of another length than the first kept one (the least
vec_id, nulls last), as they can't be compared; fewer vectors than entries make as
many entries as there are vectors; equal and null ids are ordered by their vectors;
repeated rows each give a row; parts of a length that eight doesn't divide differ by
one component; a null label is a label; sums over a long are null; components so
large that squares pass 63 bits are computed with Python's integers; an empty
table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronosweep.llm.common import cut, slices

ENTRIES, PARTS, ROUNDS, SCALE = 16, 8, 6, 4096
#: Vectors that a task handles at once.
ROWS, BYTES = 4096, 16 << 20
#: What bounds are widened by, beside the rounding to 32 bits: more than the error of a square root and a sum.
SLACK = 1e-6
NAMES = ["id", "label", "vec", "held", "upper", "lower"]


def spans(size: int, parts: int) -> list[tuple[int, int]]:
    """Where the parts of a vector of this size start and end."""
    return [(p * size // parts, (p + 1) * size // parts) for p in range(parts)]


def _up(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.nextafter((x * (1 + SLACK)).astype("f4"), np.float32(np.inf))


def _down(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.maximum(np.nextafter((x * (1 - SLACK)).astype("f4"), np.float32(-np.inf)), np.float32(0))


def integers(x: list[float], scale: int) -> list[int]:
    """floor(scale * x) of each, exact at any size: a double beyond 2^53 is an integer itself."""
    return [math.floor(c * scale) if abs(c) < 2.0**53 else int(c) * scale for c in x]


def distances(squared: np.ndarray) -> np.ndarray:
    """Roots as doubles; those of integers beyond any bound's 32 bits needn't be exact."""
    if squared.dtype != object:
        return np.sqrt(squared.astype("f8"))
    return np.array([math.sqrt(v) if v < 10**300 else 1e150 for v in squared.ravel().tolist()], "f8").reshape(squared.shape)


def squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances between rows, as integers of their own kind."""
    d = x - y
    return (d * d).sum(-1) if d.shape[-1] else np.zeros(d.shape[:-1], d.dtype)


def assign(x: np.ndarray, book: np.ndarray, held: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> int:
    """One part of some vectors: change held (entry), upper and lower in place to those of the nearest entries; returns the distances computed.

    `held` is below the number of entries; upper and lower may be infinite and zero, which prunes nothing.
    """
    if len(book) < 2 or not len(x):
        return 0
    between = distances(squares(book[:, None], book[None]))
    half = _down(between / 2)
    np.fill_diagonal(half, 0)
    others = np.where(np.eye(len(book), dtype=bool), np.float32(np.inf), half).min(1)
    rows = np.flatnonzero(upper >= others[held])  # all others are strictly nearest to their own entry
    if not len(rows):
        return 0
    own = squares(x[rows], book[held[rows]])
    upper[rows] = _up(distances(own))
    near = ~((lower[rows] > upper[rows, None]) | (half[held[rows]] > upper[rows, None]))
    near[np.arange(len(rows)), held[rows]] = False
    lower[rows, held[rows]] = _down(distances(own))
    i, c = np.nonzero(near)
    found = squares(x[rows[i]], book[c])
    lower[rows[i], c] = _down(distances(found))
    # of all that were compared, the least distance and then the least index
    i, c, found = np.concatenate([np.arange(len(rows)), i]), np.concatenate([held[rows], c]), np.concatenate([own, found])
    order = np.lexsort((c, found, i))
    first = order[np.flatnonzero(np.diff(i[order], prepend=-1))]
    held[rows], upper[rows] = c[first], _up(distances(found[first]))
    return len(found)


def shifts(books: list[np.ndarray], after: list[np.ndarray]) -> list[np.ndarray]:
    """How far each entry has moved: what upper bounds grow and lower bounds shrink by."""
    far = [distances(squares(a, b)) for a, b in zip(books, after, strict=True)]
    return [np.where(x > 0, _up(x), np.float32(0)) for x in far]


def _array(column: pa.ChunkedArray | pa.Array, kind: str, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), width).copy()


def _binary(rows: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in np.ascontiguousarray(rows)], pa.binary())


class _Layout:
    """How a vector of integers is held: eight bytes a component, or text where that isn't enough."""

    def __init__(self, size: int, wide: bool):
        self.size, self.wide, self.spans = size, wide, spans(size, PARTS)

    def read(self, column) -> np.ndarray:
        if not self.wide:
            return _array(column, "i8", self.size)
        out = np.empty((len(column), self.size), object)
        for i, told in enumerate(column.to_pylist()):
            out[i] = [int(c) for c in told.split(b",")]
        return out

    def write(self, rows: np.ndarray) -> pa.Array:
        return _binary(rows.astype("i8")) if not self.wide else pa.array([",".join(map(str, r)).encode() for r in rows], pa.binary())


def _rounds(layout: _Layout, books: list[np.ndarray], grow: list[np.ndarray], first: bool) -> Callable:
    k = len(books[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, ROWS, BYTES):
            x, n = layout.read(part.column(2)), part.num_rows
            if first:
                held, upper, lower = np.zeros((n, PARTS), "u1"), np.full((n, PARTS), np.inf, "f4"), np.zeros((n, PARTS * k), "f4")
            else:
                held, upper, lower = _array(part.column(3), "u1", PARTS), _array(part.column(4), "f4", PARTS), _array(part.column(5), "f4", PARTS * k)
            lower = lower.reshape(n, PARTS, k)
            for p, (lo, hi) in enumerate(layout.spans):
                h, u, low = held[:, p].astype("i8"), upper[:, p].copy(), lower[:, p].copy()
                if not first:
                    u = np.nextafter(u + grow[p][h], np.float32(np.inf))
                    low = np.maximum(np.nextafter(low - grow[p], np.float32(-np.inf)), np.float32(0))
                assign(x[:, lo:hi], books[p], h, u, low)
                held[:, p], upper[:, p], lower[:, p] = h, u, low
            yield pa.RecordBatch.from_arrays([*part.columns[:3], _binary(held), _binary(upper), _binary(lower.reshape(n, -1))], NAMES)

    return run


def _sums(layout: _Layout) -> Callable:
    """One row for each entry that a task's vectors use: part, entry, their number and their sums as text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], list] = {}
        for part in slices(batches, ROWS, BYTES):
            x, held = layout.read(part.column(2)), _array(part.column(3), "u1", PARTS)
            for p, (lo, hi) in enumerate(layout.spans):
                for e in np.unique(held[:, p]).tolist():
                    some = x[held[:, p] == e, lo:hi]
                    now = total.setdefault((p, e), [0, [0] * (hi - lo)])
                    now[0] += len(some)
                    now[1] = [a + int(b) for a, b in zip(now[1], some.sum(0), strict=True)]
        keys = sorted(total)
        yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in keys], pa.int32()), pa.array([b for _, b in keys], pa.int32()), pa.array([total[x][0] for x in keys], pa.int64()), pa.array([",".join(map(str, total[x][1])) for x in keys], pa.string())], ["part", "entry", "n", "sums"])

    return run


def _added(rows: pa.Table) -> pa.Table:
    """The sum of such rows of one entry."""
    told = [[int(c) for c in s.split(",")] if s else [] for s in rows.column("sums").to_pylist()]
    return pa.table({"part": rows.column("part")[:1], "entry": rows.column("entry")[:1], "n": [sum(rows.column("n").to_pylist())], "sums": [",".join(str(sum(c)) for c in zip(*told, strict=True))]})


def moved(books: list[np.ndarray], sums: list) -> list[np.ndarray]:
    """The entries after a round: floors of means; unused ones stay."""
    out = [b.copy() for b in books]
    for row in sums:
        if len(out[row["part"]][row["entry"]]):
            out[row["part"]][row["entry"]] = [int(c) // row["n"] for c in row["sums"].split(",")]
    return out


def _final(layout: _Layout, books: list[np.ndarray]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, ROWS, BYTES):
            x, held = layout.read(part.column(2)), _array(part.column(3), "u1", PARTS)
            error = sum(squares(x[:, lo:hi], books[p][held[:, p]]) for p, (lo, hi) in enumerate(layout.spans))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([h.tobytes().hex() for h in held], pa.string()), pa.array([str(e) for e in error.tolist()], pa.string())], ["id", "label", "code", "error"])

    return run


def train(vectors: DataFrame, scale: int = SCALE, rounds: int = ROUNDS, entries: int = ENTRIES) -> tuple[DataFrame, list[np.ndarray], _Layout] | None:
    """(state after the last assignment, codebooks, layout) of sound vectors (id, label, vec: array of doubles); None without any."""
    least = lambda rows: [r["vec"] for r in rows.orderBy(F.col("id").asc_nulls_last(), "vec").limit(entries).collect()]
    first = least(vectors)
    if not first:
        return None
    size = len(first[0])
    alike = vectors.where(F.size("vec") == size)
    if any(len(v) != size for v in first):
        first = least(alike)
    largest = alike.agg(F.max(F.array_max(F.transform("vec", F.abs)))).first()[0] * scale + 1
    wide = 4 * largest * largest * -(-size // PARTS) >= 2.0**62
    layout = _Layout(size, wide)
    rows = np.array([integers(v, scale) for v in first], object).reshape(len(first), size)
    books = [rows[:, lo:hi].astype(object if wide else "i8") for lo, hi in layout.spans]

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, ROWS, BYTES):
            if wide:
                whole = np.array([integers(v, scale) for v in part.column(2).to_pylist()], object).reshape(part.num_rows, size)
            else:
                whole = np.floor(part.column(2).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, size) * scale).astype("i8")
            nothing = pa.nulls(part.num_rows, pa.binary())
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), layout.write(whole), nothing, nothing, nothing], NAMES)

    kinds = {f.name: f.dataType.simpleString() for f in vectors.schema}
    schema = f"id {kinds['id']}, label {kinds['label']}, vec binary, held binary, upper binary, lower binary"
    state, grow = cut(alike.select("id", "label", "vec").mapInArrow(packed, schema)), []
    added = "part int, entry int, n long, sums string"
    for k in range(rounds + 1):
        state = cut(state.mapInArrow(_rounds(layout, books, grow, k == 0), schema))
        if k < rounds:
            sums = state.mapInArrow(_sums(layout), added).groupBy("part", "entry").applyInArrow(_added, added).collect()
            before, books = books, moved(books, sums)
            grow = shifts(before, books)
    return state, books, layout


def compress_vectors(embeddings: DataFrame, scale: int = SCALE, rounds: int = ROUNDS, entries: int = ENTRIES, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """vec_id, code (two hex digits a part), error, label_error, codebooks_sha256."""
    held = embeddings.select(F.col(vec_id).alias("id"), F.col(label).alias("label"), F.col(embedding).cast("array<double>").alias("vec"))
    sound = F.coalesce((F.size("vec") > 0) & F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
    kinds = dict(held.dtypes)
    found = train(held.where(sound), scale, rounds, entries)
    if found is None:
        return embeddings.sparkSession.createDataFrame([], f"{vec_id} {kinds['id']}, code string, error long, label_error long, codebooks_sha256 string")
    state, books, layout = found
    told = ",".join(str(int(c)) for b in books for e in b for c in e)
    done = state.mapInArrow(_final(layout, books), f"id {kinds['id']}, label {kinds['label']}, code string, error string")
    done = cut(done.withColumn("error", F.col("error").try_cast("decimal(38,0)")))
    sums = done.groupBy("label").agg(F.try_sum("error").alias("total")).withColumnRenamed("label", "_label")
    out = done.join(sums, F.col("label").eqNullSafe(F.col("_label")))
    return out.select(F.col("id").alias(vec_id), "code", F.col("error").try_cast("long").alias("error"), F.col("total").try_cast("long").alias("label_error"), F.lit(hashlib.sha256(told.encode()).hexdigest()).alias("codebooks_sha256"))
