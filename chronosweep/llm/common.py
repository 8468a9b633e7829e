"""Small helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronosweep.functions.lineage import cut, ready_checkpoints

__all__ = ["BYTES", "ROWS", "Bounded", "cut", "forget", "kept", "let", "pieces", "ready_checkpoints", "running", "slices", "table", "text_of", "within_bytes"]

#: Rows and bytes handled at once inside a task; Arrow batches are cut to these so that
#: long texts don't sit in memory as Python objects all together.
ROWS, BYTES = 256, 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batches: Iterator[pa.RecordBatch], rows: int = ROWS, most: int = BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of at most so many rows and bytes; a larger row is a part of its own."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield from _halved(batch.slice(at, rows), most)


def _halved(part: pa.RecordBatch, most: int) -> Iterator[pa.RecordBatch]:
    if part.num_rows < 2 or part.nbytes <= most:
        yield part
    else:
        half = part.num_rows // 2
        yield from _halved(part.slice(0, half), most)
        yield from _halved(part.slice(half), most)


_kept: dict = {}


def kept(key, make: Callable):
    """What a worker keeps from task to task: the thing asked for last, and only that."""
    if key not in _kept:
        _kept.clear()
        _kept[key] = make()
    return _kept[key]


def forget() -> None:
    """Give back what earlier tasks of another operator keep in this worker, and memory that is free but still held."""
    if _kept:
        _kept.clear()
        pa.default_memory_pool().release_unused()


class Bounded(dict):
    """A dict that fills itself by a function and is emptied when its keys and values pass so many bytes.  Keys over a thousandth of that aren't kept."""

    def __init__(self, make: Callable, most: int = 32 << 20):
        super().__init__()
        self.make, self.most, self.held = make, most, 0

    def __missing__(self, key):
        value = self.make(key)
        weight = 200 + sum(_weight(x) for x in (key, value))
        if weight * 1000 <= self.most:
            self.held += weight
            if self.held > self.most:
                self.clear()
                self.held = weight
            self[key] = value
        return value


def _weight(x) -> int:
    if isinstance(x, tuple):
        return 56 + sum(map(_weight, x))
    return len(x) if isinstance(x, (str, bytes)) else 32


def within_bytes(sample: DataFrame, most: int, *order: str, text: str = "t") -> DataFrame:
    """The rows of a sample, whose number of rows is bounded, that come first in an order and hold `most` bytes of text together.

    Rows over a sixteenth of that are passed over, so that no single text takes the place of all others.
    Rows are taken whole; only their sizes are added up in one task.
    """
    sized = sample.withColumn("_size", F.octet_length(text)).where(F.col("_size") <= most // 16)
    upto = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    fits = sized.select(*order, F.sum("_size").over(upto).alias("_upto")).where(F.col("_upto") <= most).select(*order)
    return sized.join(F.broadcast(fits), list(order), "left_semi").drop("_size")


def text_of(name: str = "text") -> Column:
    """A text column with null read as empty."""
    return F.coalesce(F.col(name), F.lit(""))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is worked out once, where naming it twice would work it out twice (in a lambda, once an element)."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _chunks(values: Column) -> Column:
    """An array cut into about as many parts as each part has elements."""
    width = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(values)))).cast("int")
    return let(width, lambda w: F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size(values) - 1) / w)).cast("int")), lambda i: F.slice(values, i * w + 1, w)))


def _fold(values: Column, join: Callable[[Column, Column], Column], start: int) -> Column:
    """start, then what all values up to each place join to."""
    return F.aggregate(values, F.array(F.lit(start).cast("bigint")), lambda acc, x: F.array_append(acc, join(F.element_at(acc, -1), x.cast("bigint"))))


def running(values: Column, join: Callable[[Column, Column], Column] = lambda a, b: a + b, start: int = 0) -> Column:
    """For each element of an array, what it and all before it join to (an associative `join` of whole numbers, of which `start` is the neutral one).

    A fold that appends copies its array at each step.  Here it runs in parts of about the root of the
    length and then over the parts, so n elements take n to the power of 1.5 and not n squared.
    """

    def over(parts: Column) -> Column:
        before = _fold(F.transform(parts, lambda p: F.element_at(p, -1)), join, start)
        return F.flatten(F.zip_with(parts, F.slice(before, F.lit(1), F.size(parts)), lambda p, b: F.transform(p, lambda x: join(b, x))))

    inner = lambda v: F.transform(_chunks(v), lambda c: F.slice(_fold(c, join, start), F.lit(2), F.size(c)))
    empty = F.array().cast("array<bigint>")
    return let(values, lambda v: F.when(F.size(v) > 0, let(inner(v), over)).otherwise(empty))


def pieces(text: Column, spans: Column) -> Column:
    """The texts of spans (start, end in code points, in order, none overlapping).

    Finding a place in a string means reading it from its start, so stretches of about the root of the
    number of spans are cut out first and the spans are cut out of these.
    """

    def stretch(chunk: Column) -> Column:
        first = F.element_at(chunk, 1)["start"]
        part = F.substring(text, first.cast("int") + 1, (F.element_at(chunk, -1)["end"] - first).cast("int"))
        return let(part, lambda p: F.transform(chunk, lambda s: F.substring(p, (s["start"] - first).cast("int") + 1, (s["end"] - s["start"]).cast("int"))))

    return let(spans, lambda every: F.when(F.size(every) > 0, F.flatten(F.transform(_chunks(every), stretch))).otherwise(F.array().cast("array<string>")))
