"""Quality scores from compression: zstandard dictionaries of good and of bad text.

A text's blocks are compressed once with each dictionary; the difference of the two
sizes, over their sum, is a calibrated score's only input.  The dictionaries are
built from one half of a bounded sample of labelled rows, and the logistic curve that
turns differences into scores is fitted on the other half.  Each label's rows go to
the halves by turns in the order of a salted id hash, whatever their ids.

The sample: of each label, the ``sample`` rows of least id hash, read whole, as far as both
labels' texts hold ``sample_bytes`` together (texts over a sixteenth of that aren't learned
from).  Scores read whole texts.

Defined results: null and empty texts get the score of a difference of zero; an id
with labels that disagree isn't learned from; with under two learnable rows of a
label (one at least with text), every score is the share of good labels (one half if there are none);
repeated rows each get a row; null ids count as held in; an empty table gives no
rows; ``score_quality`` ignores other columns and ``keep_good`` keeps them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronosweep.llm.common import cut, forget, slices, text_of, within_bytes

SAMPLE, SAMPLE_BYTES = 1200, 64 << 20
BLOCK, DICTIONARY, LEVEL = 2048, 1 << 16, 3


@dataclass
class QualityModel:
    good: bytes
    bad: bytes
    slope: float
    offset: float

    def scorer(self):
        packers = [_packer(d) for d in (self.good, self.bad)] if self.good and self.bad else []

        def score(text: str) -> float:
            x = _difference(text.encode(), packers) if packers else 0.0
            return float(1 / (1 + np.exp(-np.clip(self.slope * x + self.offset, -30, 30))))

        return score


def _packer(dictionary: bytes):
    data = zstandard.ZstdCompressionDict(dictionary)
    data.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=data, write_content_size=False, write_dict_id=False).compress


def _blocks(data: bytes) -> list[bytes]:
    return [data[i : i + BLOCK] for i in range(0, len(data), BLOCK)]


def _difference(data: bytes, packers: list) -> float:
    good, bad = (sum(map(len, map(pack, _blocks(data)))) for pack in packers)
    return (bad - good) / (bad + good) if data else 0.0


def _dictionary(texts: list[bytes]) -> bytes:
    blocks = [b for t in texts for b in _blocks(t)]
    try:
        return zstandard.train_dictionary(DICTIONARY, blocks).as_bytes()
    except zstandard.ZstdError:  # too little text to train on: the text itself serves
        return b"".join(blocks)[-DICTIONARY:]


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset by Newton's steps, with a weak pull of the slope to zero."""
    scale = x.std() or 1.0
    z, w = np.stack([x / scale, np.ones_like(x)], 1), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p) + 1e-9)[:, None]).T @ z + np.diag([0.1, 1e-6]), z.T @ (y - p) - np.array([0.1, 0]) * w)
        w = w + step
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0] / scale), float(w[1])


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit_quality(documents: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> QualityModel:
    """Learn from labelled rows that aren't held out."""
    known = labels.where(F.col("quality").isin(0, 1) & F.col(doc_id).isNotNull() & ~held_out(doc_id)).groupBy(F.col(doc_id).alias("id")).agg(F.min("quality").alias("q"), F.max("quality").alias("most")).where("q = most")
    order = F.xxhash64("id", F.lit(8))
    share = known.agg(F.avg("q")).first()[0]
    # 2 * sample ids at most
    chosen = known.where("q = 0").orderBy(order, "id").limit(sample).unionByName(known.where("q = 1").orderBy(order, "id").limit(sample)).withColumn("turn", F.xxhash64("id", F.lit(10)))
    texts = documents.select(F.col(doc_id).alias("id"), text_of(text).alias("t")).join(F.broadcast(chosen), "id").groupBy("id", "q", "turn").agg(F.min("t").alias("t"))
    texts = within_bytes(cut(texts), sample_bytes, "turn", "id")
    # rows without text come last, so that they don't take the turns of others
    rows = sorted(texts.collect(), key=lambda r: (not r["t"], r["turn"], r["id"]))
    by_label = [[r for r in rows if r["q"] == q] for q in (1, 0)]
    sides = [[r["t"].encode() for r in part[::2] if r["t"]] for part in by_label]
    rest = [r for part in by_label for r in part[1::2]]
    if not all(sides) or len({r["q"] for r in rest}) < 2:
        share = min(max(0.5 if share is None else float(share), 1e-6), 1 - 1e-6)
        return QualityModel(b"", b"", 0.0, float(np.log(share / (1 - share))))
    good, bad = map(_dictionary, sides)
    packers = [_packer(good), _packer(bad)]
    x = np.array([_difference(r["t"].encode(), packers) for r in rest])
    y = np.array([float(r["q"]) for r in rest])
    slope, offset = _logistic(x, y)
    # the sample holds the labels in other shares than the labelled rows do
    seen = y.mean()
    offset += float(np.log(share / (1 - share)) - np.log(seen / (1 - seen)))
    return QualityModel(good, bad, slope, offset)


def score_quality(documents: DataFrame, model: QualityModel, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        score = shared.value.scorer()
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([score(t) for t in batch.column(1).to_pylist()], pa.float64())], ["id", "score"])

    kind = documents.schema[doc_id].dataType.simpleString()
    scored = documents.select(F.col(doc_id).alias("id"), text_of(text).alias("t")).mapInArrow(run, f"id {kind}, score double")
    return scored.select(F.col("id").alias(doc_id), held_out("id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(documents: DataFrame, model: QualityModel, text: str = "text") -> DataFrame:
    """documents without those whose score is under one half."""
    shared, at = documents.sparkSession.sparkContext.broadcast(model), documents.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        score = shared.value.scorer()
        for batch in slices(batches):
            yield batch.filter(pa.array([score(t or "") >= 0.5 for t in batch.column(at).to_pylist()]))

    return documents.mapInArrow(run, documents.schema)
