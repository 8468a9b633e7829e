"""Language identification by interpolated Kneser-Ney models of characters.

Each language gets a model of order four over lower-case letters, with every run of
other characters read as one space.  The models share sorted arrays of n-gram hashes:
for each order one array of the n-grams that any language has seen, with every
language's interpolated log-probability beside it, and one of the contexts, with the
back-off weights.  A text's language is the one of lowest cross-entropy, divided by
the text's length; a logistic scale fitted on rows kept apart turns the entropies into
a score, and a floor under it, fitted so that one in two hundred right answers falls
below, marks doubtful texts as rejected.

The models learn from a bounded sample: of each language the ``sample`` rows of least
id hash, read whole, as far as all languages' texts hold ``sample_bytes`` together; each
language's first row comes before any language's second (texts over a sixteenth of that
aren't learned from).  Predictions read whole texts.

Defined results: null text and text without a letter get `und`, score 0 and are
rejected; with nothing to learn from, so does everything; ties go to the language
first by name; repeated rows each get a row; null ids are held in; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronosweep.llm.common import cut, slices, text_of, within_bytes

ORDER, DISCOUNT = 4, 0.75
SAMPLE, SAMPLE_BYTES = 200, 64 << 20
UNSEEN = 1 << 16  # symbols that the lowest order spreads its rest over
_PRIME = np.uint64(0x9E3779B97F4A7C15)
_letters: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _letters[0]


def symbols(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, each with a space before and after it, and each one's length."""
    padded = [f" {t.lower()} " for t in texts]
    lengths = np.array([len(t) for t in padded])
    codes = np.frombuffer("".join(padded).encode("utf-32-le"), "<u4")
    owner = np.repeat(np.arange(len(texts)), lengths)
    codes = np.where(_is_letter()[codes], codes, 32)
    keep = np.ones(len(codes), bool)
    keep[1:] = (codes[1:] != 32) | (codes[:-1] != 32) | (owner[1:] != owner[:-1])
    return codes[keep].astype("u8"), np.bincount(owner[keep], minlength=len(texts))


def gram_hashes(codes: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """The places after each text's first space and, for each order, the hash of the n-gram that ends there and of the one that ends a symbol before.  Spaces stand before a text."""
    begins = np.repeat(np.cumsum(lengths) - lengths, lengths)
    into = np.arange(len(codes)) - begins
    hashes = []
    for n in range(1, ORDER + 1):
        h = np.zeros(len(codes), "u8")
        for k in range(n - 1, -1, -1):
            shifted = np.where(into >= k, np.roll(codes, k), np.uint64(32))
            h = h * _PRIME + shifted + np.uint64(1)
        hashes.append(h)
    places = np.flatnonzero(into > 0)
    return places, [h[places] for h in hashes], [h[places - 1] for h in hashes]


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


class _One:
    """Counts of one language: for each order, n-grams, contexts and their weights."""

    def __init__(self, texts: list[str]):
        _, hashes, before = gram_hashes(*symbols(texts))
        self.own, self.weight = [None] * ORDER, [None] * ORDER
        grams, counts, place = None, None, None
        for n in range(ORDER, 0, -1):
            if n == ORDER:
                grams, place, counts = np.unique(hashes[n - 1], return_index=True, return_counts=True)
            else:  # how many different symbols stand before it
                grams, first, counts = np.unique(hashes[n - 1][place], return_index=True, return_counts=True)
                place = place[first]
            if n > 1:
                contexts, inverse = np.unique(before[n - 2][place], return_inverse=True)
            else:
                contexts, inverse = np.zeros(1, "u8"), np.zeros(len(grams), np.int64)
            total, kinds = np.bincount(inverse, counts), np.bincount(inverse)
            self.own[n - 1] = grams, np.maximum(counts - DISCOUNT, 0) / total[inverse]
            self.weight[n - 1] = contexts, DISCOUNT * kinds / total

    def log_p(self, suffixes: list[np.ndarray], contexts: list[np.ndarray]) -> np.ndarray:
        """Interpolated log-probability of n-grams, given the hashes of all their suffixes and of these without the last symbol."""
        p = np.full(len(suffixes[0]), 1.0 / UNSEEN)
        for n in range(1, len(suffixes) + 1):
            at, seen = _find(self.own[n - 1][0], suffixes[n - 1])
            own = np.where(seen, self.own[n - 1][1][at], 0.0)
            at, seen = _find(self.weight[n - 1][0], contexts[n - 1])
            p = own + np.where(seen, self.weight[n - 1][1][at], 1.0) * p
        return np.log(p)


@dataclass
class LanguageModel:
    names: list[str]
    grams: list[tuple[np.ndarray, np.ndarray]]
    backs: list[tuple[np.ndarray, np.ndarray]]
    scale: float = 1.0
    floor: float = 0.0

    def entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Nats a symbol by (text, language), and whether the text has a letter."""
        codes, lengths = symbols(texts)
        if not len(texts):
            return np.zeros((0, len(self.names))), np.zeros(0, bool)
        begins = np.cumsum(lengths) - lengths
        places, hashes, before = gram_hashes(codes, lengths)
        total = np.zeros((len(codes), len(self.names)), "f4")
        left = np.arange(len(places))
        for n in range(ORDER, 0, -1):
            at, seen = _find(self.grams[n - 1][0], hashes[n - 1][left])
            total[places[left[seen]]] += self.grams[n - 1][1][at[seen]]
            left = left[~seen]
            if not len(left):
                break
            if n > 1:
                at, seen = _find(self.backs[n - 1][0], before[n - 2][left])
                total[places[left[seen]]] += self.backs[n - 1][1][at[seen]]
        total[places[left]] += self.backs[0][1][0] - np.float32(np.log(UNSEEN))  # symbols that no language has seen
        sums = np.add.reduceat(total.astype("f8"), begins, axis=0)
        letters = np.add.reduceat((codes != 32).astype(np.int64), begins)
        return -sums / lengths[:, None], letters > 0

    def predict(self, texts: list[str]) -> list[tuple[str, float, bool]]:
        if not self.names:
            return [("und", 0.0, True)] * len(texts)
        cross, letters = self.entropies(texts)
        z = -self.scale * (cross - cross.min(1, keepdims=True))
        best = np.argmin(cross, 1)
        score = 1 / np.exp(z).sum(1)
        return [(self.names[b], float(s), bool(s < self.floor)) if ok else ("und", 0.0, True) for b, s, ok in zip(best, score, letters, strict=True)]


def _build(names: list[str], texts: dict[str, list[str]]) -> LanguageModel:
    ones = {name: _One(texts[name]) for name in names}
    _, hashes, before = gram_hashes(*symbols([t for name in names for t in texts[name]]))
    before = [np.zeros(len(hashes[0]), "u8"), *before]
    grams, backs = [], []
    for n in range(1, ORDER + 1):
        keys, place = np.unique(hashes[n - 1], return_index=True)
        table = [ones[name].log_p([hashes[k][place] for k in range(n)], [before[k][place] for k in range(n)]) for name in names]
        grams.append((keys, np.stack(table, 1).astype("f4")))
        keys = np.unique(np.concatenate([ones[name].weight[n - 1][0] for name in names]))
        table = []
        for name in names:
            at, seen = _find(ones[name].weight[n - 1][0], keys)
            table.append(np.where(seen, np.log(ones[name].weight[n - 1][1][at]), 0.0))
        backs.append((keys, np.stack(table, 1).astype("f4")))
    return LanguageModel(names, grams, backs)


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit_languages(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> LanguageModel:
    """Learn from rows with a language that aren't held out."""
    rows = documents.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & F.col(doc_id).isNotNull() & ~held_out(doc_id))
    ids = rows.select(F.col(doc_id).alias("id"), F.col(lang).alias("lang")).distinct()
    # ids whose hash can't be among the least of their language, by a margin of four, never meet in one task
    ids = cut(ids.withColumn("h", F.xxhash64("id", F.lit(10))))
    sizes = ids.groupBy("lang").agg(F.count("*").alias("size"))  # a row for each language, of which each gets a model here
    few = ids.join(F.broadcast(sizes), "lang").where((F.col("h") / F.lit(2.0**64) + 0.5) * F.col("size") <= 4 * sample + 100)
    chosen = few.withColumn("k", F.expr("row_number() over (partition by lang order by h, id)")).where(F.col("k") <= sample).select("id", "lang", "k")
    held = rows.select(F.col(doc_id).alias("id"), F.col(lang).alias("lang"), F.col(text).alias("t"))
    texts = held.join(F.broadcast(chosen), ["id", "lang"]).groupBy("lang", "id", "k").agg(F.min("t").alias("t"))
    taken = within_bytes(cut(texts), sample_bytes, "k", "lang").collect()
    names = sorted({r["lang"] for r in taken})
    if not names:
        return LanguageModel([], [], [])
    by_name = {name: [r["t"] for r in sorted(taken, key=lambda r: r["id"]) if r["lang"] == name] for name in names}
    apart = [(name, t) for name in names for t in by_name[name][::5]]
    trial = _build(names, {name: [t for i, t in enumerate(by_name[name]) if i % 5] or by_name[name] for name in names})
    cross, letters = trial.entropies([t for _, t in apart])
    right = np.array([names.index(name) for name, _ in apart])
    cross, right = cross[letters], right[letters]
    model = _build(names, by_name)
    if len(right):
        gap = cross - cross.min(1, keepdims=True)

        def loss(scale: float) -> float:
            return float((scale * gap[np.arange(len(right)), right] + np.log(np.exp(-scale * gap).sum(1))).mean())

        model.scale = min((2.0**k for k in range(0, 11)), key=loss)
        score = 1 / np.exp(-model.scale * gap).sum(1)
        good = score[cross.argmin(1) == right]
        model.floor = float(np.quantile(good, 0.005)) if len(good) else 0.0
    return model


def predict_languages(documents: DataFrame, model: LanguageModel, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 64):
            found = shared.value.predict(batch.column(1).to_pylist())
            arrays = [pa.array([f[k] for f in found], t) for k, t in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], ["id", "lang_pred", "score", "rejected"])

    kind = documents.schema[doc_id].dataType.simpleString()
    out = documents.select(F.col(doc_id).alias("id"), text_of(text).alias("t")).mapInArrow(run, f"id {kind}, lang_pred string, score double, rejected boolean")
    return out.select(F.col("id").alias(doc_id), held_out("id").alias("held_out"), "lang_pred", "score", "rejected")
