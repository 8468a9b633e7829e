"""Benchmark decontamination: size-partitioned MinHash containment search.

Test items are partitioned by their number of word shingles into classes of half powers
of two.  For a class of up to s shingles, a document is covered by windows of three blocks
of s / 2 shingles, each window starting a block after the one before it, so an item that
stands in the document stands whole in one window of about its own size, however long the
document.  An item is a candidate where one of ``HASHES`` minima over a window equals the
item's own, and a candidate is verified by exact containment: the share of the item's
distinct shingles that the document holds, compared as words.

An item has over 0.7 s shingles, so one that stands there unchanged makes up at least 0.47
of the joint shingles of some window (a third for a single shingle), and one that stands
there to 0.8 at least 0.34: all minima miss with a chance under 0.66 to the power of
``HASHES``, one in 20,000.  That needs distinct shingles: items that repeat themselves, with
fewer distinct ones than ``DISTINCT`` of their class, are looked up by all their distinct
shingles and are candidates wherever a document holds enough of them, so none is missed.
Other items whose shingles are scattered over a document can be missed more often.

Distinct item texts go to the tasks in blocks of bounded size, and ids join what is found
by a key of the text; documents aren't shuffled.

Words are runs of letters and digits in lower case, shingles five words.  Defined
results: an item of fewer words is one shingle of all its words; items and documents
without words (null, empty) match nothing; repeated items and documents each give
their rows; ids may be null; empty tables give no rows; ``find_leaks`` ignores other
columns and ``drop_leaks`` keeps them.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronosweep.llm.common import Bounded, cut, slices, text_of

WORDS, LEAST = 5, 0.8
HASHES = 24
#: Share of its class's size that an item's distinct shingles must reach to be searched by minima.
DISTINCT = 0.7
#: Bytes of distinct item texts that go to the tasks at once.
ITEM_BYTES = 8 << 20
SEED = 9
_PRIME = np.uint64(0x9E3779B97F4A7C15)
_WORD = re.compile(r"[^\W_]+")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    return x ^ (x >> np.uint64(27))


def size_class(shingles: int) -> int:
    """The least half power of two, rounded up, that isn't under a number of shingles."""
    k = max(0, math.ceil(2 * math.log2(shingles)) - 1)
    return next(s for s in (math.ceil(2 ** (k / 2)), math.ceil(2 ** ((k + 1) / 2))) if s >= shingles)


class _Hasher:
    def __init__(self):
        self.word = Bounded(lambda w: xxhash.xxh64_intdigest(w.encode(), SEED))

    def words(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.word.__getitem__, words), "u8", len(words))

    @staticmethod
    def shingles(hashes: np.ndarray, n: int) -> np.ndarray:
        """Hashes of every n words that follow one another."""
        m = max(0, len(hashes) - n + 1)
        out = np.zeros(m, "u8")
        for k in range(n):
            out = out * _PRIME + hashes[k : k + m]
        return _mixed(out)


_draw = np.random.default_rng(SEED).integers(1, 1 << 63, (2, HASHES), dtype="u8")
_TIMES, _PLUS = _draw[0] * np.uint64(2) + np.uint64(1), _draw[1]


def _permuted(hashes: np.ndarray, k: int) -> np.ndarray:
    x = hashes * _TIMES[k] + _PLUS[k]
    return x ^ (x >> np.uint64(32))


class ItemIndex:
    """A block of items: for each shingle length and size class, the items' minima in sorted arrays; repetitive items by all their shingles."""

    def __init__(self, items: list[tuple]):
        self.items, hasher = [], _Hasher()
        classes, repeating = defaultdict(list), defaultdict(list)
        for item_id, text in items:
            words = words_of(text)
            if not words:
                continue
            n = min(WORDS, len(words))
            shingles = {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}
            hashes = np.unique(hasher.shingles(hasher.words(words), n))
            size = size_class(len(words) - n + 1)
            (repeating[n] if len(hashes) < DISTINCT * size else classes[n, size]).append(len(self.items))
            self.items.append((item_id, n, shingles, hashes))
        self.minima, anchors = {}, defaultdict(list)
        for key, which in classes.items():
            tables = []
            for k in range(HASHES):
                found = [_permuted(self.items[i][3], k) for i in which]
                least = np.array([f.min() for f in found])
                anchors[key[0]] += [self.items[i][3][f.argmin()] for i, f in zip(which, found, strict=True)]
                order = np.argsort(least, kind="stable")
                tables.append((least[order], np.array(which)[order]))
            self.minima[key] = tables
        #: by shingle length: the distinct shingles of repetitive items in order, and whose they are
        self.repeating = {}
        for n, which in repeating.items():
            keys = np.concatenate([self.items[i][3] for i in which])
            order = np.argsort(keys, kind="stable")
            self.repeating[n] = keys[order], np.repeat(which, [len(self.items[i][3]) for i in which])[order]
        #: the shingles that some minimum of some item comes from, by shingle length
        self.anchors = {n: np.unique(np.array(found, "u8")) for n, found in anchors.items()}

    def search(self, texts: list[list[str]], hasher: _Hasher) -> list[list[tuple]]:
        """For each document's words: (item_id, shingles of the item, of these in the document)."""
        hashed = [hasher.words(w) for w in texts]
        candidates: list[set] = [set() for _ in texts]
        for n in {n for n, _ in self.minima} | set(self.repeating):
            parts = [hasher.shingles(h, n) for h in hashed]
            if n in self.repeating:
                for found, p in zip(candidates, parts, strict=True):
                    found.update(self._repeated(p, n))
            if n not in self.anchors:
                continue
            # a window's minimum equals an item's only where both come from one shingle: other documents need no windows
            which_docs = np.array([d for d, p in enumerate(parts) if self._anchored(p, n)], np.int64)
            if not len(which_docs):
                continue
            parts = [parts[d] for d in which_docs]
            sizes = np.array([len(p) for p in parts])
            every = np.concatenate(parts)
            begins = np.cumsum(sizes) - sizes
            covers = {}
            for c in {c for m, c in self.minima if m == n}:
                block = -(-c // 2)
                blocks = -(-sizes // block)
                owner = np.repeat(np.arange(len(sizes)), blocks)
                at = np.repeat(begins, blocks) + (np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)) * block
                covers[c] = owner, at, owner[1:] == owner[:-1], owner[2:] == owner[:-2]
            for k in range(HASHES):
                values = _permuted(every, k)
                for c, (owner, at, one, two) in covers.items():
                    own = np.minimum.reduceat(values, at)
                    least = own.copy()
                    least[:-1] = np.where(one, np.minimum(least[:-1], own[1:]), least[:-1])
                    least[:-2] = np.where(two, np.minimum(least[:-2], own[2:]), least[:-2])
                    keys, which = self.minima[n, c][k]
                    lo, hi = np.searchsorted(keys, least), np.searchsorted(keys, least, "right")
                    for i in np.flatnonzero(hi > lo):
                        candidates[which_docs[owner[i]]].update(which[lo[i] : hi[i]].tolist())
        return [self._verify(words, sorted(found)) if found else [] for words, found in zip(texts, candidates, strict=True)]

    def _anchored(self, hashes: np.ndarray, n: int) -> bool:
        anchors = self.anchors[n]
        at = np.minimum(np.searchsorted(anchors, hashes), len(anchors) - 1)
        return bool((anchors[at] == hashes).any())

    def _repeated(self, hashes: np.ndarray, n: int) -> list[int]:
        """Repetitive items of whose distinct shingles a document holds enough."""
        keys, owner = self.repeating[n]
        at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
        held = np.unique(hashes[keys[at] == hashes])
        if not len(held):
            return []
        lo, hi = np.searchsorted(keys, held), np.searchsorted(keys, held, "right")
        which, inside = np.unique(np.concatenate([owner[a:b] for a, b in zip(lo, hi, strict=True)]), return_counts=True)
        return [int(i) for i, k in zip(which, inside, strict=True) if k >= LEAST * len(self.items[i][3])]

    def _verify(self, words: list[str], found: list[int]) -> list[tuple]:
        held, out = {}, []
        for i in found:
            item_id, n, shingles, _ = self.items[i]
            if n not in held:
                held[n] = {tuple(words[j : j + n]) for j in range(len(words) - n + 1)}
            inside = len(shingles & held[n])
            if inside >= LEAST * len(shingles):
                out.append((item_id, len(shingles), inside))
        return out


def _keyed(items: DataFrame, text: str) -> DataFrame:
    return items.withColumn("_t", text_of(text)).withColumn("_key", F.sha2(F.col("_t").cast("binary"), 256))


def _blocks(items: DataFrame, text: str) -> Iterator[ItemIndex]:
    """Indexes of distinct item texts under their keys."""
    held = cut(_keyed(items, text).groupBy("_key").agg(F.first("_t").alias("_t")))
    size = held.agg(F.sum(F.octet_length("_t"))).first()[0] or 0
    parts = max(1, math.ceil(size / ITEM_BYTES))
    for k in range(parts):
        rows = held.where(F.pmod(F.xxhash64("_key"), F.lit(parts)) == k).collect()
        yield ItemIndex(sorted((r["_key"], r["_t"]) for r in rows))


def find_leaks(documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text") -> DataFrame:
    """doc_id, item_id, n_shingles, n_found, containment: the items that a document holds to 0.8 or more."""
    ids = documents.schema[doc_id].dataType.simpleString()
    held = documents.select(F.col(doc_id).alias("id"), text_of(text).alias("t"))
    out = None
    for index in _blocks(items, text):
        shared = documents.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            hasher = _Hasher()
            for batch in slices(batches):
                found = shared.value.search([words_of(t) for t in batch.column(1).to_pylist()], hasher)
                owner = [i for i, pairs in enumerate(found) for _ in pairs]
                flat = [p for pairs in found for p in pairs]
                kinds = pa.string(), pa.int64(), pa.int64()
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner, pa.int64())), *(pa.array([p[k] for p in flat], kind) for k, kind in enumerate(kinds))], ["doc", "_key", "n_shingles", "n_found"])

        part = held.mapInArrow(run, f"doc {ids}, _key string, n_shingles long, n_found long")
        out = part if out is None else out.unionByName(part)
    named = _keyed(items, text).select("_key", F.col(item_id).alias("_item"))
    return out.join(named, "_key").select(F.col("doc").alias(doc_id), F.col("_item").alias(item_id), "n_shingles", "n_found", (F.col("n_found") / F.col("n_shingles")).alias("containment"))


def drop_leaks(documents: DataFrame, items: DataFrame, text: str = "text") -> DataFrame:
    """documents without those that hold an item."""
    at = documents.columns.index(text)
    for index in _blocks(items, text):
        shared = documents.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            hasher = _Hasher()
            for batch in slices(batches):
                found = shared.value.search([words_of(t) for t in batch.column(at).to_pylist()], hasher)
                yield batch.filter(pa.array([not pairs for pairs in found], pa.bool_()))

        documents = documents.mapInArrow(run, documents.schema)
    return documents
