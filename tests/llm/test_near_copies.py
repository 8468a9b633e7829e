"""Near copies against brute-force Jaccard of the shingles themselves."""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np

import corpus_pipeline
from chronosweep.llm import near_copies
from tests.llm.fixtures import ODD_TEXTS, odd_documents, rows_of
from tests.llm.test_corpus_operators import LARGER, least_of_groups


def shingles(text, words=5):
    parts = [p for p in (text or "").encode().lower().split() if p]
    return frozenset(tuple(parts[i : i + words]) for i in range(max(1, len(parts) - words + 1))) if parts else frozenset()


def jaccard_pairs(sets):
    """All pairs of different sets with a Jaccard similarity of 0.8 or more."""
    places, inside = defaultdict(list), Counter()
    for i, s in enumerate(sets):
        for x in s:
            places[x].append(i)
    for at in places.values():
        for k, j in enumerate(at):
            inside.update((i, j) for i in at[:k])
    return [(i, j) for (i, j), n in inside.items() if 5 * n >= 4 * (len(sets[i]) + len(sets[j]) - n)]


def kept_ids(rows):
    """The least id of each group; null ids come last."""
    sets = list(dict.fromkeys(shingles(t) for _, t in rows))
    group = least_of_groups(range(len(sets)), jaccard_pairs(sets))
    at, least = {s: k for k, s in enumerate(sets)}, {}
    for i, t in rows:
        g = group[at[shingles(t)]]
        least[g] = min(least.get(g, (True, 0)), (i is None, i or 0))
    return sorted(least.values())


def as_kept(df):
    return sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in df.select("doc_id").collect())


def edited(rng, size, edits):
    words = [f"w{k}" for k in rng.integers(0, 10**9, size)]
    other = list(words)
    for at in rng.choice(size, edits, replace=False):
        other[at] = f"x{rng.integers(0, 10**9)}"
    return " ".join(words), " ".join(other)


def test_edited_copies_go(spark):
    rng = np.random.default_rng(3)
    rows = [(2 * k + side, t) for k in range(100) for side, t in enumerate(edited(rng, 150 + k, 1 + k % 6))]
    rows += [(1000 + k, " ".join(["a long template of words that all of these texts share " * 8, *(f"v{(k * 7 + j) % 50}" for j in range(k % 12))])) for k in range(60)] + [(5000 + i, t) for i, t in ODD_TEXTS if i is not None]
    got = near_copies.drop_near_copies(odd_documents(spark, rows))
    assert got.columns == odd_documents(spark).columns
    assert as_kept(got) == kept_ids(rows)
    assert as_kept(near_copies.drop_near_copies(odd_documents(spark))) == kept_ids(ODD_TEXTS)
    assert near_copies.drop_near_copies(odd_documents(spark, [])).count() == 0


def test_stage_finds_all_near_copies(spark):
    docs = spark.read.parquet(f"{LARGER}/documents.parquet")
    assert as_kept(corpus_pipeline.drop_near_copies(spark, docs, LARGER)) == kept_ids(rows_of("documents", "doc_id, text", LARGER))


def test_recall_of_sketches():
    rng = np.random.default_rng(5)
    pairs = [[near_copies.shingle_set(t) for t in edited(rng, 400, 8)] for _ in range(300)]
    alike = [p for p in pairs if 5 * len(np.intersect1d(*p)) >= 4 * len(np.union1d(*p))]
    assert len(alike) >= 200 and all((near_copies.band_values(a) == near_copies.band_values(b)).any() for a, b in alike)
