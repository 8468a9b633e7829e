"""A group of near copies that many tries find in parts is compared as one cluster, and no pair of its groups is lost."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pytest

from chronosweep.llm import near_copies
from tests.llm.fixtures import odd_documents
from tests.llm.test_near_copies import as_kept, edited, kept_ids


def crowd(n):
    """Texts of one template with two to six other words each, near the threshold on both sides, and pairs of their own."""
    rng = np.random.default_rng(11)
    template = edited(rng, 150, 1)[0].split()
    texts = []
    for k in range(n):
        words = list(template)
        for at in rng.choice(len(words), 2 + k % 5, replace=False):
            words[at] = f"y{rng.integers(0, 10**9)}"
        texts.append(" ".join(words))
    return texts + [t for k in range(40) for t in edited(rng, 80, 1 + k % 3)]


def pairs_of(rows):
    held: dict[int, set] = {}
    for r in rows:
        held.setdefault(r["value"], set()).add(r["node"])
    return {p for g in held.values() for p in combinations(sorted(g), 2)}


@pytest.mark.parametrize("joined", [8, 2])
def test_clusters_keep_every_pair(spark, monkeypatch, joined):
    monkeypatch.setattr(near_copies, "JOINED", joined)
    sets = [near_copies.shingle_set(t) for t in crowd(200)]
    prints = [(k, len(s), bytearray(near_copies.wide_print(s).tobytes())) for k, s in enumerate(sets)]
    groups = near_copies.cut(near_copies.trie_groups(spark.createDataFrame(prints, "node long, n int, print binary")))
    before, after = groups.collect(), near_copies.clustered(groups).collect()
    assert pairs_of(before) <= pairs_of(after)
    assert {(r["node"], r["n"]) for r in after} == {(r["node"], r["n"]) for r in before}
    assert len(after) == len({(r["value"], r["node"]) for r in after}) <= len(before) / 8


@pytest.mark.parametrize(("block", "spread"), [(1000, 8), (30, 4)])
def test_rows_to_compare_follow_the_nodes(spark, monkeypatch, block, spread):
    monkeypatch.setattr(near_copies, "BLOCK", block)
    monkeypatch.setattr(near_copies, "SPREAD", spread, raising=False)
    compared, links = [], near_copies._links
    monkeypatch.setattr(near_copies, "_links", lambda shared, *rest: compared.append(shared.count()) or links(shared, *rest))
    texts = crowd(300)
    rows = list(enumerate(texts))
    assert as_kept(near_copies.drop_near_copies(odd_documents(spark, rows))) == kept_ids(rows)
    assert sum(compared) <= 8 * len(texts)
