"""Near copies are found by tries of SimHash fingerprints: their walk, their fingerprints and their groups against brute force."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pytest

from chronosweep.llm import near_copies
from chronosweep.llm.simhash import BITS, subtree_links
from tests.llm.test_near_copies import edited


def test_subtrees_against_all_pairs():
    rng = np.random.default_rng(7)
    seeds = rng.integers(0, 1 << 63, 40, "u8") * np.uint64(2)
    prints = np.concatenate([seeds, *(seeds ^ np.uint64(1) << rng.integers(0, 64, 40).astype("u8") for _ in range(8)), seeds[:5]])
    prints.sort()
    for depth, budget in ((0, 3), (4, 2), (12, 1), (12, 13)):
        pairs = {(min(i, j), max(i, j)) for a, b in subtree_links(prints, depth, budget) for i, j in zip(a.tolist(), b.tolist(), strict=True)}
        apart = [(i, j, int(prints[i]) ^ int(prints[j])) for i, j in combinations(range(len(prints)), 2)]
        assert pairs == {(i, j) for i, j, x in apart if x >> (BITS - depth) == 0 and x.bit_count() <= budget}


def test_a_bit_is_the_majority_of_its_hashes():
    rng = np.random.default_rng(8)
    for n in (1, 2, 5, 300, 1000):
        shingles = rng.integers(0, 1 << 63, n, "u8")
        hashed = shingles[:, None] * near_copies._TIMES + near_copies._PLUS
        hashed = (hashed ^ hashed >> np.uint64(31)) * near_copies._PRIME
        hashed ^= hashed >> np.uint64(29)
        ones = np.unpackbits(hashed.view("u1"), axis=1).astype(int).sum(0)
        assert (np.unpackbits(near_copies.wide_print(shingles)) == (2 * ones > n)).all()


@pytest.mark.parametrize("crowd", [near_copies.CROWD, 100])
def test_tries_meet_what_is_alike(spark, monkeypatch, crowd):
    monkeypatch.setattr(near_copies, "CROWD", crowd)
    rng = np.random.default_rng(9)
    texts = [t for k in range(150) for t in edited(rng, 60 + k, 1 + k // 60)] + [t for _ in range(100) for t in [edited(rng, 9, 1)[0]] for t in (t, t.rsplit(" ", 1)[0])]
    sets = [near_copies.shingle_set(t) for t in texts]
    rows = [(k, len(s), bytearray(near_copies.wide_print(s).tobytes())) for k, s in enumerate(sets)]
    groups: dict[int, set] = {}
    for r in near_copies.trie_groups(spark.createDataFrame([*rows, (9999, 0, bytearray(128))], "node long, n int, print binary")).collect():
        groups.setdefault(r["value"], set()).add(r["node"])
    met = {p for g in groups.values() for p in combinations(sorted(g), 2)}
    alike = {(k, k + 1) for k in range(0, len(sets), 2) if 5 * len(np.intersect1d(sets[k], sets[k + 1])) >= 4 * len(np.union1d(sets[k], sets[k + 1]))}
    assert len(alike) >= 200 and alike <= met and all(9999 not in g and len(g) > 1 for g in groups.values())


def test_tries_follow_the_number_of_nodes():
    shapes = [near_copies.shape(n) for n in (0, 1, 1 << 20, 1 << 24, 1 << 28)]
    assert shapes[0] == shapes[1] == (12, 128) and all(n / 2 ** d <= near_copies.LEAVES for n, (d, _) in zip((0, 1, 1 << 20, 1 << 24, 1 << 28), shapes, strict=True) if d > 12)
    assert all(t * near_copies.AGREE**d >= near_copies.MEETINGS for d, t in shapes)
