"""Benchmark items that repeat themselves."""

from __future__ import annotations

import numpy as np

from chronosweep.llm import decontaminate


def test_repetitive_items_are_found_in_long_texts():
    rng = np.random.default_rng(6)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 6))
    items = []
    for positions, distinct in [(56, 1), (56, 3), (96, 5), (300, 30), (40, 25)] * 12:
        refrain = [word() for _ in range(distinct)]
        items.append((len(items), " ".join((refrain * positions)[: positions + 4])))
    index, hasher = decontaminate.ItemIndex(items), decontaminate._Hasher()
    texts = [[word() for _ in range(500)] + text.split() + [word() for _ in range(500)] for _, text in items]
    found = index.search(texts, hasher)
    assert [k for k, pairs in enumerate(found) if not any(i == k for i, *_ in pairs)] == []
    assert not any(index.search([[word() for _ in range(500)]], hasher))
