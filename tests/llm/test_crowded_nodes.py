"""Fingerprints that share a long prefix are dealt in blocks, and no link is lost between blocks."""

import random

import pytest

from chronosweep.llm import simhash
from chronosweep.llm.components import components


def plain_groups(values, budget):
    parent = {v: v for v in values}

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for n, a in enumerate(values):
        for b in values[n + 1 :]:
            if ((a ^ b) & (2**64 - 1)).bit_count() <= budget:
                parent[root(a)] = root(b)
    return {frozenset(v for v in values if root(v) == r) for r in map(root, values)} - {frozenset([v]) for v in values}


@pytest.mark.parametrize("block", [1 << 20, 40, 7])
def test_crowded_nodes(spark, monkeypatch, block):
    monkeypatch.setattr(simhash, "BLOCK", block)
    draw = random.Random(block)
    template = draw.getrandbits(64)
    # half share 44 bits with a template, the others lie near it in the upper bits too or anywhere
    values = {template ^ draw.getrandbits(20) for _ in range(150)}
    values |= {v ^ sum(1 << draw.randrange(64) for _ in range(2)) & (2**64 - 1) for v in list(values)[:60]}
    values |= {draw.getrandbits(64) for _ in range(60)}
    signed = sorted(v - 2**64 if v >= 2**63 else v for v in values)
    distinct = spark.createDataFrame([(v,) for v in signed], "fp long")
    groups = {}
    for r in components(simhash.near_links(distinct)).collect():
        groups.setdefault(r["component"], set()).add(r["node"])
    assert {frozenset(g) for g in groups.values()} == plain_groups(signed, simhash.BUDGET)
