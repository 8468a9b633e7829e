"""Shards of skewed tables, and vectors of many components."""

from __future__ import annotations

import random

import numpy as np
import pytest

from chronosweep.llm import embeddings, sharding


@pytest.mark.parametrize("kind", ["empty", "short", "words"])
def test_rows_tokens_and_bytes_of_skewed_tables(spark, kind):
    rng = random.Random(4)
    odd = {"empty": "", "short": "same few words here", "words": "a " * 400}[kind]
    rows = [(k, odd) for k in range(3000)] + [(3000 + k, "x" * rng.randint(800, 1600) + f" {k} end") for k in range(3000)]
    df = sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(6))
    found = df.select("doc_id", "shard", "size").collect()
    texts = dict(rows)
    total = np.zeros((8, 3))
    for r in found:
        total[r["shard"]] += (r["size"], len(texts[r["doc_id"]].split()), 1)
    assert sorted(r["doc_id"] for r in found) == sorted(texts)
    spread = total.max(0) / total.mean(0)
    assert spread[0] < 1.03 and spread[1] < 1.1 and spread[2] < 1.1, total


def test_vectors_of_many_components(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=20_000)
    rows = [(1, base.tolist()), (2, (base + rng.normal(size=20_000) * 0.1).tolist()), (3, rng.normal(size=20_000).tolist()), (4, (-base).tolist())]
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embeddings.embedding_groups(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {1: (1, 1, True), 2: (1, 1, False), 3: (0, 3, True), 4: (0, 4, True)}
    assert [embeddings.code_kind(n) for n in (64, 8192, 16_384, 20_000, 40_000)] == ["i4", "i4", "i4", "i8", "i8"]
