"""Operator 12 against plain Python: every 50-byte string of every document."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest

from chronosweep.llm import queries, suffixes
from tests.conftest import SMALL, same_as_oracle
from tests.llm.fixtures import LONG, ODD_TEXTS, odd_documents, rows_of

COLUMNS = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def plain(rows, judged=None):
    """All rows, or those at the places judged, by a dict of every string's least id."""
    texts = [((10**30 if i is None else i), (t or "").encode()) for i, t in rows]
    least: dict[bytes, int] = {}
    for i, t in texts:
        for p in range(len(t) - 49):
            s = t[p : p + 50]
            if least.get(s, 10**31) > i:
                least[s] = i
    out = []
    for k, ((i, t), (told, _)) in enumerate(zip(texts, rows, strict=True)):
        if judged is not None and k not in judged:
            continue
        gone = bytearray(len(t))
        for p in range(len(t) - 49):
            if least[t[p : p + 50]] < i:
                gone[p : p + 50] = b"\1" * 50
        kept = bytes(c for c, g in zip(t, gone, strict=True) if not g)
        out.append((told, len(t), sum(gone), sum(1 for p in range(len(t)) if gone[p] and (p == 0 or not gone[p - 1])), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def found(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=repr)


def planted(seed, n=120):
    """Texts of few letters or of words, which share passages of 40 to 200 bytes, some whole copies."""
    rng = random.Random(seed)
    letters = "ab" if seed % 3 == 0 else "abcdefgh é\U0001f600"
    make = lambda k: "".join(rng.choice(letters) for _ in range(k))
    shared = [make(rng.randint(40, 200)) for _ in range(8)]
    rows = [(rng.randint(-5, n), "".join(rng.choice([make(rng.randint(0, 80)), rng.choice(shared)]) for _ in range(rng.randint(0, 8)))) for _ in range(n)]
    return rows + [(rng.randint(0, n), rows[k][1]) for k in range(0, n, 9)] + [(None, rows[1][1]), (None, rows[2][1]), (3, "z" * 300), (4, "z" * 120), (5, None), (6, ""), (7, shared[0][:49]), (8, shared[0][:50])]


@pytest.mark.parametrize("seed", range(4))
def test_repeats_against_plain_strings(spark, seed):
    rows = planted(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert found(suffixes.remove_repeats(docs, hot=(256, 1, 2, 0)[seed], slice_bytes=700)) == plain(rows)


def test_slices_and_levels_of_many_batches():
    """The whole path without a session: many slices of few documents, families with merges, hot anchors."""
    rows = planted(5, 200)
    parts, family = 3, {}
    data = []
    for at in range(0, len(rows), 4):
        texts = [(t or "").encode() for _, t in rows[at : at + 4]]
        text, ends = np.frombuffer(b"".join(texts), "u1"), np.cumsum([len(t) for t in texts])
        data.append((text, ends))
        tags = np.unique(suffixes.anchored(text, ends, parts).tag)
        for p in range(parts):
            family.setdefault(p, suffixes.Family()).add(at, tags[tags >> np.uint64(32) == p].astype("u4"))
    for p, f in family.items():
        assert [v.batches for v in f.levels] == sorted({v.batches for v in f.levels}, reverse=True) and sum(v.batches for v in f.levels) == len(data)
        keys = np.concatenate([v.keys for v in f.levels])
        assert len(keys) == len(np.unique(keys)) and all((np.diff(v.keys.astype("i8")) > 0).all() for v in f.levels)
        owner, common, _ = f.found(256)
        held: dict = {}
        for k, (text, ends) in enumerate(data):
            tags = np.unique(suffixes.anchored(text, ends, parts).tag)
            for key in tags[tags >> np.uint64(32) == p].astype("u4").tolist():
                held.setdefault(key, set()).add(4 * k)
        assert sorted(zip(common.tolist(), owner.tolist(), strict=True)) == sorted((key, s) for key, x in held.items() if len(x) > 1 for s in x)


def test_batches_one_after_another_equal_one_batch(spark):
    rows = sorted((r for r in planted(7, 150) if r[0] is not None), key=lambda r: r[0])
    cuts = [k for k in range(1, len(rows)) if rows[k][0] != rows[k - 1][0]]
    edges = [0, cuts[len(cuts) // 4], cuts[len(cuts) // 2], cuts[3 * len(cuts) // 4], len(rows)]
    index, out = None, []
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        done, index = suffixes.add(spark.createDataFrame(rows[a:b], "doc_id long, text string").repartition(2), index, slice_bytes=900)
        out += found(done)
        index = index._replace(slices=suffixes.cut(index.slices), levels=suffixes.cut(index.levels))
    assert sorted(out, key=repr) == plain(rows)
    assert index.batches == 4 and index.levels.where("batches > 0").count() <= 3 * index.parts


def test_odd_and_empty_tables(spark):
    rows = ODD_TEXTS + [(40, LONG[500:9000] + "x" + LONG[:700]), (0, LONG[100:160])]
    assert found(suffixes.remove_repeats(odd_documents(spark, rows))) == plain(rows)
    assert found(suffixes.remove_repeats(odd_documents(spark, []))) == []
    kept = suffixes.add(spark.createDataFrame([(1, "p" * 60), (2, "a" + "p" * 60 + "é")], "doc_id long, text string"), texts=True, keep=False)[0]
    assert {r["doc_id"]: bytes(r["kept"]) for r in kept.collect()} == {1: b"p" * 60, 2: "aé".encode()}


def test_repeats_of_the_small_table(spark):
    got = queries.op12_suffix_array_dedup(spark, SMALL)
    same_as_oracle(got, queries.ORACLES["op12_suffix_array_dedup"])
    assert found(got) == plain(rows_of("documents", "doc_id, text"))


def test_anchors_are_those_of_the_string_alone():
    rng = np.random.default_rng(1)
    text = rng.integers(97, 101, 70_000).astype("u1")
    runs = suffixes.anchored(text, np.array([len(text)]), 1)
    assert (runs.first[1:] == runs.last[:-1] + 1).all() and runs.first[0] == 0 and runs.last[-1] == len(text) - 50
    for p in (0, 17, 65_535, 65_536, 65_500, 69_900):
        alone = suffixes.anchored(text[p : p + 50], np.array([50]), 1)
        assert alone.tag[0] == runs.tag[np.searchsorted(runs.last, p)]
