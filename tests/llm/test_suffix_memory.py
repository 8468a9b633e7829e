"""Operator 12: what a slice or a verifying task takes of memory, however much of it others hold."""

from __future__ import annotations

import hashlib
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from chronosweep.llm import suffixes
from tests.llm.test_suffixes import plain, planted

PARTS, DEALS = 3, 5


def packed(number, rows):
    texts = [(t or "").encode() for _, t in rows]
    ends = np.cumsum([len(t) for t in texts]).astype("i8")
    body = suffixes.zstandard.compress(b"".join(texts))
    return pa.table({"slice": [number], "ids": [[i for i, _ in rows]], "ends": [ends.tobytes()], "body": [body], "bytes": [int(ends[-1])]})


def tags_of(rows):
    texts = [(t or "").encode() for _, t in rows]
    return np.unique(suffixes.anchored(np.frombuffer(b"".join(texts), "u1"), np.cumsum([len(t) for t in texts]), PARTS).tag)


def noted(tags, crowded, hits=()):
    blobs = [(p, suffixes._blob(suffixes._steps(tags[own].astype("u4")), crowded[own]), 0) for p in range(PARTS) for own in [tags >> np.uint64(32) == p] if own.any()]
    blobs += [(None, h, 1) for h in hits]
    return pa.table({"part": pa.array([b[0] for b in blobs], pa.int32()), "keys": pa.array([b[1] for b in blobs], pa.binary()), "kind": pa.array([b[2] for b in blobs], pa.int32())})


def peak_mb(run):
    tracemalloc.start()
    try:
        run()
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_a_slice_of_crowded_anchors_takes_little_memory():
    """All anchors of half a megabyte are crowded: half a million strings, 804 MB when they were laid out together."""
    rng = random.Random(3)
    rows = [(k, "".join(rng.choices("abcdefgh ", k=5_000))) for k in range(100)]
    tags = tags_of(rows)
    notes = noted(tags, np.ones(len(tags), bool))
    told = []
    assert peak_mb(lambda: told.append(suffixes._told(PARTS, DEALS, 0)(packed(7, rows), notes))) < 150
    assert sorted(told[0].column("deal").unique().to_pylist()) == list(range(DEALS))


def test_one_task_of_equal_strings_takes_little_memory():
    rows = [(1, "z" * 200_000), (2, "z" * 200_000)]
    tags = tags_of(rows)
    for crowded in (True, False):
        assert peak_mb(lambda crowded=crowded: suffixes._told(PARTS, DEALS, 0)(packed(7, rows), noted(tags, np.full(len(tags), crowded)))) < 100


def test_anchors_are_crowded_by_their_runs_not_by_slices():
    """A line that very many slices hold once is one piece of each; it isn't dealt string by string."""
    family = suffixes.Family()
    for k in range(400):
        family.add(k, np.array([5, 9], "u4"), np.array([1, 500]))
    _, keys, crowded = family.found(suffixes.HOT)
    assert set(keys[crowded].tolist()) == {9} and set(keys[~crowded].tolist()) == {5}


@pytest.mark.parametrize(("seed", "hot"), [(0, 0.0), (1, 0.5), (2, 1.0), (3, 0.5)])
def test_blocks_of_pieces_against_plain_strings(monkeypatch, seed, hot):
    """Slices told, verified and cut in blocks of very few pieces and strings."""
    monkeypatch.setattr(suffixes, "AT_ONCE", 7)
    monkeypatch.setattr(suffixes, "STRINGS", 5)
    rows = [r for r in planted(seed, 90) if r[0] is not None]
    groups = [rows[k : k + 12] for k in range(0, len(rows), 12)]
    tags = [tags_of(g) for g in groups]
    crowded = [(suffixes._mixed(t) % np.uint64(100)) < np.uint64(100 * hot) for t in tags]
    told = pa.concat_tables([suffixes._told(PARTS, DEALS, 0)(packed(k, g), noted(tags[k], crowded[k])) for k, g in enumerate(groups)])
    deals = np.array(told.column("deal").to_pylist())
    hits = pa.concat_tables([suffixes._verified(told.take(np.flatnonzero(deals == d))) for d in range(DEALS)])
    of = np.array(hits.column("slice").to_pylist())
    out = []
    for k, g in enumerate(groups):
        mine = [hits.column("keys")[int(j)].as_py() for j in np.flatnonzero(of == k)]
        out += suffixes._removed(PARTS, DEALS, False)(packed(k, g), noted(tags[k], crowded[k], mine)).to_pylist()
    found = sorted((tuple(r[c] for c in ("id", "n_bytes", "n_removed", "n_spans", "kept_sha256")) for r in out), key=repr)
    assert found == plain(rows)
    assert any(r[4] != hashlib.sha256((t or "").encode()).hexdigest() for r, (_, t) in zip(found, rows, strict=True))
