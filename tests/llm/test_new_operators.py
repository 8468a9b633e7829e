"""Operators 11 and 13: fill-in-middle against SQL and plain Python, codebooks against a plain Lloyd."""

from __future__ import annotations

import hashlib
import math
import random
import re

import numpy as np
import pytest

from chronosweep.llm import codebooks, fim, queries
from tests.conftest import SMALL, same_as_oracle
from tests.llm.fixtures import ODD_TEXTS, odd_documents, rows_of


def plain_fim(doc_id, text, seed=42):
    text = text or ""
    units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    n, told = len(units), hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(told[8 * k : 8 * k + 8], 16) for k in range(4)]
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return doc_id, n, "plain", None, None, sha(text), sha(text)
    lo, hi = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:lo]), "".join(units[lo:hi]), "".join(units[hi:])
    form, out = ("spm", f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 80 else ("psm", f"<P>{p}<S>{s}<M>{m}")
    return doc_id, n, form, len(p), len(m), sha(out), sha(text)


FIM = ("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")


def test_fim_of_odd_texts(spark):
    rows = ODD_TEXTS + [(i, t) for i in range(20, 60) for t in ("a<b <S a>", f"w{i} <M>", " lead and trail \n", "<<S <P\t>x<", "one", "\U0001f600 two\x00 \x1f")]
    got = fim.digest_fim(odd_documents(spark, rows))
    assert sorted(map(repr, (tuple(r) for r in got.select(*FIM).collect()))) == sorted(repr(plain_fim(*r)) for r in rows)
    assert {r["form"] for r in got.collect()} == {"plain", "psm", "spm"}
    assert fim.digest_fim(odd_documents(spark, [])).collect() == []


def test_fim_of_all_small_documents(spark):
    same_as_oracle(queries.op11_fill_in_middle(spark, SMALL), queries.ORACLES["op11_fill_in_middle"])
    want = sorted(plain_fim(i, t) for i, t in rows_of("documents", "doc_id, text"))
    assert [r[:3] for r in sorted(tuple(r[c] for c in FIM) for r in queries.op11_fill_in_middle(spark, SMALL).collect())] == [r[:3] for r in want]


def test_fim_needs_no_python_and_no_shuffle(spark):
    plan = queries.op11_fill_in_middle(spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan


def test_other_sentinels_and_kept_columns(spark):
    docs = spark.createDataFrame([(i, f"some <P> text {i} of words", "x") for i in range(40)], "doc_id long, text string, output string")
    marks = ("[[pre]]", "((suf))", "{{mid}}")
    out = fim.fill_in_middle(docs, rate=100, spm=50, seed=7, sentinels=marks, keep=("text",))
    rows = out.select("text", fim.restored(out["output"], out["form"], marks).alias("back"), "form", "prefix", "middle", "suffix").collect()
    assert all(r["back"] == r["text"] == r["prefix"] + r["middle"] + r["suffix"] for r in rows) and {r["form"] for r in rows} == {"psm", "spm"}
    for bad in (("<P>", "<P>", "<M>"), ("aba", "<S>", "<M>"), ("<P>", "><S", "<M>"), ("", "<S>", "<M>"), ("a", "cab", "d")):
        with pytest.raises(ValueError):
            fim.fill_in_middle(docs, sentinels=bad)


def plain_lloyd(rows, entries=16, rounds=6, scale=4096, parts=8):
    """(codebooks digest, rows) by comparing everything with everything in Python's integers."""
    kept = [(i, v, lab) for i, v, lab in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0], r[1]))
    if not kept:
        return None, []
    size = len(kept[0][1])
    kept = [(i, [math.floor(x * scale) if abs(x) < 2**53 else int(x) * scale for x in v], lab) for i, v, lab in kept if len(v) == size]
    cuts = [(p * size // parts, (p + 1) * size // parts) for p in range(parts)]
    books = [[v[lo:hi] for _, v, _ in kept[:entries]] for lo, hi in cuts]

    def nearest(v):
        return [min((sum((a - b) ** 2 for a, b in zip(v[lo:hi], e, strict=True)), k) for k, e in enumerate(book)) for (lo, hi), book in zip(cuts, books, strict=True)]

    for _ in range(rounds):
        told = [nearest(v) for _, v, _ in kept]
        for p, (lo, hi) in enumerate(cuts):
            for k in range(len(books[p])):
                own = [v[lo:hi] for (_, v, _), t in zip(kept, told, strict=True) if t[p][1] == k]
                if own:
                    books[p][k] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    told = [nearest(v) for _, v, _ in kept]
    error = [sum(d for d, _ in t) for t in told]
    by_label: dict = {}
    for (_, _, lab), e in zip(kept, error, strict=True):
        by_label[lab] = by_label.get(lab, 0) + e
    long = lambda e: e if e < 2**63 else None
    return digest, sorted(((i, "".join(f"{k:02x}" for _, k in t), long(e), long(by_label[lab]), digest) for (i, _, lab), t, e in zip(kept, told, error, strict=True)), key=repr)


def coded(spark, rows, kind="double"):
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int").withColumnsRenamed({}).selectExpr("*", "'clash' AS code", "1 AS id", "'x' AS held", "2 AS error")
    return sorted((tuple(r) for r in codebooks.compress_vectors(df.repartition(5)).collect()), key=repr)


def test_codebooks_equal_plain_lloyd_on_the_small_table(spark):
    rows = rows_of("embeddings", "vec_id, embedding, label")
    digest, want = plain_lloyd(rows)
    got = sorted((tuple(r) for r in queries.op13_vector_codes(spark, SMALL).collect()), key=repr)
    assert got == want and len(got) == len(rows) and {r[4] for r in got} == {digest}


@pytest.mark.parametrize("seed", range(4))
def test_codebooks_of_odd_vectors(spark, seed):
    rng = random.Random(seed)
    grid = seed % 2  # a coarse grid makes ties between entries
    size = (16, 8, 19, 5)[seed]
    value = (lambda: float(rng.randint(-2, 2)) / 4096) if grid else (lambda: rng.gauss(0, 1))
    rows = [(i, [value() for _ in range(size)], rng.choice([None, 1, 2])) for i in range(300)]
    rows += [(1000, None, 1), (1001, [None] * size, 1), (1002, [float("nan")] * size, None), (1003, [float("inf")] * size, 2), (1004, [], 2), (1005, [1.0] * (size + 1), 2), (3, rows[3][1], 1), (3, rows[4][1], 1), (None, rows[5][1], None)]
    assert coded(spark, rows) == plain_lloyd(rows)[1]


def test_codebooks_of_few_none_and_huge_vectors(spark):
    assert coded(spark, []) == [] == coded(spark, [(1, None, 1)])
    few = [(i, [float(i * k) for k in range(16)], 1) for i in range(5)]
    assert coded(spark, few) == plain_lloyd(few)[1]
    huge = [(i, [(-1.0) ** k * 10.0 ** (i % 40) * (k + 1) for k in range(16)], i % 3) for i in range(60)] + [(99, [1e308] * 16, 4)]
    assert coded(spark, huge) == plain_lloyd(huge)[1]


def test_bounds_prune_most_distances():
    rng = np.random.default_rng(3)
    centres = rng.integers(-4000, 4000, (16, 8))
    x = (centres[rng.integers(0, 16, 4000)] + rng.integers(-200, 200, (4000, 8))).astype("i8")
    held, upper, lower = np.zeros(4000, "i8"), np.full(4000, np.inf, "f4"), np.zeros((4000, 16), "f4")
    book = centres.astype("i8")
    codebooks.assign(x, book, held, upper, lower)
    after = book + rng.integers(-20, 20, book.shape)
    grow = codebooks.shifts([book], [after])[0]
    upper, lower = np.nextafter(upper + grow[held], np.float32(np.inf)), np.maximum(lower - grow, 0).astype("f4")
    assert codebooks.assign(x, after, held, upper, lower) < 0.2 * 4000 * 16
    assert (held == ((x[:, None] - after[None]) ** 2).sum(2).argmin(1)).all()
