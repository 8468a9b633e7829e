"""The corpus pipeline stage by stage: each one's decisions take effect on all that it was given."""

from __future__ import annotations

from collections import Counter

import corpus_pipeline
from chronosweep.llm.common import cut
from tests.llm.fixtures import ODD_TEXTS, odd_documents, rows_of
from tests.llm.test_corpus_operators import LARGER, leak_rows
from tests.llm.test_near_copies import kept_ids
from tests.llm.test_text_operators import every_span, library_digests


def test_stages(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_copies", "benchmark", "secrets", "encode"]
    docs = spark.read.parquet(f"{LARGER}/documents.parquet")
    columns, kept = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        docs = cut(stage(spark, docs, LARGER))
        kept.append(docs)
        if name != "encode":
            assert docs.columns == columns
    rows = [[(r["doc_id"], r["text"]) for r in d.select("doc_id", "text").collect()] for d in kept[:4]]
    good, one, clean, masked = rows
    every = rows_of("documents", "doc_id, text", LARGER)
    labels = dict(rows_of("labels", "doc_id, quality", LARGER))
    assert set(good) <= set(every) and 0.75 * len(every) < len(good) < len(every)
    lost = {i for i, _ in every} - {i for i, _ in good}
    assert sum(labels.get(i) == 1 for i in lost) <= 0.03 * sum(labels.values())
    assert sorted((i is None, i or 0) for i, _ in one) == kept_ids(good)
    leaks = {d for d, *_ in leak_rows(one, rows_of("benchmark", "item_id, text", LARGER))}
    assert leaks and Counter(clean) == Counter(r for r in one if r[0] not in leaks)
    assert {i for i, _ in masked} == {i for i, _ in clean}
    assert all(("[SECRET]" in (t or "")) == bool(every_span(x or "")) for (_, t), (_, x) in zip(sorted(masked), sorted(clean), strict=True))
    got = Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in kept[4].collect())
    assert got == library_digests(masked)


def test_stages_of_odd_and_empty_tables(spark, tmp_path):
    spark.createDataFrame([(1, 1), (5, 0), (None, 1), (8, None)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(None, None), (1, ""), (2, "Forty two!")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for rows in ([*ODD_TEXTS, (20, "it is forty two, they say"), (21, None), (21, None)], []):
        docs = odd_documents(spark, rows).selectExpr("*", "'x' AS lang", "CAST(1 AS BIGINT) AS n_chars")
        columns = docs.columns
        for name, stage in corpus_pipeline.STAGES:
            docs = cut(stage(spark, docs, str(tmp_path)))
            assert name == "encode" or docs.columns == columns
        ids = [r["doc_id"] for r in docs.collect()]
        assert 20 not in ids and (not rows or 7 in ids) and len(ids) == len(set(ids))
