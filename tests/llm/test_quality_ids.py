"""The quality classifier learns whatever the ids are."""

from __future__ import annotations

from collections import Counter

import numpy as np

from chronosweep.llm import quality


def test_quality_learns_whatever_the_ids(spark):
    rng = np.random.default_rng(2)
    good, bad = ("river stone garden window morning letter".split(), "zzqx 0x1f buy!!! $$$ click {};".split())
    texts = [" ".join(rng.choice(good if k % 2 else bad, 60)) for k in range(200)]
    for ids in ([2 * k for k in range(200)], [2 * k + 1 for k in range(200)], [1000 * k for k in range(200)]):
        documents = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string")
        labels = spark.createDataFrame([(i, k % 2) for k, i in enumerate(ids)], "doc_id long, quality int")
        model = quality.fit_quality(documents, labels)
        assert model.good and model.bad
        assert Counter(r["doc_id"] for r in quality.keep_good(documents, model).collect()) == Counter(ids[1::2])
