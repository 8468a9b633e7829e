"""Scores of the learned operators against plain versions of the same models."""

from __future__ import annotations

import math
from collections import Counter, defaultdict

import numpy as np
import pytest
import zstandard

from chronosweep.llm import language, quality

TEXTS = {"aa": ["Die Sonne scheint, die Vögel singen.", "ein zweiter Satz; noch einer!", "Sonne"], "bb": ["The sun is shining and the birds sing.", "a second sentence. one more?", ""]}


def sequence(text: str) -> str:
    out = " "
    for c in f"{text.lower()} ":
        c = c if c.isalpha() else " "
        out += "" if c == " " and out[-1] == " " else c
    return out


class PlainKneserNey:
    def __init__(self, texts: list[str], order: int = language.ORDER):
        grams = Counter()
        for t in texts:
            s = " " * (order - 1) + sequence(t)
            grams.update(s[i - order + 1 : i + 1] for i in range(order, len(s)))
        self.levels = []
        for n in range(order, 0, -1):
            total, kinds = Counter(), Counter()
            for g, c in grams.items():
                total[g[:-1]] += c
                kinds[g[:-1]] += 1
            self.levels.insert(0, (grams, total, kinds))
            if n > 1:
                left = defaultdict(set)
                for g in grams:
                    left[g[1:]].add(g)
                grams = Counter({g: len(x) for g, x in left.items()})

    def p(self, gram: str) -> float:
        p = 1 / language.UNSEEN
        for n, (counts, total, kinds) in enumerate(self.levels, 1):
            g = gram[-n:]
            if total[g[:-1]]:
                p = max(counts[g] - language.DISCOUNT, 0) / total[g[:-1]] + language.DISCOUNT * kinds[g[:-1]] / total[g[:-1]] * p
        return p

    def entropy(self, text: str) -> float:
        s, order = " " * (len(self.levels) - 1) + sequence(text), len(self.levels)
        return -sum(math.log(self.p(s[i - order + 1 : i + 1])) for i in range(order, len(s))) / len(sequence(text))


def test_entropies_equal_a_plain_model():
    model = language._build(["aa", "bb"], TEXTS)
    plain = {name: PlainKneserNey(texts) for name, texts in TEXTS.items()}
    wanted = [*TEXTS["aa"], *TEXTS["bb"], "Something QUITE else: Ærøskøbing 12", "zzz", "語", "sing die sun"]
    cross, letters = model.entropies(wanted)
    for k, text in enumerate(wanted):
        assert cross[k] == pytest.approx([plain["aa"].entropy(text), plain["bb"].entropy(text)], rel=1e-4), text
        assert letters[k] == any(c.isalpha() for c in text)


def test_quality_scores_equal_a_plain_compressor(spark):
    rng = np.random.default_rng(2)
    good, bad = ("river stone garden window morning letter".split(), "zzqx 0x1f buy!!! $$$ click {};".split())
    rows = [(k, " ".join(rng.choice(good if k % 2 else bad, 200 + k))) for k in range(120)]
    rows += [(500, ""), (501, None), (502, "é" * 5000), (503, "one")]
    documents = spark.createDataFrame(rows, "doc_id long, text string")
    model = quality.fit_quality(documents, spark.createDataFrame([(k, k % 2) for k in range(120)], "doc_id long, quality int"))
    got = {r["doc_id"]: r["score"] for r in quality.score_quality(documents, model).collect()}

    def size(data: bytes, dictionary: bytes) -> int:
        packer = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(dictionary), write_content_size=False, write_dict_id=False)
        return sum(len(packer.compress(data[i : i + 2048])) for i in range(0, len(data), 2048))

    for k, text in rows:
        data = (text or "").encode()
        a, b = size(data, model.good), size(data, model.bad)
        x = (b - a) / (a + b) if data else 0.0
        assert got[k] == pytest.approx(1 / (1 + math.exp(-max(-30, min(30, model.slope * x + model.offset)))), rel=1e-6), k
    assert all((got[k] >= 0.5) == bool(k % 2) for k in range(120))
