"""Hand-calculated indicators, and averages over many stretches."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from chronosweep.operators import indicators, ordered, signals


def bars(spark, high, low, close, step=3600):
    return spark.createDataFrame([("EUR_USD", k * step, float(h), float(lo), float(c)) for k, (h, lo, c) in enumerate(zip(high, low, close, strict=True))], "pair string, s long, high double, low double, close double")


def column(df, name):
    return [r[name] for r in df.orderBy("s").collect()]


def test_ema(spark):
    x = [8, 4, 10, 2, 6]
    for step in (3600, indicators.STRETCH, 2 * indicators.STRETCH + 7):
        assert column(indicators.emas(bars(spark, x, x, x, step), "close", [3]), "ema_3") == pytest.approx([8, 6, 8, 5, 5.5])


def test_ema_over_stretches_equals_one_pass(spark):
    x = np.random.default_rng(1).normal(size=700).cumsum() + 50
    got = column(indicators.emas(bars(spark, x, x, x, indicators.STRETCH // 40), "close", [12]), "ema_12")
    assert got == pytest.approx(pd.Series(x).ewm(span=12, adjust=False).mean().tolist(), rel=1e-12)


def test_atr(spark):
    # true ranges 1, 1.5 and 2.8: the third reaches from the close before down to the low
    b = bars(spark, [5.0, 6.0, 5.5], [4.0, 4.5, 3.0], [4.5, 5.8, 3.5])
    assert column(indicators.atr_ema(b, 2), "atr") == pytest.approx([1, 4 / 3, 104 / 45])


def test_flat_rsi(spark):
    x = [7.5] * 12
    assert column(indicators.rsi(bars(spark, x, x, x), 4), "rsi") == [100.0] * 12


def test_donchian(spark):
    b = bars(spark, [10, 11, 12, 11, 9, 13], [8, 9, 10, 7, 6, 8], [9, 10, 11.5, 8, 6.5, 12.5])
    assert {r["s"] // 3600: r["direction"] for r in signals.donchian(b, 2).collect()} == {2: 1, 3: -1, 5: 1}


def test_cells_and_stretches_equal_one_window(spark, monkeypatch):
    rng = np.random.default_rng(3)
    s = np.sort(rng.choice(400 * 86_400, 300, replace=False))
    rows = [(p, int(t) + k, float(x), None if rng.random() < 0.6 else float(x)) for k, p in enumerate("AB") for t, x in zip(s, rng.normal(size=300), strict=True)]
    df = spark.createDataFrame(rows, "pair string, s long, x double, v double")
    want = pd.DataFrame(rows, columns=["pair", "s", "x", "v"]).sort_values(["pair", "s"])
    by = want.groupby("pair")
    want["lag"], want["top"], want["last"], want["rn"] = by["x"].shift(1), by["x"].transform(lambda x: x.rolling(5, 1).max()), by["v"].ffill(), by.cumcount() + 1
    monkeypatch.setattr(ordered, "CELL", 9)
    made = ordered.in_order(df, 4, lambda d, w: d.withColumns({"lag": F.lag("x").over(w), "top": F.max("x").over(w.rowsBetween(-4, 0)), "no": F.col("rn")}))
    got = ordered.carried(made, F.col("v"), "last").toPandas().sort_values(["pair", "s"])
    for name, other in (("lag", "lag"), ("top", "top"), ("last", "last"), ("no", "rn")):
        assert np.allclose(got[name].to_numpy(float), want[other].to_numpy(float), equal_nan=True), name


def test_invalid_combinations(spark):
    for params in ((12, 12, 9), (5, 9, 9)):
        with pytest.raises(signals.InvalidCombination):
            signals.macd_cross(None, *params)
