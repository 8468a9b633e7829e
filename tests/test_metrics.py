"""Hand-calculated metrics, stops and filters."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from chronosweep.functions.exprs import norm_cdf, norm_ppf, time_filter
from chronosweep.operators import cost, metrics, pricing, reconcile


def of(spark, trials: dict[int, list[float]], **more):
    rows = [(t, k + 1, float(p)) for t, ps in trials.items() for k, p in enumerate(ps)]
    return {r["trial_id"]: r for r in metrics.trial_metrics(spark.createDataFrame(rows, "trial_id long, i long, pnl double"), **more).collect()}


def test_metrics(spark):
    got = of(spark, {1: [10, -5, 20, -3], 2: [10, 20, 15], 3: [10, -5, 20, -3, 15, -2, 8, -4, 12, -1]}, avg_sl=15.0)
    assert (got[1]["win_rate"], got[1]["profit_factor"]) == (0.5, 3.75)
    assert (got[2]["profit_factor"], got[2]["max_dd_pct"]) == (10, 0)
    assert (got[3]["expectancy_pips"], got[3]["max_consec_loss"]) == (5, 1) and got[3]["profit_factor"] == pytest.approx(65 / 15)


def test_deflated_ratio(spark):
    one = spark.createDataFrame([(1, 0.9)], "trial_id long, psr double")
    assert metrics.with_dsr(one).first()["dsr"] == 0.9
    few, many = (metrics.with_dsr(spark.range(n).select(F.col("id").alias("trial_id"), F.lit(0.9).alias("psr"))).first()["dsr"] for n in (5, 50))
    assert many < few < 0.9


def test_normal_functions(spark):
    rows = spark.createDataFrame([(p,) for p in (1e-6, 0.01, 0.2, 0.5, 0.9, 0.99, 1 - 1e-6)], "p double")
    assert all(abs(r["q"] - r["p"]) < 2e-7 for r in rows.withColumn("q", norm_cdf(norm_ppf(F.col("p")))).collect())


def test_stops(spark):
    base = {"direction": 1, "entry_price": 1.1, "atr_pips": 10.0, "pip": 1e-4, "sl_mode": 0, "tp_mode": 2, "sl_fixed_pips": 20.0, "sl_atr_mult": 1.5, "tp_rr": 2.0, "tp_atr_mult": 1.0, "tp_fixed_pips": 40.0, "swing_sl": 1.09}
    cases = [({}, (1.098, 1.104)), ({"direction": -1, "sl_mode": 1, "tp_mode": 0}, (1.1015, 1.097)), ({"tp_mode": 0, "tp_rr": 0.5}, (1.098, 1.102)), ({"sl_mode": 2, "swing_sl": 1.1 - 0.2e-4}, (1.0995, 1.104))]
    for change, want in cases:
        row = pricing.stops(spark.createDataFrame([base | change])).first()
        assert (row["sl_price"], row["tp_price"]) == pytest.approx(want)


def test_hours_may_wrap(spark):
    hours = spark.range(24).where(time_filter(F.col("id"), F.lit(2), F.lit(22), F.lit(6), F.lit(0b100)))
    assert {r["id"] for r in hours.collect()} == {22, 23, *range(7)}


def test_overlay(spark):
    trades = spark.createDataFrame([("EUR_USD", 36_000, 10.0, 0.32, None)], "pair string, s long, pnl double, bt_spread_pips double, reason string")
    costs = spark.createDataFrame([("EUR_USD", "London", 0.0)], "pair string, session string, spread_pips double")
    per = spark.createDataFrame([("EUR_USD", 0.35, 0.5)], "pair string, commission_per_side_pips double, slippage_per_side_pips double")
    row = cost.overlay(trades, costs, per).first()
    assert (row["delta"], row["adjusted_pnl"]) == pytest.approx((-0.78, 9.22))


def test_categories(spark):
    kind = "pair string, direction int, signal_s long, {0}_id long, {0}_entry double, {0}_exit double, {0}_pnl double"
    bt = spark.createDataFrame([("EUR_USD", 1, 0, 1, 1.085, 1.088, 30.0), ("EUR_USD", 1, 9, 2, 1.085, 1.088, 30.0)], kind.format("bt"))
    live = spark.createDataFrame([("EUR_USD", 1, 0, 1, 1.08505, 1.08795, 29.5), ("EUR_USD", 1, 9, 2, 1.086, 1.088, None)], kind.format("live"))
    got = {r["bt_id"]: r["categories"] for r in reconcile.classify(reconcile.match_exact(bt, live)).collect()}
    assert got == {1: [], 2: ["mismatched_entry_price"]}
