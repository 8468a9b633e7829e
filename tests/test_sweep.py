"""Sweeps: joins of trials and signals, slots, ranking of what isn't finite, and small helpers."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from chronosweep.operators import cost, encoders, metrics, ranking, resample, signals, space, sweep

NAN = float("nan")


def test_opt_outs_take_part_with_all(spark):
    trials = spark.createDataFrame([(1, 0.0), (2, 1.0), (3, -1.0), (4, 9.0)], "trial_id long, signal_variant double")
    found = spark.createDataFrame([(0, 10), (1, 11), (-1, 12), (2, 13)], "variant_id long, signal_id long")
    got = sorted((r["trial_id"], r["signal_id"]) for r in sweep.matched(trials, found).collect())
    assert got == [(1, 10), (1, 12), (2, 11), (2, 12), (3, 10), (3, 11), (3, 12), (3, 13), (4, 12)]


def test_generic_and_value_filters(spark):
    base = {"direction": 1, "filter_value": 2.0, "buy_filter_max": -1.0, "sell_filter_min": -1.0, "hour": 5, "day": 1, "hours_start": 0.0, "hours_end": 23.0, "days_bitmask": 127.0, "spread": 1e-4, "pip": 1e-4}
    base |= {f"signal_p{k}": -1.0 for k in range(10)} | {f"p{k}": k for k in range(10)}
    cases = [({}, True), ({"buy_filter_max": 2.0}, True), ({"buy_filter_max": 3.0}, False), ({"sell_filter_min": 3.0}, True), ({"direction": -1, "sell_filter_min": 3.0}, False), ({"buy_filter_max": 3.0, "filter_value": -1.0}, True)]
    cases += [({f"signal_p{k}": k + 0.4}, True) for k in range(10)] + [({f"signal_p{k}": k + 0.6}, False) for k in range(10)] + [({f"signal_p{k}": 77.0, f"p{k}": -1}, True) for k in range(10)]
    cases += [({"days_bitmask": 1.0}, False), ({"hours_start": 6.0}, False)]
    rows = spark.createDataFrame([{**base, **change, "k": k} for k, (change, _) in enumerate(cases)])
    got = {r["k"] for r in rows.where(sweep.passes(rows.columns, 2.0)).collect()}
    assert got == {k for k, (_, want) in enumerate(cases) if want}
    assert rows.where(sweep.passes(rows.columns, 0.5)).count() == 0


def test_what_is_not_finite_ranks_last_and_passes_nothing(spark):
    rows = spark.createDataFrame([(1, NAN, 5.0), (2, 2.0, 1.0), (3, float("inf"), 1.0), (4, None, 1.0)], "trial_id long, sharpe double, return_pct double").withColumn("trades", F.lit(3)).withColumn("profit_factor", F.lit(0.5))
    assert ranking.pick_best(rows, "sharpe").first()["trial_id"] == 2
    assert ranking.pick_best(rows, "return_pct", [("sharpe", ">=", 1.0)]).first()["trial_id"] == 2
    assert [r["trial_id"] for r in ranking.top_per_objective(rows, ["sharpe"], 4).orderBy("rank").collect()] == [2, 1, 3, 4]


def test_trades_without_a_time_keep_their_result(spark):
    trades = spark.createDataFrame([("EUR_USD", None, 10.0, 1.0, None)], "pair string, s long, pnl double, bt_spread_pips double, reason string")
    costs = spark.createDataFrame([("EUR_USD", "Rollover", 5.0)], "pair string, session string, spread_pips double")
    per = spark.createDataFrame([("EUR_USD", 0.35, 0.5)], "pair string, commission_per_side_pips double, slippage_per_side_pips double")
    row = cost.overlay(trades, costs, per).first()
    assert (row["delta"], row["adjusted_pnl"], row["session"]) == (0.0, 10.0, None)


def test_metrics_of_nearly_equal_trades(spark):
    rows = [(1, k + 1, 1000.1 + 0.001 * (k % 3)) for k in range(30)] + [(2, k + 1, 0.1) for k in range(10)] + [(3, k + 1, float("1e6") + k) for k in range(30)]
    got = {r["trial_id"]: r for r in metrics.trial_metrics(spark.createDataFrame(rows, "trial_id long, i long, pnl double")).collect()}
    import numpy as np

    for t in (1, 3):
        p = np.array([x for i, _, x in rows if i == t])
        assert got[t]["sharpe"] == pytest.approx(p.mean() / p.std(ddof=1) * np.sqrt(30 * 6.048), rel=1e-9)
    assert got[2]["sharpe"] == 0 and got[2]["psr"] == 0 and got[2]["k_ratio"] == 0


def test_idle_trials_have_zeros(spark):
    rows = metrics.trial_metrics(spark.createDataFrame([(1, 1, 5.0)], "trial_id long, i long, pnl double"))
    got = {r["trial_id"]: r for r in metrics.with_idle(rows, spark.range(3).withColumnRenamed("id", "trial_id")).collect()}
    assert got[0]["trades"] == 0 and got[2]["sharpe"] == 0 and got[1]["trades"] == 1 and got[1]["avg_hold_bars"] is None


def test_encoders(spark):
    rows = spark.createDataFrame([(1, "atr", True, "fixed", 7.9, 3), (2, None, False, None, None, None), (3, "odd", True, "none", 1.0, 2)], "trial_id long, kind string, switch boolean, mode string, x double, n int")
    mapping = [("sl_mode", encoders.category("kind", {"fixed": 0, "atr": 1}, 5)), ("be_enabled", encoders.flag("switch")), ("trailing_mode", encoders.mode_or_off("switch", "mode", {"fixed": 1, "atr": 2})), ("be_trigger", encoders.if_on("switch", "x", 4)), ("sl_atr_mult", encoders.of_arm("kind", "atr", "x")), ("max_bars", encoders.whole("x", 9)), ("tp_rr", encoders.number("n", 0.5)), ("tp_mode", encoders.constant(2))]
    got = [tuple(r[s] for s, _ in mapping) for r in encoders.encode(rows, mapping).orderBy("trial_id").collect()]
    assert got == [(1, 1, 1, 7.9, 7.9, 7, 3, 2), (5, 0, 0, 4, 0, 9, 0.5, 2), (5, 1, 0, 1, 0, 1, 2, 2)]
    assert encoders.encode(rows, mapping).first()["signal_p3"] == -1 and encoders.encode(rows, mapping).first()["partial_pct"] == 0
    for wrong in ([*mapping, mapping[0]], [("no_slot", F.lit(1))]):
        with pytest.raises(ValueError):
            encoders.encode(rows, wrong)


def test_small_helpers(spark):
    assert (resample.moment("2024-01-02"), resample.moment("2024-01-02", True), resample.moment("2024-01-02T03:00:00+01:00"), resample.moment("")) == (1704153600, 1704239999, 1704160800, None)
    assert encoders.chunk_size(1000) == 10066 and encoders.chunk_size(10**9) == 10 and encoders.chunk_size(5, 7) == 7
    told = encoders.preflight({"ema_cross": {"fast": [5, 20], "slow": [10, 20]}}, 1000, 500)
    assert (told["combinations"], told["variants"], told["build_s"], told["evaluate_s"]) == (4, 2, 0.5, 2.0)
    with pytest.raises(KeyError):
        signals.family("donchian")(lambda: None)
    variants = spark.createDataFrame([("a", "x=1", 0)], "family string, params string, variant_id long")
    wanted = spark.createDataFrame([("a", "x=2")], "family string, params string")
    with pytest.raises(Exception, match="no variant"):
        space.resolve_variant(wanted, variants, strict=True).collect()
    ticks = spark.createDataFrame([("A", 61, 61_000_000, 1.0, 1.1, 2.0, 3.0, 1), ("A", 62, 62_000_000, 1.2, 1.3, 1.0, 0.5, 2)], "pair string, s long, us long, bid double, ask double, bid_volume double, ask_volume double, seq long")
    assert resample.ticks_to_bars(ticks).first()["volume"] == 6.5 and resample.ticks_to_bars(ticks.drop("bid_volume")).first()["volume"] == 2


def test_inputs_of_a_sweep_are_validated(spark):
    trials = spark.createDataFrame([(1,)], "trial_id long")
    found = spark.createDataFrame([(0, 1, "A", 1, 1, 1.0, 1.0, 1e-4)], "variant_id long, signal_id long, pair string, no long, direction int, entry_price double, atr_pips double, pip double")
    sweep.validate(trials, found)
    for bad in ((trials.unionByName(trials), found), (trials.where("false").unionByName(spark.createDataFrame([(None,)], "trial_id long")), found), (trials, found.drop("pip")), (trials.withColumn("sl_mode", F.lit("x")), found)):
        with pytest.raises(ValueError):
            sweep.validate(*bad)


def test_a_library_is_built_once(spark, tmp_path, monkeypatch):
    from tests.conftest import SMALL
    from chronosweep.plans.catalogue import bars

    b, families = bars(spark, SMALL), {"ema_cross": {"fast": [5], "slow": [20]}}
    first = sorted(map(tuple, signals.cached_library(b, families, str(tmp_path))[1].collect()))
    monkeypatch.setattr(signals, "build_library", lambda *_, **__: (_ for _ in ()).throw(AssertionError("built again")))
    variants, again = signals.cached_library(b, families, str(tmp_path))
    assert sorted(map(tuple, again.collect())) == first and first and variants.count() == 1
    with pytest.raises(AssertionError):
        signals.cached_library(b.where("s > 1704200000"), families, str(tmp_path))


def test_files_tell_their_pair_and_hour(spark, tmp_path):
    import lzma

    import numpy as np

    from chronosweep.sources import files

    for pair, price in (("EURUSD", 110000), ("USDJPY", 150000)):
        folder = tmp_path / pair / "2024" / "00" / "15"
        folder.mkdir(parents=True)
        (folder / "07h_ticks.bi5").write_bytes(lzma.compress(np.array([(1500, price + 2, price, 1.0, 2.0)], files.TICK).tobytes()))
    got = {r["pair"]: r for r in files.located_ticks(spark, f"{tmp_path}/*/*/*/*").collect()}
    assert {p: round(r["bid"], 5) for p, r in got.items()} == {"EUR_USD": 1.1, "USD_JPY": 150.0}
    assert got["EUR_USD"]["us"] == 1705302001500000 and got["EUR_USD"]["s"] == 1705302001


def test_lean_runs(spark, tmp_path):
    from chronosweep.sources import files

    rows = spark.range(25).withColumnRenamed("id", "trial_id")
    files.write_lean(str(tmp_path), rows, rows.where("trial_id < 3"), 10)
    assert files.read_run(spark, str(tmp_path), "metrics").groupBy("chunk").count().count() == 3
    assert files.read_run(spark, str(tmp_path), "retained").count() == 3


def test_trials_and_signals_meet_in_counted_cells(spark):
    trials = spark.range(300).selectExpr("id AS trial_id", "CAST(id % 4 - 1 AS DOUBLE) AS signal_variant")
    found = spark.range(900).selectExpr("id AS signal_id", "CASE WHEN id % 7 = 0 THEN -1 ELSE id % 3 END AS variant_id", "CASE WHEN id % 2 = 0 THEN 'A' END AS pair", "id * 20 AS no")
    plain = sorted((t, s) for t in range(300) for s in range(900) if t % 4 - 1 == -1 or s % 7 == 0 or t % 4 - 1 == s % 3)
    for cell, block in ((4096, 1024), (7, 10), (1, 300)):
        got = sweep.matched(trials, found, cell, block)
        assert sorted((r["trial_id"], r["signal_id"]) for r in got.collect()) == plain
        assert sorted(got.columns) == ["no", "pair", "signal_id", "signal_variant", "trial_id", "variant_id"]


def test_signals_carry_swings_values_and_marks(spark):
    from tests.conftest import SMALL
    from chronosweep.plans.catalogue import bars

    b = bars(spark, SMALL)
    _, found = signals.build_library(b, {"ema_cross": {"fast": [5], "slow": [20]}}, swing=4, value="session", marks=("hour", "weekday", "body"))
    by = {}
    for r in b.orderBy("pair", "s").collect():
        by.setdefault(r["pair"], []).append(r)
    rows = found.collect()
    assert rows
    for r in rows:
        last = [x for x in by[r["pair"]] if x["s"] <= r["s"]][-4:]
        assert r["swing_sl"] == (min(x["low"] for x in last) if r["direction"] == 1 else max(x["high"] for x in last))
        assert (r["filter_value"], r["p0"], r["p1"], r["p2"]) == (r["session"], r["hour"], r["day"], int(last[-1]["close"] >= last[-1]["open"]))
    assert [(r["variant_id"], r["no"]) for r in rows] and "p3" not in found.columns


def test_a_long_trial_has_the_metrics_of_its_whole(spark):
    rows = spark.range(30_000).selectExpr("id % 3 AS trial_id", "CAST(floor(id / 3) + 1 AS BIGINT) AS i", "CASE WHEN id % 3 = 2 THEN CAST(id % 2 AS DOUBLE) - 0.4 ELSE round(sin(id * 12.9898) * 43.7, 4) + 0.3 END AS pnl")
    rows = rows.unionByName(spark.createDataFrame([(9, 1, 2.0), (9, 2, -1.0)], "trial_id long, i long, pnl double"))
    whole = {r["trial_id"]: r for r in metrics.trial_metrics(rows).collect()}
    parts = {r["trial_id"]: r for r in metrics.trial_metrics(rows, block=700).collect()}
    assert len(whole) == 4 and set(parts) == set(whole)
    for t, r in whole.items():
        for c, x in r.asDict().items():
            assert parts[t][c] == pytest.approx(x, rel=1e-9, abs=1e-9), (t, c)
    line = lambda block: [tuple(r) for r in metrics.equity(rows, block=block).select("trial_id", "i", F.round("eq", 6), F.round("dd_pct", 6), "streak").orderBy("trial_id", "i").collect()]
    assert line(10_000) == line(512)


def test_order_statistics_by_counted_ranges(spark):
    rows = spark.range(20_000).selectExpr("id % 2 AS g", "CASE WHEN id % 2 = 0 THEN CAST(id % 10 = 0 AS DOUBLE) ELSE pow(CAST(id % 997 AS DOUBLE), 3) END AS v").unionByName(spark.createDataFrame([(2, 5.0), (2, -5.0)], "g long, v double"))
    import collections

    held = collections.defaultdict(list)
    for r in rows.collect():
        held[r["g"]].append(r["v"])
    wanted = [(g, str(k), k) for g, v in held.items() for k in sorted({0, len(v) // 20, len(v) // 2, len(v) - 1})]
    got = {(r["g"], r["which"]): r["x"] for r in metrics.order_statistics(rows, ["g"], "v", spark.createDataFrame(wanted, "g long, which string, k long"), block=50, ranges=8).collect()}
    assert got == {(g, w): sorted(held[g])[k] for g, w, k in wanted}


def test_benches_of_profitable_quality_and_shared_lists(spark):
    base = {m: 1.0 for m in ranking.BENCHES if m != "quality_profitable"} | {"total_pips": 1.0, "profit_factor": 2.0}
    rows = [base | {"trial_id": t, "quality": q, "total_pips": p, "profit_factor": f, "psr": s} for t, q, p, f, s in ((1, 9.0, -1.0, 0.5, 0.1), (2, 5.0, 1.0, 0.5, NAN), (3, 4.0, -1.0, 1.5, 0.9), (4, float("inf"), 1.0, 2.0, 0.2))]
    tops = ranking.benches(spark.createDataFrame(rows), 2)
    by = {}
    for r in tops.orderBy("objective", "rank").collect():
        by.setdefault(r["objective"], []).append(r["trial_id"])
    assert by["quality"] == [1, 2] and by["quality_profitable"] == [2, 3] and by["psr"] == [3, 4] == by["dsr"] and len(by) == len(ranking.BENCHES) + 1
    got = {r["trial_id"]: (r["benches"], r["is_best"]) for r in ranking.kept(spark.createDataFrame(rows), tops).collect()}
    assert got[1][1] and not got[2][1] and set(got) == {1, 2, 3, 4}
    lost = tops.where("trial_id <> 1 AND objective <> 'quality'")  # the best stands on no bench
    assert [r["trial_id"] for r in ranking.kept(spark.createDataFrame(rows), lost).where("is_best").collect()] == [2]


def test_equal_trades_are_simulated_once_or_dealt_apart(spark, monkeypatch):
    from chronosweep.operators import positions

    main = spark.range(300).selectExpr("'A' AS pair", "id * 3600 AS s", "1.1 + sin(id) * 0.002 + 0.001 AS high", "1.1 + sin(id) * 0.002 - 0.001 AS low", "1.1 + sin(id) * 0.002 AS close", "0.0001 AS spread")
    mains = positions.main_bars(main, main, 3600)
    trade = {"pair": "A", "direction": 1, "entry_price": 1.1, "sl_price": 1.0975, "tp_price": 1.1035, "atr_pips": 10.0, "entry_no": 5, "trailing_mode": 1.0, "trailing_activate": 5.0, "trailing_distance": 5.0}
    same = spark.range(6000).select(F.col("id").alias("trade_id"), *[F.lit(v).alias(k) for k, v in trade.items()])
    other = spark.range(6000, 9000).select(F.col("id").alias("trade_id"), *[(F.lit(v) + (F.col("id") - 6000) * 1e-8 if k == "sl_price" else F.lit(v)).alias(k) for k, v in trade.items()])
    monkeypatch.setattr(positions, "GROUP", 500)
    want = None
    for trades in (same, other, same.unionByName(other)):
        rows = positions.simulate(trades, positions.paths(mains, main, 3600), 8, ["trade_id"]).collect()
        assert sorted(r["trade_id"] for r in rows) == sorted(r["trade_id"] for r in trades.collect())
        found = {(r["exit_no"], r["exit_reason"], round(r["pnl"], 3)) for r in rows if r["trade_id"] < 6000} or want
        want = want or found
        assert found == want and len(found) == 1
