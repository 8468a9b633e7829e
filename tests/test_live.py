"""Greedy matching against a plain loop, streams against batches, files and spaces."""

from __future__ import annotations

import bisect
import lzma
from collections import defaultdict

import numpy as np
import pytest

from chronosweep.operators import live


def test_greedy_match_equals_loop(spark):
    rng = np.random.default_rng(5)
    side = lambda n: [("EUR_USD" if k % 3 else "USD_JPY", int(rng.choice([1, -1])), int(rng.integers(0, 400_000)), k) for k in range(n)]
    bt, lv = side(300), side(280)
    want, free = {}, defaultdict(list)
    for p, d, s, i in lv:
        free[p, d].append((s, i))
    for p, d, s, i in sorted(bt, key=lambda r: (r[2], r[3])):
        near = [(abs(x - s), x, j) for x, j in free[p, d] if abs(x - s) <= 900]
        if near:
            gap, x, j = min(near)
            free[p, d].remove((x, j))
            want[i] = (j, gap)
    kind = "pair string, direction int, signal_s long, {}_id long"
    got = live.match_greedy(spark.createDataFrame(bt, kind.format("bt")), spark.createDataFrame(lv, kind.format("live")), 900)
    assert {r["bt_id"]: (r["live_id"], r["gap"]) for r in got.collect()} == want and want


@pytest.mark.parametrize("kind", ["dense", "gaps", "ties"])
def test_greedy_match_of_dense_rows(spark, kind):
    """A row a minute, windows that hold sixty of them, so that what one takes matters to many after it."""
    rng = np.random.default_rng(3)
    n = {"dense": 40_000, "gaps": 6_000, "ties": 1_500}[kind]
    bt = [("P", 1, 60 * k, k) for k in range(n)]
    lv = {"dense": [("P", 1, 60 * k + 7, 10**6 + k) for k in range(n) if rng.random() < 0.9], "gaps": [("P", 1, int(60 * k + rng.integers(-90, 90)), 10**6 + k) for k in range(n) if (k // 500) % 3 and rng.random() < 0.97], "ties": [("P", 1, 600 * (k // 9), 10**6 + k) for k in range(n)]}[kind]
    window = 900 if kind == "ties" else 3600
    free, want = sorted((s, i) for _, _, s, i in lv), {}
    for _, _, s, i in sorted(bt, key=lambda r: (r[2], r[3])):
        lo, hi = bisect.bisect_left(free, (s - window,)), bisect.bisect_left(free, (s + window + 1,))
        if lo < hi:
            gap, x, j = min((abs(x - s), x, j) for x, j in free[lo:hi])
            free.remove((x, j))
            want[i] = (j, gap)
    form = "pair string, direction int, signal_s long, {}_id long"
    got = live.match_greedy(spark.createDataFrame(bt, form.format("bt")), spark.createDataFrame(lv, form.format("live")), window, crowd=400)
    assert {r["bt_id"]: (r["live_id"], r["gap"]) for r in got.collect()} == want and want


def test_streamed_bars_equal_batch(spark, tmp_path):
    from pyspark.sql import functions as F

    from chronosweep.streaming.bars import closed_bar_events, stream_bars

    rows = [("A" if k % 2 else "B", 1_704_067_200 + 37 * k, 1.1 + k % 17 * 1e-4, 1.1 + k % 17 * 1e-4 + 1e-5, k) for k in range(400)]
    ticks = spark.createDataFrame(rows, "pair string, s long, bid double, ask double, seq long").withColumn("ts", F.timestamp_seconds("s")).drop("s")
    ticks.unionByName(ticks.where("seq < 50")).coalesce(1).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(ticks.schema).parquet(str(tmp_path / "in"))
    stream_bars(source).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c1")).option("path", str(tmp_path / "bars")).trigger(availableNow=True).start().awaitTermination()
    bars = spark.read.parquet(str(tmp_path / "bars"))
    batch = ticks.groupBy("pair", F.window("ts", "15 minutes").start.alias("start")).agg(F.count("*").alias("n"), F.max((F.col("bid") + F.col("ask")) / 2).alias("high"))
    closed = {(r["pair"], r["start"]): (r["volume"], r["high"]) for r in bars.collect()}
    every = {(r["pair"], r["start"]): (r["n"], r["high"]) for r in batch.collect()}
    assert closed and all(every[k] == v for k, v in closed.items()) and 0 < len(every) - len(closed) <= 4
    bars.select("pair", F.unix_timestamp("start").alias("start_s"), "close").coalesce(1).write.parquet(str(tmp_path / "closed"))
    fresh = spark.readStream.schema("pair string, start_s long, close double").parquet(str(tmp_path / "closed"))
    closed_bar_events(fresh).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c2")).option("path", str(tmp_path / "events")).trigger(availableNow=True).start().awaitTermination()
    assert spark.read.parquet(str(tmp_path / "events")).count() == len(closed) - 2


def test_binary_files(spark, tmp_path):
    from chronosweep.sources import files

    ticks = np.array([(5, 110020, 110000, 1.5, 2.5), (9, 110030, 110010, 1.0, 1.0)], files.TICK)
    bars = np.array([(0, 110000, 110010, 109990, 110020, 3.0)], files.CANDLE)
    for folder, data in (("t", ticks), ("b", bars)):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "00.bin").write_bytes(lzma.compress(data.tobytes()))
        (tmp_path / folder / "01.bin").write_bytes(b"")
    got = files.read_ticks(spark, str(tmp_path / "t")).orderBy("ms").collect()
    assert [(r["ms"], round(r["bid"], 5), round(r["ask"], 5)) for r in got] == [(5, 1.1, 1.1002), (9, 1.1001, 1.1003)]
    (bar,) = files.read_candles(spark, str(tmp_path / "b")).collect()
    assert [round(bar[c], 5) for c in ("open", "high", "low", "close", "volume")] == [1.1, 1.1002, 1.0999, 1.1001, 3.0]


def test_logs_and_artifacts(spark, tmp_path):
    from chronosweep.sources import files

    (tmp_path / "log.jsonl").write_text('﻿{"plan_id": 1, "pair": "EUR_USD"}\nnot json\n\n{"plan_id": 2, "pair": null}\n')
    assert [(r["plan_id"], r["pair"]) for r in files.read_log(spark, str(tmp_path / "log.jsonl"), "plan_id long, pair string").orderBy("plan_id").collect()] == [(1, "EUR_USD"), (2, None)]
    trades = spark.createDataFrame([("EUR_USD", 1_704_067_200, 1_704_070_800, 2.5)], "pair string, entry_s long, exit_s long, pips double")
    files.export_trades(trades, str(tmp_path / "csv"))
    back = files.import_trades(spark, str(tmp_path / "csv"), "pair string, entry_s timestamp, exit_s timestamp, pips double").collect()
    assert len(back) == 1 and back[0]["entry_s"].isoformat() == "2024-01-01T00:00:00"
    files.write_run(str(tmp_path / "run"), metrics=trades, trades=trades)
    assert files.read_run(spark, str(tmp_path / "run"), "metrics").count() == 1


def test_spaces():
    import pytest

    from chronosweep.operators import space

    tree = {"sl": space.IntRange(10, 50, 10), "tp": space.FloatRange(1.0, 3.0, 0.5), "trail": space.Choice((0, 1)), "gap": ("trail", 1, space.IntRange(5, 20, 5))}
    space.validate(tree)
    assert space.from_json(space.to_json(tree)) == tree
    assert [r[0] for r in space.flatten(tree)] == ["sl", "tp", "trail", "gap"]
    changed = space.override(tree, {"sl": {"frozen": 20}, "tp": {"min": 2.0}, "trail": {"enabled": False}}, step_multiplier=2)
    assert changed["sl"] == space.Choice((20,)) and changed["tp"] == space.FloatRange(2.0, 3.0, 1.0) and changed["trail"] == space.Choice((0,)) and changed["gap"][2].step == 10
    assert tree["sl"].step == 10
    assert space.pin(tree, {"sl": 30, "gap": 10}) ["gap"] == ("trail", 1, space.Choice((10,)))
    assert space.count(tree) == 5 * 5 * 2 * 4
    with pytest.raises(ValueError):
        space.validate({"gap": ("none", 1, space.Choice((1,)))})
    for level in range(1, 11):
        space.validate(space.preset(level, 12.0))
    assert set(space.preset(1, 12.0)) < set(space.preset(10, 12.0))


def test_positions_are_managed_batch_by_batch_and_over_a_restart(spark, tmp_path):
    import json

    from chronosweep.streaming.bars import managed_positions

    rules = json.dumps({"pip": 1e-4, "direction": 1, "entry_price": 1.1, "sl_price": 1.097, "tp_price": 1.106, "entry_no": -1, "be_enabled": 1, "be_trigger": 5, "be_offset": 2})
    kind = "trade_id long, rules string, seq long, no long, high double, low double, close double, spread double, main_close double, main_spread double, main_range double"
    steps = list(enumerate([(1.1001, 1.1), (1.1008, 1.1004), (1.1006, 1.1003), (1.1003, 1.1001), (1.1001, 1.1)]))

    def run(part):
        for k, (high, low) in part:
            spark.createDataFrame([(1, rules, k, k, high, low, low, 0.0, low, 0.0, high - low)], kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        source = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        managed_positions(source).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start().awaitTermination()

    run(steps[:2])
    run(steps[2:])
    got = spark.read.parquet(str(tmp_path / "out")).orderBy("seq").collect()
    assert [(r["seq"], r["action"], round(r["value"], 4)) for r in got] == [(1, "modify_sl", 1.1002), (3, "close", 1.1002)]


def test_one_batch_or_many_leave_the_same_numbers():
    import pandas as pd

    from chronosweep.operators import positions

    rng = np.random.default_rng(9)
    mid = 1.1 + np.cumsum(rng.normal(0, 2e-4, 200))
    bars = pd.DataFrame({"seq": range(200), "no": np.arange(200) // 4, "high": mid + 2e-4, "low": mid - 2e-4, "close": mid, "spread": 1e-5})
    by = bars.groupby("no")
    bars["main_close"], bars["main_spread"], bars["main_range"] = by["close"].transform("last"), 1e-5, by["high"].transform("max") - by["low"].transform("min")
    trade = {"direction": 1, "entry_price": 1.1, "sl_price": 1.05, "tp_price": 1.2, "atr_pips": 10.0, "pip": 1e-4, "entry_no": -1, "trailing_mode": 1, "trailing_activate": 3.0, "trailing_distance": 400.0, "stale_enabled": 1, "stale_bars": 3, "stale_atr_thresh": 0.01}
    whole, _, _ = positions.proceed(positions.begin(trade), [], bars)
    numbers, ranges = positions.begin(trade), []
    for at in range(0, 200, 7):
        numbers, ranges, _ = positions.proceed(numbers, ranges, bars.iloc[at : at + 7])
    assert len(ranges) == 3 and np.allclose(numbers, whole, equal_nan=True)
