"""Bars and closed-bar events from streams of ticks, and the care of open positions."""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronosweep.operators import positions


def stream_bars(ticks: DataFrame, width: str = "15 minutes", late: str = "1 minute") -> DataFrame:
    """Bars that are emitted once they are closed.  ticks: pair, ts (timestamp), bid, ask, seq; repeated ticks within the delay count once."""
    mid = (F.col("bid") + F.col("ask")) / 2
    fresh = ticks.withWatermark("ts", late).dropDuplicatesWithinWatermark(["pair", "seq"])
    at = F.struct("ts", "seq")
    bars = fresh.withColumn("mid", mid).groupBy("pair", F.window("ts", width).alias("w")).agg(F.min_by("mid", at).alias("open"), F.max("mid").alias("high"), F.min("mid").alias("low"), F.max_by("mid", at).alias("close"), F.count("*").alias("volume"))
    return bars.select("pair", F.col("w.start").alias("start"), "open", "high", "low", "close", "volume")


def closed_bar_events(bars: DataFrame) -> DataFrame:
    """Each pair's bars once, in order, without the first: a pair's first bar only warms up.  bars: pair, start_s, close."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(frames)).drop_duplicates("start_s").sort_values("start_s")
        fresh = rows if last is None else rows[rows.start_s > last]
        if len(fresh):
            state.update((int(fresh.start_s.max()),))
            out = fresh.iloc[1:] if last is None else fresh
            if len(out):
                yield pd.DataFrame({"pair": key[0], "start_s": out.start_s, "close": out.close})

    return bars.groupBy("pair").applyInPandasWithState(run, "pair string, start_s long, close double", "last long", "append", "NoTimeout")


def managed_positions(steps: DataFrame) -> DataFrame:
    """What each open trade needs after every batch of its bars: trade_id, seq, action, value; nothing is emitted for a hold.

    steps: trade_id, rules (the trade's numbers and rules as JSON), seq, no (the main bar's place), high, low, close, spread,
    main_close, main_spread and main_range.  State is the trade's numbers, as `positions.advance` leaves them, the ranges of the
    last main bars that its rule looks back on, the stop and share that the broker holds, and the last bar seen: its size doesn't
    grow with the trade.  Bars that come again count once; a closed trade keeps only its last bar.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames)).drop_duplicates("seq").sort_values("seq")
        if state.exists:
            numbers, ranges, stop, partial, last = state.get
        else:
            numbers, ranges, last = positions.begin(json.loads(rows["rules"].iat[0])), [], -1
            stop, partial = numbers[positions.PLACE["stop"]], False
        fresh = rows[rows.seq > last]
        if not numbers or not len(fresh):
            return
        seen = int(fresh.seq.max())
        numbers, ranges, found = positions.proceed(numbers, ranges, fresh)
        of = lambda name: numbers[positions.PLACE[name]]
        action, value = "hold", None
        if found["done"][0]:
            action, value, numbers, ranges = "close", found["exit_price"][0], [], []
        elif of("taken") > 0 and not partial:
            action, value, partial = "partial", of("partial_pct"), True
        else:
            wanted = of("stop") if math.isnan(of("staged")) else of("staged")
            if abs(wanted - stop) > of("pip") / 10:
                action, value, stop = "modify_sl", wanted, wanted
        state.update((numbers, ranges, stop, partial, seen))
        if action != "hold":
            yield pd.DataFrame({"trade_id": [key[0]], "seq": [seen], "action": [action], "value": [float(value)]})

    return steps.groupBy("trade_id").applyInPandasWithState(run, "trade_id long, seq long, action string, value double", "numbers array<double>, ranges array<double>, stop double, partial boolean, last long", "append", "NoTimeout")
