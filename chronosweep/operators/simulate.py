"""Exits of trades without managed stops: the first touch of stop or target, a number of bars, and a calm stretch.

`first_touch` is a range join on cells of time whose horizon widens: only trades that
found no exit go on to the next, and the earliest touch in a shorter stretch is final.
Managed trades are in `positions`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, WindowSpec
from pyspark.sql import functions as F

from chronosweep.functions.lineage import cut
from chronosweep.operators import ordered

#: Seconds of the first horizon, and the growth of the next ones.
HORIZON, GROWTH = 86_400, 5


def first_touch(entries: DataFrame, bars: DataFrame, width: int, horizon: int = HORIZON) -> DataFrame:
    """entries (trade_id, pair, s, direction, sl_price, tp_price, ...) with exit_s, exit_price, exit_reason.

    Bars after the entry's own count.  A stop wins over a target in one bar; trades that touch neither close at the pair's last close.
    Every round is a join on (pair, cell of its horizon), and the last horizon reaches the end of the longest pair.
    """
    path = bars.select("pair", F.col("s").alias("bar_s"), "high", "low")
    last = bars.groupBy("pair").agg(F.max("s").alias("exit_s"), F.max_by("close", "s").alias("exit_price"), F.min("s").alias("_first"))
    longest = last.agg(F.max(F.col("exit_s") - F.col("_first"))).first()[0] or 0
    done, open_, begun = None, entries, 0
    while True:
        left = open_.select("trade_id", "pair", F.col("s").alias("entry_s"), "direction", "sl_price", "tp_price")
        start, end = F.col("entry_s") + width + begun, F.col("entry_s") + width + horizon
        span = F.sequence(F.floor(start / horizon), F.floor(end / horizon))
        joined = left.withColumn("cell", F.explode(span)).join(path.withColumn("cell", F.floor(F.col("bar_s") / horizon)), ["pair", "cell"]).where((F.col("bar_s") >= start) & (F.col("bar_s") < end))
        long = F.col("direction") == 1
        stopped = F.when(long, F.col("low") <= F.col("sl_price")).otherwise(F.col("high") >= F.col("sl_price"))
        reached = F.when(long, F.col("high") >= F.col("tp_price")).otherwise(F.col("low") <= F.col("tp_price"))
        touch = F.struct(F.col("bar_s").alias("exit_s"), F.when(stopped, F.col("sl_price")).otherwise(F.col("tp_price")).alias("exit_price"), F.when(stopped, "SL").otherwise("TP").alias("exit_reason"))
        found = joined.where(stopped | reached).groupBy("trade_id").agg(F.min_by(touch, "bar_s").alias("_x"))
        met = cut(open_.join(found, "trade_id", "left"))
        part = met.where("_x is not null").select(*entries.columns, "_x.*")
        done = part if done is None else done.unionByName(part)
        open_ = met.where("_x is null").drop("_x")
        if horizon > longest or open_.isEmpty():
            break
        begun, horizon = horizon, horizon * GROWTH
    return done.unionByName(open_.join(last.drop("_first"), "pair", "left").withColumn("exit_reason", F.lit("NONE")).select(*done.columns))


def max_bars_exit(entries: DataFrame, bars: DataFrame, most: int) -> DataFrame:
    """entries with exit_s, exit_price, exit_reason: the close of the `most`-th bar after the entry's, or the pair's last close."""
    numbered = ordered.numbered(bars.select("pair", "s", "close"))
    last = numbered.groupBy("pair").agg(F.max("rn").alias("_last"))
    start = entries.join(numbered.select("pair", "s", "rn"), ["pair", "s"]).join(last, "pair")
    due = start.withColumn("exit_reason", F.when(F.col("rn") + most <= F.col("_last"), "MAX_BARS").otherwise("NONE")).withColumn("rn", F.least(F.col("rn") + most, F.col("_last")))
    return due.join(numbered.select("pair", "rn", F.col("s").alias("exit_s"), F.col("close").alias("exit_price")), ["pair", "rn"]).drop("rn", "_last")


def stale_exit(entries: DataFrame, bars: DataFrame, n: int, threshold: float) -> DataFrame:
    """entries with exit_s, exit_price, exit_reason: the first bar, `n` or more after the entry's, whose last n bars all have a range under the threshold.

    The next such bar is carried back from it over the bars before, so that an entry needs no walk of its own.
    """

    def make(df: DataFrame, w: WindowSpec) -> DataFrame:
        width = F.max(F.col("high") - F.col("low")).over(w.rowsBetween(1 - n, 0))
        return df.withColumn("no", F.col("rn")).withColumn("_calm", (width < threshold) & (F.col("rn") >= n))

    calm = ordered.in_order(bars, n, make)
    at = F.struct(F.col("close").alias("exit_price"), (-F.col("s")).alias("exit_s"))
    coming = ordered.carried(calm.withColumn("s", -F.col("s")), F.when(F.col("_calm"), at), "_x").select("pair", (-F.col("s")).alias("s"), "no", "_x")
    start = entries.join(coming.select("pair", "s", "no"), ["pair", "s"]).withColumn("no", F.col("no") + n)
    last = bars.groupBy("pair").agg(F.max("s").alias("_s"), F.max_by("close", "s").alias("_close"))
    met = start.join(coming.select("pair", "no", "_x"), ["pair", "no"], "left").join(last, "pair")
    return met.select(*entries.columns, F.coalesce("_x.exit_s", "_s").alias("exit_s"), F.coalesce("_x.exit_price", "_close").alias("exit_price"), F.when(F.col("_x").isNull(), "NONE").otherwise("STALE").alias("exit_reason"))
