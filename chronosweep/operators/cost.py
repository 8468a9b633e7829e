"""Session costs: spreads by session, the three-and-three gate, overlays and telemetry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronosweep.functions.exprs import hour_of, pip, session_name
from chronosweep.sources.upsert import GROUPS

LIQUID = ("Asian", "London", "Lon-NY")


# Spreads in pips under which a pair's table can't be right, for pairs of the dollar's majors and others.
FLOOR_MAJOR, FLOOR_OTHER = 0.05, 0.15


def spread_floor(pair: Column) -> Column:
    return F.when(pair.isin(*GROUPS["Majors"]), FLOOR_MAJOR).otherwise(FLOOR_OTHER)


def session_spreads(ticks: DataFrame, least: float | Column = 0.0, most: float = 50.0) -> DataFrame:
    """pair, session, spread_pips (mean, four places): a pair with any session outside the bounds is left out whole; `spread_floor` gives bounds by pair."""
    sp = (F.col("ask") - F.col("bid")) / pip(F.col("pair"))
    rows = ticks.select("pair", session_name(hour_of(F.col("s"))).alias("session"), sp.alias("sp")).where((F.col("sp") >= 0) & (F.col("sp") < float("inf")))
    means = rows.groupBy("pair", "session").agg(F.round(F.avg("sp"), 4).alias("spread_pips"))
    ok = F.min(((F.col("spread_pips") >= least) & (F.col("spread_pips") <= most)).cast("int")).over(Window.partitionBy("pair"))
    return means.withColumn("_ok", ok).where("_ok = 1").drop("_ok")


def preferred(*tables: tuple[str, DataFrame]) -> DataFrame:
    """Session spreads of several sources, the best first, each (name, table) by whole pairs: a pair comes from the first source that has it."""
    ranked = None
    for k, (name, rows) in enumerate(tables):
        part = rows.select("pair", "session", "spread_pips", F.lit(name).alias("source"), F.lit(k).alias("_k"))
        ranked = part if ranked is None else ranked.unionByName(part)
    best = ranked.groupBy("pair").agg(F.min("_k").alias("_k"))
    return ranked.join(best, ["pair", "_k"]).drop("_k")


def gate_reason(hour: Column, spread: Column, slippage: Column | None) -> Column:
    """Why a trade is refused, in fixed order, or null; without slippage it is the guard of live orders."""
    unknown = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    out = F.when((hour >= 21) & (hour <= 23), "rollover").when(unknown(spread), "unknown_spread").when(spread > 3, "spread_3p")
    return out if slippage is None else out.when(unknown(slippage), "unknown_slippage").when(slippage > 3, "slippage_3p")


def overlay(trades: DataFrame, costs: DataFrame, pair_costs: DataFrame, commission: float = 0.3) -> DataFrame:
    """trades with delta and adjusted_pnl: what was charged less what the table says; trades without a time and pairs without costs have delta 0."""
    mean = costs.groupBy("pair").agg(F.avg("spread_pips").alias("_mean"))
    rows = trades.withColumn("session", session_name(hour_of(F.col("s")))).join(costs, ["pair", "session"], "left").join(mean, "pair", "left").join(pair_costs, "pair", "left")
    real = F.coalesce("spread_pips", "_mean") + 2 * F.col("commission_per_side_pips") + 2 * F.col("slippage_per_side_pips")
    delta = F.when(F.col("s").isNotNull(), F.coalesce(F.col("bt_spread_pips") + 2 * commission - real, F.lit(0.0))).otherwise(0.0)
    return rows.withColumn("delta", delta).withColumn("adjusted_pnl", F.when(F.col("reason").isNotNull(), 0.0).otherwise(F.col("pnl") + delta)).drop("spread_pips", "_mean", "commission_per_side_pips", "slippage_per_side_pips")


def overlay_charge(costs: DataFrame, commission: float = 0.35, slippage: float = 0.5) -> DataFrame:
    """Per pair: the simulated charge less the mean cost of the liquid sessions."""
    return costs.where(F.col("session").isin(*LIQUID)).groupBy("pair").agg((0.6 - (F.avg("spread_pips") + 2 * commission + 2 * slippage)).alias("charge_pips"))


def gate_parts(trades: DataFrame) -> DataFrame:
    """adjusted = total + gate_save + overhead."""
    blocked = F.col("reason").isNotNull()
    return trades.groupBy("pair").agg(F.sum("pnl").alias("total"), F.sum(F.when(blocked, -F.col("pnl")).otherwise(0.0)).alias("gate_save"), F.sum(F.when(blocked, 0.0).otherwise(F.col("delta"))).alias("overhead"), F.sum("adjusted_pnl").alias("adjusted"))


def slippage_telemetry(fills: DataFrame, window: int = 20) -> DataFrame:
    """Median of each pair's last `window` known slippages, for pairs that have so many."""
    w = Window.partitionBy("pair").orderBy(F.desc("s"), F.desc("seq"))
    last = fills.where(F.col("slippage").isNotNull() & ~F.isnan("slippage")).withColumn("k", F.row_number().over(w)).where(F.col("k") <= window)
    return last.groupBy("pair").agg(F.count("*").alias("n"), F.round(F.median("slippage"), 4).alias("slippage_pips")).where(F.col("n") >= window).drop("n")
