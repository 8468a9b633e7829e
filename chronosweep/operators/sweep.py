"""Sweeps: sampled trials meet the signals of a library, become trades, and are measured.

Trials and signals meet by an equality on the variant; filters are columns of the same
join, so a trial's signals that don't pass are never shuffled.  Trades run through
`positions.simulate` together, whatever trial they belong to, and every trial, with or
without trades, gets its row of metrics.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronosweep.functions.exprs import time_filter
from chronosweep.functions.lineage import cut
from chronosweep.operators import metrics, positions, pricing

#: Slots of a trial, with what an unmapped one holds: filters are off at -1, everything else at 0.
SLOTS = {
    "signal_variant": -1.0, "buy_filter_max": -1.0, "sell_filter_min": -1.0, **{f"signal_p{k}": -1.0 for k in range(10)},
    "hours_start": 0.0, "hours_end": 0.0, "days_bitmask": 0.0, "sl_mode": 0.0, "sl_fixed_pips": 0.0, "sl_atr_mult": 0.0, "tp_mode": 0.0, "tp_rr": 0.0, "tp_atr_mult": 0.0, "tp_fixed_pips": 0.0,
    **{k: 0.0 for k in positions.RULES},
}
FILTERS = 10
#: Signals without one of these carry what stands beside it.
SIGNAL = {"swing_sl": None, "filter_value": -1.0, "hour": None, "day": None, "spread": None}
#: Main bars to a stretch, and signals and trials that meet in one cell of the join.
STRETCH, CELL, BLOCK = 4096, 4096, 1024


def matched(trials: DataFrame, signals: DataFrame, cell: int = CELL, block: int = BLOCK) -> DataFrame:
    """Trials with the signals of their variant; -1 on either side takes part with all of the other.

    An opted-out trial is dealt to each variant that the library has, so all of this is one equi-join.  Its key is the variant, the pair,
    the stretch of bars, a part of the signals there and a part of the variant's trials, both counted: trials go only where
    their variant has signals, and no key holds more than about `cell` signals and `block` trials, however few variants there are.
    """
    variants = signals.agg(F.array_append(F.collect_set(F.col("variant_id").cast("long")), F.lit(-1).cast("long")).alias("_ids"))  # one row, as long as the library
    own = F.coalesce(F.col("signal_variant").cast("long"), F.lit(-1))
    chosen = trials.where(own >= 0).select("*", F.explode(F.array(own, F.lit(-1).cast("long"))).alias("variant_id"))
    free = trials.where(own < 0).join(F.broadcast(variants)).select(*trials.columns, F.explode(F.array_distinct("_ids")).alias("variant_id"))
    told = chosen.unionByName(free)
    pair = F.col("pair") if "pair" in signals.columns else F.lit("")
    stretch = F.floor(F.col("no") / STRETCH) if "no" in signals.columns else F.lit(0)
    kept = signals.withColumns({"variant_id": F.coalesce(F.col("variant_id").cast("long"), F.lit(-1).cast("long")), "_pair": F.coalesce(pair, F.lit("")), "_stretch": F.coalesce(stretch, F.lit(0))})
    at = ["variant_id", "_pair", "_stretch"]
    blocks = told.groupBy("variant_id").agg(F.ceil(F.count("*") / block).alias("_blocks"))
    grid = kept.groupBy(*at).agg(F.ceil(F.count("*") / cell).alias("_parts")).join(blocks, "variant_id")
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    left = told.join(grid, "variant_id").withColumn("_block", F.pmod(F.xxhash64("trial_id"), F.col("_blocks"))).withColumn("_part", every("_parts"))
    right = kept.join(grid, at).withColumn("_part", F.pmod(F.xxhash64("signal_id"), F.col("_parts"))).withColumn("_block", every("_blocks"))
    keys = [*at, "_part", "_block"]
    return left.drop("_parts", "_blocks").join(right.drop("_parts", "_blocks"), keys).drop(*keys[1:])


def passes(columns: Sequence[str], max_spread_pips: float = 0.0) -> Column:
    """The filters between a trial (slots by name) and a signal: value, generic, time, spread."""
    ok = pricing.value_filter(F.col("direction"), F.coalesce("filter_value", F.lit(-1.0)), F.col("buy_filter_max"), F.col("sell_filter_min"))
    for k in range(FILTERS):
        if f"p{k}" in columns:
            ok = ok & pricing.opt_out(F.round(F.col(f"signal_p{k}")).cast("long"), F.col(f"p{k}").cast("long"))
    ok = ok & time_filter(F.col("hour"), F.col("day"), F.col("hours_start").cast("int"), F.col("hours_end").cast("int"), F.col("days_bitmask").cast("int"))
    return ok & pricing.spread_gate(F.col("spread"), F.col("pip"), F.lit(max_spread_pips))


def trades_of(trials: DataFrame, signals: DataFrame, max_spread_pips: float = 0.0) -> DataFrame:
    """One row for each trial and signal that passes, with stops; signals: variant_id, signal_id, pair, no, direction, entry_price, atr_pips, pip and SIGNAL."""
    slots = trials.withColumns({c: F.lit(v) for c, v in SLOTS.items() if c not in trials.columns})
    rows = matched(slots, signals.withColumns({c: F.lit(v).cast("double") for c, v in SIGNAL.items() if c not in signals.columns}))
    rows = rows.where(passes(rows.columns, max_spread_pips))
    return pricing.stops(rows).withColumn("entry_no", F.col("no"))


def evaluate(trials: DataFrame, signals: DataFrame, mains: DataFrame, path: DataFrame, costs: DataFrame | None = None, slippage: float = 0.5, commission: float = 0.0, max_spread_pips: float = 0.0, stale_bars: int = 64) -> DataFrame:
    """The log of all trades of a sweep: trial_id, pair, i (its place in the trial), signal_id, direction, stops, entry, exit and pnl.

    Pips are kept to six places, so that trades that end alike are equal and a trial of such has no deviation.

    costs: pair, slippage_pips; pairs that it lacks have `slippage`.  mains and path come from `positions`.
    """
    rows = trades_of(cut(trials), signals, max_spread_pips)  # drawn once, though the join looks at them from several sides
    rows = rows.join(costs.select("pair", F.col("slippage_pips").alias("slippage")), "pair", "left") if costs is not None else rows.withColumn("slippage", F.lit(None).cast("double"))
    opening = mains.select("pair", "no", F.col("first_spread").alias("entry_spread"))
    rows = rows.withColumn("slippage", F.coalesce("slippage", F.lit(slippage))).withColumn("commission", F.lit(commission)).join(opening, ["pair", "no"], "left")
    keep = ["trial_id", "pair", "signal_id", "variant_id", "s", "sl_pips", "direction", "sl_price", "tp_price", "entry_no", "entry_spread"]
    done = positions.simulate(rows, path, stale_bars, keep)
    place = F.row_number().over(Window.partitionBy("trial_id", "pair").orderBy("entry_no", "signal_id"))
    log = ["trial_id", "pair", "signal_id", "variant_id", F.col("s").alias("signal_s"), F.col("direction").cast("int").alias("direction"), F.round("sl_pips", 6).alias("sl_pips"), "sl_price", "tp_price", F.col("entry_cost_price").alias("entry_price"), "entry_no", "entry_spread", "exit_no", "exit_s", "exit_price", "exit_reason", F.round("pnl", 6).alias("pnl")]
    return done.withColumn("i", place).select(*log, "i")


def sweep_metrics(log: DataFrame, trials: DataFrame, pairs: DataFrame, bars_per_year: float = 6048.0) -> DataFrame:
    """All metrics of every trial on every pair.  A trial of which any trade failed has zeros, like one without trades.  pairs: pair, n_bars."""
    failed = log.where(F.col("pnl").isNull() | F.isnan("pnl")).select("trial_id", "pair").distinct()
    sound = log.join(failed, ["trial_id", "pair"], "left_anti").join(pairs, "pair").select("trial_id", "pair", "i", "pnl", "sl_pips", "n_bars")
    measured = metrics.trial_metrics(sound, bars_per_year=bars_per_year, by=("pair", "trial_id"))
    names = pairs.agg(F.collect_set("pair").alias("_pairs"))  # one row, as long as the list of pairs
    every = trials.join(F.broadcast(names)).select("trial_id", F.explode("_pairs").alias("pair"))
    return metrics.with_idle(measured, every, ("pair", "trial_id"))


def with_slippage(log: DataFrame, telemetry: DataFrame, default: float = 0.5) -> DataFrame:
    """log with its pair's measured slippage_pips, or the default for pairs without one."""
    return log.join(telemetry.select("pair", "slippage_pips"), "pair", "left").withColumn("slippage_pips", F.coalesce("slippage_pips", F.lit(default)))


def validate(trials: DataFrame, signals: DataFrame) -> None:
    """Raises where a column is missing, an id is null or given twice, or a slot isn't a number."""
    for name, rows, needed, key in (("trials", trials, ["trial_id"], ["trial_id"]), ("signals", signals, ["variant_id", "signal_id", "pair", "no", "direction", "entry_price", "atr_pips", "pip"], ["signal_id", "pair"])):
        lacking = [c for c in needed if c not in rows.columns]
        if lacking:
            raise ValueError(f"{name} lack {lacking}")
        unfit = [c for c, kind in rows.dtypes if c in SLOTS and kind in ("string", "boolean", "binary")]
        if unfit:
            raise ValueError(f"{name} have slots that are no numbers: {unfit}")
        if not rows.where(F.greatest(*[F.col(c).isNull().cast("int") for c in (*key, key[0])]) == 1).isEmpty():
            raise ValueError(f"{name} have rows without {key}")
        if not rows.groupBy(*key).count().where("count > 1").isEmpty():
            raise ValueError(f"{name} have {key} twice")


def with_families(log: DataFrame, variants: DataFrame) -> DataFrame:
    """log with the family and parameters of each trade's variant; unknown variants have none."""
    return log.join(variants.select("variant_id", "family", "params"), "variant_id", "left")
