"""Metrics of trials from their trades in order.

Trials of up to `BLOCK` trades run in windows of their own.  Where a trial is longer, its trades run in blocks of
places: what a block starts from (equity, peak, losses so far) is a prefix over the blocks' sums, what is a trial's
own (means, slope) is an aggregation that is joined back, and its order statistics are found by counting ranges of
values.  So a trial of any length is as many tasks as it has blocks, and only the blocks' sums of a trial meet.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronosweep.functions.exprs import norm_cdf, norm_ppf, ratio
from chronosweep.functions.lineage import cut

#: All metrics of a trial, in order; the last three need a sweep's context and are null here.
METRICS = (
    "trades", "win_rate", "profit_factor", "sharpe", "sortino", "max_dd_pct", "return_pct", "r_squared", "ulcer", "quality", "expectancy_r", "expectancy_pips", "sqn", "calmar", "recovery",
    "upi", "k_ratio", "tail_ratio", "omega", "max_consec_loss", "psr", "quality_v2", "total_pips", "dsr", "avg_hold_bars", "trades_per_day",
)
#: What a trial without trades has: no activity, and nothing to measure.
UNTRACKED = ("avg_hold_bars", "trades_per_day")
#: Share of a curve's variance under which its distance from a straight line is rounding.
STRAIGHT = 1e-12


#: Trades to a block, and ranges that values are counted in at once.
BLOCK, RANGES = 10_000, 1024


def is_long(trades: DataFrame, block: int = BLOCK) -> bool:
    """Whether any trial has more trades than a block."""
    return (trades.agg(F.max("i")).first()[0] or 0) > block


def equity(trades: DataFrame, by: Sequence[str] = ("trial_id",), block: int = BLOCK, blocks: bool | None = None) -> DataFrame:
    """trades with running equity, peak (from 0), drawdown, its percentage of the largest absolute equity so far, and the losing streak.

    trades: by, i (place in the trial, from 1), pnl.  `blocks` tells whether trials run in blocks; by default it is looked up.
    """
    blocks = is_long(trades, block) if blocks is None else blocks
    keys = [*by, "_block"] if blocks else [*by]
    rows = trades.withColumn("_block", F.floor((F.col("i") - 1) / block)) if blocks else trades
    rows = rows.withColumn("_loss", (F.col("pnl") < 0).cast("int"))
    w = Window.partitionBy(*keys).orderBy("i")

    def carried(rows: DataFrame, **sums: tuple) -> DataFrame:
        """rows with what each block starts from: an aggregate of all blocks before it."""
        if not blocks:
            return rows.withColumns({c: F.lit(start) for c, (_, _, start) in sums.items()})
        told = rows.groupBy(*keys).agg(*[own.alias(c) for c, (own, _, _) in sums.items()])
        before = Window.partitionBy(*by).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
        told = told.select(*keys, *[F.coalesce(over(F.col(c)).over(before), F.lit(start)).alias(c) for c, (_, over, start) in sums.items()])
        return rows.join(told, keys)

    run = carried(rows, _eq=(F.sum("pnl"), F.sum, 0.0), _lost=(F.sum("_loss"), F.sum, 0))
    run = run.withColumn("eq", F.col("_eq") + F.sum("pnl").over(w)).withColumn("losses", F.col("_lost") + F.sum("_loss").over(w))
    settled = F.when(F.col("pnl") >= 0, F.col("losses"))
    run = carried(run, _peak=(F.max("eq"), F.max, 0.0), _base=(F.max(F.abs("eq")), F.max, 0.0), _settled=(F.max(settled), F.max, 0))
    run = run.withColumns({"peak": F.greatest(F.max("eq").over(w), F.col("_peak"), F.lit(0.0)), "base": F.greatest(F.max(F.abs("eq")).over(w), F.col("_base")), "streak": F.col("losses") - F.greatest(F.coalesce(F.max(settled).over(w), F.lit(0)), F.col("_settled"))})
    run = run.withColumn("dd", F.col("peak") - F.col("eq"))
    run = run.withColumn("dd_pct", F.when(F.col("base") > 0, F.col("dd") / F.col("base") * 100).otherwise(0.0))
    return run.drop("_loss", "_eq", "_lost", "_peak", "_base", "_settled", "losses", "_block")


def order_statistics(rows: DataFrame, by: Sequence[str], value: str, wanted: DataFrame, block: int = BLOCK, ranges: int = RANGES) -> DataFrame:
    """by, which, x: the k-th value (from 0) of each group, for wanted (by, which, k), without sorting a group in one task.

    Values are counted in equal ranges between a group's least and largest; only the range that holds the k-th goes on, until it
    is no larger than a block or all of its values are equal.  Each round cuts a range's width by as many ranges as there are.
    """
    keys = [*by, "which"]
    left = rows.select(*by, F.col(value).alias("x")).join(wanted, list(by))
    while True:
        bounds = left.groupBy(*keys).agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.count("*").alias("n"))
        bounds = cut(bounds)
        crowded = (F.col("n") > block) & (F.col("lo") < F.col("hi"))
        if bounds.where(crowded).isEmpty():
            break
        place = F.when(crowded, F.least(F.floor((F.col("x") - F.col("lo")) / (F.col("hi") - F.col("lo")) * ranges), F.lit(ranges - 1))).otherwise(0)
        binned = left.join(bounds, keys).withColumn("bin", place)
        counts = binned.groupBy(*keys, "bin").agg(F.count("*").alias("m"), F.min("k").alias("k"))
        upto = F.sum("m").over(Window.partitionBy(*keys).orderBy("bin"))
        holds = counts.withColumn("upto", upto).where((F.col("k") < F.col("upto")) & (F.col("k") >= F.col("upto") - F.col("m")))
        left = cut(binned.drop("k").join(holds.select(*keys, "bin", (F.col("k") - F.col("upto") + F.col("m")).alias("k")), [*keys, "bin"]).select(*keys, "x", "k"))
    flat = bounds.where(F.col("lo") == F.col("hi")).select(*keys, F.col("lo").alias("x"))
    rest = left.join(bounds.where(F.col("lo") < F.col("hi")).select(*keys), keys, "left_semi")
    ranked = rest.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy("x")) - 1)
    return flat.unionByName(ranked.where(F.col("_rank") == F.col("k")).select(*keys, "x"))


def trial_metrics(trades: DataFrame, avg_sl: float = 30.0, n_bars: int = 1000, bars_per_year: float = 6048, by: Sequence[str] = ("trial_id",), block: int = BLOCK) -> DataFrame:
    """by, and METRICS but dsr and the untracked ones.  trades: by, i (place in the trial, from 1), pnl.

    Where trades have `sl_pips`, a trial's mean stop is theirs and not avg_sl; where they have `n_bars`, so is the number of bars.
    Moments are sums over deviations from the trial's own mean, so they don't cancel however large the mean is.
    """
    p, n = F.col("pnl"), F.col("trades")
    sound = trades.withColumn("pnl", F.col("pnl").cast("double"))
    blocks = is_long(sound, block)
    run = equity(sound, by, block, blocks)
    run = cut(run) if blocks else run

    def with_own(rows: DataFrame, **own: Column) -> DataFrame:
        """rows with aggregates of their whole trial."""
        if blocks:
            return rows.join(rows.groupBy(*by).agg(*[c.alias(k) for k, c in own.items()]), list(by))
        return rows.withColumns({k: c.over(Window.partitionBy(*by)) for k, c in own.items()})

    run = with_own(run, _mean=F.avg("pnl"), _least=F.min("pnl"), _most=F.max("pnl"), slope=F.regr_slope("eq", "i"), mid_eq=F.avg("eq"), mid_i=F.avg("i"))
    run = run.withColumn("d", F.when(F.col("_least") == F.col("_most"), 0.0).otherwise(p - F.col("_mean")))
    # how far equity is from its own straight line over the trade's number
    run = run.withColumn("off", F.coalesce(F.col("eq") - F.col("mid_eq") - F.col("slope") * (F.col("i") - F.col("mid_i")), F.lit(0.0)))
    d2 = F.col("d") * F.col("d")
    stop = F.avg("sl_pips") if "sl_pips" in trades.columns else F.first(F.lit(float(avg_sl)))
    bars = F.max("n_bars").cast("double") if "n_bars" in trades.columns else F.first(F.lit(float(n_bars)))
    m = run.groupBy(*by).agg(
        F.count("*").alias("trades"),
        F.sum("pnl").alias("total_pips"),
        F.avg((p > 0).cast("double")).alias("win_rate"),
        F.sum(F.when(p > 0, p).otherwise(0.0)).alias("won"),
        F.sum(F.when(p < 0, -p).otherwise(0.0)).alias("lost"),
        F.sum(F.when(p < 0, p * p).otherwise(0.0)).alias("neg_sq"),
        F.count_if(p < 0).alias("n_neg"),
        F.sum(d2).alias("s2"), F.sum(d2 * F.col("d")).alias("s3"), F.sum(d2 * d2).alias("s4"),
        F.max("dd").alias("max_dd"),
        F.max("base").alias("base"),
        F.avg(F.col("dd_pct") * F.col("dd_pct")).alias("dd2"),
        F.max("streak").cast("long").alias("max_consec_loss"),
        F.regr_r2("eq", "i").alias("r2"), F.max("slope").alias("slope"), F.sum(F.col("off") * F.col("off")).alias("rest"),
        F.regr_sxx("eq", "i").alias("sxx"), F.regr_syy("eq", "i").alias("syy"),
        *([] if blocks else [F.array_sort(F.collect_list("pnl")).alias("sorted")]),
        stop.alias("stop"), bars.alias("bars"),
    )
    rank = lambda share: F.round((n - 1) * share).cast("long")
    if blocks:
        wanted = m.select(*by, F.explode(F.array(F.struct(F.lit("low").alias("which"), rank(0.05).alias("k")), F.struct(F.lit("high").alias("which"), rank(0.95).alias("k")))).alias("w")).select(*by, "w.*")
        found = order_statistics(run, by, "pnl", wanted, block).groupBy(*by).agg(*[F.max(F.when(F.col("which") == c, F.col("x"))).alias(c) for c in ("low", "high")])
        m = m.join(found, list(by))
    else:
        m = m.withColumns({c: F.element_at("sorted", rank(share).cast("int") + 1) for c, share in (("low", 0.05), ("high", 0.95))})
    per_year = ratio(n * bars_per_year, F.col("bars")) if bars_per_year > 0 else F.least(n, F.lit(252)).cast("double")
    m = m.withColumns({"mean": F.col("total_pips") / n, "std": F.when(n > 1, F.sqrt(F.col("s2") / (n - 1))).otherwise(0.0), "ann": F.sqrt(per_year), "down": F.sqrt(ratio(F.col("neg_sq"), F.col("n_neg")))})
    # what later columns use several times is a column of its own, so that the generated code stays small
    m = m.withColumns({"sr": ratio(F.col("mean"), F.col("std")), "m2": F.col("s2") / n})
    sr = F.col("sr")
    m = m.withColumns({
        "profit_factor": F.when(F.col("lost") > 0, F.col("won") / F.col("lost")).when(F.col("won") > 0, 10.0).otherwise(0.0),
        "sharpe": sr * F.col("ann"),
        "sortino": F.when(F.col("n_neg") > 0, F.col("mean") / F.col("down") * F.col("ann")).when(F.col("mean") > 0, 10.0).otherwise(0.0),
        "return_pct": F.when(F.col("stop") > 0, F.col("total_pips") / F.col("stop") * 100).otherwise(0.0),
        "expectancy_pips": F.col("mean"),
        "expectancy_r": F.when(F.col("stop") > 0, F.col("mean") / F.col("stop")).otherwise(0.0),
        "sqn": F.sqrt("trades") * sr,
        "ulcer": F.sqrt("dd2"),
        "max_dd_pct": F.col("max_dd") / F.when(F.col("base") > 0, F.col("base")).otherwise(1.0) * 100,
        "r_squared": F.when(F.col("syy") > 0, F.greatest(F.coalesce("r2", F.lit(0.0)), F.lit(0.0))).otherwise(0.0),
        "calmar": ratio(F.col("total_pips") * (bars_per_year if bars_per_year > 0 else 0) / F.col("bars"), F.col("max_dd")),
        "recovery": ratio(F.col("total_pips"), F.col("max_dd")),
    })
    # residual variance of equity over the trade's number, and the slope's standard error; a straight line has none
    rest = F.col("rest")
    err = F.when(n > 2, F.sqrt(F.when(rest > STRAIGHT * F.col("syy"), rest).otherwise(0.0) / (n - 2) / F.col("sxx"))).otherwise(0.0)
    m = m.withColumn("err", err)
    m = m.withColumns({"g3": ratio(F.col("s3") / n, F.col("m2") * F.sqrt("m2")), "g4": ratio(F.col("s4") / n, F.col("m2") * F.col("m2"))})
    m = m.withColumn("z", sr * F.sqrt(n - 1) / F.sqrt(F.greatest(1 - F.col("g3") * sr + (F.col("g4") - 1) / 4 * sr * sr, F.lit(1e-12))))
    m = m.withColumns({
        "upi": ratio(F.col("return_pct"), F.col("ulcer")),
        "k_ratio": F.when((n > 2) & (F.col("err") > 0), F.col("slope") / (F.col("err") * F.sqrt("trades"))).otherwise(0.0),
        "tail_ratio": F.when((n >= 20) & (F.col("low") != 0), F.abs("high") / F.abs("low")).otherwise(0.0),
        "omega": F.col("profit_factor"),
        "psr": F.when((n >= 4) & (F.col("std") > 0), norm_cdf(F.col("z"))).otherwise(0.0),
    })
    quality = F.ln(1 + F.col("sortino")) * F.least(F.greatest(F.col("k_ratio") / 3, F.lit(0.0)), F.lit(1.0)) * F.least("profit_factor", F.lit(5.0)) * (F.least(n, F.lit(300)) / 300 * 14.14) / (F.col("ulcer") + 5)
    m = m.withColumn("quality", F.when(F.col("sortino") > 0, quality).otherwise(0.0)).withColumn("quality_v2", F.col("quality"))
    return m.select(*by, *[c for c in METRICS if c not in ("dsr", *UNTRACKED)], "max_dd")


def with_idle(metrics: DataFrame, trials: DataFrame, by: Sequence[str] = ("trial_id",)) -> DataFrame:
    """metrics of all trials: those without trades have zeros; what isn't tracked yet is null."""
    filled = trials.select(*by).join(metrics, list(by), "left").fillna(0).fillna(0.0)
    return filled.withColumns({c: F.lit(None).cast("double") for c in UNTRACKED})


EULER = 0.5772156649015329


def with_dsr(metrics: DataFrame) -> DataFrame:
    """metrics with dsr: psr deflated by the expected best of as many random trials; one trial keeps its psr."""
    n = metrics.agg(F.count("*").cast("double").alias("_n"))
    best = (1 - EULER) * norm_ppf(1 - 1 / F.col("_n")) + EULER * norm_ppf(1 - 1 / (F.col("_n") * math.e))
    rows = metrics.join(F.broadcast(n.withColumn("_best", F.when(F.col("_n") > 1, best))))
    rows = rows.withColumn("_p", F.least(F.greatest("psr", F.lit(1e-12)), F.lit(1 - 1e-12)))
    rows = rows.withColumn("_z", norm_ppf(F.col("_p")) - F.col("_best"))
    return rows.withColumn("dsr", F.when(F.col("_n") < 2, F.col("psr")).otherwise(norm_cdf(F.col("_z")))).drop("_n", "_best", "_p", "_z")
