"""Picking trials: constraints with fallback, ties in a fixed order, top-N by objective, plots."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronosweep.functions.lineage import cut

#: Metrics of which less is better.
LOWER = ("max_dd_pct", "ulcer", "max_consec_loss")


def finite(metric: str) -> Column:
    """The metric as a number, null where it isn't finite: Spark would rank NaN above everything."""
    x = F.col(metric).cast("double")
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def better(metric: str) -> Column:
    """The metric turned so that more is better; what isn't finite ranks last."""
    x = finite(metric)
    return F.coalesce(-x if metric in LOWER else x, F.lit(float("-inf")))


def holds(metric: str, op: str, value: float) -> Column:
    """A constraint; what isn't finite never passes."""
    x = finite(metric)
    return {">=": x >= value, ">": x > value, "<=": x <= value, "<": x < value, "==": x == value, "!=": x != value}[op]


def _or_all(metrics: DataFrame, passes: Column) -> DataFrame:
    """Rows that pass, or all rows if none does: the test is one row, joined to all."""
    some = metrics.agg(F.coalesce(F.max(F.coalesce(passes, F.lit(False)).cast("int")), F.lit(0)).alias("_some"))
    return metrics.join(F.broadcast(some)).where((F.col("_some") == 0) | passes).drop("_some")


def pick_best(metrics: DataFrame, objective: str, constraints: list[tuple[str, str, float]] = (), tie_break: tuple[str, ...] = ("return_pct", "trades"), profitable: bool = False) -> DataFrame:
    """The best trial: constraints, then profitability, each falling back to all rows; ties by tie_break, then the first trial."""
    rows = metrics
    if constraints:
        rows = _or_all(rows, reduce(lambda a, b: a & b, [holds(*c) for c in constraints]))
    if profitable:
        rows = _or_all(rows, holds("return_pct", ">", 0) | holds("profit_factor", ">", 1))
    return rows.orderBy(*[better(m).desc() for m in (objective, *tie_break)], "trial_id").limit(1)


def top_per_objective(metrics: DataFrame, objectives: list[str], n: int, by: list[str] | None = None) -> DataFrame:
    """by, objective, trial_id, value, rank: the rank's bound holds in each task before the shuffle."""
    by = by or []
    pairs = F.explode(F.array(*[F.struct(F.lit(m).alias("objective"), F.col(m).cast("double").alias("value"), better(m).alias("order")) for m in objectives]))
    long = metrics.select(*by, "trial_id", pairs.alias("o")).select(*by, "trial_id", "o.*")
    w = Window.partitionBy(*by, "objective").orderBy(F.desc("order"), "trial_id")
    return long.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n).drop("order")


#: Objectives that a lean run keeps the best trials of, and those whose list another one shares: with a fixed number of trials dsr rises with psr.
BENCHES = (
    "trades", "win_rate", "quality", "profit_factor", "sharpe", "sortino", "r_squared", "return_pct", "expectancy_r", "expectancy_pips", "sqn", "calmar", "recovery", "upi", "k_ratio", "tail_ratio", "omega", "psr",
    "total_pips", "quality_profitable", "max_dd_pct", "ulcer", "max_consec_loss",
)
SHARED = {"dsr": "psr"}


def benches(metrics: DataFrame, n: int, by: list[str] | None = None) -> DataFrame:
    """by, objective, trial_id, value, rank: the best n of each of BENCHES, and the lists that are shared.

    quality_profitable is the quality of trials that gain or whose profit factor is over 1; what isn't finite stands on no bench.
    """
    profitable = holds("total_pips", ">", 0) | holds("profit_factor", ">", 1)
    rows = metrics.withColumn("quality_profitable", F.when(profitable, F.col("quality")))
    tops = top_per_objective(rows.withColumns({c: finite(c) for c in BENCHES}), list(BENCHES), n, by).where("value IS NOT NULL")
    named = F.explode(F.when(F.col("objective").isin(*SHARED.values()), F.array("objective", *[F.when(F.col("objective") == source, F.lit(c)) for c, source in SHARED.items()])).otherwise(F.array("objective")))
    return tops.withColumn("objective", named).where("objective IS NOT NULL")


def kept(metrics: DataFrame, tops: DataFrame, by: list[str] | None = None) -> DataFrame:
    """by, trial_id, benches, best_rank, is_best of all trials on any bench, and of the best one.

    The best is the trial of most quality, ties by return and trades.  Where that stands on no bench, as a sweep's parts may rank ties otherwise, the first of
    quality_profitable takes its place, or if no trial is profitable the first of quality.
    """
    by = by or []
    order = [better(m).desc() for m in ("quality", "return_pct", "trades")]
    chosen = metrics.withColumn("_place", F.row_number().over(Window.partitionBy(*by).orderBy(*order, "trial_id"))).where("_place = 1").select(*by, F.col("trial_id").alias("_first"))
    seats = tops.where(~F.col("objective").isin(*SHARED)).groupBy(*by, "trial_id").agg(F.count("*").alias("benches"), F.min("rank").cast("long").alias("best_rank"))
    heads = tops.where("rank = 1 AND objective IN ('quality_profitable', 'quality')").groupBy(*by).agg(F.max_by("trial_id", F.col("objective") == "quality_profitable").alias("_head"))
    seated = chosen.join(seats.select(*by, F.col("trial_id").alias("_first"), F.lit(True).alias("_seated")), [*by, "_first"], "left")
    best = (seated.join(heads, by, "left") if by else seated.join(F.broadcast(heads))).select(*by, F.when(F.col("_seated"), F.col("_first")).otherwise(F.coalesce("_head", "_first")).alias("trial_id"), F.lit(True).alias("_best"))
    out = seats.join(best, [*by, "trial_id"], "full")
    return out.select(*by, "trial_id", F.coalesce("benches", F.lit(0)).alias("benches"), "best_rank", F.coalesce("_best", F.lit(False)).alias("is_best"))


def retained(tops: DataFrame) -> DataFrame:
    return tops.select("trial_id").distinct()


def decimate(points: DataFrame, limit: int, required: DataFrame) -> DataFrame:
    """Every k-th trial by number, k such that `limit` suffices, and all that are required."""
    n = points.agg(F.ceil(F.count("*") / limit).alias("_step"))
    keep = points.join(F.broadcast(n)).join(required.select("trial_id", F.lit(1).alias("_req")), "trial_id", "left")
    return keep.where((F.col("trial_id") % F.greatest("_step", F.lit(1)) == 0) | F.col("_req").isNotNull()).drop("_step", "_req")


def by_density(metrics: DataFrame) -> DataFrame:
    """Trials by number of trades, among those that gain and draw down less than 30 %."""
    return _or_all(metrics, holds("total_pips", ">=", 0) & holds("max_dd_pct", "<", 30) & holds("trades", ">", 0)).orderBy(better("trades").desc(), better("total_pips").desc(), "trial_id").limit(1)


def with_proxy(metrics: DataFrame, charge: float) -> DataFrame:
    """metrics with adjusted_proxy: what all trades earn after a charge (negative: a cost) on each."""
    return metrics.withColumn("adjusted_proxy", F.col("trades") * (F.col("expectancy_pips") + charge))


def jump_best(metrics: DataFrame, objective: str) -> DataFrame:
    """The best trial of a plot: profitable ones only if there are any; ties by return, then quality."""
    rows = _or_all(metrics, F.when(F.col("total_pips").isNotNull(), holds("total_pips", ">", 0)).otherwise(holds("profit_factor", ">", 1)))
    return rows.orderBy(*[better(m).desc() for m in (objective, "return_pct", "quality")], "trial_id").limit(1)


def evenly_spaced(points: DataFrame, limit: int, required: int | None = None) -> DataFrame:
    """At most `limit` trials (numbered from 0) evenly spread over all, the last giving way to a required one that isn't among them."""
    n = points.agg(F.max("trial_id").alias("_last"))
    place = F.when(F.col("_last") < limit, F.col("id")).otherwise(F.floor(F.col("id") * (F.col("_last") / (limit - 1))))
    chosen = points.sparkSession.range(limit).join(F.broadcast(n)).select(F.least(place, F.col("_last")).cast("long").alias("trial_id"), "_last").distinct()
    if required is not None:
        has = chosen.agg(F.max((F.col("trial_id") == required).cast("int")).alias("_has"))
        swap = (F.col("_has") == 0) & (F.col("_last") >= limit) & (F.col("trial_id") == F.col("_last"))
        chosen = chosen.join(F.broadcast(has)).withColumn("trial_id", F.when(swap, F.lit(required).cast("long")).otherwise(F.col("trial_id")))
    return points.join(chosen.select("trial_id"), "trial_id", "left_semi")


def running_best(metrics: DataFrame, metric: str, block: int = 1000) -> DataFrame:
    """trial_id and the best of the metric so far: a maximum within blocks of trials, one over blocks within their group, one over groups."""
    m = cut(metrics.select("trial_id", finite(metric).alias("x"), F.floor(F.col("trial_id") / block).alias("block"), F.floor(F.col("trial_id") / (block * block)).alias("group")))
    best = F.max("x")
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    blocks = m.groupBy("group", "block").agg(best.alias("x"))
    groups = m.groupBy("group").agg(best.alias("x")).select("group", best.over(earlier(Window.orderBy("group"))).alias("_far"))
    before = blocks.select("group", "block", best.over(earlier(Window.partitionBy("group").orderBy("block"))).alias("_near")).join(groups, "group")
    within = best.over(Window.partitionBy("group", "block").orderBy("trial_id"))
    return m.join(before, ["group", "block"]).select("trial_id", F.greatest(within, "_near", "_far").alias("best"))


def lookup(metrics: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (trial_id, in the order of `place`) with its metrics, null for trials that there are none of."""
    return wanted.join(metrics, "trial_id", "left")
