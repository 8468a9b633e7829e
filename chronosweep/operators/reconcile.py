"""Backtest trades against recorded executions: exact, nearest and residual matches, and why they differ."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronosweep.functions.exprs import pip
from chronosweep.operators.ordered import around, carried

KEY = ["pair", "direction", "signal_s"]


def one_per_key(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key."""
    rest = [c for c in rows.columns if c not in (*keys, order)]
    return rows.groupBy(*keys).agg(F.max(F.struct(order, *rest)).alias("r")).select(*keys, F.col(f"r.{order}").alias(order), *[F.col(f"r.{c}").alias(c) for c in rest])


def match_exact(bt: DataFrame, live: DataFrame) -> DataFrame:
    """Pairs of rows of equal pair, direction and signal bar; sides carry bt_id and live_id."""
    return one_per_key(bt, KEY, "bt_id").join(one_per_key(live, KEY, "live_id"), KEY)


def _nearest(left: DataFrame, right: DataFrame, window: int) -> DataFrame:
    """pair, direction, s, gap, other: the nearest row of right for each key and time of left, of equally near ones that of the least id."""
    told = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.abs(F.col("s") - F.col(c)["s"]).alias("gap"), F.col(c)["id"].alias("other")))
    best = around(left, right, ["pair", "direction"], window).select("pair", "direction", "s", F.array_min(F.array_compact(F.array(told("before"), told("after")))).alias("m"))
    return best.where("m is not null").select("pair", "direction", "s", "m.gap", "m.other")


def match_nearest(bt: DataFrame, live: DataFrame, window: int) -> DataFrame:
    """Mutually nearest rows of a pair and direction within a window of seconds, by the times next to each: no pairs in reach are listed."""
    sides = [side.select("pair", "direction", F.col("signal_s").alias("s"), F.col(i).alias("id")) for side, i in ((bt, "bt_id"), (live, "live_id"))]
    ways = [_nearest(*sides, window), _nearest(*sides[::-1], window)]
    # only rows that the other side names can be mutual
    named = [side.join(way.select(F.col("other").alias("id")).distinct(), "id", "left_semi") for side, way in zip(sides, ways[::-1], strict=True)]
    best = [rows.join(way, ["pair", "direction", "s"]).groupBy("id").agg(F.min(F.struct("gap", "other", "pair", "direction")).alias("m")).select("id", "m.*") for rows, way in zip(named, ways, strict=True)]
    mine = best[0].withColumnsRenamed({"id": "bt_id", "other": "live_id"})
    theirs = best[1].select(F.col("other").alias("bt_id"), F.col("id").alias("live_id"), "gap")
    return mine.join(theirs, ["bt_id", "live_id", "gap"]).select("bt_id", "live_id", "pair", "direction", "gap")


def residuals(bt: DataFrame, live: DataFrame, matched: DataFrame) -> DataFrame:
    """side, id of the rows that no match names."""
    missing = bt.join(matched.select("bt_id"), "bt_id", "left_anti").select(F.lit("missing").alias("side"), F.col("bt_id").alias("id"), "pair")
    return missing.unionByName(live.join(matched.select("live_id"), "live_id", "left_anti").select(F.lit("extra").alias("side"), F.col("live_id").alias("id"), "pair"))


# The categories in which two sides of a match can differ.
CATEGORIES = ("mismatched_entry_price", "mismatched_exit_price", "mismatched_pnl", "mismatched_signal", "mismatched_spread", "mismatched_slippage", "mismatched_closure")


def canonical_reason(reason: Column) -> Column:
    """SL, TP, or OTHER for exits that the other side can't name."""
    return F.when(reason.isin("SL", "TP"), reason).otherwise("OTHER")


def classify(matched: DataFrame, entry: float = 2.0, exit_: float = 2.0, pnl: float = 1.0, spread: float = 0.5, slippage: float = 1.0) -> DataFrame:
    """matched with deltas in pips and the categories in which the sides differ; what one side lacks, or isn't a finite number, flags nothing.

    Columns are bt_ and live_ entry, exit and pnl, and where they are there variant, spread and close, and live_slippage.
    """
    have = set(matched.columns)
    kinds = {"variant": "long", "close": "string"}

    def get(side: str, name: str) -> Column:
        column = F.col(f"{side}_{name}") if f"{side}_{name}" in have else F.lit(None)
        column = column.cast(kinds.get(name, "double"))
        return column if name in kinds else F.when(F.isnan(column) | (F.abs(column) == float("inf")), None).otherwise(column)

    per, way = pip(F.col("pair")), F.when(F.col("direction") > 0, 1).otherwise(-1)
    out = matched.withColumns({
        "entry_delta": (get("live", "entry") - get("bt", "entry")) / per * way,
        "exit_delta": (get("live", "exit") - get("bt", "exit")) / per * way,
        "pnl_delta": get("live", "pnl") - get("bt", "pnl"),
        "spread_delta": get("live", "spread") - get("bt", "spread"),
        "slippage": get("live", "slippage"),
    })
    beyond = {"entry_delta": entry, "exit_delta": exit_, "pnl_delta": pnl}
    variant = (get("bt", "variant") >= 0) & (get("live", "variant") >= 0) & (get("bt", "variant") != get("live", "variant"))
    closure = F.coalesce(canonical_reason(get("bt", "close")) != canonical_reason(get("live", "close")), F.lit(False)) if {"bt_close", "live_close"} & have else F.lit(False)
    tests = [*(F.abs(c) > tolerance for c, tolerance in beyond.items()), variant, F.abs("spread_delta") > spread, F.abs("slippage") > slippage, closure]
    return out.withColumn("categories", F.array_compact(F.array(*[F.when(test, name) for test, name in zip(tests, CATEGORIES, strict=True)])))


def category_counts(classified: DataFrame, left: DataFrame) -> DataFrame:
    """category, n: clean matches as `matched`, each kind of difference that occurs, and missing and extra rows, also where there are none."""
    told = classified.select(F.explode(F.when(F.size("categories") == 0, F.array(F.lit("matched"))).otherwise(F.col("categories"))).alias("category")).groupBy("category").agg(F.count("*").alias("n"))
    rest = left.agg(F.count_if(F.col("side") == "missing").alias("missing_in_live"), F.count_if(F.col("side") == "extra").alias("extra_in_live"))
    return told.unionByName(rest.select(F.explode(F.array(*[F.struct(F.lit(c).alias("category"), F.col(c).alias("n")) for c in rest.columns])).alias("r")).select("r.*"))


def by_pair(classified: DataFrame, left: DataFrame) -> DataFrame:
    """By pair: matched, missing and extra rows, pips of both sides and their difference, each kind of difference, mean spread delta and slippage."""
    pips = lambda c: F.sum(F.coalesce(F.when(~F.isnan(c), F.col(c)), F.lit(0.0)))
    flags = [F.count_if(F.array_contains("categories", c)).alias(f"n_{c}") for c in CATEGORIES]
    m = classified.groupBy("pair").agg(F.count("*").alias("matched"), pips("live_pnl").alias("matched_pnl_pips_live"), pips("bt_pnl").alias("matched_pnl_pips_bt"), *flags, F.avg("spread_delta").alias("mean_spread_delta_pips"), F.avg("slippage").alias("mean_slippage_pips"))
    r = left.groupBy("pair").agg(F.count_if(F.col("side") == "missing").alias("missing_in_live"), F.count_if(F.col("side") == "extra").alias("extra_in_live"))
    every = m.join(r, "pair", "full")
    means = ("pair", "mean_spread_delta_pips", "mean_slippage_pips")
    filled = every.select(*[F.col(c) if c in means else F.coalesce(c, F.lit(0)).alias(c) for c in every.columns])
    return filled.withColumn("delta_pips", F.col("matched_pnl_pips_live") - F.col("matched_pnl_pips_bt"))


def as_live(bt: DataFrame) -> DataFrame:
    """A backtest's rows in the place of recorded ones, to compare two sources of bars."""
    return bt.withColumnsRenamed({c: c.replace("bt_", "live_", 1) for c in bt.columns if c.startswith("bt_")})


def passes(a: DataFrame, b: DataFrame, live: DataFrame) -> DataFrame:
    """pass, category, n of three comparisons: the first source with the record (A), the second with it (B), and both sources (C)."""
    out = None
    for tag, left, right in (("A", a, live), ("B", b, live), ("C", a, as_live(b))):
        matched = match_exact(left, right)
        part = category_counts(classify(matched), residuals(left, right, matched)).select(F.lit(tag).alias("pass"), "category", "n")
        out = part if out is None else out.unionByName(part)
    return out


def round_trips(deals: DataFrame) -> DataFrame:
    """position_id with its first and last deal; positions of one deal are open still."""
    at = F.struct("time", "ticket")
    legs = deals.groupBy("position_id").agg(F.count("*").alias("legs"), F.min_by("price", at).alias("open_price"), F.max_by("price", at).alias("close_price"), F.min("time").alias("open_time"), F.max("time").alias("close_time"), F.sum("profit").alias("profit"))
    return legs.where("legs >= 2")


def as_of(left: DataFrame, right: DataFrame, value: str) -> DataFrame:
    """left (pair, s, id) with the last known value of right (pair, s) at or before s: one union, carried over stretches of time, no range join."""
    both = left.select("pair", "s", "id", F.lit(None).cast("double").alias("v"), F.lit(1).alias("k")).unionByName(right.select("pair", "s", F.lit(None).cast("long").alias("id"), F.col(value).alias("v"), F.lit(0).alias("k")))
    return carried(both, F.col("v"), value, "k").where("k = 1").select("id", "pair", "s", value)
