"""Stops, targets, entry costs and the filters that stand before a trade."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIXED, ATR, SWING = 0, 1, 2
BY_RATIO, BY_ATR, BY_PIPS = 0, 1, 2


def stops(rows: DataFrame, clamp: bool = True) -> DataFrame:
    """rows with sl_price, tp_price, sl_pips, tp_pips; live orders don't clamp the target to the stop's distance."""
    pip, atr, entry = F.col("pip"), F.col("atr_pips") * F.col("pip"), F.col("entry_price")
    swing = F.when(F.col("swing_sl").isNull() | F.isnan("swing_sl"), atr * 1.5).otherwise(F.greatest(F.abs(entry - F.col("swing_sl")), 5 * pip))
    sl = F.when(F.col("sl_mode") == ATR, atr * F.col("sl_atr_mult")).when(F.col("sl_mode") == SWING, swing).otherwise(F.col("sl_fixed_pips") * pip)
    tp = F.when(F.col("tp_mode") == BY_ATR, atr * F.col("tp_atr_mult")).when(F.col("tp_mode") == BY_PIPS, F.col("tp_fixed_pips") * pip).otherwise(sl * F.col("tp_rr"))
    tp = F.greatest(tp, sl) if clamp else tp
    side = F.col("direction")
    return rows.withColumns({"sl_price": entry - side * sl, "tp_price": entry + side * tp, "sl_pips": sl / pip, "tp_pips": tp / pip})


def opt_out(wanted: Column, has: Column) -> Column:
    """Equal, or either side opts out by a negative number or null."""
    return wanted.isNull() | has.isNull() | (wanted < 0) | (has < 0) | (wanted == has)


def value_filter(direction: Column, value: Column, buy: Column, sell: Column) -> Column:
    """The side's filter equals the signal's value within 1e-9; a negative number opts out on either side."""
    want = F.when(direction == 1, buy).otherwise(sell)
    return (want < 0) | (value < 0) | (F.abs(want - value) < 1e-9)


def p_filters(wanted: list[Column], has: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, [opt_out(F.round(w).cast("long"), h) for w, h in zip(wanted, has, strict=True)], F.lit(True))


def spread_gate(spread: Column, pip: Column, most: Column) -> Column:
    """Off where the bound isn't positive; an unknown spread is refused."""
    return (most <= 0) | F.coalesce(spread / pip <= most, F.lit(False))
