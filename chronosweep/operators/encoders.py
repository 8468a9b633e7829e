"""Sampled trials to the slots of a sweep: encoders as column expressions, and the mapping that a space implies.

A trial is a row with a column for each leaf of its space, null where the leaf's group is off.
An encoder gives one slot's number from such columns.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronosweep.operators import space as spaces
from chronosweep.operators.sweep import SLOTS


def constant(value: float) -> Column:
    return F.lit(float(value))


def number(name: str, default: float = 0.0) -> Column:
    return F.coalesce(F.col(name).cast("double"), F.lit(float(default)))


def whole(name: str, default: int = 0) -> Column:
    """Cut to a whole number, towards zero."""
    return F.coalesce(F.col(name).cast("long").cast("double"), F.lit(float(default)))


def category(name: str, codes: Mapping, default: float = 0.0) -> Column:
    out = F.lit(None).cast("double")
    for value, code in codes.items():
        out = F.when(F.col(name) == F.lit(value), F.lit(float(code))).otherwise(out)
    return F.coalesce(out, F.lit(float(default)))


def _is(name: str, value) -> Column:
    return F.coalesce(F.col(name) == F.lit(value), F.lit(False))


def flag(name: str, on=True) -> Column:
    return F.when(_is(name, on), 1.0).otherwise(0.0)


def mode_or_off(test: str, mode: str | None = None, codes: Mapping | None = None, off: float = 0.0, on=True, default_on: float = 1.0) -> Column:
    """A switch's mode: its code where the switch is on, `off` where it isn't or the mode has no code."""
    told = category(mode, codes, off) if mode is not None and codes else F.lit(float(default_on))
    return F.when(_is(test, on), told).otherwise(float(off))


def if_on(test: str, value: str, default: float = 0.0, on=True) -> Column:
    return F.when(_is(test, on), number(value, default)).otherwise(float(default))


def of_arm(selector: str, arm, value: str, default: float = 0.0) -> Column:
    """A value that only one arm of a selector has."""
    return if_on(selector, value, default, arm)


def slots(mapping: list[tuple[str, Column]]) -> dict[str, Column]:
    """Every slot: mapped ones by their encoder, filters off at -1, all others 0.  A slot that is mapped twice, or unknown, raises."""
    names = [slot for slot, _ in mapping]
    twice = sorted({n for n in names if names.count(n) > 1})
    unknown = sorted(set(names) - set(SLOTS))
    if twice or unknown:
        raise ValueError(f"mapped twice: {twice}; unknown: {unknown}")
    by_name = dict(mapping)
    return {slot: by_name.get(slot, F.lit(default)).cast("double") for slot, default in SLOTS.items()}


def encode(trials: DataFrame, mapping: list[tuple[str, Column]]) -> DataFrame:
    """trial_id and every slot."""
    return trials.select("trial_id", *[column.alias(slot) for slot, column in slots(mapping).items()])


#: Selectors of the standard space: the slot of their mode, and of each arm its code and the slot of its value.
SELECTORS = {
    "stop_loss": ("sl_mode", {"fixed": (0, "sl_fixed_pips"), "atr": (1, "sl_atr_mult"), "swing": (2, None)}),
    "take_profit": ("tp_mode", {"rr": (0, "tp_rr"), "atr": (1, "tp_atr_mult"), "fixed": (2, "tp_fixed_pips")}),
}
#: Switches: the slot that is on or off, and the slots of their values.
SWITCHES = {
    "breakeven": ("be_enabled", ("be_trigger", "be_offset")),
    "partial": ("partial_enabled", ("partial_pct", "partial_trigger")),
    "stale": ("stale_enabled", ("stale_bars", "stale_atr_thresh")),
    "chandelier": ("chandelier_enabled", ("chandelier_activate", "chandelier_mult")),
}
TRAILING = {"fixed": (1, "trailing_distance"), "atr": (2, "trailing_atr_mult")}


def standard_space(atr_pips: float) -> dict:
    """The full space of managed trades, in the names that `standard_mapping` knows."""
    wide = lambda lo, hi: spaces.FloatRange(round(lo * atr_pips, 6), round(hi * atr_pips, 6), scale="log")
    switch, times = spaces.Choice((False, True)), lambda lo, hi: spaces.FloatRange(lo, hi)
    return {
        "stop_loss": spaces.Choice(("fixed", "atr")), "sl_fixed_pips": ("stop_loss", "fixed", wide(0.3, 6.0)), "sl_atr_mult": ("stop_loss", "atr", times(0.5, 6.0)),
        "take_profit": spaces.Choice(("rr", "atr", "fixed")), "tp_rr": ("take_profit", "rr", times(0.5, 5.0)), "tp_atr_mult": ("take_profit", "atr", times(0.5, 10.0)), "tp_fixed_pips": ("take_profit", "fixed", wide(0.5, 10.0)),
        "trailing": switch, "trailing_activate": ("trailing", True, wide(0.3, 8.0)), "trailing_kind": ("trailing", True, spaces.Choice(("fixed", "atr"))), "trailing_distance": ("trailing_kind", "fixed", wide(0.3, 8.0)), "trailing_atr_mult": ("trailing_kind", "atr", times(0.3, 3.0)),
        "breakeven": switch, "be_trigger": ("breakeven", True, wide(0.3, 4.0)), "be_offset": ("breakeven", True, times(0.0, 5.0)),
        "partial": switch, "partial_pct": ("partial", True, spaces.IntRange(20, 80, 10)), "partial_trigger": ("partial", True, wide(0.3, 8.0)),
        "max_bars": spaces.IntRange(0, 400, 10), "stale": switch, "stale_bars": ("stale", True, spaces.IntRange(2, 20)), "stale_atr_thresh": ("stale", True, times(0.2, 2.0)),
        "chandelier": switch, "chandelier_activate": ("chandelier", True, wide(0.3, 8.0)), "chandelier_mult": ("chandelier", True, times(1.0, 6.0)),
        "hours_start": spaces.IntRange(0, 23), "hours_end": spaces.IntRange(0, 23), "days_bitmask": spaces.IntRange(1, 127),
    }


def standard_mapping(space: dict) -> list[tuple[str, Column]]:
    """An encoder for every slot that a space has leaves for; spaces may lack selectors, arms, switches or values."""
    out = [("signal_variant", whole("signal_variant", -1))]
    for selector, (slot, arms) in SELECTORS.items():
        if selector in space:
            out.append((slot, category(selector, {arm: code for arm, (code, _) in arms.items()})))
            out += [(value, of_arm(selector, arm, value)) for arm, (_, value) in arms.items() if value in space]
    if "trailing" in space:
        kinds = {kind: code for kind, (code, _) in TRAILING.items()}
        out.append(("trailing_mode", mode_or_off("trailing", "trailing_kind" if "trailing_kind" in space else None, kinds)))
        out += [("trailing_activate", if_on("trailing", "trailing_activate"))] if "trailing_activate" in space else []
        out += [(value, of_arm("trailing_kind", kind, value)) for kind, (_, value) in TRAILING.items() if value in space]
    for switch, (slot, values) in SWITCHES.items():
        if switch in space:
            out.append((slot, flag(switch)))
            out += [(value, if_on(switch, value)) for value in values if value in space]
    plain = {"max_bars": whole("max_bars"), "hours_start": whole("hours_start"), "hours_end": whole("hours_end", 23), "days_bitmask": whole("days_bitmask", 127)}
    out += [(name, column if name in space else constant({"hours_end": 23, "days_bitmask": 127}.get(name, 0))) for name, column in plain.items()]
    return out


def decisions(trials: DataFrame, space: dict) -> DataFrame:
    """Least, mean and most leaves that trials decide; a leaf of a group that is off isn't decided, the variant is one."""
    made = sum((F.col(name).isNotNull().cast("int") for name in space), F.lit(1))
    return trials.select(made.alias("n")).agg(F.min("n").cast("long").alias("least"), F.avg("n").alias("mean"), F.max("n").cast("long").alias("most"))


def chunk_size(max_trades: int, requested: int | None = None, budget_mb: float = 768.0, fields: int = 9) -> int:
    """Trials that are worked on together so that their trades' records fit a budget."""
    if requested is not None and requested > 0:
        return requested
    return max(10, int(budget_mb * 1024 * 1024 // (max(1, max_trades) * 8 * (1 + fields))))


def preflight(families: dict[str, dict[str, list]], n_bars: int, n_trials: int, per_variant_s: float = 0.25, trials_per_s: float = 250.0) -> dict[str, float]:
    """What a run will be like: variants, signals to expect, and seconds to build and to evaluate."""
    from chronosweep.operators.signals import size_estimate

    size = size_estimate(families, n_bars)
    build, run = size["variants"] * per_variant_s, n_trials / trials_per_s
    return {**size, "build_s": build, "evaluate_s": run, "total_s": build + run}
