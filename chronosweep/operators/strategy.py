"""Strategies: signal grids and a search space by level of complexity, changes to them, and what they will cost.

A strategy is a dict of `signals` (families with a leaf for each parameter), `space` (as `space` knows it, with the
selectors and switches of `encoders`) and `execution`.  Its numbers come from a market's ranges, its steps from the level.
"""

from __future__ import annotations

import math
from copy import deepcopy
from dataclasses import asdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronosweep.operators import encoders
from chronosweep.operators import space as spaces
from chronosweep.operators.space import Choice, FloatRange, IntRange

# Up to which level, about how many points a range of floats and one of integers has.
POINTS = ((2, 8, 6), (4, 12, 10), (6, 20, 15), (8, 30, 20), (10, 50, 30))
# The level from which a part is there.
FROM_LEVEL = {"trailing": 4, "max_bars": 4, "breakeven": 5, "chandelier": 5, "partial": 6, "stale": 7, "session": 7, "atr_stop": 3, "all_targets": 3, "macd_cross": 3, "donchian": 7, "more_days": 4}
# Costs and periods of a run that names none.
EXECUTION = {"commission_pips": 0.3, "max_spread_pips": 10.0, "slippage_pips": 0.0, "atr_period": 14}


def tidy(step: float) -> float:
    """The nearest of 1, 2, 5 and 10 times a power of ten."""
    if step <= 0:
        return 1.0
    power = 10.0 ** math.floor(math.log10(step))
    nice = next(n for bound, n in ((1.5, 1), (3.5, 2), (7.5, 5), (math.inf, 10)) if step / power < bound)
    return nice * power


def _points(level: int) -> tuple[int, int]:
    return next((floats, ints) for upto, floats, ints in POINTS if level <= upto)


def floats(level: int, lo: float, hi: float) -> FloatRange:
    return FloatRange(float(lo), float(hi), tidy((hi - lo) / _points(level)[0]))


def ints(level: int, lo: int, hi: int) -> IntRange:
    return IntRange(int(lo), int(hi), max(1, (int(hi) - int(lo)) // _points(level)[1]))


def at_level(level: int, ranges: dict[str, tuple[float, float]]) -> dict:
    """The strategy of a level from 1 to 10.

    ranges: (lo, hi) of fixed_sl, fixed_tp, rr, atr_sl, atr_tp, trail_activate, trail_atr, ema_fast and ema_slow, as a market has them.
    """
    if not 1 <= level <= 10:
        raise ValueError("levels are 1 to 10")
    has = lambda part: level >= FROM_LEVEL[part]
    of = lambda name: floats(level, *ranges[name])
    stop_hi, switch = ranges["fixed_sl"][1], Choice((True, False))
    stops = ("fixed", "atr") if has("atr_stop") else ("fixed",)
    targets = ("rr", "atr", "fixed") if has("all_targets") else ("fixed",) if level == 1 else ("rr",)
    space: dict = {"stop_loss": Choice(stops), "sl_fixed_pips": ("stop_loss", "fixed", of("fixed_sl"))}
    if "atr" in stops:
        space["sl_atr_mult"] = ("stop_loss", "atr", of("atr_sl"))
    space["take_profit"] = Choice(targets)
    space |= {slot: ("take_profit", arm, of(name)) for arm, slot, name in (("rr", "tp_rr", "rr"), ("atr", "tp_atr_mult", "atr_tp"), ("fixed", "tp_fixed_pips", "fixed_tp")) if arm in targets}
    if has("trailing"):
        near = max(5.0, ranges["fixed_sl"][0])
        space |= {"trailing": switch, "trailing_kind": ("trailing", True, Choice(("fixed", "atr"))), "trailing_distance": ("trailing_kind", "fixed", floats(level, near, max(near + 1, stop_hi * 0.6))), "trailing_atr_mult": ("trailing_kind", "atr", of("trail_atr")), "trailing_activate": ("trailing", True, of("trail_activate"))}
    if has("chandelier"):
        space |= {"chandelier": switch, "chandelier_activate": ("chandelier", True, floats(level, 5, 25)), "chandelier_mult": ("chandelier", True, floats(level, 2, 4))}
    if has("breakeven"):
        space |= {"breakeven": switch, "be_trigger": ("breakeven", True, floats(level, 5, max(10, stop_hi * 0.5))), "be_offset": ("breakeven", True, floats(level, -2, 10))}
    if has("partial"):
        space |= {"partial": switch, "partial_pct": ("partial", True, floats(level, 20, 75)), "partial_trigger": ("partial", True, floats(level, 5, max(15, stop_hi * 0.8)))}
    if has("stale"):
        space |= {"stale": switch, "stale_bars": ("stale", True, ints(level, 20, 200)), "stale_atr_thresh": ("stale", True, floats(level, 0.3, 2.5))}
    if has("session"):
        space |= {"session": switch, "hours_start": ("session", True, IntRange(0, 23)), "hours_end": ("session", True, IntRange(0, 23))}
    if has("max_bars"):
        space |= {"bars_limit": switch, "max_bars": ("bars_limit", True, ints(level, 48, 498))}
    space["days_bitmask"] = Choice((31, 63, 127) if has("more_days") else (31,))
    families = {"ema_cross": {"fast": ints(level, *ranges["ema_fast"]), "slow": ints(level, *ranges["ema_slow"])}}
    if has("macd_cross"):
        families["macd_cross"] = {"fast": ints(level, 8, 16), "slow": ints(level, 24, 48), "signal": ints(level, 5, 9)}
    if has("donchian"):
        families["donchian"] = {"lookback": ints(level, 20, 120)}
    return {"signals": families, "space": space, "execution": dict(EXECUTION)}


def grids(strategy: dict) -> dict[str, dict[str, list]]:
    """Families with all values of their parameters, as a library is built from."""
    return {name: {k: spaces.expand(leaf) for k, leaf in params.items()} for name, params in strategy["signals"].items()}


def change(strategy: dict, knobs: dict[str, dict] | None = None, groups: dict[str, bool] | None = None, families: dict[str, bool] | None = None, step_multiplier: float = 1.0) -> dict:
    """A new strategy; the old one stays.

    groups: a switch by name on or off for good, or an arm of a selector (`stop_loss.atr`) left out; the last arm stays.
    families: those that are False go, but never all: then the first stays.  knobs: leaves of the space, or of a family by `family.parameter`.
    """
    out = deepcopy(strategy)
    kept = {k: v for k, v in out["signals"].items() if (families or {}).get(k, True)}
    out["signals"] = kept or dict(list(out["signals"].items())[:1])
    own = lambda name: {k.partition(".")[2]: v for k, v in (knobs or {}).items() if k.partition(".")[0] == name and "." in k}
    out["signals"] = {name: spaces.override(params, own(name), step_multiplier) for name, params in out["signals"].items()}
    out["space"] = spaces.override(out["space"], {k: v for k, v in (knobs or {}).items() if k in out["space"]}, step_multiplier)
    for path, on in (groups or {}).items():
        name, _, arm = path.partition(".")
        node = out["space"].get(name)
        leaf = node[2] if isinstance(node, tuple) else node
        if not isinstance(leaf, Choice):
            raise KeyError(f"{name} is neither a switch nor a selector")
        values = tuple(v for v in leaf.values if v != arm or on) if arm else tuple(v for v in leaf.values if v is on) or (on,)
        leaf = Choice(values or leaf.values)
        out["space"][name] = (*node[:2], leaf) if isinstance(node, tuple) else leaf
    return out


def mapping(strategy: dict) -> list:
    """Encoders of the strategy's slots: those of its leaves, with a limit of bars and hours only where their switch is on."""
    space = strategy["space"]
    out = dict(encoders.standard_mapping(space))
    if "bars_limit" in space:
        out["max_bars"] = F.when(F.col("bars_limit"), encoders.whole("max_bars")).otherwise(0.0)
    if "session" in space:
        out["hours_start"], out["hours_end"] = (F.when(F.col("session"), encoders.whole(name)).otherwise(float(full)) for name, full in (("hours_start", 0), ("hours_end", 23)))
    return list(out.items())


def inspect(strategy: dict) -> list[dict]:
    """The strategy as rows: section, name, kind (float, int, choice, switch, selector), its range or values, and what it hangs on."""
    rows = [{"section": "execution", "name": k, "kind": "value", "values": [v]} for k, v in strategy["execution"].items()]
    for section, held in [(f"signals.{name}", params) for name, params in strategy["signals"].items()] + [("space", strategy["space"])]:
        tests = {node[0] for node in held.values() if isinstance(node, tuple)}
        for name, node in held.items():
            test, wanted, leaf = node if isinstance(node, tuple) else (None, None, node)
            kind = {IntRange: "int", FloatRange: "float", Choice: "choice"}[type(leaf)]
            if isinstance(leaf, Choice) and name in tests:
                kind = "switch" if set(leaf.values) <= {True, False} else "selector"
            rows.append({"section": section, "name": name, "kind": kind, "hangs_on": test, "when": wanted} | {k: list(v) if k == "values" else v for k, v in asdict(leaf).items()})
    return rows


def report(strategy: dict) -> str:
    """`inspect` as text, leaves below what they hang on."""
    lines, depth = [], {}
    for row in inspect(strategy):
        if not lines or row["section"] != depth.get("at"):
            lines.append(f"[{row['section']}]")
            depth["at"] = row["section"]
        level = depth[row["name"]] = depth.get(row.get("hangs_on"), 0) + 1 if row.get("hangs_on") else 0
        what = ", ".join(map(str, row["values"])) if "values" in row else f"{row['lo']:g} to {row['hi']:g} by {row['step']:g}" if row["step"] else f"{row['lo']:g} to {row['hi']:g}"
        lines.append("  " * (level + 1) + f"{row['name']} ({row['kind']}): {what}" + (f" when {row['hangs_on']} is {row['when']}" if level else ""))
    return "\n".join(lines)


def preflight(strategy: dict, library: DataFrame, trials: DataFrame, n_trials: int, per_variant_s: float = 0.25, trials_per_s: float | None = None) -> dict:
    """What a run will be: variants and signals of each family as counted in the library, decisions of sampled trials, and seconds from and to.

    With a rate that was measured, seconds lie within 30 % of it; without, between those of 400 and 120 trials a second.
    """
    families = {r["family"]: (r["n"], r["s"]) for r in library.groupBy("family").agg(F.count("*").alias("n"), F.sum("n_signals").alias("s")).collect()}  # as many rows as families
    combinations = {name: math.prod(len(v) for v in spec.values()) for name, spec in grids(strategy).items()}
    made = encoders.decisions(trials, strategy["space"]).first()
    kinds = [r["kind"] for r in inspect(strategy) if r["section"] == "space"]
    fast, slow = (trials_per_s * 1.3, trials_per_s * 0.7) if trials_per_s else (400.0, 120.0)
    build = sum(n for n, _ in families.values()) * per_variant_s
    return {
        "families": {name: {"combinations": combinations.get(name, 0), "variants": n, "signals": s} for name, (n, s) in sorted(families.items())},
        "leaves": len(kinds), "switches": kinds.count("switch"), "selectors": kinds.count("selector"), "decisions": made.asDict(),
        "build_s": build, "sweep_s": (n_trials / fast, n_trials / slow), "total_s": (build + n_trials / fast, build + n_trials / slow),
    }
