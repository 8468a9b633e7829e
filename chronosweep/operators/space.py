"""Search spaces: ranges, sampling by hash, encoding to named parameter columns."""

from __future__ import annotations

import json
import math
from collections.abc import Callable
from dataclasses import asdict, dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronosweep.functions.exprs import uniform


@dataclass(frozen=True)
class IntRange:
    lo: int
    hi: int
    step: int = 1


@dataclass(frozen=True)
class FloatRange:
    lo: float
    hi: float
    step: float | None = None
    scale: str = "linear"  # or "log", for ranges without a step


@dataclass(frozen=True)
class Choice:
    values: tuple


def expand(leaf) -> list:
    """All values of a leaf; a range without a step has none to list."""
    if isinstance(leaf, Choice):
        return list(leaf.values)
    if leaf.step is None:
        raise ValueError("a continuous range can't be listed")
    n = int((leaf.hi - leaf.lo) / leaf.step + 1e-12)
    return [leaf.lo + k * leaf.step for k in range(n + 1)]


def draw(leaf, u: Column) -> Column:
    """The leaf's value at a uniform number."""
    if isinstance(leaf, FloatRange) and leaf.step is None:
        if leaf.scale == "log":
            return F.exp(math.log(leaf.lo) + u * (math.log(leaf.hi) - math.log(leaf.lo)))
        return leaf.lo + u * (leaf.hi - leaf.lo)
    values = expand(leaf)
    return F.element_at(F.array(*[F.lit(v) for v in values]), F.floor(u * len(values)).cast("int") + 1)


def sample(spark: SparkSession, trials: int | DataFrame, space: dict, seed: int, variants: int | None = None) -> DataFrame:
    """trial_id, signal_variant where there are `variants`, and a column for each leaf, of so many trials or of those that a table has.

    A (test leaf, wanted value, leaf) entry is null where its group is off or its selector stands on another arm; a test may itself hang on another.
    """
    rows = trials.select("trial_id") if isinstance(trials, DataFrame) else spark.range(trials).withColumnRenamed("id", "trial_id")
    return drawn(rows, space, lambda name: uniform(seed, F.col("trial_id"), name), variants)


def drawn(rows: DataFrame, space: dict, number: Callable[[str], Column], variants: int | None = None) -> DataFrame:
    """rows with what `sample` adds, from the uniform numbers that `number` gives by name."""
    if variants is not None:
        rows = rows.withColumn("signal_variant", F.floor(number("signal_variant") * variants))
    before, left = rows.columns, dict(space)
    # all leaves whose tests are there already make one step
    while left:
        step = {name: leaf for name, leaf in left.items() if not isinstance(leaf, tuple) or leaf[0] not in left}
        rows = rows.withColumns({name: F.when(F.col(leaf[0]) == leaf[1], draw(leaf[2], number(name))) if isinstance(leaf, tuple) else draw(leaf, number(name)) for name, leaf in step.items()})
        left = {name: leaf for name, leaf in left.items() if name not in step}
    return rows.select(*before, *space)


def encode(trials: DataFrame, slots: dict[str, tuple[str, float]]) -> DataFrame:
    """trial_id and each slot as a double: a column's value, or the slot's default where it is absent."""
    return trials.select("trial_id", *[F.coalesce(F.col(column).cast("double"), F.lit(float(default))).alias(slot) for slot, (column, default) in slots.items()])


def resolve_variant(wanted: DataFrame, variants: DataFrame, strict: bool = False) -> DataFrame:
    """wanted (family, params) with the id that this library gives it: ids are places, not names.  `strict` raises for one that it lacks."""
    found = wanted.join(variants.select("family", "params", "variant_id"), ["family", "params"], "left")
    if not strict:
        return found
    lacking = F.raise_error(F.concat(F.lit("no variant of this library: "), "family", F.lit(" "), "params")).cast("long")
    return found.withColumn("variant_id", F.coalesce("variant_id", lacking))


# Spaces as plain values: a leaf, or a group (test leaf, wanted value, leaf) by name.

_KINDS = {"int": IntRange, "float": FloatRange, "choice": Choice}


def validate(space: dict) -> None:
    """Raises where a range is empty, a choice has no values, or a group's test is no leaf before it."""
    seen: set[str] = set()
    for name, node in space.items():
        leaf = node
        if isinstance(node, tuple):
            test, _, leaf = node
            if test not in seen:
                raise ValueError(f"{name} hangs on {test}, which isn't before it")
        if isinstance(leaf, Choice):
            if not leaf.values:
                raise ValueError(f"{name} has no values")
        elif leaf.lo > leaf.hi or (leaf.step is not None and leaf.step <= 0):
            raise ValueError(f"{name} is an empty range")
        elif getattr(leaf, "scale", "linear") == "log" and leaf.lo <= 0:
            raise ValueError(f"{name} has no logarithm")
        seen.add(name)


def _leaf(node):
    return node[2] if isinstance(node, tuple) else node


def _with_leaf(node, leaf):
    return (*node[:2], leaf) if isinstance(node, tuple) else leaf


def count(space: dict) -> int | None:
    """Points of the grid over all leaves; None with a continuous range."""
    total = 1
    for node in space.values():
        leaf = _leaf(node)
        if not isinstance(leaf, Choice) and leaf.step is None:
            return None
        total *= len(expand(leaf))
    return total


def flatten(space: dict) -> list[tuple]:
    """(name, kind, lo, hi, step, values, test, wanted) of each leaf, as rows of a table of knobs."""
    rows = []
    for name, node in space.items():
        leaf = _leaf(node)
        kind = next(k for k, t in _KINDS.items() if isinstance(leaf, t))
        parts = asdict(leaf)
        test, wanted = node[:2] if isinstance(node, tuple) else (None, None)
        rows.append((name, kind, parts.get("lo"), parts.get("hi"), parts.get("step"), list(parts.get("values", ())), test, wanted))
    return rows


def to_json(space: dict) -> str:
    return json.dumps([[name, kind, asdict(_leaf(space[name])), test, wanted] for name, kind, *_, test, wanted in flatten(space)])


def from_json(text: str) -> dict:
    out = {}
    for name, kind, parts, test, wanted in json.loads(text):
        leaf = _KINDS[kind](**{k: tuple(v) if k == "values" else v for k, v in parts.items()})
        out[name] = leaf if test is None else (test, wanted, leaf)
    return out


def override(space: dict, knobs: dict[str, dict], step_multiplier: float = 1.0) -> dict:
    """A new space.  A knob's `frozen` leaves one value, `enabled` False leaves a switch's first, min, max and step replace a range's."""
    out = {}
    for name, node in space.items():
        leaf, spec = _leaf(node), knobs.get(name, {})
        if not isinstance(leaf, Choice):
            if leaf.step is not None:
                step = leaf.step * step_multiplier
                leaf = replace(leaf, step=max(1, round(step)) if isinstance(leaf, IntRange) else round(step, 6))
            leaf = replace(leaf, **{field: spec[k] for k, field in (("min", "lo"), ("max", "hi"), ("step", "step")) if k in spec})
        elif spec.get("enabled") is False:
            leaf = Choice(leaf.values[:1])
        if "frozen" in spec:
            leaf = Choice((spec["frozen"],))
        out[name] = _with_leaf(node, leaf)
    validate(out)
    return out


def pin(space: dict, trial: dict) -> dict:
    """The space with only a trial's values for the leaves that it names."""
    return {name: _with_leaf(node, Choice((trial[name],))) if name in trial else node for name, node in space.items()}


def preset(level: int, atr_pips: float) -> dict:
    """Spaces of growing size by level 1 to 10, with distances that follow the market's usual range."""
    if not 1 <= level <= 10:
        raise ValueError("levels are 1 to 10")
    wide = lambda lo, hi: FloatRange(round(lo * atr_pips, 6), round(hi * atr_pips, 6))
    switch = Choice((0, 1))
    out = {"sl_mode": Choice((0, 1) if level > 1 else (0,)), "sl_fixed_pips": wide(0.3, 6.0), "tp_mode": Choice((0, 1, 2) if level > 2 else (0,)), "tp_rr": FloatRange(0.5, 5.0)}
    if level >= 2:
        out |= {"sl_atr_mult": ("sl_mode", 1, FloatRange(0.5, 6.0))}
    if level >= 3:
        out |= {"tp_atr_mult": ("tp_mode", 1, FloatRange(0.5, 10.0)), "tp_fixed_pips": ("tp_mode", 2, wide(0.5, 10.0))}
    if level >= 4:
        out |= {"trailing_mode": Choice((0, 1, 2)), "trailing_activate": wide(0.3, 8.0), "trailing_distance": ("trailing_mode", 1, wide(0.3, 8.0)), "trailing_atr_mult": ("trailing_mode", 2, FloatRange(0.3, 3.0)), "max_bars": IntRange(0, 40 * level, 10)}
    if level >= 5:
        out |= {"be_enabled": switch, "be_trigger": ("be_enabled", 1, wide(0.3, 4.0)), "be_offset": ("be_enabled", 1, wide(0.0, 1.0)), "chandelier_enabled": switch, "chandelier_activate": ("chandelier_enabled", 1, wide(0.3, 8.0)), "chandelier_mult": ("chandelier_enabled", 1, FloatRange(1.0, 6.0))}
    if level >= 6:
        out |= {"partial_enabled": switch, "partial_pct": ("partial_enabled", 1, IntRange(20, 80, 10)), "partial_trigger": ("partial_enabled", 1, wide(0.3, 8.0))}
    if level >= 7:
        out |= {"stale_enabled": switch, "stale_bars": ("stale_enabled", 1, IntRange(2, 20)), "stale_atr_thresh": ("stale_enabled", 1, FloatRange(0.2, 2.0)), "session": switch, "hours_start": ("session", 1, IntRange(0, 23)), "hours_end": ("session", 1, IntRange(0, 23)), "days_bitmask": ("session", 1, IntRange(1, 31))}
    return out
