"""Entry events: crosses, breakouts, reversals, and the library of parameter variants.

A family says which features of a bar it needs and where it enters.  A library computes
each distinct feature of all its variants once, over one pass, and then tells every
variant's entries bar by bar; the plan grows with the features, not with the variants.
"""

from __future__ import annotations

import hashlib
import itertools
import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from chronosweep.functions.exprs import hour_of, pip, session_id, weekday_of
from chronosweep.functions.lineage import cut
from chronosweep.operators import indicators
from chronosweep.operators.ordered import in_order, numbered


class InvalidCombination(ValueError):
    """A parameter combination that a family has no meaning for; grids skip it."""


@dataclass(frozen=True)
class Rule:
    """Features by name, and the conditions of a long and of a short entry over them; `was(name)` is a feature's value one bar before."""

    features: tuple[tuple, ...]
    up: Callable[[Callable[[str], Column]], Column]
    down: Callable[[Callable[[str], Column]], Column]


#: family name -> rule(**params)
FAMILIES: dict[str, Callable[..., Rule]] = {}


def family(name: str):
    """Register a function from parameters to a Rule under a name of its own."""

    def add(fn):
        if name in FAMILIES:
            raise KeyError(f"{name} is registered")
        FAMILIES[name] = fn
        return fn

    return add


def feature_name(feature: tuple) -> str:
    return "_".join(map(str, ("f", *feature))).replace(".", "d")


def _crossing(fast: tuple, slow: tuple) -> Rule:
    f, s = feature_name(fast), feature_name(slow)
    return Rule((fast, slow), lambda was: (F.col(f) > F.col(s)) & (was(f) <= was(s)), lambda was: (F.col(f) < F.col(s)) & (was(f) >= was(s)))


@family("ema_cross")
def ema_rule(fast: int, slow: int) -> Rule:
    if fast >= slow:
        raise InvalidCombination("fast must be under slow")
    return _crossing(("ema", fast), ("ema", slow))


@family("macd_cross")
def macd_rule(fast: int, slow: int, signal: int) -> Rule:
    if fast >= slow or signal >= slow:
        raise InvalidCombination("fast and signal must be under slow")
    return _crossing(("macd", fast, slow), ("macd_signal", fast, slow, signal))


@family("donchian")
def donchian_rule(lookback: int) -> Rule:
    """Closes beyond the channel, where the bar before was not."""
    if lookback < 2:
        raise InvalidCombination("lookback must be 2 or more")
    above, below = ("above", lookback), ("below", lookback)
    begins = lambda name: lambda was: F.col(name) & ~F.coalesce(was(name), F.lit(False))
    return Rule((above, below), begins(feature_name(above)), begins(feature_name(below)))


@family("rsi_reversal")
def rsi_rule(period: int, lower: float, upper: float) -> Rule:
    if period < 2 or not 0 < lower < upper < 100:
        raise InvalidCombination("period must be 2 or more and 0 < lower < upper < 100")
    f = feature_name(("rsi", period))
    return Rule((("rsi", period),), lambda was: (F.col(f) > lower) & (was(f) <= lower), lambda was: (F.col(f) < upper) & (was(f) >= upper))


#: What a bar tells as a whole number, by the name that a library's `marks` give it; -1 where it is unknown.
MARKS: dict[str, Callable[[], Column]] = {
    "session": lambda: session_id(hour_of(F.col("s"))),
    "weekday": lambda: weekday_of(F.col("s")),
    "hour": lambda: hour_of(F.col("s")),
    "quarter": lambda: F.floor(hour_of(F.col("s")) / 6),
    "week": lambda: F.floor((F.col("s") + 3 * 86_400) / 604_800) % 4,
    "body": lambda: F.when(F.col("close") >= F.col("open"), 1).otherwise(0),
    "range": lambda: F.floor((F.col("high") - F.col("low")) / pip(F.col("pair")) / 10),
    "cost": lambda: F.floor(F.col("spread") / pip(F.col("pair"))),
    "activity": lambda: F.floor(F.sqrt("volume")),
    "place": lambda: F.col("rn") % 5,
}


def with_features(bars: DataFrame, wanted: set[tuple]) -> DataFrame:
    """bars with a column for each feature: recursive averages in two passes at most, channels in one."""
    of = lambda kind: sorted(f for f in wanted if f[0] == kind)
    lines = sorted({f[:3] for f in of("macd_signal")} | {("macd_signal", *f[1:]) for f in of("macd")})
    out, first = bars, {}
    spans = sorted({f[1] for f in of("ema")} | {n for f in lines for n in f[1:3]})
    if spans:
        first["close"] = spans
    if of("rsi") or of("atr"):
        out = indicators.moves(out)
        spans = {"gain": [f[1] for f in of("rsi")], "loss": [f[1] for f in of("rsi")], "tr": [f[1] for f in of("atr")]}
        first |= {k: v for k, v in spans.items() if v}
    if first:
        out = indicators.averages(out, first)
    out = out.withColumns({feature_name(("macd", *f[1:])): F.col(f"close_{f[1]}") - F.col(f"close_{f[2]}") for f in lines})
    signal = {feature_name(("macd", *f[1:])): [g[3] for g in of("macd_signal") if g[1:3] == f[1:]] for f in lines}
    signal = {k: v for k, v in signal.items() if v}
    if signal:
        out = indicators.averages(out, signal)
    named = {("ema", n): F.col(f"close_{n}") for (_, n) in of("ema")}
    named |= {g: F.col(f"{feature_name(('macd', *g[1:3]))}_{g[3]}") for g in of("macd_signal")}
    named |= {g: indicators.strength(f"gain_{g[1]}", f"loss_{g[1]}") for g in of("rsi")}
    named |= {g: F.col(f"tr_{g[1]}") for g in of("atr")}
    out = out.withColumns({feature_name(k): c for k, c in named.items()})
    lookbacks = sorted({f[1] for f in wanted if f[0] in ("above", "below")})
    swings = sorted({f[1] for f in wanted if f[0] in ("lowest", "highest")})
    if lookbacks or swings:

        def make(df: DataFrame, w: WindowSpec) -> DataFrame:
            columns = {}
            for n in lookbacks:
                upper, lower = indicators.channel(w, n)
                columns |= {feature_name(("above", n)): F.coalesce(F.col("close") > upper, F.lit(False)), feature_name(("below", n)): F.coalesce(F.col("close") < lower, F.lit(False))}
            for n in swings:
                last = w.rowsBetween(1 - n, 0)
                columns |= {feature_name(("lowest", n)): F.min("low").over(last), feature_name(("highest", n)): F.max("high").over(last)}
            return df.withColumns(columns)

        out = in_order(out, max([*lookbacks, *swings]), make)
    return out.select(*bars.columns, *[feature_name(f) for f in sorted(wanted)])


def entries(bars: DataFrame, rules: list[tuple[int, Rule]], more: tuple[tuple, ...] = ()) -> DataFrame:
    """bars, with further features, exploded to variant_id and direction (1 or -1) where a rule enters."""
    features = {f for _, r in rules for f in r.features}
    names = [feature_name(f) for f in sorted(features)]
    out = [*bars.columns, *map(feature_name, more)]

    def make(df: DataFrame, w: WindowSpec) -> DataFrame:
        return df.withColumns({f"was_{n}": F.lag(n).over(w) for n in names})

    known = in_order(with_features(numbered(bars), features | set(more)), 1, make)
    was = lambda name: F.col(f"was_{name}")
    told = [F.struct(F.lit(v).cast("long").alias("variant_id"), F.when(r.up(was), 1).when(r.down(was), -1).alias("direction")) for v, r in rules]
    fired = F.filter(F.array(*told), lambda x: x["direction"].isNotNull())
    return known.select(*out, F.explode(fired).alias("e")).select(*out, "e.*")


def events(bars: DataFrame, name: str, **params) -> DataFrame:
    """pair, s, direction, entry_price of one family with one set of parameters."""
    return entries(bars, [(0, FAMILIES[name](**params))]).select("pair", "s", "direction", F.col("close").alias("entry_price"))


def ema_cross(bars: DataFrame, fast: int, slow: int) -> DataFrame:
    return events(bars, "ema_cross", fast=fast, slow=slow)


def macd_cross(bars: DataFrame, fast: int, slow: int, signal: int) -> DataFrame:
    return events(bars, "macd_cross", fast=fast, slow=slow, signal=signal)


def donchian(bars: DataFrame, lookback: int) -> DataFrame:
    return events(bars, "donchian", lookback=lookback)


def rsi_reversal(bars: DataFrame, period: int, lower: float, upper: float) -> DataFrame:
    return events(bars, "rsi_reversal", period=period, lower=lower, upper=upper)


def grid(spec: dict[str, list]) -> list[dict]:
    return [dict(zip(spec, values, strict=True)) for values in itertools.product(*spec.values())]


def variants_of(families: dict[str, dict[str, list]]) -> list[tuple[int, str, dict]]:
    """(id, family, parameters) of the valid combinations, ids dense in the order of enumeration."""
    found = []
    for name, spec in families.items():
        for params in grid(spec):
            try:
                FAMILIES[name](**params)
            except InvalidCombination:
                continue
            found.append((len(found), name, params))
    return found


def size_estimate(families: dict[str, dict[str, list]], n_bars: int, rate: float = 0.02) -> dict[str, int]:
    """Combinations, valid ones, and the signals to expect of them at a share of bars that fire."""
    valid = len(variants_of(families))
    return {"combinations": sum(len(grid(spec)) for spec in families.values()), "variants": valid, "signals": round(valid * n_bars * rate)}


def fingerprint(params: dict) -> str:
    return ",".join(f"{k}={v}" for k, v in sorted(params.items()))


def cached_library(bars: DataFrame, families: dict[str, dict[str, list]], folder: str, **options) -> tuple[DataFrame, DataFrame]:
    """A library that is built once for a set of families, options and bars and read from a shared folder after that.

    Its key is a digest of all of them; one that wasn't written to its end lacks its variants and is built anew.
    """
    spark = bars.sparkSession
    told = bars.agg(F.count("*"), F.sum(F.xxhash64(*sorted(bars.columns)).cast("decimal(38,0)"))).first()
    key = hashlib.sha256(json.dumps([families, options, [str(x) for x in told]], sort_keys=True).encode()).hexdigest()[:32]
    paths = [f"{folder}/{key}/{name}" for name in ("variants", "signals")]
    try:
        return tuple(spark.read.parquet(p) for p in paths)
    except AnalysisException:  # absent
        variants, signals = build_library(bars, families, **options)
        signals.write.mode("overwrite").parquet(paths[1])
        variants.write.mode("overwrite").parquet(paths[0])
        return tuple(spark.read.parquet(p) for p in paths)


def build_library(bars: DataFrame, families: dict[str, dict[str, list]], atr_period: int = 14, together: int = 100, swing: int | None = None, value: str | None = None, marks: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(variants, signals) of all valid combinations; variants without signals stay.

    signals: variant_id, signal_id (the bar's place and the variant's), pair, s, no, direction, entry_price, atr_pips, pip, hour, day, session, spread,
    written in order of variant and place within their files.  `swing` adds swing_sl, the lowest low (of a short: the highest high) of so many bars up to
    the signal's; `value` adds filter_value and `marks` p0 to p9, both by names of MARKS.
    Variants are told `together` at a time, so that a bar's array stays small.
    """
    spark = bars.sparkSession
    rows = variants_of(families)
    full, atr, signals = cut(numbered(bars)), ("atr", atr_period), None
    more = (atr, ("lowest", swing), ("highest", swing)) if swing else (atr,)
    for at in range(0, len(rows), together):
        part = entries(full, [(v, FAMILIES[name](**params)) for v, name, params in rows[at : at + together]], more)
        signals = part if signals is None else signals.unionByName(part)
    variants = spark.createDataFrame([(v, name, fingerprint(params)) for v, name, params in rows], "variant_id long, family string, params string")
    if signals is None:
        return variants.withColumn("n_signals", F.lit(0).cast("long")), bars.limit(0)
    mark = lambda name: F.coalesce(MARKS[name](), F.lit(-1))
    extra = {"swing_sl": F.when(F.col("direction") == 1, F.col(feature_name(("lowest", swing)))).otherwise(F.col(feature_name(("highest", swing))))} if swing else {}
    extra |= {"filter_value": mark(value).cast("double")} if value else {}
    extra |= {f"p{k}": mark(name).cast("long") for k, name in enumerate(marks)}
    hour, per = hour_of(F.col("s")), pip(F.col("pair"))
    signals = signals.withColumns({"no": F.col("rn"), "atr": F.col(feature_name(atr)), **extra})
    signals = signals.select("variant_id", (F.col("no") * len(rows) + F.col("variant_id")).alias("signal_id"), "pair", "s", "no", "direction", F.col("close").alias("entry_price"), (F.col("atr") / per).alias("atr_pips"), per.alias("pip"), hour.alias("hour"), weekday_of(F.col("s")).alias("day"), session_id(hour).alias("session"), "spread", *extra)
    signals = cut(signals.sortWithinPartitions("variant_id", "no"))
    counts = signals.groupBy("variant_id").agg(F.count("*").alias("n"))
    return variants.join(counts, "variant_id", "left").withColumn("n_signals", F.coalesce("n", F.lit(0))).drop("n"), signals
