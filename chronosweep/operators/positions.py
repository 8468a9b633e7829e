"""Managed positions: all open trades of a stretch of bars are carried through it side by side.

A trade's rules and state are one array of numbers.  `advance` runs many trades through
bars in lock step, in numpy; `simulate` deals trades and bars to cells of a pair's bars
and lets open trades go on to later, wider cells, until none is open.  No task holds a
pair's history or more than `GROUP` trades, and the number of rounds grows with the
logarithm of the longest trade up to the widest cell.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronosweep.functions.lineage import apart, cut
from chronosweep.operators import ordered

# Exit reasons by code.
REASONS = ("NONE", "SL", "TP", "TRAILING", "BREAKEVEN", "MAX_BARS", "STALE", "CHANDELIER")
NONE, SL, TP, TRAILING, BREAKEVEN, MAX_BARS, STALE, CHANDELIER = range(8)

#: What a trade brings: prices and costs, then the rules, each with what stands for an absent one.
TRADE = {"direction": 1.0, "entry_price": None, "sl_price": None, "tp_price": None, "atr_pips": 0.0, "pip": 0.0001, "slippage": 0.0, "commission": 0.0, "entry_spread": 0.0, "entry_no": None}
RULES = {
    "trailing_mode": 0.0, "trailing_activate": 0.0, "trailing_distance": 0.0, "trailing_atr_mult": 0.0, "be_enabled": 0.0, "be_trigger": 0.0, "be_offset": 0.0,
    "partial_enabled": 0.0, "partial_pct": 0.0, "partial_trigger": 0.0, "max_bars": 0.0, "stale_enabled": 0.0, "stale_bars": 0.0, "stale_atr_thresh": 0.0,
    "chandelier_enabled": 0.0, "chandelier_activate": -1.0, "chandelier_mult": 0.0,
}
#: What changes: the entry after costs, the stop, the stop staged for the next bar, flags that hold and flags that are staged, the price furthest ahead, the size left, what was gained, whether a part was closed, and the main bar to go on from.
STATE = ("entry", "stop", "staged", "locked", "trailing", "chandelier", "next_locked", "next_trailing", "next_chandelier", "extreme", "size", "gained", "taken", "at")
FIELDS = (*TRADE, *RULES, *STATE)
PLACE = {name: k for k, name in enumerate(FIELDS)}
BAR = ("no", "s", "high", "low", "close", "spread", "main_close", "main_spread", "main_range", "last_no")

#: Trades to a group, main bars to a cell of the first round, growth of cells by round, and the widest cell.
GROUP, FIRST, GROWTH, WIDEST = 20_000, 64, 8, 4096


def start(v: np.ndarray) -> None:
    """Fill the state of new trades (rows of v) in place."""
    f = lambda name: v[:, PLACE[name]]
    buy = f("direction") == 1
    slip = f("slippage") * f("pip")
    v[:, PLACE["entry"]] = np.where(buy, f("entry_price") + slip + np.nan_to_num(f("entry_spread")), f("entry_price") - slip)
    v[:, PLACE["stop"]], v[:, PLACE["staged"]] = f("sl_price"), np.nan
    for name in ("locked", "trailing", "chandelier", "next_locked", "next_trailing", "next_chandelier", "gained", "taken"):
        v[:, PLACE[name]] = 0.0
    v[:, PLACE["extreme"]], v[:, PLACE["size"]], v[:, PLACE["at"]] = f("entry"), 1.0, f("entry_no") + 1


def rolling_ranges(numbers: np.ndarray, ranges: np.ndarray, widths: np.ndarray) -> np.ndarray:
    """(width, main bar): the largest range of the last `width` main bars up to each; zero for a width of none."""
    out = np.zeros((len(widths), len(numbers)))
    for row, n in zip(out, widths.astype(int), strict=True):
        for back in range(min(max(n, 0), len(ranges))):
            row[back:] = np.maximum(row[back:], ranges[: len(ranges) - back])
    return out


def advance(v: np.ndarray, bars: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Carry trades (rows of v, in FIELDS) through bars in order, changing their state in place.

    bars: BAR columns sorted by (no, s); a main bar without bars of its own has one row without prices.  Returns for each
    trade done, pnl, reason, exit_no, exit_s and exit_price.
    """
    n = len(v)
    out = {"done": np.zeros(n, bool), "pnl": np.full(n, np.nan), "reason": np.zeros(n, np.int32), "exit_no": np.full(n, -1, np.int64), "exit_s": np.full(n, np.nan), "exit_price": np.full(n, np.nan)}
    no = bars["no"].astype(np.int64)
    if not len(no) or not n:
        return out
    mains, first = np.unique(no, return_index=True)
    col = {name: v[:, k] for name, k in PLACE.items()}
    widths = np.unique(col["stale_bars"][col["stale_enabled"] > 0])
    pip = col["pip"]
    rolled = rolling_ranges(mains, bars["main_range"][first], widths)
    width_of = np.searchsorted(widths, col["stale_bars"]) if len(widths) else None
    slip = col["slippage"] * pip
    broken = np.isnan(col["at"]) | np.isnan(col["entry"])
    out["done"][broken] = True
    order = np.flatnonzero(~broken)
    order = order[np.argsort(col["at"][order], kind="stable")]
    waiting = col["at"][order]
    live, joined = np.zeros(0, np.int64), 0

    def leave(which: np.ndarray, reason, price: np.ndarray, spread, cost, j: int, sub: bool) -> None:
        buy = col["direction"][which] == 1
        moved = np.where(buy, price - cost - col["entry"][which], col["entry"][which] - price - cost)
        pnl = col["gained"][which] + moved / pip[which] * col["size"][which]
        spread = np.nan_to_num(spread)
        out["pnl"][which] = np.where(buy, pnl, pnl - spread / pip[which] * col["size"][which]) - col["commission"][which]
        out["exit_price"][which] = np.where(buy, price, price + spread)
        out["reason"][which], out["exit_no"][which], out["done"][which] = reason, no[j], True
        if sub:
            out["exit_s"][which] = bars["s"][j]

    place = -1
    for j in range(len(no)):
        if place < 0 or no[j] != mains[place]:
            place += 1
            upto = np.searchsorted(waiting, no[j], "right")
            if upto > joined:
                live = np.concatenate([live, order[joined:upto]])
                joined = upto
            if len(live):
                held = no[j] - col["entry_no"][live]
                late = (col["max_bars"][live] > 0) & (held >= col["max_bars"][live])
                calm = np.zeros(len(live), bool)
                if len(widths):
                    quiet = rolled[np.minimum(width_of[live], len(widths) - 1), place] / pip[live] < col["stale_atr_thresh"][live] * col["atr_pips"][live]
                    calm = ~late & (col["stale_enabled"][live] > 0) & (held >= col["stale_bars"][live]) & quiet
                if late.any() or calm.any():
                    gone = late | calm
                    which = live[gone]
                    leave(which, np.where(late[gone], MAX_BARS, STALE), np.full(len(which), bars["main_close"][j]), bars["main_spread"][j], slip[which], j, False)
                    live = live[~gone]
        if len(live) and bars["high"][j] == bars["high"][j]:
            live = _step(col, live, bars, j, slip, leave)
    if no[-1] == bars["last_no"][-1]:
        rest = np.flatnonzero(~out["done"])
        leave(rest, NONE, np.full(len(rest), bars["main_close"][-1]), bars["main_spread"][-1], slip[rest], len(no) - 1, False)
    else:
        col["at"][:] = np.maximum(col["at"], no[-1] + 1)
    return out


def _step(col: dict[str, np.ndarray], live: np.ndarray, bars: dict[str, np.ndarray], j: int, slip: np.ndarray, leave) -> np.ndarray:
    """One bar for the live trades; returns those that stay."""
    high, low, close, spread = (bars[c][j] for c in ("high", "low", "close", "spread"))
    get = lambda name: col[name][live]
    buy, pip, entry, tp = get("direction") == 1, get("pip"), get("entry"), get("tp_price")
    side = np.where(buy, 1.0, -1.0)
    stop, staged = get("stop"), get("staged")
    # what was staged on the bar before holds from here on
    stop = np.where(np.isnan(staged), stop, staged)
    flags = {name: (get(name) > 0) | (get(f"next_{name}") > 0) for name in ("locked", "trailing", "chandelier")}
    staged = np.full(len(live), np.nan)
    ahead = np.where(buy, high - entry, entry - low) / pip
    tighter = lambda new, old: side * (new - old) > 0
    safe = lambda new, price: side * (price - new) > 0

    new = entry + side * (get("be_offset") * pip)
    locks = (get("be_enabled") > 0) & ~flags["locked"] & (ahead >= get("be_trigger")) & tighter(new, stop) & safe(new, close)
    staged = np.where(locks, new, staged)

    mode, atr = get("trailing_mode"), get("atr_pips")
    begins = (mode != 0) & ~flags["trailing"] & (ahead >= get("trailing_activate"))
    gap = np.where(mode == 1, get("trailing_distance") * pip, get("trailing_atr_mult") * atr * pip)
    new = np.where(buy, high - gap, low + gap)
    moves = (mode != 0) & (flags["trailing"] | begins) & tighter(new, np.where(np.isnan(staged), stop, staged)) & safe(new, close)
    staged = np.where(moves, new, staged)

    on = (get("chandelier_enabled") != 0) & (get("chandelier_mult") > 0) & (get("chandelier_activate") >= 0)
    extreme = get("extreme")
    extreme = np.where(on, np.where(buy, np.maximum(extreme, high), np.minimum(extreme, low)), extreme)
    armed = on & (flags["chandelier"] | (ahead >= get("chandelier_activate")))
    new = extreme - side * (get("chandelier_mult") * atr * pip)
    moves = armed & tighter(new, np.where(np.isnan(staged), stop, staged)) & safe(new, np.where(buy, low, high))
    staged = np.where(moves, new, staged)

    touched = np.where(buy, high >= tp, low <= tp)
    trigger, share = get("partial_trigger"), get("partial_pct") / 100
    first = touched & (side * (tp - entry) / pip < trigger)
    parts = (get("partial_enabled") > 0) & (get("taken") == 0) & (ahead >= trigger) & ~first
    if parts.any():
        won = (trigger - get("slippage")) * share - np.where(buy, 0.0, np.nan_to_num(spread) / pip * share)
        col["gained"][live] += np.where(parts, won, 0.0)
        col["size"][live] -= np.where(parts, share, 0.0)
        col["taken"][live] = np.maximum(get("taken"), parts)

    for name, value in (("stop", stop), ("staged", staged), ("extreme", extreme), *flags.items(), ("next_locked", locks), ("next_trailing", begins), ("next_chandelier", armed)):
        col[name][live] = value
    stopped = np.where(buy, low <= stop, high >= stop)
    gone = stopped | touched
    if not gone.any():
        return live
    which = live[stopped]
    reason = np.where(flags["chandelier"], CHANDELIER, np.where(flags["trailing"], TRAILING, np.where(flags["locked"], BREAKEVEN, SL)))
    leave(which, reason[stopped], stop[stopped], spread, slip[which], j, True)
    reached = touched & ~stopped
    leave(live[reached], TP, tp[reached], spread, 0.0, j, True)
    return live[~gone]


def begin(trade: dict) -> list[float]:
    """The numbers of one new trade, from its values by name."""
    v = np.array([[np.nan if (x := trade.get(name, default)) is None else float(x) for name, default in {**TRADE, **RULES}.items()] + [np.nan] * len(STATE)])
    start(v)
    return v[0].tolist()


def proceed(numbers: list[float], ranges: list[float], bars: pd.DataFrame) -> tuple[list[float], list[float], dict[str, np.ndarray]]:
    """One open trade through further bars (the columns of a path, with seq); `ranges` are those of the main bars before them, newest last, and come back so."""
    v = np.array([numbers])
    first, back = int(bars["no"].iat[0]), max(int(v[0, PLACE["stale_bars"]]), 1)
    if len(ranges) and not math.isnan(v[0, PLACE["at"]]) and first < v[0, PLACE["at"]]:
        ranges = ranges[:-1]  # the main bar that the last batch ended in goes on
        v[0, PLACE["at"]] = first
    before = pd.DataFrame({"no": [first - len(ranges) + k for k in range(len(ranges))], "seq": -1, "main_range": ranges})
    path = pd.concat([before, bars]).reset_index(drop=True)
    columns = {c: path[c].to_numpy(float) if c in path else np.full(len(path), np.nan) for c in BAR} | {"s": path["seq"].to_numpy(float), "last_no": np.full(len(path), np.inf)}
    found = advance(v, columns)
    newest = path.groupby("no")["main_range"].last().tolist()
    return v[0].tolist(), newest[-back:], found


def main_bars(main: DataFrame, sub: DataFrame, width: int) -> DataFrame:
    """main (pair, s, high, low, close, spread) with its place `no`, the pair's last place, and the spread of its first sub bar."""
    opening = sub.groupBy("pair", (F.floor(F.col("s") / width) * width).cast("long").alias("main_s")).agg(F.min_by("spread", "s").alias("first_spread"))
    rows = ordered.numbered(main.select("pair", "s", "high", "low", "close", "spread"), name="no")
    last = rows.groupBy("pair").agg(F.max("no").alias("last_no"))
    rows = rows.join(opening.withColumnRenamed("main_s", "s"), ["pair", "s"], "left")
    return rows.join(last, "pair")


def paths(mains: DataFrame, sub: DataFrame, width: int) -> DataFrame:
    """Sub bars with their main bar's place, close, spread and range, in BAR columns; main bars without sub bars have one row."""
    inner = sub.select("pair", (F.floor(F.col("s") / width) * width).cast("long").alias("main_s"), F.col("s").alias("sub_s"), F.col("high").alias("h"), F.col("low").alias("l"), F.col("close").alias("c"), F.col("spread").alias("p"))
    joined = mains.join(inner.withColumnRenamed("main_s", "s"), ["pair", "s"], "left")
    return joined.select("pair", "no", F.coalesce("sub_s", "s").alias("s"), F.col("h").alias("high"), F.col("l").alias("low"), F.col("c").alias("close"), F.col("p").alias("spread"), F.col("close").alias("main_close"), F.col("spread").alias("main_spread"), (F.col("high") - F.col("low")).alias("main_range"), "last_no")


def _number(name: str, default: float | None, columns: list[str]) -> Column:
    unknown = F.lit(float("nan") if default is None else default)
    return F.coalesce(F.col(name).cast("double"), unknown) if name in columns else unknown


def _arrays(table: pa.Table, names: tuple[str, ...]) -> dict[str, np.ndarray]:
    return {c: table.column(c).cast(pa.float64()).to_numpy() for c in names}


def _run(left: pa.Table, right: pa.Table) -> pa.Table:
    v = np.array(left.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False)).reshape(left.num_rows, len(FIELDS))
    v = np.ascontiguousarray(v)
    bars = _arrays(right.sort_by([("no", "ascending"), ("s", "ascending")]), BAR)
    found = advance(v, bars)
    if not right.num_rows:
        found["done"][:] = True
    nothing = np.isnan(found["pnl"])
    values = pa.ListArray.from_arrays(pa.array(np.arange(0, v.size + 1, len(FIELDS)), pa.int32()), pa.array(v.ravel()))
    known = lambda name, kind: pa.array(found[name], kind, mask=nothing)
    when = np.nan_to_num(found["exit_s"], nan=0).astype(np.int64)
    return pa.table({
        "row": left.column("row"), "pair": left.column("pair"), "v": values, "done": found["done"], "pnl": known("pnl", pa.float64()),
        "exit_reason": pa.array(np.array(REASONS, object)[found["reason"]], pa.string(), mask=nothing), "exit_no": known("exit_no", pa.int64()),
        "exit_s": pa.array(when, pa.int64(), mask=np.isnan(found["exit_s"])), "exit_price": known("exit_price", pa.float64()),
    })


def _begun(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        v = np.array(batch.column(2).flatten().to_numpy(zero_copy_only=False)).reshape(batch.num_rows, len(FIELDS))
        start(v)
        values = pa.ListArray.from_arrays(pa.array(np.arange(0, v.size + 1, len(FIELDS)), pa.int32()), pa.array(v.ravel()))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), values, batch.column(3)], ["row", "pair", "v", "_last"])


RESULT = "row long, pair string, v array<double>, done boolean, pnl double, exit_reason string, exit_no long, exit_s long, exit_price double"


def rounds(open_: DataFrame, path: DataFrame, last: DataFrame, stale_bars: int) -> DataFrame:
    """RESULT of trades (row, pair, v, _last) that run through a path which is written already: cell by cell until none is open."""
    first = max(FIRST, 1 << max(0, stale_bars - 1).bit_length())
    width, done = first, None
    at = F.element_at("v", PLACE["at"] + 1)
    while True:
        open_ = cut(open_.withColumn("cell", F.floor(F.least(at, F.col("_last")) / width)))
        needed = open_.groupBy("pair", "cell").agg(F.ceil(F.count("*") / GROUP).alias("parts"))
        # dealt by the trade's number, so that equal trades are dealt like any others
        dealt = open_.join(needed, ["pair", "cell"], "left").withColumn("part", F.pmod(F.xxhash64("row"), F.coalesce("parts", F.lit(1))))
        # main bars just before a cell go with it, for rules that look back
        cell, into = F.floor(F.col("no") / width), F.col("no") % width
        own = path.withColumn("cell", cell)
        before = path.where(into >= width - min(stale_bars, width)).groupBy("pair", "no").agg(F.first("main_range").alias("main_range"), F.first("last_no").alias("last_no"), F.min("s").alias("s"))
        before = before.select("pair", "no", "s", *[F.lit(None).cast("double").alias(c) for c in ("high", "low", "close", "spread", "main_close", "main_spread")], "main_range", "last_no", (cell + 1).alias("cell"))
        here = own.unionByName(before).join(needed, ["pair", "cell"]).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
        key = ("pair", "cell", "part")
        out = cut(apart(dealt.drop("_last", "parts"), *key).groupBy(*key).cogroup(apart(here.drop("parts"), *key).groupBy(*key)).applyInArrow(_run, RESULT))
        closed = out.where("done")
        done = closed if done is None else done.unionByName(closed)
        left = out.where(~F.col("done"))
        if left.isEmpty():
            return done
        width = min(width * GROWTH, max(WIDEST, first))
        open_ = left.select("row", "pair", "v").join(last, "pair", "left")


def simulate(trades: DataFrame, path: DataFrame, stale_bars: int = 64, keep: list[str] | None = None) -> DataFrame:
    """The columns to keep of trades (all by default) with entry_cost_price, exit_no, exit_s, exit_price, exit_reason and pnl (pips).

    trades: pair, entry_no (the place of the main bar that they enter on), the other TRADE columns and any of RULES.
    path: what `paths` gives.  `stale_bars` is the most that any trade's rule looks back.  exit_s is null where the exit isn't within
    a main bar.  A trade without prices, or of a pair without bars, has null results.

    Trades that are equal in all numbers have equal results: where at least half of them repeat others, as those of trials that
    differ in filters only, each kind is simulated once and its result joined back.
    """
    kept = keep or trades.columns
    path = cut(path)
    last = path.groupBy("pair").agg(F.max("last_no").alias("_last"))
    numbers = [_number(c, d, trades.columns) for c, d in {**TRADE, **RULES}.items()]
    rows = trades.select("pair", F.struct(*kept).alias("k"), F.array(*numbers).alias("v"))
    rows = cut(rows.withColumns({"row": F.monotonically_increasing_id(), "_a": F.xxhash64("pair", "v"), "_b": F.xxhash64(F.lit("again"), "v", "pair")}))
    n, kinds = rows.agg(F.count("*"), F.approx_count_distinct("_a", 0.02)).first()
    number = F.concat("v", F.array_repeat(F.lit(float("nan")), len(STATE))).alias("v")
    once = n > 2 * kinds
    each = rows.groupBy("_a", "_b").agg(F.min("row").alias("row"), F.any_value("pair").alias("pair"), F.any_value("v").alias("v")) if once else rows
    each = cut(each) if once else each
    open_ = each.select("row", "pair", number).join(last, "pair", "left").select("row", "pair", "v", "_last").mapInArrow(_begun, "row long, pair string, v array<double>, _last long")
    done = rounds(open_, path, last, stale_bars).select("row", F.element_at("v", PLACE["entry"] + 1).alias("entry_cost_price"), "exit_no", "exit_s", "exit_price", "exit_reason", "pnl")
    if once:
        done = each.select("_a", "_b", "row").join(done, "row").drop("row")
    by = ["_a", "_b"] if once else ["row"]
    return rows.select("k", *by).join(done, by).select("k.*", *[c for c in done.columns if c not in by])
