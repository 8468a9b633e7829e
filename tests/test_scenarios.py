"""Hand-calculated trades: position rules over short paths, all of them through the engine at once."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronosweep.operators import positions
from tests.plain_loop import walk

ENTRY, PIP = 1.1, 1e-4
LONG, SHORT = 1, -1
HOUR, MINUTE = 3600, 60


def price(pips: float) -> float:
    return ENTRY + pips * PIP


def trade(side: int, sl: float, tp: float, **rules) -> dict:
    return {"pip": PIP, "direction": side, "entry_price": ENTRY, "sl_price": price(-side * sl), "tp_price": price(side * tp), "atr_pips": 10.0, "entry_no": 2} | rules


def minutes(special: dict[int, tuple[float, float, float]], mains: int = 5, spread: float = 0.0) -> list[tuple]:
    """(s, high, low, close, spread) of sub bars at the entry price, 60 to a main bar, but for those given as high, low and close in pips."""
    return [(k * MINUTE, price(h), price(lo), price(c), spread) for k in range(mains * 60) for h, lo, c in [special.get(k, (0, 0, 0))]]


def hours(cells: dict[int, tuple[float, float, float]], last: int = 20) -> list[tuple]:
    """One sub bar to a main bar; the last given bar repeats."""
    out, cell = [], (0, 0, 0)
    for k in range(last):
        cell = cells.get(k, cell)
        out.append((k * HOUR, price(cell[0]), price(cell[1]), price(cell[2]), 0.0))
    return out


BREAKEVEN = [(LONG, 2, (6, 0, 3), (2, 1, 2), 2), (LONG, 10, (6, 0, 3), (2, 1, 1), 0), (SHORT, 10, (0, -6, -3), (-1, -2, -1), 0), (LONG, 2, (6, 0, 4), (1, -4, -3), 2), (LONG, 10, (6, 0, 2), (1, -6, -5), 0), (LONG, -2, (6, 0, 3), (1, -4, -3), -2)]
TRAILING = [(LONG, 1, 10, (6, 0, 3), (1, -6, -5), -4), (LONG, 1, 1, (6, 0, 2), (3, 1, 1), 0), (SHORT, 1, 1, (0, -6, -2), (-1, -3, -1), 0), (LONG, 2, 0.3, (6, 0, 2), (3, 1, 1), 0), (SHORT, 1, 10, (0, -6, -3), (6, -1, 5), -4)]
CHANDELIER = [(LONG, 10, 3, (40, 30, 35), (8, -5, 0), 10), (SHORT, 10, 3, (-30, -40, -35), (5, -8, 0), 10), (LONG, 10, 3, (40, 0, 20), (30, 0, 15), 0), (LONG, 50, 3, (40, -5, 20), (30, -5, 15), 0), (LONG, -1, -1, (40, 30, 35), (8, -5, 0), 0)]
PARTIAL = [(LONG, 30, 60, 0, 0, 0, (20, 0, 10), (65, 30, 60), 60), (LONG, 30, 60, 1, 50, 10, (15, 0, 12), (65, 10, 60), 35), (SHORT, 30, 60, 1, 50, 10, (0, -15, -12), (-10, -65, -60), 35), (LONG, 12, 12, 1, 50, 44, (50, 0, 40), (1, 0, 0), 12), (SHORT, 12, 12, 1, 50, 44, (0, -50, -40), (0, -1, 0), 12), (LONG, 20, 60, 1, 70, 15, (20, 0, 18), (18, -25, -22), 4.5)]
FLAT = {2: (1, 1, 1), 3: (2, 2, 2), 4: (3, 3, 3)}
WIDE = {2: (6, -4, 1), 3: (7, -3, 2), 4: (8, -2, 3)}
STALE = [(LONG, 1, 2, 0.5, 0, FLAT, 2), (SHORT, 1, 2, 0.5, 0, FLAT, -2), (LONG, 0, 2, 0.5, 0, FLAT, 3), (LONG, 1, 3, 100, 0, WIDE, 3), (LONG, 1, 3, 0.5, 0, FLAT, 3), (LONG, 1, 2, 0.5, 2, FLAT, -2)]

#: name -> trade, sub bars, pnl, and the reason where it is told.  Bars 120 and on are the third main bar, the first after the entry's.
CASES: dict[str, tuple] = {}
for k, (side, offset, a, b, want) in enumerate(BREAKEVEN):
    CASES[f"breakeven{k}"] = trade(side, 30, 60, be_enabled=1, be_trigger=5, be_offset=offset), minutes({130: a, 131: b}), want, None
for k, (side, mode, distance, a, b, want) in enumerate(TRAILING):
    CASES[f"trailing{k}"] = trade(side, 30, 60, trailing_mode=mode, trailing_activate=5, trailing_distance=distance, trailing_atr_mult=distance, atr_pips=3.0), minutes({130: a, 131: b}), want, None
for k, (side, activate, mult, a, b, want) in enumerate(CHANDELIER):
    CASES[f"chandelier{k}"] = trade(side, 30, 60, chandelier_enabled=1, chandelier_activate=activate, chandelier_mult=mult), minutes({130: a, 131: b}), want, None
for k, (side, sl, tp, on, pct, trigger, a, b, want) in enumerate(PARTIAL):
    CASES[f"partial{k}"] = trade(side, sl, tp, partial_enabled=on, partial_pct=pct, partial_trigger=trigger), minutes({130: a, 131: b}), want, None
for k, (side, on, bars, thresh, slip, cells, want) in enumerate(STALE):
    CASES[f"stale{k}"] = trade(side, 100, 100, stale_enabled=on, stale_bars=bars, stale_atr_thresh=thresh, slippage=slip), hours(cells), want, None
CASES["max_bars"] = trade(LONG, 30, 60, max_bars=2), hours({2: (1, 0, 1), 3: (2, -40, 2)}), 2, "MAX_BARS"
CASES["cost_long"] = trade(LONG, 30, 60, entry_spread=2 * PIP, commission=0.3), minutes({}, spread=2 * PIP), -2.3, "NONE"
CASES["cost_short"] = trade(SHORT, 30, 60, commission=0.3), minutes({}, spread=2 * PIP), -2.3, "NONE"
CASES["stop_first"] = trade(LONG, 5, 5), minutes({130: (6, -6, 0)}), -5, "SL"
CASES["target_free_of_slippage"] = trade(LONG, 30, 5, slippage=0.5), minutes({130: (6, 0, 5)}), 4.5, "TP"
CASES["entry_on_last_bar"] = trade(LONG, 30, 60, entry_no=5), minutes({}), 0, "NONE"
CASES["before_entry_nothing_counts"] = trade(LONG, 5, 5), minutes({30: (9, -9, 0), 119: (9, -9, 0)}), 0, "NONE"
CASES["no_stop_price"] = trade(LONG, 5, 60, sl_price=None), minutes({130: (0, -50, 0)}), 0, "NONE"
CASES["no_entry_price"] = trade(LONG, 5, 60, entry_price=None), minutes({}), None, None


def tables(spark, cases):
    """trades and the path of each, a pair to a case."""
    names = [*positions.TRADE, *positions.RULES]
    kind = "pair string, " + ", ".join(f"{n} {'long' if n == 'entry_no' else 'double'}" for n in names)
    whole = {**positions.TRADE, **positions.RULES}
    rows = [(name, *((None if (x := c[0].get(n, whole[n])) is None else int(x) if n == "entry_no" else float(x)) for n in names)) for name, c in cases.items()]
    subs = [(name, s, h, lo, c, sp) for name, case in cases.items() for s, h, lo, c, sp in case[1]]
    sub = spark.createDataFrame(subs, "pair string, s long, high double, low double, close double, spread double")
    main = sub.groupBy("pair", (F.floor(F.col("s") / HOUR) * HOUR).alias("s")).agg(F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "s").alias("close"), F.max_by("spread", "s").alias("spread"))
    return spark.createDataFrame(rows, kind), positions.paths(positions.main_bars(main, sub, HOUR), sub, HOUR)


@pytest.fixture(scope="module")
def results(spark):
    return {r["pair"]: r for r in positions.simulate(*tables(spark, CASES), keep=["pair"]).collect()}


@pytest.mark.parametrize("name", CASES)
def test_scenario(results, name):
    _, _, want, reason = CASES[name]
    got = results[name]
    assert got["pnl"] == (None if want is None else pytest.approx(want, abs=1e-9))
    assert reason is None or got["exit_reason"] == reason


def random_cases(n: int) -> dict[str, tuple]:
    rng = np.random.default_rng(5)
    cases = {}
    for k in range(n):
        walked = np.cumsum(rng.normal(0, 3, (40, 4)), axis=0)
        bars = [(i * HOUR // 2, *(float(price(x)) for x in (q.max() + 2, q.min() - 2, q[3])), float(rng.choice([0.0, PIP]))) for i, q in enumerate(walked)]
        pick = lambda lo, hi: float(rng.uniform(lo, hi))  # noqa: B023, E731
        coin = lambda: int(rng.integers(0, 2))
        rules = {
            "be_enabled": coin(), "be_trigger": pick(1, 8), "be_offset": pick(-2, 4), "trailing_mode": int(rng.integers(0, 3)), "trailing_activate": pick(1, 8), "trailing_distance": pick(1, 6), "trailing_atr_mult": pick(0.1, 1),
            "partial_enabled": coin(), "partial_pct": pick(20, 80), "partial_trigger": pick(1, 10), "max_bars": int(rng.integers(0, 12)), "stale_enabled": coin(), "stale_bars": int(rng.integers(1, 4)), "stale_atr_thresh": pick(0.5, 3.0),
            "chandelier_enabled": coin(), "chandelier_activate": pick(-1, 8), "chandelier_mult": pick(0.1, 1), "slippage": pick(0, 1), "commission": 0.3, "entry_spread": PIP / 2,
        }
        cases[f"r{k}"] = trade(int(rng.choice([LONG, SHORT])), pick(5, 25), pick(5, 40), entry_no=int(rng.integers(1, 12)), **rules), bars
    return cases


def test_random_trades_equal_a_plain_loop(spark):
    cases = random_cases(300)
    got = {r["pair"]: r for r in positions.simulate(*tables(spark, cases), keep=["pair"]).collect()}
    for name, (p, bars) in cases.items():
        subs: dict[int, list] = {}
        for s, h, lo, c, sp in bars:
            subs.setdefault(s // HOUR + 1, []).append({"s": s, "high": h, "low": lo, "close": c, "spread": sp})
        mains = [{"no": no, "high": max(b["high"] for b in bs), "low": min(b["low"] for b in bs), "close": bs[-1]["close"], "spread": bs[-1]["spread"]} for no, bs in subs.items()]
        want = walk(p, mains, subs)
        assert (got[name]["exit_reason"], got[name]["exit_no"], got[name]["exit_s"]) == (want["reason"], want["exit_no"], want["exit_s"]), name
        assert got[name]["pnl"] == pytest.approx(want["pnl"]) and got[name]["exit_price"] == pytest.approx(want["exit_price"]), name
    assert len({r["exit_reason"] for r in got.values()}) == 8


def test_cells_make_no_difference(spark, monkeypatch):
    cases = random_cases(60)
    whole = {r["pair"]: r["pnl"] for r in positions.simulate(*tables(spark, cases), keep=["pair"]).collect()}
    monkeypatch.setattr(positions, "FIRST", 4)
    monkeypatch.setattr(positions, "WIDEST", 4)
    cells = {r["pair"]: r["pnl"] for r in positions.simulate(*tables(spark, cases), stale_bars=4, keep=["pair"]).collect()}
    assert all(math.isclose(whole[k], cells[k], abs_tol=1e-9) for k in whole)
