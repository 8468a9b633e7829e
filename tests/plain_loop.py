"""One managed trade walked bar by bar, in plain Python: what the engine is held against."""

from __future__ import annotations

import math


def known(x) -> float:
    return 0.0 if x is None or math.isnan(x) else x


def walk(p: dict, mains: list[dict], subs: dict[int, list[dict]]) -> dict:
    """p: a trade with `entry_no`; mains: main bars by place from 1 (no, high, low, close, spread); subs: sub bars by main place."""
    pip, side = p["pip"], 1 if p["direction"] == 1 else -1
    slip, rule = p.get("slippage", 0.0), lambda name: p.get(name) or 0.0
    entry = p["entry_price"] + side * slip * pip + (known(p.get("entry_spread")) if side == 1 else 0.0)
    stop, target = p["sl_price"], p["tp_price"]
    size, gained, taken = 1.0, 0.0, False
    on, coming, staged, best = set(), set(), None, entry
    pips = lambda price: side * (price - entry) / pip

    def leave(reason, price, spread, cost, no, s=None):
        pnl = gained + (pips(price) - cost) * size
        spread = known(spread) if side == -1 else 0.0
        return {"reason": reason, "pnl": pnl - spread / pip * size - p.get("commission", 0.0), "exit_price": price + spread, "exit_no": no, "exit_s": s}

    held = 0
    for m in mains:
        if m["no"] <= p["entry_no"]:
            continue
        held += 1
        if 0 < rule("max_bars") <= held:
            return leave("MAX_BARS", m["close"], m["spread"], slip, m["no"])
        if rule("stale_enabled") and held >= rule("stale_bars"):
            recent = [x for x in mains if m["no"] - rule("stale_bars") < x["no"] <= m["no"]]
            if max((x["high"] - x["low"]) / pip for x in recent) < rule("stale_atr_thresh") * p["atr_pips"]:
                return leave("STALE", m["close"], m["spread"], slip, m["no"])
        for b in subs.get(m["no"], []):
            if staged is not None:
                stop, staged = staged, None
            on |= coming
            ahead = pips(b["high"] if side == 1 else b["low"])
            tail = b["low"] if side == 1 else b["high"]

            def stage(new, wall):
                nonlocal staged
                if side * (new - (stop if staged is None else staged)) > 0 and side * (wall - new) > 0:
                    staged = new
                    return True
                return False

            if rule("be_enabled") and "BREAKEVEN" not in on and ahead >= rule("be_trigger") and stage(entry + side * rule("be_offset") * pip, b["close"]):
                coming.add("BREAKEVEN")
            if rule("trailing_mode"):
                if ahead >= rule("trailing_activate"):
                    coming.add("TRAILING")
                if "TRAILING" in on | coming:
                    gap = rule("trailing_distance") if rule("trailing_mode") == 1 else rule("trailing_atr_mult") * p["atr_pips"]
                    stage((b["high"] if side == 1 else b["low"]) - side * gap * pip, b["close"])
            if rule("chandelier_enabled") and rule("chandelier_mult") > 0 and p.get("chandelier_activate", -1) >= 0:
                best = max(best, b["high"]) if side == 1 else min(best, b["low"])
                if ahead >= rule("chandelier_activate"):
                    coming.add("CHANDELIER")
                if "CHANDELIER" in on | coming:
                    stage(best - side * rule("chandelier_mult") * p["atr_pips"] * pip, tail)
            reached = side * ((b["high"] if side == 1 else b["low"]) - target) >= 0
            if rule("partial_enabled") and not taken and ahead >= rule("partial_trigger") and not (reached and pips(target) < rule("partial_trigger")):
                share = rule("partial_pct") / 100
                gained += (rule("partial_trigger") - slip) * share - (known(b["spread"]) / pip * share if side == -1 else 0.0)
                size, taken = size - share, True
            if side * (tail - stop) <= 0:
                return leave(next((r for r in ("CHANDELIER", "TRAILING", "BREAKEVEN") if r in on), "SL"), stop, b["spread"], slip, m["no"], b["s"])
            if reached:
                return leave("TP", target, b["spread"], 0.0, m["no"], b["s"])
    return leave("NONE", mains[-1]["close"], mains[-1]["spread"], slip, mains[-1]["no"])
