"""Strategies by level, changes to them, reports and what a run will cost."""

from __future__ import annotations

import pytest

from chronosweep.operators import encoders, signals, space, strategy
from chronosweep.plans.sweep_catalogue import RANGES
from tests.conftest import SMALL


def test_levels_grow_and_get_finer():
    held = [strategy.at_level(k, RANGES) for k in range(1, 11)]
    for one, next_ in zip(held[:-1], held[1:], strict=True):
        assert set(one["signals"]) <= set(next_["signals"]) and {"stop_loss", "take_profit", "days_bitmask"} <= set(one["space"]) & set(next_["space"])
        space.validate(one["space"])
    assert held[0]["space"]["take_profit"].values == ("fixed",) and held[1]["space"]["take_profit"].values == ("rr",) and held[2]["space"]["take_profit"].values == ("rr", "atr", "fixed")
    assert [k for k in range(10) if "trailing" in held[k]["space"]][0] == 3 and [k for k in range(10) if "stale" in held[k]["space"]][0] == 6 and "donchian" not in held[5]["signals"]
    steps = [h["space"]["sl_fixed_pips"][2].step for h in held]
    assert steps == sorted(steps, reverse=True) and steps[6] != steps[9] and [strategy.tidy(x) for x in (0.14, 0.16, 3.4, 3.6, 80, 0)] == [0.1, 0.2, 2, 5, 100, 1]
    assert held[7]["signals"]["donchian"]["lookback"].step == 5 and held[9]["signals"]["donchian"]["lookback"].step == 3
    with pytest.raises(ValueError):
        strategy.at_level(11, RANGES)


def test_changes_leave_the_old_strategy_alone():
    old = strategy.at_level(8, RANGES)
    new = strategy.change(old, {"be_offset": {"frozen": 1.0}, "ema_cross.fast": {"min": 8, "max": 9}, "max_bars": {"max": 96}}, {"trailing": False, "stop_loss.atr": False, "partial": True}, {"macd_cross": False}, 2.0)
    assert new["space"]["be_offset"][2].values == (1.0,) and new["space"]["trailing"].values == (False,) and new["space"]["partial"].values == (True,) and new["space"]["stop_loss"].values == ("fixed",)
    assert set(new["signals"]) == {"ema_cross", "donchian"} and (new["signals"]["ema_cross"]["fast"].lo, new["signals"]["ema_cross"]["fast"].hi) == (8, 9)
    assert new["space"]["tp_rr"][2].step == 2 * old["space"]["tp_rr"][2].step and old["space"]["trailing"].values == (True, False) and "macd_cross" in old["signals"]
    assert set(strategy.change(old, families=dict.fromkeys(old["signals"], False))["signals"]) == {"ema_cross"}
    assert strategy.change(strategy.at_level(1, RANGES), groups={"stop_loss.fixed": False})["space"]["stop_loss"].values == ("fixed",)
    with pytest.raises(KeyError):
        strategy.change(old, groups={"tp_rr": True})


def test_reports_and_preflight(spark):
    from chronosweep.plans.catalogue import bars

    held = strategy.change(strategy.at_level(7, RANGES), {"ema_cross.fast": {"frozen": 5}, "ema_cross.slow": {"frozen": 20}}, families={"macd_cross": False})
    rows = {(r["section"], r["name"]): r for r in strategy.inspect(held)}
    assert rows["space", "trailing"]["kind"] == "switch" and rows["space", "stop_loss"]["kind"] == "selector" and rows["space", "trailing_distance"]["hangs_on"] == "trailing_kind" and rows["signals.ema_cross", "fast"]["values"] == [5]
    text = strategy.report(held)
    assert "[signals.donchian]" in text and "\n      trailing_distance (float)" in text and text.count("when trailing is True") == 2
    library = signals.build_library(bars(spark, SMALL), strategy.grids(held))[0]
    trials = space.sample(spark, 300, held["space"], 3, library.count())
    told = strategy.preflight(held, library, trials, 1000, trials_per_s=100.0)
    assert told["families"]["ema_cross"] == {"combinations": 1, "variants": 1, "signals": library.where("family = 'ema_cross'").first()["n_signals"]}
    assert told["switches"] == 7 and told["selectors"] == 3 and told["leaves"] == len(held["space"]) and told["decisions"]["least"] >= 10
    assert told["sweep_s"] == (1000 / 130, 1000 / 70) and told["build_s"] == library.count() * 0.25
    slots = encoders.encode(trials, strategy.mapping(held))
    assert slots.join(trials.select("trial_id", "bars_limit"), "trial_id").where("bars_limit = (max_bars = 0)").isEmpty()
