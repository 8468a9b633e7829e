"""Queries over a sweep of sampled trials, each with SQL that gives the same rows: a recursion over bars for the managed trades."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from chronosweep.functions.exprs import hour_of, session_name
from chronosweep.functions.lineage import cut
from chronosweep.functions.exprs import uniform
from chronosweep.operators import cost, encoders, live, metrics, positions, pricing, ranking, resample, signals, space, strategy, sweep
from chronosweep.plans.catalogue import _NAMED, _VARIANTS, trial_ids, H1, LIBRARY, LIBRARY_SQL, MEASURED, METRIC_SQL, ORDERS, TICKS, _orders, _priced, bars, bars_cte, metrics_sql, query, rounded
from chronosweep.sources import upsert
from chronosweep.sources.bridge import table, ticks

TRIALS, SEED, SLIPPAGE, COMMISSION, MAX_SPREAD = 500, 7, 0.5, 0.3, 6.0
_I, _R, _C = space.IntRange, space.FloatRange, space.Choice
#: What the library's signals carry beside their bar: a swing's bars, the filter value, and the ten marks.
SWING, VALUE, MARKS = 10, "session", ("session", "weekday", "quarter", "hour", "body", "range", "cost", "activity", "week", "place")
_OFF = (-1,)
#: Every slot of a trial is sampled; filters are mostly off, as a trial with many passes next to nothing.
SPACE = {
    "buy_filter_max": _C(_OFF * 6 + (0, 1, 2, 3)), "sell_filter_min": _C(_OFF * 6 + (0, 1, 2, 3)), "signal_p0": _C(_OFF * 12 + (0, 1, 2)), "signal_p1": _C(_OFF * 20 + (0, 1, 2, 3, 4)), "signal_p2": _C(_OFF * 12 + (0, 1, 2, 3)), "signal_p3": _R(-400.0, 23.0),
    "signal_p4": _C(_OFF * 8 + (0, 1)), "signal_p5": _C(_OFF * 20 + (0, 1, 2, 3)), "signal_p6": _C(_OFF * 20 + (0, 1, 2)), "signal_p7": _C(_OFF * 20 + (1, 2, 3)), "signal_p8": _C(_OFF * 20 + (0, 1, 2, 3)), "signal_p9": _C(_OFF * 20 + (0, 1, 2, 3, 4)),
    "signal_variant": _I(-1, len(_VARIANTS) - 1), "sl_mode": _C((0, 1, 2)), "sl_fixed_pips": _R(20.0, 120.0), "sl_atr_mult": _R(0.5, 3.0), "tp_mode": _C((0, 1, 2)), "tp_rr": _R(0.5, 3.0), "tp_atr_mult": _R(0.5, 4.0), "tp_fixed_pips": _R(20.0, 200.0),
    "hours_start": _I(0, 23), "hours_end": _I(0, 23), "days_bitmask": _I(1, 127), "trailing_mode": _C((0, 1, 2)), "trailing_activate": _R(5.0, 60.0), "trailing_distance": _R(5.0, 50.0), "trailing_atr_mult": _R(0.2, 2.0),
    "be_enabled": _C((0, 1)), "be_trigger": _R(5.0, 40.0), "be_offset": _R(0.0, 10.0), "partial_enabled": _C((0, 1)), "partial_pct": _I(20, 80, 10), "partial_trigger": _R(10.0, 60.0), "max_bars": _I(0, 48, 6),
    "stale_enabled": _C((0, 1)), "stale_bars": _I(2, 8), "stale_atr_thresh": _R(0.2, 2.0), "chandelier_enabled": _C((0, 1)), "chandelier_activate": _R(5.0, 60.0), "chandelier_mult": _R(0.5, 3.0),
}


def _draw_sql(name: str, leaf) -> str:
    u = f"(CAST(CAST('0x' || substr(md5('{SEED}|' || id || '|{name}'), 1, 8) AS UBIGINT) AS DOUBLE) / 4294967296.0)"
    if isinstance(leaf, space.FloatRange):
        return f"{leaf.lo!r}e0 + {u} * {leaf.hi - leaf.lo!r}e0 AS {name}"
    values = space.expand(leaf)
    return f"CAST([{', '.join(map(str, values))}][CAST(floor({u} * {len(values)}) AS INTEGER) + 1] AS DOUBLE) AS {name}"


def _trials_sql(n: int) -> str:
    return f"tt AS (SELECT CAST(id AS BIGINT) AS trial_id, {', '.join(_draw_sql(k, v) for k, v in SPACE.items())} FROM range(0, {n}) r(id))"


_SETUP = ", ".join([
    bars_cte("u", "M15"), LIBRARY_SQL,
    "mn AS (SELECT pair, s, open, high, low, close, spread, volume, row_number() OVER (PARTITION BY pair ORDER BY s) AS no, count(*) OVER (PARTITION BY pair) AS last_no FROM b)",
    "os AS (SELECT pair, CAST(s // 3600 * 3600 AS BIGINT) AS s, arg_min(spread, s) AS first_spread FROM u GROUP BY 1, 2)",
    f"sx AS (SELECT pair, s, min(low) OVER w AS lo_n, max(high) OVER w AS hi_n FROM b WINDOW w AS (PARTITION BY pair ORDER BY s ROWS BETWEEN {SWING - 1} PRECEDING AND CURRENT ROW))",
    "sg0 AS (SELECT ls0.variant_id, ls0.direction, mn.pair, mn.s, mn.no, mn.last_no, mn.close AS entry, mn.spread, first_spread, e_14 / 1e-4 AS atr, (mn.s // 3600) % 24 AS hour, (mn.s // 86400 + 3) % 7 AS day, CASE WHEN direction = 1 THEN lo_n ELSE hi_n END AS swing_sl, mn.open, mn.high, mn.low, mn.volume FROM ls0 JOIN mn ON mn.pair = ls0.pair AND mn.s = ls0.s JOIN la ON la.pair = ls0.pair AND la.s = ls0.s JOIN os ON os.pair = ls0.pair AND os.s = ls0.s JOIN sx ON sx.pair = ls0.pair AND sx.s = ls0.s)",
    "sg AS (SELECT * EXCLUDE (open, high, low, volume), CASE WHEN hour BETWEEN 7 AND 12 THEN 1 WHEN hour BETWEEN 13 AND 15 THEN 3 WHEN hour BETWEEN 16 AND 21 THEN 2 ELSE 0 END AS p0, day AS p1, hour // 6 AS p2, hour AS p3, CASE WHEN entry >= open THEN 1 ELSE 0 END AS p4, floor((high - low) / 1e-4 / 10) AS p5, floor(spread / 1e-4) AS p6, floor(sqrt(volume)) AS p7, ((s + 259200) // 604800) % 4 AS p8, no % 5 AS p9 FROM sg0)",
    "st AS (SELECT tt.*, sg.*, CASE CAST(sl_mode AS INTEGER) WHEN 1 THEN atr * 1e-4 * sl_atr_mult WHEN 2 THEN greatest(abs(entry - swing_sl), 5 * 1e-4) ELSE sl_fixed_pips * 1e-4 END AS sl_d FROM tt JOIN sg ON (signal_variant = -1 OR signal_variant = variant_id) AND (CASE WHEN direction = 1 THEN buy_filter_max ELSE sell_filter_min END < 0 OR abs(CASE WHEN direction = 1 THEN buy_filter_max ELSE sell_filter_min END - p0) < 1e-9){marks} AND ((CAST(days_bitmask AS INTEGER) >> CAST(day AS INTEGER)) & 1) = 1 AND CASE WHEN hours_start <= hours_end THEN hour BETWEEN hours_start AND hours_end ELSE hour >= hours_start OR hour <= hours_end END AND spread / 1e-4 <= {spread})",
    "tp0 AS (SELECT *, greatest(sl_d, CASE CAST(tp_mode AS INTEGER) WHEN 1 THEN atr * 1e-4 * tp_atr_mult WHEN 2 THEN tp_fixed_pips * 1e-4 ELSE sl_d * tp_rr END) AS tp_d, row_number() OVER () AS id, {slip}e0 * 1e-4 AS slip FROM st)",
    "tr AS (SELECT *, entry - direction * sl_d AS sl, entry + direction * tp_d AS tp, round(sl_d / 1e-4, 6) AS sl_pips, CASE WHEN direction = 1 THEN entry + slip + coalesce(first_spread, 0) ELSE entry - slip END AS cost FROM tp0)",
    "ps AS (SELECT mn.pair, no, u.s, u.high, u.low, u.close, u.spread, mn.close AS mc, mn.spread AS msp, row_number() OVER (PARTITION BY mn.pair ORDER BY u.s) AS k, row_number() OVER (PARTITION BY mn.pair, no ORDER BY u.s) = 1 AS is_first FROM mn JOIN u ON u.pair = mn.pair AND CAST(u.s // 3600 * 3600 AS BIGINT) = mn.s)",
    "rr AS (SELECT pair, no, CAST(n AS DOUBLE) AS n, max(high - low) OVER (PARTITION BY pair, n ORDER BY no ROWS BETWEEN (n - 1) PRECEDING AND CURRENT ROW) AS roll FROM mn, range(2, 9) r(n))",
    "kk AS (SELECT pair, no, min(k) AS k FROM ps GROUP BY 1, 2)",
]).replace("{spread}", f"{MAX_SPREAD}e0").replace("{slip}", str(SLIPPAGE)).replace("{marks}", "".join(f" AND (round(signal_p{k}) < 0 OR p{k} < 0 OR round(signal_p{k}) = p{k})" for k in range(10)))

# One step of a trade: w is its state after the bar before, ps the bar, tr the trade.
_W0 = "SELECT tr.id, kk.k - 1 AS k, sl AS stop, CAST(NULL AS DOUBLE) AS staged, false AS be, false AS ts, false AS ch, cost AS ext, 1e0 AS size, 0e0 AS gained, false AS taken, CAST(NULL AS VARCHAR) AS reason, CAST(NULL AS DOUBLE) AS price, CAST(NULL AS DOUBLE) AS raw, CAST(NULL AS BIGINT) AS exit_no, CAST(NULL AS BIGINT) AS exit_s, CAST(NULL AS DOUBLE) AS sp FROM tr JOIN kk ON kk.pair = tr.pair AND kk.no = tr.no + 1"
_W1 = "SELECT w.*, ps.no, ps.s, high, low, close, ps.spread, mc, msp, tr.direction AS sd, tr.direction = 1 AS buy, cost, tp, slip, tr.atr, trailing_mode, trailing_activate, trailing_distance, trailing_atr_mult, be_enabled, be_trigger, be_offset, partial_enabled, partial_pct, partial_trigger, chandelier_enabled, chandelier_activate, chandelier_mult, CASE WHEN NOT is_first THEN NULL WHEN max_bars > 0 AND ps.no - tr.no >= max_bars THEN 'MAX_BARS' WHEN stale_enabled > 0 AND ps.no - tr.no >= stale_bars AND roll / 1e-4 < stale_atr_thresh * tr.atr THEN 'STALE' END AS early, coalesce(staged, stop) AS stop1, CASE WHEN tr.direction = 1 THEN high - cost ELSE cost - low END / 1e-4 AS ahead FROM w JOIN tr ON tr.id = w.id JOIN ps ON ps.pair = tr.pair AND ps.k = w.k + 1 LEFT JOIN rr ON rr.pair = ps.pair AND rr.no = ps.no AND rr.n = stale_bars WHERE w.reason IS NULL"
_W2 = f"SELECT *, be_enabled > 0 AND NOT be AND ahead >= be_trigger AND sd * (cost + sd * (be_offset * 1e-4) - stop1) > 0 AND sd * (close - (cost + sd * (be_offset * 1e-4))) > 0 AS locks, trailing_mode <> 0 AND (ts OR ahead >= trailing_activate) AS trails, CASE WHEN trailing_mode = 1 THEN trailing_distance * 1e-4 ELSE trailing_atr_mult * atr * 1e-4 END AS gap, CASE WHEN chandelier_enabled <> 0 THEN CASE WHEN buy THEN greatest(ext, high) ELSE least(ext, low) END ELSE ext END AS ext1, chandelier_enabled <> 0 AND (ch OR ahead >= chandelier_activate) AS armed FROM ({_W1})"
_W3 = f"SELECT *, CASE WHEN locks THEN cost + sd * (be_offset * 1e-4) END AS staged1, CASE WHEN buy THEN high - gap ELSE low + gap END AS tn, ext1 - sd * (chandelier_mult * atr * 1e-4) AS cn FROM ({_W2})"
_W4 = f"SELECT *, CASE WHEN trails AND sd * (tn - coalesce(staged1, stop1)) > 0 AND sd * (close - tn) > 0 THEN tn ELSE staged1 END AS staged2, CASE WHEN buy THEN high >= tp ELSE low <= tp END AS touched, CASE WHEN buy THEN low <= stop1 ELSE high >= stop1 END AS stopped FROM ({_W3})"
_W5 = f"SELECT *, CASE WHEN armed AND sd * (cn - coalesce(staged2, stop1)) > 0 AND sd * (CASE WHEN buy THEN low ELSE high END - cn) > 0 THEN cn ELSE staged2 END AS staged3, partial_enabled > 0 AND NOT taken AND ahead >= partial_trigger AND NOT (touched AND sd * (tp - cost) / 1e-4 < partial_trigger) AND early IS NULL AS parts FROM ({_W4})"
_W6 = (
    "SELECT id, CAST(k + 1 AS BIGINT) AS k, stop1 AS stop, staged3 AS staged, be OR locks AS be, ts OR trails AS ts, ch OR armed AS ch, ext1 AS ext, CASE WHEN parts THEN size - partial_pct / 100 ELSE size END AS size, "
    f"CASE WHEN parts THEN gained + (partial_trigger - {SLIPPAGE}e0) * (partial_pct / 100) - CASE WHEN buy THEN 0 ELSE spread / 1e-4 * (partial_pct / 100) END ELSE gained END AS gained, taken OR parts AS taken, "
    "CASE WHEN early IS NOT NULL THEN early WHEN stopped THEN CASE WHEN ch THEN 'CHANDELIER' WHEN ts THEN 'TRAILING' WHEN be THEN 'BREAKEVEN' ELSE 'SL' END WHEN touched THEN 'TP' END AS reason, "
    "CASE WHEN early IS NOT NULL THEN mc WHEN stopped THEN stop1 WHEN touched THEN tp END AS price, "
    "CASE WHEN early IS NOT NULL THEN CASE WHEN buy THEN mc - slip - cost ELSE cost - mc - slip END WHEN stopped THEN CASE WHEN buy THEN stop1 - slip - cost ELSE cost - stop1 - slip END WHEN touched THEN CASE WHEN buy THEN tp - cost ELSE cost - tp END END AS raw, "
    "no AS exit_no, CASE WHEN early IS NULL THEN s END AS exit_s, CASE WHEN early IS NOT NULL THEN msp ELSE spread END AS sp "
    f"FROM ({_W5})"
)
_LOG = ", ".join([
    _SETUP, f"w AS ({_W0} UNION ALL {_W6})",
    "lw AS (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY id ORDER BY k DESC) = 1)",
    "ex AS (SELECT tr.*, coalesce(size, 1) AS size, coalesce(gained, 0) AS gained, coalesce(reason, 'NONE') AS why, CASE WHEN reason IS NULL THEN e.close ELSE price END AS px, CASE WHEN reason IS NULL THEN CASE WHEN direction = 1 THEN e.close - slip - cost ELSE cost - e.close - slip END ELSE raw END AS raw, CASE WHEN reason IS NULL THEN e.no ELSE exit_no END AS exit_no, CASE WHEN reason IS NOT NULL THEN exit_s END AS exit_s, CASE WHEN direction = 1 THEN 0 WHEN reason IS NULL THEN coalesce(e.spread, 0) ELSE coalesce(sp, 0) END AS sp FROM tr LEFT JOIN lw ON lw.id = tr.id JOIN mn e ON e.pair = tr.pair AND e.no = tr.last_no)",
    f"lg AS (SELECT *, round(gained + raw / 1e-4 * size - sp / 1e-4 * size - {COMMISSION}e0, 6) AS pnl, px + sp AS exit_price, row_number() OVER (PARTITION BY trial_id, pair ORDER BY no, variant_id) AS i FROM ex)",
])
_SWEEP = f"{H1}, {_trials_sql(TRIALS)}, {_LOG}"
_T = "mt0 AS (SELECT pair || '|' || trial_id AS trial_id, i, pnl, sl_pips AS sl, CAST(last_no AS DOUBLE) AS nb FROM lg)"
_EVERY = "ev AS (SELECT tt.trial_id AS trial, p.pair FROM tt, (SELECT DISTINCT pair FROM mn) p)"
NAMES = [m for m in metrics.METRICS if m not in ("dsr", *metrics.UNTRACKED)]
# pips have six places, so their means often stand on the border of two decimal roundings; those of 24 bits have borders elsewhere
BINARY = ("total_pips", "expectancy_pips")
_MEASURES = ", ".join(f"CAST(CAST({METRIC_SQL[m]} AS FLOAT) AS DOUBLE) AS {m}" if m in BINARY else metrics_sql([m], 6) for m in NAMES)
_ALL = f"{_SWEEP}, {_T}, {MEASURED}, mm AS (SELECT trial_id AS key, {_MEASURES} FROM k), {_EVERY}, sw AS (SELECT ev.pair, ev.trial AS trial_id, {', '.join(f'coalesce({c}, 0) AS {c}' for c in NAMES)} FROM ev LEFT JOIN mm ON mm.key = ev.pair || '|' || ev.trial)"


def run_sweep(spark, sf_dir, trials: int = TRIALS):
    """(trials, log, pairs): sampled trials over the library's signals, every pair of the table."""
    main, sub = bars(spark, sf_dir), bars(spark, sf_dir, "M15")
    _, found = signals.build_library(main, LIBRARY, swing=SWING, value=VALUE, marks=MARKS)
    mains = cut(positions.main_bars(main, sub, 3600))
    sampled = space.sample(spark, trials, SPACE, SEED)
    log = sweep.evaluate(sampled, found, mains, positions.paths(mains, sub, 3600), None, SLIPPAGE, COMMISSION, MAX_SPREAD, stale_bars=8)
    return sampled, log, mains.groupBy("pair").agg(F.max("last_no").alias("n_bars"))


@query(f"{_SWEEP} SELECT trial_id, pair, CAST(no * {len(_VARIANTS)} + variant_id AS BIGINT) AS signal_id, CAST(variant_id AS BIGINT) AS variant_id, s AS signal_s, CAST(direction AS INTEGER) AS direction, sl_pips, round(sl, 8) AS sl_price, round(tp, 8) AS tp_price, round(cost, 8) AS entry_price, no AS entry_no, round(first_spread, 8) AS entry_spread, exit_no, exit_s, round(exit_price, 8) AS exit_price, why AS exit_reason, pnl, i FROM lg")
def sim_full(spark, sf_dir):
    """The log of all trades of a sweep: every rule of managed positions, with costs, to the end of data."""
    log = run_sweep(spark, sf_dir)[1]
    return rounded(log, "sl_price", "tp_price", "entry_price", "entry_spread", "exit_price").withColumn("i", F.col("i").cast("long"))


@query(f"{_ALL} SELECT * FROM sw")
def batch_eval(spark, sf_dir):
    """All metrics of every trial of a sweep on every pair; trials without trades have zeros."""
    sampled, log, pairs = run_sweep(spark, sf_dir)
    found = sweep.sweep_metrics(log, sampled, pairs).drop("max_dd", *metrics.UNTRACKED)
    found = found.withColumns({c: F.col(c).cast("float").cast("double") for c in BINARY})
    return rounded(found, *[c for c, kind in found.dtypes if kind == "double" and c not in BINARY], places=6)


_BENCH = f"{_ALL}, qp AS (SELECT *, CASE WHEN total_pips > 0 OR profit_factor > 1 THEN quality END AS quality_profitable FROM sw), un AS (" + " UNION ALL ".join(f"SELECT pair, '{m}' AS objective, trial_id, CAST({m} AS DOUBLE) AS value, CAST({'-' if m in ranking.LOWER else ''}{m} AS DOUBLE) AS o FROM qp WHERE {m} IS NOT NULL" for m in ranking.BENCHES) + "), tn AS (SELECT pair, objective, trial_id, value, row_number() OVER (PARTITION BY pair, objective ORDER BY o DESC, trial_id) AS rank FROM un QUALIFY rank <= 20)"


@query(f"{_BENCH} SELECT * FROM tn UNION ALL SELECT pair, 'dsr', trial_id, value, rank FROM tn WHERE objective = 'psr'")
def sweep_benches(spark, sf_dir):
    """The best twenty trials of each objective on each pair, of profitable quality too; dsr shares the list of psr."""
    return ranking.benches(batch_eval(spark, sf_dir), 20, ["pair"]).withColumn("rank", F.col("rank").cast("long"))


@query(f"{_BENCH}, st0 AS (SELECT pair, trial_id, count(*) AS benches, min(rank) AS best_rank FROM tn GROUP BY pair, trial_id), bq AS (SELECT pair, arg_min(trial_id, k) AS trial_id FROM (SELECT pair, trial_id, row_number() OVER (PARTITION BY pair ORDER BY quality DESC, return_pct DESC, trades DESC, trial_id) AS k FROM sw) GROUP BY pair), fb AS (SELECT pair, coalesce(max(trial_id) FILTER (WHERE objective = 'quality_profitable'), max(trial_id)) AS trial_id FROM tn WHERE rank = 1 AND objective IN ('quality', 'quality_profitable') GROUP BY pair), be AS (SELECT bq.pair, CASE WHEN st0.trial_id IS NULL THEN fb.trial_id ELSE bq.trial_id END AS trial_id FROM bq JOIN fb ON fb.pair = bq.pair LEFT JOIN st0 ON st0.pair = bq.pair AND st0.trial_id = bq.trial_id) SELECT coalesce(st0.pair, be.pair) AS pair, coalesce(st0.trial_id, be.trial_id) AS trial_id, coalesce(benches, 0) AS benches, best_rank, be.trial_id IS NOT NULL AS is_best FROM st0 FULL JOIN be ON be.pair = st0.pair AND be.trial_id = st0.trial_id")
def retained_trials(spark, sf_dir):
    """What a lean run keeps: the trials among the best twenty of any objective on a pair, and the best of all."""
    found = cut(batch_eval(spark, sf_dir))
    return ranking.kept(found, ranking.benches(found, 20, ["pair"]), ["pair"])


@query(f"{_SWEEP}, {_NAMED} SELECT family, why AS exit_reason, CASE WHEN hour < 8 THEN 'Asian' WHEN hour < 13 THEN 'London' WHEN hour < 17 THEN 'Lon-NY' WHEN hour < 21 THEN 'NY' ELSE 'Rollover' END AS session, count(*) AS trades, CAST(CAST(avg(pnl) AS FLOAT) AS DOUBLE) AS mean_pips, round(avg(exit_no - no), 6) AS mean_bars FROM lg JOIN vs ON vs.variant_id = lg.variant_id GROUP BY ALL")
def trades_by_family(spark, sf_dir):
    """A sweep's trades with their variant's family: how each family's trades end, by session."""
    main, sub = bars(spark, sf_dir), bars(spark, sf_dir, "M15")
    variants, found = signals.build_library(main, LIBRARY, swing=SWING, value=VALUE, marks=MARKS)
    mains = cut(positions.main_bars(main, sub, 3600))
    log = sweep.evaluate(space.sample(spark, TRIALS, SPACE, SEED), found, mains, positions.paths(mains, sub, 3600), None, SLIPPAGE, COMMISSION, MAX_SPREAD, stale_bars=8)
    named = sweep.with_families(log, variants).groupBy("family", "exit_reason", session_name(hour_of(F.col("signal_s"))).alias("session"))
    return rounded(named.agg(F.count("*").alias("trades"), F.avg("pnl").cast("float").cast("double").alias("mean_pips"), F.avg(F.col("exit_no") - F.col("entry_no")).alias("mean_bars")), "mean_bars", places=6)


# Spaces and slots

_FULL = encoders.standard_space(20.0)


def _leaf_sql(name: str, node) -> str:
    leaf = node[2] if isinstance(node, tuple) else node
    u = f"(CAST(CAST('0x' || substr(md5('11|' || id || '|{name}'), 1, 8) AS UBIGINT) AS DOUBLE) / 4294967296.0)"
    if isinstance(leaf, space.FloatRange) and leaf.step is None:
        drawn = f"exp({math.log(leaf.lo)!r} + {u} * ({math.log(leaf.hi)!r} - {math.log(leaf.lo)!r}))" if leaf.scale == "log" else f"{leaf.lo!r}e0 + {u} * {leaf.hi - leaf.lo!r}e0"
    else:
        told = ", ".join(repr(v) if isinstance(v, str) else f"{v!r}e0" if isinstance(v, float) else str(v) for v in space.expand(leaf))
        drawn = f"[{told}][CAST(floor({u} * {len(space.expand(leaf))}) AS INTEGER) + 1]"
    if not isinstance(node, tuple):
        return f'{drawn} AS "{name}"'
    wanted = repr(node[1]) if isinstance(node[1], str) else str(node[1]).lower()
    return f'CASE WHEN "{node[0]}" = {wanted} THEN {drawn} END AS "{name}"'


# leaves may hang on leaves before them, which DuckDB lets a select list name
_FULL_SQL = f"f AS (SELECT CAST(id AS BIGINT) AS trial_id, CAST(floor((CAST(CAST('0x' || substr(md5('11|' || id || '|signal_variant'), 1, 8) AS UBIGINT) AS DOUBLE) / 4294967296.0) * 50) AS BIGINT) AS signal_variant, {', '.join(_leaf_sql(k, v) for k, v in _FULL.items())} FROM (SELECT o_orderkey AS id FROM orders) r)"
_MODES = {"sl_mode": "CASE stop_loss WHEN 'fixed' THEN 0 ELSE 1 END", "tp_mode": "CASE take_profit WHEN 'rr' THEN 0 WHEN 'atr' THEN 1 ELSE 2 END", "trailing_mode": "CASE WHEN \"trailing\" THEN CASE trailing_kind WHEN 'fixed' THEN 1 ELSE 2 END ELSE 0 END", "be_enabled": "breakeven", "partial_enabled": "partial", "stale_enabled": "stale", "chandelier_enabled": "chandelier"}
_SLOT_SQL = ", ".join(f"round(CAST({_MODES.get(slot, f'coalesce({slot}, 0)' if slot in _FULL or slot == 'signal_variant' else default)} AS DOUBLE), 8) AS {slot}" for slot, default in sweep.SLOTS.items())


@query(f"WITH {_FULL_SQL} SELECT trial_id, {_SLOT_SQL} FROM f")
def encode_standard(spark, sf_dir):
    """Every slot of trials sampled from the full space: selectors, switches, nested groups, logarithmic ranges."""
    encoded = encoders.encode(space.sample(spark, trial_ids(spark, sf_dir), _FULL, 11, 50), encoders.standard_mapping(_FULL))
    return rounded(encoded, *sweep.SLOTS)


@query(f"WITH {_FULL_SQL}, n AS (SELECT 1 + {' + '.join(f'CAST("{k}" IS NOT NULL AS INTEGER)' for k in _FULL)} AS n FROM f) SELECT CAST(min(n) AS BIGINT) AS least, round(avg(n), 8) AS mean, CAST(max(n) AS BIGINT) AS most FROM n")
def effective_dimension(spark, sf_dir):
    return rounded(encoders.decisions(space.sample(spark, trial_ids(spark, sf_dir), _FULL, 11, 50), _FULL), "mean")


#: A market's usual ranges, for strategies by level.
RANGES = {"fixed_sl": (10.0, 80.0), "fixed_tp": (20.0, 160.0), "rr": (0.5, 4.0), "atr_sl": (0.5, 3.0), "atr_tp": (0.5, 6.0), "trail_activate": (5.0, 60.0), "trail_atr": (0.5, 3.0), "ema_fast": (5, 20), "ema_slow": (20, 60)}
LEVELS = {level: strategy.at_level(level, RANGES) for level in (1, 2, 4, 7, 10)}


def _level_sql(level: int, held: dict) -> str:
    """(level, trial_id and all slots) of one level, by the names of its leaves."""
    space_ = held["space"]
    modes = {slot: told for slot, told in _MODES.items() if (told if told in space_ else {"sl_mode": "stop_loss", "tp_mode": "take_profit", "trailing_mode": "trailing"}.get(slot)) in space_}
    modes |= {"max_bars": "CASE WHEN bars_limit THEN max_bars ELSE 0 END", "hours_start": "CASE WHEN session THEN hours_start ELSE 0 END", "hours_end": "CASE WHEN session THEN hours_end ELSE 23 END"} if "session" in space_ else {"hours_end": "23"} | ({"max_bars": "CASE WHEN bars_limit THEN max_bars ELSE 0 END"} if "bars_limit" in space_ else {})
    slots = ", ".join(f"round(CAST({modes.get(slot, f'coalesce({slot}, 0)' if slot in space_ else default if slot != 'signal_variant' else 'signal_variant')} AS DOUBLE), 8) AS {slot}" for slot, default in sweep.SLOTS.items())
    drawn = ", ".join(_leaf_sql(k, v) for k, v in space_.items())
    return f"SELECT {level} AS level, trial_id, {slots} FROM (SELECT CAST(id AS BIGINT) AS trial_id, CAST(floor((CAST(CAST('0x' || substr(md5('11|' || id || '|signal_variant'), 1, 8) AS UBIGINT) AS DOUBLE) / 4294967296.0) * 50) AS BIGINT) AS signal_variant, {drawn} FROM (SELECT o_orderkey AS id FROM orders) r)"


@query(" UNION ALL ".join(_level_sql(*x) for x in LEVELS.items()))
def encode_levels(spark, sf_dir):
    """The slots of a table's trials at several levels of complexity: selectors of one arm or all, switches, steps by level."""
    names = list(dict.fromkeys(["signal_variant", *(name for held in LEVELS.values() for name in held["space"])]))
    # levels share their trials and uniform numbers, so the table is read and hashed once
    rows = trial_ids(spark, sf_dir).select("trial_id", F.struct(*[uniform(11, F.col("trial_id"), name).alias(name) for name in names]).alias("_u"))
    told = []
    for level, held in LEVELS.items():
        trials = space.drawn(rows, held["space"], lambda name: F.col("_u")[name], 50)
        slots = encoders.slots(strategy.mapping(held))
        # only continuous ranges have places to round
        broken = {name for name, node in held["space"].items() if isinstance(node[2] if isinstance(node, tuple) else node, space.FloatRange)}
        slots = [(F.round(c, 8) if name in broken else c).alias(name) for name, c in slots.items()]
        rows = trials.select("trial_id", "_u", *told, F.struct("trial_id", *slots, F.lit(level).alias("level")).alias(f"_{level}"))
        told.append(f"_{level}")
    return rows.select(F.explode(F.array(*told)).alias("r")).select("r.*")


@query(f"{H1}, {LIBRARY_SQL}, {_NAMED}, n AS (SELECT variant_id, count(*) AS n FROM ls0 GROUP BY 1) SELECT family, count(*) AS variants, CAST(coalesce(sum(n), 0) AS BIGINT) AS signals, round(count(*) * 0.25, 8) AS build_s FROM vs LEFT JOIN n ON vs.variant_id = n.variant_id GROUP BY family")
def preflight_families(spark, sf_dir):
    """What a run will be, by family: its variants and the signals that they really have."""
    held = {"signals": {name: {k: space.Choice(tuple(v)) for k, v in params.items()} for name, params in LIBRARY.items()}, "space": LEVELS[7]["space"], "execution": {}}
    trials = space.sample(spark, trial_ids(spark, sf_dir), held["space"], 11, 50)
    told = strategy.preflight(held, signals.build_library(bars(spark, sf_dir), LIBRARY)[0], trials, 500)
    return spark.createDataFrame([(name, k["variants"], k["signals"], k["variants"] * 0.25) for name, k in told["families"].items()], "family string, variants long, signals long, build_s double")


@query(f"{H1}, i AS (SELECT pair, 'H1' AS tf, count(*) AS rows, min(s) AS lo, max(s) AS hi FROM b GROUP BY pair UNION ALL SELECT pair, 'D', count(DISTINCT s // 86400), min(s // 86400 * 86400), max(s // 86400 * 86400) FROM b GROUP BY pair) SELECT pair, list_sort(list(tf)) AS tfs, CAST(sum(rows) AS BIGINT) AS rows, CAST(min(lo // 86400) AS BIGINT) AS first_day, CAST(max(hi // 86400) AS BIGINT) AS last_day FROM i GROUP BY pair")
def inventory_by_pair(spark, sf_dir):
    hourly = bars(spark, sf_dir)
    both = hourly.withColumn("tf", F.lit("H1")).unionByName(resample.longer_bars(hourly, "D").withColumn("tf", F.lit("D")))
    return upsert.inventory_by_pair(upsert.inventory(both))


@query(f"WITH {TICKS}, {bars_cte('b', 'H1')}, a AS (SELECT * FROM b WHERE s % 10800 <> 0) SELECT b.pair, b.s, round(CASE WHEN a.s IS NULL THEN b.close + 1 ELSE a.close END, 8) AS close, CASE WHEN a.s IS NULL THEN 1 ELSE 0 END AS source FROM b LEFT JOIN a ON a.pair = b.pair AND a.s = b.s")
def source_fallback(spark, sf_dir):
    """Bars of the best source, and where it has gaps those of the next."""
    b = bars(spark, sf_dir).select("pair", "s", "close")
    return rounded(upsert.first_source(b.where("s % 10800 <> 0"), b.withColumn("close", F.col("close") + 1)), "close")


@query(f"WITH {ORDERS}, p AS (SELECT id AS plan_id, id % 3 AS instance_id FROM o) SELECT plan_id, instance_id FROM p WHERE NOT (plan_id % 5 = 0 AND instance_id = 0) AND plan_id % 7 <> 0")
def plan_dedupe(spark, sf_dir):
    plans = _orders(spark, sf_dir).select(F.col("id").alias("plan_id"), (F.col("id") % 3).alias("instance_id"))
    return live.fresh_plans(plans.unionByName(plans.where("plan_id % 2 = 0")), plans.where("plan_id % 5 = 0").withColumn("instance_id", F.lit(0).cast("long")), plans.where("plan_id % 7 = 0"))


@query(f"WITH {ORDERS}, m AS (SELECT pair, round(avg(id % 7) / 10, 8) AS slip FROM o WHERE pair < '3' GROUP BY pair) SELECT id AS signal_id, o.pair, coalesce(slip, 0.5e0) AS slippage_pips FROM o LEFT JOIN m ON m.pair = o.pair")
def slippage_default(spark, sf_dir):
    o = _orders(spark, sf_dir)
    measured = o.where("pair < '3'").groupBy("pair").agg(F.round(F.avg(F.col("id") % 7) / 10, 8).alias("slippage_pips"))
    return sweep.with_slippage(o.select(F.col("id").alias("signal_id"), "pair"), measured)


# Logs and lookups


@query("WITH d AS (SELECT l_orderkey AS position_id, CAST(l_linenumber AS BIGINT) AS t, l_partkey AS ticket, CASE WHEN l_linenumber % 2 = 1 THEN 'in' ELSE 'out' END AS leg, CASE WHEN l_suppkey % 2 = 0 THEN 'buy' ELSE 'sell' END AS side, l_quantity AS price, l_discount AS vol, l_quantity - 25 AS profit, l_tax AS commission, l_suppkey AS order_id FROM lineitem WHERE l_orderkey <> 0), x AS (SELECT position_id, arg_min(struct_pack(t := t, side := side, price := price, vol := vol, o := order_id), (t, ticket, order_id, price)) FILTER (WHERE leg = 'in') AS i, arg_max(struct_pack(t := t, price := price), (t, ticket, order_id, price)) FILTER (WHERE leg = 'out') AS o, sum(profit) AS profit, sum(commission) AS commission FROM d GROUP BY 1) SELECT position_id, i.side AS side, i.vol AS volume, i.t - 3600 AS open_s, i.price AS open_price, o.t - 3600 AS close_s, o.price AS close_price, round(profit, 6) AS profit, round(commission, 6) AS commission, CASE WHEN i.o % 3 <> 0 THEN i.o / 10.0e0 END AS sl FROM x WHERE i IS NOT NULL AND o IS NOT NULL")
def closed_positions(spark, sf_dir):
    c = F.col
    d = table(spark, sf_dir, "lineitem").select(c("l_orderkey").alias("position_id"), c("l_partkey").alias("ticket"), c("l_linenumber").cast("long").alias("time"), c("l_suppkey").alias("order_id"), F.when(c("l_linenumber") % 2 == 1, "in").otherwise("out").alias("entry"), F.when(c("l_suppkey") % 2 == 0, "buy").otherwise("sell").alias("side"), F.lit("X").alias("symbol"), c("l_discount").alias("volume"), c("l_quantity").alias("price"), (c("l_quantity") - 25).alias("profit"), c("l_tax").alias("commission"), F.lit(0.0).alias("swap"))
    orders = table(spark, sf_dir, "supplier").select(c("s_suppkey").alias("order_id"), F.when(c("s_suppkey") % 3 != 0, c("s_suppkey") / 10.0).otherwise(0.0).alias("sl"), F.lit(0.0).alias("tp"))
    return rounded(live.closed_positions(d, orders, 3600).drop("symbol", "swap", "tp"), "profit", "commission", places=6)


@query(f"WITH {ORDERS} SELECT id AS plan_id, round((s * 1000 + 3600000 + id % 997) / 1000.0e0 - (s + 3600), 6) AS fire_offset_s, CASE WHEN id % 4 <> 0 THEN id % 89 END AS execution_ms FROM o")
def order_latencies(spark, sf_dir):
    o = _orders(spark, sf_dir)
    created = F.col("s") * 1000 + 3_600_000 + F.col("id") % 997
    plans = o.select(F.col("id").alias("plan_id"), F.col("s").alias("signal_s"), created.alias("created_ms"))
    return rounded(live.latencies(plans, o.where("id % 4 <> 0").select(F.col("id").alias("plan_id"), (created + F.col("id") % 89).alias("filled_ms")), 3600), "fire_offset_s", places=6)


@query(f"WITH {ORDERS} SELECT coalesce(CASE WHEN hour >= 21 THEN 'rollover' WHEN id % 11 = 0 THEN 'unknown_spread' WHEN id % 7 > 3 THEN 'spread_3p' END, 'pass') AS reason, count(*) AS n FROM (SELECT *, (s // 3600) % 24 AS hour FROM o) GROUP BY 1")
def live_guard(spark, sf_dir):
    """The gate before an order is sent, when its slippage isn't known yet."""
    o = _orders(spark, sf_dir)
    spread = F.when(F.col("id") % 11 != 0, (F.col("id") % 7).cast("double"))
    return o.groupBy(F.coalesce(cost.gate_reason(hour_of(F.col("s")), spread, None), F.lit("pass")).alias("reason")).agg(F.count("*").alias("n"))


@query("WITH p AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE -1 END AS d, 1e0 + (o_orderkey % 1000) * 1e-4 AS e, (o_orderkey % 17) + 1e0 AS atr, o_orderkey % 3 AS m, CASE WHEN o_orderkey % 4 <> 0 THEN 1e0 + (o_orderkey % 1003) * 1e-4 END AS sw FROM orders), q AS (SELECT *, CASE m WHEN 0 THEN 20 * 1e-4 WHEN 1 THEN atr * 1e-4 * 1.5 ELSE CASE WHEN sw IS NULL THEN atr * 1e-4 * 1.5 ELSE greatest(abs(e - sw), 5 * 1e-4) END END AS sl FROM p), r AS (SELECT *, CASE m WHEN 0 THEN sl * 0.5 WHEN 1 THEN atr * 1e-4 * 3 ELSE 40 * 1e-4 END AS tp FROM q) SELECT id, round(e - d * sl, 8) AS sl_price, round(e + d * tp, 8) AS tp_price FROM r")
def live_stops(spark, sf_dir):
    """Stops of live orders: the target isn't pushed out to the stop's distance."""
    return rounded(pricing.stops(_priced(spark, sf_dir), clamp=False).select("id", "sl_price", "tp_price"), "sl_price", "tp_price")


@query(f"WITH {TICKS}, c AS (SELECT pair, s, (ask - bid) / 1e-4 AS sp, CASE WHEN (s // 3600) % 24 < 8 THEN 'Asian' WHEN (s // 3600) % 24 < 13 THEN 'London' WHEN (s // 3600) % 24 < 17 THEN 'Lon-NY' WHEN (s // 3600) % 24 < 21 THEN 'NY' ELSE 'Rollover' END AS session FROM ticks) SELECT pair, session, round(avg(sp + CASE WHEN pair IN ('click', 'view') THEN 0 ELSE 1 END), 4) AS spread_pips, CASE WHEN pair IN ('click', 'view') THEN 'tick' ELSE 'minutes' END AS source FROM c GROUP BY ALL")
def preferred_costs(spark, sf_dir):
    """Session spreads from ticks, and for pairs without ticks from minute bars, which here are a pip wider."""
    t = ticks(spark, sf_dir)
    wider = t.withColumn("ask", F.col("ask") + F.lit(1e-4))
    return cost.preferred(("tick", cost.session_spreads(t.where("pair in ('click', 'view')"))), ("minutes", cost.session_spreads(wider)))


@query("SELECT s_suppkey AS place, s_suppkey * 3 - s_nationkey AS trial_id, o_custkey AS trades FROM supplier LEFT JOIN orders ON o_orderkey = s_suppkey * 3 - s_nationkey")
def trial_lookup(spark, sf_dir):
    found = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("trial_id"), F.col("o_custkey").alias("trades"))
    wanted = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("place"), (F.col("s_suppkey") * 3 - F.col("s_nationkey")).alias("trial_id"))
    return ranking.lookup(found, wanted)


@query(f"WITH {ORDERS}, t AS (SELECT id, CASE id % 4 WHEN 0 THEN 'sig_x [sl ' || (id % 100) || '.25]' WHEN 1 THEN 'a_L' || (id % 7) || '_b [tp  1.5]' WHEN 2 THEN '[SL 3]' ELSE 'none' END AS c FROM o) SELECT id, CASE id % 4 WHEN 0 THEN 'SL' WHEN 1 THEN 'TP' END AS stop_kind, CASE id % 4 WHEN 0 THEN id % 100 + 0.25e0 WHEN 1 THEN 1.5e0 END AS stop_price, CASE WHEN id % 4 = 1 THEN CAST(id % 7 AS INTEGER) END AS level FROM t")
def comment_fields(spark, sf_dir):
    i = F.col("id")
    told = F.when(i % 4 == 0, F.concat(F.lit("sig_x [sl "), (i % 100).cast("string"), F.lit(".25]"))).when(i % 4 == 1, F.concat(F.lit("a_L"), (i % 7).cast("string"), F.lit("_b [tp  1.5]"))).when(i % 4 == 2, "[SL 3]").otherwise("none")
    return _orders(spark, sf_dir).select("id", *[c.alias(name) for name, c in live.comment_fields(told).items()])
