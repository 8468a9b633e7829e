"""Queries over logs, ledgers and exits by time, registered beside the catalogue's, each with SQL that gives the same rows."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from chronosweep.functions.exprs import PPF_CENTRE, PPF_LOW, PPF_TAIL, hour_of, nice_round, session_name
from chronosweep.operators import cost, indicators, ledger, live, metrics, ranking, reconcile, resample, simulate
from chronosweep.plans.catalogue import _FLAGS, _HOUR, _PAIR_COUNTS, _RANKED, _SIDES, _TOUCH, _TR, H1, MOMENTS, ORDERS, TICKS, _entries, _metrics, _orders, _sides, bars, bars_cte, compared_sql, counts_sql, m1, metrics_sql, phi_sql, query, rounded
from chronosweep.sources import upsert
from chronosweep.sources.bridge import table, ticks, trades


# Exits by time


_NUMBERED = ", nb AS (SELECT *, row_number() OVER (PARTITION BY pair ORDER BY s) AS rn FROM b), lb AS (SELECT pair, max(rn) AS last_rn, max(s) AS last_s, arg_max(close, s) AS last_close FROM nb GROUP BY pair)"


@query(_TOUCH + _NUMBERED + " SELECT en.pair, en.s, x.s AS exit_s, round(x.close, 8) AS exit_price, CASE WHEN nb.rn + 12 <= last_rn THEN 'MAX_BARS' ELSE 'NONE' END AS exit_reason FROM en JOIN nb ON nb.pair = en.pair AND nb.s = en.s JOIN lb ON lb.pair = en.pair JOIN nb x ON x.pair = en.pair AND x.rn = least(nb.rn + 12, last_rn)")
def max_bars_exit(spark, sf_dir):
    b, e = _entries(spark, sf_dir)
    return rounded(simulate.max_bars_exit(e, b, 12).select("pair", "s", "exit_s", "exit_price", "exit_reason"), "exit_price")


@query(_TOUCH + _NUMBERED + ", wd AS (SELECT *, max(high - low) OVER (PARTITION BY pair ORDER BY rn ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AS width FROM nb), hit AS (SELECT en.pair, en.s, min(wd.rn) AS rn FROM en JOIN nb ON nb.pair = en.pair AND nb.s = en.s JOIN wd ON wd.pair = en.pair AND wd.rn >= nb.rn + 2 AND wd.width < 0.002 GROUP BY en.pair, en.s) SELECT en.pair, en.s, coalesce(nb.s, last_s) AS exit_s, round(coalesce(nb.close, last_close), 8) AS exit_price, CASE WHEN hit.rn IS NULL THEN 'NONE' ELSE 'STALE' END AS exit_reason FROM en JOIN lb ON lb.pair = en.pair LEFT JOIN hit ON hit.pair = en.pair AND hit.s = en.s LEFT JOIN nb ON nb.pair = en.pair AND nb.rn = hit.rn")
def stale_exit(spark, sf_dir):
    b, e = _entries(spark, sf_dir)
    return rounded(simulate.stale_exit(e, b, 2, 0.002).select("pair", "s", "exit_s", "exit_price", "exit_reason"), "exit_price")


@query(_TOUCH + " SELECT pair, s AS entry_s, exit_s, CAST(direction AS INTEGER) AS direction, exit_reason, round(direction * (exit_price - entry_price) / 1e-4, 6) AS pips, CAST((exit_s - s) // 900 AS BIGINT) AS bars_held, CASE WHEN (s // 3600) % 24 < 8 THEN 'Asian' WHEN (s // 3600) % 24 < 13 THEN 'London' WHEN (s // 3600) % 24 < 17 THEN 'Lon-NY' WHEN (s // 3600) % 24 < 21 THEN 'NY' ELSE 'Rollover' END AS session FROM ex")
def trade_log(spark, sf_dir):
    b, e = _entries(spark, sf_dir)
    done = simulate.first_touch(e, b, 900)
    pips = F.col("direction") * (F.col("exit_price") - F.col("entry_price")) / F.lit(1e-4)
    return done.select("pair", F.col("s").alias("entry_s"), "exit_s", "direction", "exit_reason", F.round(pips, 6).alias("pips"), F.floor((F.col("exit_s") - F.col("s")) / 900).alias("bars_held"), session_name(hour_of(F.col("s"))).alias("session"))


# Metrics and ranking


def _horner(coefficients: tuple[float, ...], x: str) -> str:
    out = f"{coefficients[0]!r}"
    for c in coefficients[1:]:
        out = f"({out} * {x} + {c!r})"
    return out


def _ppf_sql(p: str) -> str:
    tail = lambda x: f"({_horner(PPF_TAIL[0], f'sqrt(-2.0 * ln({x}))')} / {_horner(PPF_TAIL[1], f'sqrt(-2.0 * ln({x}))')})"
    q = f"({p} - 0.5)"
    centre = f"({_horner(PPF_CENTRE[0], f'({q} * {q})')} * {q} / {_horner(PPF_CENTRE[1], f'({q} * {q})')})"
    return f"CASE WHEN {p} < {PPF_LOW} THEN {tail(p)} WHEN {p} > {1 - PPF_LOW!r} THEN -{tail(f'(1 - {p})')} ELSE {centre} END"


@query(f"WITH {MOMENTS}, q AS (SELECT trial_id, {metrics_sql(['psr'])} FROM k), n AS (SELECT CAST(count(*) AS DOUBLE) AS c FROM q), m AS (SELECT {1 - metrics.EULER!r} * ({_ppf_sql('(1 - 1 / c)')}) + {metrics.EULER!r} * ({_ppf_sql(f'(1 - 1 / (c * {math.e!r}))')}) AS best FROM n), z AS (SELECT trial_id, psr, ({_ppf_sql('least(greatest(psr, 1e-12), 1 - 1e-12)')}) - best AS z FROM q, m) SELECT trial_id, psr, round({phi_sql('z')}, 6) AS dsr FROM z")
def metrics_dsr(spark, sf_dir):
    return rounded(metrics.with_dsr(_metrics(spark, sf_dir).select("trial_id", "psr")), "dsr", places=6)


_PROXY = "n * (m - 0.4)"


@query(f"WITH {MOMENTS} SELECT trial_id, round({_PROXY}, 6) AS adjusted_proxy FROM k ORDER BY {_PROXY} DESC, ret DESC, n DESC, trial_id LIMIT 1")
def adjusted_proxy_pick(spark, sf_dir):
    m = ranking.with_proxy(metrics.trial_metrics(trades(spark, sf_dir)), -0.4)
    return rounded(ranking.pick_best(m, "adjusted_proxy").select("trial_id", "adjusted_proxy"), "adjusted_proxy", places=6)


@query(f"{_RANKED}, z AS (SELECT * FROM r WHERE total_pips > 0 OR NOT EXISTS (SELECT 1 FROM r WHERE total_pips > 0)) SELECT trial_id, max_dd_pct FROM z ORDER BY max_dd_pct, return_pct DESC, trial_id LIMIT 1")
def jump_best(spark, sf_dir):
    return ranking.jump_best(_metrics(spark, sf_dir), "max_dd_pct").select("trial_id", "max_dd_pct")


@query(f"{_RANKED}, f AS (SELECT * FROM r WHERE total_pips >= 0 AND max_dd_pct < 30 AND trades > 0), z AS (SELECT * FROM f UNION ALL SELECT * FROM r WHERE NOT EXISTS (SELECT 1 FROM f)) SELECT trial_id, trades FROM z ORDER BY trades DESC, total_pips DESC, trial_id LIMIT 1")
def density_pick(spark, sf_dir):
    return ranking.by_density(_metrics(spark, sf_dir)).select("trial_id", "trades")


@query("WITH n AS (SELECT max(o_orderkey) AS m FROM orders), c AS (SELECT DISTINCT CAST(least(CASE WHEN m < 50 THEN k ELSE floor(k * (m / 49)) END, m) AS BIGINT) AS id FROM n, range(50) r(k)) SELECT o_orderkey AS trial_id, o_totalprice AS value FROM orders WHERE o_orderkey IN (SELECT id FROM c)")
def linspace_sample(spark, sf_dir):
    return ranking.evenly_spaced(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("trial_id"), F.col("o_totalprice").alias("value")), 50)


# Costs and ranges


@query(f"WITH {TICKS}, c AS (SELECT pair, CASE WHEN {_HOUR} < 8 THEN 'Asian' WHEN {_HOUR} < 13 THEN 'London' WHEN {_HOUR} < 17 THEN 'Lon-NY' WHEN {_HOUR} < 21 THEN 'NY' ELSE 'Rollover' END AS session, round(avg((ask - bid) / 1e-4), 4) AS spread_pips FROM ticks WHERE ask >= bid GROUP BY ALL), h AS (SELECT pair, min(s) AS first_s, max(s) AS last_s FROM ticks GROUP BY pair) SELECT c.pair, session, spread_pips, 0.35e0 AS commission_per_side_pips, 0.5e0 AS slippage_per_side_pips, 'tick' AS source, first_s, last_s FROM c JOIN h ON c.pair = h.pair")
def cost_table(spark, sf_dir):
    t = ticks(spark, sf_dir)
    history = t.groupBy("pair").agg(F.min("s").alias("first_s"), F.max("s").alias("last_s"))
    fixed = {"commission_per_side_pips": F.lit(0.35), "slippage_per_side_pips": F.lit(0.5), "source": F.lit("tick")}
    return cost.session_spreads(t).withColumns(fixed).join(history, "pair")


def _nice_sql(x: str) -> str:
    power = f"pow(10.0, floor(log10({x})))"
    base = f"({x} / {power})"
    return f"(CASE WHEN {base} < 1.5 THEN 1 WHEN {base} < 3.5 THEN 2 WHEN {base} < 7.5 THEN 5 ELSE 10 END * {power})"


_ATR_RULES = {"sl": (0.3, 6.0), "tp": (0.5, 10.0), "trail": (0.3, 8.0)}


@query(f"{H1}, {_TR}, a AS (SELECT pair, avg(tr) OVER (PARTITION BY pair ORDER BY s ROWS BETWEEN 13 PRECEDING AND CURRENT ROW) AS m, row_number() OVER (PARTITION BY pair ORDER BY s) AS k FROM t), md AS (SELECT pair, median(m) FILTER (WHERE k >= 14) / 1e-4 AS atr FROM a GROUP BY pair HAVING count(*) >= 19) SELECT pair, " + ", ".join(f"round(greatest({_nice_sql(f'(atr * {lo})')}, 0.1), 6) AS {k}_min, round({_nice_sql(f'(atr * {hi})')}, 6) AS {k}_max" for k, (lo, hi) in _ATR_RULES.items()) + " FROM md")
def nice_ranges(spark, sf_dir):
    atr = indicators.median_atr(bars(spark, sf_dir)).withColumn("atr", F.col("atr") / F.lit(1e-4))
    columns = []
    for k, (lo, hi) in _ATR_RULES.items():
        columns += [F.round(F.greatest(nice_round(F.col("atr") * lo), F.lit(0.1)), 6).alias(f"{k}_min"), F.round(nice_round(F.col("atr") * hi), 6).alias(f"{k}_max")]
    return atr.select("pair", *columns)


# Logs


def _logs(spark, sf_dir):
    o = _orders(spark, sf_dir)
    ref = 1 + F.col("id") % 100 * 0.001
    plans = o.select(F.col("id").alias("plan_id"), "pair", "direction", F.col("s").alias("signal_s"), ref.alias("entry_ref_price"), F.when(F.col("id") % 5 != 0, F.col("id") % 11).alias("signal_variant"), F.when(F.col("id") % 5 != 0, F.concat(F.lit("family"), (F.col("id") % 3).cast("string"))).alias("signal_family"), F.when(F.col("id") % 8 != 0, F.col("id") % 7 * 0.25).alias("spread_at_fire_pips"), (F.col("id") % 10 / 100).alias("lots"))
    sent = o.where("id % 9 <> 0")
    fill = ref + F.col("id") % 5 * 0.0001
    tickets = sent.select(F.col("id").alias("plan_id"), F.col("id").alias("ticket"), fill.alias("fill_price"))
    opened = sent.select(F.col("id").alias("ticket"), F.col("id").alias("position_id"), fill.alias("price"), (F.col("id") % 3 * -0.5).alias("commission"), F.lit(0.0).alias("swap"), F.lit("EXPERT").alias("reason"))
    closed = sent.where("id % 7 <> 0").select((F.col("id") + 1_000_000_000).alias("ticket"), F.col("id").alias("position_id"), (ref + F.col("id") % 31 * 0.0002 - 0.003).alias("price"), F.lit(-0.25).alias("commission"), (F.col("id") % 2 * 0.125).alias("swap"), live.deal_reason(F.col("id") % 2 + 4).alias("reason"))
    return plans, tickets, opened.unionByName(closed)


_STITCHED = f"{ORDERS}, st AS (SELECT id AS plan_id, pair, CAST(direction AS INTEGER) AS direction, s AS signal_s, 1 + id % 100 * 0.001e0 AS ref, CASE WHEN id % 9 <> 0 THEN 1 + id % 100 * 0.001e0 + id % 5 * 0.0001e0 END AS fill, CASE WHEN id % 9 <> 0 AND id % 7 <> 0 THEN 1 + id % 100 * 0.001e0 + id % 31 * 0.0002e0 - 0.003e0 END AS px, CASE WHEN id % 9 <> 0 THEN id % 3 * -0.5e0 + CASE WHEN id % 7 <> 0 THEN -0.25e0 ELSE 0 END END AS com, CASE WHEN id % 9 <> 0 THEN CASE WHEN id % 7 <> 0 THEN id % 2 * 0.125e0 ELSE 0 END END AS swp, CASE WHEN id % 9 <> 0 AND id % 7 <> 0 THEN CASE WHEN id % 2 = 0 THEN 'SL' ELSE 'TP' END ELSE '' END AS why, CASE WHEN id % 5 <> 0 THEN id % 11 ELSE -1 END AS vn, CASE WHEN id % 5 <> 0 THEN 'family' || (id % 3) ELSE '' END AS fam, CASE WHEN id % 8 <> 0 THEN id % 7 * 0.25e0 END AS fire, id % 10 / 100 AS lots FROM o)"


@query(f"WITH {_STITCHED} SELECT plan_id, pair, direction, signal_s, vn AS signal_variant, fam AS signal_family, fire AS spread_pips, round(lots, 6) AS lots, round(ref, 6) AS entry_price, round(px, 6) AS exit_price, round((px - fill) / 1e-4 * direction, 4) AS pnl_pips, com AS commission_ccy, swp AS swap_ccy, why AS close_reason, round((fill - ref) / 1e-4 * direction, 4) AS slippage_pips FROM st")
def live_stitch(spark, sf_dir):
    return rounded(rounded(live.stitch(*_logs(spark, sf_dir)), "entry_price", "exit_price", "lots", places=6), "pnl_pips", "slippage_pips", places=4)


@query(f"WITH {ORDERS}, v AS (SELECT id, id % 6 <> 0 AS ok, CASE id % 4 WHEN 0 THEN 'NONE' WHEN 1 THEN 'SL' ELSE 'TP' END AS bt, CASE WHEN id % 3 = 0 THEN 'hit sl' ELSE 'tp' END AS lv, CASE WHEN id % 13 <> 0 THEN CAST(id % 9 AS DOUBLE) END AS pnl, CAST(id % 25 AS DOUBLE) AS mins, CAST(id % 5 AS DOUBLE) AS ed, CAST(id % 3 AS DOUBLE) AS xd FROM o) SELECT CASE WHEN NOT ok THEN 'No backtest match' WHEN bt = 'NONE' THEN 'Backtest data cut off' WHEN pnl IS NULL THEN 'No replay match' WHEN abs(pnl) <= 2 AND mins <= 2 AND ed <= 2 AND xd <= 2 THEN 'Good match' WHEN abs(pnl) <= 5 AND mins <= 10 THEN 'Close enough, review' WHEN abs(pnl) <= 5 AND lv LIKE '%sl%' AND bt = 'SL' THEN 'Broker price-path drift' ELSE 'Material difference' END AS verdict, count(*) AS n FROM v GROUP BY 1")
def verdict(spark, sf_dir):
    i = F.col("id")
    o = _orders(spark, sf_dir)
    reason = F.when(i % 4 == 0, "NONE").when(i % 4 == 1, "SL").otherwise("TP")
    said = live.verdict(i % 6 != 0, reason, F.when(i % 3 == 0, "hit sl").otherwise("tp"), F.when(i % 13 != 0, (i % 9).cast("double")), (i % 25).cast("double"), (i % 5).cast("double"), (i % 3).cast("double"))
    return o.groupBy(said.alias("verdict")).agg(F.count("*").alias("n"))


@query(f"WITH {ORDERS} SELECT pair AS symbol, count(*) AS n, count_if(id % 41 - 20 > 0) AS wins, CAST(sum(id % 41 - 20) AS DOUBLE) AS net, round(count_if(id % 41 - 20 > 0) * 100 / count(*), 6) AS win_pct FROM o GROUP BY ROLLUP (pair)")
def position_summary(spark, sf_dir):
    p = _orders(spark, sf_dir).select(F.col("pair").alias("symbol"), (F.col("id") % 41 - 20).cast("double").alias("profit"))
    return rounded(live.position_summary(p).withColumn("wins", F.col("wins").cast("decimal(38,0)").cast("long")), "win_pct", places=6)


@query(f"WITH {_SIDES}, a AS (SELECT pair, count(*) AS matched, {_FLAGS} FROM cl GROUP BY pair), b AS (SELECT pair, count_if(side = 'missing') AS missing_in_live, count_if(side = 'extra') AS extra_in_live FROM rs GROUP BY pair), u(pair, has_open) AS (VALUES ('1-URGENT', true), ('9-NEVER', false)), n AS (SELECT pair FROM a UNION SELECT pair FROM b UNION SELECT pair FROM u) SELECT n.pair, {_PAIR_COUNTS}, coalesce(has_open, false) AS has_open_position FROM n LEFT JOIN a ON a.pair = n.pair LEFT JOIN b ON b.pair = n.pair LEFT JOIN u ON u.pair = n.pair")
def dashboard_rollup(spark, sf_dir):
    bt, lv = _sides(spark, sf_dir)
    matched = reconcile.match_exact(bt, lv)
    rollup = reconcile.by_pair(reconcile.classify(matched), reconcile.residuals(bt, lv, matched))
    universe = spark.createDataFrame([("1-URGENT",), ("9-NEVER",)], "pair string")
    counts = [c for c, kind in rollup.dtypes if kind == "bigint"]
    return live.dashboard(rollup.select("pair", *counts), universe, universe.where("pair = '1-URGENT'"))


@query(f"WITH {ORDERS} SELECT id AS plan_id, s AS created_s, pair FROM (SELECT * FROM o WHERE pair = '2-HIGH' AND s >= 800000000 ORDER BY s DESC, id DESC LIMIT 25)")
def plan_tail(spark, sf_dir):
    plans = _orders(spark, sf_dir).select(F.col("id").alias("plan_id"), F.col("s").alias("created_s"), "pair")
    return live.tail_plans(plans, 25, 800_000_000, "2-HIGH")


@query(f"WITH {ORDERS}, h AS (SELECT pair, count(*) AS held FROM o WHERE id % 997 = 0 GROUP BY pair), p AS (SELECT id AS plan_id, pair, s AS created_s, row_number() OVER (PARTITION BY pair ORDER BY s, id) AS k FROM o WHERE id % 997 <> 0) SELECT plan_id, p.pair, created_s FROM p LEFT JOIN h ON p.pair = h.pair WHERE k + coalesce(held, 0) <= 40")
def position_cap(spark, sf_dir):
    plans = _orders(spark, sf_dir).select(F.col("id").alias("plan_id"), "pair", F.col("s").alias("created_s"))
    return live.capped(plans.where("plan_id % 997 <> 0"), plans.where("plan_id % 997 = 0"), 40)


@query("WITH d AS (SELECT DISTINCT l_orderkey AS ticket, l_linenumber AS time, l_partkey AS price, CASE WHEN l_suppkey % 3 = 0 THEN 77 ELSE 0 END AS magic, CASE WHEN l_suppkey % 5 = 0 THEN 'sig_macd' ELSE 'other' END AS comment FROM lineitem) SELECT ticket, time, price, magic, comment FROM d WHERE magic = 77 OR comment LIKE 'sig\\_%' ESCAPE '\\' QUALIFY row_number() OVER (PARTITION BY ticket ORDER BY time DESC, price DESC, magic DESC, comment DESC) = 1")
def own_deals(spark, sf_dir):
    d = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("ticket"), F.col("l_linenumber").alias("time"), F.col("l_partkey").alias("price"), F.when(F.col("l_suppkey") % 3 == 0, 77).otherwise(0).alias("magic"), F.when(F.col("l_suppkey") % 5 == 0, "sig_macd").otherwise("other").alias("comment"))
    return live.own_deals(d.distinct(), 77)


@query("SELECT DISTINCT o_orderpriority AS family, CASE WHEN trim(regexp_replace(lower(o_orderpriority), '[^a-z0-9_]+', '_', 'g'), '_') = '' THEN 'order' ELSE substr('sig_' || trim(regexp_replace(lower(trim(o_orderpriority)), '[^a-z0-9_]+', '_', 'g'), '_'), 1, 31) END AS comment FROM orders")
def order_comments(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("family")).distinct().withColumn("comment", live.order_comment(F.col("family")))


@query(f"WITH {ORDERS} SELECT id AS trial_id, list_filter([CASE WHEN id % 2 = 0 THEN 'stale' END, CASE WHEN id % 3 = 0 THEN 'session' END, CASE WHEN id % 5 = 0 THEN 'max_bars' END], lambda x: x IS NOT NULL) AS groups FROM o")
def portable_check(spark, sf_dir):
    t = _orders(spark, sf_dir).select(F.col("id").alias("trial_id"), (F.col("id") % 2 == 0).alias("stale"), (F.col("id") % 3 == 0).alias("session"), (F.col("id") % 5 == 0).alias("max_bars"))
    return live.unportable(t)


@query(f"WITH {TICKS}, {bars_cte('b', 'M15')}, sg AS (SELECT pair, s, close FROM b WHERE s % 1800 = 0 OR s % 2700 = 0) SELECT pair, s, round(close, 8) AS close FROM sg WHERE (pair, s) IN (SELECT (pair, max(s)) FROM b GROUP BY pair)")
def fired_on_last_bar(spark, sf_dir):
    b = bars(spark, sf_dir, "M15").select("pair", "s", "close")
    return rounded(live.fired_on_last_bar(b.where("s % 1800 = 0 or s % 2700 = 0"), b), "close")


@query(f"WITH {_SIDES}, c AS (SELECT bt_id AS id, bt.pair, live_id AS rid, live.signal_s AS s FROM bt JOIN live ON bt.pair = live.pair AND live.signal_s >= bt.signal_s AND live.signal_s < bt.signal_s + 960), f AS (SELECT id, rid FROM c QUALIFY row_number() OVER (PARTITION BY id ORDER BY s, rid) = 1) SELECT bt_id AS id, pair, rid FROM bt LEFT JOIN f ON bt.bt_id = f.id")
def first_within(spark, sf_dir):
    bt, lv = _sides(spark, sf_dir)
    return live.first_within(bt.select("pair", F.col("signal_s").alias("s"), F.col("bt_id").alias("id")), lv.select("pair", F.col("signal_s").alias("s"), F.col("live_id").alias("rid")), 960)


_GREEDY = "x AS (SELECT * FROM bt WHERE bt_id NOT IN (SELECT bt_id FROM mt)), y AS (SELECT * FROM live WHERE live_id NOT IN (SELECT live_id FROM mt)), q AS (SELECT pair, direction, bt_id, row_number() OVER (PARTITION BY pair, direction ORDER BY signal_s, bt_id) AS k FROM x), gl AS (SELECT bt_id, list(struct_pack(gap := abs(x.signal_s - y.signal_s), s := y.signal_s, id := live_id) ORDER BY abs(x.signal_s - y.signal_s), y.signal_s, live_id) AS l FROM x JOIN y ON x.pair = y.pair AND x.direction = y.direction AND abs(x.signal_s - y.signal_s) <= 3600 GROUP BY bt_id), ql AS (SELECT q.*, l FROM q LEFT JOIN gl ON gl.bt_id = q.bt_id), rc AS (SELECT DISTINCT pair, direction, CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS gone, CAST(NULL AS BIGINT) AS bt_id, CAST(NULL AS STRUCT(gap BIGINT, s BIGINT, id BIGINT)) AS pick FROM q UNION ALL SELECT pair, direction, k, CASE WHEN pick IS NULL THEN gone ELSE list_append(gone, pick.id) END, bt_id, pick FROM (SELECT ql.pair, ql.direction, ql.k, rc.gone, ql.bt_id, list_filter(l, lambda c: NOT list_contains(gone, c.id))[1] AS pick FROM rc JOIN ql ON ql.pair = rc.pair AND ql.direction = rc.direction AND ql.k = rc.k + 1))"


@query(f"WITH RECURSIVE {_SIDES}, {_GREEDY} SELECT bt_id, pick.id AS live_id, pair, CAST(direction AS INTEGER) AS direction, pick.gap AS gap FROM rc WHERE pick IS NOT NULL")
def match_greedy(spark, sf_dir):
    """Nearest matches that use rows up, in order of time: in SQL a recursion that takes one row of each pair and direction a step."""
    bt, lv = _sides(spark, sf_dir)
    exact = reconcile.match_exact(bt, lv)
    return live.match_greedy(bt.join(exact.select("bt_id"), "bt_id", "left_anti"), lv.join(exact.select("live_id"), "live_id", "left_anti"), 3600)


_SECOND = "b2 AS (SELECT * REPLACE (signal_s + CASE WHEN bt_id % 9 = 2 THEN 1800 ELSE 0 END AS signal_s, bt_pnl + bt_id % 5 - 1 AS bt_pnl, bt_spread + bt_id % 2 AS bt_spread) FROM bt WHERE bt_id % 8 <> 5), l2 AS (SELECT pair, direction, signal_s, bt_id AS live_id, bt_entry AS live_entry, bt_exit AS live_exit, bt_pnl AS live_pnl, bt_variant AS live_variant, bt_spread AS live_spread, CAST(NULL AS DOUBLE) AS live_slippage, bt_close AS live_close FROM b2)"


@query(f"WITH {_SIDES}, {_SECOND}, {compared_sql('b2', 'live', '_b')}, {compared_sql('bt', 'l2', '_c')} SELECT pass, category, CAST(n AS BIGINT) AS n FROM (" + " UNION ALL ".join(counts_sql(tag, f"'{name}' AS pass, ") for name, tag in (("A", ""), ("B", "_b"), ("C", "_c"))) + ")")
def three_way(spark, sf_dir):
    """Two sources of bars against the record, and against each other."""
    bt, lv = _sides(spark, sf_dir)
    i = F.col("bt_id")
    second = bt.where(i % 8 != 5).withColumns({"signal_s": F.col("signal_s") + F.when(i % 9 == 2, 1800).otherwise(0), "bt_pnl": F.col("bt_pnl") + i % 5 - 1, "bt_spread": F.col("bt_spread") + i % 2})
    return reconcile.passes(bt, second, lv)


# Sources


@query(f"WITH {TICKS}, {bars_cte('m1', 'M1')}, {bars_cte('h', 'H1')} SELECT pair, 'minutes' AS source, count(*) AS n FROM m1 GROUP BY pair UNION ALL SELECT pair, 'hours', count(*) FROM h GROUP BY pair")
def union_sources(spark, sf_dir):
    both = m1(spark, sf_dir).withColumn("source", F.lit("minutes")).unionByName(bars(spark, sf_dir).withColumn("source", F.lit("hours")))
    return both.groupBy("pair", "source").agg(F.count("*").alias("n"))


@query(f"WITH {TICKS} SELECT pair, CAST(s // 60 * 60 AS BIGINT) AS s, round(first(bid ORDER BY us, seq), 8) AS open, round(max(bid), 8) AS high, round(min(bid), 8) AS low, round(last(bid ORDER BY us, seq), 8) AS close, 0e0 AS volume FROM ticks WHERE (s // 86400 + 3) % 7 < 5 GROUP BY pair, s // 60")
def side_bars(spark, sf_dir):
    """Minute bars of one side of the quotes, without weekends."""
    return rounded(resample.side_bars(ticks(spark, sf_dir), "bid"), "open", "high", "low", "close")


@query(f"WITH {TICKS} SELECT pair, CAST((s - 7200) // 86400 AS BIGINT) AS day, count(*) AS n, round(avg(ask - bid) * 1e4, 6) AS pips FROM ticks GROUP BY ALL")
def broker_time(spark, sf_dir):
    """Days in UTC and spreads in prices, from a broker's clock and spreads in points."""
    t = upsert.from_broker(ticks(spark, sf_dir).withColumn("spread", (F.col("ask") - F.col("bid")) / F.lit(1e-5)), 7200, 1e-5)
    return t.groupBy("pair", F.floor(F.col("s") / 86400).alias("day")).agg(F.count("*").alias("n"), F.round(F.avg("spread") * 1e4, 6).alias("pips"))


@query(f"WITH {TICKS}, b AS (SELECT min(s) // 3600 * 3600 AS lo, max(s) // 3600 * 3600 AS hi FROM ticks), h AS (SELECT CAST(unnest(range(lo, hi + 1, 3600)) AS BIGINT) AS hour_s FROM b), o AS (SELECT hour_s FROM h WHERE isodow(make_timestamp(hour_s * 1000000)) < 6 OR (isodow(make_timestamp(hour_s * 1000000)) = 7 AND hour(make_timestamp(hour_s * 1000000)) >= 21)) SELECT hour_s, count(t.s) AS n FROM o LEFT JOIN ticks t ON t.s // 3600 * 3600 = hour_s GROUP BY hour_s")
def trading_hours(spark, sf_dir):
    """The hours of a table's span in which markets are open, with its ticks in each."""
    hour = (F.floor(F.col("s") / 3600) * 3600).alias("hour_s")
    counts = ticks(spark, sf_dir).groupBy(hour).agg(F.count("*").alias("n"))
    lo, hi = counts.agg(F.min("hour_s"), F.max("hour_s")).first()
    return upsert.trading_hours(spark, lo, hi).join(counts, "hour_s", "left").fillna(0, ["n"])


# Ledgers


def _runs(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("run_id"), F.col("o_custkey").alias("n_trials"), F.col("o_totalprice").cast("double").alias("pips"))


@query("SELECT o_orderkey AS run_id, o_custkey AS n_trials, CAST(o_totalprice AS DOUBLE) AS pips, CASE WHEN o_orderkey % 2 = 0 THEN 'fast' ELSE 'baseline' END AS strategy FROM orders WHERE o_orderkey % 2 = 1 OR o_orderkey % 3 <> 0")
def history_ledger(spark, sf_dir):
    """Runs appended to a table without their newer column, and some of them deleted."""
    r = _runs(spark, sf_dir)
    every = ledger.append_runs(r.where("run_id % 2 = 1"), r.where("run_id % 2 = 0").withColumn("strategy", F.lit("fast")))
    return ledger.delete_runs(every, r.where("run_id % 6 = 0"))


@query(f"WITH {ORDERS}, r AS (SELECT * FROM (SELECT id AS n, id % 50 AS n_trials, CAST(id % 7 AS DOUBLE) AS tps, CAST(id % 90 AS DOUBLE) AS rt, id % 11 AS nv FROM o ORDER BY id DESC LIMIT 10) WHERE n_trials > 0 AND tps > 0 AND rt > 0 AND nv > 0), b AS (SELECT *, greatest(rt - n_trials / tps - 3, 0) / nv AS b FROM r) SELECT round(median(b) FILTER (WHERE b > 0 AND b < 10), 6) AS per_variant_s, round(median(tps), 6) AS trials_per_s FROM b")
def learn_rates(spark, sf_dir):
    i = F.col("id")
    runs = _orders(spark, sf_dir).select(i.alias("n"), (i % 50).alias("n_trials"), (i % 7).cast("double").alias("trials_per_s"), (i % 90).cast("double").alias("runtime_s"), (i % 11).alias("n_variants"))
    return rounded(ledger.learn_rates(runs), "per_variant_s", "trials_per_s", places=6)


@query(f"WITH {ORDERS}, b AS (SELECT pair AS kpi, CAST(sum(id % 7) AS DOUBLE) AS v FROM o WHERE pair <> '5-LOW' GROUP BY pair), n AS (SELECT pair AS kpi, CAST(sum(id % 5) AS DOUBLE) AS v FROM o WHERE pair <> '1-URGENT' GROUP BY pair) SELECT coalesce(b.kpi, n.kpi) AS kpi, b.v AS baseline, n.v AS new, n.v - b.v AS delta, round((n.v - b.v) * 100 / abs(b.v), 6) AS delta_pct FROM b FULL JOIN n ON b.kpi = n.kpi")
def baseline_delta(spark, sf_dir):
    o = _orders(spark, sf_dir)
    kpi = lambda out, k: o.where(F.col("pair") != out).groupBy(F.col("pair").alias("kpi")).agg(F.sum(F.col("id") % k).cast("double").alias("value"))
    return rounded(ledger.baseline_delta(kpi("1-URGENT", 5), kpi("5-LOW", 7)), "delta_pct", places=6)


@query(f"WITH {ORDERS} SELECT id AS config_id, id % 3 AS run_id, id % 9 AS variant_id, CASE WHEN id % 4 = 0 THEN 'own' WHEN id % 9 < 5 AND id % 3 < 2 THEN 'family' || (id % 9) END AS family, CASE WHEN id % 4 = 0 THEN 'present' WHEN id % 9 < 5 AND id % 3 < 2 THEN 'filled' ELSE 'unresolved' END AS status FROM o")
def fingerprint_backfill(spark, sf_dir):
    configs = _orders(spark, sf_dir).select(F.col("id").alias("config_id"), (F.col("id") % 3).alias("run_id"), (F.col("id") % 9).alias("variant_id"), F.when(F.col("id") % 4 == 0, "own").alias("family"))
    variants = spark.range(2).select(F.col("id").alias("run_id"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(4).cast("long"))).alias("variant_id")).withColumn("family", F.concat(F.lit("family"), F.col("variant_id").cast("string")))
    return ledger.backfill_fingerprints(configs, variants)


@query("SELECT 'running' AS side, c_nationkey AS nation, count(*) AS n FROM customer WHERE c_custkey % 3 <> 0 AND c_custkey % 5 <> 0 GROUP BY ALL UNION ALL SELECT 'retired', c_nationkey, count(*) FROM customer WHERE c_custkey % 3 = 0 GROUP BY ALL")
def instance_registry(spark, sf_dir):
    configs = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("instance_id"), F.col("c_nationkey").alias("nation"))
    manifest = configs.where("instance_id % 3 <> 0").select("instance_id", F.when(F.col("instance_id") % 5 == 0, False).alias("active"))
    running, retired = ledger.active_instances(configs, manifest)
    count = lambda d, side: d.groupBy("nation").agg(F.count("*").alias("n")).select(F.lit(side).alias("side"), "nation", "n")
    return count(running, "running").unionByName(count(retired, "retired"))
