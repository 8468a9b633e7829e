"""All registered queries of the analytics engine, each with SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronosweep.functions.exprs import TIMEFRAMES, hour_of, pip, session_id, session_name, time_filter, weekday_of
from chronosweep.operators import cost, health, indicators, metrics, pricing, ranking, reconcile, resample, signals, simulate, space
from chronosweep.sources import upsert
from chronosweep.sources.bridge import table, ticks, trades

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return add


def rounded(df: DataFrame, *columns: str, places: int = 8) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), places) for c in columns})


PRICES = ("open", "high", "low", "close", "spread")
TICKS = "ticks AS (SELECT event_type AS pair, CAST(floor(epoch_us(ts) / 1000000) AS BIGINT) AS s, epoch_us(ts) AS us, 1.1e0 + value * 1e-4 AS bid, 1.1e0 + value * 1e-4 + (CAST(regexp_extract(props, '(\\d+)', 1) AS DOUBLE) + 1) * 1e-6 AS ask, event_id AS seq FROM events)"
ROUND = ", ".join(f"round({c}, 8) AS {c}" for c in PRICES)
EVENTS = "round(entry_price, 8) AS entry_price"


def bars_cte(name: str, tf: str) -> str:
    w, o = TIMEFRAMES[tf]
    return f"{name} AS (SELECT pair, CAST(floor((s - {o}) / {w}) * {w} + {o} AS BIGINT) AS s, first((bid + ask) / 2 ORDER BY us, seq) AS open, max((bid + ask) / 2) AS high, min((bid + ask) / 2) AS low, last((bid + ask) / 2 ORDER BY us, seq) AS close, CAST(count(*) AS DOUBLE) AS volume, avg(ask - bid) AS spread FROM ticks WHERE bid IS NOT NULL AND ask IS NOT NULL GROUP BY 1, 2)"


def longer_cte(name: str, tf: str, source: str = "m1") -> str:
    w, o = TIMEFRAMES[tf]
    return f"{name} AS (SELECT pair, CAST(floor((s - {o}) / {w}) * {w} + {o} AS BIGINT) AS b, arg_min(open, s) AS open, max(high) AS high, min(low) AS low, arg_max(close, s) AS close, sum(volume) AS volume, avg(spread) AS spread, max(s) AS last_s FROM {source} GROUP BY 1, 2)"


def ema_cte(name: str, source: str, column: str, spans: list[int]) -> str:
    """name(pair, s, rn, e_{span}...): a recursion over each pair's bars in order."""
    first = ", ".join(f"{column} AS e_{n}" for n in spans)
    step = ", ".join(f"{2 / (n + 1)!r} * n.{column} + {1 - 2 / (n + 1)!r} * p.e_{n}" for n in spans)
    return f"{name}_n AS (SELECT *, row_number() OVER (PARTITION BY pair ORDER BY s) AS rn FROM {source}), {name} AS (SELECT pair, s, rn, {first} FROM {name}_n WHERE rn = 1 UNION ALL SELECT n.pair, n.s, n.rn, {step} FROM {name} p JOIN {name}_n n ON n.pair = p.pair AND n.rn = p.rn + 1)"


M15 = f"WITH RECURSIVE {TICKS}, {bars_cte('b', 'M15')}"
H1 = f"WITH RECURSIVE {TICKS}, {bars_cte('b', 'H1')}"


def m1(spark, sf_dir):
    return resample.ticks_to_bars(ticks(spark, sf_dir), "M1")


def bars(spark, sf_dir, tf="H1"):
    return resample.ticks_to_bars(ticks(spark, sf_dir), tf)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = signals.ema_cross(bars(spark, sf_dir, "M15"), 5, 20)
    return found.groupBy("pair", "direction").agg(F.count("*").alias("n"), F.avg("entry_price").alias("mean_price"))


# Resampling


@query(f"WITH {TICKS}, {bars_cte('b', 'M1')} SELECT pair, s, {ROUND}, volume FROM b")
def tick_to_m1(spark, sf_dir):
    return rounded(m1(spark, sf_dir), *PRICES)


def _longer(tf):
    sql = f"WITH {TICKS}, {bars_cte('m1', 'M1')}, {longer_cte('b', tf)} SELECT pair, b AS s, {ROUND}, volume FROM b"

    def fn(spark, sf_dir):
        return rounded(resample.longer_bars(m1(spark, sf_dir), tf), *PRICES)

    fn.__name__ = f"bars_{tf.lower()}"
    query(sql)(fn)


for _tf in ("M5", "M15", "M30", "H1", "H4", "D", "W"):
    _longer(_tf)

_FAN = ["M15", "H1", "D", "W"]


@query(f"WITH {TICKS}, {bars_cte('m1', 'M1')}, " + ", ".join(longer_cte(f"b_{t}", t) for t in _FAN) + " " + " UNION ALL ".join(f"SELECT pair, '{t}' AS tf, b AS s, {ROUND}, volume FROM b_{t}" for t in _FAN))
def fanout_all_tf(spark, sf_dir):
    return rounded(resample.fan_out(m1(spark, sf_dir), _FAN), *PRICES)


@query(f"WITH {TICKS}, {bars_cte('m1', 'M1')}, {longer_cte('b', 'H1')} SELECT pair, b AS s, {ROUND}, volume FROM b QUALIFY b < max(b) OVER (PARTITION BY pair) OR last_s >= b + 3540")
def closed_bars_only(spark, sf_dir):
    return rounded(resample.closed_bars(m1(spark, sf_dir), "H1"), *PRICES)


_DAY3, _DAY9 = 1704240000, 1704758399


@query(f"{H1} SELECT pair, count(*) AS n, min(s) AS lo, max(s) AS hi FROM b WHERE s BETWEEN {_DAY3} AND {_DAY9} GROUP BY pair")
def date_clip(spark, sf_dir):
    return resample.clip(bars(spark, sf_dir), _DAY3, _DAY9).groupBy("pair").agg(F.count("*").alias("n"), F.min("s").alias("lo"), F.max("s").alias("hi"))


@query(f"WITH {TICKS}, {bars_cte('m1', 'M1')}, {bars_cte('b', 'H1')}, x AS (SELECT pair, max(lo) AS lo, min(hi) AS hi FROM (SELECT pair, min(s) AS lo, max(s) AS hi FROM b GROUP BY pair UNION ALL SELECT pair, min(s), max(s) FROM m1 GROUP BY pair) GROUP BY pair) SELECT 'main' AS side, b.pair, count(*) AS n FROM b JOIN x ON b.pair = x.pair AND s BETWEEN lo AND hi GROUP BY ALL UNION ALL SELECT 'sub', m1.pair, count(*) FROM m1 JOIN x ON m1.pair = x.pair AND s BETWEEN lo AND hi GROUP BY ALL")
def align_window(spark, sf_dir):
    main, sub = resample.align(bars(spark, sf_dir), m1(spark, sf_dir))
    count = lambda df, side: df.groupBy("pair").agg(F.count("*").alias("n")).select(F.lit(side).alias("side"), "pair", "n")
    return count(main, "main").unionByName(count(sub, "sub"))


@query(f"WITH {TICKS}, {bars_cte('m1', 'M1')}, {bars_cte('b', 'H1')} SELECT b.pair, b.s, count(m1.s) AS n_sub, min(m1.s) AS first_sub, max(m1.s) AS last_sub FROM b LEFT JOIN m1 ON m1.pair = b.pair AND m1.s >= b.s AND m1.s < b.s + 3600 GROUP BY b.pair, b.s")
def main_sub_map(spark, sf_dir):
    sub = resample.map_to_main(m1(spark, sf_dir), "H1").groupBy("pair", "main_s").agg(F.count("*").alias("n_sub"), F.min("s").alias("first_sub"), F.max("s").alias("last_sub"))
    return bars(spark, sf_dir).select("pair", "s").join(sub.withColumnRenamed("main_s", "s"), ["pair", "s"], "left").fillna(0, ["n_sub"])


@query(f"WITH {TICKS} SELECT pair, CAST(hour(make_timestamp(us)) AS INTEGER) AS hour, CAST(isodow(make_timestamp(us)) - 1 AS INTEGER) AS weekday, count(*) AS n FROM ticks GROUP BY ALL")
def hour_weekday(spark, sf_dir):
    return ticks(spark, sf_dir).groupBy("pair", hour_of(F.col("s")).alias("hour"), weekday_of(F.col("s")).alias("weekday")).agg(F.count("*").alias("n"))


# Sources


@query(f"{H1}, n AS (SELECT pair, s, close + 1 AS close FROM b WHERE s % 7200 = 0) SELECT coalesce(n.pair, b.pair) AS pair, coalesce(n.s, b.s) AS s, round(coalesce(n.close, b.close), 8) AS close, CASE WHEN n.pair IS NULL THEN round(b.spread, 8) END AS spread FROM b FULL JOIN n ON b.pair = n.pair AND b.s = n.s")
def upsert_latest(spark, sf_dir):
    old = bars(spark, sf_dir).select("pair", "s", "close", "spread")
    new = old.where("s % 7200 = 0").select("pair", "s", (F.col("close") + 1).alias("close"))
    return rounded(upsert.upsert(old, new, ["pair", "s"]), "close", "spread")


@query(f"WITH {TICKS} SELECT pair, count(*) AS n FROM (SELECT DISTINCT pair, us, bid, ask FROM ticks) GROUP BY pair")
def dedupe_tick_identity(spark, sf_dir):
    t = ticks(spark, sf_dir).select("pair", "us", "bid", "ask")
    return upsert.merge_ticks(t, t.where("us % 2 = 0")).groupBy("pair").agg(F.count("*").alias("n"))


@query(f"WITH {TICKS}, have AS (SELECT DISTINCT s // 86400 AS day FROM ticks WHERE (s // 86400) % 3 <> 0) SELECT CAST(d AS BIGINT) AS day FROM range(19723, 19753) r(d) WHERE d NOT IN (SELECT day FROM have) OR d = 19724")
def except_days(spark, sf_dir):
    have = ticks(spark, sf_dir).select(F.floor(F.col("s") / 86400).alias("day")).where("day % 3 <> 0")
    return upsert.uncovered_days(spark.range(19723, 19753).withColumnRenamed("id", "day"), have, 19724)


@query(f"{H1}, a AS (SELECT pair, s, open + 2e-4 AS o, close + 4e-4 AS c FROM b WHERE s % 10800 = 0) SELECT b.pair, b.s, round(((a.o - b.open) + (a.c - b.close)) / 2, 8) AS spread FROM b LEFT JOIN a ON a.pair = b.pair AND a.s = b.s")
def bid_ask_merge(spark, sf_dir):
    bid = bars(spark, sf_dir)
    ask = bid.where("s % 10800 = 0").select("pair", "s", (F.col("open") + F.lit(2e-4)).alias("open"), (F.col("close") + F.lit(4e-4)).alias("close"))
    return rounded(upsert.with_spread(bid, ask, ["pair", "s"]).select("pair", "s", "spread"), "spread")


@query(f"WITH {TICKS}, {bars_cte('m1', 'M1')}, {longer_cte('h', 'H1')}, a AS (SELECT pair, 'M1' AS tf, s, spread FROM m1 UNION ALL SELECT pair, 'H1', b, spread FROM h) SELECT pair, tf, count(*) AS rows, min(s) AS first_s, max(s) AS last_s, count(spread) > 0 AS has_spread, CASE WHEN count(*) = 0 THEN 'empty' WHEN count(*) < 500 THEN 'thin' ELSE 'ok' END AS status FROM a GROUP BY pair, tf")
def inventory(spark, sf_dir):
    minutes = m1(spark, sf_dir)
    return upsert.inventory(minutes.withColumn("tf", F.lit("M1")).unionByName(resample.longer_bars(minutes, "H1").withColumn("tf", F.lit("H1")).select(*minutes.columns, "tf")))


#: Pairs that stand for the kinds of events.
AS_PAIRS = {"click": "EUR_USD", "view": "GBP_JPY", "purchase": "XAU_USD", "error": "BTC_USD", "signup": "ZAR_PLN"}
_AS_PAIR = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in AS_PAIRS.items()) + " END"


def as_pair(kind):
    return F.create_map(*[F.lit(x) for p in AS_PAIRS.items() for x in p])[kind]


@query(f"SELECT {_AS_PAIR} AS pair, CASE event_type WHEN 'click' THEN 'Majors' WHEN 'view' THEN 'Crosses' WHEN 'purchase' THEN 'Metals' WHEN 'error' THEN 'Crypto' ELSE 'Other' END AS grp, count(*) AS n FROM events GROUP BY ALL")
def intersect_group(spark, sf_dir):
    """Rows of a pair by the group that it is in."""
    rows = table(spark, sf_dir, "events").groupBy(as_pair(F.col("event_type")).alias("pair")).agg(F.count("*").alias("n"))
    return upsert.grouped(rows, upsert.GROUPS)


@query(f"WITH {TICKS}, {bars_cte('m1', 'M1')} SELECT pair, s, {ROUND}, volume FROM m1")
def bar_scan(spark, sf_dir):
    """Bars with names in capitals and times of another zone, as a vendor's file has them."""
    rows = m1(spark, sf_dir)
    told = F.concat(F.date_format(F.timestamp_seconds(F.col("s") + 7200), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+02:00"))
    vendor = rows.withColumn("Timestamp", told).drop("s").withColumnsRenamed({c: c.upper() for c in rows.columns})
    return rounded(upsert.normalised(vendor), *PRICES)


# Health


@query(f"{H1}, d AS (SELECT pair, sum(k - 1) AS dup FROM (SELECT pair, s, count(*) AS k FROM b GROUP BY ALL) GROUP BY pair), c AS (SELECT pair, count(*) AS rows, CAST(0 AS BIGINT) AS nulls, count_if(high < low OR high < open OR high < close OR low > open OR low > close) AS ohlc_violations, count_if(spread < 0) AS negative_spreads, round(avg(CAST(spread <> 0 AS INTEGER)), 8) AS nonzero_spread_share FROM b GROUP BY pair) SELECT c.pair, rows, nulls, CAST(ohlc_violations AS BIGINT) AS ohlc_violations, CAST(negative_spreads AS BIGINT) AS negative_spreads, nonzero_spread_share, CAST(dup AS BIGINT) AS dup_ts, CASE WHEN ohlc_violations > 0 OR negative_spreads > 0 THEN 'fail' WHEN nulls > 0 OR dup > 0 THEN 'warn' ELSE 'ok' END AS status FROM c JOIN d ON c.pair = d.pair")
def health_counts(spark, sf_dir):
    return rounded(health.health_counts(bars(spark, sf_dir)), "nonzero_spread_share")


@query(f"WITH {TICKS}, {bars_cte('b', 'M15')}, g AS (SELECT pair, s, lag(s) OVER (PARTITION BY pair ORDER BY s) AS prev_s FROM b), f AS (SELECT * FROM g WHERE s - prev_s > 1800 AND NOT EXISTS (SELECT 1 FROM range(0, 40) r(k) WHERE prev_s // 86400 + k <= s // 86400 AND isodow(make_timestamp((prev_s // 86400 + k) * 86400000000)) = 6)) SELECT pair, prev_s, s, row_number() OVER (PARTITION BY pair ORDER BY s) AS k, count(*) OVER (PARTITION BY pair) AS n_gaps FROM f QUALIFY k <= 20")
def gap_samples(spark, sf_dir):
    return health.gaps(bars(spark, sf_dir, "M15"), 900).withColumn("k", F.col("k").cast("long"))


# Indicators


@query(f"{H1}, {ema_cte('e', 'b', 'close', [3, 12, 26])} SELECT pair, s, round(e_3, 8) AS ema_3, round(e_12, 8) AS ema_12, round(e_26, 8) AS ema_26 FROM e")
def ema(spark, sf_dir):
    return rounded(indicators.emas(bars(spark, sf_dir).select("pair", "s", "close"), "close", [3, 12, 26]).drop("close"), "ema_3", "ema_12", "ema_26")


_TR = "t AS (SELECT *, greatest(high - low, abs(high - coalesce(lag(close) OVER w, close)), abs(low - coalesce(lag(close) OVER w, close))) AS tr FROM b WINDOW w AS (PARTITION BY pair ORDER BY s))"


@query(f"{H1}, {_TR} SELECT pair, s, round(tr, 8) AS tr FROM t")
def true_range(spark, sf_dir):
    return rounded(indicators.true_range(bars(spark, sf_dir)).select("pair", "s", "tr"), "tr")


@query(f"{H1}, {_TR}, {ema_cte('e', 't', 'tr', [14])} SELECT pair, s, round(e_14, 8) AS atr FROM e")
def atr_ema(spark, sf_dir):
    return rounded(indicators.atr_ema(bars(spark, sf_dir), 14).select("pair", "s", "atr"), "atr")


_MOVES = "mv AS (SELECT pair, s, coalesce(greatest(close - lag(close) OVER w, 0), 0) AS gain, coalesce(greatest(lag(close) OVER w - close, 0), 0) AS loss, close FROM b WINDOW w AS (PARTITION BY pair ORDER BY s))"
_RSI = f"{_MOVES}, {ema_cte('up', 'mv', 'gain', [14])}, {ema_cte('dn', 'mv', 'loss', [14])}, r AS (SELECT up.pair, up.s, CASE WHEN dn.e_14 = 0 THEN 100 ELSE 100 - 100 / (1 + up.e_14 / dn.e_14) END AS rsi FROM up JOIN dn ON up.pair = dn.pair AND up.s = dn.s)"


@query(f"{H1}, {_RSI} SELECT pair, s, round(rsi, 8) AS rsi FROM r")
def rsi(spark, sf_dir):
    return rounded(indicators.rsi(bars(spark, sf_dir), 14).select("pair", "s", "rsi"), "rsi")


_MACD = f"{ema_cte('fs', 'b', 'close', [12, 26])}, ml AS (SELECT pair, s, e_12 - e_26 AS macd FROM fs), {ema_cte('sg', 'ml', 'macd', [9])}"


@query(f"{H1}, {_MACD} SELECT ml.pair, ml.s, round(macd, 8) AS macd, round(e_9, 8) AS macd_signal FROM ml JOIN sg ON ml.pair = sg.pair AND ml.s = sg.s")
def macd(spark, sf_dir):
    return rounded(indicators.macd(bars(spark, sf_dir), 12, 26, 9).select("pair", "s", "macd", "macd_signal"), "macd", "macd_signal")


@query(f"{H1}, {_TR}, a AS (SELECT pair, avg(tr) OVER (PARTITION BY pair ORDER BY s ROWS BETWEEN 13 PRECEDING AND CURRENT ROW) AS m, row_number() OVER (PARTITION BY pair ORDER BY s) AS k FROM t) SELECT pair, round(median(m) FILTER (WHERE k >= 14), 8) AS atr FROM a GROUP BY pair HAVING count(*) >= 19")
def atr_sma_median(spark, sf_dir):
    return rounded(indicators.median_atr(bars(spark, sf_dir)), "atr")


_CHANNEL = "c AS (SELECT pair, s, close, CASE WHEN count(*) OVER w = 20 THEN max(high) OVER w END AS upper, CASE WHEN count(*) OVER w = 20 THEN min(low) OVER w END AS lower FROM b WINDOW w AS (PARTITION BY pair ORDER BY s ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING))"


@query(f"{H1}, {_CHANNEL} SELECT pair, s, round(upper, 8) AS upper, round(lower, 8) AS lower FROM c")
def donchian_channels(spark, sf_dir):
    return rounded(indicators.channels(bars(spark, sf_dir), 20).select("pair", "s", "upper", "lower"), "upper", "lower")


# Signals


def _cross_sql(source: str, f: str, s: str) -> str:
    return f"SELECT pair, s, CAST(CASE WHEN f > g AND f0 <= g0 THEN 1 ELSE -1 END AS INTEGER) AS direction, {EVENTS} FROM (SELECT pair, s, close AS entry_price, {f} AS f, {s} AS g, lag({f}) OVER w AS f0, lag({s}) OVER w AS g0 FROM {source} WINDOW w AS (PARTITION BY pair ORDER BY s)) WHERE (f > g AND f0 <= g0) OR (f < g AND f0 >= g0)"


@query(f"{M15}, {ema_cte('e', 'b', 'close', [5, 20])}, j AS (SELECT b.pair, b.s, close, e_5, e_20 FROM b JOIN e ON b.pair = e.pair AND b.s = e.s) {_cross_sql('j', 'e_5', 'e_20')}")
def ema_cross(spark, sf_dir):
    return rounded(signals.ema_cross(bars(spark, sf_dir, "M15"), 5, 20), "entry_price")


@query(f"{H1}, {_MACD}, j AS (SELECT b.pair, b.s, close, macd, e_9 FROM b JOIN ml ON b.pair = ml.pair AND b.s = ml.s JOIN sg ON b.pair = sg.pair AND b.s = sg.s) {_cross_sql('j', 'macd', 'e_9')}")
def macd_cross(spark, sf_dir):
    return rounded(signals.macd_cross(bars(spark, sf_dir), 12, 26, 9), "entry_price")


@query(f"{H1}, {_CHANNEL}, f AS (SELECT *, coalesce(close > upper, false) AS a, coalesce(close < lower, false) AS z FROM c), g AS (SELECT *, coalesce(lag(a) OVER w, false) AS a0, coalesce(lag(z) OVER w, false) AS z0 FROM f WINDOW w AS (PARTITION BY pair ORDER BY s)) SELECT pair, s, CAST(CASE WHEN a AND NOT a0 THEN 1 ELSE -1 END AS INTEGER) AS direction, round(close, 8) AS entry_price FROM g WHERE (a AND NOT a0) OR (z AND NOT z0)")
def donchian_breakout(spark, sf_dir):
    return rounded(signals.donchian(bars(spark, sf_dir), 20), "entry_price")


@query(f"{H1}, {_RSI}, j AS (SELECT r.pair, r.s, rsi, close, lag(rsi) OVER (PARTITION BY r.pair ORDER BY r.s) AS r0 FROM r JOIN b ON b.pair = r.pair AND b.s = r.s) SELECT pair, s, CAST(CASE WHEN rsi > 45 AND r0 <= 45 THEN 1 ELSE -1 END AS INTEGER) AS direction, round(close, 8) AS entry_price FROM j WHERE (rsi > 45 AND r0 <= 45) OR (rsi < 55 AND r0 >= 55)")
def rsi_reversal(spark, sf_dir):
    return rounded(signals.rsi_reversal(bars(spark, sf_dir), 14, 45.0, 55.0), "entry_price")


@query(f"WITH {TICKS}, h AS (SELECT (s // 3600) % 24 AS h FROM ticks) SELECT CAST(h AS INTEGER) AS hour, CAST(CASE WHEN h BETWEEN 7 AND 12 THEN 1 WHEN h BETWEEN 13 AND 15 THEN 3 WHEN h BETWEEN 16 AND 21 THEN 2 ELSE 0 END AS INTEGER) AS session, CASE WHEN h < 8 THEN 'Asian' WHEN h < 13 THEN 'London' WHEN h < 17 THEN 'Lon-NY' WHEN h < 21 THEN 'NY' ELSE 'Rollover' END AS name, count(*) AS n FROM h GROUP BY ALL")
def session_tag(spark, sf_dir):
    hour = hour_of(F.col("s"))
    return ticks(spark, sf_dir).groupBy(hour.alias("hour"), session_id(hour).alias("session"), session_name(hour).alias("name")).agg(F.count("*").alias("n"))


LIBRARY = {"ema_cross": {"fast": [5, 8, 20], "slow": [20, 30]}, "macd_cross": {"fast": [6], "slow": [13], "signal": [5]}, "donchian": {"lookback": [12, 24, 100_000]}, "rsi_reversal": {"period": [7], "lower": [45.0], "upper": [55.0]}}


@query("SELECT CAST(row_number() OVER (ORDER BY f, s) - 1 AS BIGINT) AS variant_id, f AS fast, s AS slow FROM (SELECT DISTINCT l_linenumber AS f FROM lineitem) a, (SELECT DISTINCT l_linenumber * 2 + 1 AS s FROM lineitem) b WHERE f < s")
def grid_expand(spark, sf_dir):
    """The valid combinations of one family over the values that a column has, with their dense ids."""
    values = sorted(r[0] for r in table(spark, sf_dir, "lineitem").select("l_linenumber").distinct().collect())
    rows = [(v, p["fast"], p["slow"]) for v, _, p in signals.variants_of({"ema_cross": {"fast": values, "slow": [2 * x + 1 for x in values]}})]
    return spark.createDataFrame(rows, "variant_id long, fast int, slow int")


def _library(spark, sf_dir):
    return signals.build_library(bars(spark, sf_dir), LIBRARY)


def _variant_sql(v: int, name: str, p: dict) -> str:
    """Rows (variant_id, pair, s, direction) of one variant, over bars b and the averages that LIBRARY_SQL has."""
    head = f"SELECT {v} AS variant_id, pair, s, "
    crossing = lambda source, f, g: f"{head}CASE WHEN f > g THEN 1 ELSE -1 END AS direction FROM (SELECT pair, s, {f} AS f, {g} AS g, lag({f}) OVER w AS f0, lag({g}) OVER w AS g0 FROM {source} WINDOW w AS (PARTITION BY pair ORDER BY s)) WHERE (f > g AND f0 <= g0) OR (f < g AND f0 >= g0)"
    if name == "ema_cross":
        return crossing("lx", f"e_{p['fast']}", f"e_{p['slow']}")
    if name == "macd_cross":
        return crossing("(SELECT lm.pair, lm.s, macd, e_5 FROM lm JOIN ls ON lm.pair = ls.pair AND lm.s = ls.s)", "macd", "e_5")
    if name == "donchian":
        n = p["lookback"]
        return f"{head}CASE WHEN a AND NOT a0 THEN 1 ELSE -1 END AS direction FROM (SELECT pair, s, a, z, coalesce(lag(a) OVER v, false) AS a0, coalesce(lag(z) OVER v, false) AS z0 FROM (SELECT pair, s, coalesce(count(*) OVER w = {n} AND close > max(high) OVER w, false) AS a, coalesce(count(*) OVER w = {n} AND close < min(low) OVER w, false) AS z FROM b WINDOW w AS (PARTITION BY pair ORDER BY s ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)) WINDOW v AS (PARTITION BY pair ORDER BY s)) WHERE (a AND NOT a0) OR (z AND NOT z0)"
    return f"{head}CASE WHEN r > {p['lower']} AND r0 <= {p['lower']} THEN 1 ELSE -1 END AS direction FROM (SELECT pair, s, rsi AS r, lag(rsi) OVER (PARTITION BY pair ORDER BY s) AS r0 FROM lr) WHERE (r > {p['lower']} AND r0 <= {p['lower']}) OR (r < {p['upper']} AND r0 >= {p['upper']})"


_VARIANTS = signals.variants_of(LIBRARY)
#: b must hold the main bars; gives ls0 (variant_id, pair, s, direction) and la, the smoothed true range.
LIBRARY_SQL = ", ".join([
    ema_cte("lx0", "b", "close", [5, 6, 8, 13, 20, 30]), "lx AS (SELECT * FROM lx0)", "lm AS (SELECT pair, s, e_6 - e_13 AS macd FROM lx)", ema_cte("ls", "lm", "macd", [5]),
    "lv AS (SELECT pair, s, coalesce(greatest(close - lag(close) OVER w, 0), 0) AS gain, coalesce(greatest(lag(close) OVER w - close, 0), 0) AS loss FROM b WINDOW w AS (PARTITION BY pair ORDER BY s))",
    ema_cte("lup", "lv", "gain", [7]), ema_cte("ldn", "lv", "loss", [7]), "lr AS (SELECT lup.pair, lup.s, CASE WHEN ldn.e_7 = 0 THEN 100 ELSE 100 - 100 / (1 + lup.e_7 / ldn.e_7) END AS rsi FROM lup JOIN ldn ON lup.pair = ldn.pair AND lup.s = ldn.s)",
    _TR, ema_cte("la", "t", "tr", [14]), "ls0 AS (" + " UNION ALL ".join(_variant_sql(*v) for v in _VARIANTS) + ")",
])
_NAMED = "vs(variant_id, family, params) AS (VALUES " + ", ".join(f"({v}, '{name}', '{signals.fingerprint(p)}')" for v, name, p in _VARIANTS) + ")"


@query(f"{H1}, {LIBRARY_SQL}, {_NAMED}, n AS (SELECT variant_id, count(*) AS n FROM ls0 GROUP BY 1) SELECT CAST(vs.variant_id AS BIGINT) AS variant_id, family, params, coalesce(n, 0) AS n_signals FROM vs LEFT JOIN n ON vs.variant_id = n.variant_id")
def variant_library(spark, sf_dir):
    return _library(spark, sf_dir)[0]


@query(f"{H1}, {LIBRARY_SQL}, nm AS (SELECT pair, s, close, spread, row_number() OVER (PARTITION BY pair ORDER BY s) AS no FROM b) SELECT CAST(ls0.variant_id AS BIGINT) AS variant_id, CAST(no * {len(_VARIANTS)} + ls0.variant_id AS BIGINT) AS signal_id, nm.pair, nm.s, no, CAST(direction AS INTEGER) AS direction, round(close, 8) AS entry_price, round(e_14 / 1e-4, 6) AS atr_pips, CAST((nm.s // 3600) % 24 AS INTEGER) AS hour, CAST((nm.s // 86400 + 3) % 7 AS INTEGER) AS day, CAST(CASE WHEN (nm.s // 3600) % 24 BETWEEN 7 AND 12 THEN 1 WHEN (nm.s // 3600) % 24 BETWEEN 13 AND 15 THEN 3 WHEN (nm.s // 3600) % 24 BETWEEN 16 AND 21 THEN 2 ELSE 0 END AS INTEGER) AS session, round(nm.spread, 8) AS spread FROM ls0 JOIN nm ON nm.pair = ls0.pair AND nm.s = ls0.s JOIN la ON la.pair = ls0.pair AND la.s = ls0.s")
def library_signals(spark, sf_dir):
    """The signals of all variants, with what a sweep needs of their bar."""
    found = _library(spark, sf_dir)[1].drop("pip")
    return rounded(rounded(found, "entry_price", "spread"), "atr_pips", places=6)


# Filters and prices


def _orders(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    day = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
    return o.select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("pair"), F.when(F.col("o_orderkey") % 2 == 0, 1).otherwise(-1).alias("direction"), (day * 86400 + F.pmod(F.col("o_orderkey") * 7, F.lit(24)) * 3600).alias("s"), F.col("o_totalprice").alias("price"))


ORDERS = "o AS (SELECT o_orderkey AS id, o_orderpriority AS pair, CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE -1 END AS direction, CAST(epoch(CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP)) AS BIGINT) + (o_orderkey * 7) % 24 * 3600 AS s, o_totalprice AS price FROM orders)"
_HOUR, _WDAY = "((s // 3600) % 24)", "((s // 86400 + 3) % 7)"


@query(f"WITH {ORDERS} SELECT pair, count(*) AS n FROM o WHERE ((21 >> CAST({_WDAY} AS INTEGER)) & 1) = 1 AND ({_HOUR} >= 22 OR {_HOUR} <= 6) GROUP BY pair")
def time_filters(spark, sf_dir):
    passes = time_filter(hour_of(F.col("s")), weekday_of(F.col("s")), F.lit(22), F.lit(6), F.lit(21))
    return _orders(spark, sf_dir).where(passes).groupBy("pair").agg(F.count("*").alias("n"))


#: What a trial wants of each of the ten, before rounding.
_WANTED = (0.6, 0.4, 1.0, 0.0, 1.2, -0.4, 0.9, 0.1, 1.4, 0.3)
_TEN = " AND ".join(f"((id // {3**k}) % 3 = 0 OR (id // {3**k}) % 3 - 1 = {round(w + 1e-9)})" for k, w in enumerate(_WANTED))


@query(f"WITH {ORDERS} SELECT pair, count(*) AS n FROM o WHERE {_TEN} AND (CASE WHEN direction = 1 THEN 2 ELSE -1 END = -1 OR id % 4 - 1 = -1 OR id % 4 - 1 = 2) GROUP BY pair")
def pk_filters(spark, sf_dir):
    """All ten filters of a trial, each with signals that opt out, and the value filter of one side."""
    has = [F.floor(F.col("id") / 3**k) % 3 - 1 for k in range(10)]
    keep = pricing.p_filters([F.lit(w) for w in _WANTED], has) & pricing.value_filter(F.col("direction"), (F.col("id") % 4 - 1).cast("double"), F.lit(2.0), F.lit(-1.0))
    return _orders(spark, sf_dir).where(keep).groupBy("pair").agg(F.count("*").alias("n"))


@query(f"{H1} SELECT pair, count(*) AS n FROM b WHERE spread / 1e-4 <= 0.5 GROUP BY pair")
def max_spread_gate(spark, sf_dir):
    return bars(spark, sf_dir).where(pricing.spread_gate(F.col("spread"), F.lit(1e-4), F.lit(0.5))).groupBy("pair").agg(F.count("*").alias("n"))


def _priced(spark, sf_dir):
    o = _orders(spark, sf_dir)
    return o.select("id", "direction", (F.lit(1.0) + F.col("id") % 1000 * F.lit(1e-4)).alias("entry_price"), ((F.col("id") % 17) + 1.0).alias("atr_pips"), F.lit(1e-4).alias("pip"), (F.col("id") % 3).alias("sl_mode"), (F.col("id") % 3).alias("tp_mode"), F.lit(20.0).alias("sl_fixed_pips"), F.lit(1.5).alias("sl_atr_mult"), F.lit(0.5).alias("tp_rr"), F.lit(3.0).alias("tp_atr_mult"), F.lit(40.0).alias("tp_fixed_pips"), F.when(F.col("id") % 4 != 0, F.lit(1.0) + F.col("id") % 1003 * F.lit(1e-4)).alias("swing_sl"))


@query("WITH p AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE -1 END AS d, 1e0 + (o_orderkey % 1000) * 1e-4 AS e, (o_orderkey % 17) + 1e0 AS atr, o_orderkey % 3 AS m, CASE WHEN o_orderkey % 4 <> 0 THEN 1e0 + (o_orderkey % 1003) * 1e-4 END AS sw FROM orders), q AS (SELECT *, CASE m WHEN 0 THEN 20 * 1e-4 WHEN 1 THEN atr * 1e-4 * 1.5 ELSE CASE WHEN sw IS NULL THEN atr * 1e-4 * 1.5 ELSE greatest(abs(e - sw), 5 * 1e-4) END END AS sl FROM p), r AS (SELECT *, greatest(sl, CASE m WHEN 0 THEN sl * 0.5 WHEN 1 THEN atr * 1e-4 * 3 ELSE 40 * 1e-4 END) AS tp FROM q) SELECT id, round(e - d * sl, 8) AS sl_price, round(e + d * tp, 8) AS tp_price, round(sl / 1e-4, 8) AS sl_pips, round(tp / 1e-4, 8) AS tp_pips FROM r")
def sl_tp_prices(spark, sf_dir):
    return rounded(pricing.stops(_priced(spark, sf_dir)).select("id", "sl_price", "tp_price", "sl_pips", "tp_pips"), "sl_price", "tp_price", "sl_pips", "tp_pips")


# Simulation


def _entries(spark, sf_dir):
    b = bars(spark, sf_dir, "M15")
    e = signals.ema_cross(b, 5, 20)
    return b, e.select(F.xxhash64("pair", "s").alias("trade_id"), "pair", "s", "direction", "entry_price", (F.col("entry_price") - F.col("direction") * F.lit(0.004)).alias("sl_price"), (F.col("entry_price") + F.col("direction") * F.lit(0.006)).alias("tp_price"))


_TOUCH = f"{M15}, {ema_cte('em', 'b', 'close', [5, 20])}, j AS (SELECT b.pair, b.s, close, e_5, e_20 FROM b JOIN em ON b.pair = em.pair AND b.s = em.s), sig AS (SELECT pair, s, CASE WHEN f > g AND f0 <= g0 THEN 1 ELSE -1 END AS direction, entry_price FROM (SELECT pair, s, close AS entry_price, e_5 AS f, e_20 AS g, lag(e_5) OVER w AS f0, lag(e_20) OVER w AS g0 FROM j WINDOW w AS (PARTITION BY pair ORDER BY s)) WHERE (f > g AND f0 <= g0) OR (f < g AND f0 >= g0)), en AS (SELECT *, entry_price - direction * 0.004 AS sl, entry_price + direction * 0.006 AS tp FROM sig), hits AS (SELECT en.pair, en.s, arg_min(b.s, b.s) AS xs, arg_min(CASE WHEN (direction = 1 AND low <= sl) OR (direction = -1 AND high >= sl) THEN sl ELSE tp END, b.s) AS xp, arg_min(CASE WHEN (direction = 1 AND low <= sl) OR (direction = -1 AND high >= sl) THEN 'SL' ELSE 'TP' END, b.s) AS xr FROM en JOIN b ON b.pair = en.pair AND b.s >= en.s + 900 WHERE (direction = 1 AND (low <= sl OR high >= tp)) OR (direction = -1 AND (high >= sl OR low <= tp)) GROUP BY en.pair, en.s), fin AS (SELECT pair, max(s) AS ls, arg_max(close, s) AS lc FROM b GROUP BY pair), ex AS (SELECT en.*, coalesce(xs, ls) AS exit_s, coalesce(xp, lc) AS exit_price, coalesce(xr, 'NONE') AS exit_reason FROM en LEFT JOIN hits ON en.pair = hits.pair AND en.s = hits.s JOIN fin ON en.pair = fin.pair)"


@query(_TOUCH + " SELECT pair, s, CAST(direction AS INTEGER) AS direction, exit_s, exit_reason, round(exit_price, 8) AS exit_price FROM ex")
def first_touch_exit(spark, sf_dir):
    b, e = _entries(spark, sf_dir)
    return rounded(simulate.first_touch(e, b, 900).select("pair", "s", "direction", "exit_s", "exit_reason", "exit_price"), "exit_price")


@query(_TOUCH + " SELECT pair, exit_reason, count(*) AS trades, round(sum(direction * (exit_price - entry_price) / 1e-4), 4) AS pips, round(avg(exit_s - s), 4) AS mean_hold_s FROM ex GROUP BY pair, exit_reason")
def batch_eval(spark, sf_dir):
    b, e = _entries(spark, sf_dir)
    done = simulate.first_touch(e, b, 900).withColumn("pips", F.col("direction") * (F.col("exit_price") - F.col("entry_price")) / F.lit(1e-4))
    return done.groupBy("pair", "exit_reason").agg(F.count("*").alias("trades"), F.round(F.sum("pips"), 4).alias("pips"), F.round(F.avg(F.col("exit_s") - F.col("s")), 4).alias("mean_hold_s"))


# Metrics


TRADES = "mt0 AS (SELECT l_suppkey AS trial_id, CASE WHEN l_suppkey % 7 = 3 THEN 0.1e0 ELSE CAST(l_quantity AS DOUBLE) - 25.0e0 + CAST(l_discount AS DOUBLE) * 10.0e0 END AS pnl, 30.0e0 AS sl, 1000.0e0 AS nb, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice, l_discount) AS i FROM lineitem)"
#: Metrics of trials from mt0 (trial_id, i, pnl, sl, nb), down to k with one row a trial.
CURVES = "e1 AS (SELECT *, sum(pnl) OVER w AS eq, sum(CAST(pnl >= 0 AS INTEGER)) OVER w AS island FROM mt0 WINDOW w AS (PARTITION BY trial_id ORDER BY i)), e2 AS (SELECT *, greatest(max(eq) OVER w, 0) AS peak, max(abs(eq)) OVER w AS base, sum(CAST(pnl < 0 AS INTEGER)) OVER (PARTITION BY trial_id, island ORDER BY i) AS streak FROM e1 WINDOW w AS (PARTITION BY trial_id ORDER BY i))"
MEASURED = CURVES + ", a AS (SELECT trial_id, count(*) AS n, sum(pnl) AS total, avg(pnl) AS m, min(pnl) = max(pnl) AS flat, avg(sl) AS sl, max(nb) AS nb, avg(CAST(pnl > 0 AS INTEGER)) AS wr, coalesce(sum(pnl) FILTER (WHERE pnl > 0), 0) AS won, coalesce(-sum(pnl) FILTER (WHERE pnl < 0), 0) AS lost, coalesce(sum(pnl * pnl) FILTER (WHERE pnl < 0), 0) AS nsq, count(*) FILTER (WHERE pnl < 0) AS nn, max(peak - eq) AS mdd, max(base) AS base, sqrt(avg(CASE WHEN base > 0 THEN pow((peak - eq) / base * 100, 2) ELSE 0 END)) AS ulcer, max(streak) AS streak, regr_r2(eq, i) AS r2, regr_slope(eq, i) AS slope, regr_sxx(eq, i) AS sxx, regr_syy(eq, i) AS syy, avg(eq) AS my, avg(i) AS mx, list_sort(list(pnl)) AS l FROM e2 GROUP BY trial_id), dv AS (SELECT e2.trial_id, CASE WHEN flat THEN 0 ELSE pnl - m END AS x, coalesce(eq - my - slope * (i - mx), 0) AS y FROM e2 JOIN a ON a.trial_id = e2.trial_id), c AS (SELECT trial_id, sum(x * x) AS q2, sum(x * x * x) AS q3, sum(x * x * x * x) AS q4, sum(y * y) AS rest FROM dv GROUP BY trial_id), d AS (SELECT a.*, q2 / n AS v, q3 / n AS c3, q4 / n AS c4, CASE WHEN n > 1 THEN sqrt(q2 / (n - 1)) ELSE 0 END AS sd, sqrt(n * 6048.0e0 / nb) AS ann, CASE WHEN lost > 0 THEN won / lost WHEN won > 0 THEN 10 ELSE 0 END AS pf, CASE WHEN nn > 0 THEN m / sqrt(nsq / nn) * sqrt(n * 6048.0e0 / nb) WHEN m > 0 THEN 10 ELSE 0 END AS sortino, rest, CASE WHEN sl > 0 THEN total / sl * 100 ELSE 0 END AS ret FROM a JOIN c ON a.trial_id = c.trial_id), ms AS (SELECT *, sqrt(CASE WHEN rest > 1e-12 * syy THEN rest ELSE 0 END / (n - 2) / sxx) AS err FROM d), k AS (SELECT *, CASE WHEN n > 2 AND err > 0 THEN slope / (err * sqrt(n)) ELSE 0 END AS kr, CASE WHEN sd > 0 THEN m / sd ELSE 0 END AS sr FROM ms)"
MOMENTS = f"{TRADES}, {MEASURED}"


def phi_sql(x: str) -> str:
    u = f"(1 / (1 + 0.3275911 * abs({x}) / sqrt(2)))"
    y = f"(1 - {u} * (0.254829592 + {u} * (-0.284496736 + {u} * (1.421413741 + {u} * (-1.453152027 + {u} * 1.061405429)))) * exp(-{x} * {x} / 2))"
    return f"CASE WHEN {x} >= 0 THEN 0.5 * (1 + {y}) ELSE 0.5 * (1 - {y}) END"


_PLACE = "l[CAST(round((n - 1) * {0}) AS INTEGER) + 1]"
_Z = "(sr * sqrt(n - 1) / sqrt(greatest(1 - CASE WHEN v > 0 THEN c3 / pow(sqrt(v), 3) ELSE 0 END * sr + (CASE WHEN v > 0 THEN c4 / (v * v) ELSE 0 END - 1) / 4 * sr * sr, 1e-12)))"
_QUALITY = "CASE WHEN sortino > 0 THEN ln(1 + sortino) * least(greatest(kr / 3, 0), 1) * least(pf, 5) * (least(n, 300) / 300 * 14.14) / (ulcer + 5) ELSE 0 END"
#: Each metric over k.
METRIC_SQL = {
    "trades": "n", "win_rate": "wr", "profit_factor": "pf", "sharpe": "sr * ann", "sortino": "sortino", "max_dd_pct": "mdd / CASE WHEN base > 0 THEN base ELSE 1 END * 100", "return_pct": "ret",
    "r_squared": "CASE WHEN syy > 0 THEN greatest(coalesce(r2, 0), 0) ELSE 0 END", "ulcer": "ulcer", "quality": _QUALITY, "expectancy_r": "CASE WHEN sl > 0 THEN m / sl ELSE 0 END", "expectancy_pips": "m", "sqn": "sqrt(n) * sr",
    "calmar": "CASE WHEN mdd <> 0 THEN total * 6048.0e0 / nb / mdd ELSE 0 END", "recovery": "CASE WHEN mdd <> 0 THEN total / mdd ELSE 0 END", "upi": "CASE WHEN ulcer <> 0 THEN ret / ulcer ELSE 0 END", "k_ratio": "kr",
    "tail_ratio": f"CASE WHEN n >= 20 AND {_PLACE.format(0.05)} <> 0 THEN abs({_PLACE.format(0.95)}) / abs({_PLACE.format(0.05)}) ELSE 0 END", "omega": "pf", "max_consec_loss": "CAST(streak AS BIGINT)",
    "psr": f"CASE WHEN n >= 4 AND sd > 0 THEN {phi_sql(_Z)} ELSE 0 END", "quality_v2": _QUALITY, "total_pips": "total", "max_dd": "mdd",
}
WHOLE = ("trades", "max_consec_loss")


def metrics_sql(names: list[str], places: int = 8) -> str:
    return ", ".join(f"{METRIC_SQL[c]} AS {c}" if c in WHOLE else f"round({METRIC_SQL[c]}, {places}) AS {c}" for c in names)


def _metric_query(name: str, columns: list[str]):
    def fn(spark, sf_dir):
        df = metrics.trial_metrics(trades(spark, sf_dir)).select("trial_id", *columns)
        return rounded(df, *[c for c, kind in df.dtypes if kind == "double"])

    fn.__name__ = name
    query(f"WITH {MOMENTS} SELECT trial_id, {metrics_sql(columns)} FROM k")(fn)


_metric_query("metrics_core", ["trades", "total_pips", "win_rate", "profit_factor", "sharpe", "sortino", "return_pct", "expectancy_pips", "expectancy_r", "sqn"])
_metric_query("metrics_drawdown", ["max_dd", "max_dd_pct", "ulcer", "calmar", "recovery", "upi"])
_metric_query("metrics_regression", ["r_squared", "k_ratio"])
_metric_query("metrics_tail", ["tail_ratio", "omega"])
_metric_query("metrics_streak", ["max_consec_loss"])
_metric_query("metrics_quality", ["quality", "quality_v2"])
_metric_query("metrics_psr", ["psr"])


# Ranking


def _metrics(spark, sf_dir):
    m = metrics.trial_metrics(trades(spark, sf_dir))
    return rounded(m, *[c for c, kind in m.dtypes if kind == "double"])


_RANKED = f"WITH {MOMENTS}, r AS (SELECT trial_id, n AS trades, round(total, 8) AS total_pips, round(ret, 8) AS return_pct, round(pf, 8) AS profit_factor, round(sr * ann, 8) AS sharpe, round(mdd / CASE WHEN base > 0 THEN base ELSE 1 END * 100, 8) AS max_dd_pct FROM k)"


@query(f"{_RANKED} SELECT trial_id, sharpe FROM r ORDER BY sharpe DESC, return_pct DESC, trades DESC, trial_id LIMIT 1")
def pick_best(spark, sf_dir):
    return ranking.pick_best(_metrics(spark, sf_dir), "sharpe").select("trial_id", "sharpe")


@query(f"{_RANKED}, x AS (SELECT * FROM r WHERE trades >= 40 AND max_dd_pct < 95 OR NOT EXISTS (SELECT 1 FROM r WHERE trades >= 40 AND max_dd_pct < 95)), z AS (SELECT * FROM x WHERE return_pct > 0 OR profit_factor > 1 OR NOT EXISTS (SELECT 1 FROM x WHERE return_pct > 0 OR profit_factor > 1)) SELECT trial_id, max_dd_pct FROM z ORDER BY max_dd_pct, return_pct DESC, trades DESC, trial_id LIMIT 1")
def pick_best_constrained(spark, sf_dir):
    return ranking.pick_best(_metrics(spark, sf_dir), "max_dd_pct", [("trades", ">=", 40), ("max_dd_pct", "<", 95)], profitable=True).select("trial_id", "max_dd_pct")


@query(f"{_RANKED}, u AS (SELECT 'sharpe' AS objective, trial_id, sharpe AS value, sharpe AS o FROM r UNION ALL SELECT 'total_pips', trial_id, total_pips, total_pips FROM r UNION ALL SELECT 'max_dd_pct', trial_id, max_dd_pct, -max_dd_pct FROM r) SELECT objective, trial_id, value, row_number() OVER (PARTITION BY objective ORDER BY o DESC, trial_id) AS rank FROM u QUALIFY rank <= 5")
def topn_per_objective(spark, sf_dir):
    return ranking.top_per_objective(_metrics(spark, sf_dir), ["sharpe", "total_pips", "max_dd_pct"], 5).withColumn("rank", F.col("rank").cast("long"))


@query(f"{_RANKED}, b AS (SELECT trial_id FROM r ORDER BY sharpe DESC, trial_id LIMIT 3) SELECT trial_id, sharpe FROM r WHERE trial_id % (SELECT greatest(ceil(count(*) / 20), 1) FROM r) = 0 OR trial_id IN (SELECT trial_id FROM b)")
def scatter_decimate(spark, sf_dir):
    m = _metrics(spark, sf_dir).select("trial_id", "sharpe")
    best = ranking.retained(ranking.top_per_objective(m, ["sharpe"], 3))
    return ranking.decimate(m, 20, best)


@query(f"WITH {TRADES}, {CURVES} SELECT trial_id, i, round(eq, 8) AS eq, round(peak - eq, 8) AS dd FROM e2")
def equity_curve(spark, sf_dir):
    return rounded(metrics.equity(trades(spark, sf_dir)).select("trial_id", "i", "eq", "dd"), "eq", "dd")


@query(f"{_RANKED} SELECT trial_id, max(sharpe) OVER (ORDER BY trial_id) AS best FROM r")
def running_best(spark, sf_dir):
    """One row per trial, as a plot of a sweep needs."""
    return ranking.running_best(_metrics(spark, sf_dir), "sharpe")


# Costs


_SPREADS = f"WITH {TICKS}, c AS (SELECT pair, CASE WHEN {_HOUR} < 8 THEN 'Asian' WHEN {_HOUR} < 13 THEN 'London' WHEN {_HOUR} < 17 THEN 'Lon-NY' WHEN {_HOUR} < 21 THEN 'NY' ELSE 'Rollover' END AS session, round(avg((ask - bid) / 1e-4), 4) AS spread_pips FROM ticks WHERE ask >= bid GROUP BY ALL)"


@query(f"{_SPREADS} SELECT * FROM c")
def session_spread(spark, sf_dir):
    return cost.session_spreads(ticks(spark, sf_dir))


_FLOORED = f"WITH {TICKS}, f AS (SELECT event_type AS kind, {_AS_PAIR} AS pair FROM (SELECT DISTINCT event_type FROM events)), c AS (SELECT f.pair, CASE WHEN {_HOUR} < 8 THEN 'Asian' WHEN {_HOUR} < 13 THEN 'London' WHEN {_HOUR} < 17 THEN 'Lon-NY' WHEN {_HOUR} < 21 THEN 'NY' ELSE 'Rollover' END AS session, round(avg((ask - bid) * CASE f.pair WHEN 'EUR_USD' THEN 0.2e0 WHEN 'XAU_USD' THEN 0.2e0 ELSE 1e0 END / CASE WHEN contains(f.pair, 'JPY') THEN 1e-2 ELSE 1e-4 END), 4) AS spread_pips FROM ticks JOIN f ON f.kind = ticks.pair WHERE ask >= bid GROUP BY ALL)"


@query(f"{_FLOORED} SELECT * FROM c WHERE pair NOT IN (SELECT pair FROM c WHERE spread_pips < CASE WHEN pair = 'EUR_USD' THEN 0.05 ELSE 0.15 END)")
def session_spread_floors(spark, sf_dir):
    """Spreads by session of pairs with a floor of their own: the majors' is lower, and a pair under its floor in any session is left out whole."""
    t = ticks(spark, sf_dir).withColumn("pair", as_pair(F.col("pair")))
    t = t.withColumn("ask", F.col("bid") + (F.col("ask") - F.col("bid")) * F.when(F.col("pair").isin("EUR_USD", "XAU_USD"), 0.2).otherwise(1.0))
    return cost.session_spreads(t, cost.spread_floor(F.col("pair")))


@query(f"{_SPREADS} SELECT pair, round(0.6 - (avg(spread_pips) + 2 * 0.35 + 2 * 0.5), 4) AS charge_pips FROM c WHERE session IN ('Asian', 'London', 'Lon-NY') GROUP BY pair")
def overlay_charge(spark, sf_dir):
    return rounded(cost.overlay_charge(cost.session_spreads(ticks(spark, sf_dir))), "charge_pips", places=4)


_GATED = f"{ORDERS}, g AS (SELECT id, pair, s, CAST(id % 41 - 20 AS DOUBLE) AS pnl, CASE WHEN {_HOUR} >= 21 THEN 'rollover' WHEN id % 11 = 0 THEN 'unknown_spread' WHEN id % 7 > 3 THEN 'spread_3p' WHEN id % 13 = 0 THEN 'unknown_slippage' WHEN id % 9 > 3 THEN 'slippage_3p' END AS reason FROM o)"


def _gated(spark, sf_dir):
    o = _orders(spark, sf_dir)
    spread = F.when(F.col("id") % 11 != 0, (F.col("id") % 7).cast("double"))
    slip = F.when(F.col("id") % 13 != 0, (F.col("id") % 9).cast("double"))
    return o.select("id", "pair", "s", (F.col("id") % 41 - 20).cast("double").alias("pnl"), cost.gate_reason(hour_of(F.col("s")), spread, slip).alias("reason"))


@query(f"WITH {_GATED} SELECT coalesce(reason, 'pass') AS reason, count(*) AS n, sum(CASE WHEN reason IS NULL THEN pnl ELSE 0 END) AS effective_pnl FROM g GROUP BY 1")
def gate_reason(spark, sf_dir):
    return _gated(spark, sf_dir).groupBy(F.coalesce("reason", F.lit("pass")).alias("reason")).agg(F.count("*").alias("n"), F.sum(F.when(F.col("reason").isNull(), F.col("pnl")).otherwise(0.0)).alias("effective_pnl"))


_COSTS = [(p, s, k / 8) for k, (p, s) in enumerate((p, s) for p in ("1-URGENT", "2-HIGH", "3-MEDIUM") for s in ("Asian", "London", "NY"))]
_COST_SQL = "costs(pair, session, spread_pips) AS (VALUES " + ", ".join(f"('{p}', '{s}', {v}e0)" for p, s, v in _COSTS) + ")"
_NAME = f"CASE WHEN {_HOUR} < 8 THEN 'Asian' WHEN {_HOUR} < 13 THEN 'London' WHEN {_HOUR} < 17 THEN 'Lon-NY' WHEN {_HOUR} < 21 THEN 'NY' ELSE 'Rollover' END"
_OVERLAID = f"WITH {_GATED}, {_COST_SQL}, v AS (SELECT g.*, coalesce(1.0 + 0.6 - (coalesce(c.spread_pips, (SELECT avg(spread_pips) FROM costs x WHERE x.pair = g.pair)) + 2 * 0.25 + 2 * 0.5), 0) AS delta FROM g LEFT JOIN costs c ON c.pair = g.pair AND c.session = {_NAME})"


def _overlaid(spark, sf_dir):
    costs = spark.createDataFrame(_COSTS, "pair string, session string, spread_pips double")
    per = costs.select("pair").distinct().withColumns({"commission_per_side_pips": F.lit(0.25), "slippage_per_side_pips": F.lit(0.5)})
    return cost.overlay(_gated(spark, sf_dir).withColumn("bt_spread_pips", F.lit(1.0)), costs, per)


@query(f"{_OVERLAID} SELECT id, round(delta, 8) AS delta, round(CASE WHEN reason IS NOT NULL THEN 0 ELSE pnl + delta END, 8) AS adjusted_pnl FROM v")
def overlay_apply(spark, sf_dir):
    return rounded(_overlaid(spark, sf_dir).select("id", "delta", "adjusted_pnl"), "delta", "adjusted_pnl")


@query(f"{_OVERLAID} SELECT pair, round(sum(pnl), 4) AS total, round(-sum(CASE WHEN reason IS NOT NULL THEN pnl ELSE 0 END), 4) AS gate_save, round(sum(CASE WHEN reason IS NULL THEN delta ELSE 0 END), 4) AS overhead, round(sum(CASE WHEN reason IS NULL THEN pnl + delta ELSE 0 END), 4) AS adjusted FROM v GROUP BY pair")
def gate_decomposition(spark, sf_dir):
    return rounded(cost.gate_parts(_overlaid(spark, sf_dir)), "total", "gate_save", "overhead", "adjusted", places=4)


@query(f"WITH {TICKS}, f AS (SELECT pair, (ask - bid) * 1e4 AS slip, row_number() OVER (PARTITION BY pair ORDER BY s DESC, seq DESC) AS k FROM ticks WHERE seq % 5 <> 0) SELECT pair, round(median(slip), 4) AS slippage_pips FROM f WHERE k <= 20 GROUP BY pair HAVING count(*) >= 20")
def slippage_telemetry(spark, sf_dir):
    fills = ticks(spark, sf_dir).select("pair", "s", "seq", F.when(F.col("seq") % 5 != 0, (F.col("ask") - F.col("bid")) * 1e4).alias("slippage"))
    return cost.slippage_telemetry(fills)


# Reconciliation


def _sides(spark, sf_dir):
    o, i = _orders(spark, sf_dir), F.col("id")
    told = lambda k, names: F.element_at(F.array(*map(F.lit, names)), (i % k + 1).cast("int"))
    bt = o.select("pair", "direction", F.col("s").alias("signal_s"), i.alias("bt_id"), (1 + i % 100 * 0.001).alias("bt_entry"), (1 + i % 90 * 0.001).alias("bt_exit"), (i % 50).cast("double").alias("bt_pnl"), (i % 11 - 1).alias("bt_variant"), (i % 5 * 0.4).alias("bt_spread"), told(4, ("SL", "TP", "TRAILING", "NONE")).alias("bt_close"))
    live = o.where("id % 10 <> 3").select(
        "pair", "direction", (F.col("s") + F.when(i % 6 == 1, 1800).otherwise(0)).alias("signal_s"), i.alias("live_id"),
        (1 + i % 100 * 0.001 + i % 4 * 0.00015).alias("live_entry"), (1 + i % 90 * 0.001).alias("live_exit"), F.when(i % 8 != 0, i % 50 + i % 3).cast("double").alias("live_pnl"),
        (i % 11 - 1 + F.when(i % 17 == 0, 1).otherwise(0)).alias("live_variant"), F.when(i % 19 != 0, i % 5 * 0.4 + i % 3 * 0.3).alias("live_spread"), F.when(i % 23 != 0, (i % 7 - 3) * 0.5).alias("live_slippage"), told(6, ("SL", "TP", "EXPERT", "", "", "")).alias("live_close"),
    )
    return bt, live


_SIDES = f"{ORDERS}, bt AS (SELECT pair, direction, s AS signal_s, id AS bt_id, 1 + id % 100 * 0.001e0 AS bt_entry, 1 + id % 90 * 0.001e0 AS bt_exit, CAST(id % 50 AS DOUBLE) AS bt_pnl, id % 11 - 1 AS bt_variant, id % 5 * 0.4e0 AS bt_spread, (['SL', 'TP', 'TRAILING', 'NONE'])[id % 4 + 1] AS bt_close FROM o), live AS (SELECT pair, direction, s + CASE WHEN id % 6 = 1 THEN 1800 ELSE 0 END AS signal_s, id AS live_id, 1 + id % 100 * 0.001e0 + id % 4 * 0.00015e0 AS live_entry, 1 + id % 90 * 0.001e0 AS live_exit, CASE WHEN id % 8 <> 0 THEN CAST(id % 50 + id % 3 AS DOUBLE) END AS live_pnl, id % 11 - 1 + CASE WHEN id % 17 = 0 THEN 1 ELSE 0 END AS live_variant, CASE WHEN id % 19 <> 0 THEN id % 5 * 0.4e0 + id % 3 * 0.3e0 END AS live_spread, CASE WHEN id % 23 <> 0 THEN (id % 7 - 3) * 0.5e0 END AS live_slippage, (['SL', 'TP', 'EXPERT', '', '', ''])[id % 6 + 1] AS live_close FROM o WHERE id % 10 <> 3)"


def compared_sql(left: str, right: str, tag: str = "") -> str:
    """CTEs mt, rs and cl{tag}: matches, residuals and deltas of two sides, which have the columns of bt and live."""
    return f"ub{tag} AS (SELECT * FROM {left} QUALIFY row_number() OVER (PARTITION BY pair, direction, signal_s ORDER BY bt_id DESC) = 1), ul{tag} AS (SELECT * FROM {right} QUALIFY row_number() OVER (PARTITION BY pair, direction, signal_s ORDER BY live_id DESC) = 1), mt{tag} AS (SELECT ub{tag}.*, live_id, live_entry, live_exit, live_pnl, live_variant, live_spread, live_slippage, live_close FROM ub{tag} JOIN ul{tag} ON ub{tag}.pair = ul{tag}.pair AND ub{tag}.direction = ul{tag}.direction AND ub{tag}.signal_s = ul{tag}.signal_s), rs{tag} AS (SELECT 'missing' AS side, bt_id AS id, pair FROM {left} WHERE bt_id NOT IN (SELECT bt_id FROM mt{tag}) UNION ALL SELECT 'extra', live_id, pair FROM {right} WHERE live_id NOT IN (SELECT live_id FROM mt{tag})), cl{tag} AS (SELECT *, (live_entry - bt_entry) / 1e-4 * direction AS ed, (live_exit - bt_exit) / 1e-4 * direction AS xd, live_pnl - bt_pnl AS pd, live_spread - bt_spread AS sd FROM mt{tag})"


_SIDES = f"{_SIDES}, {compared_sql('bt', 'live')}"
_CANON = "CASE WHEN {0} IN ('SL', 'TP') THEN {0} ELSE 'OTHER' END"
CATEGORY_SQL = {
    "mismatched_entry_price": "abs(ed) > 2", "mismatched_exit_price": "abs(xd) > 2", "mismatched_pnl": "abs(pd) > 1", "mismatched_signal": "bt_variant >= 0 AND live_variant >= 0 AND bt_variant <> live_variant",
    "mismatched_spread": "abs(sd) > 0.5", "mismatched_slippage": "abs(live_slippage) > 1", "mismatched_closure": f"{_CANON.format('bt_close')} <> {_CANON.format('live_close')}",
}
_CLEAN = " AND ".join(f"NOT coalesce({test}, false)" for test in CATEGORY_SQL.values())


def counts_sql(tag: str = "", head: str = "") -> str:
    flags = " UNION ALL ".join(f"SELECT '{name}' AS c FROM cl{tag} WHERE {test}" for name, test in (*CATEGORY_SQL.items(), ("matched", _CLEAN)))
    return f"SELECT {head}c AS category, count(*) AS n FROM ({flags}) GROUP BY c UNION ALL SELECT {head}'missing_in_live', count_if(side = 'missing') FROM rs{tag} UNION ALL SELECT {head}'extra_in_live', count_if(side = 'extra') FROM rs{tag}"


@query(f"WITH {_SIDES} SELECT pair, CAST(direction AS INTEGER) AS direction, signal_s, bt_id, live_id FROM mt")
def match_exact(spark, sf_dir):
    return reconcile.match_exact(*_sides(spark, sf_dir)).select("pair", "direction", "signal_s", "bt_id", "live_id")


@query(f"WITH {_SIDES}, nr AS (SELECT bt_id, live_id, bt.pair, bt.direction, abs(bt.signal_s - live.signal_s) AS gap FROM bt JOIN live ON bt.pair = live.pair AND bt.direction = live.direction AND abs(bt.signal_s - live.signal_s) <= 3600) SELECT bt_id, live_id, pair, CAST(direction AS INTEGER) AS direction, gap FROM nr QUALIFY row_number() OVER (PARTITION BY bt_id ORDER BY gap, live_id) = 1 AND row_number() OVER (PARTITION BY live_id ORDER BY gap, bt_id) = 1")
def match_fuzzy(spark, sf_dir):
    return reconcile.match_nearest(*_sides(spark, sf_dir), 3600)


@query(f"WITH {_SIDES} SELECT * FROM rs")
def missing_extra(spark, sf_dir):
    bt, live = _sides(spark, sf_dir)
    return reconcile.residuals(bt, live, reconcile.match_exact(bt, live))


@query(f"WITH {_SIDES} SELECT category, CAST(n AS BIGINT) AS n FROM ({counts_sql()})")
def classify(spark, sf_dir):
    bt, live = _sides(spark, sf_dir)
    matched = reconcile.match_exact(bt, live)
    return reconcile.category_counts(reconcile.classify(matched), reconcile.residuals(bt, live, matched))


_FLAGS = ", ".join(f"count_if({test}) AS n_{name}" for name, test in CATEGORY_SQL.items())
_PAIR_COUNTS = ", ".join(f"CAST(coalesce({c}, 0) AS BIGINT) AS {c}" for c in ("matched", "missing_in_live", "extra_in_live", *(f"n_{c}" for c in CATEGORY_SQL)))


@query(f"WITH {_SIDES}, a AS (SELECT pair, count(*) AS matched, sum(coalesce(live_pnl, 0)) AS pl, sum(bt_pnl) AS pb, {_FLAGS}, round(avg(sd), 8) AS mean_spread_delta_pips, round(avg(live_slippage), 8) AS mean_slippage_pips FROM cl GROUP BY pair), b AS (SELECT pair, count_if(side = 'missing') AS missing_in_live, count_if(side = 'extra') AS extra_in_live FROM rs GROUP BY pair) SELECT coalesce(a.pair, b.pair) AS pair, {_PAIR_COUNTS}, coalesce(pl, 0) AS matched_pnl_pips_live, coalesce(pb, 0) AS matched_pnl_pips_bt, coalesce(pl, 0) - coalesce(pb, 0) AS delta_pips, mean_spread_delta_pips, mean_slippage_pips FROM a FULL JOIN b ON a.pair = b.pair")
def by_pair_rollup(spark, sf_dir):
    bt, live = _sides(spark, sf_dir)
    matched = reconcile.match_exact(bt, live)
    return rounded(reconcile.by_pair(reconcile.classify(matched), reconcile.residuals(bt, live, matched)), "mean_spread_delta_pips", "mean_slippage_pips")


@query("WITH d AS (SELECT DISTINCT l_orderkey AS position_id, l_linenumber AS t, l_partkey AS ticket, l_suppkey, l_quantity AS price, l_quantity - 25 AS profit FROM lineitem) SELECT position_id, count(*) AS legs, first(price ORDER BY t, ticket, l_suppkey, price) AS open_price, last(price ORDER BY t, ticket, l_suppkey, price) AS close_price, sum(profit) AS profit FROM d GROUP BY position_id HAVING count(*) >= 2")
def round_trips(spark, sf_dir):
    d = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("position_id"), F.col("l_linenumber").alias("time"), F.struct("l_partkey", "l_suppkey", "l_quantity").alias("ticket"), F.col("l_quantity").alias("price"), (F.col("l_quantity") - 25).alias("profit")).distinct()
    return reconcile.round_trips(d).drop("open_time", "close_time")


@query(f"{H1}, q AS (SELECT seq AS id, pair, s FROM ticks) SELECT id, q.pair, q.s, round(spread, 8) AS spread FROM q ASOF LEFT JOIN b ON q.pair = b.pair AND q.s >= b.s")
def asof_spread(spark, sf_dir):
    probes = ticks(spark, sf_dir).select("pair", "s", F.col("seq").alias("id"))
    return rounded(reconcile.as_of(probes, bars(spark, sf_dir), "spread"), "spread")


# Search space

_SPACE = {"sl": space.IntRange(10, 50, 5), "tp": space.FloatRange(1.0, 3.0), "trail": space.Choice((0, 1)), "gap": ("trail", 1, space.IntRange(5, 20, 5))}


def _u(path: str) -> str:
    return f"(CAST(CAST('0x' || substr(md5('42|' || id || '|{path}'), 1, 8) AS UBIGINT) AS DOUBLE) / 4294967296.0)"


_TRIALS = f"WITH t AS (SELECT CAST(id AS BIGINT) AS trial_id, CAST(10 + 5 * floor({_u('sl')} * 9) AS INTEGER) AS sl, 1.0 + {_u('tp')} * 2.0 AS tp, CAST(floor({_u('trail')} * 2) AS INTEGER) AS trail, CAST(5 + 5 * floor({_u('gap')} * 4) AS INTEGER) AS g FROM (SELECT o_orderkey AS id FROM orders) r)"


def trial_ids(spark, sf_dir):
    """Trials that are numbered by a table."""
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("trial_id"))


@query(f"{_TRIALS} SELECT trial_id, sl, round(tp, 8) AS tp, trail, CASE WHEN trail = 1 THEN g END AS gap FROM t")
def sample_trials(spark, sf_dir):
    return rounded(space.sample(spark, trial_ids(spark, sf_dir), _SPACE, 42), "tp")


@query(f"{_TRIALS} SELECT trial_id, CAST(sl AS DOUBLE) AS sl_fixed_pips, round(tp, 8) AS tp_rr, CAST(CASE WHEN trail = 1 THEN g ELSE 0 END AS DOUBLE) AS trailing_distance FROM t")
def encode_slots(spark, sf_dir):
    return rounded(space.encode(space.sample(spark, trial_ids(spark, sf_dir), _SPACE, 42), {"sl_fixed_pips": ("sl", 0), "tp_rr": ("tp", 0), "trailing_distance": ("gap", 0)}), "tp_rr")


@query("WITH b AS (SELECT CAST(min(l_quantity) AS INTEGER) AS lo, CAST(max(l_quantity) AS INTEGER) AS hi FROM lineitem), v AS (SELECT CAST(unnest(range(lo, hi + 1, 5)) AS INTEGER) AS value FROM b) SELECT value, count(l_orderkey) AS n FROM v LEFT JOIN lineitem ON l_quantity >= value AND l_quantity < value + 5 GROUP BY value")
def expand_leaf(spark, sf_dir):
    """The values of a range that a column spans, with the rows from each to the next."""
    rows = table(spark, sf_dir, "lineitem")
    lo, hi = rows.agg(F.min("l_quantity").cast("int"), F.max("l_quantity").cast("int")).first()
    values = spark.createDataFrame([(v,) for v in space.expand(space.IntRange(lo, hi, 5))], "value int")
    counts = rows.groupBy((F.floor((F.col("l_quantity") - lo) / 5) * 5 + lo).cast("int").alias("value")).agg(F.count("l_orderkey").alias("n"))
    return values.join(counts, "value", "left").fillna(0, ["n"])


@query(f"WITH w AS (SELECT s_suppkey AS id, CASE WHEN s_suppkey % 2 = 0 THEN 'ema_cross' ELSE 'donchian' END AS family, CASE WHEN s_suppkey % 2 = 0 THEN 'fast=' || (s_suppkey % 11) || ',slow=20' ELSE 'lookback=' || (s_suppkey % 5 * 12) END AS params FROM supplier), {_NAMED} SELECT id, w.family, w.params, CAST(variant_id AS BIGINT) AS variant_id FROM w LEFT JOIN vs ON w.family = vs.family AND w.params = vs.params")
def fingerprint_resolve(spark, sf_dir):
    """Names of families and parameters that rows give, to the ids that this library gives them."""
    i = F.col("s_suppkey")
    even = i % 2 == 0
    wanted = table(spark, sf_dir, "supplier").select(i.alias("id"), F.when(even, "ema_cross").otherwise("donchian").alias("family"), F.when(even, F.concat(F.lit("fast="), (i % 11).cast("string"), F.lit(",slow=20"))).otherwise(F.concat(F.lit("lookback="), (i % 5 * 12).cast("string"))).alias("params"))
    return space.resolve_variant(wanted, _library(spark, sf_dir)[0])
