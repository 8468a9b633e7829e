"""Idempotent merges of stored and new rows, inventories and calendars."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronosweep.functions.exprs import hour_of, weekday_of


def normalised(rows: DataFrame, time: str = "timestamp") -> DataFrame:
    """rows with names in lower case and s, the epoch second of their time column: a timestamp, ISO text with or without an offset (UTC), or a number of seconds.

    Two columns that differ in case only can't both stay: that raises.
    """
    names = [c.lower() for c in rows.columns]
    if len(set(names)) < len(names):
        raise ValueError(f"columns differ in case only: {rows.columns}")
    out = rows.toDF(*names)
    kind = dict(out.dtypes)[time]
    at = F.col(time)
    if kind == "string":
        at = F.unix_seconds(F.coalesce(*[F.try_to_timestamp(F.concat(at, F.lit(tail)), F.lit(f"yyyy-MM-dd{mark}HH:mm:ss[.SSSSSS]XXX")) for tail in ("", "Z") for mark in ("'T'", " ")]))
    elif kind.startswith("timestamp"):
        at = F.unix_seconds(at.cast("timestamp"))
    return out.withColumn("s", at.cast("long")).drop(*({time} - {"s"}))


def upsert(stored: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows by key, the new side winning; columns that one side lacks are null.  One shuffle on the keys, with partial aggregation."""
    both = stored.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    rest = [c for c in both.columns if c not in (*keys, "_new")]
    best = both.groupBy(*keys).agg(F.max(F.struct("_new", *rest)).alias("r"))
    return best.select(*keys, *[F.col(f"r.{c}").alias(c) for c in rest])


def merge_ticks(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Ticks are the same only if all their columns are: several quotes of one moment stay."""
    return stored.unionByName(new).dropDuplicates()


def uncovered_days(requested: DataFrame, stored: DataFrame, today: int) -> DataFrame:
    """Days to fetch: those requested and not stored, and today always."""
    return requested.join(stored.select("day").distinct(), "day", "left_anti").unionByName(requested.where(F.col("day") == today)).distinct()


def with_spread(bid: DataFrame, ask: DataFrame, keys: list[str]) -> DataFrame:
    """Bid bars with the mean of the open and the close spread, from ask bars of the same keys."""
    side = ask.select(*keys, F.col("open").alias("_o"), F.col("close").alias("_c"))
    joined = bid.drop("spread").join(side, keys, "left")
    return joined.withColumn("spread", ((F.col("_o") - F.col("open")) + (F.col("_c") - F.col("close"))) / 2).drop("_o", "_c")


def inventory(bars: DataFrame) -> DataFrame:
    """Rows, range and status of each pair and timeframe."""
    out = bars.groupBy("pair", "tf").agg(F.count("*").alias("rows"), F.min("s").alias("first_s"), F.max("s").alias("last_s"), (F.count("spread") > 0).alias("has_spread"))
    return out.withColumn("status", F.when(F.col("rows") == 0, "empty").when(F.col("rows") < 500, "thin").otherwise("ok"))


def inventory_by_pair(held: DataFrame) -> DataFrame:
    """Timeframes, rows and the range of days that a pair has, from an inventory."""
    day = lambda c: F.floor(F.col(c) / 86_400)
    return held.groupBy("pair").agg(F.array_sort(F.collect_set("tf")).alias("tfs"), F.sum("rows").alias("rows"), F.min(day("first_s")).alias("first_day"), F.max(day("last_s")).alias("last_day"))


def first_source(*sources: DataFrame) -> DataFrame:
    """Bars of several sources, the best first: of each pair and bar the best source that has it, with its place as `source`."""
    ranked = None
    for k, rows in enumerate(sources):
        part = rows.withColumn("source", F.lit(k))
        ranked = part if ranked is None else ranked.unionByName(part, allowMissingColumns=True)
    rest = [c for c in ranked.columns if c not in ("pair", "s", "source")]
    return ranked.groupBy("pair", "s").agg(F.min(F.struct("source", *rest)).alias("r")).select("pair", "s", "r.*")


def from_broker(rows: DataFrame, offset_s: int, point: float) -> DataFrame:
    """Rows in UTC and in prices, from a broker's clock and spreads in points."""
    return rows.withColumn("s", F.col("s") - offset_s).withColumn("spread", F.col("spread") * F.lit(point))


def trading_hours(spark: SparkSession, start_s: int, end_s: int) -> DataFrame:
    """hour_s from start to end, both inclusive, while markets are open: not on Saturday, on Sunday from 21 o'clock."""
    hours = spark.range(start_s, end_s + 1, 3600).withColumnRenamed("id", "hour_s")
    day = weekday_of(F.col("hour_s"))
    return hours.where((day < 5) | ((day == 6) & (hour_of(F.col("hour_s")) >= 21)))


# Groups of pairs.
GROUPS = {
    "Majors": ["EUR_USD", "GBP_USD", "USD_JPY", "USD_CHF", "AUD_USD", "USD_CAD", "NZD_USD"],
    "Crosses": ["EUR_GBP", "EUR_JPY", "EUR_CHF", "EUR_AUD", "EUR_CAD", "EUR_NZD", "GBP_JPY", "GBP_CHF", "GBP_AUD", "GBP_CAD", "GBP_NZD", "AUD_JPY", "AUD_CHF", "AUD_CAD", "AUD_NZD", "NZD_JPY", "NZD_CHF", "NZD_CAD", "CAD_JPY", "CAD_CHF", "CHF_JPY"],
    "Metals": ["XAU_USD", "XAG_USD", "XAU_EUR", "XPT_USD", "XPD_USD"],
    "Indices": ["SPX500_USD", "NAS100_USD", "US30_USD", "UK100_GBP", "DE30_EUR", "JP225_USD"],
    "Crypto": ["BTC_USD", "ETH_USD", "LTC_USD", "XRP_USD"],
}


def grouped(pairs: DataFrame, groups: dict[str, list[str]]) -> DataFrame:
    """pairs with the group of each, `Other` for those in none."""
    name = F.lit("Other")
    for group, members in groups.items():
        name = F.when(F.col("pair").isin(members), group).otherwise(name)
    return pairs.withColumn("grp", name)
