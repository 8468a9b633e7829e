"""Ticks to bars, bars to longer bars."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronosweep.functions.exprs import TIMEFRAMES, bucket, weekday_of


def ticks_to_bars(ticks: DataFrame, tf: str = "M1") -> DataFrame:
    """pair, s, open, high, low, close, volume, spread (mean).  Ticks without a bid or an ask are left out.

    Volume is the sum of both sides' volumes where ticks have them, else the number of ticks.
    """
    mid, at = (F.col("bid") + F.col("ask")) / 2, F.struct("us", "seq")
    traded = F.col("bid_volume") + F.col("ask_volume") if {"bid_volume", "ask_volume"} <= set(ticks.columns) else F.lit(1.0)
    rows = ticks.where("bid is not null and ask is not null").select("pair", bucket(F.col("s"), *TIMEFRAMES[tf]).alias("b"), "us", "seq", mid.alias("mid"), (F.col("ask") - F.col("bid")).alias("sp"), traded.cast("double").alias("v"))
    return rows.groupBy("pair", F.col("b").alias("s")).agg(F.min_by("mid", at).alias("open"), F.max("mid").alias("high"), F.min("mid").alias("low"), F.max_by("mid", at).alias("close"), F.sum("v").alias("volume"), F.avg("sp").alias("spread"))


def _ohlc() -> list[Column]:
    return [F.min_by("open", "s").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "s").alias("close"), F.sum("volume").alias("volume"), F.avg("spread").alias("spread")]


def side_bars(ticks: DataFrame, side: str) -> DataFrame:
    """Minute bars of one side's quotes, with no volume, on weekdays."""
    at = F.struct("us", "seq")
    rows = ticks.where(F.col(side).isNotNull() & (weekday_of(F.col("s")) < 5)).select("pair", bucket(F.col("s"), 60).alias("b"), "us", "seq", F.col(side).alias("p"))
    return rows.groupBy("pair", F.col("b").alias("s")).agg(F.min_by("p", at).alias("open"), F.max("p").alias("high"), F.min("p").alias("low"), F.max_by("p", at).alias("close")).withColumn("volume", F.lit(0.0))


def longer_bars(bars: DataFrame, tf: str) -> DataFrame:
    return bars.withColumn("b", bucket(F.col("s"), *TIMEFRAMES[tf])).groupBy("pair", "b").agg(*_ohlc()).withColumnRenamed("b", "s")


def fan_out(bars: DataFrame, targets: list[str], source: str = "M1") -> DataFrame:
    """All longer timeframes from one pass over the bars and one shuffle; the bars' own timeframe is passed over."""
    unknown = set(targets) - set(TIMEFRAMES)
    if unknown:
        raise ValueError(f"unknown timeframes {sorted(unknown)}")
    targets = [t for t in targets if t != source]
    places = F.array(*[F.struct(F.lit(t).alias("tf"), bucket(F.col("s"), *TIMEFRAMES[t]).alias("b")) for t in targets])
    return bars.withColumn("p", F.explode(places)).groupBy("pair", F.col("p.tf").alias("tf"), F.col("p.b").alias("b")).agg(*_ohlc()).withColumnRenamed("b", "s")


def closed_bars(minutes: DataFrame, tf: str) -> DataFrame:
    """Longer bars without a pair's last one while its last minute is missing."""
    width = TIMEFRAMES[tf][0]
    whole = minutes.dropna().withColumn("b", bucket(F.col("s"), *TIMEFRAMES[tf])).groupBy("pair", "b").agg(*_ohlc(), F.max("s").alias("_last")).withColumnRenamed("b", "s")
    newest = whole.join(whole.groupBy("pair").agg(F.max("s").alias("_newest")), "pair")
    return newest.where((F.col("s") < F.col("_newest")) | (F.col("_last") >= F.col("s") + width - 60)).drop("_last", "_newest")


def moment(at: int | str | None, end: bool = False) -> int | None:
    """Epoch seconds of a time; ISO text without a zone is UTC, an empty one no bound, and a bare date as an end is its last second."""
    if at is None or at == "" or isinstance(at, int):
        return None if at == "" else at
    when = dt.datetime.fromisoformat(at)
    when = when.replace(tzinfo=dt.UTC) if when.tzinfo is None else when
    return int(when.timestamp()) + (86_399 if end and len(at) == 10 else 0)


def clip(bars: DataFrame, start: int | str | None, end: int | str | None) -> DataFrame:
    """Bars from start to end, both inclusive; None is no bound."""
    start, end = moment(start), moment(end, True)
    if start is not None:
        bars = bars.where(F.col("s") >= start)
    return bars if end is None else bars.where(F.col("s") <= end)


def align(main: DataFrame, sub: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables cut to the time, by pair, that both cover."""
    span = lambda df, p: df.groupBy("pair").agg(F.min("s").alias(f"{p}_lo"), F.max("s").alias(f"{p}_hi"))
    both = span(main, "m").join(span(sub, "u"), "pair").select("pair", F.greatest("m_lo", "u_lo").alias("_lo"), F.least("m_hi", "u_hi").alias("_hi"))
    cut = lambda df: df.join(both, "pair").where("s between _lo and _hi").drop("_lo", "_hi")
    return cut(main), cut(sub)


def map_to_main(sub: DataFrame, tf: str) -> DataFrame:
    """Sub bars with the start of the main bar that holds them: an equality on the bucket in place of a range join."""
    return sub.withColumn("main_s", bucket(F.col("s"), *TIMEFRAMES[tf]))
