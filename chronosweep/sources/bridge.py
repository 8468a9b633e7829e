"""The driver's tables read as ticks and trades."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pair, s (epoch seconds), us (epoch microseconds), bid, ask, seq."""
    e = table(spark, sf_dir, "events")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    bid = F.lit(1.1) + F.col("value") * F.lit(1e-4)
    k = F.regexp_extract("props", r"(\d+)", 1).cast("double")
    return e.select(F.col("event_type").alias("pair"), F.floor(us / 1_000_000).alias("s"), us.alias("us"), bid.alias("bid"), (bid + (k + 1) * F.lit(1e-6)).alias("ask"), F.col("event_id").alias("seq"))


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """trial_id, pnl, and i: the trade's place in its trial, from 1.  Every line item is a trade; some trials have equal ones only."""
    keys = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_discount"]
    place = F.expr(f"row_number() over (partition by l_suppkey order by {', '.join(keys)})")
    pnl = F.when(F.col("l_suppkey") % 7 == 3, F.lit(0.1)).otherwise(F.col("l_quantity").cast("double") - 25.0 + F.col("l_discount").cast("double") * 10.0)
    return table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("trial_id"), pnl.alias("pnl"), place.cast("long").alias("i"))
