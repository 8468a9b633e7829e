"""Files: compressed binary ticks and candles, logs of JSON lines, trade exports, and the tables of a run."""

from __future__ import annotations

import lzma
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The records' layouts, big-endian.
TICK = np.dtype([("ms", ">u4"), ("ask", ">u4"), ("bid", ">u4"), ("ask_volume", ">f4"), ("bid_volume", ">f4")])
CANDLE = np.dtype([("sec", ">u4"), ("open", ">u4"), ("close", ">u4"), ("low", ">u4"), ("high", ">u4"), ("volume", ">f4")])


def decode(data: bytes, layout: np.dtype) -> np.ndarray:
    """Records of one file; an empty file has none, a cut-off last record is ignored."""
    raw = lzma.decompress(data) if data else b""
    return np.frombuffer(raw, layout, len(raw) // layout.itemsize)


def _read(spark: SparkSession, path: str, layout: np.dtype, columns: dict[str, tuple[str, float]], schema: str) -> DataFrame:
    """Every file below a path through its layout; columns: name -> (field, what to divide it by)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, content in zip(frame["path"], frame["content"], strict=True):
                r = decode(content, layout)
                yield pd.DataFrame({"path": [name] * len(r)} | {c: r[field].astype("i8" if by is None else "f8") / (by or 1) for c, (field, by) in columns.items()}).astype({c: "i8" for c, (_, by) in columns.items() if by is None})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, f"path string, {schema}")


def read_ticks(spark: SparkSession, path: str, scale: float = 1e5) -> DataFrame:
    """path, ms from the file's hour, bid, ask and volumes of every file below a path."""
    columns = {"ms": ("ms", None), "bid": ("bid", scale), "ask": ("ask", scale), "bid_volume": ("bid_volume", 1.0), "ask_volume": ("ask_volume", 1.0)}
    return _read(spark, path, TICK, columns, "ms long, bid double, ask double, bid_volume double, ask_volume double")


def read_candles(spark: SparkSession, path: str, scale: float = 1e5) -> DataFrame:
    """path, sec from the file's day, open, high, low, close and volume of every file below a path."""
    columns = {"sec": ("sec", None)} | {c: (c, scale) for c in ("open", "high", "low", "close")} | {"volume": ("volume", 1.0)}
    return _read(spark, path, CANDLE, columns, "sec long, open double, high double, low double, close double, volume double")


# How a path tells its pair, day and hour; months count from 00.
PLACE = r"([A-Za-z]{6})/(\d{4})/(\d{2})/(\d{2})/(?:(\d{2})h_)?[^/]*$"


def with_place(rows: DataFrame) -> DataFrame:
    """Rows of files with pair (A_B) and s, the epoch second of the file's hour, or day, as their path tells; null where it doesn't."""
    part = lambda k: F.nullif(F.regexp_extract("path", PLACE, k), F.lit(""))
    month = F.lpad((part(3).cast("int") + 1).cast("string"), 2, "0")
    day = F.to_date(F.concat_ws("-", part(2), month, part(4)))
    start = F.datediff(day, F.lit("1970-01-01").cast("date")).cast("long") * 86_400 + F.coalesce(part(5).cast("long"), F.lit(0)) * 3600
    name = F.upper(part(1))
    return rows.withColumn("pair", F.concat_ws("_", F.substring(name, 1, 3), F.substring(name, 4, 3))).withColumn("s", F.when(part(1).isNotNull(), start))


def scaled(rows: DataFrame, columns: list[str], read_at: float = 1e5, yen: float = 1e3) -> DataFrame:
    """Prices of pairs against the yen, which files hold in thousandths, brought to their scale."""
    is_yen = F.col("pair").endswith("JPY")
    return rows.withColumns({c: F.when(is_yen, F.col(c) * (read_at / yen)).otherwise(F.col(c)) for c in columns})


def located_ticks(spark: SparkSession, path: str) -> DataFrame:
    """pair, s, us, bid, ask and volumes of every file of ticks below a path, with pair and hour from the file's path."""
    rows = scaled(with_place(read_ticks(spark, path)), ["bid", "ask"])
    us = F.col("s") * 1_000_000 + F.col("ms") * 1000
    return rows.select("pair", F.floor(us / 1_000_000).alias("s"), us.alias("us"), "bid", "ask", "bid_volume", "ask_volume")


def located_candles(spark: SparkSession, path: str) -> DataFrame:
    """pair, s, open, high, low, close and volume of every file of candles below a path, with pair and day from the file's path."""
    rows = scaled(with_place(read_candles(spark, path)), ["open", "high", "low", "close"])
    return rows.select("pair", (F.col("s") + F.col("sec")).alias("s"), "open", "high", "low", "close", "volume")


def read_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a log of JSON lines; lines that aren't JSON, empty ones and a byte order mark are passed over."""
    lines = spark.read.text(path).select(F.regexp_replace(F.trim("value"), "^\ufeff", "").alias("v")).where("v <> ''")
    parsed = lines.select(F.from_json("v", f"{schema}, _bad string", {"columnNameOfCorruptRecord": "_bad"}).alias("r"))
    return parsed.select("r.*").where("_bad is null").drop("_bad")


def append_log(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def export_trades(trades: DataFrame, path: str) -> None:
    """CSV with a header and ISO times for the columns entry_s and exit_s."""
    iso = {c: F.date_format(F.timestamp_seconds(c), "yyyy-MM-dd'T'HH:mm:ss'Z'") for c in ("entry_s", "exit_s") if c in trades.columns}
    trades.withColumns(iso).write.mode("overwrite").option("header", True).csv(path)


def import_trades(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.option("header", True).schema(schema).csv(path)


def write_run(path: str, **tables: DataFrame) -> None:
    """A run's tables below one folder; Spark's commit leaves each either whole or absent."""
    for name, table in tables.items():
        table.write.mode("overwrite").parquet(f"{path}/{name}")


def read_run(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{name}")


def write_lean(path: str, metrics: DataFrame, retained: DataFrame, chunk: int) -> None:
    """What a long run leaves: all metrics by chunks of trials, and the trials that are kept whole."""
    metrics.withColumn("chunk", F.floor(F.col("trial_id") / chunk)).write.mode("overwrite").partitionBy("chunk").parquet(f"{path}/metrics")
    retained.write.mode("overwrite").parquet(f"{path}/retained")
