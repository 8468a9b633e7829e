"""Indicators over bars.  Recursive averages of all columns and spans run together; windows over rows go by cells of bounded size."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from chronosweep.functions.lineage import apart
from chronosweep.operators.ordered import in_order


#: Seconds of bars that one task handles at once: no task holds a pair's whole history.
STRETCH = 30 * 86_400


def averages(bars: DataFrame, wanted: dict[str, list[int]]) -> DataFrame:
    """bars with {column}_{span} for columns that have no nulls: y0 = x0, then y = a x + (1 - a) y, a = 2 / (span + 1).

    Over a stretch of n bars the last y is (1 - a)^n times the y before it plus a term of the stretch alone.
    So stretches are summed up side by side, the few sums of a pair give each stretch the y that it starts from,
    and the stretches are run through side by side again.
    """
    lines = [(column, n, f"{column}_{n}") for column, spans in wanted.items() for n in dict.fromkeys(spans)]

    def recur(start: float, x: pd.Series, span: int) -> pd.Series:
        return pd.concat([pd.Series([start]), x], ignore_index=True).ewm(span=span, adjust=False).mean()

    def sum_up(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("s")
        head = {"pair": frame["pair"].iat[0], "stretch": frame["stretch"].iat[0], "n": len(frame)} | {f"first_{c}": frame[c].iat[0] for c in wanted}
        return pd.DataFrame([head | {name: recur(0.0, frame[c], n).iat[-1] for c, n, name in lines}])

    def starts(sums: pd.DataFrame) -> pd.DataFrame:
        sums = sums.sort_values("stretch")
        out = {"pair": sums["pair"], "stretch": sums["stretch"]}
        for column, n, name in lines:
            keep, y, found = 1 - 2 / (n + 1), sums[f"first_{column}"].iat[0], []
            for rows, own in zip(sums["n"], sums[name], strict=True):
                found.append(y)
                y = keep**rows * y + own
            out[name] = found
        return pd.DataFrame(out)

    def run(frame: pd.DataFrame, start: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("s").reset_index(drop=True)
        return frame.drop(columns="stretch").assign(**{name: recur(start[name].iat[0], frame[c], n).iloc[1:].to_numpy() for c, n, name in lines})

    doubles = ", ".join(f"{name} double" for *_, name in lines)
    firsts = ", ".join(f"first_{c} double" for c in wanted)
    cut = bars.withColumn("stretch", F.floor(F.col("s") / STRETCH))
    sums = apart(cut.select("pair", "stretch", "s", *wanted), "pair", "stretch").groupBy("pair", "stretch").applyInPandas(sum_up, f"pair string, stretch long, n long, {firsts}, {doubles}")
    begun = sums.groupBy("pair").applyInPandas(starts, f"pair string, stretch long, {doubles}")
    begun = begun.select(F.col("pair").alias("of"), F.col("stretch").alias("at"), *[name for *_, name in lines])
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in bars.schema.fields)
    return apart(cut, "pair", "stretch").groupBy("pair", "stretch").cogroup(apart(begun, "of", "at").groupBy("of", "at")).applyInPandas(run, f"{fields}, {doubles}")


def emas(bars: DataFrame, column: str, spans: list[int]) -> DataFrame:
    """bars with ema_{span} of a column."""
    return averages(bars, {column: spans}).withColumnsRenamed({f"{column}_{n}": f"ema_{n}" for n in spans})


def _true_range(before: Column) -> Column:
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))


def true_range(bars: DataFrame) -> DataFrame:
    def make(df: DataFrame, w: WindowSpec) -> DataFrame:
        return df.withColumn("tr", _true_range(F.coalesce(F.lag("close").over(w), F.col("close"))))

    return in_order(bars, 1, make)


def atr_ema(bars: DataFrame, period: int) -> DataFrame:
    return emas(true_range(bars), "tr", [period]).withColumnRenamed(f"ema_{period}", "atr")


def moves(bars: DataFrame) -> DataFrame:
    """bars with tr, the true range, and gain and loss: how far the close went up or down since the bar before."""

    def make(df: DataFrame, w: WindowSpec) -> DataFrame:
        before = F.lag("close").over(w)
        step = F.col("close") - before
        up, down = (F.coalesce(F.greatest(x, F.lit(0.0)), F.lit(0.0)) for x in (step, -step))
        return df.withColumns({"tr": _true_range(F.coalesce(before, F.col("close"))), "gain": up, "loss": down})

    return in_order(bars, 1, make)


def strength(up: str, down: str) -> Column:
    """Relative strength from mean gains and losses: 100 where there is no loss."""
    return F.when(F.col(down) == 0, 100.0).otherwise(100 - 100 / (1 + F.try_divide(up, down)))


def rsi(bars: DataFrame, period: int) -> DataFrame:
    both = averages(moves(bars), {"gain": [period], "loss": [period]})
    up, down = f"gain_{period}", f"loss_{period}"
    return both.withColumn("rsi", strength(up, down)).drop("tr", "gain", "loss", up, down)


def macd(bars: DataFrame, fast: int, slow: int, signal: int) -> DataFrame:
    line = emas(bars, "close", [fast, slow]).withColumn("macd", F.col(f"ema_{fast}") - F.col(f"ema_{slow}")).drop(f"ema_{fast}", f"ema_{slow}")
    return emas(line, "macd", [signal]).withColumnRenamed(f"ema_{signal}", "macd_signal")


def channel(w: WindowSpec, lookback: int) -> tuple[Column, Column]:
    """Highest high and lowest low of the bars before, once there are `lookback` of them."""
    w = w.rowsBetween(-lookback, -1)
    full = F.count("*").over(w) == lookback
    return F.when(full, F.max("high").over(w)), F.when(full, F.min("low").over(w))


def channels(bars: DataFrame, lookback: int) -> DataFrame:
    def make(df: DataFrame, w: WindowSpec) -> DataFrame:
        upper, lower = channel(w, lookback)
        return df.withColumn("upper", upper).withColumn("lower", lower)

    return in_order(bars, lookback, make)


def median_atr(bars: DataFrame, window: int = 14, least: int = 19) -> DataFrame:
    """Median over time of the mean true range of `window` bars; pairs of fewer than `least` bars have none."""
    ranges = in_order(true_range(bars), window, lambda df, w: df.withColumn("k", F.col("rn")).withColumn("mean", F.avg("tr").over(w.rowsBetween(1 - window, 0))))
    return ranges.groupBy("pair").agg(F.count("*").alias("n"), F.median(F.when(F.col("k") >= window, F.col("mean"))).alias("atr")).where(F.col("n") >= least).select("pair", "atr")
