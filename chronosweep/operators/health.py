"""Quality checks of bar tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronosweep.operators.ordered import in_order


def health_counts(bars: DataFrame) -> DataFrame:
    """By pair: nulls, violations of the order of open, high, low and close, repeated times, bad spreads, and a status."""
    repeated = bars.groupBy("pair", "s").agg(F.count("*").alias("k")).groupBy("pair").agg(F.sum(F.col("k") - 1).alias("dup_ts"))
    broken = F.count_if((F.col("high") < F.col("low")) | (F.col("high") < F.col("open")) | (F.col("high") < F.col("close")) | (F.col("low") > F.col("open")) | (F.col("low") > F.col("close")))
    nulls = sum((F.count_if(F.col(c).isNull()) for c in ("open", "high", "low", "close")), F.lit(0))
    counts = bars.groupBy("pair").agg(F.count("*").alias("rows"), nulls.cast("long").alias("nulls"), broken.alias("ohlc_violations"), F.count_if(F.col("spread") < 0).alias("negative_spreads"), F.avg((F.col("spread") != 0).cast("double")).alias("nonzero_spread_share"))
    out = counts.join(repeated, "pair")
    return out.withColumn("status", F.when((F.col("ohlc_violations") > 0) | (F.col("negative_spreads") > 0), "fail").when((F.col("nulls") > 0) | (F.col("dup_ts") > 0), "warn").otherwise("ok"))


def gaps(bars: DataFrame, width: int, most: int = 20) -> DataFrame:
    """The first gaps of each pair: longer than two bars and not over a Saturday, with the number of all gaps."""
    w = Window.partitionBy("pair").orderBy("s")
    before = in_order(bars.select("pair", "s"), 1, lambda df, by: df.withColumn("prev_s", F.lag("s").over(by)))
    day = F.floor(F.col("prev_s") / 86400)
    # days from the day of prev_s to the next Saturday, itself included; the epoch was a Thursday
    saturday = day + F.pmod(F.lit(2) - F.pmod(day, F.lit(7)), F.lit(7))
    found = before.where((F.col("s") - F.col("prev_s") > 2 * width) & ~(saturday <= F.floor(F.col("s") / 86400)))
    # the bound on k holds in each task before the shuffle
    first = found.select("pair", "prev_s", "s", F.row_number().over(w).alias("k")).where(F.col("k") <= most)
    return first.join(found.groupBy("pair").agg(F.count("*").alias("n_gaps")), "pair")
