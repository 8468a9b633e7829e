"""Tables of past runs: appending, deleting, learning rates from them, and comparing with a baseline."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def append_runs(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Both tables' rows; a column that one lacks is null there, and rows without a strategy are the baseline's."""
    both = stored.unionByName(new, allowMissingColumns=True)
    return both.withColumn("strategy", F.coalesce("strategy", F.lit("baseline")))


def delete_runs(stored: DataFrame, run_ids: DataFrame) -> DataFrame:
    return stored.join(run_ids.select("run_id"), "run_id", "left_anti")


def learn_rates(runs: DataFrame, last: int = 10, overhead_s: float = 3.0) -> DataFrame:
    """Medians, over the newest runs, of seconds to build a variant and of trials a second.  runs: n, n_trials, trials_per_s, runtime_s, n_variants."""
    newest = runs.orderBy(F.desc("n")).limit(last).where("n_trials > 0 and trials_per_s > 0 and runtime_s > 0 and n_variants > 0")
    build = F.greatest(F.col("runtime_s") - F.col("n_trials") / F.col("trials_per_s") - overhead_s, F.lit(0.0)) / F.col("n_variants")
    return newest.withColumn("b", build).agg(F.median(F.when((F.col("b") > 0) & (F.col("b") < 10), F.col("b"))).alias("per_variant_s"), F.median("trials_per_s").alias("trials_per_s"))


def baseline_delta(new: DataFrame, base: DataFrame) -> DataFrame:
    """kpi, baseline, new, delta, delta_pct of long tables (kpi, value); unknown values and a baseline of zero give nulls."""
    joined = base.select("kpi", F.col("value").alias("baseline")).join(new.select("kpi", F.col("value").alias("new")), "kpi", "full")
    delta = F.col("new") - F.col("baseline")
    return joined.withColumn("delta", delta).withColumn("delta_pct", F.try_divide(delta * 100, F.abs("baseline")))


def backfill_fingerprints(configs: DataFrame, variants: DataFrame) -> DataFrame:
    """configs (config_id, run_id, variant_id, family) with the family of their run's variant where they lack one, and what was done."""
    known = variants.select("run_id", "variant_id", F.col("family").alias("_family"))
    joined = configs.join(known, ["run_id", "variant_id"], "left")
    status = F.when(F.col("family").isNotNull(), "present").when(F.col("_family").isNotNull(), "filled").otherwise("unresolved")
    return joined.select("config_id", "run_id", "variant_id", F.coalesce("family", "_family").alias("family"), status.alias("status"))


def active_instances(configs: DataFrame, manifest: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(running, retired): instances that the manifest names and doesn't switch off, and those that it lacks."""
    running = configs.join(manifest, "instance_id").where(F.coalesce("active", F.lit(True)))
    return running, configs.join(manifest, "instance_id", "left_anti")
