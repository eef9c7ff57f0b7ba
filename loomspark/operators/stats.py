"""Bootstrap intervals and sign-flip tests over counted distinct values, with a hash as random numbers (see ``resampling``)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomspark.functions.text import SEED
from loomspark.operators.resampling import flipped, replicates


def interval(reps: DataFrame, samples: int, by: list[str]) -> DataFrame:
    """low and high of each group: order statistics of its replicates, which are ``samples`` rows."""
    low, high = int(0.025 * (samples - 1)) + 1, int(0.975 * (samples - 1)) + 1
    rank = F.row_number().over(Window.partitionBy(*(by or [F.lit(0)])).orderBy("mean"))
    return reps.withColumn("_r", rank).groupBy(*by).agg(F.max(F.when(F.col("_r") == low, F.col("mean"))).alias("low"), F.max(F.when(F.col("_r") == high, F.col("mean"))).alias("high"))


def bootstrap_ci(values: DataFrame, samples: int, by: str | None = None, seed: int = SEED) -> DataFrame:
    """mean, low and high of ``value`` per group, and n; a single value or no samples give the mean three times. Nulls don't count; a column ``c`` says how often a row stands."""
    named = [F.col("by").cast(values.schema[by].dataType).alias(by)] if by else []
    observed, reps = replicates(values, max(samples, 1), seed, by)
    if samples <= 0:
        return observed.select(*named, "mean", F.col("mean").alias("low"), F.col("mean").alias("high"), "n")
    ends = observed.join(interval(reps, samples, ["by"]), "by")
    one = F.col("n") == 1
    return ends.select(*named, "mean", F.when(one, F.col("mean")).otherwise(F.col("low")).alias("low"), F.when(one, F.col("mean")).otherwise(F.col("high")).alias("high"), "n")


def weights_of(weights: dict[str, float]):
    table = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])
    return F.coalesce(F.try_element_at(table, F.col("by")), F.lit(0.0))


def require_components(diffs: DataFrame, weights: dict[str, float]) -> None:
    found = {r[0] for r in diffs.select("component").distinct().limit(len(weights) + 100).collect()}
    if missing := [c for c in weights if c not in found]:
        raise ValueError(f"no shared cases for {missing[0]}")


def weighted_diff_ci(diffs: DataFrame, weights: dict[str, float], samples: int, seed: int = SEED) -> DataFrame:
    """The composite difference and its interval: components are resampled alone, then weighed."""
    means, reps = replicates(diffs.withColumnRenamed("diff", "value"), samples, seed, "component")
    observed = means.agg(F.sum(weights_of(weights) * F.col("mean")).alias("observed"))
    whole = reps.groupBy("rep").agg(F.sum(weights_of(weights) * F.col("mean")).alias("mean"))
    return observed.crossJoin(interval(whole, samples, []))


def sign_flip(diffs: DataFrame, weights: dict[str, float], samples: int, seed: int = SEED) -> DataFrame:
    """One-sided p-value of the composite difference under random signs."""
    means, reps = flipped(diffs.withColumnRenamed("diff", "value"), max(samples, 1), seed, "component")
    observed = means.agg(F.sum(weights_of(weights) * F.col("mean")).alias("observed"))
    if samples <= 0:
        return observed.withColumn("p_value", F.lit(1.0))
    null = reps.groupBy("rep").agg(F.sum(weights_of(weights) * F.col("mean")).alias("stat"))
    extreme = null.crossJoin(F.broadcast(observed)).agg(F.count_if(F.round("stat", 12) >= F.round("observed", 12)).alias("extreme"))
    return observed.crossJoin(extreme).select("observed", ((F.col("extreme") + 1) / (samples + 1)).alias("p_value"))
