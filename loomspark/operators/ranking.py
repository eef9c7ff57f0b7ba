"""Best-of-n, preference pairs, beams and rounds: per-group ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspark.functions.quality import pair_weight
from loomspark.functions.text import strip
from .dedup import keep_first, pair_key


def candidate_order(score="score", exec_time="exec_time", text="text", *ties) -> list[Column]:
    return [F.desc(score), F.asc(exec_time), F.length(text).asc(), *[F.asc(t) for t in ties]]


def top_per_group(df: DataFrame, by, order: list[Column], n: int, rank: str = "rank") -> DataFrame:
    """The first n rows of each group; the limit reaches below the shuffle (WindowGroupLimit)."""
    by = [by] if isinstance(by, str) else by
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(rank) <= n)


def best_of_n(df: DataFrame, by: str, order: list[Column], passing: float = 1.99, score: str = "score") -> DataFrame:
    """The best passing candidate of each group, with the number of candidates."""
    whole = Window.partitionBy(by)
    ranked = df.withColumns({"num_evaluated": F.count("*").over(whole), "_rank": F.row_number().over(whole.orderBy(*order))})
    return ranked.where((F.col("_rank") == 1) & (F.col(score) >= passing)).drop("_rank")


def preference_pairs(df: DataFrame, by: str, order: list[Column], n: int, passing: float = 1.99, min_gap: float = 1.0, max_rejected: float = 0.6, weighting: str = "score_gap", text: str = "text", score: str = "score") -> DataFrame:
    """Each group's best passing candidate against its n best failing ones; ranks come before the filters on scores.

    Chosen and rejected come out of one shuffle: the best row is a window value, not a self-join.
    """
    whole = Window.partitionBy(by)
    failing = F.when(F.col(score) < passing, 1).otherwise(0)
    ranked = df.withColumns({
        "num_evaluated": F.count("*").over(whole), "best": F.first(F.struct(F.col(text).alias("text"), F.col(score).alias("score"))).over(whole.orderBy(*order)),
        "negative_rank": F.sum(failing).over(whole.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))})
    pairs = ranked.where((F.col("best.score") >= passing) & (F.col(score) < passing) & (F.col("negative_rank") <= n))
    gap = F.col("best.score") - F.col(score)
    pairs = pairs.select(by, F.col("best.text").alias("chosen"), F.col(text).alias("rejected"), F.col("best.score").alias("chosen_score"), F.col(score).alias("rejected_score"), gap.alias("score_gap"), "negative_rank", "num_evaluated")
    return pairs.where((F.col("score_gap") >= min_gap) & (F.col("rejected_score") <= max_rejected)).withColumn("pair_weight", pair_weight("score_gap", weighting))


def prepare_pairs(df: DataFrame, order: str, per_prompt: int = 6, min_gap: float = 1.0, max_rejected: float = 0.6, min_asserts: int = 2) -> DataFrame:
    """Pairs fit for training: filtered, without repeats, the widest gaps of each prompt (all if per_prompt isn't positive)."""
    df = df.withColumns({c: strip(F.coalesce(F.col(c), F.lit(""))) for c in ("prompt", "chosen", "rejected")})
    fit = (F.col("prompt") != "") & (F.col("chosen") != "") & (F.col("rejected") != "") & (F.col("score_gap") >= min_gap) & (F.col("rejected_score") <= max_rejected) & (F.col("test_assert_count") >= min_asserts)
    kept = keep_first(df.where(fit), pair_key(F.col("prompt"), F.col("chosen"), F.col("rejected")), order)
    if per_prompt <= 0:
        return kept
    return top_per_group(kept, "prompt", [F.desc("score_gap"), F.asc("rejected_score"), F.desc("test_assert_count"), F.length("rejected").asc(), F.asc(order)], per_prompt, "_rank").drop("_rank")


def beam(df: DataFrame, by: str, code: str, width: int, order: list[Column]) -> DataFrame:
    """The best rows of each group with different code, blank code left out."""
    rows = df.where(strip(F.coalesce(F.col(code), F.lit(""))) != "")
    best = rows.withColumn("_n", F.row_number().over(Window.partitionBy(by, F.sha2(F.col(code).cast("binary"), 256)).orderBy(*order))).where("_n = 1").drop("_n")
    return top_per_group(best, by, order, width, "beam_rank")


def stagnation(df: DataFrame, by: str, order: list[str], score: str, patience: int) -> DataFrame:
    """df with the best score before each round, whether it improved, the rounds since it last did, and stop."""
    w = Window.partitionBy(by).orderBy(*order)
    best = F.max(score).over(w.rowsBetween(Window.unboundedPreceding, -1))
    df = df.withColumn("best_before", best).withColumn("improved", F.col("best_before").isNull() | (F.col(score) > F.col("best_before")))
    island = F.sum(F.col("improved").cast("int")).over(w)
    df = df.withColumn("_island", island)
    stale = F.row_number().over(Window.partitionBy(by, "_island").orderBy(*order)) - 1
    return df.withColumn("stale", stale).withColumn("stop", F.col("stale") >= patience).drop("_island")
