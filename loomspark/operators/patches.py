"""Patch cases from their candidates: similarity, ranking, beams, and the case's flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspark.functions.quality import patch_quality
from loomspark.functions.text import strip, tag_content, token_f1
from .ranking import top_per_group

#: A patch that shares so much of the reference counts as resolved.
THRESHOLD = 0.70
# Fixed value: what a patch's form counts beside its similarity.
HEURISTIC = 0.08


def judged(candidates: DataFrame, completion: str = "completion", reference: str = "reference") -> DataFrame:
    """candidates with code, similarity, heuristic and combined; code is empty where the answer has no tags."""
    df = candidates.withColumn("code", tag_content(completion, "answer"))
    df = df.withColumns({"similarity": F.when(F.col("code") != "", token_f1("code", reference)), "heuristic": F.when(F.col("code") != "", patch_quality("code"))})
    return df.withColumn("combined", F.col("similarity") + HEURISTIC * F.col("heuristic"))


def ranked(df: DataFrame, case: str, round_: str, order: str, width: int) -> DataFrame:
    """The best candidates of each case and round: by combined, then similarity, then arrival. These are repaired next."""
    return top_per_group(df.where("code != ''"), [case, round_], [F.desc("combined"), F.desc("similarity"), F.asc(order)], width, "place")


def case_results(df: DataFrame, case: str, round_: str, order: str, pass_k: int, max_rounds: int | None = None) -> DataFrame:
    """One row per case of judged candidates: pass_at_1, pass_at_k, format_errors, generated_candidates, rounds_used, resolve_proxy, best_patch.

    The first round's first pass_k candidates decide the flags; the first patch of the greatest similarity above 0 is the best.
    """
    if max_rounds is not None:
        df = df.where(F.col(round_) <= max_rounds)
    good = (F.col("code") != "") & (F.col("similarity") >= THRESHOLD)
    first = F.when(F.col(round_) == 1, F.row_number().over(Window.partitionBy(case, round_).orderBy(order)))
    df = df.withColumns({"_place": first, "_good": F.coalesce(good, F.lit(False))})
    best = F.max_by(F.struct("code", "similarity"), F.struct(F.coalesce("similarity", F.lit(0.0)), -F.col(round_), -F.col("_order")))
    out = df.withColumn("_order", F.row_number().over(Window.partitionBy(case, round_).orderBy(order))).groupBy(case).agg(
        F.coalesce(F.bool_or(F.when(F.col("_place") == 1, F.col("_good"))), F.lit(False)).alias("pass_at_1"),
        F.coalesce(F.bool_or(F.when(F.col("_place") <= pass_k, F.col("_good"))), F.lit(False)).alias("pass_at_k"),
        F.count_if(F.col("code") == "").alias("format_errors"), F.count("*").alias("generated_candidates"), F.max(round_).alias("rounds_used"), best.alias("_best"))
    proxy = F.coalesce(F.col("_best.similarity"), F.lit(0.0))
    return out.select(case, "pass_at_1", "pass_at_k", "format_errors", "generated_candidates", "rounds_used", proxy.alias("resolve_proxy"), F.when(proxy > 0, F.col("_best.code")).otherwise("").alias("best_patch"))


def predictions(cases: DataFrame, results: DataFrame, key: str, model: str) -> DataFrame:
    """One prediction per case, joined by the case's key instead of by position; a case without a patch predicts none."""
    found = cases.select(key).join(results.select(key, "best_patch"), key, "left")
    patch = F.coalesce("best_patch", F.lit(""))
    return found.select(F.col(key).alias("instance_id"), patch.alias("model_patch"), patch.alias("patch"), F.lit(model).alias("model_name_or_path"))


def proxy_scores(predicted: DataFrame, references: DataFrame, key: str, reference: str) -> DataFrame:
    """Cases scored by similarity alone, where no harness ran."""
    rows = references.select(key, reference).join(predicted.select(F.col("instance_id").alias(key), "model_patch"), key, "left")
    like = token_f1(F.coalesce("model_patch", F.lit("")), reference)
    rows = rows.withColumn("resolve_proxy", like)
    passed: Column = F.col("resolve_proxy") >= THRESHOLD
    return rows.select(key, passed.alias("pass_at_1"), passed.alias("pass_at_k"), F.when(strip(F.coalesce("model_patch", F.lit(""))) == "", 1).otherwise(0).alias("format_errors"), F.lit(1).alias("generated_candidates"), "resolve_proxy")
