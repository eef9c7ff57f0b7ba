"""Tool-use trajectories distilled from case logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspark.functions.quality import sufficient, test_quality
from loomspark.functions.text import not_blank, strip
from . import dedup, templates

SOURCE = "tool_trajectory_distill"


def succeeded(log: DataFrame) -> Column:
    flag = lambda c: F.coalesce(F.col(c), F.lit(False)) if c in log.columns else F.lit(False)
    return flag("all_passed") | flag("pass_at_1")


def usable(log: DataFrame, min_rounds: int = 1, include_failed: bool = False, min_asserts: int = 2, min_lines: int = 3, min_score: float = 2.5) -> DataFrame:
    """Code cases that ended well, with a history, a prompt, code and sufficient tests; with final_success and the tests' quality."""
    rows = log.withColumns({"final_success": succeeded(log), "_quality": test_quality("tests")})
    rows = rows.where((F.col("mode") == "code") & (F.coalesce(F.size("history"), F.lit(0)) >= min_rounds) & not_blank("prompt") & not_blank("tests") & not_blank("result_code"))
    return rows.where((F.lit(include_failed) | F.col("final_success")) & sufficient("_quality", min_asserts, min_lines, min_score))


def distill(log: DataFrame, order: str, most: int = 5000, **options) -> DataFrame:
    """text, prompt, tests, source, final_success and the tests' quality of each trajectory, the first of equal ones, in order of arrival.

    At most ``most`` rows, the first ones (0: all): the limit is the feature, a top-n on the order.
    """
    rows = usable(log, **options).withColumn("_history", templates.rendered_history("history"))
    rows = rows.withColumns({"_prompt": templates.trajectory_prompt(strip("prompt"), F.col("_history")), "_tests": strip("tests")})
    rows = rows.withColumn("_text", templates.trajectory_text(F.col("_prompt"), strip("result_code"), F.col("_history")))
    rows = dedup.keep_first(rows, dedup.content_key(F.col("_prompt"), F.col("_tests"), separator="\n---\n"), order)
    rows = rows.orderBy(order).limit(most) if most > 0 else rows
    return rows.select(
        F.col(order).alias("row_key"), F.col("_text").alias("text"), F.col("_prompt").alias("prompt"), F.col("_tests").alias("tests"), F.lit(SOURCE).alias("source"), "final_success",
        F.col("_quality.quality_score").alias("test_quality_score"), F.col("_quality.assert_count").alias("test_assert_count"))
