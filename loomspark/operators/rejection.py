"""Rejection sampling: verified completions of prompts become a distilled corpus and preference pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspark.functions.quality import pair_weight, sufficient, test_quality
from loomspark.functions.text import ASSISTANT, strip, tag_content, truncated_prompt, without_fences
from loomspark.sources.work import Work

#: A run's score when all its tests pass.
PASSED = 2.0


def prompt_only(prompt, text) -> Column:
    """A row's prompt; without one its text up to the assistant's turn."""
    prompt, text = (F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")) for c in (prompt, text))
    at = F.instr(text, ASSISTANT)
    head = F.when(at > 0, F.concat(F.left(text, at - 1), F.lit(ASSISTANT))).otherwise(text)
    return F.when(prompt != "", prompt).otherwise(head)


def tested_prompts(rows: DataFrame, key: str, prompt: Column, tests: str, max_chars: int = 7000, asserts: int = 2, lines: int = 3, quality: float = 2.5) -> DataFrame:
    """key, prompt (cut), tests and their counts, of the rows whose tests are good enough."""
    known = rows.select(F.col(key).alias("key"), truncated_prompt(prompt, max_chars).alias("prompt"), F.coalesce(F.col(tests), F.lit("")).alias("tests"), test_quality(tests).alias("_q"))
    known = known.where((strip("tests") != "") & sufficient("_q", asserts, lines, quality))
    return known.select("key", "prompt", "tests", F.col("_q.quality_score").alias("test_quality_score"), F.col("_q.assert_count").alias("test_assert_count"))


def answered(completions: DataFrame, text: str) -> DataFrame:
    """Completions that hold an answer, with its code."""
    return completions.withColumn("code", without_fences(tag_content(text, "answer"), ("```python", "```"))).where(tag_content(text, "answer") != "")


def distil(
    prompts: DataFrame, completions: DataFrame, ties: list[str] | None = None, negatives: int = 3, min_gap: float = 1.0, max_rejected: float = 0.6, min_evaluated: int = 4,
    weighting: str = "score_gap", min_distilled: int = 0, min_pairs: int = 0,
) -> tuple[DataFrame, DataFrame]:
    """The distilled corpus, one row a prompt, and the pairs, at most ``negatives`` a prompt.

    prompts: as ``tested_prompts`` gives them. completions: key, text, temperature, score and exec_time of each verified completion
    with an answer; all temperatures and samples of a prompt meet it by one join on the key. The best passed completion (quickest,
    then shortest, then by ties) is distilled; the best failed ones are its rejected partners, ranked before the filters on scores.
    An error if there are fewer than ``min_distilled`` or ``min_pairs``.
    """
    work = Work(prompts.sparkSession, "rejection")
    order = [F.desc("score"), F.asc("exec_time"), F.length("text").asc(), *[F.asc(t) for t in ties or []]]
    rows = prompts.join(completions.select("key", "text", "temperature", "score", "exec_time", *(ties or [])), "key")
    whole = Window.partitionBy("key")
    passed = F.col("score") == PASSED
    best = F.first(F.when(passed, F.struct("text", "score", "temperature")), ignorenulls=True)
    ranked = rows.withColumns({
        "n_evaluated": F.count("*").over(whole), "best": best.over(whole.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)),
        "place": F.sum((~passed).cast("int")).over(whole.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)),
        "first": F.row_number().over(whole.orderBy(*order)) == 1})
    ranked = work.save(ranked.where(F.col("best").isNotNull() & (F.col("first") | (~passed & (F.col("place") <= negatives)))), "ranked")
    tests = ["tests", "test_quality_score", "test_assert_count"]
    distilled = ranked.where("first").select(
        "key", F.concat("prompt", "best.text").alias("text"), "prompt", *tests, F.col("best.score").alias("chosen_score"), F.col("best.temperature").alias("chosen_temperature"))
    gap = F.col("best.score") - F.col("score")
    pairs = ranked.where(~passed & (F.col("n_evaluated") >= min_evaluated) & (gap >= min_gap) & (F.col("score") <= max_rejected)).select(
        "key", "prompt", F.col("best.text").alias("chosen"), F.col("text").alias("rejected"), *tests, F.col("best.score").alias("chosen_score"), F.col("score").alias("rejected_score"),
        F.col("best.temperature").alias("chosen_temperature"), F.col("temperature").alias("rejected_temperature"), gap.alias("score_gap"), pair_weight(gap, weighting).alias("pair_weight"),
        F.lit(weighting).alias("pair_weighting"), F.col("place").alias("negative_rank"), F.col("n_evaluated").alias("num_evaluated"))
    for name, df, least in (("distilled rows", distilled, min_distilled), ("pairs", pairs, min_pairs)):
        if least > 0 and (n := df.count()) < least:
            raise ValueError(f"{n} {name} are fewer than {least}")
    return distilled, pairs
