"""Training rows for reinforcement learning: canonical rows, quality gates, boosts, difficulty, staged curriculum."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.functions.quality import difficulty, macro_bucket, test_quality
from loomspark.functions.text import column_text, first_truthy, strip
from . import curriculum, repair, sampling, templates

# Shares of the steps that core and repository stages get, and those of a plain curriculum.
MACRO_SHARES = {"core": 0.45, "repo": 0.55}
TIER_SHARES = {"easy": 0.20, "medium": 0.30, "hard": 0.30, "expert": 0.20}


def canonical(df: DataFrame, row_key: str) -> DataFrame:
    """row_key and the canonical columns: a blank prompt falls back to the text, names are lower case, missing scores come from the tests."""
    prompt = strip(first_truthy(df, ("prompt", "text")))
    named = lambda n, default="": F.coalesce(F.nullif(F.lower(strip(column_text(df, n))), F.lit("")), F.lit(default))
    tests = strip(column_text(df, "tests"))
    out = df.select(
        F.col(row_key).alias("row_key"), prompt.alias("prompt"), strip(first_truthy(df, ("text", "prompt"))).alias("text"), tests.alias("tests"),
        named("source", "unknown").alias("source"), named("benchmark").alias("benchmark"), named("error_type").alias("error_type"),
        *[F.col(c).cast(kind).alias(f"_{c}") for c, kind in (("test_quality_score", "double"), ("test_assert_count", "int")) if c in df.columns], test_quality(tests).alias("_q"))
    own = lambda c, computed: F.coalesce(F.col(f"_{c}"), computed) if c in df.columns else computed
    out = out.withColumns({"test_quality_score": own("test_quality_score", F.col("_q.quality_score")), "test_assert_count": own("test_assert_count", F.col("_q.assert_count"))})
    return out.select("row_key", "prompt", "text", "tests", "source", "benchmark", "error_type", "test_quality_score", "test_assert_count")


def with_tests(df: DataFrame) -> DataFrame:
    """Canonical rows that have a prompt and tests."""
    return df.where("prompt != '' AND tests != ''")


def gated(df: DataFrame, min_asserts: int = 2, min_lines: int = 3, min_score: float = 2.5) -> DataFrame:
    """Rows as prompts with their tests, those with sufficient tests only; other columns of df named row_key stay."""
    return templates.format_rl(df, min_asserts, min_lines, min_score, keep=("row_key",)).where("has_tests AND tests_quality_ok")


def annotated(df: DataFrame) -> DataFrame:
    """df with prompt_length, difficulty_score and macro_bucket."""
    df = df.withColumn("prompt_length", F.length("prompt"))
    df = df.withColumn("difficulty_score", F.round(difficulty("prompt_length", "test_assert_count", "test_quality_score"), 9))
    return df.withColumn("macro_bucket", macro_bucket("source", "benchmark", "prompt_length", "error_type"))


@dataclass
class Plan:
    """Rows with their stage, in the order of training, and the steps of each stage."""

    rows: DataFrame
    steps: dict[str, int]


def stage_shares(counts: dict[str, int]) -> dict[str, float]:
    """The share of steps of each stage that has rows, in the order of training."""
    names = [n for macro in MACRO_SHARES for n in (f"{macro}_easy", f"{macro}_mid", f"{macro}_hard") if counts.get(n)]
    if not names:
        return {n: s for n, s in TIER_SHARES.items() if counts.get(n)}
    size = {macro: sum(n.startswith(macro) for n in names) for macro in MACRO_SHARES}
    return {n: MACRO_SHARES[n.partition("_")[0]] / size[n.partition("_")[0]] for n in names}


def prepare(df: DataFrame, save, drop: float = 0.10, least: int = 1000, priority: tuple[str, ...] = (), boost: float = 1.0, steps: int = 1500, drops: str = "", two_dimensional: bool = True) -> Plan:
    """From canonical rows (row_key) to staged training rows.

    Insufficient tests go, then the lowest scores (ties stay), priority sources are repeated, difficulty decides the stage,
    and each stage drops a share of its own. save writes a frame once and returns it reread. copy numbers repeats from 0.
    """
    rows = curriculum.drop_low_quality(gated(with_tests(df)), "test_quality_score", drop, least)
    rows = save(rows, "rows")
    if boost > 1.0 and priority:
        rows = sampling.upsample(rows, F.lower(strip(F.col("source"))).isin(*[p.strip().lower() for p in priority]), boost, "row_key")
    else:
        rows = rows.withColumn("copy", F.lit(0))
    rows = annotated(rows)
    tiers = curriculum.tiers_by_bucket(rows, "macro_bucket", "difficulty_score") if two_dimensional else curriculum.tiers(rows, "difficulty_score")
    tiers = save(tiers.withColumnRenamed("tier", "stage"), "tiers")
    counts = {r[0]: r[1] for r in tiers.groupBy("stage").count().collect()}  # a handful of stages
    shares = stage_shares(counts)
    allotted = dict(zip(shares, curriculum.allocate_steps(list(shares.values()), steps)))
    planned = {n: s for n, s in allotted.items() if s > 0}
    if not planned:
        raise ValueError("no stage has rows and steps")
    map_, own = repair.parse_stage_drops(drops), None
    for name in planned:
        part = curriculum.drop_low_quality(tiers.where(F.col("stage") == name), "test_quality_score", repair.stage_drop(name, map_), max(160, least // len(planned)))
        own = part if own is None else own.unionByName(part)
    order = {n: i for i, n in enumerate(planned)}
    place = F.create_map(*[F.lit(x) for kv in order.items() for x in kv])
    return Plan(own.withColumn("stage_place", place[F.col("stage")]), planned)


def in_training_order(plan: Plan) -> DataFrame:
    """The rows by stage and difficulty: one range-partitioned sort."""
    return plan.rows.orderBy("stage_place", "difficulty_score", "row_key", "copy")
