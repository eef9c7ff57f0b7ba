"""The training corpus from raw sources: filters, templates, caps, mix, dedup, quality gates, splits."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspark.functions.quality import flags_of
from loomspark.functions.text import answer_of, column_text, first_truthy, not_blank, strip
from loomspark.sources.readers import READ_ERRORS
from . import dedup, sampling, templates

#: What each kind of source must have: columns of which the first one present counts. A row with a blank side goes.
NEEDS = {
    "reasoning": (("instruction",), ("solution",)),
    "stratos": (("prompt", "messages"), ("response", "generation")),
    "bug": (("problem_statement",), ("patch",)),
    "evol": (("instruction",), ("output",)),
    "math": (("problem",), ("solution",)),
    "feedback": (("query",), ("answer",)),
    "mcts": (("instruction", "prompt"), ("output", "response")),
    "commit": (("diff",), ("message", "old_contents")),
}
# Thresholds of a corpus that is good enough, and the only policy of splits.
THRESHOLDS = {"total": 20_000, "test_coverage": 0.08, "assert_density_in_tests": 0.65, "answer_ast_parse_rate": 0.98, "prompt_coverage": 0.99, "unique_ratio": 0.75}
POLICY = "source_hash_v1"
RATIOS = {
    "test_coverage": ("with_tests", "total"), "prompt_coverage": ("with_prompt", "total"), "unique_ratio": ("total", "before_dedup"), "dedup_ratio": ("removed", "before_dedup"),
    "answer_ast_parse_rate": ("ast_ok", "code_answers"), "answer_patch_parse_rate": ("patch_ok", "patch_answers"), "answer_quality_rate": ("quality_ok", "total"), "assert_density_in_tests": ("with_asserts", "with_tests"),
}


def usable(df: DataFrame, kind: str) -> DataFrame:
    """Rows of a source that have both sides; a trajectory needs a patch under any of its names and a step."""
    if kind == "trajectory":
        steps = F.size(F.coalesce(F.col("trajectory"), F.array().cast(df.schema["trajectory"].dataType))) > 0
        return df.where(not_blank(first_truthy(df, templates.PATCH_KEYS)) & steps)
    return df.where(reduce(Column.__and__, [not_blank(column_text(df, *names)) for names in NEEDS[kind]]))


def tagged(df: DataFrame) -> DataFrame:
    """Chat records that have a text, a prompt and both answer tags."""
    has = lambda tag: F.contains(F.coalesce(F.col("text"), F.lit("")), F.lit(tag))
    return df.where(not_blank("text") & not_blank("prompt") & has("<answer>") & has("</answer>"))


def tagged_swe(df: DataFrame) -> DataFrame:
    """Repository records that have a prompt, a patch and both answer tags."""
    has = lambda tag: F.contains(F.coalesce(F.col("text"), F.lit("")), F.lit(tag))
    return df.where(not_blank("prompt") & not_blank("patch") & has("<answer>") & has("</answer>"))


def complete_pairs(df: DataFrame) -> DataFrame:
    """prompt, chosen and rejected, stripped, of the rows where none is blank; an error if a column is missing."""
    names = ["prompt", "chosen", "rejected"]
    if missing := [c for c in names if c not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df.select(*[strip(F.coalesce(F.col(c), F.lit(""))).alias(c) for c in names]).where(" AND ".join(f"{c} != ''" for c in names))


def quality_metrics(df: DataFrame, before_dedup: Column | int, removed: Column | int) -> DataFrame:
    """One row of counts and guarded ratios of records with answer flags (prompt, tests, answer_kind, answer_*_ok)."""
    tests = F.coalesce(F.col("tests"), F.lit(""))
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    kind = F.lower(strip(F.coalesce(F.col("answer_kind"), F.lit(""))))
    counts = df.agg(
        F.count("*").alias("total"), F.count_if(not_blank(tests)).alias("with_tests"), F.count_if(not_blank("prompt")).alias("with_prompt"),
        F.count_if(F.contains(strip(tests), F.lit("assert "))).alias("with_asserts"), F.count_if(kind == "code").alias("code_answers"), F.count_if(kind == "patch").alias("patch_answers"),
        F.count_if(flag("answer_ast_ok")).alias("ast_ok"), F.count_if(flag("answer_patch_ok")).alias("patch_ok"), F.count_if(flag("answer_quality_ok")).alias("quality_ok"))
    as_column = lambda x: x if isinstance(x, Column) else F.lit(x)
    counts = counts.withColumns({"before_dedup": as_column(before_dedup).cast("long"), "removed": as_column(removed).cast("long")})
    return counts.withColumns({name: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b)), F.lit(0.0)) for name, (a, b) in RATIOS.items()})


def failed_thresholds(metrics: dict, thresholds: dict[str, float] = THRESHOLDS) -> list[str]:
    failed = [f"{name}: {metrics[name]} < {least}" for name, least in thresholds.items() if metrics[name] < least]
    return failed + ([] if metrics["code_answers"] else ["code_answers: none"])


def split_key() -> Column:
    """The key by which a record's split is drawn."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    return F.concat_ws("||", F.coalesce(F.col("source"), F.lit("unknown")), text("prompt"), answer_of("text"))


def with_split(df: DataFrame, holdout: float = 0.10, val: float = 0.05, policy: str = POLICY) -> DataFrame:
    """df with split by the hash of source, prompt and answer; an error for any other policy."""
    if policy != POLICY:
        raise ValueError(f"unsupported split policy: {policy}")
    return df.withColumn("split", sampling.hash_split(split_key(), holdout, val))


def require_splits(df: DataFrame, names: tuple[str, ...] = ("train", "val", "holdout")) -> dict[str, int]:
    """Rows of each split; an error if one is empty or a record stands in two."""
    counts = {r[0]: r[1] for r in df.groupBy("split").count().collect()}
    if empty := [n for n in names if not counts.get(n)]:
        raise ValueError(f"empty splits: {', '.join(empty)}")
    key = F.sha2(F.concat_ws("||", F.lower(strip(F.coalesce("source", F.lit("unknown")))), strip(F.coalesce("prompt", F.lit(""))), answer_of("text")).cast("binary"), 256)
    if overlap := sampling.overlapping_keys(df, key).limit(1).collect():
        raise ValueError(f"a record stands in {overlap[0].n_splits} splits")
    return counts


@dataclass
class Corpus:
    """A corpus that was built: records with their split, metrics before and after the answers' filter, and what is missing."""

    records: DataFrame
    metrics_before: DataFrame
    metrics: DataFrame
    missing: list[str] = field(default_factory=list)


def formatted(sources: dict[str, tuple[str, str, DataFrame]], row_key: str) -> DataFrame:
    """Records of all sources (name: kind, category, rows): row_key, text, prompt, tests, source, category."""
    parts = []
    for name, (kind, category, rows) in sources.items():
        records = templates.format_source(usable(rows, kind), kind, name)
        parts.append(records.select(F.col(row_key).alias("row_key"), "text", "prompt", "tests", "source", F.lit(category).alias("category")))
    if not parts:
        raise ValueError("no source could be read")
    return reduce(DataFrame.unionByName, parts)


def build(sources: dict, row_key: str, save, cap: int = 25_000, weights: str = "", holdout: float = 0.10, val: float = 0.05, most_missing: int = 8) -> Corpus:
    """From raw sources to splits. sources: name to (kind, category, loader); save writes a frame once and returns it reread.

    Sources that can't be read count as missing; any other error of a loader is raised. Each source is capped, sources are mixed by category, records without
    answer tags go, then later copies of the same prompt and answer, then answers that don't parse.
    """
    loaded, missing = {}, []
    for name, (kind, category, load) in sources.items():
        try:
            rows = load()
            rows.schema  # an unreadable source fails here, before anything runs
            loaded[name] = (kind, category, rows)
        except READ_ERRORS:
            missing.append(name)
    if len(missing) > most_missing:
        raise RuntimeError(f"missing sources: {', '.join(missing)}")
    records = save(formatted(loaded, row_key), "formatted")
    capped = sampling.cap_per_key(records, "source", cap, "row_key")
    mixed = sampling.mix_by_category(capped, "category", sampling.parse_weights(weights), "row_key")
    # the answer is found once, for its flags and the key, and isn't shuffled; records are written once, after dedup
    answered = tagged(mixed).withColumn("_answer", answer_of("text"))
    flagged = answered.withColumns({"_flags": flags_of("_answer"), "_key": dedup.prompt_answer_key("prompt", "_answer")}).select("*", "_flags.*").drop("_flags", "_answer")
    first = save(dedup.keep_first(flagged, ["_key"], F.struct("source", "row_key")).drop("_key"), "first")
    before, kept = tagged(mixed).count(), first.count()
    good = with_split(first.where("answer_quality_ok"), holdout, val)
    return Corpus(good, quality_metrics(first, before, before - kept), quality_metrics(good, before, before - kept), missing)


def build_repository_set(bugs: list[DataFrame], trajectories: list[DataFrame], row_key: str, most: int = 120_000) -> DataFrame:
    """Repository records (issues with patches, and trajectories): filtered, without copies, at most ``most`` by hash order, with splits."""
    parts = [templates.format_swe_bug(b, row_key=row_key) for b in bugs] + [templates.format_swe_trajectory(t, row_key=row_key) for t in trajectories]
    if not parts:
        raise ValueError("no repository source")
    records = tagged_swe(reduce(DataFrame.unionByName, parts))
    first = dedup.keep_first(records, dedup.prompt_answer_key("prompt", answer_of("text")), F.struct(sampling.seeded("row_key"), F.col("source"), F.col("row_key")))
    # the cut is found by ranges, so that no task meets all texts
    return with_split(sampling.first_of_each(first, None, [sampling.seeded("row_key"), F.col("row_key"), F.col("source")], F.lit(most)) if most > 0 else first)


def manifest(corpus: Corpus, splits: dict[str, int], settings: dict) -> dict:
    """What a corpus' manifest says of it."""
    row = lambda df: {k: v for k, v in df.first().asDict().items()}
    return {"schema_version": "corpus_manifest_v1", "settings": settings, "missing_sources": corpus.missing, "metrics_before": row(corpus.metrics_before), "metrics": row(corpus.metrics), "split_sizes": splits}
