"""Evaluation logs: case filters, aligned differences of two runs, reports, and gates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspark.functions.text import strip
from loomspark.sources.readers import exists
from loomspark.sources.work import Work
from . import stats
from .dedup import keep_first

KEY = ["benchmark", "mode", "id"]
# The composite's components and weights.
COMPONENTS = {"livecodebench": 0.35, "bigcodebench_instruct": 0.25, "swebench_verified_subset": 0.20, "agentic_success": 0.10, "format_quality": 0.10}


def format_error_rate(errors="format_errors", generated="generated_candidates") -> Column:
    return F.coalesce(F.col(errors), F.lit(0)) / F.greatest(F.lit(1), F.coalesce(F.col(generated), F.lit(1)))


def metric(name: str) -> Column:
    if name == "pass":
        return F.coalesce(F.col("pass_at_1"), F.lit(False)).cast("double")
    if name == "format":
        return format_error_rate()
    raise ValueError(f"unsupported metric: {name}")


def save_log(log: DataFrame, table: str, path: str, buckets: int = 64) -> DataFrame:
    """A case log as a table bucketed and sorted by the case's key, and the frame that reads it: logs saved with as many buckets are
    compared, one with the other, without a shuffle, however often.

    table: a name in the session's catalog; path: a folder that all executors share. The rows are dealt by the key first, so each bucket is one file.
    """
    log.repartition(buckets, *KEY).write.bucketBy(buckets, *KEY).sortBy(*KEY).option("path", path).mode("overwrite").saveAsTable(table)
    return log.sparkSession.table(table)


def align_diffs(base: DataFrame, post: DataFrame, name: str, order: str, benchmark: str | None = None) -> DataFrame:
    """post - base of a metric per case: the last post row of a key wins, each base row counts, cases missing in either go."""
    if benchmark:
        base, post = base.where(F.col("benchmark") == benchmark), post.where(F.col("benchmark") == benchmark)
    after = keep_first(post, KEY, order, last=True).select(*KEY, metric(name).alias("_post"))
    return base.select(*KEY, metric(name).alias("_base")).join(after, KEY).select(*KEY, (F.col("_post") - F.col("_base")).alias("diff"))


def paired_objective(base: DataFrame, post: DataFrame, base_agentic: DataFrame, post_agentic: DataFrame, order: str, benchmarks: dict[str, str]) -> DataFrame:
    """Differences of all components with a component column; benchmarks: component to benchmark."""
    parts = [align_diffs(base, post, "pass", order, b).withColumn("component", F.lit(c)) for c, b in benchmarks.items()]
    parts.append(align_diffs(base_agentic, post_agentic, "pass", order).withColumn("component", F.lit("agentic_success")))
    parts.append(align_diffs(base, post, "format", order).withColumn("diff", -F.col("diff")).withColumn("component", F.lit("format_quality")))
    return reduce(DataFrame.unionByName, parts)


def weighted_mean(means: DataFrame, weights: dict[str, float] = COMPONENTS) -> Column:
    """The composite of (component, mean) rows, as an aggregate."""
    table = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])
    return F.sum(F.coalesce(F.try_element_at(table, F.col("component")), F.lit(0.0)) * F.col("mean"))


def case_ids(log: DataFrame) -> DataFrame:
    return log.select(F.lower(strip("benchmark")).alias("benchmark"), strip(F.col("id").cast("string")).alias("id")).where("benchmark != '' AND id != ''").distinct()


def filter_cases(cases: DataFrame, ids: DataFrame) -> DataFrame:
    """Cases whose id the filter lists; benchmarks that it doesn't name pass whole."""
    named = ids.select("benchmark").distinct()
    return cases.join(ids, ["benchmark", "id"], "left_semi").unionByName(cases.join(named, "benchmark", "left_anti"))


def require_benchmarks(cases: DataFrame, ids: DataFrame) -> None:
    """Fails if a benchmark that the filter names has no case left."""
    empty = ids.select("benchmark").distinct().join(cases.select("benchmark").distinct(), "benchmark", "left_anti").limit(1).collect()
    if empty:
        raise ValueError(f"the case filter leaves benchmark {empty[0][0]} empty")


def benchmark_report(log: DataFrame, *by: str) -> DataFrame:
    """Counts and means of each group."""
    return log.groupBy(*by).agg(
        F.count("*").alias("total"), F.avg(metric("pass")).alias("pass_at_1"), F.avg(F.coalesce("pass_at_k", F.lit(False)).cast("double")).alias("pass_at_k"),
        F.avg(format_error_rate()).alias("format_error_rate"), F.avg("rounds_used").alias("avg_rounds"))


def group_report(log: DataFrame, groups: dict[str, list[str]]) -> DataFrame:
    """The report of sets of benchmarks, which may overlap, and of all cases."""
    pairs = [(g, b) for g, bs in groups.items() for b in bs]
    mapping = log.sparkSession.createDataFrame(pairs, "grp string, benchmark string")
    return benchmark_report(log.join(F.broadcast(mapping), "benchmark"), "grp").unionByName(benchmark_report(log.withColumn("grp", F.lit("global")), "grp"))


def classic_case(samples: DataFrame, case: str, order: str, passed: str, *more: Column) -> DataFrame:
    """pass_at_1 is the first sample's, pass_any_k that of any sample (not the unbiased estimator). more: further figures of a case's samples."""
    return samples.groupBy(case).agg(F.min_by(passed, order).alias("pass_at_1"), F.bool_or(passed).alias("pass_any_k"), F.count("*").alias("generated_candidates"), *more)


def verifier_rollup(runs: DataFrame, by: str) -> DataFrame:
    """One row per candidate from its seeds' runs (round, score, exec_time, error_type)."""
    good = F.col("score") >= 1.99
    return runs.groupBy(by).agg(
        F.bool_and(good).alias("all_passed"), F.min("score").alias("min_score"), F.max("score").alias("max_score"), F.min(F.when(good, F.col("exec_time"))).alias("best_time"),
        F.max("exec_time").alias("max_time"), F.min_by("error_type", F.struct(-F.col("score"), F.col("exec_time"), F.col("round"))).alias("best_error"))


def error_counts(runs: DataFrame, by: str) -> DataFrame:
    """A map of how often each error ended a run."""
    counts = runs.where(F.coalesce("error_type", F.lit("")) != "").groupBy(by, "error_type").agg(F.count("*").cast("int").alias("n"))
    return counts.groupBy(by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("error_type", "n")))).alias("error_counts"))


def resolved_ids(report: DataFrame, lists: list[str], records: list[str], flag: str = "resolved", key: str = "instance_id") -> Column:
    """Sorted distinct ids that a harness report calls resolved, from lists of ids and of records."""
    none = F.array().cast("array<string>")
    parts = [F.coalesce(F.col(c), none) for c in lists if c in report.columns]
    parts += [F.coalesce(F.transform(F.filter(c, lambda r: r[flag]), lambda r: r[key]), none) for c in records if c in report.columns]
    return F.array_sort(F.array_distinct(F.filter(F.concat(*parts), lambda x: F.coalesce(x, F.lit("")) != "")))


def apply_resolved(log: DataFrame, resolved: DataFrame) -> DataFrame:
    """Cases pass if the harness resolved them; pass_at_k follows."""
    hit = resolved.select(F.col("id"), F.lit(True).alias("_hit")).distinct()
    return log.join(hit, "id", "left").withColumns({c: F.coalesce("_hit", F.lit(False)) for c in ("pass_at_1", "pass_at_k")}).drop("_hit")


def candidate_budget(history, own) -> Column:
    """All candidates that a case's rounds and itself were given, one at least."""
    return F.greatest(F.lit(1), F.aggregate(F.coalesce(history, F.array().cast("array<int>")), F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) + F.coalesce(own, F.lit(0)))


def regression_checks(base: DataFrame, post: DataFrame) -> DataFrame:
    """Per benchmark whether the later report holds: rows benchmark, pass_mean, pass_low, format_mean on either side."""
    b = base.select("benchmark", *[F.col(c).alias(f"base_{c}") for c in ("pass_mean", "pass_low", "format_mean")])
    p = post.select("benchmark", *[F.col(c).alias(f"post_{c}") for c in ("pass_mean", "pass_low", "format_mean")])
    held = (F.col("post_pass_mean") + 1e-6 >= F.col("base_pass_mean") - 0.01) & (F.col("post_pass_low") + 1e-6 >= F.col("base_pass_low") - 0.02)
    return b.join(p, "benchmark").select("benchmark", held.alias("pass_ok"), (F.col("post_format_mean") <= F.col("base_format_mean") + 0.01).alias("format_ok"))


def gate_failures(scores: DataFrame, checks: DataFrame, max_format: float = 0.02, min_gain: float = 0.15, min_gain_low: float = 0.05, alpha: float = 0.05) -> DataFrame:
    """Names of the gates that fail: scores is one row (post_format, gain, gain_low, p_value), checks per benchmark."""
    named = F.array_compact(F.array(
        F.when(F.col("post_format") >= max_format, "format_error_rate"), F.when(F.col("gain") < min_gain, "relative_improvement"),
        F.when(F.col("gain_low") < min_gain_low, "relative_improvement_lower_bound"), F.when(F.col("p_value") > alpha, "significance")))
    worse = checks.where(~(F.col("pass_ok") & F.col("format_ok"))).agg(F.array_sort(F.collect_list(F.concat(F.lit("no_regression:"), "benchmark"))).alias("_worse"))
    return scores.crossJoin(F.broadcast(worse)).withColumn("failures", F.concat(named, "_worse")).withColumn("passed", F.size("failures") == 0).drop("_worse")


def primary_score(lcb, bcb, swe, agent, fmt) -> Column:
    """(mean, low, high) of the composite from intervals; low takes the format rate's high, and vice versa."""
    part = lambda i, j: 0.35 * F.col(lcb)[i] + 0.25 * F.col(bcb)[i] + 0.20 * F.col(swe)[i] + 0.10 * F.col(agent)[i] + 0.10 * (1.0 - F.col(fmt)[j])
    return F.array(part(0, 0), part(1, 2), part(2, 1))


def report_with_intervals(log: DataFrame, by: str, samples: int, seed: int = 3407) -> DataFrame:
    """The evaluation report: per group the number of cases, and mean, low and high of each metric.

    by: the group column. Each metric is resampled on its own. The log is read once: cases with the same figures are counted into a table.
    """
    rows = log.select(by, metric("pass").alias("pass_at_1"), F.coalesce("pass_at_k", F.lit(False)).cast("double").alias("pass_at_k"), format_error_rate().alias("format_error_rate"), F.coalesce("rounds_used", F.lit(1)).cast("double").alias("rounds"))
    rows = Work(log.sparkSession, "report").save(rows.groupBy(*rows.columns).agg(F.count("*").alias("c")), "counts")
    out = rows.groupBy(by).agg(F.sum("c").alias("total"), (F.sum(F.col("rounds") * F.col("c")) / F.sum("c")).alias("avg_rounds"))
    for name in ("pass_at_1", "pass_at_k", "format_error_rate"):
        ci = stats.bootstrap_ci(rows.select(by, F.col(name).alias("value"), "c"), samples, by, seed)
        out = out.join(ci.select(by, F.array("mean", "low", "high").alias(f"{name}_ci")), by)
    return out


def report_groups(log: DataFrame, groups: dict[str, list[str]], column: str = "grp") -> DataFrame:
    """Cases once for each group of benchmarks that they are in, and once for all."""
    mapping = log.sparkSession.createDataFrame([(g, b) for g, bs in groups.items() for b in bs], f"{column} string, benchmark string")
    return log.join(F.broadcast(mapping), "benchmark").unionByName(log.withColumn(column, F.lit("global")))


def interval_of(values) -> Column:
    """(mean, low, high) of a report's list: a single value stands for all three, an empty list is an error."""
    v = F.col(values) if isinstance(values, str) else values
    empty = F.raise_error(F.lit("a report lacks a metric")).cast("array<double>")
    three = F.transform(F.slice(v, 1, 3), lambda x: x.cast("double"))
    one = F.try_element_at(v, F.lit(1)).cast("double")
    return F.when(F.coalesce(F.size(v), F.lit(0)) < 1, empty).when(F.size(v) >= 3, three).otherwise(F.array(one, one, one))


def gate_inputs(base: DataFrame, post: DataFrame, p_value: DataFrame) -> DataFrame:
    """The gate's row (post_format, gain, gain_low, p_value) from two one-row frames (score, format_rate: mean, low, high) and one with p_value."""
    b = base.select(interval_of("score").alias("_b"))
    p = post.select(interval_of("score").alias("_p"), interval_of("format_rate")[0].alias("post_format"))
    gain = lambda after, before: (after - before) / F.greatest(F.lit(1e-6), before)
    rows = b.crossJoin(F.broadcast(p)).crossJoin(F.broadcast(p_value.select("p_value")))
    return rows.select("post_format", gain(F.col("_p")[0], F.col("_b")[0]).alias("gain"), gain(F.col("_p")[1], F.col("_b")[2]).alias("gain_low"), "p_value")


# What a finished run has left in its folder.
ARTIFACTS = [
    "run_manifest.txt",
    "baseline_eval_classic.json",
    "baseline_eval_classic_cases.jsonl",
    "baseline_eval_agentic.json",
    "baseline_eval_agentic_cases.jsonl",
    "posttrain_eval_classic.json",
    "posttrain_eval_classic_cases.jsonl",
    "posttrain_eval_agentic.json",
    "posttrain_eval_agentic_cases.jsonl",
]


def require_artifacts(spark, folder: str, *more: str) -> None:
    """An error that names the files which a run should have left and hasn't."""
    missing = [p for p in (*(f"{folder.rstrip('/')}/{a}" for a in ARTIFACTS), *more) if not exists(spark, p)]
    if missing:
        raise FileNotFoundError("missing artifacts: " + ", ".join(missing))
