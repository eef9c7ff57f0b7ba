"""The evaluation report: cases of classic, agentic and patch benchmarks in one log, and its intervals by benchmark, group and in all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.operators import cases, stats
from loomspark.functions.text import strip
from loomspark.sources.work import Work

# Groups of benchmarks that a report sums up.
GROUPS = {
    "contamination_safe_coding": ["livecodebench", "mbpp", "humaneval"],
    "practical_swe_agentic": ["bigcodebench_instruct", "swebench_verified_subset"],
    "private_holdout": ["private_holdout"],
}
METRICS = ("pass_at_1", "pass_at_k", "format_error_rate")
LOG = "benchmark string, id string, pass_at_1 boolean, pass_at_k boolean, format_errors int, generated_candidates int, rounds_used int, resolve_proxy double"


def as_log(df: DataFrame) -> DataFrame:
    """df with the columns of a case log in their types, null where it has none."""
    fields = [f.split() for f in LOG.split(", ")]
    return df.select(*[(F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in fields])


def patch_log(patches: DataFrame, resolved: DataFrame | None = None) -> DataFrame:
    """Cases of patch benchmarks (benchmark, id, best_patch, resolve_proxy, and passes by proxy). resolved: ids that a harness has
    resolved, if one ran: these alone pass then, a case has one candidate, an error if it is blank, and no proxy is reported."""
    if resolved is None:
        return as_log(patches)
    run = cases.apply_resolved(patches.drop("pass_at_1", "pass_at_k"), resolved)
    blank = (strip(F.coalesce("best_patch", F.lit(""))) == "").cast("int")
    return as_log(run.withColumns({"format_errors": blank, "generated_candidates": F.lit(1), "rounds_used": F.lit(1), "resolve_proxy": F.lit(None).cast("double")}))


def assemble(*logs: DataFrame) -> DataFrame:
    """All benchmarks' cases as one log."""
    whole = as_log(logs[0])
    for log in logs[1:]:
        whole = whole.unionByName(as_log(log))
    return whole


def scopes(log: DataFrame, groups: dict[str, list[str]] = GROUPS) -> DataFrame:
    """Each case once for its benchmark, for each group that has it, and for all; scope is the kind, a slash and the name."""
    mine = F.array(*[F.when(F.col("benchmark").isin(bs), F.lit(f"group/{g}")) for g, bs in groups.items()])
    every = F.concat(F.array(F.concat(F.lit("benchmark/"), F.col("benchmark")), F.lit("global/")), F.array_compact(mine))
    return log.withColumn("scope", F.explode(F.array_compact(every)))


def report(log: DataFrame, samples: int, groups: dict[str, list[str]] = GROUPS) -> DataFrame:
    """scope, total, avg_rounds, and mean, low and high of each metric; of resolve_proxy where cases have one.

    The log is read once: cases of a benchmark with the same figures are counted into a table, and scopes and metrics work on the counts.
    """
    passed = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    values: dict[str, Column] = {"pass_at_1": passed("pass_at_1"), "pass_at_k": passed("pass_at_k"), "format_error_rate": cases.format_error_rate(), "resolve_proxy": F.col("resolve_proxy")}
    figures = log.select("benchmark", F.coalesce("rounds_used", F.lit(1)).cast("long").alias("rounds"), *[value.alias(name) for name, value in values.items()])
    counts = Work(log.sparkSession, "report").save(figures.groupBy(*figures.columns).agg(F.count("*").alias("c")), "counts")
    rows = scopes(counts, groups)
    out = rows.groupBy("scope").agg(F.sum("c").alias("total"), (F.sum(F.col("rounds") * F.col("c")) / F.sum("c")).alias("avg_rounds"))
    for name in values:
        ci = stats.bootstrap_ci(rows.select("scope", F.col(name).alias("value"), "c"), samples, "scope")
        out = out.join(ci.select("scope", F.array("mean", "low", "high").alias(f"{name}_ci")), "scope", "left")
    return out


def report_json(found: DataFrame) -> str:
    """The report as JSON: per_benchmark, groups and global. A report has a row for each benchmark and group, so it is small."""
    part = F.struct(*[c for c in found.columns if c != "scope"])
    entry = F.struct(F.substring_index("scope", "/", -1).alias("name"), part.alias("part"))
    of = lambda kind: F.map_from_entries(F.array_sort(F.collect_list(F.when(F.startswith("scope", F.lit(f"{kind}/")), entry))))
    whole = F.struct(of("benchmark").alias("per_benchmark"), of("group").alias("groups"), F.first(F.when(F.col("scope") == "global/", part), ignorenulls=True).alias("global"))
    return found.agg(F.to_json(whole)).first()[0]


def lines(found: DataFrame) -> DataFrame:
    """A printed line for each scope and metric, in per cent."""
    from loomspark.functions.text import percent

    ci = lambda m: F.concat(F.lit(f"{m}: "), percent(*[F.col(f"{m}_ci")[i] for i in range(3)]))
    return found.select("scope", F.explode(F.array(*[ci(m) for m in METRICS])).alias("line"))


def save_report(spark: SparkSession, found: DataFrame, path: str) -> None:
    from loomspark.sources import sinks

    sinks.write_text(spark, path, report_json(found))
