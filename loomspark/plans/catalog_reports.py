"""Registered queries of rejection sampling and of the assembled evaluation report."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomspark.operators import cases, evaluation, rejection
from loomspark.plans import views as V
from .catalog import interval_sql, nine, query

NL = "chr(10)"
S = V.strip_sql
TESTS = ("", "assert f(1) == 2\nassert f(-1) == 0\nassert edge(x)\ny = 1", "assert a")

#: Documents as prompts, a third of them with good tests; line items as their completions, a fifth of them without an answer.
REJECTION_SQL = f"""tested AS (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN source END AS prompt, text, CASE doc_id % 3 {' '.join(f"WHEN {i} THEN {f' || {NL} || '.join(repr(line) for line in t.split(chr(10)))}" for i, t in enumerate(TESTS))} END AS tests FROM documents),
{V.quality_sql('tested', 'doc_id', 'tests')},
good AS (SELECT doc_id, substr(CASE WHEN coalesce(prompt, '') <> '' THEN prompt ELSE coalesce(text, '') END, 1, 7000) AS prompt, tests, quality_score, assert_count FROM tested JOIN measured USING (doc_id) WHERE {S('tests')} <> '' AND assert_count >= 2 AND nonempty_lines >= 3 AND quality_score >= 2.5),
{V.CANDIDATES.strip()},
sampled AS (SELECT prompt_id, '<answer>' || text || '</answer>' AS text, CASE WHEN l_linenumber % 2 = 0 THEN 0.8 ELSE 0.2 END::double AS temperature, score, exec_time, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate FROM candidates WHERE l_linenumber % 5 <> 0),
met AS (SELECT *, count(*) OVER p AS n, row_number() OVER o AS r, sum((score < 2)::int) OVER (o ROWS UNBOUNDED PRECEDING) AS place, first_value(text) OVER o AS best_text, first_value(score) OVER o AS best_score, first_value(temperature) OVER o AS best_temperature
  FROM good JOIN sampled ON prompt_id = doc_id WINDOW p AS (PARTITION BY doc_id), o AS (PARTITION BY doc_id ORDER BY {V.CANDIDATE_ORDER}))"""


def rejected(spark, d):
    """With two evaluated candidates a prompt instead of four: many orders at hand are short."""
    docs = V.read(spark, d, "documents").withColumn("tests", F.element_at(F.array(*[F.lit(t) for t in TESTS]), (F.col("doc_id") % 3 + 1).cast("int")))
    prompt = rejection.prompt_only(F.when(F.col("doc_id") % 4 == 0, F.col("source")), "text")
    found = V.candidates(spark, d).withColumns({
        "key": F.col("prompt_id"), "temperature": F.when(F.col("l_linenumber") % 2 == 0, 0.8).otherwise(0.2),
        "text": F.when(F.col("l_linenumber") % 5 == 0, F.col("text")).otherwise(F.concat(F.lit("<answer>"), "text", F.lit("</answer>")))})
    return rejection.distil(rejection.tested_prompts(docs, "doc_id", prompt, "tests"), rejection.answered(found, "text"), V.TIES, min_evaluated=2)


@query(f"WITH {REJECTION_SQL} SELECT doc_id AS key, prompt || best_text AS text, tests, round(quality_score, 9) AS test_quality_score, assert_count::int AS test_assert_count, best_score AS chosen_score, best_temperature AS chosen_temperature FROM met WHERE r = 1 AND best_score = 2")
def rejection_distilled(spark, d):
    """The distilled corpus of rejection sampling: prompts with good tests and their best passed completion."""
    return rejected(spark, d)[0].drop("prompt").withColumns(nine("test_quality_score"))


@query(f"""WITH {REJECTION_SQL} SELECT doc_id AS key, best_text AS chosen, text AS rejected, best_score AS chosen_score, score AS rejected_score, best_temperature AS chosen_temperature, temperature AS rejected_temperature, best_score - score AS score_gap,
least(8.0, greatest(0.1, best_score - score))::double AS pair_weight, place::bigint AS negative_rank, n AS num_evaluated FROM met WHERE best_score = 2 AND score < 2 AND place <= 3 AND n >= 2 AND best_score - score >= 1.0 AND score <= 0.6""")
def rejection_pairs(spark, d):
    """The same run's preference pairs."""
    return rejected(spark, d)[1].select("key", "chosen", "rejected", "chosen_score", "rejected_score", "chosen_temperature", "rejected_temperature", "score_gap", "pair_weight", "negative_rank", "num_evaluated")


REPORT_SAMPLES = 100
SCOPES_SQL = "SELECT 'benchmark/' || benchmark AS scope, * FROM log UNION ALL SELECT 'global/', * FROM log UNION ALL " + " UNION ALL ".join(
    f"SELECT 'group/{g}', * FROM log WHERE benchmark IN ({', '.join(repr(b) for b in bs)})" for g, bs in evaluation.GROUPS.items())
#: Orders as cases of classic benchmarks, events as cases of two patch benchmarks, one judged by a harness and one by similarity.
REPORT_SQL = f"""{V.CANDIDATES.strip()},
classic AS (SELECT CASE prompt_id % 3 WHEN 0 THEN 'mbpp' WHEN 1 THEN 'humaneval' ELSE 'private_holdout' END AS benchmark, prompt_id::varchar AS id, arg_min(score >= 1.99, l_shipdate::varchar || text) AS pass_at_1, bool_or(score >= 1.99) AS pass_at_k, count(*) FILTER (score < 0.2) AS format_errors, count(*) AS generated, 1 AS rounds, NULL::double AS proxy FROM candidates GROUP BY prompt_id),
k_events AS (SELECT *, regexp_extract(props, '(\\d+)', 1)::int AS k FROM events),
patches AS (SELECT CASE WHEN event_id % 2 = 0 THEN 'swebench_verified_subset' ELSE 'bigcodebench_instruct' END AS benchmark, event_id::varchar AS id,
  CASE WHEN event_id % 2 = 0 THEN user_id % 4 = 0 ELSE k >= 60 END AS pass_at_1, CASE WHEN event_id % 2 = 0 THEN user_id % 4 = 0 ELSE k >= 30 END AS pass_at_k, CASE WHEN event_id % 2 = 0 THEN (value <= 5)::int ELSE k % 3 END AS format_errors,
  CASE WHEN event_id % 2 = 0 THEN 1 ELSE 4 END AS generated, CASE WHEN event_id % 2 = 0 THEN 1 ELSE k % 4 + 1 END AS rounds, CASE WHEN event_id % 2 = 1 THEN (k / 100.0)::double END AS proxy FROM k_events),
log AS (SELECT * FROM classic UNION ALL SELECT * FROM patches), s AS ({SCOPES_SQL}),
a AS (SELECT scope, coalesce(pass_at_1, false)::int::double AS value FROM s), {interval_sql('a', 'scope', REPORT_SAMPLES, 1)},
b AS (SELECT scope, coalesce(pass_at_k, false)::int::double AS value FROM s), {interval_sql('b', 'scope', REPORT_SAMPLES, 1)},
c AS (SELECT scope, format_errors / greatest(1, generated)::double AS value FROM s), {interval_sql('c', 'scope', REPORT_SAMPLES, 8)},
p AS (SELECT scope, proxy AS value FROM s WHERE proxy IS NOT NULL), {interval_sql('p', 'scope', REPORT_SAMPLES, 7)}"""
PARTS = {"a": "pass_at_1", "b": "pass_at_k", "c": "format_error_rate", "p": "resolve_proxy"}


def assembled(spark, d):
    c = V.candidates(spark, d).withColumn("o", F.concat(F.col("l_shipdate").cast("string"), "text"))
    passed = F.col("score") >= 1.99
    classic = cases.classic_case(c.withColumn("passed", passed), "prompt_id", "o", "passed", F.count_if(F.col("score") < 0.2).alias("format_errors"))
    name = F.element_at(F.array(F.lit("mbpp"), F.lit("humaneval"), F.lit("private_holdout")), (F.col("prompt_id") % 3 + 1).cast("int"))
    classic = classic.select(name.alias("benchmark"), F.col("prompt_id").cast("string").alias("id"), "pass_at_1", F.col("pass_any_k").alias("pass_at_k"), "format_errors", "generated_candidates")
    e = V.read(spark, d, "events").withColumn("k", F.regexp_extract("props", r"(\d+)", 1).cast("int")).withColumn("id", F.col("event_id").cast("string"))
    harness = e.where("event_id % 2 = 0").select(F.lit("swebench_verified_subset").alias("benchmark"), "id", F.when(F.col("value") > 5, "diff").alias("best_patch"), F.lit(0.5).alias("resolve_proxy"))
    judged = evaluation.patch_log(harness, e.where("user_id % 4 = 0").select("id"))
    alike = e.where("event_id % 2 = 1").select(
        F.lit("bigcodebench_instruct").alias("benchmark"), "id", (F.col("k") >= 60).alias("pass_at_1"), (F.col("k") >= 30).alias("pass_at_k"), (F.col("k") % 3).alias("format_errors"), F.lit(4).alias("generated_candidates"),
        (F.col("k") % 4 + 1).alias("rounds_used"), (F.col("k") / 100.0).alias("resolve_proxy"))
    return evaluation.report(evaluation.assemble(classic, judged, evaluation.patch_log(alike)), REPORT_SAMPLES)


@query(f"""WITH {REPORT_SQL} SELECT t.scope, total, round(avg_rounds, 9) AS avg_rounds, {', '.join(f"round({x}_ci.{part}, 9)::double AS {m}_{part}" for x, m in PARTS.items() for part in ('mean', 'low', 'high'))}
FROM (SELECT scope, count(*) AS total, avg(rounds)::double AS avg_rounds FROM s GROUP BY scope) t {' '.join(f"LEFT JOIN {x}_ci ON {x}_ci.cell = t.scope" for x in PARTS)}""")
def assembled_report(spark, d):
    """Classic, harness-judged and similarity-judged cases in one report, by benchmark, group and in all."""
    found = assembled(spark, d)
    flat = {f"{m}_{part}": F.round(F.col(f"{m}_ci")[i], 9) for m in PARTS.values() for i, part in enumerate(("mean", "low", "high"))}
    return found.withColumns(flat | nine("avg_rounds")).drop(*[f"{m}_ci" for m in PARTS.values()])
