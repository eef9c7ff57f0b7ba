"""Derived tables that the registered queries share, as frames and as SQL.

The tables at hand hold no answers, tests or evaluation logs, so answer- and log-shaped rows
are derived from documents, events and lineitem. Each view stands here twice: as a frame,
and as the SQL that the oracles start from.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomspark.functions.text import assistant_block, turn


def read(spark: SparkSession, d: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{table}.parquet")


def strip_sql(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def hash8_sql(x: str) -> str:
    return f"cast('0x' || substr(sha256({x}), 1, 8) AS bigint)"


def shuffle_sql(key: str, seed: int = 3407) -> str:
    return f"sha256('{seed}|' || {key})"


def normal_sql(x: str) -> str:
    return f"regexp_replace({strip_sql(f"regexp_replace(lower({x}), '\\s+', ' ', 'g')")}, '[^a-z0-9_<>/| ]', '', 'g')"


def corpus(spark: SparkSession, d: str) -> DataFrame:
    """Documents as chat records: the text is the prompt, its lines from the second on are the answer."""
    docs = read(spark, d, "documents").select(F.col("doc_id").alias("row_idx"), F.col("text").alias("prompt"), "source")
    at = F.instr("prompt", "\n")
    docs = docs.withColumn("answer", F.when(at > 0, F.expr("substring(prompt, instr(prompt, '\\n') + 1)")).otherwise(""))
    return docs.withColumn("text", F.concat(turn("user", F.col("prompt")), assistant_block(F.col("answer"))))


CORPUS = f"""
answers AS (SELECT doc_id AS row_idx, text AS prompt, source, CASE WHEN strpos(text, chr(10)) > 0 THEN substr(text, strpos(text, chr(10)) + 1) ELSE '' END AS answer FROM documents),
corpus AS (SELECT *, '<|im_start|>user' || chr(10) || prompt || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10) || '<answer>' || chr(10) || {strip_sql('answer')} || chr(10) || '</answer><|im_end|>' AS text FROM answers)"""


def case_logs(spark: SparkSession, d: str) -> DataFrame:
    """Events as evaluation logs of two runs: even ids before, odd ids after."""
    e = read(spark, d, "events").withColumn("side", F.when(F.col("event_id") % 2 == 0, "base").otherwise("post"))
    place = F.row_number().over(Window.partitionBy("event_type", "user_id", "side").orderBy("event_id"))
    k = F.regexp_extract("props", r"(\d+)", 1).cast("int")
    return e.select(
        "event_id", "side", F.col("event_type").alias("benchmark"), F.lit("code").alias("mode"), F.concat_ws("_", F.col("user_id").cast("string"), place.cast("string")).alias("id"),
        (F.col("value") > 100).alias("pass_at_1"), (F.col("value") > 50).alias("pass_at_k"), k.alias("format_errors"), F.lit(100).alias("generated_candidates"), (k % 4 + 1).alias("rounds_used"))


CASE_LOGS = """
k_events AS (SELECT *, CASE WHEN event_id % 2 = 0 THEN 'base' ELSE 'post' END AS side, cast(regexp_extract(props, '(\\d+)', 1) AS int) AS k FROM events),
logs AS (SELECT event_id, side, event_type AS benchmark, 'code' AS mode,
  user_id || '_' || row_number() OVER (PARTITION BY event_type, user_id, side ORDER BY event_id) AS id,
  value > 100 AS pass_at_1, value > 50 AS pass_at_k, k AS format_errors, 100 AS generated_candidates, k % 4 + 1 AS rounds_used FROM k_events),
base AS (SELECT * FROM logs WHERE side = 'base'), post AS (SELECT * FROM logs WHERE side = 'post')"""
#: The composite's components on these logs.
BENCHMARKS = {"livecodebench": "click", "bigcodebench_instruct": "view", "swebench_verified_subset": "purchase"}

TIES = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate"]


def candidates(spark: SparkSession, d: str) -> DataFrame:
    """Line items as completions: an order is a prompt, the return flag a score."""
    score = F.when(F.col("l_returnflag") == "R", 2.0).when(F.col("l_returnflag") == "A", 0.5).otherwise(0.1)
    text = F.concat_ws("-", F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string"), F.col("l_linenumber").cast("string"))
    return read(spark, d, "lineitem").select(F.col("l_orderkey").alias("prompt_id"), score.alias("score"), F.col("l_discount").alias("exec_time"), text.alias("text"), *TIES)


CANDIDATES = """
candidates AS (SELECT l_orderkey AS prompt_id, CASE l_returnflag WHEN 'R' THEN 2.0::double WHEN 'A' THEN 0.5::double ELSE 0.1::double END AS score, l_discount AS exec_time,
  l_partkey || '-' || l_suppkey || '-' || l_linenumber AS text, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate FROM lineitem)"""
CANDIDATE_ORDER = "score DESC, exec_time, length(text), l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate"

PAIRS = f"""{CANDIDATES},
ranked AS (SELECT *, count(*) OVER (PARTITION BY prompt_id) AS num_evaluated,
  first_value(text) OVER w AS chosen, first_value(score) OVER w AS chosen_score,
  sum(CASE WHEN score < 1.99 THEN 1 ELSE 0 END) OVER (PARTITION BY prompt_id ORDER BY {CANDIDATE_ORDER} ROWS UNBOUNDED PRECEDING) AS negative_rank
  FROM candidates WINDOW w AS (PARTITION BY prompt_id ORDER BY {CANDIDATE_ORDER})),
pairs AS (SELECT prompt_id, chosen, text AS rejected, chosen_score, score AS rejected_score, chosen_score - score AS score_gap, negative_rank, num_evaluated,
  least(8.0, greatest(0.1, chosen_score - score)) AS pair_weight FROM ranked
  WHERE chosen_score >= 1.99 AND score < 1.99 AND negative_rank <= 3 AND chosen_score - score >= 1.0 AND score <= 0.6)"""


def failures(spark: SparkSession, d: str) -> DataFrame:
    """Events as failed runs with an error, rounds, candidates and test quality."""
    k = F.regexp_extract("props", r"(\d+)", 1).cast("int")
    error = F.create_map(*[F.lit(x) for kv in {"click": "timeout", "error": "assertion", "purchase": "syntax", "signup": "format"}.items() for x in kv])
    return read(spark, d, "events").select(
        "event_id", F.coalesce(F.try_element_at(error, F.col("event_type")), F.lit("other")).alias("error_type"), (k % 5 + 1).alias("rounds_used"), k.alias("generated_candidates"),
        (F.col("value") / 20).alias("test_quality_score"), F.concat(F.lit("user "), F.col("user_id").cast("string")).alias("prompt"), F.concat(F.col("event_type"), (k % 10).cast("string")).alias("tests"), (F.col("value") > 100).alias("pass_at_1"))


FAILURES = """
failures AS (SELECT event_id, CASE event_type WHEN 'click' THEN 'timeout' WHEN 'error' THEN 'assertion' WHEN 'purchase' THEN 'syntax' WHEN 'signup' THEN 'format' ELSE 'other' END AS error_type,
  cast(regexp_extract(props, '(\\d+)', 1) AS int) % 5 + 1 AS rounds_used, cast(regexp_extract(props, '(\\d+)', 1) AS int) AS generated_candidates, value / 20 AS test_quality_score,
  'user ' || user_id AS prompt, event_type || (cast(regexp_extract(props, '(\\d+)', 1) AS int) % 10) AS tests, value > 100 AS pass_at_1 FROM events),
hard AS (SELECT *, round(1.35 * CASE error_type WHEN 'timeout' THEN 0.9 WHEN 'assertion' THEN 0.6 WHEN 'syntax' THEN 0.72 WHEN 'format' THEN 0.8 ELSE 0.45 END
  + least(0.6, 0.12 * greatest(1, rounds_used)) + least(0.55, 0.03 * greatest(0, greatest(1, generated_candidates) - 1)) + least(0.7, 0.05 * test_quality_score), 9)::double AS hardness FROM failures)"""


def graded(spark: SparkSession, d: str) -> DataFrame:
    """Documents as training rows with difficulty."""
    from loomspark.functions.quality import difficulty, macro_bucket, test_quality

    docs = read(spark, d, "documents").select("doc_id", "source", F.col("n_chars").alias("prompt_length"), (F.col("doc_id") % 11).cast("int").alias("test_assert_count"), test_quality("text").alias("q"))
    docs = docs.withColumn("test_quality_score", F.round("q.quality_score", 9)).drop("q")
    return docs.withColumns({"difficulty_score": F.round(difficulty("prompt_length", "test_assert_count", "test_quality_score"), 9), "macro_bucket": macro_bucket("source", F.lit(""), "prompt_length", F.lit(""))})


def terms_sql(terms: tuple[str, ...]) -> str:
    return "(" + " + ".join(f"contains(low, '{t}')::int" for t in terms) + ")"


def quality_sql(table: str, key: str, text: str) -> str:
    """CTEs up to ``measured``: the test quality of a text column."""
    from loomspark.functions.quality import BOUNDARY_TERMS, PROPERTY_TERMS, RANDOM_TERMS

    return f"""
stripped AS (SELECT {key}, {strip_sql(text)} AS t FROM {table}), lowered AS (SELECT *, lower(t) AS low FROM stripped),
counted AS (SELECT {key}, len(list_filter(regexp_split_to_array(t, '[\\r\\n]+'), lambda x: regexp_matches(x, '\\S'))) AS nonempty_lines,
  len(regexp_extract_all(chr(10) || t, '\\n[ \\t]*assert\\b')) AS assert_count, len(regexp_extract_all(chr(10) || t, '\\n[ \\t]*def[ \\t]+test_')) AS test_fn_count,
  {terms_sql(BOUNDARY_TERMS)} AS boundary_hits, {terms_sql(PROPERTY_TERMS)} AS property_hits, {terms_sql(RANDOM_TERMS)} AS random_hits FROM lowered),
measured AS (SELECT *, round(0.9 * assert_count + 1.2 * test_fn_count + 0.4 * boundary_hits + 0.5 * property_hits + 0.5 * random_hits + least(1.5, nonempty_lines / 20.0), 9)::double AS quality_score FROM counted)"""


GRADED = f"""{quality_sql('documents', 'doc_id', 'text')},
graded AS (SELECT d.doc_id, d.source, n_chars AS prompt_length, (d.doc_id % 11)::int AS test_assert_count, quality_score AS test_quality_score,
  round(0.55 * least(1.0, n_chars / 2400.0) + 0.25 * least(1.0, (d.doc_id % 11) / 10.0) + 0.20 * least(1.0, quality_score / 10.0), 9)::double AS difficulty_score,
  CASE WHEN n_chars >= 1700 THEN 'repo_resolution' ELSE 'core_code' END AS macro_bucket FROM documents d JOIN measured m USING (doc_id))"""
