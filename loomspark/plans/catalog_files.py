"""Registered queries of readers, writers, benchmark cases and the verifier. Files are written below the shared work folder and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomspark.functions import quality as Q
from loomspark.functions import rewards as R
from loomspark.functions import text as X
from loomspark.operators import cases, curriculum, repair, sampling, verify
from loomspark.plans import views as V
from loomspark.sources import readers, sinks
from loomspark.sources.repository import list_files, write_files
from loomspark.sources.work import Work
from loomspark.streaming import state
from .catalog import SPLIT_SQL, query, split_documents

S = V.strip_sql
NL = "chr(10)"


# --- scans ------------------------------------------------------------------------------

@query("SELECT doc_id, text FROM documents")
def fallback_scan(spark, d):
    return readers.first_readable(spark, [f"{d}/no_such_table.parquet", f"{d}/documents.parquet"]).select("doc_id", "text")


@query("SELECT 'documents' AS source, count(*) AS n, 'nothing' AS missing FROM documents UNION ALL SELECT 'labels', count(*), 'nothing' FROM labels")
def tolerant_sources(spark, d):
    loaders = {n: (lambda n=n: V.read(spark, d, n)) for n in ("documents", "labels", "nothing")}
    found, missing = readers.tolerant(loaders, 1)
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("source"), "n", F.lit(",".join(missing)).alias("missing")) for name, df in found.items()]
    return parts[0].unionByName(parts[1])


@query(f"SELECT doc_id FROM (SELECT doc_id, {SPLIT_SQL} AS split FROM documents) WHERE split = 'val'")
def split_choice(spark, d):
    return readers.choose_split(split_documents(spark, d), ("missing", "val")).select("doc_id")


@query(f"SELECT doc_id, text FROM (SELECT doc_id, text, {SPLIT_SQL} AS split FROM documents) WHERE split = 'train' ORDER BY doc_id LIMIT 100")
def prompt_scan(spark, d):
    """The head is the feature: the first prompts of the chosen split."""
    return readers.prompt_scan(split_documents(spark, d), 100, "doc_id").select("doc_id", "text")


@query("SELECT doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM documents) WHERE rn <= 10")
def source_heads(spark, d):
    """The head is the feature: each source's first rows in order of arrival."""
    return sampling.head_per_source(V.read(spark, d, "documents").select("doc_id", "source"), "source", 10, "doc_id")


@query(f"""WITH h AS (SELECT *, row_number() OVER (ORDER BY doc_id) - 1 AS i FROM (SELECT doc_id, text, CASE WHEN doc_id % 3 = 0 THEN '' ELSE 'assert ' || doc_id END AS tests, {SPLIT_SQL} AS split FROM documents) WHERE split = 'holdout' ORDER BY doc_id LIMIT 50)
SELECT doc_id, 'private_holdout_' || i AS id, tests FROM h WHERE {S("coalesce(text, '')")} <> '' AND tests <> ''""")
def holdout_cases(spark, d):
    """The head is the feature: the first rows of the holdout, then those with a prompt and tests."""
    rows = split_documents(spark, d).withColumn("split", F.when(F.col("split") == "holdout", "holdout_clean").otherwise(F.col("split")))
    rows = rows.select("doc_id", F.col("text").alias("prompt"), F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.concat(F.lit("assert "), F.col("doc_id").cast("string"))).alias("tests"), "split")
    return readers.holdout_cases(rows, 50, "doc_id").select("doc_id", "id", "tests")


# --- benchmark cases --------------------------------------------------------------------

CASE_COLUMNS = ["benchmark", "id", "prompt", "tests", "mode"]


@query(f"SELECT 'mbpp' AS benchmark, item_id::varchar AS id, {S('text')} AS prompt, 'assert f(1)' || {NL} || 'assert f(' || item_id || ')' AS tests, 'code' AS mode FROM benchmark")
def cases_mbpp(spark, d):
    rows = V.read(spark, d, "benchmark").select(F.col("item_id").alias("task_id"), "text", F.array(F.lit("assert f(1)"), F.concat(F.lit("assert f("), F.col("item_id").cast("string"), F.lit(")"))).alias("test_list"))
    return readers.cases(rows, "mbpp").select(*CASE_COLUMNS)


@query(f"SELECT 'humaneval' AS benchmark, 'HumanEval/' || item_id AS id, {S('text')} AS prompt, 'def check(f): pass' || CASE WHEN item_id % 2 = 0 THEN {NL} || 'check(f' || item_id || ')' ELSE '' END AS tests, 'code' AS mode FROM benchmark")
def cases_humaneval(spark, d):
    entry = F.when(F.col("item_id") % 2 == 0, F.concat(F.lit("f"), F.col("item_id").cast("string"))).otherwise(" ")
    rows = V.read(spark, d, "benchmark").select(F.concat(F.lit("HumanEval/"), F.col("item_id").cast("string")).alias("task_id"), F.col("text").alias("prompt"), F.lit("def check(f): pass").alias("test"), entry.alias("entry_point"))
    return readers.cases(rows, "human_eval").select(*CASE_COLUMNS)


@query(f"SELECT 'livecodebench' AS benchmark, item_id::varchar AS id, {S('text')} AS prompt, 'assert solve(' || item_id || ') == ' || item_id + 1 || {NL} || 'assert solve(2, 3) == 5' AS tests, 'code' AS mode FROM benchmark WHERE {S('text')} <> ''")
def cases_livecodebench(spark, d):
    """Tests made of pairs of input and output."""
    k = F.col("item_id")
    pair = lambda i, o: F.struct(i.alias("input"), o.alias("output"))
    pairs = F.array(pair(k.cast("string"), (k + 1).cast("string")), pair(F.lit("(2, 3)"), F.lit("5")))
    rows = V.read(spark, d, "benchmark").select(k.alias("question_id"), F.col("text").alias("question_content"), pairs.alias("private_test_cases"), F.lit("solve").alias("entry_point"))
    return readers.cases(rows, "livecodebench").select(*CASE_COLUMNS)


@query(f"SELECT 'bigcodebench_instruct' AS benchmark, 'B' || item_id AS id, {S('text')} AS prompt, 'assert ' || item_id AS tests, 'code' AS mode FROM benchmark WHERE item_id % 2 = 0 AND {S('text')} <> ''")
def cases_bigcodebench(spark, d):
    """Cases without tests go."""
    rows = V.read(spark, d, "benchmark").select(F.concat(F.lit("B"), F.col("item_id").cast("string")).alias("task_id"), F.col("text").alias("instruct_prompt"), F.when(F.col("item_id") % 2 == 0, F.concat(F.lit(" assert "), F.col("item_id").cast("string"))).alias("test"))
    return readers.cases(rows, "bigcodebench_instruct").select(*CASE_COLUMNS)


@query(f"SELECT 'swebench_verified_subset' AS benchmark, 'repo-' || item_id AS id, 'Issue:' || {NL} || {S('text')} AS prompt, '' AS tests, 'patch' AS mode, 'diff ' || item_id AS reference_patch FROM benchmark")
def cases_swebench(spark, d):
    rows = V.read(spark, d, "benchmark").select(F.concat(F.lit("repo-"), F.col("item_id").cast("string")).alias("instance_id"), F.col("text").alias("problem_statement"), F.concat(F.lit("diff "), F.col("item_id").cast("string")).alias("patch"))
    return readers.cases(rows, "swebench_verified_subset").select(*CASE_COLUMNS, "reference_patch")


# --- files ------------------------------------------------------------------------------

LOG_COLUMNS = ["benchmark", "id", "mode", "pass_at_1", "format_errors"]


@query(f"WITH {V.CASE_LOGS} SELECT benchmark, id, mode, pass_at_1, format_errors FROM logs WHERE event_id % 10 <> 0")
def jsonl_permissive_scan(spark, d):
    """Case logs written as JSON lines with broken ones among them, and read back."""
    path = Work(spark, "case-logs").path("lines")
    logs = V.case_logs(spark, d).select(*LOG_COLUMNS, "event_id")
    line = F.when(F.col("event_id") % 10 == 0, '{"benchmark": ').otherwise(F.to_json(F.struct(*LOG_COLUMNS)))
    logs.select(line.alias("value")).write.text(path)
    return readers.read_jsonl(spark, [path, path + "-missing"]).select(*LOG_COLUMNS)


@query(f"WITH {V.CASE_LOGS} SELECT benchmark, id, mode, pass_at_1, format_errors FROM logs")
def case_log_jsonl(spark, d):
    """Case logs written as JSON lines and read strictly."""
    path = Work(spark, "case-logs").path("lines")
    sinks.save_jsonl(V.case_logs(spark, d).select(*LOG_COLUMNS), path)
    return readers.read_jsonl_strict(spark, path).select(*LOG_COLUMNS)


@query("SELECT item_id::varchar AS instance_id, text AS model_patch, text AS patch, 'm' AS model_name_or_path FROM benchmark")
def predictions_jsonl(spark, d):
    path = Work(spark, "predictions").path("lines")
    sinks.save_predictions(V.read(spark, d, "benchmark").select(F.col("item_id").cast("string").alias("id"), F.col("text").alias("patch")), path, "m")
    return readers.read_jsonl_strict(spark, path, "instance_id string, model_patch string, patch string, model_name_or_path string")


@query(f"SELECT doc_id, {SPLIT_SQL} AS split FROM documents WHERE {SPLIT_SQL} = 'holdout'")
def saved_splits(spark, d):
    """A table saved by split, of which one is read: a pruned scan."""
    path = Work(spark, "splits").path("table")
    sinks.save_table(split_documents(spark, d).select("doc_id", "split"), path)
    return spark.read.parquet(path).where("split = 'holdout'")


@query("SELECT count(*) AS total, count(DISTINCT source) AS n_sources, 'corpus_manifest_v1' AS schema_version FROM documents")
def manifest_json(spark, d):
    """Counts written as one JSON document and read back."""
    path = Work(spark, "manifest").path("manifest.json")
    row = V.read(spark, d, "documents").agg(F.count("*").alias("total"), F.countDistinct("source").alias("n_sources")).first()
    sinks.save_manifest(spark, path, {"schema_version": "corpus_manifest_v1", **row.asDict()})
    return readers.read_json(spark, path).select("total", "n_sources", "schema_version")


@query("SELECT 'events' AS key, count(*)::varchar AS value FROM events UNION ALL SELECT 'seed', '3407'")
def run_manifest(spark, d):
    path = Work(spark, "manifest").path("run_manifest.txt")
    sinks.save_run_manifest(spark, path, {"seed": 3407, "events": V.read(spark, d, "events").count()})
    return spark.read.text(path).select(F.substring_index("value", "=", 1).alias("key"), F.regexp_replace("value", "^[^=]*=", "").alias("value")).where("key IN ('seed', 'events')")


@query("SELECT (doc_id % 1024)::int AS bucket, sum(n_chars) / 8.0::double AS weight, (SELECT count(*) FROM documents) / 4.0::double AS bias, 1024 AS buckets FROM documents GROUP BY ALL")
def saved_weights(spark, d):
    """Weights made of documents' lengths, written as a model and read again."""
    docs, path = V.read(spark, d, "documents"), Work(spark, "weights").held() + "/model"
    weights = docs.groupBy((F.col("doc_id") % 1024).cast("int").alias("bucket")).agg((F.sum("n_chars") / 8.0).alias("weight"))
    bias = docs.agg(F.lit(-1).alias("bucket"), (F.count("*") / 4.0).alias("weight"))
    sinks.save_weights(weights.unionByName(bias), path, 1024)
    weights, bias, buckets = sinks.load_weights(spark, path)
    return weights.select("bucket", "weight", F.lit(bias).alias("bias"), F.lit(buckets).alias("buckets"))


def repository(spark, d) -> str:
    """Documents as files of a repository, some of them in folders that a walk leaves out; its root."""
    root = Work(spark, "repository").held()
    folder = F.element_at(F.array(*[F.lit(x) for x in ("src", ".git", "node_modules", "a/b", ".tool_cache")]), (F.col("doc_id") % 5 + 1).cast("int"))
    name = F.concat(folder, F.lit("/"), F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 3 == 0, ".bin").otherwise(".py"))
    write_files(V.read(spark, d, "documents").where("source IS NOT NULL").select(name.alias("path"), "text"), "path", "text", root)
    return root


REPOSITORY_SQL = f"repo AS (SELECT CASE doc_id % 5 WHEN 0 THEN 'src' ELSE 'a/b' END || '/' || source || '/' || doc_id || '.py' AS path, substr(text, 1, 2500) AS body FROM documents WHERE source IS NOT NULL AND doc_id % 5 IN (0, 3) AND doc_id % 3 <> 0 AND {S('substr(text, 1, 2500)')} <> '')"


@query(f"WITH {REPOSITORY_SQL} SELECT path, body FROM repo")
def repository_walk(spark, d):
    return readers.repository(spark, repository(spark, d), max_files=0)


@query(f"WITH {REPOSITORY_SQL} SELECT path, length(body) AS n_chars FROM repo")
def cached_index(spark, d):
    """An index kept under the repository's signature: the second call reads what the first one wrote."""
    root, work = repository(spark, d), Work(spark, "cache").held()
    files = list_files(spark, root)
    build = lambda: readers.repository(spark, root, max_files=0).select("path", F.length("body").cast("long").alias("n_chars"))
    sinks.cached_table(spark, work, sinks.repository_signature(files), build)
    return sinks.cached_table(spark, work, sinks.repository_signature(files), lambda: 1 / 0)


@query("SELECT item_id::varchar AS id, coalesce(text, '') AS prompt, 'assert f' || item_id || '()' AS tests FROM benchmark WHERE item_id IS NOT NULL")
def task_table(spark, d):
    rows = V.read(spark, d, "benchmark").withColumn("tests", F.concat(F.lit("assert f"), F.col("item_id").cast("string"), F.lit("()")))
    return readers.tasks(rows, "item_id", "text", "tests")


@query("""WITH passed AS (SELECT 'p' || doc_id % 3 || '.py' AS program, unnest(list_distinct(['--f' || n_chars % 7, '--g' || n_chars % 4])) AS flag FROM documents WHERE n_chars IS NOT NULL),
declared AS (SELECT DISTINCT 'p' || doc_id % 2 || '.py' AS program, '--f' || doc_id % 5 AS flag FROM documents)
SELECT program, flag, count(*) AS n, (program, flag) IN (SELECT (program, flag) FROM declared) AS declared FROM passed WHERE program IN (SELECT program FROM declared) GROUP BY program, flag""")
def command_flag_drift(spark, d):
    """Flags that documents' scripts pass, and whether the programs' sources, a line of each from every document, declare them."""
    docs = V.read(spark, d, "documents")
    text = lambda c, n: (F.col(c) % n).cast("string")
    script = F.concat(F.lit("set -e; python3 -u p"), text("doc_id", 3), F.lit(".py --f"), text("n_chars", 7), F.lit(" 1 \\\n  --g"), text("n_chars", 4), F.lit("\npython other.py --h\n"))
    source = F.concat(F.lit("p.add_argument('--f"), text("doc_id", 5), F.lit("', type=int)"))
    sources = docs.select(F.concat(F.lit("p"), text("doc_id", 2), F.lit(".py")).alias("program"), source.alias("source"))
    return readers.flag_drift(docs.select(script.alias("script")), "script", sources, "program", "source")


# --- verifier ---------------------------------------------------------------------------

SHAPES = [
    ("def f(x):\n    return x + 1", "assert f(1) == 2\nassert f(2) == 3", 2.0, "", 2, 2),
    ("def f(x):\n    return x", "assert f(1) == 2\nassert f(2) == 2", 0.5, "assertion", 1, 2),
    ("def f(x):\n    raise ValueError(x)", "assert f(1) == 2", 0.1, "runtime", 0, 1),
    ("def f(x:", "assert f(1)", 0.0, "syntax", 0, 0),
    ("import os", "assert True", -1.0, "security", 0, 0),
    ("def f(x):\n    return 1", "assert f(1) == 1\nboom()\nassert f(2) == 1", 0.1, "runtime", 1, 1),
    ("import random\nrandom.seed(5)\ndef f(x):\n    return random.random()", "a = f(1)\nassert a != 0.6229016948897019\nassert 0 <= a < 1", 2.0, "", 2, 2),
]
SHAPES_SQL = f"CASE conv_id % {len(SHAPES)} " + " ".join(f"WHEN {i} THEN {{{i}}}" for i in range(len(SHAPES))) + " END"


def shape_sql(column: int) -> str:
    return SHAPES_SQL.format(*(f"'{s[column]}'" if isinstance(s[column], str) else s[column] for s in SHAPES))


@query(f"SELECT conv_id::varchar AS conv_id, unnest(range(0, 2))::int AS round, {shape_sql(2)}::double AS score, {shape_sql(3)} AS error_type, {shape_sql(4)}::int AS assert_passed, {shape_sql(5)}::int AS assert_total FROM (SELECT DISTINCT conv_id FROM conversations WHERE conv_id IS NOT NULL)")
def verifier_runs(spark, d):
    """Small programs of known outcome, run with two seeds each; code is only run where it is allowed, as here."""
    at = F.col("conv_id") % len(SHAPES) + 1
    pick = lambda i: F.element_at(F.array(*[F.lit(s[i]) for s in SHAPES]), at.cast("int"))
    rows = V.read(spark, d, "conversations").where("conv_id IS NOT NULL").select("conv_id").distinct().select("conv_id", pick(0).alias("code"), pick(1).alias("tests"))
    return verify.run_verifier(rows, "conv_id", "code", "tests", rounds=2, seconds=5.0, allow_execution=True).drop("exec_time")


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN doc_id % 7 END::int AS passed, CASE WHEN doc_id % 2 = 0 THEN 7 END::int AS total FROM documents")
def assert_counts(spark, d):
    """Counts found in whole outputs."""
    said = F.concat(F.coalesce("text", F.lit("")), F.lit(f"\n{verify.COUNT_TAG} "), (F.col("doc_id") % 7).cast("string"), F.when(F.col("doc_id") % 2 == 0, " 7\n").otherwise(" of 7\n"))
    return V.read(spark, d, "documents").select("doc_id", Q.assert_counts(said).alias("c")).select("doc_id", "c.passed", "c.total")


@query("SELECT conv_id, turn, coalesce(CASE (conv_id + turn) % 3 WHEN 0 THEN text WHEN 1 THEN coalesce(nullif(text, ''), role) ELSE role END, '') AS completion FROM conversations")
def completion_texts(spark, d):
    """Completions as lists of messages; an empty content falls through to the text."""
    kind = (F.col("conv_id") + F.col("turn")) % 3
    message = F.struct(F.when(kind < 2, F.col("text")).alias("content"), F.when(kind == 0, F.col("text")).otherwise(F.col("role")).alias("text"))
    rows = V.read(spark, d, "conversations").withColumn("completion", F.array(message, message))
    return rows.select("conv_id", "turn", repair.completion_text(rows, "completion").alias("completion"))


def turns(spark, d):
    return V.read(spark, d, "conversations").select("conv_id", "turn", "role", F.col("text").alias("said"))


@query(f"""SELECT conv_id, turn, 'P<|im_start|>assistant' || {NL} || {S("replace(coalesce(text, ''), '<|im_end|>', '')")} || '<|im_end|>' || {NL} || '<|im_start|>user' || {NL} || 'Self-debug round ' || turn || '.' || {NL} || '{repair.POLICIES['timeout'][0]}' || {NL} || 'Failure details:' || {NL}
|| 'error_type=timeout' || {NL} || 'stderr=' || substr(coalesce(text, ''), 1, 1800) || {NL} || 'stdout=' || substr(coalesce(role, ''), 1, 400) || {NL} || {NL} || 'Previous code:' || {NL} || 'x = 1' || {NL} || {NL} || 'Provide corrected code in <answer> tags only.<|im_end|>' || {NL} || '<|im_start|>assistant' || {NL} AS prompt FROM conversations""")
def repair_prompts(spark, d):
    """The turn after a failed one; what stood on the outputs is cut, as the feature has it."""
    prompt = repair.repair_prompt(F.lit("P"), "said", F.lit("x = 1"), F.lit("timeout"), "said", "role", "turn")
    return turns(spark, d).select("conv_id", "turn", prompt.alias("prompt"))


@query(f"""SELECT conv_id, turn, 'P<|im_start|>assistant' || {NL} || '<answer>' || {NL} || coalesce(text, '') || {NL} || '</answer><|im_end|>' || {NL} || '<|im_start|>user' || {NL} || 'Patch refinement round ' || turn || '. Return a valid unified git patch with file headers and hunks. '
|| CASE WHEN turn % 2 = 0 THEN '{repair.STRATEGIES['api_first']}' ELSE '{repair.STRATEGIES['balanced']}' END || '<|im_end|>' || {NL} || '<|im_start|>assistant' || {NL} AS prompt FROM conversations""")
def patch_repair_prompts(spark, d):
    strategy = F.when(F.col("turn") % 2 == 0, "api_first").otherwise("other")
    return turns(spark, d).select("conv_id", "turn", repair.patch_repair_prompt(F.lit("P"), "said", "turn", strategy).alias("prompt"))


CHUNK = lambda x: f"lower(regexp_replace({S(x)}, '\\s+', ' ', 'g'))"


@query(f"""SELECT conv_id, turn, CASE WHEN {S("coalesce(text, '')")} = '' THEN coalesce(nullif({S("coalesce(role, '')")}, ''), '') WHEN {S("coalesce(role, '')")} = '' OR {CHUNK("coalesce(text, '')")} = {CHUNK("coalesce(role, '')")} THEN {S("text")} ELSE {S('text')} || {NL} || {S('role')} END AS chunks FROM conversations""")
def distinct_chunks(spark, d):
    from loomspark.operators.dedup import distinct_chunks as chunks

    return turns(spark, d).select("conv_id", "turn", F.array_join(chunks(F.array("said", F.concat(F.lit(" "), F.col("said")), "role")), "\n").alias("chunks"))


@query(f"SELECT doc_id, {S("replace(replace(replace('```python' || chr(10) || coalesce(text, '') || chr(10) || '```', '```python', ''), '```py', ''), '```', '')")} AS code FROM documents")
def unfenced_code(spark, d):
    fenced = F.concat(F.lit("```python\n"), F.coalesce("text", F.lit("")), F.lit("\n```"))
    return V.read(spark, d, "documents").select("doc_id", X.without_fences(fenced).alias("code"))


@query("""WITH t AS (SELECT conv_id, turn, length(coalesce(text, '')) % 40 / 10.0::double AS t, conv_id % 5 AS k FROM conversations)
SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN '0.2|0.8' ELSE least(1.5, round(t, 1))::double::varchar || '|1.5' END AS temperatures,
  CASE WHEN turn % 3 = 0 THEN greatest(4, k) || '|' || greatest(4, greatest(4, k) - 2) || '|4' ELSE greatest(1, k - 2) || '|6' END AS schedule,
  CASE WHEN turn % 3 = 0 THEN 'minimal_diff|api_first|test_first' ELSE 'api_first|balanced' END AS strategies FROM t""")
def parsed_settings(spark, d):
    """Settings as texts, made of each turn, and what the parsers make of them."""
    c = V.read(spark, d, "conversations").withColumns({"k": F.col("conv_id") % 5, "t": (F.length(F.coalesce("text", F.lit(""))) % 40 / 10.0).cast("string")})
    given = lambda *parts: F.when(F.col("turn") % 3 == 0, "none, given").otherwise(F.concat(*parts))
    parsed = {
        "temperatures": repair.temperatures(given(F.col("t"), F.lit(", x,9"))), "schedule": repair.schedule(given((F.col("k") - 2).cast("string"), F.lit(",6,1.5")), "k"),
        "strategies": repair.strategies(given(F.lit("api_first, nothing, Balanced")))}
    return c.select("conv_id", "turn", *[F.array_join(v.cast("array<string>"), "|").alias(k) for k, v in parsed.items()])


@query("SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN greatest(1, n_chars % 9) ELSE greatest(1, n_chars % 9 + n_chars % 5 + 2) END AS budget FROM documents WHERE n_chars IS NOT NULL")
def candidate_budgets(spark, d):
    """All candidates that a case's rounds and itself were given."""
    n = F.col("n_chars").cast("int")
    history = F.when(F.col("doc_id") % 4 != 0, F.array(n % 5, F.lit(None).cast("int"), F.lit(2)))
    return V.read(spark, d, "documents").where("n_chars IS NOT NULL").select("doc_id", cases.candidate_budget(history, n % 9).alias("budget"))


@query("""WITH s AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'repo_easy' WHEN 1 THEN 'core_easy' WHEN 2 THEN 'core_hard' END AS stage, n_chars AS most FROM documents WHERE n_chars IS NOT NULL),
p AS (SELECT *, greatest(1024, most) - 256 AS room, coalesce(regexp_matches(stage, 'repo|hard|expert|replay'), false) AS long FROM s), q AS (SELECT *, least(CASE WHEN long THEN 3072 ELSE 1536 END, room - 256) AS prompt FROM p)
SELECT doc_id, prompt::int AS prompt, least(CASE WHEN long THEN 2048 ELSE 1400 END, room - prompt)::int AS completion, array_to_string([(greatest(1, most % 13) // (doc_id % 3 + 1) + (i < greatest(1, most % 13) % (doc_id % 3 + 1))::int)::int FOR i IN range(doc_id % 3 + 1)], '|') AS shares FROM q""")
def stage_lengths(spark, d):
    """Prompt and completion lengths of stages within contexts, and a budget shared out."""
    stage = F.element_at(F.array(F.lit("repo_easy"), F.lit("core_easy"), F.lit("core_hard"), F.lit(None).cast("string")), (F.col("doc_id") % 4 + 1).cast("int"))
    docs = V.read(spark, d, "documents").where("n_chars IS NOT NULL")
    prompt, completion = curriculum.context_lengths(stage, "n_chars")
    shares = curriculum.split_budget(F.col("n_chars") % 13, F.col("doc_id") % 3 + 1)
    return docs.select("doc_id", prompt.alias("prompt"), completion.alias("completion"), F.array_join(shares.cast("array<string>"), "|").alias("shares"))


@query(f"WITH m AS (SELECT doc_id, len(list_filter(regexp_split_to_array(coalesce(text, ''), '\\s+'), lambda w: w <> '')) AS n, doc_id % 12 AS k FROM documents) SELECT doc_id, round(greatest(1.5, least(4.0, 2.0 + 1.5 * (0.6 * least(1.0, n / 600.0) + 0.4 * least(1.0, k / 8.0)))), 9)::double AS seconds FROM m")
def verifier_timeouts(spark, d):
    tests = F.repeat(F.lit("assert x\n"), (F.col("doc_id") % 12).cast("int"))
    return V.read(spark, d, "documents").select("doc_id", F.round(Q.verifier_timeout("text", tests), 9).alias("seconds"))


@query("""SELECT c_custkey, c_custkey % 6 = 0 AS is_repository FROM customer""")
def model_names(spark, d):
    shapes = ("owner/{}", "/models/{}", "./{}", "{}", "a b/{}", "owner/{}/x")
    name = F.element_at(F.array(*[F.lit(s) for s in shapes]), (F.col("c_custkey") % 6 + 1).cast("int"))
    rows = V.read(spark, d, "customer").select("c_custkey", F.replace(name, F.lit("{}"), F.replace(F.lower("c_name"), F.lit("#"), F.lit("-"))).alias("name"))
    return rows.select("c_custkey", readers.looks_like_repository("name").alias("is_repository"))


# --- streams ----------------------------------------------------------------------------

#: Events as they arrive: every tenth some days late, in six batches of days.
ARRIVED_SQL = f"""lagged AS (SELECT event_id, user_id, event_type, value, ts, {V.hash8_sql("'late|' || event_id")} AS h FROM events),
arrived AS (SELECT *, greatest(0, least(5, (date_diff('day', DATE '2024-01-01', ts::date) + CASE WHEN h % 10 = 0 THEN h // 10 % 9 ELSE 0 END) // 6)) AS b FROM lagged),
marks AS (SELECT b, (SELECT date_trunc('milliseconds', max(ts)) FROM arrived e WHERE e.b < t.b) - INTERVAL 2 DAY AS mark FROM range(6) t(b)),
timely AS (SELECT a.* FROM arrived a JOIN marks USING (b) WHERE mark IS NULL OR ts > mark)"""


def arrived(spark, d):
    h = X.hash8(F.concat(F.lit("late|"), F.col("event_id").cast("string")))
    day = F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")) + F.when(h % 10 == 0, F.floor(h / 10) % 9).otherwise(0)
    number = F.greatest(F.lit(0), F.least(F.lit(5), F.floor(day / 6))).cast("int")
    return V.read(spark, d, "events").select("event_id", "user_id", "event_type", "value", "ts", number.alias("b"))


@query(f"""WITH {ARRIVED_SQL}, n AS (SELECT event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY b, event_id) - 1 AS seen FROM timely)
SELECT event_id, seen, round(CASE WHEN seen = 0 THEN 0.08 ELSE -least(0.25, 0.10 + 0.05 * seen) END, 9)::double AS reward FROM n""")
def streamed_repeats(spark, d):
    """The diversity reward on a stream: repeats are counted across micro-batches and restarts, late rows are left out."""
    root = Work(spark, "streamed-repeats")
    counted = lambda rows: state.repeats(rows, ["user_id", "event_type"], ["event_id"], "ts", "2 days")
    told = state.feed(arrived(spark, d), "b", counted, spark, root.held(), 6)
    return told.select("event_id", "seen", F.round(R.repeat_reward("seen"), 9).alias("reward"))


@query(f"""WITH {ARRIVED_SQL}, w AS (SELECT *, max(value) OVER (PARTITION BY user_id ORDER BY b, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best_before FROM timely),
i AS (SELECT *, best_before IS NULL OR value > best_before AS improved FROM w), g AS (SELECT *, sum(improved::int) OVER (PARTITION BY user_id ORDER BY b, event_id) AS island FROM i)
SELECT event_id, best_before, improved, row_number() OVER (PARTITION BY user_id, island ORDER BY b, event_id) - 1 AS stale, row_number() OVER (PARTITION BY user_id, island ORDER BY b, event_id) - 1 >= 3 AS stop FROM g""")
def streamed_stagnation(spark, d):
    """The best score so far and the rounds since, on a stream."""
    root = Work(spark, "streamed-stagnation")
    watched = lambda rows: state.stagnation(rows, ["user_id"], ["event_id"], "value", 3, "ts", "2 days")
    told = state.feed(arrived(spark, d), "b", watched, spark, root.held(), 6)
    return told.select("event_id", "best_before", "improved", F.col("stale_rounds").alias("stale"), "stop")
