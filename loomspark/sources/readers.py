"""Readers: JSON lines (forgiving or strict), splits, benchmark cases, repositories, fallbacks."""

from __future__ import annotations

import re
import warnings

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomspark.functions.text import as_text, first_nonempty, strip
from loomspark.operators.sampling import numbered
from loomspark.sources.repository import list_files, read_bodies

CASE_LOG = (
    "benchmark string, id string, mode string, prompt string, tests string, pass_at_1 boolean, pass_at_k boolean, format_errors int, generated_candidates int, rounds_used int, "
    "best_patch string, reference_patch string, result_code string, error_type string, resolve_proxy double, deferred_harness boolean, all_passed boolean, "
    "history array<struct<round int, score double, pass_fraction double, error_type string, candidate_budget int, stderr string, round_scores array<double>>>"
)
# Folders that a repository walk leaves out, and files that it takes.
IGNORED_DIRS = (".git", "__pycache__", ".venv", "venv", "node_modules", "dist", "build")
#: Hidden caches of any tool are left out too.
CACHE_DIRS = ".*_cache"
EXTENSIONS = (".py", ".md", ".txt", ".json", ".yaml", ".yml", ".toml", ".ini", ".cfg")
TEST_KEYS = ("tests", "test", "unit_tests", "public_tests", "private_tests", "hidden_tests")


#: What a loader raises if its source can't be read; anything else is a fault of the loader.
READ_ERRORS = (AnalysisException, OSError)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read_jsonl(spark: SparkSession, paths: list[str], schema: str = CASE_LOG) -> DataFrame:
    """Well-formed lines of the files that are there; blank and broken ones are passed over."""
    there = [p for p in paths if p and exists(spark, p)]
    whole = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    if not there:
        return spark.createDataFrame([], whole)
    marked = T.StructType([*whole.fields, T.StructField("_broken", T.StringType())])
    return spark.read.schema(marked).option("columnNameOfCorruptRecord", "_broken").json(there).where("_broken IS NULL").drop("_broken")


def read_jsonl_strict(spark: SparkSession, path: str, schema: str = CASE_LOG) -> DataFrame:
    """All lines, or an error: for a missing file, a broken line, or no line at all."""
    if not exists(spark, path):
        raise FileNotFoundError(path)
    df = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    if df.isEmpty():
        raise ValueError(f"no rows in {path}")
    return df


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """One document as one row."""
    if not exists(spark, path):
        raise FileNotFoundError(path)
    return spark.read.option("multiLine", True).json(path)


def first_readable(spark: SparkSession, paths: list[str], n: int | None = None) -> DataFrame:
    """The first path that reads as Parquet; all attempts are named if none does."""
    failed = []
    for p in paths:
        try:
            df = spark.read.parquet(p)
            return df.limit(n) if n else df
        except AnalysisException as e:
            failed.append(f"{p}: {str(e).splitlines()[0]}")
    raise ValueError("no source could be read: " + "; ".join(failed))


def tolerant(sources: dict, most_missing: int = 0) -> tuple[dict[str, DataFrame], list[str]]:
    """Frames of named loaders (functions), and the names of those that failed; an error if too many did."""
    found, missing = {}, []
    for name, load in sources.items():
        try:
            found[name] = load()
        except Exception as e:  # whatever is wrong with one loader, the others count
            warnings.warn(f"{name}: {e!r}", stacklevel=2)
            missing.append(name)
    if len(missing) > most_missing:
        raise RuntimeError(f"missing sources: {', '.join(missing)}")
    return found, missing


def choose_split(df: DataFrame, prefer: tuple[str, ...] = ("train",), split: str = "split") -> DataFrame:
    """Rows of the first preferred split there is, else of the first by name; partitions make it a pruned read."""
    if split not in df.columns:
        return df
    names = sorted(r[0] for r in df.select(split).distinct().collect() if r[0] is not None)
    chosen = next((p for p in prefer if p in names), names[0] if names else None)
    if chosen is None:
        raise ValueError("no split to read")
    return df.where(F.col(split) == chosen)


def prompt_scan(df: DataFrame, n: int, order: str, prefer: tuple[str, ...] = ("train",)) -> DataFrame:
    """The first n rows of the chosen split in order of arrival; an error if it has none."""
    rows = choose_split(df, prefer)
    if rows.isEmpty():
        raise ValueError("the split has no rows")
    return rows.orderBy(order).limit(n) if n > 0 else rows


def holdout_cases(df: DataFrame, n: int, order: str) -> DataFrame:
    """Cases of a holdout: the split by priority, the first n rows, then those with a prompt and tests."""
    rows = numbered(choose_split(df, ("holdout_clean", "test", "val_strict", "train")), [order], name="_i").where(F.col("_i") < n)
    own = first_nonempty(df, ("id",), default=None)
    rows = rows.withColumn("id", F.coalesce(own, F.concat(F.lit("private_holdout_"), "_i"))).drop("_i")
    return rows.where((strip(F.coalesce("prompt", F.lit(""))) != "") & (strip(F.coalesce("tests", F.lit(""))) != ""))


def case_tests(df: DataFrame) -> Column:
    """A case's tests: the first key that isn't blank, a list, or asserts made of up to ten input/output pairs."""
    options = [F.nullif(strip(as_text(k, df.schema[k].dataType)), F.lit("")) for k in (*TEST_KEYS, "test_list") if k in df.columns]
    if "private_test_cases" in df.columns and "entry_point" in df.columns:
        call = lambda x: F.when(F.contains(x["input"], F.lit("(")), x["input"]).otherwise(F.concat(F.lit("("), x["input"], F.lit(")")))
        made = F.transform(F.slice("private_test_cases", 1, 10), lambda x: F.concat(F.lit("assert "), F.col("entry_point"), call(x), F.lit(" == "), x["output"]))
        options.append(F.nullif(F.array_join(made, "\n"), F.lit("")))
    return F.coalesce(*options, F.lit("")) if options else F.lit("")


def cases(df: DataFrame, benchmark: str) -> DataFrame:
    """Benchmark rows as cases: benchmark, id, prompt, tests, mode (and patches' references)."""
    name = {"human_eval": "humaneval"}.get(benchmark.lower(), benchmark.lower())
    ident = lambda *names: F.substring(first_nonempty(df, names), 1, 80)
    if name == "mbpp":
        out = df.select(ident("task_id", "text").alias("id"), first_nonempty(df, ("text", "prompt")).alias("prompt"), case_tests(df).alias("tests"), F.lit("code").alias("mode"))
    elif name == "humaneval":
        entry = first_nonempty(df, ("entry_point",))
        tests = F.concat(first_nonempty(df, ("test",)), F.when(entry != "", F.concat(F.lit("\ncheck("), entry, F.lit(")"))).otherwise(""))
        out = df.select(ident("task_id").alias("id"), first_nonempty(df, ("prompt",)).alias("prompt"), tests.alias("tests"), F.lit("code").alias("mode"))
    elif name in ("livecodebench", "bigcodebench_instruct", "private_holdout"):
        out = df.select(ident("id", "question_id", "task_id").alias("id"), first_nonempty(df, ("prompt", "instruct_prompt", "question_content", "problem", "question", "text")).alias("prompt"), case_tests(df).alias("tests"), F.lit("code").alias("mode")).where("prompt != '' AND tests != ''")
    elif name == "swebench_verified_subset":
        problem = first_nonempty(df, ("problem_statement",))
        out = df.select(ident("instance_id").alias("id"), F.concat(F.lit("Issue:\n"), problem).alias("prompt"), F.lit("").alias("tests"), F.lit("patch").alias("mode"), first_nonempty(df, ("patch",)).alias("reference_patch"), problem.alias("problem_statement"))
    else:
        raise ValueError(f"unknown benchmark: {benchmark}")
    return out.select(F.lit(name).alias("benchmark"), "*")


def repository(spark: SparkSession, root: str, max_files: int = 600, max_chars: int = 2500, ignored_dirs: tuple[str, ...] = (*IGNORED_DIRS, CACHE_DIRS)) -> DataFrame:
    """path and body of a repository's text files: allowed extensions, no ignored folders, the first by path (all if max_files isn't positive)."""
    files = list_files(spark, root, ignored_dirs, EXTENSIONS).select("path")
    if max_files > 0:
        files = files.orderBy("path").limit(max_files)
    return read_bodies(files, root, max_chars).where(strip("body") != "")


def tasks(rows: DataFrame, key: str, prompt, tests) -> DataFrame:
    """A task table: id, prompt and tests as texts, blank where there is none; rows without an id are left out."""
    text = lambda c: F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit(""))
    return rows.where(F.col(key).isNotNull()).select(text(key).alias("id"), text(prompt).alias("prompt"), text(tests).alias("tests"))


#: A call of a Python program in a shell script, with what follows up to the command's end; a long flag; a declaration of arguments.
CALL, FLAG, DECLARATION = r"python3?\s+(?:-\w\s+)*\S+\.py[^\n;&|]*", r"(--[A-Za-z][\w-]*)", r"(?s)add_argument\((.*?)\)"


def command_flags(scripts: DataFrame, script: str) -> DataFrame:
    """scripts with program and flag: a row for each long flag that a shell script passes to a Python program."""
    joined = F.regexp_replace(script, r"\\\n", " ")
    calls = scripts.withColumn("_call", F.explode(F.regexp_extract_all(joined, F.lit(CALL), 0)))
    calls = calls.withColumn("program", F.regexp_extract("_call", r"(?:-\w\s+)*(\S+\.py)", 1))
    return calls.withColumn("flag", F.explode(F.array_distinct(F.regexp_extract_all(F.regexp_extract("_call", r"\S+\.py(.*)", 1), F.lit(FLAG), 1)))).drop("_call")


def declared_flags(sources: DataFrame, program: str, source: str) -> DataFrame:
    """program and flag: the long flags that a program's source declares."""
    calls = F.regexp_extract_all(source, F.lit(DECLARATION), 1)
    flags = F.flatten(F.transform(calls, lambda c: F.regexp_extract_all(c, F.lit(f"[\"']{FLAG}[\"']"), 1)))
    return sources.select(F.col(program).alias("program"), F.explode(flags).alias("flag")).distinct()


def flag_drift(scripts: DataFrame, script: str, sources: DataFrame, program: str, source: str) -> DataFrame:
    """Each different (program, flag) that scripts pass to one of the sources' programs, in how many scripts, and whether its source declares it."""
    passed = command_flags(scripts, script).groupBy("program", "flag").agg(F.count("*").alias("n"))
    known = sources.select(F.col(program).alias("program")).distinct()
    declared = declared_flags(sources, program, source).withColumn("declared", F.lit(True))
    return passed.join(known, "program", "left_semi").join(declared, ["program", "flag"], "left").withColumn("declared", F.coalesce("declared", F.lit(False)))


def looks_like_repository(name) -> Column:
    """Whether a model's name is an owner and a repository rather than a path."""
    v = strip(F.coalesce(F.col(name) if isinstance(name, str) else name, F.lit("")))
    path = F.startswith(v, F.lit("/")) | F.startswith(v, F.lit("./")) | F.startswith(v, F.lit("../")) | F.startswith(v, F.lit("~")) | F.contains(v, F.lit("\\")) | F.contains(v, F.lit(" "))
    parts = F.split(v, "/")
    return (v != "") & ~path & (F.size(parts) == 2) & F.forall(parts, lambda p: strip(p) != "")


def adapter_only(spark: SparkSession, folder: str) -> bool:
    """Whether a folder holds an adapter's settings and no model's."""
    return exists(spark, f"{folder.rstrip('/')}/adapter_config.json") and not exists(spark, f"{folder.rstrip('/')}/config.json")
