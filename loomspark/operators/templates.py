"""Chat templates of the corpus sources: one formatter, driven by a table of sources."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomspark.functions.quality import sufficient, test_quality
from loomspark.functions.text import (
    ASSISTANT, as_text, assistant_block, column_text, first_nonempty, first_truthy, prompt_prefix, reasoning_mode, strip, truncated, turn,
)
from .dedup import distinct_chunks


@dataclass(frozen=True)
class Template:
    """Columns in order of preference; *_blank: fall through blank values, else only through absent columns."""

    system: str
    user: tuple[str, ...]
    answer: tuple[str, ...]
    reasoning: tuple[str, ...] = ()
    user_blank: bool = False
    reasoning_blank: bool = False
    user_prefix: str = ""


# The system prompts that the corpora are trained with.
SYSTEM_REASONING = "You are an elite coding assistant. You must thoroughly analyze the problem step-by-step inside <reasoning> tags before synthesizing the final robust code inside <answer> tags."
SYSTEM_DIRECT = "You are an elite coding assistant. Provide the final robust code directly inside <answer> tags without extensive preliminary reasoning."
SYSTEM_BUG = "You are a senior software engineer. Analyze the bug report and provide the necessary code patch to resolve the issue inside <answer> tags. Think step-by-step in <reasoning> tags first."
SYSTEM_EVOL = "You are an elite coding assistant. Solve the deeply complex programming challenge inside <answer> tags. It is highly recommended to think through edge cases in <reasoning> tags first."
SYSTEM_TRAJECTORY = "You are an autonomous software engineering agent. You are provided with an issue description and a repository. You must use tools (like shell commands or file editors) to explore the codebase, understand the bug, and iteratively develop a solution inside <answer> tags."
SYSTEM_STRATOS = "You are an elite reasoning assistant. Solve the problem inside <answer> tags after deep thought in <reasoning> tags."
SYSTEM_MATH = "You are an elite mathematical reasoning assistant. Solve the math problem step-by-step inside <reasoning> tags, then provide the final answer inside <answer> tags."
SYSTEM_FEEDBACK = "You are an autonomous self-healing coder. Analyze the execution error, explain the flaw inside <reasoning> tags, and provide the fixed code inside <answer> tags."
SYSTEM_MCTS = (
    "You are an advanced reasoning agent capable of Monte Carlo Tree Search (MCTS) exploration. Before generating the final answer inside <answer> tags, use the <reasoning> tags to:\n"
    "1. Formulate multiple distinct hypotheses or approaches.\n2. Evaluate each approach logically (pros/cons, edge cases).\n"
    "3. Explicitly verify or reject (backtrack) flawed approaches.\n4. Select the most robust approach."
)
SYSTEM_COMMIT = "You are an expert software architect. Analyze the provided codebase context or issue description, and provide a comprehensive, multi-file git patch inside <answer> tags. Outline your architectural strategy in <reasoning> tags first."
SYSTEM_SWE_BUG = "You are an expert SWE assistant. Solve repository issues by proposing a precise unified patch inside <answer> tags after concise reasoning in <reasoning> tags."
SYSTEM_SWE_TRAJECTORY = "You are an autonomous SWE agent. Use prior tool traces to craft a robust final patch inside <answer> tags."
SYSTEM_RL = "You are an expert python developer. Analyze thoroughly in <reasoning> tags, then output purely the executable code in <answer> tags."
SYSTEM_CASE_PATCH = "You are an expert software engineer. Return only a unified git patch in <answer> tags."
SYSTEM_CASE_CODE = "You are an expert python developer. Analyze briefly and output executable code in <answer> tags."
TEST_KEYS = ("tests", "test", "test_list", "unit_tests", "public_tests")
SWE_TEST_KEYS = ("FAIL_TO_PASS", "PASS_TO_PASS", "tests", "test", "unit_tests", "public_tests", "private_tests", "regression_tests")
FILE_KEYS = ("files", "file_paths", "changed_files", "impacted_files", "relevant_files")
PATCH_KEYS = ("patch", "gold_patch", "model_patch", "final_patch")

TEMPLATES = {
    "bug": Template(SYSTEM_BUG, ("problem_statement",), ("patch",), ("analysis", "hints", "FAIL_TO_PASS"), reasoning_blank=True, user_prefix="Issue Description: "),
    "evol": Template(SYSTEM_EVOL, ("instruction",), ("output",)),
    "stratos": Template(SYSTEM_STRATOS, ("prompt", "messages"), ("response", "generation"), ("reasoning", "analysis")),
    "math": Template(SYSTEM_MATH, ("problem",), ("solution",), ("reasoning", "scratchpad")),
    "feedback": Template(SYSTEM_FEEDBACK, ("query",), ("answer",), ("feedback", "error")),
    "mcts": Template(SYSTEM_MCTS, ("instruction", "prompt"), ("output", "response"), ("reasoning", "trace")),
}


# Labels inside records.
ISSUE, UNKNOWN_ISSUE = "Issue: Resolving ", "Unknown Issue"
STEP_ACTION, STEP_OBSERVATION = "\n[Action]: ", "\n[Observation]: "
LOG_ACTION, LOG_OBSERVATION = "Action: ", "Observation: "
COMMIT, COMMIT_CONTEXT, COMMIT_CUT = "Commit Message / Issue: ", "\n\nPre-Commit Context / Code:\n", "\n...[Context truncated for efficiency]"
COMMIT_DIFF = "Git Patch Diff:\n"


def chat(system: str | Column, user: Column, assistant: Column) -> Column:
    return F.concat(turn("system", F.lit(system) if isinstance(system, str) else system), turn("user", user), assistant)


def record(df: DataFrame, text: Column, source: str | None = None) -> DataFrame:
    """df with text, its prompt, the row's tests and its source."""
    tests = first_truthy(df, TEST_KEYS)
    out = df.withColumns({"_text": text, "_tests": tests}).withColumns({"text": F.col("_text"), "prompt": prompt_prefix("_text"), "tests": F.col("_tests")})
    return (out.withColumn("source", F.lit(source)) if source else out).drop("_text", "_tests")


def format_source(df: DataFrame, kind: str, source: str | None = None) -> DataFrame:
    """Rows of a corpus source as chat records."""
    if kind == "reasoning":
        return format_reasoning(df, source)
    if kind == "trajectory":
        return format_trajectory(df, source)
    if kind == "commit":
        return format_commit(df, source)
    t = TEMPLATES[kind]
    pick = lambda names, blank: first_nonempty(df, names) if blank else strip(column_text(df, *names))
    user = F.concat(F.lit(t.user_prefix), pick(t.user, t.user_blank))
    reasoning = pick(t.reasoning, t.reasoning_blank) if t.reasoning else None
    return record(df, chat(t.system, user, assistant_block(pick(t.answer, False), reasoning)), source)


def format_reasoning(df: DataFrame, source: str | None = None) -> DataFrame:
    """Seven rows of ten think aloud (by hash), if there is a trace to think."""
    trace = strip(column_text(df, "reasoning_trace"))
    deep = reasoning_mode(df) & (trace != "")
    system = F.when(deep, SYSTEM_REASONING).otherwise(SYSTEM_DIRECT)
    block = assistant_block(strip(column_text(df, "solution")), F.when(deep, trace).otherwise(""))
    return record(df, chat(system, first_nonempty(df, ("instruction", "prompt")), block), source)


def steps(trajectory: str, f) -> Column:
    """f of each step (action, observation), lists joined into one."""
    empty = F.array().cast("array<struct<action:string,observation:string>>")
    return F.flatten(F.transform(F.coalesce(F.col(trajectory), empty), f))


def format_trajectory(df: DataFrame, source: str | None = None) -> DataFrame:
    issue = F.coalesce(F.nullif(strip(column_text(df, "instance_id")), F.lit("")), F.lit(UNKNOWN_ISSUE))
    act, obs = (lambda s, f=f: strip(F.coalesce(s[f], F.lit(""))) for f in ("action", "observation"))
    lines = steps("trajectory", lambda s: F.array(F.concat(F.lit(STEP_ACTION), act(s), F.lit(STEP_OBSERVATION), obs(s))))
    log = steps("trajectory", lambda s: F.filter(F.array(F.concat(F.lit(LOG_ACTION), act(s)), F.concat(F.lit(LOG_OBSERVATION), F.substring(obs(s), 1, 240))), lambda x: ~x.isin(LOG_ACTION, LOG_OBSERVATION)))
    user = F.concat(F.lit(ISSUE), issue, F.lit("\n"), F.array_join(lines, ""))
    return record(df, chat(SYSTEM_TRAJECTORY, user, assistant_block(first_truthy(df, PATCH_KEYS), F.array_join(F.slice(log, 1, 20), "\n"))), source)


def format_commit(df: DataFrame, source: str | None = None) -> DataFrame:
    user = F.concat(F.lit(COMMIT), strip(column_text(df, "message")), F.lit(COMMIT_CONTEXT), strip(column_text(df, "old_contents")))
    user = F.when(F.length(user) > 3000, F.concat(F.substring(user, 1, 3000), F.lit(COMMIT_CUT))).otherwise(user)
    answer = F.concat(F.lit(COMMIT_DIFF), strip(column_text(df, "diff")))
    return record(df, chat(SYSTEM_COMMIT, user, assistant_block(answer, column_text(df, "analysis", "explanation"))), source)


def listed(df: DataFrame, name: str) -> Column:
    """A column as an array of strings, whatever it is; empty if absent."""
    none = F.array().cast("array<string>")
    if name not in df.columns:
        return none
    if isinstance(df.schema[name].dataType, T.ArrayType):
        return F.coalesce(F.col(name).cast("array<string>"), none)
    return F.when(F.col(name).isNull(), none).otherwise(F.array(F.col(name).cast("string")))


def swe_tests(df: DataFrame, keys=SWE_TEST_KEYS) -> Column:
    """All tests of a row, each once."""
    chunks = [F.array(as_text(k, df.schema[k].dataType)) for k in keys if k in df.columns]
    return F.array_join(distinct_chunks(F.concat(*chunks)), "\n\n") if chunks else F.lit("")


def affected_files(df: DataFrame, keys=FILE_KEYS) -> Column:
    """The first file list with a value that isn't blank."""
    none = F.array().cast("array<string>")
    lists = [F.filter(F.transform(listed(df, k), lambda x: strip(F.coalesce(x, F.lit("")))), lambda x: x != "") for k in keys if k in df.columns]
    return F.coalesce(*[F.when(F.size(x) > 0, x) for x in lists], none)


def swe_record(df: DataFrame, system: str, issue: Column, trajectory: Column, patch: Column, reasoning: Column, source: str, row_key: str | None = None) -> DataFrame:
    files = affected_files(df)
    listing = F.array_join(F.transform(F.slice(files, 1, 20), lambda p: F.concat(F.lit("- "), p)), "\n")
    user = F.concat(F.lit("Issue:\n"), issue, F.when(listing != "", F.concat(F.lit("\nAffected files:\n"), listing)).otherwise(""), F.when(trajectory.isNotNull(), F.concat(F.lit("\n\nTrajectory:\n"), trajectory)).otherwise(""))
    text = chat(system, user, assistant_block(patch, reasoning))
    return df.select(
        *([F.col(row_key).alias("row_key")] if row_key else []), text.alias("text"), prompt_prefix(text).alias("prompt"), swe_tests(df).alias("tests"), issue.alias("issue"), F.array_join(F.slice(files, 1, 50), "\n").alias("affected_files"),
        patch.alias("patch"), F.coalesce(trajectory, F.lit("")).alias("trajectory"), F.lit(source).alias("source"), F.lit("repo_level").alias("swe_granularity"))


def format_swe_bug(df: DataFrame, source: str = "swe_bug", context: int = 6000, row_key: str | None = None) -> DataFrame:
    issue = truncated(column_text(df, "problem_statement", "issue", "prompt"), context)
    patch = strip(column_text(df, "patch", "gold_patch", "solution_patch"))
    return swe_record(df, SYSTEM_SWE_BUG, issue, F.lit(None).cast("string"), patch, column_text(df, "analysis", "hints"), source, row_key)


def format_swe_trajectory(df: DataFrame, source: str = "swe_trajectory", context: int = 6000, row_key: str | None = None) -> DataFrame:
    issue = truncated(column_text(df, "problem_statement", "issue", "instance_id"), context)
    first = F.slice(F.coalesce(F.col("trajectory"), F.array().cast("array<struct<action:string,observation:string>>")), 1, 60)
    lines = F.flatten(F.transform(first, lambda s: F.filter(F.array(F.concat(F.lit("[ACTION] "), truncated(s["action"], 280)), F.concat(F.lit("[OBS] "), truncated(s["observation"], 360))), lambda x: ~x.isin("[ACTION] ", "[OBS] "))))
    trace = F.array_join(lines, "\n")
    return swe_record(df, SYSTEM_SWE_TRAJECTORY, issue, trace, strip(first_truthy(df, PATCH_KEYS)), F.substring(trace, 1, 1200), source, row_key)


def case_prompt(prompt, mode) -> Column:
    system = F.when(F.col(mode) == "patch", SYSTEM_CASE_PATCH).otherwise(SYSTEM_CASE_CODE)
    return chat(system, F.col(prompt), F.lit(ASSISTANT))


def format_rl(df: DataFrame, min_asserts: int = 2, min_lines: int = 3, min_score: float = 2.5, keep: tuple[str, ...] = ()) -> DataFrame:
    """Prompts wrapped unless they are templates already, tests with their quality flags."""
    user = first_truthy(df, ("prompt", "text"))
    wrapped = chat(SYSTEM_RL, user, F.lit(ASSISTANT))
    ready = F.contains(user, F.lit("<|im_start|>assistant")) & F.contains(user, F.lit("<|im_start|>system"))
    tests = strip(first_truthy(df, ("tests", "test_list")))
    named = lambda n, default: F.coalesce(F.nullif(F.lower(strip(column_text(df, n))), F.lit("")), F.lit(default))
    out = df.select(*keep, F.when(ready, user).otherwise(wrapped).alias("prompt"), tests.alias("answer"), named("source", "unknown").alias("source"), named("benchmark", "unknown").alias("benchmark"), named("error_type", "").alias("error_type"))
    q = test_quality("answer")
    return out.withColumn("_q", q).select("*", (F.col("answer") != "").alias("has_tests"), sufficient("_q", min_asserts, min_lines, min_score).alias("tests_quality_ok"), F.col("_q.quality_score").alias("test_quality_score"), F.col("_q.assert_count").alias("test_assert_count")).drop("_q")


def rendered_history(history, most: int = 6) -> Column:
    """Rounds (struct error_type, score, stderr) as lines."""
    return F.array_join(F.transform(F.slice(F.col(history), 1, most), lambda h, i: F.format_string("[Round %d] error=%s score=%.3f stderr=%s", i + 1, F.coalesce(h["error_type"], F.lit("")), F.coalesce(h["score"], F.lit(0.0)), F.substring(F.coalesce(h["stderr"], F.lit("")), 1, 220))), "\n")


# What stands around a distilled trajectory's task and history, and the sentence that opens its rationale.
DISTILL_SYSTEM = "You are an autonomous SWE agent. Use tool feedback loops to repair code."
DISTILL_HISTORY = "Agent Tool/Test History:"
DISTILL_OPENING = "I reviewed prior failing attempts, extracted the dominant error signatures, and produced a corrected implementation consistent with test feedback.\nHistory summary:\n"


def trajectory_prompt(task, history_text) -> Column:
    return F.concat(F.lit(f"<|im_start|>system\n{DISTILL_SYSTEM}\n<|im_end|>\n<|im_start|>user\nTask:\n"), task, F.lit(f"\n\n{DISTILL_HISTORY}\n"), history_text, F.lit("\n<|im_end|>\n" + ASSISTANT))


def trajectory_text(prompt, code, history_text) -> Column:
    return F.concat(prompt, F.lit("<reasoning>\n" + DISTILL_OPENING), history_text, F.lit("\n</reasoning>\n<answer>\n"), strip(F.coalesce(code, F.lit(""))), F.lit("\n</answer><|im_end|>"))


def align_columns(df: DataFrame, defaults: dict[str, tuple[str, object]]) -> DataFrame:
    """The named columns in order: missing ones and nulls get their default, others go; strings are stripped."""
    out = []
    for name, (kind, default) in defaults.items():
        c = F.col(name).cast(kind) if name in df.columns else F.lit(None).cast(kind)
        c = strip(c) if kind == "string" else c
        out.append(F.coalesce(c, F.lit(default).cast(kind)).alias(name))
    return df.select(*out)
