"""Repair turns: policies by error, prompts, candidate budgets, and the texts that settings are parsed from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomspark.functions.text import ASSISTANT, as_text, col, strip, turn

# What a repair turn says after each error, and its temperature.
POLICIES = {
    "format": ("Your previous output missed required tags. Output exactly one <answer> block with executable code.", 0.2),
    "syntax": ("Fix syntax issues first. Do not change overall approach unless required by syntax constraints.", 0.2),
    "assertion": ("Assertions failed. Prioritize edge-case correctness and validate boundary conditions.", 0.25),
    "timeout": ("The solution timed out. Improve algorithmic complexity and remove inefficient loops.", 0.2),
    "security": ("Avoid forbidden imports and restricted builtins. Use only safe standard-library constructs.", 0.2),
}
NAME_POLICY = ("Resolve missing names/attributes and ensure symbol definitions are complete.", 0.25)
TYPE_POLICY = ("Fix type/value handling and input-shape assumptions.", 0.25)
OTHER_POLICY = ("Repair runtime correctness using test feedback and keep output in <answer> tags.", 0.3)
# What patch strategies ask for.
STRATEGIES = {
    "minimal_diff": "Focus on smallest safe patch and avoid unrelated edits.",
    "api_first": "Prioritize interface and signature correctness before internals.",
    "test_first": "Prioritize behaviors implied by tests/regressions and edge conditions.",
    "balanced": "Balance correctness, minimality, and maintainability.",
}
# The system's words of a task with its repository, and the shares that stages drop.
CONTEXT_SYSTEM = "You are an autonomous software engineer. Use the repository context to solve the task. Return executable Python code in <answer> tags. Keep reasoning concise."
STAGE_DROPS = {"easy": 0.15, "mid": 0.10, "hard": 0.05, "expert": 0.03}
# The words about a task, a failed turn and a patch to be refined.
TASK, CONTEXT, ONE_CANDIDATE = "Task:\n", "\n\nRepository Context:\n", "\n\nReturn one candidate in <answer> tags."
DEBUG_ROUND, FAILURE, PREVIOUS, CORRECT = "Self-debug round ", "\nFailure details:\n", "\nPrevious code:\n", "\n\nProvide corrected code in <answer> tags only."
REFINE_ROUND, REFINE = "Patch refinement round ", ". Return a valid unified git patch with file headers and hunks. "


def empty(c) -> Column:
    return F.coalesce(col(c).cast("string"), F.lit(""))


def repair_policy(error_type, stderr) -> Column:
    """struct(policy, temperature): by the error, else by what stderr names."""
    error, said = F.lower(empty(error_type)), F.lower(empty(stderr))
    has = lambda *names: F.contains(said, F.lit(names[0])) | F.contains(said, F.lit(names[1]))
    policy = lambda p: F.struct(F.lit(p[0]).alias("policy"), F.lit(p[1]).alias("temperature"))
    first, *rest = POLICIES.items()
    out = F.when(error == first[0], policy(first[1]))
    for name, p in rest:
        out = out.when(error == name, policy(p))
    return out.when(has("nameerror", "attributeerror"), policy(NAME_POLICY)).when(has("typeerror", "valueerror"), policy(TYPE_POLICY)).otherwise(policy(OTHER_POLICY))


def context_prefix(task, context) -> Column:
    user = F.concat(F.lit(TASK), empty(task), F.lit(CONTEXT), empty(context), F.lit(ONE_CANDIDATE))
    return F.concat(turn("system", F.lit(CONTEXT_SYSTEM)), turn("user", user))


def repair_prompt(prefix, completion, code, error_type, stderr, stdout, round_) -> Column:
    """The next turn after a failed one; standard error and output are cut."""
    said = strip(F.replace(empty(completion), F.lit("<|im_end|>"), F.lit("")))
    failure = F.concat(F.lit("error_type="), empty(error_type), F.lit("\nstderr="), F.substring(empty(stderr), 1, 1800), F.lit("\nstdout="), F.substring(empty(stdout), 1, 400), F.lit("\n"))
    block = F.concat(
        F.lit(DEBUG_ROUND), empty(round_), F.lit(".\n"), repair_policy(error_type, stderr)["policy"], F.lit(FAILURE), failure,
        F.lit(PREVIOUS), empty(code), F.lit(CORRECT))
    return F.concat(col(prefix), turn("assistant", said), turn("user", block), F.lit(ASSISTANT))


def patch_repair_prompt(prompt, patch, round_, strategy) -> Column:
    table = F.create_map(*[F.lit(x) for kv in STRATEGIES.items() for x in kv])
    ask = F.coalesce(F.try_element_at(table, empty(strategy)), F.lit(STRATEGIES["balanced"]))
    critique = F.concat(F.lit(REFINE_ROUND), empty(round_), F.lit(REFINE), ask)
    return F.concat(col(prompt), turn("assistant", F.concat(F.lit("<answer>\n"), empty(patch), F.lit("\n</answer>"))), turn("user", critique), F.lit(ASSISTANT))


def error_budget(error_type, scheduled) -> Column:
    """Candidates of the next round: more after format and syntax errors, fewer after slow or unsafe code."""
    n, error = F.greatest(F.lit(1), col(scheduled)), F.lower(strip(empty(error_type)))
    return (
        F.when(error == "format", F.least(F.lit(12), F.greatest(n, F.lit(8)))).when(error == "syntax", F.least(F.lit(12), n + 1))
        .when(error == "timeout", F.greatest(F.lit(4), n - 1)).when(error == "security", F.greatest(F.lit(4), n - 2)).otherwise(n))


def completion_text(df: DataFrame, name: str) -> Column:
    """The text of a completion column: a string, a struct with content, text or completion, or a list of either (its first)."""

    def of(c: Column, kind: T.DataType) -> Column:
        if isinstance(kind, T.ArrayType):
            return of(F.try_element_at(c, F.lit(1)), kind.elementType)
        if isinstance(kind, T.StructType):
            parts = [F.nullif(as_text(c[k]), F.lit("")) for k in ("content", "text", "completion") if k in kind.fieldNames()]
            return F.coalesce(*parts, F.lit(""))
        return as_text(c)

    return of(F.col(name), df.schema[name].dataType)


def numbers(text, kind=float) -> list:
    """The numbers of a comma-separated text; what isn't one is passed over."""
    out = []
    for part in text if isinstance(text, (list, tuple)) else str(text or "").split(","):
        try:
            out.append(kind(part))
        except ValueError:
            pass
    return out


def numbers_of(text, pattern: str = r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?", kind: str = "double") -> Column:
    """As ``numbers``, of a column: decimal numbers, blanks about them allowed."""
    parts = F.transform(F.split(F.coalesce(col(text), F.lit("")), ","), strip)
    return F.transform(F.filter(parts, lambda x: x.rlike(f"^({pattern})$")), lambda x: x.cast(kind))


def or_default(values: Column, default: list) -> Column:
    return F.when(F.size(values) > 0, values).otherwise(F.array(*[F.lit(x) if not isinstance(x, Column) else x for x in default]))


def temperatures(text) -> Column:
    """As ``parse_temperatures``, of a column."""
    return or_default(F.transform(numbers_of(text), lambda t: F.greatest(F.lit(0.0), F.least(F.lit(1.5), t))), [0.2, 0.8])


def schedule(text, base) -> Column:
    """As ``parse_schedule``, of columns."""
    base = F.greatest(F.lit(4), col(base)).cast("int")
    return or_default(F.transform(numbers_of(text, r"[+-]?\d+", "int"), lambda n: F.greatest(F.lit(1), n)), [base, F.greatest(F.lit(4), base - 2), F.greatest(F.lit(4), base - 4)])


def strategies(text) -> Column:
    """As ``parse_strategies``, of a column."""
    parts = F.transform(F.split(F.coalesce(col(text), F.lit("")), ","), lambda x: F.lower(strip(x)))
    return or_default(F.filter(parts, lambda x: x.isin(*STRATEGIES)), ["minimal_diff", "api_first", "test_first"])


def parse_temperatures(text) -> list[float]:
    return [max(0.0, min(1.5, t)) for t in numbers(text)] or [0.2, 0.8]


def parse_schedule(text, base: int) -> list[int]:
    base = max(4, int(base))
    return [max(1, n) for n in numbers(text, int)] or [base, max(4, base - 2), max(4, base - 4)]


def parse_strategies(text: str) -> list[str]:
    named = [p.strip().lower() for p in str(text or "").split(",")]
    return [p for p in named if p in STRATEGIES] or ["minimal_diff", "api_first", "test_first"]


def parse_stage_drops(text: str) -> dict[str, float]:
    out = dict(STAGE_DROPS)
    for part in str(text or "").split(","):
        name, colon, value = part.partition(":")
        found = numbers(value)
        if colon and found:
            out[name.strip().lower()] = max(0.0, min(0.8, found[0]))
    return out


def stage_drop(stage: str, drops: dict[str, float]) -> float:
    """A stage's share to drop: by its name, its last part, else as for hard ones."""
    name = (stage or "").strip().lower()
    return drops.get(name, drops.get(name.rpartition("_")[2], drops.get("hard", 0.05)))
