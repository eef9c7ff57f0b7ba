"""Quality of tests and answers, hardness and difficulty of rows, as expressions."""

from __future__ import annotations

import ast

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import LINE_BREAK, answer_of, code_tokens, col, hash8, strip, without_fences, words

# Terms that tests are searched for.
BOUNDARY_TERMS = ("empty", "none", "null", "zero", "negative", "single", "edge", "boundary", "large", "small")
PROPERTY_TERMS = ("invariant", "property", "idempot", "commut", "associat", "monot", "sorted")
RANDOM_TERMS = ("random", "randint", "shuffle", "sample", "seed", "hypothesis")
# Severity of the errors that runs end with, and of any other.
ERROR_SEVERITY = {"security": 1.00, "timeout": 0.90, "format": 0.80, "syntax": 0.72, "assertion": 0.60, "runtime": 0.50}
OTHER_SEVERITY = 0.45


def lookup(c, table: dict, default) -> Column:
    """A literal map's value of the stripped, lower-case key."""
    key = F.lower(strip(F.coalesce(col(c), F.lit(""))))
    pairs = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(F.try_element_at(pairs, key), F.lit(default))


def test_quality(c) -> Column:
    """Counts of a test text and their weighted score."""
    t = strip(F.coalesce(col(c), F.lit("")))
    low = F.lower(t)
    hits = lambda terms: sum((F.contains(low, F.lit(x)).cast("int") for x in terms[1:]), F.contains(low, F.lit(terms[0])).cast("int"))
    lines = F.size(F.filter(F.split(t, LINE_BREAK), lambda x: strip(x) != ""))
    asserts, tests = F.regexp_count(t, F.lit(r"(?md)^\s*assert\b")), F.regexp_count(t, F.lit(r"(?md)^\s*def\s+test_"))
    b, p, r = hits(BOUNDARY_TERMS), hits(PROPERTY_TERMS), hits(RANDOM_TERMS)
    score = 0.9 * asserts + 1.2 * tests + 0.4 * b + 0.5 * p + 0.5 * r + F.least(F.lit(1.5), lines / 20.0)
    return F.struct(
        lines.cast("int").alias("nonempty_lines"), asserts.cast("int").alias("assert_count"), tests.cast("int").alias("test_fn_count"),
        b.alias("boundary_hits"), p.alias("property_hits"), r.alias("random_hits"), score.cast("double").alias("quality_score"))


def sufficient(quality, asserts: int = 2, lines: int = 3, score: float = 2.5) -> Column:
    q = col(quality)
    return (q["assert_count"] >= asserts) & (q["nonempty_lines"] >= lines) & (q["quality_score"] >= score)


def looks_like_patch(answer) -> Column:
    a = strip(F.coalesce(col(answer), F.lit("")))
    has = lambda x: F.contains(a, F.lit(x))
    return (a != "") & (F.contains(F.lower(a), F.lit("diff --git")) | (has("\n@@") & (has("\n+") | has("\n-"))) | F.startswith(F.lower(a), F.lit("--- ")))


def patch_parseable(answer) -> Column:
    a = strip(F.coalesce(col(answer), F.lit("")))
    header = F.contains(F.lower(a), F.lit("diff --git")) | (F.contains(a, F.lit("--- ")) & F.contains(a, F.lit("+++ ")))
    return looks_like_patch(a) & header & F.contains(a, F.lit("@@"))


@F.arrow_udf(T.BooleanType())
def parses_as_python(code: pa.Array) -> pa.Array:
    """Whether each text is Python by the worker's grammar; parsed, never run."""

    def fine(text):
        try:
            ast.parse(text)
            return True
        except Exception:
            return False

    return pa.array([c is not None and c != "" and fine(c) for c in code.to_pylist()], pa.bool_())


def answer_flags(text) -> Column:
    """Kind of a text's answer (missing, patch or code) and whether it is in order."""
    return flags_of(answer_of(text))


def flags_of(answer) -> Column:
    """As answer_flags, of the answer itself."""
    answer = col(answer)
    missing, patch = answer == "", looks_like_patch(answer)
    # only code goes to the parser
    code_ok = parses_as_python(F.when(~missing & ~patch, without_fences(answer, ("```python", "```"))))
    patch_ok = ~missing & patch & patch_parseable(answer)
    kind = F.when(missing, "missing").when(patch, "patch").otherwise("code")
    return F.struct(kind.alias("answer_kind"), code_ok.alias("answer_ast_ok"), patch_ok.alias("answer_patch_ok"), (code_ok | patch_ok).alias("answer_quality_ok"))


def patch_quality(c) -> Column:
    t = strip(F.coalesce(col(c), F.lit("")))
    low = F.lower(t)
    part = lambda test, worth: F.when(test, worth).otherwise(0.0)
    score = (
        part(F.contains(low, F.lit("diff --git")), 1.0) + part(F.contains(t, F.lit("@@")), 0.6) + part(F.contains(t, F.lit("\n+")) | F.contains(t, F.lit("\n-")), 0.4)
        + part(F.contains(low, F.lit("index ")), 0.2) - part(F.length(t) < 40, 0.8) - part(F.length(t) > 12000, 0.6))
    return F.when(t == "", -2.0).otherwise(score)


def hardness(error_type, rounds, candidates, quality) -> Column:
    rounds, candidates = F.greatest(F.lit(1), F.coalesce(col(rounds), F.lit(1))), F.greatest(F.lit(1), F.coalesce(col(candidates), F.lit(1)))
    return (
        1.35 * lookup(error_type, ERROR_SEVERITY, OTHER_SEVERITY) + F.least(F.lit(0.60), 0.12 * rounds)
        + F.least(F.lit(0.55), 0.03 * F.greatest(F.lit(0), candidates - 1)) + F.least(F.lit(0.70), 0.05 * col(quality)))


def difficulty(length, asserts, quality) -> Column:
    return 0.55 * F.least(F.lit(1.0), col(length) / 2400.0) + 0.25 * F.least(F.lit(1.0), col(asserts) / 10.0) + 0.20 * F.least(F.lit(1.0), col(quality) / 10.0)


def macro_bucket(source, benchmark, length, error_type) -> Column:
    low = lambda c: F.lower(F.coalesce(col(c), F.lit("")))
    # Sources, benchmarks and errors of repository work.
    repo = (
        low(source).isin("online_hard_mining", "tool_trajectory_distill") | low(benchmark).isin("swebench_verified_subset", "bigcodebench_instruct", "livecodebench")
        | (F.coalesce(col(length), F.lit(0)) >= 1700) | low(error_type).isin("timeout", "security", "syntax", "format"))
    return F.when(repo, "repo_resolution").otherwise("core_code")


def pair_weight(gap, weighting: str = "score_gap") -> Column:
    return F.least(F.lit(8.0), F.greatest(F.lit(0.1), col(gap))) if weighting == "score_gap" else F.lit(1.0)


def sigmoid(x) -> Column:
    x = col(x)
    return F.when(x >= 0, 1 / (1 + F.exp(-F.abs(x)))).otherwise(F.exp(-F.abs(x)) / (1 + F.exp(-F.abs(x))))


def case_complexity(prompt, tests) -> Column:
    """From 0 to 1. Weights, and the words and asserts of a case that is as complex as can be."""
    asserts = F.regexp_count(F.coalesce(col(tests), F.lit("")), F.lit(r"\bassert\b"))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.6 * F.least(F.lit(1.0), F.size(words(prompt)) / 600.0) + 0.4 * F.least(F.lit(1.0), asserts / 8.0)))


def verifier_timeout(prompt, tests) -> Column:
    """Seconds for a case. The least, the most and what complexity adds."""
    return F.greatest(F.lit(1.5), F.least(F.lit(4.0), 2.0 + 1.5 * case_complexity(prompt, tests)))


def score_fraction(score, error_type) -> Column:
    """The share of asserts that a run's score stands for where they weren't counted."""
    s, e = col(score), F.lower(strip(F.coalesce(col(error_type), F.lit(""))))
    # Shares by error and score.
    return (
        F.when(s >= 1.99, 1.0).when(e == "assertion", 0.45).when(e.isin("runtime", "syntax"), 0.1).when(e.isin("timeout", "security"), 0.0)
        .when(s >= 0.5, 0.35).when(s > 0, 0.15).otherwise(0.0))


def round_fractions(details, asserts) -> Column:
    """Passed and total asserts guessed from rounds (array of struct score, error_type)."""
    d, total = col(details), F.greatest(F.lit(1), col(asserts)).cast("int")
    mean = F.coalesce(F.try_divide(F.aggregate(F.transform(d, lambda x: score_fraction(x["score"], x["error_type"])), F.lit(0.0), lambda a, b: a + b), F.size(d)), F.lit(0.0))
    passed = F.greatest(F.lit(0), F.least(F.bround(mean * total).cast("int"), total))
    return F.struct(passed.alias("assert_passed"), total.alias("assert_total"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), mean)).alias("pass_fraction"), F.lit("fallback_round_scores").alias("fractional_mode"))


def assert_counts(stdout, tag: str = "__ASSERT_COUNTS__") -> Column:
    """(passed, total) that an instrumented run printed."""
    found = lambda i: F.regexp_extract(F.coalesce(col(stdout), F.lit("")), rf"{tag}\s+(\d+)\s+(\d+)", i)
    return F.struct(F.try_to_number(found(1), F.lit("999999999")).cast("int").alias("passed"), F.try_to_number(found(2), F.lit("999999999")).cast("int").alias("total"))


def features(c, buckets: int) -> Column:
    """The hashed bucket of each token of two signs or more."""
    return F.transform(code_tokens(c, 1), lambda t: (hash8(t) % buckets).cast("int"))

