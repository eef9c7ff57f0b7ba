"""Rewards of completions as expressions. The training step is a parameter, not a counter."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from .quality import case_complexity, lookup
from .text import LINE_BREAK, col, contains_any, count_of, identifiers, strip, tag_content, without_fences, words

# What an error costs, and one that isn't listed.
ERROR_PENALTY = {"format": -1.8, "security": -1.6, "timeout": -1.3, "syntax": -0.9, "assertion": -0.4, "runtime": -0.3, "": 0.0}
OTHER_PENALTY = -0.25


def step_weights(step: int, max_steps: int) -> tuple[float, float]:
    """(format, execution) weights at a training step."""
    progress = min(1.0, step / max(1.0, float(max_steps)))
    return max(0.1, 1.0 - progress), 1.0 + progress


def has_tags(text, tag: str) -> Column:
    return F.contains(col(text), F.lit(f"<{tag}>")) & F.contains(col(text), F.lit(f"</{tag}>"))


def format_reward(text, step: int = 0, max_steps: int = 100) -> Column:
    weight = step_weights(step, max_steps)[0]
    answer, reasoning = has_tags(text, "answer"), has_tags(text, "reasoning")
    return F.when(answer & reasoning, 1.0 * weight).when(answer, 0.5 * weight).otherwise(-1.5)


def length_reward(prompt, text, tests) -> Column:
    n, c = F.size(words(text)), case_complexity(prompt, tests)
    soft, hard = (280 + 620 * c).cast("int"), (700 + 1300 * c).cast("int")
    return F.when(n < soft, 0.0).when(n < hard, -0.2).when(n < hard + 300, -0.5).otherwise(F.greatest(F.lit(-2.0), -0.5 - (n - hard - 300) * 0.001))


def self_check_reward(text) -> Column:
    r = tag_content(text, "reasoning")
    asserts, tests = count_of(r, "assert "), count_of(r, "def test_")
    return F.when(r == "", 0.0).when((asserts >= 2) | (tests >= 1), 0.5).when(asserts == 1, 0.2).otherwise(0.0)


def answer_fingerprint(text) -> Column:
    answer = F.coalesce(F.nullif(tag_content(text, "answer"), F.lit("")), col(text))
    return F.substring(F.regexp_replace(F.lower(without_fences(answer, ("```python", "```"))), r"(?U)\s+", " "), 1, 500)


def diversity_reward(prompt, text, order) -> Column:
    """First of its kind under a prompt earns, each repeat costs more."""
    return repeat_reward(F.row_number().over(Window.partitionBy(F.coalesce(col(prompt), F.lit("")), answer_fingerprint(text)).orderBy(order)) - 1)


def repeat_reward(seen) -> Column:
    """From the number of equal answers before."""
    seen = col(seen)
    return F.when(seen == 0, 0.08).otherwise(-F.least(F.lit(0.25), 0.10 + 0.05 * seen))


def structure_score(reasoning, prompt, tests) -> Column:
    r = col(reasoning)
    lines = F.size(F.filter(F.split(r, LINE_BREAK), lambda x: strip(x) != ""))
    shared = F.size(F.array_intersect(identifiers(F.concat(F.coalesce(col(prompt), F.lit("")), F.lit("\n"), F.coalesce(col(tests), F.lit("")))), identifiers(r)))
    w = words(r)
    dull = (F.size(w) > 0) & (F.size(F.array_distinct(F.transform(w, F.lower))) / F.greatest(F.lit(1), F.size(w)) < 0.35)
    part = lambda test, worth: F.when(test, worth).otherwise(0.0)
    # Signs of structure and what they are worth.
    score = (
        part(lines >= 2, 0.08) + part(contains_any(r, ["because", "therefore", "so that", "hence"]), 0.07)
        + part(contains_any(r, ["first", "second", "then", "finally", "step"]), 0.08) + part(shared >= 2, 0.07) - part(dull, 0.12))
    return F.when(r == "", -0.05).otherwise(score)


def process_record(prompt, text, tests) -> Column:
    """The text that a learned scorer reads of a completion."""
    empty = lambda c: F.coalesce(col(c), F.lit(""))
    parts = [("prompt=", empty(prompt)), ("\nreasoning=", tag_content(text, "reasoning")), ("\ntests=", empty(tests)), ("\nanswer=", tag_content(text, "answer"))]
    return F.concat(*[x for label, value in parts for x in (F.lit(label), F.coalesce(value, F.lit("")))])


def process_reward(prompt, text, tests, prm=None) -> Column:
    """Keyword rules on the reasoning, its structure, the answer's length and a learned scorer (0.5 without one)."""
    r, answer = tag_content(text, "reasoning"), tag_content(text, "answer")
    n, expected = F.size(words(r)), F.coalesce(col(tests), F.lit(""))
    has = lambda *needles: contains_any(r, needles)
    error = lambda kind: F.contains(F.lower(F.coalesce(col(prompt), F.lit(""))), F.lit(f"error_type={kind}"))
    part = lambda test, worth: F.when(test, worth).otherwise(0.0)
    tested = F.contains(expected, F.lit("assert"))
    # Keywords and what they are worth.
    rules = (
        part(n >= 30, 0.20) + part(n >= 70, 0.10) - part(n > 450, 0.15) + part(has("assert", "test"), 0.20) + part(has("edge", "boundary", "corner"), 0.15)
        + part(has("complex", "o("), 0.10) + part(has("first", "then", "finally", "step", "plan"), 0.10)
        + part(error("timeout") & has("optimiz", "complex"), 0.20) + part(error("syntax") & has("syntax", "parse"), 0.20)
        + part(error("assertion") & has("edge", "case"), 0.20) + part(error("format") & has("format", "xml", "tag"), 0.20)
        + part(error("security") & has("sanitize", "safe", "sandbox", "restrict"), 0.20)
        + part(tested & has("assert", "test"), 0.10) + part(tested & has("regression", "edge", "boundary"), 0.10))
    length = F.size(words(answer))
    closing = F.when(answer == "", -0.20).when(length < 4, -0.12).when(length <= 220, 0.06).otherwise(0.0)
    learned = ((F.lit(0.5) if prm is None else F.coalesce(col(prm), F.lit(0.5))) - 0.5) * 0.60
    total = F.when(r == "", -0.10).otherwise(rules) + structure_score(r, prompt, expected) + closing + learned
    return F.greatest(F.lit(-0.5), F.least(F.lit(1.0), total))


def execution_reward(has_tests, has_answer, all_passed, pass_fraction, exec_time, error_type, step: int = 1, max_steps: int = 100) -> Column:
    """From a verifier's columns; step is the call's number, from 1."""
    t = col(exec_time)
    passed = 2.0 + F.when(t < 0.05, 0.4).when(t > 0.8, -0.4).otherwise(0.0)
    failed = F.greatest(F.lit(-0.2), 1.4 * col(pass_fraction)) + lookup(error_type, ERROR_PENALTY, OTHER_PENALTY)
    score = F.when(col(all_passed), passed).otherwise(failed) * step_weights(step, max_steps)[1]
    return F.when(~col(has_tests), 0.0).when(~col(has_answer), -3.0).otherwise(F.greatest(F.lit(-3.0), F.least(F.lit(3.5), score)))


def reward_names(profile: str) -> list[str]:
    """Rewards of a profile, in order; an unknown one has the process reward too."""
    dense = ["format", "length", "diversity", "self_check", "execution"]
    return dense if (profile or "dense_exec_v1").strip().lower() == "dense_exec_v1" else [*dense[:3], "process", *dense[3:]]
