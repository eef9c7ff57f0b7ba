"""Golden rows: expressions on literals."""

import pytest
from pyspark.sql import functions as F

from loomspark.functions import quality as Q
from loomspark.functions import rewards as R
from loomspark.functions import text as X


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_text(spark):
    lit = F.lit
    assert value(spark, X.normalise_for_dedup(lit("Hello,  World!\n<b> É_1"))) == "hello world <b> _1"
    assert value(spark, X.normalise_for_dedup(lit("日本"))) == "" and value(spark, X.normalise_for_dedup(lit("日本!"), unicode_safe=True)) == "日本"
    assert value(spark, X.answer_of(lit("<answer>\n x\ny \n</answer>"))) == "x\ny"
    assert value(spark, X.tag_content(lit("a <b> q </b> <b>z</b>"), "b")) == "q" and value(spark, X.tag_content(lit("a"), "b")) == ""
    assert value(spark, X.hash8(lit("src||p||a"))) == 494548711 and value(spark, X.hash8(lit("src||p||b"))) == 2133053196
    assert value(spark, X.truncated(lit("  abc def  "), 4)) == "abc\n...[truncated]" and value(spark, X.truncated(lit(" ab "), 0)) == "ab"
    assert value(spark, X.prompt_prefix(lit(f"x{X.ASSISTANT}y{X.ASSISTANT}z"))) == f"x{X.ASSISTANT}" and value(spark, X.prompt_prefix(lit("x"))) == "x"
    assert value(spark, X.truncated_prompt(lit("a" * 50 + X.ASSISTANT), 40)).endswith(X.ASSISTANT) and len(value(spark, X.truncated_prompt(lit("a" * 50 + X.ASSISTANT), 40))) == 40
    assert value(spark, X.without_fences(lit("```python\nx\n```"))) == "x"
    assert value(spark, X.token_f1(lit("a b b c"), lit("b b b d"))) == 0.5 and value(spark, X.token_f1(lit(""), lit("a"))) == 0
    assert value(spark, X.code_tokens(lit("Foo ab a1b _x yz9"))) == ["foo", "a1b", "yz9"]
    assert value(spark, X.assistant_block(lit(" a "), lit(" "))) == f"{X.ASSISTANT}<answer>\na\n</answer><|im_end|>"
    assert value(spark, X.percent(lit(0.5), lit(0.25), lit(1.0))) == "50.00% [95% CI 25.00, 100.00]"
    assert value(spark, X.strip(lit(" \t x\n"))) == "x"


def test_three_rules_for_missing_values(spark):
    df = spark.createDataFrame([(None, "b", " ", ["x", None, "y"], [""])], "a string, b string, c string, d array<string>, e array<string>")
    assert df.select(X.column_text(df, "zz", "a", "b")).first()[0] == ""
    assert df.select(X.first_truthy(df, ("a", "c", "b"))).first()[0] == " "
    assert df.select(X.first_nonempty(df, ("a", "c", "b"))).first()[0] == "b"
    assert df.select(X.column_text(df, "d")).first()[0] == "x\ny" and df.select(X.first_truthy(df, ("e", "b"))).first()[0] == ""


def test_reasoning_mode(spark):
    df = spark.createDataFrame([("i", "p")], "instruction string, prompt string")
    assert df.select(X.reasoning_mode(df, 0.7)).first()[0] is False and df.select(X.reasoning_mode(df, 0.96)).first()[0] is True


def test_quality(spark):
    q = value(spark, Q.test_quality(F.lit("assert foo(1) == 2\nassert foo(2) == 3")))
    assert (q.nonempty_lines, q.assert_count, q.test_fn_count) == (2, 2, 0) and q.quality_score == pytest.approx(1.9)
    assert not value(spark, Q.sufficient(Q.test_quality(F.lit("assert a\nassert b")))) and value(spark, Q.sufficient(Q.test_quality(F.lit("assert a\nassert b")), 2, 2, 1.0))
    assert value(spark, Q.test_quality(F.lit(None).cast("string"))).quality_score == 0
    assert value(spark, Q.test_quality(F.lit("a\rassert x"))).assert_count == 0
    assert value(spark, Q.hardness(F.lit("assertion"), F.lit(3), F.lit(22), F.lit(1.9))) == pytest.approx(1.815)
    assert value(spark, Q.difficulty(F.lit(1200), F.lit(5), F.lit(5.0))) == pytest.approx(0.5)
    flags = [value(spark, Q.answer_flags(F.lit(t))).answer_kind for t in ("", "<answer>x = 1</answer>", "<answer>diff --git a b\n@@</answer>", "<answer>def f(:</answer>")]
    assert flags == ["missing", "code", "patch", "code"]
    assert value(spark, Q.answer_flags(F.lit("<answer>```python\nx = 1\n```</answer>"))).answer_quality_ok
    assert value(spark, Q.patch_quality(F.lit(""))) == -2 and value(spark, Q.pair_weight(F.lit(9.0))) == 8
    assert value(spark, Q.sigmoid(F.lit(-800.0))) == 0 and value(spark, Q.sigmoid(F.lit(800.0))) == 1
    assert [value(spark, Q.score_fraction(F.lit(s), F.lit(e))) for s, e in ((2.0, ""), (0.5, "assertion"), (0.1, "runtime"), (-0.5, "timeout"), (0.6, ""), (0.2, ""), (0.0, ""))] == [1, 0.45, 0.1, 0, 0.35, 0.15, 0]
    assert value(spark, Q.assert_counts(F.lit("x\n__ASSERT_COUNTS__ 2 3\n"))).asDict() == {"passed": 2, "total": 3}
    d = value(spark, Q.round_fractions(F.array(F.struct(F.lit(2.0).alias("score"), F.lit("").alias("error_type")), F.struct(F.lit(0.1).alias("score"), F.lit("runtime").alias("error_type"))), F.lit(4)))
    assert (d.assert_passed, d.assert_total, d.fractional_mode) == (2, 4, "fallback_round_scores")
    assert value(spark, Q.macro_bucket(F.lit("Tool_Trajectory_Distill"), F.lit(""), F.lit(1), F.lit(""))) == "repo_resolution"


def test_rewards(spark):
    lit = F.lit
    both = "<reasoning>r</reasoning><answer>a</answer>"
    assert [value(spark, R.format_reward(lit(t))) for t in ("x", "<answer>a</answer>", both)] == [-1.5, 0.5, 1.0]
    run = lambda ok, frac, t, e: value(spark, R.execution_reward(lit(True), lit(True), lit(ok), lit(frac), lit(t), lit(e), 1, 100))
    assert run(False, 0.5, 0.1, "assertion") == pytest.approx(0.303) and run(True, 1.0, 0.01, "") == pytest.approx(2.424) and run(True, 1.0, 0.9, "") == pytest.approx(1.616)
    assert value(spark, R.execution_reward(lit(False), lit(True), lit(True), lit(1.0), lit(0.1), lit(""))) == 0 and value(spark, R.execution_reward(lit(True), lit(False), lit(True), lit(1.0), lit(0.1), lit(""))) == -3
    df = spark.createDataFrame([(0, "p", "<answer>x</answer>"), (1, "p", "<answer>X </answer>"), (2, "q", "x")], "i int, p string, t string")
    assert [r[1] for r in df.select("i", R.diversity_reward("p", "t", "i")).orderBy("i").collect()] == pytest.approx([0.08, -0.15, 0.08])
    strong = "<reasoning>First, the assertion failed on an edge case because of a boundary.\nThen test it step by step, finally assert the regression.</reasoning><answer>def f(): return 1 + 1</answer>"
    weak = "<reasoning>ok</reasoning><answer>x</answer>"
    score = lambda t: value(spark, R.process_reward(lit("error_type=assertion"), lit(t), lit("assert f() == 2")))
    assert score(strong) > score(weak)
    assert value(spark, R.self_check_reward(lit("<reasoning>assert a, assert b</reasoning>"))) == 0.5
    assert R.reward_names("dense_exec_v1") == ["format", "length", "diversity", "self_check", "execution"] and "process" in R.reward_names("??")
    assert value(spark, R.length_reward(lit("p"), lit("w " * 100), lit(""))) == 0


def test_token_overlap_of_long_patches(spark):
    """Multisets of tokens, and 100,000 of them in seconds."""
    import random
    import time
    from collections import Counter

    r = random.Random(1)
    pairs = [(" ".join(r.choice("abcde") for _ in range(r.randrange(30))), " ".join(r.choice("abcdx") for _ in range(r.randrange(30)))) for _ in range(60)] + [("", ""), ("a", ""), (None, "b")]
    pairs.append((" ".join(f"w{r.randrange(50_000)}" for _ in range(100_000)), " ".join(f"w{r.randrange(50_000)}" for _ in range(100_000))))
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, p string, q string")
    began = time.time()
    got = dict(df.select("i", X.token_f1("p", "q")).collect())
    assert time.time() - began < 30
    for i, (p, q) in enumerate(pairs):
        a, b = Counter((p or "").split()), Counter((q or "").split())
        n = a.total() + b.total()
        assert abs(got[i] - (2 * (a & b).total() / n if n else 0.0)) < 1e-12
