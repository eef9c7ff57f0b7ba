"""Rejection sampling and the evaluation report as composites, and the verifier's second try."""

import json

import pytest
from loomspark.operators import evaluation, rejection, verify
from pyspark.sql import functions as F

GOOD = "assert f(1) == 2\nassert edge\nassert f(3)\nx = 1"
COMPLETIONS = "key int, text string, temperature double, score double, exec_time double"


def prompts(spark, rows):
    df = spark.createDataFrame(rows, "id int, prompt string, text string, tests string")
    return rejection.tested_prompts(df, "id", rejection.prompt_only("prompt", "text"), "tests", max_chars=60)


def test_prompts(spark):
    got = {r.key: r.prompt for r in prompts(spark, [(1, "p", "t", GOOD), (2, None, "u<|im_start|>assistant\nanswer", GOOD), (3, "", "plain", GOOD), (4, "p", "t", " "), (5, "p", "t", "assert x"), (6, "x" * 90, "", GOOD), (7, "p", "", None)]).collect()}
    assert got == {1: "p", 2: "u<|im_start|>assistant\n", 3: "plain", 6: "x" * 60}


def test_distil(spark):
    known = prompts(spark, [(1, "P1 ", "", GOOD), (2, "P2 ", "", GOOD), (3, "P3 ", "", GOOD)])
    tag = lambda x: f"<answer>{x}</answer>"
    rows = [(1, tag("slow"), 0.2, 2.0, 0.9), (1, tag("quick"), 0.8, 2.0, 0.1), (1, tag("bad"), 0.2, 0.5, 0.1), (1, tag("worse"), 0.2, 0.1, 0.1), (1, tag("close"), 0.2, 1.5, 0.1), (1, tag("last"), 0.2, -1.0, 0.1), (1, "no answer", 0.2, 2.0, 0.0),
            (2, tag("failed"), 0.2, 0.5, 0.1), (3, tag("only"), 0.2, 2.0, 0.1), (3, tag("lost"), 0.8, 0.0, 0.1), (9, tag("unknown"), 0.2, 2.0, 0.1)]
    found = rejection.answered(spark.createDataFrame(rows, COMPLETIONS), "text")
    distilled, pairs = rejection.distil(known, found)
    assert {r.key: (r.text, r.chosen_temperature) for r in distilled.collect()} == {1: ("P1 " + tag("quick"), 0.8), 3: ("P3 " + tag("only"), 0.2)}
    # ranks come before the filters: the closest failed one takes the first rank, and the fourth is never seen
    assert {(r.key, r.rejected, r.negative_rank, r.num_evaluated) for r in pairs.collect()} == {(1, tag("bad"), 2, 6), (1, tag("worse"), 3, 6)}
    with pytest.raises(ValueError, match="2 distilled rows"):
        rejection.distil(known, found, min_distilled=3)
    with pytest.raises(ValueError, match="2 pairs"):
        rejection.distil(known, found, min_pairs=3)
    assert [d.count() for d in rejection.distil(known, found.where("false"))] == [0, 0]


def test_report(spark, tmp_path):
    classic = spark.createDataFrame([("mbpp", str(i), i % 2 == 0, True, 1, 4) for i in range(10)], "benchmark string, id string, pass_at_1 boolean, pass_at_k boolean, format_errors int, generated_candidates int")
    patches = spark.createDataFrame([("swebench_verified_subset", f"s{i}", "diff" if i else " ", 0.9, True, True) for i in range(4)], "benchmark string, id string, best_patch string, resolve_proxy double, pass_at_1 boolean, pass_at_k boolean")
    resolved = spark.createDataFrame([("s1",)], "id string")
    judged, alike = evaluation.patch_log(patches, resolved), evaluation.patch_log(patches)
    assert {(r.id, r.pass_at_1, r.format_errors, r.generated_candidates, r.resolve_proxy) for r in judged.collect()} == {("s0", False, 1, 1, None), ("s1", True, 0, 1, None), ("s2", False, 0, 1, None), ("s3", False, 0, 1, None)}
    found = evaluation.report(evaluation.assemble(classic, judged), 50)
    rows = {r.scope: r for r in found.collect()}
    assert set(rows) == {"benchmark/mbpp", "benchmark/swebench_verified_subset", "group/contamination_safe_coding", "group/practical_swe_agentic", "global/"}
    assert rows["global/"].total == 14 and rows["global/"].pass_at_1_ci[0] == pytest.approx(6 / 14) and rows["global/"].resolve_proxy_ci is None
    assert rows["benchmark/mbpp"].format_error_rate_ci == [0.25] * 3
    assert {r.scope: r for r in evaluation.report(alike, 20).collect()}["global/"].resolve_proxy_ci == pytest.approx([0.9] * 3)
    evaluation.save_report(spark, found, f"file://{tmp_path}/out/report.json")
    saved = json.loads((tmp_path / "out" / "report.json").read_text())
    assert saved["per_benchmark"]["mbpp"]["total"] == 10 and saved["groups"]["practical_swe_agentic"]["total"] == 4 and saved["global"]["total"] == 14
    assert "global/" in {r.scope for r in evaluation.lines(found).where(F.col("line").startswith("pass_at_1: 42.86%")).collect()}


def test_a_report_reads_its_log_once(spark):
    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def seen(x):
        read.add(1)
        return x

    rows = [(b, str(i), i % 2 == 0, True, i % 3, 4, i % 4 + 1, i % 5 / 4) for i in range(30) for b in ("mbpp", "private_holdout", None)]
    log = spark.createDataFrame(rows, evaluation.LOG).withColumn("benchmark", seen("benchmark"))
    found = {r.scope: r for r in evaluation.report(log, 20).collect()}
    assert read.value == len(rows)
    assert (found["global/"].total, found["benchmark/mbpp"].total) == (90, 30) and found["global/"].avg_rounds == pytest.approx(sum(r[6] for r in rows) / 90)
    assert found["benchmark/mbpp"].resolve_proxy_ci[0] == pytest.approx(0.5) and found["global/"].format_error_rate_ci[0] == pytest.approx(0.25)


def test_a_timeout_is_tried_again_with_more_time(monkeypatch):
    spent = []

    def run(code, seconds):
        spent.append(seconds)
        late = seconds < 3
        return {"score": -0.5 if late else 2.0, "exec_time": seconds, "stdout": "", "stderr": "", "error_type": "timeout" if late else ""}

    monkeypatch.setattr(verify, "run", run)
    assert [r["score"] for r in verify.verify("x = 1", "assert x", 1, 2.0)] == [2.0] and spent == [2.0, 3.0]
    spent.clear()
    assert [r["error_type"] for r in verify.verify("x = 1", "assert x", 2, 1.0)] == ["timeout"] * 2 and spent == [1.0, 1.5] * 2


def test_a_program_that_never_ends(spark):
    rows = spark.createDataFrame([("a", "while True:\n    pass", "assert True")], "k string, code string, tests string")
    found = verify.run_verifier(rows, "k", "code", "tests", 1, 0.3, allow_execution=True).collect()
    assert [(r.k, r.error_type, r.score) for r in found] == [("a", "timeout", -0.5)]
