"""Operators on small frames: golden values and properties."""

import pytest
from pyspark.sql import functions as F

from loomspark.operators import cases, curriculum, dedup, prm, ranking, retrieval, sampling, stats, templates, verify


def test_dedup_is_idempotent_and_keeps_the_first(spark):
    df = spark.createDataFrame([(1, "A b", "x"), (2, "a  B", "x"), (3, "c", None), (4, "c", "")], "i int, p string, a string")
    key = dedup.prompt_answer_key("p", "a")
    once = dedup.keep_first(df, key, "i")
    assert sorted(r.i for r in once.collect()) == [1, 3] and dedup.keep_first(once, key, "i").count() == 2
    assert sorted(r.i for r in dedup.keep_first(df, key, "i", last=True).collect()) == [2, 4]
    chunks = spark.range(1).select(dedup.distinct_chunks(F.array(F.lit(" a  B"), F.lit("A b"), F.lit(""), F.lit("c")))).first()[0]
    assert chunks == ["a  B", "c"]


def test_splits_are_disjoint_and_whole(spark):
    df = spark.range(2000).withColumn("split", sampling.hash_split(F.col("id").cast("string")))
    counts = {r[0]: r[1] for r in df.groupBy("split").count().collect()}
    assert sum(counts.values()) == 2000 and set(counts) == {"train", "val", "holdout"} and counts["train"] > 1600
    assert sampling.overlapping_keys(df, F.col("id")).isEmpty()


def test_mix_and_caps(spark):
    counts = {"code": 60, "reasoning": 30, "repo": 10}
    assert sampling.category_quotas(counts, sampling.DEFAULT_WEIGHTS) == counts
    assert sum(sampling.category_quotas(counts, sampling.DEFAULT_WEIGHTS, 37).values()) == 37
    assert sampling.parse_weights("code:1,bad,repo:x,reasoning:-1") == {"code": pytest.approx(1 / 1.3), "repo": pytest.approx(0.3 / 1.3), "reasoning": 0.0}
    df = spark.createDataFrame([(i, "A" if i < 7 else "B", float(i)) for i in range(10)], "i int, k string, s double")
    capped = sampling.share_cap(df, "k", 0.45, "s", "i")
    assert {r[0]: r[1] for r in capped.groupBy("k").count().collect()} == {"A": 4, "B": 3}
    assert sampling.share_cap(capped, "k", 0.65, "s", "i").count() == 7 and sampling.share_cap(df, "k", 1.0, "s", "i").count() == 10
    assert sampling.cap_per_key(df, "k", 2, "i").count() == 4 and sampling.cap_per_key(df, "k", 0, "i").count() == 10


def test_replication(spark):
    def copies(*weights):
        df = spark.createDataFrame([(i, float(w)) for i, w in enumerate(weights)], "i int, w double")
        return [r[1] for r in sampling.gap_copies(df, "w").groupBy("i").count().orderBy("i").collect()]

    assert copies(1, 2, 8) == [1, 1, 4] and copies(2, 2, 5) == [1, 1, 2]
    df = spark.range(30)
    for boost, more in ((1.8, 8), (2.5, 15)):
        assert sampling.upsample(df, F.col("id") < 10, boost, "id").count() == 30 + more
    assert [sampling.eval_size(n, 0.05) for n in (199, 1000, 4000)] == [0, 50, 200]
    split = sampling.train_eval_split(spark.range(1000), 0.05, "id")
    assert split.where("split = 'eval'").count() == 50


def test_order_statistics_and_tiers(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(1, 9)], "i int, s double")
    assert [r[1] for r in curriculum.tiers(df, "s").groupBy("tier").count().orderBy(F.desc("count"), "tier").collect()] == [3, 2, 2, 1]
    ten = spark.createDataFrame([(float(i),) for i in range(1, 11)], "s double")
    assert curriculum.drop_low_quality(ten, "s", 0.2, 5).count() == 8 and curriculum.drop_low_quality(ten, "s", 0.2, 10).count() == 10


def test_budgets():
    assert curriculum.allocate_steps([0.2, 0.3, 0.3, 0.2], 1500) == [306, 444, 444, 306]
    assert curriculum.allocate_steps([0.15] * 3 + [0.55 / 3] * 3, 1500) == [228, 228, 228, 272, 272, 272]
    assert curriculum.allocate_steps([0.5, 0.5, 0.1], 2) == [1, 1, 0] and curriculum.allocate_steps([], 5) == []


def test_pairs_and_beams(spark):
    rows = [("p", 2.0, 0.2, "good"), ("p", 2.0, 0.1, "fast"), ("p", 0.5, 0.1, "half"), ("p", 0.1, 0.1, "bad"), ("q", 0.5, 0.1, "x")]
    df = spark.createDataFrame(rows, "prompt string, score double, exec_time double, text string")
    order = ranking.candidate_order()
    best = ranking.best_of_n(df, "prompt", order).collect()
    assert [(r.prompt, r.text, r.num_evaluated) for r in best] == [("p", "fast", 4)]
    pairs = ranking.preference_pairs(df, "prompt", order, 2).orderBy("negative_rank").collect()
    assert [(r.chosen, r.rejected, r.negative_rank, r.pair_weight) for r in pairs] == [("fast", "half", 1, 1.5), ("fast", "bad", 2, 1.9)]
    many = spark.createDataFrame([("p", "c", f"r{i}", 1.0 + i, 0.1, 2, i) for i in range(9)] + [("p", "c", "r8", 9.0, 0.1, 2, 10)], "prompt string, chosen string, rejected string, score_gap double, rejected_score double, test_assert_count int, i int")
    assert sorted(r.rejected for r in ranking.prepare_pairs(many, "i").collect()) == [f"r{i}" for i in range(3, 9)]
    assert ranking.prepare_pairs(many, "i", per_prompt=0).count() == 9
    assert [r.text for r in ranking.beam(df.union(df), "prompt", "text", 2, order).where("prompt = 'p'").orderBy("beam_rank").collect()] == ["fast", "good"]


def test_aligned_differences_take_the_last_row(spark):
    schema = "benchmark string, mode string, id string, pass_at_1 boolean, format_errors int, generated_candidates int, i int"
    base = spark.createDataFrame([("livecodebench", "code", "1", False, 1, 4, 0), ("livecodebench", "code", "2", True, 0, 0, 1)], schema)
    post = spark.createDataFrame([("livecodebench", "code", "1", False, 0, 4, 0), ("livecodebench", "code", "1", True, 0, 4, 2), ("livecodebench", "code", "2", True, 0, 4, 1), ("x", "code", "3", True, 0, 1, 3)], schema)
    assert [r.diff for r in cases.align_diffs(base, post, "pass", "i", "livecodebench").orderBy("id").collect()] == [1.0, 0.0]
    assert [r.diff for r in cases.align_diffs(base, post, "format", "i").orderBy("id").collect()] == [-0.25, 0.0]
    with pytest.raises(ValueError):
        cases.metric("other")
    ids = cases.case_ids(base.where("id = '1'"))
    assert cases.filter_cases(post, ids).count() == 3
    with pytest.raises(ValueError):
        cases.require_benchmarks(post.where("benchmark = 'x'"), ids)


def test_intervals(spark):
    empty = spark.createDataFrame([], "k int, value double")
    one = spark.createDataFrame([(1, 0.5)], "k int, value double")
    many = spark.createDataFrame([(i, float(i % 3)) for i in range(50)], "k int, value double")
    assert stats.bootstrap_ci(one, 20).first()[:3] == (0.5, 0.5, 0.5)
    r = stats.bootstrap_ci(many, 60).first()
    assert r.low <= r["mean"] <= r.high and stats.bootstrap_ci(empty, 10).count() <= 1
    diffs = spark.createDataFrame([(i, c, 1.0 if i % 2 else 0.5) for c in cases.COMPONENTS for i in range(6)], "i int, component string, diff double")
    ci = stats.weighted_diff_ci(diffs, cases.COMPONENTS, 40).first()
    assert ci.observed == pytest.approx(0.75) and ci.low <= ci.observed <= ci.high
    p = stats.sign_flip(diffs, cases.COMPONENTS, 40).first().p_value
    assert 1 / 41 <= p <= 1 and stats.sign_flip(diffs, cases.COMPONENTS, 0).first().p_value == 1.0
    with pytest.raises(ValueError):
        stats.require_components(diffs.where("component != 'format_quality'"), cases.COMPONENTS)


def test_retrieval_scores(spark):
    docs = spark.createDataFrame([("d1", "", "alpha beta"), ("d2", "", "beta beta gamma")], "doc string, path string, body string")
    queries = spark.createDataFrame([(1, "beta alpha alpha")], "q int, t string")
    index = retrieval.index(docs, "doc", "path", "body").withColumn("symbols", F.array().cast("array<string>"))
    found = {r.doc: r.score for r in retrieval.retrieve(index, queries, "q", "t").collect()}
    assert found == {"d1": pytest.approx(1.708393573965574), "d2": pytest.approx(0.2373416715660948)}


def test_scorer_learns(spark):
    rows = [(0, "good fix passes tests", 1), (1, "bad crash error", 0), (2, "good clean passes", 1), (3, "error crash timeout", 0)]
    df = spark.createDataFrame(rows, "i int, t string, y int")
    model = prm.train(df, "t", "y", "i", 1024, 6, 0.1)
    weights, bias = model.where("bucket >= 0"), model.where("bucket = -1").first().weight
    scores = {r.i: r.score for r in prm.predict(df, "i", "t", weights, bias, 1024).collect()}
    assert min(scores[0], scores[2]) > max(scores[1], scores[3])


def test_templates(spark):
    df = spark.createDataFrame([("do", "x = 1", "why", ["assert x"], [("ls", "files"), ("", "none")])], "instruction string, solution string, reasoning_trace string, tests array<string>, trajectory array<struct<action:string,observation:string>>")
    r = templates.format_source(df, "reasoning", "s").first()
    assert r.text.startswith("<|im_start|>system\n") and r.prompt.endswith("<|im_start|>assistant\n") and r.tests == "assert x" and r.source == "s"
    t = templates.format_source(df, "trajectory").first()
    assert "Issue: Resolving Unknown Issue\n\n[Action]: ls\n[Observation]: files" in t.text and "Observation: none" in t.text
    s = templates.format_swe_trajectory(df).first()
    assert s.trajectory == "[ACTION] ls\n[OBS] files\n[OBS] none" and s.swe_granularity == "repo_level"
    for kind in (*templates.TEMPLATES, "commit"):
        assert templates.format_source(df, kind).first().text.endswith("</answer><|im_end|>")
    rl = templates.format_rl(df).first()
    assert rl.has_tests and not rl.tests_quality_ok and rl.source == "unknown"
    files = spark.createDataFrame([(["  ", ""], ["a.py ", None])], "files array<string>, file_paths array<string>")
    assert files.select(templates.affected_files(files)).first()[0] == ["a.py"]


def test_code_checks_and_runs(spark):
    assert [verify.violation(c) for c in ("import math", "import os", "eval('1')", "x.__class__", "def f(:", "os.system('x')", "[].append(1)")] == ["", "security", "security", "security", "syntax", "security", ""]
    df = spark.createDataFrame([(1, "def add(a, b): return a + b", "assert add(1, 2) == 3\nassert add(1, 1) == 3")], "i int, c string, t string")
    with pytest.raises(PermissionError):
        verify.run_verifier(df, "i", "c", "t")
    r = verify.run_verifier(df, "i", "c", "t", allow_execution=True).first()
    assert (r.error_type, r.score, r.assert_passed, r.assert_total) == ("assertion", 0.5, 1, 2)


def test_repairs(spark):
    from loomspark.operators import repair

    df = spark.createDataFrame([("P", "said<|im_end|>", "code", "boom", "NameError: x", "out", 2)], "prefix string, said string, code string, error string, stderr string, stdout string, r int")
    text = df.select(repair.repair_prompt("prefix", "said", "code", "error", "stderr", "stdout", "r")).first()[0]
    assert text.startswith("P<|im_start|>assistant\nsaid<|im_end|>\n") and repair.NAME_POLICY[0] in text and text.endswith("<|im_start|>assistant\n")
    assert "balanced" not in df.select(repair.patch_repair_prompt("prefix", "code", "r", F.lit("api_first"))).first()[0]
    assert "Repository Context:\nout" in df.select(repair.context_prefix("said", "stdout")).first()[0]
    shaped = spark.createDataFrame([([("", "t")], "s")], "a array<struct<content:string,text:string>>, b string")
    assert shaped.select(repair.completion_text(shaped, "a"), repair.completion_text(shaped, "b")).first()[:] == ("t", "s")
    assert repair.parse_temperatures("0.1,x,9") == [0.1, 1.5] and repair.parse_temperatures("") == [0.2, 0.8]
    assert repair.parse_schedule("", 6) == [6, 4, 4] and repair.parse_schedule("3,0", 6) == [3, 1]
    assert repair.parse_strategies("api_first,no") == ["api_first"] and repair.stage_drop("core_easy", repair.parse_stage_drops("easy:0.3,mid:x")) == 0.3


def test_budgets(spark):
    df = spark.createDataFrame([("repo_hard", 8192, 8, 3), ("easy", 1024, 2, 5), (None, 3000, 0, 1), ("x_Expert", 4000, 7, 7)], "stage string, most int, k int, parts int")
    rows = df.select("most", *[c.alias(n) for c, n in zip(curriculum.context_lengths("stage", "most"), ("p", "c"))], curriculum.split_budget("k", "parts").alias("b")).collect()
    assert [(r.p, r.c) for r in rows] == [(3072, 2048), (512, 256), (1536, 1208), (3072, 672)]
    assert [r.b for r in rows] == [[3, 3, 2], [1, 1, 0, 0, 0], [1], [1] * 7]
    assert all(r.p + r.c <= max(1024, r.most) - 256 for r in rows)
    for ratios, total in (([0.1, 0.2, 0.7], 100), ([0, 0, 0], 95), ([1, 1, 1], 4), ([3, 1], 61)):
        steps = curriculum.allocate_steps(ratios, total)
        assert sum(steps) == total and all(s >= (30 if total >= 30 * len(ratios) else 1) for s in steps)


def test_settings_of_columns_parse_as_texts_do(spark):
    from loomspark.operators import repair

    texts = ["0.3,x,9", "", None, " 1 , -2,.5", "0,6", "api_first, nothing, Balanced", "1e-1,5.", ",,"]
    df = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)], "i int, t string, base int")
    for r in df.select("i", repair.temperatures("t").alias("a"), repair.schedule("t", "base").alias("b"), repair.strategies("t").alias("c")).collect():
        assert (r.a, r.b, r.c) == (repair.parse_temperatures(texts[r.i]), repair.parse_schedule(texts[r.i], r.i), repair.parse_strategies(texts[r.i]))
