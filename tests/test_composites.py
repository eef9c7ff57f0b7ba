"""The composites' errors and edges; their results are held against SQL in test_queries."""

import pytest

from loomspark.operators import cases, corpus, patches, rl, sampling, trajectories
from loomspark.sources.work import Work


def evol(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, instruction string, output string")


def test_missing_sources_and_policies(spark):
    def broken():
        raise OSError("gone")

    rows = evol(spark, [(i, f"task {i}", f"x = {i}") for i in range(60)] + [(99, " ", "y"), (98, "t", None)])
    made = corpus.build({"a": ("evol", "code", lambda: rows), "b": ("math", "reasoning", broken)}, "doc_id", Work(spark, "t").save, most_missing=1)
    assert made.missing == ["b"] and made.metrics_before.first().total == 60
    with pytest.raises(RuntimeError):
        corpus.build({"b": ("math", "reasoning", broken)}, "doc_id", Work(spark, "t").save, most_missing=0)
    with pytest.raises(ValueError):
        corpus.formatted({}, "doc_id")
    with pytest.raises(ValueError):
        corpus.with_split(made.records, policy="other")


def test_splits_may_not_be_empty_nor_overlap(spark):
    df = spark.createDataFrame([("s", f"p{i}", f"<answer>{i}</answer>") for i in range(400)], "source string, prompt string, text string")
    split = corpus.with_split(df)
    counts = corpus.require_splits(split)
    assert set(counts) == {"train", "val", "holdout"} and sum(counts.values()) == 400
    with pytest.raises(ValueError, match="empty"):
        corpus.require_splits(split.where("split = 'train'"))
    twice = split.unionByName(split.where("split = 'train'").limit(1).selectExpr("source", "prompt", "text", "'val' AS split"))
    with pytest.raises(ValueError, match="stands in"):
        corpus.require_splits(twice)


def test_metrics_of_nothing_and_thresholds(spark):
    empty = spark.createDataFrame([], "prompt string, tests string, answer_kind string, answer_ast_ok boolean, answer_patch_ok boolean, answer_quality_ok boolean")
    m = corpus.quality_metrics(empty, 0, 0).first().asDict()
    assert all(m[r] == 0 for r in corpus.RATIOS) and "code_answers: none" in corpus.failed_thresholds(m)
    rows = spark.createDataFrame([("p", "assert x", "code", True, False, True)] * 3 + [(None, None, "patch", None, False, None)], empty.schema)
    m = corpus.quality_metrics(rows, 5, 1).first()
    assert (m.total, m.with_tests, m.code_answers, m.unique_ratio, m.dedup_ratio, m.answer_ast_parse_rate, m.answer_quality_rate) == (4, 3, 3, 0.8, 0.2, 1.0, 0.75)


def test_pairs_need_their_columns(spark):
    with pytest.raises(ValueError, match="rejected"):
        corpus.complete_pairs(spark.createDataFrame([("a", "b")], "prompt string, chosen string"))


def test_canonical_rows(spark):
    df = spark.createDataFrame([(1, None, " t ", None, " Src ", None), (2, "p", None, "assert a\nassert b", None, 7.5)], "id int, prompt string, text string, tests string, source string, test_quality_score double")
    one, two = rl.canonical(df, "id").orderBy("row_key").collect()
    assert (one.prompt, one.source, one.tests, one.test_quality_score) == ("t", "src", "", 0.0)
    assert (two.prompt, two.text, two.source, two.test_quality_score, two.test_assert_count) == ("p", "p", "unknown", 7.5, 2)
    assert [r.row_key for r in rl.with_tests(rl.canonical(df, "id")).collect()] == [2]


def test_stage_shares():
    assert rl.stage_shares({"core_easy": 3, "core_hard": 1, "repo_mid": 2}) == {"core_easy": 0.225, "core_hard": 0.225, "repo_mid": 0.55}
    assert rl.stage_shares({"easy": 1, "expert": 0}) == {"easy": 0.2}


def test_patch_case_without_answers(spark):
    df = spark.createDataFrame([(1, 0, 1, "no tags", "a b"), (1, 1, 1, "<answer>a b</answer>", "a b"), (2, 0, 2, "<answer>a b</answer>", "a b"), (3, 0, 1, None, "x")], "c int, o int, r int, completion string, reference string")
    out = {r.c: r for r in patches.case_results(patches.judged(df), "c", "r", "o", 1).collect()}
    assert (out[1].pass_at_1, out[1].pass_at_k, out[1].format_errors, out[1].resolve_proxy, out[1].best_patch) == (False, False, 1, 1.0, "a b")
    assert patches.case_results(patches.judged(df), "c", "r", "o", 2).where("c = 1").first().pass_at_k
    assert (out[2].pass_at_1, out[2].rounds_used, out[2].resolve_proxy) == (False, 2, 1.0) and (out[3].best_patch, out[3].resolve_proxy) == ("", 0.0)


def test_trajectory_filters(spark):
    schema = "id int, mode string, prompt string, tests string, result_code string, pass_at_1 boolean, all_passed boolean, history array<struct<error_type:string,score:double,stderr:string>>"
    tests, history = "def test_a():\n  assert edge\n  assert x", [("runtime", 0.1, "boom")]
    good = ("code", "p", tests, "c", True, None, history)
    rows = [(1, *good), (2, "patch", *good[1:]), (3, "code", "p2", tests, "c", False, None, history), (4, "code", "p", tests, "c", True, None, []), (5, "code", " ", tests, "c", True, None, history), (6, *good), (7, "code", "q", "assert x", "c", None, True, history)]
    df = spark.createDataFrame(rows, schema)
    assert [r.row_key for r in trajectories.distill(df, "id").collect()] == [1]
    assert sorted(r.row_key for r in trajectories.distill(df, "id", include_failed=True).collect()) == [1, 3]


def test_intervals_and_artifacts(spark, tmp_path):
    df = spark.createDataFrame([([1.0],), ([1.0, 2.0],), ([1.0, 2.0, 3.0, 4.0],)], "v array<double>")
    assert [tuple(r[0]) for r in df.select(cases.interval_of("v")).collect()] == [(1, 1, 1), (1, 1, 1), (1, 2, 3)]
    with pytest.raises(Exception, match="lacks a metric"):
        spark.createDataFrame([([],)], "v array<double>").select(cases.interval_of("v")).collect()
    for name in cases.ARTIFACTS[1:]:
        (tmp_path / name).write_text("{}")
    with pytest.raises(FileNotFoundError, match="run_manifest.txt"):
        cases.require_artifacts(spark, str(tmp_path))
    (tmp_path / "run_manifest.txt").write_text("")
    cases.require_artifacts(spark, str(tmp_path))
    with pytest.raises(FileNotFoundError, match="other.json"):
        cases.require_artifacts(spark, str(tmp_path), f"{tmp_path}/other.json")


def test_order_statistics_by_ranges(spark):
    from pyspark.sql import functions as F

    df = spark.range(1000).selectExpr("id % 3 AS k", "id * 7919 % 1000 AS v").unionByName(spark.createDataFrame([(None, 5), (None, 6)], "k bigint, v bigint"))
    out = {r.k: (r.a, r.b, r.n) for r in sampling.order_statistics(df, "v", {"a": F.lit(0), "b": F.floor(F.col("n") / 2)}, ["k"]).collect()}
    for k in (0, 1, 2):
        own = sorted(i * 7919 % 1000 for i in range(1000) if i % 3 == k)
        assert out[k] == (own[0], own[len(own) // 2], len(own))
    assert out[None] == (5, 6, 2)
    kept = sampling.share_cap(df.withColumn("id", F.monotonically_increasing_id()), "k", 0.1, "v", "id")
    assert sorted(r["count"] for r in kept.groupBy("k").count().collect()) == [2, 100, 100, 100]


def test_bucketed_logs_are_compared_without_a_shuffle(spark, tmp_path):
    rows = [(i, "b" + str(i % 2), "code", str(i % 40), i % 3 == 0, i % 5, 10) for i in range(200)] + [(900, None, "code", "1", True, 0, 1)]
    logs = [spark.createDataFrame([(r[0] + k, *r[1:4], r[4] ^ (k > 0), *r[5:]) for r in rows], "event_id int, benchmark string, mode string, id string, pass_at_1 boolean, format_errors int, generated_candidates int") for k in (0, 1)]
    saved = [cases.save_log(log, f"bucketed_{k}", f"file://{tmp_path}/{k}", 8) for k, log in enumerate(logs)]
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = lambda b, p, **kw: cases.align_diffs(b, p, "pass", "event_id", **kw)._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" in plan(*logs)
        for kw in ({}, {"benchmark": "b1"}):
            assert "Join" in plan(*saved, **kw) and "Exchange" not in plan(*saved, **kw)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    get = lambda b, p: sorted(map(tuple, cases.align_diffs(b, p, "pass", "event_id").collect()))
    assert get(*saved) == get(*logs) != []
    for k in (0, 1):
        spark.sql(f"DROP TABLE bucketed_{k}")
