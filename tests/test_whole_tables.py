"""Queries whose SQL takes whole tables, on tables larger than the operators' default limits; and queries found failing or slow."""

import random
import time
import tracemalloc

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import GroupedData
from pyspark.sql import functions as F

import __spark_entry__  # noqa: F401  registers all catalogues
from loomspark.functions import text as X
from loomspark.operators import prm, retrieval, sampling, verify
from loomspark.operators.posting_index import PostingIndex
from loomspark.plans.catalog import ORACLES, QUERIES
from loomspark.sources.work import Work


def documents(spark, folder, n: int, source: str) -> str:
    """n short documents of one source, each with a patch for an answer."""
    i = F.col("doc_id")
    rows = spark.range(n).withColumnRenamed("id", "doc_id")
    rows = rows.select("doc_id", F.concat(F.lit("text "), i.cast("string")).alias("text"), F.lit("en").alias("lang"), F.lit(source).alias("source"), (3 * i + 1).cast("int").alias("n_chars"))
    rows.coalesce(4).write.parquet(f"file://{folder}/documents.parquet")
    return f"file://{folder}"


def by_sql(folder: str, name: str, columns: list[str]) -> list[tuple]:
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder.removeprefix('file://')}/documents.parquet/*.parquet'")
    return sorted(con.sql(f"SELECT {', '.join(f'"{c}"' for c in columns)} FROM ({ORACLES[name]})").fetchall())


@pytest.mark.parametrize("name,n,source", [("corpus_build", 27_000, "src1"), ("corpus_metrics", 27_000, "src1"), ("repository_set", 128_000, "src2")])
def test_no_row_beyond_a_default_limit_is_lost(spark, tmp_path, name, n, source):
    d = documents(spark, tmp_path, n, source)
    columns = {"corpus_build": ["row_key", "split", "digest"], "corpus_metrics": ["at", "total", "before_dedup", "removed"], "repository_set": ["row_key", "split"]}[name]
    found = sorted(tuple(r) for r in QUERIES[name](spark, d).select(*columns).collect())
    assert found == by_sql(d, name, columns)
    if name != "corpus_metrics":
        assert len(found) > (120_000 if name == "repository_set" else 25_000)


def test_source_heads(spark, tiny):
    found = QUERIES["source_heads"](spark, tiny).groupBy("source").count().collect()
    assert found and max(r["count"] for r in found) <= 10


def test_copies_of_a_program_run_once(spark):
    code = "def f(x):\n    return x"
    rows = spark.createDataFrame([(i, code if i % 3 else code.replace("x", "y"), "assert f(1) == 1") for i in range(600)] + [(600, None, None)], "k int, c string, t string")
    found = verify.run_verifier(rows, "k", "c", "t", rounds=2, allow_execution=True)
    runs = found.select("k", "round", "score", "assert_passed", "exec_time").collect()
    assert {(r.k, r.round) for r in runs} == {(str(i), r) for i in range(601) for r in (0, 1)}
    assert all(r.score == 2.0 for r in runs) and all(r.assert_passed == (r.k != "600") for r in runs)
    assert len({r.exec_time for r in runs}) <= 3 * 2  # three programs, two seeds


def test_training_gathers_no_group(spark, monkeypatch):
    def refused(*_):
        raise AssertionError("all rows in one table")

    monkeypatch.setattr(GroupedData, "applyInArrow", refused)
    df = spark.createDataFrame([(i, "good answer" if i % 2 else "bad reply", i % 2) for i in range(300)], "i int, t string, y int")
    found = {r.bucket: r.weight for r in prm.train(df.repartition(5), "t", "y", "i", 256).collect()}
    assert -1 in found and len(found) > 2
    assert prm.train(df.where("false"), "t", "y", "i", 256).count() == 0


def test_a_pass_works_on_few_rows_at_once():
    x = np.stack((np.arange(200), np.ones(200))).astype(np.int32).tobytes()
    batch = pa.RecordBatch.from_arrays([pa.array([1] * 10_000, pa.int32()), pa.array([x] * 10_000, pa.binary())], ["y", "x"])
    tracemalloc.start()
    n, _, gradient, _ = prm.loss_and_gradient([batch], np.zeros(257))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 10_000 and gradient[-1] == pytest.approx(-5_000) and most < 20 << 20


def test_numbers_need_one_shuffle(spark):
    df = spark.range(5_000).select("id", (F.col("id") % 3).alias("k"), F.sha2(F.col("id").cast("string").cast("binary"), 256).alias("h"))
    for by in (None, "k"):
        found = sampling.numbered(df, ["h"], by)
        # rows themselves pass no window and no second sort: only the totals do
        assert found._jdf.queryExecution().optimizedPlan().toString().count("row_number") == 0
        rows = found.collect()
        for key in {getattr(r, by) for r in rows} if by else {None}:
            own = sorted((r.idx, r.h) for r in rows if by is None or r.k == key)
            assert [i for i, _ in own] == list(range(len(own))) and [h for _, h in own] == sorted(h for _, h in own)


def test_queries_and_documents_meet_in_small_steps(spark):
    assert [retrieval.documents_at_once(n) for n in (0, 200, 8_000_000)] == [256, 256, 1]
    docs = spark.createDataFrame([(i, f"src/p{i % 3}", " ".join(f"word{(i * j) % 97}" for j in range(1, 60))) for i in range(700)], "i long, p string, b string")
    asked = spark.createDataFrame([(q, f"word{q} word{q + 1} p1 Name_x") for q in range(40)], "q long, t string")
    found = retrieval.retrieve(retrieval.index(docs, "i", "p", "b"), asked, "q", "t", 5)
    kept = PostingIndex(spark, Work(spark, "small-steps").held(), buckets=4)
    kept.refresh(docs.withColumn("s", F.xxhash64("b")), "i", "p", "b", "s")
    rows = lambda df: sorted((r["query"], r["rank"], r["doc"], round(r["score"], 6)) for r in df.collect())
    assert rows(found) == rows(kept.search(asked, "q", "t", 5)) and len(rows(found)) == 200


def test_blanks_inside_a_text_cost_no_time(spark):
    """An expression tried every blank of a run: 200,000 in a row took some 10^10 steps."""
    run = "a" + " " * 200_000 + "b"
    began = time.perf_counter()
    row = spark.createDataFrame([(f" {run} \n",)], "t string").select(X.strip("t").alias("s"), X.not_blank("t").alias("b")).first()
    assert row.s == run and row.b and time.perf_counter() - began < 20


def test_text_expressions_say_what_they_said(spark):
    """strip, answers and normal forms against the expressions that define them, on odd signs, tags and blanks."""
    rng, parts = random.Random(5), [*X.SPACES, "\x1c", "\x00", "​", "é", "Ω", "İ", "K", "中文", "😀", "<answer>", "</answer>", "<ANSWER>", "<answer", "</", "|", "a_Z", "09", "!\"#.;:=?@[\\]^`{}~\x7f", "x y"]
    texts = [None, "", *X.SPACES, *("".join(rng.choices(parts, k=rng.randrange(1, 12))) for _ in range(3000))]
    c = F.coalesce("t", F.lit(""))
    old_strip = lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")
    old_normal = F.regexp_replace(old_strip(F.regexp_replace(F.lower(c), r"(?U)\s+", " ")), r"[^a-z0-9_<>/| ]", "")
    old_answer = old_strip(F.regexp_extract(c, r"(?s)<answer>\s*(.*?)\s*</answer>", 1))
    pairs = {"strip": (X.strip("t"), old_strip(F.col("t"))), "answer": (X.answer_of("t"), old_answer), "normal": (X.normalise_for_dedup("t"), old_normal)}
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for name, (new, old) in pairs.items():
        apart = df.select("t", new.alias("new"), old.alias("old")).where("NOT new <=> old").collect()
        assert not apart, (name, apart[:3])


def test_corpus_writes_texts_twice(spark, tmp_path, monkeypatch):
    """Records are written as they come and once after dedup, and patches aren't parsed as Python."""
    saved = []
    monkeypatch.setattr(Work, "save", lambda self, df, name, save=Work.save: saved.append(name) or save(self, df, name))
    found = QUERIES["corpus_metrics"](spark, documents(spark, tmp_path, 300, "src1")).where("at = 'after'").first()
    assert saved == ["formatted", "first"] and found["patch_answers"] == found["total"] > 0
