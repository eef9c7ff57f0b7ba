from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from loomspark.llm import ann_forest
from loomspark.llm.ann_forest import nearest, op1_ann_forest


def brute(rows, k, is_query):
    rows = [(i, np.array(x, float)) for i, x in rows]
    out = {}
    for q, x in rows:
        if is_query(q):
            out[q] = sorted(((-float(x @ y), i) for i, y in rows if i != q))[:k]
    return out


def test_recall_and_order(spark, tiny):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{tiny}/embeddings.parquet").collect()]
    want = brute(rows, 20, lambda i: i % 20 == 0)
    found = defaultdict(list)
    for r in op1_ann_forest(spark, tiny).orderBy("query_id", "rank").collect():
        found[r.query_id].append(r)
    x = {i: np.array(v, float) for i, v in rows}
    assert set(found) == set(want)
    hits = 0
    for q, got in found.items():
        assert [r["rank"] for r in got] == list(range(1, 21))
        assert [(-r.score, r.vec_id) for r in got] == sorted((-r.score, r.vec_id) for r in got)
        assert all(abs(r.score - float(x[q] @ x[r.vec_id])) < 1e-9 for r in got)
        hits += len({r.vec_id for r in got} & {i for _, i in want[q]})
    assert hits / (20 * len(want)) >= 0.9


def test_copies_ties_and_bad_vectors(spark):
    rng = np.random.default_rng(3)
    same = [1.0, 0.0, 0.0, 0.0]
    rows = [(i, same) for i in range(60)] + [(100 + i, rng.standard_normal(4).tolist()) for i in range(40)]
    bad = [(200, None), (201, []), (202, [0.0] * 4), (203, [1.0, None, 0.0, 0.0]), (204, [float("nan")] * 4), (205, [float("inf"), 0.0, 0.0, 0.0]), (206, [1.0, 2.0]), (None, same)]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows + bad], "vec_id bigint, embedding array<double>, score string")
    found = defaultdict(list)
    for r in nearest(df, F.col("vec_id") % 10 == 0, 20, recall=1.0, leaf_rows=8).orderBy("query_id", "rank").collect():
        found[r.query_id].append((round(-r.score, 9), r.vec_id))
    assert found == {q: [(round(s, 9), i) for s, i in v] for q, v in brute(rows, 20, lambda i: i % 10 == 0).items()}
    assert nearest(df.limit(0), F.col("vec_id") % 10 == 0, 20).count() == 0
    few = spark.createDataFrame([(0, [1.0, 2.0]), (1, [2.0, 1.0])], "vec_id bigint, embedding array<double>")
    assert [(r.query_id, r.vec_id) for r in nearest(few, F.col("vec_id") == 0, 20).collect()] == [(0, 1)]


def found_share(spark, ids, x, **options):
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], "vec_id bigint, embedding array<double>")
    got = defaultdict(set)
    for r in nearest(df, F.col("vec_id") % 20 == 0, 20, **options).collect():
        got[r.query_id].add(r.vec_id)
    hits = n = 0
    for q in np.flatnonzero(ids % 20 == 0)[::7]:
        scores = x @ x[q]
        scores[q] = -np.inf
        hits += len(got[ids[q]] & set(ids[np.argpartition(-scores, 20)[:20]].tolist()))
        n += 20
    return hits / n


def test_recall_on_other_shapes(spark):
    """Vectors without structure, in clusters, and of very different norms."""
    rng = np.random.default_rng(8)
    ids = np.arange(6000)
    loose = rng.standard_normal((6000, 24))
    assert found_share(spark, ids, loose) >= 0.9
    centres = rng.standard_normal((60, 24)) * 3
    assert found_share(spark, ids, centres[rng.integers(0, 60, 6000)] + 0.4 * rng.standard_normal((6000, 24))) >= 0.9
    assert found_share(spark, ids, loose * np.exp(rng.standard_normal((6000, 1)))) >= 0.9


def test_recall_of_a_larger_table(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    assert found_share(spark, ids, x) >= 0.9


def test_hot_boughs_are_dealt(spark, monkeypatch):
    """Boughs beyond the bound of rows and queries go to several tasks; the result stays."""
    rng = np.random.default_rng(9)
    x = rng.standard_normal((900, 8))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    want = sorted(map(tuple, nearest(df, F.col("vec_id") % 5 == 0, 5).collect()))
    monkeypatch.setattr(ann_forest, "ROWS", 100)
    monkeypatch.setattr(ann_forest, "QUERIES", 30)
    assert sorted(map(tuple, nearest(df, F.col("vec_id") % 5 == 0, 5).collect())) == want
