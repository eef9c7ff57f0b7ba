"""Embedding whitening against plain numpy over the whole table."""

import numpy as np
import pytest
from loomspark.llm import embedding_whitening as op


def plain(vectors):
    x = np.floor(np.array(vectors, float) * 1024).astype(np.int64) + 100_000
    n, s = len(x), x.sum(axis=0)
    c = x - s / n
    values, vecs = np.linalg.eigh(c.T @ c / n)
    values, vecs = values[::-1], vecs[:, ::-1]
    return ((n * x - s) ** 2).sum(axis=1), values / values.sum(), c @ vecs / np.sqrt(np.maximum(values, 1e-30))


def table(spark, vectors, parts=3):
    return spark.createDataFrame([(i, v, "x", 1.0) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>, component string, n double").repartition(parts)


def close(found, vectors, components):
    deviation, explained, white = plain(vectors)
    got = {(r.vec_id, r.component): r for r in found}
    assert len(got) == len(vectors) * components
    for k in range(components):
        mine = np.array([got[i, k + 1].whitened for i in range(len(vectors))])
        assert min(np.abs(mine - white[:, k]).max(), np.abs(mine + white[:, k]).max()) < 1e-9
        assert got[0, k + 1].explained == pytest.approx(explained[k], rel=1e-9)
    assert all(got[i, 1].deviation == deviation[i] for i in range(len(vectors)))
    assert got[0, 1].n == len(vectors) and got[0, 1].identity_error < 1e-9


def test_equals_numpy_on_any_partitions(spark):
    r = np.random.default_rng(1)
    vectors = (r.normal(size=(300, 12)) @ np.diag(np.linspace(3, 0.2, 12))).astype(np.float32).tolist()
    for parts in (1, 7):
        close(op.whiten(table(spark, vectors, parts)).collect(), vectors, 8)


def test_merge_is_the_moments_of_the_union():
    r = np.random.default_rng(2)
    x = r.integers(99_000, 101_000, size=(50, 4))
    parts = [op.Moments.of(p) for p in (x[:1], x[1:20], x[20:])]
    for merged in (parts[0].merge(parts[1]).merge(parts[2]), parts[2].merge(parts[0].merge(parts[1]))):
        whole = op.Moments.of(x)
        assert merged.n == 50 and (merged.sums == whole.sums).all()
        assert np.abs(merged.scatter - whole.scatter).max() < 1e-6


def test_unfit_vectors(spark):
    good = [[0.1, 0.2], [0.3, -0.2], [0.0, 0.5]]
    df = table(spark, [*good, None, [], [1.0, None], [float("nan"), 1.0], [float("inf"), 0.0], [1.0, 2.0, 3.0]])
    assert {r.vec_id for r in op.whiten(df).collect()} == {0, 1, 2}
    close(op.whiten(df).collect(), good, 2)
    assert op.whiten(table(spark, [])).count() == 0
    assert op.whiten(table(spark, [None])).count() == 0
    with pytest.raises(Exception, match="too large"):
        op.whiten(table(spark, [[2.0**41, 0.0], [0.0, 1.0]])).collect()


def test_no_variance(spark):
    rows = op.whiten(table(spark, [[1.0, 2.0]] * 4)).collect()
    assert len(rows) == 8 and all(r.whitened is None and r.identity_error is None and r.deviation == 0 for r in rows)
    line = op.whiten(table(spark, [[0.5, 1.0], [1.0, 2.0], [2.0, 4.0]])).collect()
    assert {r.component for r in line if r.whitened is None} == {2}


def test_repeated_rows_and_null_ids(spark):
    df = spark.createDataFrame([(None, [0.0, 1.0]), (1, [1.0, 0.0]), (1, [1.0, 0.0])], "vec_id long, embedding array<double>")
    rows = op.whiten(df).collect()
    assert len(rows) == 6 and {r.n for r in rows} == {3}


def test_deviation_beyond_a_long(spark, monkeypatch):
    rows = op.whiten(table(spark, [[2.0**30], [-(2.0**30)], [0.0]])).collect()
    n, x = 3, [2**40 + 100_000, -(2**40) + 100_000, 100_000]
    want = [(n * v - sum(x)) ** 2 for v in x]
    assert [r.deviation for r in sorted(rows, key=lambda r: r.vec_id)] == [w if w < 2**63 else None for w in want]
