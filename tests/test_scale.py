"""Operators that replace work on single tasks, against plain versions: row numbers, counted resampling, the logistic fit."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from loomspark.operators import prm, resampling, sampling, stats
from pyspark.sql import functions as F


def test_numbered_equals_sorting(spark):
    r = random.Random(1)
    rows = [(r.choice(["hot"] * 8 + ["a", "b", None]), r.random()) for _ in range(3000)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(7)
    got = {x.v: x.idx for x in sampling.numbered(df, ["v"]).collect()}
    assert got == {v: i for i, v in enumerate(sorted(v for _, v in rows))}
    own = {}
    for k in {k for k, _ in rows}:
        own |= {v: i for i, v in enumerate(sorted(v for q, v in rows if q == k))}
    assert {x.v: x.idx for x in sampling.numbered(df, ["v"], "k").collect()} == own
    assert sampling.numbered(df.where("false"), ["v"]).count() == 0


@pytest.mark.parametrize(("n", "p"), [(1, 0.3), (7, 0.5), (60, 0.07), (5000, 0.42), (2_000_000, 1e-4), (10**9, 0.25)])
def test_binomial_is_the_inverse_distribution(n, p):
    u = np.linspace(0.0005, 0.9995, 400)
    k = resampling.binomial(np.full(400, n), p, u)
    if n <= 5000:
        pmf = [math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)) for i in range(n + 1)]
        chance = np.cumsum(pmf)
        assert (k == np.minimum(np.searchsorted(chance, u), n)).all()
    assert k.mean() == pytest.approx(n * p, rel=0.02, abs=0.2)
    assert k.std() == pytest.approx(math.sqrt(n * p * (1 - p)), rel=0.05, abs=0.2)
    mixed = np.array([n, max(1, n // 3)] * 10)
    assert (resampling.binomial(mixed, p, np.linspace(0.1, 0.9, 20))[::2] == resampling.binomial(np.full(10, n), p, np.linspace(0.1, 0.9, 20)[::2])).all()


def test_draws_are_multinomial_and_whole(monkeypatch):
    counts, samples = np.array([5, 0, 100, 30, 1, 64, 300]), 4000
    draws = dict(resampling.value_draws(counts, resampling.block_draws(np.array([500]), 0, 8, samples, 1, "g|"), 0, 8, 1, "g|"))
    whole = np.array([draws.get(i, np.zeros(samples)) for i in range(7)])
    assert (whole.sum(axis=0) == 500).all() and not whole[1].any()
    assert np.abs(whole.mean(axis=1) - counts).max() < 0.6
    expected = np.diag(counts) - np.outer(counts, counts) / 500
    assert np.abs(np.cov(whole) - expected).max() < 0.08 * expected.max()
    # blocks of another size draw the same
    cut = {}
    for block in range(4):
        part = counts[2 * block : 2 * block + 2]
        here = resampling.block_draws(np.array([5, 130, 65, 300]), block, 2, samples, 1, "g|")
        cut |= {2 * block + i: d for i, d in resampling.value_draws(part, here, block, 2, 1, "g|")}
    assert set(cut) == set(draws) and all((cut[i] == draws[i]).all() for i in cut)


def test_intervals_are_those_of_drawing_rows(spark, monkeypatch):
    monkeypatch.setattr(resampling, "BLOCK", 4)  # many blocks
    r = np.random.default_rng(3)
    values = np.round(r.gamma(2.0, 1.0, 600), 2).tolist()
    df = spark.createDataFrame([(("a", "b")[i % 2], v) for i, v in enumerate(values)] + [("one", 2.5), ("a", None)], "grp string, value double")
    found = {x.grp: x for x in stats.bootstrap_ci(df.repartition(5), 600, "grp").collect()}
    again = {x.grp: x for x in stats.bootstrap_ci(df.repartition(2), 600, "grp").collect()}
    for i, g in enumerate("ab"):
        mine = np.array(values[i::2])
        means = np.sort([r.choice(mine, len(mine)).mean() for _ in range(600)])
        assert found[g].n == len(mine) and found[g]["mean"] == pytest.approx(mine.mean())
        for end, at in (("low", int(0.025 * 599)), ("high", int(0.975 * 599))):
            assert found[g][end] == pytest.approx(means[at], abs=0.25 * mine.std() / math.sqrt(len(mine)) * 2)
            assert found[g][end] == pytest.approx(again[g][end], rel=1e-12)
    assert found["one"].low == found["one"].high == 2.5


def test_signs(spark):
    diffs = [0.0] * 40 + [1.0] * 30 + [-1.0] * 12 + [0.5] * 9
    df = spark.createDataFrame([("agentic_success", d) for d in diffs], "component string, diff double")
    p = stats.sign_flip(df, {"agentic_success": 1.0}, 2000).first().p_value
    r = np.random.default_rng(1)
    null = (r.choice([-1, 1], (20_000, len(diffs))) * np.array(diffs)).mean(axis=1)
    assert p == pytest.approx((null >= np.mean(diffs)).mean(), abs=0.01)


def plain_fit(rows, buckets, l2):
    """Newton's method on the whole matrix, a row's features being its tokens' shares."""
    x, y = np.zeros((len(rows), buckets + 1)), np.array([t for _, t in rows]) > 0
    x[:, -1] = 1
    for i, (found, _) in enumerate(rows):
        for b, c in Counter(found).items():
            x[i, b] = c / len(found)
    pen, w = np.append(np.full(buckets, l2), 0.0), np.zeros(buckets + 1)
    loss = lambda w: np.logaddexp(0, np.where(y, -1, 1) * (x @ w)).mean() + 0.5 * pen @ w**2
    for _ in range(60):
        q = 1 / (1 + np.exp(-(x @ w)))
        step = np.linalg.solve(x.T @ (x * (q * (1 - q))[:, None]) / len(x) + np.diag(pen) + 1e-12 * np.eye(buckets + 1), x.T @ (q - y) / len(x) + pen * w)
        t = 1.0
        while loss(w - t * step) > loss(w) and t > 1e-9:
            t /= 2
        w = w - t * step
    return loss(w), x @ w


def test_logistic_fit_reaches_the_optimum(spark):
    r = random.Random(2)
    words = [f"word{i}" for i in range(60)]
    rows = []
    for i in range(240):
        good = r.random() < 0.5
        text = " ".join(r.choice(words[:35] if good else words[25:]) for _ in range(r.randrange(3, 40)))
        rows.append((i, text, int(good if r.random() < 0.95 else not good)))
    rows += [(1000, "", 1), (1001, None, 0), (1002, "word1 word2", None)]
    df = spark.createDataFrame(rows, "id int, text string, y int")
    found = {i: prm.fit_logistic(df.repartition(parts), "text", "y", 256, l2=1e-4) for i, parts in enumerate((1, 5))}
    tokens = dict(df.select("id", prm.features(F.coalesce("text", F.lit("")), 256).alias("t")).collect())
    best, z = plain_fit([(tokens[i], y) for i, _, y in rows if y is not None], 256, 1e-4)
    assert all(m.loss == pytest.approx(best, abs=1e-6) for m in found.values())
    model = found[0]
    scores = dict(prm.predict(df.where("id < 240"), "id", "text", model.frame(spark), model.bias, 256, mean=True).collect())
    assert max(abs(scores[i] - 1 / (1 + math.exp(-z[i]))) for i in range(240)) < 0.01
    # texts are ranked as by the exact trainer
    exact = prm.train(df.where("y IS NOT NULL"), "text", "y", "id", 256).collect()
    bias = next(x.weight for x in exact if x.bucket == -1)
    trained = dict(prm.predict(df.where("id < 240"), "id", "text", spark.createDataFrame([tuple(x) for x in exact if x.bucket >= 0], "bucket int, weight double"), bias, 256).collect())
    ranks = lambda s: np.argsort(np.argsort([s[i] for i in range(240)]))
    assert np.corrcoef(ranks(scores), ranks(trained))[0, 1] > 0.8  # sums outweigh means in long texts
    with pytest.raises(ValueError, match="no labelled rows"):
        prm.fit_logistic(df.where("false"), "text", "y", 256)
