"""State across micro-batches and restarts against plain loops."""

import random
from datetime import datetime, timedelta

from loomspark.sources.work import Work
from loomspark.streaming import state

START = datetime(2024, 1, 1)


def rows(n, seed):
    r = random.Random(seed)
    return [(i, r.choice("aab"), r.choice([1, 2]), float(r.randrange(5)), START + timedelta(hours=10 * (i // (n // 3)) + r.randrange(10), days=-20 if i % 17 == 16 else 0), i // (n // 3)) for i in range(n)]


def timely(data, delay):
    """Rows in order of arrival that aren't behind the watermark of the batches before."""
    for i, row in enumerate(data):
        before = [r[4] for r in data if r[5] < row[5]]
        if not before or row[4] > max(before) - delay:
            yield row


def run(spark, data, stream, total):
    df = spark.createDataFrame(data, "id long, k string, j int, score double, at timestamp, b int")
    return state.feed(df, "b", stream, spark, Work(spark, "state-test").held(), total)


def test_repeats_across_restarts(spark):
    data = rows(90, 1)
    got = {r.id: r.seen for r in run(spark, data, lambda s: state.repeats(s, ["k", "j"], ["id"], "at", "5 days"), 4).collect()}
    seen, want = {}, {}
    for i, k, j, *_ in timely(data, timedelta(days=5)):
        want[i] = seen.get((k, j), 0)
        seen[k, j] = want[i] + 1
    assert got == want and len(got) < len(data)


def test_forgotten_keys_start_anew(spark):
    at = lambda d: START + timedelta(days=d)
    data = [(1, "old", 1, 0.0, at(0), 0), (2, "new", 1, 0.0, at(30), 0), (3, "new", 1, 0.0, at(30), 1), (4, "old", 1, 0.0, at(30), 1)]
    day = 86_400_000
    told = run(spark, data, lambda s: state.repeats(s, ["k"], ["id"], "at", "1 day", keep_ms=2 * day), 2)
    assert {r.id: r.seen for r in told.collect()} == {1: 0, 2: 0, 3: 1, 4: 0}


def test_stagnation_across_restarts(spark):
    data = rows(60, 2)
    got = {r.id: (r.best_before, r.improved, r.stale_rounds, r.stop) for r in run(spark, data, lambda s: state.stagnation(s, ["k"], ["id"], "score", 3, "at", "5 days"), 3).collect()}
    best, stale, want = {}, {}, {}
    for i, k, _, score, *_ in timely(data, timedelta(days=5)):
        better = k not in best or score > best[k]
        stale[k] = 0 if better else stale[k] + 1
        want[i] = (best.get(k), better, stale[k], stale[k] >= 3)
        best[k] = max(score, best.get(k, score))
    assert got == want


def test_nothing_arrives(spark):
    assert run(spark, [], lambda s: state.repeats(s, ["k"], ["id"], "at", "1 day"), 1).count() == 0
