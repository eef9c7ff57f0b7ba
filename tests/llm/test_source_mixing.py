import math
from collections import defaultdict

import pytest

from loomspark.llm.source_mixing import mix_sources, op4_source_mixing

from .helpers import awkward, multiset, row, sentence, table, words


def plain_targets(sizes: dict, weights=(5, 2, 1), share=1.5):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, out, open_ = share * sum(sizes.values()), {}, set(names)
    while open_:
        left = total - sum(out.values())
        level = left / sum(w[s] for s in open_)
        over = {s for s in open_ if level * w[s] > 2 * sizes[s]}
        if not over:
            return out | {s: level * w[s] for s in open_}
        out |= {s: 2.0 * sizes[s] for s in over}
        open_ -= over
    return out


def check(docs, found, near=0.02):
    sizes = defaultdict(int)
    for d, (t, s) in docs.items():
        sizes[s] += len(words(t))
    want, taken = plain_targets(sizes), defaultdict(int)
    for r in found:
        t, s = docs[r.doc_id]
        assert r.size == len(words(t)) and r.source_size == sizes[s] and r.target == pytest.approx(want[s])
        assert 0 <= r.taken <= 2 * r.size
        taken[s] += r.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= near * want[s] + 60


def test_query_meets_the_targets(spark, tiny):
    docs = {r.doc_id: (r.text, r.source) for r in spark.read.parquet(f"{tiny}/documents.parquet").collect()}
    out = op4_source_mixing(spark, tiny)
    assert out.count() == len(docs)
    check(docs, out.collect(), near=0.05)
    assert multiset(out.select("doc_id", "taken")) == multiset(op4_source_mixing(spark, tiny).select("doc_id", "taken"))


def test_one_size_holds_most_rows(spark):
    rows = [row(i, sentence(1, 50), "en", "hot") for i in range(6000)] + [row(10_000 + i, sentence(i, 10 + i % 200), "en", f"s{i % 4}") for i in range(800)]
    check({r[0]: (r[1], r[3]) for r in rows}, mix_sources(table(spark, rows)).collect())


def test_awkward_rows(spark):
    for keep in (False, True):
        out = mix_sources(table(spark, awkward()), keep_text=keep)
        rows = out.collect()
        assert len(rows) == len(awkward())
        assert all(r.taken == r.copies * r.size and r.copies in (0, 1, 2) for r in rows)
        assert all(r.taken == 0 for r in rows if r.size == 0)
        assert mix_sources(table(spark, []), keep_text=keep).count() == 0
    assert set(out.columns) >= {"text", "_uid", "label"}


def test_rates_against_a_plain_convex_solve(spark, tiny):
    """The tilt of each source by bisection over its documents; reruns on other partitions agree to the last bit."""
    out = op4_source_mixing(spark, tiny).collect()
    docs = {r.doc_id: r.source for r in spark.read.parquet(f"{tiny}/documents.parquet").select("doc_id", "source").collect()}
    by_source = defaultdict(list)
    for r in out:
        by_source[docs[r.doc_id]].append(r)
    for rows in by_source.values():
        mean, target = sum(r.size for r in rows) / len(rows), rows[0].target
        if target >= 2 * rows[0].source_size:
            continue
        low, high = -60.0 * mean, 60.0 * mean
        total = lambda lam: sum(r.size * min(2.0, math.exp(min(lam * r.size / mean, 1))) for r in rows)
        for _ in range(200):
            mid = (low + high) / 2
            low, high = (mid, high) if total(mid) < target else (low, mid)
        assert all(r.rate == pytest.approx(min(2.0, math.exp(min(low * r.size / mean, 1))), rel=1e-5) for r in rows if r.size)
    again = mix_sources(spark.read.parquet(f"{tiny}/documents.parquet").repartition(7)).select("doc_id", "rate", "taken")
    assert {(r.doc_id, r.rate, r.taken) for r in again.collect()} == {(r.doc_id, r.rate, r.taken) for r in out}
