from collections import Counter

from loomspark.llm.common import Workspace
from loomspark.llm.components import components
from loomspark.llm.ngram_join import band_plan, ngram_join, op7_ngram_join

from .helpers import awkward, row, sentence, shingles, similar, table


def brute(docs):
    """(class, links) of each document by comparing all pairs."""
    sets = {d: shingles(t) for d, t in docs.items()}
    parent, links = {d: d for d in docs}, Counter()

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(docs)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if similar(sets[a], sets[b]):
                links[a] += 1
                links[b] += 1
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {d: (root(d), links[d]) for d in ids}


def test_against_all_pairs(spark, tiny):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{tiny}/documents.parquet").collect()}
    assert {r.doc_id: (r.class_id, r.n_links) for r in op7_ngram_join(spark, tiny).collect()} == brute(docs)


def test_large_groups_in_tiles(spark):
    base = sentence(3, 120).split()
    rows = [row(i, " ".join(base[:i % 90] + [f"new{i}"] + base[i % 90 + 1 :])) for i in range(90)] + [row(200 + i, sentence(3, 120)) for i in range(30)] + [row(300 + i, sentence(50 + i, 80)) for i in range(40)]
    out = ngram_join(table(spark, rows), tile=16)
    assert {r.doc_id: (r.class_id, r.n_links) for r in out.collect()} == brute({r[0]: r[1] for r in rows})
    kept = out.where("keeper").collect()
    assert sorted(r.doc_id for r in kept) == sorted({c for c, _ in brute({r[0]: r[1] for r in rows}).values()})


def test_awkward_rows(spark):
    out = ngram_join(table(spark, awkward())).collect()
    assert len(out) == len(awkward()) and all(r._uid in ("u", None) for r in out)
    by = {r.doc_id: r for r in out if r.doc_id != 6}
    assert by[7].n_links == 2 and by[7].class_id == 6 and by[1].n_links == by[2].n_links == 0 and by[2].class_id == 2
    assert sum(r.keeper for r in out if r.class_id == 6) == 1
    assert ngram_join(table(spark, [])).count() == 0


def test_bands_reach_the_recall():
    bands, rows = band_plan(0.8, 0.9995)
    assert 1 - (1 - 0.8**rows) ** bands >= 0.9995 and bands * rows <= 256


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (7, 7)] + [(200, 200 + i) for i in range(1, 50)]
    out = components(Workspace(spark, "test"), spark.createDataFrame(edges, "u bigint, v bigint"))
    want = {i: 0 for i in range(41)} | {i: 100 for i in (100, 101, 102)} | {200 + i: 200 for i in range(50)}
    assert {r.node: r.label for r in out.collect()} == want
    assert components(Workspace(spark, "test"), spark.createDataFrame([], "u bigint, v bigint")).count() == 0
