import zlib

import numpy as np

from loomspark.llm.quality_classifier import fit, op6_quality_classifier, score_quality
from loomspark.llm.toxicity import PRIOR, Automaton, Scorer, ToxicityModel, op3_toxicity, quotations, score_toxicity, train_toxicity

from .helpers import awkward, table


def distance(a, b):
    """Edits with swaps of neighbours."""
    d = {(i, 0): i for i in range(len(a) + 1)} | {(0, j): j for j in range(len(b) + 1)}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


def test_automaton_finds_words_within_an_edit():
    stems = {"idiot": 1.0, "moron": 1.0, "scum": 1.0}
    a = Automaton(stems)
    for word, stem, edits in (("idiot", "idiot", 0), ("idiots", "idiot", 0), ("idoit", "idiot", 1), ("idio", "idiot", 1), ("idiiot", "idiot", 1), ("morom", "moron", 1), ("scum", "scum", 0)):
        assert a.match(word)[:2] == (stem, edits), word
    for word in ("table", "scam", "i", "", "mood", "dition"):
        assert a.match(word) is None, word
    letters = "idotmrn"
    rng = np.random.default_rng(0)
    for _ in range(3000):
        word = "".join(rng.choice(list(letters), rng.integers(1, 8)))
        found = a.match(word)
        ends = min(distance(word[:i], s) for s in stems for i in range(len(word) + 1) if word and word[:1] == s[:1])if any(word[:1] == s[:1] for s in stems) else 9
        if found and found[1] == 0:
            assert word.startswith(found[0])
        elif found:
            assert ends <= 1
        if any(word.startswith(s) for s in stems):
            assert found and found[1] == 0


def test_quotation_weighs_less_than_abuse():
    s = Scorer(ToxicityModel({"idiot": 1.0}))
    quoted, plain, abuse = (s.hits(t)[0][3] for t in ('they said "idiot" in the report', "a table of idiot words", "you are an idiot"))
    assert quoted < plain < abuse


def test_quotation_spans():
    assert quotations('a "b c" d'.split()) == [False, True, True, False]
    assert quotations("you’re such a moron, don’t".split()) == [False] * 5
    assert quotations("« un deux » trois “x” y".split()) == [True, True, True, True, False, True, False]
    assert quotations('he said "never closed at all'.split()) == [False] * 6
    assert quotations(("“x, y.” (z) " + '"' + "w " * 200 + '"').split())[:3] == [True, True, False]
    s = Scorer(ToxicityModel({"moron": 1.0}))
    assert s.found("you’re such a moron, don’t")[0][3] == (0, 0, 0) and s.found("you are «a moron»")[0][3] == (1, 0, 1)


def test_letters_set_apart():
    s = Scorer(ToxicityModel({"idiot": 1.0, "scum": 1.0}))
    for word in ("i-d-i-o-t", "i.d.i.o.t!", "s_c_u_m", "$-c-u-m", "total-idiot", "i*d*i*o*t"):
        assert [h[1] for h in s.hits(f"a {word} here")] == [0], word
    for text in ("a-b-c-d-e-f", "e.g. u.s.a. and so on", "well-known"):
        assert s.hits(text) == [], text


def test_contexts_are_learned(spark):
    """Words of reporting stand beside the term in toxic texts only, so they don't excuse it; quotations keep their prior."""
    rows = [(i, f"the word was scumbag again {i}", 1) for i in range(80)] + [(100 + i, f"what a scumbag that is {i}", 1) for i in range(20)] + [(1000 + i, f"a quiet day {i}", 0) for i in range(200)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id bigint, toxic int")
    model = train_toxicity(docs, labels, "text", "doc_id", "toxic", 1000)
    assert any("scumbag".startswith(s) for s in model.stems)
    assert PRIOR[0, 1, 0] < 0.85 < model.contexts[0, 1, 0] and model.contexts[1, 0, 0] == PRIOR[1, 0, 0]


def held(doc_id, mod, rest):
    return zlib.crc32(str(doc_id).encode()) % mod == rest


def accuracy(spark, tiny, out, label, mod, rest, cut):
    labels = {r.doc_id: r[label] for r in spark.read.parquet(f"{tiny}/labels.parquet").collect()}
    rows = out.collect()
    assert len(rows) == spark.read.parquet(f"{tiny}/documents.parquet").count()
    for r in rows:
        assert r.held_out == held(r.doc_id, mod, rest) and 0 <= r.score <= 1 and r.predicted == int(r.score >= cut)
    tested = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and labels.get(r.doc_id) is not None]
    return np.mean([p == y for p, y in tested])


def test_held_out_quality(spark):
    assert accuracy(spark, "/root/testdata/sf0.01", op6_quality_classifier(spark, "/root/testdata/sf0.01"), "quality", 4, 2, 0.7) >= 0.95


def test_held_out_toxicity(spark):
    # some 320 labels teach little; ten times as many teach enough
    for d, least in (("/root/testdata/sf0.01", 0.9), ("/root/testdata/sf0.1", 0.97)):
        assert accuracy(spark, d, op3_toxicity(spark, d), "toxic", 5, 0, 0.5) >= least


def test_awkward_rows_and_poor_labels(spark):
    docs = table(spark, awkward())
    for score, column in ((score_quality, "quality"), (score_toxicity, "toxic")):
        for rows in ([], [(1, None), (None, 1)], [(6, 1)], [(6, 1), (8, 0), (6, 0)]):
            labels = spark.createDataFrame(rows, f"doc_id bigint, {column} int")
            out = score(docs, labels, score="likely").collect()
            assert len(out) == len(awkward()) and all(0 <= r.likely <= 1 for r in out)
        assert score(table(spark, []), labels).count() == 0


def test_hinge_separates():
    rng = np.random.default_rng(1)
    rows = [np.unique(np.concatenate((rng.integers(100, 4000, 30), [y * 7 + 1]))).astype(np.int32) for y in (0, 1) * 200]
    labels = np.array([0, 1] * 200)
    model = fit(rows, labels, bits=12)
    flat, offsets = np.concatenate(rows), np.concatenate(([0], np.cumsum([len(r) for r in rows])))
    assert ((model.scores(flat, offsets) > 0.5) == labels).mean() > 0.99


def test_edits_anywhere_against_true_distance():
    stems = ["idiot", "moron", "scum"]
    a = Automaton(dict.fromkeys(stems, 1.0), anywhere=True)
    rng = np.random.default_rng(2)
    letters = list("idotmrnscux")
    planted = ["xdiot", "diot", "xidiot", "dioit", "scam", "cum", "scm", "xcum", "csum", "oron"]
    for word in planted + ["".join(rng.choice(letters, rng.integers(1, 8))) for _ in range(4000)]:
        near = min(distance(word[:i], s) for s in stems for i in range(len(word) + 1))
        found = a.match(word)
        assert (found[1] if found else 2) == min(near, 2), word


def test_masked_first_letters_are_hits():
    s = Scorer(ToxicityModel({"abcde": 1.0, "idiot": 1.0, "scum": 1.0}))
    for word, stem, edits in (("@bcde", "abcde", 0), ("!diot", "idiot", 0), ("$cum", "scum", 0), ("@idiot", "idiot", 0), ("*diot", "idiot", 1), ("scxm", "scum", 1), ("xdiots", "idiot", 1)):
        assert [h[:2] for h in s.hits(f"a {word} here")] == [(stem, edits)], word
