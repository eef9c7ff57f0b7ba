import math
import random

import numpy as np

from loomspark.llm.quality_rules import FLOORS, TAIL, P, chi2_cdf, chi2_quantile, op9_quality_rules, quality_rules, repeated_words, text_counts

from .helpers import awkward, row, sentence, table, words


def plain(text):
    w = words(text)
    windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    covered = {j for i, x in enumerate(windows) if windows.count(x) > 1 for j in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    return {"n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": sum(c in "#*$%&|<>" for c in text or ""), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered)}


def test_counts_match_plain_python():
    rng = random.Random(3)
    texts = ["", None, "a b\nc\na b\n\n \n", "x " * 40] + ["".join(rng.choice("ab \n#\t") for _ in range(rng.randint(0, 200))) for _ in range(200)]
    found = text_counts(texts)
    for i, t in enumerate(texts):
        for c, v in plain(t).items():
            assert found[c][i] == v, (t, c)
    assert repeated_words(list("abcdefgh") * 2) == 16


def test_chi_square():
    assert abs(chi2_quantile(0.95, 6) - 12.5916) < 1e-3 and abs(chi2_cdf(12.5916, 6) - 0.95) < 1e-4


def test_query_counts_whole_texts_and_keeps_clean_ones(spark, tiny):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{tiny}/documents.parquet").collect()}
    for r in op9_quality_rules(spark, tiny).collect():
        want = plain(texts[r.doc_id])
        assert all(r[c] == v for c, v in want.items())
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert not (r.base_failed and r.kept)


def test_outliers_go_and_the_rest_stays(spark):
    rng = random.Random(1)
    rows = [row(i, " ".join("".join(rng.choice("abcdefg") for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(40, 300))), "en", "big" if i % 3 else f"small{i % 50}") for i in range(1500)]
    rows += [row(10_000 + i, sentence(i, 100).replace(" ", " ***&&& "), "en", "big") for i in range(40)]
    out = {r.doc_id: r.quality for r in quality_rules(table(spark, rows), min_cell=200).select("doc_id", "quality").collect()}
    assert not any(out[10_000 + i].kept for i in range(40))
    assert sum(out[i].kept for i in range(1500)) >= 1490


def plain_mcd(x, support=0.75, steps=60):
    """The smallest determinant of concentration steps from many random subsets, then the usual reweighting."""
    floor = np.diag(np.array(list(FLOORS.values())) ** 2)
    rng, h, best = np.random.default_rng(0), math.ceil(support * len(x)), None
    consistency = support / chi2_cdf(chi2_quantile(support, P), P + 2)
    distances = lambda m, s: np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(s), x - m)
    for _ in range(60):
        own = x[rng.choice(len(x), 4 * P, replace=False)]
        m, s = own.mean(0), np.cov(own.T, bias=True) + floor
        for _ in range(steps):
            own = x[np.argsort(distances(m, s))[:h]]
            m, s = own.mean(0), consistency * np.cov(own.T, bias=True) + floor
        if best is None or np.linalg.slogdet(s)[1] < best[0]:
            best = np.linalg.slogdet(s)[1], m, s
    cut = chi2_quantile(0.975, P)
    own = x[distances(*best[1:]) <= cut]
    m, s = own.mean(0), 0.975 / chi2_cdf(cut, P + 2) * np.cov(own.T, bias=True) + floor
    return distances(m, s)


def vectors(rows):
    share = lambda a, b: math.asin(math.sqrt(min(a / max(b, 1), 1)))
    return np.array([[math.log1p(q.n_words), math.log1p(q.word_chars / max(q.n_words, 1)), share(q.n_symbols, q.word_chars), share(q.n_repeat_words, q.n_words), share(q.n_twins, q.n_words), share(q.n_upper, q.word_chars)] for q in rows])


def test_against_a_plain_determinant_search(spark):
    """A cluster of outliers, 15 % of a cell, that medians alone would not tell apart; and a small cell."""
    rng = random.Random(4)
    text = lambda n, size, sign: " ".join("".join(rng.choice("abcdefg") for _ in range(rng.randint(2, size))) + (sign if rng.random() < 0.5 else "") for _ in range(n))
    rows = [row(i, text(rng.randint(60, 300), 8, ""), "en", "big") for i in range(510)] + [row(1000 + i, text(rng.randint(30, 40), 3, "#$"), "en", "big") for i in range(90)] + [row(2000 + i, text(rng.randint(60, 300), 8, ""), "de", "small") for i in range(60)]
    out = sorted(quality_rules(table(spark, rows)).select("doc_id", "quality").collect())
    for ids in (range(0, 1999), range(2000, 3000)):
        some = [r.quality for r in out if r.doc_id in ids]
        want = plain_mcd(vectors(some))
        assert len({q.cell for q in some}) == 1 and "own" in some[0].cell
        limit = chi2_quantile(1 - TAIL, P) * (len(some) + P) / (len(some) - P)
        agree = [q.kept == (d <= limit) for q, d in zip(some, want)]
        assert sum(agree) >= 0.99 * len(some)
    assert not any(r.quality.kept for r in out if 1000 <= r.doc_id < 2000)


def test_awkward_rows(spark):
    out = quality_rules(table(spark, awkward()))
    rows = out.collect()
    assert len(rows) == len(awkward()) and "x0" in out.columns and all(r.x0 in (0.5, None) for r in rows)
    assert quality_rules(table(spark, [])).count() == 0
