"""Secret scans against plain regular expressions and plain statistics."""

import hashlib
import math
import random
import re

import pytest
from loomspark.llm import secret_scan as op

from .helpers import awkward, table

KINDS = [
    ("assign", re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII), lambda m: len(m[2]) >= 8),
    ("access", re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 16),
    ("hex", re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 32),
]
LETTERS = op.UPPER + op.LOWER + op.DIGITS


def plain(text):
    spans = sorted((m.start(), k, m.end(), name) for k, (name, p, good) in enumerate(KINDS) for m in p.finditer(text or "") if good(m))
    return [f"{name}:{a}:{b}" for a, _, b, name in spans]


def upper(z):
    return 0.5 * math.erfc(z / math.sqrt(2))


def plain_step(hit, moments):
    """Class and step of one candidate, by the definitions."""
    body = hit.rstrip("=")
    fits = [k for k, (_, p, _) in enumerate(op.ENCODINGS) if re.fullmatch(p, body)]
    if body.isdigit() or not fits:
        return None
    code, alphabet = fits[0], op.ENCODINGS[fits[0]][2]
    x, n, k = [alphabet.index(c) for c in body], len(body), len(alphabet)
    chi = sum(x.count(v) ** 2 for v in set(x)) * k / n - n
    even = ((chi / (k - 1)) ** (1 / 3) - (1 - 2 / (9 * (k - 1)))) / math.sqrt(2 / (9 * (k - 1)))
    above = [2 * v >= k for v in x]
    pairs = 2 * sum(above) * (n - sum(above))
    runs = 1 + sum(a != b for a, b in zip(above, above[1:]))
    z_runs = 1e3 if pairs <= n else abs(runs - 1 - pairs / n) / math.sqrt(pairs * (pairs - n) / (n * n * (n - 1)))
    s1, s2, s12 = sum(x), sum(v * v for v in x), sum(a * b for a, b in zip(x, x[1:] + x[:1]))
    z_serial = 1e3 if n * s2 == s1 * s1 else abs((n * s12 - s1 * s1) / (n * s2 - s1 * s1) + 1 / (n - 1)) * (n - 1) / math.sqrt(n * (n - 3) / (n + 1))
    q2, q3 = moments[code]
    var = (k / n) ** 2 * 2 * n * (n - 1) * (q2 + 2 * (n - 2) * q3 - (2 * n - 3) * q2 * q2)
    z_text = (chi - (k * (1 + (n - 1) * q2) - n)) / math.sqrt(max(var, 1e-9))
    ok = 3 * min(upper(even), 2 * upper(z_runs), 2 * upper(z_serial)) >= op.RANDOM
    return code * 64 + int(math.log2(n)), int(max(0, -op.STEPS * math.log10(max(upper(-z_text), 1e-300)))) if ok else -1


def test_base_spans_and_edges(spark):
    texts = [
        'Token = "abcdefgh" x', "password:1234567 no", "secret: api_key: abcdefghij", "PASSWD='a.b/c+d=e'", "AKIAABCDEFGHIJKL and AKIAAKIAABCDEFG", "x" + "0" * 31 + "g" + "0" * 32,
        "日本 token=12345678 é" + "ab" * 16, "api-key=abcdefghij", "token=token=abcdefgh", "ApI_kEy\"  =  'zzzzzzzz'", "ſecret=abcdefgh",
    ]
    rows = [*awkward(), *[(100 + i, t, "en", "s", 1, "o", "u", 1, "s", 0.1, "w") for i, t in enumerate(texts)]]
    found = op.scan_secrets(table(spark, rows)).select("doc_id", op.listed("base_spans").alias("base"), op.listed("spans").alias("spans"), "n_assign", "n_access", "n_hex").collect()
    assert len(found) == len(rows)
    assert sorted((r.doc_id or -1, r.base) for r in found) == sorted((r[0] or -1, ",".join(plain(r[1]))) for r in rows)
    by_id = {r.doc_id: r for r in found}
    assert by_id[2].base == by_id[1].base == ""
    assert (by_id[104].n_access, by_id[105].n_hex, by_id[102].n_assign) == (1, 1, 0)
    assert op.scan_secrets(table(spark, [])).count() == 0


def test_many_matches_stay_in_place(spark):
    text = " ".join(f"token={i:08d} {'é' * (i % 3)}" for i in range(3000))
    row = op.scan_secrets(spark.createDataFrame([(1, text)], "doc_id long, text string")).select(op.listed("spans")).first()
    assert row[0].split(",") == plain(text)


def test_steps_equal_plain_statistics(spark):
    r = random.Random(5)
    hits = ["".join(r.choice(a) for _ in range(n)) for _, _, a in op.ENCODINGS for n in (20, 31, 32, 64, 300)]
    hits += ["internationalization_of_the_thing", "a" * 40, "ab" * 20, "1234567890" * 4, "thequickbrownfoxjumpsoverthelazydog", "AbC+/xyz-_AbC+/xyz-_AbC", "QUJDREVGR0hJSktMTU5PUFFSU1Q=="]
    counts = {c: 1 + 40 * (c in "etaoinshr") + 10 * c.islower() for c in LETTERS + "+/-_"}
    moments = op.pair_moments(counts)
    df = spark.createDataFrame([(i, h) for i, h in enumerate(hits)], "i int, h string")
    got = {row.i: (row.c[0]["class"], row.c[0]["step"]) if row.c else None for row in df.selectExpr("i", "array(struct(0 AS start, length(h) AS stop, h AS hit)) AS cands").select("i", op.tested("cands", moments).alias("c")).collect()}
    for i, h in enumerate(hits):
        want = plain_step(h, moments)
        assert (got[i] is None) == (want is None), h
        if want:
            assert got[i][0] == want[0] and abs(got[i][1] - want[1]) <= 1, (h, got[i], want)


def test_thresholds_are_benjamini_hochberg(spark):
    r = random.Random(3)
    steps = [(c, r.choice([-1, 0, 3, 20, 41, 60, 90, 200])) for c in (1, 2, 3) for _ in range(50 * c)] + [(4, 5)]
    got = op.thresholds(spark.createDataFrame(steps, "class int, step int"))
    for c in (1, 2, 3, 4):
        ps = sorted(10 ** (-s / op.STEPS) if s >= 0 else 2.0 for k, s in steps if k == c)
        best = max((p for i, p in enumerate(ps, 1) if p <= op.FDR * sum(q <= p for q in ps) / len(ps)), default=None)
        want = None if best is None else round(-math.log10(best) * op.STEPS)
        assert got.get(c) == want


def test_finds_planted_and_leaves_prose(spark):
    r = random.Random(11)
    words = ["the", "and", "einheit", "lichkeit", "tion", "menteado", "ouverture", "reading", "while", "over"]
    rows, planted = [], {}
    for i in range(400):
        text = " ".join(r.choice(words) for _ in range(60)) + " " + "".join(r.choice(words) for _ in range(6)) + " some_long_identifier_in_code/and/paths/too "
        if i % 2 == 0:
            key = "".join(r.choice(LETTERS + "+/") for _ in range(64))
            planted[i] = (len(text), len(text) + 64)
            text += key + " ende"
        rows.append((i, text))
    found = op.scan_secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    hits = {(x.doc_id, s.start, s.stop) for x in found for s in x.spans if s.kind == "random"}
    want = {(i, *s) for i, s in planted.items()}
    assert len(hits & want) >= 0.95 * len(want)
    assert len(hits - want) <= 0.02 * len(rows)


def test_registered_query(spark, tiny):
    rows = op.op13_secret_scan(spark, tiny).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{tiny}/documents.parquet").collect()}
    assert len(rows) == len(texts)
    for r in rows:
        assert r.base_sha256 == hashlib.sha256(",".join(plain(texts[r.doc_id])).encode()).hexdigest()


@pytest.mark.parametrize("z", [-5.0, -1.0, 0.0, 0.5, 2.0, 6.0])
def test_normal_tail(spark, z):
    assert spark.sql(f"SELECT {op.log_upper(f'({z}D)')} AS p").first().p == pytest.approx(math.log(upper(z)), rel=1e-5, abs=1e-6)
