"""Small tables with awkward rows, and plain Python versions of what the operators compute."""

import re
from collections import Counter

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, size string, _uid string, label int, score string, x0 double, n_words string"


def words(text):
    return WORDS.findall(text or "")


def row(i, text, lang="en", source="s1"):
    return (i, text, lang, source, len(text) if text is not None else None, "other", "u", 1, "s", 0.5, "w")


def sentence(i, n=60):
    return " ".join(f"w{(i * 131 + k * k * 7 + k) % 9973}" for k in range(n))


def awkward():
    """Nulls in every column, empty and blank texts, a very long one, ties, repeated rows."""
    long = " ".join(f"long{k * k % 10007}" for k in range(30_000))
    rows = [row(1, None), row(2, ""), row(3, " \n\t"), row(4, "one"), row(5, long), row(6, sentence(1)), row(6, sentence(1)), row(7, sentence(1)), row(8, sentence(2), None, None)]
    return [*rows, (None,) * 11, row(9, "ünïcödé 日本語   text's end"), row(10, "<|endoftext|> ok"), row(11, "a a a a a a a a a a a a")]


def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def shingles(text, n=5):
    w = words(text)
    return frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()


def similar(a, b):
    shared = len(a & b)
    return bool(a) and bool(b) and shared >= 0.8 * (len(a) + len(b) - shared) - 1e-9


def multiset(df):
    return Counter(tuple(r) for r in df.collect())
