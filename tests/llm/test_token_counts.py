import public_tokenizers
from tokenizers import Tokenizer

from loomspark.llm.token_counts import LengthCounter, LengthTable, count_tokens, op10_token_counts

from .helpers import awkward, table

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_counts_are_the_librarys(spark, tiny):
    library = Tokenizer.from_file(PATH)
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{tiny}/documents.parquet").collect()}
    found = op10_token_counts(spark, tiny).collect()
    assert len(found) == len(texts)
    for r in found:
        assert r.n_tokens == len(library.encode(texts[r.doc_id], add_special_tokens=False).ids)
        assert r.n_bytes == len(texts[r.doc_id].encode()) and r.over_limit == (r.n_tokens > 2048)


def test_awkward_rows(spark):
    library = Tokenizer.from_file(PATH)
    out = count_tokens(table(spark, awkward()), PATH).collect()
    assert len(out) == len(awkward())
    for r in out:
        assert r.n_tokens == len(library.encode(r.text or "", add_special_tokens=False).ids)
    assert count_tokens(table(spark, []), PATH).count() == 0


def test_caches_stay_bounded_and_exact():
    library, counter = Tokenizer.from_file(PATH), LengthCounter(PATH, LengthTable({}), cache_size=10)
    texts = [f"Word{i}'s it's don't {i} !?.. x y STRASSE ß" for i in range(200)]
    assert counter.count(texts) == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]
    assert len(counter.runs) < 10 + 2000
    long = ["x" * 5000 + str(i) for i in range(20)]
    assert counter.count(long) == [len(library.encode(t, add_special_tokens=False).ids) for t in long]
    assert max(map(len, [*counter.runs, *counter.parts])) <= 64


def test_length_table():
    words = {f"w{i}é": i % 300 + 1 for i in range(5000)}
    built = LengthTable(words)
    assert all(built.get(w) == n for w, n in words.items()) and built.get("other") is None and built.size <= 1 << 14
    assert LengthTable({}).get("x") is None
