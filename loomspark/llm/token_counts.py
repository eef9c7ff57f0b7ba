"""Token counts by a two-tier lookup that never shuffles a pre-token.

Tier one is a compact hash table of the commonest pre-token lengths (open addressing in flat
arrays of fingerprints and lengths), broadcast to every worker; tier two is a bounded cache in
each Python worker that encodes what the table misses. A pre-token is a run without white space: no pattern of the tokenizer crosses
white space, so a text's count is the sum over its runs. Texts for which that argument
isn't safe (special strings, rare scripts, characters whose lower case or normal form
could merge or split runs) go to the library whole.

The table is learned from a bounded sample of documents. It only warms the caches: every
count is exact whatever the table holds.

Edge cases: a null or empty text has 0 bytes and 0 tokens; very long texts are counted
whole; repeated rows are counted each; an empty table gives an empty result; other columns
pass through untouched, and a clash with an output column is resolved in favour of the count.
"""

from __future__ import annotations

import os
import re
import uuid
from collections import ChainMap, Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import read, slices, text_chunks

#: Characters for which lower-casing and normalising act one by one.
_UNSAFE = re.compile("[^\\t-\\r\\x20-\\x7e\\xa1-\\xffŒœ–—‘-„…€]")
#: The tokenizer's own pre-token pattern (a fixed value of word_bpe_49k.json).
_PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
SAMPLE_DOCS = 4_000
TABLE_SIZE = 65_536
CACHE_SIZE = 300_000
#: Longer runs are counted each time, so that a cache of so many entries is bounded in bytes, too.
LONGEST_CACHED = 64

_workers: dict[str, "LengthCounter"] = {}


class LengthTable:
    """A hash table from pre-tokens to lengths: 128-bit fingerprints and lengths in flat arrays, at most half full."""

    def __init__(self, lengths: dict[str, int]):
        self.size = 1 << max(2 * len(lengths) - 1, 1).bit_length()
        self.keys = np.zeros((self.size, 2), np.uint64)
        self.lengths = np.zeros(self.size, np.uint32)  # 0: free
        for word, n in lengths.items():
            high, low = self.fingerprint(word)
            slot = low & (self.size - 1)
            while self.lengths[slot]:
                slot = (slot + 1) & (self.size - 1)
            self.keys[slot] = high, low
            self.lengths[slot] = n

    @staticmethod
    def fingerprint(word: str) -> tuple[int, int]:
        h = xxhash.xxh3_128_intdigest(word.encode("utf-8", "surrogatepass"))
        return h >> 64, h & 0xFFFFFFFFFFFFFFFF

    def get(self, word: str) -> int | None:
        high, low = self.fingerprint(word)
        slot = low & (self.size - 1)
        while n := self.lengths[slot]:
            if self.keys[slot, 1] == low and self.keys[slot, 0] == high:
                return int(n)
            slot = (slot + 1) & (self.size - 1)
        return None


class LengthCounter:
    """Counts tokens of whole texts in one worker, within bounded memory."""

    def __init__(self, path: str, table: LengthTable, cache_size: int = CACHE_SIZE):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.pattern = regex.compile(_PRE_TOKEN)
        self.table, self.cache_size = table, cache_size
        self.runs: dict[str, int] = {}
        self.parts: dict[str, int] = {}

    def encode_lengths(self, texts: list[str]) -> list[int]:
        return [len(e.ids) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def is_safe(self, text: str) -> bool:
        return not (_UNSAFE.search(text) or any(s in text for s in self.special))

    def learn(self, runs: set[str]) -> dict[str, int]:
        """Puts the lengths of short runs into the cache, from the table or the library, and returns those of the others."""
        if len(self.runs) > self.cache_size:
            self.runs = {}
        if len(self.parts) > self.cache_size:
            self.parts = {}
        new = list(runs - self.runs.keys())
        split = [self.pattern.findall(r) for r in new]
        found: dict[str, int] = {}
        missing = []
        for part in set().union(*split) - self.parts.keys():
            n = self.table.get(part)
            if n is None:
                missing.append(part)
            else:
                found[part] = n
        for i in range(0, len(missing), 4096):
            some = missing[i : i + 4096]
            found.update(zip(some, self.encode_lengths(some)))
        self.parts.update((p, n) for p, n in found.items() if len(p) <= LONGEST_CACHED)
        found = ChainMap(found, self.parts)
        counted = {r: sum(found[p] for p in parts) for r, parts in zip(new, split)}
        self.runs.update((r, n) for r, n in counted.items() if len(r) <= LONGEST_CACHED)
        return {r: n for r, n in counted.items() if len(r) > LONGEST_CACHED}

    def count(self, texts: list) -> list[int]:
        out = [0] * len(texts)
        for first, chunk in text_chunks(texts):
            split = [t.lower().split() if self.is_safe(t) else None for t in chunk]
            long = self.learn(set().union(*(s for s in split if s)))
            get = ChainMap(long, self.runs).__getitem__ if long else self.runs.__getitem__
            for i, (t, s) in enumerate(zip(chunk, split)):
                out[first + i] = sum(map(get, s)) if s is not None else self.encode_lengths([t])[0]
        return out


def frequent_lengths(df: DataFrame, path: str, text: str, sample_docs: int, table_size: int) -> dict[str, int]:
    """Lengths of the commonest pre-tokens among about sample_docs documents, drawn row by row."""
    rows = df.count()
    if not rows:
        return {}
    sample = df.select(F.col(text).alias("t")).where(F.col("t").isNotNull() & (F.rand(11) < sample_docs / rows))

    def tally(batches):
        import regex

        pattern, counts = regex.compile(_PRE_TOKEN), Counter()
        for batch in batches:
            for t in batch.column(0).to_pylist():
                counts.update(pattern.findall(t.lower()))
        top = counts.most_common(table_size)
        yield pa.RecordBatch.from_pydict({"p": [p for p, _ in top], "n": [n for _, n in top]}, schema=pa.schema([("p", pa.string()), ("n", pa.int64())]))

    counts: Counter = Counter()
    for r in sample.mapInArrow(tally, "p string, n bigint").collect():
        counts[r.p] += r.n
    words = [w for w, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:table_size]]
    return dict(zip(words, LengthCounter(path, LengthTable({})).encode_lengths(words))) if words else {}


def count_tokens(
    df: DataFrame, path: str, text: str = "text", n_tokens: str = "n_tokens", n_bytes: str = "n_bytes",
    sample_docs: int = SAMPLE_DOCS, table_size: int = TABLE_SIZE, cache_size: int = CACHE_SIZE,
) -> DataFrame:
    """df with n_bytes (UTF-8) and n_tokens of each whole text."""
    table = df.sparkSession.sparkContext.broadcast(LengthTable(frequent_lengths(df, path, text, sample_docs, table_size)))
    key = uuid.uuid4().hex

    @F.arrow_udf(T.LongType())
    def counted(column: pa.Array) -> pa.Array:
        if key not in _workers:
            _workers.clear()  # one table at a time: a worker's memory stays bounded
            _workers[key] = LengthCounter(path, table.value, cache_size)
        return pa.array([n for texts in slices(column) for n in _workers[key].count(texts)], pa.int64())

    return df.withColumns({n_bytes: F.coalesce(F.octet_length(text), F.lit(0)).cast("long"), n_tokens: counted(F.coalesce(F.col(text), F.lit("")))})


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    counted = count_tokens(docs, public_tokenizers.path("word_bpe_49k.json"))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 2048).alias("over_limit"))
