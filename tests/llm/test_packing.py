import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from loomspark.llm.bestfit_packing import Packing, crossover, cut_points, decode, evolve, op5_bestfit_packing, pack_documents
from loomspark.llm.byte_bpe import ByteBPE

from .helpers import awkward, table

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_ids_are_the_librarys():
    library, bpe = Tokenizer.from_file(PATH), ByteBPE(PATH, cache_size=50)
    rng = random.Random(5)
    texts = ["", "  a", " \n b", "a  b\n\n c  ", "x's don't", "<|endoftext|>hi", "日本 語", "\n", " ", "é", "a\x1cb", "¼ ½ a1b2", "ª º µ"]
    texts += ["".join(rng.choice("abC  \n\t.,1é' ½\x85\xa0") for _ in range(rng.randint(0, 60))) for _ in range(400)]
    for t, ids in zip(texts, bpe.encode(texts)):
        assert library.encode(t, add_special_tokens=False).ids == ids.tolist(), repr(t)


def check(texts, rows):
    library = Tokenizer.from_file(PATH)
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    assert set(pieces) == set(texts)
    for d, t in texts.items():
        ids = library.encode(t or "", add_special_tokens=False).ids + [2]
        own = sorted(pieces[d], key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(-(-len(ids) // 1024)))
        at = 0
        for r in own:
            assert r.start == at and r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids) and all(r.length == 1024 for r in own[1:])
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 1024
    return len(sequences), sum(r.length for r in rows) / 1024


def test_round_trip_and_tightness(spark, tiny):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{tiny}/documents.parquet").collect()}
    used, least = check(texts, op5_bestfit_packing(spark, tiny).collect())
    assert used <= least * 1.03 + 2


def test_awkward_rows(spark):
    rows = [r for r in awkward() if r[0] not in (6, None)]
    check({r[0]: r[1] for r in rows}, pack_documents(table(spark, rows), PATH, block=3).collect())
    assert pack_documents(table(spark, awkward()), PATH, with_ids=True).where("size(ids) = length").count() >= len(awkward())
    assert pack_documents(table(spark, []), PATH).count() == 0


def test_cuts():
    assert cut_points(1, 4) == [0, 1] and cut_points(4, 4) == [0, 4] and cut_points(9, 4) == [0, 1, 5, 9]


def test_genes():
    rng = random.Random(2)
    sizes = [rng.randint(1, 1000) for _ in range(300)]
    a, b = (Packing(sizes, 1024).insert(rng.sample(range(300), 300)) for _ in range(2))
    child = crossover(a, b, rng)
    assert sorted(p for x in child.bins for p in x) == list(range(300))
    assert all(sum(sizes[p] for p in x) <= 1024 for x in child.bins)
    numbers, fewer, _ = evolve(sizes, 1024, 1, [])
    best = decode(sizes, 1024, numbers)
    assert -fewer == len(best.bins) <= len(Packing(sizes, 1024).insert(sorted(range(300), key=lambda p: -sizes[p])).bins)
