"""Byte-level BPE of whole texts, vectorised over batches.

Pre-tokens are found for a batch at once from character classes, hashed, and made distinct;
only distinct ones are looked up in a bounded cache, and only what the cache misses is
merged. Texts with contractions go through the merge library whole, texts with special
strings or characters beyond the class table through the tokenizer library itself.
"""

from __future__ import annotations

import json
import os
import struct

import numpy as np

from .common import code_points, span_hashes, text_chunks

#: Fixed value: the pre-token pattern of this family of tokenizers.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CACHE_SIZE = 200_000
#: Longer pre-tokens are encoded each time, so that a cache of so many entries is bounded in bytes, too.
LONGEST_CACHED = 64
_KNOWN = 0x250
_SPACE, _LETTER, _NUMBER, _OTHER, _END = range(5)


def _classes() -> np.ndarray:
    import regex

    table = np.full(_KNOWN, _OTHER, np.int8)
    for kind, pattern in ((_SPACE, r"\s"), (_LETTER, r"\p{L}"), (_NUMBER, r"\p{N}")):
        find = regex.compile(pattern)
        table[[bool(find.match(chr(i))) for i in range(_KNOWN)]] = kind
    table[0x1C:0x20] = _OTHER  # separators of information, white space in one library only: see is_plain
    return table


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in the vocabulary file."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


class ByteBPE:
    def __init__(self, path: str, cache_size: int = CACHE_SIZE):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        alphabet = byte_alphabet()
        ranks = {bytes(alphabet[c] for c in token): i for token, i in vocab.items() if token not in self.special}
        self.merges = tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.cache: dict[str, bytes] = {}
        self.cache_size = cache_size
        self.table = _classes()

    def pre_tokens(self, cps: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last+1 code point of each pre-token; bounds: where texts begin, each ended by one sign that isn't its own."""
        kind = self.table[cps]
        last = bounds[1:] - 1
        kind[last] = _END
        after = np.append(kind[1:], np.int8(_END))
        solid = (kind != _SPACE) & (kind != _END)
        start = np.ones(len(cps), bool)
        start[1:] = kind[1:] != kind[:-1]
        start |= (kind == _SPACE) & (after != _SPACE) & (after != _END)  # the last white space before a word stands alone ...
        start[1:] &= ~(solid[1:] & (cps[:-1] == 32) & (kind[:-1] == _SPACE))  # ... and a blank joins the word
        start[last] = True
        begins = np.flatnonzero(start)
        ends = np.append(begins[1:], len(cps))
        own = kind[begins] != _END
        return begins[own], ends[own]

    def lookup(self, pieces: list[str]) -> list[bytes]:
        if len(self.cache) > self.cache_size:
            self.cache = {}
        found = list(map(self.cache.get, pieces))
        for i, known in enumerate(found):
            if known is None:
                ids = self.merges.encode_ordinary(pieces[i])
                found[i] = struct.pack(f"<{len(ids)}I", *ids)
                if len(pieces[i]) <= LONGEST_CACHED:
                    self.cache[pieces[i]] = found[i]
        return found

    def encode_plain(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts together and offsets of each."""
        cps, bounds = code_points(texts)
        joined = "\n".join(texts) + "\n"
        begins, ends = self.pre_tokens(cps, bounds)
        if not len(begins):
            return np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
        keys = span_hashes(cps, begins, ends)
        _, first, inverse = np.unique(keys, return_index=True, return_inverse=True)
        same = first[inverse]
        if ((ends - begins) != (ends - begins)[same]).any() or (cps[begins] != cps[begins[same]]).any() or (cps[ends - 1] != cps[ends[same] - 1]).any():
            first = inverse = np.arange(len(begins))  # two pre-tokens share a hash: look up each
        found = self.lookup([joined[a:b] for a, b in zip(begins[first].tolist(), ends[first].tolist())])
        flat = np.frombuffer(b"".join(found), np.uint32)
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        place = np.concatenate(([0], np.cumsum(sizes)))[:-1]
        n = sizes[inverse]
        total = np.concatenate(([0], np.cumsum(n)))
        ids = flat[np.repeat(place[inverse] - total[:-1], n) + np.arange(total[-1])]
        return ids, total[np.searchsorted(begins, bounds)]

    def is_plain(self, text: str) -> bool:
        return "'" not in text and (text.isascii() or max(text) < chr(_KNOWN)) and not any(s in text for s in self.special) and not any(chr(c) in text for c in range(0x1C, 0x20))

    def encode(self, texts: list) -> list[np.ndarray]:
        """Ids of each whole text, as the library gives them without added special tokens."""
        out = [np.zeros(0, np.uint32)] * len(texts)
        for first, chunk in text_chunks(texts, 600_000):
            plain = [i for i, t in enumerate(chunk) if self.is_plain(t)]
            ids, offsets = self.encode_plain([chunk[i] for i in plain])
            for k, i in enumerate(plain):
                out[first + i] = ids[offsets[k] : offsets[k + 1]]
            for i in set(range(len(chunk))) - set(plain):
                t = chunk[i]
                simple = (t.isascii() or max(t) < chr(_KNOWN)) and not any(s in t for s in self.special) and not any(chr(c) in t for c in range(0x1C, 0x20))
                out[first + i] = np.array(self.merges.encode_ordinary(t) if simple else self.library.encode(t, add_special_tokens=False).ids, np.uint32)
        return out
