"""Shared plumbing of the corpus operators: durable intermediate tables, size-checked
broadcasts, and vectorised hashing of words.

Intermediate results that are read more than once are written as Parquet under the
folder that the session names in ``spark.checkpoint.dir``, so that a lost executor
costs a re-read and never a local copy. Nothing here uses ``localCheckpoint``.
"""

from __future__ import annotations

import ctypes
import gc
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space that separates words everywhere in this subpackage.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"

#: A side may be broadcast up to this many rows; beyond it the join shuffles.
BROADCAST_ROWS = 20_000


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The shared work folder: ``spark.checkpoint.dir``. A local session without it works below its warehouse; on a cluster it must be set."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_work"
    return root.rstrip("/")


class Workspace:
    """Parquet tables of one operator call, each in a folder of its own below ``shared_dir``.

    A frame that an operator returns may read them, so they stay until ``close``, or until the
    driver ends; ``inner`` tells which were made since a point, so that a caller that has
    written an operator's result can close them.
    """

    made: list["Workspace"] = []

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.kept = False
        Workspace.made.append(self)

    @classmethod
    def inner(cls, since: int) -> list["Workspace"]:
        found = cls.made[since:]
        del cls.made[since:]
        return found

    def close(self) -> None:
        """Deletes all tables of this call."""
        self.delete(self.root)

    def delete(self, name: str, at_exit: bool = False) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(name)
        files = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        files.deleteOnExit(path) if at_exit else files.delete(path, True)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Writes df once and returns a frame that reads it: lineage ends here."""
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        if not self.kept:
            self.delete(self.root, at_exit=True)
            self.kept = True
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        """Deletes a table that nothing reads any more."""
        self.delete(f"{self.root}/{name}")

    def release(self) -> None:
        """Lets Spark's cleaner delete the shuffle files of finished jobs: it acts once the driver has collected its garbage. Gives the driver's freed memory back, too."""
        gc.collect()
        tidy()
        self.spark._jvm.System.gc()


def join_measured(big: DataFrame, small: DataFrame, on, how: str, rows: int) -> DataFrame:
    """Broadcasts ``small`` where its counted ``rows`` are within bound, else lets the join shuffle."""
    return big.join(F.broadcast(small) if rows <= BROADCAST_ROWS else small, on, how)


# --- vectorised word hashing -------------------------------------------------------------

_MUL = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0xD6E8FEB86659FD93)  # odd, so it has an inverse modulo 2**64
_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit words (xor-shift and multiply)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n, kept between calls."""
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, b in enumerate((_BASE, _INV)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            _powers[k] = np.cumprod(p, dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each values[starts[i]:ends[i]], equal for equal spans wherever they stand."""
    n = len(values)
    up, down = powers(n + 1)
    prefix = np.empty(n + 1, np.uint64)
    prefix[0] = 0
    np.cumsum(mix64(values.astype(np.uint64) + _MUL) * up[:n], dtype=np.uint64, out=prefix[1:])
    return mix64((prefix[ends] - prefix[starts]) * down[starts] + (ends - starts).astype(np.uint64) * _MUL)


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All texts as code points, each followed by a line feed, and where each text begins."""
    joined = np.frombuffer(("\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=starts[1:])
    return joined, starts


def word_spans(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words (runs without ASCII white space) of whole texts.

    Returns each word's hash, its first and last+1 code point within its own text, and
    offsets: text i has words offsets[i]:offsets[i + 1].
    """
    cps, at = code_points(texts)
    space = (cps == 32) | ((cps >= 9) & (cps <= 13))
    edge = np.diff(np.concatenate(([True], space)).view(np.int8))
    starts = np.flatnonzero(edge == -1)
    ends = np.flatnonzero(edge == 1)
    offsets = np.searchsorted(starts, at)
    base = np.repeat(at[:-1], np.diff(offsets))
    return span_hashes(cps, starts, ends), starts - base, ends - base, offsets


def shingle_hashes(words: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's k-word windows (a shorter text has one window: itself), and offsets."""
    counts = np.diff(offsets)
    n = np.where(counts == 0, 0, np.maximum(counts - k + 1, 1))
    out = np.zeros(len(n) + 1, np.int64)
    np.cumsum(n, out=out[1:])
    starts = np.arange(out[-1]) - np.repeat(out[:-1] - offsets[:-1], n)
    ends = np.minimum(starts + k, np.repeat(offsets[1:], n))
    return span_hashes(words, starts, ends), out


def text_chunks(texts: list, max_chars: int = 400_000):
    """(first index, texts) runs of about max_chars, nulls as empty; a longer text stands alone."""
    start, size = 0, 0
    texts = [t or "" for t in texts]
    for i, t in enumerate(texts):
        if size and size + len(t) > max_chars:
            yield start, texts[start:i]
            start, size = i, 0
        size += len(t) + 1
    if start < len(texts):
        yield start, texts[start:]


#: Classes of letters are told for code points below this one (all scripts that have capitals).
LETTERS = 0x20000


def summed(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The sum of values[offsets[i]:offsets[i + 1]], the same whatever stands beside it; 0 where there is none."""
    out = np.zeros(len(offsets) - 1, values.dtype)
    some = np.flatnonzero(np.diff(offsets))
    if len(some):
        out[some] = np.add.reduceat(values, offsets[some])
    return out


def tidy() -> None:
    """Gives freed memory back to the system: idle Python workers share an executor with its JVM."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # not this C library


def slices(column: pa.Array, rows: int = 512):
    """The values of an Arrow column, so many rows at a time: a batch is never a Python list as a whole."""
    for at in range(0, len(column), rows):
        yield column.slice(at, rows).to_pylist()
    tidy()
