"""Embedding whitening: projection on the principal components, scaled to unit variance.

A vector's entries become integers, ``floor(1024 * c) + 100000``, whose large common offset would
eat the digits of a sum of squares. So each partition works on its own mean: it tells its count,
its exact sums and the scatter of its rows about their own mean, and two such triples merge by
Chan's formula, the scatter growing by ``n1 * n2 / (n1 + n2)`` times the outer product of the
difference of the means. The merge is a tree over the executors (``treeReduce``), so what reaches
the driver is one triple of d sums and d * d products, whatever the rows. The driver takes the
eigenvectors; the rows are projected where they are; a second pass, merged in the same way over
the whitened rows, tells how far their covariance is from the identity.

Sums of the integers are exact, so ``deviation`` is, too. The scatter's sums of products are
doubles about a mean that is right to the last digit.

Edge cases: vectors that are null, empty, or hold null or non-finite entries take no part and don't
come back; nor do vectors of another length than the most frequent one (the longest of equally
frequent ones). An entry of 2**40 and more in size raises an error, as its integer has no room.
Repeated rows count as often as they stand. Components of no variance (equal vectors, fewer
vectors than dimensions) have no whitened form: ``whitened`` is null for them and they aren't part
of ``identity_error``; a deviation beyond a long is null. An empty table gives an empty result.
Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Workspace, read

SCALE, OFFSET = 1024, 100_000
#: Entries from here on have no exact integer.
LARGEST = 2.0**40
#: Below this share of the largest one an eigenvalue is rounding.
RANK = 1e-13
#: Rows that are turned into a matrix at a time.
ROWS = 8192


class Moments(NamedTuple):
    """Count, sums, and scatter about the mean, of some rows."""

    n: int
    sums: np.ndarray
    scatter: np.ndarray

    @classmethod
    def of(cls, rows: np.ndarray) -> "Moments":
        sums = rows.sum(axis=0)
        centred = rows - sums / len(rows)
        return cls(len(rows), sums, centred.T @ centred)

    def merge(self, other: "Moments") -> "Moments":
        apart = other.sums / other.n - self.sums / self.n
        return Moments(self.n + other.n, self.sums + other.sums, self.scatter + other.scatter + np.outer(apart, apart) * (self.n * other.n / (self.n + other.n)))


def usable(df: DataFrame, key: str, vector: str) -> DataFrame:
    """key and entries (doubles) of the vectors that are whole and finite."""
    v = F.col(vector).cast("array<double>")
    whole = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    return df.select(F.col(key).alias("vec_id"), v.alias("v")).where(F.col("v").isNotNull() & (F.size("v") > 0) & whole.eqNullSafe(F.lit(True)))


def matrices(column: pa.Array, dim: int, scaled: bool) -> Iterator[np.ndarray]:
    """The vectors of a column as matrices of some thousand rows; scaled: as integers."""
    for at in range(0, len(column), ROWS):
        part = column.slice(at, ROWS)
        rows = part.flatten().to_numpy(zero_copy_only=False).reshape(len(part), dim)
        if scaled and rows.size and np.abs(rows).max() >= LARGEST:
            raise ArithmeticError("an entry of a vector is too large for whitening")
        yield np.floor(rows * SCALE).astype(np.int64) + OFFSET if scaled else rows


def moments(df: DataFrame, column: str, dim: int, scaled: bool) -> Moments:
    """Moments of a column of vectors: one triple a partition, merged as a tree."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = None
        for batch in batches:
            for rows in matrices(batch.column(0), dim, scaled):
                if len(rows):
                    found = Moments.of(rows) if found is None else found.merge(Moments.of(rows))
        if found is not None:
            yield pa.RecordBatch.from_arrays([pa.array([found.n]), pa.array([found.sums.tobytes()], pa.binary()), pa.array([found.scatter.tobytes()], pa.binary())], ["n", "sums", "scatter"])

    kind = np.int64 if scaled else np.float64
    parts = df.select(column).mapInArrow(partial, "n long, sums binary, scatter binary").rdd.map(
        lambda r: Moments(r.n, np.frombuffer(r.sums, kind), np.frombuffer(r.scatter, np.float64).reshape(dim, dim)))
    return parts.treeReduce(Moments.merge, depth=max(2, (parts.getNumPartitions() - 1).bit_length() // 3))


def whiten(df: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = 8) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error: a row for each vector and component."""
    spark = df.sparkSession
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows = usable(df, key, vector)
    lengths = rows.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).limit(1).collect()
    if not lengths:
        return spark.createDataFrame([], schema)
    dim = lengths[0].dim
    rows = rows.where(F.size("v") == dim)
    fit = moments(rows, "v", dim, True)
    values, vectors = np.linalg.eigh(fit.scatter / fit.n)
    order = np.argsort(values)[::-1][: min(components, dim)]
    values, vectors, total = values[order], vectors[:, order], float(np.trace(fit.scatter) / fit.n)
    good = values > max(values[0] * RANK, 0)
    n, sums = fit.n, fit.sums
    mean = sums / n
    exact = float(n) * (2 * np.abs(mean).max() + 1) < 2**62

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scale = vectors[:, good] / np.sqrt(values[good])
        for batch in batches:
            at = 0
            for x in matrices(batch.column(1), dim, True):
                off = n * x - sums if exact else n * x.astype(object) - sums.astype(object)
                if off.dtype == object or float(np.abs(off).max(initial=0)) ** 2 * dim >= 2**63:
                    deviation = [int(d) if d < 2**63 else None for d in (off.astype(object) ** 2).sum(axis=1)]
                else:
                    deviation = (off * off).sum(axis=1)
                white = (x - mean) @ scale
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(x)), pa.array(deviation, pa.int64()), pa.FixedSizeListArray.from_arrays(pa.array(white.ravel()), max(white.shape[1], 1)).cast(pa.list_(pa.float64()))
                     if white.shape[1] else pa.array([[]] * len(x), pa.list_(pa.float64()))], ["vec_id", "deviation", "white"])
                at += len(x)

    white = rows.mapInArrow(project, "vec_id long, deviation long, white array<double>")
    white = Workspace(spark, "whitening").save(white, "white")
    error = None
    if good.any():
        second = moments(white, "white", int(good.sum()), False)
        error = float(np.abs(second.scatter / second.n - np.eye(int(good.sum()))).max())
    explained = [float(e / total) if total > 0 else None for e in values]
    # eigenvalues fall, so the components that have a whitened form come first
    each = F.array(*[F.struct(F.lit(k + 1).alias("component"), F.lit(e).cast("double").alias("explained")) for k, e in enumerate(explained)])
    out = white.select("vec_id", "deviation", "white", F.explode(each).alias("c"))
    return out.select(
        "vec_id", "c.component", F.lit(n).cast("long").alias("n"), "deviation", F.get("white", F.col("c.component") - 1).alias("whitened"),
        "c.explained", F.lit(error).cast(T.DoubleType()).alias("identity_error"))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(read(spark, sf_dir, "embeddings"))
