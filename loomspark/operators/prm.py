"""A tiny process reward model: hashed tokens, logistic scores, training in sequence and at scale."""

from __future__ import annotations

import json
import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.functions.quality import features, sigmoid
from loomspark.sources.work import Work

BUCKETS = 8192
#: Rows of a batch that are worked on at once.
SLICE = 512


def featurise(df: DataFrame, key: str, text: str, buckets: int = BUCKETS) -> DataFrame:
    """key, bucket and how many tokens fall into it."""
    return df.select(key, F.explode(features(text, buckets)).alias("bucket")).groupBy(key, "bucket").agg(F.count("*").alias("value"))


def scorer(weights: DataFrame, bias: float, buckets: int = BUCKETS, mean: bool = False) -> Callable[[Column], Column]:
    """What a model makes of a text, as a column: its buckets meet the weights as one literal array, whose size is the number of buckets.

    mean: the model is of ``fit_logistic``, on the mean over tokens; else of ``train``, on their sum.
    """
    table = [0.0] * buckets
    for r in weights.collect():
        table[r.bucket] = r.weight
    array = F.from_json(F.lit(json.dumps(table)), "array<double>")

    def score(text) -> Column:
        dot = F.aggregate(features(text, buckets), F.lit(0.0), lambda total, b: total + F.get(array, b))
        dot = dot / F.greatest(F.lit(1), F.size(features(text, buckets))) if mean else dot
        return sigmoid(F.coalesce(dot, F.lit(0.0)) + bias)

    return score


def predict(df: DataFrame, key: str, text, weights: DataFrame, bias: float, buckets: int = BUCKETS, mean: bool = False) -> DataFrame:
    """key and score, without a shuffle."""
    return df.select(key, scorer(weights, bias, buckets, mean)(text).alias("score"))


def record_text(prompt, error_type, history, tests, code) -> Column:
    """The text that the model reads of a case: up to eight rounds of history (struct error_type, score)."""
    empty = lambda c: F.coalesce(F.col(c), F.lit(""))
    rounds = F.transform(F.slice(F.col(history), 1, 8), lambda h: F.concat(F.lit("round_error="), F.coalesce(h["error_type"], F.lit("")), F.lit(" round_score="), F.coalesce(h["score"].cast("string"), F.lit(""))))
    return F.concat(F.lit("prompt="), empty(prompt), F.lit("\nerror_type="), empty(error_type), F.lit("\nhistory="), F.coalesce(F.array_join(rounds, " | "), F.lit("")), F.lit("\ntests="), empty(tests), F.lit("\ncode="), empty(code))


def label(all_passed, pass_at_1) -> Column:
    return F.when(F.coalesce(F.col(all_passed), F.lit(False)) | F.coalesce(F.col(pass_at_1), F.lit(False)), 1).otherwise(0)


def slices(batches):
    """Batches of SLICE rows at most, so that what is made of one stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            yield batch.slice(at, SLICE)


def packed(df: DataFrame, text: str, target: str, buckets: int, order: str | None = None) -> DataFrame:
    """Labelled texts as (o,) y and x: each row's different buckets and their counts, 8 bytes an entry."""

    def pack(batches):
        for batch in slices(batches):
            out = []
            for row in batch.column(batch.num_columns - 1):
                found, counts = np.unique(row.values.to_numpy(), return_counts=True)
                out.append(np.stack((found, counts)).astype(np.int32).tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out, pa.binary())], names=[*batch.schema.names[:-1], "x"])

    first = [F.col(order).alias("o")] if order else []
    rows = df.select(*first, F.col(target).cast("int").alias("y"), features(F.coalesce(F.col(text), F.lit("")), buckets).alias("t"))
    return rows.mapInArrow(pack, (f"o {df.schema[order].dataType.simpleString()}, " if order else "") + "y int, x binary")


@dataclass
class Logistic:
    """A fitted model on the mean over a text's tokens: weights of the buckets, the bias, the mean loss with its penalty, and the passes over the data that it took."""

    weights: np.ndarray
    bias: float
    loss: float
    passes: int

    def frame(self, spark: SparkSession) -> DataFrame:
        """bucket and weight, as ``predict`` takes them."""
        return spark.createDataFrame([(int(b), float(self.weights[b])) for b in np.flatnonzero(self.weights)], "bucket int, weight double")


def loss_and_gradient(batches, w: np.ndarray):
    """Of packed rows, each as shares of its tokens: their number, the sums of the loss and of its gradient (the bias last), and of the squares."""
    size = len(w) - 1
    n, loss, gradient, squares = 0, 0.0, np.zeros(size + 1), np.zeros(size)
    for batch in slices(batches):
        y = batch.column(0).to_numpy(zero_copy_only=False) > 0
        rows = [np.frombuffer(x.as_buffer(), np.int32).reshape(2, -1) for x in batch.column(1)]
        at = np.cumsum([0] + [r.shape[1] for r in rows])
        found, counts = np.concatenate(rows, axis=1) if rows else np.zeros((2, 0), np.int32)
        owner = np.repeat(np.arange(len(rows)), np.diff(at))
        counts = counts / np.bincount(owner, counts, minlength=len(rows))[owner]
        z = np.bincount(owner, w[found] * counts, minlength=len(rows)) + w[-1]
        signed = np.where(y, -z, z)
        loss += float(np.logaddexp(0, signed).sum())
        off = np.exp(-np.logaddexp(0, -signed)) * np.where(y, -1.0, 1.0)
        gradient[:size] += np.bincount(found, off[owner] * counts, minlength=size)
        gradient[size] += off.sum()
        squares += np.bincount(found, counts**2, minlength=size)
        n += len(rows)
    return n, loss, gradient, squares


def fit_logistic(df: DataFrame, text: str, target: str, buckets: int = BUCKETS, l2: float = 1e-6, tolerance: float = 1e-8, most: int = 500) -> Logistic:
    """Logistic regression on hashed tokens, for any number of rows: the optimum of the mean log loss plus ``l2 / 2`` times
    the squared weights (the bias is free), which, unlike ``train``'s, doesn't depend on the order of rows. A text counts
    by the shares of its tokens, so that long ones don't outweigh all others.

    Texts are hashed once and written packed. Each step is a pass over them: every partition sums loss and gradient, the
    sums meet in a tree, and the driver, which holds a few vectors of ``buckets`` numbers, takes a limited-memory BFGS step
    from curvatures that the first pass has estimated bucket by bucket. Ends when a step is expected to gain less than
    ``tolerance``; an error if it doesn't within ``most`` passes. Rows without a label are left out.
    """
    buckets, work = max(256, int(buckets)), Work(df.sparkSession, "prm-logistic")
    rows = work.save(packed(df.where(F.col(target).isNotNull()), text, target, buckets), "packed")

    kind, names = "n long, loss double, sums binary", ["n", "loss", "sums"]
    tasks = math.isqrt(rows.rdd.getNumPartitions())

    def sums_row(n: int, loss: float, sums: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([loss]), pa.array([sums.tobytes()], pa.binary())], names)

    def total(w: np.ndarray):
        def partial(batches):
            n, loss, gradient, squares = loss_and_gradient(batches, w)
            if n:
                yield sums_row(n, loss, np.concatenate((gradient, squares)))

        def added(batches):
            n, loss, sums = 0, 0.0, np.zeros(2 * buckets + 1)
            for batch in batches:
                for row in zip(*batch.columns):
                    n, loss = n + row[0].as_py(), loss + row[1].as_py()
                    sums += np.frombuffer(row[2].as_buffer())
            if n:
                yield sums_row(n, loss, sums)

        # sums meet in as many tasks as the root of the partitions, those on the driver: a stage has one worker a core
        parts = rows.mapInArrow(partial, kind)
        parts = parts.repartition(tasks).mapInArrow(added, kind) if tasks > 4 else parts
        found = [(r.n, r.loss, np.frombuffer(r.sums)) for r in parts.collect()]
        return tuple(sum(c) for c in zip(*found))

    if rows.isEmpty():
        raise ValueError("no labelled rows")
    w = np.zeros(buckets + 1)
    n, loss, sums = total(w)
    curvature = np.concatenate((0.25 * sums[buckets + 1 :] / n + l2, [0.25]))
    penal = np.concatenate((np.full(buckets, l2), [0.0]))
    value, gradient, passes = loss / n, sums[: buckets + 1] / n, 1
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    while True:
        direction, alphas = gradient.copy(), []
        for s, y in reversed(steps):
            alphas.append((s @ direction) / (s @ y))
            direction -= alphas[-1] * y
        if steps:
            s, y = steps[-1]
            direction *= (s @ y) / (y @ (y / curvature))
        direction /= curvature
        for (s, y), alpha in zip(steps, reversed(alphas)):
            direction += s * (alpha - (y @ direction) / (s @ y))
        gain = float(gradient @ direction)
        if gain < tolerance:
            return Logistic(w[:buckets], float(w[buckets]), value, passes)
        length = 1.0
        while True:
            if passes >= most:
                raise ArithmeticError(f"no optimum within {most} passes")
            there = w - length * direction
            n, loss, sums = total(there)
            passes += 1
            reached = loss / n + 0.5 * float(penal @ there**2)
            if reached <= value - 1e-4 * length * gain:
                break
            length /= 2
        slope = sums[: buckets + 1] / n + penal * there
        if (there - w) @ (slope - gradient) > 0:
            steps = [*steps[-9:], (there - w, slope - gradient)]
        w, value, gradient = there, reached, slope


def train(df: DataFrame, text: str, target: str, order: str, buckets: int = BUCKETS, epochs: int = 3, rate: float = 0.08, l2: float = 1e-6) -> DataFrame:
    """bucket and weight (bucket -1: the bias) by one pass after another over the rows in order.

    Sequential by definition, so all rows meet in one task, one epoch after another: Spark sorts them (on disk, where memory
    is short), and the task takes them batch by batch, so it holds the weights and some rows, whatever the number of rows.
    Texts are hashed and counted where they are, once; what arrives is each row's buckets with counts, 8 bytes an entry.
    """
    buckets, epochs, spark = max(256, int(buckets)), max(1, int(epochs)), df.sparkSession

    def learn(batches, w: np.ndarray, bias: float):
        w, n = w.copy(), 0
        for batch in slices(batches):
            n += batch.num_rows
            for y, x in zip(batch["y"].to_numpy(zero_copy_only=False), batch["x"]):
                found, counts = np.frombuffer(x.as_buffer(), np.int32).reshape(2, -1)
                z = bias + float(w[found] @ counts)
                gradient = (1 / (1 + math.exp(-z)) if z >= 0 else math.exp(z) / (1 + math.exp(z))) - (y > 0)
                bias -= rate * gradient
                w[found] -= rate * (gradient * counts + l2 * w[found])
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([bias]), pa.array([w.tobytes()], pa.binary())], ["bias", "weights"])

    rows = Work(spark, "prm-train").save(packed(df, text, target, buckets, order), "packed")
    w, bias, seen = np.zeros(buckets), 0.0, False
    for _ in range(epochs):
        start = (w, bias)
        for r in rows.repartition(1).sortWithinPartitions("o").mapInArrow(lambda b, start=start: learn(b, *start), "bias double, weights binary").collect():
            w, bias, seen = np.frombuffer(r.weights), r.bias, True
    used = [(int(b), float(w[b])) for b in np.flatnonzero(w)]
    return spark.createDataFrame([(-1, float(bias)), *used] if seen else [], "bucket int, weight double")
