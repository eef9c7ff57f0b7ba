"""Quality classifier: support vectors on naive Bayes features.

A text becomes a set of n-gram indicators: words and word pairs, and one- to three-grams of
word shapes (runs of small letters, capitals and digits shortened to one sign, other signs
kept, with a mark on a word that repeats the one before). Indicators are hashed, scaled by
the log-count ratio of the two classes, and a linear hinge-loss model is fitted by dual
coordinate descent; a sigmoid fitted on rows kept from training turns margins into scores.

The model is fitted on at most about ``max_train`` labelled rows, chosen by a hash of the id, of
MAX_INDICATORS indicators together; all documents are scored, each whole.

Edge cases: null and empty texts have no indicators and get the intercept's score; rows with
null labels or ids teach nothing; if only one class (or none) is labelled every score is that
class's share (0.5 if none); repeated rows are scored each; other columns pass through.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LETTERS, Workspace, code_points, join_measured, mix64, read, shingle_hashes, slices, span_hashes, summed, text_chunks, word_spans

BITS = 18
MAX_TRAIN = 8_000
#: Indicators of all training rows together, 4 bytes each on the driver: rows beyond aren't learned from.
MAX_INDICATORS = 40_000_000
EPOCHS = 12

_shape = np.arange(0x110000, dtype=np.uint32)
for _c in range(LETTERS):
    if chr(_c).isalpha():
        _shape[_c] = 65 if chr(_c).isupper() else 97
    elif chr(_c).isdigit():
        _shape[_c] = 48
_runs = np.zeros(128, bool)
_runs[[48, 65, 97]] = True


def shape_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each word's shape, and offsets of texts."""
    cps, at = code_points(texts)
    shape = _shape[cps]
    keep = np.ones(len(shape), bool)
    keep[1:] = (shape[1:] != shape[:-1]) | ~((shape[1:] < 128) & _runs[np.minimum(shape[1:], 127)])
    at = np.concatenate(([0], np.cumsum(keep)))[at]
    shape = shape[keep]
    space = (shape == 32) | ((shape >= 9) & (shape <= 13))
    edge = np.diff(np.concatenate(([True], space)).view(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    return span_hashes(shape, starts, ends), np.searchsorted(starts, at)


def indicators(texts: list[str], bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct feature numbers of each text, and offsets."""
    words, _, _, offsets = word_spans(texts)
    shapes, shape_offsets = shape_hashes(texts)
    twin = np.zeros(len(words), bool)
    twin[1:] = words[1:] == words[:-1]
    twin[offsets[:-1][np.diff(offsets) > 0]] = False
    shapes = np.where(twin, shapes ^ np.uint64(0x5BD1E995), shapes)
    owners, features = [], []
    for salt, values, at, k in ((1, words, offsets, 1), (2, words, offsets, 2), (3, shapes, shape_offsets, 1), (4, shapes, shape_offsets, 2), (5, shapes, shape_offsets, 3)):
        grams, gram_at = shingle_hashes(values, at, k)
        features.append((mix64(grams + np.uint64(salt)) >> np.uint64(64 - bits)).astype(np.int64))
        owners.append(np.repeat(np.arange(len(texts)), np.diff(gram_at)))
    keys = np.unique((np.concatenate(owners) << bits) | np.concatenate(features))
    return (keys & ((1 << bits) - 1)).astype(np.int32), np.searchsorted(keys >> bits, np.arange(len(texts) + 1))


@dataclass
class Model:
    weights: np.ndarray  # of indicators, the class ratio already multiplied in
    bias: float
    slope: float
    intercept: float

    def margins(self, features: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        sums, norms = (summed(w[features], offsets) for w in self.weights)
        return sums / np.maximum(np.sqrt(norms), 1e-12) + self.bias

    def scores(self, features: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margins(features, offsets) + self.intercept, -30, 30)))


def fit(rows: list[np.ndarray], labels: np.ndarray, bits: int = BITS, epochs: int = EPOCHS, c: float = 1.0, seed: int = 7) -> Model:
    """Naive Bayes ratios, then hinge loss by dual coordinate descent, then a sigmoid on every fifth row."""
    size = 1 << bits
    if not len(labels) or labels.min() == labels.max():
        share = min(max(float(labels.mean()), 0.001), 0.999) if len(labels) else 0.5
        return Model(np.zeros((2, size)), 0.0, 0.0, float(np.log(share / (1 - share))))
    train = np.arange(len(rows)) % 5 != 0
    if len(set(labels[train])) < 2 or len(set(labels[~train])) < 2:
        train[:] = True
    counts = np.ones((2, size))
    for i in np.flatnonzero(train):
        counts[labels[i]][rows[i]] += 1
    ratio = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
    seen = counts.sum(axis=0) > 2
    ratio = np.where(seen, ratio, 0.0)
    norms = [float(np.sqrt((ratio[r] ** 2).sum())) for r in rows]
    w, bias = np.zeros(size), 0.0
    sign = np.where(labels == 1, 1.0, -1.0)
    share = labels[train].mean()
    bound = np.where(labels == 1, c * 0.5 / share, c * 0.5 / (1 - share))  # both classes weigh alike
    alpha = np.zeros(len(rows))
    order, rng = np.flatnonzero(train), np.random.default_rng(seed)
    values = [ratio[r] / max(n, 1e-12) for r, n in zip(rows, norms)]
    for _ in range(epochs):
        rng.shuffle(order)
        for i in order:
            x, v, y = rows[i], values[i], sign[i]
            square = (1.0 if norms[i] else 0.0) + 1.0  # the bias is a feature of value 1
            new = min(max(alpha[i] - (y * (float(w[x] @ v) + bias) - 1) / square, 0.0), bound[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * y
                w[x] += step * v
                bias += step
                alpha[i] = new
    model = Model(np.stack((w * ratio, ratio**2)), bias, 1.0, 0.0)
    some = np.flatnonzero(~train) if not train.all() else np.flatnonzero(train)
    margins = np.array([(float(w[rows[i]] @ values[i]) + bias) for i in some])
    target = labels[some].astype(float)
    high, low = (target.sum() + 1) / (target.sum() + 2), 1 / (len(target) - target.sum() + 2)
    target = np.where(target == 1, high, low)
    a, b = 1.0, 0.0
    for _ in range(50):  # Newton steps of the sigmoid, slightly ridged
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -30, 30)))
        g = np.array([((p - target) * margins).sum() + 1e-3 * a, (p - target).sum()])
        r = np.maximum(p * (1 - p), 1e-6)
        h = np.array([[(r * margins**2).sum() + 1e-3, (r * margins).sum()], [(r * margins).sum(), r.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        a, b = a - np.clip(step[0], -5, 5), b - np.clip(step[1], -5, 5)
    model.slope, model.intercept = float(a), float(b)
    return model


@F.arrow_udf(T.BinaryType())
def indicators_udf(column: pa.Array) -> pa.Array:
    out = []
    for texts in slices(column):
        for _, chunk in text_chunks(texts):
            features, offsets = indicators(chunk)
            out += [features[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:])]
    return pa.array(out, pa.binary())


def train_quality(docs: DataFrame, labels: DataFrame, text: str, doc_id: str, label: str, max_train: int) -> Model:
    """labels: rows to learn from. At most about max_train of them, by a hash of the id, are used."""
    labels = labels.where(F.col(label).isin(0, 1) & F.col(doc_id).isNotNull()).select(doc_id, label)
    share = max_train / max(labels.count(), 1)
    chosen = labels.where(F.pmod(F.xxhash64(doc_id, F.lit("train")), F.lit(1_000_000)) < int(1_000_000 * min(share, 1.0)))
    ws = Workspace(docs.sparkSession, "quality-classifier")
    joined = join_measured(docs.select(doc_id, text), chosen, doc_id, "inner", chosen.count())
    rows = ws.save(joined.select(F.xxhash64(doc_id).alias("h"), F.col(doc_id).alias("d"), F.col(label).alias("y"), indicators_udf(F.coalesce(F.col(text), F.lit(""))).alias("x")), "train")
    total, last = 0, None
    for h, size in sorted(rows.groupBy("h").agg(F.sum(F.octet_length("x")).alias("size")).collect()):  # at most about max_train rows
        total += size // 4
        if total > MAX_INDICATORS and last is not None:
            break
        last = h
    rows = rows.where(F.col("h") <= last).collect() if last is not None else []
    rows.sort(key=lambda r: (r.h, r.d, r.x))
    model = fit([np.frombuffer(r.x, np.int32) for r in rows], np.array([r.y for r in rows], np.int64))
    del rows
    ws.close()
    ws.release()
    return model


def score_quality(df: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "quality", max_train: int = MAX_TRAIN, score: str = "score") -> DataFrame:
    """df with a score from 0 to 1: how likely the label is 1."""
    model = train_quality(df, labels, text, doc_id, label, max_train)
    sent = df.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf(T.DoubleType())
    def scored(column: pa.Array) -> pa.Array:
        out = []
        for texts in slices(column):
            out += [sent.value.scores(*indicators(chunk)) for _, chunk in text_chunks(texts)]
        return pa.array(np.concatenate(out) if out else np.zeros(0), pa.float64())

    return df.withColumn(score, scored(F.coalesce(F.col(text), F.lit(""))))


def held_out(doc_id: str, mod: int, rest: int):
    """Whether a row's labels may not be learned from."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(mod)) == rest


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    labels = read(spark, sf_dir, "labels").where(~held_out("doc_id", 4, 2))
    scored = score_quality(docs, labels)
    return scored.select("doc_id", F.coalesce(held_out("doc_id", 4, 2), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
