"""Quality rules: plain counts per text, then robust multivariate outliers per language and source.

Each document gets a vector of transformed statistics (length, word length, and the shares
of symbols, repeated words, doubled words and capitals). For every language and source a
minimum-covariance-determinant estimate of centre and scatter is found by concentration
steps over all documents, from several starts (medians and quartiles, and small random
subsets): distances under the current estimate are binned, the nearest share of each cell is
summed up to the next estimate, until no determinant falls any more; the start with the
smallest determinant wins. One pass over the statistics makes one step of all starts, with
partial sums on the map side, so a source that holds most rows costs no more per task than
others. Documents far out by Mahalanobis distance are rejected.

Cells with too few documents to estimate from (under eight for each statistic) are pooled per
language, then over all; ``cell`` tells which estimate judged a document. The cut-off is wider
for small cells, whose estimates are less certain.

Edge cases: null or empty texts have no words and fail the base rules; null language or
source is a value of its own; repeated rows count each; an empty table gives an empty
result; other columns pass through.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LETTERS, Workspace, code_points, join_measured, mix64, read, slices, span_hashes, text_chunks, word_spans

SYMBOLS = "#*$%&|<>"
WINDOW = 8
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_twins"]
#: The statistics' names and the least spread that each is given, in transformed units.
FLOORS = {"length": 0.3, "word_length": 0.15, "symbols": 0.05, "repeats": 0.15, "twins": 0.07, "capitals": 0.1}
P = len(FLOORS)
SUPPORT = 0.75
MIN_CELL = 8 * P
#: Starts of the concentration, most steps, and the fall of a log determinant that still counts as one.
STARTS, STEPS, FALL = 4, 15, 1e-3
#: Share of regular documents beyond the cut-off under normality.
TAIL = 1e-4

_upper = np.array([chr(i).isupper() for i in range(LETTERS)] + [False])
_symbol = np.isin(np.arange(LETTERS + 1), [ord(c) for c in SYMBOLS])


def repeated_words(words: list[str], k: int = WINDOW) -> int:
    """How many words stand in k-word windows that occur at least twice in the text."""
    seen: dict[tuple, int] = {}
    windows = list(zip(*(words[i:] for i in range(k))))
    for w in windows:
        seen[w] = seen.get(w, 0) + 1
    end = total = 0
    for i, w in enumerate(windows):
        if seen[w] > 1:
            total += i + k - max(end, i)
            end = i + k
    return total


def text_counts(texts: list) -> dict[str, np.ndarray]:
    """COUNTS of each whole text."""
    out = {c: np.zeros(len(texts), np.int64) for c in COUNTS}
    for first, chunk in text_chunks(texts):
        at = slice(first, first + len(chunk))
        cps, bounds = code_points(chunk)
        hashes, starts, ends, offsets = word_spans(chunk)
        out["n_words"][at] = np.diff(offsets)
        ids = np.minimum(cps, LETTERS)
        for name, values, edges in (("word_chars", ends - starts, offsets), ("n_symbols", _symbol[ids], bounds), ("n_upper", _upper[ids], bounds)):
            out[name][at] = np.diff(np.concatenate(([0], np.cumsum(values, dtype=np.int64)))[edges])
        twin = np.concatenate(([False], hashes[1:] == hashes[:-1])) if len(hashes) else np.zeros(0, bool)
        twin[offsets[:-1][np.diff(offsets) > 0]] = False
        out["n_twins"][at] = np.diff(np.concatenate(([0], np.cumsum(twin, dtype=np.int64)))[offsets])
        n = np.maximum(np.diff(offsets) - WINDOW + 1, 0)
        windows = np.repeat(offsets[:-1] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
        owner = np.repeat(np.arange(len(chunk)), n)
        keys = span_hashes(hashes, windows, windows + WINDOW) ^ mix64(owner.astype(np.uint64))
        _, inverse, count = np.unique(keys, return_inverse=True, return_counts=True)
        for i in np.unique(owner[count[inverse] > 1]):  # exact where hashes point to a repeat
            words = [chunk[i][a:b] for a, b in zip(starts[offsets[i] : offsets[i + 1]], ends[offsets[i] : offsets[i + 1]])]
            out["n_repeat_words"][first + i] = repeated_words(words)
        for i, t in enumerate(chunk):
            lines = [x for x in t.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
            out["n_dup_lines"][first + i] = len(lines) - len(set(lines))
    return out


@F.arrow_udf(T.StructType([T.StructField(c, T.LongType()) for c in COUNTS]))
def counts_udf(column: pa.Array) -> pa.Array:
    found = [text_counts(texts) for texts in slices(column)] or [text_counts([])]
    return pa.StructArray.from_arrays([pa.array(np.concatenate([f[c] for f in found])) for c in COUNTS], COUNTS)


def chi2_cdf(x: float, dof: int) -> float:
    """For even degrees of freedom."""
    term = total = 1.0
    for i in range(1, dof // 2):
        term *= x / 2 / i
        total += term
    return 1 - math.exp(-x / 2) * total


def chi2_quantile(p: float, dof: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_cdf(mid, dof) < p else (low, mid)
    return low


def transformed(counts: str) -> list:
    c = lambda name: F.col(f"{counts}.{name}").cast("double")
    share = lambda part, whole: F.asin(F.sqrt(F.least(c(part) / F.greatest(c(whole), F.lit(1.0)), F.lit(1.0))))
    return [
        F.log1p(c("n_words")), F.log1p(c("word_chars") / F.greatest(c("n_words"), F.lit(1.0))), share("n_symbols", "word_chars"),
        share("n_repeat_words", "n_words"), share("n_twins", "n_words"), share("n_upper", "word_chars"),
    ]


PARAMS = [f"m{i}" for i in range(P)] + [f"s{i}_{j}" for i in range(P) for j in range(i, P)]
MOMENTS = ["n", *(f"t{i}" for i in range(P)), *(f"q{i}_{j}" for i in range(P) for j in range(i, P))]


def distance():
    """Squared Mahalanobis distance of x0.. from m0.. under the inverse scatter s0_0.."""
    dev = [F.col(f"x{i}") - F.col(f"m{i}") for i in range(P)]
    terms = [(1 if i == j else 2) * F.col(f"s{i}_{j}") * dev[i] * dev[j] for i in range(P) for j in range(i, P)]
    return sum(terms[1:], terms[0])


def estimates(moments: DataFrame, factor: float) -> DataFrame:
    """Centre, inverse scatter and its log determinant of each cell and start from its sums; the spread has a floor."""
    floor = np.diag(np.array(list(FLOORS.values())) ** 2)

    def solve(batches):
        for pdf in batches:
            out = {c: [] for c in ["cell", "start", "logdet", *PARAMS]}
            for row in pdf.itertuples(index=False):
                mean = np.array([getattr(row, f"t{i}") for i in range(P)]) / row.n
                cov = np.zeros((P, P))
                for i in range(P):
                    for j in range(i, P):
                        cov[i, j] = cov[j, i] = getattr(row, f"q{i}_{j}") / row.n - mean[i] * mean[j]
                inverse = np.linalg.inv(factor * cov + floor)
                out["cell"].append(row.cell)
                out["start"].append(row.start)
                out["logdet"].append(-np.linalg.slogdet(inverse)[1])
                for i in range(P):
                    out[f"m{i}"].append(mean[i])
                    for j in range(i, P):
                        out[f"s{i}_{j}"].append(inverse[i, j])
            yield type(pdf)(out)

    return moments.mapInPandas(solve, "cell string, start int, logdet double, " + ", ".join(f"{c} double" for c in PARAMS))


def sums():
    x = [F.col(f"x{i}") for i in range(P)]
    return [F.count("*").alias("n"), *(F.sum(x[i]).alias(f"t{i}") for i in range(P)), *(F.sum(x[i] * x[j]).alias(f"q{i}_{j}") for i in range(P) for j in range(i, P))]


def quality_rules(
    df: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", support: float = SUPPORT,
    min_cell: int = MIN_CELL, starts: int = STARTS, steps: int = STEPS, tail: float = TAIL,
) -> DataFrame:
    """df with a struct column ``quality``: the counts, base_failed, distance (squared; null where none is estimated), cell (whose estimate it is) and kept."""
    ws = Workspace(df.sparkSession, "quality-rules")
    own = F.to_json(F.array(F.lit("own"), F.col(lang).cast("string"), F.col(source).cast("string")), {"ignoreNullFields": "false"})
    rest = [c for c in df.columns if c not in (text, "quality")]
    # the input's columns stay in one struct, so that none can clash with the names in here
    stats = df.select(F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in rest]).alias("_row"), F.col(lang).cast("string").alias("_lang"), own.alias("_own"), counts_udf(F.coalesce(F.col(text), F.lit(""))).alias("quality"))
    stats = stats.withColumns({f"x{i}": e for i, e in enumerate(transformed("quality"))})
    failed = (F.col("quality.n_words") < 20) | (100 * F.col("quality.n_repeat_words") > 30 * F.col("quality.n_words"))
    stats = ws.save(stats.withColumn("_failed", failed), "stats")

    cells = stats.where(~F.col("_failed")).groupBy("_own", "_lang").agg(F.count("*").alias("n"))
    enough = F.col("n") >= min_cell
    pooled = F.sum(F.when(~enough, F.col("n"))).over(Window.partitionBy("_lang"))
    cells = cells.select("_own", F.when(enough, F.col("_own")).when(pooled >= min_cell, F.to_json(F.array(F.lit("lang"), F.col("_lang").cast("string")))).otherwise("[\"all\"]").alias("cell"))
    cells = ws.save(cells, "cells")
    n_cells = cells.count()
    xs = [f"x{i}" for i in range(P)]
    good = join_measured(stats.where(~F.col("_failed")).select("_own", *xs), cells, "_own", "inner", n_cells).drop("_own")
    good = ws.save(good, "good")

    quartiles = good.groupBy("cell").agg(*[F.percentile_approx(x, [0.25, 0.5, 0.75], 1000).alias(x) for x in xs])
    start = {f"m{i}": F.col(f"x{i}")[1] for i in range(P)}
    for i, floor in enumerate(FLOORS.values()):
        for j in range(i, P):
            spread = (F.col(f"x{i}")[2] - F.col(f"x{i}")[0]) / 1.349
            start[f"s{i}_{j}"] = 1 / (spread * spread + floor**2) if i == j else F.lit(0.0)
    first = quartiles.select("cell", F.lit(0).alias("start"), F.lit(1e9).alias("logdet"), *[e.alias(k) for k, e in start.items()])
    # the other starts: some 4 P rows of each cell, drawn by a hash of their values
    sizes = ws.save(good.groupBy("cell").agg(F.count("*").alias("of")), "sizes")
    drawn = join_measured(good, sizes, "cell", "inner", n_cells).withColumn("start", F.explode(F.sequence(F.lit(1), F.lit(max(starts - 1, 1)))))
    drawn = drawn.where(F.pmod(F.xxhash64("start", *xs), F.greatest(F.lit(1), F.floor(F.col("of") / (4 * P)))) == 0)
    others = estimates(drawn.groupBy("cell", "start").agg(*sums()), 1.0).withColumn("logdet", F.lit(1e9))
    params = ws.save(first.unionByName(others).where(F.col("start") < starts), "params0")
    consistency = support / chi2_cdf(chi2_quantile(support, P), P + 2)
    bins = F.floor(16 * F.log2(F.greatest(F.col("d2"), F.lit(1e-4)))).cast("int")
    for step in range(steps):
        near = join_measured(good, params, "cell", "inner", n_cells * starts).withColumn("d2", distance())
        binned = near.withColumn("bin", bins).groupBy("cell", "start", "bin").agg(*sums())
        in_cell = Window.partitionBy("cell", "start")
        below = F.coalesce(F.sum("n").over(in_cell.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        core = binned.withColumns({"_below": below, "_all": F.sum("n").over(in_cell)}).where(F.col("_below") < support * F.col("_all"))
        core = core.groupBy("cell", "start").agg(*[F.sum(c).alias(c) for c in MOMENTS])
        before, params = params, ws.save(estimates(core, consistency), f"params{step + 1}")
        fallen = params.join(before.select("cell", "start", F.col("logdet").alias("before")), ["cell", "start"]).where(F.col("before") - F.col("logdet") > FALL)
        if fallen.isEmpty():
            break
    best = F.row_number().over(Window.partitionBy("cell").orderBy("logdet", "start"))
    params = params.withColumn("_best", best).where("_best = 1").drop("_best")
    cut = chi2_quantile(0.975, P)  # the usual reweighting: estimate again from all that isn't far out
    near = join_measured(good, params, "cell", "inner", n_cells).where(distance() <= cut)
    params = ws.save(estimates(near.groupBy("cell", "start").agg(*sums()), 0.975 / chi2_cdf(cut, P + 2)), "params")
    by_own = join_measured(cells, params.join(sizes, "cell"), "cell", "inner", n_cells)
    judged = join_measured(stats, by_own, "_own", "left", n_cells).withColumn("_d2", distance())
    wider = (F.col("of") + P) / F.greatest(F.col("of") - P, F.lit(1))
    kept = ~F.col("_failed") & (F.coalesce(F.col("_d2") / wider, F.lit(0.0)) <= chi2_quantile(1 - tail, P))
    quality = F.struct(*[F.col(f"quality.{c}").alias(c) for c in COUNTS], F.col("_failed").alias("base_failed"), F.col("_d2").alias("distance"), F.col("cell").alias("cell"), kept.alias("kept"))
    return judged.withColumn("quality", quality).select(*[F.col("_row").getField(c).alias(c) for c in rest], "quality")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return quality_rules(docs).select("doc_id", *[f"quality.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance", "cell")])
