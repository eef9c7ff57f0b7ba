"""Mixing sources to target weights by entropy balancing.

Among all ways to weight documents so that every source contributes its target number of
tokens, entropy balancing takes the one nearest (in relative entropy) to using each
document once, with at most ``cap`` uses. The solution is an exponential tilt,
rate = min(cap, exp(lambda * size / mean size)), and the convex dual has one lambda per
source, found by Newton steps (kept inside a bracket). A document enters the dual only by
its source and size, so each step sums over the exact histogram of sizes instead of over
documents. Rates become whole copies by cumulative rounding along the sizes of a source;
what is left between a source and its target is closed by moving single copies.

All of it is DataFrame operations.

Edge cases: a null text has size 0; size 0 documents are never taken; null is a source of its
own, after all others; ``cap`` times a source bounds its target; repeated rows count each; an
empty table gives an empty result. Reruns agree: ranks are by hash and id. Other columns pass
through unless they clash with an output column.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD_PATTERN, Workspace, join_measured, read

WEIGHTS = (5, 2, 1)
SHARE = 1.5
CAP = 2
STEPS = 25
TOLERANCE = 1e-7
#: Documents of one source and size that a single task ranks, about.
RANKED = 2048


def targets(sources: DataFrame, weights, share: float, cap: int) -> DataFrame:
    """_s, source_size and target: shares by weight, filled up to the cap of each source."""
    everything = Window.partitionBy()
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    place = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1
    weighed = sources.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), place.cast("int")))
    weighed = weighed.withColumns({"room": cap * F.col("source_size") / F.col("w"), "total": share * F.sum("source_size").over(everything)})
    rising = Window.orderBy("room", "_s")
    filled = F.coalesce(F.sum(cap * F.col("source_size")).over(rising.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = F.sum("w").over(rising.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    weighed = weighed.withColumn("level", (F.col("total") - filled) / left)
    level = F.min_by(F.when(F.col("level") <= F.col("room"), F.col("level")), F.when(F.col("level") <= F.col("room"), F.col("room"))).over(everything)
    most = (cap * F.col("source_size")).cast("double")
    return weighed.withColumn("target", F.coalesce(F.least(most, level * F.col("w")), most)).select("_s", "source_size", "target")


def exact(x):
    """A sum that doesn't depend on the order of rows."""
    return F.sum(x.cast("decimal(38,6)")).cast("double")


def solve_dual(ws: Workspace, hist: DataFrame, sources: DataFrame, n_sources: int, cap: int, steps: int) -> DataFrame:
    """_s and lam: Newton steps on the logarithm of each source's tokens, bisecting where a step leaves its bracket."""
    top = math.log(cap)
    state = sources.select(
        "_s", "target", "mean", F.lit(0.0).alias("lam"), (-60 * F.col("mean")).alias("low"), (top * F.col("mean")).alias("high"),
        ((F.col("target") <= 0) | (F.col("target") >= cap * F.col("source_size"))).alias("done"))
    state = state.withColumn("lam", F.when(F.col("target") <= 0, F.col("low")).when(F.col("done"), F.col("high")).otherwise(0.0))
    state = ws.save(state, "dual0")
    for step in range(steps):
        z = F.col("size") / F.col("mean")
        tokens = F.col("n") * F.col("size") * F.exp(F.least(F.col("lam") * z, F.lit(top)))
        slope = F.when(F.col("lam") * z < top, tokens * z).otherwise(0.0)
        sums = join_measured(hist, state.where("NOT done"), "_s", "inner", n_sources).groupBy("_s").agg(exact(tokens).alias("g"), exact(slope).alias("h"))
        state = join_measured(state, sums, "_s", "left", n_sources)
        under = F.col("g") < F.col("target")
        low, high = F.when(under, F.col("lam")).otherwise(F.col("low")), F.when(under, F.col("high")).otherwise(F.col("lam"))
        newton = F.col("lam") - F.ln(F.col("g") / F.col("target")) * F.try_divide(F.col("g"), F.col("h"))
        inside = (F.col("g") > 0) & (newton > low) & (newton < high)
        moved = F.when(F.coalesce(inside, F.lit(False)), newton).otherwise((low + high) / 2)
        done = F.col("done") | (F.abs(F.col("g") - F.col("target")) <= TOLERANCE * F.col("target"))
        state = state.select("_s", "target", "mean", F.when(done, F.col("lam")).otherwise(moved).alias("lam"), F.when(F.col("done"), F.col("low")).otherwise(low).alias("low"), F.when(F.col("done"), F.col("high")).otherwise(high).alias("high"), done.alias("done"))
        state = ws.save(state, f"dual{step + 1}")
        ws.drop(f"dual{step}")
        if state.where("NOT done").isEmpty():
            break
    return state.select("_s", "lam")


def round_copies(ws: Workspace, hist: DataFrame, sources: DataFrame, n_sources: int, cap: int, repairs: int = 4) -> DataFrame:
    """hist with copies: whole copies for all documents of a source and size together."""
    along = Window.partitionBy("_s").orderBy(F.col("size").desc())
    run = F.sum(F.col("n") * F.col("rate")).over(along.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    hist = hist.withColumn("_run", F.round(run)).withColumn("copies", F.col("_run") - F.coalesce(F.lag("_run").over(along), F.lit(0.0)))
    hist = hist.withColumn("copies", F.greatest(F.lit(0), F.least(F.col("copies").cast("long"), cap * F.col("n")))).drop("_run")
    hist = ws.save(hist, "rounded0")
    for i in range(repairs):
        gap = hist.groupBy("_s").agg((F.first("target") - F.sum(F.col("copies") * F.col("size"))).alias("gap"))
        open_ = join_measured(hist, gap, "_s", "inner", n_sources)
        room = (F.col("size") > 0) & F.when(F.col("gap") > 0, F.col("copies") < cap * F.col("n")).otherwise(F.col("copies") > 0)
        miss = F.abs(F.abs("gap") - F.col("size"))
        best = open_.where(room & (miss < F.abs("gap"))).groupBy("_s").agg(F.min(F.struct(miss.alias("miss"), F.col("size"))).alias("best"), F.first("gap").alias("gap"))
        move = best.select("_s", F.col("best.size").alias("_size"), F.signum("gap").cast("long").alias("_move"))
        moved = F.col("copies") + F.when(F.col("size") == F.col("_size"), F.col("_move")).otherwise(0)
        hist = ws.save(join_measured(hist, move, "_s", "left", n_sources).withColumn("copies", moved).drop("_size", "_move"), f"rounded{i + 1}")
        ws.drop(f"rounded{i}")
    return hist


def mix_sources(
    df: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", weights=WEIGHTS, share: float = SHARE, cap: int = CAP, steps: int = STEPS, keep_text: bool = False,
) -> DataFrame:
    """df (its text only if asked for) with size, source_size, target, rate, copies and taken."""
    ws = Workspace(df.sparkSession, "source-mixing")
    made = ("size", "source_size", "target", "rate", "copies", "taken")
    rest = [c for c in df.columns if c != text and c not in made]
    whole = [c for c in df.columns if c not in made] if keep_text else []
    key = F.coalesce(F.concat(F.lit("v"), F.col(source)), F.lit("n"))  # joins treat null as a value
    # the input's columns stay in one struct, so that none can clash with the names in here
    docs = df.select(F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in whole or rest]).alias("_row"), F.col(doc_id).alias("_id"), key.alias("_s"), F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long").alias("size"), F.xxhash64(doc_id).alias("_h"))
    if keep_text:  # the texts wait in the saved table; only ids and sizes are shuffled until the copies are known
        texts = ws.save(docs.select("*", F.monotonically_increasing_id().alias("_uid")), "sizes")
        docs = texts.select("_id", "_s", "size", "_h", "_uid")
    else:
        docs = ws.save(docs, "sizes")
    hist = ws.save(docs.groupBy("_s", "size").agg(F.count("*").alias("n")), "histogram")
    sources = hist.groupBy("_s").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("n_docs"))
    sources = sources.withColumn("source", F.when(F.col("_s") != "n", F.substring("_s", 2, 1 << 30)))
    mean = F.greatest(F.col("source_size") / F.col("n_docs"), F.lit(1e-9))
    sources = ws.save(targets(sources, weights, share, cap).join(sources.select("_s", mean.alias("mean")), "_s"), "sources")
    n_sources = sources.count()
    duals = solve_dual(ws, hist, sources, n_sources, cap, steps)
    ws.release()
    hist = join_measured(hist, sources.join(duals, "_s"), "_s", "inner", n_sources)
    hist = hist.withColumn("rate", F.exp(F.least(F.col("lam") * F.col("size") / F.col("mean"), F.lit(math.log(cap))))).withColumn("rate", F.when(F.col("size") > 0, F.col("rate")).otherwise(0.0))
    hist = round_copies(ws, hist, sources, n_sources, cap).select("_s", "size", "n", "source_size", "target", "rate", "copies")

    # each document of a source and size gets the floor of the copies; the rest go by hash rank,
    # in parts small enough that a size which holds most rows is ranked by many tasks
    docs = join_measured(docs, hist, ["_s", "size"], "inner", hist.count())
    docs = docs.withColumns({"_part": F.pmod(F.col("_h"), F.ceil(F.col("n") / RANKED)), "_extra": F.pmod(F.col("copies"), F.col("n"))})
    parts = docs.groupBy("_s", "size", "_part").agg(F.count("*").alias("_c"), F.first("n").alias("_n"), F.first("_extra").alias("_e"))
    before = F.sum("_c").over(Window.partitionBy("_s", "size").orderBy("_part")) - F.col("_c")
    parts = parts.withColumn("_before", before)
    given = F.floor(F.col("_e") * (F.col("_before") + F.col("_c")) / F.col("_n")) - F.floor(F.col("_e") * F.col("_before") / F.col("_n"))
    docs = docs.join(parts.select("_s", "size", "_part", given.alias("_given")), ["_s", "size", "_part"])
    rank = F.row_number().over(Window.partitionBy("_s", "size", "_part").orderBy("_h", "_id"))
    copies = (F.floor(F.col("copies") / F.col("n")) + F.when(rank <= F.col("_given"), 1).otherwise(0)).cast("long")
    docs = docs.withColumn("copies", copies).withColumn("taken", F.col("copies") * F.col("size"))
    if keep_text:
        return texts.drop("size").join(docs.select("_uid", *made), "_uid").select(*[F.col("_row").getField(c).alias(c) for c in whole], *made)
    return docs.select(*[F.col("_row").getField(c).alias(c) for c in rest], *made)


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix_sources(docs).select("doc_id", "size", "source_size", "target", "taken", "copies", "rate")
