"""Multinomial resampling of counted distinct values.

A bootstrap replicate of n rows draws each distinct value a number of times, and these numbers are
multinomial. So a replicate needs work for each distinct value, not for each row: the draws of a
node of a binary tree over the values, in order, are split between its halves by a binomial number,
down to single values. The number is the inverse of the binomial distribution at a uniform number,
which is a word of ``sha256(seed|group|replicate div 4|size|place)``, size and place naming the node;
so a rerun on any cluster, and any other engine, draws the same.

The values of a group are numbered by a distributed row number and cut into at most ``BLOCKS``
blocks of a power of two; a task has one block and walks down to it from the root through the
blocks' totals, which are as many numbers. Nothing depends on how Spark deals the rows.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.operators.sampling import numbered
from loomspark.sources.work import Work

#: Blocks of a group at most, and values of a block at least.
BLOCKS, BLOCK = 4096, 4096
#: Standard deviations (and values) about the mean beyond which a binomial number has no weight in doubles.
FAR = 10


_small = np.concatenate(([0.0], np.cumsum(np.log(np.arange(1, 1024)))))


def log_factorial(x: np.ndarray) -> np.ndarray:
    """ln(x!) of whole numbers: a table, and Stirling's series from 1024 on."""
    big = np.maximum(x, 1024).astype(float)
    series = big * np.log(big) - big + 0.5 * np.log(2 * math.pi * big) + 1 / (12 * big) - 1 / (360 * big**3)
    return np.where(x < 1024, _small[np.minimum(x, 1023)], series)


def binomial(n: np.ndarray, p: float, u: np.ndarray) -> np.ndarray:
    """The smallest k at which the binomial distribution of n[i] trials at p reaches u[i]."""
    out = np.zeros(len(n), np.int64)
    if p <= 0:
        return out
    if p >= 1:
        return n.astype(np.int64)
    for trials in np.unique(n) if len(np.unique(n)) < 8 else [None]:  # draws of the root share their number of trials
        rows = np.flatnonzero(n == trials) if trials is not None else np.arange(len(n))
        for at in range(0, len(rows), 256) if trials is None else [0]:
            part = rows[at : at + 256] if trials is None else rows
            m = (n[part] if trials is None else np.array([trials])).astype(float)
            far = FAR * np.sqrt(m * p * (1 - p)) + FAR
            low, high = np.maximum(0, np.floor(m * p - far)), np.minimum(m, np.ceil(m * p + far))
            k = low[:, None] + np.arange(int((high - low).max()) + 1)
            inside = np.minimum(k, m[:, None]).astype(np.int64)
            whole = m.astype(np.int64)[:, None]
            weight = np.exp(log_factorial(whole) - log_factorial(inside) - log_factorial(whole - inside) + inside * math.log(p) + (whole - inside) * math.log1p(-p))
            chance = np.cumsum(np.where(k <= high[:, None], weight, 0), axis=1)
            chance /= chance[:, -1:]
            below = np.searchsorted(chance[0], u[part]) if trials is not None else (chance < u[part, None]).sum(axis=1)
            out[part] = np.minimum(low.astype(np.int64) + below, high.astype(np.int64))
    return out


def uniforms(seed: int, group: str, reps: np.ndarray, node: str) -> np.ndarray:
    """A number in (0, 1) for each replicate at a node: 52 bits, four replicates to a hash."""
    words = {b: hashlib.sha256(f"{seed}|{group}{b}|{node}".encode()).hexdigest() for b in np.unique(reps // 4).tolist()}
    return np.array([(int(words[r // 4][16 * (r % 4) : 16 * (r % 4) + 13], 16) + 0.5) / 2.0**52 for r in reps.tolist()])


def split(draws: np.ndarray, left: int, whole: int, seed: int, group: str, node: str) -> np.ndarray:
    """How many of a node's draws, per replicate, go to its left half."""
    if left <= 0 or left >= whole:
        return draws * (left > 0)
    out = np.zeros_like(draws)
    some = np.flatnonzero(draws)
    if len(some):
        out[some] = binomial(draws[some], left / whole, uniforms(seed, group, some, node))
    return out


def block_draws(totals: np.ndarray, block: int, size: int, samples: int, seed: int, group: str) -> np.ndarray:
    """Draws per replicate of a block of ``size`` values, from the root through the blocks' totals."""
    prefix = np.concatenate(([0], np.cumsum(totals)))
    total = lambda a, b: int(prefix[min(b, len(totals))] - prefix[min(a, len(totals))])
    draws, start, width = np.full(samples, prefix[-1], np.int64), 0, 1 << max(0, len(totals) - 1).bit_length()
    while width > 1:
        half = width // 2
        left = split(draws, total(start, start + half), total(start, start + width), seed, group, f"{width * size}|{start // width}")
        draws, start = (left, start) if block < start + half else (draws - left, start + half)
        width = half
    return draws


def value_draws(counts: np.ndarray, draws: np.ndarray, block: int, size: int, seed: int, group: str):
    """(place in the block, draws per replicate) of each value of a block."""
    prefix = np.concatenate(([0], np.cumsum(counts)))
    total = lambda a, b: int(prefix[min(b, len(counts))] - prefix[min(a, len(counts))])
    stack = [(0, size, draws)]
    while stack:
        start, width, here = stack.pop()
        if start >= len(counts) or not here.any():
            continue
        if width == 1:
            yield start, here
            continue
        half = width // 2
        left = split(here, total(start, start + half), total(start, start + width), seed, group, f"{width}|{(block * size + start) // width}")
        stack += [(start + half, half, here - left), (start, half, left)]


def counted(values: DataFrame, by: str | None) -> DataFrame:
    """by (a string, empty without one), idx from 0, value and c: the distinct values of each group in order, and how often they stand.
    A column ``c`` of the values says how often each row stands."""
    group = F.col(by).cast("string") if by else F.lit("")
    times = F.col("c") if "c" in values.columns and by != "c" else F.lit(1)
    counts = values.where("value IS NOT NULL").select(group.alias("by"), F.col("value").cast("double").alias("value"), times.cast("long").alias("c")).groupBy("by", "value").agg(F.sum("c").alias("c"))
    return numbered(counts, ["value"], "by")


def replicates(values: DataFrame, samples: int, seed: int, by: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Of (by, value): each group's mean and n, and (by, rep, mean) of each replicate. Groups appear as strings in ``by``."""
    work = Work(values.sparkSession, "resampling")
    counts = work.save(counted(values, by), "counts")
    known = counts.groupBy("by").agg((F.sum(F.col("value") * F.col("c")) / F.sum("c")).alias("mean"), F.sum("c").alias("n"), F.count("*").alias("m"))
    size = F.pow(F.lit(2.0), F.greatest(F.lit(math.log2(BLOCK)), F.ceil(F.log2(F.col("m"))) - math.log2(BLOCKS))).cast("long")
    sized = known.select("by", size.alias("size"))
    rows = counts.join(sized, "by").withColumn("block", F.expr("idx DIV size"))
    totals = rows.groupBy("by", "block", "size").agg(F.sum("c").alias("total"))
    blocks = totals.groupBy("by").agg(F.transform(F.array_sort(F.collect_list(F.struct("block", "total"))), lambda x: x["total"]).alias("totals"))
    blocks = totals.select("by", "block", "size").join(blocks, "by").select(F.col("by").alias("of"), F.col("block").alias("at"), F.col("size").alias("wide"), "totals")

    def draw(key, left: pa.Table, right: pa.Table) -> pa.Table:
        group, block = key[0].as_py(), key[1].as_py()
        left = left.sort_by("idx")
        size, totals = right["wide"][0].as_py(), np.array(right["totals"][0].as_py(), np.int64)
        prefix = f"{group}|" if by else ""
        draws = block_draws(totals, block, size, samples, seed, prefix)
        value, sums = left["value"].to_numpy(), np.zeros(samples)
        for place, times in value_draws(left["c"].to_numpy(), draws, block, size, seed, prefix):
            sums += value[place] * times
        return pa.table({"by": pa.array([group] * samples), "rep": pa.array(np.arange(samples)), "part": pa.array(sums)})

    drawn = rows.groupBy("by", "block").cogroup(blocks.groupBy("of", "at")).applyInArrow(draw, "by string, rep long, part double")
    means = drawn.groupBy("by", "rep").agg(F.sum("part").alias("total")).join(known.select("by", "n"), "by").select("by", "rep", (F.col("total") / F.col("n")).alias("mean"))
    return known.select("by", "mean", "n"), means


def flipped(values: DataFrame, samples: int, seed: int, by: str) -> tuple[DataFrame, DataFrame]:
    """As ``replicates``, of means under random signs: of c equal values a binomial number keeps its sign."""
    work = Work(values.sparkSession, "resampling")
    counts = work.save(counted(values, by), "counts")
    known = counts.groupBy("by").agg((F.sum(F.col("value") * F.col("c")) / F.sum("c")).alias("mean"), F.sum("c").alias("n"))

    def flip(batches):
        for batch in batches:
            sums: dict[str, np.ndarray] = {}
            for group, idx, value, c in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                kept = binomial(np.full(samples, c), 0.5, uniforms(seed, f"flip|{group}|", np.arange(samples), str(idx)))
                sums[group] = sums.get(group, 0) + value * (2 * kept - c)
            for group, total in sums.items():
                yield pa.RecordBatch.from_arrays([pa.array([group] * samples), pa.array(np.arange(samples)), pa.array(total)], ["by", "rep", "part"])

    drawn = counts.select("by", "idx", "value", "c").mapInArrow(flip, "by string, rep long, part double")
    means = drawn.groupBy("by", "rep").agg(F.sum("part").alias("total")).join(known.select("by", "n"), "by").select("by", "rep", (F.col("total") / F.col("n")).alias("mean"))
    return known.select("by", "mean", "n"), means


# --- the same in DuckDB SQL -------------------------------------------------------------


def binomial_sql(source: str, keys: str, u: str) -> str:
    """(keys, k) of a CTE with keys, n, p and u's inputs: the inverse binomial distribution at u."""
    far = f"{FAR} * sqrt(n * p * (1 - p)) + {FAR}"
    window = f"SELECT *, {u} AS u, greatest(0, floor(n * p - ({far})))::bigint AS low, least(n, ceil(n * p + {far}))::bigint AS high FROM {source} WHERE n > 0 AND p > 0 AND p < 1"
    each = f"SELECT *, exp(lgamma(n + 1.0::double) - lgamma(k + 1.0::double) - lgamma(n - k + 1.0::double) + k * ln(p) + (n - k) * ln(1 - p)) AS w FROM (SELECT *, unnest(range(low, high + 1)) AS k FROM ({window}))"
    below = f"SELECT {keys}, u, low, high, sum(w) OVER (PARTITION BY {keys} ORDER BY k) AS chance FROM ({each})"
    return (
        f"SELECT {keys}, least(low + count(*) FILTER (chance < u), high) AS k FROM ({below}) GROUP BY {keys}, low, high "
        f"UNION ALL SELECT {keys}, CASE WHEN p >= 1 THEN n ELSE 0 END FROM {source} WHERE NOT (n > 0 AND p > 0 AND p < 1)")  # fmt: skip


def uniform_sql(text: str) -> str:
    """text: the hashed string with ``rep // 4`` in it."""
    return f"(('0x' || substr(sha256({text}), (16 * (rep % 4) + 1)::int, 13))::bigint + 0.5) / 4503599627370496.0::double"


def replicates_sql(name: str, key: str, samples: int, levels: int, seed: int = 3407) -> str:
    """CTEs from ``{name}`` (cell, value) to ``{name}_means`` (cell, rep, mean): up to 2**levels distinct values a group. key '' has one group."""
    group = f"{key}::varchar" if key else "''"
    prefix = f"'{seed}|' || {'cell || ' + repr('|') + ' || ' if key else ''}(rep // 4)"
    parts = [f"{name}_c AS (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY value) - 1 AS idx FROM (SELECT {group} AS cell, value::double AS value, count(*) AS c FROM {name} GROUP BY ALL))",
             f"{name}_{levels} AS (SELECT cell, rep, 0 AS pos, sum(c)::bigint AS n FROM {name}_c, range({samples}) t(rep) GROUP BY cell, rep)"]
    for level in range(levels, 0, -1):
        size = 1 << level
        total = f"SELECT cell, idx // {size} AS pos, sum(c) FILTER (idx % {size} < {size // 2}) AS l, sum(c) AS t FROM {name}_c GROUP BY ALL"
        parts.append(f"{name}_s{level} AS (SELECT cell, rep, pos, n, coalesce(l, 0)::double / t::double AS p FROM {name}_{level} JOIN ({total}) USING (cell, pos))")
        parts.append(f"{name}_k{level} AS ({binomial_sql(f'{name}_s{level}', 'cell, rep, pos', uniform_sql(f"{prefix} || '|{size}|' || pos"))})")
        parts.append(f"{name}_{level - 1} AS (SELECT cell, rep, 2 * pos + h AS pos, CASE h WHEN 0 THEN k ELSE n - k END AS n FROM {name}_s{level} JOIN {name}_k{level} USING (cell, rep, pos), range(2) t(h) WHERE CASE h WHEN 0 THEN k ELSE n - k END > 0)")
    parts.append(f"{name}_means AS (SELECT cell, rep, sum(n * value) / any_value(whole) AS mean FROM {name}_0 d JOIN {name}_c c USING (cell) JOIN (SELECT cell, sum(c) AS whole FROM {name}_c GROUP BY cell) USING (cell) WHERE c.idx = d.pos GROUP BY cell, rep)")
    return ", ".join(parts)


def flipped_sql(name: str, key: str, samples: int, seed: int = 3407) -> str:
    """CTEs from ``{name}`` (cell, value) to ``{name}_flips`` (cell, rep, mean)."""
    text = f"'{seed}|flip|' || cell || '|' || (rep // 4) || '|' || idx"
    return (
        f"{name}_c AS (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY value) - 1 AS idx FROM (SELECT {key}::varchar AS cell, value::double AS value, count(*) AS c FROM {name} GROUP BY ALL)), "
        f"{name}_s AS (SELECT cell, idx, value, rep, c AS n, 0.5::double AS p FROM {name}_c, range({samples}) t(rep)), {name}_k AS ({binomial_sql(f'{name}_s', 'cell, idx, rep', uniform_sql(text))}), "
        f"{name}_flips AS (SELECT cell, rep, sum(value * (2 * k - n)) / sum(n) AS mean FROM {name}_s JOIN {name}_k USING (cell, idx, rep) GROUP BY cell, rep)")  # fmt: skip
