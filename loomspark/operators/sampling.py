"""Seeded order, caps, splits, mixes and replication, all by hashes of row keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspark.functions.text import SEED, hash8, hash_order
from loomspark.sources.work import Work

# Default shares of source categories.
DEFAULT_WEIGHTS = {"code": 0.55, "repo": 0.30, "reasoning": 0.15}


def parse_weights(text: str, default: dict[str, float] = DEFAULT_WEIGHTS) -> dict[str, float]:
    """``name:share`` pairs over the defaults, clamped to 0 and normalised; malformed pairs are passed over."""
    found = dict(default)
    for part in (text or "").split(","):
        name, colon, value = part.partition(":")
        try:
            found.update({name.strip().lower(): float(value)} if colon else {})
        except ValueError:
            pass
    total = sum(max(0.0, v) for v in found.values())
    return {k: max(0.0, v) / total for k, v in found.items()} if total > 0 else dict(default)


def seeded(key, seed: int = SEED) -> Column:
    return hash_order(F.lit(seed), key)


def cap_per_key(df: DataFrame, by: str, cap: int, row_key: str, seed: int = SEED) -> DataFrame:
    """At most cap rows of each key, by hash order; no cap if it isn't positive."""
    if cap <= 0:
        return df
    rank = F.row_number().over(Window.partitionBy(by).orderBy(seeded(row_key, seed), row_key))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= cap).drop("_rank")


def head(df: DataFrame, n: int, order: str) -> DataFrame:
    """The first n rows by the arrival order: a top-n, never a full sort."""
    return df.orderBy(order).limit(n)


def head_per_source(df: DataFrame, source: str, n: int, order: str) -> DataFrame:
    """The first n rows of each source in order of arrival; the limit reaches below the shuffle."""
    rank = F.row_number().over(Window.partitionBy(source).orderBy(order))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")


def shuffled_head(df: DataFrame, n: int, row_key: str, seed: int = SEED) -> DataFrame:
    """n rows by hash order, if n is positive."""
    return df.orderBy(seeded(row_key, seed), row_key).limit(n) if n > 0 else df


def hash_split(key: Column, holdout: float = 0.10, val: float = 0.05) -> Column:
    """holdout, val or train by the key's hash modulo 1000; shares are kept within 0.01 to 0.5 and 0.4."""
    h = max(1, int(1000 * min(max(holdout, 0.01), 0.5)))
    v = max(1, int(1000 * min(max(val, 0.01), 0.4)))
    bucket = hash8(key) % 1000
    return F.when(bucket < h, "holdout").when(bucket < h + v, "val").otherwise("train")


def overlapping_keys(df: DataFrame, key: Column, split: str = "split") -> DataFrame:
    """Keys found in more than one split: one pass instead of pairwise intersections."""
    return df.groupBy(key.alias("key")).agg(F.countDistinct(split).alias("n_splits")).where("n_splits > 1")


def category_quotas(counts: dict[str, int], weights: dict[str, float], budget: int | None = None) -> dict[str, int]:
    """Rows to take of each category. Without a budget the leftover refills every category to its full size."""
    total = sum(counts.values())
    goal = total if budget is None else min(budget, total)
    quotas = {c: min(counts[c], int(goal * weights.get(c, 0.0))) for c in sorted(counts)}
    left = goal - sum(quotas.values())
    while left > 0:
        open_ = [c for c in quotas if quotas[c] < counts[c]]
        if not open_:
            break
        each = max(1, min(left // len(open_), min(counts[c] - quotas[c] for c in open_)))
        for c in open_:
            if left <= 0:
                break
            step = min(each, left)
            quotas[c] += step
            left -= step
    return quotas


def mix_by_category(df: DataFrame, category: str, weights: dict[str, float], row_key: str, seed: int = SEED, budget: int | None = None) -> DataFrame:
    """Rows of each category by hash order up to its quota; counts of the few categories come to the driver."""
    counts = {r[0]: r[1] for r in df.groupBy(category).count().collect()}
    if not counts:
        raise ValueError("no rows to mix")
    quotas = category_quotas(counts, weights, budget)
    if all(quotas[c] == counts[c] for c in counts):
        return df
    quota = F.create_map(*[F.lit(x) for kv in quotas.items() for x in kv])
    return first_of_each(df, category, [seeded(row_key, seed), F.col(row_key)], quota[F.col(category)])


def share_cap(df: DataFrame, by: str, share: float, score: str, order: str, total: int | None = None) -> DataFrame:
    """At most share of all rows (one at least) of each key, hardest first; total: the share's base where it isn't df's own size."""
    if share <= 0 or share >= 1:
        return df
    n = df.count() if total is None else total
    return first_of_each(df, by, [-F.col(score), F.col(order)], F.lit(max(1, int(n * share))))


def replicate(df: DataFrame, copies: Column, number: str = "copy") -> DataFrame:
    return df.withColumn(number, F.explode(F.sequence(F.lit(1), copies)))


def order_statistics(df: DataFrame, value: str, places: dict[str, Column], by: list[str] | None = None) -> DataFrame:
    """Exact order statistics: values at 0-based places computed from n (and the keys); null where there are fewer.

    Distinct values are counted and dealt by ranges of keys and value, each range is ranked alone, and the ranges'
    totals (one row per range and key) say how many values come before. So no task sorts a whole key.
    """
    keys = by or []
    counts = df.groupBy(*keys, F.col(value).alias("v")).agg(F.count("*").alias("c"))
    ranged = counts.repartitionByRange(*keys, "v").withColumn("_range", F.spark_partition_id())
    counts = Work(df.sparkSession, "order-statistics").save(ranged, "counts")
    totals = counts.groupBy("_range", *keys).agg(F.sum("c").alias("_t"))
    whole = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    before = F.coalesce(F.sum("_t").over(whole.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    totals = totals.select("_range", *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], before.alias("_before"), F.sum("_t").over(whole).alias("n"))
    same = F.col("_range") == F.col("_r")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    rows = counts.join(totals.withColumnRenamed("_range", "_r"), same)
    rows = rows.withColumn("upto", F.col("_before") + F.sum("c").over(Window.partitionBy("_range", *keys).orderBy("v")))
    at = {name: F.min(F.when(F.col("upto") > place, F.col("v"))).alias(name) for name, place in places.items()}
    return rows.groupBy(*keys).agg(*at.values(), F.first("n").alias("n"))


def numbered(df: DataFrame, order: list, by: str | None = None, name: str = "idx") -> DataFrame:
    """df with each row's number, from 0, in an order without ties: of all rows, or within ``by``.

    Rows are dealt by ranges of the key and the order, sorted there and written once with their place in the range; the
    ranges' totals (one row per range and key) say how many rows come before. So no task has more than a range, whatever
    holds most rows, and rows are shuffled and sorted once.
    """
    keys = [by] if by else []
    ranged = df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order).withColumn("_place", F.monotonically_increasing_id())
    ranged = Work(df.sparkSession, "numbered").save(ranged, "ranges")
    range_of = F.shiftright("_place", 33)
    totals = ranged.groupBy(range_of.alias("_r"), *[F.col(k).alias("_k") for k in keys]).agg(F.count("*").alias("_t"), F.min("_place").alias("_first"))
    before = (Window.partitionBy(*["_k"] * len(keys)) if keys else Window.partitionBy(F.lit(0))).orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("_before", F.coalesce(F.sum("_t").over(before), F.lit(0))).drop("_t")
    same = range_of == F.col("_r")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col("_k"))
    # without a key there is one total a range
    rows = ranged.join(totals if keys else F.broadcast(totals), same)
    return rows.withColumn(name, F.col("_before") + F.col("_place") - F.col("_first")).drop("_place", "_r", "_k", "_first", "_before")


def first_of_each(df: DataFrame, by: str | None, order: list[Column], most: Column) -> DataFrame:
    """The first ``most`` rows (a column of the key, n and whatever df's rows of a key agree in) of each key by an order without ties.

    The last place's value is found by ranges, then rows are compared with it: a key that holds most rows is never sorted in one task.
    """
    placed = df.withColumn("_place", F.struct(*[c.alias(f"_{i}") for i, c in enumerate(order)]))
    keys = [by] if by else []
    cuts = order_statistics(placed, "_place", {"_cut": most - 1}, keys)
    cuts = cuts.select(*[F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)], "_cut", most.alias("_most"))
    if by:
        placed = placed.join(cuts, F.col(by).eqNullSafe(F.col("_key0"))).drop("_key0")
    else:
        placed = placed.crossJoin(F.broadcast(cuts))
    kept = (F.col("_most") > 0) & (F.col("_cut").isNull() | (F.col("_place") <= F.col("_cut")))
    return placed.where(kept).drop("_place", "_cut", "_most")


def gap_copies(df: DataFrame, weight: str, most: float = 4.0) -> DataFrame:
    """Each row as many times as its weight over the upper median says: 1 to most, halves to even."""
    weights = df.withColumn("_w", F.greatest(F.lit(0.1), F.col(weight)))
    median = order_statistics(weights, "_w", {"_m": F.floor(F.col("n") / 2)}).drop("n")
    rate = F.least(F.lit(most), F.greatest(F.lit(1.0), F.col("_w") / F.greatest(F.lit(0.1), F.col("_m"))))
    return replicate(weights.crossJoin(F.broadcast(median)), F.bround(rate).cast("int")).drop("_w", "_m")


def upsample(df: DataFrame, priority: Column, boost: float, row_key: str, seed: int = SEED) -> DataFrame:
    """Priority rows again: whole cycles of all of them, then the first by hash order, round((boost - 1) * n) in all."""
    chosen = df.where(priority)
    n = chosen.count()
    extra = round((boost - 1.0) * n)
    out = df.withColumn("copy", F.lit(0))
    cycles, rest = divmod(extra, n) if n else (0, 0)
    if cycles > 0:
        out = out.unionByName(replicate(chosen, F.lit(cycles)))
    if rest > 0:
        out = out.unionByName(first_of_each(chosen, None, [seeded(row_key, seed), F.col(row_key)], F.lit(rest)).withColumn("copy", F.lit(cycles + 1)))
    return out


def eval_size(n: int, fraction: float) -> int:
    """Rows to evaluate on: none below 200."""
    return 0 if n < 200 else max(50, min(int(n * min(max(fraction, 0.02), 0.2)), n - 1))


def train_eval_split(df: DataFrame, fraction: float, row_key: str, seed: int = SEED) -> DataFrame:
    """df with split: the first rows by hash order are eval. The cut is one key, found by ranges."""
    n = eval_size(df.count(), fraction)
    if not n:
        return df.withColumn("split", F.lit("train"))
    here = F.struct(seeded(row_key, seed).alias("_h"), F.col(row_key).alias("_k"))
    cut = order_statistics(df.select(here.alias("_here")), "_here", {"_cut": F.lit(n - 1)}).select("_cut")
    return df.crossJoin(F.broadcast(cut)).withColumn("split", F.when(here <= F.col("_cut"), "eval").otherwise("train")).drop("_cut")
