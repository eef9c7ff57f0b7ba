"""N-gram Jaccard join: MinHash bands find candidates, full n-gram sets verify them.

Documents with the same set of word n-grams are one class from the start, so copies are
never compared. Each class gets a MinHash signature cut into bands; the numbers of bands
and rows are chosen for a target recall at the threshold. Classes that share a band hash
are tied to the smallest of them (never to each other), the ties' components are the
candidate groups, and every pair inside a group is verified on its full sets. A large
group is cut into tiles and each pair of tiles is a task of its own; tasks return numbers
of links and a spanning forest of the verified pairs, never the pairs.

Result: one row per document with its class (documents joined by links, named by the
smallest id) and the number of other documents within the threshold of it.

Edge cases: a text shorter than n words is one n-gram; null and empty texts have no n-grams,
form classes alone and have no links; repeated rows are copies of each other; null ids sort
after others as names; an empty table gives an empty result; other columns pass through
unless they clash with an output column.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Workspace, mix64, read, shingle_hashes, slices, text_chunks, tidy, word_spans
from .components import components

N = 5
THRESHOLD = 0.8
RECALL = 0.9995
TILE = 512
#: Documents of small candidate groups that one task verifies, about.
TASK_DOCS = 1000
_A = np.random.default_rng(5).integers(1, 1 << 63, 4096, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = np.random.default_rng(6).integers(0, 1 << 63, 4096, dtype=np.uint64)


def band_plan(threshold: float, recall: float, most: int = 256) -> tuple[int, int]:
    """(bands, rows): the most rows per band, so the fewest chance candidates, that reach the recall within ``most`` hashes."""
    best = (most, 1)
    for rows in range(1, 17):
        chance = threshold**rows
        bands = 1 if chance >= 1 else math.ceil(math.log(1 - recall) / math.log(1 - chance))
        if bands * rows <= most and rows <= 5:
            best = (bands, rows)
    return best


def sets_of(texts: list[str], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct n-gram hashes of each text, and offsets."""
    words, _, _, offsets = word_spans(texts)
    grams, at = shingle_hashes(words, offsets, n)
    parts = [np.unique(grams[a:b]) for a, b in zip(at[:-1], at[1:])]
    return np.concatenate(parts) if parts else grams, np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int64)


def folded(values: np.ndarray, offsets: np.ndarray, how) -> np.ndarray:
    """how.reduceat over each text's values; 0 where it has none."""
    out = np.zeros(len(offsets) - 1, np.uint64)
    some = np.flatnonzero(np.diff(offsets))
    if len(some):
        out[some] = how.reduceat(values, offsets[some])
    return out


def signatures(texts: list[str], n: int, bands: int, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Number of n-grams, two hashes of the whole set, and band hashes (texts x bands)."""
    grams, offsets = sets_of(texts, n)
    mixed = mix64(grams)
    keys = np.zeros((len(texts), bands), np.uint64)
    for b in range(bands):
        for j in range(b * rows, (b + 1) * rows):
            least = folded(grams * _A[j] + _B[j], offsets, np.minimum)
            keys[:, b] = mix64(keys[:, b] * np.uint64(31) + least)
    return np.diff(offsets), folded(mixed, offsets, np.add), folded(mixed, offsets, np.bitwise_xor), keys


def verify(grams: np.ndarray, offsets: np.ndarray, weights: np.ndarray, threshold: float, split: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links of each set to the others with Jaccard at least threshold: number, their weights' sum, and the smallest set it hangs together with.

    split > 0: only pairs across the border before set number ``split`` are compared.
    """
    m = len(offsets) - 1
    _, ids = np.unique(grams, return_inverse=True)
    sizes = np.diff(offsets)
    mark = np.zeros(ids.max() + 1 if len(ids) else 1, np.int32)
    texts, docs = np.zeros(m, np.int64), np.zeros(m, np.int64)
    parent = list(range(m))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i in range(split or m):
        first = split or i + 1
        if first >= m:
            continue
        own = ids[offsets[i] : offsets[i + 1]]
        mark[own] = 1
        shared = np.add.reduceat(mark[ids[offsets[first] :]], offsets[first:-1] - offsets[first])
        mark[own] = 0
        linked = first + np.flatnonzero(shared >= threshold * (sizes[i] + sizes[first:] - shared) - 1e-9)
        if len(linked):
            texts[i] += len(linked)
            docs[i] += weights[linked].sum()
            texts[linked] += 1
            docs[linked] += weights[i]
            for j in linked.tolist():
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return texts, docs, np.array([root(i) for i in range(m)], np.int64)


def ngram_join(df: DataFrame, text: str = "text", doc_id: str = "doc_id", n: int = N, threshold: float = THRESHOLD, recall: float = RECALL, tile: int = TILE) -> DataFrame:
    """df with class_id, class_size, n_links and keeper (true for one row of each class)."""
    ws = Workspace(df.sparkSession, "ngram-join")
    bands, rows = band_plan(threshold, recall)
    made = ("class_id", "class_size", "n_links", "keeper")
    rest = [c for c in df.columns if c not in made]

    @F.arrow_udf(T.StructType([T.StructField(c, T.LongType()) for c in ("n", "a", "b")] + [T.StructField("bands", T.ArrayType(T.LongType()))]))
    def signed(column: pa.Array) -> pa.Array:
        parts = []
        for _, chunk in (c for texts in slices(column) for c in text_chunks(texts)):
            size, a, b, keys = signatures(chunk, n, bands, rows)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(chunk) + 1, dtype=np.int32) * bands), pa.array(keys.view(np.int64).ravel()))
            parts.append(pa.StructArray.from_arrays([pa.array(size), pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), lists], ["n", "a", "b", "bands"]))
        return pa.concat_arrays(parts)

    # the input's columns stay in one struct, so that none can clash with the names in here
    docs = df.select(F.struct(*[F.col(f"`{c}`") for c in rest]).alias("_row"), F.monotonically_increasing_id().alias("_uid"), signed(F.coalesce(F.col(text), F.lit(""))).alias("_s"))
    docs = ws.save(docs.select("_row", "_uid", F.col("_s.n").alias("_n"), F.col("_s.a").alias("_a"), F.col("_s.b").alias("_b"), F.col("_s.bands").alias("_bands")), "documents")
    row = lambda c: F.col("_row").getField(c)
    first = F.min(F.struct(F.isnull(row(doc_id)).alias("none"), row(doc_id).alias("id"), F.col("_uid").alias("uid")))
    classes = docs.where("_n > 0").groupBy("_a", "_b").agg(first.alias("first"), F.count("*").alias("copies"), F.any_value("_bands").alias("bands"))
    classes = ws.save(classes.select(F.xxhash64("_a", "_b").alias("node"), "*"), "classes")

    keyed = classes.select("node", F.posexplode("bands").alias("band", "key"))
    buckets = keyed.groupBy("band", "key").agg(F.min("node").alias("m"), F.count("*").alias("c")).where("c > 1").drop("c")
    ties = keyed.join(buckets, ["band", "key"]).where("node != m").select(F.col("node").alias("u"), F.col("m").alias("v"))
    groups = ws.save(components(ws, ties), "groups")
    sizes = groups.groupBy("label").agg(F.count("*").alias("m"))
    n_active = groups.count()
    tiles = F.ceil(F.col("m") / tile)
    active = groups.join(sizes, "label").join(classes.select("node", "copies", F.col("first.uid").alias("_uid")), "node")
    active = ws.save(active.select("node", "label", "copies", "_uid", tiles.cast("int").alias("tiles"), F.pmod(F.xxhash64("node"), tiles).cast("int").alias("tile")), "active")
    few = max(1, math.ceil(n_active / TASK_DOCS))
    spread = active.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    spread = spread.withColumns({"lo": F.least("tile", "other"), "hi": F.greatest("tile", "other")})
    task = F.when(F.col("tiles") == 1, F.pmod(F.xxhash64("label"), F.lit(few))).otherwise(F.xxhash64("label", "lo", "hi"))
    # one shuffle of the texts at any size: candidates grow with the corpus, so they are never broadcast
    texts = docs.select("_uid", F.coalesce(row(text), F.lit("")).alias("text"))
    spread = texts.hint("merge").join(spread.withColumn("task", task), "_uid")

    def compare(table: pa.Table) -> pa.Table:
        table = table.sort_by([("label", "ascending"), ("lo", "ascending"), ("hi", "ascending"), ("tile", "ascending"), ("node", "ascending")])
        node, label, tile_of = (table[c].to_numpy() for c in ("node", "label", "tile"))
        lo, hi, copies = (table[c].to_numpy() for c in ("lo", "hi", "copies"))
        edge = np.flatnonzero(np.concatenate(([True], (label[1:] != label[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1]), [True])))
        out = [[], [], [], []]
        for s, e in zip(edge[:-1], edge[1:]):
            grams, offsets = sets_of(table["text"].slice(s, e - s).to_pylist(), n)
            split = int((tile_of[s:e] == lo[s]).sum()) if lo[s] != hi[s] else 0
            if split == e - s:
                continue
            found = verify(grams, offsets, copies[s:e], threshold, split)
            own = node[s:e]
            for c, x in zip(out, (own, found[0], found[1], own[found[2]])):
                c.append(x)
        tidy()
        cat = [np.concatenate(c) if c else np.zeros(0, np.int64) for c in out]
        return pa.table(cat, names=["node", "link_texts", "link_docs", "root"])

    links = spread.groupBy("task").applyInArrow(compare, "node bigint, link_texts bigint, link_docs bigint, root bigint")
    links = ws.save(links, "links")
    ws.release()
    ends = components(ws, links.where("node != root").select(F.col("node").alias("u"), F.col("root").alias("v")), "joined")
    numbers = links.groupBy("node").agg(F.sum("link_texts").alias("link_texts"), F.sum("link_docs").alias("link_docs"))
    named = classes.drop("bands").join(numbers, "node", "left").join(ends, "node", "left").withColumn("label", F.coalesce("label", "node"))
    named = ws.save(named, "named")
    whole = named.groupBy("label").agg(F.min("first").alias("least"), F.sum("copies").alias("class_size"))
    named = named.join(whole, "label").select(
        "_a", "_b", F.col("least.id").alias("class_id"), F.col("least.uid").alias("_keeper"), "class_size", (F.coalesce("link_docs", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    out = docs.drop("_bands").join(named, ["_a", "_b"], "left")
    alone = F.col("_n") == 0
    return out.select(
        *[row(c).alias(c) for c in rest], F.when(alone, row(doc_id)).otherwise(F.col("class_id")).alias("class_id"),
        F.when(alone, F.lit(1)).otherwise(F.col("class_size")).cast("long").alias("class_size"), F.when(alone, F.lit(0)).otherwise(F.col("n_links")).cast("long").alias("n_links"),
        (alone | (F.col("_uid") == F.col("_keeper"))).alias("keeper"))


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return ngram_join(docs).select("doc_id", "class_id", "class_size", "n_links")


OP7_SQL = r"""
WITH RECURSIVE split AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws FROM documents),
grams AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(2, len(ws) - 3))) AS i FROM split WHERE len(ws) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM shared JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE c >= 0.8 * (p.n + q.n - c) - 1e-9),
reached AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, l.y FROM reached r JOIN links l ON l.x = r.y),
classes AS (SELECT x AS doc_id, min(y) AS class_id, count(*) AS class_size FROM reached GROUP BY x),
numbers AS (SELECT x AS doc_id, count(*) AS n_links FROM links GROUP BY x)
SELECT doc_id, class_id, class_size, coalesce(n_links, 0) AS n_links FROM classes LEFT JOIN numbers USING (doc_id)
"""
