"""BM25 with path and symbol bonuses, through an inverted index; context within a budget."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomspark.functions.text import code_tokens, identifiers
from loomspark.sources.work import Work

K1, B = 1.2, 0.75
PATH_BONUS, SYMBOL_BONUS = 1.5, 0.8
#: Terms and symbols of all queries together (some 50 bytes each) up to which they go to every task.
ASKED_ROWS = 200_000


def index(docs: DataFrame, doc: str, path: str, body: str) -> DataFrame:
    """One row per document: its terms, their number, its path's terms and its identifiers. Write it to keep it."""
    whole = F.concat(F.col(path), F.lit("\n"), F.coalesce(F.col(body), F.lit("")))
    return docs.where(F.trim(F.coalesce(F.col(body), F.lit(""))) != "").select(
        F.col(doc).alias("doc"), code_tokens(whole).alias("terms"), F.array_distinct(code_tokens(path)).alias("path_terms"), identifiers(whole).alias("symbols")
    ).withColumn("doc_len", F.size("terms"))


def retrieve(docs: DataFrame, queries: DataFrame, query: str, text: str, k: int = 8) -> DataFrame:
    """query, doc, score and rank of the k best documents of each query (rows of index); a score of 0 or less is none.

    Up to ASKED_ROWS terms of all queries together (counted) these go to every task, which scores its documents' terms where
    they are and returns k rows a query: no pair of a query and a document is shuffled. Beyond that, equi-joins on the term.
    """
    work = Work(docs.sparkSession, "retrieval")
    docs = work.save(docs, "index")
    q = queries.select(F.col(query).alias("query"), code_tokens(text).alias("terms"), identifiers(text).alias("symbols"))
    asked = work.save(q.select("query", F.explode("terms").alias("term")).groupBy("query", "term").agg(F.count("*").alias("times")), "asked")
    symbols = work.save(q.select("query", F.explode("symbols").alias("s")), "symbols")
    total = by_tasks(docs, asked, symbols, k) if asked.count() + symbols.count() <= ASKED_ROWS else by_joins(docs, asked, symbols)
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "doc"))
    return total.withColumn("rank", rank).where(F.col("rank") <= k)


def weighed(docs: DataFrame, asked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(query, term, weight: times by rarity), and one row of n_docs and mean_len."""
    vocabulary = asked.select("term").distinct()
    totals = docs.agg(F.count("*").alias("n_docs"), F.avg("doc_len").alias("mean_len"))
    found = docs.select(F.explode(F.array_distinct("terms")).alias("term")).join(vocabulary, "term", "left_semi").groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log((F.greatest(F.lit(1), F.col("n_docs")) - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1.0)
    return asked.join(found, "term").crossJoin(F.broadcast(totals)).select("query", "term", (F.col("times") * idf).alias("weight")), totals


def documents_at_once(n: int) -> int:
    """Documents that a task scores at once for n queries: each of their terms may meet every query, so few."""
    return max(1, min(256, 4_000_000 // max(n, 1)))


def by_tasks(docs: DataFrame, asked: DataFrame, symbols: DataFrame, k: int) -> DataFrame:
    weights, totals = weighed(docs, asked)
    mean_len = max(1.0, totals.first().mean_len or 0.0)
    rows, marks = weights.collect(), symbols.collect()
    names = sorted({r["query"] for r in rows} | {r["query"] for r in asked.select("query").distinct().collect()} | {r["query"] for r in marks})
    number = {n: i for i, n in enumerate(names)}
    paths = asked.select("query", "term").collect()
    sent = docs.sparkSession.sparkContext.broadcast((
        Postings([(r.term, number[r["query"]], r.weight) for r in rows]), Postings([(r.term, number[r["query"]], PATH_BONUS) for r in paths]), Postings([(r.s, number[r["query"]], SYMBOL_BONUS) for r in marks])))
    n, kind = len(names), docs.schema["doc"].dataType.simpleString()

    def score(batches):
        best, docs_type = Best(n, k), pa.int64()
        for batch in batches:
            docs_type = batch.column(0).type
            step = documents_at_once(n)
            for at in range(0, batch.num_rows, step):
                some = batch.slice(at, step)
                scores = np.zeros((some.num_rows, n))
                lengths = some.column(2).to_numpy().astype(float)
                norm = K1 * (1.0 - B + B * lengths / mean_len)
                for column, table, part in ((1, sent.value[0], lambda tf, d: tf * (K1 + 1.0) / (tf + norm[d])), (3, sent.value[1], lambda tf, d: tf), (4, sent.value[2], lambda tf, d: tf)):
                    table.add(scores, some.column(column), part)
                best.take(some.column(0).to_numpy(zero_copy_only=False), np.round(scores, 9))
        yield best.batch(docs_type)

    found = docs.select("doc", "terms", "doc_len", "path_terms", "symbols").mapInArrow(score, f"_q int, doc {kind}, score double")
    labels = docs.sparkSession.createDataFrame([(i, name) for i, name in enumerate(names)], T.StructType([T.StructField("_q", T.IntegerType()), asked.schema["query"]]))
    return found.join(F.broadcast(labels), "_q").select("query", "doc", "score")


class Postings:
    """Of each term the queries that ask for it, with weights, in flat arrays."""

    def __init__(self, rows: list[tuple[str, int, float]]):
        rows = sorted(rows)
        self.terms = pa.array(sorted({r[0] for r in rows}), pa.string())
        place = {t: i for i, t in enumerate(self.terms.to_pylist())}
        codes = np.array([place[r[0]] for r in rows], np.int64)
        self.starts = np.searchsorted(codes, np.arange(len(self.terms) + 1))
        self.queries, self.weights = np.array([r[1] for r in rows], np.int64), np.array([r[2] for r in rows], float)

    def add(self, scores: np.ndarray, lists: pa.ListArray, part) -> None:
        """Adds to scores (documents x queries) what each document's terms are worth; part: from a term's count and its document."""
        codes = pc.index_in(lists.flatten(), self.terms)
        hit = codes.is_valid().to_numpy(zero_copy_only=False)
        owner = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())[hit]
        pairs, counts = np.unique(owner * max(len(self.terms), 1) + codes.drop_null().to_numpy(), return_counts=True)
        owner, code = pairs // max(len(self.terms), 1), pairs % max(len(self.terms), 1)
        value = part(counts.astype(float), owner)
        n = self.starts[code + 1] - self.starts[code]
        at = np.repeat(self.starts[code] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
        scores += np.bincount(np.repeat(owner, n) * scores.shape[1] + self.queries[at], np.repeat(value, n) * self.weights[at], scores.size).reshape(scores.shape)


class Best:
    """The k best documents of each query so far: by score, then document."""

    def __init__(self, n: int, k: int):
        self.k, self.docs, self.scores = k, [None] * n, [np.zeros(0)] * n

    def take(self, docs: np.ndarray, scores: np.ndarray) -> None:
        for q in range(scores.shape[1]):
            own = scores[:, q]
            least = self.scores[q][-1] if len(self.scores[q]) == self.k else 0.0
            some = np.flatnonzero((own > 0) & (own >= least))
            if len(some):
                d, s = docs[some] if self.docs[q] is None else np.concatenate((self.docs[q], docs[some])), np.concatenate((self.scores[q], own[some]))
                order = np.lexsort((np.unique(d, return_inverse=True)[1], -s))[: self.k]
                self.docs[q], self.scores[q] = d[order], s[order]

    def batch(self, kind: pa.DataType) -> pa.RecordBatch:
        found = [(q, d.tolist(), s.tolist()) for q, (d, s) in enumerate(zip(self.docs, self.scores)) if d is not None]
        columns = [q for q, d, _ in found for _ in d], [x for _, d, _ in found for x in d], [x for _, _, s in found for x in s]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), kind, pa.float64()))], names=["_q", "doc", "score"])


def by_joins(docs: DataFrame, asked: DataFrame, symbols: DataFrame) -> DataFrame:
    """Terms, path terms and symbols of queries meet documents by equi-joins on the term; only hits are ever paired."""
    weights, totals = weighed(docs, asked)
    tf = docs.select("doc", "doc_len", F.explode("terms").alias("term")).join(asked.select("term").distinct(), "term", "left_semi").groupBy("doc", "doc_len", "term").agg(F.count("*").alias("tf"))
    norm = K1 * (1.0 - B + B * F.col("doc_len") / F.greatest(F.lit(1.0), F.col("mean_len")))
    bm25 = weights.join(tf, "term").crossJoin(F.broadcast(totals)).select("query", "doc", (F.col("weight") * F.col("tf") * (K1 + 1.0) / (F.col("tf") + norm)).alias("part"))
    path = asked.select("query", "term").join(docs.select("doc", F.explode("path_terms").alias("term")), "term").select("query", "doc", F.lit(PATH_BONUS).alias("part"))
    marks = symbols.join(docs.select("doc", F.explode("symbols").alias("s")), "s").select("query", "doc", F.lit(SYMBOL_BONUS).alias("part"))
    return bm25.unionByName(path).unionByName(marks).groupBy("query", "doc").agg(F.round(F.sum("part"), 9).alias("score")).where("score > 0")


def context_blocks(ranked: DataFrame, by: str, rank: str, path: str, body: str, budget: int = 9000) -> DataFrame:
    """Each group's blocks in rank order, joined, until the budget of signs; the last one is cut."""
    block = F.concat(F.lit("[FILE] "), F.col(path), F.lit("\n"), F.col(body), F.lit("\n"))
    used = F.sum(F.length("_block")).over(Window.partitionBy(by).orderBy(rank).rowsBetween(Window.unboundedPreceding, -1))
    rows = ranked.withColumn("_block", block).withColumn("_used", F.coalesce(used, F.lit(0))).where(F.col("_used") < budget)
    part = F.struct(F.col(rank).alias("r"), F.expr(f"substring(_block, 1, {budget} - int(_used))").alias("b"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda x: x["b"]), "\n")
    return rows.groupBy(by).agg(F.regexp_replace(joined, r"(?U)^\s+|\s+$", "").alias("context"), F.count("*").alias("n_blocks"))
