"""Toxicity: Levenshtein automata run against a trie of learned stems, then contexts weigh the hits.

The lexicon is learned from labelled rows: word beginnings that are far commoner in toxic
documents, each lengthened as long as it keeps its documents. The automaton of all words
within one edit (insertion, deletion, substitution, or swap of neighbours) of a stem is the
product of the trie with an edit counter; its states are made when first met and kept, so a
word costs one table look-up per character and most words die within a few.

Each hit is weighed by its context: whether it stands within quotation marks (spans from an
opening to a closing sign; an apostrophe within a word is none), near words of reporting, near
words of address. What each context weighs is learned from the labelled rows, starting from a
prior. Letters set apart by signs (i-d-i-o-t) are read together. A logistic model over the
weighed counts gives the score.

Edge cases: null and empty texts have no hits and get the score of a text without hits; rows
with null labels or ids teach nothing; with no toxic label every score is near 0, with no clean
one near 1, with neither 0.5; repeated rows are scored each; other columns pass through.
"""

from __future__ import annotations

import math
import re
import uuid
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Workspace, join_measured, read, slices
from .quality_classifier import held_out

#: Labelled rows to learn from, at most about; they bound the lexicon, too.
MAX_TRAIN = 12_000
#: Letters of the shortest stem, and of the longest beginning that may become one.
SHORTEST, LONGEST = 4, 16
CONTEXT = 5
CACHE_SIZE = 400_000
#: Longer words are looked up each time, so that the memory of so many words is bounded in bytes, too.
LONGEST_CACHED = 64
_WORD = re.compile(r"[@$*!]*[^\W_]+(?:[@$*!'’-]+[^\W_]+)*")
_LETTERS = re.compile(r"[^\W_]+")
#: Single letters (or signs for them) set apart by signs.
_SPACED = re.compile(r"(?<![^\W_])(?:[^\W\d_@$!]|[@$!0-9])(?:[-.*_·]+(?:[^\W\d_]|[@$!0-9])(?![^\W_])){3,}")
_SIGNS = str.maketrans({"@": "a", "$": "s", "!": "i"})
#: Opening signs of quotations with the signs that close them, and the most words that one spans.
_QUOTES = {'"': '"', "“": "”", "„": "“”", "«": "»", "»": "«", "‘": "’", "`": "`"}
QUOTED_WORDS = 100
_MARKS = ".,;:!?()[]{}<>…-—–"
#: Words of reporting and of address, in the languages of the tables.
_REPORTING = set("said says wrote word words term quote quoted called quotes phrase reported sagte schrieb wort zitat dit mot terme cité dijo palabra término cita".split())
_ADDRESS = set("you your you're u ur du dein deine sie ihr tu vous votre ton ta tú usted ustedes".split())


class Automaton:
    """Words that begin with a stem, or with one edit of it; determinised while it runs.

    anywhere: edits of the first letter and of stems of four letters too, so all words within one edit.
    """

    def __init__(self, stems: dict[str, float], anywhere: bool = False):
        self.anywhere = anywhere
        self.children: list[dict[str, int]] = [{}]
        self.ends: dict[int, str] = {}
        for stem in sorted(stems):
            node = 0
            for c in stem:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                node = self.children[node][c]
            self.ends[node] = stem
        self.states: list[frozenset] = []
        self.numbers: dict[frozenset, int] = {}
        self.moves: list[dict[str, int]] = []
        self.found: list[tuple[str | None, str | None]] = []  # stems ended here without and with an edit
        self.start = self.state(self.closure({(0, 0, "")}))

    def closure(self, items: set) -> frozenset:
        """Adds deletions: a stem's character that the word leaves out (the first only with anywhere)."""
        out = set(items)
        for node, edits, wait in items:
            if not wait and edits == 0 and (node or self.anywhere):
                out.update((child, 1, "") for child in self.children[node].values())
        return frozenset(out)

    def state(self, items: frozenset) -> int:
        if items not in self.numbers:
            self.numbers[items] = len(self.states)
            self.states.append(items)
            self.moves.append({})
            exact = [self.ends[n] for n, e, w in items if e == 0 and not w and n in self.ends]
            near = [self.ends[n] for n, e, w in items if e == 1 and not w and n in self.ends and (self.anywhere or len(self.ends[n]) > 4)]
            self.found.append((min(exact, default=None), min(near, default=None)))
        return self.numbers[items]

    def move(self, state: int, c: str) -> int:
        to = set()
        for node, edits, wait in self.states[state]:
            if wait:
                if c == wait:
                    to.add((node, edits, ""))
                continue
            child = self.children[node].get(c)
            if child is not None:
                to.add((child, edits, ""))
            if edits == 0:
                if node or self.anywhere:
                    to.add((node, 1, ""))
                for x, other in self.children[node].items():
                    if x != c and (node or self.anywhere):
                        to.add((other, 1, ""))
                    after = self.children[other].get(c)
                    if after is not None and x != c:
                        to.add((after, 1, x))
        self.moves[state][c] = to = self.state(self.closure(to)) if to else -1
        return to

    def match(self, word: str) -> tuple[str, int, int] | None:
        """(stem, edits, letters after it) of the best hit: without edit first, then the longest."""
        state, best = self.start, None
        for i, c in enumerate(word):
            to = self.moves[state].get(c)
            state = self.move(state, c) if to is None else to
            if state < 0:
                break
            exact, near = self.found[state]
            if exact:
                best = (exact, 0, len(word) - i - 1)
            elif near and (best is None or best[1]):
                best = (near, 1, len(word) - i - 1)
        return best


FEATURES = ["any", "amount", "kinds", "rate"]
#: How much a near hit of a stem counts for its trust if clean documents have it.
DISTRUST = 50.0
#: What a hit weighs before anything is learned: less when quoted or reported, more when addressed to someone.
PRIOR = {(q, r, a): max(1.0 - 0.6 * q - 0.3 * r + 0.3 * a, 0.1) for q in (0, 1) for r in (0, 1) for a in (0, 1)}
#: The prior counts as so many documents of each context.
PRIOR_DOCS = 20


def quotations(words: list[str]) -> list[bool]:
    """Which words stand between an opening and a closing quotation sign; one that isn't closed within QUOTED_WORDS opens nothing."""
    inside, start, close = [False] * len(words), -1, ""
    for i, word in enumerate(words):
        body = word.strip(_MARKS)
        if start >= 0 and i - start > QUOTED_WORDS:
            start = -1
        if start < 0 and body and body[0] in _QUOTES:
            start, close, body = i, _QUOTES[body[0]], body[1:]
        if start >= 0 and body and body.rstrip(_MARKS)[-1:] and body.rstrip(_MARKS)[-1] in close:
            inside[start : i + 1] = [True] * (i + 1 - start)
            start = -1
    return inside


@dataclass
class ToxicityModel:
    """Stems with their weights, and how far hits with an edit are trusted: (stem, whole word or not)."""

    stems: dict[str, float]
    trust: dict[tuple[str, bool], float] = field(default_factory=dict)
    contexts: dict[tuple[int, int, int], float] = field(default_factory=lambda: dict(PRIOR))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(len(FEATURES) + 1))


class Scorer:
    """Finds and weighs hits in whole texts, with a bounded memory of words."""

    def __init__(self, model: ToxicityModel, cache_size: int = CACHE_SIZE):
        self.model, self.cache_size = model, cache_size
        self.automaton = Automaton(model.stems, anywhere=True)
        self.clean: set[str] = set()
        self.dirty: dict[str, tuple[str, int, int]] = {}

    def look_up(self, word: str) -> tuple[str, int, int] | None:
        """The best hit in one word: in its parts, in the whole with signs as letters, in letters set apart."""
        best = None
        forms = [p for whole in _WORD.findall(word) for p in (whole.lstrip("@$*!"), whole)]  # a sign before a word may stand for its first letter
        forms += [piece for whole in _WORD.findall(word) if "-" in whole for piece in whole.split("-") if len(piece) >= SHORTEST]
        forms += ["".join(c for c in m[0] if c not in "-.*_·") for m in _SPACED.finditer(word)]
        for form in dict.fromkeys(forms):
            found = self.automaton.match(form.translate(_SIGNS))
            if found and (best is None or found[1] < best[1]):
                best = found
        return best

    def hits(self, text: str) -> list[tuple[str, int, int, float]]:
        """(stem, edits, letters after it, context weight) of each hit in order."""
        return [(stem, edits, after, self.model.contexts[context]) for stem, edits, after, context in self.found(text)]

    def found(self, text: str) -> list[tuple[str, int, int, tuple[int, int, int]]]:
        """(stem, edits, letters after it, context) of each hit in order."""
        words = text.lower().split()
        kinds = set(words)
        new = kinds - self.clean
        if len(self.clean) > self.cache_size:
            self.clean = set()
        if len(self.dirty) > self.cache_size:
            self.dirty = {}
        own: dict[str, tuple[str, int, int]] = {}
        for w in new:
            best = self.dirty.get(w) or self.look_up(w)
            if best:
                own[w] = best
            if len(w) <= LONGEST_CACHED:
                if best:
                    self.dirty[w] = best
                else:
                    self.clean.add(w)
        if not own:
            return []
        quoted = quotations(words)
        return [(*own[w], self.context(words, i, quoted[i])) for i, w in enumerate(words) if w in own]

    @staticmethod
    def context(words: list[str], i: int, quoted: bool) -> tuple[int, int, int]:
        """Whether a word is quoted, near words of reporting, near words of address."""
        plain = {w.strip(_MARKS + "".join(_QUOTES) + "”’") for w in words[max(0, i - CONTEXT) : i + CONTEXT + 1]}
        return int(quoted), int(bool(plain & _REPORTING)), int(bool(plain & _ADDRESS))

    def features(self, text: str) -> list[float]:
        total, best = 0.0, {}
        for stem, edits, after, weight in self.hits(text):
            worth = weight * self.model.stems[stem]
            if edits:
                worth *= self.model.trust.get((stem, after == 0), 1.0 if after == 0 else 0.5)
            total += worth
            best[stem] = max(best.get(stem, 0.0), worth)
        return [min(total, 1.0), math.log1p(total), math.log1p(sum(best.values())), total / (total + 0.005 * (len(text) / 6 + 20))]

    def score(self, text: str) -> float:
        x = self.features(text)
        return 1 / (1 + math.exp(-max(min(float(self.model.weights[0]) + float(np.dot(self.model.weights[1:], x)), 30.0), -30.0)))


def beginnings(text: str) -> set[str]:
    words = set(_LETTERS.findall((text or "").lower()))
    return {w[:n] for w in words for n in range(SHORTEST, min(len(w), LONGEST) + 1)}


def learn_lexicon(rows: DataFrame) -> tuple[dict[str, float], int, int]:
    """Stems with their weight (0 to 1) from (t, y) rows, and the rows of either class."""

    def tally(batches):
        counts: dict[str, list[int]] = {}
        for batch in batches:
            for t, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for b in beginnings(t):
                    counts.setdefault(b, [0, 0])[y] += 1
        some = list(counts.items())
        for i in range(0, len(some), 10_000):
            part = some[i : i + 10_000]
            yield pa.RecordBatch.from_pydict({"stem": [k for k, _ in part], "clean": [v[0] for _, v in part], "toxic": [v[1] for _, v in part]}, schema=pa.schema([("stem", pa.string()), ("clean", pa.int64()), ("toxic", pa.int64())]))

    n = {r.y: r.n for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n_clean, n_toxic = n.get(0, 0), n.get(1, 0)
    if not n_toxic or not n_clean:
        return {}, n_clean, n_toxic
    least = max(3, n_toxic // 200)
    odds = (F.col("toxic") + 0.5) / (F.col("clean") + 0.5) * n_clean / n_toxic
    counted = rows.mapInArrow(tally, "stem string, clean bigint, toxic bigint").groupBy("stem").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    found = counted.where((F.col("toxic") >= least) & (odds >= 20)).collect()  # as many as the training rows allow
    toxic = {r.stem: r.toxic for r in found}
    clean = {r.stem: r.clean for r in found}
    stems: dict[str, float] = {}
    for stem in sorted(toxic, key=lambda s: (len(s), s)):
        if any(stem[:i] in toxic for i in range(SHORTEST, len(stem))):
            continue  # a shorter beginning already stands for it
        while longer := [s for s in toxic if len(s) == len(stem) + 1 and s.startswith(stem) and toxic[s] >= 0.9 * toxic[stem]]:
            stem = max(longer, key=toxic.get)
        stems[stem] = toxic[stem] / (toxic[stem] + clean[stem] * n_toxic / n_clean)
    return stems, n_clean, n_toxic


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> np.ndarray:
    """Intercept and weights, none of which is negative: a feature that would be is left out."""
    used = list(range(x.shape[1]))
    while True:
        z = np.column_stack((np.ones(len(x)), x[:, used]))
        w = np.zeros(z.shape[1])
        penalty = np.diag([1e-6] + [ridge] * len(used))
        for _ in range(60):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            step = np.linalg.solve((z * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ z + penalty, z.T @ (p - y) + penalty @ w)
            w = w - np.clip(step, -4, 4)
            if np.abs(step).max() < 1e-8:
                break
        if not used or w[1:].min() >= 0:
            break
        used.pop(int(w[1:].argmin()))
    out = np.zeros(x.shape[1] + 1)
    out[[0, *(i + 1 for i in used)]] = w
    return out


def learn_contexts(rows: DataFrame, model: ToxicityModel, n_clean: int, n_toxic: int) -> dict[tuple[int, int, int], float]:
    """What a hit weighs in each context: how much likelier than elsewhere a document with it there is toxic, from the prior on."""

    def tally(batches):
        scorer, counts = Scorer(model), {}
        for batch in batches:
            for t, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for key in {context for _, edits, _, context in scorer.found(t) if not edits}:
                    counts.setdefault(key, [0, 0])[y] += 1
        yield pa.RecordBatch.from_arrays([*(pa.array([k[i] for k in counts], pa.int32()) for i in range(3)), *(pa.array([v[y] for v in counts.values()], pa.int64()) for y in (0, 1))], names=["q", "r", "a", "clean", "toxic"])

    found = rows.mapInArrow(tally, "q int, r int, a int, clean bigint, toxic bigint").groupBy("q", "r", "a").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).collect()
    share = {(x.q, x.r, x.a): (x.toxic, x.toxic + x.clean * n_toxic / n_clean) for x in found}
    base = sum(t for t, _ in share.values()) / max(sum(n for _, n in share.values()), 1e-9)
    out = {}
    for key, prior in PRIOR.items():
        toxic, n = share.get(key, (0, 0))
        rate = (toxic + PRIOR_DOCS * min(prior * base, 1.0)) / (n + PRIOR_DOCS)
        out[key] = min(max(rate / max(base, 1e-9), 0.1), 1.5)
    return out


def learn_trust(rows: DataFrame, model: ToxicityModel, n_clean: int, n_toxic: int) -> dict[tuple[str, bool], float]:
    """A stem's hits with an edit are trusted as far as clean documents lack them."""

    def tally(batches):
        scorer, counts = Scorer(model), {}
        for batch in batches:
            for t, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for key in {(stem, edits, after == 0) for stem, edits, after, _ in scorer.hits(t)}:
                    counts.setdefault(key, [0, 0])[y] += 1
        keys = list(counts)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()), pa.array([k[2] for k in keys], pa.bool_()), *(pa.array([counts[k][y] for k in keys], pa.int64()) for y in (0, 1))], names=["stem", "edits", "whole", "clean", "toxic"])

    found = rows.mapInArrow(tally, "stem string, edits int, whole boolean, clean bigint, toxic bigint").groupBy("stem", "edits", "whole").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).collect()
    exact: dict[str, int] = {}
    for r in found:
        if not r.edits:
            exact[r.stem] = exact.get(r.stem, 0) + r.toxic
    near = {(r.stem, r.whole): r.clean * n_toxic / n_clean for r in found if r.edits}
    return {k: exact.get(k[0], 0) / max(exact.get(k[0], 0) + DISTRUST * v, 1e-9) for k, v in near.items()}


def train_toxicity(docs: DataFrame, labels: DataFrame, text: str, doc_id: str, label: str, max_train: int) -> ToxicityModel:
    """labels: rows to learn from. At most about max_train of them, by a hash of the id, are used."""
    labels = labels.where(F.col(label).isin(0, 1) & F.col(doc_id).isNotNull()).select(doc_id, label)
    share = max_train / max(labels.count(), 1)
    chosen = labels.where(F.pmod(F.xxhash64(doc_id, F.lit("train")), F.lit(1_000_000)) < int(1_000_000 * min(share, 1.0)))
    rows = join_measured(docs.select(doc_id, text), chosen, doc_id, "inner", chosen.count()).select(F.coalesce(F.col(text), F.lit("")).alias("t"), F.col(label).cast("int").alias("y"))
    rows = Workspace(docs.sparkSession, "toxicity").save(rows, "train")
    stems, n_clean, n_toxic = learn_lexicon(rows)
    model = ToxicityModel(stems)
    if not n_clean or not n_toxic:
        model.weights[0] = math.log((n_toxic + 0.5) / (n_clean + 0.5))
        return model

    model.contexts = learn_contexts(rows, model, n_clean, n_toxic)
    model.trust = learn_trust(rows, model, n_clean, n_toxic)

    def measure(batches):
        scorer = Scorer(model)
        for batch in batches:
            found = np.array([scorer.features(t) for t in batch.column(0).to_pylist()], float).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([*(pa.array(c) for c in found.T), batch.column(1).cast(pa.float64())], names=[*FEATURES, "y"])

    found = rows.mapInArrow(measure, ", ".join(f"`{c}` double" for c in [*FEATURES, "y"])).groupBy(*FEATURES, "y").agg(F.count("*").alias("n")).collect()
    found = sorted(tuple(r) for r in found)
    table = np.array([r[:-1] for r in found for _ in range(r[-1])], float)
    model.weights = fit_logistic(table[:, :-1], table[:, -1])
    return model


_workers: dict[str, Scorer] = {}


def score_toxicity(
    df: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "toxic", max_train: int = MAX_TRAIN, score: str = "score",
) -> DataFrame:
    """df with a score from 0 to 1: how likely the label is 1."""
    model = train_toxicity(df, labels, text, doc_id, label, max_train)
    sent, key = df.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex

    @F.arrow_udf(T.DoubleType())
    def scored(column: pa.Array) -> pa.Array:
        if key not in _workers:
            _workers.clear()
            _workers[key] = Scorer(sent.value)
        return pa.array([_workers[key].score(t or "") for texts in slices(column) for t in texts], pa.float64())

    return df.withColumn(score, scored(F.coalesce(F.col(text), F.lit(""))))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    labels = read(spark, sf_dir, "labels").where(~held_out("doc_id", 5, 0))
    scored = score_toxicity(docs, labels)
    return scored.select("doc_id", F.coalesce(held_out("doc_id", 5, 0), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
