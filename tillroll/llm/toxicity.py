"""Toxicity by maximum-scoring segments.

Learning.  The numbers of training documents of either label that hold a word give its log-odds with an
informative Dirichlet prior (``PRIOR`` times the word's count in both).  Telling words, whose toxic share no more than
``CHANCE`` words would reach by chance (Tarone's correction of the Chernoff bound) and with log-odds of at least
``MIN_SCORE``, score their log-odds (the ``LEXICON`` strongest of them), every other word scores ``DRIFT``.

Scoring.  One linear scan per text finds all maximal-scoring segments (Ruzzo and
Tompa).  Segment scores follow an extreme-value law on clean text: lambda
solves sum p exp(lambda s) = 1 over clean word frequencies, K is its
maximum-likelihood value over the clean training documents (one without a
segment counts as censored at the smallest word score).  A segment's
normalised score is lambda S - ln(K n); segments with a positive one
(expected by chance less than once) are significant, and the logarithm of 1 plus
their sum is mapped to a probability by a logistic curve fitted to a
histogram of all training documents.

The fit uses at most ``FIT_ROWS`` labelled documents (those with the smallest
hashes), whose ids and labels are broadcast (9 bytes each); counts over their
words are a Spark aggregate.  Documents are never shuffled.

Defined cases: null and empty texts have no words and get the score of a text
without segments; several labels of a document count as their largest; null
labels and ids are no labels; without both classes every score is the share of label 1 (0
without labels); ``keep_clean`` keeps all columns and, of rows with equal ids,
judges each by its own text.  Only ``text`` is an input of a score.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from tillroll.llm.common import _WORD, fresh, stored, words

LEXICON, CHANCE, MIN_SCORE, DRIFT, PRIOR, FIT_ROWS = 50_000, 1.0, 2.0, -0.3, 0.02, 200_000
_FLUSH = 200_000


@dataclass
class Model:
    scores: dict[str, float] = field(default_factory=dict)
    lam: float = 1.0
    log_k: float = 0.0
    slope: float = 0.0
    shift: float = -math.inf  # probability 0

    def probability(self, strength: float) -> float:
        x = self.slope * strength + self.shift
        return 1 / (1 + math.exp(-x)) if x > -700 else 0.0

    def normalised(self, score: float, n: int) -> float:
        return self.lam * score - self.log_k - math.log(max(n, 1))

    def strength(self, segments: list[tuple[int, int, float]], n: int) -> float:
        """Logarithm of 1 plus the sum of the significant segments' normalised scores."""
        return math.log1p(sum(x for _, _, s in segments if (x := self.normalised(s, n)) > 0))


def maximal_segments(hits: list[tuple[int, float]], drift: float = DRIFT) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments as (first word, last word, score); ``hits`` are (place, score > 0), the rest scores ``drift``.

    Linear: each candidate keeps a pointer to the nearest earlier one whose left
    sum is smaller, so every pointer is followed once.
    """
    seg: list[list] = []  # first, last, left sum, right sum, pointer
    total, done = 0.0, 0
    for place, score in hits:
        total += drift * (place - done)
        done = place + 1
        new = [place, place, total, total + score, -1]
        total += score
        j = len(seg) - 1
        while True:
            while j >= 0 and seg[j][2] >= new[2]:
                j = seg[j][4]
            if j < 0 or seg[j][3] >= new[3]:
                new[4] = j
                seg.append(new)
                break
            new[0], new[2] = seg[j][0], seg[j][2]
            pointer = seg[j][4]
            del seg[j:]
            j = pointer
    return [(a, b, r - left) for a, b, left, r, _ in seg]


def _segments(ws: list[str], scores: dict[str, float]) -> list[tuple[int, int, float]]:
    return maximal_segments([(i, scores[w]) for i, w in enumerate(ws) if w in scores])


def _training(labels: DataFrame, in_training: Column | None, fit_rows: int) -> dict[int, int]:
    """doc_id -> label of at most ``fit_rows`` labelled documents, by smallest hash."""
    usable = F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()
    rows = (labels.where(usable if in_training is None else usable & in_training)
            .groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
            .orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows).collect())
    return {r[0]: r[1] for r in rows}


def _counts(docs: DataFrame, sent) -> DataFrame:
    """word, clean, toxic: the training documents of either label that hold it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        label, counts = sent.value, {}

        def out() -> pa.RecordBatch:
            flat = list(counts.values())
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array([c[0] for c in flat], pa.int64()),
                                               pa.array([c[1] for c in flat], pa.int64())], ["word", "clean", "toxic"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                if doc_id in label:
                    side = label[doc_id] > 0
                    for w in set(words(text.as_py())):
                        if w not in counts:
                            counts[w] = [0, 0]
                        counts[w][side] += 1
                    if len(counts) >= _FLUSH:
                        yield out()
                        counts.clear()
        if counts:
            yield out()

    return docs.mapInArrow(run, "word string, clean long, toxic long").groupBy("word").agg(
        F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))


def _least_evidence(found: list[tuple[int, int]], share: float, chance: float = CHANCE) -> float:
    """Evidence from which at most ``chance`` words pass by chance; ``found`` are (documents n, words in n documents).

    A word in n documents has evidence of at most n ln(1 / share).  Words that
    cannot reach the bar are no trials (Tarone), so the bar is the lowest ln(trials / chance)
    that all counted trials can reach; infinite if none can.
    """
    trials, bar = 0, math.inf
    for n, m in sorted(found, reverse=True):
        trials += m
        if -n * math.log(share) < math.log(trials / chance):
            break
        bar = math.log(trials / chance)
    return bar


def _lambda(freq: np.ndarray, score: np.ndarray) -> float:
    """The positive root of sum freq exp(lambda score) = 1 (freq and scores of lexicon words; the rest drifts)."""
    rest = max(1 - freq.sum(), 1e-12)
    f = lambda x: float((freq * np.exp(np.minimum(x * score, 700))).sum() + rest * math.exp(x * DRIFT)) - 1
    lo, hi = 0.0, 1.0
    while f(hi) < 0 and hi < 1e6:
        hi *= 2
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if f(mid) < 0 else (lo, mid)
    return max(hi, 1e-3)


def _logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve through (x, label y) with weights n; Newton steps with a small ridge."""
    design, beta = np.stack([x, np.ones_like(x)], 1), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        grad = design.T @ (n * (y - p)) - 1e-2 * beta
        hess = (design * (n * p * (1 - p))[:, None]).T @ design + 1e-2 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        beta += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return float(beta[0]), float(beta[1])


def fit(docs: DataFrame, labels: DataFrame, in_training: Column | None = None, fit_rows: int = FIT_ROWS) -> Model:
    """Learn from the labels for which ``in_training`` (a column over ``labels``) holds."""
    sc = docs.sparkSession.sparkContext
    label = _training(labels, in_training, fit_rows)
    share = sum(v > 0 for v in label.values()) / max(len(label), 1)
    if share in (0.0, 1.0):
        return Model(shift=math.inf if share else -math.inf)
    sent = sc.broadcast(label)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    counts = stored(_counts(own, sent), "toxic-counts")
    n_c, n_t = counts.agg(F.sum("clean"), F.sum("toxic")).first()
    n_c, n_t = n_c or 0, n_t or 0
    mass = PRIOR * (n_c + n_t)
    prior = F.lit(PRIOR) * (F.col("clean") + F.col("toxic"))
    yt, yc = F.col("toxic") + prior, F.col("clean") + prior
    delta = F.log(yt / (n_t + mass - yt)) - F.log(yc / (n_c + mass - yc))
    # Evidence that a word is telling: the Chernoff bound -ln P(at least so many of its documents are toxic by chance).
    share = max(share, n_t / max(n_c + n_t, 1))
    n, rate = F.col("clean") + F.col("toxic"), F.col("toxic") / (F.col("clean") + F.col("toxic"))
    evidence = F.col("toxic") * F.log(rate / share) + F.when(F.col("clean") > 0, F.col("clean") * F.log((1 - rate) / (1 - share))).otherwise(0.0)
    sizes = counts.groupBy(n.alias("n")).count().collect()  # at most one row per number of training documents
    lexicon = (counts.where(rate > share).select("word", delta.alias("s"), (yc / (n_c + mass)).alias("p"), evidence.alias("e"))
               .where((F.col("e") >= _least_evidence([(r[0], r[1]) for r in sizes], share)) & (F.col("s") >= MIN_SCORE))
               .orderBy(F.col("e").desc(), "word").limit(LEXICON).collect())
    model = Model({r["word"]: r["s"] for r in lexicon})
    if lexicon:
        model.lam = _lambda(np.array([r["p"] for r in lexicon]), np.array([r["s"] for r in lexicon]))
    scores = sc.broadcast(model.scores)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Per training document its label, words and segment scores."""
        for batch in batches:
            rows: tuple[list, list, list] = ([], [], [])
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                if doc_id in sent.value:
                    ws = words(text.as_py())
                    for col, v in zip(rows, (sent.value[doc_id], len(ws), [s for _, _, s in _segments(ws, scores.value)])):
                        col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int32()), pa.array(rows[1], pa.int64()),
                                              pa.array(rows[2], pa.list_(pa.float64()))], ["toxic", "n", "s"])

    seen = stored(own.mapInArrow(best, "toxic int, n long, s array<double>"), "toxic-segments")
    # K = (clean documents with a segment) / sum n exp(-lambda S); half a document more keeps K above 0.
    least = min(model.scores.values(), default=1.0)
    clean = seen.where("toxic <= 0 and n > 0").select("n", F.array_max("s").alias("s"))
    m, mass = clean.agg(F.count("s"), F.sum(F.col("n") * F.exp(-model.lam * F.coalesce("s", F.lit(least))))).first()
    model.log_k = math.log((m + 0.5) / mass) if mass else 0.0
    each = F.transform("s", lambda s: model.lam * s - model.log_k - F.log(F.greatest(F.col("n"), F.lit(1)).cast("double")))
    strength = F.log1p(F.aggregate(F.filter(each, lambda x: x > 0), F.lit(0.0), lambda a, x: a + x))
    bins = seen.groupBy(F.round(strength, 2).alias("x"), (F.col("toxic") > 0).cast("double").alias("y")).count().collect()
    model.slope, model.shift = _logistic(*(np.array([r[i] for r in bins], float) for i in range(3)))
    return model


def score(docs: DataFrame, model: Model, score_name: str = "_toxicity", passages_name: str = "_passages") -> DataFrame:
    """``docs`` with two last columns: the score (0 to 1) and its passages (code-point start, end, normalised score)."""
    passage = StructType([StructField("start", LongType()), StructField("end", LongType()), StructField("score", DoubleType())])
    schema = StructType([*docs.schema, StructField(score_name, DoubleType()),
                         StructField(passages_name, ArrayType(passage))])
    names, sent = schema.names, docs.sparkSession.sparkContext.broadcast(model)
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type
        own, kind = sent.value, to_arrow_type(ArrayType(passage))
        for batch in batches:
            scores, passages = [], []
            for text in batch.column(at):
                text = text.as_py() or ""
                ws = words(text)
                segments = _segments(ws, own.scores)
                scores.append(own.probability(own.strength(segments, len(ws))))
                found = [(a, b, x) for a, b, s in segments if (x := own.normalised(s, len(ws))) > 0]
                places = [m.span() for m in _WORD.finditer(text)] if found else []
                # lower-casing can split a character into several (rare); places are then those of the nearest word
                last = len(places) - 1
                passages.append([{"start": places[min(a, last)][0], "end": places[min(b, last)][1], "score": x} for a, b, x in found])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64()), pa.array(passages, kind)], names)

    return docs.mapInArrow(run, schema)


def keep_clean(docs: DataFrame, labels: DataFrame, in_training: Column | None = None) -> DataFrame:
    """``docs`` without those scored 0.5 or more."""
    names = fresh(docs, "_toxicity"), fresh(docs, "_passages")
    return score(docs, fit(docs, labels, in_training), *names).where(F.col(names[0]) < 0.5).drop(*names)


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5 (null as empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, n_passages; learnt from the labels outside the held-out fold."""
    model = fit(docs, labels, fold(F.col("doc_id")) != 0)
    out = score(docs.select("doc_id", "text"), model)
    return out.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), F.col("_toxicity").alias("score"),
                      (F.col("_toxicity") >= 0.5).cast("int").alias("predicted"), F.size("_passages").cast("long").alias("n_passages"))
