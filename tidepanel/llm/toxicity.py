"""Toxicity: cumulative-link (proportional-odds) regression over sparse hashed word features.

P(grade > k | x) = sigmoid(w.x - theta_k) with one weight vector for all thresholds and
theta_0 < theta_1 < ...; the output is the expected grade, the sum of these probabilities.

The labels tell toxic from clean. Grades: 0 clean; toxic documents are 1 (mild) or 2 (severe) by
whether they hold more of the words that mark toxic documents than the median toxic one does.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidepanel.llm.common import beside_rows, durable, rows_apart

#: Bound of the labelled sample for the fit: this many toxic and as many clean documents, those
#: with the smallest hashes of their doc_id. Everything else covers all rows.
MAX_PER_CLASS = 3000
BITS = 18
STRIP = ".,;:!?\"'()[]{}<>|#$%&*-_"
#: A document is rejected from this probability of any toxic grade on (of held-out documents, toxic ones lie above and clean ones far below).
REJECT_AT = 0.3
#: Features weigh in only if in at least so many sample documents, and at least so many times likelier in one class.
MIN_SUPPORT, MIN_RATIO = 4, 3.0


def features(word: str) -> list[int]:
    """Hashed features of a word: itself, and its beginning if it is longer."""
    word = word.strip(STRIP)
    names = ["w" + word] if word else []
    names += [f"p{word[:k]}" for k in (4, 5, 6) if len(word) > k]
    return [xxhash.xxh32_intdigest(n) & ((1 << BITS) - 1) for n in names]


def words(text: str) -> set[str]:
    return set(text.lower().split())


class _Cache(dict):
    """word -> what ``make`` gives; emptied when it has grown large."""

    def __init__(self, make, most: int = 150_000):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, key):
        if len(self) >= self.most:
            self.clear()
        self[key] = value = self.make(key)
        return value


def sample(docs: DataFrame, labels: DataFrame, per_class: int = MAX_PER_CLASS) -> DataFrame:
    """(toxic, features) of the bounded sample, one row for each doc_id, with every distinct feature of its text.

    A document labelled twice counts as toxic if any label says so; of rows that repeat a doc_id
    the one with the smallest text counts.
    """
    marked = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = F.xxhash64("doc_id")
    picked = [marked.where(F.col("toxic") == t).orderBy(order, "doc_id").limit(per_class) for t in (0, 1)]
    chosen = F.broadcast(picked[0].union(picked[1]))  # bounded by 2 * per_class rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _Cache(features)
        for batch in batches:
            rows = [sorted({f for w in words(t or "") for f in cache[w]}) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1).cast(pa.int32()), pa.array(rows, pa.list_(pa.int32()))], names=["doc_id", "toxic", "features"])

    found = docs.select("doc_id", "text").join(chosen, "doc_id").select(F.col("doc_id").cast("long").alias("doc_id"), "toxic", "text")
    first = found.groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("text").alias("text"))
    return first.mapInArrow(run, "doc_id long, toxic int, features array<int>").select("toxic", "features")


def supported(rows: DataFrame) -> DataFrame:
    """(toxic, features as bytes): the sample with those features only that MIN_SUPPORT of its rows have; the others can't weigh in.

    The features are counted on the executors; of 2**BITS numbers those that are often enough make one bounded array.
    """
    often = rows.select(F.explode("features").alias("feature")).groupBy("feature").agg(F.count("*").alias("n")).where(F.col("n") >= MIN_SUPPORT)
    mask = np.zeros(1 << BITS, bool)
    mask[[r["feature"] for r in often.select("feature").collect()]] = True
    sent = rows.sparkSession.sparkContext.broadcast(mask)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            all_ = [np.array(f, np.int32) for f in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([f[sent.value[f]].tobytes() for f in all_], pa.binary())], names=["toxic", "features"])

    return rows.mapInArrow(run, "toxic int, features binary")


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


class OrdinalModel:
    """Weights by hashed feature (float32) and ordered thresholds."""

    def __init__(self, weights: np.ndarray, thresholds: np.ndarray):
        self.weights, self.thresholds = weights, thresholds

    def exceed(self, score: np.ndarray) -> np.ndarray:
        """P(grade > k) for each threshold, a column each."""
        return _sigmoid(np.asarray(score)[:, None] - self.thresholds)


def graded(toxic: np.ndarray, rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Grades 0, 1, 2, and the mask of features that tell the classes apart."""
    size = 1 << BITS
    seen = np.zeros((2, size))
    for t, r in zip(toxic, rows, strict=True):
        seen[int(t)][np.unique(r)] += 1
    n = np.maximum(np.bincount(toxic.astype(int), minlength=2)[:, None], 1)
    rate = (seen + 0.5) / (n + 1)
    ratio = rate[1] / rate[0]
    useful = (seen.sum(0) >= MIN_SUPPORT) & ((ratio >= MIN_RATIO) | (ratio <= 1 / MIN_RATIO))
    marks = useful & (ratio >= 10)
    hits = np.array([len(np.unique(r[marks[r]])) for r in rows])
    middle = np.median(hits[toxic == 1]) if (toxic == 1).any() else 0
    return np.where(toxic == 1, 1 + (hits > middle), 0), useful


def fit(toxic: np.ndarray, rows: list[np.ndarray], prior: float, penalty: float = 3e-4, steps: int = 300, rate: float = 0.05) -> OrdinalModel:
    """Penalised maximum likelihood by Adam; the classes are weighted to ``prior``, the labels' share of toxic."""
    grades, useful = graded(toxic, rows)
    used = np.flatnonzero(useful)
    if not (toxic == 1).any() or not (toxic == 0).any() or not len(used):
        return OrdinalModel(np.zeros(1 << BITS, np.float32), np.array([40.0, 41.0]))
    place = np.full(1 << BITS, -1, np.int64)
    place[used] = np.arange(len(used))
    rows = [place[r] for r in rows]
    rows = [r[r >= 0] for r in rows]
    owner, column = np.repeat(np.arange(len(rows)), [len(r) for r in rows]), np.concatenate(rows)
    share = toxic.mean()
    weight = np.where(toxic == 1, prior / share, (1 - prior) / (1 - share)) / len(rows)
    # parameters: weights, first threshold, logarithm of the step to the second
    x = np.zeros(len(used) + 2)
    x[-2] = np.log((1 - prior) / prior)
    m, v = np.zeros_like(x), np.zeros_like(x)
    for i in range(1, steps + 1):
        w, low, step = x[:-2], x[-2], np.exp(x[-1])
        score = np.bincount(owner, w[column], minlength=len(rows))
        p = _sigmoid(score[:, None] - np.array([low, low + step]))
        slope = p * (1 - p)
        chance = np.where(grades == 0, 1 - p[:, 0], np.where(grades == 1, p[:, 0] - p[:, 1], p[:, 1]))
        # derivative of -log chance by each cut's margin
        by = np.zeros_like(p)
        by[:, 0] = np.where(grades == 0, slope[:, 0], np.where(grades == 1, -slope[:, 0], 0))
        by[:, 1] = np.where(grades == 1, slope[:, 1], np.where(grades == 2, -slope[:, 1], 0))
        by *= (weight / np.maximum(chance, 1e-9))[:, None]
        g = np.empty_like(x)
        g[:-2] = np.bincount(column, by.sum(1)[owner], minlength=len(used)) + penalty * w
        g[-2], g[-1] = -by.sum(), -by[:, 1].sum() * step
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        x -= rate * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.999**i)) + 1e-9)
    weights = np.zeros(1 << BITS, np.float32)
    weights[used] = x[:-2]
    return OrdinalModel(weights, np.array([x[-2], x[-2] + np.exp(x[-1])]))


def train(docs: DataFrame, labels: DataFrame, per_class: int = MAX_PER_CLASS) -> OrdinalModel:
    """Fit on the bounded sample; without labels of both classes every document scores 0."""
    prior = labels.where("toxic is not null").agg(F.avg(F.col("toxic").cast("double"))).first()[0]
    rows = supported(durable(sample(docs, labels, per_class))).collect()  # at most 2 * per_class rows
    rows.sort(key=lambda r: (r["toxic"], bytes(r["features"])))
    toxic = np.array([r["toxic"] for r in rows], np.int64)
    return fit(toxic, [np.frombuffer(bytes(r["features"]), np.int32) for r in rows], min(max(prior or 0.0, 0.01), 0.99))


ADDED = ("p_mild", "p_severe", "severity", "grade", "rejected")


def scored_rows(docs: DataFrame, model: OrdinalModel) -> DataFrame:
    """(row, p_mild, p_severe, severity, grade, rejected): each row of ``docs`` as a struct beside its scores."""
    schema = T.StructType([T.StructField("row", docs.schema), *(T.StructField(a, t()) for a, t in zip(ADDED, (T.DoubleType, T.DoubleType, T.DoubleType, T.IntegerType, T.BooleanType), strict=True))])
    sent = docs.sparkSession.sparkContext.broadcast(model)  # 2**BITS floats, whatever the corpus

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        weights = model.weights
        cache = _Cache(lambda w: float(sum(weights[f] for f in features(w))))
        for batch in batches:
            score = np.array([sum(map(cache.__getitem__, words(t))) if t else 0.0 for t in batch.column(1).to_pylist()], np.float64)
            p = model.exceed(score)
            severity = p.sum(1)
            more = [p[:, 0], p[:, 1], severity, np.rint(severity).astype(np.int32), p[:, 0] >= REJECT_AT]
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, more)], names=["row", *ADDED])

    return rows_apart(docs, F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def score(docs: DataFrame, model: OrdinalModel) -> DataFrame:
    """All rows and columns of ``docs``, with p_mild, p_severe (at least that grade), severity, grade and rejected.

    Null and empty texts have no features: they get the thresholds' base rate and are kept. Each
    row is scored by its own text, so repeated rows score the same and a null doc_id does no harm.
    Long texts are read whole. A column of ``docs`` that has the name of a score gives way to it.
    """
    return beside_rows(scored_rows(docs, model), ADDED)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, p_mild, p_severe, severity, grade, rejected for every row; see ``score`` and ``train`` for odd rows."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return score(slim, train(slim, labels)).drop("text")
