"""Toxicity scores by non-negative positive-unlabelled learning.

Confirmed toxic texts are the positives, other texts of the training fold are unlabelled:
some of them are toxic too, at the class prior. The risk of the negative class is that of
the unlabelled texts less the prior times that of the positives, and while this estimate
is below zero its gradient is followed upwards, so that the model can't fit it away. The
classifier is logistic over word and word-beginning counts, with an L1 step after each
update: words without a bearing get no weight, and long texts don't add up noise.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweave.llm.arrow import batch, free_name, map_batches, slices
from riskweave.session import written_table

#: Bounds of the training sample: confirmed toxic texts, unlabelled texts.
MAX_POSITIVE = 1500
MAX_UNLABELLED = 6000
#: Word beginnings of these lengths are features beside whole words.
PREFIXES = (4, 5, 6)
# Parameters of the classifier. A feature's value is its count in the text, CAP at most; it
# needs MIN_POSITIVE_TEXTS positive texts; of more than MAX_FEATURES those in most
# positive texts are used.
CAP = 3
MIN_POSITIVE_TEXTS = 8
MAX_FEATURES = 30_000
CACHE_WORDS = 200_000

_WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32
    for b in range(256)
)


def words_of(text: bytes | None) -> list[bytes]:
    """Runs of ASCII letters, digits and non-ASCII bytes, A-Z lower-cased."""
    return text.translate(_WORD_BYTES).split() if text else []


def features_of(word: bytes) -> list[str]:
    w = word.decode("utf-8", "replace")
    return [w, *(w[:k] + "*" for k in PREFIXES if len(w) > k)]


def text_features(text: bytes | None) -> Counter:
    found: Counter = Counter()
    for word, n in Counter(words_of(text)).items():
        for f in features_of(word):
            found[f] += n
    return found


class _Rows:
    """Sparse counts of texts over a fixed set of features."""

    def __init__(self, vocabulary: dict[str, int]):
        self.vocabulary = vocabulary
        self.index: list[np.ndarray] = []
        self.value: list[np.ndarray] = []

    def add(self, counts: Counter) -> None:
        known = self.vocabulary
        kept = [(known[f], min(n, CAP)) for f, n in counts.items() if f in known]
        self.index.append(np.array([i for i, _ in kept], dtype=np.int64))
        self.value.append(np.array([v for _, v in kept], dtype=float))

    def close(self) -> None:
        self.rows = len(self.index)
        lengths = [len(i) for i in self.index]
        self.row = np.repeat(np.arange(self.rows), lengths)
        self.index = np.concatenate([np.empty(0, np.int64), *self.index])
        self.value = np.concatenate([np.empty(0), *self.value])

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.value * w[self.index], minlength=self.rows)

    def back(self, g: np.ndarray, n: int) -> np.ndarray:
        return np.bincount(self.index, self.value * g[self.row], minlength=n)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit_nnpu(
    positive: _Rows, unlabelled: _Rows, n: int, prior: float,
    steps: int = 300, rate: float = 0.1, l1: float = 0.01,
) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the non-negative risk (Adam steps, soft threshold).

    The threshold falls with the square root of the positives, as the noise of means does.
    """
    l1 = min(l1 / math.sqrt(max(positive.rows, 1)), 1e-3)
    w, b = np.zeros(n), 0.0
    m, s = np.zeros(n + 1), np.zeros(n + 1)
    for step in range(1, steps + 1):
        zp, zu = positive.dot(w) + b, unlabelled.dot(w) + b
        sp, su = _sigmoid(zp), _sigmoid(zu)
        negative_risk = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        if negative_risk >= 0:
            gp = prior * (sp - 1 - sp) / len(zp)
            gu = su / len(zu)
        else:
            gp = prior * sp / len(zp)
            gu = -su / len(zu)
        g = np.append(positive.back(gp, n) + unlabelled.back(gu, n), gp.sum() + gu.sum())
        m = 0.9 * m + 0.1 * g
        s = 0.99 * s + 0.01 * g * g
        size = rate / (np.sqrt(s / (1 - 0.99**step)) + 1e-4)
        move = size * m / (1 - 0.9**step)
        w = w - move[:-1]
        b -= move[-1]
        w = np.sign(w) * np.maximum(np.abs(w) - l1 * size[:-1], 0)
    return w, b


def train(sample: Iterable[tuple[bool, bytes | None]], prior: float) -> list[tuple[str, float]]:
    """Non-zero weights from (is positive, text) pairs, positives first; "" is the bias."""
    first: list[Counter] = []
    documents: Counter = Counter()
    positive = unlabelled = None
    vocabulary: dict[str, int] = {}

    def open_rows():
        least = min(MIN_POSITIVE_TEXTS, max(2, len(first) // 4))
        common = sorted((-k, f) for f, k in documents.items() if k >= least)[:MAX_FEATURES]
        vocabulary.update({f: i for i, (_, f) in enumerate(sorted(common, key=lambda x: x[1]))})
        rows = _Rows(vocabulary)
        for counts in first:
            rows.add(counts)
        return rows

    for is_positive, text in sample:
        counts = text_features(text)
        if is_positive:
            first.append(counts)
            documents.update(counts.keys())
        else:
            if positive is None:
                positive, unlabelled = open_rows(), _Rows(vocabulary)
            unlabelled.add(counts)
    if not first or unlabelled is None:
        return [("", math.log(max(prior, 1e-6) / (1 - min(max(prior, 1e-6), 0.999))))]
    positive.close()
    unlabelled.close()
    w, b = fit_nnpu(positive, unlabelled, len(vocabulary), prior)
    return [("", float(b)), *((f, float(w[i])) for f, i in vocabulary.items() if w[i] != 0)]


def smallest(df: DataFrame, by: Column, k: int) -> DataFrame:
    """The ``k`` rows of the smallest hashes: a cut is found from hashes alone, before rows move."""
    ranked = df.select(by.alias("_h")).orderBy("_h").limit(k)
    cut = ranked.agg(F.max("_h")).first()[0]
    near = df.withColumn("_h", by).filter(F.col("_h") <= F.lit(cut))
    return near.orderBy("_h", *[c for c in df.columns]).limit(k).drop("_h")


def fit_toxicity(
    docs: DataFrame, labels: DataFrame, in_training: Column,
    max_positive: int = MAX_POSITIVE, max_unlabelled: int = MAX_UNLABELLED,
) -> list[tuple[str, float]]:
    """Learn from labelled toxic texts and unlabelled ones, both where ``in_training`` holds.

    ``in_training`` is a condition on doc_id. The prior is the share of toxic rows among the
    labels in training. The sample is bounded by ``max_positive`` and ``max_unlabelled`` rows
    (those of the smallest hashes of doc_id), so one task trains on it. Without positives or
    texts the model is the prior alone. At most MAX_FEATURES weights reach the driver.
    """
    known = labels.filter(in_training & F.col("toxic").isNotNull())
    shares = known.agg(F.avg(F.col("toxic").cast("double"))).first()[0]
    prior = min(max(shares or 0.0, 0.0), 0.9)
    key = F.xxhash64("doc_id")
    toxic = known.filter(F.col("toxic") == 1).select("doc_id").distinct()
    chosen = smallest(toxic, key, max_positive)  # at most max_positive ids
    texts = docs.select("doc_id", "text").filter(in_training & F.col("text").isNotNull())
    positives = texts.join(F.broadcast(chosen), "doc_id", "left_semi")
    # Of rows that share a doc_id the text of the smallest hash stands for the document.
    least = F.min_by("text", F.struct(F.xxhash64("text"), "text"))
    positives = positives.groupBy("doc_id").agg(least.alias("text")).withColumn("_p", F.lit(True))
    others = smallest(texts, key, max_unlabelled).withColumn("_p", F.lit(False))
    sample = positives.unionByName(others)
    ordered = sample.repartition(1).sortWithinPartitions(F.desc("_p"), "doc_id", "text")

    def make(arrow):
        def run(batches):
            rows = (
                (p, t)
                for b in slices(batches, 500)
                for p, t in zip(
                    b.column("_p").to_pylist(), b.column("text").to_pylist(), strict=True
                )
            )
            model = train(rows, prior)
            yield batch(arrow, {"f": [f for f, _ in model], "w": [w for _, w in model]})

        return run

    ordered = ordered.select("_p", F.col("text").cast("binary").alias("text"))
    model = map_batches(ordered, "f string, w double", make)
    # Written once: a lost executor must not lead to a second, different training.
    return [(r["f"], r["w"]) for r in written_table(model, "toxicity").collect()]


class _Scorer(dict):
    """For each word the weighted features it has; nearly all words have none."""

    def __init__(self, model: list[tuple[str, float]]):
        super().__init__()
        self.weights = dict(model)
        self.bias = self.weights.pop("", 0.0)

    def __missing__(self, word: bytes):
        weights = self.weights
        found = tuple(f for f in features_of(word) if f in weights) or None
        if len(self) >= CACHE_WORDS:
            self.clear()
        if len(word) <= 64:
            self[word] = found
        return found

    def score(self, text: bytes | None) -> float:
        counts = Counter(f for fs in map(self.__getitem__, words_of(text)) if fs for f in fs)
        z = self.bias + sum(self.weights[f] * min(n, CAP) for f, n in counts.items())
        return 1 / (1 + math.exp(-min(max(z, -40.0), 40.0)))


def toxicity_scores(
    docs: DataFrame, model: list[tuple[str, float]], threshold: float = 0.7, text: str = "text"
) -> DataFrame:
    """``docs`` with score (0 to 1) and predicted (1 from ``threshold`` on) of each whole text.

    A NULL or empty text has no features and gets the bias alone. Rows stay one to one,
    other columns are kept, and one named like a result is replaced. No shuffle.
    """
    given = free_name(docs, "_text")
    kept = [c for c in docs.columns if c not in ("score", "predicted")]
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*kept).schema]
    schema = ", ".join([*fields, "score double", "predicted int"])

    def make(arrow):
        def run(batches):
            scorer = _Scorer(model)
            for b in slices(batches, 1000):
                scores = [scorer.score(t) for t in b.column(given).to_pylist()]
                out = {c: b.column(c) for c in kept}
                out["score"] = scores
                out["predicted"] = [int(s >= threshold) for s in scores]
                yield batch(arrow, out)

        return run

    return map_batches(docs.select(*kept, F.col(text).cast("binary").alias(given)), schema, make)
