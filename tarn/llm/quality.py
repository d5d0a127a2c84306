"""Quality classifier: supervised subword embeddings.

A document is the average of learned vectors: one for each word, one for each character n-gram of it, all hashed into
one table, and one for each word that stands again right after itself, which is what an average of words alone can't
see. All weigh the same. A softmax layer turns the average into class probabilities; table and layer are trained by stochastic
gradient descent in numpy. As the output is linear in the average, a trained model is one number a feature, and a
word's features are summed once and kept.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from itertools import chain, islice
from math import exp
from operator import eq

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import bounded_batches, crc_fold
from .samples import sampled, training_labels
from .subwords import Letters, WordValues

BITS = 17
GRAMS = (3, 4)
AGAIN = 1 << BITS  # the feature of a word that stands right after itself


def word_features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, place in words) of the words and of their character n-grams, with marks at their ends. Case counts."""
    letters = Letters(words)
    bucket, word = zip(letters.whole(BITS), *(letters.grams(n, BITS) for n in GRAMS), strict=True)
    return np.concatenate(bucket), np.concatenate(word)


def document_features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, how often) of a whole text."""
    parts = (text or "").split()
    words = Counter(parts)
    if not words:
        return np.empty(0, np.int32), np.empty(0, np.float32)
    bucket, word = word_features(list(words))
    at, place = np.unique(bucket, return_inverse=True)
    counts = np.bincount(place, np.fromiter(words.values(), np.float64, len(words))[word])
    if again := repeats(parts):
        at, counts = np.append(at, AGAIN), np.append(counts, again)
    return at.astype(np.int32), counts.astype(np.float32)


def repeats(words: list[str]) -> int:
    """How many words stand right after themselves."""
    return sum(map(eq, words, islice(words, 1, None)))


@dataclass
class Model:
    """One number a feature, and a constant: the difference of the two classes' logits."""

    features: np.ndarray
    bias: float


def gradients(table: np.ndarray, out: np.ndarray, bias: np.ndarray, at: np.ndarray, share: np.ndarray, label: int) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """(loss, and its gradients by the vectors at ``at``, by out and by bias) of softmax cross-entropy for one document."""
    hidden = share @ table[at]
    z = out @ hidden + bias
    z = z - z.max()
    p = np.exp(z)
    p /= p.sum()
    loss = -float(np.log(max(float(p[label]), 1e-300)))
    p[label] -= 1
    return loss, np.outer(share, p @ out), np.outer(p, hidden), p


def train(rows: list[tuple[np.ndarray, np.ndarray, int]], dimensions: int = 16, epochs: int = 4, rate: float = 0.5, vector_rate: float = 50.0, seed: int = 7) -> Model:
    """Stochastic gradient descent on softmax cross-entropy, a document a step, with falling rates; classes weigh as they occur.

    The gradient by a vector has its feature's share of the document as a factor, which is small; the table's rate is a
    constant of its own for that. A document without words moves the bias alone. Without rows all scores are 0.5.
    """
    rng = np.random.default_rng(seed)
    table = rng.uniform(-1 / dimensions, 1 / dimensions, ((1 << BITS) + 1, dimensions)).astype(np.float32)
    out, bias = np.zeros((2, dimensions), dtype=np.float32), np.zeros(2, dtype=np.float32)
    steps, step = max(1, epochs * len(rows)), 0
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            at, counts, label = rows[i]
            fall = np.float32(1 - step / steps)
            step += 1
            share = counts / max(counts.sum(), 1)
            _, by_vector, by_out, by_bias = gradients(table, out, bias, at, share, label)
            table[at] -= np.float32(vector_rate) * fall * by_vector
            out -= np.float32(rate) * fall * by_out
            bias -= np.float32(0.1 * rate) * fall * by_bias
    return Model(table @ (out[1] - out[0]), float(bias[1] - bias[0]))


def features_of(docs: DataFrame, ids: DataFrame, id_col: str, text_col: str) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """Features and labels of the documents in ids (id, label), a bounded sample, on the driver, in the order of their ids.

    A document has 2**17 + 1 features at most, however long it is.
    """
    import pyarrow as pa

    def extract(batches):
        for batch in bounded_batches(batches, 64):
            got = [document_features(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([a.tobytes() for a, _ in got], pa.binary()), pa.array([c.tobytes() for _, c in got], pa.binary())], names=["id", "label", "at", "counts"])

    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(ids), "id").select("id", "text", "label")
    got = base.mapInArrow(extract, f"id {docs.schema[id_col].dataType.simpleString()}, label int, at binary, counts binary").toArrow().sort_by([("id", "ascending"), ("at", "ascending")])
    return [(np.frombuffer(a.as_py(), np.int32), np.frombuffer(c.as_py(), np.float32), y.as_py()) for y, a, c in zip(got["label"], got["at"], got["counts"], strict=True)]


def fit_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 3, held_out: int = 1, most: int = 2500, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """A model of label 1 against 0, from the texts of at most ``most`` labelled ids outside the held-out fold.

    Null ids and labels are left out; of several labels of one id the greatest counts; rows of one id are a document
    each; null and empty texts have no features and move the constant alone; labels without a document have no effect.
    Without any labelled document, as with empty tables, scores are 0.5. Other columns are not read.
    """
    ids = sampled(training_labels(labels, label, folds, held_out, id_col), most, 4)
    return train(features_of(docs, ids, id_col, text_col))


class Scorer:
    """Scores of whole texts; what a word adds is summed once and kept."""

    def __init__(self, model: Model):
        self.bias, self.again = model.bias, float(model.features[AGAIN])

        def values(words: list[str]) -> list[complex]:
            """Sum and number of each word's features."""
            bucket, word = word_features(words)
            return (np.bincount(word, model.features[bucket], len(words)) + 1j * np.bincount(word, minlength=len(words))).tolist()

        self.words = WordValues(values)

    def scores(self, texts: list[str | None]) -> list[float]:
        parts = [(t or "").split() for t in texts]
        self.words.learn(chain.from_iterable(parts))
        out = []
        for words in parts:
            z = self.bias
            if words:
                both, again = sum(map(self.words.__getitem__, words)), repeats(words)
                z += (both.real + again * self.again) / (both.imag + again)
            out.append(1 / (1 + exp(-min(max(z, -500.0), 500.0))))
        return out


def keep_quality(docs: DataFrame, model: Model, least: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of docs that score at least ``least``, as they are, with all their columns.

    Null and empty texts score by the constant alone; rows that repeat are judged each; an empty table stays empty.
    """
    import pyarrow as pa

    known, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)

    def keep(batches):
        scorer = Scorer(known.value)
        for batch in bounded_batches(batches):
            yield batch.filter(pa.array([s >= least for s in scorer.scores(batch.column(at).to_pylist())], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)


def score_quality(docs: DataFrame, model: Model, folds: int = 3, held_out: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, held_out, score (probability of label 1), predicted (score >= 0.5).

    Whole texts are scored; null and empty ones by the constant alone. A null id isn't held out. Null and repeated ids
    stay as they are; empty tables give empty results; other columns of docs are not read.
    """
    import pyarrow as pa

    known = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches):
        scorer = Scorer(known.value)
        for batch in bounded_batches(batches):
            out = scorer.scores(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(out, pa.float64()), pa.array([int(s >= 0.5) for s in out], pa.int32())], names=[id_col, "held_out", "score", "predicted"])

    held = F.coalesce(crc_fold(F.col(id_col), folds) == held_out, F.lit(False))
    return docs.select(id_col, text_col, held.alias("_held")).mapInArrow(score, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, held_out boolean, score double, predicted int")
