"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic documents are the positives; all other text is unlabelled. A linear model over words, their beginnings
and their n-grams is trained in numpy on the class-prior-corrected risk

    prior * E_p[l(f)] + max(0, E_u[l(-f)] - prior * E_p[l(-f)])

whose second part, an estimate of the risk on negatives, is kept from going below zero: where a batch takes it there,
the step goes back up instead.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import chain
from math import exp, fsum

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import bounded_batches, crc_fold
from .decontaminate import words_of
from .samples import sampled, training_labels
from .subwords import Letters, WordValues

BITS = 18
BUCKETS = 1 << BITS
STARTS = (4, 5, 6)


def word_features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, place in words) of words (lower-cased) and of their beginnings in characters."""
    letters = Letters(words)
    bucket, word = zip(letters.whole(BITS), *(letters.beginnings(n, BITS) for n in STARTS), strict=True)
    return np.concatenate(bucket), np.concatenate(word)


def document_words(text: str | None) -> set[str]:
    """The distinct words of a whole text."""
    return {w.decode(errors="replace") for w in set(words_of(text))}


@dataclass
class Model:
    features: np.ndarray
    bias: float


class _Rows:
    """Documents as lists of buckets, one after another."""

    def __init__(self, rows: list[np.ndarray]):
        self.sizes = np.array([len(r) for r in rows], dtype=np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])
        self.flat = np.concatenate([*rows, np.empty(0, np.int32)]).astype(np.int64)

    def take(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(buckets, the document of each)."""
        n = self.sizes[which]
        at = np.repeat(self.starts[which] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return self.flat[at], np.repeat(np.arange(len(which)), n)


def risk(zp: np.ndarray, zu: np.ndarray, prior: float) -> tuple[float, np.ndarray, np.ndarray]:
    """(risk, and what descends by the outputs on positives and on unlabelled text): the gradient of the risk, or, where its
    second part is below zero, that of minus this part, so that the step goes back up."""
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -500, 500)))
    on_positive, as_negative = np.logaddexp(0, -zp).mean(), np.logaddexp(0, zp).mean()
    negative = np.logaddexp(0, zu).mean() - prior * as_negative
    up_p, down_p, down_u = -sigmoid(-zp) / len(zp), sigmoid(zp) / len(zp), sigmoid(zu) / len(zu)
    if negative >= 0:
        return float(prior * on_positive + negative), prior * (up_p - down_p), down_u
    return float(prior * on_positive), prior * down_p, -down_u


def train(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, epochs: int = 30, batch: int = 512, rate: float = 0.1, sparsity: float = 2e-3, momentum: float = 0.9, least: int = 4, seed: int = 5) -> Model:
    """Proximal stochastic gradient descent on the non-negative risk with logistic loss.

    An L1 penalty takes away the weights that chance made. The constant is then set where the same risk, with zero-one loss, is least on the sample. Buckets in fewer than
    ``least`` documents of it are left out. Without positives or unlabelled text every score is the prior.
    """
    theta, bias = np.zeros(BUCKETS), float(np.log(max(prior, 1e-6) / max(1 - prior, 1e-6)))
    if not positive or not unlabelled:
        return Model(theta, bias)
    held = np.zeros(BUCKETS, dtype=np.int64)
    for r in (*positive, *unlabelled):
        held[np.unique(r)] += 1
    pos, unl = (_Rows([r[held[r] >= least] for r in rows]) for rows in (positive, unlabelled))
    rng = np.random.default_rng(seed)
    velocity, pull = np.zeros(BUCKETS), 0.0
    share = max(batch // 4, round(batch * len(pos.sizes) / (len(pos.sizes) + len(unl.sizes))))
    rest = batch - share
    batches = max(1, len(unl.sizes) // rest)
    for step in range(epochs * batches):
        k = step % batches
        if not k:
            order_p, order_u = rng.permutation(len(pos.sizes)), rng.permutation(len(unl.sizes))
        lr = rate * (1 - step / (epochs * batches))
        p, u = order_p[np.arange(k * share, (k + 1) * share) % len(order_p)], order_u[np.arange(k * rest, (k + 1) * rest) % len(order_u)]
        fp, dp = pos.take(p)
        fu, du = unl.take(u)
        zp, zu = np.bincount(dp, theta[fp], len(p)) + bias, np.bincount(du, theta[fu], len(u)) + bias
        _, gp, gu = risk(zp, zu, prior)
        velocity = momentum * velocity + np.bincount(fp, gp[dp], BUCKETS) + np.bincount(fu, gu[du], BUCKETS)
        pull = momentum * pull + gp.sum() + gu.sum()
        theta = theta - lr * velocity
        theta = np.sign(theta) * np.maximum(0, np.abs(theta) - lr * sparsity / (1 - momentum))
        bias -= 0.1 * lr * pull
    return Model(theta, -threshold(np.array([theta[r].sum() for r in positive]), np.array([theta[r].sum() for r in unlabelled]), prior))


def threshold(positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> float:
    """The highest of the thresholds with the least class-prior-corrected risk under zero-one loss."""
    zp, zu = np.sort(positive), np.sort(unlabelled)
    at = np.unique(zp)
    # the least positive, between any two, and above all
    at = np.concatenate([at[:1], (at[1:] + at[:-1]) / 2, [at[-1] + 1e-6]])
    caught, flagged = 1 - np.searchsorted(zp, at) / len(zp), 1 - np.searchsorted(zu, at) / len(zu)
    risk = prior * (1 - caught) + np.maximum(0, flagged - prior * caught)
    return float(at[np.flatnonzero(risk <= risk.min() + 1e-12)[-1]])


def bucket_lists(docs: DataFrame, ids: DataFrame, id_col: str, text_col: str) -> list[np.ndarray]:
    """The buckets of all distinct words of each document in ids (a bounded sample), on the driver, in the order of their ids."""
    import pyarrow as pa

    def extract(batches):
        for batch in bounded_batches(batches, 64):
            out = [word_features(sorted(words))[0].astype(np.int32).tobytes() if (words := document_words(t)) else b"" for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["id", "at"])

    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(ids.select("id")), "id", "left_semi")
    got = base.mapInArrow(extract, f"id {docs.schema[id_col].dataType.simpleString()}, at binary").toArrow().sort_by([("id", "ascending"), ("at", "ascending")])
    return [np.frombuffer(a.as_py(), np.int32) for a in got["at"]]


def fit_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = 5, held_out: int = 0, most_positive: int = 3000, most_unlabelled: int = 6000, prior: float | None = None, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """A model from at most ``most_positive`` confirmed documents outside the held-out fold and at most ``most_unlabelled`` of all texts.

    ``prior`` is the share of toxic documents; by default, that among the labels outside the held-out fold. Null ids and
    labels are left out; of several labels of one id the greatest counts; rows of one id are a document each; null and
    empty texts have no features. Without positives, as with empty tables, every score is the prior. Other columns are
    not read.
    """
    known = training_labels(labels, label, folds, held_out, id_col)
    if prior is None:
        prior = known.agg(F.avg((F.col("label") == 1).cast("double"))).first()[0] or 0.0
    positive = bucket_lists(docs, sampled(known.where("label = 1"), most_positive, 5), id_col, text_col)
    anyone = docs.select(F.col(id_col).alias("id")).where("id IS NOT NULL")
    return train(positive, bucket_lists(docs, sampled(anyone, most_unlabelled, 6), id_col, text_col), prior)


def score_toxicity(docs: DataFrame, model: Model, folds: int = 5, held_out: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, held_out, score (0 to 1, higher: toxic likelier), predicted (score >= 0.5).

    Whole texts are scored; null and empty ones by the constant alone. A null id isn't held out. Null and repeated ids
    stay as they are; empty tables give empty results; other columns of docs are not read.
    """
    import pyarrow as pa

    known = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches):
        m = known.value

        def values(words: list[str]) -> list[float]:
            bucket, word = word_features(words)
            return np.bincount(word, m.features[bucket], len(words)).tolist()

        words = WordValues(values)
        for batch in bounded_batches(batches):
            parts = [document_words(t) for t in batch.column(1).to_pylist()]
            words.learn(chain.from_iterable(parts))
            # exact sums, whatever the order of a set
            z = [m.bias + fsum(map(words.__getitem__, p)) for p in parts]
            out = [1 / (1 + exp(-min(max(x, -500.0), 500.0))) for x in z]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(out, pa.float64()), pa.array([int(s >= 0.5) for s in out], pa.int32())], names=[id_col, "held_out", "score", "predicted"])

    held = F.coalesce(crc_fold(F.col(id_col), folds) == held_out, F.lit(False))
    return docs.select(id_col, text_col, held.alias("_held")).mapInArrow(score, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, held_out boolean, score double, predicted int")
