"""Quality classifier: a factorisation machine.

Features are hashed words, structure statistics in quantile bins (case, symbol
and digit shares, repetition, line shape, …) and length metadata taken from
the text. Every pair of features interacts through low-rank factors; a score
takes time linear in a document's features by the sum-of-squares identity

    sum_{i<j} <v_i, v_j> x_i x_j = 1/2 sum_f [(sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2].

Training reads a bounded sample of labelled rows (``MAX_LABELLED``), never the
held-out fold; bin edges come from it too. Scoring reads every whole text, in
place: no shuffle.

Defined cases: null and empty texts are scored like any text, from the bins of
a text of no length; without usable labels every score is 0.5; of a doc_id
labelled twice the larger label counts; repeated rows are scored each; an
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship_package
from .textstats import NAMES, hashed_words, held_out, labelled_sample, structure, usable_labels

#: Labelled rows that training reads at most.
MAX_LABELLED = 6000
WORD_DIMS = 1 << 13
BINS = 10
RANK = 6
THRESHOLD = 0.3
MODULUS, HELD = 5, 0


def features(stats: list[float], buckets: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers and values: words share a weight of one, each bin has its own."""
    bins = np.array([np.searchsorted(edges[k], v, side="right") + k * BINS for k, v in enumerate(stats)], np.int32)
    ids = np.concatenate([bins + np.int32(WORD_DIMS), buckets])
    values = np.concatenate([np.ones(len(bins), np.float32), np.full(len(buckets), 1 / np.sqrt(max(1, len(buckets))), np.float32)])
    return ids, values


@dataclass
class FactorisationMachine:
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def raw(self, ids: np.ndarray, values: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Scores before the sigmoid of rows laid end to end, each with a feature at least."""
        v = self.factors[ids] * values[:, None]
        sums, squares = np.add.reduceat(v, starts, axis=0), np.add.reduceat(v * v, starts, axis=0)
        return self.bias + np.add.reduceat(self.weights[ids] * values, starts) + 0.5 * (sums**2 - squares).sum(axis=1)

    @classmethod
    def trained(cls, rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, size: int, epochs: int = 14, rate: float = 0.08, decay: float = 2e-4, seed: int = 7) -> FactorisationMachine:
        """Log loss by Adagrad over shuffled batches; the seed fixes the result."""
        rng = np.random.default_rng(seed)
        share = float(np.clip(labels.mean(), 0.02, 0.98))
        m = cls(float(np.log(share / (1 - share))), np.zeros(size, np.float32), rng.normal(0, 0.02, (size, RANK)).astype(np.float32))
        g_b, g_w, g_v = 1e-6, np.full(size, 1e-6, np.float32), np.full((size, RANK), 1e-6, np.float32)
        for _ in range(epochs):
            order = rng.permutation(len(rows))
            for at in range(0, len(order), 64):
                part = order[at : at + 64]
                ids, values = np.concatenate([rows[k][0] for k in part]), np.concatenate([rows[k][1] for k in part])
                sizes = np.array([len(rows[k][0]) for k in part])
                starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
                off = 1 / (1 + np.exp(-np.clip(m.raw(ids, values, starts), -30, 30))) - labels[part]
                each = np.repeat(off, sizes).astype(np.float32)
                v = m.factors[ids]
                sums = np.repeat(np.add.reduceat(v * values[:, None], starts, axis=0), sizes, axis=0)
                step_w, step_v = each * values, (each * values)[:, None] * (sums - v * values[:, None])
                used, where = np.unique(ids, return_inverse=True)
                d_w = np.bincount(where, step_w, len(used)).astype(np.float32) + decay * m.weights[used]
                d_v = np.stack([np.bincount(where, step_v[:, f], len(used)) for f in range(RANK)], axis=1).astype(np.float32) + decay * m.factors[used]
                g_b += float(off.sum()) ** 2
                g_w[used] += d_w**2
                g_v[used] += d_v**2
                m.bias -= rate * float(off.sum()) / np.sqrt(g_b)
                m.weights[used] -= rate * d_w / np.sqrt(g_w[used])
                m.factors[used] -= rate * d_v / np.sqrt(g_v[used])
        return m


@dataclass
class QualityModel:
    machine: FactorisationMachine | None
    edges: np.ndarray

    def scores(self, texts: list[bytes]) -> np.ndarray:
        if self.machine is None or not texts:
            return np.full(len(texts), 0.5)
        ids, values, sizes = [], [], []
        for t in texts:
            stats, words = structure(t)
            i, v = features(stats, hashed_words(words, WORD_DIMS), self.edges)
            ids.append(i)
            values.append(v)
            sizes.append(len(i))
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
        raw = self.machine.raw(np.concatenate(ids), np.concatenate(values), starts)
        return 1 / (1 + np.exp(-np.clip(raw.astype(np.float64), -30, 30)))


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, 500):
            batch = whole.slice(at, 500)
            stats, buckets = [], []
            for t in batch.column(0).to_pylist():
                s, words = structure(t or b"")
                stats.append(s)
                buckets.append(hashed_words(words, WORD_DIMS))
            yield pa.RecordBatch.from_arrays([pa.array(stats, pa.list_(pa.float64())), pa.array(buckets, pa.list_(pa.int32())), batch.column(1)], ["stats", "buckets", "label"])


def fit(docs: DataFrame, labels: DataFrame, column: str = "quality", modulus: int = MODULUS, held: int = HELD, limit: int = MAX_LABELLED) -> QualityModel:
    """Trains on at most ``limit`` labelled rows outside the held-out fold."""
    ship_package(docs.sparkSession)
    sample = labelled_sample(docs, usable_labels(labels, column, modulus, held), limit)
    got = sample.select("text", "label", "doc_id").mapInArrow(_measured, "stats array<double>, buckets array<int>, label int").toArrow()
    n = got.num_rows
    stats = np.array(got.column(0).to_pylist(), float).reshape(n, len(NAMES))
    if not n:
        return QualityModel(None, np.zeros((len(NAMES), BINS - 1)))
    order = np.lexsort(stats.T)  # rows come in any order; training must not depend on it
    stats, y = stats[order], np.array(got.column(2).to_pylist(), float)[order]
    buckets = [np.array(x, np.int32) for x in got.column(1).to_pylist()]
    edges = np.quantile(stats, np.linspace(0, 1, BINS + 1)[1:-1], axis=0).T
    rows = [features(list(s), buckets[k], edges) for s, k in zip(stats, order)]
    return QualityModel(FactorisationMachine.trained(rows, y, WORD_DIMS + BINS * len(NAMES)), edges)


def score(docs: DataFrame, model: QualityModel, threshold: float = THRESHOLD, modulus: int = MODULUS, held: int = HELD) -> DataFrame:
    """doc_id, held_out, score, predicted for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 200):
                batch = whole.slice(at, 200)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.scores([t or b"" for t in batch.column(1).to_pylist()]))], ["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, f"doc_id {kind}, score double")
    return scored.select("doc_id", held_out(modulus, held).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, fit(docs, labels))


def drop_rejected(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows whose text is scored below the threshold.

    The score is a filter on the text where the row is read; nothing is joined.
    """
    model = fit(docs, labels)

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        every = [bytes(t) if t is not None else b"" for t in texts]
        parts = [model.scores(every[k : k + 200]) for k in range(0, len(every), 200)]
        return pd.Series(np.concatenate(parts) if parts else [], dtype=float)

    return docs.where(scored(F.col("text").cast("binary")) >= threshold)
