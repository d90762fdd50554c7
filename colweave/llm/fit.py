"""Labelled samples of bounded size, and the small models fitted on them on the driver."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import remainder, whole_text

#: Labelled rows that a fit reads at most. Their number is the only thing here that is bounded.
SAMPLE_ROWS = 20_000


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label: str, modulus: int, held: int, most: int = SAMPLE_ROWS
) -> DataFrame:
    """Rows (id, text, y): whole texts whose label may be learned from.

    Ids whose crc32 leaves ``held`` are left out. Beyond ``most`` labelled ids, those of the smallest
    hash are taken, the same ones each time. Null ids and labels teach nothing; an id labelled twice
    counts once, with its larger label; rows of ``docs`` that share an id all count.
    """
    chosen = (
        labels.where(remainder("doc_id", modulus) != held)
        .groupBy("doc_id")
        .agg(F.max(F.col(label).cast("double")).alias("y"))
        .where("doc_id is not null and y is not null")
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(most)
        .select(F.col("doc_id").alias("id"), "y")
    )
    texts = docs.select(F.col("doc_id").alias("id"), whole_text("text").alias("text"))
    return texts.join(F.broadcast(chosen), "id")  # of ``most`` short rows at most


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def lasso_logistic(
    x: np.ndarray, y: np.ndarray, penalty: float, steps: int = 400, prior: np.ndarray | None = None
) -> tuple[float, np.ndarray]:
    """Intercept and weights by accelerated proximal gradient; the penalty is the L1 norm of w - prior."""
    n, k = x.shape
    prior = np.zeros(k) if prior is None else prior
    both = np.column_stack([np.ones(n), x])
    centre = np.concatenate([[0.0], prior])
    rate = 4 * n / max(np.linalg.norm(both, 2) ** 2, 1e-9)
    w = old = centre.copy()
    t = 1.0
    for _ in range(steps):
        t_next = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead = w + (t - 1) / t_next * (w - old)
        old, t = w, t_next
        moved = ahead - rate * (both.T @ (sigmoid(both @ ahead) - y) / n) - centre
        moved[1:] = np.sign(moved[1:]) * np.maximum(np.abs(moved[1:]) - rate * penalty, 0)
        w = moved + centre
    return float(w[0]), w[1:]


def constant_score(y: np.ndarray) -> float:
    """The score of every text where the sample has one class or no row."""
    return float((y.sum() + 1) / (len(y) + 2))
