"""Training rows and small models shared by the classifiers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out


def labelled(docs: DataFrame, labels: DataFrame, target: str, broadcast_rows: int = 1_000_000) -> DataFrame:
    """doc_id, text and y (0.0 or 1.0) of the rows that may be learned from.

    The label table is counted; up to ``broadcast_rows`` rows it is broadcast (at
    most some 60 MB) so that texts don't move, and beyond that the join shuffles.
    Rows without a label, or labelled otherwise than 0 or 1, are left out.
    """
    own = labels.where(F.col(target).isin(0, 1) & ~held_out()).groupBy("doc_id").agg(F.max(target).cast("double").alias("y"))
    if own.count() <= broadcast_rows:
        own = F.broadcast(own)
    return docs.select("doc_id", "text").where(~held_out()).join(own, "doc_id")


def hashed_share(rows: DataFrame, n: int, limit: int) -> DataFrame:
    """Of ``n`` rows those with hashes of doc_id in a share that holds somewhat more than
    ``limit`` of them; all if there are no more."""
    share = min(1 << 30, int(1.2 * limit / max(n, 1) * (1 << 30)) + 1)
    return rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < share) if n > limit else rows


def bounded_sample(rows: DataFrame, n: int, limit: int) -> pa.Table:
    """At most ``limit`` of ``n`` rows, the same ones in every run. A share of the
    hashes is taken first, so that no task sends ``limit`` rows. As Arrow, so that
    the driver holds arrays and not an object for each number."""
    return hashed_share(rows, n, limit).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit).toArrow()


def lists(column: pa.ChunkedArray) -> list[np.ndarray]:
    """A list column as views of its values."""
    out = []
    for chunk in column.chunks:
        values, ends = chunk.values.to_numpy(zero_copy_only=False), chunk.offsets.to_numpy()
        out += [values[a:b] for a, b in zip(ends, ends[1:], strict=False)]
    return out


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 40) -> np.ndarray:
    """Weights and, last, intercept of a ridge logistic regression, by Newton's method."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    hold = np.full(x.shape[1], ridge)
    for _ in range(steps):
        p = sigmoid(x @ w)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(hold), x.T @ (y - p) - hold * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))
