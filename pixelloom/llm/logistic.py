"""Small logistic models on a bounded, documented sample: fitted on the driver, shipped to tasks as an array."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def fit(x: np.ndarray, y: np.ndarray, prior: np.ndarray | None = None, l2: float = 1.0, steps: int = 30) -> np.ndarray:
    """Weights, the last being the intercept, by Newton's method with a Gaussian prior (none on the intercept).

    A step that would make the fit worse, as from a prior far off, is halved until it does not.
    """
    x = np.column_stack([x, np.ones(len(x))])
    start = np.zeros(x.shape[1]) if prior is None else prior.astype(float)
    w, penalty = start.copy(), np.full(x.shape[1], l2)
    penalty[-1] = 1e-3
    if not len(y):
        return w
    loss = lambda w: np.logaddexp(0, x @ w).sum() - y @ (x @ w) + (penalty * (w - start) ** 2).sum() / 2
    for _ in range(steps):
        p = sigmoid(x @ w)
        gradient = x.T @ (p - y) + penalty * (w - start)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), gradient)
        worst = loss(w) + 1e-9
        while loss(w - step) > worst and np.abs(step).max() >= 1e-8:
            step = step / 2
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w


def predict(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return sigmoid(x @ w[:-1] + w[-1])


def logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def sample_ids(rows: DataFrame, limit: int) -> DataFrame:
    """At most ``limit`` rows of a table with doc_id, those of the smallest hash of doc_id: a bounded sample that any partitioning gives alike.

    Rows far above the expected last hash are dropped first, so that the final sort sees a few times ``limit`` rows.
    """
    keyed = rows.where("doc_id is not null").withColumn("_hash", F.xxhash64(F.col("doc_id").cast("string")))
    n = keyed.count()
    if n > 4 * limit:
        near = keyed.where(F.col("_hash") < int(-(2**63) + 2**64 * 2 * limit / n))
        keyed = near if near.count() >= limit else keyed
    return keyed.orderBy("_hash", "doc_id").limit(limit).drop("_hash")


def stratified_ids(rows: DataFrame, by: str, limit: int) -> DataFrame:
    """(doc_id, by, _text_hash) of at most ``limit`` rows of (doc_id, by, text), of every value of ``by`` as many as there are, or an equal share.

    A row's place among those of its value is known from its hash and the count of the value, so nothing is sorted by
    value; rows beyond twice the limit cannot be in the sample and are dropped before the final sort.
    """
    keyed = rows.where("doc_id is not null").select("doc_id", by, F.xxhash64("text").alias("_text_hash")).withColumn("_hash", F.xxhash64(F.col("doc_id").cast("string"), "_text_hash"))
    counts = keyed.groupBy(by).agg(F.count("*").alias("_n"))
    share = (F.col("_hash").cast("double") + 2.0**63) / 2.0**64
    placed = keyed.join(counts, by).withColumn("_place", share * F.col("_n")).where(F.col("_place") <= 2 * limit + 100)
    return placed.select("doc_id", by, "_text_hash", "_place").distinct().orderBy("_place", "doc_id", by).limit(limit).drop("_place")
