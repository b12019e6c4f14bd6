"""A bounded labelled sample, and logistic fits on it."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


BATCH_ROWS = 1000


def bounded_batches(docs: DataFrame) -> None:
    """Send at most ``BATCH_ROWS`` texts to Python at once: ten thousand long ones do not fit a small executor."""
    conf, name = docs.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name)) <= BATCH_ROWS:
        conf.set(name, str(BATCH_ROWS))


def id_bucket(buckets: int) -> Column:
    """crc32 of the id as text, modulo ``buckets``: which fold a document is in."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % buckets


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, usable: Column) -> tuple[pd.DataFrame, dict[int, int]]:
    """At most ``per_class`` labelled rows of each class with their texts, and how many rows each class has.

    Chosen by a hash of the id, so the sample is the same on every run. Rows without id, label or text
    are left out; copies of a text count once. An id that is labelled both ways counts as 1.
    """
    bounded_batches(docs)
    known = labels.filter(usable & F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)).select("doc_id", F.col(label).cast("int").alias("label"))
    totals = {r[0]: r[1] for r in known.groupBy("label").count().collect()}
    drawn = [known.filter(F.col("label") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for c in (0, 1)]
    chosen = drawn[0].unionByName(drawn[1]).groupBy("doc_id").agg(F.max("label").alias("label"))
    texts = docs.select(F.col("doc_id").alias("doc_id"), "text").filter(F.col("text").isNotNull())
    rows = texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "label").toPandas()  # the bound is per_class
    rows = rows.sort_values(["doc_id", "text"]).drop_duplicates(["text"]).reset_index(drop=True)
    return rows, totals


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Weights of a logistic model by Newton steps; a ridge on all but a constant last column."""
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    if len(x) and np.ptp(x[:, -1]) == 0:
        penalty[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (weight * (p - y)) + penalty * w
        bend = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(bend, slope)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w
