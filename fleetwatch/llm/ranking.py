"""Bradley-Terry weights from all pairs of a good and a bad row, without making the pairs.

A pair counts by the difference of its two strengths w.x alone. So rows are put into bins of their strength, a
``STEPS``-th of the deviation wide, and each bin keeps how many rows of a class it has and the sums of their
features and of the products of two features. From these sums, two bins at a time, follow the slope and the
curvature of the loss over all pairs: no row and no pair is left out, and only the chance of a pair is taken at the
mean strengths of its bins. A Newton step is one pass over the rows, whose sums do not grow with their number.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STEPS, REACH = 32, 8  # bins a deviation, and deviations on either side; what is further counts with the outermost bins
SIDE = STEPS * REACH
CLIP = 8.0
PARTS = 512  # of a range of values, in the search for a threshold
_SUMS = "label int, bin int, part int, sums array<double>"


def standardised(x: np.ndarray, mean: np.ndarray, spread: np.ndarray) -> np.ndarray:
    return np.clip((x - mean) / spread, -CLIP, CLIP)


def _batch(cells: np.ndarray, sums: np.ndarray, part: int) -> pa.RecordBatch:
    label, at = np.divmod(cells, 2 * SIDE + 1)
    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(cells) + 1) * sums.shape[1], pa.int32()), pa.array(sums.ravel()))
    columns = [pa.array(label, pa.int32()), pa.array(at - SIDE, pa.int32()), pa.array(np.full(len(cells), part), pa.int32()), lists]
    return pa.RecordBatch.from_arrays(columns, ["label", "bin", "part", "sums"])


def _sums(rows: DataFrame, scale: tuple | None = None, w: np.ndarray | None = None, middle: float = 0.0, width: float = 1.0) -> dict:
    """By class: counts, sums of features and of their products, an element a bin that has rows. Without ``w`` all rows are in one bin."""

    def add(batches: Iterator[pa.RecordBatch], merge: bool) -> Iterator[pa.RecordBatch]:
        found = None
        for batch in batches:
            if not len(batch):
                continue
            label = batch["label"].to_numpy().astype(int)
            x = batch["sums" if merge else "x"].flatten().to_numpy(zero_copy_only=False).reshape(len(batch), -1)
            if merge:
                at, values = batch["bin"].to_numpy(), x
            else:
                x = x if scale is None else standardised(x, *scale)
                at = np.zeros(len(x), int) if w is None else np.clip(np.rint((x @ w - middle) / width), -SIDE, SIDE).astype(int)
                one, two = np.triu_indices(x.shape[1])
                values = np.hstack((np.ones((len(x), 1)), x, x[:, one] * x[:, two]))
            cell = label * (2 * SIDE + 1) + at + SIDE
            order = np.argsort(cell, kind="stable")
            cell = cell[order]
            first = np.flatnonzero(np.diff(cell, prepend=-1))
            if found is None:
                found = np.zeros((2 * (2 * SIDE + 1), values.shape[1]))
            found[cell[first]] += np.add.reduceat(values[order], first, axis=0)
        if found is not None:
            cells = np.flatnonzero(found[:, 0])
            yield _batch(cells, found[cells], TaskContext.get().partitionId())

    made = rows.select("label", "x").mapInArrow(lambda b: add(b, False), _SUMS)
    once = made.repartition("label", "bin").sortWithinPartitions("label", "bin", "part").mapInArrow(lambda b: add(b, True), _SUMS)
    listed = sorted(once.select("label", "bin", "sums").collect())  # at most 2 * (2 * SIDE + 1) rows
    by_class = {}
    for k in (0, 1):
        table = np.array([r["sums"] for r in listed if r["label"] == k])
        if len(table):
            size = int((math.isqrt(8 * table.shape[1] + 1) - 3) // 2)
            two = np.zeros((len(table), size, size))
            two[(slice(None), *np.triu_indices(size))] = table[:, 1 + size:]
            two += np.triu(two, 1).transpose(0, 2, 1)
            by_class[k] = table[:, 0], table[:, 1:1 + size], two
    return by_class


def moments(rows: DataFrame) -> tuple[list[int], np.ndarray | None, np.ndarray | None]:
    """Rows of class 0 and 1, and the mean and deviation of each feature over both."""
    found = _sums(rows)
    n = [int(found[k][0][0]) if k in found else 0 for k in (0, 1)]
    if not sum(n):
        return n, None, None
    one, two = (sum(f[i][0] for f in found.values()) / sum(n) for i in (1, 2))
    return n, one, np.sqrt(np.maximum(0, np.diag(two) - one * one)) + 1e-9


def pair_weights(rows: DataFrame, mean: np.ndarray, spread: np.ndarray, ridge: float = 1.0, rounds: int = 40) -> tuple[np.ndarray, float]:
    """Weights by Newton steps, and the deviation of all strengths. The pairs together weigh as much as there are rows.

    Steps end where they are small and no longer halve: what is left then is the width of the bins.
    """
    w, middle, deviation, last = np.zeros(len(mean)), 0.0, 0.0, math.inf
    for _ in range(rounds):
        found = _sums(rows, (mean, spread), w, middle, deviation / STEPS or 1.0)
        (n_bad, bad, bad2), (n_good, good, good2) = found[0], found[1]
        total = n_bad.sum() + n_good.sum()
        lost = 1 / (1 + np.exp(np.clip((good @ w / n_good)[:, None] - (bad @ w / n_bad)[None], -30, 30)))
        bent, share = lost * (1 - lost), total / n_bad.sum() / n_good.sum()
        slope = share * ((n_good @ lost) @ bad - (lost @ n_bad) @ good) + ridge * w
        mixed = good.T @ bent @ bad
        bend = np.tensordot(bent @ n_bad, good2, 1) + np.tensordot(n_good @ bent, bad2, 1) - mixed - mixed.T
        step = np.linalg.solve(share * bend + ridge * np.eye(len(w)), slope)
        w = w - step
        average = (good.sum(axis=0) + bad.sum(axis=0)) / total
        middle = float(average @ w)
        deviation = math.sqrt(max(0.0, w @ (good2.sum(axis=0) + bad2.sum(axis=0)) @ w / total - middle * middle))
        size = np.abs(step).max() / max(1.0, np.abs(w).max())
        if size < 1e-6 or last / 2 < size < 0.02:
            break
        last = size
    return w, deviation


def halfway(rows: DataFrame, weights: Sequence[float], goal: float) -> float:
    """Middle of the strength at which the weights of rows, added up in ascending order, reach ``goal``, and of the next row's.

    ``weights``: of a row of class 0 and 1. Counts of ever narrower ranges find it, so no task sorts or holds the rows.
    """
    value = F.col("strength")
    low, high = rows.agg(F.min(value), F.max(value)).first()
    below = 0.0
    while True:
        part = F.least(F.floor((value - low) / (high - low) * PARTS), F.lit(PARTS - 1)) if high > low else F.lit(0)
        inside = rows.filter(value.between(low, high)).groupBy(part.alias("part")).agg(
            *[F.count_if(F.col("label") == k).alias(f"n{k}") for k in (0, 1)], F.min(value).alias("low"), F.max(value).alias("high")
        )
        counted = inside.orderBy("part").collect()  # at most PARTS rows
        for r in counted:
            gain = weights[0] * r["n0"] + weights[1] * r["n1"]
            if r is counted[-1] or below + gain >= goal * (1 - 1e-12):
                break
            below += gain
        low, high = r["low"], r["high"]
        if low == high:
            break
    same = r["n0"] + r["n1"]
    if same > 1 and (goal - below) / gain * same <= same - 1:
        return low
    beyond = rows.agg(F.min(F.when(value > low, value)), F.max(F.when(value < low, value))).first()
    after = beyond[0] if beyond[0] is not None else low if same > 1 else beyond[1]
    return (low + after) / 2
