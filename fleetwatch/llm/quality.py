"""Quality by Bradley-Terry ranking.

Every document gets a strength w.x from features of its text. A preference pair is a document
labelled good and one labelled bad; the good one wins with probability sigmoid(w.(x_good -
x_bad)), and w minimises the logistic loss on these feature differences. The threshold is the
quantile of the labelled documents' strengths that the share of bad labels names. The score is
the sigmoid of a document's distance from it, so 0.5 is the threshold.

All labelled texts and all their pairs are fitted (``ranking``); scoring covers every whole text.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetwatch.llm.fitting import bounded_batches, id_bucket
from fleetwatch.llm.ranking import halfway, moments, pair_weights, standardised
from fleetwatch.operators import skew
from fleetwatch.session import materialise

GOOD = 0.5

_KIND = np.full(256, 4, np.uint8)  # 0 lower, 1 upper, 2 digit, 3 white, 4 mark, 5 stop or comma; beyond ASCII counts as lower
_KIND[97:123] = 0
_KIND[128:] = 0
_KIND[65:91] = 1
_KIND[48:58] = 2
_KIND[[32, 9, 10, 11, 12, 13]] = 3
_KIND[[46, 44]] = 5


def features(text: str | None) -> list[float]:
    raw = (text or "").encode()
    words = raw.split()
    n = len(words)
    if not n:
        return [0.0] * 19 + [1.0]
    share = np.bincount(_KIND[np.frombuffer(raw, np.uint8)], minlength=6) / len(raw)
    distinct = set(words)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    again = sum(a == b for a, b in zip(words, words[1:])) / n
    plain = sum(w.isalpha() or not w.isascii() for w in words) / n
    ends = [w[-1] for w in words]
    marked = sum(33 <= e <= 47 and e not in (44, 46) or e in (58, 59, 63, 124) for e in ends) / n
    pairs = list(zip(words, words[1:]))
    squeezed = len(zlib.compress(raw, 1)) / len(raw)
    length = len(raw) / n
    shares = [share[1], share[2], share[4], share[5], again, marked, len(lines) and 1 - len(set(lines)) / len(lines)]
    new_pairs = len(set(pairs)) / max(1, len(pairs))
    return [
        *shares, *np.log1p(100 * np.array(shares[:5])), plain, len(distinct) / n, np.log(n) * len(distinct) / n,
        new_pairs, squeezed, np.log(length), np.log(n), 0.0,
    ]


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _features(texts: pd.Series) -> pd.Series:
    return pd.Series([np.array(features(t), np.float64) for t in texts], dtype=object)


def _labelled(docs: DataFrame, labels: DataFrame, usable: Column) -> tuple[DataFrame, dict[int, int]]:
    """Columns label, x of every labelled text, and how many rows of labels each class has.

    Rows without id, label or text are left out. Copies of a text count once, with the label of the smallest id. An id
    that is labelled both ways counts as 1.
    """
    known = labels.filter(usable & F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1))
    known = known.select(F.col("doc_id"), F.col("quality").cast("int").alias("label"))
    chosen = materialise(known.groupBy("doc_id").agg(F.max("label").alias("label"), *[F.count_if(F.col("label") == k).alias(f"n{k}") for k in (0, 1)]))
    totals = chosen.df.agg(F.sum("n0"), F.sum("n1")).first()
    texts = docs.select(F.col("doc_id").alias("doc_id"), "text").filter(F.col("text").isNotNull())

    def described(rows: DataFrame) -> DataFrame:
        return rows.withColumn("x", _features("text")).withColumn("hash", F.sha2("text", 256)).drop("text")

    ids = chosen.df.select("doc_id", "label")
    # beyond a broadcast features are joined, not texts
    small = skew.fits_broadcast(chosen)
    rows = described(texts.join(F.broadcast(ids), "doc_id")) if small else described(texts).join(ids, "doc_id")
    once = rows.groupBy("hash").agg(F.min(F.struct("doc_id", "label", "x")).alias("first"))
    # in one order, so that sums come out alike on every run
    made = materialise(once.sortWithinPartitions("hash").select("first.label", "first.x"))
    return made.df, {k: n for k, n in enumerate(totals) if n}


def fit(docs: DataFrame, labels: DataFrame, usable: Column) -> dict:
    """The model, from all usable labelled texts. Runs jobs when called; the driver gets sums of features, never rows."""
    bounded_batches(docs)
    rows, totals = _labelled(docs, labels, usable)
    prior = totals.get(1, 0) / sum(totals.values()) if totals else 1.0
    n, mean, spread = moments(rows)
    if min(n) < 2:
        return {"prior": prior}
    w, deviation = pair_weights(rows, mean, spread)

    @F.pandas_udf(T.DoubleType())
    def strength(x: pd.Series) -> pd.Series:
        return pd.Series(standardised(np.stack(x.to_numpy()), mean, spread) @ w if len(x) else np.zeros(0))

    strengths = materialise(rows.select("label", strength("x").alias("strength"))).df
    threshold = halfway(strengths, [totals[k] / n[k] for k in (0, 1)], totals[0])
    return {"prior": prior, "mean": mean, "spread": spread, "w": w, "threshold": threshold, "scale": max(1e-9, deviation / 2)}


def score_column(text: str, model: dict) -> Column:
    """Score (0 to 1, 0.5 at the threshold) of a text column.

    A null or empty text has features of its own and a score like any other. Copies score alike.
    Without enough labels of both classes every score is the share of good labels, or 1 without any.
    """

    @F.pandas_udf(T.DoubleType())
    def score(texts: pd.Series) -> pd.Series:
        if "w" not in model:
            return pd.Series(np.full(len(texts), model["prior"], float))
        x = np.array([features(t) for t in texts]).reshape(-1, len(model["mean"]))
        strength = standardised(x, model["mean"], model["spread"]) @ model["w"]
        return pd.Series(1 / (1 + np.exp(-np.clip((strength - model["threshold"]) / model["scale"], -30, 30))))

    return score(text)


def op7_quality(spark, folder: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    held_out = id_bucket(3) == 1
    scored = docs.select("doc_id", score_column("text", fit(docs, labels, ~held_out)).alias("score"))
    return scored.select(
        "doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= GOOD).cast("int").alias("predicted")
    )
