"""Toxicity by compression distance.

There are two zstandard dictionaries. The ordinary one is trained by zstandard on ordinary text. The
toxic one is a list of mined strings: one that zstandard trains on the toxic rows holds common syllables
and tells classes apart far worse (README). Windows of
``WINDOW`` words are compressed with the ordinary dictionary, and with the toxic one placed in
front of the same ordinary content. What is ordinary then costs the same bytes either way, so
the difference of the two lengths shows only what the toxic dictionary knows. Of toxic texts the
dictionary gets the strings that occur in significantly more toxic than ordinary documents;
common syllables would only add noise.

A document is described by how much its windows gain. Thresholds are calibrated by a logistic
model on labelled documents that took no part in making the dictionaries which scored them (two
folds). ``MAX_PER_CLASS`` rows of each class at most are fitted; scoring covers every whole text.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetwatch.llm.fitting import id_bucket, labelled_sample, logistic

MAX_PER_CLASS = 3000
WINDOW = 12
LEVEL = 6
ORDINARY_BYTES, TOXIC_BYTES = 32768, 4096
GRAMS = (5, 6, 7, 8)
LEAST_DOCS = 4
SIGNIFICANT = 20.0  # log-likelihood ratio
FLAGGED = 0.3

_RESULT = "doc_id bigint, score double"


def _grams(word: str) -> set[str]:
    return {word[i:i + n] for n in GRAMS for i in range(len(word) - n + 1)}


def _ratio(a: int, b: int, na: int, nb: int) -> float:
    """Log-likelihood ratio of a in na against b in nb."""
    def fit(k, n, p):
        return (k * math.log(p) if k else 0) + ((n - k) * math.log(1 - p) if n > k else 0)

    p = (a + b) / (na + nb)
    return 2 * (fit(a, na, a / na) + fit(b, nb, b / nb) - fit(a, na, p) - fit(b, nb, p))


def _toxic_strings(toxic: list[str], ordinary: list[str]) -> list[tuple[str, int]]:
    """Longest strings that mark toxic documents, with their counts, the most frequent last."""
    words = [Counter(f" {w} " for t in texts for w in set(t.lower().split())) for texts in (toxic, ordinary)]
    counts = [Counter(), Counter()]
    for seen, c in zip(counts, words):
        for w, k in c.items():
            for g in _grams(w):
                seen[g] += k
    na, nb = len(toxic), len(ordinary)
    marks = {
        g for g, k in counts[0].items()
        if k >= LEAST_DOCS and k / na > 3 * counts[1][g] / nb and _ratio(min(k, na), min(counts[1][g], nb), na, nb) > SIGNIFICANT
    }
    found: Counter[str] = Counter()
    for w, k in words[0].items():
        inside = [False] * len(w)
        for n in GRAMS:
            for i in range(len(w) - n + 1):
                if w[i:i + n] in marks:
                    inside[i:i + n] = [True] * n
        for run in re.finditer("1+", "".join("1" if x else "0" for x in inside)):
            found[w[run.start():run.end()]] += k
    kept: list[tuple[str, int]] = []
    for s, k in sorted(found.items(), key=lambda x: (-x[1], x[0])):
        if k >= LEAST_DOCS - 1 and not any(s in t for t, _ in kept):
            kept.append((s, k))
    return kept[::-1]


def dictionaries(toxic: list[str], ordinary: list[str]) -> tuple[bytes, bytes]:
    """Contents of the toxic and the ordinary dictionary."""
    samples = [t.lower().encode() for t in ordinary if t]
    try:
        common = zstandard.train_dictionary(ORDINARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:  # too few or too short samples to train on
        common = b" ".join(samples)[-ORDINARY_BYTES:]
    strings = _toxic_strings(toxic, ordinary)
    return "".join(s for s, _ in strings).encode()[-TOXIC_BYTES:], common


class _Scorer:
    def __init__(self, toxic: bytes, ordinary: bytes):
        def compressor(content: bytes):
            known = zstandard.ZstdCompressionDict(content or b" " * 8, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            known.precompute_compress(level=LEVEL)
            return zstandard.ZstdCompressor(level=LEVEL, dict_data=known, write_checksum=False, write_content_size=False, write_dict_id=False)

        self.both, self.plain = compressor(toxic + ordinary), compressor(ordinary)

    def features(self, text: str | None) -> list[float]:
        words = (text or "").lower().split()
        if not words:
            return [0.0] * 7
        gains = []
        for i in range(0, len(words), WINDOW):
            window = f" {' '.join(words[i:i + WINDOW])} ".encode()
            gains.append(len(self.plain.compress(window)) - len(self.both.compress(window)))
        g = np.array(gains, np.float64)
        return [
            g.max(), np.log1p((g >= 2).sum()), np.log1p((g >= 3).sum()), np.log1p((g >= 5).sum()),
            np.clip(g, 0, None).mean(), (g >= 3).mean(), np.log1p(len(g)),
        ]


def fit(docs: DataFrame, labels: DataFrame, usable: Column) -> dict:
    """Dictionaries and the calibrated model, from at most ``MAX_PER_CLASS`` usable rows of each class."""
    rows, totals = labelled_sample(docs, labels, "toxic", MAX_PER_CLASS, usable)
    y = rows["label"].to_numpy(float)
    texts = rows["text"].tolist()
    prior = totals.get(1, 0) / max(1, sum(totals.values()))
    if not 2 <= y.sum() <= len(y) - 2:
        return {"prior": prior}

    def made_of(chosen: np.ndarray) -> tuple[bytes, bytes]:
        return dictionaries(*[[t for t, c, v in zip(texts, chosen, y) if c and v == k] for k in (1, 0)])

    fold = np.zeros(len(y), int)
    for k in (0, 1):
        fold[y == k] = np.arange((y == k).sum()) % 2
    x = np.zeros((len(y), 7))
    for k in (0, 1):
        scorer = _Scorer(*made_of(fold != k))
        x[fold == k] = [scorer.features(t) for t, f in zip(texts, fold) if f == k]
    mean, spread = x.mean(axis=0), x.std(axis=0) + 1e-9
    design = np.column_stack(((x - mean) / spread, np.ones(len(x))))
    share = np.array([totals.get(k, 0) / max(1, (y == k).sum()) for k in (0, 1)])
    weight = share[y.astype(int)]
    weight *= len(y) / weight.sum()
    toxic, ordinary = made_of(np.ones(len(y), bool))
    return {"prior": prior, "toxic": toxic, "ordinary": ordinary, "mean": mean, "spread": spread, "w": logistic(design, y, weight)}


def scores(docs: DataFrame, model: dict) -> DataFrame:
    """Columns doc_id, score (0 to 1) for every row.

    A null or empty text has no windows: its score follows from gains of nought. Copies score
    alike. Without enough labels of both classes every score is the share of toxic labels (0
    without any). Other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _Scorer(model["toxic"], model["ordinary"]) if "w" in model else None
        for batch in batches:
            if scorer is None:
                score = np.full(len(batch), model["prior"], float)
            else:
                x = np.array([scorer.features(t) for t in batch["text"].to_pylist()]).reshape(-1, 7)
                z = (x - model["mean"]) / model["spread"] @ model["w"][:-1] + model["w"][-1]
                score = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(score)], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, _RESULT)


def op1_toxicity(spark, folder: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    held_out = id_bucket(4) == 2
    return scores(docs, fit(docs, labels, ~held_out)).select(
        "doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= FLAGGED).cast("int").alias("predicted")
    )
