"""Substring dedup: Rabin-Karp hashes of every window of ``size`` words, counted in Spark.

The words of a text are its runs of bytes other than ASCII white space. Every window of a
document is hashed (64 bits, rolling), and a window is repeated if the same hash starts
earlier: in a document of smaller id, or before it in the same one. The words that repeated
windows cover merge into maximal removal intervals; first occurrences stay.

Counting goes through ``exchange``: one shuffle of the texts by chunk of ids (used twice),
one of delta-coded hashes, one of answer bits. Two different windows are taken for equal
with a chance of about n**2 / 2**65 for n distinct windows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetwatch.llm import exchange as ex
from fleetwatch.llm.arrays import Prefix, spans_to_mask, text_bytes, word_hashes, word_spans

RESULT = "doc_id bigint, n_words bigint, n_removed bigint, removed array<struct<start:bigint,end:bigint>>, kept_text string"


class _Windows:
    """All windows of a chunk, in document order."""

    def __init__(self, table: pa.Table, size: int):
        self.table = ex.ordered(table)
        self.data, self.offsets = text_bytes(self.table["text"])
        self.starts, self.ends, self.first = word_spans(self.data, self.offsets)
        hashes = word_hashes(self.data, self.starts, self.ends)
        ends = np.repeat(self.first[1:], np.diff(self.first))
        self.at = np.flatnonzero(np.arange(len(hashes)) + size <= ends)
        rolled = Prefix(hashes).windows(size)[self.at]
        self.keys, self.first_at, self.key_of = np.unique(rolled, return_index=True, return_inverse=True)


def repeated_windows(docs: DataFrame, size: int = 20, chunk_ids: int = ex.CHUNK_IDS, buckets: int | None = None) -> DataFrame:
    """Documents with the words that repeated windows cover, and the text that is left.

    Columns: doc_id, n_words, n_removed, removed (maximal intervals of word numbers, end
    exclusive), kept_text (kept words joined by one space). One row for each row of ``docs``.

    A null text is empty; it and texts below ``size`` words lose nothing. Rows of one id count
    as documents in the order of their texts, so a copy under the same id is removed. A row
    without id cannot be ordered: it takes no part, keeps all its words, and its windows count
    for nobody. Other columns of ``docs`` are ignored. An empty table gives an empty result.
    """
    chunks = ex.in_chunks(docs, chunk_ids)
    buckets = buckets or ex.bucket_count(docs)

    def send(table: pa.Table) -> pa.Table:
        return ex.sent(table["chunk"][0].as_py(), _Windows(table, size).keys, buckets)

    def apply(table: pa.Table, answer: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _kept(table, None, size)
        w = _Windows(table, size)
        earlier = ex.codes_of(answer, w.keys, buckets)[w.key_of] > 0
        earlier |= w.first_at[w.key_of] != np.arange(len(w.at))
        covered = spans_to_mask(w.at[earlier], w.at[earlier] + size, len(w.starts))
        return _kept(w.table, (w, covered), size)

    keys = chunks.groupBy("chunk").applyInArrow(send, ex.SENT)
    found = ex.answers(keys, ex.in_earlier_chunk)
    judged = chunks.groupBy("chunk").cogroup(found.groupBy("chunk")).applyInArrow(apply, RESULT)
    return judged.unionByName(_without_id(docs))


def _kept(table: pa.Table, judged: tuple[_Windows, np.ndarray] | None, size: int) -> pa.Table:
    if judged is None:
        w, covered, n = None, np.zeros(0, bool), 0
        first, offsets, data, stays = np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(0, np.uint8), np.zeros(0, bool)
    else:
        w, covered = judged
        n, first, data = len(w.offsets) - 1, w.first, w.data.copy()
        kept = np.flatnonzero(~covered)
        doc = np.searchsorted(first, kept, side="right") - 1
        inner = np.concatenate((doc[1:] == doc[:-1], [False]))[:len(kept)]  # another kept word of its document follows
        stays = spans_to_mask(w.starts[kept], w.ends[kept], len(data))
        joint = w.ends[kept[inner]]
        data[joint] = 0x20
        stays[joint] = True
        offsets = np.concatenate(([0], np.cumsum(stays)))[w.offsets]
    removed = np.add.reduceat(np.concatenate((covered, [False])).astype(np.int64), first[:-1]) if n else np.zeros(0, np.int64)
    removed[np.diff(first) == 0] = 0
    doc_edge = np.zeros(len(covered) + 1, bool)
    doc_edge[first] = True
    starts, ends = _split_at(covered, doc_edge)
    per_doc = np.searchsorted(starts, first)
    base = first[np.searchsorted(first, starts, side="right") - 1] if len(starts) else starts
    spans = pa.ListArray.from_arrays(
        pa.array(per_doc, pa.int32()),
        pa.StructArray.from_arrays([pa.array(starts - base, pa.int64()), pa.array(ends - base, pa.int64())], ["start", "end"]),
    )
    texts = pa.LargeStringArray.from_buffers(n, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data[stays].tobytes()))
    return pa.table({
        "doc_id": table["doc_id"].cast(pa.int64()), "n_words": pa.array(np.diff(first), pa.int64()),
        "n_removed": pa.array(removed, pa.int64()), "removed": spans, "kept_text": texts.cast(pa.string()),
    })


def _split_at(mask: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal covered runs that stop at document edges."""
    n = len(mask)
    before = np.concatenate(([False], mask[:-1])) if n else mask
    after = np.concatenate((mask[1:], [False])) if n else mask
    starts = np.flatnonzero(mask & (~before | edge[:n]))
    ends = np.flatnonzero(mask & (~after | edge[1:n + 1])) + 1
    return starts, ends


def _without_id(docs: DataFrame) -> DataFrame:
    words = F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    return docs.filter(F.col("doc_id").isNull()).select(
        F.lit(None).cast("bigint").alias("doc_id"), F.size(words).cast("bigint").alias("n_words"),
        F.lit(0).cast("bigint").alias("n_removed"),
        F.array().cast("array<struct<start:bigint,end:bigint>>").alias("removed"), F.array_join(words, " ").alias("kept_text"),
    )


def op8_substring_dedup(spark, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    return repeated_windows(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))
