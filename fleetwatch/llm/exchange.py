"""Compare 64-bit keys of all documents through one compact shuffle.

Documents are dealt out in chunks of neighbouring ids. A chunk sends its distinct keys,
sorted and delta-coded, to buckets that are ranges of the key space; a bucket answers with
bits, one for each key sent. A key is sent once by each chunk however often it occurs
there, so a passage that a third of all documents share costs a few bytes a chunk, and a
bucket's size follows the number of distinct keys.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetwatch.llm.arrays import pack_sorted, unpack_sorted

CHUNK_IDS = 256
LEAST_BUCKETS = 64
BUCKET_DOCS = 4000

SENT = "bucket int, chunk bigint, keys binary, extra binary"
ANSWER = "chunk bigint, bucket int, bits binary"
_SENT = pa.schema([("bucket", pa.int32()), ("chunk", pa.int64()), ("keys", pa.binary()), ("extra", pa.binary())])
_ANSWER = pa.schema([("chunk", pa.int64()), ("bucket", pa.int32()), ("bits", pa.binary())])


def in_chunks(docs: DataFrame, chunk_ids: int = CHUNK_IDS) -> DataFrame:
    """Columns chunk, doc_id, text. A row without an id belongs to no chunk and is left out."""
    chunk: Column = F.floor(F.col("doc_id") / F.lit(chunk_ids)).cast("bigint")
    return docs.filter(F.col("doc_id").isNotNull()).select(
        chunk.alias("chunk"), F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")
    )


def bucket_count(docs: DataFrame) -> int:
    """Buckets in proportion to the rows, so that a bucket's size does not grow with the table."""
    return max(LEAST_BUCKETS, docs.count() // BUCKET_DOCS)


def ordered(table: pa.Table) -> pa.Table:
    """Rows of a chunk in their one order: by id, copies of an id by text."""
    return table.sort_by([("doc_id", "ascending"), ("text", "ascending")])


def bucket_edges(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket's range begins and ends in sorted keys."""
    at = (np.arange(1, buckets, dtype=np.float64) * (2.0**64 / buckets)).astype(np.uint64)
    return np.concatenate(([0], np.searchsorted(keys, at), [len(keys)]))


def sent(chunk: int, keys: np.ndarray, buckets: int, extra: np.ndarray | None = None) -> pa.Table:
    """Rows for sorted keys. ``extra`` goes along, one 64-bit value a key."""
    edges = bucket_edges(keys, buckets)
    full = [b for b in range(buckets) if edges[b + 1] > edges[b]]
    parts = [slice(edges[b], edges[b + 1]) for b in full]
    return pa.table([
        pa.array(full, pa.int32()),
        pa.array([chunk] * len(full), pa.int64()),
        pa.array([pack_sorted(keys[p]) for p in parts], pa.binary()),
        pa.array([b"" if extra is None else extra[p].tobytes() for p in parts], pa.binary()),
    ], schema=_SENT)


def answers(keys: DataFrame, judge: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """``judge(keys, rank of the chunk, extra)`` gives small codes (0-3) of all keys of a bucket; chunks rank in ascending order."""

    def of_bucket(table: pa.Table) -> pa.Table:
        table = table.sort_by("chunk")
        sets = [unpack_sorted(x) for x in table["keys"].to_pylist()]
        sizes = [len(s) for s in sets]
        extra = np.frombuffer(b"".join(table["extra"].to_pylist()), np.uint64)
        codes = judge(np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes), extra)
        parts = np.split(codes.astype(np.uint8), np.cumsum(sizes)[:-1])
        bits = [np.packbits(np.concatenate((p & 1, p >> 1 & 1))).tobytes() for p in parts]
        return pa.table([table["chunk"], table["bucket"], pa.array(bits, pa.binary())], schema=_ANSWER)

    return keys.groupBy("bucket").applyInArrow(of_bucket, ANSWER)


def codes_of(answer: pa.Table, keys: np.ndarray, buckets: int) -> np.ndarray:
    """The answers that a chunk got, one code for each of its sorted keys."""
    edges = bucket_edges(keys, buckets)
    codes = np.zeros(len(keys), np.uint8)
    for bucket, bits in zip(answer["bucket"].to_pylist(), answer["bits"].to_pylist()):
        n = edges[bucket + 1] - edges[bucket]
        flags = np.unpackbits(np.frombuffer(bits, np.uint8), count=2 * n)
        codes[edges[bucket]:edges[bucket + 1]] = flags[:n] | flags[n:] << 1
    return codes


def in_earlier_chunk(keys: np.ndarray, chunk: np.ndarray, extra: np.ndarray) -> np.ndarray:
    """1 for a key that a chunk of lower rank also has."""
    order = np.argsort(keys, kind="stable")
    same = np.zeros(len(keys), np.uint8)
    same[order[1:]] = keys[order[1:]] == keys[order[:-1]]
    return same


def in_other_chunk(keys: np.ndarray, chunk: np.ndarray, extra: np.ndarray) -> np.ndarray:
    """1 for a key that any other chunk also has."""
    order = np.argsort(keys, kind="stable")
    equal = keys[order[1:]] == keys[order[:-1]]
    same = np.zeros(len(keys), np.uint8)
    same[order[1:]] = equal
    same[order[:-1]] |= equal
    return same
