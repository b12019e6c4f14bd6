"""Words, byte hashes and key blobs of a batch of texts, as whole-array numpy steps.

A batch is one buffer of UTF-8 bytes with document offsets, as Arrow holds it.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2**64
_VALUE = np.random.default_rng(20240501).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers = np.ones(1, np.uint64)
_inverse = np.ones(1, np.uint64)


_KEPT_POWERS = 1 << 20  # longer tables go when they have been used: a worker would keep them for all later stages


def _made_tables(size: int) -> tuple[np.ndarray, np.ndarray]:
    powers, inverse = np.full(size, _BASE, np.uint64), np.full(size, pow(_BASE, -1, 2**64), np.uint64)
    powers[0] = inverse[0] = 1
    np.multiply.accumulate(powers, out=powers)
    np.multiply.accumulate(inverse, out=inverse)
    return powers, inverse


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers, _inverse
    if n >= _KEPT_POWERS:
        return _made_tables(n + 1)
    if len(_powers) <= n:
        _powers, _inverse = _made_tables(min(_KEPT_POWERS, max(n + 1, 2 * len(_powers), 1 << 16)))
    return _powers, _inverse


def text_bytes(texts: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of all texts; a null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
        if isinstance(texts, pa.ChunkedArray):  # more than one chunk is left where offsets would overflow
            texts = pa.concat_arrays([c.cast(pa.large_string()) for c in texts.chunks])
    texts = pc.fill_null(texts, "")
    wide = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    buffers = texts.buffers()
    offsets = np.frombuffer(buffers[1], wide)[texts.offset:texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, wide)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    offsets = offsets.astype(np.int64)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def small(batches, rows: int = 128):
    """Parts of Arrow batches, so that the arrays made of a part stay small (some forty bytes for each byte of text)."""
    for batch in batches:
        for at in range(0, len(batch), rows):
            yield batch.slice(at, rows)


class Prefix:
    """Polynomial prefix sums modulo 2**64: the hash of any slice in constant time, wherever it lies."""

    def __init__(self, values: np.ndarray):
        n = len(values)
        powers, self.inverse = _power_tables(n)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(values * powers[:n], out=self.sums[1:])

    def slices(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.inverse[start]

    def windows(self, size: int) -> np.ndarray:
        """Hash of every slice of ``size`` values."""
        n = max(0, len(self.sums) - size)
        return (self.sums[size:size + n] - self.sums[:n]) * self.inverse[:n]


def byte_prefix(data: np.ndarray) -> Prefix:
    return Prefix(_VALUE[data])


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread all bits of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_spans(data: np.ndarray, offsets: np.ndarray, white: np.ndarray = WHITE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and the index of each document's first word (with the total last)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~white[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    heads = offsets[:-1][offsets[:-1] < len(data)]
    first[heads] = inside[heads]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    tails = offsets[1:][offsets[1:] > 0] - 1
    last[tails] = inside[tails]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


_LONG_WORD = 32  # bytes; in much longer ones polynomial sums modulo a power of two have collisions whatever the base


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    hashes = mixed(byte_prefix(data).slices(starts, ends))
    for i in np.flatnonzero(ends - starts > _LONG_WORD):
        digest = hashlib.blake2b(data[starts[i]:ends[i]].tobytes(), digest_size=8).digest()
        hashes[i] = int.from_bytes(digest, "little")
    return hashes


def spans_to_mask(starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """Which of ``n`` places any of the spans covers."""
    steps = np.bincount(starts, minlength=n + 1) - np.bincount(ends, minlength=n + 1)
    return np.cumsum(steps[:n]) > 0


def mask_to_spans(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edges = np.flatnonzero(np.diff(np.concatenate(([0], mask.view(np.int8), [0]))))
    return edges[::2], edges[1::2]


def pack_sorted(keys: np.ndarray) -> bytes:
    """Ascending 64-bit keys as steps of as few whole bytes as the widest step needs."""
    if not len(keys):
        return b""
    steps = np.diff(keys)
    width = max(1, -(-int(steps.max()).bit_length() // 8)) if len(steps) else 1
    return bytes([width]) + keys[:1].tobytes() + steps.view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unpack_sorted(blob: bytes) -> np.ndarray:
    if not len(blob):
        return np.zeros(0, np.uint64)
    width = blob[0]
    planes = np.frombuffer(blob, np.uint8, offset=9).reshape(-1, width)
    steps = np.zeros((len(planes) + 1, 8), np.uint8)
    steps[0] = np.frombuffer(blob, np.uint8, 8, 1)
    steps[1:, :width] = planes
    return np.cumsum(steps.view(np.uint64).ravel())
