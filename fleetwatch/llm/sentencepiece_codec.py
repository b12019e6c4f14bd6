"""SentencePiece encoding and decoding with the tokenizers library.

The model file is a protobuf message; a small reader takes its pieces, scores and options. From
them a tokenizer is rebuilt: the normaliser (character map if there is one, extra spaces,
dummy prefix), the metaspace marker for spaces, unigram scores or, for a BPE model, merges in
the order of the scores, and byte fallback. No piece has a marker behind another character, so
a text falls into segments (markers, then other characters) that never merge. A worker encodes
segments in multithreaded batches, checks them against the sentencepiece library and remembers those that are
in use. A model with a piece that joins words is refused. Decoding spells out ids from a table of pieces.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from functools import cached_property
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Regex, Tokenizer, decoders, models, normalizers

from fleetwatch.llm.fitting import bounded_batches

MARK = "▁"
KNOWN_SEGMENTS = 100_000  # segments a worker remembers as new ones; as many older ones stay while they are used
_SEGMENT = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
_UNIGRAM, _BPE = 1, 2
_NORMAL, _USER = 1, 4


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 0x7F) << shift
        shift += 7
        if byte < 0x80:
            return value, at


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    at = 0
    while at < len(data):
        tag, at = _varint(data, at)
        kind = tag & 7
        if kind == 0:
            value, at = _varint(data, at)
        else:
            size, at = _varint(data, at) if kind == 2 else ({1: 8, 5: 4}[kind], at)
            value, at = data[at:at + size], at + size
        yield tag >> 3, value


class Model:
    def __init__(self, data: bytes):
        self.pieces: list[tuple[str, float, int]] = []
        trainer: dict = {}
        normal: dict = {}
        for field, value in _fields(data):
            if field == 1:
                piece = dict(_fields(value))
                score = struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0
                self.pieces.append((piece[1].decode(), score, piece.get(3, _NORMAL)))
            elif field == 2:
                trainer = dict(_fields(value))
            elif field == 3:
                normal = dict(_fields(value))
        self.kind = trainer.get(3, _UNIGRAM)
        self.byte_fallback = bool(trainer.get(35, 0))
        self.unknown = next((i for i, p in enumerate(self.pieces) if p[2] == 2), 0)
        self.charsmap = normal.get(2, b"")
        self.dummy_prefix = bool(normal.get(3, 1))
        self.one_space = bool(normal.get(4, 1))
        if any(MARK in p.lstrip(MARK) for p, _, kind in self.pieces if kind in (_NORMAL, _USER)):
            raise ValueError("a piece joins words: segments cannot be encoded one by one")

    def tokenizer(self) -> Tokenizer:
        """A tokenizer for one segment, in which spaces are markers already."""
        if self.kind == _BPE:
            ids = {p: i for i, (p, _, _) in enumerate(self.pieces)}
            merges = []
            for p, score, kind in self.pieces:
                if kind in (_NORMAL, _USER):
                    cuts = [(p[:k], p[k:]) for k in range(1, len(p)) if p[:k] in ids and p[k:] in ids]
                    merges += [(-score, ids[a], ids[b], (a, b)) for a, b in cuts]
            model = models.BPE(
                vocab=ids, merges=[m[-1] for m in sorted(merges)], byte_fallback=self.byte_fallback,
                unk_token=self.pieces[self.unknown][0], fuse_unk=True,
            )
        else:
            model = models.Unigram([(p, s) for p, s, _ in self.pieces], self.unknown, self.byte_fallback)
        made = Tokenizer(model)
        made.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()])
        return made

    def normalised(self, texts: list[str]) -> list[str]:
        """Texts with markers for spaces, as sentencepiece sees them."""
        steps = [normalizers.Precompiled(self.charsmap)] if self.charsmap else []
        if self.one_space:
            steps += [normalizers.Replace(Regex(" {2,}"), " "), normalizers.Strip()]
        if steps:
            change = normalizers.Sequence(steps)
            texts = [change.normalize_str(t) for t in texts]
        prefix = MARK if self.dummy_prefix else ""
        return [prefix + t.replace(" ", MARK) if t else "" for t in texts]


class Rebuilt:
    """What tasks need of a model, rebuilt once on the driver: the merges of all pieces take more room than the rest."""

    def __init__(self, data: bytes):
        self.model, self.proto = Model(data), data
        self.tokenizer = self.model.tokenizer().to_str()
        byte = {f"<0x{i:02X}>": bytes([i]) for i in range(256)}
        self.spelt = [byte.get(p, p.replace(MARK, " ").encode()) for p, _, _ in self.model.pieces]  # what each id stands for
        self.model.pieces = []


class _Codec:
    def __init__(self, rebuilt: Rebuilt):
        self.model, self.spelt, self.packed, self.proto = rebuilt.model, rebuilt.spelt, rebuilt.tokenizer, rebuilt.proto
        self.known: dict[str, bytes] = {}  # ids as 32-bit integers
        self.older: dict[str, bytes] = {}
        self.differ: set[str] = set()
        self.prefix = self.model.dummy_prefix

    @cached_property
    def judge(self):
        import sentencepiece

        return sentencepiece.SentencePieceProcessor(model_proto=self.proto)

    @cached_property
    def tokenizer(self) -> Tokenizer:
        return Tokenizer.from_str(self.packed)

    def learn(self, segments: list[str]) -> None:
        """Afterwards all these segments are known. Those not used since the last turn but one are forgotten."""
        if len(self.known) > KNOWN_SEGMENTS:
            self.older, self.known = self.known, {}
            self.differ &= self.older.keys()
        new = []
        for s in dict.fromkeys(segments):
            if s not in self.known:
                if s in self.older:
                    self.known[s] = self.older[s]
                else:
                    new.append(s)
        ours = [e.ids for e in self.tokenizer.encode_batch(new, add_special_tokens=False)]
        # the judge puts the dummy prefix in front again
        shown = [s[1:] if self.prefix and s.startswith(MARK) else s for s in new]
        theirs = self.judge.encode([s.replace(MARK, " ") for s in shown], num_threads=1)
        for s, mine, other in zip(new, ours, theirs):
            self.known[s] = struct.pack(f"<{len(mine)}i", *mine)
            if mine != other and (s.startswith(MARK) or not self.prefix):
                self.differ.add(s)

    def encode(self, texts: list[str]) -> tuple[list[bytes], list[bool]]:
        cut = [_SEGMENT.findall(t) for t in self.model.normalised(texts)]
        self.learn(list(chain.from_iterable(cut)))
        known = self.known
        return [b"".join([known[s] for s in segments]) for segments in cut], [self.differ.isdisjoint(segments) for segments in cut]

    def decode(self, ids: list[np.ndarray]) -> list[str]:
        texts = [self._spelt_out(x) for x in ids]
        return [t[1:] if self.prefix and t.startswith(" ") else t for t in texts]

    def _spelt_out(self, ids: np.ndarray) -> str:
        if len(ids) and 0 <= ids.min() and ids.max() < len(self.spelt):
            try:
                return b"".join([self.spelt[i] for i in ids.tolist()]).decode()
            except UnicodeDecodeError:
                pass  # bytes that are no text: the tokenizer says what to show for them
        return self.tokenizer.decode(ids.tolist(), skip_special_tokens=False)


_last: list[_Codec] = []


def _codec(rebuilt: Rebuilt) -> _Codec:
    """The codec of a model in this worker. It stays for later tasks: threads of the library keep some memory of every tokenizer they met."""
    if not _last or _last[0].proto != rebuilt.proto:
        _last[:] = [_Codec(rebuilt)]
    return _last[0]


def model_bytes(path: str | None = None) -> bytes:
    """The model file, read on the driver and sent along with the tasks (0.5 MB)."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    with open(path, "rb") as file:
        return file.read()


_BATCH = 128  # documents encoded together


def encode(docs: DataFrame, model: bytes) -> DataFrame:
    """Columns doc_id, ids, parity (every segment got the ids that sentencepiece gives).

    One row for each row of ``docs``. A null or empty text has no ids. Repeated rows and rows
    without id are encoded like others; other columns are ignored.
    """

    rebuilt = Rebuilt(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(rebuilt)
        for batch in batches:
            for at in range(0, len(batch), _BATCH):
                part = batch.slice(at, _BATCH)
                ids, same = codec.encode(part["text"].to_pylist())
                offsets = np.cumsum([0, *map(len, ids)]) // 4
                flat = np.frombuffer(b"".join(ids), "<i4")
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat))
                yield pa.RecordBatch.from_arrays([part["doc_id"], lists, pa.array(same, pa.bool_())], ["doc_id", "ids", "parity"])

    bounded_batches(docs)
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return texts.mapInArrow(run, "doc_id bigint, ids array<int>, parity boolean")


def decode(encoded: DataFrame, model: bytes) -> DataFrame:
    """Columns doc_id, parity, n_tokens, ids_crc32 (of little-endian 32-bit ids) and text for rows of ids."""

    rebuilt = Rebuilt(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(rebuilt)
        for batch in batches:
            for at in range(0, len(batch), _BATCH):
                part = batch.slice(at, _BATCH)
                flat, offsets = part["ids"].flatten().to_numpy(), np.concatenate(([0], np.cumsum(part["ids"].value_lengths().to_numpy())))
                yield _decoded(codec, part["doc_id"], part["parity"], [flat[a:b] for a, b in zip(offsets[:-1], offsets[1:])])

    return encoded.mapInArrow(run, DECODED)


DECODED = "doc_id bigint, parity boolean, n_tokens bigint, ids_crc32 bigint, text string"


def _decoded(codec: _Codec, doc_id: pa.Array, parity: pa.Array, ids: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([
        doc_id, parity, pa.array([len(x) for x in ids], pa.int64()),
        pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64()), pa.array(codec.decode(ids), pa.string()),
    ], ["doc_id", "parity", "n_tokens", "ids_crc32", "text"])


def round_trip(docs: DataFrame, model: bytes) -> DataFrame:
    """``decode(encode(docs))`` in one task for each part of the table: one Python worker instead of two, and no ids between them."""

    rebuilt = Rebuilt(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(rebuilt)
        for batch in batches:
            for at in range(0, len(batch), _BATCH):
                part = batch.slice(at, _BATCH)
                ids, same = codec.encode(part["text"].to_pylist())
                yield _decoded(codec, part["doc_id"], pa.array(same, pa.bool_()), [np.frombuffer(x, "<i4") for x in ids])

    bounded_batches(docs)
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return texts.mapInArrow(run, DECODED)


def op4_sentencepiece(spark, folder: str) -> DataFrame:
    decoded = round_trip(spark.read.parquet(f"{folder}/documents.parquet"), model_bytes())
    return decoded.select("doc_id", "n_tokens", "ids_crc32", "parity", F.sha2("text", 256).alias("decoded_sha256"))
