"""Suffix-array dedup: distributed prefix doubling over a sparse set of suffixes.

A text is its UTF-8 bytes. Every byte that a string of ``WINDOW`` (200) bytes covers which
also starts anywhere else is removed; matches stay inside a document.

Suffixes. Among the 101 starts of 25-byte strings with which a window begins, the one of
least hash (the last of equal ones) is the window's anchor. It depends on the window's
bytes alone, so equal windows have anchors at equal places. About every fiftieth position
is an anchor, and it owns the run of neighbouring windows that chose it. All of them hold
the 100 bytes that follow the anchor.

Doubling. Anchors are named by their first 25, 50 and 100 bytes: the name for 2h is the pair
of the names for h at the position and h further on. In each round Spark sorts the names in
ranges of the key space, and anchors whose name is unique drop out: none of their windows is
repeated. Only equality of ranks matters here, so a name is 64 bits of the pair's hash and
needs no second look-up in another task.

Past the threshold. Anchors with 100 bytes in common are sorted by (name, context), the
context being all bytes of the windows that they own. A context that occurs twice has only
repeated windows. Where contexts differ, one anchor of each context sends its windows, and
these are sorted as a last rank; this happens only near the ends of repeated passages.

Each chunk sends a name once, however often it has it (see ``exchange``), so a passage
which a third of all documents share is a few bytes for each chunk. Two different strings
are taken for equal with a chance of about n**2 / 2**65 for n distinct names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetwatch.llm import exchange as ex
from fleetwatch.llm.arrays import byte_prefix, mask_to_spans, mixed, spans_to_mask, text_bytes
from fleetwatch.session import materialise

WINDOW = 200
GRAM = 25  # doubles to CORE
CORE = 4 * GRAM
CHOICES = WINDOW - CORE + 1  # windows of one anchor at most

RESULT = "doc_id bigint, n_bytes bigint, n_removed bigint, removed array<struct<start:bigint,end:bigint>>, kept binary"
_STATE = "chunk bigint, state binary"
_ANCHOR = np.dtype([("lo", "<u4"), ("n", "u1"), ("half", "<u8"), ("core", "<u8"), ("context", "<u8")])
_DECIDED = np.dtype([("lo", "<u4"), ("n", "u1"), ("whole", "?")])
_LOW = np.uint64(0xFFFFFFFF)


def _pair(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    return mixed(one * np.uint64(0xD6E8FEB86659FD93) + two)


class _Text:
    def __init__(self, table: pa.Table):
        self.table = ex.ordered(table)
        self.data, self.offsets = text_bytes(self.table["text"])
        self.prefix = byte_prefix(self.data)

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """Names of the first 25 bytes, and the rest of what the rounds need, by anchor."""
        ends = np.repeat(self.offsets[1:], np.diff(self.offsets))
        at = np.flatnonzero(np.arange(len(ends)) + WINDOW <= ends)
        if not len(at):
            return np.zeros(0, np.uint64), np.zeros(0, _ANCHOR)
        gram = mixed(self.prefix.windows(GRAM))
        least = gram & ~_LOW | (_LOW - np.arange(len(gram), dtype=np.uint64))
        width = 1
        while 2 * width <= CHOICES:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        rest = CHOICES - width
        least = np.minimum(least[:len(least) - rest], least[rest:])
        chosen = (_LOW - (least[at] & _LOW)).astype(np.int64)
        heads = np.flatnonzero(np.concatenate(([True], chosen[1:] != chosen[:-1])))
        a, lo, n = chosen[heads], at[heads], np.diff(np.append(heads, len(at)))
        quarter = [gram[a + i * GRAM] for i in range(4)]
        found = np.empty(len(a), _ANCHOR)
        found["lo"], found["n"] = lo, n
        found["half"] = _pair(quarter[0], quarter[1])
        found["core"] = _pair(found["half"], _pair(quarter[2], quarter[3]))
        place = ((a - lo) * 256 + n).astype(np.uint64)
        found["context"] = _pair(self.prefix.slices(lo, lo + n - 1 + WINDOW), place)
        return mixed(quarter[0]), found

    def windows(self, decided: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and names of all windows that the given anchors own."""
        n = decided["n"].astype(np.int64)
        starts = np.repeat(decided["lo"].astype(np.int64) - np.cumsum(n) + n, n) + np.arange(n.sum())
        return starts, mixed(self.prefix.slices(starts, starts + WINDOW))


def _state(chunk: int, rows: np.ndarray) -> pa.Table:
    kept = [rows.tobytes()] if len(rows) else []
    return pa.table({"chunk": pa.array([chunk] * len(kept), pa.int64()), "state": pa.array(kept, pa.binary())})


def _repeated(names: np.ndarray, answer: pa.Table, buckets: int) -> np.ndarray:
    """Which of a chunk's names occur again, in it or elsewhere."""
    keys, inverse, count = np.unique(names, return_inverse=True, return_counts=True)
    return ((ex.codes_of(answer, keys, buckets) > 0) | (count > 1))[inverse]


def _first_round(chunks: DataFrame, buckets: int) -> DataFrame:
    def send(table: pa.Table) -> pa.Table:
        return ex.sent(table["chunk"][0].as_py(), np.unique(_Text(table).anchors()[0]), buckets)

    def keep(table: pa.Table, answer: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _state(0, np.zeros(0, _ANCHOR))
        names, anchors = _Text(table).anchors()
        return _state(table["chunk"][0].as_py(), anchors[_repeated(names, answer, buckets)])

    found = ex.answers(chunks.groupBy("chunk").applyInArrow(send, ex.SENT), ex.in_other_chunk)
    return chunks.groupBy("chunk").cogroup(found.groupBy("chunk")).applyInArrow(keep, _STATE)


def _next_round(states: DataFrame, buckets: int) -> DataFrame:
    """Anchors whose first 50 bytes occur again."""

    def send(batches):
        for batch in batches:
            for chunk, state in zip(batch["chunk"].to_pylist(), batch["state"].to_pylist()):
                yield from ex.sent(chunk, np.unique(np.frombuffer(state, _ANCHOR)["half"]), buckets).to_batches()

    def keep(table: pa.Table, answer: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _state(0, np.zeros(0, _ANCHOR))
        anchors = np.frombuffer(table["state"][0].as_py(), _ANCHOR)
        return _state(table["chunk"][0].as_py(), anchors[_repeated(anchors["half"], answer, buckets)])

    found = ex.answers(states.mapInArrow(send, ex.SENT), ex.in_other_chunk)
    return states.groupBy("chunk").cogroup(found.groupBy("chunk")).applyInArrow(keep, _STATE)


def _judge_contexts(core: np.ndarray, chunk: np.ndarray, context: np.ndarray) -> np.ndarray:
    """1: the context occurs in another chunk. 2: its core has more contexts, and this is its first place."""
    order = np.lexsort((chunk, context, core))
    core, context = core[order], context[order]
    new_core = np.concatenate(([True], core[1:] != core[:-1]))
    new = new_core | np.concatenate(([True], context[1:] != context[:-1]))
    contexts = np.add.reduceat(new.astype(np.int64), np.flatnonzero(new_core))[np.cumsum(new_core) - 1]
    again = ~new | ~np.append(new[1:], True)
    codes = np.empty(len(core), np.uint8)
    codes[order] = again | (new & (contexts > 1)).astype(np.uint8) << 1
    return codes


def _last_round(states: DataFrame, buckets: int) -> DataFrame:
    """What becomes of the anchors whose first 100 bytes occur again."""

    def pairs(state: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        anchors = np.frombuffer(state, _ANCHOR)
        anchors = anchors[np.lexsort((anchors["context"], anchors["core"]))]
        new = np.ones(len(anchors), bool)
        new[1:] = (anchors["core"][1:] != anchors["core"][:-1]) | (anchors["context"][1:] != anchors["context"][:-1])
        heads = np.flatnonzero(new)
        return anchors, heads, np.cumsum(new) - 1, np.diff(np.append(heads, len(anchors)))

    def send(batches):
        for batch in batches:
            for chunk, state in zip(batch["chunk"].to_pylist(), batch["state"].to_pylist()):
                anchors, heads, _, _ = pairs(state)
                one = anchors[heads]
                yield from ex.sent(chunk, np.ascontiguousarray(one["core"]), buckets, np.ascontiguousarray(one["context"])).to_batches()

    def decide(table: pa.Table, answer: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _state(0, np.zeros(0, _DECIDED))
        anchors, heads, pair, count = pairs(table["state"][0].as_py())
        codes = ex.codes_of(answer, np.ascontiguousarray(anchors["core"][heads]), buckets)
        whole = ((codes & 1 > 0) | (count > 1))[pair]
        first = np.zeros(len(anchors), bool)
        first[heads] = codes & 2 > 0
        shown = whole | first
        found = np.empty(shown.sum() + (whole & first).sum(), _DECIDED)
        both = anchors[np.concatenate((np.flatnonzero(whole), np.flatnonzero(first)))]
        found["lo"], found["n"] = both["lo"], both["n"]
        found["whole"] = np.arange(len(both)) < whole.sum()
        return _state(table["chunk"][0].as_py(), found)

    found = ex.answers(states.mapInArrow(send, ex.SENT), _judge_contexts)
    return states.groupBy("chunk").cogroup(found.groupBy("chunk")).applyInArrow(decide, _STATE)


def repeated_bytes(docs: DataFrame, chunk_ids: int = ex.CHUNK_IDS, buckets: int | None = None) -> DataFrame:
    """Documents with the bytes that repeated 200-byte strings cover, and the bytes that are left.

    Columns: doc_id, n_bytes, n_removed, removed (maximal runs of byte numbers, end
    exclusive), kept (bytes; a cut may fall inside a character). One row for each row of ``docs``.

    A null text is empty; it and texts below 200 bytes lose nothing. Rows of one id count as
    different documents, so copies of 200 bytes or more lose all that they share, all of them
    alike. A row without id takes no part and keeps its bytes. Other columns are ignored. An
    empty table gives an empty result.

    Runs three jobs when called: the first two rounds and the last write small tables.
    """
    chunks = ex.in_chunks(docs, chunk_ids)
    buckets = buckets or ex.bucket_count(docs)
    states = materialise(_first_round(chunks, buckets)).df
    states = materialise(_next_round(states, buckets)).df
    decided = materialise(_last_round(states, buckets)).df

    def send(table: pa.Table, state: pa.Table) -> pa.Table:
        if not table.num_rows or not state.num_rows:
            return ex.sent(0, np.zeros(0, np.uint64), buckets)
        rows = np.frombuffer(state["state"][0].as_py(), _DECIDED)
        return ex.sent(table["chunk"][0].as_py(), np.unique(_Text(table).windows(rows[~rows["whole"]])[1]), buckets)

    def apply(table: pa.Table, answer: pa.Table) -> pa.Table:
        text = _Text(table)
        state = answer.filter(pa.compute.equal(answer["bucket"], -1))
        if not state.num_rows:
            return _kept(text, np.zeros(len(text.data), bool))
        rows = np.frombuffer(state["bits"][0].as_py(), _DECIDED)
        whole, open_ = rows[rows["whole"]], rows[~rows["whole"]]
        starts, names = text.windows(open_)
        again = starts[_repeated(names, answer.filter(pa.compute.greater_equal(answer["bucket"], 0)), buckets)]
        lo = whole["lo"].astype(np.int64)
        spans = np.concatenate((lo, again)), np.concatenate((lo + whole["n"] - 1 + WINDOW, again + WINDOW))
        return _kept(text, spans_to_mask(*spans, len(text.data)))

    by_chunk = chunks.groupBy("chunk")
    found = ex.answers(by_chunk.cogroup(decided.groupBy("chunk")).applyInArrow(send, ex.SENT), ex.in_other_chunk)
    told = found.unionByName(decided.select("chunk", F.lit(-1).alias("bucket"), F.col("state").alias("bits")))
    judged = by_chunk.cogroup(told.groupBy("chunk")).applyInArrow(apply, RESULT)
    whole_text = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    unknown = docs.filter(F.col("doc_id").isNull()).select(
        F.lit(None).cast("bigint").alias("doc_id"), F.octet_length(whole_text).cast("bigint").alias("n_bytes"),
        F.lit(0).cast("bigint").alias("n_removed"),
        F.array().cast("array<struct<start:bigint,end:bigint>>").alias("removed"), whole_text.alias("kept"),
    )
    return judged.unionByName(unknown)


def _kept(text: _Text, covered: np.ndarray) -> pa.Table:
    offsets, n = text.offsets, len(text.offsets) - 1
    # one uncovered place after each document, so that runs end with it
    wide = np.zeros(len(covered) + n, bool)
    wide[np.arange(len(covered)) + np.repeat(np.arange(n), np.diff(offsets))] = covered
    starts, ends = mask_to_spans(wide)
    base = offsets + np.arange(n + 1)
    per_doc = np.searchsorted(starts, base)
    shift = np.repeat(base[:-1], np.diff(per_doc))
    removed = np.concatenate(([0], np.cumsum(covered)))[offsets]
    kept_offsets = offsets - removed
    return pa.table({
        "doc_id": text.table["doc_id"].cast(pa.int64()), "n_bytes": pa.array(np.diff(offsets), pa.int64()),
        "n_removed": pa.array(np.diff(removed), pa.int64()),
        "removed": pa.ListArray.from_arrays(
            pa.array(per_doc, pa.int32()),
            pa.StructArray.from_arrays([pa.array(starts - shift, pa.int64()), pa.array(ends - shift, pa.int64())], ["start", "end"]),
        ),
        "kept": pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), n, [None, pa.py_buffer(kept_offsets.astype(np.int64)), pa.py_buffer(text.data[~covered].tobytes())]
        ).cast(pa.binary()),
    })


def op10_suffix_array_dedup(spark, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    return repeated_bytes(docs).select(
        "doc_id", "n_bytes", "n_removed", F.size("removed").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )
