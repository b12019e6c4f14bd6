"""Benchmark decontamination by latent semantic retrieval.

Benchmark items are a stated query set, taken in blocks of ``ITEMS``. All their words are terms.
Letter case and marks don't count. Documents are cut into passages of ``PASSAGE`` words, half
overlapping, and for items of more words into passages of twice, four times ... as many, so that a
passage is never shorter than the item; a passage with half a passage on either side is its window.

Passages are rows of a TF-IDF matrix. Its right singular vectors come from a distributed randomised SVD:
tasks add up A'(A omega), the driver orthonormalises it (terms x ``RANK``), ``POWER`` times over, and tasks add up
the small Gram matrix. The cosine of a passage and an item is taken in that space, with their lengths in
the whole one: what the space doesn't hold counts as unlike, so a pair is near only if the space
represents both well.

Candidates come in two ways. Pairs whose cosine reaches ``LEAST_COSINE`` are taken as paraphrases, for which
the longest common subsequence must hold ``LEAST_NEAR`` of the item's words. All others, as the
space holds few directions and may miss a rare item, are candidates only if the window shares
``LEAST_LCS`` of the item's words, and the subsequence must hold as many: that bound loses no verbatim or
slightly changed copy, however badly the space represents it. In both cases the subsequence of the item's last
``ANSWER`` words (where questions have their answer) must hold ``LEAST_ANSWER`` of them. All is
counted word by word, over the window.

A subsequence is no longer than the number of words that item and window share, so a pair that shares
fewer than ``LEAST_NEAR`` of the item's words fails for certain, and a passage without any other pair is no row of the matrix.
Of n words of which r are shared, ``RARE_HITS`` of the n - r + ``RARE_HITS`` rarest are shared. Only pairs that have these
are counted in full, with r as ``LEAST_LCS`` sets it, n the words that occur in documents, and twice ``RARE_HITS`` words at least: a copy
always has them, and a paraphrase must have them too.

Items with fewer than ``LEAST_TERMS`` different words ("yes", "the answer") say nothing about a text that holds
them among others. They are found where they are the whole text, by an exact join.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetwatch.llm.arrays import LOWER, WHITE, small, text_bytes, word_hashes, word_spans
from fleetwatch.llm.fitting import bounded_batches
from fleetwatch.session import materialise

ITEMS = 20_000
PASSAGE = 64
LEAST_TERMS = 3
RARE_HITS = 4
RANK, OVER, POWER = 64, 8, 1
LEAST_COSINE = 0.6
LEAST_LCS, LEAST_NEAR, LEAST_ANSWER, ANSWER = 0.6, 0.45, 0.5, 8

_APART = WHITE.copy()
_APART[[ord(c) for c in ".,;:!?\"'()[]|"]] = True
_PASSAGES = "doc_id bigint, text string, terms array<int>, counts array<int>, items array<int>, full array<boolean>"


def _words(texts: pa.Array):
    data, offsets = text_bytes(texts)
    lower = LOWER[data]
    starts, ends, first = word_spans(lower, offsets, _APART)
    return data, starts, ends, first, word_hashes(lower, starts, ends)


def _places(hashes: np.ndarray, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which words are terms, and which terms they are."""
    at = np.searchsorted(terms, hashes)
    at[at == len(terms)] = 0
    hit = np.flatnonzero(terms[at] == hashes)
    return hit, at[hit]


def _document_counts(terms: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, docs = np.zeros(len(terms), np.int64), 0
        for batch in small(batches):
            _, _, _, first, hashes = _words(batch["text"])
            hit, term = _places(hashes, terms)
            doc = np.searchsorted(first, hit, side="right") - 1
            counts += np.bincount(np.unique(doc * len(terms) + term) % len(terms), minlength=len(terms))
            docs += len(batch)
        full = np.append(np.flatnonzero(counts), len(terms))  # the last counts documents
        yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array(np.append(counts, docs)[full])], ["term", "n"])

    return run


class Terms:
    """The words of a block of items: hashes, weights, and which items have them how often."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, total: int, first: np.ndarray, words: np.ndarray):
        self.hashes, self.idf = hashes, np.log((1 + total) / (1 + counts)) + 1
        # of an item's words, as many must be in a window: of a paraphrase, and of any other copy
        self.least, self.full = np.zeros((2, len(first) - 1), np.int64)
        whole, rare = [], []
        for k, (a, b) in enumerate(zip(first[:-1], first[1:])):
            ids, many = np.unique(np.searchsorted(hashes, words[a:b]), return_counts=True)
            if len(ids) < LEAST_TERMS:
                continue
            n = int(b - a)
            self.least[k], self.full[k] = (np.argmax(np.arange(n + 1) / n >= part) for part in (LEAST_NEAR, LEAST_LCS))
            order = np.argsort(counts[ids], kind="stable")
            ids, many = ids[order], many[order]
            whole.append((k, ids, many))
            ids, many = ids[counts[ids] > 0], many[counts[ids] > 0]  # words that no document has are never shared
            left = max(many.sum() - self.full[k] + min(RARE_HITS, self.full[k]), 2 * RARE_HITS)
            before = np.cumsum(many) - many
            part = before < left
            rare.append((k, ids[part], np.minimum(many, left - before)[part]))
        self.whole, self.rare = _table(whole, len(self.least)), _table(rare, len(self.least))
        self.by_term = np.argsort(self.rare[1], kind="stable")
        self.of_term = np.searchsorted(self.rare[1][self.by_term], np.arange(len(hashes) + 1))

    def candidates(self, window: np.ndarray, term: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All pairs of window (of sorted entries window, term, count) and item that share enough words for a paraphrase, and whether for any copy."""
        item, _, many, _ = self.rare
        entry, at = _spread(self.of_term[term], self.of_term[term + 1])
        at = self.by_term[at]
        keys, to = np.unique(window[entry] * len(self.least) + item[at], return_inverse=True)
        hits = np.bincount(to, np.minimum(count[entry], many[at]), minlength=len(keys))
        keys = keys[hits >= np.minimum(RARE_HITS, self.full[keys % len(self.least)])]
        _, ids, many, start = self.whole
        listed, known, kept, full = window * len(self.hashes) + term, np.append(count, 0), [], []
        for part in np.array_split(keys, len(keys) // 10_000 + 1):
            row, item = np.divmod(part, len(self.least))
            pair, at = _spread(start[item], start[item + 1])
            wanted = row[pair] * len(self.hashes) + ids[at]
            place = np.searchsorted(listed, wanted)
            place[np.append(listed, -1)[place] != wanted] = len(listed)
            shared = np.bincount(pair, np.minimum(known[place], many[at]), minlength=len(part))
            enough = shared >= self.least[item]
            kept.append(part[enough])
            full.append((shared >= self.full[item])[enough])
        return *np.divmod(np.concatenate(kept), len(self.least)), np.concatenate(full)


def _table(parts: list, items: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Item, term and count of all entries, and where each item's begin (with the total last)."""
    item = np.repeat(np.array([k for k, _, _ in parts], np.int64), [len(t) for _, t, _ in parts])
    term, many = (np.concatenate([p[i] for p in parts] or [np.zeros(0, np.int64)]) for i in (1, 2))
    return item, term, many, np.searchsorted(item, np.arange(items + 1))


def _spread(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each range which range it is and each of its places."""
    n = end - start
    of = np.repeat(np.arange(len(n)), n)
    return of, np.arange(len(of)) - (np.cumsum(n) - n)[of] + start[of]


def _added(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    kept, at = np.unique(keys, return_inverse=True)
    return kept, np.bincount(at, counts, minlength=len(kept)).astype(np.int64)


def _passages(terms: Terms, size: int):
    step = size // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        many = len(terms.hashes)
        for batch in small(batches):
            data, starts, ends, first, hashes = _words(batch["text"])
            hit, term = _places(hashes, terms.hashes)
            doc = np.searchsorted(first, hit, side="right") - 1
            width = int(np.diff(first).max(initial=0)) // step + 4
            blocks, n = np.unique((doc * width + (hit - first[doc]) // step) * many + term, return_counts=True)
            # a window is a passage with half a passage on either side: four blocks, from the one before its passage's first
            moved = [(blocks[k] - back * many, n[k]) for back in (-1, 0, 1, 2) for k in [(blocks // many) % width >= back]]
            keys, counts = _added(*map(np.concatenate, zip(*moved)))
            found = []
            windows, sharing, full = terms.candidates(keys // many, keys % many, counts)  # in order of windows
            for r in np.unique(windows):
                a, b = np.searchsorted(blocks, (r * many, (r + 2) * many))
                listed, times = _added(blocks[a:b] % many, n[a:b])
                d, at = divmod(int(r), width)
                i = max(first[d], first[d] + at * step - step)
                j = min(first[d + 1], first[d] + at * step + size + step)
                own = slice(*np.searchsorted(windows, (r, r + 1)))
                found.append((d, data[starts[i]:ends[j - 1]].tobytes().decode(), listed.tolist(), times.tolist(), sharing[own].tolist(), full[own].tolist()))
            d, text, kinds, times, known, whole = zip(*found) if found else ((),) * 6
            yield pa.RecordBatch.from_arrays([
                batch["doc_id"].take(pa.array(d, pa.int64())), pa.array(text, pa.string()),
                pa.array(kinds, pa.list_(pa.int32())), pa.array(times, pa.list_(pa.int32())),
                pa.array(known, pa.list_(pa.int32())), pa.array(whole, pa.list_(pa.bool_())),
            ], ["doc_id", "text", "terms", "counts", "items", "full"])

    return run


def _weighted(batch: pa.RecordBatch, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, term and weight of all entries of a batch; rows have length one."""
    sizes = batch["terms"].value_lengths().to_numpy()
    row = np.repeat(np.arange(len(sizes)), sizes)
    term = batch["terms"].flatten().to_numpy()
    weight = (1 + np.log(batch["counts"].flatten().to_numpy())) * idf[term]
    norm = np.sqrt(np.bincount(row, weight**2, minlength=len(sizes)))
    return row, term, weight / norm[row]


def _times(row, term, weight, right: np.ndarray, rows: int) -> np.ndarray:
    """Sparse rows, in their order, times a dense matrix."""
    out = np.zeros((rows, right.shape[1]))
    filled, start = np.unique(row, return_index=True)
    if len(filled):
        out[filled] = np.add.reduceat(weight[:, None] * right[term], start)
    return out


def _summed(df: DataFrame, run, rows: int, width: int) -> np.ndarray:
    """The sum of matrices that tasks yield as rows (at, c0, c1, ...): rows x width numbers come to the driver."""
    made = df.mapInArrow(run, "at int, " + ", ".join(f"c{i} double" for i in range(width)))
    out = np.zeros((rows, width))
    for r in made.groupBy("at").agg(*[F.sum(f"c{i}") for i in range(width)]).collect():
        out[r[0]] = r[1:]
    return out


def _matrix(at: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
    columns = [pa.array(at, pa.int32()), *[pa.array(np.ascontiguousarray(c)) for c in values.T]]
    return pa.RecordBatch.from_arrays(columns, ["at", *[f"c{i}" for i in range(values.shape[1])]])


def latent_space(passages: DataFrame, idf: np.ndarray, rank: int = RANK) -> np.ndarray:
    """Right singular vectors (terms x rank) of the passages' TF-IDF matrix, by a randomised SVD."""
    width = min(rank + OVER, len(idf))
    def sketched(by: np.ndarray) -> np.ndarray:
        def sketch(batches):
            total = np.zeros((len(idf), width))
            for batch in batches:
                row, term, weight = _weighted(batch, idf)
                y = _times(row, term, weight, by, len(batch))
                order = np.argsort(term, kind="stable")
                total += _times(term[order], row[order], weight[order], y, len(idf))
            at = np.flatnonzero(total.any(axis=1))
            yield _matrix(at, total[at])

        return np.linalg.qr(_summed(passages, sketch, len(idf), width))[0]

    basis = sketched(np.random.default_rng(5).standard_normal((len(idf), width)))
    for _ in range(POWER):
        basis = sketched(basis)

    def gram(batches):
        total = np.zeros((width, width))
        for batch in batches:
            y = _times(*_weighted(batch, idf), basis, len(batch))
            total += y.T @ y
        yield _matrix(np.arange(width), total)

    values, vectors = np.linalg.eigh(_summed(passages, gram, width, width))
    return basis @ vectors[:, ::-1][:, :rank]


def common_subsequence(one: list, two: list) -> int:
    """Length of the longest common subsequence, with a row of the table as bits of an integer."""
    masks: dict = {}
    for i, w in enumerate(one):
        masks[w] = masks.get(w, 0) | 1 << i
    full = (1 << len(one)) - 1
    row = full
    for w in two:
        if w in masks:
            x = row & masks[w]
            row = (row + x | row - x) & full
    return len(one) - row.bit_count()


_PLAIN = np.where(_APART, 32, LOWER).astype(np.uint8).tobytes()


def _cut(text: str) -> list[bytes]:
    """The words of a text, as ``_words`` finds them."""
    return text.encode().translate(_PLAIN).split()


def _search(space: np.ndarray, idf: np.ndarray, items: list[tuple[int, int, list, np.ndarray]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors = np.stack([v for _, _, _, v in items])
        place = np.zeros(max(k for k, _, _, _ in items) + 1, int)
        place[[k for k, _, _, _ in items]] = np.arange(len(items))
        for batch in batches:
            z = _times(*_weighted(batch, idf), space, len(batch))
            found = []
            texts, listed = batch["text"], batch["items"]
            passage = np.repeat(np.arange(len(batch)), listed.value_lengths().to_numpy())
            item = place[listed.flatten().to_numpy()]
            # an item that is near but shares too few words would fail below for certain
            cosine = np.concatenate([np.einsum("ij,ij->i", z[p], vectors[q]) for p, q in zip(*[np.array_split(x, len(item) // 20_000 + 1) for x in (passage, item)])])
            near = cosine >= LEAST_COSINE
            tried = np.flatnonzero(near | batch["full"].flatten().to_numpy(zero_copy_only=False))
            words_of, at = None, -1
            for p, q, is_near in zip(passage[tried], item[tried], near[tried]):
                if p != at:
                    words_of, at = _cut(texts[int(p)].as_py()), p
                words = items[q][2]
                shared = common_subsequence(words, words_of) / len(words)
                answer = words[-ANSWER:]
                if shared >= (LEAST_NEAR if is_near else LEAST_LCS) and common_subsequence(answer, words_of) >= LEAST_ANSWER * len(answer):
                    found.append((batch["doc_id"][int(p)].as_py(), items[q][1], shared))
            d, i, s = zip(*found) if found else ((),) * 3
            yield pa.RecordBatch.from_arrays([pa.array(d, pa.int64()), pa.array(i, pa.int64()), pa.array(s, pa.float64())], ["doc_id", "item_id", "shared"])

    return run


_MARKS = r"[\x20\x09-\x0D.,;:!?\"'()\[\]|]+"


def _whole_texts(texts: DataFrame, rows: list[tuple[int, str]]) -> DataFrame:
    """Texts whose words are those of an item, in order."""
    items = texts.sparkSession.createDataFrame(rows, "item_id bigint, text string")

    def words(column):
        return F.trim(F.regexp_replace(column, _MARKS, " "))

    listed = items.select("item_id", words("text").alias("words"))
    return texts.select("doc_id", words("text").alias("words")).join(listed, "words").select("doc_id", "item_id", F.lit(1.0).alias("shared"))


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Columns doc_id, item_id, shared (part of the item's words found in order): every item found in a document.

    Null and empty texts and items lead to nothing. Items with fewer than ``LEAST_TERMS``
    different words are found in texts that have no other words. Repeated documents give one row. Rows without id are not
    reported. Other columns are ignored. Runs jobs when called.
    """
    bounded_batches(docs)
    texts = docs.filter("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("bigint").alias("doc_id"), F.lower("text").alias("text"))
    # the stated query set; its terms and vectors are sent to tasks in blocks
    listed = benchmark.filter("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").cast("bigint"), "text").distinct()
    rows = sorted((r[0], r[1].lower()) for r in listed.collect())
    found = [_leaks_of(texts, rows[i:i + ITEMS]) for i in range(0, len(rows), ITEMS)]
    found = [f for f in found if f is not None]
    few = [(item, text) for item, text in rows if 0 < len(set(_cut(text))) < LEAST_TERMS]
    found += [_whole_texts(texts, few)] if few else []
    if not found:
        return docs.sparkSession.createDataFrame([], "doc_id bigint, item_id bigint, shared double")
    return reduce(DataFrame.unionByName, found).groupBy("doc_id", "item_id").agg(F.max("shared").alias("shared"))


def _passage_size(words: int) -> int:
    """``PASSAGE``, doubled until it holds an item of so many words."""
    size = PASSAGE
    while size < words:
        size *= 2
    return size


def _leaks_of(texts: DataFrame, rows: list[tuple[int, str]]) -> DataFrame | None:
    _, _, _, first, hashes = _words(pa.array([t for _, t in rows]))
    terms = np.unique(hashes)
    if not len(terms):
        return None
    counted = texts.select("text").mapInArrow(_document_counts(terms), "term int, n bigint").groupBy("term").agg(F.sum("n"))
    counts = np.zeros(len(terms) + 1, np.int64)
    for r in counted.collect():  # one row a term
        counts[r[0]] = r[1]
    sizes = np.array([_passage_size(n) for n in np.diff(first)])
    found = []
    for size in np.unique(sizes):  # one scan each
        chosen = np.flatnonzero(sizes == size)
        words = np.concatenate([hashes[first[k]:first[k + 1]] for k in chosen])
        own = np.unique(words)
        starts = np.append(0, np.cumsum(np.diff(first)[chosen]))
        block = Terms(own, counts[np.searchsorted(terms, own)], counts[-1], starts, words)
        found.append(_leaks_of_size(texts, [rows[k] for k in chosen], block, starts, words, int(size)))
    found = [f for f in found if f is not None]
    return reduce(DataFrame.unionByName, found) if found else None


def _leaks_of_size(texts: DataFrame, rows: list[tuple[int, str]], terms: Terms, first: np.ndarray, words: np.ndarray, size: int) -> DataFrame | None:
    if not terms.least.any():
        return None
    passages = materialise(texts.mapInArrow(_passages(terms, size), _PASSAGES))
    if not passages.rows:
        return None
    space = latent_space(passages.df, terms.idf)
    items = []
    for k, (item, text) in enumerate(rows):
        kinds, many = np.unique(np.searchsorted(terms.hashes, words[first[k]:first[k + 1]]), return_counts=True)
        if len(kinds) >= LEAST_TERMS:
            weight = (1 + np.log(many)) * terms.idf[kinds]
            items.append((k, item, _cut(text), weight / np.linalg.norm(weight) @ space[kinds]))
    return passages.df.mapInArrow(_search(space, terms.idf, items), "doc_id bigint, item_id bigint, shared double")


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Columns doc_id, contaminated, item_id (the item found most fully; of equals the least), shared. One row for each row of ``docs``."""
    best = leaks(docs, benchmark).groupBy("doc_id").agg(F.min(F.struct((-F.col("shared")).alias("less"), "item_id")).alias("best"))
    worst = materialise(best.select("doc_id", "best.item_id", (-F.col("best.less")).alias("shared"))).df
    ids = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"))
    return ids.join(worst, "doc_id", "left").select("doc_id", F.col("item_id").isNotNull().alias("contaminated"), "item_id", "shared")


def op3_decontamination(spark, folder: str) -> DataFrame:
    return contamination(*[spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "benchmark")])
