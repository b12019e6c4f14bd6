"""MinHash near-dedup with b-bit signatures.

A document's set holds its distinct shingles of ``words`` words. ``BANDS * ROWS`` minima of the
set are taken; groups of five give the band keys that generate candidates, and then only the
two low bits of each minimum are kept, packed as bit planes in four longs. Two signatures agree
in a place by chance with probability 1/4, so with e the share of equal places (bit counts of
the planes) the similarity is estimated as (e - 1/4) / (3/4). A candidate whose estimate lies
five deviations below the threshold is dropped; all others are confirmed on full sets.

Groups. Documents of one set collapse into one node first. In each bucket of a band, nodes are
compared with one centre (a star), not with each other. Confirmed links make components;
buckets that still hold several components get another star, now around the node with the least
share of rare shingles (that at most ``RARE`` open nodes have). What is still open then goes through
two exact filters. Of two sets at the threshold, the rarest shingles (n - ceil(t n) + 1 of each)
must have one in common; and if the rarest common one is not rare, no rare shingle is in the
intersection. A pair comes up at the rarest shingle of both only, not at each one that they share, and
parity bitmaps of the sets (unequal bits are at most as many as unequal shingles) tell most pairs of loose
copies apart before anything is confirmed. No bucket is capped, pairs of one component are never listed,
and no link between components is lost: a pair at the threshold of 0.85 misses all bands with a
chance of 8e-6, and with less above it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetwatch.llm.arrays import LOWER, Prefix, mixed, pack_sorted, text_bytes, unpack_sorted, word_hashes, word_spans
from fleetwatch.llm.components import components
from fleetwatch.llm.fitting import bounded_batches
from fleetwatch.session import materialise

BANDS, ROWS = 20, 5
PLACES = BANDS * ROWS
RARE = 20
STARS = 2  # rounds of stars before the exact filter
BITS = 16  # longs of a set's parity bitmap
SEEN = 64  # first keys of a node that tell whether a pair met before; beyond them a pair may come up again
PLANES = ("p0", "p1", "q0", "q1")

_rng = np.random.default_rng(42)
_FLIP = _rng.integers(0, 2**32, (PLACES, 1), dtype=np.uint32)
_TIMES = _rng.integers(0, 2**31, (PLACES, 1), dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_SHIFTS = np.arange(PLACES // 2, dtype=np.uint64)
_BLOCK = 20_000  # shingles whose minima are taken at once

_SKETCH = f"doc_id bigint, n bigint, set_id bigint, {', '.join(f'{p} bigint' for p in PLANES)}, bands array<bigint>"
_HELD = tuple(f"h{i}" for i in range(BITS))
_SETS = f"set_id bigint, shingles binary, {', '.join(f'{h} bigint' for h in _HELD)}"
_LOW48 = np.uint64(16)


def shingle_sets(texts: pa.Array, words: int) -> list[np.ndarray]:
    """Distinct shingle hashes of each text, sorted. Letters A-Z count as lower case."""
    data, offsets = text_bytes(texts)
    data = LOWER[data]
    starts, ends, first = word_spans(data, offsets)
    hashes = Prefix(word_hashes(data, starts, ends))
    sets = []
    for i, j in zip(first[:-1].tolist(), first[1:].tolist()):
        at = np.arange(i, max(j - words, i) + 1) if j > i else np.zeros(0, np.int64)
        sets.append(np.unique(mixed(hashes.slices(at, np.minimum(at + words, j)))))
    return sets


def _set_ids(sets: list[np.ndarray]) -> np.ndarray:
    ids = [int(np.bitwise_xor.reduce(mixed(s))) ^ (int(s.sum()) * 31 + len(s)) if len(s) else 0 for s in sets]
    return mixed(np.array([i & (2**64 - 1) for i in ids], np.uint64)).view(np.int64)


def minima(sets: list[np.ndarray]) -> np.ndarray:
    """One row of ``PLACES`` minima for each set; all ones for an empty set."""
    out = np.full((len(sets), PLACES), 2**32 - 1, np.uint32)
    block: list[int] = []
    size = 0
    for i, s in enumerate(sets + [None]):
        if block and (s is None or size + len(s) > _BLOCK):
            values = np.concatenate([(sets[k] >> np.uint64(32)).astype(np.uint32) for k in block])
            edges = np.cumsum([0] + [len(sets[k]) for k in block[:-1]])
            # a very long text is one block of many parts
            parts = [np.minimum.reduceat((values[a:a + _BLOCK] ^ _FLIP) * _TIMES, np.unique(np.clip(edges - a, 0, None)[edges < a + _BLOCK]), axis=1) for a in range(0, len(values), _BLOCK)]
            out[block] = (parts[0] if len(block) > 1 or len(parts) == 1 else np.minimum.reduce(parts)).T
            block, size = [], 0
        if s is not None and len(s):
            block.append(i)
            size += len(s)
    return out


def _sketches(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 128):
                part = batch.slice(at, 128)
                sets = shingle_sets(part["text"], words)
                least = minima(sets)
                grouped = least.reshape(len(sets), BANDS, ROWS).astype(np.uint64)
                keys = np.full((len(sets), BANDS), 1, np.uint64) * np.arange(1, BANDS + 1, dtype=np.uint64)
                for r in range(ROWS):
                    keys = mixed(keys * np.uint64(0x9E3779B97F4A7C15) + grouped[:, :, r])
                half = PLACES // 2
                planes = [
                    (((least[:, side * half:(side + 1) * half].astype(np.uint64) >> np.uint64(bit)) & np.uint64(1)) << _SHIFTS).sum(axis=1).view(np.int64)
                    for side in (0, 1) for bit in (0, 1)
                ]
                full = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1) * BANDS, pa.int32()), pa.array(keys.ravel().view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [part["doc_id"], pa.array([len(s) for s in sets], pa.int64()), pa.array(_set_ids(sets)), *map(pa.array, planes), full],
                    ["doc_id", "n", "set_id", *PLANES, "bands"],
                )

    return run


def _parities(sets: list[np.ndarray]) -> np.ndarray:
    """A row of ``BITS`` longs for each set: whether an odd number of its shingles falls on each bit."""
    odd = np.zeros((len(sets), BITS * 64), bool)
    for row, s in zip(odd, sets):
        row[:] = np.bincount((s & np.uint64(BITS * 64 - 1)).astype(np.int64), minlength=BITS * 64) & 1
    return np.packbits(odd, axis=1, bitorder="little").view("<i8")


def _full_sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 128):
                sets = shingle_sets(batch.slice(at, 128)["text"], words)
                ids = pa.array(_set_ids(sets))
                sets = [np.unique(s >> _LOW48) for s in sets]  # 48 bits suffice inside one pair
                blobs = pa.array([pack_sorted(s) for s in sets], pa.binary())
                yield pa.RecordBatch.from_arrays([ids, blobs, *map(pa.array, _parities(sets).T)], ["set_id", "shingles", *_HELD])

    return run


def _exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [unpack_sorted(x).view(np.int64) for x in batch["shingles"].to_pylist()]
        nodes = np.repeat(np.array(batch["node"], np.int64), [len(s) for s in sets])
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(np.concatenate(sets) if sets else nodes)], ["node", "key"])


@F.pandas_udf(T.LongType())
def _in_common(one: pd.Series, two: pd.Series) -> pd.Series:
    def shared(a, b):
        both = np.concatenate((unpack_sorted(a), unpack_sorted(b)))
        both.sort()
        return int((both[1:] == both[:-1]).sum())

    return pd.Series([shared(a, b) for a, b in zip(one, two)])


def estimate(one: str, two: str) -> Column:
    """Similarity estimated from equal two-bit places, freed of chance agreement."""
    def differ(p: str, q: str) -> Column:
        flips = [F.col(f"{one}{x}").bitwiseXOR(F.col(f"{two}{x}")) for x in (p, q)]
        return F.bit_count(flips[0].bitwiseOR(flips[1]))

    equal = 1 - (differ("p0", "p1") + differ("q0", "q1")) / F.lit(PLACES)
    return (equal - 0.25) / 0.75


def _possible(percent: int) -> Column:
    """Whether a pair can be at the threshold: by what both can have in common, and by the estimate."""
    agree = 0.25 + 0.75 * percent / 100
    slack = 5 * (agree * (1 - agree) / PLACES) ** 0.5 / 0.75
    common = F.least(F.col("a_n") - F.col("a_apart"), F.col("b_n") - F.col("b_apart"))
    return ((100 + percent) * common >= percent * (F.col("a_n") + F.col("b_n"))) & (estimate("a_", "b_") >= percent / 100 - slack)


def _few_apart(percent: int) -> Column:
    """Whether a pair can be at the threshold by its bitmaps: unequal bits are at most as many as shingles that only one set has."""
    unequal = reduce(lambda x, y: x + y, [F.bit_count(F.col(f"a_{h}").bitwiseXOR(F.col(f"b_{h}"))) for h in _HELD])
    sizes = F.col("a_n") + F.col("b_n")
    return (100 + percent) * (sizes - unequal) >= 2 * percent * sizes


def _side(df: DataFrame, side: str) -> DataFrame:
    more = [c for c in ("before", *_HELD) if c in df.columns]
    return df.select("key", F.col("node").alias(side), *[F.col(c).alias(f"{side}_{c}") for c in ("n", *PLANES, "apart", "comp", *more)])


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """Links of 100 * intersection >= percent * union, as components.

    Columns: doc_id, n_shingles (set size), component_id (least doc_id reachable), kept (doc_id =
    component_id). One row for each row of ``docs``.

    A text with fewer words than a shingle is one shingle; a null, empty or blank text has the
    empty set and is linked with nothing. Repeated rows stay, and belong together. A row without
    id gets its set size, a null component and kept = true, and links nobody. Other columns are
    ignored. An empty table gives an empty result. Runs jobs when called.
    """
    bounded_batches(docs)
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    sketches = materialise(docs.mapInArrow(_sketches(words), _SKETCH)).df
    known = sketches.filter("doc_id IS NOT NULL AND n > 0")
    nodes = known.groupBy(F.col("set_id").alias("node")).agg(F.min("doc_id").alias("first"))

    keyed = known.select(F.col("set_id").alias("node"), "n", *PLANES, F.explode("bands").alias("key"))
    several = keyed.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high")).filter("low < high").select("key")
    rows = materialise(keyed.join(several, "key").dropDuplicates(["key", "node"])).df

    members = nodes.join(rows.select("node").distinct(), "node", "left_semi")
    texts = docs.join(members.select(F.col("first").alias("doc_id")).distinct(), "doc_id")
    full = texts.select("text").mapInArrow(_full_sets(words), _SETS)
    sets = materialise(full.dropDuplicates(["set_id"])).df

    def confirmed(pairs: DataFrame) -> DataFrame:
        one = pairs.join(sets.select(F.col("set_id").alias("a"), F.col("shingles").alias("a_set")), "a")
        two = one.join(sets.select(F.col("set_id").alias("b"), F.col("shingles").alias("b_set")), "b")
        common = two.select("a", "b", "a_n", "b_n", _in_common("a_set", "b_set").alias("common"))
        return common.filter(F.col("common") * (100 + percent) >= percent * (F.col("a_n") + F.col("b_n"))).select("a", "b")

    def shingles_of(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Shingles that at least two of the nodes have, with their frequency; and how many rare ones each node has."""
        full = nodes.join(sets.withColumnRenamed("set_id", "node"), "node").select("node", "shingles")
        held = materialise(full.mapInArrow(_exploded, "node bigint, key bigint")).df
        common = held.groupBy("key").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
        shared = materialise(held.join(common, "key")).df
        met = shared.groupBy("node").agg(F.count(F.lit(1)).alias("met"), F.count_if(F.col("df") > RARE).alias("usual"))
        sizes = nodes.join(met, "node", "left").fillna(0, ["met", "usual"])
        return shared, materialise(sizes.select("node", (F.col("n") - F.col("met")).alias("own"), (F.col("n") - F.col("usual")).alias("rare"))).df

    def rarest(nodes: DataFrame, shared: DataFrame) -> DataFrame:
        """A row (column key) for each shingle of the part of a set that a partner must meet."""
        of_node = Window.partitionBy("node").orderBy("df", "key")  # one document's shingles
        mine = shared.join(nodes.select("node"), "node", "left_semi")
        ranked = mine.select("node", "key", "df", (F.col("df") <= RARE).alias("seldom"), F.row_number().over(of_node).alias("nth"))
        needed = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
        heads = F.collect_list(F.when(F.col("nth") <= SEEN, F.col("key"))).over(of_node.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
        first = ranked.withColumn("heads", heads).join(nodes, "node").filter(F.col("nth") <= needed - F.col("own"))
        before = F.slice("heads", 1, F.least(F.col("nth") - 1, F.lit(SEEN)))
        apart = F.when(F.col("seldom"), 0).otherwise(F.col("rare"))
        marked = first.withColumns({"apart": apart, "before": before}).drop("nth", "heads", "df")
        return materialise(marked.join(sets.select(F.col("set_id").alias("node"), *_HELD), "node")).df

    links, tried, labels = [], [], None
    for turn in range(STARS + 1):
        if labels is None:
            open_ = rows.withColumn("comp", F.col("node"))
        else:
            named = rows.join(labels, "node", "left").withColumn("comp", F.coalesce("label", "node")).drop("label")
            mixed_keys = named.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low < high").select("key")
            open_ = materialise(named.join(mixed_keys, "key")).df
        if turn == 0:
            open_ = open_.withColumns({"apart": F.lit(0), "draw": F.xxhash64("node")})
        else:
            if turn == 1:
                shared, rare = shingles_of(open_.select("node", "n").dropDuplicates(["node"]))
            open_ = open_.join(rare, "node").withColumns({"apart": F.lit(0), "draw": F.col("rare") / F.col("n")})
        star = turn < STARS
        if star:
            members = open_
            best = F.min(F.struct("draw", "node", "n", *PLANES, "apart", "comp"))
            others = open_.groupBy("key").agg(best.alias("c")).select("key", "c.*")
        else:
            members = others = rarest(open_.drop("key", "apart").dropDuplicates(["node"]), shared)
        if star:
            wanted = (F.col("a_comp") != F.col("b_comp")) & _possible(percent)
        else:  # a pair comes up at the least key of both, not at each one they share
            wanted = (F.col("a_comp") < F.col("b_comp")) & _possible(percent) & _few_apart(percent) & ~F.arrays_overlap("a_before", "b_before")
        found = _side(members, "a").join(_side(others, "b"), "key").filter(wanted)
        pairs = found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "a_n", "b_n").dropDuplicates(["a", "b"])
        for old in tried:
            pairs = pairs.join(old.select("a", "b"), ["a", "b"], "left_anti")
        pairs = materialise(pairs)
        if pairs.rows:
            tried.append(pairs.df)
            edges = materialise(confirmed(pairs.df))
            if edges.rows:
                links.append(edges.df)
                labels = components(reduce(DataFrame.unionByName, links))

    if labels is None:
        whole = nodes.withColumnRenamed("first", "component_id")
    else:
        comp = nodes.join(labels, "node", "left").withColumn("comp", F.coalesce("label", "node"))
        least = comp.groupBy("comp").agg(F.min("first").alias("component_id"))
        whole = comp.join(least, "comp").select("node", "component_id")
    slim = sketches.select("doc_id", "n", "set_id")
    linked = slim.filter("doc_id IS NOT NULL AND n > 0").join(whole.withColumnRenamed("node", "set_id"), "set_id")
    alone = slim.filter("doc_id IS NULL OR n = 0").withColumn("component_id", F.col("doc_id"))
    return linked.unionByName(alone).select(
        "doc_id", F.col("n").alias("n_shingles"), "component_id",
        F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"),
    )


def op2_minhash_dedup(spark, folder: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{folder}/documents.parquet"), words=3, percent=85)
