"""Mixing sources to target weights with fixed-length blocks.

The words of a source, its documents one after the other, are cut into blocks of a fixed length (the
last one may be shorter). The mix is a row of slots, one block each, in output shards of a fixed
number of slots. Each shard draws how many of its slots go to each source from a multinomial with the
sources' shares of the mix, seeded by the shard's number, so shards are drawn in parallel and reruns
agree.

The slots of a source are numbered over all shards, and a pseudorandom permutation of the source
takes the number to an index. Independent draws stray from the targets by chance, so indexes at or
above a source's quota (its target in blocks) are passed on, in order, to the sources that drew too few.
After that a source's indexes are 0 to quota - 1, each once. An index counts whole passes over the
source's blocks, each pass in a permutation of its own: no block comes twice in a pass, and a target
of at most twice the source's size means at most two passes. Slots and blocks are joined by source
and block index.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetwatch.operators.ordering import positions, running_totals
from fleetwatch.operators.skew import find_hot, join_table
from fleetwatch.session import Table, materialise

BLOCK = 64          # words
SHARD = 4096        # slots
WEIGHTS = (5, 2, 1)
SHARE = 1.5         # of all words
MOST = 2            # times a source's size
SEED = 20240607
MAX_SOURCES = 100_000  # the table of sources travels to every task: 40 bytes a source
WORD = r"[^\x20\x09-\x0D]+"
_STEPS = np.array([turn * 0xD6E8FEB86659FD93 % 2**64 for turn in range(1, 5)], np.uint64)


def sized(docs: DataFrame, row=None) -> DataFrame:
    """row (a number of this run), doc_id, source, size (words of the text; 0 of a null one); written when called."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint")
    row = F.monotonically_increasing_id() if row is None else row
    return materialise(docs.select(row.alias("row"), "doc_id", "source", size.alias("size"), F.xxhash64("text").alias("print"))).df


def _of():
    return F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("__of")


@dataclass(frozen=True)
class Sources:
    """One row for each source: source, number (by code point, null last), weight, source_size, target, n_blocks, quota (blocks to take)."""

    table: Table
    block: int

    def arrays(self) -> dict[str, np.ndarray]:
        rows = self.table.df.orderBy("number").select("n_blocks", "quota").collect()  # at most MAX_SOURCES
        return {c: np.array([r[c] for r in rows], np.int64) for c in ("n_blocks", "quota")}


def weighed_sources(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST, block: int = BLOCK) -> Sources:
    """Targets by weight that add up to ``share`` of all words; none is above ``most`` times its source's size.

    What a source cannot take is shared among the others by weight, until none is above. Sources are few: more than
    ``MAX_SOURCES`` are an error.
    """
    sizes = materialise(docs.groupBy("source").agg(F.sum("size").alias("source_size")))
    if sizes.rows > MAX_SOURCES:
        raise ValueError(f"{sizes.rows} sources; at most {MAX_SOURCES} can be mixed")
    keyed = sizes.df.withColumn("__all", F.lit(0))
    numbered = positions(keyed, ["__all"], ["source"], find_hot(keyed, ["__all"], at_most=sizes.rows), "number").drop("__all")
    nth = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(F.col("number") - 1, F.lit(len(weights))) + 1).cast("int"))
    rows = materialise(numbered.withColumn("weight", nth.cast("bigint"))).df
    total = rows.agg(F.sum("source_size")).first()[0] or 0
    cap = F.col("source_size") * most
    level, full = None, F.lit(False)
    while True:  # each round fills one more source at least; the level of the others rises
        filled, open_weight = rows.agg(F.sum(F.when(full, cap)), F.sum(F.when(~full, F.col("weight")))).first()
        if not open_weight:
            level = None
            break
        higher = (share * total - (filled or 0)) / open_weight
        if higher == level:
            break
        level, full = higher, F.col("weight") * F.lit(higher) >= cap
    target = cap.cast("double") if level is None else F.least(cap.cast("double"), F.col("weight") * F.lit(level))
    n_blocks = F.ceil(F.col("source_size") / block).cast("bigint")
    quota = F.coalesce(F.rint(F.try_divide(target * n_blocks, F.col("source_size"))), F.lit(0)).cast("bigint")
    made = rows.withColumns({"target": target, "n_blocks": n_blocks}).withColumn("quota", F.least(quota, F.col("n_blocks") * most))
    return Sources(materialise(made), block)


def blocks(docs: DataFrame, sources: Sources) -> DataFrame:
    """number (of the source), block, place, row, start, n_words: which words of which document make up each block, and where in it.

    Documents follow each other by doc_id, then size, then a digest of the text. A source with very many documents is
    cut into slices for the running totals.
    """
    size = F.lit(sources.block)
    names = sources.table.df.select(_of(), "number")
    keyed = join_table(docs.filter("size > 0").select("*", _of()), Table(names, sources.table.rows, sources.table.bytes), ["__of"])
    rows = keyed.select("number", "doc_id", "size", "print", "row")
    totals = running_totals(rows, ["number"], ["doc_id", "size", "print", "row"], {"upto": F.col("size")}, find_hot(rows, ["number"]))
    first = F.col("upto") - F.col("size")
    spread = totals.select(
        "number", "row", first.alias("first"), "upto",
        F.explode(F.sequence(F.floor(first / size), F.floor((F.col("upto") - 1) / size))).alias("block"),
    )
    start = F.greatest(F.col("first"), F.col("block") * size)
    return spread.select(
        "number", F.col("block").cast("bigint").alias("block"), (start - F.col("block") * size).alias("place"), "row", (start - F.col("first")).alias("start"),
        (F.least("upto", (F.col("block") + 1) * size) - start).alias("n_words"),
    )


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def permuted(index: np.ndarray, size: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Pseudorandom permutations of 0..size-1, each named by its key, at the given indexes (below their size).

    A Feistel network over the least even number of bits that holds the size; what falls outside is sent through again.
    """
    half = (np.ceil(np.log2(np.maximum(size, 2))).astype(np.uint64) + np.uint64(1)) >> np.uint64(1)
    mask = (np.uint64(1) << half) - np.uint64(1)
    seed = _mixed(key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(SEED))
    at, todo = index.astype(np.uint64), np.arange(len(index))
    while len(todo):
        x, h, m, s = at[todo], half[todo], mask[todo], seed[todo]
        left, right = x >> h, x & m
        for step in _STEPS:
            left, right = right, left ^ (_mixed(right + s + step) & m)
        at[todo] = left << h | right
        todo = todo[at[todo] >= size[todo].astype(np.uint64)]
    return at.astype(np.int64)


def _drawn(quota: np.ndarray, shard_slots: int):
    total = int(quota.sum())
    upto = np.cumsum(quota) / max(total, 1)

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = {"shard": [], "number": [], "n": []}
            for shard in batch["id"].to_pylist():
                slots = min(shard_slots, total - shard * shard_slots)
                # slots at uniform places between the sources' shares: a multinomial draw whose work follows the slots
                places = np.random.default_rng([SEED, shard]).random(slots)
                counts = np.bincount(np.minimum(np.searchsorted(upto, places, side="right"), np.flatnonzero(quota)[-1]))
                of = np.flatnonzero(counts)
                made["shard"] += [shard] * len(of)
                made["number"] += (of + 1).tolist()
                made["n"] += counts[of].tolist()
            yield pa.RecordBatch.from_pydict(made, pa.schema([("shard", pa.int64()), ("number", pa.int64()), ("n", pa.int64())]))

    return draw


def _placed(drawn: np.ndarray, quota: np.ndarray, n_blocks: np.ndarray, rows: int = 100_000):
    lack_upto = np.cumsum(np.maximum(quota - drawn, 0))
    over_before = np.concatenate(([0], np.cumsum(np.maximum(drawn - quota, 0))))[:-1]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("shard", pa.int64()), ("number", pa.int64()), ("round", pa.int64()), ("block", pa.int64())])
        for batch in batches:
            shard, of, n, upto = (batch[c].to_numpy().astype(np.int64) for c in ("shard", "number", "n", "upto"))
            of = of - 1
            edges = np.searchsorted(np.cumsum(n), np.arange(0, n.sum() + rows, rows))
            for a, b in zip(edges, np.append(edges[1:], len(n))):
                if a >= b:
                    continue
                m = n[a:b]
                source, shards = np.repeat(of[a:b], m), np.repeat(shard[a:b], m)
                within = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
                slot = np.repeat(upto[a:b] - m, m) + within  # number of the slot among the source's
                index = permuted(slot, drawn[source], 2 * source)
                over = index >= quota[source]
                if over.any():
                    passed_on = over_before[source[over]] + index[over] - quota[source[over]]
                    to = np.searchsorted(lack_upto, passed_on, side="right")
                    index[over] = drawn[to] + passed_on - (lack_upto[to] - np.maximum(quota - drawn, 0)[to])
                    source[over] = to
                turn, block = index // n_blocks[source], index % n_blocks[source]
                block = permuted(block, n_blocks[source], (turn + 1) * 2 * len(quota) + 2 * source + 1)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (shards, source + 1, turn, block)], schema=schema)

    return place


def slots(spark, sources: Sources, shard_slots: int = SHARD) -> DataFrame:
    """shard, number (of the source), round (0: first pass over the source), block: one row for each slot of the mix."""
    known = sources.arrays()
    total = int(known["quota"].sum())
    empty = spark.createDataFrame([], "shard bigint, number bigint, round bigint, block bigint")
    if not total:
        return empty
    shards = -(-total // shard_slots)
    tasks = min(shards, max(spark.sparkContext.defaultParallelism, shards // 64))
    ids = spark.range(0, shards, numPartitions=tasks)
    counts = materialise(ids.mapInArrow(_drawn(known["quota"], shard_slots), "shard bigint, number bigint, n bigint")).df
    drawn = np.zeros(len(known["quota"]), np.int64)
    for row in counts.groupBy("number").agg(F.sum("n").alias("n")).collect():  # one row a source
        drawn[row["number"] - 1] = row["n"]
    numbered = running_totals(counts, ["number"], ["shard"], {"upto": F.col("n")}, find_hot(counts, ["number"]))
    # dealt out by shard again: the counts of a source lie in one partition
    spread = numbered.repartition(tasks, "shard")
    return spread.mapInArrow(_placed(drawn, known["quota"], known["n_blocks"]), empty.schema)


def taken_words(docs: DataFrame, **settings) -> DataFrame:
    """row, doc_id, source, size, source_size, target, taken (words of the mix that are the document's).

    One row for each row of ``docs``. A null or empty text, or one without words, has size 0 and gives nothing; a null
    source is a source. Ties of an id are ordered by size and digest, repeated rows count each. Without words every target
    is 0. Other columns are ignored. Runs jobs when called.
    """
    known = sized(docs)
    sources = weighed_sources(known, **settings)
    times = slots(docs.sparkSession, sources).groupBy("number", "block").agg(F.count(F.lit(1)).alias("times"))
    # the slots come out of a table of few rows, so their size is underrated: both sides are shuffled, nothing is broadcast
    parts = blocks(known, sources).join(times.hint("merge"), ["number", "block"])
    taken = parts.groupBy("row").agg(F.sum(F.col("n_words") * F.col("times")).alias("taken"))
    names = sources.table.df.select(_of(), "source_size", "target")
    both = join_table(known.select("*", _of()), Table(names, sources.table.rows, sources.table.bytes), ["__of"])
    return both.join(taken, "row", "left").select("row", "doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("bigint").alias("taken"))


def mixed_texts(docs: DataFrame, **settings) -> DataFrame:
    """The mix itself: shard, number (of the source), round, block, text (the words of the block, joined by spaces)."""
    numbered = materialise(docs.select("doc_id", "source", "text").withColumn("row", F.monotonically_increasing_id())).df
    known = sized(numbered, F.col("row"))
    sources = weighed_sources(known, **settings)
    words = F.slice(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), (F.col("start") + 1).cast("int"), F.col("n_words").cast("int"))
    parts = blocks(known, sources).join(numbered.select("row", "text"), "row").select("number", "block", "place", F.array_join(words, " ").alias("words"))
    in_order = F.sort_array(F.collect_list(F.struct("place", "words")))["words"]
    whole = parts.groupBy("number", "block").agg(F.array_join(in_order, " ").alias("text"))
    return slots(docs.sparkSession, sources).hint("merge").join(whole, ["number", "block"]).select("shard", "number", "round", "block", "text")


def op12_source_mix(spark, folder: str) -> DataFrame:
    mix = taken_words(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "source", "text"))
    return mix.select("doc_id", "size", "source_size", "target", "taken")
