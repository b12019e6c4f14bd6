"""Conversation prefix trie by truncation peeling.

A node is a distinct sequence of first turns. Nodes are found from the deepest level upwards: those
of a level are the surviving nodes of the level below with their last turn stripped, merged with the
conversations that end there. Each group of equal sequences is one node; its members, children,
leaves and saved tokens are summed as it is found, so the trie needs no pass over conversations again.

Turns are 128-bit digests from the first scan on. A conversation is cut into blocks of depths: the
first ``TOP`` levels, then blocks twice as wide each up to ``WIDE``. A sequence's name is the digest of
the name at the start of its block and the digest of its turns in the block, so that a conversation of
any length is named block by block, in many tasks.

Levels up to ``TOP``, where a few nodes hold most conversations, are peeled by Spark: one regrouping a
level, with partial aggregation. In a deeper block the sequences that share the block's start are peeled
in one task, level by level, if they hold at most ``PEEL_TURNS`` turns; the others are regrouped by Spark
too. Conversations that end at one node are merged before the peeling into one item with their digest,
made from a sorted stream, so copies without number cost a few bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetwatch.operators.ordering import positions
from fleetwatch.operators.skew import find_hot, join_table
from fleetwatch.session import Table, materialise

TOP = 8
WIDE = 16_384
PEEL_TURNS = 1_000_000

NO_ENDS = hashlib.sha256().hexdigest()
_SUMS = "conv bigint, n bigint, kids bigint, leaves bigint, saved bigint, ends string"
_ITEM = f"head binary, keys array<binary>, sizes array<bigint>, {_SUMS}"
_NODE = f"depth bigint, key binary, parent binary, parent_conv bigint, {_SUMS}"


def _schema(columns: str) -> pa.Schema:
    kinds = {"binary": pa.binary(), "bigint": pa.int64(), "string": pa.string(), "array<binary>": pa.list_(pa.binary()), "array<bigint>": pa.list_(pa.int64())}
    return pa.schema([(name, kinds[kind]) for name, kind in (c.split() for c in columns.split(", "))])


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """Columns conv, idx (from 1), turn_key (16 bytes that stand for role and text) and size (bytes of the text); written when called.

    Turns are taken in order of turn, nulls first, then role, then digest. A null role or text is an empty
    one. Rows without conv_id belong to no conversation. Repeated rows are turns of their own.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = conversations.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("bigint").alias("conv"), F.col("turn").isNotNull().cast("int").alias("has_turn"), F.col("turn").cast("bigint").alias("turn"),
        role.alias("role"), F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)).alias("digest"),
        F.octet_length(text).cast("bigint").alias("size"),
    )
    order = ("has_turn", "turn", "role", "digest")
    placed = positions(rows, ["conv"], order, find_hot(rows, ["conv"]), "idx")
    return materialise(placed.select("conv", "idx", F.unhex("digest").alias("turn_key"), "size")).df


def block_bounds(block: int, top: int = TOP, wide: int = WIDE) -> tuple[int, int]:
    """Depths of a block: above the first, up to the second."""
    if block == 0:
        return 0, top
    doublings = max(1, (wide // top).bit_length())
    if block <= doublings:
        return top << (block - 1), top << block
    first = (top << doublings) + (block - doublings - 1) * wide
    return first, first + wide


def block_of(depth: Column, top: int = TOP, wide: int = WIDE) -> Column:
    doublings = max(1, (wide // top).bit_length())
    last = top << doublings
    doubled = F.floor((depth - 1) / top).cast("bigint")
    return (
        F.when(doubled <= 0, 0).when(depth <= last, F.length(F.bin(doubled))).otherwise(doublings + 1 + F.floor((depth - last - 1) / wide)).cast("int")
    )


def _heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The name at the start of each block of a conversation, from the digests of its blocks."""
    for batch in batches:
        made = {"conv": [], "block": [], "head": []}
        for row in batch.to_pylist():
            head = b""
            for link in row["links"]:
                made["conv"].append(row["conv"])
                made["block"].append(link["block"])
                made["head"].append(head)
                head = hashlib.md5(head + link["link"], usedforsecurity=False).digest()
        yield pa.RecordBatch.from_pydict(made, pa.schema([("conv", pa.int64()), ("block", pa.int32()), ("head", pa.binary())]))


def _names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Names of all sequences of a block: digest of the block's start and of the turns in it so far."""
    for batch in batches:
        all_keys = []
        for head, turns in zip(batch["head"].to_pylist(), batch["turn_keys"].to_pylist()):
            so_far, keys = hashlib.md5(usedforsecurity=False), []
            for turn in turns:
                so_far.update(turn)
                keys.append(hashlib.md5(head + so_far.digest(), usedforsecurity=False).digest())
            all_keys.append(keys)
        columns = {c: batch[c] for c in ("conv", "block", "head", "ended")} | {"keys": pa.array(all_keys, pa.list_(pa.binary())), "sizes": batch["sizes"]}
        yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def _paths(turns: DataFrame, last_block: int, top: int, wide: int) -> DataFrame:
    block = block_of(F.col("depth"), top, wide)
    chunks = turns.groupBy("conv", block.alias("block")).agg(
        F.sort_array(F.collect_list(F.struct("depth", "turn_key", "size"))).alias("turns"),
        F.max((block_of(F.col("length"), top, wide) == block)).alias("ended"),
    )
    chunks = chunks.select("conv", "block", "ended", F.col("turns.turn_key").alias("turn_keys"), F.col("turns.size").alias("sizes"))
    if last_block:
        chunks = materialise(chunks).df
        link = F.unhex(F.md5(F.unhex(F.array_join(F.transform("turn_keys", F.hex), ""))))
        links = chunks.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("block", link.alias("link")))).alias("links"))
        heads = links.filter(F.size("links") > 1).mapInArrow(_heads, "conv bigint, block int, head binary").filter("block > 0")
        chunks = chunks.join(heads, ["conv", "block"], "left")
    else:
        chunks = chunks.withColumn("head", F.lit(None).cast("binary"))
    named = chunks.withColumn("head", F.coalesce("head", F.lit(b"")))
    made = named.mapInArrow(_names, "conv bigint, block int, head binary, ended boolean, keys array<binary>, sizes array<bigint>")
    return materialise(made).df


def _endings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Conversations that end at one node, from a stream sorted by name and conversation: the least, how many, and their digest."""
    schema = pa.schema([("key", pa.binary()), ("block", pa.int32()), ("conv", pa.int64()), ("n", pa.int64()), ("ends", pa.string())])

    def rows():
        for batch in batches:
            yield from zip(*(batch[c].to_pylist() for c in ("key", "block", "conv")))

    held = []
    for (key, block), members in groupby(rows(), lambda r: (r[0], r[1])):
        digest, first, n = hashlib.sha256(), None, 0
        for _, _, conv in members:
            digest.update(f",{conv}".encode() if n else str(conv).encode())
            first = conv if first is None else first
            n += 1
        held.append({"key": key, "block": block, "conv": first, "n": n, "ends": digest.hexdigest()})
        if len(held) == 1000:
            yield pa.RecordBatch.from_pylist(held, schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def _peel_in_task(low: int):
    schema = _schema(_NODE)

    def peel(table: pa.Table) -> pa.Table:
        head = table["head"][0].as_py()
        keys, sizes = table["keys"].to_pylist(), table["sizes"].to_pylist()
        sums = list(zip(*(table[c].to_pylist() for c in ("conv", "n", "kids", "leaves", "saved", "ends"))))
        ended = {}
        for i, path in enumerate(keys):
            ended.setdefault(len(path), []).append(i)
        made = {c: [] for c in schema.names}
        below = []  # nodes of the level below: (any item through it, place among the nodes made, conv, n, leaves, saved)
        for depth in range(max(ended), 0, -1):
            nodes = {}
            stripped = ((i, (conv, n, 1, leaves, saved, None), at) for i, at, conv, n, leaves, saved in below)
            own = ((i, sums[i], None) for i in ended.get(depth, ()))
            for group in (stripped, own):
                for i, (conv, n, kids, leaves, saved, ends), child in group:
                    node = nodes.setdefault(keys[i][depth - 1], [i, conv, 0, 0, 0, 0, None, []])
                    node[1] = min(node[1], conv)
                    node[2] += n
                    node[3] += kids
                    node[4] += leaves
                    node[5] += saved
                    node[6] = ends or node[6]
                    if child is not None:
                        node[7].append(child)
            below = []
            for key, (i, conv, n, kids, leaves, saved, ends, children) in nodes.items():
                leaves = leaves if kids else 1
                saved += (n - 1) * sizes[i][depth - 1]
                at = len(made["depth"])
                parent = keys[i][depth - 2] if depth > 1 else head
                for name, value in zip(schema.names, (low + depth, key, parent, None, conv, n, kids, leaves, saved, ends)):
                    made[name].append(value)
                for child in children:
                    made["parent_conv"][child] = conv
                below.append((i, at, conv, n, leaves, saved))
        return pa.Table.from_pydict(made, schema)

    return peel


def _summed(items: DataFrame, by: list[Column], size: Column, more: list[Column]) -> DataFrame:
    """Items of equal sequence as one node."""
    groups = items.groupBy(*by).agg(
        *more, F.min("conv").alias("conv"), *[F.sum(c).alias(c) for c in ("n", "kids", "leaves")],
        (F.sum("saved") + (F.sum("n") - 1) * F.coalesce(F.any_value(size), F.lit(0))).alias("saved"), F.max("ends").alias("ends"),
    )
    return groups.withColumn("leaves", F.when(F.col("kids") == 0, 1).otherwise(F.col("leaves")).cast("bigint"))


def _stripped(nodes: DataFrame, *path: Column) -> DataFrame:
    return nodes.select(*path, "conv", "n", F.lit(1).cast("bigint").alias("kids"), "leaves", "saved", F.lit(None).cast("string").alias("ends"))


def _peel_levels(items: DataFrame, low: int, width: int) -> list[DataFrame]:
    """Nodes of the levels of a block, one table a level, deepest first: each is a regrouping of the one below and the items that end there."""
    survivors, made = None, []
    for depth in range(width, 0, -1):
        here = items.filter(F.size("keys") == depth)
        here = here if survivors is None else here.unionByName(survivors)
        key = F.element_at("keys", F.lit(depth)).alias("key")
        nodes = _summed(here, [key], F.element_at("sizes", F.lit(depth)), [F.any_value(c).alias(c) for c in ("head", "keys", "sizes")])
        nodes = materialise(nodes).df
        parent = F.element_at("keys", F.lit(depth - 1)) if depth > 1 else F.col("head")
        unknown = F.lit(None).cast("bigint").alias("parent_conv")
        made.append(nodes.select(F.lit(low + depth).cast("bigint").alias("depth"), "key", parent.alias("parent"), unknown, *[c.split()[0] for c in _SUMS.split(", ")]))
        survivors = _stripped(nodes, F.col("head"), F.slice("keys", 1, depth - 1).alias("keys"), F.slice("sizes", 1, depth - 1).alias("sizes"))
    return made


def prefix_trie(turns: DataFrame, turnless: DataFrame, top: int = TOP, wide: int = WIDE, peel_turns: int = PEEL_TURNS) -> DataFrame:
    """One row for each node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``turns`` has conv, length (of its conversation), depth (from 1 to length, none missing), turn_key (16 bytes) and size;
    ``turnless`` the conv of conversations of length 0. A node's conv_id is its least member, and the root has no
    parent. Without conversations there are no nodes, the root included. Runs jobs when called.
    """
    deepest = turns.agg(F.max(block_of(F.col("length"), top, wide))).first()[0]
    last_block = -1 if deepest is None else deepest
    paths = _paths(turns, last_block, top, wide)
    final = paths.filter("ended").select(F.element_at("keys", -1).alias("key"), "block", "conv")
    rootless = turnless.select(F.lit(b"").alias("key"), F.lit(-1).alias("block"), F.col("conv").cast("bigint").alias("conv"))
    sorted_ends = final.unionByName(rootless).repartition("key").sortWithinPartitions("key", "block", "conv")
    ends = materialise(sorted_ends.mapInArrow(_endings, "key binary, block int, conv bigint, n bigint, ends string")).df
    zero = F.lit(0).cast("bigint")
    own = ends.join(paths, ["conv", "block"]).select("block", "head", "keys", "sizes", "conv", "n", zero.alias("kids"), zero.alias("leaves"), zero.alias("saved"), "ends")
    own = materialise(own).df

    made, upper = [], None  # upper: the survivors of the block below, at the depth where this block ends
    for block in range(last_block, -1, -1):
        low, high = block_bounds(block, top, wide)
        items = own.filter(F.col("block") == block).drop("block")
        if upper is not None:
            through = paths.filter(F.col("block") == block).select("conv", "head", "keys", "sizes")
            items = items.unionByName(upper.join(through, "conv").select(*items.columns))
        if block == 0:
            levels = _peel_levels(items, low, high - low)
            made, nodes = made + levels, levels[-1]
        else:
            items = materialise(items).df
            big = items.groupBy("head").agg(F.sum(F.size("keys")).alias("turns"), F.count(F.lit(1)).alias("n")).filter((F.col("turns") > peel_turns) & (F.col("n") > 1))
            big = materialise(big.select("head", F.lit(True).alias("__big")))
            levels = []
            if big.rows:
                marked = join_table(items, big, ["head"], "left")
                levels = _peel_levels(marked.filter("__big").drop("__big"), low, high - low)
                items = marked.filter("__big IS NULL").drop("__big")
            in_task = materialise(items.groupBy("head").applyInArrow(_peel_in_task(low), _NODE)).df
            made += [in_task, *levels]
            nodes = reduce(DataFrame.unionByName, levels[-1:], in_task.filter(F.col("depth") == low + 1))
        lifted = _stripped(nodes, F.col("parent").alias("head"))
        upper = materialise(lifted.groupBy("head").agg(
            F.min("conv").alias("conv"), *[F.sum(c).alias(c) for c in ("n", "kids", "leaves", "saved")], F.max("ends").alias("ends")
        ).drop("head")).df
    sums = ["conv", "n", "kids", "leaves", "saved", "ends"]
    at_root = ends.filter("block = -1").select("conv", "n", zero.alias("kids"), zero.alias("leaves"), zero.alias("saved"), "ends")
    at_root = at_root if upper is None else at_root.unionByName(upper.select(*sums))
    root = _summed(at_root, [F.lit(b"").alias("key")], zero, [])
    nothing = F.lit(None)
    root = root.select(zero.alias("depth"), "key", nothing.cast("binary").alias("parent"), nothing.cast("bigint").alias("parent_conv"), *sums)
    nodes = reduce(DataFrame.unionByName, made, root)

    # parents that lie in another block, or in another level that Spark has peeled
    open_ones = nodes.filter("parent_conv IS NULL AND parent IS NOT NULL")
    parents = materialise(nodes.select(F.col("key").alias("parent"), F.col("conv").alias("__parent")).join(open_ones.select("parent").distinct(), "parent", "left_semi"))
    known = nodes.filter("parent_conv IS NOT NULL OR parent IS NULL")
    found = join_table(open_ones, parents, ["parent"]).withColumn("parent_conv", F.col("__parent")).select(*nodes.columns)
    return known.unionByName(found).select(
        F.col("conv").alias("conv_id"), "depth", F.col("parent_conv").alias("parent_conv_id"), F.col("n").alias("n_convs"), F.col("kids").alias("n_children"),
        F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("ends", F.lit(NO_ENDS)).alias("ends_sha256"),
    )


def spliced(own: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations rebuilt from the first turns of the conversation their group of five begins with; turns and turnless ones."""
    heads = F.crc32(F.col("conv").cast("string").cast("binary")) % 9
    convs = own.groupBy("conv").agg(F.count(F.lit(1)).alias("n")).select("conv", "n", heads.alias("h"), (F.col("conv") - F.col("conv") % 5).alias("base"))
    convs = materialise(convs)
    lengths = convs.df.select(F.col("conv").alias("base"), F.col("n").alias("n_base"))
    taken = F.least("h", F.coalesce("n_base", F.lit(0)))
    shape = convs.df.join(lengths, "base", "left").select(
        "conv", "base", "h", taken.alias("taken"), (taken + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length")
    )
    shape = materialise(shape)
    first = own.filter("idx <= 8").select(F.col("conv").alias("base"), F.col("idx").alias("depth"), "turn_key", "size")
    first = first.join(shape.df, "base").filter("depth <= h")
    plan = Table(shape.df.select("conv", "h", "taken", "length"), shape.rows, shape.bytes)
    rest = join_table(own, plan, ["conv"]).filter("idx > h").withColumn("depth", F.col("taken") + F.col("idx") - F.col("h"))
    columns = ["conv", "length", "depth", "turn_key", "size"]
    return materialise(first.select(*columns).unionByName(rest.select(*columns))).df, shape.df.filter("length = 0").select("conv")


def op11_prefix_trie(spark, folder: str) -> DataFrame:
    return prefix_trie(*spliced(numbered_turns(spark.read.parquet(f"{folder}/conversations.parquet"))))
