"""Conversation structure repair by a square-root checkpointed dynamic program.

A conversation is well formed when the initials of its roles read ``(s?(ua)+)?``. Four states say
what has been given so far: nothing, a system turn, a user turn, an assistant turn. Keep costs 0,
Rerole (to user or assistant) 2, Delete 3, Insert (of an empty user or assistant turn, anywhere)
2; a truncated row that is not deleted adds 1; blank and duplicate rows must be deleted. In a
state only one role can be inserted or given, so the letters of the edits name them fully.

The cost vector before a row holds, for each state, what the rest of the conversation costs. The
backward pass stores vectors at every sqrt(n)-th row only; the forward walk recomputes the vectors
of one block at a time and takes, of the edits whose cost is tight, the one with the least letter.

Conversations are dealt out by id, sorted (which spills) and streamed: one is held at a time. One
with more than ``LONG_ROWS`` rows or ``LONG_BYTES`` bytes is cut into ranges of its rows instead,
which are checkpoints of the same program one level up: a range gives a min-plus matrix over the
four states, the matrices of a conversation are chained backwards to the vector at the end of each
range, each range is walked from all four states in its own task, and chaining the four exits
forwards picks the walk that was taken. Only the digest of such a conversation is made in one task,
as SHA-256 is sequential; it streams the rows and holds one of them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import isqrt

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetwatch.operators.skew import HotGroups, split_hot
from fleetwatch.session import Table, materialise

LONG_ROWS = 50_000
LONG_BYTES = 64 * 1024 * 1024
RANGE_ROWS = 20_000
RANGE_BYTES = 32 * 1024 * 1024

WHITE = " \t\n\x0b\x0c\r"
LEGAL = ("su", "ua", "au")

INSERT, REROLE, DELETE, TRUNCATED = 2, 2, 3, 1
START, SYSTEM, USER, ASSISTANT = range(4)
_NEXT = (USER, USER, ASSISTANT, USER)  # the one role that can be inserted or given
_NAME = {USER: "user", ASSISTANT: "assistant"}
_KEEP = {"s": (SYSTEM, None, None, None), "u": (USER, USER, None, USER), "a": (None, None, ASSISTANT, None)}
_NO_KEEP = (None,) * 4
END = (0, 4, 2, 0)  # what is still to be inserted after the last row
_FAR = 1 << 40

# A row as the program sees it: None if it must go, else (state after keeping it, by state before; cost of not deleting it).
_MUST_GO = "-"
_KINDS = {_MUST_GO: None} | {
    code: (_KEEP.get(initial, _NO_KEEP), extra)
    for initial, codes in {"s": "sS", "u": "uU", "a": "aA", "": "xX"}.items()
    for code, extra in zip(codes, (0, TRUNCATED))
}


def _kind(initial: str, truncated: bool) -> str:
    code = initial if initial in _KEEP else "x"
    return code.upper() if truncated else code


def _before(kind: str, after) -> tuple[int, int, int, int]:
    """The cost vector before a row of this kind."""
    row = _KINDS[kind]
    if row is None:
        n, s, u, a = (c + DELETE for c in after)
    else:
        keep, extra = row
        best = []
        for state in range(4):
            cost = min(after[state] + DELETE, after[_NEXT[state]] + REROLE + extra)
            to = keep[state]
            best.append(cost if to is None else min(cost, after[to] + extra))
        n, s, u, a = best
    u, a = min(u, a + INSERT), min(a, u + INSERT)
    return min(n, u + INSERT), min(s, u + INSERT), u, a


def walk(kinds: str, state: int, end, last: bool = True) -> tuple[str, int]:
    """The ASCII-least of the cheapest edits of these rows from ``state``, and the state after them.

    ``end`` is the cost vector after the rows; with ``last`` they end the conversation, and what is still missing is inserted.
    """
    n = len(kinds)
    step = max(1, isqrt(n))
    marks, vector = [end], end
    for i in range(n - 1, -1, -1):
        vector = _before(kinds[i], vector)
        if i % step == 0:
            marks.append(vector)
    marks.reverse()
    audit = []
    for block, start in enumerate(range(0, n, step)):
        stop = min(n, start + step)
        vectors = [marks[block + 1]]
        for i in range(stop - 1, start - 1, -1):
            vectors.append(_before(kinds[i], vectors[-1]))
        for i in range(start, stop):
            here, after = vectors.pop(), vectors[-1]
            row = _KINDS[kinds[i]]
            while True:
                cost = here[state]
                if cost == after[state] + DELETE:
                    audit.append("D")
                elif cost == here[_NEXT[state]] + INSERT:
                    audit.append("I")
                    state = _NEXT[state]
                    continue
                elif row[0][state] is not None and cost == after[row[0][state]] + row[1]:
                    audit.append("K")
                    state = row[0][state]
                else:
                    audit.append("R")
                    state = _NEXT[state]
                break
    while last and END[state]:
        audit.append("I")
        state = _NEXT[state]
    return "".join(audit), state


def _matrix(kinds: str) -> list[int]:
    """Least costs from each state before the rows (fast) to each state after them (slow)."""
    costs = []
    for to in range(4):
        vector = tuple(0 if state == to else _FAR for state in range(4))
        for kind in reversed(kinds):
            vector = _before(kind, vector)
        costs.extend(vector)
    return costs


class _Edits:
    """Follows an audit over the rows it was made for and gives the repaired turns as (edit, role, text)."""

    def __init__(self, audit: str, state: int = START):
        self.audit, self.at, self.state = audit, 0, state

    def inserted(self) -> Iterator[tuple[str, str, str]]:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.at += 1
            self.state = _NEXT[self.state]
            yield "I", _NAME[self.state], ""

    def row(self, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        yield from self.inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K":
            self.state = _KEEP[role[:1]][self.state]
            yield edit, role, text
        elif edit == "R":
            self.state = _NEXT[self.state]
            yield edit, _NAME[self.state], text


class _Digest:
    """SHA-256 of ``role:text`` lines, fed line by line."""

    def __init__(self):
        self.made, self.first = hashlib.sha256(), True

    def add(self, turns) -> None:
        for _, role, text in turns:
            self.made.update(f"{'' if self.first else chr(10)}{role}:{text}".encode())
            self.first = False


def _marked(rows: DataFrame) -> DataFrame:
    """conv (text, empty where the id is null), turn, role, text, and what the text says: blank, truncated or neither."""
    text = F.coalesce("text", F.lit(""))
    body = F.rtrim(text, F.lit(WHITE))
    fault = F.when(body == "", "blank").when(F.substring(body, -1, 1).isin(".", "!", "?"), "").otherwise("truncated")
    return rows.select(
        F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("conv"), F.col("turn").cast("bigint").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"), text.alias("text"), fault.alias("fault"),
    )


def _sorted(*more):
    return [*(F.col(c).asc_nulls_first() for c in ("conv", "turn", "role", "text")), *more]


SUMMARY = "conv string, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"
TURNS = "conv string, part bigint, pos bigint, edit string, role string, text string"


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list]]:
    """Rows of one conversation after the other, out of sorted batches."""
    conv, rows = None, []
    for batch in batches:
        for row in zip(*(batch[c].to_pylist() for c in ("conv", "turn", "role", "text", "fault"))):
            if row[0] != conv:
                if rows:
                    yield conv, rows
                conv, rows = row[0], []
            rows.append(row)
    if rows:
        yield conv, rows


def _judged(rows: list) -> tuple[str, dict[str, int]]:
    """Kinds of the rows of a conversation, and its counts."""
    seen, kinds, counts = set(), [], dict.fromkeys(("blank", "duplicate", "truncated"), 0)
    for _, _, role, text, fault in rows:
        if fault != "blank" and (role, text) in seen:
            fault = "duplicate"
        seen.add((role, text))
        if fault:
            counts[fault] += 1
        kinds.append(_MUST_GO if fault in ("blank", "duplicate") else _kind(role[:1], fault == "truncated"))
    turns = [r[1] for r in rows if r[1] is not None]
    counts["gaps"] = turns[-1] - turns[0] + 1 - len(set(turns)) if turns else 0
    counts["illegal"] = sum(a[2][:1] + b[2][:1] not in LEGAL for a, b in zip(rows, rows[1:]))
    return "".join(kinds), counts


def _cost(kinds: str) -> int:
    vector = END
    for kind in reversed(kinds):
        vector = _before(kind, vector)
    return vector[START]


def _in_batches(made: Iterator[dict], schema: pa.Schema, rows: int = 1000) -> Iterator[pa.RecordBatch]:
    held = []
    for row in made:
        held.append(row)
        if len(held) == rows:
            yield pa.RecordBatch.from_pylist(held, schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


_SUMMARY = pa.schema([(c.split()[0], pa.string() if c.endswith("string") else pa.int64()) for c in SUMMARY.split(", ")])
_TURNS = pa.schema([(c.split()[0], pa.string() if c.endswith("string") else pa.int64()) for c in TURNS.split(", ")])


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def made():
        for conv, rows in _conversations(batches):
            kinds, counts = _judged(rows)
            audit, _ = walk(kinds, START, END)
            edits, digest = _Edits(audit), _Digest()
            for row in rows:
                digest.add(edits.row(row[2], row[3]))
            digest.add(edits.inserted())
            yield counts | {"conv": conv, "cost": _cost(kinds), "audit": audit, "repaired_sha256": digest.made.hexdigest()}

    return _in_batches(made(), _SUMMARY)


def _turns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def made():
        for conv, rows in _conversations(batches):
            edits = _Edits(walk(_judged(rows)[0], START, END)[0])
            place = 0
            for given in (*(edits.row(r[2], r[3]) for r in rows), edits.inserted()):
                for edit, role, text in given:
                    yield {"conv": conv, "part": 0, "pos": place, "edit": edit, "role": role, "text": text}
                    place += 1

    return _in_batches(made(), _TURNS)


# ---- conversations too long for one task

_RANGES = ("conv string, part bigint, first bigint, kinds string, matrix array<bigint>, blank bigint, duplicate bigint, truncated bigint, illegal bigint, "
           "initial string, final string, low bigint, high bigint, turns bigint")
_RANGE = pa.schema([
    (c.split()[0], pa.list_(pa.int64()) if c.endswith(">") else pa.string() if c.endswith("string") else pa.int64()) for c in _RANGES.split(", ")
])


def _range_of(table: pa.Table) -> pa.Table:
    """One range of a conversation (a bounded number of rows, without texts) as one row."""
    rows = table.sort_by("pos").to_pylist()
    kinds, counts = [], dict.fromkeys(("blank", "duplicate", "truncated"), 0)
    for row in rows:
        fault = row["fault"] if row["fault"] == "blank" or row["fresh"] else "duplicate"
        if fault:
            counts[fault] += 1
        kinds.append(_MUST_GO if fault in ("blank", "duplicate") else _kind(row["initial"], fault == "truncated"))
    kinds = "".join(kinds)
    turns = [r["turn"] for r in rows if r["turn"] is not None]
    return pa.Table.from_pylist([counts | {
        "conv": rows[0]["conv"], "part": rows[0]["part"], "first": rows[0]["pos"], "kinds": kinds, "matrix": _matrix(kinds),
        "illegal": sum(a["initial"] + b["initial"] not in LEGAL for a, b in zip(rows, rows[1:])),
        "initial": rows[0]["initial"], "final": rows[-1]["initial"],
        "low": turns[0] if turns else None, "high": turns[-1] if turns else None, "turns": len(set(turns)),
    }], _RANGE)


def _ends(table: pa.Table) -> pa.Table:
    """Cost vector at the end of each range of a conversation, and what the conversation costs: 16 numbers a range."""
    rows = table.sort_by("part").to_pylist()
    vector, made = list(END), []
    for at in range(len(rows) - 1, -1, -1):
        end, matrix = vector, rows[at]["matrix"]
        vector = [min(matrix[4 * to + state] + end[to] for to in range(4)) for state in range(4)]
        made.append({"conv": rows[at]["conv"], "part": rows[at]["part"], "end": end, "last": at == len(rows) - 1, "cost": vector[START]})
    return pa.Table.from_pylist(made, pa.schema([("conv", pa.string()), ("part", pa.int64()), ("end", pa.list_(pa.int64())), ("last", pa.bool_()), ("cost", pa.int64())]))


def _walks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("conv", pa.string()), ("part", pa.int64()), ("audits", pa.list_(pa.string())), ("exits", pa.list_(pa.int64()))])

    def made():
        for batch in batches:
            for row in batch.to_pylist():
                walks = [walk(row["kinds"], state, row["end"], row["last"]) for state in range(4)]
                yield {"conv": row["conv"], "part": row["part"], "audits": [w[0] for w in walks], "exits": [w[1] for w in walks]}

    return _in_batches(made(), schema, 1)


def _entries(table: pa.Table) -> pa.Table:
    """The state in which each range is entered: four exits a range."""
    made, state = [], START
    for row in table.sort_by("part").to_pylist():
        made.append({"conv": row["conv"], "part": row["part"], "entry": state})
        state = row["exits"][state]
    return pa.Table.from_pylist(made, pa.schema([("conv", pa.string()), ("part", pa.int64()), ("entry", pa.int64())]))


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, Iterator]]:
    """(conversation, range, repaired turns) of rows in order; the first row of a range brings its audit."""
    edits, conv, part = None, None, None
    for batch in batches:
        for row in batch.to_pylist():
            if row["audit"] is not None:
                if edits:
                    yield conv, part, edits.inserted()
                edits, conv, part = _Edits(row["audit"], row["entry"]), row["conv"], row["part"]
            yield conv, part, edits.row(row["role"], row["text"])
    if edits:
        yield conv, part, edits.inserted()


def _long_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def made():
        conv, digest = None, None
        for name, _, turns in _edited(batches):
            if name != conv:
                if digest:
                    yield {"conv": conv, "repaired_sha256": digest.made.hexdigest()}
                conv, digest = name, _Digest()
            digest.add(turns)
        if digest:
            yield {"conv": conv, "repaired_sha256": digest.made.hexdigest()}

    return _in_batches(made(), pa.schema([("conv", pa.string()), ("repaired_sha256", pa.string())]))


def _long_turns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def made():
        at, place = None, 0
        for conv, part, turns in _edited(batches):
            place = place if at == (conv, part) else 0
            at = conv, part
            for edit, role, text in turns:
                yield {"conv": conv, "part": part, "pos": place, "edit": edit, "role": role, "text": text}
                place += 1

    return _in_batches(made(), _TURNS)


class _Long:
    """Rows of the long conversations in ranges, with the edits of each range."""

    def __init__(self, rows: DataFrame, n_ranges: int):
        # equal rows of one turn can be many: their place in the written table parts them
        tie = F.monotonically_increasing_id()
        placed = rows.withColumn("__tie", tie)
        placed = placed.repartitionByRange(max(2, n_ranges), *_sorted(F.col("__tie"))).sortWithinPartitions(*_sorted(F.col("__tie")))
        self.rows = materialise(placed.drop("__tie").withColumn("pos", F.monotonically_increasing_id())).df.withColumn("part", F.shiftright("pos", 33))
        same = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)
        light = self.rows.select("conv", "part", "pos", "turn", F.substring("role", 1, 1).alias("initial"), "fault", same.alias("same"))
        fresh = light.groupBy("conv", "same").agg(F.min("pos").alias("pos")).select("pos", F.lit(True).alias("fresh"))
        known = light.drop("same").join(fresh, "pos", "left").withColumn("fresh", F.coalesce("fresh", F.lit(False)))
        self.ranges = materialise(known.groupBy("conv", "part").applyInArrow(_range_of, _RANGES)).df
        ends = self.ranges.select("conv", "part", "matrix").groupBy("conv").applyInArrow(_ends, "conv string, part bigint, end array<bigint>, last boolean, cost bigint")
        self.ends = materialise(ends).df
        walks = self.ranges.select("conv", "part", "kinds").join(self.ends, ["conv", "part"]).select("conv", "part", "kinds", "end", "last")
        walks = materialise(walks.mapInArrow(_walks, "conv string, part bigint, audits array<string>, exits array<bigint>")).df
        entries = walks.select("conv", "part", "exits").groupBy("conv").applyInArrow(_entries, "conv string, part bigint, entry bigint")
        taken = walks.join(entries, ["conv", "part"]).select("conv", "part", "entry", F.element_at("audits", (F.col("entry") + 1).cast("int")).alias("audit"))
        self.taken = materialise(taken).df

    def _with_audits(self) -> DataFrame:
        heads = self.taken.join(self.ranges.select("conv", "part", "first"), ["conv", "part"])
        return self.rows.select("conv", "part", "pos", "role", "text").join(heads.select(F.col("first").alias("pos"), "entry", "audit"), "pos", "left")

    def summaries(self) -> DataFrame:
        one_after_other = Window.partitionBy("conv").orderBy("part")
        joint = F.concat(F.lag("final").over(one_after_other), "initial")
        ranges = self.ranges.select(
            "*", F.when(joint.isNotNull() & ~joint.isin(*LEGAL), 1).otherwise(0).alias("__joint"),
            F.when(F.lag("high").over(one_after_other) == F.col("low"), 1).otherwise(0).alias("__shared"),
        )
        gaps = F.coalesce(F.max("high") - F.min("low") + 1 - F.sum(F.col("turns") - F.col("__shared")), F.lit(0))
        counts = ranges.groupBy("conv").agg(
            gaps.alias("gaps"), *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")], F.sum(F.col("illegal") + F.col("__joint")).alias("illegal"),
        )
        costs = self.ends.groupBy("conv").agg(F.min_by("cost", "part").alias("cost"))
        audits = self.taken.groupBy("conv").agg(F.expr("listagg(audit, '') WITHIN GROUP (ORDER BY part)").alias("audit"))
        streams = self._with_audits().repartition("conv").sortWithinPartitions("conv", "pos")
        digests = streams.mapInArrow(_long_digests, "conv string, repaired_sha256 string")
        return counts.join(costs, "conv").join(audits, "conv").join(digests, "conv").select(*_SUMMARY.names)

    def turns(self) -> DataFrame:
        streams = self._with_audits().repartition("conv", "part").sortWithinPartitions("conv", "part", "pos")
        return streams.mapInArrow(_long_turns, TURNS)


def _parted(rows: DataFrame, long_rows: int, long_bytes: int) -> tuple[DataFrame, _Long | None]:
    """Rows of ordinary conversations, each whole in one partition and in order; and the long ones."""
    marked = _marked(rows)
    size = F.octet_length("role") + F.octet_length("text")
    sizes = marked.groupBy("conv").agg(F.count(F.lit(1)).alias("n"), F.sum(size.cast("bigint")).alias("bytes"))
    long = materialise(sizes.filter((F.col("n") > long_rows) | (F.col("bytes") > long_bytes)), largest="n")
    regular, found = marked, None
    if long.rows:
        n, total = long.df.agg(F.sum("n"), F.sum("bytes")).first()
        keys = Table(long.df.select("conv"), long.rows, long.bytes)
        regular, heavy = split_hot(marked, HotGroups(("conv",), long_rows, keys))
        found = _Long(heavy, max(n // min(long_rows, RANGE_ROWS), total // min(long_bytes, RANGE_BYTES)) + 1)
    return regular.repartition("conv").sortWithinPartitions(*_sorted()), found


def _with_ids(made: DataFrame, rows: DataFrame) -> DataFrame:
    conv_id = F.when(F.col("conv") != "", F.col("conv")).cast(rows.schema["conv_id"].dataType)
    return made.select(conv_id.alias("conv_id"), *[c for c in made.columns if c != "conv"])


def repair_audits(rows: DataFrame, long_rows: int = LONG_ROWS, long_bytes: int = LONG_BYTES) -> DataFrame:
    """One row for each conversation of ``rows`` (conv_id, turn, role, text): counts of faults, cost, audit and digest of the repaired turns.

    Rows are taken by turn, nulls first, then role, then text. A null role or text is an empty one, a row
    with an empty text is blank, an empty role fits nowhere as it stands. A null conv_id is a conversation like any
    other. Repeated rows are duplicates. Other columns are ignored; no rows give no rows. Counts what
    each conversation holds when called (one scan), and cuts long ones then.
    """
    regular, long = _parted(rows, long_rows, long_bytes)
    made = regular.mapInArrow(_summaries, SUMMARY)
    return _with_ids(made if long is None else made.unionByName(long.summaries()), rows)


def repaired_turns(rows: DataFrame, long_rows: int = LONG_ROWS, long_bytes: int = LONG_BYTES) -> DataFrame:
    """The repaired conversations: conv_id, part, pos, edit (K, R or I), role, text; part and pos give the order in a conversation."""
    regular, long = _parted(rows, long_rows, long_bytes)
    made = regular.mapInArrow(_turns, TURNS)
    return _with_ids(made if long is None else made.unionByName(long.turns()), rows)


def _damage_code():
    name = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    return F.crc32(name.cast("binary")) % 20


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text after planned damage: rows dropped, emptied, without end marks, repeated, or of role user."""
    code, role, text = F.col("__code"), F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    rows = conversations.select("conv_id", "turn", "role", "text", _damage_code().alias("__code")).filter(code != 0)
    return rows.select(
        "conv_id", "turn", F.when(code == 4, "user").otherwise(role).alias("role"),
        F.when(code == 1, "").when(code == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.explode(F.when(code == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("__copy"),
    ).drop("__copy")


def op13_conversation_repair(spark, folder: str) -> DataFrame:
    conversations = spark.read.parquet(f"{folder}/conversations.parquet")
    repaired = repair_audits(damaged(conversations))
    left = conversations.groupBy("conv_id").agg(F.min((_damage_code() == 0)).alias("none_left")).filter("none_left")
    zero = F.lit(0).cast("bigint")
    nothing = {"audit": F.lit(""), "repaired_sha256": F.lit(hashlib.sha256().hexdigest())}
    return repaired.unionByName(left.select("conv_id", *[nothing.get(c, zero).alias(c) for c in repaired.columns if c != "conv_id"]))
