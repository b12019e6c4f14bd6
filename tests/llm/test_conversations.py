"""Prefix trie, source mix and conversation repair against brute force, on small tables with nulls, ties, copies and clashing columns."""

import functools
import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetwatch.llm import conversation_repair, prefix_trie, source_mix

SCHEMA = "conv_id bigint, turn bigint, role string, text string, conv string, depth int, key string, part int, pos int"
WHITE = " \t\n\x0b\x0c\r"


def _conversations(seed, n):
    draw = random.Random(seed)
    shared = [("user", f"w{draw.randrange(3)}") for _ in range(60)]
    rows = []
    for c in range(n):
        length = draw.choice([1, 2, 3, 8, 20, 40])
        same = draw.choice([0, 0, length, 10])
        for t in range(length):
            role = draw.choice(["user", "assistant", "system", "user", "assistant", "tool", "", None])
            text = draw.choice(["Hi.", "ok", "What?", " ", "", None, "a b! ", "same.", "é", "x%d." % draw.randrange(5)])
            role, text = shared[t] if t < same else (role, text)
            rows.append((None if c == 7 else c, draw.choice([t, t, t, t + draw.randrange(3), None]), role, text, "c", 1, "k", 2, 3))
    rows += [(1000, 0, "user", "long. " * 50_000, "c", 1, "k", 2, 3), rows[0], rows[0]]
    return rows


ROWS = _conversations(3, 60)


@pytest.fixture(scope="module")
def conversations(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def _trie():
    groups = {}
    for c, t, r, x, *_ in ROWS:
        if c is not None:
            r, x = r or "", x or ""
            groups.setdefault(c, []).append((t is not None, t or 0, r, hashlib.md5(f"{len(r)}:{r}{x}".encode()).hexdigest(), x))
    groups = {c: [(a[2], a[4]) for a in sorted(v)] for c, v in groups.items()}
    heads = {c: zlib.crc32(str(c).encode()) % 9 for c in groups}
    whole = {c: tuple(groups.get(c - c % 5, [])[:heads[c]] + groups[c][heads[c]:]) for c in groups}
    members, kids, leaves, saved = {}, {}, {}, {}
    for c, s in whole.items():
        for d in range(len(s) + 1):
            members.setdefault(s[:d], []).append(c)
    for p in members:
        if p:
            kids.setdefault(p[:-1], []).append(p)
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in kids.get(p, [])) or 1
        saved[p] = sum(saved[k] for k in kids.get(p, [])) + ((len(members[p]) - 1) * len(p[-1][1].encode()) if p else 0)
    return Counter(
        (min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids.get(p, [])), leaves[p], saved[p],
         hashlib.sha256(",".join(map(str, sorted(c for c in m if len(whole[c]) == len(p)))).encode()).hexdigest())
        for p, m in members.items()
    )


@pytest.mark.parametrize("settings", [{}, {"top": 2, "wide": 4, "peel_turns": 60}, {"top": 4, "wide": 8}])
def test_prefix_trie(conversations, settings):
    found = prefix_trie.prefix_trie(*prefix_trie.spliced(prefix_trie.numbered_turns(conversations)), **settings)
    assert Counter(map(tuple, found.collect())) == _trie()


def test_prefix_trie_hot_conversation(conversations, hot_limit, no_broadcast):
    hot_limit(7)
    found = prefix_trie.prefix_trie(*prefix_trie.spliced(prefix_trie.numbered_turns(conversations)), top=4, wide=16)
    assert Counter(map(tuple, found.collect())) == _trie()


def test_prefix_trie_without_turns(spark, empty):
    assert prefix_trie.prefix_trie(*prefix_trie.spliced(prefix_trie.numbered_turns(empty))).count() == 0
    turns = spark.createDataFrame([], "conv bigint, length bigint, depth bigint, turn_key binary, size bigint")
    nodes = prefix_trie.prefix_trie(turns, spark.createDataFrame([(5,), (3,)], "conv bigint")).collect()
    assert [tuple(n) for n in nodes] == [(3, 0, None, 2, 0, 1, 0, hashlib.sha256(b"3,5").hexdigest())]


def test_block_bounds_follow_blocks(spark):
    for top, wide in ((8, 16_384), (2, 4), (4, 16), (8, 8)):
        blocks = spark.range(1, 3000).select("id", prefix_trie.block_of(F.col("id"), top, wide).alias("block")).collect()
        for r in blocks:
            low, high = prefix_trie.block_bounds(r["block"], top, wide)
            assert low < r["id"] <= high


def _repair(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "", r[2] or ""))
    rows = [(t, a or "", b or "") for t, a, b in rows]
    seen, faults = set(), []
    for _, a, b in rows:
        body = b.rstrip(WHITE)
        faults.append("blank" if not body else "duplicate" if (a, b) in seen else "" if body[-1] in ".!?" else "truncated")
        seen.add((a, b))
    after = {0: 2, 1: 2, 2: 3, 3: 2}
    name = {2: "user", 3: "assistant"}
    keep = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}

    @functools.cache
    def best(i, state, inserts):
        ways = [(0, "", ())] if i == len(rows) and state in (0, 3) else []
        if inserts:
            x = best(i, after[state], inserts - 1)
            ways.append((x[0] + 2, "I" + x[1], (name[after[state]] + ":", *x[2])))
        if i < len(rows):
            _, a, b = rows[i]
            x = best(i + 1, state, 3)
            ways.append((x[0] + 3, "D" + x[1], x[2]))
            if faults[i] not in ("blank", "duplicate"):
                more = faults[i] == "truncated"
                if (a[:1], state) in keep:
                    x = best(i + 1, keep[a[:1], state], 3)
                    ways.append((x[0] + more, "K" + x[1], (f"{a}:{b}", *x[2])))
                x = best(i + 1, after[state], 3)
                ways.append((x[0] + 2 + more, "R" + x[1], (f"{name[after[state]]}:{b}", *x[2])))
        return min(ways, default=(10**9, "", ()))

    cost, audit, lines = best(0, 0, 3)
    turns = [r[0] for r in rows if r[0] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(x[1][:1] + y[1][:1] not in ("su", "ua", "au") for x, y in zip(rows, rows[1:]))
    return (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, "\n".join(lines))


def _repaired():
    groups = {}
    for c, *r in ROWS:
        groups.setdefault(c, []).append(tuple(r[:3]))
    return {c: _repair(r) for c, r in groups.items()}


@pytest.mark.parametrize("limits", [{}, {"long_rows": 15}, {"long_bytes": 200}])
def test_repair(conversations, limits):
    expected = _repaired()
    found = conversation_repair.repair_audits(conversations, **limits).collect()
    assert len(found) == len(expected)
    assert {r["conv_id"]: tuple(r)[1:] for r in found} == {c: (*r[:-1], hashlib.sha256(r[-1].encode()).hexdigest()) for c, r in expected.items()}
    turns = sorted(conversation_repair.repaired_turns(conversations, **limits).collect(), key=lambda r: (r["part"], r["pos"]))
    lines = {}
    for r in turns:
        lines.setdefault(r["conv_id"], []).append(f"{r['role']}:{r['text']}")
    assert {c: "\n".join(x) for c, x in lines.items()} == {c: r[-1] for c, r in expected.items() if r[-1]}


def test_repair_of_nothing(empty):
    assert conversation_repair.repair_audits(empty).count() == 0
    assert conversation_repair.repaired_turns(empty).count() == 0


def test_walk_keeps_few_vectors(monkeypatch):
    """The backward pass stores about sqrt(n) vectors, and each row is costed twice at most."""
    n = 10_000
    calls = []
    real = conversation_repair._before
    monkeypatch.setattr(conversation_repair, "_before", lambda kind, after: calls.append(1) or real(kind, after))
    audit, _ = conversation_repair.walk("ua" * (n // 2), conversation_repair.START, conversation_repair.END)
    assert audit == "K" * n and len(calls) == 2 * n


def test_repair_query(spark, tmp_path, conversations):
    conversations.select("conv_id", "turn", "role", "text", "key").write.parquet(f"{tmp_path}/conversations.parquet")
    expected, left = {}, {}
    for c, t, r, x, *_ in ROWS:
        code = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r, x = " " if r is None else r, " " if x is None else x
        rows = left.setdefault(c, [])
        if code:
            x = "" if code == 1 else "".join(ch for ch in x if ch not in ".!?") if code == 2 else x
            rows += [(t, "user" if code == 4 else r, x)] * (2 if code == 3 else 1)
    for c, rows in left.items():
        *most, lines = _repair(rows)
        expected[c] = (*most, hashlib.sha256(lines.encode()).hexdigest())
    found = conversation_repair.op13_conversation_repair(spark, str(tmp_path)).collect()
    assert len(found) == len(expected) and {r["conv_id"]: tuple(r)[1:] for r in found} == expected
    got = prefix_trie.op11_prefix_trie(spark, str(tmp_path)).collect()
    assert Counter(map(tuple, got)) == _trie()


DOCS = "doc_id bigint, source string, text string, row int, number int, target string, size string"


def _documents():
    draw = random.Random(5)
    rows = []
    for i in range(400):
        source = draw.choice(["a"] * 6 + ["b", "c", None, "é", "~"])
        text = draw.choice([" ".join(f"w{i}x{k}" for k in range(draw.randrange(1, 300)))] * 8 + ["", None, " \t\n"])
        rows.append((None if i == 3 else i, source, text, 1, 2, "t", "s"))
    rows += [rows[0], rows[0], (5, "a", "other words here", 1, 2, "t", "s"), (400, "huge", " ".join(f"h{k}" for k in range(20_000)), 1, 2, "t", "s")]
    return rows


def _targets(sizes, weights=(5, 2, 1), share=1.5, most=2):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    target, rest = dict.fromkeys(names, 0.0), share * sum(sizes.values())
    while rest > 1e-6:
        still = [s for s in names if target[s] < most * sizes[s] - 1e-9]
        each = rest / sum(weight[s] for s in still)
        rest = 0.0
        for s in still:
            target[s] += each * weight[s]
            if target[s] > most * sizes[s]:
                rest += target[s] - most * sizes[s]
                target[s] = float(most * sizes[s])
    return target


@pytest.mark.parametrize("hot", [False, True])
def test_mix(spark, hot_limit, hot):
    if hot:
        hot_limit(20)
    rows = _documents()
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    found = source_mix.taken_words(docs, block=16).collect()
    assert Counter((r["doc_id"], r["size"]) for r in found) == Counter((r[0], len((r[2] or "").split())) for r in rows)
    sizes = Counter()
    for r in rows:
        sizes[r[1]] += len((r[2] or "").split())
    target, taken = _targets(sizes), Counter()
    for r in found:
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - target[r["source"]]) < 1e-3
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
    for source, words in taken.items():
        assert abs(words - target[source]) <= max(32, 0.02 * target[source])
    again = source_mix.taken_words(docs.repartition(7), block=16).collect()
    key = lambda r: (r["doc_id"], r["source"], r["size"], r["taken"])
    assert Counter(map(key, found)) == Counter(map(key, again))


def test_mixed_texts(spark):
    rows = [r for r in _documents() if r[0] != 400]
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    mix = source_mix.mixed_texts(docs, block=16).collect()
    words = Counter(w for m in mix for w in m["text"].split())
    seen = Counter(w for r in rows for w in (r[2] or "").split())
    assert words and all(n <= 2 * seen[w] for w, n in words.items())
    assert sum(words.values()) == sum(r["taken"] for r in source_mix.taken_words(docs, block=16).collect())
    assert all(n == 1 for n in Counter((m["number"], m["round"], m["block"]) for m in mix).values())


def test_mix_of_nothing(spark):
    assert source_mix.taken_words(spark.createDataFrame([], DOCS)).count() == 0
    wordless = spark.createDataFrame([(1, None, None, 1, 2, "t", "s"), (2, "a", "  ", 1, 2, "t", "s")], DOCS)
    assert sorted(tuple(r)[1:] for r in source_mix.taken_words(wordless).collect()) == [(1, None, 0, 0, 0.0, 0), (2, "a", 0, 0, 0.0, 0)]


def test_shards_draw_multinomially(spark):
    quota = np.array([6000, 0, 3000, 1000], np.int64)
    import pyarrow as pa

    (counts,) = source_mix._drawn(quota, 100)([pa.RecordBatch.from_pydict({"id": range(100)})])
    by = {}
    for shard, number, n in zip(*(counts[c].to_pylist() for c in ("shard", "number", "n"))):
        by.setdefault(shard, {})[number] = n
    assert all(sum(c.values()) == 100 for c in by.values()) and not any(2 in c for c in by.values())
    first = np.array([c.get(1, 0) for c in by.values()])
    assert abs(first.mean() - 60) < 2 and 3 < first.std() < 7  # sqrt(100 * 0.6 * 0.4) is 4.9


@pytest.mark.parametrize("size", [1, 2, 3, 4, 5, 17, 64, 1000, 4097])
def test_permutations(size):
    index = np.arange(size)
    made = [source_mix.permuted(index, np.full(size, size), np.full(size, key)) for key in range(3)]
    assert all(sorted(m) == list(index) for m in made)
    if size > 60:
        assert not np.array_equal(made[0], made[1])
