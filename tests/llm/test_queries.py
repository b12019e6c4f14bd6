"""The registered queries against their contracts, by brute force on small tables."""

import hashlib
import random
import re
import zlib

import pytest

from fleetwatch.llm import id_files
from fleetwatch.llm.queries import QUERIES

WORDS = [a + b for a in "ba ce di fo gu".split() for b in "lan mer nis top ruk é".split()]


def prose(seed: int, n: int) -> str:
    draw = random.Random(seed)
    return " ".join(draw.choice(WORDS) + ("." if draw.random() < 0.1 else "") for _ in range(n))


BASE = prose(1, 200)
TEXTS = [
    BASE, BASE, " ".join("xx" if i == 90 else w for i, w in enumerate(BASE.split())), None, "", " \n", "One two", "one  TWO",
    f"Password: hunter22 and AKIA{'B3' * 10} then", f"é api_key='{'q' * 8}' {'0a' * 14}", "token=abc secret = x-y_z.1", prose(2, 5000),
    *[prose(100 + k, 50) + (" awful rotten" if k % 3 == 0 else "") for k in range(60)],
]
IDS = [3 * i + 1 for i in range(len(TEXTS))]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    rows = [(d, t, "en", "s", len(t or "")) for d, t in zip(IDS, TEXTS)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{path}/documents.parquet")
    labels = [(d, int("awful" in (t or "")), int("awful" not in (t or ""))) for d, t in zip(IDS, TEXTS)]
    spark.createDataFrame(labels, "doc_id bigint, toxic int, quality int").write.parquet(f"{path}/labels.parquet")
    return path


def result(spark, folder, name):
    rows = QUERIES[name](spark, folder).collect()
    assert sorted(r["doc_id"] for r in rows) == IDS
    return {r["doc_id"]: r.asDict() for r in rows}


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("name, parts, rest, least", [("op1_toxicity", 4, 2, 0.3), ("op7_quality", 3, 1, 0.5)])
def test_scores(spark, folder, name, parts, rest, least):
    found = result(spark, folder, name)
    for d, row in found.items():
        assert row["held_out"] == (zlib.crc32(str(d).encode()) % parts == rest)
        assert 0 <= row["score"] <= 1 and row["predicted"] == int(row["score"] >= least)
    assert found[IDS[0]]["score"] == found[IDS[1]]["score"]  # equal texts


def test_near_duplicates(spark, folder):
    sets = {}
    for d, t in zip(IDS, TEXTS):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[d] = {tuple(w[i:i + 3]) for i in range(max(1, len(w) - 2))} if w else set()
    group = {d: d for d in IDS}
    for _ in IDS:
        for a in IDS:
            for b in IDS:
                if sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                    group[a] = min(group[a], group[b])
        if all(group[group[d]] == group[d] for d in IDS):
            break
    found = result(spark, folder, "op2_minhash_dedup")
    assert {d: (r["n_shingles"], r["component_id"], r["kept"]) for d, r in found.items()} == {
        d: (len(sets[d]), group[d], group[d] == d) for d in IDS}


def test_fingerprints(spark, folder):
    found = result(spark, folder, "op5_spot_signatures")
    texts = [t or "" for t in TEXTS]
    for k, (d, text) in enumerate(zip(IDS, texts)):
        after, row = texts[(k + 1) % len(texts)], found[d]
        n = len(text) // 4
        edited = text[:len(text) - n] + after[:n]
        assert (row["n_chars"], row["edited_sha256"]) == (len(text), sha(edited))
        assert 0 <= row["near_edited"] <= 1 and 0 <= row["near_next"] <= 1
        if text == edited:
            assert row["fingerprint"] == row["edited_fingerprint"] and row["near_edited"] == 1
    assert found[IDS[0]]["fingerprint"] == found[IDS[1]]["fingerprint"] and found[IDS[0]]["near_next"] == 1


def test_token_files(spark, folder):
    from tokenizers import Tokenizer

    tokenizer, start, expected = Tokenizer.from_file(id_files.default_tokenizer()), 0, {}
    for d, text in zip(IDS, TEXTS):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        expected[d] = (start, len(ids), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids)))
        start += len(ids)
    found = result(spark, folder, "op6_token_files")
    assert {d: (r["start"], r["n_tokens"], r["ids_crc32"]) for d, r in found.items()} == expected


def test_secrets(spark, folder):
    assign = re.compile(r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    found = result(spark, folder, "op9_secret_scan")
    for d, text in zip(IDS, TEXTS):
        kinds = [
            ("assign", [m.span() for m in assign.finditer(text or "") if len(m[2]) >= 6]),
            ("access", [m.span() for m in re.finditer("AKIA[A-Z0-9]+", text or "") if len(m[0]) >= 20]),
            ("hex", [m.span() for m in re.finditer("[0-9a-f]+", text or "") if len(m[0]) >= 24]),
        ]
        spans = sorted((a, k, b) for k, (_, listed) in enumerate(kinds) for a, b in listed)
        base = ",".join(f"{kinds[k][0]}:{a}:{b}" for a, k, b in spans)
        row = found[d]
        assert [row[f"n_{kind}"] for kind, _ in kinds] == [len(listed) for _, listed in kinds]
        assert row["base_sha256"] == sha(base)
        assert set(filter(None, base.split(","))) <= set(row["spans"].split(","))
    assert sum(r["n_assign"] for r in found.values()) == 3 and sum(r["n_hex"] for r in found.values()) == 1
