"""Dealt operators against brute force, on small tables with nulls, ties, copies, long texts and clashing columns."""

import hashlib
import os
import random
import re
import shutil

import numpy as np
import pytest

from fleetwatch.llm import decontamination, id_files, minhash_dedup, quality, ranking, secret_scan, sentencepiece_codec, spot_signatures, toxicity
from fleetwatch.llm import substring_dedup, suffix_dedup
import corpus_pipeline
from pyspark.sql import functions as F

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, chunk string, key string, node string"
WORDS = [a + b for a in "ba ce di fo gu".split() for b in "lan mer nis top ruk é".split()]


def prose(seed: int, n: int) -> str:
    draw = random.Random(seed)
    return " ".join(draw.choice(WORDS) + ("." if draw.random() < 0.1 else "") for _ in range(n))


BASE = prose(1, 120)
EDITED = " ".join("xx" if i == 60 else w for i, w in enumerate(BASE.split()))
TEXTS = [
    BASE, BASE, EDITED, prose(2, 40) + "\n" + BASE[200:560] + " " + prose(3, 30), None, "", "  \n", "one", "One  two", "one two",
    prose(4, 6000), "a" * 700, "é" * 300, "x" * 150 + BASE[:260], prose(5, 19), prose(6, 20), prose(6, 20),
]
ROWS = [(i, t, "en", "s", None, "c", "k", "n") for i, t in enumerate(TEXTS)] + [(None, BASE, None, None, None, None, None, None), (2, EDITED, "en", "s", None, "c", "k", "n")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def in_order():
    return sorted((r[0], r[1] or "") for r in ROWS if r[0] is not None)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text)


def test_substring_dedup(docs, empty):
    seen, expected = set(), []
    for doc, text in in_order():
        w = words(text)
        gone = set()
        for i in range(len(w) - 19):
            window = tuple(w[i:i + 20])
            if window in seen:
                gone |= set(range(i, i + 20))
            seen.add(window)
        expected.append((doc, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    found = substring_dedup.repeated_windows(docs, chunk_ids=4, buckets=5)
    rows = [(r["doc_id"], r["n_words"], r["n_removed"], r["kept_text"]) for r in found.collect()]
    assert sorted(r for r in rows if r[0] is not None) == sorted(expected)
    assert [r for r in rows if r[0] is None] == [(None, 120, 0, BASE)]
    assert all(sum(s["end"] - s["start"] for s in r["removed"]) == r["n_removed"] for r in found.collect())
    assert substring_dedup.repeated_windows(empty).count() == 0


def test_suffix_dedup(docs, empty):
    texts = [(d, t.encode()) for d, t in in_order()]
    count = {}
    for _, b in texts:
        for i in range(len(b) - 199):
            count[b[i:i + 200]] = count.get(b[i:i + 200], 0) + 1
    expected = []
    for d, b in texts:
        gone = bytearray(len(b))
        for i in range(len(b) - 199):
            if count[b[i:i + 200]] > 1:
                gone[i:i + 200] = b"\1" * 200
        runs = len(re.findall(b"\1+", bytes(gone)))
        expected.append((d, len(b), sum(gone), runs, bytes(x for x, g in zip(b, gone) if not g)))
    found = suffix_dedup.repeated_bytes(docs, chunk_ids=4, buckets=5)
    rows = [(r["doc_id"], r["n_bytes"], r["n_removed"], len(r["removed"]), bytes(r["kept"])) for r in found.collect()]
    assert sorted(r for r in rows if r[0] is not None) == sorted(expected)
    assert [r[2] for r in rows if r[0] is None] == [0]
    assert suffix_dedup.repeated_bytes(empty).count() == 0


def _components(sets, percent):
    label = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label]
    return label


@pytest.mark.parametrize("n,percent", [(3, 85), (5, 80)])
def test_minhash(spark, docs, empty, n, percent):
    loose = [prose(50, 200).split() for _ in range(30)]
    for k, w in enumerate(loose):
        for at in random.Random(k).sample(range(200), k % 9):
            w[at] = f"new{k}{at}"
    more = spark.createDataFrame([(100 + k, " ".join(w)) for k, w in enumerate(loose)], "doc_id bigint, text string")
    both = docs.unionByName(more, allowMissingColumns=True)
    rows = sorted((r[0], r[1] or "") for r in both.select("doc_id", "text").collect() if r[0] is not None)
    sets = []
    for _, text in rows:
        w = words("".join(c.lower() if "A" <= c <= "Z" else c for c in text))
        sets.append({tuple(w[i:i + n]) for i in range(max(1, len(w) - n + 1))} if w else set())
    label = _components(sets, percent)
    expected = sorted((d, len(s), rows[x][0]) for (d, _), s, x in zip(rows, sets, label))
    found = minhash_dedup.near_duplicates(both, n, percent).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in found if r["doc_id"] is not None) == expected
    assert [(r["component_id"], r["kept"]) for r in found if r["doc_id"] is None] == [(None, True)]
    assert minhash_dedup.near_duplicates(empty).count() == 0


def _loose(spark, n):
    """Texts that share most words, each pair some way below the threshold, but for the last two."""
    base, rows = prose(70, 150).split(), []
    for k in range(n):
        text = list(base)
        for at in random.Random(k).sample(range(150), 6):
            text[at] = f"own{k}at{at}"
        rows.append((k, " ".join(text)))
    rows.append((n, rows[-1][1] + " end"))
    return spark.createDataFrame(rows, "doc_id bigint, text string")


def test_loose_group_is_not_squared(spark, monkeypatch):
    """Pairs left to confirm after the stars, and links, for a loose group of two sizes."""
    plain, last = minhash_dedup.materialise, []

    def counting(df, largest=None):
        table = plain(df, largest)
        if df.columns == ["a", "b", "a_n", "b_n"]:
            last.append(table.rows)
        return table

    monkeypatch.setattr(minhash_dedup, "materialise", counting)
    for n in (40, 120):
        found = minhash_dedup.near_duplicates(_loose(spark, n), 5, 80).collect()
        assert sorted(r["doc_id"] for r in found if not r["kept"]) == [n]
        assert last[-1] <= n


def test_bitmaps_tell_no_link_apart():
    """Unequal bits are at most as many as unequal shingles, in small and in very large sets."""
    draw = np.random.default_rng(3)
    for n, changed in ((1, 1), (50, 5), (3000, 400), (100_000, 9000)):
        one = draw.integers(0, 2**48, n, dtype=np.uint64)
        two = np.concatenate((one[changed:], draw.integers(0, 2**48, changed, dtype=np.uint64)))
        sets = [np.unique(one), np.unique(two), np.zeros(0, np.uint64)]
        bits = np.bitwise_count(minhash_dedup._parities(sets)[:, None] ^ minhash_dedup._parities(sets)[None]).sum(axis=2)
        for i in range(3):
            for j in range(3):
                assert bits[i, j] <= len(np.setxor1d(sets[i], sets[j]))


def test_secrets(spark, empty):
    hexes = "0123456789abcdef" * 2
    texts = [
        None, "", f'token = "{hexes}" and AKIA{"Q" * 16}', "secret=token: abcdefgh", "PassWord:  hunter22 apikey='abc'",
        "client_id = alice77 then Zz9" + "k" * 20 + " at https://api.example.com/v1", "Zz9" + "k" * 20 + " at https://api.example.com/v1",
        "client_id = alice77" + " filler" * 80 + " Zz9" + "k" * 20,
    ]
    found = {r["doc_id"]: r for r in secret_scan.find_secrets(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).collect()}
    kinds = {d: [s["kind"] for s in r["spans"]] for d, r in found.items()}
    assert kinds == {0: [], 1: [], 2: ["assign", "hex", "access"], 3: [], 4: ["assign"], 5: ["id", "weak", "endpoint"], 6: [], 7: []}
    assert texts[2][found[2]["base"][1]["start"]:found[2]["base"][1]["end"]] == hexes
    assert secret_scan.find_secrets(empty).count() == 0


def test_secrets_longer_than_the_scope(spark):
    """The gap between two parts counts, not how far their starts are apart."""
    long = "Zz9" + "k" * 1600
    texts = [
        f"{long} client_id = alice77", "https://api.example.com/" + "v1/" * 150 + f" client_id = alice77 {long}",
        f"{long} {'filler ' * 40}client_id = alice77", f"{long} {'filler ' * 50}client_id = alice77",
    ]
    found = {r["doc_id"]: r for r in secret_scan.find_secrets(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).collect()}
    kinds = {d: sorted(s["kind"] for s in r["spans"]) for d, r in found.items()}
    assert kinds == {0: ["id", "weak"], 1: ["endpoint", "id", "weak"], 2: ["id", "weak"], 3: []}


def test_secrets_are_not_linked_with_themselves(spark):
    """The value of an identifier, or a piece of an address, is no second part."""
    weak = "Zz9" + "k" * 20
    texts = [
        "user_name = abcdefgh12345678 and nothing else", "client_id = alice77 see https://example.com/docs/v1/getting-started",
        f"user_name = abcdefgh12345678 and {weak}", f"client_id = alice77 see https://example.com/docs/v1/getting-started and {weak}",
        f"see https://example.com/?client_id=alice77&x={weak}", f"{weak} user_name = {weak}",
    ]
    found = {r["doc_id"]: r for r in secret_scan.find_secrets(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).collect()}
    kinds = {d: [s["kind"] for s in r["spans"]] for d, r in found.items()}
    assert kinds == {0: [], 1: [], 2: ["id", "weak"], 3: ["id", "endpoint", "weak"], 4: [], 5: ["weak", "id"]}


def test_long_words_that_polynomial_sums_take_for_equal(spark):
    """Two words of 1024 letters, the Thue-Morse sequence over a and b and its mirror image."""
    one = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
    two = one.translate(str.maketrans("ab", "ba"))
    rows = [(1, " ".join([one] * 20)), (2, " ".join([two] * 20)), (3, " ".join([one] * 20))]
    found = substring_dedup.repeated_windows(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {r["doc_id"]: r["n_removed"] for r in found} == {1: 0, 2: 0, 3: 20}


def test_sentencepiece_forgets_what_is_not_used(monkeypatch):
    monkeypatch.setattr(sentencepiece_codec, "KNOWN_SEGMENTS", 50)
    codec = sentencepiece_codec._Codec(sentencepiece_codec.Rebuilt(sentencepiece_codec.model_bytes()))
    texts = [prose(seed, 60) + f" only{seed} é日" for seed in range(30)]
    made = [codec.encode([t]) for t in texts]
    assert all(same == [True] for _, same in made) and len(codec.known) + len(codec.older) < 300
    ids = [np.frombuffer(x[0], "<i4") for x, _ in made]
    assert codec.decode(ids) == texts
    odd = [np.array(x, "<i4") for x in ([], [3 + 0xE3], [5, 10**6])]  # no ids, half a character, an id of no piece
    assert codec.decode(odd[:2])[0] == ""
    assert codec.decode(odd[1:2]) == [codec.tokenizer.decode(odd[1].tolist(), skip_special_tokens=False)]


def test_pipeline_stages_without_unique_ids(spark, tmp_path):
    """Rows without id and one id under two texts, in each stage that joins its findings back."""
    secret, item = "token = " + "0123456789abcdef" * 2, " ".join(f"item{j}" for j in range(20))

    def table(rows):
        return spark.createDataFrame(rows, "doc_id bigint, text string, n_chars bigint")

    def ran(stage, rows):
        return sorted(((r[0], r[1]) for r in stage(spark, table(rows), str(tmp_path)).collect()), key=str)

    masked = ran(corpus_pipeline.mask_secrets, [(None, f"a {secret}", 1), (1, f"longer before {secret}", 1), (1, f"b {secret} c", 1), (2, "clean", 1), (None, None, None)])
    assert masked == sorted([(None, "a [secret]"), (1, "longer before [secret]"), (1, "b [secret] c"), (2, "clean"), (None, None)], key=str)

    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    clean = ran(corpus_pipeline.drop_benchmark, [(None, item, 1), (None, prose(1, 30), 1), (5, f"x {item}", 1), (5, prose(2, 30), 1)])
    assert clean == sorted([(None, prose(1, 30)), (5, prose(2, 30))], key=str)

    rows = [(9, BASE, 1), (3, EDITED, 1), (4, prose(61, 90), 1), (4, prose(62, 90), 1), (3, prose(63, 90), 1), (None, BASE, 1), (7, "", 1), (7, "", 1)]
    kept = ran(corpus_pipeline.drop_near_duplicates, rows)
    assert kept == sorted([(3, EDITED), (4, prose(61, 90)), (4, prose(62, 90)), (3, prose(63, 90)), (None, BASE), (7, "")], key=str)


def test_pipeline_stages_on_hard_tables(spark, tmp_path):
    """Clashing names, null and very long texts, and empty tables, in every stage."""
    schema = "nr bigint, row string, doc_id bigint, text string, `spans` int, n_chars int, masked string, component_id string"
    secret, item = "token = " + "0123456789abcdef" * 2, " ".join(f"item{j}" for j in range(20))
    good, long = [prose(500 + k, 60) for k in range(40)], prose(7, 150_000)
    bad = [" ".join(w.upper() + "!!" for w in prose(600 + k, 60).split()) for k in range(40)]
    texts = [*good, *bad, None, "", long, f"{long} {secret} {secret} end", f"{good[0]} {item}"]
    rows = [(7, "r", i, t, 5, 1, "m", "c") for i, t in enumerate(texts)]
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    labels = [(i, int(i < 40)) for i in range(80)]
    spark.createDataFrame(labels, "doc_id bigint, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    full, none = spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, none, str(tmp_path)).count() == 0
        result = stage(spark, full, str(tmp_path))
        assert result.schema.simpleString() == full.schema.simpleString()
        found = {r["doc_id"]: r for r in result.collect()}
        assert all((r["nr"], r["row"], r["spans"], r["masked"], r["component_id"]) == (7, "r", 5, "m", "c") for r in found.values())
        if name == "quality":
            assert set(range(40)) | {82, 83} <= set(found) and not set(range(40, 80)) & set(found)
        elif name == "near_duplicates":
            assert set(found) == set(range(len(rows))) - {83} and found[80]["text"] is None
        elif name == "decontamination":
            assert set(found) == set(range(len(rows))) - {84}
        else:
            changed = {i: r["text"] for i, r in found.items() if r["text"] != texts[i]}
            assert changed == {83: f"{long} [secret] [secret] end"} and found[83]["n_chars"] == len(changed[83])
            assert all(r["n_chars"] == 1 for i, r in found.items() if i != 83)
    encoded = {r["doc_id"]: r for r in corpus_pipeline.encode(spark, full, str(tmp_path)).collect()}
    assert set(encoded) == set(range(len(rows))) and all(r["n_tokens"] == len(r["ids"]) for r in encoded.values())
    assert corpus_pipeline.encode(spark, none, str(tmp_path)).count() == 0


def test_sentencepiece(docs, empty):
    import sentencepiece

    model = sentencepiece_codec.model_bytes()
    judge = sentencepiece.SentencePieceProcessor(model_proto=model)
    odd = ["▁a ▁▁b", "日本 x", " lead", "tail  ", "a\tb\n\nc", "   "]
    texts = [r[1] for r in ROWS] + odd
    frame = docs.sparkSession.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id int, text string, ids string")
    encoded = sentencepiece_codec.encode(frame, model)
    ids = {r["doc_id"]: list(r["ids"]) for r in encoded.collect()}
    assert ids == {i: judge.encode(t or "") for i, t in enumerate(texts)}
    assert encoded.filter("NOT parity").count() == 0
    back = {r["doc_id"]: r["text"] for r in sentencepiece_codec.decode(encoded, model).collect()}
    assert back == {i: judge.decode(judge.encode(t or "")) for i, t in enumerate(texts)}
    assert sentencepiece_codec.encode(empty, model).count() == 0
    both = sentencepiece_codec.round_trip(frame, model)
    assert sorted(map(str, both.collect())) == sorted(map(str, sentencepiece_codec.decode(encoded, model).collect()))
    assert sentencepiece_codec.round_trip(empty, model).count() == 0


def test_id_blocks():
    draw = np.random.default_rng(3)
    blocks = [np.zeros(0, np.int32), np.array([49407]), np.full(500, 7), draw.integers(0, 49408, 700), np.minimum(draw.geometric(0.05, 900), 49000), np.tile(np.arange(40), 30)]
    blocks = [b.astype(np.int32) for b in blocks]
    payloads = id_files.encode_blocks(blocks)
    assert all((a == b).all() for a, b in zip(blocks, id_files.decode_blocks(payloads, [len(b) for b in blocks]), strict=True))
    assert len(payloads[5]) < 300 < len(payloads[3])


def test_counts_of_bytes(monkeypatch):
    """Sums by sixteen tell the same intervals as all 256 counts, also when these have grown old."""
    monkeypatch.setattr(id_files, "_MAX_COUNT", 900)
    draw, made = np.random.default_rng(5), id_files._Bytes(3)
    plain = np.ones((3, 256), np.int64)
    for _ in range(300):
        rows = np.flatnonzero(draw.random(3) < 0.8)
        symbol = draw.geometric(0.02, len(rows)) % 256
        sums, at = np.cumsum(plain[rows], axis=1), np.arange(len(rows))
        start, size, total = made.interval(rows, symbol)
        assert (start == sums[at, symbol] - plain[rows, symbol]).all() and (size == plain[rows, symbol]).all() and (total == sums[:, -1]).all()
        made.learn(rows, symbol)
        plain[rows, symbol] += 24
        old = rows[plain[rows].sum(axis=1) > 900]
        plain[old] = (plain[old] + 1) >> 1


def test_words_are_forgotten_unless_used(monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(id_files, "KNOWN_WORDS", 20)
    words, plain = id_files._Words(id_files.default_tokenizer()), Tokenizer.from_file(id_files.default_tokenizer())
    for k in range(40):
        text = f"always here {prose(k, 8)} only{k} é\n  日本"
        assert words.ids([text, ""]) == [plain.encode(text, add_special_tokens=False).ids, []]
        assert len(words.known) + len(words.older) < 80 and "always" in words.known


def test_words_are_encoded_together():
    """Many new words go to the tokenizer as one text, and each gets the ids that it has alone."""
    words = id_files._Words(id_files.default_tokenizer())
    plain, texts = words.tokenizer, []

    class Counted:
        def encode_batch(self, batch, **options):
            texts.extend(batch)
            return plain.encode_batch(batch, **options)

    words.tokenizer = Counted()
    odd = ["don't stop", "a\vb \fc", "\u0301e e\u0301 \u0958x İstanbul", "<|endoftext|>x y", "\u00a0 \u2028z\u00a0q", "日本 \U0001f31f's", "\x01 \x7f", " ", ""]
    many = [" ".join(f"w{i}x{j}" for j in range(60)) for i in range(20)]
    assert words.ids(many + odd) == [plain.encode(t, add_special_tokens=False).ids for t in many + odd]
    assert len(texts) <= 1 + 1260 // id_files._TOGETHER
    ids, counts = words.flat(id_files.pa.array([], "string"))
    assert len(ids) == len(counts) == 0


def test_marks_and_capitals_make_no_new_words(tmp_path):
    """Letters are encoded apart from the marks behind them, in small, and once; but only where the tokenizer does so."""
    from tokenizers import Tokenizer, normalizers

    words = id_files._Words(id_files.default_tokenizer())
    plain, sent = Tokenizer.from_file(id_files.default_tokenizer()), []

    class Counted:
        def __init__(self, tokenizer):
            self.tokenizer = tokenizer

        def encode_batch_fast(self, batch, **options):
            sent.extend(" ".join(batch).split())
            return self.tokenizer.encode_batch_fast(batch, **options)

    words.letters = (*map(Counted, words.letters[:2]), words.letters[2])
    texts = ["Thonre thonre, THONRE*** (thonre) thonre's THONRE'S", "ÈÊAUX èêaux. Èêaux;; straße STRASSE ẞ İx ÷x x÷ e\u0301x", "x<|endoftext|> x, <x> , .", "", "Thonre\v, thonre", "ÿ! Ÿ!"]
    for _ in range(2):
        assert words.ids(texts) == [plain.encode(t, add_special_tokens=False).ids for t in texts]
    assert sorted(sent) == sorted({"thonre", "èêaux", "straße", "strasse", "x", "ÿ"})
    plain.normalizer = normalizers.NFC()
    plain.save(str(tmp_path / "capitals.json"))
    words = id_files._Words(str(tmp_path / "capitals.json"))
    assert words.letters is None and words.ids(texts) == [plain.encode(t, add_special_tokens=False).ids for t in texts]


def test_words_are_kept_for_later_tasks(tmp_path):
    """A process knows its words again in its next task, unless the tokenizer's file has changed."""
    shutil.copy(id_files.default_tokenizer(), tmp_path / "one.json")
    path = str(tmp_path / "one.json")
    words = id_files._words(path, os.stat(path).st_mtime_ns)
    assert id_files._words(path, os.stat(path).st_mtime_ns) is words
    os.utime(path, (1, 1))
    assert id_files._words(path, os.stat(path).st_mtime_ns) is not words


def test_tokenizers_that_need_whole_texts(docs, tmp_path):
    """A limit on length cuts no words that go together, and ids that tell of the blank before them are refused."""
    from tokenizers import Tokenizer, models, pre_tokenizers

    plain = Tokenizer.from_file(id_files.default_tokenizer())
    plain.enable_truncation(8)
    plain.save(str(tmp_path / "cut.json"))
    text = " ".join(f"w{i}x" for i in range(50))
    words = id_files._Words(str(tmp_path / "cut.json"))
    plain.no_truncation()
    assert words.ids([text]) == [plain.encode(text, add_special_tokens=False).ids]
    blanks = Tokenizer(models.BPE({c: i for i, c in enumerate(sorted(pre_tokenizers.ByteLevel.alphabet()))}, []))
    blanks.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False)
    blanks.save(str(tmp_path / "blanks.json"))
    with pytest.raises(ValueError):
        id_files.write_ids(docs, str(tmp_path / "out"), str(tmp_path / "blanks.json"))


def test_blocks_of_unequal_length():
    """Lanes end at different places, in the mixture and in order 0, and counts are halved on the way."""
    draw = np.random.default_rng(8)
    blocks = [np.minimum(draw.geometric(p, n), 65535).astype(np.int32) for n, p in [(5000, 0.2), (1, 0.5), (2048, 0.001), (0, 0.5), (4999, 0.0001), (7, 0.3)] * 3]
    payloads = id_files.encode_blocks(blocks)
    assert all((a == b).all() for a, b in zip(blocks, id_files.decode_blocks(payloads, [len(b) for b in blocks]), strict=True))
    assert [id_files.decode_blocks([p], [len(b)])[0].tolist() for p, b in zip(payloads, blocks)] == [b.tolist() for b in blocks]
    assert id_files.encode_blocks([]) == id_files.decode_blocks([], []) == []


def test_id_files(spark, docs, empty, tmp_path):
    from tokenizers import Tokenizer

    id_files.write_ids(docs, str(tmp_path / "ids"), block=64)
    found = {(r["start"], r["doc_id"]): list(r["ids"]) for r in id_files.read_ids(spark, str(tmp_path / "ids")).collect()}
    plain = Tokenizer.from_file(id_files.default_tokenizer())
    start, expected = 0, {}
    for doc, text in [(None, BASE), *in_order()]:
        ids = [*plain.encode(text, add_special_tokens=False).ids, id_files.END]
        expected[start, doc] = ids
        start += len(ids)
    assert found == expected
    with pytest.raises(ValueError):
        id_files.write_ids(docs, str(tmp_path / "wide"), end=1 << 16)
    id_files.write_ids(empty, str(tmp_path / "none"))
    assert id_files.read_ids(spark, str(tmp_path / "none")).count() == 0


def test_spots(docs, empty):
    rows = spot_signatures.fingerprints(docs).withColumn("f", spot_signatures.fingerprint("found")).collect()
    given = in_order()
    following = {given[i]: given[(i + 1) % len(given)][1] for i in range(len(given))}
    for r in rows:
        if r["doc_id"] is not None:
            n = len(r["text"])
            nexts = {following[k] for k in following if k == (r["doc_id"], r["text"])}
            nexts |= {r["text"]} if given.count((r["doc_id"], r["text"])) > 1 else set()
            assert r["edited"] in {r["text"][:n - n // 4] + x[:n // 4] for x in nexts}
    by_text = {}
    for r in rows:
        assert by_text.setdefault(r["text"], r["f"]) == r["f"]
    pairs = spot_signatures.similar_fingerprints(spot_signatures.fingerprints(docs).filter("doc_id IS NOT NULL"), 0.5).collect()
    sets = {r["doc_id"]: set(r["found"]) for r in rows if r["doc_id"] is not None}
    first = {}
    for d in sorted(sets):
        first.setdefault(frozenset(sets[d]), d)
    ids = sorted(first.values())
    assert {(p["a"], p["b"]) for p in pairs} == {
        (a, b) for a in ids for b in ids if a < b and len(sets[a] & sets[b]) >= 0.5 * len(sets[a] | sets[b])
    }
    assert spot_signatures.fingerprints(empty).count() == 0


def test_spots_are_made_once(docs, monkeypatch):
    """Spots are made of each row with id, of those without and of the edited texts; the order of ids is found without them."""
    def plan(df):
        return df._jdf.queryExecution().optimizedPlan().toString()

    ordered, materialise = [], spot_signatures.materialise
    monkeypatch.setattr(spot_signatures, "materialise", lambda df: ordered.append(plan(df)) or materialise(df))
    assert plan(spot_signatures.fingerprints(docs)).count("Generate explode") == 3
    assert ordered and not any("Generate" in p for p in ordered)


def test_following(spark, monkeypatch):
    monkeypatch.setattr(spot_signatures, "SMALL", 3)
    ids = sorted(random.Random(1).sample(range(10**7), 60))
    found = {r["id"]: r["next"] for r in spot_signatures.following(spark.createDataFrame([(i,) for i in ids], "id bigint")).collect()}
    assert found == dict(zip(ids, [*ids[1:], None]))


def test_decontamination(spark, docs, empty):
    item = prose(77, 30).split()
    changed = [w for i, w in enumerate(item) if i not in (4, 15)] + ["extra"]
    bench = spark.createDataFrame([(1, " ".join(item), "x"), (2, None, "x"), (3, "", "x"), (4, "ba", "x")], "item_id int, text string, doc_id string")
    more = [(200, prose(8, 50) + " " + " ".join(item) + " " + prose(9, 40)), (201, prose(10, 90) + " " + " ".join(changed).upper()), (202, prose(11, 200))]
    both = docs.unionByName(spark.createDataFrame(more, "doc_id bigint, text string"), allowMissingColumns=True)
    # words of the test vocabulary are in all texts: make the item's own
    own = {w: f"{w}q" for w in set(item)}

    def rename(text):
        return " ".join(own.get(w, w) for w in text.split())

    bench = bench.withColumn("text", F.when(F.col("item_id") == 1, F.lit(rename(" ".join(item)))).otherwise(F.col("text")))
    both = both.withColumn("text", F.when(F.col("doc_id") == 200, F.lit(prose(8, 50) + " " + rename(" ".join(item)))).when(
        F.col("doc_id") == 201, F.lit((prose(10, 90) + " " + rename(" ".join(changed))).upper())).otherwise(F.col("text")))
    found = decontamination.contamination(both, bench).filter("contaminated").collect()
    assert sorted((r["doc_id"], r["item_id"]) for r in found) == [(200, 1), (201, 1)]
    assert decontamination.contamination(empty, bench).count() == 0
    assert decontamination.contamination(docs, bench.limit(0)).filter("contaminated").count() == 0


def _leaked(texts, items, size=64):
    """Brute force: pairs of document and item, over all windows of twice ``size`` words."""
    found, step = set(), size // 2
    for (d, text), (i, item) in ((x, y) for x in texts for y in items):
        cut, item = text.split(), item.split()
        for at in range(-step, len(cut), step):
            window = cut[max(0, at):at + 2 * size]
            if decontamination.common_subsequence(item, window) >= 0.6 * len(item) and decontamination.common_subsequence(item[-8:], window) >= 4:
                found.add((d, i))
    return found


def _leaks(spark, texts, items):
    tables = spark.createDataFrame(texts, "doc_id int, text string"), spark.createDataFrame(items, "item_id int, text string")
    return {(r["doc_id"], r["item_id"]) for r in decontamination.leaks(*tables).collect()}


def test_decontamination_of_paraphrases(spark):
    """The rarest words of each item, which carry nearly all of its weight, are replaced."""
    items = [(i, " ".join(f"own{i}x{j}" if j % 3 == 0 else w for j, w in enumerate(prose(800 + i, 30).replace(".", "").split()))) for i in range(8)]
    texts = [(k, prose(900 + k, 200).replace(".", "")) for k in range(60)]
    texts += [(100 + i, " ".join([prose(700 + i, 60).replace(".", ""), *["other" if w.startswith("own") else w for w in item.split()]])) for i, item in items]
    found = _leaks(spark, texts, items)
    assert found == _leaked(texts, items) and {(100 + i, i) for i, _ in items} <= found


def test_decontamination_by_cosine(spark, monkeypatch):
    """Half of each item's words stay, in order: too few for a copy, but near in the latent space."""
    items = [(i, " ".join(f"i{i}w{j}" for j in range(24))) for i in range(10)]
    half = [(i, " ".join(f"new{j}" if j % 2 else w for j, w in enumerate(item.split()))) for i, item in items]
    texts = [(100 + i, f"{prose(i, 60)} {item}") for i, item in half] + [(k, prose(900 + k, 200)) for k in range(30)]
    # as many words of an item in a text that is about others: not near
    texts += [(200 + i, " ".join([half[i][1], *[f"i{(i + k) % 10}w{j}" for k in (1, 2, 3, 4) for j in range(9, 18)]])) for i in range(10)]
    assert _leaked(texts, items) == set()
    assert _leaks(spark, texts, items) == {(100 + i, i) for i, _ in items}
    monkeypatch.setattr(decontamination, "LEAST_COSINE", 2.0)
    assert _leaks(spark, texts, items) == set()


def test_decontamination_of_short_items(spark):
    items = [(1, "Yes"), (2, "the  answer."), (3, "..."), (4, ""), (5, "no no no")]
    texts = [(1, "yes!"), (2, "the answer"), (3, "yes, the answer is no"), (4, ""), (5, None), (6, "No; no\n(no)"), (7, "no no"), (8, "...")]
    assert _leaks(spark, texts, items) == {(1, 1), (2, 2), (6, 5)}


def test_decontamination_of_rare_items(spark):
    """Items that leak often fill the latent space; the others leak once, beside words of the first."""
    items = [(i, " ".join(f"i{i}w{j}" for j in range(16))) for i in range(190)]
    texts = [(1000 * i + k, f"{items[i][1]} {prose(k, 6)}") for i in range(150) for k in range(60)]
    rare = [(500_000 + i, f"{items[i][1]} i{i - 60}w3 i{i - 60}w7 i{i - 70}w5 {prose(i, 6)}") for i in range(150, 190)]
    assert _leaks(spark, texts + rare, items) == {(d, d // 1000) for d, _ in texts} | {(d, d - 500_000) for d, _ in rare}


def test_decontamination_of_long_items(spark):
    draw = random.Random(3)
    long = [f"w{draw.randrange(400)}" for _ in range(500)]
    items = [(1, " ".join(long)), (2, " ".join(long[:214])), (3, " ".join(f"v{j}" for j in range(40)))]
    changed = [f"z{j}" if j % 5 == 2 else w for j, w in enumerate(long)]
    texts = [(k, " ".join([prose(k, k).replace(".", ""), *middle, prose(k + 1, 90).replace(".", "")])) for k, middle in ((301, long), (302, changed), (303, long[:214]), (304, long[:60]))]
    found = _leaks(spark, texts, items)
    assert found == {(301, 1), (301, 2), (302, 1), (302, 2), (303, 2)}
    assert found == _leaked(texts, items[:1], 512) | _leaked(texts, items[1:2], 256)


def test_common_subsequence():
    draw = random.Random(5)
    for _ in range(50):
        a, b = ([draw.randrange(5) for _ in range(draw.randrange(1, 30))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert decontamination.common_subsequence(a, b) == table[-1][-1]


@pytest.mark.parametrize("kind", ["toxic", "quality"])
def test_classifiers(spark, docs, empty, kind):
    rows = []
    for k in range(120):
        bad = k % 3 == 0
        text = prose(300 + k, 60)
        if bad:
            text = text + " awful rotten" if kind == "toxic" else " ".join(w.upper() + "!!" for w in text.split())
        rows.append((1000 + k, text, int(bad) if kind == "toxic" else int(not bad)))
    known = spark.createDataFrame(rows, "doc_id bigint, text string, label int")
    labels = known.select("doc_id", F.col("label").alias(kind), F.lit("x").alias("text"))
    held = F.col("doc_id") % 4 == 1
    both = docs.unionByName(known.select("doc_id", "text"), allowMissingColumns=True)
    if kind == "toxic":
        def judge(d, fitted):
            return toxicity.scores(d, fitted)
        model, none, cut = toxicity.fit(both, labels, ~held), toxicity.fit(both, labels.limit(0), ~held), 0.3
    else:
        def judge(d, fitted):
            return d.select("doc_id", quality.score_column("text", fitted).alias("score"))
        model, none, cut = quality.fit(both, labels, ~held), quality.fit(both, labels.limit(0), ~held), 0.5
    found = judge(both, model).collect()
    assert len(found) == both.count() and all(0 <= r["score"] <= 1 for r in found)
    truth = {r[0]: r[2] for r in rows if r[0] % 4 == 1}
    right = [(r["score"] >= cut) == bool(truth[r["doc_id"]]) for r in found if r["doc_id"] in truth]
    assert sum(right) >= 0.9 * len(right) == 0.9 * 30
    assert judge(both, none).select("score").distinct().count() == 1
    assert judge(empty, model).count() == 0


@pytest.mark.parametrize("limit", [0, 500_000])
def test_quality_is_fitted_on_all_labels_and_pairs(spark, monkeypatch, limit):
    """More rows of a class than a sample of 3000: moments, weights and threshold against all rows and all pairs in numpy."""
    monkeypatch.setattr("fleetwatch.operators.skew.BROADCAST_ROWS", limit)
    rows = []
    for k in range(3900):
        text, good = prose(k, 6 + k % 25), k % 6 > 0
        rows.append((k, text if good != (k % 17 == 0) else text.upper() + "!!", int(good)))
    rows += [(9000, rows[1][1], 0), (9001, None, 1), (None, "no id", 1)]  # a copy counts once, as the smallest id says
    table = spark.createDataFrame(rows, "doc_id bigint, text string, quality int").repartition(5).cache()
    model = quality.fit(table.select("doc_id", "text"), table.select("doc_id", "quality"), F.lit(True))
    texts = {t: q for _, t, q in reversed(rows[:3901])}
    x, y = np.array([quality.features(t) for t in texts]), np.array(list(texts.values()))
    assert len(x) > 3600
    np.testing.assert_allclose(model["mean"], x.mean(axis=0), rtol=1e-9, atol=1e-12)
    np.testing.assert_allclose(model["spread"], x.std(axis=0), rtol=1e-5, atol=1e-6)
    z = np.clip((x - model["mean"]) / model["spread"], -8, 8)
    good, bad = z[y == 1], z[y == 0]
    lost = 1 / (1 + np.exp(np.clip((good @ model["w"])[:, None] - (bad @ model["w"])[None], -30, 30)))
    slope = len(z) / lost.size * (lost.sum(axis=0) @ bad - lost.sum(axis=1) @ good) + model["w"]
    assert np.abs(slope).max() < 1e-3 * len(z)  # at nought: the least loss over all pairs
    totals = [sum(q == k for d, _, q in rows if d is not None) for k in (0, 1)]
    weight = np.array([totals[k] / (y == k).sum() for k in (0, 1)])
    strength = z @ model["w"]
    order = np.argsort(strength)
    rank = np.searchsorted(np.cumsum(weight[y[order]]), totals[0] * (1 - 1e-12))
    assert model["threshold"] == pytest.approx(strength[order][rank:rank + 2].mean(), abs=1e-9)


def test_halfway_between_strengths(spark):
    """Ties, extremes and values next to each other."""
    for values, goal in (([1, 1, 1, 1], 2), ([0, 1, 1, 2], 1), ([0, 1, 1, 2], 2), ([0, 1, 1, 2], 3), ([5, -1e9, 1e9], 1), ([1.0, 1 + 2**-52, 1 + 2**-51], 2), ([3, 4], 2)):
        rows = spark.createDataFrame([(0, float(v)) for v in values], "label int, strength double")
        order = sorted(values)
        at = min(goal - 1, len(order) - 2)
        assert ranking.halfway(rows, [1.0, 1.0], goal) == (order[at] + order[at + 1]) / 2
