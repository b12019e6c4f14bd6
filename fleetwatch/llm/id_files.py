"""Token ids in compressed files: an adaptive context-mixing range coder.

Documents are encoded with the tokenizers library, an end id follows each, and the ids are
written in ascending doc_id order. A file is a range of ids of documents; it is cut into blocks
of ``BLOCK`` ids. Every block starts with a fresh model, so it can be decoded alone, and carries
the CRC-32 of its ids.

Model. Order 2 and order 1 each predict one id, the one that last followed the same two ids or
the same id. Which of them is right, or neither, is an outcome; four outcomes are one symbol of
the mixture, whose adaptive counts the outcome before them chooses. So outcomes can be read before
any id is known, and the ids then follow by looking up. Only an id that neither predicts is coded
by order 0: adaptive counts of its high and its low byte. The coder takes counts up anew at places
ever further apart, so that a symbol is looked up and not searched. Two carry-less range coders of
64 bits, one for the mixture and one for order 0, put out 32-bit words and take two symbols at
once. All blocks of a task are coded in step, one array element each.

Storage is a Parquet table of block rows (file, block, documents and payload), so it works with
any store that Spark knows and a lost executor's files are written again.
"""

from __future__ import annotations

import json
import math
import os
import re
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain, compress, filterfalse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetwatch.llm.fitting import bounded_batches
from fleetwatch.session import _new_path

BLOCK = 2048
END = 2
LANES = 2048  # blocks coded in step: 32 KB of predictions and 2 KB of counts each
FILE_CHARS = 16_000_000  # code points of the texts of one file, which one task writes and one reads
_SLOTS = 1 << 13
_BITS = 11  # of the scale that a symbol's share is on
_MAX_COUNT = 1 << 14
_GROUP = 4  # outcomes in a symbol
_CHOICES = 3  # sets of counts for a group, which the outcome before it chooses
_THREES = [3 ** i for i in range(_GROUP)][::-1]
_WORD, _LOW_HALF, _HALF = np.uint64(1 << 32), np.uint64((1 << 32) - 1), np.uint64(32)
_ONE, _TWO, _TWELVE, _SIZE = np.uint64(_BITS), np.uint64(2 * _BITS), np.uint64(12), np.uint64(4095)


class _Bytes:
    """Adaptive counts of bytes, or of fewer symbols, a set for each row."""

    def __init__(self, rows: int, symbols: int = 256):
        self.counts, self.symbols = np.ones((rows, symbols), np.int32), symbols

    def interval(self, rows, symbol):
        """Where each row's symbol, or each of its line of symbols, lies among the row's counts, and their sum."""
        sums, lines = np.cumsum(self.counts[rows], axis=1), symbol.reshape(len(rows), symbol[0].size if len(rows) else 1)
        size = np.take_along_axis(self.counts[rows], lines, 1)
        before = np.take_along_axis(sums, lines, 1) - size
        return before.reshape(symbol.shape), size.reshape(symbol.shape), sums[:, -1].reshape(-1, *[1] * (symbol.ndim - 1))

    def shares(self, rows: int):
        """Flat, for the first rows: beginning << 12 | size of what each symbol has of ``1 << _BITS``; and the sizes."""
        sums = np.zeros((rows, self.symbols + 1), np.int32)
        np.cumsum(self.counts[:rows], axis=1, out=sums[:, 1:])
        edges = (sums * (np.float32((1 << _BITS) - self.symbols) / sums[:, -1:].astype(np.float32))).astype(np.int32)
        edges += np.arange(self.symbols + 1, dtype=np.int32)  # each symbol has one at least
        edges[:, -1] = 1 << _BITS
        sizes = np.diff(edges)
        return (edges[:, :-1] << 12 | sizes).ravel(), sizes.ravel()

    def tables(self, rows: int):
        """To decode with: the symbol at each of ``1 << _BITS`` places of each row, and the shares."""
        shares, sizes = self.shares(rows)
        return np.repeat(np.tile(np.arange(self.symbols, dtype=np.uint8), rows), sizes), shares

    def learn(self, rows, symbol):
        at = (rows * self.symbols).reshape(*rows.shape, *[1] * (symbol.ndim - rows.ndim)) + symbol
        seen = np.bincount(at.ravel(), minlength=self.counts.size).reshape(self.counts.shape)
        seen *= 24
        np.add(self.counts, seen, out=self.counts, casting="unsafe")
        old = np.flatnonzero(self.counts.sum(axis=1) > _MAX_COUNT)
        if len(old):
            self.counts[old] = (self.counts[old] + 1) >> 1


def _spans(n: int) -> Iterator[tuple[int, int]]:
    """Stretches of 0..n in which counts stay as they are; what a stretch held is learnt at its end."""
    at = 0
    while at < n:
        yield at, min(n, at + max(8, at // 2))
        at += max(8, at // 2)


class _Coder:
    """Lows and ranges of 64 bits. A range below 32 bits is cut to end on a word unless that is settled, and the word goes out."""

    def __init__(self, lanes: int):
        self.low, self.range = np.zeros(lanes, np.uint64), np.full(lanes, (1 << 64) - 1, np.uint64)

    def narrow(self, k, start, size, r):
        """To each lane's ``size`` parts of length ``r`` from ``start`` on."""
        low, left = self.low[:k], size * r
        low += start * r
        short = left < _WORD
        self.words(k, low, short)
        rest = _WORD - (low & _LOW_HALF)  # of this word
        shift = short.view(np.uint8) << np.uint8(5)
        np.minimum(left, rest, out=left, where=short)
        low <<= shift
        np.left_shift(left, shift, out=self.range[:k])


class _Writer(_Coder):
    def __init__(self, lanes: int, room: int):
        super().__init__(lanes)
        self.out, self.next = np.zeros((lanes, room), np.uint32), np.arange(lanes) * room
        self.flat, self.first = self.out.ravel(), self.next.copy()

    def words(self, k, low, short):
        self.flat[self.next[:k]] = low >> _HALF  # the next word takes the place of one that was not settled
        self.next[:k] += short

    def finish(self) -> list[bytes]:
        """A last word that lies in the range when noughts follow it."""
        self.flat[self.next] = self.low + _LOW_HALF >> _HALF
        many = self.next - self.first + 1
        return [row[:n].astype("<u4").tobytes() for row, n in zip(self.out, many.tolist())]


class _Reader(_Coder):
    def __init__(self, payloads: list[bytes]):
        super().__init__(len(payloads))
        width = max(map(len, payloads), default=0) + 16
        words = np.frombuffer(b"".join(p.ljust(width - width % 4, b"\0") for p in payloads), "<u4").reshape(len(payloads), width // 4)
        self.data, self.next = words.astype(np.uint64).ravel(), np.arange(len(payloads)) * (width // 4) + 2
        self.code = words[:, 0].astype(np.uint64) << _HALF | words[:, 1]

    def value(self, k, r):
        return (self.code[:k] - self.low[:k]) // r

    def words(self, k, low, short):
        np.copyto(self.code[:k], self.code[:k] << _HALF | self.data.take(self.next[:k], mode="clip"), where=short)
        self.next[:k] += short


def _going_on(sizes) -> list[int]:
    """How many blocks, from the longest on, have a symbol at each place."""
    return np.searchsorted(-sizes, -np.arange(max(sizes, default=0)), side="left").tolist()


class _Pairs:
    """Codes lines of pairs of bytes, a line for each block, the longest first. Each byte has counts that the one before it may choose."""

    def __init__(self, lanes: int, symbols: int = 256, choices: int = 1):
        """A byte modulo ``choices`` chooses the counts of the next."""
        self.choices = choices
        self.first = _Bytes(lanes * choices, symbols)
        self.second = _Bytes(lanes, symbols) if choices == 1 else self.first

    def rows(self, before):
        """Which counts each lane uses after the bytes ``before``, a line for each lane."""
        lanes = np.arange(len(before))[:, None] * self.choices
        return lanes + before % self.choices if self.choices > 1 else lanes[:, 0]

    def learn(self, pairs, before):
        """``pairs`` of a stretch, after the bytes ``before``."""
        x, y = pairs >> 8, pairs & 255
        self.first.learn(self.rows(np.column_stack((before, y[:, :-1]))), x)
        self.second.learn(self.rows(x), y)

    def write(self, pairs, sizes) -> list[bytes]:
        going = _going_on(sizes)
        writer = _Writer(len(sizes), len(going) + 2)  # a word a pair at most
        before = np.zeros(len(sizes), np.int64)
        for a, b in _spans(len(going)):
            n, part = going[a], pairs[:going[a], a:b]
            x, y = part >> 8, part & 255
            shares, _ = self.first.shares(n * self.choices)
            shares_of_second = shares if self.second is self.first else self.second.shares(n)[0]
            symbols, lines = self.first.symbols, self.rows(np.column_stack((before[:n], y[:, :-1])))
            for c in range(a, b, 64):  # arrays that stay in the cache
                some = slice(c - a, min(b, c + 64) - a)
                outer = shares.take((lines if self.choices == 1 else lines[:, some]).reshape(n, -1) * symbols + x[:, some]).astype(np.uint64)
                inner = shares_of_second.take(self.rows(x[:, some]).reshape(n, -1) * symbols + y[:, some]).astype(np.uint64)
                size = outer & _SIZE
                start = ((outer >> _TWELVE << _ONE) + (inner >> _TWELVE) * size).T.copy()
                size = (size * (inner & _SIZE)).T.copy()
                for t in range(c, min(b, c + 64)):
                    k = going[t]
                    writer.narrow(k, start[t - c, :k], size[t - c, :k], writer.range[:k] >> _TWO)
            self.learn(part, before[:n])
            before[:n] = y[:, -1]
        return writer.finish()

    def read(self, payloads: list[bytes], sizes) -> np.ndarray:
        going = _going_on(sizes)
        reader, pairs = _Reader(payloads), np.zeros((len(sizes), len(going)), np.int32)
        before = np.zeros(len(sizes), np.int64)
        for a, b in _spans(len(going)):
            n = going[a]
            places, table = np.arange(n) * self.choices << _BITS, np.arange(n) * (self.choices * self.first.symbols)
            at, shares = self.first.tables(n * self.choices)
            inner_at, inner = (at, shares) if self.second is self.first else self.second.tables(n)
            found, x, y = np.zeros((b - a, n), np.int32), 0, before[:n]
            for t in range(a, b):
                k = going[t]
                r = reader.range[:k] >> _TWO
                value = reader.value(k, r)
                place, row = self._line(places[:k], table[:k], y)
                x = at.take((value >> _ONE).view(np.int64) + place, mode="clip")
                share = shares.take(row + x, mode="clip").astype(np.uint64)
                start, size = share >> _TWELVE << _ONE, share & _SIZE
                place, row = self._line(places[:k], table[:k], x)
                y = inner_at.take(((value - start) // size).view(np.int64) + place, mode="clip")
                share = inner.take(row + y, mode="clip").astype(np.uint64)
                reader.narrow(k, start + (share >> _TWELVE) * size, size * (share & _SIZE), r)
                found[t - a, :k] = x.astype(np.int32) << 8 | y
            part = pairs[:n, a:b] = found.T
            self.learn(part, before[:n])
            before[:n] = part[:, -1] & 255
        return pairs

    def _line(self, places, table, before):
        """Where the places and the shares of the counts are that the bytes ``before`` choose."""
        if self.choices == 1:
            return places, table
        chosen = (before[:len(table)] % self.choices).astype(np.int64)
        return places + (chosen << _BITS), table + chosen * self.first.symbols


def _slots(before, last, lanes):
    """Where order 2 and order 1 have what came last after the ids ``before`` and ``last``, and after ``last``."""
    return (before * 40503 + last * 30011 & _SLOTS - 1) + lanes, (last & _SLOTS - 1) + lanes


def _by_length(sizes) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """The order of blocks from the longest on, their sizes in it, and how many have an id at each place."""
    sizes = np.array(sizes, np.int64)
    order = np.argsort(-sizes, kind="stable")
    return order, sizes[order], _going_on(sizes[order])


def _pairs_of(sizes):
    """Pairs of groups of outcomes that so many ids have."""
    return -(-sizes // (2 * _GROUP))


def encode_blocks(blocks: list[np.ndarray]) -> list[bytes]:
    """Payloads of blocks of ids below 65536; longer blocks are coded along with shorter ones.

    A payload is two 32-bit numbers, of ids that order 0 codes and of the bytes of the outcomes, then these, then those ids.
    """
    if not blocks:
        return []
    order, sizes, going = _by_length([len(b) for b in blocks])
    lines = np.zeros((len(blocks), len(going)), np.uint16)
    for row, i in enumerate(order):
        lines[row, :sizes[row]] = blocks[i]
    ids, slots = np.ascontiguousarray(lines.T), np.arange(len(blocks)) * _SLOTS
    two, one = (np.zeros(len(slots) * _SLOTS, np.uint16) for _ in range(2))
    by_two, by_one = np.zeros_like(ids), np.zeros_like(ids)
    before = last = np.zeros_like(slots)
    for t, k in enumerate(going):
        at2, at1 = _slots(before[:k], last[:k], slots[:k])
        by_two[t, :k], by_one[t, :k] = two.take(at2, mode="clip"), one.take(at1, mode="clip")
        two[at2] = one[at1] = ids[t, :k]
        before, last = last, ids[t].astype(np.int64)
    wrong = by_two != ids
    missing = wrong & (by_one != ids) & (np.arange(len(going))[:, None] < sizes)
    neither = np.ascontiguousarray(missing.T)
    outcomes = np.zeros((max(_pairs_of(sizes)), 2, _GROUP, len(slots)), np.uint8)
    np.add(wrong, missing, out=outcomes.reshape(-1, len(slots))[:len(going)], dtype=np.uint8)
    groups = sum(outcomes[:, :, i] * np.uint8(n) for i, n in enumerate(_THREES)).transpose(1, 2, 0).astype(np.int32)
    symbols = _Pairs(len(slots), 3 ** _GROUP, _CHOICES).write(groups[0] << 8 | groups[1], _pairs_of(sizes))
    many = neither.sum(axis=1)
    missed = np.zeros((len(slots), max(many)), np.int32)
    missed[np.arange(missed.shape[1]) < many[:, None]] = lines[neither]
    longest = np.argsort(-many, kind="stable")
    payloads: list[bytes] = [b""] * len(blocks)
    for row, rest in zip(longest, _Pairs(len(slots)).write(missed[longest], many[longest])):
        payloads[order[row]] = np.array([many[row], len(symbols[row])], "<u4").tobytes() + symbols[row] + rest
    return payloads


def decode_blocks(payloads: list[bytes], sizes: list[int]) -> list[np.ndarray]:
    if not payloads:
        return []
    order, sizes, going = _by_length(sizes)
    heads = np.array([np.frombuffer(payloads[i], "<u4", 2) for i in order], np.int64)
    many, slots = np.minimum(heads[:, 0], sizes), np.arange(len(payloads)) * _SLOTS
    pairs = _Pairs(len(slots), 3 ** _GROUP, _CHOICES).read([payloads[i][8:8 + end] for i, end in zip(order, heads[:, 1])], _pairs_of(sizes))
    groups = np.stack((pairs.T >> 8, pairs.T & 255), axis=1).astype(np.uint8)
    outcomes = np.stack([groups // np.uint8(n) % np.uint8(3) for n in _THREES], axis=2).reshape(-1, len(slots))
    right2, right1, neither = outcomes == 0, outcomes == 1, outcomes == 2
    longest = np.argsort(-many, kind="stable")
    missed = np.zeros((len(slots), max(many) + 1), np.uint16)
    missed[longest, :-1] = _Pairs(len(slots)).read([payloads[order[row]][8 + heads[row, 1]:] for row in longest], many[longest])
    following, missed = np.arange(len(slots)) * missed.shape[1], missed.ravel()
    ids = np.zeros((len(going), len(slots)), np.uint16)
    two, one = (np.zeros(len(slots) * _SLOTS, np.uint16) for _ in range(2))
    before = last = np.zeros_like(slots)
    for t, k in enumerate(going):
        at2, at1 = _slots(before[:k], last[:k], slots[:k])
        now = missed.take(following[:k], mode="clip")
        np.copyto(now, two.take(at2, mode="clip"), where=right2[t, :k])
        np.copyto(now, one.take(at1, mode="clip"), where=right1[t, :k])
        following[:k] += neither[t, :k]
        ids[t, :k] = two[at2] = one[at1] = now
        before, last = last, now.astype(np.int64)
    ids, out = np.ascontiguousarray(ids.T).astype(np.int32), [np.zeros(0, np.int32)] * len(order)
    for row, i in enumerate(order):
        out[i] = ids[row, :sizes[row]]
    return out


KNOWN_WORDS = 150_000  # after which those that were not used since are forgotten
_TOGETHER = 256  # words that are encoded as one text


_MARKS = '!"#$%&()*+,-./:;=?@[\\]^_`{}~'
_SMALL_LETTERS = "".join(chr(c) for c in (*range(97, 123), *range(0xDF, 0x100)) if c != 0xF7)
_SMALL, _PLAIN = "^[a-zß-öø-ÿ]+$", f"^[A-Za-zÀ-ÖØ-öø-ÿ]+[{re.escape(_MARKS)}]*$"
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
_CUTS = {"type": "Sequence", "pretokenizers": [
    {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
]}


def _of_letters(tokenizer):
    """The same model for words of small letters: a tokenizer for ASCII ones, one for all, and which ids end a word.

    Nothing if the tokenizer is not known to make letters small, to part them from the marks behind them and to end each
    part with an id of its own.
    """
    from tokenizers import Tokenizer, models, pre_tokenizers

    model, vocab = tokenizer.model, tokenizer.get_vocab()
    steps = [json.loads(x.__getstate__()) if x else None for x in (tokenizer.normalizer, tokenizer.pre_tokenizer)]
    if steps != [_NORMALIZER, _CUTS] or not isinstance(model, models.BPE) or not (suffix := model.end_of_word_suffix):
        return None
    alphabet = pre_tokenizers.ByteLevel.alphabet()
    whole = all(c in vocab and c + suffix in vocab for c in alphabet)
    apart = all(set(t.content) & set("<>|'0123456789") for t in tokenizer.get_added_tokens_decoder().values())
    if not whole or not apart or model.dropout or model.continuing_subword_prefix:
        return None
    end = np.zeros(max(vocab.values()) + 1, bool)
    end[[i for w, i in vocab.items() if w.endswith(suffix)]] = True
    ascii_only, any_letters = Tokenizer(model), Tokenizer(model)
    ascii_only.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
    any_letters.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    return ascii_only, any_letters, end


def _joined(lines, lengths, row) -> tuple[np.ndarray, np.ndarray]:
    """``lines`` has parts of these ``lengths``; those that ``row`` numbers, and where each ends."""
    many = lengths.take(row)
    ends = np.cumsum(many)
    return lines.take(np.repeat(np.cumsum(lengths).take(row) - ends, many) + np.arange(ends[-1])), ends


class _Words:
    """Ids of texts, word by word: the tokenizer drops white space and never looks across it.

    Where it is known to part letters from the marks behind them, these are looked up and encoded apart.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core, and threads that wait for words burn others
        self.tokenizer, self.known, self.older = Tokenizer.from_file(path), {"": b""}, {}
        self.tokenizer.no_truncation()  # words that go together are longer than any limit
        self.tokenizer.no_padding()
        self.letters = _of_letters(self.tokenizer)

    def ids(self, texts: list[str]) -> list[list[int]]:
        flat, counts = self.flat(pa.array(texts, pa.string()))
        return [part.tolist() for part in np.split(flat, np.cumsum(counts)[:-1])]

    def flat(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and how many each text has."""
        if not len(texts):
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        odd = any(pa.compute.any(pa.compute.match_substring(texts, c)).as_py() for c in "\v\f")  # no white space to all tokenizers
        cut = pa.compute.split_pattern_regex(texts, r"[ \t\n\r]+") if odd else pa.compute.ascii_split_whitespace(texts)
        coded = cut.flatten().dictionary_encode()
        ids, ends = _joined(*self._lines(coded.dictionary), coded.indices.to_numpy())
        return ids, np.diff(np.concatenate(([0], ends)).take(cut.offsets.to_numpy()))

    def _lines(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in a row, and how many each word has."""
        if not self.letters:
            return self._found(words)
        plain, small = pa.compute.match_substring_regex(words, _PLAIN), pa.compute.utf8_lower(words)
        core = pa.compute.utf8_rtrim(small, _MARKS)
        marked = pa.compute.and_(plain, pa.compute.not_equal(core, small))
        marks = pa.compute.utf8_ltrim(small.filter(marked), _SMALL_LETTERS)
        parts = pa.concat_arrays([pa.compute.if_else(plain, core, words), marks]).dictionary_encode()
        marked, numbers = marked.to_numpy(zero_copy_only=False), parts.indices.to_numpy()
        last = np.arange(len(words)) + np.cumsum(marked)  # of each word's parts
        row = np.empty(len(numbers), np.int64)
        row[last - marked] = numbers[:len(words)]
        row[last[marked]] = numbers[len(words):]
        ids, ends = _joined(*self._found(parts.dictionary), row)
        return ids, np.diff(ends.take(last), prepend=0)

    def _found(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """As ``_lines``, of parts that are encoded alone."""
        if len(self.known) > KNOWN_WORDS:  # words that come again soon are kept
            self.known, self.older = {"": b""}, self.known
        words = parts.to_numpy(zero_copy_only=False).tolist()
        lines = list(map(self.known.get, words))
        unknown = [i for i, line in enumerate(lines) if line is None]
        new = [words[i] for i in unknown]
        if self.older:
            self.known.update((w, self.older[w]) for w in new if w in self.older)
            new = [w for w in new if w not in self.known]
        if self.letters:
            small = pa.compute.match_substring_regex(pa.array(new, pa.string()), _SMALL).to_numpy(zero_copy_only=False)
            self._learn_letters(list(compress(new, small)))
            new = [w for w in new if w not in self.known]
        self.known.update(zip(new, self._encoded(new)))
        for i in unknown:
            lines[i] = self.known[words[i]]
        return np.frombuffer(b"".join(lines), np.int32), np.fromiter(map(len, lines), np.int64, len(lines)) >> 2

    def _learn_letters(self, words: list[str]) -> None:
        """Words of small letters only; those whose ends do not tell them apart are left."""
        ascii_only, any_letters, end = self.letters
        for tokenizer, some in ((ascii_only, list(filter(str.isascii, words))), (any_letters, list(filterfalse(str.isascii, words)))):
            parts = [" ".join(some[i:i + _TOGETHER]) for i in range(0, len(some), _TOGETHER)]
            found = tokenizer.encode_batch_fast(parts, add_special_tokens=False)
            ids = np.fromiter(chain.from_iterable(e.ids for e in found), np.int32)
            ends = (4 * (np.flatnonzero(end.take(ids)) + 1)).tolist()
            if len(ends) == len(some):
                ids = ids.tobytes()
                self.known.update(zip(some, (ids[a:b] for a, b in zip([0, *ends], ends))))

    def _encoded(self, words: list[str]) -> Iterator[bytes]:
        """Ids of each word. Many are encoded as one text; where an id comes from tells its word."""
        parts = [" ".join(words[i:i + _TOGETHER]) for i in range(0, len(words), _TOGETHER)]
        found = self.tokenizer.encode_batch(parts, add_special_tokens=False)
        ids = np.fromiter(chain.from_iterable(e.ids for e in found), np.int32).tobytes()
        places = [np.fromiter((a for a, _ in e.offsets), np.int64) for e in found]
        base = np.cumsum([0, *(len(p) + 1 for p in parts)])
        places = np.concatenate([p + at for p, at in zip(places, base)]) if places else np.zeros(0, np.int64)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        upto = np.searchsorted(places, ends).tolist()
        return (ids[4 * a:4 * b] for a, b in zip([0, *upto], upto))


@lru_cache(2)
def _words(path: str, changed: int) -> _Words:
    """Kept for the tasks that the same process runs later; ``changed`` tells a file from one that was there before."""
    return _Words(path)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _check_tokenizer(path: str, end: int) -> None:
    """Refuse what the format or the cutting of words would get wrong."""
    words = _Words(path)
    if max(end, *words.tokenizer.get_vocab().values()) >= 1 << 16:
        raise ValueError("ids of 65536 and more cannot be written")
    probes = ["the cat sat", "a\nb", "x  y", " to\tbe ", "Don't stop , 3.5"]

    def encoded(text):
        return words.tokenizer.encode(text, add_special_tokens=False).ids

    whole, alone = [encoded(p) for p in probes], [list(chain.from_iterable(map(encoded, p.split()))) for p in probes]
    if not words.ids(probes) == alone == whole:
        raise ValueError("the tokenizer looks across white space")


def write_ids(docs: DataFrame, folder: str, tokenizer: str | None = None, end: int = END, block: int = BLOCK) -> None:
    """Write the ids of all documents to ``folder``.

    ``blocks``: file, block, n, crc, payload. ``documents``: file, place in it, doc_id, n_tokens.
    Files follow each other in ascending order of doc_id, and so do places in a file. A null or
    empty text has its end id only. Rows of one id follow in the order of their texts, rows
    without id come first. Other columns are ignored; an empty table gives no files. The
    tokenizer's path must be the same on all machines. The number of files follows the length of
    all texts, so that a file does not grow with the input. A tokenizer with ids of 65536 and more, or
    one that does not drop white space, is a ``ValueError``. Runs a job when called.
    """
    bounded_batches(docs)
    path = tokenizer or default_tokenizer()
    _check_tokenizer(path, end)
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    chars = texts.agg(F.sum(F.length("text"))).first()[0] or 0
    files = max(docs.sparkSession.sparkContext.defaultParallelism, math.ceil(chars / FILE_CHARS))
    spread = texts.repartitionByRange(files, "doc_id", "text").sortWithinPartitions("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, number, rest = _words(path, os.stat(path).st_mtime_ns), 0, np.zeros(0, np.int32)
        waiting: list[np.ndarray] = []

        def rows_of(blocks):
            nonlocal number
            for payload, ids in zip(encode_blocks(blocks), blocks):
                yield [None, None, number, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), payload]
                number += 1

        for batch in batches:
            ids, counts = words.flat(batch["text"])
            yield _batch([[d, n + 1, None, None, None, None] for d, n in zip(batch["doc_id"].to_pylist(), counts.tolist())])
            flat = np.concatenate((rest, np.insert(ids, np.cumsum(counts), end)))
            full = len(flat) // block * block
            waiting += list(flat[:full].reshape(-1, block))
            rest = flat[full:]
            if len(waiting) >= LANES:
                full = len(waiting) // LANES * LANES
                for i in range(0, full, LANES):
                    yield _batch(rows_of(waiting[i:i + LANES]))
                waiting = waiting[full:]
        waiting += [rest] if len(rest) else []
        if waiting:
            for i in range(0, len(waiting), LANES):
                yield _batch(rows_of(waiting[i:i + LANES]))

    made = spread.mapInArrow(run, "doc_id bigint, n_tokens bigint, block int, n int, crc bigint, payload binary")
    placed = made.select(F.spark_partition_id().alias("file"), F.monotonically_increasing_id().alias("place"), "*")
    placed.write.parquet(folder)


def _batch(rows) -> pa.RecordBatch:
    names = ["doc_id", "n_tokens", "block", "n", "crc", "payload"]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary()]
    columns = list(zip(*rows)) or [()] * 6
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names)


READ = "doc_id bigint, start bigint, n_tokens bigint, ids array<int>"


def read_ids(spark, folder: str, derive: Callable[[pa.Table], pa.Table] | None = None, columns: str = READ) -> DataFrame:
    """Columns doc_id, start (ids of all documents before), n_tokens, ids: decoded and checked.

    A block whose checksum differs fails the job. One task decodes one file. ``derive`` makes other ``columns`` of these where the
    ids are decoded, so that they need not leave Python.
    """
    stored = spark.read.parquet(folder)
    sums = stored.filter("n_tokens IS NOT NULL").groupBy("file").agg(F.sum("n_tokens").alias("total"))
    # a row for each file: their number is the number of partitions written
    starts = {r["file"]: r["total"] for r in sums.collect()}
    base, so_far = {}, 0
    for file in sorted(starts):
        base[file], so_far = so_far, so_far + starts[file]

    def of_file(table: pa.Table) -> pa.Table:
        table = table.sort_by("place")
        known = pa.compute.is_valid(table["n_tokens"])
        listed, blocks = table.filter(known), table.filter(pa.compute.invert(known)).sort_by("block")
        payloads, sizes, sums_ = (blocks[c].to_pylist() for c in ("payload", "n", "crc"))
        ids = []
        for i in range(0, len(payloads), LANES):
            part = decode_blocks(payloads[i:i + LANES], sizes[i:i + LANES])
            if [zlib.crc32(x.astype("<u4").tobytes()) for x in part] != sums_[i:i + LANES]:
                raise ValueError("a block does not have the checksum that was stored with it")
            ids += part
        flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
        counts = listed["n_tokens"].to_numpy()
        ends = np.cumsum(counts)
        first = base[table["file"][0].as_py()] if table.num_rows else 0
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)), pa.int32()), pa.array(flat))
        read = pa.table({
            "doc_id": listed["doc_id"], "start": pa.array(first + ends - counts, pa.int64()), "n_tokens": listed["n_tokens"], "ids": lists,
        })
        return derive(read) if derive else read

    return stored.groupBy("file").applyInArrow(of_file, columns)


def with_crc32(read: pa.Table) -> pa.Table:
    """The CRC-32 of each document's ids, as little-endian unsigned 32-bit integers, in their place."""
    ids = read["ids"].combine_chunks()
    ends, flat = (4 * ids.offsets.to_numpy()).tolist(), memoryview(ids.values.to_numpy().astype("<u4").tobytes())
    crcs = [zlib.crc32(flat[a:b]) for a, b in zip(ends, ends[1:])]
    return read.drop_columns("ids").append_column("ids_crc32", pa.array(crcs, pa.int64()))


def op6_token_files(spark, folder: str) -> DataFrame:
    path = _new_path(spark)
    write_ids(spark.read.parquet(f"{folder}/documents.parquet"), path)
    return read_ids(spark, path, with_crc32, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
