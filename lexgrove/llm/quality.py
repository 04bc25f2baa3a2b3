"""Quality by the perplexity of an interpolated modified Kneser-Ney n-gram model of words.

The model is trained on trusted text: the documents labelled good, all of it. Its units are the
words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased, its order is three: a word is predicted from
the two words before it (two starts before a text's first word), then from the one before it,
then from nothing, and at last as an unknown word, one over the vocabulary and one more.

A word is known by 48 bits of its hash. In all that is sent, the HEAD most frequent words have a
short number instead. Each place
of a text is one triple: its word with the words before and after. Triples are sharded by their
middle word; a word so frequent that it would fill a shard is dealt out further by the word
before. So one shard holds all counts of a pair of words and of what follows it, and of a word
and of what precedes it.

Counting: tasks send the triples of trusted texts, counted by chunk, and shards sum them. Lower
orders get continuation counts, the number of distinct words seen before. A rare word's count is
sent to the shards of the words that it follows, counts of numbered words to all tasks, and the
pairs of dealt out words are summed by pair and sent to each of their shards. The driver gets the
counts of numbered words and figures of fixed size: counts of counts, which give the discounts D1,
D2, D3+ of each order, and totals. Tables are never written: for scoring, shards count the
messages of trusted texts once more, before they answer them and the others.

Scoring, a sharded count join: each task sends the triples of a chunk of documents to their
shards, one compressed message for each chunk and shard; shards answer with a sum of log
probabilities for each document of the chunk; and the sums are added by chunk. A triple's shard
adds the probability of its last word after the others or, if the model doesn't have the triple,
the weights of backing off; and the probability of its middle word alone, if the model doesn't
have that word after the first. No text is shuffled.

All words that no trusted text has are alike to the model, so in other texts they are sent as one,
and their own triples, which add what any such word adds, aren't sent: tasks add them. Numbered
words are known to be such by their counts; rare words by a bitmap of the trusted ones, of at most
KNOWN bits. A word that shares its bit with a trusted one is sent as it is.

The model learns from two thirds of the trusted documents, by crc32 of their id. A document is
kept if its perplexity is at most MARGIN times the QUANTILE of the other trusted documents of
its language; a language without those takes the quantile over all of them.

Defined results: a text without words has a null perplexity and is not kept; a null lang is a
language. Without trusted text perplexities are null and nothing is kept. Rows
that repeat a doc_id are scored each. Rows have to come in the same order when a task is run
again, as they do from files.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexgrove.llm.scratch import cut, maybe_in, never_in, session_for, shuffle_partitions
from lexgrove.llm.textcols import U, gathered, mix, slices, text_bytes, word_hashes

QUANTILE = 0.99
MARGIN = 1.25
#: So many of the most frequent words at most get a number, which shortens messages; results don't depend on it.
HEAD = 1 << 20
#: Trusted ids that are sent to all tasks at most (8 bytes each); more are joined by shuffling.
SENT_IDS = 2_000_000
#: Bits at most that tell tasks which rare words trusted texts have; results don't depend on it.
KNOWN = 1 << 26
#: Text bytes for a shard, and of a chunk of documents, about.
SHARD = 48 << 20
CHUNK = 8 << 20
#: Words: the start and end of a text, any that no trusted text has, numbered words, 48 bits of a hash.
START, END, UNKNOWN, _NUMBERED, _RARE = 1, 2, 3, 4, 1 << 48
_BUFFER = 1_000_000  # counts that are held before they are summed
_TURN = (U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F), U(0x165667B19E3779F9))


def _pack(*columns: np.ndarray) -> bytes:
    """Columns of whole numbers, compressed.

    Numbers below 2**32 become a byte of their length in bits and their first four bits, and the
    other bits on end; columns with larger ones become byte planes.
    """
    out = []
    squeeze = zstandard.ZstdCompressor(level=1).compress
    for column in columns:
        bits = int(column.max()).bit_length() if len(column) else 0
        if bits > 32:
            width = -(-bits // 8)
            planes = column.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]
            out.append((width, squeeze(planes.T.tobytes()), b""))
        else:
            more = np.maximum(np.frexp(column.astype(np.float64))[1] - 4, 0)
            first = ((column >> more) + 8 * more).astype(np.uint8)
            rest = [(column[more >= k + 8] >> k).astype(np.uint8).tobytes() for k in range(0, bits - 11, 8)]
            left = more & 7
            over = column >> (more - left)
            rest += [np.packbits((over[left > k] >> k & 1).astype(np.uint8)).tobytes() for k in range(7)]
            out.append((0, squeeze(first.tobytes()), b"".join(rest)))
    return b"".join(struct.pack("<IBI", len(c), width, len(a)) + a + b for c, (width, a, b) in zip(columns, out, strict=True))


def _unpack(data: bytes) -> list[np.ndarray]:
    at, out = 0, []
    loosen = zstandard.ZstdDecompressor().decompress
    while at < len(data):
        size, width, length = struct.unpack_from("<IBI", data, at)
        at += 9 + length
        raw = np.frombuffer(loosen(data[at - length : at]), np.uint8)
        if width:
            planes = np.zeros((size, 8), np.uint8)
            planes[:, :width] = raw.reshape(width, size).T
            out.append(planes.view("<i8").ravel())
        else:
            more = np.maximum((raw.astype(np.int64) >> 3) - 1, 0)
            column = raw - 8 * more << more
            for k in range(0, int(more.max()) - 7 if size else 0, 8):
                where = np.flatnonzero(more >= k + 8)
                column[where] |= np.frombuffer(data, np.uint8, len(where), at).astype(np.int64) << k
                at += len(where)
            left = more & 7
            over = np.zeros(size, np.uint8)
            for k in range(7):
                where = np.flatnonzero(left > k)
                to = at + -(-len(where) // 8)
                over[where] |= np.unpackbits(np.frombuffer(data, np.uint8, to - at, at), count=len(where)) << k
                at = to
            column |= over.astype(np.int64) << (more - left)
            out.append(column)
    return out


def _pack_words(*columns: np.ndarray, n: np.ndarray) -> bytes:
    """Columns of words, rare ones apart, and one of whole numbers."""
    out = []
    for words in columns:
        rare = words >= _RARE
        out += [np.where(rare, 0, words), words[rare] - _RARE]
    return _pack(n, *out)


def _unpack_words(data: bytes) -> list[np.ndarray]:
    n, *rest = _unpack(data)
    for words, rare in zip(rest[::2], rest[1::2], strict=True):
        words[words == 0] = rare + _RARE
    return [*rest[::2], n]


def _steps(words: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Words that are in order within runs, as steps from the one before, and one; rare words stay."""
    before = np.concatenate([np.zeros(1, np.int64), words[:-1]])[: len(words)]
    before[starts] = 0
    return np.where(words < _RARE, words - before + 1, words)


def _walked(steps: np.ndarray, starts: np.ndarray) -> np.ndarray:
    step = np.where(steps < _RARE, steps - 1, 0)
    place = np.cumsum(step)
    begin = np.repeat(place[starts] - step[starts], _sizes(starts, steps))
    return np.where(steps < _RARE, place - begin, steps)


def _short(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> U(16)).astype(np.int64)


@dataclass
class Head:
    """48-bit hashes of the numbered words (sorted), their numbers, and into how many shards each number's word is dealt."""

    hashes: np.ndarray
    numbers: np.ndarray
    dealt: np.ndarray
    shards: int

    @staticmethod
    def of(hashes: np.ndarray, counts: np.ndarray, total: int, shards: int) -> Head:
        order = np.lexsort((hashes, -counts))
        by_hash = np.argsort(hashes[order])
        dealt = np.concatenate([np.ones(_NUMBERED, np.int64), np.clip(counts[order] * shards // max(total, 1), 1, shards)])
        return Head(hashes[order][by_hash], (by_hash + _NUMBERED).astype(np.int32), dealt.astype(np.int32), shards)

    @cached_property
    def _of_shards(self) -> tuple[np.ndarray, np.ndarray]:
        shard, number = self.each(np.arange(_NUMBERED, len(self.dealt)), np.arange(_NUMBERED, len(self.dealt)))
        order = np.lexsort((number, shard))
        return number[order], np.searchsorted(shard[order], np.arange(self.shards + 1))

    def numbers_in(self, shard: int) -> np.ndarray:
        """The numbers, in order, whose words a shard has or has a part of."""
        numbers, starts = self._of_shards
        return numbers[starts[shard] : starts[shard + 1]]

    def words(self, hashes: np.ndarray) -> np.ndarray:
        hashes = _short(hashes)
        at, there = _find(self.hashes, hashes)
        return np.where(there, self.numbers[at], hashes + _RARE) if len(self.hashes) else hashes + _RARE

    def dealt_of(self, words: np.ndarray) -> np.ndarray:
        return np.where(words < _RARE, self.dealt[np.where(words < _RARE, words, 0)], 1)

    def shard_of(self, words: np.ndarray, before: np.ndarray) -> np.ndarray:
        """A triple's shard, by its middle word and the one before."""
        part = (mix(before.astype(U)) % self.dealt_of(words).astype(U)).astype(np.int64)
        return _shard(words, part, self.shards)

    def each(self, words: np.ndarray, *columns: np.ndarray) -> list[np.ndarray]:
        """Rows repeated for each part that a word is dealt into: its shard, and the columns."""
        times = self.dealt_of(words)
        of = np.repeat(np.arange(len(words)), times)
        part = np.arange(len(of)) - np.repeat(np.cumsum(times) - times, times)
        shard = _shard(words[of], part, self.shards)
        order = np.lexsort((shard, of))
        order = order[_runs(of[order], shard[order])]  # two parts may be in one shard
        return [shard[order], *(c[of[order]] for c in columns)]

    def places(self, shard: int, words: np.ndarray) -> np.ndarray:
        """Numbered words by their place among a shard's."""
        return np.where(words < _RARE, np.searchsorted(self.numbers_in(shard), words), words)

    def words_at(self, shard: int, places: np.ndarray) -> np.ndarray:
        numbered = places < _RARE
        places[numbered] = self.numbers_in(shard)[places[numbered]]
        return places

    def pack_counts(self, shard: int, words: np.ndarray, before: np.ndarray, after: np.ndarray, n: np.ndarray) -> bytes:
        """A shard's triples, in order, with their counts."""
        return _pack_words(_steps(self.places(shard, words), _FIRST[: len(words)]), _steps(before, _runs(words)), after, n=n)

    def unpack_counts(self, shard: int, data: bytes) -> list[np.ndarray]:
        words, before, after, n = _unpack_words(data)
        words = self.words_at(shard, _walked(words, _FIRST[: len(words)]))
        return [words, _walked(before, _runs(words)), after, n]

    def pack_texts(self, shard: int, words: np.ndarray, before: np.ndarray, after: np.ndarray, doc: np.ndarray) -> bytes:
        """A shard's triples of documents, with each document's number of them."""
        order = np.lexsort((words, doc))
        return _pack_words(_steps(self.places(shard, words[order]), _runs(doc)), before[order], after[order], n=np.bincount(doc))

    def unpack_texts(self, shard: int, data: bytes) -> list[np.ndarray]:
        steps, before, after, n = _unpack_words(data)
        some = n[n > 0]
        return [self.words_at(shard, _walked(steps, np.cumsum(some) - some)), before, after, n]


_FIRST = np.zeros(1, np.int64)


def _shard(words: np.ndarray, part: np.ndarray, shards: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (mix(words.astype(U) * _TURN[0] + part.astype(U)) % U(shards)).astype(np.int64)


def tokens(column: pa.Array, head: Head) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Each word, the word before and the word after it in its text, and the number of words before each row."""
    hashes, first = word_hashes(*text_bytes(column))
    words = head.words(hashes)
    before, after = np.full(len(words), START), np.full(len(words), END)
    before[1:], after[:-1] = words[:-1], words[1:]
    some = np.diff(first) > 0
    before[first[:-1][some]], after[first[1:][some] - 1] = START, END
    return words, before, after, first


def _runs(*ordered: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    if not len(ordered[0]):
        return np.zeros(0, np.int64)
    new = np.zeros(len(ordered[0]), bool)
    new[0] = True
    for column in ordered:
        new[1:] |= column[1:] != column[:-1]
    return np.flatnonzero(new)


def _sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, starts) if len(starts) else np.zeros(0, np.int64)


def _sizes(starts: np.ndarray, of: np.ndarray) -> np.ndarray:
    return np.diff(np.append(starts, len(of)))


def _summed_up(*columns: np.ndarray) -> list[np.ndarray]:
    """Distinct keys, sorted, with the sums of the last column."""
    *keys, n = columns
    order = np.lexsort(keys[::-1])
    keys = [k[order] for k in keys]
    starts = _runs(*keys)
    return [*(k[starts] for k in keys), _sums(n[order], starts)]


class Counts:
    """Keys of words and their counts, summed up as they come."""

    def __init__(self, width: int) -> None:
        self.parts: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] * (width + 1)]
        self.held, self.limit = 0, _BUFFER

    def add(self, *columns: np.ndarray) -> None:
        self.parts.append(list(columns))
        self.held += len(columns[0])
        if self.held > self.limit:
            self.sum()

    def sum(self) -> list[np.ndarray]:
        if len(self.parts) > 1:
            found = _summed_up(*(np.concatenate(c) for c in zip(*self.parts, strict=True)))
            self.parts, self.held, self.limit = [found], len(found[0]), max(_BUFFER, 2 * len(found[0]))
        return self.parts[0]


class Grams:
    """A shard's triples (sorted by middle word, word before, word after) and what they say of lower orders."""

    def __init__(self, words: np.ndarray, before: np.ndarray, after: np.ndarray, n: np.ndarray) -> None:
        self.columns = words, before, after, n
        self.inner = inner = after != END
        self.pair_at = at = _runs(words, before)
        self.first, self.second = before[at], words[at]  # pairs of words
        self.pair_of = np.repeat(np.arange(len(at)), _sizes(at, words))
        self.pair_n = _sums(n, at)
        start = _runs(self.second)
        self.words, self.continued = self.second[start], _sizes(start, self.second)
        order = np.lexsort((after[inner], words[inner]))
        one, two = words[inner][order], after[inner][order]
        at = _runs(one, two)
        self.one, self.two, self.pair_continued = one[at], two[at], _sizes(at, one)  # pairs by their first word


def _counts_of(n: np.ndarray) -> np.ndarray:
    return np.bincount(n[n <= 4], minlength=5)[1:]


#: Figures: counts of counts of triples, pairs and single words (four each); of the words that start a
#: text, how many, how often in all, and how many once, twice and more often; of the rare words, the
#: sum of continuation counts, how many, and how many with one, two and more.
_FIGURES = 22
_AT_STARTS, _AT_RARE = 12, 17


def _by_three(n: np.ndarray) -> list[int]:
    return [int(x.sum()) for x in (n == 1, n == 2, n > 2)]


def _figures(grams: Grams, head: Head) -> np.ndarray:
    out = np.zeros(_FIGURES, np.int64)
    starts = grams.pair_n[grams.first == START]
    rare = grams.continued[grams.words >= _RARE]
    out[:4] = _counts_of(grams.columns[3][grams.inner]) + _counts_of(starts)
    out[4:8] = _counts_of(grams.pair_continued[head.dealt_of(grams.one) == 1])
    out[4] += len(starts)  # a start comes before each pair of a start and a word
    out[8:12] = _counts_of(rare)
    out[_AT_STARTS:_AT_RARE] = [len(starts), starts.sum(), *_by_three(starts)]
    out[_AT_RARE:] = [rare.sum(), len(rare), *_by_three(rare)]
    return out


def _discounts(n: list[float]) -> list[float]:
    """0, D1, D2 and D3+ from the counts of counts 1 to 4."""
    y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.5
    d = [i - (i + 1) * y * b / a if a else y * i / 2 for i, a, b in ((1, n[0], n[1]), (2, n[1], n[2]), (3, n[2], n[3]))]
    return [0.0, *(min(max(x, 0.05), i - 0.05) for i, x in zip((1, 2, 3), d, strict=True))]


class Model:
    """Discounts of each order, probabilities of single words, and those of a text's first word."""

    def __init__(self, figures: np.ndarray, continued: np.ndarray) -> None:
        """continued: of each numbered word."""
        figures = figures.copy()
        known = continued[continued > 0]
        figures[8:12] += _counts_of(known)
        figures[_AT_RARE:] += [known.sum(), len(known), *_by_three(known)]
        self.triple, self.pair, self.single = (np.array(_discounts(figures[i : i + 4].astype(float).tolist())) for i in (0, 4, 8))
        self.total, self.size = int(figures[_AT_RARE]), int(figures[_AT_RARE + 1])
        self.spare = float(np.dot(figures[_AT_RARE + 2 :], self.single[1:]))
        self.starts, self.texts = int(figures[_AT_STARTS]), int(figures[_AT_STARTS + 1])
        self.start_spare = float(np.dot(figures[_AT_STARTS + 2 : _AT_RARE], self.triple[1:]))
        self.numbered = self.alone(continued)

    def alone(self, continued: np.ndarray) -> np.ndarray:
        """Probability of a word with such a continuation count, 0 if unknown."""
        return (self.less(self.single, continued) + self.spare / (self.size + 1)) / self.total

    def at_start(self, n: np.ndarray, alone: np.ndarray) -> np.ndarray:
        """Probability of a text's first word that starts n trusted texts."""
        pair = np.where(n > 0, 1 - self.pair[1], 0) / self.starts + self.pair[1] * alone
        return (self.less(self.triple, n) + self.start_spare * pair) / self.texts

    @staticmethod
    def less(discounts: np.ndarray, n: np.ndarray) -> np.ndarray:
        return n - discounts[np.minimum(n, 3)]


def _bits(rare: np.ndarray, most: int) -> bytes:
    """A bitmap of a shard's rare words, of 32 bits for each, but of ``most`` bits at most."""
    size = max(min(32 * len(rare), most) // 8, 1)
    bits = np.zeros(8 * size, np.uint8)
    bits[(rare - _RARE) % len(bits)] = 1
    return zstandard.ZstdCompressor(level=1).compress(np.packbits(bits, bitorder="little").tobytes())


class Known:
    """Which words trusted texts have, and what each other word adds to its text.

    Of rare words, some others that share a bit count as known.
    """

    def __init__(self, model: Model, continued: np.ndarray, slices_of: dict[int, bytes], shards: int) -> None:
        """continued: of each numbered word; slices_of: each shard's bitmap."""
        self.numbered = continued > 0
        self.numbered[:_NUMBERED] = True
        loosen = zstandard.ZstdDecompressor().decompress
        parts = [np.frombuffer(loosen(slices_of[s]) if s in slices_of else bytes(1), np.uint8) for s in range(shards)]
        self.sizes = 8 * np.array([len(x) for x in parts], np.int64)
        self.starts, self.bits = np.cumsum(self.sizes) - self.sizes, np.concatenate(parts)
        alone = model.alone(np.zeros(1, np.int64))
        self.alone, self.at_start = float(np.log(alone)[0]), float(np.log(model.at_start(np.zeros(1, np.int64), alone))[0])

    def has(self, words: np.ndarray) -> np.ndarray:
        out = self.numbered[np.where(words < _RARE, words, 0)]
        at = np.flatnonzero(words >= _RARE)
        rare = words[at]
        shard = _shard(rare, np.zeros(len(rare), np.int64), len(self.sizes))
        bit = self.starts[shard] + (rare - _RARE) % self.sizes[shard]
        out[at] = self.bits[bit >> 3] >> (bit & 7).astype(np.uint8) & 1
        return out


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each wanted key among the sorted ones, and whether it is there."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def _key(turn: int, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(mix(one.astype(U) * _TURN[turn]) + two.astype(U))


class Lookup:
    """Sorted keys (64-bit hashes) with values."""

    def __init__(self, keys: np.ndarray, *values: np.ndarray) -> None:
        order = np.argsort(keys)
        self.keys, self.values = keys[order], [v[order] for v in values]

    def get(self, keys: np.ndarray) -> tuple[np.ndarray, ...]:
        """Whether a key is there, and its values or 0."""
        at, there = _find(self.keys, keys)
        return there, *(np.where(there, v[at], 0) if len(v) else np.zeros(len(keys), v.dtype) for v in self.values)


class Table:
    """A shard's log probabilities and weights of backing off.

    rare: the rare words that follow the shard's words, with their continuation counts; dealt: the
    pairs, of all shards, that begin with the dealt out words which the shard has a part of.
    """

    def __init__(self, model: Model, head: Head, grams: Grams, rare: list[np.ndarray], dealt: list[np.ndarray]) -> None:
        self.model = model
        own = head.dealt_of(grams.one) == 1
        one, two, n = (np.concatenate(c) for c in zip([grams.one[own], grams.two[own], grams.pair_continued[own]], dealt, strict=True))
        order = np.lexsort((two, one))
        one, two, n = one[order], two[order], n[order]
        at = _runs(one)
        words, of = one[at], np.repeat(np.arange(len(at)), _sizes(at, one))
        total = _sums(n, at)
        spare = np.bincount(of, model.pair[np.minimum(n, 3)], len(at))
        at, there = _find(rare[0], two)
        if not there[two >= _RARE].all():
            raise ValueError("a word's continuation count is missing")
        alone = model.alone(rare[1])[at] if len(rare[0]) else np.zeros(len(two))
        alone = np.where(two < _RARE, self._numbered(two), alone)
        p = (model.less(model.pair, n) + spare[of] * alone) / total[of]
        self.pairs = Lookup(_key(1, one, two), p)
        self.back = words, spare / np.maximum(total, 1)
        mid, _, after, n = (c[grams.inner] for c in grams.columns)
        pair = grams.pair_of[grams.inner]
        total = np.bincount(pair, n, len(grams.first))
        spare = np.bincount(pair, model.triple[np.minimum(n, 3)], len(grams.first))
        key = _key(0, grams.second, grams.first)
        _, lower = self.pairs.get(_key(1, mid, after))
        self.triples = Lookup(_key(2, key[pair], after), (model.less(model.triple, n) + spare[pair] * lower) / total[pair])
        # a pair that only ends texts predicts nothing
        self.before = Lookup(key, np.where(total > 0, spare / np.maximum(total, 1), 1), grams.pair_n)
        self.own = grams.words, grams.continued

    def _numbered(self, words: np.ndarray) -> np.ndarray:
        return self.model.numbered[np.where(words < _RARE, words, 0)]

    def log_p(self, words: np.ndarray, before: np.ndarray, after: np.ndarray) -> np.ndarray:
        """What each triple adds to its text."""
        key = _key(0, words, before)
        seen, back, n = self.before.get(key)
        found, p = self.triples.get(_key(2, key, after))
        rest = np.flatnonzero(~found & (after != END))
        there, lower = self.pairs.get(_key(1, words[rest], after[rest]))
        at, known = _find(self.back[0], words[rest])
        lower[~there] = np.where(known, self.back[1][at], 1)[~there] if len(self.back[0]) else 1
        p[rest] = np.where(seen[rest], back[rest], 1) * lower
        p[~found & (after == END)] = 1
        out = np.log(p)
        start = before == START
        rest = np.flatnonzero(start | ~seen)
        at, known = _find(self.own[0], words[rest])
        alone = self.model.alone(np.where(known, self.own[1][at], 0) if len(self.own[0]) else np.zeros(len(rest), np.int64))
        alone = np.where(words[rest] < _RARE, self._numbered(words[rest]), alone)
        out[rest] += np.log(np.where(start[rest], self.model.at_start(n[rest], alone), alone))
        return out


def _frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's frequent words, and a null with the number of all and their bytes."""
    counts, total, size = Counts(1), 0, 0
    for batch in batches:
        for part in slices(batch, "text", CHUNK):
            data, offsets = text_bytes(part.column("text"))
            words, n = np.unique(_short(word_hashes(data, offsets)[0]), return_counts=True)
            total, size = total + int(n.sum()), size + len(data)
            counts.add(words, n)
            if counts.held > 4 * _BUFFER:  # a word may lose some of its count, which only lengthens messages
                words, n = counts.sum()
                counts.parts, counts.held = [[words[n > 1], n[n > 1]]], int((n > 1).sum())
    words, n = counts.sum()
    words, n = words[n > 1], n[n > 1]
    out = [(-1, _pack(np.array([total]), np.array([size])))]
    for s, (own, times) in _split(words >> 42, words, n):
        out.append((s, _pack(np.diff(own, prepend=s << 42), times)))
    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.binary()), strict=True)], ["shard", "data"])


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The tasks' words, with their sums; and a null with the sums of all words and bytes."""
    last, counts, totals = None, Counts(1), np.zeros(2, np.int64)

    def told() -> pa.RecordBatch:
        words, n = counts.sum()
        return pa.record_batch([pa.array(words), pa.array(n), pa.array(np.zeros(len(n), np.int64))], ["word", "n", "size"])

    for batch in batches:
        for s, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            one, two = _unpack(data)
            if s < 0:
                totals += [one[0], two[0]]
                continue
            if s != last:
                yield told()
                last, counts = s, Counts(1)
            counts.add(np.cumsum(one) + (s << 42), two)
    yield told()
    yield pa.record_batch([pa.array([None], pa.int64()), pa.array(totals[:1]), pa.array(totals[1:])], ["word", "n", "size"])


_ROWS = "kind int, shard long, chunk long, data binary"
#: Kinds of rows: rare words with continuation counts, pairs of dealt out words with continuation
#: counts, triples of trusted texts and of others, documents of a chunk; figures, numbered words and
#: bitmaps of rare words for the driver.
_WORDS, _PAIRS, _TRIPLES, _ASKED, _DOCS, _FIGURE, _NUMBERS, _BITS = range(8)


def _rows(*rows: tuple[int, int, bytes]) -> pa.RecordBatch:
    kinds, shards, data = zip(*rows, strict=True)
    return pa.record_batch([pa.array(kinds, pa.int32()), pa.array(shards, pa.int64()), pa.array([-1] * len(rows), pa.int64()), pa.array(data, pa.binary())], ["kind", "shard", "chunk", "data"])


def _split(shard: np.ndarray, *columns: np.ndarray) -> Iterator[tuple[int, tuple[np.ndarray, ...]]]:
    """Columns cut by shard; order is kept."""
    order = np.argsort(shard, kind="stable")
    cuts = [*_runs(shard[order]).tolist(), len(shard)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        yield int(shard[order[a]]), tuple(c[order[a:b]] for c in columns)


def _counted(shared):  # noqa: ANN001
    """Triples of trusted texts, counted by chunk, for their shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = shared.value
        for batch in gathered(batches, "text", CHUNK):
            for part in slices(batch, "text", CHUNK):
                words, before, after, _ = tokens(part.column("text"), head)
                words, before, after, n = _summed_up(words, before, after, np.ones(len(words), np.int64))
                out = [(_TRIPLES, s, head.pack_counts(s, *c)) for s, c in _split(head.shard_of(words, before), words, before, after, n)]
                if out:
                    yield _rows(*out)

    return run


def _by_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple]]]:
    """Runs of rows of one shard within a batch."""
    for batch in batches:
        rows = list(zip(*(batch.column(c).to_pylist() for c in ("shard", "kind", "data")), strict=True))
        shard = np.array([r[0] for r in rows])
        cuts = [*_runs(shard).tolist(), len(rows)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield int(shard[a]), rows[a:b]


def _summed(shared, bits: int):  # noqa: ANN001
    """What other shards and the driver have to know of each shard's triples; bits: for a shard's rare words at most."""

    def told(head: Head, shard: int, grams: Grams) -> Iterator[pa.RecordBatch]:
        out = [(_FIGURE, -1, _pack(_figures(grams, head)))]
        low = grams.words < _RARE
        out.append((_BITS, shard, _bits(grams.words[~low], bits)))
        out.append((_NUMBERS, -1, _pack(grams.words[low], grams.continued[low])))
        # a rare word to all shards of the words before it
        rare = (grams.second >= _RARE) & (grams.first != START)
        word, n = grams.second[rare], grams.continued[np.searchsorted(grams.words, grams.second[rare])]
        for s, columns in _split(*head.each(grams.first[rare], word, n)):
            keys, at = np.unique(columns[0], return_index=True)
            out.append((_WORDS, s, _pack_words(keys, n=columns[1][at])))
        dealt = head.dealt_of(grams.one) > 1
        one, two, n = (c[dealt] for c in (grams.one, grams.two, grams.pair_continued))
        out += [(_PAIRS, s, _pack_words(*c[:2], n=c[2])) for s, c in _split(_shard(one, two, head.shards), one, two, n)]
        yield _rows(*out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, last, counts = shared.value, None, Counts(3)
        for shard, rows in _by_shard(batches):
            if shard != last:
                if last is not None:
                    yield from told(head, last, Grams(*counts.sum()))
                last, counts = shard, Counts(3)
            for _, _, data in rows:
                counts.add(*head.unpack_counts(shard, data))
        if last is not None:
            yield from told(head, last, Grams(*counts.sum()))

    return run


def _paired(shared):  # noqa: ANN001
    """Continuation counts of dealt out words' pairs, summed and sent to each of the words' shards."""

    def told(head: Head, one: np.ndarray, two: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        figures = np.zeros(_FIGURES, np.int64)
        figures[4:8] = _counts_of(n)
        out = [(_FIGURE, -1, _pack(figures))]
        out += [(_PAIRS, s, _pack_words(*c[:2], n=c[2])) for s, c in _split(*head.each(one, one, two, n))]
        return _rows(*out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, last, counts = shared.value, None, Counts(2)
        for shard, rows in _by_shard(batches):
            if shard != last:
                if last is not None:
                    yield told(head, *counts.sum())
                last, counts = shard, Counts(2)
            for _, _, data in rows:
                counts.add(*_unpack_words(data))
        if last is not None:
            yield told(head, *counts.sum())

    return run


_MESSAGES = _ROWS + ", ids array<long>, langs array<string>, sizes array<long>"
_MESSAGE_TYPES = [pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.int64())]


def _batch(schema: str, types: list[pa.DataType], rows: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], [f.split()[0] for f in schema.split(", ")])


_UNIT = 1 << 17  # sums of log probabilities are sent in units of one over this


def _sent_sums(some: np.ndarray, sums: np.ndarray) -> bytes:
    """Sums of log probabilities of some documents, by their numbers in the chunk."""
    return _pack(np.diff(some, prepend=0), np.rint(sums * -_UNIT).astype(np.int64))


def _asked(shared, known_of):  # noqa: ANN001
    """Messages of each chunk's triples to their shards, and the chunk's documents with the sums of their unknown words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, known = shared.value, known_of.value
        number = 0
        for batch in gathered(batches, "text", CHUNK):
            for part in slices(batch, "text", CHUNK):
                chunk = part.column("task")[0].as_py() << 32 | number
                number += 1
                # trusted documents first, which shortens the numbers of documents
                part = part.take(np.argsort(~part.column("trusted").to_numpy(zero_copy_only=False), kind="stable"))
                words, before, after, first = tokens(part.column("text"), head)
                sizes = np.diff(first)
                doc = np.repeat(np.arange(part.num_rows), sizes)
                shard = head.shard_of(words, before)
                trusted = part.column("trusted").to_numpy(zero_copy_only=False)[doc]
                unknown = ~trusted & ~known.has(words)
                at = np.flatnonzero(unknown)
                some, of = np.unique(doc[at], return_inverse=True)
                sums = np.bincount(of, np.where(before[at] == START, known.at_start, known.alone), len(some))
                out = [(_DOCS, -1, chunk, _sent_sums(some, sums), part.column("doc_id").to_pylist(), part.column("lang").to_pylist(), sizes.tolist())]
                after[at[before[at] != START] - 1] = UNKNOWN
                before[at[after[at] != END] + 1] = UNKNOWN
                for kind, own in ((_TRIPLES, trusted), (_ASKED, ~trusted & ~unknown)):
                    for s, c in _split(*(x[own] for x in (shard, words, before, after, doc))):
                        out.append((kind, s, chunk, head.pack_texts(s, *c), None, None, None))
                yield _batch(_MESSAGES, _MESSAGE_TYPES, out)

    return run


_ANSWERS = "chunk long, shard long, ids array<long>, langs array<string>, sizes array<long>, data binary"
_ANSWER_TYPES = [pa.int64(), pa.int64(), *_MESSAGE_TYPES[4:], pa.binary()]


def _answered(shared, model_of):  # noqa: ANN001
    """Sums of each message's documents by its shard's table, whose rows and trusted texts come before other messages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, model = shared.value, model_of.value
        last, table, parts, held = None, None, {}, []

        def begin() -> Table:
            return Table(model, head, Grams(*parts[_TRIPLES].sum()), parts[_WORDS].sum(), parts[_PAIRS].sum())

        def answer(chunk: int, data: bytes) -> tuple:
            *triples, n = head.unpack_texts(last, data)
            some = np.flatnonzero(n)
            sums = np.add.reduceat(table.log_p(*triples), np.cumsum(n[some]) - n[some])
            return chunk, last, None, None, None, _sent_sums(some, sums)

        for batch in batches:
            out = []
            for kind, shard, chunk, data, *documents in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if kind == _DOCS:
                    out.append((chunk, shard, *documents, data))
                    continue
                if shard != last:
                    if held:
                        table = begin()
                        out += [answer(*x) for x in held]
                    last, table, parts, held = shard, None, {_TRIPLES: Counts(3), _WORDS: Counts(1), _PAIRS: Counts(2)}, []
                if kind == _TRIPLES:
                    *triples, n = head.unpack_texts(shard, data)
                    parts[kind].add(*triples, np.ones(len(triples[0]), np.int64))
                    held.append((chunk, data))
                elif kind == _ASKED:
                    if table is None:
                        table = begin()
                        out += [answer(*x) for x in held]
                        held = []
                    out.append(answer(chunk, data))
                else:
                    parts[kind].add(*_unpack_words(data))
            if out:
                yield _batch(_ANSWERS, _ANSWER_TYPES, out)
        if held:
            table = begin()
            yield _batch(_ANSWERS, _ANSWER_TYPES, [answer(*x) for x in held])

    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Perplexities of each chunk's documents; the chunk's documents come before its sums."""
    held = None

    def close() -> pa.RecordBatch:
        ids, langs, sizes, sums = held
        found = [float(np.exp(-t / n)) if n else None for t, n in zip(sums, sizes, strict=True)]
        return pa.record_batch([pa.array(ids, pa.int64()), pa.array(langs, pa.string()), pa.array(found, pa.float64())], ["doc_id", "lang", "perplexity"])

    for batch in batches:
        for _, _, ids, langs, sizes, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if ids is not None:
                if held is not None:
                    yield close()
                held = ids, langs, sizes, np.zeros(len(ids))
            steps, parts = _unpack(data)
            held[3][np.cumsum(steps)] -= parts / _UNIT
    if held is not None:
        yield close()


def perplexities(docs: DataFrame, shards: int | None = None, texts: DataFrame | None = None) -> DataFrame:
    """(doc_id, lang, perplexity) of each row of docs (doc_id, lang, text, trusted), by the model of the trusted texts.

    texts: the same texts, if they can be had at less cost.
    """
    spark = session_for(docs)
    parts = shuffle_partitions(spark)
    found = (docs if texts is None else texts).select("text").mapInArrow(_frequent, "shard long, data binary")
    found = cut(found.repartition(parts, "shard").sortWithinPartitions("shard").mapInArrow(_frequencies, "word long, n long, size long"))
    total, size = (x or 0 for x in found.where("word is null").agg(F.sum("n"), F.sum("size")).first())
    if shards is None:
        shards = max(parts, -(-size // SHARD))
    named = found.where("word is not null")
    by_n = sorted(named.groupBy("n").count().collect(), reverse=True)  # their number grows with the root of the words'
    least = next((r[0] + 1 for r, words in zip(by_n, np.cumsum([r[1] for r in by_n]), strict=True) if words > HEAD), 0)
    often = named.where(F.col("n") >= least).select("word", "n").toArrow()
    head = Head.of(*(often.column(c).combine_chunks().to_numpy(zero_copy_only=False).astype(np.int64) for c in ("word", "n")), total, shards)
    shared = spark.sparkContext.broadcast(head)
    counted = docs.where("trusted").select("text").mapInArrow(_counted(shared), _ROWS)
    rows = cut(counted.repartition(parts, "shard").sortWithinPartitions("shard").mapInArrow(_summed(shared, KNOWN // shards), _ROWS))
    told = rows.where(F.col("kind") == _WORDS)
    figures = [r[0] for r in rows.where(F.col("kind") == _FIGURE).select("data").collect()]
    if not figures:
        return docs.select("doc_id", "lang", F.lit(None).cast("double").alias("perplexity"))
    if (head.dealt > 1).any():
        pairs = rows.where(F.col("kind") == _PAIRS).repartition(parts, "shard").sortWithinPartitions("shard")
        pairs = cut(pairs.mapInArrow(_paired(shared), _ROWS))
        figures += [r[0] for r in pairs.where(F.col("kind") == _FIGURE).select("data").collect()]
        told = told.unionByName(pairs.where(F.col("kind") == _PAIRS))
    continued = np.zeros(len(head.dealt), np.int64)
    for r in rows.where(F.col("kind") == _NUMBERS).select("data").collect():
        numbers, n = _unpack(r[0])
        continued[numbers] += n
    model = Model(sum(_unpack(x)[0] for x in figures), continued)
    bits = {r[0]: r[1] for r in rows.where(F.col("kind") == _BITS).select("shard", "data").collect()}
    known = spark.sparkContext.broadcast(Known(model, continued, bits, shards))
    model = spark.sparkContext.broadcast(model)
    asked = docs.select("doc_id", "lang", "text", "trusted", F.spark_partition_id().cast("long").alias("task")).mapInArrow(_asked(shared, known), _MESSAGES)
    asked = asked.unionByName(told, allowMissingColumns=True)
    # rows of documents only pass through here, so any partition will do
    dealt = asked.withColumn("dealt", F.when(F.col("kind") == _DOCS, F.xxhash64("chunk")).otherwise(F.col("shard")))
    answered = dealt.repartition(parts, "dealt").drop("dealt").sortWithinPartitions("shard", "kind", "chunk").mapInArrow(_answered(shared, model), _ANSWERS)
    return answered.repartition(parts, "chunk").sortWithinPartitions("chunk", "shard").mapInArrow(_added, "doc_id long, lang string, perplexity double")


def marked(rows: DataFrame, ids: DataFrame, id_col: str, name: str, sent: int = SENT_IDS) -> DataFrame:
    """rows with a boolean column: whether doc_id is among ids (distinct); no row is shuffled if ids are few.

    ids are counted first: up to ``sent`` of them go to all tasks; with more, rows that a
    bitmap finds may be among them are joined by shuffling.
    """
    flag = F.col(id_col).isNotNull()
    if ids.count() <= sent:
        return rows.join(F.broadcast(ids), F.col("doc_id") == F.col(id_col), "left").withColumn(name, flag).drop(id_col)
    maybe = maybe_in(rows, "doc_id", ids, id_col).join(ids, F.col("doc_id") == F.col(id_col), "left").withColumn(name, flag).drop(id_col)
    return maybe.unionByName(never_in(rows, "doc_id", ids, id_col).withColumn(name, F.lit(False)))


def quality(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, sent: int = SENT_IDS) -> DataFrame:
    """(doc_id, perplexity, threshold, kept) of every document; trusted are those labelled good.

    Texts scored by a model but without any threshold (no held-out trusted text) are kept.
    """
    session_for(docs)
    good = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("_good")).where("_good > 0").select(F.col("doc_id").cast("long").alias("_id"))
    good = cut(good)
    rows = docs.select(F.col("doc_id").cast("long"), "lang", "text")
    fold = F.crc32(F.col("_id").cast("string")) % 3
    scored = cut(perplexities(marked(rows, good.where(fold != 1), "_id", "trusted", sent), texts=rows))
    known = marked(scored, good.where(fold == 1), "_id", "held_out", sent).where("held_out")
    limit = F.percentile_approx("perplexity", quantile, 10_000) * MARGIN
    by_lang = known.groupBy("lang").agg(limit.alias("_limit")).withColumnRenamed("lang", "_lang")
    overall = known.agg(limit.alias("_all"))
    joined = scored.join(by_lang, F.col("lang").eqNullSafe(F.col("_lang")), "left").join(F.broadcast(overall), F.lit(True), "left")
    threshold = F.coalesce("_limit", "_all")
    return joined.select("doc_id", "perplexity", threshold.alias("threshold"), F.coalesce(F.col("perplexity") <= threshold, threshold.isNull() & F.col("perplexity").isNotNull()).alias("kept"))
