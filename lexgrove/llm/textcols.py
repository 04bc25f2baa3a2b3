"""Word and shingle hashes of whole Arrow text columns, in numpy.

Words are ``[^\\x20\\x09-\\x0D]+`` of the UTF-8 bytes with A-Z lower-cased.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
SHINGLE = 5
_BLOCK = 1 << 20
_PLACE = 0x9E3779B97F4A7C15
_rng = np.random.default_rng(20240229)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64)[_LOWER]
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_TURN = _rng.integers(1, 2**63, SHINGLE, dtype=np.uint64) | U(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every output bit depends on every input bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
        return x ^ (x >> U(31))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The column's UTF-8 bytes on end and each row's offsets; nulls are empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if len(column) == 0 or column.buffers()[2] is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows with about ``most`` bytes of the column; a long row is a run."""
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    run = np.cumsum(size.astype(np.int64)) // most
    cuts = [0, *(np.flatnonzero(np.diff(run)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b > a:
            yield batch.slice(a, b - a)


def gathered(batches: Iterator[pa.RecordBatch], column: str, most: int, rows: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    """The batches joined to some with about ``most`` bytes of the column, or ``rows`` rows."""
    held: list[pa.RecordBatch] = []
    size = count = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        own = pc.sum(pc.binary_length(batch.column(column))).as_py() or 0
        if held and (size + own > most or count + batch.num_rows > rows):
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size, count = [], 0, 0
        held.append(batch)
        size, count = size + own, count + batch.num_rows
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end byte of each word; rows bound words too."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    starts, ends = inside.copy(), inside.copy()
    starts[1:] &= ~inside[:-1] | edge[1:-1]
    ends[:-1] &= ~inside[1:] | edge[1:-1]
    return np.flatnonzero(starts), np.flatnonzero(ends) + 1


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word, and for each row the number of words before it.

    Each pair of a byte and its place in the word has a mixed value of its own; a word's hash is
    the mixed sum of them, so that no pattern of bytes cancels out.
    """
    starts, ends = word_spans(data, offsets)
    out = np.empty(len(starts), np.uint64)
    at = 0
    with np.errstate(over="ignore"):
        while at < len(starts):
            low = starts[at]
            to = max(at + 1, int(np.searchsorted(ends, low + _BLOCK, "right")))
            high = ends[to - 1]
            s, e = starts[at:to] - low, ends[at:to] - low
            begun = np.zeros(high - low, np.int64)
            begun[s] = s
            place = np.arange(high - low) - np.maximum.accumulate(begun)
            total = np.empty(high - low + 1, np.uint64)
            total[0] = 0
            np.cumsum(mix(_BYTE[data[low:high]] + place.astype(np.uint64) * U(_PLACE)), out=total[1:])
            out[at:to] = mix(total[e] - total[s] + (e - s).astype(np.uint64))
            at = to
    return out, np.searchsorted(starts, offsets)


def shingles(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """Each row's sorted distinct hashes of five words on end.

    A row of one to four words has one, of all its words; a row without words none.
    """
    words, first = word_hashes(data, offsets)
    many = max(0, len(words) - SHINGLE + 1)
    with np.errstate(over="ignore"):
        rolled = np.zeros(many, np.uint64)
        for k in range(SHINGLE):
            rolled += words[k : k + many] * _TURN[k]
        rolled = mix(rolled)
        out = []
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if b - a >= SHINGLE:
                own = np.sort(rolled[a : b - SHINGLE + 1])
                out.append(own[np.concatenate(([True], own[1:] != own[:-1]))])
            elif b > a:
                short = (words[a:b] * _TURN[: b - a]).sum(dtype=np.uint64) + U(b - a)
                out.append(mix(np.array([short ^ U(0xA5A5A5A5)], np.uint64)))
            else:
                out.append(np.zeros(0, np.uint64))
    return out
