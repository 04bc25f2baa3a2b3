"""Baseline JPEG columns: lossless payload storage, Huffman decoding and DC thumbnails.

A payload (bytes, padded with 0 to a positive multiple of 64) is stored 64 bytes a block as
the quantized coefficients of a grey baseline JPEG, each byte as a signed 8-bit number, in
zigzag order. Coefficients are entropy-coded without loss, so the stored bytes give the
payload back. Blocks are laid out nearly square; blocks of zeros fill the last row. A restart
marker follows each block, so scans decode in lockstep: all intervals of all images of a
batch at once, one coefficient of each a step.

The reader parses the markers of any baseline JPEG (8-bit, Huffman, any sampling and number
of components, with or without restart intervals, one scan or several) and rebuilds a
luminance thumbnail of one pixel a block from the DC coefficients alone. A feature is
``WIDTHxHEIGHT:SHA:DHASH``: the image's dimensions, the first 16 hex digits of the SHA-256 of
the thumbnail and a 64-bit difference hash of it.

Defined results: a null or empty text is a payload of 64 zero bytes; rows that repeat a
doc_id are stored each; columns besides doc_id and text are ignored. Bytes that aren't a
baseline JPEG raise ValueError.
"""

from __future__ import annotations

import hashlib
import math
import re
import struct
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lexgrove.llm.scratch import session_for
from lexgrove.llm.textcols import slices, text_bytes

UNIT = 64
#: Bytes of text coded at once, so that the work arrays stay in the processor's cache.
RUN = 1 << 18
_MARK = re.compile(rb"\xff[^\x00\xd0-\xd7\xff]")
_COMMENT = b"payload-bytes="

# Code lengths of the writer's own Huffman tables, short for the bytes of prose:
# DC by size of the value; AC by run << 4 | size.
_DC_BITS = {7: 1, 6: 2, 5: 4, 8: 4, 4: 5, 0: 6, 1: 6, 2: 6, 3: 6}
_AC_BITS = {0x07: 1, 0x06: 2, 0x08: 4, 0x04: 5, 0x05: 5, 0x00: 6, 0x01: 7, 0x02: 7, 0x03: 7, 0xF0: 8} | {run << 4 | size: 12 for run in range(1, 16) for size in range(1, 9)}


def _canonical(bits: dict[int, int]) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The table as a DHT segment has it, and code and length by symbol."""
    order = sorted(bits, key=lambda s: (bits[s], s))
    code, length, codes = 0, 0, np.zeros(256, np.uint64)
    for symbol in order:
        code <<= bits[symbol] - length
        length = bits[symbol]
        codes[symbol] = code
        code += 1
    counts = bytes(sum(b == n for b in bits.values()) for n in range(1, 17))
    lengths = np.zeros(256, np.uint64)
    lengths[list(bits)] = list(bits.values())
    return counts + bytes(order), codes, lengths


_DC_TABLE, _DC_CODE, _DC_LENGTH = _canonical(_DC_BITS)
_AC_TABLE, _AC_CODE, _AC_LENGTH = _canonical(_AC_BITS)
_VALUES = np.arange(-128, 128)
_SIZE = np.array([int(abs(v)).bit_length() for v in _VALUES], np.uint64)  # by value + 128
_EXTRA = np.where(_VALUES < 0, _VALUES + (1 << _SIZE.astype(np.int64)) - 1, _VALUES).astype(np.uint64)


def _coded(code: np.ndarray, length: np.ndarray, run: int) -> tuple[np.ndarray, np.ndarray]:
    """Code with the value's own bits, and their number, by the coefficient as an unsigned byte."""
    symbol = _SIZE.astype(np.int64) | run << 4
    return np.roll(code[symbol] << _SIZE | _EXTRA, 128), np.roll(np.where(length[symbol] > 0, length[symbol] + _SIZE, 0), 128)


_DC_ENTRY, _DC_ENTRY_BITS = _coded(_DC_CODE, _DC_LENGTH, 0)
_AC_ENTRY, _AC_ENTRY_BITS = (np.stack(x) for x in zip(*(_coded(_AC_CODE, _AC_LENGTH, r) for r in range(16)), strict=True))
_ZRL, _ZRL_BITS = int(_AC_CODE[0xF0]), int(_AC_LENGTH[0xF0])
_LEAD = np.array([sum(_ZRL << _ZRL_BITS * i for i in range(k)) for k in range(4)], np.uint64)
_DENSE_BITS = _AC_ENTRY_BITS[0].astype(np.uint8)


def _segment(mark: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, mark, len(body) + 2) + body


@lru_cache(maxsize=4096)
def _layout(blocks: int) -> tuple[int, int]:
    wide = math.isqrt(blocks - 1) + 1
    wide = max(wide, -(-blocks // 8191))
    high = -(-blocks // wide)
    if wide > 8191:
        raise ValueError("a payload of more than 4 GB does not fit in one JPEG")
    return wide, high


@lru_cache(maxsize=4096)
def _header(wide: int, high: int) -> bytes:
    return b"".join(
        (
            b"\xff\xd8",
            _segment(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0"),
            _segment(0xDB, b"\0" + b"\1" * 64),
            _segment(0xC0, struct.pack(">BHHB3B", 8, high * 8, wide * 8, 1, 1, 0x11, 0)),
            _segment(0xC4, b"\0" + _DC_TABLE),
            _segment(0xC4, b"\x10" + _AC_TABLE),
            _segment(0xDD, b"\0\1"),
        )
    )


_SCAN = _segment(0xDA, b"\1\1\0\0\x3f\0")


def _dense_entries(blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entries (n, 17) and their bits of blocks whose AC coefficients are all non-zero; four coefficients an entry."""
    value = _AC_ENTRY[0][blocks]
    bits = _DENSE_BITS[blocks]
    value[:, 0], bits[:, 0] = _DC_ENTRY[blocks[:, 0]], _DC_ENTRY_BITS[blocks[:, 0]]
    for _ in range(2):
        right = bits[:, 1::2]
        value = value[:, ::2] << right.astype(np.uint64) | value[:, 1::2]
        bits = bits[:, ::2] + right
    return value, bits.astype(np.int64)


def _sparse_entries(blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entries (n, 65) and their bits of any blocks: coefficients with the zeros before them, and the end of block."""
    some = blocks[:, 1:] > 0
    before = np.zeros(blocks.shape, np.int64)
    before[:, 1:] = np.maximum.accumulate(np.where(some, np.arange(1, UNIT), 0), 1)
    run = np.arange(1, UNIT) - before[:, :-1] - 1
    own = _AC_ENTRY_BITS[run & 15, blocks[:, 1:]]
    value, bits = np.zeros((len(blocks), UNIT + 1), np.uint64), np.zeros((len(blocks), UNIT + 1), np.int64)
    value[:, 0], bits[:, 0] = _DC_ENTRY[blocks[:, 0]], _DC_ENTRY_BITS[blocks[:, 0]]
    value[:, 1:UNIT] = np.where(some, _LEAD[run >> 4] << own | _AC_ENTRY[run & 15, blocks[:, 1:]], 0)
    bits[:, 1:UNIT] = np.where(some, own.astype(np.int64) + _ZRL_BITS * (run >> 4), 0)
    open_end = before[:, -1] < UNIT - 1
    value[open_end, UNIT], bits[open_end, UNIT] = _AC_CODE[0], _AC_LENGTH[0]
    return value, bits


def _entropy_code(coefficients: np.ndarray, last: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scan bytes of blocks (n, 64) of coefficients as unsigned bytes, and each block's first byte.

    last: whether a block ends its image; number: its place there. Each block is an interval.
    """
    dense = (coefficients[:, 1:] > 0).all(1)
    count = np.where(dense, UNIT // 4 + 1, UNIT + 2)
    first = np.cumsum(count) - count
    v, flat = np.zeros(int(count.sum()), np.uint64), np.zeros(int(count.sum()), np.int64)
    size_bytes = np.zeros(len(coefficients), np.int64)
    for own, entries in ((np.flatnonzero(dense), _dense_entries), (np.flatnonzero(~dense), _sparse_entries)):
        if len(own):
            value, bits = entries(coefficients[own])
            place = first[own, None] + np.arange(value.shape[1] + 1)
            total = bits.sum(1)
            pad = -total % 8  # with ones
            v[place[:, :-1]], flat[place[:, :-1]] = value, bits
            v[place[:, -1]], flat[place[:, -1]] = (1 << pad) - 1, pad
            size_bytes[own] = (total + pad) // 8
    # entries go on end; each meets one 64-bit word or two
    to = np.cumsum(flat)
    words = np.zeros(int(to[-1]) // 64 + 2, np.uint64)
    at = to - flat
    word, room = at >> 6, 64 - (at & 63) - flat
    fits = np.where(room >= 0, v << np.maximum(room, 0).astype(np.uint64), v >> np.maximum(-room, 0).astype(np.uint64))
    first = np.concatenate(([0], np.flatnonzero(np.diff(word)) + 1))
    words[word[first]] = np.bitwise_or.reduceat(fits, first)
    over = np.flatnonzero(room < 0)
    words[word[over] + 1] |= v[over] << (64 + room[over]).astype(np.uint64)
    data = words.byteswap().view(np.uint8)[: int(to[-1]) // 8]
    # stuff a 0 after each 255 and a restart marker after each block but an image's last
    ends = np.cumsum(size_bytes) - 1
    stuffed = data == 255
    added = stuffed.astype(np.int64)
    added[ends[~last]] += 2
    place = np.arange(len(data)) + np.cumsum(added) - added
    out = np.zeros(len(data) + int(added.sum()), np.uint8)
    out[place] = data
    mark = place[ends[~last]] + 1 + stuffed[ends[~last]]
    out[mark] = 255
    out[mark + 1] = 0xD0 + number[~last] % 8
    return out, place[np.concatenate(([0], ends[:-1] + 1))]


def encode(data: np.ndarray, offsets: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """JPEGs of payloads, given as bytes on end with offsets, each padded to whole blocks here.

    Returns them and the payloads' padded sizes.
    """
    sizes = np.diff(offsets)
    blocks = np.maximum(1, -(-sizes // UNIT))
    shapes = [_layout(b) for b in blocks.tolist()]
    cells = np.array([w * h for w, h in shapes], np.int64)
    starts = np.concatenate(([0], np.cumsum(cells)))
    held = np.zeros(int(starts[-1]) * UNIT, np.uint8)
    for a, b, to in zip(offsets[:-1].tolist(), offsets[1:].tolist(), (starts[:-1] * UNIT).tolist(), strict=True):
        held[to : to + b - a] = data[a:b]
    last = np.zeros(int(starts[-1]), bool)
    last[starts[1:] - 1] = True
    number = np.arange(int(starts[-1])) - np.repeat(starts[:-1], cells)
    scan, first = _entropy_code(held.reshape(-1, UNIT), last, number)
    edges = [*first[starts[:-1]].tolist(), len(scan)]
    out = [
        b"".join((_header(w, h), _segment(0xFE, _COMMENT + str(n * UNIT).encode()), _SCAN, scan[a:b].tobytes(), b"\xff\xd9"))
        for (w, h), n, a, b in zip(shapes, blocks.tolist(), edges, edges[1:], strict=False)
    ]
    return out, blocks * UNIT


@dataclass
class Scan:
    components: tuple[int, ...]
    tables: tuple[tuple[bytes, bytes], ...]  # DC and AC of each component
    interval: int
    data: bytes


@dataclass
class Picture:
    width: int = 0
    height: int = 0
    factors: tuple[tuple[int, int], ...] = ()  # horizontal and vertical, by component
    quantizers: dict[int, np.ndarray] = field(default_factory=dict)
    quantizer_of: tuple[int, ...] = ()
    comment: bytes = b""
    scans: list[Scan] = field(default_factory=list)
    coefficients: dict[int, np.ndarray] = field(default_factory=dict)  # by component: (rows, columns, 64)


def parse(data: bytes) -> Picture:
    """Markers of a baseline JPEG; scans stay coded."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG: no start marker")
    out, tables, ids, interval, at = Picture(), {}, (), 0, 2
    while True:
        while data[at : at + 2] == b"\xff\xff":
            at += 1
        if len(data) < at + 2 or data[at] != 0xFF:
            raise ValueError("not a JPEG: a marker is missing")
        mark = data[at + 1]
        if mark == 0xD9:
            break
        size = int.from_bytes(data[at + 2 : at + 4])
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if mark == 0xDB:
            while body:
                wide, slot = body[0] >> 4, body[0] & 15
                out.quantizers[slot] = np.frombuffer(body, ">u2" if wide else "u1", 64, 1).astype(np.int64)
                body = body[1 + 64 * (1 + wide) :]
        elif mark == 0xC0:
            depth, out.height, out.width, n = struct.unpack(">BHHB", body[:6])
            if depth != 8:
                raise ValueError("samples are not of 8 bits")
            ids = tuple(body[6 + 3 * i] for i in range(n))
            out.factors = tuple((body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15) for i in range(n))
            out.quantizer_of = tuple(body[8 + 3 * i] for i in range(n))
        elif 0xC1 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
            raise ValueError("not a baseline JPEG")
        elif mark == 0xC4:
            while body:
                n = 17 + sum(body[1:17])
                tables[body[0]] = body[1:n]
                body = body[n:]
        elif mark == 0xDD:
            interval = int.from_bytes(body)
        elif mark == 0xFE:
            out.comment = body
        elif mark == 0xDA:
            found = _MARK.search(data, at)
            if not found:
                raise ValueError("not a JPEG: the scan does not end")
            own = [(ids.index(body[1 + 2 * i]), body[2 + 2 * i]) for i in range(body[0])]
            out.scans.append(Scan(tuple(c for c, _ in own), tuple((tables[t >> 4], tables[16 | t & 15]) for _, t in own), interval, data[at : found.start()]))
            at = found.start()
    if not out.scans:
        raise ValueError("not a JPEG: it has no scan")
    return out


@lru_cache(maxsize=64)
def _lookup(table: bytes) -> tuple[np.ndarray, np.ndarray]:
    """By the next 16 bits: code length << 8 | symbol, 0 where no code fits; and the value << 16 |
    symbol << 8 | bits of code and value, 0 where they don't fit into 16."""
    out, code, at = np.zeros(1 << 16, np.uint16), 0, 16
    for length in range(1, 17):
        for _ in range(table[length - 1]):
            low = code << (16 - length)
            out[low : low + (1 << (16 - length))] = length << 8 | table[at]
            code, at = code + 1, at + 1
        code <<= 1
    length, symbol = (out >> 8).astype(np.int64), (out & 255).astype(np.int64)
    size = symbol & 15
    shift = 16 - length - size
    value = np.arange(1 << 16) >> np.maximum(shift, 0) & (1 << size) - 1
    value = np.where((size > 0) & (value >> np.maximum(size - 1, 0) == 0), value - (1 << size) + 1, value)
    return out, np.where((length > 0) & (shift >= 0), value << 16 | symbol << 8 | length + size, 0)


def _intervals(scans: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all scans without stuffing and markers, first byte of each interval, and intervals by scan."""
    raw = np.frombuffer(b"".join(scans) + b"\0", np.uint8)
    full = np.flatnonzero(raw[:-1] == 255)
    after = raw[full + 1]
    marks = full[(after >= 0xD0) & (after <= 0xD7)]
    keep = np.ones(len(raw), bool)
    keep[-1] = False
    keep[full[after == 0] + 1] = False
    keep[full[after == 255]] = False
    keep[marks] = keep[marks + 1] = False
    begins = np.cumsum([0, *map(len, scans)])
    starts = np.sort(np.concatenate((begins[:-1], marks + 2)))
    kept_before = np.cumsum(keep) - keep
    counts = np.diff(np.searchsorted(starts, begins))
    return raw[keep], kept_before[starts], counts


def _decode(data: np.ndarray, starts: np.ndarray, units: np.ndarray, plan: list[tuple[int, bytes, bytes]]) -> np.ndarray:
    """Coefficients (intervals, units, blocks of a unit, 64) in zigzag order, DC differences summed.

    plan: component, DC table and AC table of each block of a unit. All intervals go in step.
    """
    padded = np.concatenate((data, np.zeros(16, np.uint8))).astype(np.uint64)
    window = np.zeros(len(data) + 8, np.uint64)
    for i in range(8):
        window = window << np.uint64(8) | padded[i : i + len(window)]
    most = int(units.max())
    out = np.zeros((len(starts), most, len(plan), UNIT), np.int16)
    at = starts.astype(np.int64) * 8
    limit = len(data) * 8 + 63
    bit7, top = np.uint64(7), np.uint64(48)

    def long_value(bits: np.ndarray, found: np.ndarray) -> np.ndarray:
        length, size = (found >> 8).astype(np.uint64), (found & 15).astype(np.uint64)
        if not length.all():
            raise ValueError("the scan has a code that its table lacks")
        value = ((bits << length) >> (np.uint64(64) - size)).astype(np.int64)
        size = size.astype(np.int64)
        value -= np.where(value >> np.maximum(size - 1, 0) == 0, (1 << size) - 1, 0)
        return value << 16 | (found & 255).astype(np.int64) << 8 | length.astype(np.int64) + size

    def next_value(place: np.ndarray, tables: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        if len(place) and place.max() >= limit:
            raise ValueError("the scan is cut short")
        bits = window[place >> 3] << (place.view(np.uint64) & bit7)
        peek = bits >> top
        found = tables[1][peek]
        if not found.all():
            rest = np.flatnonzero(found == 0)
            found[rest] = long_value(bits[rest], tables[0][peek[rest]])
        return found

    flat = out.reshape(-1)
    for unit in range(most):
        rows = np.flatnonzero(units > unit)
        place = at[rows]
        for block, (_, dc, ac) in enumerate(plan):
            base = ((rows * most + unit) * len(plan) + block) * UNIT
            found = next_value(place, _lookup(dc))
            place += found & 255
            flat[base] = found >> 16
            tables, live, here, to = _lookup(ac), None, place, base + 1
            while len(here):  # one coefficient of each interval; live: rows that go on, if not all
                found = next_value(here, tables)
                here += found & 255
                symbol = found >> 8 & 255
                to += symbol >> 4
                size = symbol & 15
                own = base if live is None else base[live]
                if (to - own >= UNIT).any():
                    over = to - own >= UNIT
                    if (size[over] > 0).any():
                        raise ValueError("a block has more than 64 coefficients")
                if size.all():
                    flat[to] = found >> 16
                    going = None
                else:
                    store = size > 0
                    flat[to[store]] = found[store] >> 16
                    going = store | (symbol == 0xF0)
                to += 1
                full = to - own == UNIT
                if full.any():
                    going = ~full if going is None else going & ~full
                if going is not None and not going.all():
                    if live is None:
                        live = np.arange(len(here))
                    place[live] = here
                    live, here, to = live[going], here[going], to[going]
        at[rows] = place
    for component in {c for c, _, _ in plan}:
        own = [i for i, p in enumerate(plan) if p[0] == component]
        dc = out[:, :, own, 0].astype(np.int64).reshape(len(starts), -1)
        out[:, :, own, 0] = np.cumsum(dc, 1).reshape(len(starts), most, len(own))
    return out


def decode(files: list[bytes]) -> list[Picture]:
    """Pictures with their coefficients; scans with equal tables are decoded together."""
    pictures = [parse(f) for f in files]
    groups = defaultdict(list)
    for picture in pictures:
        for scan in picture.scans:
            groups[scan.components, scan.tables, tuple(picture.factors[c] for c in scan.components)].append((picture, scan))
    for (components, tables, factors), members in groups.items():
        alone = len(components) == 1
        plan = [(c, *t) for c, t, (h, v) in zip(components, tables, factors, strict=True) for _ in range(1 if alone else h * v)]
        shapes = []
        for picture, _ in members:
            h, v = (max(f[i] for f in picture.factors) for i in (0, 1))
            if alone:
                fh, fv = factors[0]
                across, down = -(-picture.width * fh // (8 * h)), -(-picture.height * fv // (8 * v))
            else:
                across, down = -(-picture.width // (8 * h)), -(-picture.height // (8 * v))
            shapes.append((across, down))
        data, starts, counts = _intervals([s.data for _, s in members])
        units = []
        for (across, down), (_, scan), count in zip(shapes, members, counts.tolist(), strict=True):
            every = scan.interval or across * down
            if count != -(-across * down // every):
                raise ValueError("restart markers don't match the interval")
            units += [every] * (count - 1) + [across * down - every * (count - 1)]
        found = _decode(data, starts, np.array(units), plan)
        at = 0
        for (across, down), (picture, _), count in zip(shapes, members, counts.tolist(), strict=True):
            own = found[at : at + count]
            own = own.reshape(-1, len(plan), UNIT)[: across * down] if count == 1 or own.shape[1] * (count - 1) < across * down else own
            own = own.reshape(-1, len(plan), UNIT)[: across * down]
            at += count
            block = 0
            for c, (h, v) in zip(components, factors, strict=True):
                h, v = (1, 1) if alone else (h, v)
                part = own[:, block : block + h * v].reshape(down, across, v, h, UNIT).swapaxes(1, 2)
                picture.coefficients[c] = part.reshape(down * v, across * h, UNIT)
                block += h * v
    return pictures


def thumbnail(picture: Picture) -> np.ndarray:
    """Luminance of each 8x8 block, from the DC coefficients of the first component."""
    h, v = (max(f[i] for f in picture.factors) for i in (0, 1))
    fh, fv = picture.factors[0]
    scale = picture.quantizers[picture.quantizer_of[0]][0]
    dc = picture.coefficients[0][: -(-picture.height * fv // (8 * v)), : -(-picture.width * fh // (8 * h)), 0]
    return np.clip((dc * scale + 4) // 8 + 128, 0, 255).astype(np.uint8)


def difference_hash(image: np.ndarray) -> int:
    """64 bits: whether brightness rises between neighbouring cells of an 8 x 9 grid of the image."""
    rows = (np.arange(8) * 2 + 1) * image.shape[0] // 16
    columns = (np.arange(9) * 2 + 1) * image.shape[1] // 18
    cells = image[rows[:, None], columns]
    return int.from_bytes(np.packbits(cells[:, 1:] > cells[:, :-1]).tobytes())


def feature(picture: Picture) -> str:
    image = thumbnail(picture)
    return f"{picture.width}x{picture.height}:{hashlib.sha256(image.tobytes()).hexdigest()[:16]}:{difference_hash(image):016x}"


def payload(picture: Picture) -> bytes:
    """The bytes that encode stored."""
    if not picture.comment.startswith(_COMMENT):
        raise ValueError("not written by encode")
    return picture.coefficients[0].astype(np.int8).tobytes()[: int(picture.comment[len(_COMMENT) :])]


_STORED = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text", RUN):
            data, offsets = text_bytes(part.column("text"))
            files, _ = encode(data, offsets)
            read = decode(files)
            back = [payload(p) for p in read]
            columns = [
                part.column("doc_id"),
                pa.array(np.diff(offsets)),
                pa.array([len(x) for x in back], pa.int64()),
                pa.array([hashlib.sha256(x).hexdigest() for x in back]),
                pa.array([zlib.crc32(x[-64:]) for x in back], pa.int64()),
                pa.array([len(x) for x in files], pa.int64()),
                pa.array([hashlib.sha256(x).hexdigest() for x in files]),
                pa.array([feature(p) for p in read]),
            ]
            yield pa.record_batch(columns, [c.split()[0] for c in _STORED.split(", ")])


def media_digests(docs: DataFrame) -> DataFrame:
    """Store each text as a JPEG, read it back, and describe both; see _STORED for the columns."""
    session_for(docs)
    return docs.select("doc_id", "text").mapInArrow(_store, _STORED)


def media_files(docs: DataFrame) -> DataFrame:
    """(doc_id, media): each text's JPEG."""
    session_for(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", RUN):
                files, _ = encode(*text_bytes(part.column("text")))
                yield pa.record_batch([part.column("doc_id"), pa.array(files, pa.binary())], ["doc_id", "media"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, media binary")
