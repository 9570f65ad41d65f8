"""Progressive JPEG in numpy: media columns and their decoding to RGB tensors.

The decoder accumulates spectral-selection and successive-approximation scans into
coefficient arrays, dequantises and inverse-transforms them by one matrix product,
repeats subsampled chroma and converts to RGB. Entropy-coded segments
(restart intervals) of all images of a batch that share a scan script are decoded
in lockstep, one vector lane each, so the Python loop runs over symbols and not
over blocks. Images without restart markers decode by the same code with a lane each.

The encoder writes coefficients without loss. ``payload_media`` uses it to keep
any bytes: byte b is the coefficient b - ZERO, 64 bytes are a block in zigzag
order, all quantisers are 1; luma blocks come first, then Cb, then Cr, and a comment
segment holds the number of bytes.

Defined results: null and empty texts are one block of zero bytes; equal texts have
equal media and features; very long texts get wider images (up to 65520 pixels square); an empty
table gives an empty result; only the named columns are read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievedeck.llm.textvec import text_slices
from sievedeck.session import ensure_importable

ZERO = 109  # the byte that becomes coefficient 0; small letters lie near it
MOST_ROWS = 4095  # MCU rows of an image: 16 * 4095 < 65536
_U = np.uint64

# Scans of the encoder: components, first and last coefficient, high and low bit.
SCRIPT = (
    ((0, 1, 2), 0, 0, 0, 1),
    ((0,), 1, 5, 0, 1),
    ((0,), 6, 63, 0, 0),
    ((1,), 1, 63, 0, 0),
    ((2,), 1, 63, 0, 0),
    ((0, 1, 2), 0, 0, 1, 0),
    ((0,), 1, 5, 1, 0),
)


def zigzag() -> np.ndarray:
    """Place in the 8 x 8 block of each coefficient in zigzag order."""
    cells = [(y, x) for y in range(8) for x in range(8)]
    cells.sort(key=lambda c: (c[0] + c[1], c[0] if (c[0] + c[1]) % 2 else c[1]))
    return np.array([8 * y + x for y, x in cells])


def _inverse_transform() -> np.ndarray:
    """From 64 coefficients in zigzag order to 64 samples, as one matrix."""
    u = np.arange(8)
    basis = np.cos((2 * u[None, :] + 1) * u[:, None] * np.pi / 16) / 2
    basis[0] /= np.sqrt(2)
    return np.kron(basis, basis)[zigzag()]


_IDCT = _inverse_transform()


def _code_table(frequent: list[int], short: int, rest: list[int], long: int) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """A Huffman table of two code lengths: its DHT body, codes and lengths by symbol, lookup by 16 bits."""
    counts = [0] * 16
    counts[short - 1], counts[long - 1] = len(frequent), len(rest)
    body = bytes(counts) + bytes([*frequent, *rest])
    return (body, *_read_table(body)[:3])


def _read_table(body: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    counts, codes, lengths = body[:16], np.zeros(256, np.uint64), np.zeros(256, np.int64)
    lookup = np.zeros(1 << 16, np.uint16)
    code, at = 0, 16
    for length in range(1, 17):
        for _ in range(counts[length - 1]):
            symbol = body[at]
            codes[symbol], lengths[symbol] = code, length
            lookup[code << (16 - length) : (code + 1) << (16 - length)] = length << 8 | symbol
            code, at = code + 1, at + 1
        code <<= 1
    return codes, lengths, lookup, at


_DC = _code_table(list(range(12)), 4, [], 16)
_FREQUENT = [0x01, 0x02, 0x03, 0x04, 0x05, 0x06, 0x07, 0x00]
_AC = _code_table(_FREQUENT, 4, [s for s in range(256) if s not in _FREQUENT], 9)


def _bit_size(x: np.ndarray) -> np.ndarray:
    return np.frexp(np.abs(x).astype(np.float32))[1].astype(np.int64)


def _signed_bits(v: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.where(v < 0, v + (1 << size) - 1, v).astype(np.uint64)


class Geometry:
    """4:2:0 images of ``mcus`` units each: where blocks stand, for a batch of images."""

    def __init__(self, mcus: np.ndarray):
        self.mcus = mcus
        self.cols = -(-mcus // MOST_ROWS)
        self.rows = -(-mcus // self.cols)
        self.units = self.cols * self.rows

    def scan_order(self, component: int, interleaved: bool) -> np.ndarray:
        """Block numbers (in raster order, images one after another) as a scan takes them."""
        per = 4 if component == 0 else 1
        n = int(self.units.sum()) * per
        if not interleaved or component or (self.cols == 1).all():
            return np.arange(n)
        out, base = [], 0
        for cols, rows in zip(self.cols.tolist(), self.rows.tolist(), strict=True):
            grid = base + np.arange(4 * cols * rows).reshape(rows, 2, cols, 2)
            out.append(grid.transpose(0, 2, 1, 3).reshape(-1))
            base += 4 * cols * rows
        return np.concatenate(out)


def _pack(codes: np.ndarray, lengths: np.ndarray, segment: np.ndarray, n_segments: int, image_segments: np.ndarray) -> list[bytes]:
    """Entropy-coded data of every image: its segments padded, stuffed, joined by RST markers."""
    bits = np.bincount(segment, weights=lengths, minlength=n_segments).astype(np.int64)
    size = -(-bits // 8)
    first = np.cumsum(size) - size
    upto = np.cumsum(lengths) - lengths
    start = np.cumsum(bits) - bits
    pos = 8 * first[segment] + upto - start[segment]
    word, shift = pos >> 5, (64 - (pos & 31) - lengths).astype(np.uint64)
    value = codes << shift
    total = int(size.sum())
    n_words = total // 4 + 2
    made = np.bincount(word, (value >> _U(32)).astype(np.float64), n_words) + np.bincount(word + 1, (value & _U(0xFFFFFFFF)).astype(np.float64), n_words + 1)[:n_words]
    raw = made.astype(np.uint32).byteswap().view(np.uint8)[:total].copy()
    raw[first + size - 1] |= ((1 << (8 * size - bits)) - 1).astype(np.uint8)
    end = first + size - 1
    last = np.cumsum(image_segments) - 1
    marked = np.ones(n_segments, bool)
    marked[last] = False
    room = 1 + (raw == 0xFF).astype(np.int64)
    room[end[marked]] += 2
    at = np.cumsum(room) - room
    out = np.zeros(int(room.sum()), np.uint8)
    out[at] = raw
    number = np.arange(n_segments) - np.repeat(last + 1 - image_segments, image_segments)
    tail = (at + room - 2)[end[marked]]
    out[tail], out[tail + 1] = 0xFF, 0xD0 + number[marked] % 8
    data, edges = out.tobytes(), np.append(0, (at + room)[end[last]]).tolist()
    return [data[a:b] for a, b in zip(edges, edges[1:], strict=False)]


def _dc_codes(values: np.ndarray, per: np.ndarray, high: int, low: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes of DC values whose prediction starts anew where ``per`` is True."""
    if high:
        return (values.astype(np.int64) >> low & 1).astype(np.uint64), np.ones(len(values), np.int64)
    v = values.astype(np.int64) >> low
    diff = np.diff(v, prepend=0)
    diff[per] = v[per]
    size = _bit_size(diff)
    return _DC[1][size] << size.astype(np.uint64) | _signed_bits(diff, size), _DC[2][size] + size


def _ac_first_codes(band: np.ndarray, low: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes, lengths and block numbers of the first scan of a band."""
    n, width = band.shape
    v = band if not low else np.sign(band) * (np.abs(band) >> low)
    block, k = np.nonzero(v)
    value = v[block, k].astype(np.int64)
    before = np.empty_like(k)
    before[:1], before[1:] = -1, k[:-1]
    before[np.flatnonzero(np.diff(block, prepend=-1))] = -1
    run = k - before - 1
    skips, run = run >> 4, run & 15
    full = np.zeros(n, bool)
    full[block[k == width - 1]] = True
    eob = ~full
    eobs_before = np.cumsum(eob) - eob
    upto = np.cumsum(skips + 1)
    at = upto - 1 + eobs_before[block]
    total = (int(upto[-1]) if len(upto) else 0) + int(eob.sum())
    codes = np.full(total, _AC[1][0xF0])
    lengths = np.full(total, _AC[2][0xF0])
    owner = np.bincount(block, skips + 1, n).astype(np.int64) + eob
    size = _bit_size(value)
    symbol = run << 4 | size
    codes[at] = _AC[1][symbol] << size.astype(np.uint64) | _signed_bits(value, size)
    lengths[at] = _AC[2][symbol] + size
    at = (np.cumsum(owner) - 1)[eob]
    codes[at], lengths[at] = _AC[1][0], _AC[2][0]
    return codes, lengths, np.repeat(np.arange(n), owner)


def _ac_refine_codes(band: np.ndarray, low: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of a refinement scan: each symbol, then correction bits of the known coefficients it passes."""
    n, width = band.shape
    magnitude = np.abs(band).astype(np.int64) >> low
    known, new = magnitude > 1, magnitude == 1
    zero = magnitude == 0
    lines = lambda a: np.cumsum(a, axis=1, dtype=np.int64)
    known_upto, zero_upto = lines(known), lines(zero)

    def at_last_new(count: np.ndarray) -> np.ndarray:
        """The count at the last new coefficient before each place."""
        held = np.maximum.accumulate(np.where(new, count, 0), axis=1)
        return np.hstack([np.zeros((n, 1), np.int64), held[:, :-1]])

    zeros = zero_upto - zero - at_last_new(zero_upto)  # since the last new one
    skips = np.where(new, zeros >> 4, 0)
    symbols = lines(np.where(new, skips + 1, 0))
    symbols_before = symbols - np.where(new, skips + 1, 0)
    later = lines(new)[:, -1:] - lines(new) > 0
    trailing = width - 1 - np.where(new.any(1), width - 1 - np.argmax(new[:, ::-1], axis=1), -1) > 0
    owner = known_upto[:, -1] + symbols[:, -1] + trailing
    base = np.cumsum(owner) - owner
    codes, lengths = np.full(int(owner.sum()), _AC[1][0xF0]), np.full(int(owner.sum()), _AC[2][0xF0])
    b, k = np.nonzero(known)
    at = base[b] + known_upto[b, k] - 1 + symbols_before[b, k] + 1 + np.where(later[b, k], zeros[b, k] >> 4, 0)
    codes[at], lengths[at] = (magnitude[b, k] & 1).astype(np.uint64), 1
    b, k = np.nonzero(new)
    passed = at_last_new(known_upto)[b, k]
    for j in np.flatnonzero(zeros[b, k] > 15):  # place the skips among the correction bits
        row = int(b[j])
        start = int(zero_upto[row, k[j]]) - int(zeros[row, k[j]])
        for m in range(int(skips[row, k[j]])):
            codes[p := base[row] + passed[j] + symbols_before[row, k[j]] + m], lengths[p] = _AC[1][0xF0], _AC[2][0xF0]
            passed[j] = known_upto[row, int(np.searchsorted(zero_upto[row], start + 16 * (m + 1)))]
    at = base[b] + passed + symbols[b, k] - 1
    symbol = (zeros[b, k] & 15) << 4 | 1
    codes[at] = _AC[1][symbol] << _U(1) | (band[b, k] > 0).astype(np.uint64)
    lengths[at] = _AC[2][symbol] + 1
    rows = np.flatnonzero(trailing)
    last = np.where(new, known_upto, 0).max(axis=1)[rows]
    at = base[rows] + last + symbols[rows, -1]
    codes[at], lengths[at] = _AC[1][0], _AC[2][0]
    return codes, lengths, np.repeat(np.arange(n), owner)


def _marker(kind: int, body: bytes) -> bytes:
    return bytes([0xFF, kind]) + (len(body) + 2).to_bytes(2, "big") + body


def encode_images(planes: list[np.ndarray], geometry: Geometry, comments: list[bytes]) -> list[bytes]:
    """JPEG files of a batch; planes: coefficients (blocks x 64, zigzag) of Y, Cb, Cr, images one after another."""
    units = geometry.units
    scans: list[list[bytes]] = []
    for components, lo, hi, high, low in SCRIPT:
        if lo == 0:
            order = [geometry.scan_order(c, True) for c in components]
            values = np.hstack([planes[c][o, 0].reshape(-1, 4 if c == 0 else 1) for c, o in zip(components, order, strict=True)])
            anew = np.zeros(values.shape, bool)
            anew[:, [0, 4, 5]] = True
            codes, lengths = _dc_codes(values.reshape(-1), anew.reshape(-1), high, low)
            segment = np.repeat(np.arange(len(values)), 6)
            scans.append(_pack(codes, lengths, segment, len(values), units))
        else:
            band = planes[components[0]][:, lo : hi + 1]
            codes, lengths, segment = (_ac_refine_codes if high else _ac_first_codes)(band, low)
            scans.append(_pack(codes, lengths, segment, len(band), units * (4 if components[0] == 0 else 1)))
    tables = _marker(0xDB, bytes([0]) + bytes([1] * 64))
    tables += _marker(0xC4, bytes([0x00]) + _DC[0]) + _marker(0xC4, bytes([0x10]) + _AC[0]) + _marker(0xDD, (1).to_bytes(2, "big"))
    heads = [_marker(0xDA, bytes([len(cs), *(x for c in cs for x in (c + 1, 0)), lo, hi, high << 4 | low])) for cs, lo, hi, high, low in SCRIPT]
    out = []
    for k, comment in enumerate(comments):
        frame = _marker(0xC2, bytes([8]) + int(16 * geometry.rows[k]).to_bytes(2, "big") + int(16 * geometry.cols[k]).to_bytes(2, "big") + bytes([3, 1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0]))
        out.append(b"\xff\xd8" + _marker(0xFE, comment) + tables + frame + b"".join(h + s[k] for h, s in zip(heads, scans, strict=True)) + b"\xff\xd9")
    return out


class _Parsed:
    """Headers of a file and where its scans lie."""

    def __init__(self, raw: bytes):
        data = np.frombuffer(raw, np.uint8)
        if raw[:2] != b"\xff\xd8":
            raise ValueError("not a JPEG file")
        ff = np.flatnonzero(data[:-1] == 0xFF)
        ends = ff[(data[ff + 1] != 0) & (data[ff + 1] != 0xFF) & ((data[ff + 1] < 0xD0) | (data[ff + 1] > 0xD7))]
        self.comment, self.quantisers, tables, interval, at = b"", {}, {}, 0, 2
        self.scans: list[tuple] = []
        while True:
            if raw[at] != 0xFF:
                raise ValueError("a marker is missing")
            kind = raw[at + 1]
            if kind == 0xFF:
                at += 1
                continue
            if kind == 0xD9:
                break
            size = int.from_bytes(raw[at + 2 : at + 4], "big")
            body, at = raw[at + 4 : at + 2 + size], at + 2 + size
            if kind == 0xFE:
                self.comment = body
            elif kind == 0xDB:
                while body:
                    wide = body[0] >> 4
                    n = 64 * (1 + wide)
                    self.quantisers[body[0] & 15] = np.frombuffer(body[1 : 1 + n], ">u2" if wide else "u1").astype(np.int64)
                    body = body[1 + n :]
            elif kind == 0xC4:
                while body:
                    n = 17 + sum(body[1:17])
                    tables[body[0]] = body[1:n]
                    body = body[n:]
            elif kind == 0xDD:
                interval = int.from_bytes(body, "big")
            elif kind == 0xC2:
                self.height, self.width = (int.from_bytes(body[k : k + 2], "big") for k in (1, 3))
                self.components = tuple((body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(body[5]))
            elif 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
                raise ValueError("not a progressive Huffman-coded JPEG file")
            elif kind == 0xDA:
                n = body[0]
                ids = [c[0] for c in self.components]
                parts = tuple((ids.index(body[1 + 2 * k]), tables.get(body[2 + 2 * k] >> 4), tables.get(0x10 | body[2 + 2 * k] & 15)) for k in range(n))
                lo, hi, bits = body[1 + 2 * n : 4 + 2 * n]
                end = int(ends[np.searchsorted(ends, at)])
                self.scans.append((parts, lo, hi, bits >> 4, bits & 15, interval, at, end))
                at = end
        self.raw = raw
        self.key = self.components, tuple(s[:6] for s in self.scans)
        h, v = (max(c[k] for c in self.components) for k in (1, 2))
        self.units = -(-self.width // (8 * h)), -(-self.height // (8 * v))  # interleaved MCUs across and down
        self.grids = [(self.units[0] * c[1], self.units[1] * c[2]) for c in self.components]
        self.own = [(-(--(-self.width * c[1] // h) // 8), -(--(-self.height * c[2] // v) // 8)) for c in self.components]


_LOOKUPS: dict[bytes, np.ndarray] = {}


def _lookup(body: bytes) -> np.ndarray:
    if body not in _LOOKUPS:
        _LOOKUPS[body] = _read_table(body)[2]
    return _LOOKUPS[body]


class _Lanes:
    """Bit readers over many segments at once."""

    def __init__(self, images: list[_Parsed], scan: int):
        parts = [np.frombuffer(p.raw, np.uint8, p.scans[scan][7] - p.scans[scan][6], p.scans[scan][6]) for p in images]
        data = np.concatenate(parts)
        sizes = np.array([len(p) for p in parts])
        after = np.append(data[1:], 0)
        after[np.cumsum(sizes) - 1] = 0
        ff = data == 0xFF
        restart = ff & (after >= 0xD0) & (after <= 0xD7)
        keep = ~restart
        keep[1:] &= ~restart[:-1] & ~(ff[:-1] & (after[:-1] == 0))
        kept_before = np.cumsum(keep) - keep
        first = np.cumsum(sizes) - sizes
        starts = np.sort(np.concatenate([first, np.flatnonzero(restart) + 2]))
        self.image = np.searchsorted(first, starts, "right") - 1
        clean = np.append(data[keep], np.zeros(16, np.uint8))
        self.bit = 8 * np.append(kept_before, int(keep.sum()))[starts]
        window = clean[:-7].astype(np.uint64)
        for k in range(1, 8):
            window = window << _U(8) | clean[k : len(clean) - 7 + k]
        self.window, self.end = window, 8 * (len(window) - 1)

    def peek(self, bit: np.ndarray) -> np.ndarray:
        """64 bits from each position, of which the first 57 are sound."""
        if len(bit) and int(bit.max()) > self.end:
            raise ValueError("entropy-coded data ends early")
        return self.window[bit >> 3] << (bit & 7).astype(np.uint64)


def _extend(bits: np.ndarray, size: np.ndarray) -> np.ndarray:
    v = bits.astype(np.int64)
    return np.where(v < (1 << size >> 1), v - (1 << size) + 1, v)


def _take(word: np.ndarray, skip: np.ndarray, size: np.ndarray) -> np.ndarray:
    return (word << skip.astype(np.uint64) >> _U(1)) >> (63 - size).astype(np.uint64)


def _dc_step(reader: _Lanes, lanes: np.ndarray, blocks: np.ndarray, plane: np.ndarray, predicted: np.ndarray, table: bytes, high: int, low: int) -> None:
    bit = reader.bit[lanes]
    word = reader.peek(bit)
    if high:
        plane[blocks, 0] |= ((word >> _U(63)).astype(np.int64) << low).astype(plane.dtype)
        reader.bit[lanes] = bit + 1
        return
    entry = _lookup(table)[word >> _U(48)].astype(np.int64)
    length, size = entry >> 8, entry & 255
    predicted[lanes] += _extend(_take(word, length, size), size)
    plane[blocks, 0] = predicted[lanes] << low
    reader.bit[lanes] = bit + length + size


def _ac_first_step(reader: _Lanes, lanes: np.ndarray, blocks: np.ndarray, plane: np.ndarray, pending: np.ndarray, table: bytes, lo: int, hi: int, low: int) -> None:
    skipped = pending[lanes] > 0
    if skipped.any():
        pending[lanes[skipped]] -= 1
        lanes, blocks = lanes[~skipped], blocks[~skipped]
    lookup, flat = _lookup(table), plane.reshape(-1)
    bit, row, k = reader.bit[lanes], blocks * 64, np.full(len(lanes), lo)
    while len(lanes):
        word = reader.peek(bit)
        entry = lookup[word >> _U(48)].astype(np.int64)
        length, run, size = entry >> 8, entry >> 4 & 15, entry & 15
        k += run
        if len(k) and int(k.max()) > 63 + 15:
            raise ValueError("a run leaves its block")
        value = _extend(_take(word, length, size), size) << low
        some = size > 0
        bit += length + size
        if some.all():
            flat[row + k] = value
            done = k >= hi
        else:
            at = np.flatnonzero(some)
            flat[row[at] + k[at]] = value[at]
            ended = ~some & (run < 15)
            long = np.flatnonzero(ended & (run > 0))
            if len(long):
                pending[lanes[long]] = (1 << run[long]) - 1 + _take(word[long], length[long], run[long]).astype(np.int64)
                bit[long] += run[long]
            done = ended | (k >= hi)
        k += 1
        if done.any():
            reader.bit[lanes[done]] = bit[done]
            go = ~done
            lanes, bit, row, k = lanes[go], bit[go], row[go], k[go]


def _ac_refine_step(reader: _Lanes, lanes: np.ndarray, blocks: np.ndarray, plane: np.ndarray, pending: np.ndarray, table: bytes, lo: int, hi: int, low: int) -> None:
    lookup, n = _lookup(table), len(lanes)
    bit, ended = reader.bit[lanes], pending[lanes] > 0
    run, value, wanting = np.zeros(n, np.int64), np.zeros(n, np.int64), ~ended
    for k in range(lo, hi + 1):
        at = np.flatnonzero(wanting & ~ended)
        if len(at):
            word = reader.peek(bit[at])
            entry = lookup[word >> _U(48)].astype(np.int64)
            length, r, s = entry >> 8, entry >> 4 & 15, entry & 15
            stop = (s == 0) & (r < 15)
            extra = np.where(stop, r, s)
            bits = _take(word, length, extra).astype(np.int64)
            bit[at] += length + extra
            pending[lanes[at[stop]]] = (1 << r[stop]) + bits[stop]
            ended[at[stop]] = True
            run[at], value[at] = r, np.where(s > 0, np.where(bits > 0, 1, -1) << low, 0)
            wanting[at] = False
        c = plane[blocks, k].astype(np.int64)
        at = np.flatnonzero(c)
        if len(at):
            up = (reader.peek(bit[at]) >> _U(63)).astype(bool) & (np.abs(c[at]) >> low & 1 == 0)
            c[at] += np.where(up, np.sign(c[at]) << low, 0)
            bit[at] += 1
        here = (plane[blocks, k] == 0) & ~ended
        put = here & (run == 0)
        c[put] = value[put]
        plane[blocks, k] = c
        wanting |= put
        run[here & ~put] -= 1
    reader.bit[lanes] = bit
    pending[lanes[ended]] -= 1


def _coefficients(images: list[_Parsed]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each component: coefficients of all images' blocks, and the first block of each image."""
    planes = []
    for c in range(len(images[0].components)):
        sizes = np.array([p.grids[c][0] * p.grids[c][1] for p in images])
        planes.append((np.zeros((int(sizes.sum()), 64), np.int32), np.cumsum(sizes) - sizes))
    for number, (parts, lo, hi, high, low, interval, _, _) in enumerate(images[0].scans):
        reader, single = _Lanes(images, number), parts[0][0]
        shape = [p.own[single] if len(parts) == 1 else p.units for p in images]
        across, total = np.array([s[0] for s in shape]), np.array([s[0] * s[1] for s in shape])
        image = reader.image
        nth = np.arange(len(image)) - np.searchsorted(image, image)
        begin = nth * interval
        count = np.minimum(total[image] - begin, interval or 1 << 62)
        if (np.bincount(image, count, len(images)) != total).any():
            raise ValueError("restart markers do not fit the image")
        predicted = {c: np.zeros(len(image), np.int64) for c, _, _ in parts}
        pending = np.zeros(len(image), np.int64)
        for step in range(int(count.max())):
            lanes = np.flatnonzero(count > step)
            unit = begin[lanes] + step
            y, x = np.divmod(unit, across[image[lanes]])
            for c, dc, ac in parts:
                plane, base = planes[c]
                h, v = images[0].components[c][1:3] if len(parts) > 1 else (1, 1)
                wide = np.array([p.grids[c][0] for p in images])[image[lanes]]
                for dy in range(v):
                    for dx in range(h):
                        blocks = base[image[lanes]] + (y * v + dy) * wide + x * h + dx
                        if lo == 0:
                            _dc_step(reader, lanes, blocks, plane, predicted[c], dc, high, low)
                        else:
                            (_ac_refine_step if high else _ac_first_step)(reader, lanes, blocks, plane, pending, ac, lo, hi, low)
    return planes


def _samples(image: _Parsed, c: int, pixels: np.ndarray) -> np.ndarray:
    """A component's samples at full resolution (chroma repeated)."""
    wide, tall = image.grids[c]
    plane = pixels.reshape(tall, wide, 8, 8).transpose(0, 2, 1, 3).reshape(8 * tall, 8 * wide)
    h, v = (max(x[k] for x in image.components) // image.components[c][k] for k in (1, 2))
    if v > 1:
        plane = np.repeat(plane, v, axis=0)
    if h > 1:
        plane = np.repeat(plane, h, axis=1)
    return plane[: image.height, : image.width]


class Decoded:
    """An image as coefficients by component, comment, and full-resolution RGB (height x width x 3, uint8)."""

    def __init__(self, comment: bytes, coefficients: list[np.ndarray], rgb: np.ndarray):
        self.comment, self.coefficients, self.rgb = comment, coefficients, rgb


def decode_images(files: list[bytes]) -> list[Decoded]:
    """Decode progressive JPEG files; those of one scan script run in lockstep."""
    parsed = [_Parsed(f) for f in files]
    alike: dict[tuple, list[int]] = defaultdict(list)
    for k, p in enumerate(parsed):
        alike[p.key].append(k)
    out: list = [None] * len(files)
    for members in alike.values():
        images = [parsed[k] for k in members]
        planes = _coefficients(images)
        # The small shift settles exact ties alike whatever the order of summation.
        pixels = []
        for c, (plane, _) in enumerate(planes):
            scaled = plane if all((p.quantisers[p.components[c][3]] == 1).all() for p in images) else plane * np.repeat([p.quantisers[p.components[c][3]] for p in images], [p.grids[c][0] * p.grids[c][1] for p in images], axis=0)
            pixels.append(np.clip(np.floor(scaled.astype(np.float64) @ _IDCT + (128.5 + 1e-6)), 0, 255).astype(np.float32))
        for j, k in enumerate(members):
            p = images[j]
            spans = [slice(int(base[j]), int(base[j]) + p.grids[c][0] * p.grids[c][1]) for c, (_, base) in enumerate(planes)]
            full = [_samples(p, c, pixels[c][spans[c]]) for c in range(len(planes))]
            if len(full) == 3:
                y, cb, cr = full[0], full[1] - 128, full[2] - 128
                full = [y + np.float32(1.402) * cr, y - np.float32(0.344136) * cb - np.float32(0.714136) * cr, y + np.float32(1.772) * cb]
            else:
                full = [full[0]] * 3
            rgb = np.clip(np.rint(np.stack(full, axis=2)), 0, 255).astype(np.uint8)
            out[k] = Decoded(p.comment, [planes[c][0][spans[c]] for c in range(len(planes))], rgb)
    return out


def payload_media(texts: list[bytes]) -> list[bytes]:
    """A progressive JPEG for each payload, which it holds without loss."""
    sizes = np.array([len(t) for t in texts], np.int64)
    blocks = np.maximum(1, -(-sizes // 64))
    geometry = Geometry(-(-blocks // 6))
    units = geometry.units
    if (16 * geometry.cols > 65_520).any():
        raise ValueError("a payload is too large for one JPEG file")
    room = np.full(int(units.sum()) * 384, ZERO, np.uint8)
    first = (np.cumsum(units) - units) * 384
    for at, text in zip(first.tolist(), texts, strict=True):
        padded = -(-max(1, len(text)) // 64) * 64
        room[at : at + len(text)] = np.frombuffer(text, np.uint8)
        room[at + len(text) : at + padded] = 0
    values = room.astype(np.int32).reshape(-1, 64) - ZERO
    image = np.repeat(np.arange(len(texts)), units * 6)
    within = np.arange(len(values)) - np.repeat(first // 64, units * 6)
    luma = within < 4 * units[image]
    cb = ~luma & (within < 5 * units[image])
    planes = [values[luma], values[cb], values[~luma & ~cb]]
    return encode_images(planes, geometry, [int(s).to_bytes(8, "big") for s in sizes])


def read_payload(image: Decoded) -> tuple[bytes, int]:
    """The padded payload that an image holds, and its length without the padding."""
    n = int.from_bytes(image.comment, "big")
    raw = (np.concatenate(image.coefficients) + ZERO).astype(np.uint8).tobytes()
    return raw[: max(64, -(-n // 64) * 64)], n


def media_feature(rgb: np.ndarray) -> str:
    """Size, mean and deviation of each channel in thousandths, and a checksum of the tensor."""
    flat = rgb.reshape(-1, 3).astype(np.int64)
    n, total, squares = len(flat), flat.sum(0), (flat * flat).sum(0)
    mean, spread = total * 1000 // n, np.sqrt(squares * n - total * total) * 1000 // n
    return f"{rgb.shape[1]}x{rgb.shape[0]} mean " + ",".join(map(str, mean.tolist())) + " sd " + ",".join(str(int(x)) for x in spread.tolist()) + f" crc {zlib.crc32(np.ascontiguousarray(rgb)):08x}"


def with_media(df: DataFrame, text_col: str = "text", out_col: str = "media") -> DataFrame:
    """Add the progressive JPEG that holds each text's UTF-8 bytes."""
    ensure_importable(df.sparkSession)

    @F.pandas_udf("binary")
    def make(texts):
        import pandas as pd

        out: list[bytes] = []
        for row, stop, data, offs in text_slices(pa.array(texts, pa.string()), 1 << 19):
            raw = data.tobytes()
            out += payload_media([raw[offs[k] : offs[k + 1]] for k in range(stop - row)])
        return pd.Series(out, dtype=object)

    return df.withColumn(out_col, make(F.col(text_col)))


def _some(files: list[bytes], most: int = 1 << 19):
    """Runs of files of about half a megabyte."""
    at = 0
    while at < len(files):
        stop, size = at, 0
        while stop < len(files) and (stop == at or size + len(files[stop]) <= most):
            size += len(files[stop])
            stop += 1
        yield files[at:stop]
        at = stop


def decode_media(df: DataFrame, media_col: str = "media") -> DataFrame:
    """Replace ``media_col`` by a struct of height, width and the RGB tensor's bytes, all null where it is null."""
    ensure_importable(df.sparkSession)

    @F.pandas_udf("struct<height: int, width: int, rgb: binary>")
    def decode(media):
        import pandas as pd

        some = media[media.notna()]
        made = [x.rgb for part in _some(list(some)) for x in decode_images(part)]
        rows = pd.DataFrame({"height": [x.shape[0] for x in made], "width": [x.shape[1] for x in made], "rgb": [x.tobytes() for x in made]}, index=some.index)
        return rows.reindex(media.index)

    return df.withColumn(media_col, decode(F.col(media_col)))


def media_features(df: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """What the stored media hold: payload, its digests, and the feature of the RGB tensor."""
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            rows = []
            for part in _some(batch.column(1).to_pylist()):
                for file, image in zip(part, decode_images(part), strict=True):
                    payload, n = read_payload(image)
                    rows.append((n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(file), hashlib.sha256(file).hexdigest(), media_feature(image.rgb)))
            columns = list(zip(*rows, strict=True)) or [()] * 7
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=names)

    return df.select(F.col(id_col).alias("doc_id"), F.col(media_col).alias("media")).mapInArrow(run, f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
