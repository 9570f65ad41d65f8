"""Vectorised text primitives over Arrow string batches.

Texts are handled as one byte buffer with document offsets, so splitting and
hashing cost a few numpy passes over the bytes instead of a Python call a word.
Buffers are cut into slices of whole documents near ``SLICE_BYTES``; a longer
document is one slice of its own, never a prefix.
"""

from __future__ import annotations

import contextlib
import ctypes
import re
from collections.abc import Iterator
from functools import partial
from itertools import chain

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_M1, _M2, _GOLD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
_JOIN = np.uint64(0xD1342543DE82EF95)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def distinct_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """Different byte strings, compared whole, and which of them each span is; spans ascend and do not overlap.

    Arrow numbers the spans and the gaps between them, so the strings contain those of the gaps, too.
    """
    if not len(starts):
        return [], np.zeros(0, np.int64)
    edges = np.empty(2 * len(starts), np.int64)
    edges[0::2], edges[1::2] = starts, ends
    numbered = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(edges) - 1, [None, pa.py_buffer(edges), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
    return numbered.dictionary.to_pylist(), numbered.indices.to_numpy()[0::2]


#: Masks that keep the first 0 to 8 bytes of a little-endian number.
_KEEP = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def span_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit halves of a hash of each span.

    Spans of at most 16 bytes and one length are mapped one to one (their bytes are two numbers that
    rounds of bijections mix), so different ones never have equal hashes; longer ones have their xxh3-128 digest.
    """
    size = ends - starts
    padded = np.zeros(len(data) + 16, np.uint8)
    padded[: len(data)] = data
    number = np.ndarray((len(data) + 9,), "<u8", buffer=padded, strides=(1,))  # the eight bytes from each place on
    a = number[starts] & _KEEP[np.minimum(size, 8)]
    b = number[starts + 8] & _KEEP[np.clip(size - 8, 0, 8)]
    a ^= size.astype(np.uint64) * _GOLD
    for _ in range(2):
        a = mix(a + b * _JOIN)
        b = mix(b ^ a * _GOLD)
    long = np.flatnonzero(size > 16)
    if len(long):
        from xxhash import xxh3_128_digest

        raw = padded.tobytes()
        digests = b"".join([xxh3_128_digest(raw[x:y]) for x, y in zip(starts[long].tolist(), ends[long].tolist(), strict=True)])
        a[long], b[long] = np.frombuffer(digests, "<u8").reshape(-1, 2).T
    return a, b


def sequence_hash(items: np.ndarray, k: int, lane: int = 0) -> np.ndarray:
    """Hash of each run of ``k`` consecutive 64-bit items (len(items) - k + 1 values).

    Runs of 1, 2, 4 ... items are joined pairwise, with a bijection after each join, so there is
    no polynomial whose differences vanish. Lanes are independent hash functions.
    """
    n = len(items) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    level, made, at, size = mix(items + np.uint64(lane) * _GOLD), None, 0, 1
    while True:
        if k & size:
            part = level[at : at + n]
            made = part if made is None else mix(made * _JOIN + part)
            at += size
        if 2 * size > k:
            return mix(made + np.uint64(k * int(_GOLD) & (1 << 64) - 1))
        level = mix(level[:-size] * _JOIN + level[size:])
        size *= 2


def range_hash(items: np.ndarray, starts: np.ndarray, ends: np.ndarray, lane: int = 0) -> np.ndarray:
    """Hash of each run items[start:end] (not empty) of 64-bit items: a sum of functions of item and place."""
    count = ends - starts
    if not len(count):
        return np.zeros(0, np.uint64)
    first = np.cumsum(count) - count
    place = np.arange(int(count.sum())) - np.repeat(first, count)
    keyed = mix(gather(items, starts, count) + mix((place.astype(np.uint64) + np.uint64(1 + 1000 * lane)) * _GOLD))
    return mix(np.add.reduceat(keyed, first) + count.astype(np.uint64) * _GOLD)


def trim() -> None:
    """Give freed memory back to the system; a worker otherwise keeps its largest use for the next task."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)


def text_slices(column: pa.Array | pa.ChunkedArray, max_bytes: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Yield (first row, end row, bytes, offsets); nulls are empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offs, raw = column.buffers()
    offs = np.frombuffer(offs, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        stop = max(row + 1, int(np.searchsorted(offs, offs[row] + max_bytes, "right")) - 1)
        yield row, stop, data[offs[row] : offs[stop]], offs[row : stop + 1] - offs[row]
        row = stop
    trim()


def words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and document indexes of the maximal runs of non-space bytes."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, none
    space = SPACE[data]
    before, after = np.empty(n, bool), np.empty(n, bool)
    before[0] = after[-1] = True
    before[1:], after[:-1] = space[:-1], space[1:]
    inner = offs[(offs > 0) & (offs < n)]
    before[inner] = True
    after[inner - 1] = True
    solid = ~space
    starts = np.flatnonzero(solid & before)
    ends = np.flatnonzero(solid & after) + 1
    return starts, ends, np.searchsorted(offs, starts, "right") - 1


def gather(flat: np.ndarray, off: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The pieces flat[off:off+count], one after another."""
    upto = np.cumsum(count)
    total = int(upto[-1]) if len(upto) else 0
    return flat[np.arange(total) + np.repeat(off - (upto - count), count)]


def counts_by(doc: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(doc, minlength=n).astype(np.int64)


# A byte after white space that surely begins no white space: ASCII but for
# controls, or a lead byte under which no white-space character lies.
_SOLID = ~SPACE
_SOLID[[*range(0x1C, 0x20), 0x80, 0xC2, 0xE1, 0xE2, 0xE3]] = False
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_MARK = np.zeros(256, bool)
_MARK[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
_LATIN = np.zeros(256, bool)  # second bytes of the letters from U+00C0 to U+00FF
_LATIN[0x80:0xC0] = True
_LATIN[[0x97, 0xB7]] = False


def added_spans(data: np.ndarray, offs: np.ndarray, added: re.Pattern | None) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the strings of added tokens, each within its document."""
    raw, spans = data.tobytes(), []
    if added is not None and added.search(raw):
        for a, b in zip(offs.tolist(), offs[1:].tolist(), strict=False):
            spans += [m.span() for m in added.finditer(raw, a, b)]
    spans = np.array(spans, np.int64).reshape(-1, 2)
    return spans[:, 0], spans[:, 1]


def tokenizer_pieces(data: np.ndarray, offs: np.ndarray, added: re.Pattern | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Starts and documents of the pieces. Texts are cut where no pre-tokenizer match can cross: before the last white
    space of a run that a non-space follows, and between a letter and an ASCII
    mark. Encoding piece by piece then equals encoding the text, for patterns
    that take one space with the next word and keep letters and marks apart. The
    string of an added token is a piece, and texts begin and end beside it, as in the library."""
    n = len(data)
    token, token_end = added_spans(data, offs, added)
    texts, offs = offs, np.unique(np.concatenate([offs, token, token_end])) if len(token) else offs
    cut = np.zeros(n, bool)
    if n:
        cut[:-1] = SPACE[data[:-1]] & _SOLID[data[1:]]
        inner = offs[(offs > 0) & (offs < n)]
        cut[inner - 1] = False  # a document's last byte is followed by another's first
        mark = _MARK[data]
        cut[1:] |= mark[1:] & _LETTER[data[:-1]]
        cut[2:] |= mark[2:] & _LATIN[data[1:-1]] & (data[:-2] == 0xC3)
        for a, b in zip(token.tolist(), token_end.tolist(), strict=True):
            cut[a:b] = False
        cut[offs[:-1][offs[:-1] < offs[1:]]] = True
    starts = np.flatnonzero(cut)
    return starts, np.searchsorted(texts, starts, "right") - 1


def whole_texts(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return offs[:-1], np.arange(len(offs) - 1)


class PieceCache:
    """Works out what belongs to each distinct piece once and keeps it, in bounded memory.

    ``learn`` takes the texts of new pieces and returns for each kind the values of
    all of them one after another, and how many each has. Pieces of at most 16 bytes are known by their two hash
    values and their length, which no two of them share; longer ones, and any that meet another's first
    value, by their bytes. When there are more than ``max_entries``, or longer ones of more than ``max_bytes``,
    all are dropped and learnt again.
    """

    def __init__(self, learn, max_entries: int = 2_000_000, max_bytes: int = 32 << 20, pieces=tokenizer_pieces):
        self.learn, self.max_entries, self.max_bytes, self.pieces = learn, max_entries, max_bytes, pieces
        self._reset()

    def _reset(self) -> None:
        self.keys, self.others, self.sizes, self.places = np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.uint8), np.zeros(0, np.int32)
        self.spelt: dict[bytes, int] = {}
        self.bytes = 0
        self.kinds: dict[str, list[np.ndarray]] = {}

    def _learn(self, raws: list[bytes]) -> np.ndarray:
        """Places of new pieces."""
        at = len(next(iter(self.kinds.values()))[0]) if self.kinds else 0
        for kind, (flat, cnt) in self.learn([x.decode("utf-8", "replace") for x in raws]).items():
            old = self.kinds.get(kind) or [np.zeros(0, np.int64), np.zeros(0, np.int32), flat[:0]]
            self.kinds[kind] = [np.concatenate([old[0], len(old[2]) + np.cumsum(cnt, dtype=np.int64) - cnt]), np.concatenate([old[1], cnt]), np.concatenate([old[2], flat])]
        return np.arange(at, at + len(raws), dtype=np.int32)

    def rows(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Where the values of the pieces (from each start to the next) are kept; holds until the next call."""
        ends = np.append(starts[1:], len(data)).astype(np.int64)
        if len(self.keys) > self.max_entries or self.bytes > self.max_bytes:
            self._reset()
        if not self.kinds:
            self._learn([])
        raw, size = data.tobytes(), ends - starts
        a, b = span_hash(data, starts, ends)
        out = np.full(len(starts), -1, np.int64)
        short = np.flatnonzero(size <= 16)
        if len(short):
            a, b, n = a[short], b[short], size[short].astype(np.uint8)
            numbered = pa.array(a).dictionary_encode()
            which, key = numbered.indices.to_numpy(), numbered.dictionary.to_numpy()
            first = np.empty(len(key), np.int64)
            first[which[::-1]] = np.arange(len(a) - 1, -1, -1)
            at = np.searchsorted(self.keys, key)
            inside = np.minimum(at, max(0, len(self.keys) - 1))
            taken = (self.keys[inside] == key) if len(self.keys) else np.zeros(len(key), bool)
            place = np.full(len(key), -1, np.int64)
            if taken.any():
                same = taken & (self.others[inside] == b[first]) & (self.sizes[inside] == n[first])
                place[same] = self.places[inside[same]]
            if not taken.all():
                new = np.flatnonzero(~taken)
                new = new[np.argsort(key[new])]
                found = first[new]
                place[new] = self._learn([raw[x:y] for x, y in zip(starts[short[found]].tolist(), ends[short[found]].tolist(), strict=True)])
                for name, values in (("keys", key[new]), ("others", b[found]), ("sizes", n[found]), ("places", place[new].astype(np.int32))):
                    setattr(self, name, np.insert(getattr(self, name), at[new], values))
            alike = (b == b[first[which]]) & (n == n[first[which]])
            out[short] = np.where(alike, place[which], -1)
        rest = np.flatnonzero(out < 0)
        if len(rest):
            said = [raw[x:y] for x, y in zip(starts[rest].tolist(), ends[rest].tolist(), strict=True)]
            new = [x for x in dict.fromkeys(said) if x not in self.spelt]
            self.spelt.update(zip(new, self._learn(new).tolist(), strict=True))
            self.bytes += sum(map(len, new)) + 200 * len(new)
            out[rest] = [self.spelt[x] for x in said]
        return out

    def take(self, kind: str, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        off, cnt, flat = self.kinds[kind]
        cnt = cnt[rows].astype(np.int64)
        return gather(flat, off[rows], cnt), cnt

    def documents(self, column, kinds: tuple[str, ...]) -> Iterator[tuple[int, dict[str, tuple[np.ndarray, np.ndarray]]]]:
        """Yield (first row, {kind: (values of a slice of rows, offsets of the rows)})."""
        for row, stop, data, offs in text_slices(column):
            starts, doc = self.pieces(data, offs)
            rows, made = self.rows(data, starts), {}
            for kind in kinds:
                flat, cnt = self.take(kind, rows)
                per_doc = np.bincount(doc, weights=cnt, minlength=stop - row).astype(np.int64)
                made[kind] = flat, np.concatenate([[0], np.cumsum(per_doc)])
            yield row, made


_HELD: dict[tuple, object] = {}


def only(key: tuple, make=lambda: None):
    """What a worker keeps between its tasks: one operator's tables and caches at a time."""
    if key not in _HELD:
        _HELD.clear()
        trim()
        _HELD[key] = make()
    return _HELD[key]


def library_encoder(path: str, added_tokens: bool = False) -> PieceCache:
    """The worker's cache of ids for a tokenizers file.

    With ``added_tokens`` the strings of added tokens in texts become their ids, as the library
    does by default; otherwise they are ordinary text.
    """

    def make() -> PieceCache:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        tok.encode_special_tokens = not added_tokens
        tokens = tok.get_added_tokens_decoder().values() if added_tokens else ()
        pieces = tokenizer_pieces
        if any(t.normalized or t.lstrip or t.rstrip or t.single_word for t in tokens):  # these depend on the text around them
            pieces = whole_texts
        elif tokens:
            pieces = partial(tokenizer_pieces, added=re.compile(b"|".join(re.escape(x) for x in sorted((t.content.encode() for t in tokens), key=len, reverse=True))))

        def learn(texts: list[str]) -> dict:
            flat, cnt = [np.zeros(0, np.uint32)], [np.zeros(0, np.int32)]
            for at in range(0, len(texts), 8192):  # encodings are many times the size of their ids
                found = [e.ids for e in tok.encode_batch_fast(texts[at : at + 8192], add_special_tokens=False)]
                cnt.append(np.fromiter(map(len, found), np.int32, len(found)))
                flat.append(np.fromiter(chain.from_iterable(found), np.uint32, int(cnt[-1].sum())))
            return {"ids": (np.concatenate(flat), np.concatenate(cnt))}

        return PieceCache(learn, pieces=pieces)

    return only(("tokenizers", path, added_tokens), make)


def encode_documents(column, encoder: PieceCache) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Yield (first row, ids of a slice of rows, id offsets of those rows)."""
    for row, made in encoder.documents(column, ("ids",)):
        yield row, *made["ids"]
