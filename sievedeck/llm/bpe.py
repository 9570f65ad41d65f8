"""Byte-level BPE by recursive DuckDB queries in each partition.

Texts are cut into the pre-tokenizer's matches; each distinct match is a word whose
token-position rows, at first one a byte, a recursive query joins with the merge table, to
contract each word's leftmost pair of least rank until no pair merges. A word's rows are kept as a
list between steps, so a step costs a hash join and a minimum, words without a pair leave the
recursion, and only the last state of each word is held. Decoding joins rows with the
vocabulary and puts the bytes together by an ordered aggregation.

Words of more than ``SEGMENT`` bytes are contracted by segments, so that the work grows with their
length, not with its square. Between two neighbouring segments the encoding of the whole equals
both encodings side by side if the last token of the one and the first of the other, encoded together,
give these two tokens again: merges left and right of a boundary go on independently
until a pair across it is the least, and whether one ever is hangs on the two tokens next to it alone. Where
the test fails, tokens around the boundary are encoded anew as one segment, with its own boundaries
to test, twice as many in each round.

Defined results: null and empty texts have no ids and decode to nothing; equal
texts have equal ids; an empty table gives an empty result; only the named
columns are read. Unknown ids raise an error in decoding.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievedeck.llm.textvec import SLICE_BYTES, only
from sievedeck.session import ensure_importable

#: Bytes of a segment of a long word; bytes of the words of a query; words a worker's cache holds (twice); words decoded by a query.
SEGMENT, BLOCK_BYTES, KNOWN_WORDS, DECODED = 64, 400_000, 400_000, 50_000

_ENCODE = """
WITH RECURSIVE state(word, tokens) USING KEY (word) AS (
  SELECT word, tokens FROM starting
  UNION
  SELECT word, list_concat(list_append(tokens[:best % 4294967296 - 1], (best // 4294967296)::INT), tokens[best % 4294967296 + 2:])
  FROM state JOIN (
    SELECT word, min(merged * 4294967296 + pos) AS best
    FROM (SELECT word, unnest(tokens)::BIGINT * 4294967296 + unnest(tokens[2:]) AS pair, generate_subscripts(tokens, 1) AS pos FROM state)
    JOIN merges USING (pair) GROUP BY word
  ) USING (word)
)
SELECT tokens FROM state ORDER BY word
"""
_DECODE = """
SELECT seq, string_agg(hex, '' ORDER BY pos) AS hex, string_agg(said, '' ORDER BY pos) AS decimal
FROM given LEFT JOIN vocabulary USING (token) GROUP BY seq ORDER BY seq
"""


def read_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a tiktoken file."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def merge_table(ranks: dict[bytes, int]) -> pa.Table:
    """pair (first * 2**32 + second) and merged: every pair of tokens whose bytes together are a token."""
    rows = [
        ((a << 32) + b, merged)
        for token, merged in ranks.items() for i in range(1, len(token))
        if (a := ranks.get(token[:i])) is not None and (b := ranks.get(token[i:])) is not None
    ]
    return pa.table({name: pa.array([r[k] for r in rows], pa.int64()) for k, name in enumerate(("pair", "merged"))})


class DuckBpe:
    """The merge table and vocabulary in one in-memory DuckDB of a worker, and the words it met lately."""

    def __init__(self, ranks_path: str, pattern: str):
        import duckdb
        import regex

        ranks = read_ranks(ranks_path)
        self.db = duckdb.connect()
        self.db.execute("SET threads = 1")
        self.db.execute("SET memory_limit = '512MB'")
        self.db.register("given_merges", merge_table(ranks))
        self.db.execute("CREATE TABLE merges AS SELECT * FROM given_merges")
        self.db.register("given_vocabulary", pa.table({"token": pa.array(ranks.values(), pa.int32()), "hex": [t.hex() for t in ranks], "said": [f"{i} " for i in ranks.values()]}))
        self.db.execute("CREATE TABLE vocabulary AS SELECT * FROM given_vocabulary")
        self.bytes = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.said = {i: t for t, i in ranks.items()}
        self.pattern = regex.compile(pattern)
        # What a word's ids are in decimal (a space after each), and the bytes they decode to.
        self.known: dict[str, tuple[str, bytes]] = {}
        self.before: dict[str, tuple[str, bytes]] = {}

    def _query(self, name: str, table: pa.Table, sql: str) -> pa.Table:
        self.db.register(name, table)
        out = self.db.sql(sql).to_arrow_table()
        self.db.unregister(name)
        return out

    def _contract(self, words: list[bytes]) -> pa.ChunkedArray:
        """Ids of words (none empty), a block a query."""
        out: list[pa.Array] = []
        at = 0
        while at < len(words):
            stop, size = at, 0
            while stop < len(words) and (stop == at or size + len(words[stop]) <= BLOCK_BYTES):
                size += len(words[stop])
                stop += 1
            tokens = pa.array(self.bytes[np.frombuffer(b"".join(words[at:stop]), np.uint8)])
            offsets = pa.array(np.cumsum([0, *map(len, words[at:stop])]), pa.int32())
            out += self._query("starting", pa.table({"word": np.arange(stop - at, dtype=np.int32), "tokens": pa.ListArray.from_arrays(offsets, tokens)}), _ENCODE)["tokens"].chunks
            at = stop
        return pa.chunked_array(out, pa.list_(pa.int32()))

    def _joined(self, tokens: list[int]) -> bytes:
        return b"".join(map(self.said.__getitem__, tokens))

    def _by_segments(self, words: list[bytes]) -> list[list[int]]:
        """Ids of long words; each has its tokens so far and its untested boundaries with the tokens to take on either side."""
        cut = [[w[a : a + SEGMENT] for a in range(0, len(w), SEGMENT)] for w in words]
        made = iter(self._contract(list(chain.from_iterable(cut))).to_pylist())
        tokens: list[list[int]] = []
        untested: list[dict[int, int]] = []
        for parts in cut:
            own, edges = [], {}
            for _ in parts:
                if own:
                    edges[len(own)] = 4
                own += next(made)
            tokens.append(own)
            untested.append(edges)
        holds: dict[tuple[int, int], bool] = {}
        while any(untested):
            new = {(t[b - 1], t[b]) for t, edges in zip(tokens, untested, strict=True) for b in edges} - holds.keys()
            pairs = sorted(new)
            for pair, ids in zip(pairs, self._contract([self._joined(list(p)) for p in pairs]).to_pylist(), strict=True):
                holds[pair] = ids == list(pair)
            windows: list[tuple[int, int, int, int]] = []  # word, first and end token, and reach of the next round
            for k, (t, edges) in enumerate(zip(tokens, untested, strict=True)):
                for b, reach in sorted(edges.items()):
                    if holds[t[b - 1], t[b]]:
                        continue
                    a, z = max(0, b - reach), min(len(t), b + reach)
                    if windows and windows[-1][0] == k and windows[-1][2] >= a:
                        a, reach = windows[-1][1], max(reach, windows[-1][3] // 2)
                        z = max(z, windows.pop()[2])
                    windows.append((k, a, z, 2 * reach))
            again = self._contract([self._joined(tokens[k][a:z]) for k, a, z, _ in windows]).to_pylist()
            untested = [{} for _ in words]
            pieces: dict[int, list[int]] = {}
            done: dict[int, int] = {}
            for (k, a, z, reach), ids in zip(windows, again, strict=True):
                own = pieces.setdefault(k, [])
                own += tokens[k][done.get(k, 0) : a]
                if a:
                    untested[k][len(own)] = reach
                own += ids
                if z < len(tokens[k]):
                    untested[k][len(own)] = reach
                done[k] = z
            for k, own in pieces.items():
                tokens[k] = own + tokens[k][done[k] :]
        return tokens

    def encode_words(self, words: list[bytes]) -> pa.Array:
        """Lists of ids of words, none of them empty."""
        long = [k for k, w in enumerate(words) if len(w) > SEGMENT]
        if not long:
            return self._contract(words).combine_chunks()
        short = [k for k, w in enumerate(words) if len(w) <= SEGMENT]
        made = [*self._contract([words[k] for k in short]).chunks, pa.array(self._by_segments([words[k] for k in long]), pa.list_(pa.int32()))]
        return pa.concat_arrays(made).take(pa.array(np.argsort(short + long)))

    def decode(self, sequences: pa.Array) -> tuple[list[bytes], list[str]]:
        """The bytes of each list of ids, and the ids in decimal, a space after each; an empty or null one has none."""
        lengths = pc.fill_null(pc.list_value_length(sequences), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        raw, decimal = [b""] * len(lengths), [""] * len(lengths)
        for a in range(0, len(lengths), DECODED):
            own = lengths[a : a + DECODED]
            seq = np.repeat(np.arange(a, a + len(own)), own)
            if len(seq):
                pos = np.arange(len(seq)) - np.repeat(np.cumsum(own) - own, own)
                made = self._query("given", pa.table({"seq": seq, "pos": pos, "token": pc.list_flatten(sequences.slice(a, DECODED)).cast(pa.int32())}), _DECODE)
                for k, x, d in zip(*(made[c].to_pylist() for c in ("seq", "hex", "decimal")), strict=True):
                    raw[k], decimal[k] = bytes.fromhex(x), d
        return raw, decimal

    def _learn(self, words: list[str]) -> None:
        old = [w for w in words if w in self.before]
        self.known.update(zip(old, map(self.before.pop, old), strict=True))
        new = [w for w in words if w not in self.known]
        if new:
            raw, decimal = self.decode(self.encode_words([w.encode() for w in new]))
            self.known.update(zip(new, zip(decimal, raw, strict=True), strict=True))

    def documents(self, texts: list[str | None]) -> Iterator[tuple[str, bytes]]:
        """For each text its ids in decimal, a space after each, and the bytes they decode to."""
        at = 0
        while at < len(texts):
            stop, size, found = at, 0, []
            while stop < len(texts) and (stop == at or size < SLICE_BYTES):
                found.append(self.pattern.findall(texts[stop] or ""))
                size += len(texts[stop] or "")
                stop += 1
            if len(self.known) > KNOWN_WORDS:  # the older words go but for those that are met again
                self.before, self.known = self.known, {}
            self._learn(sorted(set(chain.from_iterable(found)) - self.known.keys()))
            for matches in found:
                own = [self.known[m] for m in matches]
                yield "".join([x[0] for x in own]), b"".join([x[1] for x in own])
            at = stop


def worker_bpe(ranks_path: str, pattern: str) -> DuckBpe:
    return only(("bpe", ranks_path, pattern), lambda: DuckBpe(ranks_path, pattern))


def bpe_encode(df: DataFrame, ranks_path: str, pattern: str, text_col: str = "text", out_col: str = "ids") -> DataFrame:
    """Add the ids of each text as an array."""
    ensure_importable(df.sparkSession)

    @F.pandas_udf("array<int>")
    def encode(texts):
        import pandas as pd

        return pd.Series([list(map(int, decimal.split())) for decimal, _ in worker_bpe(ranks_path, pattern).documents(list(texts))])

    return df.withColumn(out_col, encode(F.col(text_col)))


def bpe_decode(df: DataFrame, ranks_path: str, pattern: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """Add the bytes that the ids stand for; null ids give no bytes."""
    ensure_importable(df.sparkSession)

    @F.pandas_udf("binary")
    def decode(ids):
        import pandas as pd

        return pd.Series(worker_bpe(ranks_path, pattern).decode(pa.array(ids, pa.list_(pa.int32())))[0])

    return df.withColumn(out_col, decode(F.col(ids_col)))


def bpe_round_trip(df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document, without its ids leaving the worker."""
    ensure_importable(df.sparkSession)

    def run(batches):
        for batch in batches:
            out = ([], [], [])
            for decimal, raw in worker_bpe(ranks_path, pattern).documents(batch.column(1).to_pylist()):
                out[0].append(decimal.count(" "))
                out[1].append(hashlib.sha256(decimal[:-1].encode()).hexdigest())
                out[2].append(hashlib.sha256(raw).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out[0], pa.int64()), pa.array(out[1], pa.string()), pa.array(out[2], pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
