"""Substring deduplication by relative Lempel-Ziv parsing.

The corpus is cut into reference blocks by content: every window of ``WINDOW`` words
has a seed, its ``SEED``-word gram of least hash, and the windows in a row that share a
seed with the words they cover are a block. Equal passages have equal blocks inside, so the index
is the blocks' first places, by a 96-bit content key; blocks whose seed occurs once
in the corpus can have no match and leave the index early. Documents are then factored
greedily: matched blocks in a row that go on in the same reference are one factor. At the ends
of factors, where a block also covers words outside the passage, content keys differ and
single windows are checked instead. Every word in a factor is a duplicate; factors
have ``WINDOW`` words or more by construction.

The outcome is exact: a word goes if a window that covers it starts earlier as
well (in a document of a smaller id, or earlier in its own), judged on the input.

Copies are merged before shuffles (first places are minima), joins on block keys are plain
equi-joins that adaptive execution can split, and nothing is gathered by key but the factors of
a document.

Defined results: null and empty texts have no words; texts under ``WINDOW`` words
are left alone; rows that share an id are documents of their own, in the order of a 64-bit hash of
their texts, and those that share the text, too, are one place; rows with a null id are neither indexed nor
changed; an empty table gives an empty result; other columns are kept as they are.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievedeck.llm.joins import salted_join
from sievedeck.llm.textvec import gather, mix, only, sequence_hash, span_hash, text_slices, words
from sievedeck.session import discard, ensure_importable, release, staged, unused

WINDOW, SEED = 20, 6


def _blocks(data: np.ndarray, offs: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """word starts, ends, documents, their hashes; and of the blocks: first window, number of windows, seed place, seed."""
    starts, ends, doc = words(data, offs)
    h = span_hash(data, starts, ends)
    none = np.zeros(0, np.int64)
    n = len(starts) - window + 1
    if n <= 0:
        return starts, ends, doc, h, none, none, none, none.astype(np.uint64)
    seed = min(SEED, window)
    grams = sequence_hash(h[0], seed)
    width = window - seed + 1
    # The first least gram of ``width`` in a row: of 1, 2, 4 ..., and of two such runs that overlap.
    place, span = np.arange(len(grams)), 1
    while span < width:
        reach = min(span, width - span)
        left, right = place[: len(place) - reach], place[reach:]
        place = np.where(grams[right] < grams[left], right, left)
        span += reach
    whole = doc[:n] == doc[window - 1 :]
    place = place[whole]
    at = np.flatnonzero(whole)
    new = np.ones(len(at), bool)
    new[1:] = (place[1:] != place[:-1]) | (at[1:] != at[:-1] + 1)
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(at)))
    return starts, ends, doc, h, at[first], count, place[first], grams[place[first]]


def _keyed(h: tuple[np.ndarray, np.ndarray], first: np.ndarray, count: np.ndarray, place: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """96 bits of the block's windows, each with its place in the block, and of where the seed stands in it."""
    shift = ((place - first).astype(np.uint64) << np.uint64(32)) + count.astype(np.uint64)
    upto = np.cumsum(count) - count
    nth = np.arange(int(count.sum())) - np.repeat(upto, count)
    at, salt = np.repeat(first, count) + nth, mix(nth.astype(np.uint64) + np.uint64(1))
    c = [np.add.reduceat(mix(sequence_hash(h[lane], window, lane)[at] + salt), upto) if len(count) else np.zeros(0, np.uint64) for lane in (0, 1)]
    return mix(c[0] + mix(shift)).view(np.int64), (mix(c[1]) >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _source(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text, row: rows that share an id are told apart by a hash of their texts, and ordered by it."""
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id IS NOT NULL AND text <> ''")
    return docs.withColumn("row", F.xxhash64("text"))


def _seed_counts(docs: DataFrame, window: int) -> DataFrame:
    def run(batches):
        only(("substrings",))
        for batch in batches:
            for _, _, data, offs in text_slices(batch.column(1)):
                seeds, n = np.unique(_blocks(data, offs, window)[-1], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(seeds.view(np.int64)), pa.array(n)], names=["seed", "n"])

    return docs.mapInArrow(run, "seed long, n long")


def _block_rows(docs: DataFrame, window: int) -> DataFrame:
    """seed, c1, c2, doc_id, row, place (first window * 64 + windows - 1) of every block."""

    def run(batches):
        only(("substrings",))
        for batch in batches:
            ids, texts = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 2))
            for row, _, data, offs in text_slices(batch.column(1)):
                starts, _, doc, h, first, count, place, seed = _blocks(data, offs, window)
                c1, c2 = _keyed(h, first, count, place, window)
                base = np.searchsorted(doc, np.arange(len(offs)))
                own = doc[first] if len(first) else first
                yield pa.RecordBatch.from_arrays(
                    [pa.array(seed.view(np.int64)), pa.array(c1), pa.array(c2), pa.array(ids[own + row].astype(np.int64)), pa.array(texts[own + row].astype(np.int64)), pa.array((first - base[own]) * 64 + count - 1)],
                    names=["seed", "c1", "c2", "doc_id", "row", "place"],
                )

    return docs.mapInArrow(run, "seed long, c1 long, c2 int, doc_id long, row long, place long")


def _window_rows(docs: DataFrame, window: int) -> DataFrame:
    """w1, w2, doc_id, row, at of the windows of the listed blocks (docs: doc_id, text, row, places)."""

    def run(batches):
        only(("substrings",))
        for batch in batches:
            ids, texts = (batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 2))
            lists = batch.column(3)
            for row, stop, data, offs in text_slices(batch.column(1)):
                starts, ends, doc = words(data, offs)
                h = span_hash(data, starts, ends)
                base = np.searchsorted(doc, np.arange(len(offs)))
                owner, at = [], []
                for k in range(stop - row):
                    places = np.unique(np.array(lists[row + k].as_py(), np.int64))
                    count = places % 64 + 1
                    own = gather(np.arange(64), np.zeros(len(places), np.int64), count) + np.repeat(places // 64, count)
                    at.append(own)
                    owner.append(np.full(len(own), k))
                at, owner = np.concatenate(at), np.concatenate(owner)
                where = at + base[owner]
                w1 = sequence_hash(h[0], window, 0)[where].view(np.int64)
                w2 = (sequence_hash(h[1], window, 1)[where] >> np.uint64(32)).astype(np.uint32).view(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(w1), pa.array(w2), pa.array(ids[owner + row]), pa.array(texts[owner + row]), pa.array(at)], names=["w1", "w2", "doc_id", "row", "at"])

    return docs.select("doc_id", "text", "row", "places").mapInArrow(run, "w1 long, w2 int, doc_id long, row long, at long")


def matches(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """doc_id, row and found, an array of (at, windows, ref_doc, ref_at): runs of windows that also start at an earlier place."""
    ensure_importable(df.sparkSession)
    docs = _source(df, id_col, text_col)
    seeds = staged(_seed_counts(docs, window).groupBy("seed").agg(F.sum("n").alias("n")).where("n > 1"), "seeds")
    blocks = staged(salted_join(_block_rows(docs, window), seeds, ["seed"], ["doc_id", "place"]).drop("n"), "blocks")
    index = staged(blocks.groupBy("seed", "c1", "c2").agg(F.min(F.struct("doc_id", "row", "place")).alias("ref"), F.count("*").alias("n")), "index")
    mixed = index.groupBy("seed").agg(F.count("*").alias("kinds")).where("kinds > 1").select("seed")
    edge = index.join(mixed, "seed").groupBy(F.col("ref.doc_id").alias("doc_id"), F.col("ref.row").alias("row")).agg(F.collect_list("ref.place").alias("places"))
    rows = staged(_window_rows(docs.join(edge, ["doc_id", "row"]), window), "windows")
    first = staged(rows.groupBy("w1", "w2").agg(F.min(F.struct("doc_id", "row", "at")).alias("ref"), F.count("*").alias("n")).where("n > 1"), "first")
    singles = salted_join(rows, first, ["w1", "w2"], ["doc_id", "at"]).where(F.struct("doc_id", "row", "at") != F.col("ref")).select("doc_id", "row", "at", F.lit(1).cast("long").alias("windows"), F.col("ref.doc_id").alias("ref_doc"), F.col("ref.at").alias("ref_at"))
    whole = salted_join(blocks, index.where("n > 1"), ["seed", "c1", "c2"], ["doc_id", "place"]).where(F.struct("doc_id", "row", "place") != F.col("ref"))
    whole = whole.select("doc_id", "row", F.floor(F.col("place") / 64).alias("at"), (F.col("place") % 64 + 1).alias("windows"), F.col("ref.doc_id").alias("ref_doc"), F.floor(F.col("ref.place") / 64).alias("ref_at"))
    found = staged(whole.unionByName(singles).groupBy("doc_id", "row").agg(F.collect_list(F.struct("at", "windows", "ref_doc", "ref_at")).alias("found")), "found")
    discard(seeds, blocks, index, rows, first)
    release(df.sparkSession)
    return found


def factor(rows: np.ndarray, window: int = WINDOW) -> list[tuple[int, int, int, int]]:
    """Greedy factors (start, words, ref_doc, ref_start) from rows (at, windows, ref_doc, ref_at) of one document."""
    out: list[tuple[int, int, int, int]] = []
    end = 0  # of the windows in the current factor
    for at, n, ref, ref_at in sorted(map(tuple, rows.tolist())):
        if out and at <= end and ref == out[-1][2] and ref_at - at == out[-1][3] - out[-1][0]:
            end = max(end, at + n)
            out[-1] = (*out[-1][:1], end - out[-1][0] + window - 1, *out[-1][2:])
        elif not out or at + n > end:
            out.append((at, n + window - 1, ref, ref_at))
            end = at + n
    return out


def _stripped(data: np.ndarray, offs: np.ndarray, factors: list[list[tuple[int, int, int, int]]]) -> tuple[list[bytes], list[bytes], list[int], list[int]]:
    """Texts without factors; kept words joined by a space; numbers of words and removed words."""
    starts, ends, doc = words(data, offs)
    base = np.searchsorted(doc, np.arange(len(offs)))
    change = np.zeros(len(starts) + 1, np.int64)
    for k, own in enumerate(factors):
        for start, n, *_ in own:
            change[base[k] + start] += 1
            change[base[k] + start + n] -= 1
    gone = np.cumsum(change)[:-1] > 0
    removed = np.bincount(doc[gone], minlength=len(factors)) if len(doc) else np.zeros(len(factors), np.int64)
    # A removed word takes the space after it along.
    cover = np.zeros(len(data) + 1, np.int64)
    following = np.append(starts[1:], len(data))
    last = np.append(doc[1:] != doc[:-1], True)[: len(doc)]
    following[last] = offs[1:][doc[last]]
    cover[starts[gone]] += 1
    np.subtract.at(cover, following[gone], 1)
    stay = np.cumsum(cover)[:-1] == 0
    upto = np.append(0, np.cumsum(stay))[offs]
    left = data[stay].tobytes()
    spaced = np.append(data, np.uint8(0x20))
    length = (ends - starts)[~gone] + 1
    joined = gather(spaced, starts[~gone], length) if len(length) else data[:0].copy()
    if len(length):
        joined[np.cumsum(length) - 1] = 0x20
    size = np.bincount(doc[~gone], weights=length, minlength=len(factors)).astype(np.int64) if len(doc) else np.zeros(len(factors), np.int64)
    edge = np.append(0, np.cumsum(size))
    flat = joined.tobytes()
    return (
        [left[a:b] for a, b in zip(upto, upto[1:], strict=False)],
        [flat[a : max(a, b - 1)] for a, b in zip(edge, edge[1:], strict=False)],
        np.diff(base).tolist(), removed.tolist(),
    )


def substring_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """Add ``dedup``: text (what is left), n_words, n_removed, kept_sha256 (of the kept
    words joined by one space) and factors (start, words, ref_doc, ref_start)."""
    found_id, found_row, found_col = unused(df, "__id", "__row", "__found")
    found = matches(df, id_col, text_col, window).toDF(found_id, found_row, found_col)

    @F.arrow_udf("struct<text: string, n_words: long, n_removed: long, kept_sha256: string, factors: array<struct<start: long, words: long, ref_doc: long, ref_start: long>>>")
    def strip(texts: pa.Array, lists: pa.Array) -> pa.Array:
        runs = lists.flatten()
        rows = np.stack([runs.field(c).to_numpy(zero_copy_only=False) for c in ("at", "windows", "ref_doc", "ref_at")], axis=1) if len(runs) else np.zeros((0, 4), np.int64)
        edges = np.append(0, np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)))
        parsed = [factor(rows[x:y], window) if y > x else [] for x, y in zip(edges.tolist(), edges[1:].tolist(), strict=False)]
        left, kept, n_words, n_removed = [], [], [], []
        for row, stop, data, offs in text_slices(texts):
            said, joined, n, removed = _stripped(data, offs, parsed[row:stop])
            left += said
            kept += [hashlib.sha256(x).hexdigest() for x in joined]
            n_words += n
            n_removed += removed
        null = np.asarray(pc.is_null(texts))
        flat = np.array([f for own in parsed for f in own], np.int64).reshape(-1, 4)
        names = ("start", "words", "ref_doc", "ref_start")
        factors = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum([len(own) for own in parsed])), pa.int32()), pa.StructArray.from_arrays([pa.array(c) for c in flat.T], names=names))
        columns = [pa.array(left, pa.binary(), mask=null).cast(pa.string()), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string()), factors]
        return pa.StructArray.from_arrays(columns, names=["text", "n_words", "n_removed", "kept_sha256", "factors"])

    own = (df[id_col].cast("long") == F.col(found_id)) & (F.xxhash64(df[text_col]) == F.col(found_row))
    joined = df.join(found, own, "left").drop(found_id, found_row)
    return joined.withColumn("dedup", strip(F.col(text_col), F.col(found_col))).drop(found_col)
