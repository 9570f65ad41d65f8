"""Line deduplication by content-defined chunks of lines.

A rolling hash over the hashes of ``WINDOW`` neighbouring lines ends a chunk where it
is 0 modulo ``MODULUS``; chunks have two lines at least (a single line at the end
joins the chunk before). Boundaries depend on nearby lines alone, so copies of a
passage are cut alike wherever they stand. Chunks of several lines that occur
again, in a document of a greater id or later in the same one, are removed; the
grouping that finds them has the chunk's bytes in its key.

With ``passages`` every two neighbouring lines are a chunk, at every offset, so a repeated passage
of two lines or more goes whole wherever it stands: a line goes if it and a neighbour also stand
together in a document of a lesser id or earlier in the same one, judged on the input. Pairs
are keyed by their lines' hashes. The queries and the pipeline use this.

Bytes are compared in either form: lines (chunks) are grouped with their bytes by hash, and should
one hash have several byte strings, all keys are made of SHA-256 digests instead, so nothing goes and
nothing stays on the word of a short hash.

Defined results: null texts stay null and have no lines; an empty text has one
empty line; documents of one line are left alone; rows that share an id count as one
place, of each repeats inside go; rows with a null id are neither looked up nor changed;
an empty table gives an empty result; other columns are kept as they are.
"""

from __future__ import annotations

import hashlib
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievedeck.llm.joins import salted_join
from sievedeck.llm.textvec import distinct_spans, only, sequence_hash, span_hash, text_slices
from sievedeck.session import discard, ensure_importable, staged, tidy, unused

WINDOW, MODULUS = 2, 3


def line_spans(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends (without the line feed) and documents of all lines; every document has one at least."""
    feeds = np.flatnonzero(data == 0x0A)
    n = len(offs) - 1
    doc = np.concatenate([np.arange(n), np.searchsorted(offs, feeds, "right") - 1])
    starts = np.concatenate([offs[:-1], feeds + 1])
    order = np.lexsort((starts, doc))
    starts, doc = starts[order], doc[order]
    ends = np.empty(len(starts), np.int64)
    ends[:-1] = starts[1:] - 1
    last = np.flatnonzero(np.append(doc[1:] != doc[:-1], True))
    ends[last] = offs[1:][doc[last]]
    return starts, ends, doc


def chunk_lines(cut: list[bool]) -> list[int]:
    """First lines of the chunks of a document, given after which lines the rolling hash would cut."""
    firsts, n = [0], len(cut)
    for k, c in enumerate(cut):
        if c and k + 1 - firsts[-1] >= 2 and n - (k + 1) >= 2:
            firsts.append(k + 1)
    return firsts


def chunks(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends, documents and numbers of lines of all chunks."""
    starts, ends, doc = line_spans(data, offs)
    h = span_hash(data, starts, ends)[0]
    rolled = np.zeros(len(h), np.uint64)
    rolled[WINDOW - 1 :] = sequence_hash(h, WINDOW)
    cut = rolled % np.uint64(MODULUS) == 0
    edges = np.searchsorted(doc, np.arange(len(offs)))
    cut[[k for e in edges[:-1] for k in range(e, min(e + WINDOW - 1, len(cut)))]] = False  # no whole window yet
    flags = cut.tolist()
    firsts, owner = [], []
    for d, (a, b) in enumerate(zip(edges.tolist(), edges[1:].tolist(), strict=False)):
        own = chunk_lines(flags[a:b])
        firsts += [a + k for k in own]
        owner += [d] * len(own)
    firsts, owner = np.array(firsts, np.int64), np.array(owner, np.int64)
    after = np.append(firsts[1:], len(starts))
    return starts[firsts], ends[after - 1], owner, after - firsts


#: How spans become keys: "sha256", or the number of bits of each half of a 128-bit xxhash that count (tests lower it).
FAST, SURE = 64, "sha256"


def _span_keys(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, how: int | str) -> tuple[np.ndarray, np.ndarray]:
    if how == SURE:
        strings, which = distinct_spans(data, starts, ends)
        table = np.frombuffer(b"".join(hashlib.sha256(x).digest()[:16] for x in strings), "<u8").reshape(-1, 2)
        return table[which, 0], table[which, 1]
    return tuple(h >> np.uint64(64 - how) for h in span_hash(data, starts, ends))


def _keys(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, how: int | str) -> list[np.ndarray]:
    return [h.view(np.int64) for h in _span_keys(data, starts, ends, how)]


def _several_lines(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where(F.col("doc_id").isNotNull() & F.col("text").contains("\n"))


def _chunk_rows(df: DataFrame, id_col: str, text_col: str, how: int | str, bytes_too: bool = False) -> DataFrame:
    """h1, h2, doc_id (and the bytes) of the distinct chunks of several lines of each document."""

    def run(batches):
        only(("lines",))
        for batch in batches:
            ids = batch.column(0)
            for row, _, data, offs in text_slices(batch.column(1)):
                starts, ends, doc, n = chunks(data, offs)
                many = n > 1
                starts, ends, doc = starts[many], ends[many], doc[many]
                h1, h2 = _keys(data, starts, ends, how)
                _, first = np.unique(np.stack([doc, h1, h2]), axis=1, return_index=True) if len(doc) else (None, np.zeros(0, np.int64))
                first.sort()
                columns = [pa.array(h1[first]), pa.array(h2[first]), ids.take(pa.array(doc[first] + row))]
                if bytes_too:
                    raw = data.tobytes()
                    columns.append(pa.array([raw[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names=["h1", "h2", "doc_id", "chunk"][: len(columns)])

    kind = df.schema[id_col].dataType.simpleString()
    return _several_lines(df, id_col, text_col).mapInArrow(run, f"h1 long, h2 long, doc_id {kind}" + ", chunk binary" * bytes_too)


def repeated_chunks(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", how: int | str = FAST) -> DataFrame:
    """h1, h2, first_doc, n, kinds of the chunks that several documents have, and of keys with several byte strings.

    Partial aggregation merges copies before the shuffle, so a chunk that a third
    of all documents have is a row a task.
    """
    ensure_importable(df.sparkSession)
    found = _chunk_rows(df, id_col, text_col, how, True).groupBy("h1", "h2", "chunk").agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("n"))
    return found.groupBy("h1", "h2").agg(F.min("first_doc").alias("first_doc"), F.sum("n").alias("n"), F.count("*").alias("kinds")).where("n > 1")


def _strip(data: np.ndarray, offs: np.ndarray, gone: list, how: int | str = FAST) -> tuple[list[bytes], list[int], list[int]]:
    """Texts without the chunks in ``gone`` (pairs of keys a document) and without repeats inside; lines before and removed."""
    starts, ends, doc, n = chunks(data, offs)
    h1, h2 = _keys(data, starts, ends, how)
    raw = data.tobytes()
    kept: list[list[bytes]] = [[] for _ in gone]
    total, removed = [0] * len(gone), [0] * len(gone)
    seen: set = set()
    for a, b, d, lines, x, y in zip(starts.tolist(), ends.tolist(), doc.tolist(), n.tolist(), h1.tolist(), h2.tolist(), strict=True):
        total[d] += lines
        if lines > 1 and ((x, y) in gone[d] or (d, x, y, raw[a:b]) in seen):
            removed[d] += lines
            continue
        if lines > 1:
            seen.add((d, x, y, raw[a:b]))
        kept[d].append(raw[a:b])
    return [b"\n".join(x) for x in kept], total, removed


def _pairs(data: np.ndarray, offs: np.ndarray, how: int | str) -> tuple[np.ndarray, ...]:
    """Starts, ends, documents and two hashes (64 and 32 bits) of all lines, and those that have a next line."""
    starts, ends, doc = line_spans(data, offs)
    h1, h2 = _span_keys(data, starts, ends, how)
    return starts, ends, doc, h1, h2 >> np.uint64(32), np.flatnonzero(doc[1:] == doc[:-1])


def _pair_keys(h1: np.ndarray, h2: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """Three values that hold all four hashes of a pair's lines."""
    return [x.view(np.int64) for x in (h1[at], h1[at + 1], (h2[at] << np.uint64(32)) | h2[at + 1])]


def _pair_rows(df: DataFrame, id_col: str, text_col: str, how: int | str) -> DataFrame:
    """a, b, c (the key), doc_id of all pairs of neighbouring lines."""

    def run(batches):
        only(("lines",))
        for batch in batches:
            ids = batch.column(0)
            for row, _, data, offs in text_slices(batch.column(1)):
                _, _, doc, h1, h2, at = _pairs(data, offs, how)
                yield pa.RecordBatch.from_arrays([*map(pa.array, _pair_keys(h1, h2, at)), ids.take(pa.array(doc[at] + row))], names=["a", "b", "c", "doc_id"])

    kind = df.schema[id_col].dataType.simpleString()
    return _several_lines(df, id_col, text_col).mapInArrow(run, f"a long, b long, c long, doc_id {kind}")


def _line_rows(df: DataFrame, id_col: str, text_col: str, how: int | str) -> DataFrame:
    """h1, h2 and bytes of the lines; of equal lines in a slice one."""

    def run(batches):
        only(("lines",))
        for batch in batches:
            for _, _, data, offs in text_slices(batch.column(1)):
                starts, ends, _, h1, h2, _ = _pairs(data, offs, how)
                raw = data.tobytes()
                found = list({raw[a:b]: k for k, (a, b) in enumerate(zip(starts.tolist(), ends.tolist(), strict=True))}.items())
                at = np.array([k for _, k in found], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(h1[at].view(np.int64)), pa.array(h2[at].view(np.int64)), pa.array([x for x, _ in found], pa.binary())], names=["h1", "h2", "line"])

    return _several_lines(df, id_col, text_col).mapInArrow(run, "h1 long, h2 long, line binary")


def lines_collide(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", how: int | str = FAST) -> bool:
    """Whether two lines of different bytes have one hash."""
    kinds = _line_rows(df, id_col, text_col, how).distinct().groupBy("h1", "h2").agg(F.count("*").alias("kinds"))
    with tidy(df.sparkSession):
        return kinds.where("kinds > 1").limit(1).count() > 0


def repeated_pairs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", how: int | str = FAST) -> DataFrame:
    """a, b, c, first_doc, n of the pairs of neighbouring lines that several documents have."""
    ensure_importable(df.sparkSession)
    found = _pair_rows(df, id_col, text_col, how).groupBy("a", "b", "c").agg(F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"), F.count("*").alias("n"))
    return found.where("first_doc < last_doc").drop("last_doc")


def _strip_pairs(data: np.ndarray, offs: np.ndarray, gone: list, how: int | str = FAST) -> tuple[list[bytes], list[int], list[int]]:
    """As ``_strip``, without the lines of the pairs in ``gone`` and of pairs that repeat inside."""
    starts, ends, doc, h1, h2, at = _pairs(data, offs, how)
    raw, away = data.tobytes(), np.zeros(len(starts), bool)
    starts, ends, before, seen = starts.tolist(), ends.tolist(), -1, set()
    for k, d, *key in zip(at.tolist(), doc[at].tolist(), *(x.tolist() for x in _pair_keys(h1, h2, at)), strict=True):
        if d != before:
            before, seen = d, set()
        said = raw[starts[k] : ends[k + 1]]
        if said in seen or tuple(key) in gone[d]:
            away[k : k + 2] = True
        seen.add(said)
    kept: list[list[bytes]] = [[] for _ in gone]
    for k in np.flatnonzero(~away).tolist():
        kept[doc[k]].append(raw[starts[k] : ends[k]])
    return [b"\n".join(x) for x in kept], np.bincount(doc, minlength=len(gone)).tolist(), np.bincount(doc[away], minlength=len(gone)).tolist()


def line_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", out_text: str = "text", drop_emptied: bool = False, passages: bool = False, how: int | str = FAST) -> DataFrame:
    """Replace texts by what is left of them and add n_lines and n_removed.

    ``drop_emptied`` leaves out documents of which nothing is left; ``passages``
    takes every two neighbouring lines for a chunk.
    """
    ensure_importable(df.sparkSession)
    if passages:
        keys = ("a", "b", "c")
        how = SURE if lines_collide(df, id_col, text_col, how) else how
        repeated = staged(repeated_pairs(df, id_col, text_col, how), "pairs")
        strip_slice, rows = partial(_strip_pairs, how=how), _pair_rows(df, id_col, text_col, how)
    else:
        keys = ("h1", "h2")
        repeated = staged(repeated_chunks(df, id_col, text_col, how), "chunks")
        if not repeated.where("kinds > 1").isEmpty():
            discard(repeated)
            how = SURE
            repeated = staged(repeated_chunks(df, id_col, text_col, how), "chunks")
        strip_slice, rows = partial(_strip, how=how), _chunk_rows(df, id_col, text_col, how)
    found_id, gone_col, made_col = unused(df, "__id", "__gone", "__made")
    gone = (
        salted_join(rows, repeated.select(*keys, "first_doc", "n"), list(keys), ["doc_id"]).where("doc_id > first_doc")
        .groupBy(F.col("doc_id").alias(found_id)).agg(F.collect_list(F.struct(*keys)).alias(gone_col))
    )

    @F.arrow_udf("struct<text: string, n_lines: long, n_removed: long>")
    def strip(texts: pa.Array, lists: pa.Array) -> pa.Array:
        found = lists.flatten()
        said = [found.field(k).to_numpy(zero_copy_only=False) for k in keys]
        edges = np.append(0, np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))).tolist()
        out: tuple[list, list, list] = ([], [], [])
        for row, stop, data, offs in text_slices(texts):
            sets = [frozenset(zip(*(c[a:b].tolist() for c in said), strict=True)) if b > a else frozenset() for a, b in zip(edges[row:stop], edges[row + 1 : stop + 1], strict=True)]
            for column, values in zip(out, strip_slice(data, offs, sets), strict=True):
                column += values
        null = np.asarray(pc.is_null(texts))
        n_lines = np.where(null, 0, np.array(out[1], np.int64)) if len(texts) else np.zeros(0, np.int64)
        return pa.StructArray.from_arrays([pa.array(out[0], pa.binary(), mask=null).cast(pa.string()), pa.array(n_lines), pa.array(out[2], pa.int64())], names=["text", "n_lines", "n_removed"])

    joined = df.join(gone, df[id_col] == F.col(found_id), "left").drop(found_id)
    made = joined.withColumn(made_col, F.when(F.col(id_col).isNotNull(), strip(F.col(text_col), F.col(gone_col))))
    keep = [c for c in df.columns if c not in (out_text, "n_lines", "n_removed")]
    lines = F.coalesce(F.col(f"{made_col}.n_lines"), F.size(F.split(F.col(text_col), "\n", -1)).cast("long"), F.lit(0).cast("long"))
    out = made.select(
        *(F.col(f"`{c}`") for c in keep),
        F.when(F.col(id_col).isNotNull(), F.col(f"{made_col}.text")).otherwise(F.col(text_col)).alias(out_text),
        lines.alias("n_lines"), F.coalesce(F.col(f"{made_col}.n_removed"), F.lit(0).cast("long")).alias("n_removed"),
    )
    return out.where(f"n_removed = 0 OR `{out_text}` <> ''") if drop_emptied else out
