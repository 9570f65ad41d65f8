"""Best-fit packing by exact-complement hashing.

Documents become pieces of at most ``capacity`` ids. Only the histogram of piece
lengths (at most ``capacity`` numbers, whatever the corpus) reaches the driver.
There single, pair and triple length sums are indexed; combinations that fill a
gap exactly are consumed under availability counts, longest pieces first, and
the residuals are placed best fit. The outcome is a list of patterns with
multiplicities; pieces find their slots by their rank among pieces of equal length.

Defined results: a null or empty text is the end id alone (one piece of length
1); rows with equal ids are packed as they come, each on its own; an empty table
gives an empty result; only ``id_col`` and ``text_col`` are read, so extra
columns of any name do no harm.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievedeck.llm.textvec import encode_documents, library_encoder
from sievedeck.session import ensure_importable, staged

CAPACITY, END_ID = 1024, 2


def cut_points(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: full ones, the first takes what is over."""
    first = n % capacity or min(n, capacity)
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def document_pieces(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, added_tokens: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece of every document."""
    ensure_importable(df.sparkSession)

    def run(batches):
        encoder = library_encoder(tokenizer, added_tokens)
        for batch in batches:
            rows, out = batch.column(0), ([], [], [], [], [])
            for row, ids, offs in encode_documents(batch.column(1), encoder):
                for k in range(len(offs) - 1):
                    own = np.append(ids[offs[k] : offs[k + 1]], np.uint32(end_id)).astype("<u4")
                    for piece, (start, length) in enumerate(cut_points(len(own), capacity)):
                        for column, value in zip(out, (row + k, piece, start, length, zlib.crc32(own[start : start + length])), strict=True):
                            column.append(value)
            yield pa.RecordBatch.from_arrays(
                [rows.take(pa.array(out[0], pa.int64())), pa.array(out[1], pa.int32()), *(pa.array(c, pa.int64()) for c in out[2:])],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def pack_histogram(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths of one sequence, longest first) and how many sequences have each."""
    left = {k: v for k, v in counts.items() if v > 0}
    plan: list[tuple[tuple[int, ...], int]] = []

    def room(combo: tuple[int, ...]) -> int:
        return min(left.get(x, 0) // combo.count(x) for x in set(combo))

    def take(combo: tuple[int, ...]) -> None:
        if n := room(combo):
            plan.append((combo, n))
            for x in combo:
                left[x] -= n
                if not left[x]:
                    del left[x]

    if capacity in left:
        take((capacity,))
    for longest in sorted(left, reverse=True):
        gap = capacity - longest
        if longest in left:
            take((longest, gap))
        for x in sorted((x for x in left if gap / 2 <= x < gap), reverse=True):
            if longest not in left:
                break
            take((longest, x, gap - x))
        for x in sorted((x for x in left if gap / 3 <= x < gap), reverse=True):
            for y in sorted((y for y in left if (gap - x) / 2 <= y <= min(x, gap - x - 1)), reverse=True):
                if longest not in left or x not in left:
                    break
                take((longest, x, y, gap - x - y))
            if longest not in left:
                break
    # Best fit of what is over, longest first; equal open sequences are one entry.
    opened: dict[int, dict[tuple[int, ...], int]] = defaultdict(dict)
    gaps: list[int] = []

    def put(combo: tuple[int, ...], n: int, gap: int) -> None:
        if gap == 0:
            plan.append((combo, n))
            return
        if not opened[gap]:
            insort(gaps, gap)
        opened[gap][combo] = opened[gap].get(combo, 0) + n

    for length in sorted(left, reverse=True):
        n = left[length]
        while n:
            at = bisect_left(gaps, length)
            if at == len(gaps):
                each = capacity // length
                full, over = divmod(n, each)
                if full:
                    put((length,) * each, full, capacity - each * length)
                if over:
                    put((length,) * over, 1, capacity - over * length)
                break
            gap = gaps[at]
            combo, have = opened[gap].popitem()
            if not opened[gap]:
                gaps.pop(at)
            each = min(gap // length, n)
            used = min(have, n // each)
            put(combo + (length,) * each, used, gap - each * length)
            if have > used:
                put(combo, have - used, gap)
            n -= used * each
    for gap in gaps:
        plan.extend(opened[gap].items())
    return plan


def plan_table(plan: list[tuple[tuple[int, ...], int]]) -> dict[str, np.ndarray]:
    """Slots by length: ranks from ``first`` on have sequences from ``base`` on, at ``offset``."""
    rank: dict[int, int] = defaultdict(int)
    rows, base = [], 0
    for combo, n in plan:
        offset = 0
        for length in combo:
            rows.append((length, rank[length], base, offset))
            rank[length] += n
            offset += length
        base += n
    table = np.array(sorted(rows), np.int64).reshape(-1, 4)
    return dict(zip(("length", "first", "base", "offset"), table.T, strict=True))


def pack(pieces: DataFrame, capacity: int = CAPACITY, rows_per_salt: int = 20_000) -> DataFrame:
    """Add sequence_id and offset to a table of pieces that can be read twice.

    Ranks among equal lengths are counted in salted groups, so a length that a
    third of all pieces have is still dealt over many tasks.
    """
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # capacity rows at most
    table = plan_table(pack_histogram(histogram, capacity))
    salts = 64 + sum(histogram.values()) // rows_per_salt
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)))
    before = (
        salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
        .select("length", "salt", (F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")).alias("before"))
    )
    local = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranked = salted.withColumn("local", local).join(before, ["length", "salt"]).select(*pieces.columns, (F.col("before") + F.col("local")).alias("rank"))
    far = 1 << 40  # ranks stay below this, so (length, rank) sorts as one number

    def place(batches):
        keys = table["length"] * far + table["first"]
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            at = np.searchsorted(keys, length * far + rank, "right") - 1
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(table["base"][at] + rank - table["first"][at]), pa.array(table["offset"][at])],
                names=[*batch.schema.names[:-1], "sequence_id", "offset"],
            )

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema.fields)
    return ranked.mapInArrow(place, f"{kinds}, sequence_id long, offset long")


def best_fit_packing(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, added_tokens: bool = False) -> DataFrame:
    """Pack the documents of ``df``; one row a piece with its sequence and place.

    ``added_tokens`` gives the strings of added tokens in texts their ids (the library's default).
    """
    return pack(staged(document_pieces(df, tokenizer, id_col, text_col, capacity, end_id, added_tokens), "pieces"), capacity)
