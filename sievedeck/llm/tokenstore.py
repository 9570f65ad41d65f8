"""Token-ID output: shards of separately compressed documents under one dictionary.

A store is a folder in the shared file system: ``<hash>.dict`` holds a zstandard
dictionary trained on serialized id arrays, ``shard-<bucket>.tok`` the documents
of one range of ids, ascending. A shard is

    "SDTOKENS", version u32, bytes an id u32, dictionary hash u64
    a zstandard frame for each document (its ids, little-endian, 2 or 4 bytes each)
    index: doc_ids i64[n], valid u8[n], n_tokens u32[n], frame offsets u64[n + 1]
    footer: index offset u64, n u64, "SDTOKENS"

so one document costs a read of the index and of its frame. Shards are written
under a temporary name and moved, so a repeated task leaves the same files.

The dictionary is fitted on the ``sample`` documents with the least id hashes, of longer ones
a block of ``SAMPLE_IDS`` ids from anywhere in them; every document is written with it.

Defined results: null or empty texts are the end id alone; rows that share an id
are all kept, side by side; null ids come first; an empty table gives an empty store
and an empty result. Only the id and text columns are read.
"""

from __future__ import annotations

import re
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievedeck.llm.docorder import ordered_parts
from sievedeck.llm.textvec import encode_documents, library_encoder
from sievedeck.session import ensure_importable, forget, shared_dir, staged

MAGIC, VERSION, HEADER, FOOTER = b"SDTOKENS", 1, 24, 24
SAMPLE_IDS = 16_384
NULL_ID = -(1 << 63)


def _file_system(path: str):
    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem(), re.sub("^file:/+", "/", path)
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def train_dictionary(samples: list[bytes], size: int = 65_536) -> bytes:
    """A zstandard dictionary; with too few samples to train, their bytes serve as one."""
    import zstandard

    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return (b"".join(samples)[-size:] or b"\0" * 8).rjust(8, b"\0")


def dictionary_hash(raw: bytes) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(raw)


def _zstd_dictionary(raw: bytes):
    import zstandard

    return zstandard.ZstdCompressionDict(raw)


class Shard:
    """One shard, for whole reads and for single documents."""

    def __init__(self, path: str, dictionary: bytes):
        import zstandard

        files, at = _file_system(path)
        self.file = files.open_input_file(at)
        size = self.file.size()
        head, foot = self.file.read_at(HEADER, 0), self.file.read_at(FOOTER, size - FOOTER)
        if head[:8] != MAGIC or foot[16:] != MAGIC:
            raise ValueError(f"{path} is no token shard")
        self.width = int.from_bytes(head[12:16], "little")
        if int.from_bytes(head[16:24], "little") != dictionary_hash(dictionary):
            raise ValueError(f"{path} was written with another dictionary")
        index, n = (int.from_bytes(foot[k : k + 8], "little") for k in (0, 8))
        raw = self.file.read_at(size - FOOTER - index, index)
        self.doc_ids = np.frombuffer(raw, "<i8", n)
        self.valid = np.frombuffer(raw, np.uint8, n, 8 * n).astype(bool)
        self.n_tokens = np.frombuffer(raw, "<u4", n, 9 * n)
        self.offsets = np.frombuffer(raw, "<u8", n + 1, 13 * n)
        self._unpack = zstandard.ZstdDecompressor(dict_data=_zstd_dictionary(dictionary))

    def _ids(self, frame: bytes) -> np.ndarray:
        return np.frombuffer(self._unpack.decompress(frame), f"<u{self.width}").astype("<u4")

    def document(self, k: int) -> np.ndarray:
        a, b = int(self.offsets[k]), int(self.offsets[k + 1])
        return self._ids(self.file.read_at(b - a, a))

    def find(self, doc_id: int) -> list[np.ndarray]:
        """The ids of the documents of that id."""
        return [self.document(int(k)) for k in np.flatnonzero(self.valid & (self.doc_ids == doc_id))]

    def documents(self, most_bytes: int = 1 << 22):
        """All documents' ids in order, a few megabytes of frames at a time."""
        k, n = 0, len(self.doc_ids)
        while k < n:
            stop = max(k + 1, int(np.searchsorted(self.offsets, self.offsets[k] + np.uint64(most_bytes), "right")) - 1)
            base = int(self.offsets[k])
            raw = self.file.read_at(int(self.offsets[stop]) - base, base)
            for j in range(k, stop):
                yield self._ids(raw[int(self.offsets[j]) - base : int(self.offsets[j + 1]) - base])
            k = stop

    def close(self) -> None:
        self.file.close()


class _Writer:
    def __init__(self, folder: str, bucket: int, width: int, dictionary: int):
        self.files, self.folder = _file_system(folder)
        self.name, self.bucket = f"{self.folder}/shard-{bucket}.tok", bucket
        self.temporary = f"{self.folder}/.shard-{bucket}-{uuid.uuid4().hex}"
        self.out = self.files.open_output_stream(self.temporary)
        self.out.write(MAGIC + VERSION.to_bytes(4, "little") + width.to_bytes(4, "little") + dictionary.to_bytes(8, "little"))
        self.at, self.columns = HEADER, ([], [], [], [])

    def add(self, doc_ids: np.ndarray, valid: np.ndarray, n_tokens: np.ndarray, sizes: np.ndarray, frames: memoryview) -> None:
        self.out.write(frames)
        for column, values in zip(self.columns, (doc_ids, valid, n_tokens, self.at + np.cumsum(sizes) - sizes), strict=True):
            column.append(values)
        self.at += int(sizes.sum())

    def close(self) -> tuple[int, int, int]:
        doc_ids, valid, n_tokens, offsets = (np.concatenate(c) for c in self.columns)
        for values, kind in ((doc_ids, "<i8"), (valid, "u1"), (n_tokens, "<u4"), (np.append(offsets, self.at), "<u8")):
            self.out.write(values.astype(kind).tobytes())
        self.out.write(self.at.to_bytes(8, "little") + len(doc_ids).to_bytes(8, "little") + MAGIC)
        self.out.close()
        self.files.move(self.temporary, self.name)
        return self.bucket, len(doc_ids), int(n_tokens.sum())


class TokenStore:
    """A written store: the folder, the dictionary, and a table of its shards."""

    def __init__(self, folder: str, dictionary: bytes, shards: DataFrame):
        self.folder, self.dictionary, self.shards = folder, dictionary, shards

    def statistics(self, tasks: int | None = None) -> DataFrame:
        """doc_id, start, n_tokens, ids_crc32 of every document, from the files."""
        folder, dictionary = self.folder, self.dictionary
        # One row a shard (tens of MB of documents), so one window over all is small.
        base = F.sum("n_tokens").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n_tokens")
        dealt = self.shards.select("bucket", base.alias("base")).repartition(tasks or 96, "bucket")

        def run(batches):
            for batch in batches:
                for bucket, before in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    shard = Shard(f"{folder}/shard-{bucket}.tok", dictionary)
                    n_tokens = shard.n_tokens.astype(np.int64)
                    crc = np.fromiter((zlib.crc32(ids) for ids in shard.documents()), np.int64, len(n_tokens))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(shard.doc_ids, mask=~shard.valid), pa.array(before + np.cumsum(n_tokens) - n_tokens), pa.array(n_tokens), pa.array(crc)],
                        names=["doc_id", "start", "n_tokens", "ids_crc32"],
                    )
                    shard.close()

        return dealt.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _encoded(batch, tokenizer: str, end_id: int, width: int, added_tokens: bool):
    """Serialized ids of every document of a batch, in order."""
    for _, ids, offs in encode_documents(batch, library_encoder(tokenizer, added_tokens)):
        for k in range(len(offs) - 1):
            yield np.append(ids[offs[k] : offs[k + 1]], np.uint32(end_id)).astype(f"<u{width}").tobytes()


def sample_block(raw: bytes, width: int) -> bytes:
    """``SAMPLE_IDS`` ids in a row of a document, from a place its own bytes draw."""
    spare = len(raw) // width - SAMPLE_IDS
    at = zlib.crc32(raw) % (spare + 1) * width if spare > 0 else 0
    return raw[at : at + SAMPLE_IDS * width]


def write_token_store(df: DataFrame, tokenizer: str, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, sample: int = 1000, rows_per_shard: int = 20_000, added_tokens: bool = False) -> TokenStore:
    """Encode, compress and write all documents of ``df`` in ascending order of id.

    ``added_tokens`` gives the strings of added tokens in texts their ids (the library's default).
    """
    import zstandard
    from tokenizers import Tokenizer

    spark = df.sparkSession
    ensure_importable(spark)
    if folder is None:
        folder = f"{shared_dir(spark)}/sievedeck-tokens-{uuid.uuid4().hex}"
        forget(spark, folder)
    width = 2 if Tokenizer.from_file(tokenizer).get_vocab_size() <= 1 << 16 else 4
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def serialize(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([sample_block(x, width) for x in _encoded(batch.column(0), tokenizer, end_id, width, added_tokens)], pa.binary())], names=["ids"])

    order = F.xxhash64("doc_id")
    last = docs.select(order.alias("h")).orderBy("h").limit(sample).agg(F.max("h")).first()[0]
    drawn = docs.where(order <= F.lit(last)).select("text").mapInArrow(serialize, "ids binary").limit(sample).collect() if last is not None else []
    dictionary = train_dictionary([bytes(r["ids"]) for r in drawn])
    files, at = _file_system(folder)
    files.create_dir(at, recursive=True)
    with files.open_output_stream(f"{at}/{dictionary_hash(dictionary):016x}.dict") as out:
        out.write(dictionary)

    def compress(batches):
        press = zstandard.ZstdCompressor(level=3, dict_data=_zstd_dictionary(dictionary))
        for batch in batches:
            made = [(len(x) // width, press.compress(x)) for x in _encoded(batch.column(2), tokenizer, end_id, width, added_tokens)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([n for n, _ in made], pa.int64()), pa.array([x for _, x in made], pa.binary())], names=["bucket", "doc_id", "n_tokens", "frame"])

    def write(batches):
        out, done = None, []
        for batch in batches:
            bucket, n_tokens = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 2))
            ids, frames = batch.column(1), batch.column(3)
            valid, doc_ids = np.asarray(ids.is_valid()), ids.fill_null(NULL_ID).to_numpy(zero_copy_only=False)
            offs = np.frombuffer(frames.buffers()[1], np.int32)[frames.offset : frames.offset + len(frames) + 1].astype(np.int64)
            raw = memoryview(frames.buffers()[2])
            edges = [0, *(np.flatnonzero(bucket[1:] != bucket[:-1]) + 1).tolist(), len(bucket)] if len(bucket) else []
            for a, b in zip(edges, edges[1:], strict=False):
                if out is None or out.bucket != bucket[a]:
                    if out:
                        done.append(out.close())
                    out = _Writer(folder, int(bucket[a]), width, dictionary_hash(dictionary))
                out.add(doc_ids[a:b], valid[a:b], n_tokens[a:b], np.diff(offs[a : b + 1]), raw[offs[a] : offs[b]])
        if out:
            done.append(out.close())
        yield pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], pa.int64()) for k in range(3)], names=["bucket", "n_docs", "n_tokens"])

    bucket, parts = ordered_parts(docs, "doc_id", rows_per_shard, F.xxhash64("text"))
    shards = (
        docs.select(bucket.alias("bucket"), "doc_id", "text")
        .mapInArrow(compress, "bucket long, doc_id long, n_tokens long, frame binary")
        .repartition(parts, "bucket").sortWithinPartitions("bucket", "doc_id", "frame")
        .mapInArrow(write, "bucket long, n_docs long, n_tokens long")
    )
    return TokenStore(folder, dictionary, staged(shards, "shards"))
