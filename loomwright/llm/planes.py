"""Token ids in files of shuffled planes.

A file holds the ids of many documents, one after another.  They are cut into blocks of a fixed number
of ids; a block is transposed into planes (byte k of every id, or bit k of every id), each plane is
compressed with zstandard on its own, and the index at the end of the file says where each block and
plane lies, so any range of ids can be read alone.

    "PLN1" | planes of block 0 | planes of block 1 | ... | index (JSON, zstandard) | its size (8 bytes) | "PLN1"

A table is written by one task for each range of document ids.  A task writes a file of its own name and
reports it in its result row; only files that the manifest lists count, so tasks that are repeated or
run twice leave no wrong data.  The manifest is a small table beside the files, with a row for a file.

Null texts are empty: just the end id.  Documents with equal ids are ordered by their texts; null ids
come first.  An empty table gives an empty manifest and no rows.  Other columns aren't read.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomwright.llm.common import released, shared_folder, ship, utf8
from loomwright.llm.encode import library_encoder

MAGIC, BLOCK_IDS = b"PLN1", 1 << 16


def open_store(uri: str):
    """The file system of a URI or path, and the path in it."""
    from pyarrow import fs

    if "://" in uri or uri.startswith("file:"):
        return fs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri[5:])
    return fs.LocalFileSystem(), uri


def split_planes(ids: np.ndarray, bits: bool) -> list[bytes]:
    raw = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    if not bits:
        return [np.ascontiguousarray(raw[:, k]).tobytes() for k in range(4)]
    each = np.unpackbits(raw, axis=1, bitorder="little")
    return [np.packbits(each[:, k], bitorder="little").tobytes() for k in range(32)]


def join_planes(planes: list[bytes], n: int) -> np.ndarray:
    if len(planes) == 4:
        raw = np.stack([np.frombuffer(p, np.uint8) for p in planes], axis=1)
    else:
        each = np.stack([np.unpackbits(np.frombuffer(p, np.uint8), bitorder="little")[:n] for p in planes], axis=1)
        raw = np.packbits(each, axis=1, bitorder="little")
    return np.ascontiguousarray(raw).view("<u4").ravel()


class PlaneWriter:
    """Takes documents in order; out is a binary file."""

    def __init__(self, out, block_ids: int = BLOCK_IDS, bits: bool = False, level: int = 3):
        self.out, self.block_ids, self.bits = out, block_ids, bits
        self.zstd = zstandard.ZstdCompressor(level=level)
        self.waiting: list[np.ndarray] = []
        self.n_waiting, self.at, self.total = 0, len(MAGIC), 0
        self.blocks: list[list] = []
        self.docs: list = []
        self.sizes: list[int] = []
        out.write(MAGIC)

    def add(self, doc, ids: np.ndarray) -> None:
        self.docs.append(doc)
        self.sizes.append(len(ids))
        self.waiting.append(ids)
        self.n_waiting += len(ids)
        self.total += len(ids)
        if self.n_waiting >= self.block_ids:
            ids = np.concatenate(self.waiting)
            whole = len(ids) // self.block_ids * self.block_ids
            for k in range(0, whole, self.block_ids):
                self._block(ids[k : k + self.block_ids])
            self.waiting, self.n_waiting = [ids[whole:]], len(ids) - whole

    def _block(self, ids: np.ndarray) -> None:
        planes = [self.zstd.compress(p) for p in split_planes(ids, self.bits)]
        self.blocks.append([self.at, len(ids), [len(p) for p in planes]])
        self.out.write(b"".join(planes))
        self.at += sum(map(len, planes))

    def close(self) -> None:
        if self.n_waiting:
            self._block(np.concatenate(self.waiting))
        index = self.zstd.compress(json.dumps({"block_ids": self.block_ids, "blocks": self.blocks, "docs": self.docs, "sizes": self.sizes}).encode())
        self.out.write(index + struct.pack("<Q", len(index)) + MAGIC)
        self.out.close()


class PlaneReader:
    """Reads blocks, ranges of ids or documents of a file; file can seek."""

    def __init__(self, file):
        self.file = file
        size = file.seek(0, 2) or file.tell()
        file.seek(size - 12)
        n, magic = struct.unpack("<Q4s", file.read(12))
        if magic != MAGIC:
            raise ValueError("not a file of planes")
        file.seek(size - 12 - n)
        self.zstd = zstandard.ZstdDecompressor()
        self.index = json.loads(self.zstd.decompress(file.read(n)))

    def block(self, k: int) -> np.ndarray:
        at, n, sizes = self.index["blocks"][k]
        self.file.seek(at)
        data = self.file.read(sum(sizes))
        ends = np.cumsum(sizes).tolist()
        return join_planes([self.zstd.decompress(data[e - s : e]) for s, e in zip(sizes, ends)], n)

    def ids(self, start: int, end: int) -> np.ndarray:
        size = self.index["block_ids"]
        if end <= start:
            return np.zeros(0, np.uint32)
        parts = [self.block(k) for k in range(start // size, (end - 1) // size + 1)]
        return np.concatenate(parts)[start - start // size * size :][: end - start]

    def documents(self) -> Iterator[tuple[object, int, int]]:
        """(document, ids, crc32 of its ids) in order, a block in memory at a time."""
        k, block, at = -1, np.zeros(0, np.uint32), 0
        for doc, n in zip(self.index["docs"], self.index["sizes"]):
            left, crc = n, 0
            while left:
                if at == len(block):
                    k, at = k + 1, 0
                    block = self.block(k)
                part = block[at : at + left]
                crc = zlib.crc32(part.tobytes(), crc)
                at, left = at + len(part), left - len(part)
            yield doc, n, crc


def write_token_files(df: DataFrame, vocabulary: str, folder: str, end_id: int | None = 2, id_column: str = "doc_id", text_column: str = "text", bits: bool = False) -> DataFrame:
    """Encodes and writes all texts in ascending order of ids, and returns the manifest: part, path,
    n_docs, n_ids, and start (the ids of all files before)."""
    spark = df.sparkSession
    ship(spark)

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = library_encoder(vocabulary)
        end = np.array([] if end_id is None else [end_id], np.uint32)
        part = TaskContext.get().partitionId()
        writer = path = None
        for batch in batches:
            for doc, ids in zip(batch.column(0).to_pylist(), encoder.encode(batch.column(1).to_pylist())):
                if writer is None:
                    path = f"{folder}/part-{part:06d}-{uuid.uuid4().hex}.planes"
                    store, at = open_store(path)
                    store.create_dir(at.rpartition("/")[0], recursive=True)
                    writer = PlaneWriter(store.open_output_stream(at), bits=bits)
                writer.add(doc, np.concatenate([ids, end]))
        if writer:
            writer.close()
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "path": [path], "n_docs": pa.array([len(writer.docs)], pa.int64()), "n_ids": pa.array([writer.total], pa.int64())})

    rows = df.select(F.col(id_column).cast("long").alias("doc_id"), utf8(text_column).alias("text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    rows.mapInArrow(run, "part int, path string, n_docs long, n_ids long").write.parquet(f"{folder}/manifest")
    return read_manifest(spark, folder)


def read_manifest(spark: SparkSession, folder: str) -> DataFrame:
    rows = spark.read.schema("part int, path string, n_docs long, n_ids long").parquet(f"{folder}/manifest")
    return rows.withColumn("start", F.sum("n_ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n_ids"))


def read_token_files(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document, from the files; a task reads whole files,
    block by block."""
    ship(manifest.sparkSession)

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                store, at = open_store(path)
                with store.open_input_file(at) as f:
                    found = list(PlaneReader(f).documents())
                n = np.array([x[1] for x in found], np.int64)
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array([x[0] for x in found], pa.int64()), "start": start + np.cumsum(n) - n, "n_tokens": n, "ids_crc32": pa.array([x[2] for x in found], pa.int64())})

    files = manifest.select("path", "start")
    return files.repartition(max(1, manifest.count())).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def stored_tokens(df: DataFrame, vocabulary: str, end_id: int = 2) -> DataFrame:
    """Written to the shared folder and read back."""
    return read_token_files(write_token_files(df, vocabulary, shared_folder(df.sparkSession, "token_files"), end_id))
