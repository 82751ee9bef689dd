"""Cost-balanced packing of documents into sequences.

The cost of a piece of n tokens is estimated as linear * n + quadratic * n * n: the layers that work on
each token, and attention within the piece.  Documents are dealt in descending order of cost, each to
the cheapest sequence that has room for it.

Packing needs no shuffle: a task packs its own documents in groups of bounded tokens, so memory and
work don't depend on the size of the input, a lost task is repeated alone, and any number of tasks run
side by side.  The capacities of a group's sequences add up to its tokens exactly: as many of
`capacity` as fit, and powers of two for the rest.  A sequence whose length is a power of two needs no
padding, so there is none at all.  What fits nowhere whole is cut.

Null or empty texts are a lone end id.  Rows with equal or null ids are separate documents.  An empty
table gives no rows.  Other columns aren't read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwright.llm.common import released, ship, utf8
from loomwright.llm.encode import library_encoder

#: Tokens and documents that are packed together at most (one more document may reach over the first).
GROUP_TOKENS, GROUP_DOCUMENTS = 1 << 20, 1 << 14


def capacities(tokens: int, capacity: int) -> list[int]:
    """Room of the sequences that hold just as many tokens."""
    rest = tokens % capacity
    return [capacity] * (tokens // capacity) + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def pack(lengths: np.ndarray, capacity: int = 2048, linear: float = 1.0, quadratic: float = 1 / 4096) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of each piece; sequences are numbered from 0."""
    out = []
    sequences = 0
    pool: list[tuple[int, int, int]] = []
    for doc, n in enumerate(lengths.tolist()):
        whole = n // capacity * capacity
        for start in range(0, whole, capacity):
            out.append((doc, start, capacity, sequences, 0))
            sequences += 1
        if n > whole:
            pool.append((n - whole, doc, whole))
    pool.sort(key=lambda x: (-x[0], x[1]))
    room = np.array(capacities(sum(x[0] for x in pool), capacity), np.int64)
    used = np.zeros(len(room), np.int64)
    cost = np.zeros(len(room))
    for n, doc, start in pool:
        while n:
            fits = room >= n
            if fits.any():
                take = n
            else:
                fits, take = room > 0, 0
            s = int(np.where(fits, cost, np.inf).argmin())
            take = take or int(room[s])
            out.append((doc, start, take, sequences + s, int(used[s])))
            room[s] -= take
            used[s] += take
            cost[s] += linear * take + quadratic * take * take
            start, n = start + take, n - take
    return out


def pack_documents(df: DataFrame, vocabulary: str, end_id: int = 1, capacity: int = 2048, id_column: str = "doc_id", text_column: str = "text", with_ids: bool = False, linear: float = 1.0, quadratic: float = 1 / 4096) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and with
    with_ids its ids as array<int>."""
    ship(df.sparkSession)
    fields = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * with_ids

    def flush(ids: list, tokens: list[np.ndarray], first: int) -> tuple[pa.RecordBatch, int]:
        pieces = pack(np.array([len(t) for t in tokens], np.int64), capacity, linear, quadratic)
        doc, start, length, sequence, offset = (list(x) for x in zip(*pieces))
        parts = [tokens[d][s : s + n] for d, s, n in zip(doc, start, length)]
        columns = {"doc_id": pa.array([ids[d] for d in doc], pa.int64()), "start": pa.array(start, pa.int64()), "length": pa.array(length, pa.int64()), "ids_crc32": pa.array([zlib.crc32(p.astype("<u4").tobytes()) for p in parts], pa.int64()), "doc_tokens": pa.array([len(tokens[d]) for d in doc], pa.int64()), "sequence_id": pa.array([first + s for s in sequence], pa.int64()), "offset": pa.array(offset, pa.int64())}
        if with_ids:
            columns["ids"] = pa.array([p.astype(np.int32) for p in parts], pa.list_(pa.int32()))
        return pa.RecordBatch.from_pydict(columns), first + max(sequence) + 1

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = library_encoder(vocabulary)
        first = TaskContext.get().partitionId() << 40
        ids: list = []
        tokens: list[np.ndarray] = []
        size = 0
        end = np.array([end_id], np.uint32)
        for batch in batches:
            for doc, own in zip(batch.column(0).to_pylist(), encoder.encode(batch.column(1).to_pylist())):
                ids.append(doc)
                tokens.append(np.concatenate([own, end]))
                size += len(own) + 1
                if size >= GROUP_TOKENS or len(ids) >= GROUP_DOCUMENTS:
                    out, first = flush(ids, tokens, first)
                    yield out
                    ids, tokens, size = [], [], 0
        if ids:
            yield flush(ids, tokens, first)[0]

    return df.select(F.col(id_column).cast("long").alias("doc_id"), utf8(text_column).alias("text")).mapInArrow(run, fields)
