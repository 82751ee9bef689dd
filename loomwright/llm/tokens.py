"""Encoding and decoding of a table's texts with the token automaton (see bpe.py).

Null texts are empty and have no tokens.  Rows with equal or null ids stay separate rows; an empty
table gives no rows; other columns aren't read.  The automaton is broadcast: its size is that of the
vocabulary file, 2 MB compressed for 49,000 tokens, whatever the data.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwright.llm.bpe import Automaton, Decoder, automaton_encoder, compiled
from loomwright.llm.common import released, ship, utf8

_HERE: dict[str, tuple] = {}


def loaded(data: bytes) -> tuple:
    """Encoder and decoder of this process."""
    key = hashlib.sha256(data).hexdigest()
    if key not in _HERE:
        a = Automaton.loads(data)
        _HERE[key] = automaton_encoder(a), Decoder(a)
    return _HERE[key]


def tokenize(df: DataFrame, vocabulary: str, id_column: str = "doc_id", text_column: str = "text", with_ids: bool = True, with_decoded: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each text; with with_ids also ids (array<int>),
    with with_decoded also decoded (string)."""
    ship(df.sparkSession)
    data = df.sparkSession.sparkContext.broadcast(compiled(vocabulary))
    fields = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids + ", decoded string" * with_decoded

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = loaded(data.value)
        for batch in batches:
            n, ids_hash, text_hash, ids, texts = [], [], [], [], []
            for own in encoder.encode(batch.column(1).to_pylist()):
                n.append(len(own))
                ids_hash.append(hashlib.sha256(own.astype("<u4").tobytes()).hexdigest())
                text = decoder.decode(own)
                text_hash.append(hashlib.sha256(text).hexdigest())
                if with_ids:
                    ids.append(own.astype(np.int32))
                if with_decoded:
                    texts.append(text.decode())
            columns = {"doc_id": batch.column(0), "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(ids_hash, pa.string()), "decoded_sha256": pa.array(text_hash, pa.string())}
            if with_ids:
                columns["ids"] = pa.array(ids, pa.list_(pa.int32()))
            if with_decoded:
                columns["decoded"] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_pydict(columns)

    return df.select(F.col(id_column).cast("long").alias("doc_id"), utf8(text_column).alias("text")).mapInArrow(run, fields)
