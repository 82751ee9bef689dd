"""A training corpus from documents: toxic ones go, repeated runs of lines go, one of each group of near
copies stays, passages that other documents hold go, and what is left is packed into sequences.

Every stage works on all rows that the stage before kept and is written as Parquet before the next one
reads it, so a lost executor costs tasks of one stage.  All but the last return the columns of documents,
further ones too, whatever their names; n_chars follows the text.

Null texts are empty: they are clean and all alike, so the near-copy stage keeps one of them, and packing
makes it a lone end id.  Of rows that are near copies of each other the one with the smallest id stays, of
ties and of rows without an id, which come last, the one of the smallest hash of text and columns; rows
that repeat each other wholly are one.  Rows with equal ids and different texts are documents of their own.
A text that loses all its lines or passages stays as an empty one.  Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwright.llm import lines, packing, simhash, substring, toxicity
from loomwright.llm.common import table, written
from loomwright.llm.encode import default_vocabulary
from loomwright.llm.queries import TOXIC_FROM, fitted_toxicity

CAPACITY, END_ID = 2048, 1


def _retold(docs: DataFrame, operate: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """docs with the texts that operate gives them, n_chars counted anew.  The operator sees the other columns
    by names of no meaning, so that none can clash with a column of its own."""
    own = {c: c if c in ("doc_id", "text") else f"column_{i}" for i, c in enumerate(docs.columns)}
    rows = operate(docs.select(*[F.col(f"`{c}`").alias(n) for c, n in own.items()]))
    kind = {f.name: f.dataType for f in docs.schema}
    return rows.select(*[(F.length("text").cast(kind[c]) if c == "n_chars" else F.col(n)).alias(c) for c, n in own.items()])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep_clean(docs, fitted_toxicity(docs, table(spark, sf_dir, "labels")), TOXIC_FROM)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _retold(docs, lines.dedup_lines)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_first(docs)


def drop_shared_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _retold(docs, substring.dedup_substrings)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, default_vocabulary(), END_ID, CAPACITY)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("simhash_near_dedup", drop_near_copies),
    ("substring_dedup", drop_shared_passages),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs


#: SQL has no training, fingerprints of word shingles or vocabulary: tests compare with a plain version.
ORACLE_SQL = None
