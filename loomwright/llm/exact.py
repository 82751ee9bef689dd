"""Exact deduplication without a hot group in any task.

Texts are equal if they are identical without ASCII white space.  Each task first combines its own rows
(partial aggregation), then the groups of a digest meet in as many parts as there are salts, then the
winners of the salts meet.  The full normalised text is a grouping key at each of these stages, the last
one too, so equal digests of different texts stay apart.  The last stage counts the texts of each digest:
where it has one text only, each row finds its group by the digest, which then says as much as the text;
where it has several, rows find theirs by the text itself.

Null texts are empty; all empty texts are equal.  Rows with a null id never stay while another row of
their group has an id.  Rows that repeat an id and text count in group_size and get the same values.
An empty table gives no rows; other columns aren't read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwright.llm.common import released, ship, utf8, written

SALTS = 32
SPACE = b" \t\n\x0b\x0c\r"


def digests(df: DataFrame, id_column: str, text_column: str, width: int, with_text: bool) -> DataFrame:
    """doc_id, n_points of the original, sha of the normalised text, key (its first bytes), and the text if asked."""
    ship(df.sparkSession)

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            norm = [t.translate(None, SPACE) for t in batch.column(2).to_pylist()]
            columns = {"doc_id": batch.column(0), "n_points": batch.column(1), "sha": pa.array([hashlib.sha256(t).digest() for t in norm], pa.binary())}
            yield pa.RecordBatch.from_pydict(columns | ({"norm": pa.array(norm, pa.binary())} if with_text else {}))

    rows = df.select(F.col(id_column).cast("long").alias("doc_id"), F.coalesce(F.length(text_column), F.lit(0)).cast("long").alias("n_points"), utf8(text_column).alias("text"))
    rows = rows.mapInArrow(run, "doc_id long, n_points long, sha binary" + ", norm binary" * with_text)
    return rows.withColumn("key", F.substring("sha", 1, width))


def exact_duplicates(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", width: int = 32) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of each row.  width: bytes of the digest that key groups."""
    salted = digests(df, id_column, text_column, width, True).withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    parts = salted.groupBy("key", "norm", "n_points", "salt").agg(F.min("doc_id").alias("first"), F.count("*").alias("n"))
    # dealt out once, by the digest: at most SALTS rows a text and length meet
    sizes = parts.repartition("key").groupBy("key", "norm", "n_points").agg(F.min("first").alias("first"), F.sum("n").alias("n"))
    whole = sizes.groupBy("key", "norm").agg(F.max_by("first", F.when(F.col("first").isNotNull(), F.col("n_points"))).alias("keep_id"), F.sum("n").alias("group_size"))
    groups = whole.groupBy("key").agg(F.count("*").alias("n_texts"), F.min("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
    groups = written(groups, "groups")  # a table of its own: Spark can split the join where a digest is frequent
    rows = digests(df, id_column, text_column, width, False).join(groups.where("n_texts = 1"), "key")
    out = ["doc_id", "keep_id", "group_size", "sha"]
    rows = rows.select(*out)
    several = groups.where("n_texts > 1").select("key")
    if not several.isEmpty():
        apart = written(whole.join(several, "key", "left_semi"), "apart")
        rows = rows.unionByName(digests(df, id_column, text_column, width, True).join(apart, ["key", "norm"]).select(*out))
    return rows.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))
