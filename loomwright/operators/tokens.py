"""Token counts of corpora, their overlap and divergence, packing of token arrays, corpus statistics.

Any column expression that gives an array of tokens can be the tokenizer; the default splits at white
space.  Counting explodes tokens and combines them in each task before the shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwright.functions import text as T


def count_tokens(df: DataFrame, tokens: Column | None = None, text: str = "text") -> DataFrame:
    tokens = T.tokens(F.col(text)) if tokens is None else tokens
    return df.select(F.explode(tokens).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


def frequencies(counts: DataFrame) -> DataFrame:
    total = counts.agg(F.sum("n").alias("total"))
    return counts.crossJoin(F.broadcast(total)).withColumn("f", F.col("n") / F.col("total")).drop("total")  # one row


def both(a: DataFrame, b: DataFrame) -> DataFrame:
    """token, n_a, n_b over the union of both vocabularies."""
    return a.withColumnRenamed("n", "n_a").join(b.withColumnRenamed("n", "n_b"), "token", "full_outer").select("token", F.coalesce("n_a", F.lit(0)).alias("n_a"), F.coalesce("n_b", F.lit(0)).alias("n_b"))


def overlap(pair: DataFrame) -> DataFrame:
    one = pair.agg(F.count_if(F.expr("n_b = 0")).alias("only_a"), F.count_if(F.expr("n_a = 0")).alias("only_b"), F.count_if(F.expr("n_a > 0 and n_b > 0")).alias("shared"), F.count("*").alias("n_union"))
    return one.withColumn("jaccard", F.round(F.coalesce(F.try_divide("shared", "n_union"), F.lit(0.0)), 6))


def frequency_difference(a: DataFrame, b: DataFrame, k: int) -> DataFrame:
    """The k tokens whose relative frequencies differ most."""
    fa, fb = frequencies(a).select("token", F.col("f").alias("fa")), frequencies(b).select("token", F.col("f").alias("fb"))
    rows = fa.join(fb, "token", "full_outer").select("token", F.round(F.coalesce("fa", F.lit(0.0)) - F.coalesce("fb", F.lit(0.0)), 9).alias("diff"))
    return rows.orderBy(F.desc(F.abs("diff")), "token").limit(k)


def kl_divergence(p: DataFrame, q: DataFrame, floor: float = 1e-12) -> DataFrame:
    """Sum over the tokens of p; tokens that q lacks count with the floor, and nothing is normalised anew."""
    fp, fq = frequencies(p).select("token", F.col("f").alias("p")), frequencies(q).select("token", F.col("f").alias("q"))
    return fp.join(fq, "token", "left").agg(F.round(F.sum(F.col("p") * F.log(F.col("p") / F.coalesce("q", F.lit(floor)))), 6).alias("kl"))


def piece_lengths(counts: DataFrame) -> DataFrame:
    """length, the share of occurrences, and the weighted mean of lengths."""
    rows = counts.groupBy(F.length("token").cast("long").alias("length")).agg(F.sum("n").alias("n")).where("length > 0")
    all_ = Window.partitionBy()
    return rows.select("length", "n", F.round(F.col("n") / F.sum("n").over(all_), 9).alias("share"), F.round(F.sum(F.col("length") * F.col("n")).over(all_) / F.sum("n").over(all_), 6).alias("mean_length"))


def composition(pair: DataFrame, script: Column) -> DataFrame:
    """Per script: tokens of A, of B, of A only, of B only, of both, and the script's own Jaccard."""
    rows = pair.groupBy(script.alias("script")).agg(F.count_if(F.expr("n_a > 0")).alias("a"), F.count_if(F.expr("n_b > 0")).alias("b"), F.count_if(F.expr("n_b = 0")).alias("only_a"), F.count_if(F.expr("n_a = 0")).alias("only_b"), F.count_if(F.expr("n_a > 0 and n_b > 0")).alias("shared"))
    return rows.withColumn("jaccard", F.round(F.try_divide("shared", F.col("only_a") + F.col("only_b") + F.col("shared")), 6))


def with_offsets(df: DataFrame, size: Column, order: str, group: list[str]) -> DataFrame:
    """start: the sum of size over the rows of the group before, in the order."""
    w = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("start", F.sum(size).over(w) - size)


def pack_blocks(df: DataFrame, ids: str, order: str, batch: Column, length: int, head: int | None = None, keep_short: bool = False) -> DataFrame:
    """batch, block, ids: the tokens of a batch of rows one after another, in blocks of `length`; a rest that
    doesn't fill a block goes.  head: a token that every block begins with (it takes one place).
    keep_short: a batch that doesn't fill one block at all stays as a short block."""
    body = length - (head is not None)
    rows = with_offsets(df.select(batch.alias("batch"), F.col(order).alias("o"), F.col(ids).alias("ids")), F.size("ids"), "o", ["batch"])
    tokens = rows.select("batch", "start", F.posexplode("ids").alias("i", "id")).withColumn("at", F.col("start") + F.col("i"))
    blocks = tokens.groupBy("batch", F.floor(F.col("at") / body).alias("block")).agg(F.array_sort(F.collect_list(F.struct("at", "id"))).alias("x"))
    full = F.size("x") == body
    blocks = blocks.where(full | (F.col("block") == 0) & ~full) if keep_short else blocks.where(full)
    out = F.transform("x", lambda t: t["id"])
    return blocks.select("batch", "block", (F.concat(F.array(F.lit(head)), out) if head is not None else out).alias("ids"))


def longest_first(df: DataFrame, length: str, order: str) -> DataFrame:
    """The rows with place, from 0, the longest first, ties by order.  Rows are counted for each length, and
    ranked only among those of their own."""
    down = Window.orderBy(F.desc(length)).rowsBetween(Window.unboundedPreceding, 0)  # a row for each length
    before = df.groupBy(length).agg(F.count("*").alias("__n")).select(F.col(length).alias("__l"), (F.sum("__n").over(down) - F.col("__n")).alias("__b"))
    rows = df.withColumn("__i", F.row_number().over(Window.partitionBy(length).orderBy(order)) - 1)
    return rows.join(before, F.col(length).eqNullSafe(F.col("__l"))).select(*df.columns, (F.col("__b") + F.col("__i")).cast("long").alias("place"))


def budget_batches(df: DataFrame, order: list[str], length: str, budget: int, most: int, group: str | None = None) -> DataFrame:
    """Longest first: a batch is cut where one more row would exceed budget = rows * longest ** 2, or `most`
    rows.  Cutting is sequential, so it runs within groups, one after another within a group only."""
    schema = df.schema.simpleString()[7:-1]

    def cut(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([length, *order], ascending=[False] + [True] * len(order), kind="stable")
        out, batch, n, top = [], 0, 0, 0
        for size in pdf[length]:
            longest = max(top, size)
            if n and ((n + 1) * longest * longest > budget or n >= most):
                batch, n, top = batch + 1, 1, size
            else:
                n, top = n + 1, longest
            out.append(batch)
        return pdf.assign(batch=out)

    keyed = df.groupBy(group) if group else df.groupBy(F.lit("all").alias("all"))
    return keyed.applyInPandas(cut, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema) + ", batch long")


def corpus_statistics(df: DataFrame, n: Column, limit: int, kept: Column | None = None) -> DataFrame:
    """Rows, truncated share, tokens, tokens after truncation, mean length and packed sequences."""
    rows = df.select(n.cast("long").alias("n"))
    one = rows.agg(F.count("*").alias("n_rows"), F.round(100 * F.avg((F.col("n") > limit).cast("int")), 6).alias("truncated_pct"), F.sum("n").alias("n_tokens"), F.sum(F.least("n", F.lit(limit))).alias("n_kept"), F.round(F.avg("n"), 6).alias("mean_tokens"))
    return one.withColumn("n_sequences", F.floor(F.col("n_tokens") / limit).cast("long"))


def length_distribution(df: DataFrame, n: Column, percentiles: list[float]) -> DataFrame:
    """p and the element of the sorted lengths at min(floor(n * p / 100), n - 1)."""
    counts = df.groupBy(n.cast("long").alias("v")).agg(F.count("*").alias("c"))
    up = Window.orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    counts = counts.withColumn("upto", F.sum("c").over(up)).withColumn("n", F.sum("c").over(Window.partitionBy()))
    ps = counts.crossJoin(F.broadcast(df.sparkSession.createDataFrame([(float(p),) for p in percentiles], "p double")))
    return ps.where(F.col("upto") > F.least(F.floor(F.col("n") * F.col("p") / 100), F.col("n") - 1)).groupBy("p").agg(F.min("v").alias("length"))


def coverage(df: DataFrame, n: Column, limits: list[int]) -> DataFrame:
    """For each maximum length: share of rows that fit, of tokens kept, and of a padded batch that is waste."""
    rows = df.select(n.cast("long").alias("n"))
    parts = [F.struct(F.lit(m).alias("most"), (F.col("n") <= m).cast("int").alias("fits"), F.least("n", F.lit(m)).cast("long").alias("kept")) for m in limits]
    each = rows.select("n", F.explode(F.array(*parts)).alias("x")).groupBy("x.most").agg(F.avg("x.fits").alias("a"), F.sum("x.kept").alias("k"), F.sum("n").alias("t"), F.count("*").alias("c"))
    return each.select("most", F.round(100 * F.col("a"), 6).alias("fits_pct"), F.round(100 * F.col("k") / F.col("t"), 6).alias("kept_pct"), F.round(100 * (1 - F.col("k") / (F.col("c") * F.col("most"))), 6).alias("waste_pct"))


def map_batches(df: DataFrame, f, schema: str) -> DataFrame:
    """f from a pandas batch to a batch: for tokenizers and models that aren't column expressions."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            yield f(pdf)

    return df.mapInPandas(run, schema)
