"""Connected components of links between long node ids, by alternating large and small stars.

Every round is two aggregations and two joins over all links, and its result is a written table, so a
lost executor costs one round at most and nothing is gathered in the driver but a count and a checksum.
A hub's links are combined before they are shuffled, and joins with one row a node on the other side
are split by Spark where one key is frequent.  Links that have been counted, at most FEW, are joined by one
task instead of dozens of stages: the same components.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwright.llm.common import scratch, ship, written

#: Links that one task takes: 16 bytes each, and as much again for their nodes.
FEW = 1 << 18


def forest(n: int, pairs: Iterable[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """For each of n positions, the smallest that the pairs connect it with."""
    label = np.arange(n)
    for i, j in pairs:
        while len(i):
            a, b = label[i], label[j]
            low, high = np.minimum(a, b), np.maximum(a, b)
            open_ = low < high
            if not open_.any():
                break
            i, j = i[open_], j[open_]
            np.minimum.at(label, high[open_], low[open_])
            while True:  # to the roots
                up = label[label]
                if (up == label).all():
                    break
                label = up
    return label


def _large_star(links: DataFrame) -> DataFrame:
    both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(low, "u").where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(low, "u").where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(low.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct()


def _in_one_task(links: DataFrame) -> DataFrame:
    """a, b: each node but the smallest of a component, and that one."""
    ship(links.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
        if ends:
            a, b = (np.concatenate(x) for x in zip(*ends))
            names, place = np.unique(np.concatenate([a, b]), return_inverse=True)
            label = forest(len(names), [(place[: len(a)], place[len(a) :])])
            moved = np.flatnonzero(label != np.arange(len(names)))
            yield pa.RecordBatch.from_pydict({"a": names[moved], "b": names[label[moved]]})

    return links.select("a", "b").coalesce(1).mapInArrow(run, "a long, b long")


def components(links: DataFrame, few: int = FEW) -> DataFrame:
    """links: a, b (long).  Returns node, component (its smallest node) for every node of a link;
    links of a node with itself and null ends don't count."""
    with scratch(links.sparkSession, "components") as keep:
        links = written(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
        before = None
        while True:
            now = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
            if now == before or now[0] <= few:
                break
            before = now
            links = written(_small_star(_large_star(links)), "links")
        links = keep(_in_one_task(links) if now != before else links, "stars")
    stars = links.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())
