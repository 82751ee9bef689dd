"""Embeddings as arrays: centroids, cosines, neighbours, divergence of distributions, spectra, clusters.

Sums over dimensions go through (dimension, value) rows or through d x d matrices that tasks add up, so
what reaches the driver is bounded by the dimension, never by the number of vectors.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwright.functions import arrays as R


def centroids(df: DataFrame, vector: str, keys: list[str]) -> DataFrame:
    """keys, centroid (array of double): the mean of each dimension."""
    rows = df.select(*keys, F.posexplode(vector).alias("i", "x")).groupBy(*keys, "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("i", "m"))).alias("x")).select(*keys, F.transform("x", lambda e: e["m"]).alias("centroid"))


def compare(a: Column, b: Column) -> list[Column]:
    """cosine, cosine distance, L2 distance and angle of two vectors."""
    cos = R.cosine(a, b)
    return [F.round(cos, 6).alias("cosine"), F.round(1 - cos, 6).alias("cosine_distance"), F.round(F.sqrt(R.squared_distance(a, b)), 6).alias("l2"), F.round(R.angle(cos), 4).alias("degrees")]


def to_centroid(df: DataFrame, vector: str, keys: list[str]) -> DataFrame:
    """Each row with its cosine distance to the centroid of its group (one row a group: broadcast if few)."""
    c = centroids(df, vector, keys)
    return df.join(c, keys).withColumn("distance", 1 - R.cosine(F.col(vector), F.col("centroid"))).drop("centroid")


def histogram(df: DataFrame, x: Column, low: float, high: float, bins: int, keys: list[str] | None = None) -> DataFrame:
    """keys, bin, n and density; values outside don't count, the last bin holds its upper end."""
    width = (high - low) / bins
    bin_ = F.when(x == high, bins - 1).otherwise(F.floor((x - low) / width)).cast("int")
    rows = df.where((x >= low) & (x <= high)).groupBy(*(keys or []), bin_.alias("bin")).agg(F.count("*").alias("n"))
    return rows.withColumn("density", F.round(F.col("n") / F.sum("n").over(Window.partitionBy(*(keys or []))) / width, 6))


def neighbours(df: DataFrame, queries: DataFrame, key: str, vector: str, k: int, block: int = 4096) -> DataFrame:
    """query, key, rank, similarity: the k most similar rows of each query by cosine, itself left out, ties
    by key.  Queries (a stated set) are broadcast in blocks of bounded size; each task multiplies its
    batches with them and keeps k for each query, then k of those are kept."""
    spark = df.sparkSession
    n = queries.count()
    numbered = queries.select(F.col(key).cast("long").alias("k"), F.col(vector).alias("v"))
    out = None
    parts = max(1, -(-n // block))
    for part in range(parts):
        mine = numbered.where(F.pmod(F.xxhash64("k"), F.lit(parts)) == part).collect()  # about `block` vectors
        shared = spark.sparkContext.broadcast((np.array([r[0] for r in mine], np.int64), np.array([r[1] for r in mine], np.float64)))

        def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            ids, q = shared.value
            q = q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300) if len(ids) else q
            for pdf in it:
                if not len(pdf) or not len(ids):
                    continue
                x = np.stack(pdf["v"].to_numpy()).astype(np.float64)
                own = pdf["k"].to_numpy()
                sim = np.round(q @ (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)).T, 6)
                sim[ids[:, None] == own[None, :]] = -np.inf
                order = np.lexsort((np.broadcast_to(own, sim.shape), -sim), axis=1)[:, :k]
                rows = np.repeat(np.arange(len(ids)), order.shape[1])
                cols = order.ravel()
                keep = np.isfinite(sim[rows, cols])
                yield pd.DataFrame({"query": ids[rows][keep], "key": own[cols][keep], "similarity": sim[rows, cols][keep]})

        one = df.select(F.col(key).cast("long").alias("k"), F.col(vector).alias("v")).mapInPandas(run, "query long, key long, similarity double")
        out = one if out is None else out.unionByName(one)
    w = Window.partitionBy("query").orderBy(F.desc("similarity"), "key")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query", "key", "rank", "similarity")


def hubness(near: DataFrame) -> DataFrame:
    """key, n: how often a row is among another's nearest."""
    return near.groupBy("key").agg(F.count("*").alias("n"))


def hub_histogram(hubs: DataFrame) -> DataFrame:
    """n (how often a row is among another's nearest) and how many rows that holds for."""
    return hubs.groupBy("n").agg(F.count("*").alias("n_rows"))


def top_hubs(hubs: DataFrame, k: int = 10) -> DataFrame:
    return hubs.orderBy(F.desc("n"), "key").limit(k)


def most_similar_pair(pairs: DataFrame, keys: list[str], x: str = "x", y: str = "y", cosine: str = "cosine") -> DataFrame:
    """The pair of the largest cosine within the keys; of ties the first."""
    best = F.max_by(F.struct(x, y, cosine), F.struct(F.col(cosine), -F.col(x), -F.col(y))).alias("p")
    return pairs.groupBy(*keys).agg(best).select(*keys, f"p.{x}", f"p.{y}", f"p.{cosine}")


#: Vectors a side that a kernel matrix is made of at most.
MMD_VECTORS = 10_000


def rbf_mmd(a: DataFrame, b: DataFrame, vector: str, most: int = MMD_VECTORS, block: int = 256) -> DataFrame:
    """Unbiased MMD with a Gaussian kernel whose bandwidth is the median of the positive cross distances, and
    that sigma, for two samples of at most `most` vectors, which the tasks hold; each takes blocks of rows
    against all.  The median is exact: distances are counted in ranges, and only the values of the ranges
    in the middle are sent to the driver."""
    spark = a.sparkSession
    both = []
    for df in (a, b):
        rows = df.select(F.col(vector).cast("array<double>")).limit(most + 1).collect()
        if len(rows) > most:
            raise ValueError(f"more than {most} vectors a side: take a sample")
        both.append(np.array([r[0] for r in rows]))
    if not all(map(len, both)):
        return spark.createDataFrame([(None, None)], "mmd double, sigma double")
    shared = spark.sparkContext.broadcast(both)

    def blocks(kind: str, each: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> list[np.ndarray]:
        """each(squared distances, whether they count) of blocks of rows, added up or put together by the caller."""
        left, right = (0 if kind == "a" else 1 if kind == "b" else 0), (0 if kind == "a" else 1)

        def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            x, y = shared.value[left], shared.value[right]
            for pdf in it:
                for k in pdf["id"]:
                    own = x[k * block : (k + 1) * block]
                    d = np.maximum((own**2).sum(1)[:, None] + (y**2).sum(1)[None] - 2 * own @ y.T, 0)
                    near = d < 1e-9 * ((own**2).sum(1)[:, None] + (y**2).sum(1)[None])  # cancelled: take the difference
                    for i, j in zip(*np.nonzero(near)):
                        d[i, j] = ((own[i] - y[j]) ** 2).sum()
                    counts = np.ones(d.shape, bool)
                    if kind != "ab":
                        counts[np.arange(len(own)), k * block + np.arange(len(own))] = False
                    yield pd.DataFrame({"x": [each(d, counts)]})

        n = -(-len(both[left]) // block)
        return [np.array(r[0]) for r in spark.range(0, n, 1, n).mapInPandas(run, "x array<double>").collect()]

    top = (np.sqrt((both[0] ** 2).sum(1).max()) + np.sqrt((both[1] ** 2).sum(1).max())) ** 2 * (1 + 1e-9) + 1e-300
    edges = np.linspace(0, top, 4097)
    counts = sum(blocks("ab", lambda d, _: np.histogram(d[d > 0], edges)[0].astype(float))).astype(np.int64)
    n = int(counts.sum())
    if n:
        upto = np.cumsum(counts)
        low, high = np.searchsorted(upto, [(n - 1) // 2, n // 2], "right").tolist()
        inside = np.sort(np.concatenate(blocks("ab", lambda d, _: d[(d > 0) & (d >= edges[low]) & ((d < edges[high + 1]) | (high == 4095))])))
        before = int(upto[low - 1]) if low else 0
        s = float((inside[(n - 1) // 2 - before] + inside[n // 2 - before]) / 2)
    else:
        s = 1.0

    def mean(kind: str) -> float:
        total = sum(blocks(kind, lambda d, ok: np.array([np.exp(-d[ok] / s).sum(), float(ok.sum())])))
        return float(total[0] / total[1]) if total[1] else 0.0

    mmd = max(mean("a") + mean("b") - 2 * mean("ab"), 0.0) ** 0.5
    return spark.createDataFrame([(round(mmd, 6), round((s / 2) ** 0.5, 6))], "mmd double, sigma double")


def gram(df: DataFrame, vector: str) -> tuple[int, np.ndarray, np.ndarray]:
    """n, sum and sum of outer products: each task adds up its own, the driver gets a d x d matrix a task
    group by tree aggregation."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, total, outer = 0, None, None
        for pdf in it:
            if len(pdf):
                x = np.stack(pdf["v"].to_numpy()).astype(np.float64)
                n += len(x)
                total = x.sum(0) if total is None else total + x.sum(0)
                outer = x.T @ x if outer is None else outer + x.T @ x
        if n:
            d = len(total)
            yield pd.DataFrame({"i": np.arange(d + 2), "row": [np.full(1, float(n)), total, *outer]})

    parts = df.select(F.col(vector).alias("v")).mapInPandas(run, "i long, row array<double>")
    each = parts.select("i", F.posexplode("row").alias("j", "x")).groupBy("i", "j").agg(F.sum("x").alias("x")).toPandas()  # d * (d + 1) + 1 numbers
    d = int(each["i"].max()) - 1
    full = np.zeros((d + 2, d))
    full[each["i"].to_numpy(), each["j"].to_numpy()] = each["x"].to_numpy()
    return int(round(full[0, 0])), full[1], full[2:]


def mean_covariance(df: DataFrame, vector: str, ddof: int = 0) -> tuple[np.ndarray, np.ndarray]:
    n, total, outer = gram(df, vector)
    mean = total / n
    return mean, (outer - n * np.outer(mean, mean)) / (n - ddof)


def gaussian_kl(m0: np.ndarray, c0: np.ndarray, m1: np.ndarray, c1: np.ndarray, ridge: float = 1e-3) -> float:
    """The divergence of two Gaussians, with a ridge on both covariances.  A singular one is inverted as far as it
    goes; where a determinant isn't positive, the logarithms of the singular values (and the ridge) count."""
    d = len(m0)
    c0, c1 = c0 + ridge * np.eye(d), c1 + ridge * np.eye(d)
    try:
        inverse = np.linalg.inv(c1)
    except np.linalg.LinAlgError:
        inverse = np.linalg.pinv(c1)
    signs, logs = zip(*map(np.linalg.slogdet, (c0, c1)))
    if min(signs) <= 0:
        logs = [np.log(np.linalg.svd(c, compute_uv=False) + ridge).sum() for c in (c0, c1)]
    gap = m1 - m0
    return float(0.5 * (logs[1] - logs[0] - d + np.trace(inverse @ c0) + gap @ inverse @ gap))


def gaussian_js(m0: np.ndarray, c0: np.ndarray, m1: np.ndarray, c1: np.ndarray, ridge: float = 1e-3) -> float:
    """The Jensen-Shannon divergence with the Gaussian of the averaged parameters in the middle."""
    m, c = (m0 + m1) / 2, (c0 + c1) / 2
    return 0.5 * gaussian_kl(m0, c0, m, c, ridge) + 0.5 * gaussian_kl(m1, c1, m, c, ridge)


def spectrum(df: DataFrame, vector: str) -> DataFrame:
    """Component, eigenvalue and share of the covariance, with the effective rank exp(entropy) and the
    participation ratio."""
    _, c = mean_covariance(df, vector, ddof=1)
    e = np.clip(np.linalg.eigvalsh(c)[::-1], 0, None)
    p = e / e.sum()
    rank = float(np.exp(-(p[p > 0] * np.log(p[p > 0])).sum()))
    ratio = float(e.sum() ** 2 / (e**2).sum())
    return df.sparkSession.createDataFrame([(k, float(x), float(y), rank, ratio) for k, (x, y) in enumerate(zip(e, p))], "component int, eigenvalue double, share double, effective_rank double, participation double")


def projected(df: DataFrame, vector: str, axes: int = 2) -> DataFrame:
    """The rows with coordinates: the vectors less their mean, on the first principal axes; an axis points where
    its largest component is positive."""
    mean, c = mean_covariance(df, vector, ddof=1)
    top = np.linalg.eigh(c)[1][:, ::-1][:, :axes]
    top = top * np.sign(top[np.abs(top).argmax(0), np.arange(top.shape[1])])
    away = F.zip_with(F.col(vector).cast("array<double>"), F.array(*[F.lit(float(x)) for x in mean]), lambda x, m: x - m)
    axis = [F.array(*[F.lit(float(x)) for x in top[:, k]]) for k in range(top.shape[1])]
    rows = df.withColumn("__away", away)
    return rows.withColumn("coordinates", F.array(*[R.dot(F.col("__away"), a) for a in axis])).drop("__away")


def isotropy(df: DataFrame, vector: str, axes: int = 15) -> DataFrame:
    """min Z / max Z over the first principal axes, Z the sum of exp of projections."""
    _, c = mean_covariance(df, vector, ddof=1)
    top = np.linalg.eigh(c)[1][:, ::-1][:, :axes]
    z = [F.sum(F.exp(R.dot(F.col(vector), F.array(*[F.lit(float(x)) for x in top[:, k]])))).alias(f"z{k}") for k in range(top.shape[1])]
    rows = df.agg(*z)
    zs = [F.col(f"z{k}") for k in range(top.shape[1])]
    return rows.select(F.round(F.least(*zs) / F.greatest(*zs), 6).alias("isotropy"))


def intra_cosine(df: DataFrame, vector: str, group: str) -> DataFrame:
    """group, n, mean norm and mean cosine of all pairs within, in closed form: the squared length of the sum
    of unit vectors less their number, over n(n - 1)."""
    n = R.norm(F.col(vector))
    unit = df.select(F.col(group).alias("g"), n.alias("norm"), F.when(n > 0, F.transform(vector, lambda x: x.cast("double") / n)).otherwise(F.transform(vector, lambda x: F.lit(0.0))).alias("u"))
    sums = unit.select("g", F.posexplode("u").alias("i", "x")).groupBy("g", "i").agg(F.sum("x").alias("s")).groupBy("g").agg(F.sum(F.col("s") * F.col("s")).alias("sq"))
    counts = unit.groupBy("g").agg(F.count("*").alias("n"), F.count_if(F.col("norm") > 0).alias("nz"), F.round(F.avg("norm"), 6).alias("mean_norm"))
    return counts.join(sums, "g").select(F.col("g").alias(group), "n", "mean_norm", F.round(F.try_divide(F.col("sq") - F.col("nz"), F.col("n") * (F.col("n") - 1)), 6).alias("mean_cosine"))


def clusters(df: DataFrame, vector: str, k: int, seed: int = 42) -> DataFrame:
    """The rows with cluster, by k-means over unit vectors."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import Normalizer
    from pyspark.ml.functions import array_to_vector

    rows = Normalizer(inputCol="__v", outputCol="__u").transform(df.withColumn("__v", array_to_vector(F.col(vector).cast("array<double>"))))
    model = KMeans(k=k, seed=seed, featuresCol="__u", predictionCol="cluster").fit(rows)
    return model.transform(rows).drop("__v", "__u")


def composition(rows: DataFrame, is_b: Column) -> DataFrame:
    """cluster, size, pct_b and the mean distance of the clusters' shares from the overall one."""
    each = rows.groupBy("cluster").agg(F.count("*").alias("size"), F.sum(is_b.cast("int")).alias("b"))
    all_ = Window.partitionBy()
    each = each.withColumn("pct_b", 100 * F.col("b") / F.col("size")).withColumn("base", 100 * F.sum("b").over(all_) / F.sum("size").over(all_))
    return each.select("cluster", "size", F.round("pct_b", 6).alias("pct_b"), F.round(F.avg(F.abs(F.col("pct_b") - F.col("base"))).over(all_), 6).alias("skew"))


def sampled_cosines(a: DataFrame, b: DataFrame, key: str, vector: str, n: int, seed: str = "p") -> DataFrame:
    """n, mean and population deviation of the cosines of n pairs, a row of a and a row of b each, drawn with
    replacement by a hash of the draw's number; for pairs within a table both are that table."""
    spark = a.sparkSession

    def drawn(df: DataFrame, side: str) -> DataFrame:
        rows = numbered(df.select(F.col(key).alias("k"), F.col(vector).alias("v")), "k")
        size = rows.agg(F.max("place").alias("m"))
        draws = spark.range(n).select(F.col("id").alias("draw"), F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}{side}|"), F.col("id").cast("string"))), 1, 8), 16, 10).cast("bigint").alias("h"))
        places = draws.crossJoin(F.broadcast(size)).select("draw", F.pmod("h", F.col("m") + 1).alias("place"))  # one row
        return rows.join(places, "place").select("draw", F.col("v").alias(side))

    pairs = drawn(a, "x").join(drawn(b, "y"), "draw").select(R.cosine(F.col("x"), F.col("y")).alias("c"))
    return pairs.agg(F.count("*").alias("n"), F.round(F.avg("c"), 6).alias("mean"), F.round(F.stddev_pop("c"), 6).alias("std"))


def numbered(df: DataFrame, key: str, bounds: int = 255) -> DataFrame:
    """The rows with place, from 0 in the order of key.  A sample of at most `bounds` keys cuts the order into
    ranges; places are counted within them and the ranges' sizes are summed, so no task sorts all rows."""
    cuts = sorted(r[0] for r in df.select(key).orderBy(F.md5(F.col(key).cast("string")), key).limit(bounds).collect())
    part = F.size(F.filter(F.array(*[F.lit(x) for x in cuts]), lambda x: x <= F.col(key))) if cuts else F.lit(0)
    rows = df.withColumn("__p", part)
    rows = rows.withColumn("__i", F.row_number().over(Window.partitionBy("__p").orderBy(key)) - 1)
    up = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, 0)
    before = df.select(part.alias("__p")).groupBy("__p").agg(F.count("*").alias("__n")).select("__p", (F.sum("__n").over(up) - F.col("__n")).alias("__b"))  # bounds + 1 rows
    return rows.join(F.broadcast(before), "__p").withColumn("place", F.col("__b") + F.col("__i")).drop("__p", "__i", "__b")


def outliers(df: DataFrame, x: Column, sigmas: float, keys: list[str] | None = None, sample: bool = False, most: int | None = None) -> DataFrame:
    """The rows whose z-score is beyond +-sigmas, with z; with `most` only those farthest out.  Means and
    deviations are aggregated and joined back: one row for each of the keys."""
    own = [f"__k{i}" for i in range(len(keys or []))]
    rows = df.select("*", *[F.col(k).alias(o) for k, o in zip(keys or [], own)], x.cast("double").alias("__x"))
    stats = rows.groupBy(*[F.col(o).alias(f"{o}_") for o in own]).agg(F.avg("__x").alias("__m"), (F.stddev_samp if sample else F.stddev_pop)("__x").alias("__d"))
    if own:
        rows = rows.join(stats, reduce(lambda a, b: a & b, [F.col(o).eqNullSafe(F.col(f"{o}_")) for o in own]))
    else:
        rows = rows.crossJoin(F.broadcast(stats))  # one row
    rows = rows.withColumn("z", F.try_divide(F.col("__x") - F.col("__m"), F.col("__d"))).where(F.abs("z") > sigmas).select(*df.columns, "z")
    return rows if most is None else rows.orderBy(F.desc(F.abs("z")), *df.columns[:1]).limit(most)


def drift(base: DataFrame, other: DataFrame, key: str, vector: str) -> DataFrame:
    """key and the cosine of its two vectors."""
    return base.select(key, F.col(vector).alias("a")).join(other.select(key, F.col(vector).alias("b")), key).select(key, R.cosine(F.col("a"), F.col("b")).alias("cosine"))


def most_moved(drift: DataFrame, key: str, k: int = 8) -> DataFrame:
    """The k keys whose vectors turned farthest: the smallest cosines."""
    return drift.orderBy("cosine", key).limit(k)
