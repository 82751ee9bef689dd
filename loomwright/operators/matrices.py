"""Weight matrices, activations and attention as long tables: statistics, spectra, histograms, thresholds.

A matrix is rows (keys, row, vals); spectra work on the Gram matrix of one matrix at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _same(a: str, b: str, keys: list[str]) -> Column:
    return reduce(lambda x, y: x & y, [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys], F.lit(True))


def _joined(rows: DataFrame, one: DataFrame, keys: list[str]) -> DataFrame:
    """rows and the one row for their keys (null keys too); Spark broadcasts it if it is small."""
    if not keys:
        return rows.crossJoin(F.broadcast(one))  # one row
    own = [c for c in one.columns if c not in keys]
    return rows.alias("l").join(one.alias("r"), _same("l", "r", keys)).select("l.*", *[F.col(f"r.{c}") for c in own])


#: Ranges that the values of a key are cut into.
RANGES = 1024


def in_ranges(df: DataFrame, keys: list[str], value: str) -> tuple[DataFrame, DataFrame]:
    """df: keys, value and __c (how often).  The rows with __p, the value's range between the least and the
    largest of its keys; and of each range __s (rows), __before (rows below) and __n (rows of the keys)."""
    stats = df.groupBy(*keys).agg(F.min(value).alias("__a"), F.max(value).alias("__z"))
    share = F.try_divide(F.col(value) - F.col("__a"), F.col("__z") - F.col("__a"))
    rows = _joined(df, stats, keys).withColumn("__p", F.coalesce(F.least(F.lit(RANGES - 1), F.floor(RANGES * share)), F.lit(0)).cast("int")).drop("__a", "__z")
    up = Window.partitionBy(*keys).orderBy("__p").rowsBetween(Window.unboundedPreceding, 0)  # RANGES rows a key
    sizes = rows.groupBy(*keys, "__p").agg(F.sum("__c").alias("__s"))
    return rows, sizes.withColumn("__before", F.sum("__s").over(up) - F.col("__s")).withColumn("__n", F.sum("__s").over(Window.partitionBy(*keys)))


def order_values(df: DataFrame, keys: list[str], x: Column, at: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """keys, n and, for each name, the element of the sorted values at the place (from 0) that its function
    gives for n.  Places come from counts of equal values, range by range: of the values only those of the
    ranges that hold a place are sorted."""
    counts = df.select(*keys, x.alias("__v")).where("__v IS NOT NULL").groupBy(*keys, "__v").agg(F.count("*").alias("__c"))
    rows, sizes = in_ranges(counts, keys, "__v")
    places = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), f(F.col("__n")).cast("long").alias("at")) for name, f in at.items()])).alias("__w")
    wanted = sizes.select(*keys, "__p", "__s", "__before", "__n", places).withColumn("__rest", F.col("__w.at") - F.col("__before"))
    wanted = wanted.where("__rest >= 0 AND __rest < __s").select(*keys, "__p", "__n", F.col("__w.name").alias("__name"), "__rest")
    hit = rows.alias("l").join(wanted.alias("r"), _same("l", "r", [*keys, "__p"])).select("l.*", "r.__n", "r.__name", "r.__rest")
    up = Window.partitionBy(*keys, "__p", "__name").orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)
    hit = hit.withColumn("__u", F.sum("__c").over(up)).where("__u > __rest AND __u - __c <= __rest")
    return hit.groupBy(*keys).agg(F.max("__n").alias("n"), *[F.max(F.when(F.col("__name") == name, F.col("__v"))).alias(name) for name in at])


def quantiles(df: DataFrame, keys: list[str], x: Column, shares: dict[str, float]) -> DataFrame:
    """keys and, for each name, the quantile with linear interpolation."""
    place = lambda n, q: F.round((n - 1) * F.lit(q), 9)
    at: dict[str, Callable[[Column], Column]] = {}
    for name, q in shares.items():
        at |= {f"{name}_low": lambda n, q=q: F.floor(place(n, q)), f"{name}_high": lambda n, q=q: F.ceil(place(n, q))}
    rows = order_values(df, keys, x.cast("double"), at)

    def between(name: str, q: float) -> Column:
        low, high = F.col(f"{name}_low"), F.col(f"{name}_high")
        return low + (high - low) * (place(F.col("n"), q) - F.floor(place(F.col("n"), q)))

    return rows.select(*keys, *[between(name, q).alias(name) for name, q in shares.items()])


def statistics(df: DataFrame, keys: list[str], vals: str = "vals", row: str | None = None) -> DataFrame:
    """mean, std (population), min, max, median, p1, p99, Frobenius norm, L1 and largest absolute value; with
    the name of the row column also the spectral norm."""
    x = df.select(*keys, F.explode(vals).alias("x")).withColumn("x", F.col("x").cast("double"))
    r = lambda c, n: F.round(c, 6).alias(n)
    one = x.groupBy(*keys).agg(F.count("*").alias("n"), r(F.avg("x"), "mean"), r(F.stddev_pop("x"), "std"), r(F.min("x"), "x_min"), r(F.max("x"), "x_max"), r(F.sqrt(F.sum(F.col("x") * F.col("x"))), "fro"), r(F.sum(F.abs("x")), "l1"), r(F.max(F.abs("x")), "absmax"))
    names = {"median": 0.5, "p1": 0.01, "p99": 0.99}
    q = quantiles(x, keys, F.col("x"), names).select(*keys, *[r(F.col(c), c) for c in names])
    out = _joined(one, q, keys)
    if row:
        top = singular_values(df, keys, row, vals).groupBy(*keys).agg(r(F.max("value"), "spectral"))
        out = _joined(out, top, keys)
    return out


def singular_values(df: DataFrame, keys: list[str], row: str = "row", vals: str = "vals", block: int = 512) -> DataFrame:
    """keys, k, value: from the Gram matrix of each matrix's smaller side, columns x columns if it is no wider
    than tall, else rows x rows.  Tasks make partial products, of their own rows or of a block of columns
    of all rows; these are added up in strips of `block` rows, and one task takes a whole Gram matrix."""
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.select(*keys).schema)
    shape = df.groupBy(*keys).agg(F.count("*").alias("__rows"), F.max(F.size(vals)).alias("__cols"))
    rows = _joined(df.select(*keys, F.col(row).alias("__row"), F.col(vals).cast("array<double>").alias("__v")), shape, keys)
    strips = f"{fields}, strip long, size long, i long, g array<double>"

    def out(key: tuple, g: np.ndarray, size: int) -> pd.DataFrame:
        i = np.arange(len(g))
        return pd.DataFrame({**{k: [v] * len(g) for k, v in zip(keys, key)}, "strip": i // block, "size": size, "i": i, "g": list(g)})

    def tall(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for key, own in pdf.groupby(keys, dropna=False, sort=False):
                x = np.stack(own["__v"].to_numpy())
                yield out(key, x.T @ x, min(x.shape[1], int(own["__rows"].iloc[0])))

    def wide(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(pdf.sort_values("__row", kind="stable")["__v"].to_numpy())
        return out(key[:-1], x @ x.T, len(x))

    def added(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf.groupby("i", sort=True)["g"].apply(lambda x: np.sum(np.stack(x.to_numpy()), axis=0))
        return pd.DataFrame({**{k: [v] * len(own) for k, v in zip(keys, key)}, "strip": key[-1], "size": pdf["size"].iloc[0], "i": own.index, "g": own.to_numpy()})

    def final(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        g = np.stack(pdf.sort_values("i")["g"].to_numpy())
        e = np.sqrt(np.clip(np.linalg.eigvalsh(g)[::-1], 0, None))[: int(pdf["size"].iloc[0])]
        return pd.DataFrame({**{k: [v] * len(e) for k, v in zip(keys, key)}, "k": np.arange(len(e)), "value": e})

    parts = rows.where("__cols <= __rows").mapInPandas(tall, strips)
    cut = rows.where("__cols > __rows").select(*keys, "__row", F.explode(F.sequence(F.lit(0), F.col("__cols") - 1, F.lit(block))).alias("__b"), "__v").withColumn("__v", F.slice("__v", F.col("__b") + 1, block))
    parts = parts.unionByName(cut.groupBy(*keys, "__b").applyInPandas(wide, strips))
    return parts.groupBy(*keys, "strip").applyInPandas(added, strips).groupBy(*keys).applyInPandas(final, f"{fields}, k long, value double")


def ranks(sv: DataFrame, keys: list[str], tolerance: float = 1e-3) -> DataFrame:
    """Effective rank (exp of the entropy of shares), stable rank, numerical rank, spectral norm and the
    first value's share."""
    w = Window.partitionBy(*keys)
    p = F.col("value") / F.sum("value").over(w)
    rows = sv.withColumn("p", p).withColumn("top", F.max("value").over(w))
    return rows.groupBy(*keys).agg(F.round(F.exp(-F.sum(F.when(F.col("p") > 0, F.col("p") * F.log("p")).otherwise(0.0))), 6).alias("effective_rank"), F.round(F.sum(F.col("value") * F.col("value")) / F.max(F.col("top") * F.col("top")), 6).alias("stable_rank"), F.count_if(F.col("value") > tolerance * F.col("top")).alias("numerical_rank"), F.round(F.max("value"), 6).alias("spectral"), F.round(F.max("p"), 6).alias("top_share"))


def head_signatures(sv: DataFrame, keys: list[str], k: int = 16) -> DataFrame:
    """keys and signature: the k largest singular values (0 where there are fewer) and the Frobenius norm."""
    top = F.slice(F.sort_array(F.collect_list("value"), asc=False), 1, k)
    rows = sv.groupBy(*keys).agg(top.alias("t"), F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("fro"))
    return rows.select(*keys, F.concat(F.col("t"), F.array_repeat(F.lit(0.0), F.lit(k) - F.size("t")), F.array("fro")).alias("signature"))


def standardise(df: DataFrame, vector: str, keys: list[str]) -> DataFrame:
    """keys and vector: each dimension less its mean, over its deviation (population; 0 counts as 1)."""
    cells = df.select(*keys, F.posexplode(vector).alias("__i", "__x"))
    d = F.stddev_pop("__x")
    stats = cells.groupBy("__i").agg(F.avg("__x").alias("__m"), F.when(d > 0, d).otherwise(1.0).alias("__d"))
    z = F.struct("__i", ((F.col("__x") - F.col("__m")) / F.col("__d")).alias("z"))
    rows = cells.join(stats, "__i").groupBy(*keys).agg(F.array_sort(F.collect_list(z)).alias("__z"))
    return rows.select(*keys, F.transform("__z", lambda e: e["z"]).alias(vector))


def log_histogram(df: DataFrame, x: str, scopes: list[Column], low: float, high: float, bins: int) -> DataFrame:
    """scope, bin, n of log10 of the positive finite values; a value counts in each of its scopes; the last
    bin holds its upper end."""
    v = F.col(x).cast("double")
    rows = df.where((v > 0) & ~F.isnan(v) & (v < float("inf"))).select(F.log10(v).alias("l"), F.explode(F.array(*scopes)).alias("scope")).where(F.col("l").between(low, high) & F.col("scope").isNotNull())
    width = (high - low) / bins
    return rows.groupBy("scope", F.when(F.col("l") == high, bins - 1).otherwise(F.floor((F.col("l") - low) / width)).cast("int").alias("bin")).agg(F.count("*").alias("n"))


def log_range(df: DataFrame, x: str) -> DataFrame:
    """The range for binning: floor of the least logarithm less 1, ceiling of the largest and 1."""
    v = F.col(x).cast("double")
    return df.where((v > 0) & ~F.isnan(v) & (v < float("inf"))).agg((F.floor(F.log10(F.min(v))) - 1).cast("int").alias("low"), (F.ceil(F.log10(F.max(v))) + 1).cast("int").alias("high"))


def cumulative(hist: DataFrame, keys: list[str], order: str = "bin", n: str = "n") -> DataFrame:
    """cdf: the share of the bins so far."""
    up = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return hist.withColumn("cdf", F.round(F.sum(n).over(up) / F.sum(n).over(Window.partitionBy(*keys)), 6))


def cumulative_share(df: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """share_upto: the value's running share within the keys, the largest values first, ties by order.  Sums run
    within ranges of values, on top of the sums of the ranges above."""
    rows, _ = in_ranges(df.withColumn("__c", F.lit(1)).withColumn("__v", F.col(value).cast("double")), keys, "__v")
    sums = rows.groupBy(*keys, "__p").agg(F.sum("__v").alias("__s"))
    down = Window.partitionBy(*keys).orderBy(F.desc("__p")).rowsBetween(Window.unboundedPreceding, 0)  # RANGES rows a key
    sums = sums.select(*keys, "__p", (F.sum("__s").over(down) - F.col("__s")).alias("__above"), F.sum("__s").over(Window.partitionBy(*keys)).alias("__total"))
    own = Window.partitionBy(*keys, "__p").orderBy(F.desc("__v"), order).rowsBetween(Window.unboundedPreceding, 0)
    rows = _joined(rows.withColumn("__u", F.sum("__v").over(own)), sums, [*keys, "__p"])
    return rows.select(*df.columns, F.try_divide(F.col("__above") + F.col("__u"), F.col("__total")).alias("share_upto"))


def top_share(df: DataFrame, keys: list[str], value: str, order: str, share: float = 0.1) -> DataFrame:
    """The largest values' share of the total: the first ceil(share * n).  Ranges of values count whole; only
    the range that the limit falls into is ranked."""
    rows, sizes = in_ranges(df.select(*keys, F.col(value).cast("double").alias("__v"), F.col(order).alias("__o"), F.lit(1).alias("__c")), keys, "__v")
    sums = rows.groupBy(*keys, "__p").agg(F.sum("__v").alias("__sum"))
    above = F.col("__n") - F.col("__before") - F.col("__s")  # rows of larger ranges
    sizes = _joined(sizes, sums, [*keys, "__p"]).withColumn("__left", F.ceil(F.col("__n") * share) - above)
    whole = sizes.groupBy(*keys).agg(F.sum(F.when(F.col("__left") >= F.col("__s"), F.col("__sum")).otherwise(0.0)).alias("__whole"), F.sum("__sum").alias("__total"))
    edge = sizes.where("__left > 0 AND __left < __s").select(*keys, "__p", "__left")
    rank = F.row_number().over(Window.partitionBy(*keys, "__p").orderBy(F.desc("__v"), "__o"))
    part = _joined(rows, edge, [*keys, "__p"]).withColumn("__r", rank).where("__r <= __left").groupBy(*keys).agg(F.sum("__v").alias("__part"))
    out = whole.alias("l").join(part.alias("r"), _same("l", "r", keys), "left").select("l.*", "r.__part")
    return out.select(*keys, F.round((F.col("__whole") + F.coalesce("__part", F.lit(0.0))) / F.col("__total"), 6).alias("top_share"))


def kth_threshold(df: DataFrame, x: Column, ratio: float) -> DataFrame:
    """The value at position floor(n * ratio) of the sorted values (from 1), and the share that is at most that."""
    hit = order_values(df, [], x, {"threshold": lambda n: F.greatest(F.lit(1), F.floor(n * ratio)) - 1})
    rows = df.select(x.alias("v")).crossJoin(F.broadcast(hit))  # one row
    return rows.groupBy("threshold").agg(F.round(F.count_if(F.col("v") <= F.col("threshold")) / F.max("n"), 6).alias("achieved"))


def quantile_mask(df: DataFrame, keys: list[str], x: str, ratio: float) -> DataFrame:
    """The rows with threshold (each module's quantile, linear interpolation) and masked."""
    return _joined(df, quantiles(df, keys, F.col(x), {"threshold": ratio}), keys).withColumn("masked", F.col(x) <= F.col("threshold"))


def quantile_masks(df: DataFrame, keys: list[str], x: str, ratio: float) -> DataFrame:
    """threshold and how many values each module loses."""
    return quantile_mask(df, keys, x, ratio).groupBy(*keys).agg(F.round(F.max("threshold"), 6).alias("threshold"), F.count_if("masked").alias("n_masked"), F.count("*").alias("n"))


def matrix_drift(base: DataFrame, other: DataFrame, keys: list[str], vals: str = "vals") -> DataFrame:
    """||other - base|| / ||base|| and the cosine of the whole matrices, joined on keys and place."""
    a = base.select(*keys, F.posexplode(vals).alias("j", "x"))
    b = other.select(*keys, F.posexplode(vals).alias("j", "y"))
    rows = a.join(b, [*keys, "j"])
    group = [k for k in keys if k != "row"]
    s = lambda p, q: F.sum(F.col(p).cast("double") * F.col(q).cast("double"))
    rows = rows.groupBy(*group).agg(s("x", "x").alias("xx"), s("y", "y").alias("yy"), s("x", "y").alias("xy"))
    return rows.select(*group, F.round(F.sqrt(F.greatest(F.col("xx") + F.col("yy") - 2 * F.col("xy"), F.lit(0.0)) / F.col("xx")), 6).alias("relative_delta"), F.round(F.col("xy") / F.sqrt(F.col("xx") * F.col("yy")), 6).alias("cosine"))


def low_rank_merge(weights: DataFrame, a: DataFrame, b: DataFrame, alpha: float, rank_stable: bool = False, overrides: DataFrame | None = None) -> DataFrame:
    """weights: name, row, vals (out x in); a: name, row, vals (r x in); b: name, row, vals (out x r).
    W + scale * B A for the names that have both factors, scale alpha / r or alpha / sqrt(r); other rows
    stay as they are.  overrides (name, row, vals): weights that were trained whole take the place of W first.
    Factors have r rows and are gathered by name; W's rows stay spread."""
    if overrides is not None:
        weights = weights.join(overrides.select("name", "row", F.col("vals").alias("__o")), ["name", "row"], "left").select("name", "row", F.coalesce(F.col("__o").cast("array<double>"), F.col("vals").cast("array<double>")).alias("vals"))
    fa = a.groupBy("name").agg(F.array_sort(F.collect_list(F.struct("row", "vals"))).alias("fa"))
    rows = weights.join(fa, "name", "left").join(b.select("name", "row", F.col("vals").alias("fb")), ["name", "row"], "left")
    r = F.size("fa").cast("double")
    scale = F.lit(alpha) / (F.sqrt(r) if rank_stable else r)
    factors = F.arrays_zip(F.col("fb").alias("w"), F.transform("fa", lambda x: x["vals"]).alias("v"))
    delta = F.aggregate(factors, F.transform("vals", lambda x: F.lit(0.0)), lambda acc, f: F.zip_with(acc, f["v"], lambda p, q: p + f["w"].cast("double") * q.cast("double")))
    merged = F.zip_with("vals", delta, lambda x, y: x.cast("double") + scale * y)
    return rows.select("name", "row", F.when(F.col("fa").isNull() | F.col("fb").isNull(), F.col("vals").cast("array<double>")).otherwise(merged).alias("vals"))


def unused(factors: DataFrame, weights: DataFrame) -> DataFrame:
    """Names of factors that no weight has."""
    return factors.select("name").distinct().join(weights.select("name").distinct(), "name", "left_anti")


def copying_score(o: DataFrame, v: DataFrame, keys: list[str]) -> DataFrame:
    """trace(O V) / (||O|| ||V||): the sum over places of O_ij V_ji."""
    x, y = o.select(*keys, F.col("row").alias("i"), F.posexplode("vals").alias("j", "x")), v.select(*keys, F.col("row").alias("j"), F.posexplode("vals").alias("i", "y"))
    norm = lambda z, c, n: z.groupBy(*keys).agg(F.sqrt(F.sum(F.col(c).cast("double") * F.col(c))).alias(n))
    trace = x.join(y, [*keys, "i", "j"]).groupBy(*keys).agg(F.sum(F.col("x").cast("double") * F.col("y")).alias("t"))
    return trace.join(norm(x, "x", "nx"), keys).join(norm(y, "y", "ny"), keys).select(*keys, F.round(F.try_divide("t", F.col("nx") * F.col("ny")), 6).alias("copying"))


def attention_metrics(att: DataFrame, keys: list[str]) -> DataFrame:
    """att: keys, q, k, p.  Means over the queries but the first: entropy, largest weight, weight on the first
    position, and distance."""
    p = F.col("p").cast("double")
    per = att.where("q >= 1").groupBy(*keys, "q").agg((-F.sum(F.when(p > 0, p * F.log(p + 1e-12)).otherwise(0.0))).alias("e"), F.max(p).alias("t"), F.sum(F.when(F.col("k") == 0, p).otherwise(0.0)).alias("s"), F.sum(p * (F.col("q") - F.col("k"))).alias("d"))
    r = lambda c, n: F.round(F.avg(c), 6).alias(n)
    return per.groupBy(*keys).agg(r("e", "entropy"), r("t", "top1"), r("s", "sink"), r("d", "distance"))


def induction_scores(att: DataFrame, tokens: DataFrame, keys: list[str], begin: int) -> DataFrame:
    """att: keys, q, k, p; tokens: pos, token, a sequence whose part from `begin` on repeats what stands before.
    The mean weight that the repeated positions give to the place behind their token's first occurrence."""
    first = tokens.groupBy("token").agg(F.min("pos").alias("at"))
    wanted = tokens.where(F.col("pos") >= begin).join(first, "token").select(F.col("pos").alias("q"), (F.col("at") + 1).alias("k"), F.lit(True).alias("__hit"))
    n = wanted.agg(F.count("*").alias("__m"))
    rows = att.join(wanted, ["q", "k"], "left").groupBy(*keys).agg(F.sum(F.when(F.col("__hit"), F.col("p").cast("double")).otherwise(0.0)).alias("__t"))
    return rows.crossJoin(F.broadcast(n)).select(*keys, F.round(F.coalesce(F.try_divide("__t", "__m"), F.lit(0.0)), 6).alias("induction"))  # one row


def classify_heads(metrics: DataFrame, group: list[str], induction: str = "induction") -> DataFrame:
    w = Window.partitionBy(*group)
    rows = metrics.withColumn("__a", F.percentile("distance", 0.33).over(w)).withColumn("__b", F.percentile("distance", 0.9).over(w))
    return rows.withColumn("is_local", F.col("distance") < F.col("__a")).withColumn("is_global", F.col("distance") > F.col("__b")).withColumn("is_sink", F.col("sink") > 0.5).withColumn("is_induction", F.col(induction) > 0.2).drop("__a", "__b")


def distance_decay(att: DataFrame, keys: list[str], most: int = 40) -> DataFrame:
    return att.where(f"q - k between 0 and {most - 1}").groupBy(*keys, (F.col("q") - F.col("k")).alias("d")).agg(F.round(F.avg("p"), 6).alias("mean_p"))


def received_attention(att: DataFrame, types: DataFrame) -> DataFrame:
    """types: k, kind.  The mean attention that positions of each kind receive."""
    return att.join(types, "k").groupBy("kind").agg(F.round(F.avg("p"), 6).alias("received"), F.countDistinct("k").alias("n_positions"))


def rollout(att: DataFrame, n: int, most: int = 4096) -> np.ndarray:
    """The product over layers of (mean over heads + identity) / 2, for one short sequence of n positions."""
    if n > most:
        raise ValueError(f"a sequence of {n} positions: at most {most} fit into the driver")
    rows = att.where((F.col("q") < n) & (F.col("k") < n)).groupBy("layer", "q", "k").agg(F.avg("p").alias("p")).toPandas()
    out = np.eye(n)
    for _, own in rows.groupby("layer"):
        m = np.zeros((n, n))
        m[own["q"], own["k"]] = own["p"]
        m = (m + np.eye(n)) / 2
        out = (m / m.sum(1, keepdims=True)) @ out
    return out


def neuron_statistics(act: DataFrame, keys: list[str], threshold: float = 0.0) -> DataFrame:
    """act: keys, gate, up, post.  Mean absolute value, variance, largest, firing share, correlation of gate
    and up (0 if one is constant), and overlap of their activity."""
    post = F.col("post").cast("double")
    r = lambda c, n: F.round(c, 6).alias(n)
    corr = F.when((F.stddev_pop("gate") > 0) & (F.stddev_pop("up") > 0), F.corr("gate", "up")).otherwise(0.0)
    active = lambda c: F.abs(c) > threshold
    return act.groupBy(*keys).agg(r(F.avg(F.abs(post)), "mean_abs"), r(F.var_pop(post), "variance"), r(F.max(F.abs(post)), "largest"), r(F.avg((F.abs(post) > threshold).cast("int")), "firing"), r(corr, "gate_up_corr"), r(F.avg((active(F.col("gate")) & active(F.col("up"))).cast("int")), "overlap"))


def layer_activity(neurons: DataFrame, keys: list[str], dead: float = 1e-6, sparse: float = 0.05) -> DataFrame:
    """Dead and sparse neurons, entropy of the activity over neurons, and its coefficient of variation."""
    p = F.col("mean_abs") / F.sum("mean_abs").over(Window.partitionBy(*keys))
    rows = neurons.withColumn("__p", p)
    return rows.groupBy(*keys).agg(F.count_if(F.col("largest") <= dead).alias("n_dead"), F.count_if(F.col("firing") < sparse).alias("n_sparse"), F.round(-F.sum(F.when(F.col("__p") > 0, F.col("__p") * F.log("__p")).otherwise(0.0)), 6).alias("entropy"), F.round(F.stddev_pop("mean_abs") / F.avg("mean_abs"), 6).alias("cov"))


def column_norms(df: DataFrame, keys: list[str], column: str = "neuron", vals: str = "vals") -> DataFrame:
    """keys, column, norm (L2) and l1 (sum of absolute weights) of each column of the matrices."""
    x = F.col("x").cast("double")
    cells = df.select(*keys, F.posexplode(vals).alias(column, "x"))
    return cells.groupBy(*keys, column).agg(F.sqrt(F.sum(x * x)).alias("norm"), F.sum(F.abs(x)).alias("l1"))


def importance(neurons: DataFrame, columns: DataFrame, keys: list[str]) -> DataFrame:
    """Mean activity times the norm of the neuron's output column."""
    return neurons.join(columns, keys).withColumn("importance", F.col("mean_abs") * F.col("norm"))


def column_importance(inputs: DataFrame, columns: DataFrame, keys: list[str]) -> DataFrame:
    """inputs: keys, sample, mean_abs (of the column's input in a sample).  The sum of absolute weights of each
    column times the mean over samples of its input."""
    means = inputs.groupBy(*keys).agg(F.avg("mean_abs").alias("__m"))
    return means.join(columns, keys).select(*keys, (F.col("l1") * F.col("__m")).alias("importance"))


def projection_pivot(report: DataFrame, layer: str, projection: str, value: str, names: list[str]) -> DataFrame:
    """layer, a column for each projection, and the projections of the largest and the smallest value."""
    wide = report.groupBy(layer).pivot(projection, names).agg(F.max(value))
    by = F.struct(value, projection)
    return wide.join(report.groupBy(layer).agg(F.max_by(projection, by).alias("largest"), F.min_by(projection, by).alias("smallest")), layer)


def concept_selectivity(means: DataFrame, keys: list[str], sigmas: float = 3.0) -> DataFrame:
    """means: keys, concept, neuron, m, base.  Neurons of each concept beyond the mean and 3 deviations."""
    w = Window.partitionBy(*keys, "concept")
    rows = means.withColumn("d", F.col("m") - F.col("base"))
    rows = rows.withColumn("hit", F.col("d") > F.avg("d").over(w) + sigmas * F.stddev_pop("d").over(w))
    return rows.groupBy(*keys, "concept").agg(F.count_if("hit").alias("n_selective"))


def merge_check(base: DataFrame, merged: DataFrame, expected: DataFrame, keys: list[str], tolerance: float = 1e-2) -> DataFrame:
    """How much the merge changed, and how far the result is from the expected one."""
    change = matrix_drift(base, merged, keys).withColumnRenamed("relative_delta", "changed").drop("cosine")
    rest = matrix_drift(expected, merged, keys).withColumnRenamed("relative_delta", "residual").drop("cosine")
    group = [k for k in keys if k != "row"]
    return change.join(rest, group).withColumn("ok", F.col("residual") <= tolerance)


def parameter_budget(shapes: DataFrame) -> DataFrame:
    """shapes: part, rows, cols, copies.  Parameters of each part and their share."""
    n = (F.col("rows").cast("long") * F.col("cols") * F.col("copies")).alias("n")
    rows = shapes.groupBy("part").agg(F.sum(n).alias("n"))
    return rows.withColumn("pct", F.round(100 * F.col("n") / F.sum("n").over(Window.partitionBy()), 6))
