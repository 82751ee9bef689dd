"""Keep-first deduplication, leakage, decontamination, splits and samples in a fixed order.

Random orders are orders of md5(seed | id): the same on any number of machines.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_first(df: DataFrame, keys: list[str | Column], order: list[str]) -> DataFrame:
    """The first row of each key.  The smallest order is aggregated, so a frequent key is combined before it
    is shuffled, and rows are joined with one row for each key."""
    named = [F.col(k) if isinstance(k, str) else k for k in keys]
    rows = df.select("*", *[k.alias(f"__k{i}") for i, k in enumerate(named)], F.struct(*order).alias("__o"))
    own = [f"__k{i}" for i in range(len(named))]
    first = rows.groupBy(*own).agg(F.min("__o").alias("__f"))
    match = [rows[k].eqNullSafe(first[k]) for k in own] + [rows["__o"] == first["__f"]]
    return rows.join(first, match, "left_semi").select(*df.columns)


def hash_order(seed: str, *ids: str) -> Column:
    return F.md5(F.concat_ws("|", F.lit(seed), *[F.col(i).cast("string") for i in ids]))


def hash_bucket(seed: str, buckets: int, *ids: str) -> Column:
    """A number below `buckets` from the first 32 bits of the hash."""
    return F.pmod(F.conv(F.substring(hash_order(seed, *ids), 1, 8), 16, 10).cast("bigint"), F.lit(buckets)).cast("int")


def leakage(splits: DataFrame, key: str, split: str, pairs: list[tuple[str, str]]) -> DataFrame:
    """a, b, n_a and n_leaked: rows of split a whose key is in split b."""
    out = None
    for a, b in pairs:
        mine, theirs = splits.where(F.col(split) == a), splits.where(F.col(split) == b).select(key).distinct().withColumn("__hit", F.lit(True))
        one = mine.join(theirs, key, "left").agg(F.count("*").alias("n_a"), F.count("__hit").alias("n_leaked")).select(F.lit(a).alias("a"), F.lit(b).alias("b"), "n_a", "n_leaked")
        out = one if out is None else out.unionByName(one)
    return out


def decontaminate(splits: DataFrame, key: str, split: str, order: str, train: str = "train", val: str = "val", test: str = "test") -> DataFrame:
    """Duplicates within a split go first; then val loses what test has, and train what val or test have."""
    rows = keep_first(splits, [split, key], [order])
    of = lambda s: rows.where(F.col(split) == s)
    held = of(val).select(key).unionByName(of(test).select(key)).distinct()
    return of(train).join(held, key, "left_anti").select(*splits.columns).unionByName(of(val).join(of(test).select(key).distinct(), key, "left_anti").select(*splits.columns)).unionByName(of(test))


def places(df: DataFrame, keys: list[str], seed: str, *ids: str, digits: int = 3) -> DataFrame:
    """The rows with __i, their place (from 0) within the keys in hash order, and __n, the rows of the keys.
    Places are counted within ranges of the hash, 16 ** digits for each key, and the ranges' sizes are
    summed: no task sorts a whole key."""
    own = [f"__k{i}" for i in range(len(keys))]
    rows = df.select("*", *[F.col(k).alias(o) for k, o in zip(keys, own)], hash_order(seed, *ids).alias("__h")).withColumn("__p", F.substring("__h", 1, digits))
    sizes = rows.groupBy(*own, "__p").agg(F.count("*").alias("__c"))
    up = Window.partitionBy(*own).orderBy("__p").rowsBetween(Window.unboundedPreceding, 0)
    before = sizes.select(*[F.col(o).alias(f"{o}_") for o in own], F.col("__p").alias("__p_"), (F.sum("__c").over(up) - F.col("__c")).alias("__b"), F.sum("__c").over(Window.partitionBy(*own)).alias("__n"))
    rows = rows.withColumn("__r", F.row_number().over(Window.partitionBy(*own, "__p").orderBy("__h", *ids)) - 1)
    same = reduce(lambda a, b: a & b, [F.col(o).eqNullSafe(F.col(f"{o}_")) for o in own], F.col("__p") == F.col("__p_"))
    return rows.join(before, same).select(*df.columns, (F.col("__b") + F.col("__r")).alias("__i"), "__n")


def stratified_split(df: DataFrame, label: str, seed: str, *ids: str, train: float = 0.8, val: float = 0.1) -> DataFrame:
    """The rows with split: within each label, in hash order, rounded half to even; a label too small
    for three splits gives one row to train first."""
    test = 1 - train - val
    rows = places(df, [label], seed, *ids)
    size = lambda p: F.greatest(F.lit(1), F.bround(F.col("__n") * F.lit(round(p, 9)), 0).cast("int"))
    rows = rows.withColumn("__small", F.col("__n") - size(val) - size(test) < 1)
    n_train = F.when(F.col("__small"), 1).otherwise(F.col("__n") - size(val) - size(test))
    n_val = F.when(F.col("__small"), F.greatest(F.lit(1), F.floor((F.col("__n") - 1) / 2).cast("int"))).otherwise(size(val))
    split = F.when(F.col("__i") < n_train, "train").when(F.col("__i") < n_train + n_val, "val").otherwise("test")
    return rows.select(*df.columns, split.alias("split"))


def split_summary(df: DataFrame, label: str, split: str = "split") -> DataFrame:
    """split, label, n, the label's share of the split and of all rows."""
    n = df.groupBy(split, label).agg(F.count("*").alias("n"))
    share = lambda *k: 100 * F.sum("n").over(Window.partitionBy(*k, label)) / F.sum("n").over(Window.partitionBy(*k))
    return n.select(F.col(split).alias("split"), F.col(label).alias("label"), "n", F.round(share(split), 6).alias("split_pct"), F.round(share(), 6).alias("all_pct"))


def sample(df: DataFrame, n: int, seed: str, *ids: str) -> DataFrame:
    """n rows chosen by hash order, as a heap for each task and one merge."""
    return df.orderBy(hash_order(seed, *ids), *ids).limit(n)


def first_rows(df: DataFrame, n: int, *order: str) -> DataFrame:
    return df.orderBy(*order).limit(n)


def first_per_group(df: DataFrame, group: list[str], order: list[Column | str], k: int) -> DataFrame:
    """The first k rows of each group; Spark keeps k rows of a group in each task before it shuffles."""
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("__r") <= k).drop("__r")


def disjoint(a: DataFrame, b: DataFrame) -> DataFrame:
    """n_shared of two key tables; 0 is what is wanted."""
    return a.intersect(b).agg(F.count("*").alias("n_shared"))
