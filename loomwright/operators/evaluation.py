"""Predictions to accuracies, reports, paired tests and distributions; scores to predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def accuracy(df: DataFrame, keys: list[Column | str], hit: Column) -> DataFrame:
    """keys, n_correct, n, accuracy in percent."""
    return df.groupBy(*keys).agg(F.count_if(hit).alias("n_correct"), F.count("*").alias("n")).withColumn("accuracy", F.round(100 * F.col("n_correct") / F.col("n"), 6))


def accuracy_report(df: DataFrame, sets: list[list[str]], hit: Column, valid: Column | None = None) -> DataFrame:
    """All breakdowns in one pass (grouping sets): the key columns (null where not grouped), dims (which
    ones are), n_correct, n, n_skipped, accuracy."""
    cols = list(dict.fromkeys(c for s in sets for c in s))
    valid = F.lit(True) if valid is None else valid
    rows = df.select(*cols, (hit & valid).alias("__hit"), valid.alias("__valid"))
    out = rows.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in cols]).agg(F.count_if("__hit").alias("n_correct"), F.count_if("__valid").alias("n"), F.count_if(~F.col("__valid")).alias("n_skipped"), F.grouping_id(*cols).alias("__g"))
    names = {sum(1 << (len(cols) - 1 - i) for i, c in enumerate(cols) if c not in s): "+".join(s) or "overall" for s in sets}
    dims = F.create_map(*[F.lit(x) for g, n in names.items() for x in (g, n)])
    return out.select(dims[F.col("__g").cast("int")].alias("dims"), *cols, "n_correct", "n", "n_skipped", F.round(100 * F.try_divide("n_correct", "n"), 6).alias("accuracy"))


def option_distribution(df: DataFrame, value: str, base: int, n: int, keys: list[str] | None = None) -> DataFrame:
    """keys, option, n: options without a row count 0, values outside of the range don't count."""
    keys = keys or []
    options = df.sparkSession.range(base, base + n).withColumnRenamed("id", "option")
    frame = df.select(*keys).distinct().crossJoin(F.broadcast(options)) if keys else options
    counts = df.groupBy(*keys, F.col(value).cast("long").alias("option")).agg(F.count("*").alias("n"))
    return frame.join(counts, [*keys, "option"], "left").select(*keys, "option", F.coalesce("n", F.lit(0)).alias("n"))


def total_variation(pred: DataFrame, gold: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """50 * sum |p - g| over the options, in percentage points; NaN if one is empty."""
    keys = keys or []
    rows = pred.withColumnRenamed("n", "p").join(gold.withColumnRenamed("n", "g"), [*keys, "option"], "full_outer").select(*keys, F.coalesce("p", F.lit(0)).alias("p"), F.coalesce("g", F.lit(0)).alias("g"))
    w = Window.partitionBy(*keys)
    rows = rows.withColumn("d", F.abs(F.try_divide("p", F.sum("p").over(w)) - F.try_divide("g", F.sum("g").over(w))))
    return rows.groupBy(*keys).agg(F.round(F.coalesce(50 * F.sum("d"), F.lit(float("nan"))), 6).alias("tvd"))


def erfc(x: Column) -> Column:
    return F.java_method(F.lit("org.apache.commons.math3.special.Erf"), F.lit("erfc"), x.cast("double")).cast("double")


def mcnemar(df: DataFrame, a: Column, b: Column, keys: list[str] | None = None) -> DataFrame:
    """b01 (only a is right), b10, chi2 with continuity correction and p; p is 1 without discordant pairs."""
    rows = df.groupBy(*(keys or [])).agg(F.count_if(a & ~b).alias("b01"), F.count_if(b & ~a).alias("b10"))
    n = F.col("b01") + F.col("b10")
    rows = rows.withColumn("chi2", F.round(F.coalesce(F.try_divide(F.pow(F.abs(F.col("b01") - F.col("b10")) - 1, F.lit(2)), n), F.lit(0.0)), 6))
    return rows.withColumn("p", F.when(n == 0, 1.0).otherwise(erfc(F.sqrt(F.col("chi2") / 2))))


def gains(df: DataFrame, a: Column, b: Column) -> DataFrame:
    """What two ways of predicting get right alone, together and alike."""
    return df.agg(F.count("*").alias("n"), F.count_if(a & ~b).alias("only_a"), F.count_if(b & ~a).alias("only_b"), F.count_if(a & b).alias("both"), F.round(100 * (F.avg(b.cast("int")) - F.avg(a.cast("int"))), 6).alias("delta"))


def agreement(df: DataFrame, a: str, b: str, gold: str) -> DataFrame:
    """Percent of identical predictions, and the difference of accuracies."""
    hit = lambda c: F.avg((F.col(c) == F.col(gold)).cast("int"))
    return df.agg(F.round(100 * F.avg((F.col(a) == F.col(b)).cast("int")), 6).alias("same_pct"), F.round(100 * (hit(b) - hit(a)), 6).alias("delta"))


def pair_by_item(a: DataFrame, b: DataFrame, item: str = "item_idx") -> DataFrame:
    """Two dumps joined on the item's number; dumps of unequal length give no rows."""
    sizes = a.agg(F.count("*").alias("__n")).crossJoin(b.agg(F.count("*").alias("__m")))
    return a.join(b, item).crossJoin(F.broadcast(sizes)).where("__n = __m").drop("__n", "__m")


def model_pairs(df: DataFrame, item: str, model: str, hit: str) -> DataFrame:
    """For each pair of models: items that only the first, only the second or both get right."""
    a = df.select(F.col(item).alias("i"), F.col(model).alias("model_a"), F.col(hit).alias("x"))
    b = df.select(F.col(item).alias("i"), F.col(model).alias("model_b"), F.col(hit).alias("y"))
    rows = a.join(b, "i").where("model_a < model_b")
    return rows.groupBy("model_a", "model_b").agg(F.count_if(F.expr("x and not y")).alias("only_a"), F.count_if(F.expr("y and not x")).alias("only_b"), F.count_if(F.expr("x and y")).alias("both"))


def modal_answer(df: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """keys, the most frequent value (of ties the smallest) and its share."""
    n = df.groupBy(*keys, value).agg(F.count("*").alias("n"))
    return n.groupBy(*keys).agg(F.max_by(value, F.struct(F.col("n"), -F.col(value))).alias("modal"), F.round(100 * F.max("n") / F.sum("n"), 6).alias("pct"))


def class_report(df: DataFrame, gold: str, pred: str, labels: list) -> DataFrame:
    """label, tp, fp, fn, support, precision, recall, f1.  Predictions that are no label are misses of their
    gold label only."""
    n = df.where(F.col(gold).isin(labels) | F.col(pred).isin(labels)).groupBy(F.col(gold).alias("g"), F.col(pred).alias("p")).agg(F.count("*").alias("n"))
    frame = df.sparkSession.createDataFrame([(x,) for x in labels], df.select(gold).schema).toDF("label")
    hits = n.select(F.explode(F.array_distinct(F.array("g", "p"))).alias("label"), "g", "p", "n")
    rows = hits.groupBy("label").agg(F.sum(F.when((F.col("g") == F.col("label")) & (F.col("p") == F.col("label")), F.col("n")).otherwise(0)).alias("tp"), F.sum(F.when(~F.col("g").eqNullSafe(F.col("label")), F.col("n")).otherwise(0)).alias("fp"), F.sum(F.when(~F.col("p").eqNullSafe(F.col("label")), F.col("n")).otherwise(0)).alias("fn"))
    rows = frame.join(rows, "label", "left").select("label", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("tp", "fp", "fn")])
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    rows = rows.withColumn("support", F.col("tp") + F.col("fn")).withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", ratio(F.col("tp"), F.col("tp") + F.col("fn")))
    return rows.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def class_summary(df: DataFrame, gold: str, pred: str, labels: list) -> DataFrame:
    """accuracy, n, n_unparsed; micro, macro and support-weighted precision, recall and F1."""
    one = df.agg(F.count("*").alias("n"), F.count_if(F.col(gold) == F.col(pred)).alias("correct"), F.count_if(~F.coalesce(F.col(pred).isin(labels), F.lit(False))).alias("n_unparsed"))
    each = class_report(df, gold, pred, labels).agg(*[F.avg(c).alias(f"macro_{c}") for c in ("precision", "recall", "f1")], F.coalesce(F.try_divide(F.sum(F.col("f1") * F.col("support")), F.sum("support")), F.lit(0.0)).alias("weighted_f1"))
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    rows = one.crossJoin(each).withColumn("mp", ratio(F.col("correct"), F.col("n") - F.col("n_unparsed"))).withColumn("mr", ratio(F.col("correct"), F.col("n")))
    r = lambda c, n: F.round(c, 6).alias(n)
    return rows.select(r(F.col("mr"), "accuracy"), "n", "n_unparsed", r(F.col("mp"), "micro_precision"), r(F.col("mr"), "micro_recall"), r(ratio(2 * F.col("mp") * F.col("mr"), F.col("mp") + F.col("mr")), "micro_f1"), *[r(F.col(f"macro_{c}"), f"macro_{c}") for c in ("precision", "recall", "f1")], r(F.col("weighted_f1"), "weighted_f1"))


def confusion(df: DataFrame, gold: str, pred: str, labels: list) -> DataFrame:
    """gold, a column for each label, and the diagonal's share of the row (other predictions don't count)."""
    rows = df.where(F.col(gold).isin(labels)).groupBy(F.col(gold).alias("gold")).pivot(pred, labels).count().na.fill(0)
    total = sum(F.col(f"`{x}`") for x in labels)
    own = F.coalesce(*[F.when(F.col("gold") == x, F.col(f"`{x}`")) for x in labels])
    return rows.withColumn("accuracy", F.round(F.coalesce(F.try_divide(own, total), F.lit(0.0)), 6))


def unknown_examples(df: DataFrame, pred: str, labels: list, order: str, k: int = 5) -> DataFrame:
    """The first k rows, in the order, whose prediction is no label."""
    return df.where(~F.coalesce(F.col(pred).isin(labels), F.lit(False))).orderBy(order).limit(k)


def perplexity(df: DataFrame, keys: list[str], loss: str, weight: str, cap: float = 700.0) -> DataFrame:
    """exp of the weighted mean loss; infinite beyond the cap."""
    mean = F.sum(F.col(loss) * F.col(weight)) / F.sum(weight)
    rows = df.groupBy(*keys).agg(mean.alias("mean_loss"))
    return rows.select(*keys, F.round("mean_loss", 6).alias("mean_loss"), F.when(F.col("mean_loss") > cap, float("inf")).otherwise(F.round(F.exp(F.least("mean_loss", F.lit(cap))), 6)).alias("perplexity"))


def best_epoch(df: DataFrame, keys: list[str], metric: str, step: str) -> DataFrame:
    """The step of the best metric; of ties the first."""
    return df.groupBy(*keys).agg(F.max_by(step, F.struct(F.col(metric), -F.col(step))).alias("best_step"), F.max(metric).alias("best"))


def mean_between(df: DataFrame, keys: list[str], step: str, value: str, mark: Column) -> DataFrame:
    """The mean of value in each stretch that ends with a marked row."""
    w = Window.partitionBy(*keys).orderBy(step).rowsBetween(Window.unboundedPreceding, -1)
    rows = df.withColumn("stretch", F.coalesce(F.sum(mark.cast("int")).over(w), F.lit(0)))
    return rows.groupBy(*keys, "stretch").agg(F.round(F.avg(value), 6).alias("mean"), F.max(step).alias("last_step"))


def fingerprint_match(dumps: DataFrame, published: DataFrame, dump: str, hit: Column) -> DataFrame:
    """Dumps whose numbers of rows and of hits are those published, the first for each model."""
    own = dumps.groupBy(dump).agg(F.count("*").alias("n"), F.count_if(hit).alias("n_correct"))
    return own.join(published, ["n", "n_correct"]).groupBy("model").agg(F.min(dump).alias(dump))


def verify(derived: DataFrame, published: DataFrame, keys: list[str], value: str, tolerance: float = 0.015) -> DataFrame:
    """Cells that differ by more than the tolerance, or are missing."""
    rows = published.withColumnRenamed(value, "__want").join(derived.withColumnRenamed(value, "__got"), keys, "left")
    return rows.where(F.col("__got").isNull() | (F.abs(F.col("__got") - F.col("__want")) > tolerance)).select(*keys, F.col("__want").alias("want"), F.col("__got").alias("got"))


def rotation_average(scores: DataFrame, item: str = "item_idx") -> DataFrame:
    """scores: item, rot, slot, score.  Option i stood in slot (i - rot) mod n, so each option's score is the
    mean over the rotations, and the best option is the prediction (-1 for an item without scores)."""
    n = F.max("slot").over(Window.partitionBy(item)) + 1
    rows = scores.withColumn("option", F.pmod(F.col("slot") + F.col("rot"), n))
    means = rows.groupBy(item, "option").agg(F.avg("score").alias("m"))
    return means.groupBy(item).agg(F.coalesce(F.max_by("option", F.struct(F.col("m"), -F.col("option"))), F.lit(-1)).cast("int").alias("pred"))


def choice_argmax(ll: DataFrame, doc: str = "doc", choice: str = "choice") -> DataFrame:
    """ll: doc, choice, ll, char_len.  pred by score and pred_norm by score a character; the first of ties."""
    best = lambda x: F.max_by(choice, F.struct(x, -F.col(choice)))
    return ll.groupBy(doc).agg(best(F.col("ll")).alias("pred"), best(F.try_divide("ll", "char_len")).alias("pred_norm"))


def top_tokens(logits: DataFrame, keys: list[str], k: int) -> DataFrame:
    """rank, token and probability of the k largest logits."""
    w = Window.partitionBy(*keys)
    rows = logits.withColumn("prob", F.exp(F.col("logit") - F.max("logit").over(w)))
    rows = rows.withColumn("prob", F.round(F.col("prob") / F.sum("prob").over(w), 9)).withColumn("rank", F.row_number().over(w.orderBy(F.desc("logit"), "token")))
    return rows.where(F.col("rank") <= k).select(*keys, "rank", "token", "prob")


def end_rank(probs: DataFrame, keys: list[str], end: Column) -> DataFrame:
    """The rank of the end token among the probabilities, and its probability."""
    p = F.max(F.when(end, F.col("prob"))).over(Window.partitionBy(*keys))
    return probs.withColumn("__p", p).groupBy(*keys).agg(F.max("__p").alias("p_end"), (F.count_if(F.col("prob") > F.col("__p")) + 1).alias("rank"))


def end_report(positions: DataFrame, p: str = "p_end", rank: str = "rank") -> DataFrame:
    """positions: probability and rank of the end token where a turn ends.  n, mean, median (the element at
    n // 2 of the sorted values) and least probability, median and worst rank, and the percent of rank 1."""
    from loomwright.operators.matrices import order_values

    one = positions.agg(F.count("*").alias("n"), F.round(F.avg(p), 9).alias("mean_p"), F.min(p).alias("min_p"), F.max(rank).alias("worst_rank"), F.round(100 * F.avg((F.col(rank) == 1).cast("int")), 6).alias("top1_pct"))
    half = {"median": lambda n: F.floor(n / 2)}
    for c, name in ((p, "median_p"), (rank, "median_rank")):
        one = one.crossJoin(order_values(positions, [], F.col(c), half).select(F.col("median").alias(name)))  # one row each
    return one


def generation_health(df: DataFrame, keys: list[str], stopped: Column, leaked: Column, n_new: Column) -> DataFrame:
    pct = lambda c: F.round(100 * F.avg(c.cast("int")), 6)
    return df.groupBy(*keys).agg(F.count("*").alias("n"), pct(stopped).alias("stopped_pct"), pct(leaked).alias("leaked_pct"), F.round(F.avg(n_new), 6).alias("mean_new"))


def winners(rows: DataFrame, column: str, model: str, value: str, skip: list[str] = ()) -> DataFrame:
    """column, model of the best value; columns that tie, or are skipped, have no winner."""
    rows = rows.where(F.col(value).isNotNull() & ~F.col(column).isin(*skip)) if skip else rows.where(F.col(value).isNotNull())
    best = rows.groupBy(column).agg(F.max(value).alias("__v"))
    top = rows.join(best, column).where(F.col(value) == F.col("__v"))
    return top.groupBy(column).agg(F.count("*").alias("__n"), F.min(model).alias("winner")).where("__n = 1").drop("__n")


def delta_to_base(rows: DataFrame, base: str, column: str, model: str, value: str) -> DataFrame:
    own = rows.where(F.col(model) == base).select(column, F.col(value).alias("__b"))
    return rows.join(own, column, "left").select(model, column, value, F.round(F.col(value) - F.col("__b"), 6).alias("delta"))


def macro_means(rows: DataFrame, model: str, column: str, value: str, language: Column) -> DataFrame:
    """Overall and per-language means of a model's values; missing ones don't count."""
    return rows.groupBy(model).agg(F.round(F.avg(value), 6).alias("mean"), F.round(F.avg(F.when(language == "si", F.col(value))), 6).alias("mean_si"), F.round(F.avg(F.when(language == "en", F.col(value))), 6).alias("mean_en"), F.count(value).alias("n"))


def first_match(rows: DataFrame, alias: DataFrame, name: str, value: str) -> DataFrame:
    """alias: name, model, priority; rows: snapshot (priority) and name.  The value of the best snapshot and
    alias for each model."""
    hits = rows.join(F.broadcast(alias), name)
    return hits.groupBy("model").agg(F.min_by(value, F.struct("snapshot", "priority", name)).alias(value))


def largest_change(rows: DataFrame, group: list[str], key: str, d: str) -> DataFrame:
    """Mean difference and the largest by absolute value; of ties the first key."""
    by_size = rows.groupBy(*group).agg(F.round(F.avg(d), 6).alias("mean_delta"), F.min_by(F.struct(key, d), F.struct(-F.abs(F.col(d)), F.col(key))).alias("x"))
    return by_size.select(*group, "mean_delta", F.col(f"x.{key}").alias("largest_key"), F.col(f"x.{d}").alias("largest"))


def axis_limit(value: Column, step: int = 20) -> Column:
    return F.ceil(value / step) * step
