"""Profiles of labelled texts: coverage, labels, lengths, duplicates, scripts, reasons for dropping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwright.functions import text as T


def field_coverage(df: DataFrame, fields: list[str]) -> DataFrame:
    """field, n_present (not null), n_total, pct."""
    total = F.count(F.lit(1)).alias("n_total")
    one = df.agg(total, *[F.count(F.col(f)).alias(f) for f in fields])
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("n_present")) for f in fields])).alias("x")
    rows = one.select("n_total", pairs).select("x.field", "x.n_present", "n_total")
    return rows.withColumn("pct", F.round(100 * F.coalesce(F.try_divide("n_present", "n_total"), F.lit(0.0)), 6))


def emptiness(df: DataFrame, text: str = "text", short: int = 5) -> DataFrame:
    """n_records, n_empty (no text but white space), n_very_short (1 to short - 1 tokens)."""
    n = T.token_count(F.col(text))
    return df.agg(F.count("*").alias("n_records"), F.count_if(T.strip(T.empty_if_null(F.col(text))) == "").alias("n_empty"), F.count_if((n > 0) & (n < short)).alias("n_very_short"))


def label_distribution(df: DataFrame, label: str, order: str, name: str | None = None) -> DataFrame:
    """label, n, pct, and the name that its last row (by order) has."""
    extra = [F.max_by(name, order).alias("label_name")] if name else []
    rows = df.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n"), *extra)
    return rows.withColumn("pct", F.round(100 * F.col("n") / F.sum("n").over(Window.partitionBy()), 6))


def class_balance(counts: DataFrame) -> DataFrame:
    """n_max, n_min, ratio and a verdict in three tiers, from label counts n."""
    one = counts.agg(F.max("n").alias("n_max"), F.min("n").alias("n_min")).withColumn("ratio", F.round(F.try_divide("n_max", "n_min"), 6))
    return one.withColumn("verdict", F.when(F.col("ratio") > 5, "highly imbalanced").when(F.col("ratio") > 2, "imbalanced").otherwise("balanced"))


def length_stats(df: DataFrame, values: dict[str, Column]) -> DataFrame:
    """metric, n, n_min, n_max, mean, and the elements of the sorted values at floor(n * p) for the median
    and the 10th and 90th percentiles.  Positions come from counts of each value, so no list is built."""
    rows = df.select(F.explode(F.array(*[F.struct(F.lit(k).alias("metric"), v.cast("long").alias("v")) for k, v in values.items()])).alias("x")).select("x.*")
    counts = rows.groupBy("metric", "v").agg(F.count("*").alias("c"))
    up = Window.partitionBy("metric").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    counts = counts.withColumn("upto", F.sum("c").over(up)).withColumn("n", F.sum("c").over(Window.partitionBy("metric")))
    at = lambda p: F.min(F.when(F.col("upto") > F.floor(F.col("n") * p), F.col("v")))
    return counts.groupBy("metric").agg(
        F.max("n").alias("n"), F.min("v").alias("n_min"), F.max("v").alias("n_max"), F.round(F.sum(F.col("v") * F.col("c")) / F.max("n"), 6).alias("mean"),
        at(0.5).alias("median"), at(0.1).alias("p10"), at(0.9).alias("p90"),
    )


def means_by_label(df: DataFrame, label: str, text: str = "text") -> DataFrame:
    return df.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n"), F.round(F.avg(T.token_count(F.col(text))), 6).alias("mean_tokens"), F.round(F.avg(F.length(T.empty_if_null(F.col(text)))), 6).alias("mean_chars"))


def duplicate_groups(df: DataFrame, key: Column, order: str) -> DataFrame:
    """key, n and first (the smallest order) of keys that occur more than once."""
    return df.groupBy(key.alias("key")).agg(F.count("*").alias("n"), F.min(order).alias("first")).where("n > 1")


def duplicate_summary(groups: DataFrame) -> DataFrame:
    return groups.agg(F.count("*").alias("n_groups"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("long").alias("n_surplus"))


def top_duplicates(groups: DataFrame, k: int = 3) -> DataFrame:
    """The most frequent keys; of equal ones the earlier first."""
    return groups.orderBy(F.desc("n"), "first").limit(k).select("first", "n", T.preview(F.col("key")).alias("preview"))


def character_scripts(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """script, n_chars and n_records.  The ASCII letters of a text are counted by one expression; only its
    other characters are exploded, and counted for each record first, so what is shuffled is a row for each
    record and code point at most."""
    t = T.empty_if_null(F.col(text))
    letters = F.array(F.struct(F.lit("A").alias("ch"), F.regexp_count(t, F.lit(r"[A-Za-z\x7F]")).cast("long").alias("n")))
    rest = F.transform(F.filter(F.split(F.regexp_replace(t, r"[\x00-\x7F]+", ""), ""), lambda c: c != ""), lambda c: F.struct(c.alias("ch"), F.lit(1).cast("long").alias("n")))
    chars = df.select(F.col(key).alias("k"), F.explode(F.concat(letters, rest)).alias("x")).select("k", "x.ch", "x.n").where("n > 0")
    each = chars.groupBy("k", "ch").agg(F.sum("n").alias("n")).withColumn("script", T.script_of(F.ascii("ch")))
    each = each.where(F.col("script").isNotNull()).groupBy("k", "script").agg(F.sum("n").alias("n"))
    return each.groupBy("script").agg(F.sum("n").alias("n_chars"), F.count("*").alias("n_records"))


def script_report(scripts: DataFrame) -> DataFrame:
    return scripts.withColumn("pct", F.round(100 * F.col("n_chars") / F.sum("n_chars").over(Window.partitionBy()), 6)).orderBy(F.desc("n_chars"), "script")


def script_majority(df: DataFrame, pattern: str = "[A-Za-z]", text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, the share of a text's letters that match, and whether they are more than half."""
    letters, own = F.regexp_count(T.empty_if_null(F.col(text)), F.lit(r"\p{L}")), F.regexp_count(T.empty_if_null(F.col(text)), F.lit(pattern))
    share = F.round(F.coalesce(F.try_divide(own, letters), F.lit(0.0)), 6)
    return df.select(F.col(key), share.alias("share"), (share > 0.5).alias("majority"))


def degenerate(text: Column, words: int = 20, size: int = 5, most: int = 3, distinct: float = 0.6) -> Column:
    """Texts that loop: a word 5-gram occurs 3 times or more and fewer than 60 % of them are distinct."""

    def loops(grams: Column) -> Column:
        return (F.size(grams) >= words - size + 1) & (F.size(F.array_distinct(grams)) < distinct * F.size(grams)) & T.occurs(grams, most)

    return T.let(T.hashed_ngrams(T.tokens(text), size), loops)


def first_reason(rules: list[tuple[str, Column]]) -> Column:
    """The name of the first rule that holds; null if none does."""
    out = None
    for name, rule in rules:
        hit = F.coalesce(rule, F.lit(False))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out


def ledger(df: DataFrame, reason: str = "reason") -> DataFrame:
    """reason, n; rows that are kept count as 'kept'."""
    return df.groupBy(F.coalesce(F.col(reason), F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


def rule_hits(df: DataFrame, rules: list[T.Rule], text: str = "text", passes: int = 4, tidy: list[T.Rule] = ()) -> DataFrame:
    """rule, n_hits (replacements of all passes until nothing changes, at most `passes`, and of one pass of the
    tidy rules behind them) and n_texts (texts with any).  Each rule is a projection of its own, so that its
    text is made once; a text that a pass left alone isn't searched again."""
    rows = df.select(T.empty_if_null(F.col(text)).alias("t"), F.lit(True).alias("open"))
    counts: dict[str, list[str]] = {n: [] for n, _, _ in [*rules, *tidy]}

    def apply(rows: DataFrame, rule: T.Rule, when: Column) -> DataFrame:
        name, pattern, to = rule
        c = f"c{sum(map(len, counts.values()))}"
        counts[name].append(c)
        hits = F.when(when, F.regexp_count("t", F.lit(pattern))).otherwise(0)
        rows = rows.withColumn(c, hits.cast("long"))
        return rows.withColumn("t", F.when(F.col(c) > 0, F.regexp_replace("t", pattern, to)).otherwise(F.col("t")))

    for _ in range(passes):
        for rule in rules:
            rows = apply(rows, rule, F.col("open"))
        rows = rows.withColumn("open", F.greatest(*[F.col(x[-1]) for n, x in counts.items() if x], F.lit(0)) > 0)
    for rule in tidy:
        rows = apply(rows, rule, F.lit(True))
    total = lambda own: sum((F.col(c) for c in own[1:]), F.col(own[0]))
    each = F.array(*[F.struct(F.lit(n).alias("rule"), total(own).alias("c")) for n, own in counts.items()])
    return rows.select(F.explode(each).alias("x")).groupBy("x.rule").agg(F.sum("x.c").alias("n_hits"), F.count_if(F.col("x.c") > 0).alias("n_texts"))


def changed(df: DataFrame, new: Column, text: str = "text") -> DataFrame:
    """n_texts, n_changed, chars_before and chars_after of a cleaning."""
    old = T.empty_if_null(F.col(text))
    return df.select(old.alias("a"), new.alias("b")).agg(F.count("*").alias("n_texts"), F.count_if(F.col("a") != F.col("b")).alias("n_changed"), F.sum(F.length("a")).cast("long").alias("chars_before"), F.sum(F.length("b")).cast("long").alias("chars_after"))
