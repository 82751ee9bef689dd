"""Line deduplication by winnowing, with DataFrame functions only.

A text's units are its lines; blank lines belong to the line before them.  Units are compared without
white space at both ends, by hash.  Over every window of `window` units the smallest hash is selected as
fingerprint, so two documents that share a run of that many lines share a fingerprint at the same place
of the run: that guarantee is what is deleted, no more and no less.  Positions meet by fingerprint;
those of fingerprints selected only once go at once.  From a position that meets another one the match is
extended to the units on both sides: by each of the windows that selected it, if all their units (128 bits)
stand around an earlier position as well.  Where the extension from one position reaches the next one's, the
match goes on, so a run is covered to both of its ends.

With `alone`, a unit of that many words counts as a run by itself; without it, single lines that repeat
between changing neighbours stay.

A line goes if a match covers it whose window also occurs earlier, in the order of document id and
line.  Frequent windows are combined before they are shuffled (one row a window leaves a task), and each
position is then joined with the single first position of its window, not with every other one.

Null texts are empty texts; a text without any line but blank ones stays as it is; a text all of whose
lines go becomes empty.  Rows that repeat an id and text are one document and get the same result; rows
with one id and different texts are ordered by a hash of the text; null ids come first.  An empty table
gives no rows.  All columns stay, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwright.llm.common import scratch, written

BLANK = " \t\r\n\x0b\x0c"
#: A newline before the next line that isn't blank.
NEW_UNIT = r"\n(?=[ \t\r\x0b\x0c]*[^ \t\r\n\x0b\x0c])"


def _units(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), NEW_UNIT, -1)


def _key(id_column: str, text_column: str) -> list[Column]:
    return [F.col(id_column).cast("long").alias("d"), F.xxhash64(F.coalesce(F.col(text_column), F.lit(""))).alias("r")]


def windows(df: DataFrame, window: int, id_column: str, text_column: str, alone: int | None = None) -> DataFrame:
    """d, r, start, n, at, fp, k1, k2: the windows of n units of each document, and the place and hash of their minima."""
    trimmed = F.transform(_units(F.col(text_column)), lambda x: F.btrim(x, F.lit(BLANK)))
    hashes = F.transform("u", lambda x: F.when(x != "", F.xxhash64(x)))
    rows = df.select(*_key(id_column, text_column), trimmed.alias("u"))
    long = F.transform("u", lambda x: F.regexp_count(x, F.lit(r"[^ \t\r\n\x0b\x0c]+")) >= alone) if alone else F.lit(None)
    rows = rows.select("d", "r", hashes.alias("h"), long.alias("long"))
    spans = F.when(F.size("h") >= window, F.transform(F.sequence(F.lit(0), F.size("h") - window), lambda s: F.struct(s.alias("start"), F.lit(window).alias("n")))).otherwise(F.array().cast("array<struct<start:int,n:int>>"))
    if alone:
        own = F.transform("long", lambda x, s: F.when(x, F.struct(s.alias("start"), F.lit(1).alias("n"))))
        spans = F.concat(spans, F.filter(own, lambda x: x.isNotNull()))
    rows = rows.select("d", "r", "h", F.explode(spans).alias("x")).select("d", "r", "x.start", "x.n", F.slice("h", F.col("x.start") + 1, F.col("x.n")).alias("w"))
    rows = rows.where(~F.exists("w", F.isnull)).withColumn("fp", F.array_min("w"))
    place = (F.col("start") + F.col("n") - F.array_position(F.reverse("w"), F.col("fp"))).cast("int")  # the last of equal minima
    return rows.select("d", "r", "start", "n", place.alias("at"), "fp", F.xxhash64("w").alias("k1"), F.xxhash64(F.lit(1), "w").alias("k2"))


def repeated(df: DataFrame, window: int, id_column: str, text_column: str, alone: int | None = None) -> DataFrame:
    """d, r, starts and alone: where the windows of a document begin that occur earlier, and such long units, in order."""
    with scratch(df.sparkSession, "lines") as keep:
        return keep(_repeated(written(windows(df, window, id_column, text_column, alone), "windows"), window), "repeated")


def _repeated(rows: DataFrame, window: int) -> DataFrame:
    seeds = rows.groupBy("fp").agg(F.min(F.struct("d", "r", "at", "n")).alias("low"), F.max(F.struct("d", "r", "at", "n")).alias("high"))
    # tables of their own: Spark can split a join with them where a fingerprint or window is frequent
    seeds = written(seeds.where(~F.col("low").eqNullSafe(F.col("high"))).select("fp"), "seeds")
    shared = rows.join(seeds, "fp", "left_semi")
    place = F.struct("d", "r", "start")
    first = shared.groupBy("fp", "k1", "k2").agg(F.min(place).alias("first"), F.max(place).alias("last"))
    first = first.where(~F.col("first").eqNullSafe(F.col("last"))).select("fp", "k1", "k2", "first")
    first = written(first, "first")
    later = shared.join(first, ["fp", "k1", "k2"]).where(~place.eqNullSafe(F.col("first")))
    of = lambda n: F.array_sort(F.collect_set(F.when(n, F.col("start"))))
    return later.groupBy("d", "r").agg(of(F.col("n") == window).alias("starts"), of(F.col("n") != window).alias("alone"))


def dedup_lines(df: DataFrame, window: int = 2, id_column: str = "doc_id", text_column: str = "text", alone: int | None = None) -> DataFrame:
    """The rows with their texts less the repeated runs, and n_lines and n_removed (long) in place of
    columns of those names."""
    found = repeated(df, window, id_column, text_column, alone).select(F.col("d").alias("fd"), F.col("r").alias("fr"), "starts", "alone")
    d, r = _key(id_column, text_column)
    own = {c: f"c{i}" for i, c in enumerate(df.columns)}  # names that nothing here uses otherwise
    rows = df.select(*[F.col(f"`{c}`").alias(n) for c, n in own.items()], d, r)
    # merged at every size: a hot document is split, and the plan doesn't turn where the table grows out of a broadcast
    rows = rows.join(found.hint("merge"), F.col("d").eqNullSafe(F.col("fd")) & (F.col("r") == F.col("fr")), "left")
    # of each matching window, the units that the one before doesn't cover, behind those that none covers
    def covered(starts: str, n: int) -> Column:
        back = lambda i: F.when(i > 0, F.get(starts, i - 1)).otherwise(F.lit(-n))
        return F.flatten(F.transform(starts, lambda s, i: F.concat(F.array_repeat(F.lit(False), F.greatest(s - back(i) - n, F.lit(0))), F.array_repeat(F.lit(True), F.least(s - back(i), F.lit(n))))))

    gone = covered("starts", window)
    if alone:
        gone = F.zip_with(gone, covered("alone", 1), lambda a, b: F.coalesce(a, F.lit(False)) | F.coalesce(b, F.lit(False)))
    text = F.col(own[text_column])
    rows = rows.select(*own.values(), _units(text).alias("units"), gone.alias("gone"))
    kept = F.filter("units", lambda x, i: ~F.coalesce(F.get("gone", i), F.lit(False)))
    new = F.when(F.col("gone").isNull(), F.coalesce(text, F.lit(""))).otherwise(F.array_join(kept, "\n"))
    n = F.size(F.filter("units", lambda x: F.btrim(x, F.lit(BLANK)) != "")).cast("long")
    n_gone = F.when(F.col("gone").isNull(), 0).otherwise(F.size(F.filter("gone", lambda x: x))).cast("long")
    out = [(new if c == text_column else F.col(k)).alias(c) for c, k in own.items() if c not in ("n_lines", "n_removed")]
    return rows.select(*out, n.alias("n_lines"), n_gone.alias("n_removed"))
