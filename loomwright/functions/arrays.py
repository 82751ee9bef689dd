"""Array functions as column expressions: token sequences, masks, option scores, vectors.

Positions count from 0, as in the tables; the first of equal values wins.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomwright.functions.text import let

IGNORED = -100


def truncate(ids: Column, budget: Column | int) -> Column:
    n = F.lit(budget) if isinstance(budget, int) else budget
    return F.slice(ids, 1, F.greatest(n, F.lit(0)))


def pad(ids: Column, n: int, value: int = 0, left: bool = False) -> Column:
    fill = F.array_repeat(F.lit(value), F.greatest(F.lit(n) - F.size(ids), F.lit(0)))
    return F.concat(fill, ids) if left else F.concat(ids, fill)


def attention_mask(ids: Column, n: int, left: bool = False) -> Column:
    return pad(F.transform(ids, lambda _: F.lit(1)), n, 0, left)


def mask_prefix(ids: Column, prefix: Column) -> Column:
    """Labels: IGNORED for the first `prefix` tokens."""
    return F.transform(ids, lambda x, i: F.when(i < prefix, F.lit(IGNORED)).otherwise(x))


def mask_spans(ids: Column, offsets: Column, spans: Column) -> Column:
    """Labels: a token counts if its offsets (s, e) lie within one of the spans (s, e)."""
    return F.transform(F.arrays_zip(ids.alias("id"), offsets.alias("o")), lambda t: F.when(F.exists(spans, lambda x: (t["o"]["s"] >= x["s"]) & (t["o"]["e"] <= x["e"])), t["id"]).otherwise(F.lit(IGNORED)))


def supervised(labels: Column) -> Column:
    return F.size(F.filter(labels, lambda x: x != IGNORED))


def cut_at_turn(n: Column, ends: Column, most: int) -> Column:
    """Where to cut n tokens: at the last turn end that fits, else hard; n if all fit."""
    return F.when(n <= most, n).otherwise(F.coalesce(F.array_max(F.filter(ends, lambda t: t <= most)), F.lit(most)))


def chunks(ids: Column, size: int, stride: int, most: int) -> Column:
    """Overlapping windows; the last one that reaches the end is the last."""

    def body(x: Column) -> Column:
        n = F.size(x)
        last = F.least(F.greatest(F.ceil((n - size) / F.lit(stride)), F.lit(0)), F.lit(most - 1)).cast("int")
        return F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(x, i * stride + 1, size))

    return let(ids, body)


def perplexity_windows(n: Column, size: int, stride: int) -> Column:
    """(begin, end) of strided evaluation windows over n tokens."""
    steps = F.sequence(F.lit(0), F.greatest(F.ceil(n / F.lit(stride)).cast("int") - 1, F.lit(0)))
    return F.transform(steps, lambda i: F.struct(F.greatest(i * stride + stride - size, F.lit(0)).alias("begin"), F.least(i * stride + stride, n).alias("end")))


def continuation(context: Column, whole: Column, alone: Column, most: int) -> Column:
    """struct(ids, start): the ids of a context and what follows it, and where that begins.  whole: the ids of
    both as one text; where they don't begin with those of the context, or nothing follows, the ids of the
    rest alone are put behind it.  Of more than `most` ids the last ones stay; start is 1 at least, as each
    id is scored by those before it."""
    n = F.size(context)
    ids = F.when((F.size(whole) > n) & (F.slice(whole, 1, n) == context), whole).otherwise(F.concat(context, alone))

    def cut(x: Column) -> Column:
        gone = F.greatest(F.size(x) - most, F.lit(0))
        return F.struct(F.slice(x, gone + 1, most).alias("ids"), F.greatest(n - gone, F.lit(1)).alias("start"))

    return let(ids, cut)


def argmax(xs: Column) -> Column:
    return F.array_position(xs, F.array_max(xs)) - 1


def log_softmax(xs: Column) -> Column:
    def body(x: Column) -> Column:
        top = F.array_max(x)
        return let(top + F.log(F.aggregate(x, F.lit(0.0), lambda a, v: a + F.exp(v - top))), lambda z: F.transform(x, lambda v: v - z))

    return let(xs, body)


def softmax(xs: Column) -> Column:
    return F.transform(log_softmax(xs), lambda v: F.exp(v))


def minus(xs: Column, ys: Column) -> Column:
    return F.zip_with(xs, ys, lambda a, b: a - b)


def rotate(xs: Column, r: Column) -> Column:
    """Slot i shows option (i + r) % n."""
    n = F.size(xs)
    return F.concat(F.slice(xs, r % n + 1, n), F.slice(xs, 1, r % n))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double")), F.lit(0.0), lambda s, x: s + x * x)


def cosine(a: Column, b: Column) -> Column:
    """0 where a vector is zero."""
    return F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(0.0))


def angle(cos: Column) -> Column:
    return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cos))))
