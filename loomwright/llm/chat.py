"""Chats from event logs, rendered with a reversible template.

A log holds events of conversations: conv_id, seq (orders the events of a conversation; any type that has
an order), message (names a message within its conversation), kind, role and text.

    start       a message begins, with its role; its place in the conversation is that of this event
    delta       streamed text is appended
    edit        the text so far is replaced
    branch      the same, and all messages that began later go
    regenerate  the text so far is thrown away, and all messages that began later go; new deltas follow
    delete      the message goes, whatever follows

So the final messages follow from the sequence: a message's text is that of its last edit, branch or
regenerate and the deltas behind it; a message goes if it began after another one and before that one's
last branch or regenerate.  The first is an aggregate of a message's own events, combined by conversation
and message, so a conversation with a third of all events is spread over many tasks.  The second is a
running maximum along a conversation's sequence, over numbers only, and only for conversations in which
anything branches.  Both and the render that follows are column expressions.

Template: a turn is "### Role: text</turn>\\n".  A backslash goes before every backslash, every "###" and
every "</turn>" of a text, and before ":" too in a role; reading takes them away, so any text comes back.
The loss mask covers the texts of assistant turns, as rendered.

Null texts and roles are empty; events of a null conversation are a conversation of its own; deltas of
equal seq are ordered by text, and an edit comes after the deltas of its own seq; a message without a
start begins with its first event and has an empty role; rows that repeat a conversation, turn, role and
text are turns of their own; unknown kinds are an error; an empty log gives no rows; other columns aren't
read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwright.llm.common import released, ship, written

MARK, END = "###", "</turn>"
#: Code points of a delta in logs that are made of finished turns.
DELTA = 400

_HEAD = re.compile(r"### ((?:[^\\:]|\\(?:\\|###|</turn>|:))*): ", re.S)
_ESCAPED = re.compile(r"\\(\\|###|</turn>|:)")


def turns_to_events(rows: DataFrame, delta: int = DELTA) -> DataFrame:
    """A log that leads to these rows (conv_id, turn, role, text), with every kind of event: a hash says
    whether a turn is only streamed, or has a draft that is edited, branched or regenerated, or another
    message beside it that is deleted."""
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    rows = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    rows = rows.groupBy("conv_id", "turn", "role", "text").count().withColumn("copy", F.explode(F.sequence(F.lit(1), "count")))
    event = lambda kind, text="", other=False: F.struct(F.lit(kind).alias("kind"), F.lit(text).alias("text") if isinstance(text, str) else text.alias("text"), F.lit(other).alias("other"))
    piece = lambda i: F.col("text").substr(i * delta + 1, F.lit(delta))
    n = F.greatest(F.ceil(F.length("text") / delta) - 1, F.lit(0)).cast("int")  # pieces behind the first
    first = event("delta", piece(F.lit(0)))
    rest = F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: event("delta", piece(i)))).otherwise(F.array().cast("array<struct<kind:string,text:string,other:boolean>>"))
    start, draft = event("start"), event("delta", "draft")
    beside = [event("start", other=True), event("delta", "gone", other=True)]
    stories = [
        [start, first],
        [start, draft, event("edit", piece(F.lit(0)))],
        [start, draft, *beside, event("regenerate"), first],
        [start, *beside, draft, event("branch", piece(F.lit(0)))],
        [start, beside[0], first, *beside[1:], event("delete", other=True)],
    ]
    which = F.pmod(F.xxhash64("conv_id", "turn", "role", "text", "copy"), F.lit(len(stories)))
    story = F.array(*[start])
    for k, x in enumerate(stories):
        story = F.when(which == k, F.array(*x)).otherwise(story)
    place = ["turn", "role", F.xxhash64("text").alias("text_hash"), "copy"]
    events = rows.select("conv_id", *place, F.posexplode(F.concat(story, rest)).alias("step", "e"))
    named = ["turn", "role", "text_hash", "copy"]
    role_ = F.when(F.col("e.kind") == "start", F.when(F.col("e.other"), "other").otherwise(F.col("role")))
    return events.select("conv_id", F.struct(*named, "step").alias("seq"), F.struct(*named, F.col("e.other").alias("other")).alias("message"), "e.kind", role_.alias("role"), "e.text")


def fold(events: DataFrame) -> DataFrame:
    """conv_id, place (the seq of the start), message, role, text: the messages that remain."""
    kinds = ["start", "delta", "edit", "branch", "regenerate", "delete"]
    name = F.coalesce(F.col("kind"), F.lit("null"))
    kind = F.when(name.isin(kinds), name).otherwise(F.raise_error(F.concat(F.lit("an event of kind "), name)))
    log = events.select("conv_id", "message", "seq", kind.alias("kind"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    is_ = lambda *k: F.col("kind").isin(*k)
    own = log.groupBy("conv_id", "message").agg(
        F.min(F.when(is_("start"), F.struct("seq", "role"))).alias("start"),
        F.min("seq").alias("first"),
        F.max(F.when(is_("branch", "regenerate"), F.col("seq"))).alias("cut"),
        F.max(F.when(is_("edit", "branch", "regenerate"), F.struct("seq", "kind", F.when(is_("regenerate"), "").otherwise(F.col("text")).alias("text")))).alias("base"),
        F.bool_or(is_("delete")).alias("deleted"),
        F.array_sort(F.collect_list(F.when(is_("delta"), F.struct("seq", "text")))).alias("deltas"),
    )
    behind = F.filter("deltas", lambda d: F.col("base").isNull() | (d["seq"] > F.col("base.seq")))
    text = F.concat(F.coalesce("base.text", F.lit("")), F.array_join(F.transform(behind, lambda d: d["text"]), ""))
    place, role = F.coalesce("start.seq", "first"), F.coalesce("start.role", F.lit(""))
    messages = written(own.select("conv_id", place.alias("place"), "message", role.alias("role"), text.alias("text"), "cut", "deleted"), "messages")
    marks = messages.select("conv_id", "message", "place", "cut")
    some = marks.where("cut IS NOT NULL").select(F.col("conv_id").alias("c")).distinct()
    before = Window.partitionBy("conv_id").orderBy("place", "message").rowsBetween(Window.unboundedPreceding, -1)
    marks = marks.join(some, F.col("conv_id").eqNullSafe(F.col("c")), "left_semi").withColumn("upto", F.max("cut").over(before))
    cut = marks.where("upto > place").select(F.col("conv_id").alias("c"), F.col("message").alias("m"))
    left = messages.where("NOT deleted").join(cut, F.col("conv_id").eqNullSafe(F.col("c")) & F.col("message").eqNullSafe(F.col("m")), "left_anti")
    return left.select("conv_id", "place", "message", "role", "text")


def _escaped(text: Column, colon: bool = False) -> Column:
    out = F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit(MARK), F.lit("\\" + MARK)), F.lit(END), F.lit("\\" + END))
    return F.replace(out, F.lit(":"), F.lit("\\:")) if colon else out


def render(messages: DataFrame) -> DataFrame:
    """conv_id, place, segment (the turn's formatted text), and loss_start and loss_end (code points
    within the segment; equal where no loss falls)."""
    role = F.concat(F.upper(F.substring("role", 1, 1)), F.expr("substring(role, 2)"))
    role = F.when(F.col("role").rlike(r"\A[a-z]+\z"), role).otherwise(F.concat(F.lit("\\"), F.col("role")))  # so that any role comes back
    head, body = F.concat(F.lit(MARK + " "), _escaped(role, True), F.lit(": ")), _escaped(F.col("text"))
    rows = messages.select("conv_id", "place", (F.col("role") == "assistant").alias("loss"), head.alias("head"), body.alias("body"))
    start = F.length("head").cast("long")
    return rows.select("conv_id", "place", F.concat("head", "body", F.lit(END + "\n")).alias("segment"), start.alias("loss_start"), (start + F.when(F.col("loss"), F.length("body")).otherwise(0)).alias("loss_end"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def read_turns(formatted: str) -> Iterator[tuple[str, str]]:
    """(role, text) of each turn of a formatted conversation, or of a part of it that holds whole turns."""
    at = 0
    while at < len(formatted):
        m = _HEAD.match(formatted, at)
        if not m:
            raise ValueError("not a turn")
        end = m.end()
        while True:
            end = formatted.index(END, end)
            slashes = end - len(formatted[m.end() : end].rstrip("\\")) - m.end()
            if slashes % 2 == 0:
                break
            end += len(END)
        role = unescape(m[1])
        yield role[1:] if role[:1] == "\\" else role[:1].lower() + role[1:], unescape(formatted[m.end() : end])
        at = end + len(END) + 1


def conversation_digests(segments: DataFrame) -> DataFrame:
    """Reads rendered turns back: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256 and
    formatted_chars.  A conversation's turns stream through one task, a batch in memory at a time."""
    ship(segments.sparkSession)

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            out: list[tuple] = []
            for conv, segment, a, b in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3, 4))):
                if state is None or conv != key:
                    if state:
                        out.append(done(key, state))
                    key, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text in read_turns(segment):
                    state[0] += 1
                    state[1].update(f"{role}\n{text}\n".encode())
                loss = unescape(segment[a:b])
                state[2] += len(loss)
                state[3].update(loss.encode())
                state[4] += len(segment)
            yield rows(out)
        if state:
            yield rows([done(key, state)])

    def done(key: int | None, s: list) -> tuple:
        return key, s[0], s[1].hexdigest(), s[2], s[3].hexdigest(), s[4]

    names = [("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())]

    def rows(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({n: pa.array([x[k] for x in out], t) for k, (n, t) in enumerate(names)})

    log = segments.select("conv_id", "place", "segment", "loss_start", "loss_end").repartition("conv_id").sortWithinPartitions("conv_id", "place")
    return log.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def format_log(events: DataFrame) -> DataFrame:
    """The rendered turns of a log."""
    return render(fold(events))


def conversations(segments: DataFrame) -> DataFrame:
    """conv_id and formatted: whole conversations, for those that fit into a row."""
    return segments.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("place", "segment"))).alias("x")).select("conv_id", F.array_join(F.transform("x", lambda t: t.segment), "").alias("formatted"))
