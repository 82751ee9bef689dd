"""Dialogues as arrays of messages: assembly, trimming, repair, rendering with supervised spans, mixing."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, fields

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwright.functions import text as T
from loomwright.functions.text import let


def assemble(turns: DataFrame, key: str = "conv_id", order: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """key, messages: array of content and role in order."""
    rows = turns.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("content"), F.col(role).alias("role")))).alias("x"))
    return rows.select(key, F.transform("x", lambda m: F.struct(m["content"].alias("content"), m["role"].alias("role"))).alias("messages"))


def trim(messages: Column) -> Column:
    """What follows the last assistant turn goes; empty if there is none."""
    return let(messages, lambda m: F.slice(m, 1, F.size(m) - F.coalesce(F.nullif(F.array_position(F.reverse(F.transform(m, lambda x: x["role"])), F.lit("assistant")), F.lit(0)) - 1, F.size(m)).cast("int")))


def first_empty(messages: Column) -> Column:
    """The position, from 0, of the first turn without content; null if there is none."""
    blank = F.transform(messages, lambda x: (T.strip(T.empty_if_null(x["content"])) == "").cast("int"))
    return F.nullif(F.array_position(blank, F.lit(1)), F.lit(0)) - 1


def repair(messages: Column) -> Column:
    """struct(messages, reason): cut at the first empty turn, to an even number of turns; dialogues without
    two turns left, or that don't end with an assistant turn, have no messages and a reason."""

    def body(m: Column) -> Column:
        empty = first_empty(m)
        keep = F.coalesce(empty - empty % 2, F.size(m)).cast("int")
        kept = F.slice(m, 1, keep)
        none = F.slice(m, 1, 0)
        last = F.element_at(F.transform(kept, lambda x: x["role"]), -1)
        reason = F.when(F.size(m) == 0, "empty").when(empty.isNotNull() & (keep < 2), "no_content_before_empty_turn")
        reason = reason.when(F.size(kept) == 0, "empty").when(~last.eqNullSafe("assistant"), "not_assistant_last")
        note = F.when(empty.isNotNull(), "truncated_at_empty_turn")
        return F.struct(F.when(reason.isNotNull(), none).otherwise(kept).alias("messages"), F.coalesce(reason, note).alias("reason"))

    return let(messages, body)


def prepare(messages: Column, clean) -> Column:
    """Trailing turns go first, then contents are cleaned, then the dialogue is repaired."""

    def body(m: Column) -> Column:
        cleaned = F.transform(m, lambda x: F.struct(clean(T.empty_if_null(x["content"])).alias("content"), x["role"].alias("role")))
        return F.when(F.size(m) < 2, F.struct(F.slice(m, 1, 0).alias("messages"), F.lit("no_assistant_turn").alias("reason"))).otherwise(repair(cleaned))

    return let(trim(messages), body)


@dataclass(frozen=True)
class Template:
    """How a dialogue becomes text.  Fixed values: the names and defaults of these settings, which files of
    settings use."""

    user_prefix: str = "### User:\n"
    assistant_prefix: str = "### Assistant:\n"
    system_prefix: str = "### System:\n"
    turn_separator: str = "\n\n"
    eos: str = "<|end_of_text|>"
    bos: str = ""
    system_prompt: str = ""

    @staticmethod
    def of(settings: dict) -> Template:
        unknown = set(settings) - {f.name for f in fields(Template)}
        if unknown:
            raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
        return Template(**settings)

    def chat_template(self) -> str:
        """The rendering of `render` as a Jinja template, for a tokenizer's configuration: messages go in, and
        add_generation_prompt, which is taken as false where it isn't defined."""
        say = lambda *parts: "{{ " + " + ".join(parts) + " }}"
        text = lambda s: json.dumps(s, ensure_ascii=False)
        content = "message['content']"
        roles = [
            ("if message['role'] == 'assistant'", [text(self.assistant_prefix), content, text(self.eos)]),
            ("elif loop.first and message['role'] == 'system'", [text(self.system_prefix), content]),
            ("else", [text(self.user_prefix), content]),
        ]
        out = [say(text(self.bos))] if self.bos else []
        if self.system_prompt:
            out += ["{% if messages[0]['role'] != 'system' %}", say(text(self.system_prefix + self.system_prompt + self.turn_separator)), "{% endif %}"]
        out += ["{% for message in messages %}", "{% if not loop.first %}", say(text(self.turn_separator)), "{% endif %}"]
        for test, parts in roles:
            out += ["{% " + test + " %}", say(*parts)]
        out += ["{% endif %}", "{% endfor %}", "{% if add_generation_prompt %}", say(text(self.turn_separator + self.assistant_prefix)), "{% endif %}"]
        return "".join(out)

    def fingerprint(self) -> str:
        return hashlib.sha1(json.dumps(asdict(self), sort_keys=True, ensure_ascii=False).encode()).hexdigest()[:10]


def render(messages: Column, t: Template = Template(), generation: bool = False) -> Column:
    """struct(text, spans): spans are the character ranges (s, e) of assistant contents with their end."""

    def parts(m: Column) -> Column:
        role = lambda x: x["role"]
        rows = F.transform(
            m,
            lambda x, i: F.struct(
                F.when((i == 0) & (role(x) == "system"), t.system_prefix).when(role(x) == "assistant", t.assistant_prefix).otherwise(t.user_prefix).alias("prefix"),
                F.concat(T.empty_if_null(x["content"]), F.when(role(x) == "assistant", t.eos).otherwise("")).alias("body"),
                (role(x) == "assistant").alias("loss"),
            ),
        )
        if not t.system_prompt:
            return rows
        own = F.array(F.struct(F.lit(t.system_prefix).alias("prefix"), F.lit(t.system_prompt).alias("body"), F.lit(False).alias("loss")))
        return F.when(F.get(m, F.lit(0))["role"].eqNullSafe("system"), rows).otherwise(F.concat(own, rows))

    def body(rows: Column) -> Column:
        text = F.concat(F.lit(t.bos), F.array_join(F.transform(rows, lambda p: F.concat(p["prefix"], p["body"])), t.turn_separator))
        if generation:
            text = F.concat(text, F.lit(t.turn_separator + t.assistant_prefix))
        zero = F.struct(F.lit(len(t.bos)).alias("at"), F.array().cast("array<struct<s:int,e:int>>").alias("spans"))

        def step(a: Column, p: Column) -> Column:
            start = a["at"] + F.length(p["prefix"])
            end = start + F.length(p["body"])
            span = F.array(F.struct(start.cast("int").alias("s"), end.cast("int").alias("e")))
            return F.struct((end + len(t.turn_separator)).cast("int").alias("at"), F.when(p["loss"], F.concat(a["spans"], span)).otherwise(a["spans"]).alias("spans"))

        return F.struct(text.alias("text"), F.aggregate(rows, zero, step, lambda a: a["spans"]).alias("spans"))

    return let(let(messages, parts), body)


#: Ranges that ids are cut into, less one.
BOUNDS = 255


def assign_stride(a: DataFrame, b: DataFrame, key: str, stride: int, names: tuple[str, str] = ("si", "en")) -> DataFrame:
    """key and language for the ids that both tables have: each `stride`th in order, from the first, is the
    second language.  A sample of ids (at most BOUNDS) cuts the order into ranges; places are counted within
    them and the ranges' sizes are summed, so no task sorts all ids."""
    shared = a.select(key).intersect(b.select(key))
    bounds = sorted(r[0] for r in shared.orderBy(F.md5(F.col(key).cast("string"))).limit(BOUNDS).collect())
    rows = shared.withColumn("__p", F.size(F.filter(F.array(*[F.lit(x) for x in bounds]), lambda x: x <= F.col(key))) if bounds else F.lit(0))
    own = rows.withColumn("__i", F.row_number().over(Window.partitionBy("__p").orderBy(key)))
    sizes = rows.groupBy("__p").agg(F.count("*").alias("__n"))
    before = sizes.select("__p", (F.sum("__n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, 0)) - F.col("__n")).alias("__b"))  # BOUNDS + 1 rows at most
    place = F.col("__b") + F.col("__i") - 1
    return own.join(F.broadcast(before), "__p").select(key, F.when(place % stride == 0, names[1]).otherwise(names[0]).alias("language"))


def id_statistics(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Distinct ids of each table, shared ones, and those of one only."""
    x, y = a.select(key).distinct().withColumn("__a", F.lit(1)), b.select(key).distinct().withColumn("__b", F.lit(1))
    return x.join(y, key, "full_outer").agg(F.count("__a").alias("n_a"), F.count("__b").alias("n_b"), F.count_if(F.expr("__a is not null and __b is not null")).alias("n_shared"), F.count_if(F.col("__b").isNull()).alias("only_a"), F.count_if(F.col("__a").isNull()).alias("only_b"))


def turn_statistics(rows: DataFrame, messages: str = "messages") -> DataFrame:
    n = F.size(messages)
    last = F.element_at(F.transform(messages, lambda x: x["role"]), -1)
    return rows.agg(F.count("*").alias("n_dialogues"), F.round(F.avg(n), 6).alias("mean_turns"), F.max(n).alias("max_turns"), F.count_if(~last.eqNullSafe("assistant")).alias("n_not_assistant_last"))


def drop_counts(rows: DataFrame, result: str = "r") -> DataFrame:
    """reason, n of prepared dialogues; those kept whole count as 'kept'."""
    return rows.groupBy(F.coalesce(F.col(f"{result}.reason"), F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))
