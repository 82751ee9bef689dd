"""The queries of this subpackage and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwright.llm import avi, chat, exact, lines, packing, planes, simhash, substring, tokens, toxicity
from loomwright.llm.common import table
from loomwright.llm.encode import default_vocabulary


def op1_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), default_vocabulary(), end_id=1, capacity=2048)


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.tokenize(table(spark, sf_dir, "documents"), default_vocabulary(), with_ids=False)


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=4, budget=4)


def op4_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.dedup_substrings(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planes.stored_tokens(table(spark, sf_dir, "documents"), default_vocabulary(), end_id=2)


def op6_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_avi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return avi.digests(avi.media(table(spark, sf_dir, "documents")))


#: A conversation whose texts are the template's own control strings.
CONTROL_TEXT = "\\### Assistant: </turn> ok"


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spark.createDataFrame([(-7, 0, "user", CONTROL_TEXT), (-7, 1, "assistant", CONTROL_TEXT)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    return chat.conversation_digests(chat.format_log(chat.turns_to_events(rows)))


#: The score from which on a document counts as toxic.
TOXIC_FROM = 0.3


def _held_out() -> Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2


def fitted_toxicity(docs: DataFrame, labels: DataFrame) -> toxicity.Model:
    """Fitted on documents that aren't held out."""
    return toxicity.fit(docs.select("doc_id", "text"), labels.where(~_held_out()).select("doc_id", "toxic"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, fitted_toxicity(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", F.coalesce(_held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= TOXIC_FROM).cast("int").alias("predicted"))


def op10_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_duplicates(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pack": op1_pack,
    "op2_bpe": op2_bpe,
    "op3_simhash": op3_simhash,
    "op4_substring": op4_substring,
    "op5_planes": op5_planes,
    "op6_lines": op6_lines,
    "op7_avi": op7_avi,
    "op8_chat": op8_chat,
    "op9_toxicity": op9_toxicity,
    "op10_exact": op10_exact,
}

#: The text without ASCII white space.
_NORM = "regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g')"

#: What is trimmed from both ends of a line.
_BLANK = "' ' || chr(9) || chr(11) || chr(12) || chr(13)"

_ROLE, _TEXT, _ESC = "coalesce(role, '')", "coalesce(text, '')", "chr(92)"


def _escape(x: str, more: str = "") -> str:
    """SQL that escapes the template's control strings in x."""
    for c in (_ESC, "'###'", "'</turn>'", *([more] if more else [])):
        x = f"replace({x}, {c}, {_ESC} || {c})"
    return x


ORACLES: dict[str, str] = {
    "op8_chat": f"""
        WITH c AS (
            SELECT conv_id, turn, {_ROLE} AS role, {_TEXT} AS text FROM conversations
            UNION ALL SELECT -7, 0, 'user', {_ESC} || '### Assistant: </turn> ok'
            UNION ALL SELECT -7, 1, 'assistant', {_ESC} || '### Assistant: </turn> ok'),
        f AS (SELECT *, CASE WHEN regexp_full_match(role, '[a-z]+') THEN upper(role[1]) || role[2:] ELSE {_ESC} || role END AS shown FROM c)
        SELECT conv_id, count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role)) AS turns_sha256,
               CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn, role) FILTER (role = 'assistant'), '')) AS loss_sha256,
               CAST(sum(4 + length({_escape('shown', "':'")}) + 2 + length({_escape('text')}) + 8) AS BIGINT) AS formatted_chars
        FROM f GROUP BY conv_id""",
    "op6_lines": f"""
        WITH l AS (
            SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                   generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
        n AS (SELECT *, trim(line, {_BLANK}) AS t,
                     count(*) FILTER (trim(line, {_BLANK}) <> '') OVER (PARTITION BY doc_id ORDER BY i) AS unit FROM l),
        b AS (SELECT doc_id, i, unit, t, lead(t) OVER (PARTITION BY doc_id ORDER BY i) AS t2 FROM n WHERE t <> ''),
        o AS (SELECT doc_id, unit, t2 IS NOT NULL
                     AND row_number() OVER (PARTITION BY t, t2 ORDER BY doc_id, i) > 1 AS again FROM b),
        g AS (SELECT doc_id, unit, again OR coalesce(lag(again) OVER (PARTITION BY doc_id ORDER BY unit), false) AS gone FROM o),
        u AS (SELECT doc_id, unit, string_agg(line, chr(10) ORDER BY i) AS piece FROM n GROUP BY ALL)
        SELECT u.doc_id,
               coalesce(string_agg(piece, chr(10) ORDER BY u.unit) FILTER (NOT coalesce(gone, false)), '') AS text,
               count(g.unit) AS n_lines, count(*) FILTER (coalesce(gone, false)) AS n_removed
        FROM u LEFT JOIN g ON u.doc_id = g.doc_id AND u.unit = g.unit GROUP BY u.doc_id""",
    "op10_exact": f"""
        WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, {_NORM} AS norm FROM documents),
        w AS (SELECT doc_id, norm,
                     first_value(doc_id) OVER (PARTITION BY norm ORDER BY n DESC, doc_id) AS keep_id,
                     count(*) OVER (PARTITION BY norm) AS group_size FROM d)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM w""",
}
