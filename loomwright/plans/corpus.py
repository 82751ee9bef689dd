"""Queries on labelled texts: profiles, cleaning, duplicates, splits."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwright.functions import text as T
from loomwright.operators import quality as Q
from loomwright.operators import splits as S
from loomwright.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


#: DuckDB: the words between white space, and a text's dedup key.
WORDS = "list_filter(string_split_regex(coalesce(text, ''), '\\s+'), lambda x: x <> '')"
KEY = "replace(lower(trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g'))), 'ß', 'ss')"
BUCKET = "CAST(CAST(('0x' || substr(md5('s|' || doc_id), 1, 8)) AS BIGINT) % 10 AS INTEGER)"
SPLIT = f"CASE WHEN {BUCKET} < 8 THEN 'train' WHEN {BUCKET} = 8 THEN 'val' ELSE 'test' END"


def docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


def labelled(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).join(table(spark, d, "labels"), "doc_id")


def with_split(df: DataFrame) -> DataFrame:
    b = S.hash_bucket("s", 10, "doc_id")
    return df.withColumn("split", F.when(b < 8, "train").when(b == 8, "val").otherwise("test"))


#: Written out for the ranges up to U+04FF, in which all of the driver's characters lie; a character beyond fails.
_BLOCKS = """WHEN c <= 127 THEN 'English / Basic Latin' WHEN c <= 255 THEN 'Latin Extended (Western European)' WHEN c <= 591 THEN 'Latin Extended A/B (Central/Eastern European)'
    WHEN c < 880 THEN NULL WHEN c <= 1023 THEN 'Greek' WHEN c <= 1279 THEN 'Cyrillic (Russian, Bulgarian, etc.)' ELSE 'beyond'"""


@query(f"""
    WITH ch AS (SELECT doc_id, unnest(string_split(text, '')) AS ch FROM documents WHERE text <> ''),
    s AS (SELECT doc_id, unicode(ch) AS c FROM ch WHERE ch <> ''),
    k AS (SELECT doc_id, CASE WHEN c < 65 OR c BETWEEN 91 AND 96 OR c BETWEEN 123 AND 126 THEN NULL {_BLOCKS} END AS script FROM s),
    g AS (SELECT script, CAST(count(*) AS BIGINT) AS n_chars, count(DISTINCT doc_id) AS n_records FROM k WHERE script IS NOT NULL GROUP BY 1)
    SELECT script, n_chars, n_records, round(100 * n_chars / sum(n_chars) OVER (), 6) AS pct FROM g""")
def script_profile(spark, d):
    return Q.script_report(Q.character_scripts(docs(spark, d)))


@query("""
    WITH t AS (SELECT count(*) AS n_total, count(text) AS a, count(lang) AS b, count(quality) AS c, count(toxic) AS e FROM documents LEFT JOIN labels USING (doc_id))
    SELECT field, n_present, n_total, round(100 * n_present / n_total, 6) AS pct
    FROM (SELECT n_total, unnest(['text', 'lang', 'quality', 'toxic']) AS field, unnest([a, b, c, e]) AS n_present FROM t)""")
def field_coverage(spark, d):
    return Q.field_coverage(docs(spark, d).join(table(spark, d, "labels"), "doc_id", "left"), ["text", "lang", "quality", "toxic"])


@query(f"""SELECT count(*) AS n_records, count(*) FILTER (trim(coalesce(text, ''), ' ' || chr(10)) = '') AS n_empty,
    count(*) FILTER (len({WORDS}) BETWEEN 1 AND 4) AS n_very_short FROM documents""")
def empty_and_short(spark, d):
    return Q.emptiness(docs(spark, d))


@query("""SELECT quality AS label, count(*) AS n, arg_max(lang, doc_id) AS label_name, round(100 * count(*) / sum(count(*)) OVER (), 6) AS pct
    FROM documents JOIN labels USING (doc_id) GROUP BY quality""")
def label_distribution(spark, d):
    return Q.label_distribution(labelled(spark, d), "quality", "doc_id", "lang")


@query("""WITH c AS (SELECT count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY quality), m AS (SELECT max(n) AS n_max, min(n) AS n_min FROM c)
    SELECT n_max, n_min, round(n_max / n_min, 6) AS ratio, CASE WHEN n_max / n_min > 5 THEN 'highly imbalanced' WHEN n_max / n_min > 2 THEN 'imbalanced' ELSE 'balanced' END AS verdict FROM m""")
def class_balance(spark, d):
    return Q.class_balance(Q.label_distribution(labelled(spark, d), "quality", "doc_id"))


@query(f"""
    WITH v AS (SELECT 'chars' AS metric, length(text) AS v FROM documents UNION ALL SELECT 'tokens', len({WORDS}) FROM documents),
    l AS (SELECT metric, list_sort(list(v)) AS x, count(*) AS n, min(v) AS n_min, max(v) AS n_max, round(avg(v), 6) AS mean FROM v GROUP BY metric)
    SELECT metric, n, n_min, n_max, mean, x[CAST(floor(n * 0.5) AS INT) + 1] AS median, x[CAST(floor(n * 0.1) AS INT) + 1] AS p10, x[CAST(floor(n * 0.9) AS INT) + 1] AS p90 FROM l""")
def length_stats(spark, d):
    return Q.length_stats(docs(spark, d), {"chars": F.length("text"), "tokens": T.token_count(F.col("text"))})


@query(f"""SELECT quality AS label, count(*) AS n, round(avg(len({WORDS})), 6) AS mean_tokens, round(avg(length(text)), 6) AS mean_chars
    FROM documents JOIN labels USING (doc_id) GROUP BY quality""")
def means_by_label(spark, d):
    return Q.means_by_label(labelled(spark, d), "quality")


@query("""WITH g AS (SELECT count(*) AS n FROM documents GROUP BY text HAVING count(*) > 1)
    SELECT count(*) AS n_groups, CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS n_surplus FROM g""")
def exact_duplicates(spark, d):
    return Q.duplicate_summary(Q.duplicate_groups(docs(spark, d), F.col("text"), "doc_id"))


@query("""SELECT min(doc_id) AS first, count(*) AS n, substr(replace(text, chr(10), ' '), 1, 60) AS preview
    FROM documents GROUP BY text HAVING count(*) > 1 ORDER BY n DESC, first LIMIT 3""")
def dup_top3(spark, d):
    return Q.top_duplicates(Q.duplicate_groups(docs(spark, d), F.col("text"), "doc_id"))


@query("SELECT min(doc_id) AS doc_id FROM documents GROUP BY text")
def dedup_keep_first(spark, d):
    return S.keep_first(docs(spark, d), ["text"], ["doc_id"]).select("doc_id")


@query(f"SELECT min(doc_id) AS doc_id, lang FROM documents GROUP BY lang, {KEY}")
def dedup_normalised(spark, d):
    return S.keep_first(docs(spark, d), ["lang", T.dedup_key(F.col("text"))], ["doc_id"]).select("doc_id", "lang")


@query("""SELECT doc_id FROM documents WHERE regexp_replace(coalesce(text, ''), '\\s+', '', 'g') NOT IN (SELECT regexp_replace(text, '\\s+', '', 'g') FROM benchmark WHERE text IS NOT NULL)""")
def eval_leak_exact(spark, d):
    keys = table(spark, d, "benchmark").select(T.question_key(F.col("text")).alias("k")).distinct()
    return docs(spark, d).withColumn("k", T.question_key(F.col("text"))).join(keys, "k", "left_anti").select("doc_id")


@query("""SELECT DISTINCT doc_id, item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text) WHERE length(b.text) > 0""")
def eval_leak_contains(spark, d):
    """Which benchmark items a document holds whole.  The hash of 5 words inside an item is an equi-join key
    against the hashes of all 5-word windows, so the cost follows the corpus and not its product with the
    items; only ids and hashes meet, and texts follow for the hits.  Items of 7 words or fewer have no such
    words and are searched for in every document: Spark broadcasts them if they are few."""
    words = lambda: F.split(T.collapse_ws(F.col("text")), " ")
    items = table(spark, d, "benchmark").where("length(text) > 0").select("item_id", F.col("text").alias("item"), words().alias("w"))
    long = items.where(F.size("w") > 7).select("item_id", F.get(T.hashed_ngrams(F.slice("w", 2, 5), 5), F.lit(0)).alias("g"))
    grams = docs(spark, d).select("doc_id", F.explode(T.hashed_ngrams(words(), 5)).alias("g"))
    hits = grams.join(long, "g").select("doc_id", "item_id").distinct()
    found = hits.join(items.select("item_id", "item"), "item_id").join(docs(spark, d).select("doc_id", "text"), "doc_id").where(F.contains("text", F.col("item"))).select("doc_id", "item_id")
    short = items.where(F.size("w") <= 7).select("item_id", "item")
    few = docs(spark, d).join(short, F.contains("text", F.col("item"))).select("doc_id", "item_id")
    return found.unionByName(few).distinct()


_SPLITS = f"WITH s AS (SELECT doc_id, {KEY} AS k, {SPLIT} AS split FROM documents)"


@query(f"""{_SPLITS}, p AS (SELECT unnest(['test', 'val', 'test']) AS a, unnest(['train', 'train', 'val']) AS b)
    SELECT a, b, count(*) AS n_a, count(*) FILTER (EXISTS (SELECT 1 FROM s t WHERE t.split = b AND t.k = s.k)) AS n_leaked FROM p JOIN s ON s.split = p.a GROUP BY a, b""")
def split_leakage(spark, d):
    rows = with_split(docs(spark, d)).select("doc_id", "split", T.dedup_key(F.col("text")).alias("k"))
    return S.leakage(rows, "k", "split", [("test", "train"), ("val", "train"), ("test", "val")])


@query(f"""{_SPLITS}, f AS (SELECT split, k, min(doc_id) AS doc_id FROM s GROUP BY 1, 2)
    SELECT doc_id, split FROM f WHERE split = 'test'
      OR (split = 'val' AND k NOT IN (SELECT k FROM f WHERE split = 'test'))
      OR (split = 'train' AND k NOT IN (SELECT k FROM f WHERE split <> 'train'))""")
def decontaminate(spark, d):
    rows = with_split(docs(spark, d)).select("doc_id", "split", T.dedup_key(F.col("text")).alias("k"))
    return S.decontaminate(rows, "k", "split", "doc_id").select("doc_id", "split")


_STRATA = """WITH r AS (SELECT doc_id, quality, count(*) OVER (PARTITION BY quality) AS n,
        row_number() OVER (PARTITION BY quality ORDER BY md5('42|' || doc_id), doc_id) - 1 AS i FROM labels),
    z AS (SELECT *, greatest(1, CAST(round_even(n * 0.1, 0) AS INT)) AS h FROM r),
    s AS (SELECT *, CASE WHEN n - 2 * h < 1 THEN CASE WHEN i < 1 THEN 'train' WHEN i < 1 + greatest(1, (n - 1) // 2) THEN 'val' ELSE 'test' END
        ELSE CASE WHEN i < n - 2 * h THEN 'train' WHEN i < n - h THEN 'val' ELSE 'test' END END AS split FROM z)"""


@query(f"{_STRATA} SELECT doc_id, quality, split FROM s")
def stratified_split(spark, d):
    rows = table(spark, d, "labels").select("doc_id", "quality")
    return S.stratified_split(rows, "quality", "42", "doc_id")


@query(f"""{_STRATA}, g AS (SELECT split, quality AS label, count(*) AS n FROM s GROUP BY 1, 2)
    SELECT split, label, n, round(100 * n / sum(n) OVER (PARTITION BY split), 6) AS split_pct,
    round(100 * (sum(n) OVER (PARTITION BY label)) / sum(n) OVER (), 6) AS all_pct FROM g""")
def stratified_split_sizes(spark, d):
    return S.split_summary(stratified_split(spark, d), "quality")


@query("SELECT doc_id FROM documents ORDER BY md5('7|' || doc_id), doc_id LIMIT 100")
def hash_sample(spark, d):
    return S.sample(docs(spark, d).select("doc_id"), 100, "7", "doc_id")


@query("SELECT doc_id, CAST(row_number() OVER (ORDER BY md5('9|' || doc_id), doc_id) AS BIGINT) AS place FROM documents")
def seeded_shuffle(spark, d):
    """Places of a global shuffle, counted within ranges of the order and then over the ranges."""
    return S.places(docs(spark, d).select("doc_id"), [], "9", "doc_id").select("doc_id", (F.col("__i") + 1).cast("long").alias("place"))


@query("SELECT source, doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) <= 3")
def first_per_source(spark, d):
    return S.first_per_group(docs(spark, d).select("source", "doc_id"), ["source"], ["doc_id"], 3)


@query("""SELECT doc_id FROM documents ORDER BY doc_id LIMIT (SELECT CAST(floor(count(*) * 0.25) AS BIGINT) FROM documents)""")
def head_share(spark, d):
    rows = docs(spark, d).select("doc_id")
    return S.first_rows(rows, int(rows.count() * 0.25), "doc_id")


_GRAMS = f"""w AS (SELECT doc_id, text, {WORDS} AS w FROM documents),
    gr AS (SELECT doc_id, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS g FROM w WHERE len(w) >= 20),
    gc AS (SELECT doc_id, g, count(*) AS c FROM gr GROUP BY 1, 2),
    dg AS (SELECT doc_id, max(c) >= 3 AND count(*) < 0.6 * sum(c) AS bad FROM gc GROUP BY 1)"""


@query(f"WITH {_GRAMS} SELECT doc_id FROM dg WHERE bad")
def degenerate_text(spark, d):
    return docs(spark, d).where(Q.degenerate(F.col("text"))).select("doc_id")


@query(f"""WITH {_GRAMS},
    a AS (SELECT w.doc_id, text, len(w) AS n, coalesce(bad, false) AS bad, regexp_replace(coalesce(text, ''), '\\s+', '', 'g') AS k FROM w LEFT JOIN dg USING (doc_id)),
    b AS (SELECT *, CASE WHEN n = 0 THEN 'empty' WHEN n < 5 THEN 'very_short' WHEN k IN (SELECT regexp_replace(text, '\\s+', '', 'g') FROM benchmark) THEN 'eval_leak' END AS r FROM a),
    c AS (SELECT *, row_number() OVER (PARTITION BY r, k ORDER BY doc_id) AS i FROM b)
    SELECT coalesce(r, CASE WHEN i > 1 THEN 'duplicate' WHEN bad THEN 'degenerate_text' ELSE 'kept' END) AS reason, count(*) AS n FROM c GROUP BY 1""")
def drop_ledger(spark, d):
    """Rules in order; duplicates are counted over the rows that the rules before them left."""
    keys = table(spark, d, "benchmark").select(F.sha2(T.question_key(F.col("text")), 256).alias("k")).distinct().withColumn("leak", F.lit(True))
    n = T.token_count(F.col("text"))
    # only a hash of the key moves; of rows that an earlier rule drops, n-grams aren't made
    rows = docs(spark, d).select("doc_id", "text", n.alias("n"), F.sha2(T.question_key(F.col("text")), 256).alias("k")).join(keys, "k", "left")
    rows = rows.withColumn("reason", Q.first_reason([("empty", F.col("n") == 0), ("very_short", F.col("n") < 5), ("eval_leak", F.col("leak"))]))
    rows = rows.select("doc_id", "k", F.when(F.col("reason").isNull(), Q.degenerate(F.col("text"))).alias("bad"), "reason")
    first = rows.where("reason IS NULL").groupBy("k").agg(F.min("doc_id").alias("first"))
    rows = rows.join(first, "k", "left")
    late = Q.first_reason([("duplicate", F.col("doc_id") > F.col("first")), ("degenerate_text", F.col("bad"))])
    return Q.ledger(rows.withColumn("reason", F.coalesce("reason", late)))


@query(f"""SELECT doc_id, md5(trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g'))) AS collapsed, md5({KEY}) AS dedup_key, md5(regexp_replace(coalesce(text, ''), '\\s+', '', 'g')) AS question_key,
    CAST(len({WORDS}) AS INT) AS n_tokens, CAST(length(text) AS INT) AS n_chars FROM documents""")
def text_keys(spark, d):
    """White space collapsed, folded keys, keys without white space, tokens and characters of every text."""
    t = F.col("text")
    return docs(spark, d).select("doc_id", F.md5(T.collapse_ws(t)).alias("collapsed"), F.md5(T.dedup_key(t)).alias("dedup_key"), F.md5(T.question_key(t)).alias("question_key"), T.token_count(t).alias("n_tokens"), F.length(t).alias("n_chars"))


@query("""SELECT count(*) AS n_texts, count(*) FILTER (text <> b) AS n_changed, CAST(sum(length(text)) AS BIGINT) AS chars_before, CAST(sum(length(b)) AS BIGINT) AS chars_after
    FROM (SELECT coalesce(text, '') AS text, regexp_replace(replace(coalesce(text, ''), chr(12288), ''), '[^\\x{0D80}-\\x{0DFF}a-zA-Z0-9\\s.,!?;:''"()\\[\\]{}\\-\\x{2013}\\x{2014}\\x{2026}%@#&*+=/\\x{200D}]', '', 'g') AS b FROM documents)""")
def clean_whitelist(spark, d):
    return Q.changed(docs(spark, d), T.keep_script(T.empty_if_null(F.col("text"))))


#: Rules of the same shapes as the fixed ones, on words that the driver's texts hold.
DEMO_RULES = [("numeral", r"(?m)^(The|In|Un)( )", "1.$2"), ("list_word", r"(1\. )[a-z]+ ", "$1"), ("caption", r" ?\((?:c|C)\) ?", " ")]


#: The same rules, in DuckDB's way of writing.
_DEMO_SQL = [("numeral", "(?m)^(The|In|Un)( )", "1.\\2"), ("list_word", "(1\\. )[a-z]+ ", "\\1"), ("caption", " ?\\((?:c|C)\\) ?", " ")]
_TIDY_SQL = [("tidy_spaces", "[ \\t]{2,}", " "), ("tidy_space_before_punct", " +([,.!?;:])", "\\1"), ("tidy_blank_lines", "\\n{3,}", "\n\n"), ("tidy_trailing_ws", "(?m)[ \\t]+$", "")]


def _passes_sql() -> str:
    """Four passes of the rules and one of the tidy rules, a step after the other."""
    steps = [*_DEMO_SQL * 4, *_TIDY_SQL]
    out = ["s0 AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)"]
    for k, (_, pattern, to) in enumerate(steps):
        out.append(f"s{k + 1} AS (SELECT *, len(regexp_extract_all(t{k or ''}, '{pattern}')) AS n{k}, regexp_replace(t{k or ''}, '{pattern}', '{to}', 'g') AS t{k + 1} FROM s{k})")
    names = list(dict.fromkeys(n for n, _, _ in steps))
    total = {n: " + ".join(f"n{k}" for k, x in enumerate(steps) if x[0] == n) for n in names}
    parts = [f"SELECT '{n}' AS rule, CAST(sum({c}) AS BIGINT) AS n_hits, count(*) FILTER ({c} > 0) AS n_texts FROM s{len(steps)}" for n, c in total.items()]
    return f"WITH {', '.join(out)} {' UNION ALL '.join(parts)}"


@query(_passes_sql())
def artifact_hits(spark, d):
    """Replacements until nothing changes, and those of the tidy rules behind them."""
    return Q.rule_hits(docs(spark, d), DEMO_RULES, tidy=T.TIDY_RULES)


@query("SELECT unnest(['word_numeral_5', 'word_numeral_6', 'word_numeral_8', 'word_numeral_10', 'word_numeral_11', 'word_numeral_12', 'word_numeral_20', 'word_numeral_25', 'word_numeral_50', 'injected_list_word', 'caption', 'edit_link']) AS rule, CAST(0 AS BIGINT) AS n_hits, CAST(0 AS BIGINT) AS n_texts")
def artifact_clean(spark, d):
    """The fixed rules to a fixpoint on all texts; what is left of each rule afterwards (nothing)."""
    rows = docs(spark, d).select("doc_id", T.clean_artifacts(T.empty_if_null(F.col("text"))).alias("text"))
    return Q.rule_hits(rows, T.artifact_rules(), passes=1)


@query("""SELECT count(*) AS n_texts, count(*) FILTER (text <> b) AS n_changed, CAST(sum(length(text)) AS BIGINT) AS chars_before, CAST(sum(length(b)) AS BIGINT) AS chars_after
    FROM (SELECT text, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '[ \\t]{2,}', ' ', 'g'), ' +([,.!?;:])', '\\1', 'g'), '\\n{3,}', chr(10) || chr(10), 'g'), '(?m)[ \\t]+$', '', 'g'), ' ' || chr(9) || chr(10) || chr(13)) AS b
          FROM (SELECT coalesce(text, '') AS text FROM documents))""")
def tidy_whitespace(spark, d):
    return Q.changed(docs(spark, d), T.strip(T.apply_rules(T.empty_if_null(F.col("text")), T.TIDY_RULES)))


@query("""SELECT page_id, length(t) AS n FROM (SELECT page_id, replace(regexp_replace(replace(trim(html, ' ' || chr(9) || chr(10) || chr(13)), ' [title]', '. '), '\\[[^\\n]*?\\]', '', 'g'), '  ', ' ') AS t FROM pages)""")
def bracket_clean(spark, d):
    return table(spark, d, "pages").select("page_id", F.length(T.bracket_clean(F.col("html"))).cast("long").alias("n"))


@query("SELECT doc_id, sha256(trim(replace(replace(text, chr(13), ''), chr(10), ' '), ' ' || chr(9))) AS line_sha FROM documents WHERE lang = 'en' AND trim(text) <> ''")
def export_corpus_lines(spark, d):
    """One line for each English document, as the text sink writes it."""
    rows = docs(spark, d).where("lang = 'en'").select("doc_id", T.export_line(F.col("text")).alias("line")).where("line <> ''")
    return rows.select("doc_id", F.sha2("line", 256).alias("line_sha"))


@query("""SELECT source, count(*) AS n_in, count(*) FILTER (length(text) > 20) AS n_long, count(*) FILTER (lang IN ('en', 'de')) AS n_listed, count(*) FILTER (lang NOT IN ('en', 'de')) AS n_unmapped FROM documents GROUP BY source""")
def label_filters(spark, d):
    """Minimum length, white list of labels, and labels that a map doesn't know."""
    return docs(spark, d).withColumn("m", F.try_element_at(F.create_map(F.lit("en"), F.lit(0), F.lit("de"), F.lit(1)), "lang")).groupBy("source").agg(F.count("*").alias("n_in"), F.count_if(F.length("text") > 20).alias("n_long"), F.count_if(F.col("lang").isin("en", "de")).alias("n_listed"), F.count_if(F.col("m").isNull()).alias("n_unmapped"))


@query("""WITH w AS (SELECT DISTINCT x FROM (SELECT unnest(string_split_regex(text, '\\s+')) AS x FROM documents) WHERE x <> '')
    SELECT CASE WHEN regexp_matches(x, '[\\x{0D80}-\\x{0DFF}]') THEN 'Sinhala' WHEN regexp_matches(x, '[A-Za-z]') THEN 'Latin' WHEN regexp_matches(x, '[0-9]') THEN 'Digit' ELSE 'Other' END AS script, count(*) AS n FROM w GROUP BY 1""")
def token_scripts(spark, d):
    words = docs(spark, d).select(F.explode(T.tokens(F.col("text"))).alias("x")).distinct()
    return words.groupBy(T.token_script(F.col("x")).alias("script")).agg(F.count("*").alias("n"))


@query("""SELECT doc_id, round(coalesce(a / nullif(l, 0), 0), 6) AS share, round(coalesce(a / nullif(l, 0), 0), 6) > 0.5 AS majority FROM (
    SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[A-Za-z]')) AS a, len(regexp_extract_all(coalesce(text, ''), '\\p{L}')) AS l FROM documents)""")
def mostly_latin(spark, d):
    return Q.script_majority(docs(spark, d))
