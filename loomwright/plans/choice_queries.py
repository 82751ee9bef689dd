"""Queries on multiple-choice items.  Items are parts: the name is the question, four derived options."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomwright.functions import arrays as R
from loomwright.functions import text as T
from loomwright.operators import choices as C
from loomwright.operators import quality as Q
from loomwright.plans.common import Book
from loomwright.session import table

query = Book()
QUERIES, ORACLES = query.queries, query.oracles

ITEMS = """i AS (SELECT p_partkey AS item_idx, p_name AS question, p_brand AS subject, p_type AS kind, CASE WHEN p_partkey % 13 = 0 THEN 7 ELSE CAST(p_partkey % 4 AS INT) END AS answer,
    [p_brand, p_type, CASE WHEN p_partkey % 9 = 0 THEN p_brand ELSE 'BOX ' || (p_partkey % 8) END, CAST(p_size AS VARCHAR)] AS choices FROM part)"""
OPTIONS = "array_to_string(list_transform(choices, lambda c, k: k || '. ' || trim(regexp_replace(c, '\\s+', ' ', 'g'))), chr(10))"
TEMPLATE = "Subject [SUBJECT], answer with one of [NUMS].\nQuestion: [QUESTION]\n[OPTIONS]\nAnswer:"


def box(key):
    return F.concat(F.lit("BOX "), (key % 8).cast("string"))


def items(spark, d):
    key = F.col("p_partkey")
    choices = F.array("p_brand", "p_type", F.when(key % 9 == 0, F.col("p_brand")).otherwise(box(key)), F.col("p_size").cast("string"))
    return table(spark, d, "part").select(key.alias("item_idx"), F.col("p_name").alias("question"), F.col("p_brand").alias("subject"), F.col("p_type").alias("kind"), F.when(key % 13 == 0, 7).otherwise(key % 4).cast("int").alias("answer"), choices.alias("choices"))


@query(f"WITH {ITEMS} SELECT item_idx, answer BETWEEN 0 AND 3 AS valid_0, answer BETWEEN 1 AND 4 AS valid_1, len(list_distinct(choices)) < 4 AS collapsed, choices[answer + 1] AS answer_text FROM i")
def mcq_validity(spark, d):
    c, a = F.col("choices"), F.col("answer")
    return items(spark, d).select("item_idx", C.valid_index(a, c, 0, exactly=4).alias("valid_0"), C.valid_index(a, c, 1).alias("valid_1"), C.collapsed(c).alias("collapsed"), C.option_text(c, a).alias("answer_text"))


@query(f"""WITH {ITEMS}, r AS (SELECT *, regexp_replace(question, '\\s+', '', 'g') AS k, CASE WHEN answer > 3 THEN 'malformed' WHEN kind LIKE '%BRASS' THEN 'excluded' END AS r FROM i),
    f AS (SELECT *, row_number() OVER (PARTITION BY r, k ORDER BY item_idx) AS n FROM r)
    SELECT coalesce(r, CASE WHEN n > 1 THEN 'duplicate' WHEN len(list_distinct(choices)) < 4 THEN 'collapsed_choices' ELSE 'kept' END) AS reason, count(*) AS n FROM f GROUP BY 1""")
def mcq_ledger(spark, d):
    """First failing rule; duplicates count over what the rules before left, before the later rules."""
    c = F.col("choices")
    rows = items(spark, d).withColumn("k", T.question_key(F.col("question")))
    rows = rows.withColumn("reason", Q.first_reason([("malformed", C.malformed(F.col("question"), c, F.col("answer"))), ("empty_field", C.has_empty_field(F.col("question"), c)), ("excluded", F.col("kind").like("%BRASS"))]))
    first = rows.where("reason IS NULL").groupBy("k").agg(F.min("item_idx").alias("first"))
    late = Q.first_reason([("duplicate", F.col("item_idx") > F.col("first")), ("collapsed_choices", C.collapsed(c)), ("degenerate_text", Q.degenerate(T.collapse_ws(F.col("question"))))])
    return Q.ledger(rows.join(first, "k", "left").withColumn("reason", F.coalesce("reason", late)))


@query(f"""WITH {ITEMS} SELECT item_idx, 'Subject ' || subject || ', answer with one of 1, 2, 3, 4.' || chr(10) || 'Question: ' || trim(question) || chr(10) || {OPTIONS} || chr(10) || 'Answer: ' AS prompt FROM i""")
def mcq_render(spark, d):
    return items(spark, d).select("item_idx", C.render(TEMPLATE, F.col("subject"), F.col("question"), F.col("choices")).alias("prompt"))


@query(f"""WITH {ITEMS} SELECT item_idx, 'A. ' || choices[1] || chr(10) || 'B. ' || choices[2] || chr(10) || 'C. ' || choices[3] || chr(10) || 'D. ' || choices[4] AS options FROM i""")
def lettered_options(spark, d):
    return items(spark, d).select("item_idx", C.option_list(F.col("choices"), letters=True).alias("options"))


_BLOCK = f"""'Subject ' || subject || ', answer with one of 1, 2, 3, 4.' || chr(10) || 'Question: ' || trim(question) || chr(10) || {OPTIONS} || chr(10) || 'Answer: '"""
_SHOT = f"""{ITEMS}, b AS (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY item_idx) AS r, {_BLOCK} AS block FROM i),
    p AS (SELECT subject, string_agg(block || answer, chr(10) || chr(10) ORDER BY r) AS prefix FROM b WHERE r <= 2 GROUP BY subject)"""


def prompts(spark, d):
    c = [F.col(x) for x in ("subject", "question", "choices")]
    rows = items(spark, d).withColumn("block", C.render(TEMPLATE, *c)).withColumn("shot", C.render(TEMPLATE, *c, answer=F.col("answer")))
    prefixes = C.few_shot_prefix(rows.select("subject", "item_idx", "shot"), ["subject"], "item_idx", "shot", 2)
    return C.with_prefix(rows, prefixes, ["subject"], "block")


@query(f"WITH {_SHOT} SELECT item_idx, sha256(prefix || chr(10) || chr(10) || block) AS prompt_sha FROM b JOIN p USING (subject)")
def few_shot_prompts(spark, d):
    return prompts(spark, d).select("item_idx", F.sha2("prompt", 256).alias("prompt_sha"))


@query(f"""WITH {ITEMS}, b AS (SELECT item_idx, 'Subject ' || subject || ', answer with one of 1, 2, 3, 4.' AS instr, 'Question: ' || trim(question) || chr(10) || {OPTIONS} AS body FROM i)
    SELECT item_idx, '### User:' || chr(10) || instr || chr(10) || chr(10) || body || chr(10) || chr(10) || '### Assistant:' || chr(10) || 'Answer: ' AS chat FROM b""")
def wrap_chat(spark, d):
    rows = mcq_render(spark, d)
    return rows.select("item_idx", C.wrap_blocks(F.col("prompt"), C.CHAT, "Answer:", end=C.CHAT_END).alias("chat"))


@query(f"""WITH {_SHOT}, x AS (SELECT item_idx, prefix || chr(10) || chr(10) || block AS prompt FROM b JOIN p USING (subject)) SELECT item_idx, len(string_split(prompt, chr(10) || chr(10))) AS n_blocks, len(string_split(prompt, chr(10) || chr(10))) AS n_responses FROM x""")
def wrap_alpaca(spark, d):
    rows = prompts(spark, d).select("item_idx", "prompt", C.wrap_blocks(F.col("prompt"), C.ALPACA, "Answer:").alias("a"))
    return rows.select("item_idx", F.size(F.split("prompt", "\n\n")).cast("long").alias("n_blocks"), F.regexp_count("a", F.lit("### Response:\nAnswer:")).cast("long").alias("n_responses"))


@query(f"WITH {ITEMS}, r AS (SELECT *, unnest(range(4)) AS rot FROM i) SELECT item_idx, CAST(rot AS INT) AS rot, array_to_string(list_concat(choices[rot + 1:], choices[:rot]), '|') AS rotated FROM r")
def rotate_options(spark, d):
    return C.rotations(items(spark, d), "choices").select("item_idx", "rot", F.array_join("rotated", "|").alias("rotated"))


@query(f"""WITH {ITEMS}, o AS (SELECT item_idx, answer, k - 1 AS k, choices[k] AS c, md5(item_idx || '|' || (k - 1) || '|' || choices[k]) AS h FROM i, (SELECT unnest([1, 2, 3, 4]) AS k)),
    s AS (SELECT item_idx, answer, k, c, row_number() OVER (PARTITION BY item_idx ORDER BY h, k) - 1 AS p FROM o)
    SELECT item_idx, string_agg(c, '|' ORDER BY p) AS choices, CAST(coalesce(max(p) FILTER (k = answer), -1) AS INT) AS answer FROM s GROUP BY item_idx""")
def shuffle_options(spark, d):
    rows = items(spark, d).select("item_idx", C.shuffle_options(F.col("choices"), F.col("answer"), F.col("item_idx").cast("string")).alias("x"))
    return rows.select("item_idx", F.array_join("x.choices", "|").alias("choices"), "x.answer")


@query(f"WITH {ITEMS}, r AS (SELECT item_idx, answer, row_number() OVER (PARTITION BY answer ORDER BY md5('0|' || item_idx), item_idx) AS r FROM i) SELECT item_idx, answer FROM r WHERE r <= 3")
def balanced_examples(spark, d):
    return C.balanced_examples(items(spark, d), "answer", "item_idx", 3, "0").select("item_idx", "answer")


@query(f"WITH {ITEMS}, r AS (SELECT item_idx, row_number() OVER (PARTITION BY answer ORDER BY md5('0|' || item_idx), item_idx) AS r FROM i) SELECT item_idx FROM r WHERE r > 3")
def test_without_examples(spark, d):
    return items(spark, d).select("item_idx").join(balanced_examples(spark, d).select("item_idx"), "item_idx", "left_anti")


@query(f"WITH {ITEMS} SELECT answer, count(*) AS n FROM i GROUP BY answer")
def answer_distribution(spark, d):
    return items(spark, d).groupBy("answer").agg(F.count("*").alias("n"))


@query("""SELECT n_name AS name, lower(regexp_replace(n_name, '[^A-Za-z0-9]', '', 'g')) AS key, replace(n_name, '_', ' ') AS display FROM nation""")
def file_subjects(spark, d):
    """Subjects from file names, here built around the nations' names."""
    rows = table(spark, d, "nation").select(F.col("n_name").alias("name"), C.subject_of_file(F.concat(F.lit("data/TEST/easy/"), "n_name", F.lit("_social_science_easy_f_12a.json"))).alias("x"))
    return rows.select("name", "x.key", "x.display")


@query("""WITH v AS (SELECT n_nationkey AS k, lower(n_name) AS key, n_name AS a, lower(n_name) AS b FROM nation) SELECT key, a AS label FROM v""")
def canonical_subjects(spark, d):
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.lower("n_name").alias("key"), F.explode(F.array(F.lower("n_name"), F.col("n_name"))).alias("name"))
    return C.canonical_names(n, "key", "name", "k")


@query("""WITH w AS (SELECT n_regionkey AS level, lower(n_name) AS key FROM nation), h AS (SELECT n_regionkey AS level, CASE WHEN n_nationkey % 2 = 0 THEN lower(n_name) ELSE substr(lower(n_name), 1, 4) END AS s FROM nation WHERE n_nationkey % 3 <> 1),
    p AS (SELECT w.level, key, s, s = key AS same, length(s) AS n FROM w JOIN h ON w.level = h.level AND (contains(key, s) OR contains(s, key)))
    SELECT w.level, w.key, (SELECT arg_max(s, (same, n, s)) FROM p WHERE p.level = w.level AND p.key = w.key) AS shot_key FROM w""")
def fuzzy_subjects(spark, d):
    n = table(spark, d, "nation")
    want = n.select(F.col("n_regionkey").alias("level"), F.lower("n_name").alias("key"))
    have = n.where("n_nationkey % 3 <> 1").select(F.col("n_regionkey").alias("level"), F.when(F.col("n_nationkey") % 2 == 0, F.lower("n_name")).otherwise(F.substring(F.lower("n_name"), 1, 4)).alias("key"))
    return C.match_subjects(want, have, "level", "key")


@query("""SELECT domain, count(*) AS n FROM (SELECT ['stem', 'other', 'social_sciences', 'humanities', 'stem', 'other', 'social_sciences', 'humanities', 'other'][o_orderkey % 9 + 1] AS domain FROM orders) GROUP BY 1""")
def subject_domains(spark, d):
    """Orders stand for items; each has one of eight known subjects or one that no map knows."""
    names = ["astronomy", "anatomy", "econometrics", "formal_logic", "abstract_algebra", "business_ethics", "high_school_geography", "high_school_us_history", "no_such_subject"]
    subject = F.element_at(F.array(*[F.lit(x) for x in names]), (F.col("o_orderkey") % 9 + 1).cast("int"))
    return table(spark, d, "orders").groupBy(C.domain(subject).alias("domain")).agg(F.count("*").alias("n"))


@query("""SELECT p_partkey AS item_idx, CASE WHEN regexp_full_match(l, '[0-9]+') AND CAST(l AS INT) < 4 THEN true ELSE false END AS valid FROM (SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN '' WHEN p_partkey % 5 = 1 THEN 'x' ELSE CAST(p_partkey % 7 AS VARCHAR) END AS l FROM part) WHERE true""")
def label_validity(spark, d):
    key = F.col("p_partkey")
    label = F.when(key % 5 == 0, " ").when(key % 5 == 1, "x").otherwise((key % 7).cast("string"))
    four = F.array(*[F.lit(str(i)) for i in range(4)])
    return table(spark, d, "part").select(key.alias("item_idx"), C.valid_label(label, four).alias("valid"))


@query("""SELECT p_partkey AS item_idx, p_type || ': ' || p_name || ' ' || 'B' || 'ox ' || (p_partkey % 8) AS query FROM part""")
def context_queries(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("item_idx"), T.context_query(F.col("p_type"), F.col("p_name"), box(F.col("p_partkey"))).alias("query"))


@query("""WITH s AS (SELECT p_partkey AS item_idx, p_brand AS subject, [CAST(p_size % 5 AS DOUBLE), CAST(p_partkey % 6 AS DOUBLE), CAST(p_partkey % 3 AS DOUBLE)] AS x FROM part),
    p AS (SELECT subject, avg(x[1]) AS a, avg(x[2]) AS b, avg(x[3]) AS c FROM s GROUP BY subject)
    SELECT item_idx, CAST(list_position([round(x[1] - a, 9), round(x[2] - b, 9), round(x[3] - c, 9)], greatest(round(x[1] - a, 9), round(x[2] - b, 9), round(x[3] - c, 9))) - 1 AS INT) AS pred FROM s JOIN p USING (subject)""")
def calibrated_predictions(spark, d):
    p = table(spark, d, "part")
    scores = p.select(F.col("p_partkey").alias("item_idx"), F.col("p_brand").alias("subject"), F.array(*[c.cast("double") for c in (F.col("p_size") % 5, F.col("p_partkey") % 6, F.col("p_partkey") % 3)]).alias("scores"))
    priors = scores.groupBy("subject").agg(F.array(*[F.avg(F.get("scores", F.lit(k))) for k in range(3)]).alias("prior"))
    return C.calibrated(scores, priors, ["subject"]).select("item_idx", "pred")


@query("""SELECT p_partkey AS item_idx, CASE WHEN contains(lower(p_name), 'bactrian') THEN 'alpaca' WHEN contains(lower(p_name), 'chat') OR contains(lower(p_name), 'uc') THEN 'chat' ELSE 'raw' END AS format, CASE WHEN regexp_matches(lower(p_type), '[a-z]') THEN replace(lower(trim(p_type)), ' ', '_') END AS category FROM part""")
def model_routing(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("item_idx"), C.route(F.col("p_name")).alias("format"), T.norm_category(F.col("p_type")).alias("category"))


@query("""SELECT p_partkey AS item_idx, CAST(TRY_CAST(trim(l) AS DOUBLE) AS BIGINT)::VARCHAR AS label FROM (SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN ' ' || p_size || '.0' WHEN p_partkey % 4 = 1 THEN 'none' ELSE CAST(p_size AS VARCHAR) END AS l FROM part)""")
def integer_labels(spark, d):
    key = F.col("p_partkey")
    label = F.when(key % 4 == 0, F.concat(F.lit(" "), F.col("p_size").cast("string"), F.lit(".0"))).when(key % 4 == 1, "none").otherwise(F.col("p_size").cast("string"))
    return table(spark, d, "part").select(key.alias("item_idx"), T.integer_label(label).alias("label"))


@query(f"WITH {ITEMS} SELECT subject, count(*) AS n, count(*) FILTER (r <= 2) AS n_first FROM (SELECT subject, row_number() OVER (PARTITION BY subject ORDER BY item_idx) AS r FROM i) GROUP BY subject")
def few_shot_counts(spark, d):
    from loomwright.operators.splits import first_per_group

    rows = items(spark, d).select("subject", "item_idx")
    return rows.groupBy("subject").agg(F.count("*").alias("n")).join(first_per_group(rows, ["subject"], ["item_idx"], 2).groupBy("subject").agg(F.count("*").alias("n_first")), "subject")
