"""Queries on token counts, divergence, chunking and packing.  Corpus A is the English documents, B the rest."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomwright.functions import arrays as R
from loomwright.functions import text as T
from loomwright.operators import tokens as O
from loomwright.plans.common import WORDS, Book
from loomwright.session import table

query = Book()
QUERIES, ORACLES = query.queries, query.oracles

_AB = f"""w AS (SELECT lang = 'en' AS a, unnest({WORDS}) AS token FROM documents),
    c AS (SELECT token, count(*) FILTER (a) AS n_a, count(*) FILTER (NOT a) AS n_b FROM w GROUP BY token),
    t AS (SELECT sum(n_a) AS ta, sum(n_b) AS tb FROM c)"""
#: Pseudo ids of words: their lengths, enough for arrays of integers.
_IDS = f"SELECT doc_id, list_transform({WORDS}, lambda w: length(w)) AS ids FROM documents"


def docs(spark, d):
    return table(spark, d, "documents")


def counts(spark, d):
    rows = docs(spark, d)
    return O.count_tokens(rows.where("lang = 'en'")), O.count_tokens(rows.where("lang <> 'en'"))


def ids(spark, d):
    return docs(spark, d).select("doc_id", F.transform(T.tokens(F.col("text")), F.length).alias("ids"))


@query(f"WITH {_AB} SELECT token, n_a, n_b FROM c")
def token_counts(spark, d):
    return O.both(*counts(spark, d))


@query(f"WITH {_AB} SELECT token, n_a / ta AS f FROM c, t WHERE n_a > 0")
def token_frequencies(spark, d):
    return O.frequencies(counts(spark, d)[0]).select("token", "f")


@query(f"""WITH {_AB}, o AS (SELECT count(*) FILTER (n_b = 0) AS only_a, count(*) FILTER (n_a = 0) AS only_b, count(*) FILTER (n_a > 0 AND n_b > 0) AS shared, count(*) AS n_union FROM c)
    SELECT *, round(shared / n_union, 6) AS jaccard FROM o""")
def vocabulary_overlap(spark, d):
    return O.overlap(O.both(*counts(spark, d)))


@query(f"WITH {_AB} SELECT token, round(n_a / ta - n_b / tb, 9) AS diff FROM c, t ORDER BY abs(round(n_a / ta - n_b / tb, 9)) DESC, token LIMIT 40")
def freq_diff_top40(spark, d):
    return O.frequency_difference(*counts(spark, d), 40)


@query(f"WITH {_AB} SELECT round(sum((n_a / ta) * ln((n_a / ta) / CASE WHEN n_b = 0 THEN 1e-12 ELSE n_b / tb END)), 6) AS kl FROM c, t WHERE n_a > 0")
def kl_divergence(spark, d):
    return O.kl_divergence(*counts(spark, d))


@query(f"""WITH {_AB}, l AS (SELECT length(token) AS length, CAST(sum(n_a) AS BIGINT) AS n FROM c WHERE n_a > 0 GROUP BY 1)
    SELECT length, n, round(n / sum(n) OVER (), 9) AS share, round(sum(length * n) OVER () / sum(n) OVER (), 6) AS mean_length FROM l""")
def piece_length_hist(spark, d):
    return O.piece_lengths(counts(spark, d)[0])


@query(f"""WITH {_AB}, s AS (SELECT *, CASE WHEN regexp_matches(token, '[\\x{{0D80}}-\\x{{0DFF}}]') THEN 'Sinhala' WHEN regexp_matches(token, '[A-Za-z]') THEN 'Latin' WHEN regexp_matches(token, '[0-9]') THEN 'Digit' ELSE 'Other' END AS script FROM c)
    SELECT script, count(*) FILTER (n_a > 0) AS a, count(*) FILTER (n_b > 0) AS b, count(*) FILTER (n_b = 0) AS only_a, count(*) FILTER (n_a = 0) AS only_b,
      count(*) FILTER (n_a > 0 AND n_b > 0) AS shared, round(count(*) FILTER (n_a > 0 AND n_b > 0) / count(*), 6) AS jaccard FROM s GROUP BY script""")
def vocabulary_composition(spark, d):
    return O.composition(O.both(*counts(spark, d)), T.token_script(F.col("token")))


@query(f"""WITH i AS ({_IDS}), n AS (SELECT doc_id, ids, len(ids) AS n, least(greatest(CAST(ceil((len(ids) - 128) / 96) AS INT), 0), 7) AS last FROM i)
    SELECT doc_id, CAST(k AS INT) AS chunk, CAST(len(ids[k * 96 + 1:k * 96 + 128]) AS INT) AS n, CAST(coalesce(list_sum(ids[k * 96 + 1:k * 96 + 128]), 0) AS BIGINT) AS total
    FROM (SELECT doc_id, ids, unnest(range(last + 1)) AS k FROM n)""")
def chunk_windows(spark, d):
    rows = ids(spark, d).select("doc_id", F.posexplode(R.chunks(F.col("ids"), 128, 96, 8)).alias("chunk", "x"))
    return rows.select("doc_id", "chunk", F.size("x").alias("n"), F.aggregate("x", F.lit(0).cast("bigint"), lambda a, v: a + v).alias("total"))


@query(f"""WITH i AS (SELECT doc_id, doc_id // 100 AS batch, list_append(ids, 0) AS ids FROM ({_IDS})),
    o AS (SELECT *, sum(len(ids)) OVER (PARTITION BY batch ORDER BY doc_id) - len(ids) AS start FROM i),
    e AS (SELECT batch, start + unnest(range(len(ids))) AS pos, unnest(ids) AS id FROM o),
    b AS (SELECT batch, pos // 256 AS block, count(*) AS n, sum(id) AS total FROM e GROUP BY 1, 2)
    SELECT batch, CAST(block AS BIGINT) AS block, CAST(total AS BIGINT) AS total FROM b WHERE n = 256""")
def pack_blocks(spark, d):
    rows = ids(spark, d).withColumn("ids", F.array_append("ids", F.lit(0)))
    out = O.pack_blocks(rows, "ids", "doc_id", F.floor(F.col("doc_id") / 100), 256)
    return out.select("batch", "block", F.aggregate("ids", F.lit(0).cast("bigint"), lambda a, v: a + v).alias("total"))


@query(f"""WITH i AS (SELECT doc_id, doc_id // 100 AS batch, ids FROM ({_IDS})),
    o AS (SELECT *, sum(len(ids)) OVER (PARTITION BY batch ORDER BY doc_id) - len(ids) AS start FROM i),
    e AS (SELECT batch, start + unnest(range(len(ids))) AS pos, unnest(ids) AS id FROM o),
    b AS (SELECT batch, pos // 255 AS block, count(*) AS n, sum(id) + 1 AS total FROM e GROUP BY 1, 2)
    SELECT batch, CAST(block AS BIGINT) AS block, CAST(total AS BIGINT) AS total, 256 AS n FROM b WHERE n = 255""")
def pack_blocks_with_start(spark, d):
    out = O.pack_blocks(ids(spark, d), "ids", "doc_id", F.floor(F.col("doc_id") / 100), 256, head=1)
    return out.select("batch", "block", F.aggregate("ids", F.lit(0).cast("bigint"), lambda a, v: a + v).alias("total"), F.size("ids").alias("n"))


@query(f"""WITH i AS (SELECT doc_id, ids FROM ({_IDS})),
    o AS (SELECT doc_id AS batch, unnest(range(len(ids))) AS pos, unnest(ids) AS id FROM i),
    b AS (SELECT batch, pos // 4096 AS block, count(*) AS n, sum(id) AS total FROM o GROUP BY 1, 2)
    SELECT batch, CAST(block AS BIGINT) AS block, n, CAST(total AS BIGINT) AS total FROM b WHERE n = 4096 OR block = 0""")
def group_texts(spark, d):
    """Blocks that keep the short tail of a batch which doesn't fill one block."""
    out = O.pack_blocks(ids(spark, d), "ids", "doc_id", F.col("doc_id"), 4096, keep_short=True)
    return out.select("batch", "block", F.size("ids").cast("long").alias("n"), F.aggregate("ids", F.lit(0).cast("bigint"), lambda a, v: a + v).alias("total"))


@query(f"""WITH n AS (SELECT doc_id, len({WORDS}) AS n FROM documents), w AS (SELECT doc_id, n, unnest(range(greatest(CAST(ceil(n / 64) AS INT), 1))) AS i FROM n)
    SELECT doc_id, CAST(greatest(i * 64 + 64 - 256, 0) AS INT) AS begin_at, CAST(least(i * 64 + 64, n) AS INT) AS end_at FROM w""")
def perplexity_windows(spark, d):
    rows = docs(spark, d).select("doc_id", F.explode(R.perplexity_windows(T.token_count(F.col("text")), 256, 64)).alias("x"))
    return rows.select("doc_id", F.col("x.begin").alias("begin_at"), F.col("x.end").alias("end_at"))


@query(f"""WITH i AS ({_IDS}) SELECT doc_id, len(ids[:64]) + greatest(64 - len(ids), 0) AS n, CAST(coalesce(list_sum(ids[:64]), 0) AS BIGINT) AS total, least(len(ids), 64) AS n_attended,
    greatest(least(len(ids), 64) - 16, 0) AS n_supervised FROM i""")
def truncate_pad_mask(spark, d):
    """Truncated to 64, padded, with attention and a mask over the first 16."""
    rows = ids(spark, d).select("doc_id", R.truncate(F.col("ids"), 64).alias("t"))
    rows = rows.select("doc_id", R.pad(F.col("t"), 64).alias("p"), R.attention_mask(F.col("t"), 64).alias("m"), R.mask_prefix(F.col("t"), F.lit(16)).alias("l"))
    total = lambda c: F.aggregate(c, F.lit(0).cast("bigint"), lambda a, v: a + v)
    return rows.select("doc_id", F.size("p").cast("long").alias("n"), total("p").alias("total"), total("m").alias("n_attended"), R.supervised(F.col("l")).cast("long").alias("n_supervised"))


@query(f"""WITH n AS (SELECT len({WORDS}) AS n FROM documents)
    SELECT count(*) AS n_rows, round(100 * avg(CAST(n > 512 AS INT)), 6) AS truncated_pct, CAST(sum(n) AS BIGINT) AS n_tokens, CAST(sum(least(n, 512)) AS BIGINT) AS n_kept, round(avg(n), 6) AS mean_tokens, CAST(sum(n) // 512 AS BIGINT) AS n_sequences FROM n""")
def corpus_token_stats(spark, d):
    return O.corpus_statistics(docs(spark, d), T.token_count(F.col("text")), 512)


@query(f"""WITH l AS (SELECT list_sort(list(len({WORDS}))) AS x, count(*) AS n FROM documents), p AS (SELECT unnest([1, 10, 50, 90, 99, 99.9]) AS p)
    SELECT CAST(p AS DOUBLE) AS p, x[least(CAST(floor(n * p / 100) AS BIGINT), n - 1) + 1] AS length FROM l, p""")
def length_percentiles(spark, d):
    return O.length_distribution(docs(spark, d), T.token_count(F.col("text")), [1, 10, 50, 90, 99, 99.9])


@query(f"""WITH n AS (SELECT len({WORDS}) AS n, unnest([128, 512, 2048]) AS most FROM documents)
    SELECT most, round(100 * avg(CAST(n <= most AS INT)), 6) AS fits_pct, round(100 * sum(least(n, most)) / sum(n), 6) AS kept_pct, round(100 * (1 - sum(least(n, most)) / (count(*) * most)), 6) AS waste_pct FROM n GROUP BY most""")
def length_coverage(spark, d):
    return O.coverage(docs(spark, d), T.token_count(F.col("text")), [128, 512, 2048])


@query("""WITH RECURSIVE o AS (SELECT doc_id, source, n_chars AS n, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS i FROM documents),
    b AS (SELECT source, i, doc_id, n, 0 AS batch, 1 AS k, n AS top FROM o WHERE i = 1
      UNION ALL SELECT o.source, o.i, o.doc_id, o.n, CASE WHEN (b.k + 1) * b.top * b.top > 40000000 OR b.k >= 16 THEN b.batch + 1 ELSE b.batch END,
        CASE WHEN (b.k + 1) * b.top * b.top > 40000000 OR b.k >= 16 THEN 1 ELSE b.k + 1 END, CASE WHEN (b.k + 1) * b.top * b.top > 40000000 OR b.k >= 16 THEN o.n ELSE b.top END
      FROM b JOIN o ON o.source = b.source AND o.i = b.i + 1)
    SELECT doc_id, source, n, CAST(batch AS BIGINT) AS batch FROM b""")
def batch_budget(spark, d):
    """Batches of documents under a quadratic budget, within each source."""
    rows = docs(spark, d).select("doc_id", "source", F.col("n_chars").alias("n"))
    return O.budget_batches(rows, ["doc_id"], "n", 40_000_000, 16, "source")


@query(f"SELECT doc_id, len({WORDS}) AS n_tokens, CAST(coalesce(list_sum(list_transform({WORDS}, lambda w: length(w))), 0) AS BIGINT) AS n_letters FROM documents")
def mapped_batches(spark, d):
    """A tokenizer that is no column expression: here Python's own split, batch by batch."""

    def count(pdf):
        words = pdf["text"].fillna("").map(str.split)
        return pdf.assign(n_tokens=words.map(len), n_letters=words.map(lambda w: sum(map(len, w))))[["doc_id", "n_tokens", "n_letters"]]

    return O.map_batches(docs(spark, d).select("doc_id", "text"), count, "doc_id long, n_tokens long, n_letters long")


@query("SELECT doc_id, n_chars, CAST(row_number() OVER (ORDER BY n_chars DESC, doc_id) - 1 AS BIGINT) AS place FROM documents")
def longest_first(spark, d):
    return O.longest_first(docs(spark, d).select("doc_id", "n_chars"), "n_chars", "doc_id")


@query(f"""SELECT CASE WHEN n = 0 THEN '0' WHEN n < 64 THEN '1-63' WHEN n < 256 THEN '64-255' WHEN n < 1024 THEN '256-1023' ELSE '1024+' END AS bin, count(*) AS n FROM (SELECT len({WORDS}) AS n FROM documents) GROUP BY 1""")
def length_histogram(spark, d):
    n = T.token_count(F.col("text"))
    rows = docs(spark, d).select(n.alias("n"))
    return rows.groupBy(F.when(F.col("n") == 0, "0").when(F.col("n") < 64, "1-63").when(F.col("n") < 256, "64-255").when(F.col("n") < 1024, "256-1023").otherwise("1024+").alias("bin")).agg(F.count("*").alias("n"))


@query(f"""WITH i AS ({_IDS}), p AS (SELECT doc_id, ids, list_transform(range(len(ids)), lambda k: k) AS k FROM i)
    SELECT count(*) AS n_docs, CAST(sum(len(list_filter(range(1, greatest(len(ids), 1)), lambda k: ids[k + 1] = ids[k]))) AS BIGINT) AS n_correct, CAST(sum(greatest(len(ids) - 1, 0)) AS BIGINT) AS n_scored FROM p""")
def token_accuracy_shifted(spark, d):
    """Accuracy of predicting each token as the one before, label and prediction shifted by one."""
    rows = ids(spark, d).select(R.let(F.col("ids"), lambda x: F.zip_with(F.slice(x, 1, F.greatest(F.size(x) - 1, F.lit(0))), F.slice(x, 2, F.greatest(F.size(x) - 1, F.lit(0))), lambda p, y: (p == y).cast("int"))).alias("hit"))
    return rows.agg(F.count("*").alias("n_docs"), F.sum(F.aggregate("hit", F.lit(0), lambda a, v: a + v)).cast("long").alias("n_correct"), F.sum(F.size("hit")).cast("long").alias("n_scored"))


@query(f"""WITH v AS (SELECT DISTINCT token FROM (SELECT unnest({WORDS}) AS token FROM documents)),
    c AS (SELECT CASE WHEN regexp_matches(token, '[^\\x00-\\x7F]') THEN 'non_english_other' WHEN regexp_matches(token, '^[0-9]+$') THEN 'number' WHEN regexp_matches(token, '^[^A-Za-z0-9]+$') THEN 'punctuation'
        WHEN regexp_matches(token, '^[A-Za-z'']+$') THEN 'subword_fragment' WHEN regexp_matches(token, '[0-9]') THEN 'number' ELSE 'other' END AS category FROM v)
    SELECT category, count(*) AS n FROM c GROUP BY 1""")
def token_categories(spark, d):
    words = docs(spark, d).select(F.explode(T.tokens(F.col("text"))).alias("x")).distinct()
    return words.groupBy(T.token_category(F.col("x")).alias("category")).agg(F.count("*").alias("n"))


@query(f"""WITH v AS (SELECT unnest({WORDS}) AS token FROM documents),
    c AS (SELECT CASE WHEN regexp_matches(token, '^[0-9]+$') THEN 'number' WHEN regexp_matches(token, '^[^\\p{{L}}\\p{{N}}]+$') THEN 'punctuation' WHEN lower(token) IN ('the','a','an','of','to','in','and','is','was','that','it','for','on','with') THEN 'stopword' ELSE 'english' END AS kind FROM v)
    SELECT kind, count(*) AS n FROM c GROUP BY 1""")
def token_types(spark, d):
    words = docs(spark, d).select(F.explode(T.tokens(F.col("text"))).alias("x"))
    return words.groupBy(T.token_type(F.col("x")).alias("kind")).agg(F.count("*").alias("n"))
