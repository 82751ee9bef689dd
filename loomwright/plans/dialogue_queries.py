"""Queries on the driver's conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomwright.functions import text as T
from loomwright.operators import dialogue as D
from loomwright.operators import splits as S
from loomwright.plans.common import Book
from loomwright.session import table

query = Book()
QUERIES, ORACLES = query.queries, query.oracles

#: DuckDB: turns up to a conversation's last assistant turn.
TRIM = """a AS (SELECT conv_id, turn, role, text, max(turn) FILTER (role = 'assistant') OVER (PARTITION BY conv_id) AS last FROM conversations),
    t AS (SELECT conv_id, turn, role, text FROM a WHERE turn <= last)"""


def dialogues(spark, d):
    return D.assemble(table(spark, d, "conversations"))


@query("SELECT conv_id, count(*) AS n_turns, string_agg(role, ',' ORDER BY turn) AS roles, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM conversations GROUP BY conv_id")
def dialogue_assemble(spark, d):
    m = F.col("messages")
    return dialogues(spark, d).select("conv_id", F.size(m).cast("long").alias("n_turns"), F.array_join(F.transform(m, lambda x: x["role"]), ",").alias("roles"), F.aggregate(m, F.lit(0).cast("bigint"), lambda a, x: a + F.length(x["content"])).alias("n_chars"))


@query(f"WITH {TRIM}, n AS (SELECT conv_id, count(*) AS n FROM t GROUP BY 1) SELECT c.conv_id, coalesce(n, 0) AS n_turns FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN n USING (conv_id)")
def dialogue_trim(spark, d):
    return dialogues(spark, d).select("conv_id", F.size(D.trim(F.col("messages"))).cast("long").alias("n_turns"))


@query(f"WITH {TRIM}, n AS (SELECT c.conv_id, count(t.turn) AS n FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN t USING (conv_id) GROUP BY 1) SELECT CASE WHEN n < 2 THEN 'no_assistant_turn' ELSE 'kept' END AS reason, count(*) AS n FROM n GROUP BY 1")
def dialogue_prepare(spark, d):
    return D.drop_counts(dialogues(spark, d).select(D.prepare(F.col("messages"), T.strip).alias("r")))


@query("""WITH l AS (SELECT conv_id, arg_max(role, turn) AS last, count(*) AS n FROM conversations GROUP BY 1) SELECT CASE WHEN last <> 'assistant' THEN 'not_assistant_last' ELSE 'kept' END AS reason, count(*) AS n FROM l GROUP BY 1""")
def dialogue_repair(spark, d):
    return D.drop_counts(dialogues(spark, d).select(D.repair(F.col("messages")).alias("r")))


@query("""WITH c AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i, role, text FROM conversations),
    p AS (SELECT conv_id, i, role, CASE WHEN i = 1 AND role = 'system' THEN '### System:' WHEN role = 'assistant' THEN '### Assistant:' ELSE '### User:' END || chr(10) AS prefix, text || CASE WHEN role = 'assistant' THEN '<|end_of_text|>' ELSE '' END AS body FROM c)
    SELECT conv_id, sha256(string_agg(prefix || body, chr(10) || chr(10) ORDER BY i)) AS text_sha, CAST(sum(CASE WHEN role = 'assistant' THEN length(body) ELSE 0 END) AS BIGINT) AS sup_chars FROM p GROUP BY conv_id""")
def chat_render(spark, d):
    rows = dialogues(spark, d).select("conv_id", D.render(F.col("messages")).alias("r"))
    return rows.select("conv_id", F.sha2("r.text", 256).alias("text_sha"), F.aggregate("r.spans", F.lit(0).cast("bigint"), lambda a, s: a + s["e"] - s["s"]).alias("sup_chars"))


@query("""WITH c AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i, role, text FROM conversations),
    p AS (SELECT conv_id, i, role, CASE WHEN i = 1 AND role = 'system' THEN '### System:' WHEN role = 'assistant' THEN '### Assistant:' ELSE '### User:' END || chr(10) AS prefix, text || CASE WHEN role = 'assistant' THEN '<|end_of_text|>' ELSE '' END AS body FROM c),
    o AS (SELECT conv_id, i, role, body, sum(length(prefix) + length(body) + 2) OVER (PARTITION BY conv_id ORDER BY i) - length(body) - 2 AS s FROM p)
    SELECT conv_id, CAST(s AS INT) AS span_start, CAST(s + length(body) AS INT) AS span_end FROM o WHERE role = 'assistant'""")
def supervised_spans(spark, d):
    rows = dialogues(spark, d).select("conv_id", F.explode(D.render(F.col("messages"))["spans"]).alias("x"))
    return rows.select("conv_id", F.col("x.s").alias("span_start"), F.col("x.e").alias("span_end"))


_MIX = """a AS (SELECT DISTINCT conv_id FROM conversations WHERE role = 'assistant'), b AS (SELECT DISTINCT conv_id FROM conversations WHERE turn = 2), s AS (SELECT conv_id FROM a INTERSECT SELECT conv_id FROM b)"""


def id_sets(spark, d):
    rows = table(spark, d, "conversations")
    return rows.where("role = 'assistant'").select("conv_id"), rows.where("turn = 2").select("conv_id")


@query(f"WITH {_MIX} SELECT conv_id, CASE WHEN (row_number() OVER (ORDER BY conv_id) - 1) % 4 = 0 THEN 'en' ELSE 'si' END AS language FROM s")
def mix_assign_stride(spark, d):
    return D.assign_stride(*id_sets(spark, d), "conv_id", 4)


@query(f"WITH {_MIX} SELECT (SELECT count(*) FROM a) AS n_a, (SELECT count(*) FROM b) AS n_b, (SELECT count(*) FROM s) AS n_shared, (SELECT count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b)) AS only_a, (SELECT count(*) FROM (SELECT * FROM b EXCEPT SELECT * FROM a)) AS only_b")
def mix_id_stats(spark, d):
    return D.id_statistics(*id_sets(spark, d), "conv_id")


@query(f"WITH {_MIX}, l AS (SELECT conv_id, CASE WHEN (row_number() OVER (ORDER BY conv_id) - 1) % 4 = 0 THEN 'en' ELSE 'si' END AS language FROM s) SELECT language, count(DISTINCT conv_id) AS n_dialogues, count(*) AS n_turns FROM l JOIN conversations USING (conv_id) GROUP BY language")
def mix_rows(spark, d):
    """Each dialogue in the one language that it was assigned."""
    return table(spark, d, "conversations").join(mix_assign_stride(spark, d), "conv_id").groupBy("language").agg(F.countDistinct("conv_id").alias("n_dialogues"), F.count("*").alias("n_turns"))


@query(f"WITH {_MIX} SELECT 0 AS n_shared")
def mix_disjoint(spark, d):
    rows = mix_assign_stride(spark, d)
    return S.disjoint(rows.where("language = 'si'").select("conv_id"), rows.where("language = 'en'").select("conv_id")).select(F.col("n_shared").cast("int").alias("n_shared"))


@query("""WITH n AS (SELECT conv_id, count(*) AS n, arg_max(role, turn) AS last FROM conversations GROUP BY 1) SELECT count(*) AS n_dialogues, round(avg(n), 6) AS mean_turns, CAST(max(n) AS INT) AS max_turns, count(*) FILTER (last <> 'assistant') AS n_not_assistant_last FROM n""")
def turn_stats(spark, d):
    return D.turn_statistics(dialogues(spark, d))


@query("SELECT conv_id, turn, md5('3|' || conv_id || '|' || turn) AS place FROM conversations WHERE role <> 'system' ORDER BY place LIMIT 200")
def eval_sample(spark, d):
    """A sample without replacement, in hash order."""
    rows = table(spark, d, "conversations").where("role <> 'system'")
    return S.sample(rows, 200, "3", "conv_id", "turn").select("conv_id", "turn", S.hash_order("3", "conv_id", "turn").alias("place"))


@query("""SELECT role, count(*) AS n FROM (SELECT conv_id, role FROM conversations WHERE turn = 0 UNION ALL SELECT conv_id, role FROM conversations WHERE turn = 1) GROUP BY role""")
def union_tables(spark, d):
    rows = table(spark, d, "conversations").select("conv_id", "role", "turn")
    return rows.where("turn = 0").unionByName(rows.where("turn = 1")).groupBy("role").agg(F.count("*").alias("n"))


@query("""SELECT conv_id FROM conversations WHERE turn = 0 AND role = 'user' UNION SELECT conv_id FROM conversations WHERE turn = 3""")
def union_ids(spark, d):
    rows = table(spark, d, "conversations")
    return rows.where("turn = 0 and role = 'user'").select("conv_id").union(rows.where("turn = 3").select("conv_id")).distinct()


@query("""SELECT conv_id FROM conversations WHERE turn = 0 INTERSECT SELECT conv_id FROM conversations WHERE turn = 3""")
def intersect_ids(spark, d):
    rows = table(spark, d, "conversations")
    return rows.where("turn = 0").select("conv_id").intersect(rows.where("turn = 3").select("conv_id"))


@query("""SELECT conv_id FROM conversations WHERE turn = 0 EXCEPT SELECT conv_id FROM conversations WHERE turn = 3""")
def except_ids(spark, d):
    rows = table(spark, d, "conversations")
    return rows.where("turn = 0").select("conv_id").subtract(rows.where("turn = 3").select("conv_id"))
