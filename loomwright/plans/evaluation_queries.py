"""Queries on predictions.  Items are orders: gold and two models' predictions follow from their columns;
classifications are labels, with quality as gold and toxic as prediction."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomwright.operators import evaluation as E
from loomwright.plans.common import Book
from loomwright.session import table

query = Book()
QUERIES, ORACLES = query.queries, query.oracles

MCQ = """m AS (SELECT o_orderkey AS item_idx, CAST(o_orderkey % 4 AS INT) AS gold, CAST(o_custkey % 4 AS INT) AS pred_a,
    CAST(CASE WHEN o_orderkey % 5 = 0 THEN o_orderkey % 4 ELSE CAST(floor(o_totalprice) AS BIGINT) % 4 END AS INT) AS pred_b,
    o_orderpriority AS difficulty, o_orderstatus AS category, o_orderkey % 17 <> 3 AS valid FROM orders)"""


def mcq(spark, d):
    o = table(spark, d, "orders")
    key = F.col("o_orderkey")
    return o.select(
        key.alias("item_idx"), (key % 4).cast("int").alias("gold"), (F.col("o_custkey") % 4).cast("int").alias("pred_a"),
        F.when(key % 5 == 0, key % 4).otherwise(F.floor("o_totalprice").cast("bigint") % 4).cast("int").alias("pred_b"),
        F.col("o_orderpriority").alias("difficulty"), F.col("o_orderstatus").alias("category"), (key % 17 != 3).alias("valid"),
    )



def hit(c: str):
    return F.col(c) == F.col("gold")


@query(f"WITH {MCQ} SELECT difficulty, count(*) FILTER (pred_b = gold) AS n_correct, count(*) AS n, round(100 * count(*) FILTER (pred_b = gold) / count(*), 6) AS accuracy FROM m GROUP BY difficulty")
def accuracy_by_key(spark, d):
    return E.accuracy(mcq(spark, d), ["difficulty"], hit("pred_b"))


@query(f"""WITH {MCQ}, g AS (SELECT difficulty, category, grouping(difficulty) AS gd, grouping(category) AS gc, count(*) FILTER (valid AND pred_b = gold) AS n_correct, count(*) FILTER (valid) AS n, count(*) FILTER (NOT valid) AS n_skipped
        FROM m GROUP BY GROUPING SETS ((), (difficulty), (category), (difficulty, category)))
    SELECT CASE WHEN gd = 1 AND gc = 1 THEN 'overall' WHEN gc = 1 THEN 'difficulty' WHEN gd = 1 THEN 'category' ELSE 'difficulty+category' END AS dims, difficulty, category, n_correct, n, n_skipped, round(100 * n_correct / n, 6) AS accuracy FROM g""")
def accuracy_grouping_sets(spark, d):
    return E.accuracy_report(mcq(spark, d), [[], ["difficulty"], ["category"], ["difficulty", "category"]], hit("pred_b"), F.col("valid"))


@query(f"WITH {MCQ}, o AS (SELECT unnest(range(0, 5)) AS option) SELECT option, (SELECT count(*) FROM m WHERE pred_b = option) AS n FROM o")
def option_distribution(spark, d):
    return E.option_distribution(mcq(spark, d), "pred_b", 0, 5)


@query(f"""WITH {MCQ}, k AS (SELECT difficulty, o AS option, count(*) FILTER (pred_b = o) AS p, count(*) FILTER (gold = o) AS g FROM m, (SELECT unnest(range(0, 4)) AS o) GROUP BY 1, 2)
    SELECT difficulty, round(50 * sum(abs(p / n - g / n)), 6) AS tvd FROM (SELECT *, sum(p) OVER (PARTITION BY difficulty) AS n FROM k) GROUP BY difficulty""")
def total_variation(spark, d):
    rows = mcq(spark, d)
    return E.total_variation(E.option_distribution(rows, "pred_b", 0, 4, ["difficulty"]), E.option_distribution(rows, "gold", 0, 4, ["difficulty"]), ["difficulty"])


@query(f"""WITH {MCQ}, c AS (SELECT difficulty, count(*) FILTER (pred_a = gold AND pred_b <> gold) AS b01, count(*) FILTER (pred_b = gold AND pred_a <> gold) AS b10 FROM m GROUP BY 1)
    SELECT *, round(CASE WHEN b01 + b10 = 0 THEN 0 ELSE (abs(b01 - b10) - 1) ** 2 / (b01 + b10) END, 6) AS chi2 FROM c""")
def mcnemar(spark, d):
    return E.mcnemar(mcq(spark, d), hit("pred_a"), hit("pred_b"), ["difficulty"]).drop("p")


#: 1 - erf(x) by the series of positive terms x ** (2n + 1) * 2 ** n / (1 * 3 * ... * (2n + 1)).
_ERFC = "1 - 2 / sqrt(pi()) * exp(-x * x) * list_reduce(list_prepend({'t': x, 's': x}, list_transform(range(1, 200), lambda n: {'t': x * x * 2 / (2 * n + 1), 's': CAST(0 AS DOUBLE)})), lambda a, b: {'t': a.t * b.t, 's': a.s + a.t * b.t}).s"


@query(f"""WITH {MCQ}, g AS (SELECT difficulty, count(*) FILTER (pred_a = gold AND pred_b <> gold) AS b01, count(*) FILTER (pred_b = gold AND pred_a <> gold) AS b10 FROM m GROUP BY difficulty),
    c AS (SELECT *, round(coalesce((abs(b01 - b10) - 1) ** 2 / nullif(b01 + b10, 0), 0), 6) AS chi2 FROM g), y AS (SELECT *, sqrt(chi2 / 2) AS x FROM c)
    SELECT difficulty, b01, b10, chi2, round(CASE WHEN b01 + b10 = 0 THEN 1 ELSE {_ERFC} END, 9) + 0.0 AS p FROM y""")
def mcnemar_p(spark, d):
    return E.mcnemar(mcq(spark, d), hit("pred_a"), hit("pred_b"), ["difficulty"]).withColumn("p", F.round("p", 9))


@query(f"""WITH {MCQ} SELECT count(*) AS n, count(*) FILTER (pred_a = gold AND pred_b <> gold) AS only_a, count(*) FILTER (pred_b = gold AND pred_a <> gold) AS only_b, count(*) FILTER (pred_a = gold AND pred_b = gold) AS both,
    round(100 * (avg(CAST(pred_b = gold AS INT)) - avg(CAST(pred_a = gold AS INT))), 6) AS delta FROM m""")
def paired_gains(spark, d):
    """Two dumps, joined on the item's number."""
    rows = mcq(spark, d)
    pair = E.pair_by_item(rows.select("item_idx", "gold", "pred_a"), rows.select("item_idx", "pred_b"))
    return E.gains(pair, hit("pred_a"), hit("pred_b"))


@query(f"WITH {MCQ} SELECT round(100 * avg(CAST(pred_a = pred_b AS INT)), 6) AS same_pct, round(100 * (avg(CAST(pred_b = gold AS INT)) - avg(CAST(pred_a = gold AS INT))), 6) AS delta FROM m")
def method_agreement(spark, d):
    return E.agreement(mcq(spark, d), "pred_a", "pred_b", "gold")


_LONG = """l AS (SELECT item_idx, 'a' AS model, pred_a = gold AS hit FROM m UNION ALL SELECT item_idx, 'b', pred_b = gold FROM m UNION ALL SELECT item_idx, 'c', (pred_a + pred_b) % 4 = gold FROM m)"""


def long_hits(spark, d):
    rows = mcq(spark, d).withColumn("pred_c", (F.col("pred_a") + F.col("pred_b")) % 4)
    return rows.select("item_idx", "difficulty", F.explode(F.array(*[F.struct(F.lit(m).alias("model"), hit(f"pred_{m}").alias("hit")) for m in "abc"])).alias("x")).select("item_idx", "difficulty", "x.*")


@query(f"""WITH {MCQ}, {_LONG} SELECT a.model AS model_a, b.model AS model_b, count(*) FILTER (a.hit AND NOT b.hit) AS only_a, count(*) FILTER (b.hit AND NOT a.hit) AS only_b, count(*) FILTER (a.hit AND b.hit) AS both
    FROM l a JOIN l b ON a.item_idx = b.item_idx AND a.model < b.model GROUP BY 1, 2""")
def model_pair_matrix(spark, d):
    return E.model_pairs(long_hits(spark, d), "item_idx", "model", "hit")


@query(f"WITH {MCQ}, c AS (SELECT difficulty, pred_b, count(*) AS n FROM m GROUP BY 1, 2) SELECT difficulty, arg_max(pred_b, n * 10 - pred_b) AS modal, round(100 * max(n) / sum(n), 6) AS pct FROM c GROUP BY difficulty")
def modal_answer(spark, d):
    return E.modal_answer(mcq(spark, d), "pred_b", ["difficulty"])


@query(f"WITH {MCQ} SELECT difficulty, category, count(*) AS n, count(*) FILTER (gold < 3) AS n_subset, count(*) FILTER (gold < 3 AND pred_b = gold) AS n_subset_correct FROM m GROUP BY 1, 2")
def subset_composition(spark, d):
    return mcq(spark, d).groupBy("difficulty", "category").agg(F.count("*").alias("n"), F.count_if(F.col("gold") < 3).alias("n_subset"), F.count_if((F.col("gold") < 3) & hit("pred_b")).alias("n_subset_correct"))


_REPORT = """k AS (SELECT unnest([0, 1, 2]) AS label),
    r AS (SELECT label, count(*) FILTER (gold = label AND pred = label) AS tp, count(*) FILTER (gold <> label AND pred = label) AS fp, count(*) FILTER (gold = label AND pred <> label) AS fn FROM k, c GROUP BY label),
    s AS (SELECT *, tp + fn AS support, CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END AS pr, CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END AS re FROM r),
    f AS (SELECT *, CASE WHEN pr + re = 0 THEN 0 ELSE 2 * pr * re / (pr + re) END AS f1 FROM s)"""
_CLASSES = "c AS (SELECT CAST(quality AS INT) AS gold, CAST(CASE WHEN doc_id % 11 = 5 THEN 9 ELSE toxic END AS INT) AS pred FROM labels)"


def classes(spark, d):
    return table(spark, d, "labels").select(F.col("quality").cast("int").alias("gold"), F.when(F.col("doc_id") % 11 == 5, 9).otherwise(F.col("toxic")).cast("int").alias("pred"))


@query(f"WITH {_CLASSES}, {_REPORT} SELECT label, tp, fp, fn, support, round(pr, 6) AS precision, round(re, 6) AS recall, round(f1, 6) AS f1 FROM f")
def class_report(spark, d):
    rows = E.class_report(classes(spark, d), "gold", "pred", [0, 1, 2])
    return rows.select("label", "tp", "fp", "fn", "support", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query(f"""WITH {_CLASSES}, {_REPORT}, a AS (SELECT count(*) AS n, count(*) FILTER (gold = pred) AS ok, count(*) FILTER (pred NOT IN (0, 1, 2)) AS un FROM c),
    m AS (SELECT avg(pr) AS mp, avg(re) AS mr, avg(f1) AS mf, sum(f1 * support) / sum(support) AS wf FROM f)
    SELECT round(ok / n, 6) AS accuracy, n, un AS n_unparsed, round(ok / (n - un), 6) AS micro_precision, round(ok / n, 6) AS micro_recall, round(2 * (ok / (n - un)) * (ok / n) / (ok / (n - un) + ok / n), 6) AS micro_f1,
      round(mp, 6) AS macro_precision, round(mr, 6) AS macro_recall, round(mf, 6) AS macro_f1, round(wf, 6) AS weighted_f1 FROM a, m""")
def class_summary(spark, d):
    return E.class_summary(classes(spark, d), "gold", "pred", [0, 1, 2])


@query(f"""WITH {_CLASSES} SELECT gold, count(*) FILTER (pred = 0) AS "0", count(*) FILTER (pred = 1) AS "1", round(CASE gold WHEN 0 THEN count(*) FILTER (pred = 0) ELSE count(*) FILTER (pred = 1) END / count(*) FILTER (pred IN (0, 1)), 6) AS accuracy FROM c GROUP BY gold""")
def confusion_matrix(spark, d):
    return E.confusion(classes(spark, d), "gold", "pred", [0, 1])


@query(f"WITH {_CLASSES} SELECT 'gold' AS side, CAST(gold AS VARCHAR) AS label, count(*) AS n FROM c GROUP BY 2 UNION ALL SELECT 'pred', CASE WHEN pred = 9 THEN 'UNK' ELSE CAST(pred AS VARCHAR) END, count(*) FROM c GROUP BY 2")
def label_counters(spark, d):
    rows = classes(spark, d)
    pred = F.when(F.col("pred") == 9, "UNK").otherwise(F.col("pred").cast("string"))
    return rows.groupBy(F.lit("gold").alias("side"), F.col("gold").cast("string").alias("label")).agg(F.count("*").alias("n")).unionByName(rows.groupBy(F.lit("pred").alias("side"), pred.alias("label")).agg(F.count("*").alias("n")))


@query("SELECT doc_id, pred FROM (SELECT doc_id, CAST(CASE WHEN doc_id % 11 = 5 THEN 9 ELSE toxic END AS INT) AS pred FROM labels) WHERE pred NOT IN (0, 1) OR pred IS NULL ORDER BY doc_id LIMIT 5")
def unknown_examples(spark, d):
    rows = table(spark, d, "labels").select("doc_id", F.when(F.col("doc_id") % 11 == 5, 9).otherwise(F.col("toxic")).cast("int").alias("pred"))
    return E.unknown_examples(rows, "pred", [0, 1], "doc_id")


@query("""SELECT event_type, round(sum(value * (event_id % 7 + 1)) / sum(event_id % 7 + 1) / 100, 6) AS mean_loss, round(exp(sum(value / 100 * (event_id % 7 + 1)) / sum(event_id % 7 + 1)), 6) AS perplexity FROM events GROUP BY event_type""")
def perplexity_weighted(spark, d):
    rows = table(spark, d, "events").select("event_type", (F.col("value") / 100).alias("loss"), (F.col("event_id") % 7 + 1).alias("n_tokens"))
    return E.perplexity(rows, ["event_type"], "loss", "n_tokens")


@query("SELECT user_id, arg_max(event_id, (round(value, 2), -event_id)) AS best_step, max(round(value, 2)) AS best FROM events GROUP BY user_id")
def best_epoch(spark, d):
    rows = table(spark, d, "events").select("user_id", "event_id", F.round("value", 2).alias("v"))
    return E.best_epoch(rows, ["user_id"], "v", "event_id")


@query("""WITH s AS (SELECT user_id, event_id, value, coalesce(sum(CAST(event_id % 5 = 0 AS INT)) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS stretch FROM events)
    SELECT user_id, CAST(stretch AS BIGINT) AS stretch, round(avg(value), 6) AS mean, max(event_id) AS last_step FROM s GROUP BY 1, 2""")
def loss_between_evals(spark, d):
    return E.mean_between(table(spark, d, "events"), ["user_id"], "event_id", "value", F.col("event_id") % 5 == 0)


@query(f"""WITH {MCQ}, {_LONG}, a AS (SELECT model, round(100 * avg(CAST(hit AS INT)), 6) AS x, count(*) AS n FROM l GROUP BY model)
    SELECT model, x AS mean, round(x - (SELECT x FROM a WHERE model = 'a'), 6) AS d FROM a""")
def delta_to_base(spark, d):
    rows = long_hits(spark, d).groupBy("model").agg(F.round(100 * F.avg(F.col("hit").cast("int")), 6).alias("mean")).withColumn("c", F.lit("all"))
    return E.delta_to_base(rows, "a", "c", "model", "mean").select("model", "mean", F.col("delta").alias("d"))


_CELLS = f"""{MCQ}, {_LONG.replace("SELECT item_idx,", "SELECT item_idx, difficulty,")}, e AS (SELECT model, difficulty AS bench, round(100 * avg(CAST(hit AS INT)), 1) AS acc FROM l GROUP BY 1, 2)"""


def cells(spark, d):
    return long_hits(spark, d).groupBy("model", F.col("difficulty").alias("bench")).agg(F.round(100 * F.avg(F.col("hit").cast("int")), 1).alias("acc"))


@query(f"WITH {_CELLS}, t AS (SELECT bench, model, acc, max(acc) OVER (PARTITION BY bench) AS top FROM e) SELECT bench, min(model) AS winner FROM t WHERE acc = top GROUP BY bench HAVING count(*) = 1")
def winners_no_ties(spark, d):
    return E.winners(cells(spark, d), "bench", "model", "acc")


@query(f"WITH {_CELLS} SELECT model, round(avg(acc), 6) AS mean, round(avg(acc) FILTER (bench LIKE '%-HIGH' OR bench LIKE '%URGENT%'), 6) AS mean_si, round(avg(acc) FILTER (NOT (bench LIKE '%-HIGH' OR bench LIKE '%URGENT%')), 6) AS mean_en, count(acc) AS n FROM e GROUP BY model")
def macro_means(spark, d):
    language = F.when(F.col("bench").like("%-HIGH") | F.col("bench").like("%URGENT%"), "si").otherwise("en")
    return E.macro_means(cells(spark, d), "model", "bench", "acc", language)


@query(f"""WITH {_CELLS}, j AS (SELECT x.bench, y.model, round(y.acc - x.acc, 6) AS delta FROM e x JOIN e y ON x.bench = y.bench AND x.model = 'a' AND y.model <> 'a')
    SELECT model, round(avg(delta), 6) AS mean_delta, arg_min(bench, (-abs(delta), bench)) AS largest_key, arg_min(delta, (-abs(delta), bench)) AS largest FROM j GROUP BY model""")
def largest_change(spark, d):
    rows = cells(spark, d)
    base = rows.where("model = 'a'").select("bench", F.col("acc").alias("base"))
    return E.largest_change(rows.where("model <> 'a'").join(base, "bench").withColumn("delta", F.round(F.col("acc") - F.col("base"), 6)), ["model"], "bench", "delta")


@query(f"""WITH {_CELLS}, p AS (SELECT model, bench, acc FROM e), a AS (SELECT DISTINCT model FROM e GROUP BY model, bench) SELECT model, CAST(count(*) AS BIGINT) AS n_bench FROM p GROUP BY model HAVING count(DISTINCT bench) = (SELECT count(DISTINCT bench) FROM e)""")
def models_in_all(spark, d):
    """Models that every benchmark has: two regimes joined on model and benchmark."""
    rows = cells(spark, d)
    zero, few = rows.select("model", "bench", F.col("acc").alias("zero")), rows.select("model", "bench", F.col("acc").alias("few"))
    both = zero.join(few, ["model", "bench"]).groupBy("model").agg(F.countDistinct("bench").alias("n_bench"))
    return both.crossJoin(F.broadcast(rows.agg(F.countDistinct("bench").alias("all")))).where("n_bench = all").select("model", "n_bench")


@query(f"""WITH {MCQ}, a AS (SELECT pred_a AS option, count(*) AS n_a FROM m WHERE category = 'F' GROUP BY 1), b AS (SELECT pred_b + 1 AS option, count(*) AS n_b FROM m WHERE category = 'O' GROUP BY 1)
    SELECT coalesce(a.option, b.option) AS option, coalesce(n_a, 0) AS n_a, coalesce(n_b, 0) AS n_b FROM a FULL JOIN b ON a.option = b.option""")
def distribution_pair(spark, d):
    """Two answer distributions side by side; what one lacks is 0."""
    rows = mcq(spark, d)
    a = rows.where("category = 'F'").groupBy(F.col("pred_a").alias("option")).agg(F.count("*").alias("n_a"))
    b = rows.where("category = 'O'").groupBy((F.col("pred_b") + 1).alias("option")).agg(F.count("*").alias("n_b"))
    return a.join(b, "option", "full_outer").select("option", F.coalesce("n_a", F.lit(0)).alias("n_a"), F.coalesce("n_b", F.lit(0)).alias("n_b"))


@query("""WITH c AS (SELECT l_orderkey AS doc, l_linenumber AS choice, round(avg(l_extendedprice), 2) AS ll, round(avg(l_quantity), 2) AS n FROM lineitem GROUP BY 1, 2)
    SELECT doc, arg_max(choice, (ll, -choice)) AS pred, arg_max(choice, (ll / n, -choice)) AS pred_norm FROM c GROUP BY doc""")
def choice_argmax(spark, d):
    rows = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("choice")).agg(F.round(F.avg("l_extendedprice"), 2).alias("ll"), F.round(F.avg("l_quantity"), 2).alias("char_len"))
    return E.choice_argmax(rows)


_SCORES = "s AS (SELECT o_orderkey AS item_idx, r.rot, t.slot, CAST((o_orderkey * 7 + o_custkey * 3 * ((t.slot + r.rot) % 4) + t.slot * 5) % 23 AS DOUBLE) AS score FROM orders, (SELECT unnest(range(4)) AS rot) r, (SELECT unnest(range(4)) AS slot) t)"


@query(f"""WITH {_SCORES}, m AS (SELECT item_idx, (slot + rot) % 4 AS option, avg(score) AS m FROM s GROUP BY 1, 2) SELECT item_idx, CAST(arg_max(option, (m, -option)) AS INT) AS pred FROM m GROUP BY item_idx""")
def rotation_average(spark, d):
    o = table(spark, d, "orders")
    rows = o.select("o_orderkey", "o_custkey", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("rot")).select("*", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("slot"))
    score = (F.col("o_orderkey") * 7 + F.col("o_custkey") * 3 * ((F.col("slot") + F.col("rot")) % 4) + F.col("slot") * 5) % 23
    return E.rotation_average(rows.select(F.col("o_orderkey").alias("item_idx"), "rot", "slot", score.cast("double").alias("score")))


@query("""WITH p AS (SELECT user_id, event_id AS token, value / 10 AS logit FROM events), e AS (SELECT *, exp(logit - max(logit) OVER (PARTITION BY user_id)) AS x FROM p),
    q AS (SELECT user_id, token, logit, x / sum(x) OVER (PARTITION BY user_id) AS prob, row_number() OVER (PARTITION BY user_id ORDER BY logit DESC, token) AS rank FROM e)
    SELECT user_id, CAST(rank AS INT) AS rank, token, round(prob, 9) AS prob FROM q WHERE rank <= 5""")
def top_k_tokens(spark, d):
    rows = table(spark, d, "events").select("user_id", F.col("event_id").alias("token"), (F.col("value") / 10).alias("logit"))
    return E.top_tokens(rows, ["user_id"], 5)


@query("""WITH p AS (SELECT user_id, event_id, value AS prob, event_id = min(event_id) OVER (PARTITION BY user_id) AS is_end FROM events), e AS (SELECT user_id, prob AS p_end FROM p WHERE is_end)
    SELECT p.user_id, max(p_end) AS p_end, count(*) FILTER (prob > p_end) + 1 AS rank FROM p JOIN e ON p.user_id = e.user_id GROUP BY p.user_id""")
def end_token_rank(spark, d):
    from pyspark.sql import Window

    rows = table(spark, d, "events").select("user_id", F.col("value").alias("prob"), (F.col("event_id") == F.min("event_id").over(Window.partitionBy("user_id"))).alias("is_end"))
    return E.end_rank(rows, ["user_id"], F.col("is_end"))


@query("""WITH p AS (SELECT user_id, event_id, value AS prob, event_id = min(event_id) OVER (PARTITION BY user_id) AS is_end FROM events), e AS (SELECT user_id, prob AS p_end FROM p WHERE is_end),
    r AS (SELECT p.user_id, max(p_end) AS p, count(*) FILTER (prob > p_end) + 1 AS k FROM p JOIN e ON p.user_id = e.user_id GROUP BY p.user_id),
    s AS (SELECT list_sort(list(p)) AS ps, list_sort(list(k)) AS ks, count(*) AS n, round(avg(p), 9) AS mean_p, min(p) AS min_p, max(k) AS worst_rank, round(100 * avg(CAST(k = 1 AS INT)), 6) AS top1_pct FROM r)
    SELECT n, mean_p, min_p, worst_rank, top1_pct, ps[n // 2 + 1] AS median_p, ks[n // 2 + 1] AS median_rank FROM s""")
def end_token_report(spark, d):
    return E.end_report(end_token_rank(spark, d))


@query("""SELECT role, count(*) AS n, round(100 * avg(CAST(right(text, 1) = '.' AS INT)), 6) AS stopped_pct, round(100 * avg(CAST(contains(text, 'the') AS INT)), 6) AS leaked_pct, round(avg(length(text)), 6) AS mean_new FROM conversations GROUP BY role""")
def generation_health(spark, d):
    return E.generation_health(table(spark, d, "conversations"), ["role"], F.endswith("text", F.lit(".")), F.contains("text", F.lit("the")), F.length("text"))


@query(f"""WITH {MCQ}, f AS (SELECT difficulty, count(*) AS n, count(*) FILTER (pred_b = gold) AS n_correct FROM m GROUP BY 1) SELECT 'model of ' || difficulty AS model, difficulty FROM f""")
def fingerprint_match(spark, d):
    """Dumps (here: difficulties) recognised by their published numbers of rows and hits."""
    rows = mcq(spark, d)
    published = rows.groupBy("difficulty").agg(F.count("*").alias("n"), F.count_if(hit("pred_b")).alias("n_correct")).select(F.concat(F.lit("model of "), "difficulty").alias("model"), "n", "n_correct")
    return E.fingerprint_match(rows, published, "difficulty", hit("pred_b"))


@query(f"WITH {_CELLS} SELECT model, bench, acc + CASE WHEN model = 'b' THEN 0.02 ELSE 0.01 END AS want, acc AS got FROM e WHERE model = 'b'")
def verify_published(spark, d):
    rows = cells(spark, d)
    return E.verify(rows, rows.withColumn("acc", F.col("acc") + F.when(F.col("model") == "b", 0.02).otherwise(0.01)), ["model", "bench"], "acc")


@query("""WITH p AS (SELECT conv_id, turn, text FROM conversations) SELECT conv_id, turn, coalesce(nullif(regexp_extract(text, '[eai]'), ''), NULL) AS first_label,
    CASE WHEN upper(trim(text)) LIKE 'THE%' THEN 'THE' WHEN upper(trim(text)) LIKE 'LES%' THEN 'LES' WHEN contains(upper(text), 'THE') THEN 'THE' WHEN contains(upper(text), 'LES') THEN 'LES' END AS by_prefix,
    CASE WHEN contains(upper(text), 'ANDTH') THEN 'ANDTH' WHEN regexp_matches(upper(text), '\\bTHE\\b') THEN 'THE' ELSE 'UNK' END AS by_keyword FROM p""")
def parse_predictions(spark, d):
    from loomwright.functions import text as T

    t = F.col("text")
    return table(spark, d, "conversations").select("conv_id", "turn", T.first_label_char(t, "eai").alias("first_label"), T.label_by_prefix(t, ["THE", "LES"]).alias("by_prefix"), T.label_by_keyword(t, ["ANDTH", "THE"], {"THE"}).alias("by_keyword"))


@query("""SELECT o_orderkey AS item_idx, CAST(list_position([x0, x1, x2], list_max([x0, x1, x2])) - 1 AS BIGINT) AS pred, round(x0 - (m + ln(exp(x0 - m) + exp(x1 - m) + exp(x2 - m))), 9) AS lp0, round(exp(x1 - m) / (exp(x0 - m) + exp(x1 - m) + exp(x2 - m)), 9) AS p1,
    CAST(list_position([x0 - 3, x1 - 1, x2], list_max([x0 - 3, x1 - 1, x2])) - 1 AS BIGINT) AS pred_calibrated
    FROM (SELECT o_orderkey, x0, x1, x2, greatest(x0, x1, x2) AS m FROM (SELECT o_orderkey, CAST(o_orderkey % 7 AS DOUBLE) AS x0, CAST(o_custkey % 5 AS DOUBLE) AS x1, CAST(o_orderkey % 3 AS DOUBLE) AS x2 FROM orders))""")
def option_scores(spark, d):
    """Log-probabilities over the options, the best one, and the best after a prior is taken off."""
    from loomwright.functions import arrays as R

    x = F.array(*[c.cast("double") for c in (F.col("o_orderkey") % 7, F.col("o_custkey") % 5, F.col("o_orderkey") % 3)])
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("item_idx"), x.alias("x"))
    prior = F.array(F.lit(3.0), F.lit(1.0), F.lit(0.0))
    return rows.select("item_idx", R.argmax(F.col("x")).cast("long").alias("pred"), F.round(F.get(R.log_softmax(F.col("x")), F.lit(0)), 9).alias("lp0"), F.round(F.get(R.softmax(F.col("x")), F.lit(1)), 9).alias("p1"), R.argmax(R.minus(F.col("x"), prior)).cast("long").alias("pred_calibrated"))


@query("""WITH r AS (SELECT n_name AS name, n_nationkey % 3 AS snapshot, n_nationkey * 1.5 AS score FROM nation), a AS (SELECT n_name AS name, n_regionkey AS model, n_nationkey % 4 AS priority FROM nation)
    SELECT model, arg_min(score, (snapshot, priority, name)) AS score FROM r JOIN a USING (name) GROUP BY model""")
def first_match(spark, d):
    """Of several names and snapshots the value of the best one for each model."""
    n = table(spark, d, "nation")
    rows = n.select(F.col("n_name").alias("name"), (F.col("n_nationkey") % 3).alias("snapshot"), (F.col("n_nationkey") * F.lit(1.5)).alias("score"))
    alias = n.select(F.col("n_name").alias("name"), F.col("n_regionkey").alias("model"), (F.col("n_nationkey") % 4).alias("priority"))
    return E.first_match(rows, alias, "name", "score")


@query("SELECT r_name AS arm, n_name AS model, lang FROM region, nation, (SELECT unnest(['si', 'en']) AS lang)")
def job_units(spark, d):
    """The product of languages, arms and models: tables of a few rows."""
    langs = spark.createDataFrame([("si",), ("en",)], "lang string")
    arms, models = table(spark, d, "region").select(F.col("r_name").alias("arm")), table(spark, d, "nation").select(F.col("n_name").alias("model"))
    return langs.crossJoin(F.broadcast(arms)).crossJoin(F.broadcast(models)).select("arm", "model", "lang")


@query("""SELECT o_orderkey AS item_idx, coalesce(nullif(regexp_extract(string_split(g, 'Answer:')[-1], '\\b([0-4])\\b', 1), ''), 'UNK') AS pred FROM (
    SELECT o_orderkey, 'x 3 Answer: no 1 Answer:' || CASE o_orderkey % 4 WHEN 0 THEN ' 2.' WHEN 1 THEN '12' WHEN 2 THEN ' it is 7 or 4' ELSE '' END AS g FROM orders)""")
def digit_answers(spark, d):
    from loomwright.functions import text as T

    k = F.col("o_orderkey") % 4
    g = F.concat(F.lit("x 3 Answer: no 1 Answer:"), F.when(k == 0, " 2.").when(k == 1, "12").when(k == 2, " it is 7 or 4").otherwise(""))
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("item_idx"), T.digit_answer(g).alias("pred"))


@query("""WITH s AS (SELECT doc_id, text, md5('12|' || doc_id) AS h FROM documents) SELECT CASE WHEN CAST(('0x' || substr(h, 1, 8)) AS BIGINT) % 50 = 0 THEN 'eval' ELSE 'train' END AS part, count(*) AS n FROM s GROUP BY 1""")
def hash_split(spark, d):
    """A random 2 % for evaluation, the same rows whatever the partitions."""
    from loomwright.operators.splits import hash_bucket

    return table(spark, d, "documents").groupBy(F.when(hash_bucket("12", 50, "doc_id") == 0, "eval").otherwise("train").alias("part")).agg(F.count("*").alias("n"))
