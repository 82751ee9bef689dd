"""Queries on embeddings (A: even labels, B: odd) and on matrices built from them and from lineitem."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomwright.functions import arrays as R
from loomwright.operators import matrices as M
from loomwright.operators import vectors as V
from loomwright.plans.common import Book
from loomwright.session import table

query = Book()
QUERIES, ORACLES = query.queries, query.oracles

E_ = "e AS (SELECT vec_id, label, label % 2 AS side, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"
DOT = "list_inner_product"
COS = "coalesce(list_inner_product({a}, {b}) / nullif(sqrt(list_inner_product({a}, {a})) * sqrt(list_inner_product({b}, {b})), 0), 0)"


def cos_sql(a: str, b: str) -> str:
    return COS.format(a=a, b=b)


def emb(spark, d):
    return table(spark, d, "embeddings").withColumn("side", F.col("label") % 2)


_CENTROID = f"{E_}, x AS (SELECT side, generate_subscripts(v, 1) AS i, unnest(v) AS x FROM e), m AS (SELECT side, i, avg(x) AS m FROM x GROUP BY 1, 2), c AS (SELECT side, list(m ORDER BY i) AS c FROM m GROUP BY side)"


@query(f"WITH {_CENTROID} SELECT side, CAST(i - 1 AS INT) AS i, round(m, 6) AS m FROM m")
def centroids(spark, d):
    return V.centroids(emb(spark, d), "embedding", ["side"]).select("side", F.posexplode("centroid").alias("i", "m")).withColumn("m", F.round("m", 6))


@query(f"""WITH {_CENTROID}, p AS (SELECT a.c AS a, b.c AS b FROM c a, c b WHERE a.side = 0 AND b.side = 1), q AS (SELECT a, b, {cos_sql('a', 'b')} AS cos FROM p)
    SELECT round(cos, 6) AS cosine, round(1 - cos, 6) AS cosine_distance, round(list_distance(a, b), 6) AS l2, round(degrees(acos(greatest(-1, least(1, cos)))), 4) AS degrees FROM q""")
def centroid_shift(spark, d):
    c = V.centroids(emb(spark, d), "embedding", ["side"])
    a, b = c.where("side = 0").select(F.col("centroid").alias("a")), c.where("side = 1").select(F.col("centroid").alias("b"))
    return a.crossJoin(b).select(*V.compare(F.col("a"), F.col("b")))


@query(f"WITH {_CENTROID} SELECT vec_id, round(1 - {cos_sql('v', 'c')}, 6) AS distance FROM e JOIN c USING (side)")
def distance_to_centroid(spark, d):
    return V.to_centroid(emb(spark, d), "embedding", ["side"]).select("vec_id", F.round("distance", 6).alias("distance"))


@query(f"""WITH {_CENTROID}, d AS (SELECT side, round(1 - {cos_sql('v', 'c')}, 9) AS x FROM e JOIN c USING (side)), b AS (SELECT side, CAST(CASE WHEN x = 2 THEN 19 ELSE floor(x / 0.1) END AS INT) AS bin, count(*) AS n FROM d WHERE x BETWEEN 0 AND 2 GROUP BY 1, 2)
    SELECT side, bin, n, round(n / sum(n) OVER (PARTITION BY side) / 0.1, 6) AS density FROM b""")
def compactness_histogram(spark, d):
    rows = V.to_centroid(emb(spark, d), "embedding", ["side"]).withColumn("x", F.round("distance", 9))
    return V.histogram(rows, F.col("x"), 0.0, 2.0, 20, ["side"])


@query(f"""WITH {E_}, p AS (SELECT a.vec_id AS query, b.vec_id AS key, round({cos_sql('a.v', 'b.v')}, 6) AS similarity FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0)
    SELECT query, key, CAST(r AS INT) AS rank, similarity FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY similarity DESC, key) AS r FROM p) WHERE r <= 5""")
def knn_top5(spark, d):
    rows = table(spark, d, "embeddings")
    return V.neighbours(rows, rows.where("vec_id % 20 = 0"), "vec_id", "embedding", 5)


@query(f"""WITH {E_}, p AS (SELECT a.vec_id AS query, b.vec_id AS key, round({cos_sql('a.v', 'b.v')}, 6) AS similarity FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0),
    k AS (SELECT key FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY similarity DESC, key) AS r FROM p) WHERE r <= 10) SELECT key, count(*) AS n FROM k GROUP BY key""")
def hubness(spark, d):
    rows = table(spark, d, "embeddings")
    return V.hubness(V.neighbours(rows, rows.where("vec_id % 20 = 0"), "vec_id", "embedding", 10))


@query(f"""WITH {E_}, s AS (SELECT vec_id, side, v FROM e), x AS (SELECT vec_id, v FROM s WHERE side = 0 ORDER BY md5('m|' || vec_id) LIMIT 10000), y AS (SELECT vec_id, v FROM s WHERE side = 1 ORDER BY md5('m|' || vec_id) LIMIT 10000),
    c AS (SELECT list_distance(x.v, y.v) ** 2 AS d FROM x, y), g AS (SELECT median(d) FILTER (d > 0) AS s FROM c),
    k AS (SELECT (SELECT avg(exp(-(list_distance(a.v, b.v) ** 2) / s)) FROM x a JOIN x b ON a.vec_id <> b.vec_id) AS xx, (SELECT avg(exp(-(list_distance(a.v, b.v) ** 2) / s)) FROM y a JOIN y b ON a.vec_id <> b.vec_id) AS yy, (SELECT avg(exp(-d / s)) FROM c) AS xy, s FROM g)
    SELECT round(sqrt(greatest(xx + yy - 2 * xy, 0)), 6) AS mmd, round(sqrt(s / 2), 6) AS sigma FROM k""")
def mmd_rbf(spark, d):
    """On samples of at most 10,000 vectors a side: a kernel matrix of bounded size."""
    from loomwright.operators.splits import sample

    rows = emb(spark, d).select("vec_id", "side", "embedding")
    return V.rbf_mmd(sample(rows.where("side = 0"), V.MMD_VECTORS, "m", "vec_id"), sample(rows.where("side = 1"), V.MMD_VECTORS, "m", "vec_id"), "embedding")


@query(f"""WITH {E_}, u AS (SELECT label, sqrt({DOT}(v, v)) AS n, v FROM e), x AS (SELECT label, generate_subscripts(v, 1) AS i, unnest(v) / nullif(n, 0) AS x FROM u),
    s AS (SELECT label, sum(sq) AS sq FROM (SELECT label, sum(x) ** 2 AS sq FROM x GROUP BY label, i) GROUP BY label), c AS (SELECT label, count(*) AS n, count(*) FILTER (n > 0) AS nz, round(avg(n), 6) AS mean_norm FROM u GROUP BY label)
    SELECT label, n, mean_norm, round((sq - nz) / (n * (n - 1)), 6) AS mean_cosine FROM c JOIN s USING (label)""")
def category_intra_cosine(spark, d):
    return V.intra_cosine(table(spark, d, "embeddings"), "embedding", "label")


@query()
def kmeans_composition(spark, d):
    return V.composition(V.clusters(emb(spark, d), "embedding", 8), F.col("side") == 1)


#: Two numbers of a vector: the means of its even and of its odd dimensions.
_TWO = """t AS (SELECT vec_id, label % 2 AS side, list_avg(list_filter(CAST(embedding AS DOUBLE[]), lambda x, i: i % 2 = 1)) AS x, list_avg(list_filter(CAST(embedding AS DOUBLE[]), lambda x, i: i % 2 = 0)) AS y FROM embeddings)"""


def two(spark, d):
    mean = lambda k: F.aggregate(F.filter("embedding", lambda x, i: i % 2 == k), F.lit(0.0), lambda s, x: s + x.cast("double")) / 32
    return emb(spark, d).select("vec_id", "side", F.array(mean(0), mean(1)).alias("v"))


@query(f"""WITH {_TWO}, c AS (SELECT var_samp(x) AS a, covar_samp(x, y) AS b, var_samp(y) AS c FROM t), e AS (SELECT unnest([0, 1]) AS component, (a + c) / 2 + unnest([1, -1]) * sqrt(((a - c) / 2) ** 2 + b * b) AS e FROM c),
    p AS (SELECT component, e, e / sum(e) OVER () AS p, (sum(e) OVER ()) ** 2 / sum(e * e) OVER () AS r FROM e)
    SELECT component, round(e, 9) AS eigenvalue, round(p, 9) AS share, round(exp(-sum(p * ln(p)) OVER ()), 9) AS effective_rank, round(r, 9) AS participation FROM p""")
def spectrum_of_two(spark, d):
    """Of two numbers a vector, where the eigenvalues have a closed form."""
    rows = V.spectrum(two(spark, d), "v")
    return rows.select("component", *[F.round(c, 9).alias(c) for c in ("eigenvalue", "share", "effective_rank", "participation")])


@query()
def spectrum(spark, d):
    return V.spectrum(table(spark, d, "embeddings"), "embedding")


@query()
def principal_coordinates(spark, d):
    rows = V.projected(table(spark, d, "embeddings"), "embedding", 2)
    return rows.select("vec_id", *[F.round(F.get("coordinates", F.lit(k)), 6).alias(f"pc{k + 1}") for k in (0, 1)])


@query()
def isotropy(spark, d):
    return V.isotropy(table(spark, d, "embeddings"), "embedding")


def _kl_sql(p: str, q: str) -> str:
    """The divergence of the Gaussian of table p from that of q (columns m1, m2, a, b, c), ridge 1e-3, in closed form."""
    P, Q = ({k: f"(SELECT {k} FROM {t})" for k in ("m1", "m2", "a", "b", "c")} for t in (p, q))
    A, C, U, W = (f"({x} + 1e-3)" for x in (P["a"], P["c"], Q["a"], Q["c"]))
    dp, dq = f"({A} * {C} - {P['b']} ** 2)", f"({U} * {W} - {Q['b']} ** 2)"
    x, y = f"({Q['m1']} - {P['m1']})", f"({Q['m2']} - {P['m2']})"
    trace = f"(({W} * {A} - 2 * {Q['b']} * {P['b']} + {U} * {C}) / {dq})"
    gap = f"(({W} * {x} ** 2 - 2 * {Q['b']} * {x} * {y} + {U} * {y} ** 2) / {dq})"
    return f"0.5 * (ln({dq}) - ln({dp}) - 2 + {trace} + {gap})"


@query(f"""WITH {_TWO}, p AS (SELECT avg(x) AS m1, avg(y) AS m2, var_pop(x) AS a, covar_pop(x, y) AS b, var_pop(y) AS c FROM t WHERE side = 0), q AS (SELECT avg(x) AS m1, avg(y) AS m2, var_pop(x) AS a, covar_pop(x, y) AS b, var_pop(y) AS c FROM t WHERE side = 1),
    m AS (SELECT (p.m1 + q.m1) / 2 AS m1, (p.m2 + q.m2) / 2 AS m2, (p.a + q.a) / 2 AS a, (p.b + q.b) / 2 AS b, (p.c + q.c) / 2 AS c FROM p, q)
    SELECT round({_kl_sql('p', 'q')}, 9) AS kl, round(0.5 * ({_kl_sql('p', 'm')}) + 0.5 * ({_kl_sql('q', 'm')}), 9) AS js""")
def gaussian_divergence(spark, d):
    """Of two numbers a vector, where the divergence has a closed form."""
    rows = two(spark, d)
    (m0, c0), (m1, c1) = (V.mean_covariance(rows.where(F.col("side") == s), "v") for s in (0, 1))
    return spark.createDataFrame([(V.gaussian_kl(m0, c0, m1, c1), V.gaussian_js(m0, c0, m1, c1))], "kl double, js double").select(F.round("kl", 9).alias("kl"), F.round("js", 9).alias("js"))


@query()
def embedding_divergence(spark, d):
    rows = emb(spark, d)
    (m0, c0), (m1, c1) = (V.mean_covariance(rows.where(F.col("side") == s), "embedding") for s in (0, 1))
    return spark.createDataFrame([(V.gaussian_kl(m0, c0, m1, c1), V.gaussian_js(m0, c0, m1, c1))], "kl double, js double")


_COV = f"{E_}, x AS (SELECT vec_id, generate_subscripts(v, 1) AS i, unnest(v) AS x FROM e)"


@query(f"WITH {_COV} SELECT CAST(a.i - 1 AS INT) AS i, CAST(b.i - 1 AS INT) AS j, round(covar_pop(a.x, b.x), 6) + 0.0 AS c FROM x a JOIN x b ON a.vec_id = b.vec_id GROUP BY a.i, b.i")
def covariance(spark, d):
    _, c = V.mean_covariance(table(spark, d, "embeddings"), "embedding")
    return spark.createDataFrame([(i, j, float(c[i, j])) for i in range(len(c)) for j in range(len(c))], "i int, j int, c double").withColumn("c", F.round("c", 6) + F.lit(0.0))


def _pairs_sql(name: str, a: int, b: int) -> str:
    side = lambda s, x: f"SELECT draw, v AS {x} FROM (SELECT draw, h % (SELECT count(*) FROM r WHERE side = {s}) AS place FROM (SELECT draw, CAST(('0x' || substr(md5('p{x}|' || draw), 1, 8)) AS BIGINT) AS h FROM (SELECT unnest(range(5000)) AS draw))) JOIN r USING (place) WHERE side = {s}"
    return f"SELECT '{name}' AS pair, count(*) AS n, round(avg(c), 6) AS mean, round(stddev_pop(c), 6) AS std FROM (SELECT {cos_sql('x', 'y')} AS c FROM ({side(a, 'x')}) JOIN ({side(b, 'y')}) USING (draw))"


@query(f"WITH {E_}, r AS (SELECT side, v, row_number() OVER (PARTITION BY side ORDER BY vec_id) - 1 AS place FROM e) {' UNION ALL '.join(_pairs_sql(*x) for x in (('AA', 0, 0), ('BB', 1, 1), ('AB', 0, 1)))}")
def sampled_cosines(spark, d):
    """5,000 drawn pairs each within A, within B and across."""
    rows = emb(spark, d)
    a, b = rows.where("side = 0"), rows.where("side = 1")
    out = [V.sampled_cosines(x, y, "vec_id", "embedding", 5000).select(F.lit(n).alias("pair"), "n", "mean", "std") for n, x, y in (("AA", a, a), ("BB", b, b), ("AB", a, b))]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query(f"WITH {E_}, n AS (SELECT vec_id, sqrt({DOT}(v, v)) AS n FROM e), z AS (SELECT vec_id, (n - avg(n) OVER ()) / stddev_pop(n) OVER () AS z FROM n) SELECT vec_id, round(z, 6) AS z FROM z WHERE abs(z) > 1 ORDER BY abs(z) DESC, vec_id LIMIT 8")
def norm_outliers_top8(spark, d):
    return V.outliers(table(spark, d, "embeddings").select("vec_id", "embedding"), R.norm(F.col("embedding")), 1.0, most=8).select("vec_id", F.round("z", 6).alias("z"))


@query(f"WITH {E_}, n AS (SELECT vec_id, sqrt({DOT}(v, v)) AS n FROM e), z AS (SELECT vec_id, (n - avg(n) OVER ()) / stddev_pop(n) OVER () AS z FROM n) SELECT vec_id, round(z, 6) AS z FROM z WHERE abs(z) > 2")
def norm_outliers(spark, d):
    return V.outliers(table(spark, d, "embeddings"), R.norm(F.col("embedding")), 2.0).select("vec_id", F.round("z", 6).alias("z"))


@query("WITH z AS (SELECT s_suppkey, s_nationkey, (s_acctbal - avg(s_acctbal) OVER w) / stddev_samp(s_acctbal) OVER w AS z FROM supplier WINDOW w AS (PARTITION BY s_nationkey)) SELECT s_suppkey, round(z, 6) AS z FROM z WHERE abs(z) > 1.5")
def zscore_outliers(spark, d):
    return V.outliers(table(spark, d, "supplier"), F.col("s_acctbal"), 1.5, ["s_nationkey"], sample=True).select("s_suppkey", F.round("z", 6).alias("z"))


@query(f"""WITH {E_}, w AS (SELECT vec_id, v, list_transform(v, lambda x, i: CASE WHEN (vec_id + i) % 3 = 0 THEN -x ELSE x END) AS o FROM e), c AS (SELECT vec_id, {cos_sql('v', 'o')} AS c FROM w)
    SELECT round(avg(c), 6) AS mean, round(avg(CAST(c < 0.9 AS INT)), 6) AS moved FROM c""")
def token_drift(spark, d):
    rows = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    other = rows.withColumn("embedding", F.transform("embedding", lambda x, i: F.when((F.col("vec_id") + i + 1) % 3 == 0, -x).otherwise(x)))
    return V.drift(rows, other, "vec_id", "embedding").agg(F.round(F.avg("cosine"), 6).alias("mean"), F.round(F.avg((F.col("cosine") < 0.9).cast("int")), 6).alias("moved"))


@query(f"""WITH {E_}, w AS (SELECT vec_id, v, list_transform(v, lambda x, i: CASE WHEN (vec_id + i) % 3 = 0 THEN -x ELSE x END) AS o FROM e) SELECT vec_id, round({cos_sql('v', 'o')}, 6) AS cosine FROM w ORDER BY 2, 1 LIMIT 8""")
def most_moved(spark, d):
    rows = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    other = rows.withColumn("embedding", F.transform("embedding", lambda x, i: F.when((F.col("vec_id") + i + 1) % 3 == 0, -x).otherwise(x)))
    return V.most_moved(V.drift(rows, other, "vec_id", "embedding").withColumn("cosine", F.round("cosine", 6)), "vec_id")


@query(f"WITH {_CENTROID.replace('side', 'one').replace('label % 2 AS one', '1 AS one')} SELECT round(avg({cos_sql('v', 'c')}), 6) AS mean_cosine FROM e, c")
def cosine_to_mean(spark, d):
    return V.to_centroid(table(spark, d, "embeddings").withColumn("one", F.lit(1)), "embedding", ["one"]).agg(F.round(F.avg(1 - F.col("distance")), 6).alias("mean_cosine"))


@query(f"WITH {E_} SELECT round(corr(ln(1 + label), sqrt({DOT}(v, v))), 6) AS r FROM e")
def frequency_norm_corr(spark, d):
    return table(spark, d, "embeddings").agg(F.round(F.corr(F.log1p("label"), R.norm(F.col("embedding"))), 6).alias("r"))


@query("SELECT label % 3 AS cluster, count(*) FILTER (vec_id % 2 = 0) AS a, count(*) FILTER (vec_id % 2 = 1) AS b FROM embeddings GROUP BY 1")
def cluster_crosstab(spark, d):
    rows = table(spark, d, "embeddings").select((F.col("label") % 3).alias("cluster"), F.when(F.col("vec_id") % 2 == 0, "a").otherwise("b").alias("c"))
    return rows.groupBy("cluster").pivot("c", ["a", "b"]).count().na.fill(0)


@query(f"""WITH {E_}, m AS (SELECT label, list(v ORDER BY vec_id) AS x FROM e WHERE vec_id % 7 = 0 GROUP BY label), c AS (SELECT label, v, vec_id FROM e), p AS (SELECT a.label AS x, b.label AS y, round({cos_sql('a.c', 'b.c')}, 6) AS c FROM
    (SELECT label, list(m ORDER BY i) AS c FROM (SELECT label, i, avg(x) AS m FROM (SELECT label, generate_subscripts(v, 1) AS i, unnest(v) AS x FROM e) GROUP BY 1, 2) GROUP BY 1) a JOIN
    (SELECT label, list(m ORDER BY i) AS c FROM (SELECT label, i, avg(x) AS m FROM (SELECT label, generate_subscripts(v, 1) AS i, unnest(v) AS x FROM e) GROUP BY 1, 2) GROUP BY 1) b ON a.label < b.label) SELECT x, y, c AS cosine FROM p""")
def head_cosines(spark, d):
    """Cosines of all pairs of a few vectors (here the labels' centroids)."""
    c = V.centroids(table(spark, d, "embeddings"), "embedding", ["label"])
    a, b = c.select(F.col("label").alias("x"), F.col("centroid").alias("u")), c.select(F.col("label").alias("y"), F.col("centroid").alias("v"))
    return a.join(b, F.col("x") < F.col("y")).select("x", "y", F.round(R.cosine(F.col("u"), F.col("v")), 6).alias("cosine"))


_HUBS = f"""{E_}, p AS (SELECT a.vec_id AS query, b.vec_id AS key, round({cos_sql('a.v', 'b.v')}, 6) AS similarity FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0),
    k AS (SELECT key FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY similarity DESC, key) AS r FROM p) WHERE r <= 10), h AS (SELECT key, count(*) AS n FROM k GROUP BY key)"""


@query(f"WITH {_HUBS} SELECT n, count(*) AS n_rows FROM h GROUP BY n")
def hub_histogram(spark, d):
    return V.hub_histogram(hubness(spark, d))


@query(f"WITH {_HUBS} SELECT key, n FROM h ORDER BY n DESC, key LIMIT 10")
def top_hubs(spark, d):
    return V.top_hubs(hubness(spark, d))


@query(f"""WITH {_CENTROID.replace('side', 'label').replace('label % 2 AS label, ', '')}, p AS (SELECT a.label % 2 AS side, a.label AS x, b.label AS y, round({cos_sql('a.c', 'b.c')}, 6) AS cosine FROM c a JOIN c b ON a.label < b.label)
    SELECT side, arg_max(x, (cosine, -x, -y)) AS x, arg_max(y, (cosine, -x, -y)) AS y, max(cosine) AS cosine FROM p GROUP BY side""")
def most_redundant_pair(spark, d):
    return V.most_similar_pair(head_cosines(spark, d).withColumn("side", F.col("x") % 2), ["side"])


# ---- matrices: label = layer, a row for each vector


def matrix(spark, d):
    return table(spark, d, "embeddings").select(F.col("label").alias("layer"), F.col("vec_id").alias("row"), F.col("embedding").alias("vals"))


@query("""WITH x AS (SELECT label AS layer, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings)
    SELECT layer, count(*) AS n, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std, round(min(x), 6) AS x_min, round(max(x), 6) AS x_max, round(quantile_cont(x, 0.5), 6) AS median, round(quantile_cont(x, 0.01), 6) AS p1, round(quantile_cont(x, 0.99), 6) AS p99,
      round(sqrt(sum(x * x)), 6) AS fro, round(sum(abs(x)), 6) AS l1, round(max(abs(x)), 6) AS absmax FROM x GROUP BY layer""")
def matrix_stats(spark, d):
    return M.statistics(matrix(spark, d), ["layer"])


@query()
def matrix_ranks(spark, d):
    return M.ranks(M.singular_values(matrix(spark, d), ["layer"]), ["layer"])


@query()
def head_signatures(spark, d):
    signatures = M.standardise(M.head_signatures(M.singular_values(matrix(spark, d), ["layer"]), ["layer"]), "signature", ["layer"])
    return signatures.select("layer", F.posexplode("signature").alias("i", "z")).withColumn("z", F.round("z", 6))


@query("""WITH x AS (SELECT l_linenumber % 3 AS layer, l_extendedprice AS v FROM lineitem WHERE l_extendedprice > 0), s AS (SELECT log10(v) AS l, unnest(['global', CASE WHEN layer = 0 THEN 'attn' ELSE 'mlp' END, 'layer ' || layer]) AS scope FROM x), b AS (SELECT scope, CAST(CASE WHEN l = 6 THEN 39 ELSE floor((l - 2) / 0.1) END AS INT) AS bin, count(*) AS n FROM s WHERE l BETWEEN 2 AND 6 GROUP BY 1, 2)
    SELECT scope, bin, n, round(sum(n) OVER (PARTITION BY scope ORDER BY bin) / sum(n) OVER (PARTITION BY scope), 6) AS cdf FROM b""")
def log_histogram_cdf(spark, d):
    layer = F.col("l_linenumber") % 3
    scopes = [F.lit("global"), F.when(layer == 0, "attn").otherwise("mlp"), F.concat(F.lit("layer "), layer.cast("string"))]
    return M.cumulative(M.log_histogram(table(spark, d, "lineitem"), "l_extendedprice", scopes, 2.0, 6.0, 40), ["scope"])


@query("SELECT CAST(floor(log10(min(l_extendedprice))) - 1 AS INT) AS low, CAST(ceil(log10(max(l_extendedprice))) + 1 AS INT) AS high FROM lineitem WHERE l_extendedprice > 0")
def histogram_range(spark, d):
    return M.log_range(table(spark, d, "lineitem"), "l_extendedprice")


@query("""WITH s AS (SELECT l_extendedprice AS v, row_number() OVER (ORDER BY l_extendedprice) AS r, count(*) OVER () AS n FROM lineitem), t AS (SELECT v AS threshold, n FROM s WHERE r = CAST(floor(n * 0.3) AS BIGINT))
    SELECT threshold, round((SELECT count(*) FROM lineitem WHERE l_extendedprice <= threshold) / n, 6) AS achieved FROM t""")
def kth_prune_threshold(spark, d):
    return M.kth_threshold(table(spark, d, "lineitem"), F.col("l_extendedprice"), 0.3)


@query("""WITH t AS (SELECT l_linenumber, quantile_cont(l_extendedprice, 0.2) AS t FROM lineitem GROUP BY 1) SELECT l_linenumber, round(max(t), 6) AS threshold, count(*) FILTER (l_extendedprice <= t) AS n_masked, count(*) AS n FROM lineitem JOIN t USING (l_linenumber) GROUP BY l_linenumber""")
def quantile_masks(spark, d):
    return M.quantile_masks(table(spark, d, "lineitem"), ["l_linenumber"], "l_extendedprice", 0.2)


@query("""WITH t AS (SELECT l_linenumber, quantile_cont(l_extendedprice, 0.2) AS t FROM lineitem GROUP BY 1) SELECT l_orderkey, l_linenumber, l_extendedprice <= t AS masked FROM lineitem JOIN t USING (l_linenumber)""")
def quantile_mask(spark, d):
    return M.quantile_mask(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice"), ["l_linenumber"], "l_extendedprice", 0.2).select("l_orderkey", "l_linenumber", "masked")


@query("""WITH x AS (SELECT label AS layer, vec_id, generate_subscripts(embedding, 1) AS j, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings), y AS (SELECT *, x * (1 + (j % 5) * 0.01) AS y FROM x)
    SELECT layer, round(sqrt(greatest(sum(x * x) + sum(y * y) - 2 * sum(x * y), 0) / sum(x * x)), 6) AS relative_delta, round(sum(x * y) / sqrt(sum(x * x) * sum(y * y)), 6) AS cosine FROM y GROUP BY layer""")
def matrix_drift(spark, d):
    m = matrix(spark, d).withColumn("vals", F.col("vals").cast("array<double>"))
    return M.matrix_drift(m, m.withColumn("vals", F.transform("vals", lambda x, i: x * (1 + ((i + 1) % 5) * 0.01))), ["layer", "row"])


@query("""WITH o AS (SELECT l_suppkey AS k, l_partkey AS n, sum(l_extendedprice) AS x FROM lineitem GROUP BY 1, 2), r AS (SELECT k, n, x, sum(x) OVER (PARTITION BY k ORDER BY x DESC, n) / sum(x) OVER (PARTITION BY k) AS s FROM o) SELECT k, count(*) AS n_for_half FROM r WHERE s <= 0.5 GROUP BY k""")
def importance_cumulative(spark, d):
    rows = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("k"), F.col("l_partkey").alias("n")).agg(F.sum("l_extendedprice").alias("x"))
    return M.cumulative_share(rows, ["k"], "x", "n").where("share_upto <= 0.5").groupBy("k").agg(F.count("*").alias("n_for_half"))


@query("""WITH o AS (SELECT l_linenumber AS k, l_orderkey AS o, round(sum(l_extendedprice), 2) AS x FROM lineitem GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY x DESC, o) AS r, count(*) OVER (PARTITION BY k) AS n FROM o) SELECT k, round(sum(x) FILTER (r <= ceil(n * 0.1)) / sum(x), 6) AS top_share FROM r GROUP BY k""")
def importance_top_share(spark, d):
    rows = table(spark, d, "lineitem").groupBy(F.col("l_linenumber").alias("k"), F.col("l_orderkey").alias("o")).agg(F.round(F.sum("l_extendedprice"), 2).alias("x"))
    return M.top_share(rows, ["k"], "x", "o")


_ATT = "r AS (SELECT l_linenumber AS head, l_suppkey % 16 AS q, l_partkey % 16 AS k, l_quantity AS w FROM lineitem WHERE l_partkey % 16 <= l_suppkey % 16), a AS (SELECT head, q, k, sum(w) / sum(sum(w)) OVER (PARTITION BY head, q) AS p FROM r GROUP BY 1, 2, 3)"


def attention(spark, d):
    from pyspark.sql import Window

    li = table(spark, d, "lineitem").select(F.col("l_linenumber").alias("head"), (F.col("l_suppkey") % 16).alias("q"), (F.col("l_partkey") % 16).alias("k"), F.col("l_quantity").alias("w")).where("k <= q")
    rows = li.groupBy("head", "q", "k").agg(F.sum("w").alias("w"))
    return rows.select("head", "q", "k", (F.col("w") / F.sum("w").over(Window.partitionBy("head", "q"))).alias("p"))


@query(f"""WITH {_ATT}, g AS (SELECT head, q, -sum(CASE WHEN p > 0 THEN p * ln(p + 1e-12) ELSE 0 END) AS e, max(p) AS t, coalesce(sum(p) FILTER (k = 0), 0) AS s, sum(p * (q - k)) AS d FROM a WHERE q >= 1 GROUP BY 1, 2)
    SELECT head, round(avg(e), 6) AS entropy, round(avg(t), 6) AS top1, round(avg(s), 6) AS sink, round(avg(d), 6) AS distance FROM g GROUP BY head""")
def attention_metrics(spark, d):
    return M.attention_metrics(attention(spark, d), ["head"])


@query(f"WITH {_ATT} SELECT head, q - k AS d, round(avg(p), 6) AS mean_p FROM a WHERE q - k BETWEEN 0 AND 39 GROUP BY 1, 2")
def attention_decay(spark, d):
    return M.distance_decay(attention(spark, d), ["head"])


@query(f"WITH {_ATT} SELECT CASE WHEN k % 3 = 0 THEN 'stopword' ELSE 'english' END AS kind, round(avg(p), 6) AS received, count(DISTINCT k) AS n_positions FROM a GROUP BY 1")
def attention_received(spark, d):
    types = spark.range(16).select(F.col("id").alias("k"), F.when(F.col("id") % 3 == 0, "stopword").otherwise("english").alias("kind"))
    return M.received_attention(attention(spark, d), types)


_INDUCTION = "i AS (SELECT head, round(coalesce(sum(p) FILTER (q >= 8 AND k = q % 8 + 1), 0) / 8, 6) AS induction FROM a GROUP BY head)"


def induction(spark, d):
    """Sixteen positions whose second half repeats the first."""
    tokens = spark.range(16).select(F.col("id").alias("pos"), (F.col("id") % 8 * 7 + 3).alias("token"))
    return M.induction_scores(attention(spark, d), tokens, ["head"], 8)


@query(f"WITH {_ATT}, {_INDUCTION} SELECT head, induction FROM i")
def induction_scores(spark, d):
    return induction(spark, d)


@query(f"""WITH {_ATT}, {_INDUCTION}, g AS (SELECT head, q, coalesce(sum(p) FILTER (k = 0), 0) AS s, sum(p * (q - k)) AS d FROM a WHERE q >= 1 GROUP BY 1, 2), m AS (SELECT head, round(avg(s), 6) AS sink, round(avg(d), 6) AS distance FROM g GROUP BY head),
    p AS (SELECT quantile_cont(distance, 0.33) AS lo, quantile_cont(distance, 0.9) AS hi FROM m) SELECT head, distance < lo AS is_local, distance > hi AS is_global, sink > 0.5 AS is_sink, induction > 0.2 AS is_induction FROM m JOIN i USING (head), p""")
def head_classes(spark, d):
    m = M.attention_metrics(attention(spark, d), ["head"]).join(induction(spark, d), "head").withColumn("one", F.lit(1))
    return M.classify_heads(m, ["one"]).select("head", "is_local", "is_global", "is_sink", "is_induction")


@query("""WITH r AS (SELECT l_linenumber % 2 AS layer, l_linenumber AS head, l_suppkey % 16 AS q, l_partkey % 16 AS k, l_quantity AS w FROM lineitem WHERE l_partkey % 16 <= l_suppkey % 16), a AS (SELECT layer, head, q, k, sum(w) / sum(sum(w)) OVER (PARTITION BY head, q) AS p FROM r GROUP BY 1, 2, 3, 4),
    h AS (SELECT layer, q, k, avg(p) AS p FROM a GROUP BY 1, 2, 3), g AS (SELECT layer, q, k, (coalesce(p, 0) + CASE WHEN q = k THEN 1 ELSE 0 END) / 2 AS m FROM (SELECT layer, q, k FROM (SELECT unnest([0, 1]) AS layer), (SELECT unnest(range(16)) AS q), (SELECT unnest(range(16)) AS k)) LEFT JOIN h USING (layer, q, k)),
    n AS (SELECT layer, q, k, m / sum(m) OVER (PARTITION BY layer, q) AS m FROM g) SELECT CAST(x.q AS INT) AS q, CAST(y.k AS INT) AS k, round(sum(x.m * y.m), 6) AS share FROM n x JOIN n y ON x.layer = 1 AND y.layer = 0 AND x.k = y.q GROUP BY 1, 2""")
def attention_rollout(spark, d):
    """Two layers: heads of even and of odd numbers."""
    out = M.rollout(attention(spark, d).withColumn("layer", F.col("head") % 2), 16)
    return spark.createDataFrame([(q, k, round(float(x), 6)) for q, row in enumerate(out) for k, x in enumerate(row)], "q int, k int, share double")


_ACT = "a AS (SELECT l_linenumber AS layer, l_suppkey % 20 AS neuron, l_quantity - 25 AS gate, l_discount - 0.05 AS up, (l_quantity - 25) * (l_discount - 0.05) AS post FROM lineitem)"
_NEURON = f"{_ACT}, n AS (SELECT layer, neuron, round(avg(abs(post)), 6) AS mean_abs, round(var_pop(post), 6) AS variance, round(max(abs(post)), 6) AS largest, round(avg(CAST(abs(post) > 0.5 AS INT)), 6) AS firing, round(corr(gate, up), 6) AS gate_up_corr, round(avg(CAST(abs(gate) > 0.5 AND abs(up) > 0.5 AS INT)), 6) AS overlap FROM a GROUP BY 1, 2)"


def neurons(spark, d):
    li = table(spark, d, "lineitem")
    gate, up = F.col("l_quantity") - 25, F.col("l_discount") - 0.05
    act = li.select(F.col("l_linenumber").alias("layer"), (F.col("l_suppkey") % 20).alias("neuron"), gate.alias("gate"), up.alias("up"), (gate * up).alias("post"))
    return M.neuron_statistics(act, ["layer", "neuron"], 0.5)


@query(f"WITH {_NEURON} SELECT * FROM n")
def neuron_stats(spark, d):
    return neurons(spark, d)


@query(f"""WITH {_NEURON}, p AS (SELECT *, mean_abs / sum(mean_abs) OVER (PARTITION BY layer) AS p FROM n) SELECT layer, count(*) FILTER (largest <= 1e-6) AS n_dead, count(*) FILTER (firing < 0.05) AS n_sparse, round(-sum(p * ln(p)), 6) AS entropy, round(stddev_pop(mean_abs) / avg(mean_abs), 6) AS cov FROM p GROUP BY layer""")
def layer_activity(spark, d):
    return M.layer_activity(neurons(spark, d), ["layer"])


_COLUMNS = "w AS (SELECT label AS layer, CAST(generate_subscripts(embedding, 1) - 1 AS INT) AS neuron, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings), k AS (SELECT layer, neuron, sqrt(sum(x * x)) AS norm, sum(abs(x)) AS l1 FROM w GROUP BY 1, 2)"


@query(f"WITH {_COLUMNS} SELECT layer, neuron, round(norm, 6) AS norm, round(l1, 6) AS l1 FROM k")
def column_norms(spark, d):
    return M.column_norms(matrix(spark, d), ["layer"]).select("layer", "neuron", F.round("norm", 6).alias("norm"), F.round("l1", 6).alias("l1"))


@query(f"WITH {_NEURON}, {_COLUMNS} SELECT layer, neuron, round(mean_abs * norm, 6) AS importance FROM n JOIN k USING (layer, neuron)")
def neuron_importance(spark, d):
    """Lineitem's activity, with the output columns of the layer's matrix."""
    columns = M.column_norms(matrix(spark, d), ["layer"])
    return M.importance(neurons(spark, d), columns, ["layer", "neuron"]).select("layer", "neuron", F.round("importance", 6).alias("importance"))


@query(f"WITH {_COLUMNS}, s AS (SELECT l_linenumber AS layer, l_suppkey % 20 AS neuron, l_partkey % 5 AS sample, avg(abs(l_quantity - 25)) AS a FROM lineitem GROUP BY 1, 2, 3), i AS (SELECT layer, neuron, avg(a) AS m FROM s GROUP BY 1, 2) SELECT layer, neuron, round(l1 * m, 6) AS importance FROM i JOIN k USING (layer, neuron)")
def column_importance(spark, d):
    inputs = table(spark, d, "lineitem").groupBy(F.col("l_linenumber").alias("layer"), (F.col("l_suppkey") % 20).alias("neuron"), (F.col("l_partkey") % 5).alias("sample")).agg(F.avg(F.abs(F.col("l_quantity") - 25)).alias("mean_abs"))
    return M.column_importance(inputs, M.column_norms(matrix(spark, d), ["layer"]), ["layer", "neuron"]).withColumn("importance", F.round("importance", 6))


@query(f"WITH {_NEURON}, c AS (SELECT layer, neuron, unnest([0, 1]) AS concept, mean_abs FROM n), x AS (SELECT layer, concept, CASE WHEN concept = 0 THEN mean_abs * 3 ELSE mean_abs * (1 + neuron % 7) END - mean_abs AS d FROM c), t AS (SELECT layer, concept, d > avg(d) OVER w + 2 * stddev_pop(d) OVER w AS hit FROM x WINDOW w AS (PARTITION BY layer, concept)) SELECT layer, concept, count(*) FILTER (hit) AS n_selective FROM t GROUP BY 1, 2")
def concept_selectivity(spark, d):
    n = neurons(spark, d).select("layer", "neuron", F.explode(F.array(F.lit(0), F.lit(1))).alias("concept"), F.col("mean_abs").alias("base"))
    n = n.withColumn("m", F.when(F.col("concept") == 0, F.col("base") * 3).otherwise(F.col("base") * (1 + F.col("neuron") % 7)))
    return M.concept_selectivity(n, ["layer"], 2.0)


@query("SELECT part, n, round(100 * n / sum(n) OVER (), 6) AS pct FROM (SELECT l_returnflag AS part, CAST(sum(CAST(l_quantity AS BIGINT) * l_linenumber * 2) AS BIGINT) AS n FROM lineitem GROUP BY 1)")
def parameter_budget(spark, d):
    li = table(spark, d, "lineitem")
    return M.parameter_budget(li.select(F.col("l_returnflag").alias("part"), F.col("l_quantity").cast("long").alias("rows"), F.col("l_linenumber").alias("cols"), F.lit(2).alias("copies")))


@query("""WITH w AS (SELECT label, vec_id, generate_subscripts(embedding, 1) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings),
    m AS (SELECT label, vec_id, CASE WHEN label = 3 AND vec_id % 4 = 0 THEN 0.5 ELSE x END + CASE WHEN label < 8 THEN 2.0 * ((vec_id % 2) * (i % 3) + (i + 1) % 3) ELSE 0 END AS y FROM w)
    SELECT CAST(label AS VARCHAR) AS name, vec_id AS row, round(sum(y), 6) AS total, round(sum(y * y), 6) AS square FROM m GROUP BY 1, 2""")
def low_rank_merge(spark, d):
    """Layers' matrices; those below 8 have factors of rank 2, and some rows of layer 3 were trained whole."""
    m = matrix(spark, d).select(F.col("layer").cast("string").alias("name"), "row", F.col("vals").cast("array<double>").alias("vals"))
    some = m.where(F.col("name").cast("int") < 8)
    n = F.sequence(F.lit(1), F.lit(64))
    a = some.select("name").distinct().select("name", F.explode(F.array(F.lit(0), F.lit(1))).alias("row")).withColumn("vals", F.transform(n, lambda i: ((i + F.col("row")) % 3).cast("double")))
    b = some.select("name", "row", F.array((F.col("row") % 2).cast("double"), F.lit(1.0)).alias("vals"))
    whole = m.where("name = '3' AND row % 4 = 0").select("name", "row", F.array_repeat(F.lit(0.5), 64).alias("vals"))
    merged = M.low_rank_merge(m, a, b, alpha=4.0, overrides=whole)
    total = lambda f: F.round(F.aggregate("vals", F.lit(0.0), lambda s, x: s + f(x)), 6)
    return merged.select("name", "row", total(lambda x: x).alias("total"), total(lambda x: x * x).alias("square"))


@query("""WITH x AS (SELECT label AS layer, generate_subscripts(embedding, 1) AS j, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings), y AS (SELECT *, x + 0.25 * (j % 3) AS y, x + 0.25 * (j % 3) + CASE WHEN layer = 2 THEN 0.5 ELSE 0 END AS z FROM x),
    r AS (SELECT layer, round(sqrt(greatest(sum(x * x) + sum(y * y) - 2 * sum(x * y), 0) / sum(x * x)), 6) AS changed, round(sqrt(greatest(sum(z * z) + sum(y * y) - 2 * sum(z * y), 0) / sum(z * z)), 5) AS residual FROM y GROUP BY layer)
    SELECT layer, changed, residual, residual <= 0.01 AS ok FROM r""")
def merge_check(spark, d):
    """A merge that one layer's expected matrix doesn't agree with."""
    m = matrix(spark, d).withColumn("vals", F.col("vals").cast("array<double>"))
    merged = m.withColumn("vals", F.transform("vals", lambda x, i: x + 0.25 * ((i + 1) % 3)))
    expected = merged.withColumn("vals", F.transform("vals", lambda x: x + F.when(F.col("layer") == 2, 0.5).otherwise(0.0)))
    return M.merge_check(m, merged, expected, ["layer", "row"]).select("layer", "changed", F.round("residual", 5).alias("residual"), "ok")


@query("SELECT DISTINCT n_name AS name FROM nation WHERE n_regionkey <> 1")
def unused_factors(spark, d):
    """Factors named after nations, weights after those of one region."""
    n = table(spark, d, "nation").select(F.col("n_name").alias("name"), "n_regionkey")
    return M.unused(n.select("name"), n.where("n_regionkey = 1").select("name"))


@query("""WITH m AS (SELECT label AS layer, vec_id // 64 AS part, vec_id % 64 AS r, embedding FROM embeddings), x AS (SELECT layer, part, r AS i, generate_subscripts(embedding, 1) - 1 AS j, CAST(unnest(embedding) AS DOUBLE) AS x FROM m), t AS (SELECT a.layer, a.part, sum(a.x * b.x) AS t FROM x a JOIN x b ON a.layer = b.layer AND a.part = b.part AND a.i = b.j AND a.j = b.i GROUP BY 1, 2), n AS (SELECT layer, part, sum(x * x) AS n FROM x GROUP BY 1, 2)
    SELECT layer, part, round(t / n, 6) AS copying FROM t JOIN n USING (layer, part)""")
def copying_score(spark, d):
    """Each layer's rows as square matrices of 64 rows; rows of other layers count as zero."""
    m = matrix(spark, d).select("layer", F.floor(F.col("row") / 64).alias("part"), (F.col("row") % 64).alias("row"), F.col("vals").cast("array<double>").alias("vals"))
    return M.copying_score(m, m, ["layer", "part"])


@query("""WITH x AS (SELECT l_linenumber AS layer, l_returnflag AS proj, l_extendedprice AS v FROM lineitem), g AS (SELECT layer, proj, round(avg(v), 6) AS m FROM x GROUP BY 1, 2) SELECT layer, max(m) FILTER (proj = 'A') AS "A", max(m) FILTER (proj = 'N') AS "N", max(m) FILTER (proj = 'R') AS "R", arg_max(proj, (m, proj)) AS largest, arg_min(proj, (m, proj)) AS smallest FROM g GROUP BY layer""")
def layer_projection_pivot(spark, d):
    g = table(spark, d, "lineitem").groupBy(F.col("l_linenumber").alias("layer"), F.col("l_returnflag").alias("proj")).agg(F.round(F.avg("l_extendedprice"), 6).alias("m"))
    return M.projection_pivot(g, "layer", "proj", "m", ["A", "N", "R"])


@query("SELECT CAST(ceil(max(l_quantity) / 20) * 20 AS BIGINT) AS axis FROM lineitem")
def radar_axis(spark, d):
    from loomwright.operators.evaluation import axis_limit

    return table(spark, d, "lineitem").agg(axis_limit(F.max("l_quantity")).cast("long").alias("axis"))
