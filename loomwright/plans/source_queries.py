"""Queries on readers, writers and streams.  Files are made from the driver's tables in a shared folder and
read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from loomwright.sources import readers, sinks
from loomwright.streaming import events as EV
from loomwright.plans.common import Book
from loomwright.session import shared_root, table

query = Book()
QUERIES, ORACLES = query.queries, query.oracles


def folder(spark) -> str:
    """A new path in the folder that the cluster shares."""
    return f"{shared_root(spark)}/files-{uuid.uuid4().hex}"


@query("SELECT CAST(count(*) AS BIGINT) AS n_read, CAST(sum(CAST(doc_id % 10 = 0 AS INT)) AS BIGINT) AS n_errors, CAST(sum(length(text)) FILTER (doc_id % 10 <> 0) AS BIGINT) AS n_chars FROM documents")
def jsonl_tolerant(spark, d):
    """Every tenth line is broken."""
    at = folder(spark)
    rows = table(spark, d, "documents")
    line = F.to_json(F.struct("text", F.col("lang").alias("label"), F.col("source").alias("label_name")))
    rows.select(F.when(F.col("doc_id") % 10 == 0, F.concat(F.lit("{oops "), line)).otherwise(line).alias("value")).write.text(at)
    got = readers.read_jsonl(spark, at)
    return got.agg(F.count("*").alias("n_read"), F.sum(F.col("_corrupt_record").isNotNull().cast("long")).alias("n_errors"), F.sum(F.length("text")).cast("long").alias("n_chars"))


@query("SELECT doc_id, text, lang FROM documents")
def jsonl_strict_round_trip(spark, d):
    at = folder(spark)
    sinks.write_jsonl(table(spark, d, "documents").select("doc_id", "text", "lang"), at)
    return readers.read_jsonl_strict(spark, at, "doc_id long, text string, lang string")


@query("SELECT count(*) AS n_lines FROM documents WHERE doc_id % 10 <> 0")
def jsonl_merge(spark, d):
    """Lines of a folder that are JSON objects, passed through as they are."""
    at = folder(spark)
    line = F.to_json(F.struct("doc_id", "lang"))
    table(spark, d, "documents").select(F.when(F.col("doc_id") % 10 == 0, F.concat(F.lit("{oops "), line)).otherwise(line).alias("value")).repartition(3).write.text(at)
    return readers.merge_jsonl(spark, f"{at}/*.txt").agg(F.count("*").alias("n_lines"))


@query("SELECT c_custkey, c_name, c_mktsegment FROM customer")
def csv_round_trip(spark, d):
    at = folder(spark)
    rows = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias(" c_custkey "), "c_name", F.col("c_mktsegment").alias("c_mktsegment "))
    rows.write.csv(at, header=True, sep=";", escape='"')
    return readers.read_csv(spark, at, ";").withColumn("c_custkey", F.col("c_custkey").cast("long"))


@query("SELECT count(*) AS n_lines FROM documents WHERE trim(text) <> ''")
def corpus_text_round_trip(spark, d):
    at = folder(spark)
    sinks.write_corpus(table(spark, d, "documents"), at)
    return readers.read_corpus(spark, at).agg(F.count("*").alias("n_lines"))


@query("SELECT CAST(n_nationkey AS BIGINT) AS place, n_name || ' ' || n_name || ' ' || n_name || ' x ' || n_nationkey AS text FROM nation WHERE length(n_name || ' ' || n_name || ' ' || n_name || ' x ' || n_nationkey) > 20")
def article_files(spark, d):
    at = folder(spark)
    rows = table(spark, d, "nation").select("n_nationkey", F.concat_ws("  ", "n_name", "n_name", "n_name", F.lit("x"), "n_nationkey").alias("a"))
    one = rows.agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "a"))).alias("x")).select(F.array_join(F.transform("x", lambda t: t["a"]), "&&&&&&").alias("value"))  # 25 rows
    one.write.text(at)
    return readers.read_articles(spark, at).select(F.col("place").cast("long").alias("place"), "text")


@query("SELECT p_partkey AS answer, p_name AS question, p_brand AS subject FROM part")
def wrapped_records(spark, d):
    """JSON arrays of items, half of them wrapped; a file for every 1000 keys."""
    at = folder(spark)
    item = F.struct(F.col("p_name").alias("question"), F.array("p_brand", "p_type").alias("choices"), F.col("p_partkey").cast("int").alias("answer"), F.col("p_brand").alias("subject"))
    rows = table(spark, d, "part").select(F.floor(F.col("p_partkey") / 1000).alias("file"), F.when(F.col("p_partkey") % 2 == 0, F.to_json(F.struct(item.alias("train")))).otherwise(F.to_json(item)).alias("v"))
    arrays = rows.groupBy("file").agg(F.concat(F.lit("["), F.array_join(F.collect_list("v"), ","), F.lit("]")).alias("value"))
    arrays.write.partitionBy("file").text(at)
    return readers.read_records(spark, at).select(F.col("answer").cast("long").alias("answer"), "question", "subject")


@query("SELECT n_regionkey || '' AS region, count(*) AS n FROM nation GROUP BY 1")
def folder_column(spark, d):
    at = folder(spark)
    table(spark, d, "nation").select(F.to_json(F.struct(F.col("n_name").alias("text"))).alias("value"), F.col("n_regionkey").alias("r")).write.partitionBy("r").text(at)
    rows = readers.with_folder(readers.read_jsonl(spark, [f"{at}/r=*/*.txt"]), "region", r"/r=([^/]+)/")
    return rows.groupBy("region").agg(F.count("*").alias("n"))


@query("SELECT CAST(row_number() OVER (ORDER BY n_nationkey) - 1 AS BIGINT) AS item_idx, n_name AS pred FROM nation QUALIFY n_nationkey % 4 <> 1")
def prediction_dump(spark, d):
    at = folder(spark)
    line = F.to_json(F.struct(F.col("n_name").alias("pred"), (F.col("n_nationkey") % 4 != 1).alias("valid")))
    table(spark, d, "nation").orderBy("n_nationkey").coalesce(1).select(line.alias("value")).write.text(at)
    return readers.read_predictions(spark, at, "pred string, valid boolean").select("item_idx", "pred")


@query("SELECT 'A' || (n_nationkey % 3) AS pred, 'A' || (n_nationkey % 2) AS gold, count(*) AS n FROM nation GROUP BY 1, 2")
def damaged_predictions(spark, d):
    at = folder(spark)
    n = F.col("n_nationkey")
    row = F.concat_ws(" , ", n.cast("string"), F.lit("some text"), F.lit("with, commas"), F.concat(F.lit("A"), (n % 2).cast("string")), F.lit("gold text"), F.concat(F.lit("A"), (n % 3).cast("string")), F.lit("x"), F.lit("True"), F.lit("False"))
    lines = table(spark, d, "nation").agg(F.array_join(F.collect_list(row), "\n").alias("x")).select(F.concat(F.lit("idx,header\n"), "x").alias("value"))
    lines.write.text(at)
    return readers.recover_labels(spark, at, ["A0", "A1", "A2"]).groupBy("pred", "gold").agg(F.count("*").alias("n"))


@query("SELECT CAST(91.25 AS DOUBLE) AS accuracy, CAST(NULL AS DOUBLE) AS f1")
def results_text(spark, d):
    at = folder(spark)
    spark.createDataFrame([("Results\nAccuracy: 91.25 %\nMacro: none",)], "value string").write.text(at)
    return readers.scrape(spark, at, {"accuracy": r"Accuracy: ([0-9.]+)", "f1": r"F1: ([0-9.]+)"}).select("accuracy", "f1")


@query("SELECT n_name AS model, n_nationkey / 25 AS accuracy FROM nation")
def metrics_files(spark, d):
    at = folder(spark)
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for k, name in table(spark, d, "nation").select("n_nationkey", "n_name").collect():  # 25 files
        path = jvm.org.apache.hadoop.fs.Path(f"{at}/x/{name.replace(' ', '~')}_metrics.json")
        out = path.getFileSystem(conf).create(path)
        out.write(bytearray(f'{{"accuracy": {k / 25!r}}}'.encode()))
        out.close()
    rows = readers.read_metrics(spark, at, "accuracy double")
    return rows.select(F.translate(F.url_decode("model"), "~", " ").alias("model"), "accuracy")


@query("SELECT doc_id, text, n_chars FROM documents WHERE lang = 'es'")
def parquet_round_trip(spark, d):
    """A fixed schema on writing, a projection and a filter on reading."""
    at = folder(spark)
    sinks.write_parquet(table(spark, d, "documents"), at, "n_chars long, text string, lang string, doc_id long")
    return readers.read_any(spark, readers.expand(spark, [f"{at}/none*.parquet", f"{at}/*.parquet"])).where("lang = 'es'").select("doc_id", "text", "n_chars")


@query("SELECT doc_id, lang, source FROM documents")
def projected_scan(spark, d):
    """Three columns of a parquet table; texts aren't read."""
    return readers.read_any(spark, [f"{d}/documents.parquet"]).select("doc_id", "lang", "source")


@query("""WITH g AS (SELECT lang, count(*) AS n, round(avg(n_chars) / 1000, 2) AS k FROM documents GROUP BY lang), l AS (SELECT lang, n, printf('%.2f', k) AS k FROM g)
    SELECT unnest(['markdown', 'latex']) AS kind, unnest([string_agg('| ' || lang || ' | ' || n || ' | ' || k || ' |', chr(10) ORDER BY lang), string_agg(lang || ' & ' || n || ' & ' || k || ' ' || repeat(chr(92), 2), chr(10) ORDER BY lang)]) AS body FROM l""")
def report_tables(spark, d):
    """The rows of a report, without its head and foot."""
    rows = table(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("n"), F.round(F.avg("n_chars") / 1000, 2).alias("k")).orderBy("lang")
    markdown, latex = sinks.markdown(rows).splitlines()[2:], sinks.latex(rows).splitlines()[2:-1]
    return spark.createDataFrame([("markdown", "\n".join(markdown)), ("latex", "\n".join(latex))], "kind string, body string")


@query("""SELECT '{"rule":"{\\"stride\\": 4}","counts":{"n":' || count(*) || ',"n_en":' || count(*) FILTER (lang = 'en') || '}}' AS value FROM documents""")
def manifest(spark, d):
    return sinks.manifest({"n": F.count("*"), "n_en": F.count_if(F.col("lang") == "en")}, table(spark, d, "documents"), {"stride": 4})


@query("SELECT lang, count(*) AS n FROM documents GROUP BY lang")
def kept_table(spark, d):
    """Made at the first call, found by its fingerprint at the second."""
    at = folder(spark)
    make = lambda: table(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("n"))
    sinks.kept(spark, at, "by_lang", {"by": "lang"}, make)
    return sinks.kept(spark, at, "by_lang", {"by": "lang"}, lambda: 1 / 0)


@query("SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def windowed_counts(spark, d):
    return EV.windowed_counts(table(spark, d, "events"))


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def streamed_counts(spark, d):
    """The events as a stream, all that is there, in complete mode."""
    source = table(spark, d, "events")
    rows = spark.readStream.schema(source.schema).parquet(f"{d}/events.parquet*")
    at = folder(spark)

    def keep(batch, _):
        batch.write.mode("overwrite").parquet(f"{at}/out")

    q = rows.groupBy("event_type").agg(F.count("*").alias("n")).writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{at}/out")


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts <= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g)
    SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, s""")
def event_sessions(spark, d):
    return EV.sessions(table(spark, d, "events"))
