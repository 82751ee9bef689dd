"""Readers of the file kinds that corpora, predictions and reports come in.

All go through Spark's readers, so any file system that Spark knows will do; nothing is opened locally.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwright.functions import text as X

DIALOGUE = "prompt string, prompt_id string, messages array<struct<content:string,role:string>>, language string"
ITEM = "question string, choices array<string>, answer int, subject string, metadata struct<subject_original:string>"
RECORD = "text string, label string, label_name string"


def expand(spark: SparkSession, patterns: str | list[str], what: str = "files") -> list[str]:
    """The files of the first pattern that matches any: a chain of fallbacks, not a union."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for p in [patterns] if isinstance(patterns, str) else patterns:
        path = jvm.org.apache.hadoop.fs.Path(p)
        found = path.getFileSystem(conf).globStatus(path)
        if found:
            return sorted(f.getPath().toString() for f in found)
    raise FileNotFoundError(f"no {what}: {patterns}")


def resolve_split(spark: SparkSession, folders: list[str], split: str, endings: tuple[str, ...] = ("parquet", "jsonl")) -> list[str]:
    """A split's files: the first folder and ending that has any."""
    return expand(spark, [f"{d}/{split}*.{e}" for d in folders for e in endings], split)


def read_any(spark: SparkSession, paths: list[str], schema: str | None = None) -> DataFrame:
    """Parquet or JSON lines, by the ending."""
    if paths[0].endswith(".parquet"):
        return spark.read.parquet(*paths)
    return (spark.read.schema(schema) if schema else spark.read).json(paths)


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """file, value of the lines that aren't blank, stripped."""
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), X.strip(F.col("value")).alias("value"))
    return rows.where("value <> ''")


def read_jsonl(spark: SparkSession, path: str | list[str], schema: str = RECORD) -> DataFrame:
    """Tolerant: the fields, and _corrupt_record with the line where it is no JSON object."""
    fields = T._parse_datatype_string(schema).add("_corrupt_record", "string")
    rows = read_lines(spark, path)
    return rows.select("file", F.from_json("value", fields, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}).alias("r")).select("file", "r.*")


def read_jsonl_strict(spark: SparkSession, path: str | list[str], schema: str = RECORD) -> DataFrame:
    """The first bad line is an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def jsonl_errors(rows: DataFrame) -> DataFrame:
    """file, n_read and n_errors."""
    bad = F.col("_corrupt_record").isNotNull()
    return rows.groupBy("file").agg(F.count_if(~bad).alias("n_read"), F.count_if(bad).alias("n_errors"))


def merge_jsonl(spark: SparkSession, pattern: str) -> DataFrame:
    """file and the raw lines of a folder that are JSON objects."""
    rows = read_lines(spark, pattern)
    return rows.where(F.try_parse_json("value").isNotNull())


def read_corpus(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """A text corpus: a document a line."""
    return read_lines(spark, path).select(F.col("value").alias("text"))


def read_articles(spark: SparkSession, path: str | list[str], least: int = 20) -> DataFrame:
    """Articles of whole files, with five ampersands or more between them, longer than `least`."""
    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.split("value", "&{5,}")).alias("place", "text"))
    return rows.withColumn("text", X.collapse_ws(F.col("text"))).where(F.length("text") > least)


def read_csv(spark: SparkSession, path: str | list[str], sep: str = ",") -> DataFrame:
    """All columns as strings, nothing taken for missing; header names are stripped; quoted newlines stay."""
    rows = spark.read.csv(path, sep=sep, header=True, multiLine=True, escape='"', inferSchema=False)
    names = [c.strip() for c in rows.columns]
    return rows.toDF(*names).select(*[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in names])


def read_records(spark: SparkSession, path: str | list[str], schema: str = ITEM) -> DataFrame:
    """A JSON array of items, each bare or wrapped as {"train": item}; with file."""
    item = T._parse_datatype_string(schema)
    rows = spark.read.schema(T.StructType([*item.fields, T.StructField("train", item)])).option("multiLine", True).json(path)
    return rows.select(F.col("_metadata.file_path").alias("file"), *[F.coalesce(F.col(f"train.{f.name}"), F.col(f.name)).alias(f.name) for f in item.fields])


def with_folder(rows: DataFrame, name: str, pattern: str = r"/([^/]+)/[^/]+\z") -> DataFrame:
    """A column from the file's path: by default its folder."""
    return rows.withColumn(name, F.regexp_extract("file", pattern, 1))


def read_predictions(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    """A dump's valid rows with item_idx, the line's number within its file.  Lines of one file are read in
    one piece, so that their numbers are right."""
    lines = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.split("value", "\n")).alias("item_idx", "value"))
    rows = lines.where("trim(value) <> ''").select("file", F.col("item_idx").cast("long").alias("item_idx"), F.from_json("value", schema).alias("r")).select("file", "item_idx", "r.*")
    return rows.where(F.coalesce(F.col("valid"), F.lit(True))) if "valid" in rows.columns else rows


def read_metrics(spark: SparkSession, pattern: str, schema: str) -> DataFrame:
    """Metrics documents; model is the file's name less _metrics.json."""
    rows = spark.read.schema(schema).option("multiLine", True).option("recursiveFileLookup", True).json(pattern)
    return rows.withColumn("model", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)_metrics\.json\z", 1))


def discover(spark: SparkSession, folder: str, name: str, exclude: str) -> DataFrame:
    """path of the files below a folder by name, without those whose path contains `exclude`."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", name).load(folder).select("path")
    return rows.where(~F.contains("path", F.lit(exclude))).orderBy("path")


def recover_labels(spark: SparkSession, path: str | list[str], labels: list[str]) -> DataFrame:
    """file, pred, gold, correct of a damaged prediction CSV: the last two fields are valid and correct, the
    first label to their left is the prediction, the next one the gold label.  A file with a row that can't be
    read has no rows at all."""
    lines = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.split("value", "\r?\n")).alias("i", "line")).where("i > 0 and trim(line) <> ''")
    rows = lines.select("file", "i", F.reverse(F.transform(F.split("line", ","), lambda x: F.trim(x))).alias("t")).where(F.size("t") >= 6)
    found = F.filter(F.slice("t", 3, F.greatest(F.size("t") - 2, F.lit(0))), lambda x: x.isin(labels))
    flags = lambda k: F.get("t", F.lit(k)).isin("True", "False")
    rows = rows.select("file", "i", F.get(found, F.lit(0)).alias("pred"), F.get(found, F.lit(1)).alias("gold"), (flags(0) & flags(1)).alias("ok"))
    bad = rows.where(~F.col("ok") | F.col("gold").isNull()).select("file").distinct()
    return rows.join(bad, "file", "left_anti").select("file", "i", "pred", "gold", (F.col("pred") == F.col("gold")).alias("correct"))


def scrape(spark: SparkSession, path: str | list[str], patterns: dict[str, str]) -> DataFrame:
    """A column for each pattern's first group in a results text; null where it has none."""
    rows = spark.read.text(path, wholetext=True)
    return rows.select(F.col("_metadata.file_path").alias("file"), *[F.nullif(F.regexp_extract("value", p, 1), F.lit("")).try_cast("double").alias(n) for n, p in patterns.items()])


def tensor_shards(spark: SparkSession, folder: str, names: str = r".*", index: str = "*.index.json", single: str = "model.safetensors") -> DataFrame:
    """name and shard of the tensors whose names match, from the folder's index (its weight_map); a folder
    without one has a single file, which is the shard of one row with a null name: all that it holds."""
    try:
        path = expand(spark, f"{folder}/{index}")[0]
    except FileNotFoundError:
        return spark.createDataFrame([(None, expand(spark, f"{folder}/{single}")[0])], "name string, shard string")
    rows = spark.read.schema("weight_map map<string,string>").option("multiLine", True).json(path)
    rows = rows.select(F.explode("weight_map").alias("name", "file")).where(F.col("name").rlike(names))
    return rows.select("name", F.concat(F.lit(folder.rstrip("/") + "/"), "file").alias("shard"))


def read_tensors(spark: SparkSession, rows: DataFrame, load) -> DataFrame:
    """rows: name, shard.  load(shard, names) yields (name, row, values); a task reads its own shards, each
    once.  For formats of weights that Spark doesn't know."""
    import pandas as pd

    def run(it):
        for pdf in it:
            for shard, own in pdf.groupby("shard"):
                for name, row, vals in load(shard, list(own["name"])):
                    yield pd.DataFrame({"name": [name], "row": [row], "vals": [vals]})

    shards = rows.select("name", "shard").repartition("shard")
    return shards.mapInPandas(run, "name string, row long, vals array<float>")


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """item_idx by an order within each file."""
    return rows.withColumn("item_idx", F.row_number().over(Window.partitionBy("file").orderBy(*order)) - 1)
