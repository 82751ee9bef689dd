"""Writers: JSON lines, parquet, text corpora, manifests, small report tables, and tables kept by fingerprint."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwright.functions import text as T


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.json(path)


def write_parquet(df: DataFrame, path: str, schema: str | None = None) -> None:
    """zstd; with a schema the columns are cast to it, in its order."""
    if schema:
        from pyspark.sql.types import _parse_datatype_string

        df = df.select(*[F.col(f.name).cast(f.dataType) for f in _parse_datatype_string(schema).fields])
    df.write.option("compression", "zstd").parquet(path)


def write_corpus(df: DataFrame, path: str, text: str = "text") -> None:
    """A document a line: newlines inside become spaces, empty ones go."""
    df.select(T.export_line(F.col(text)).alias("value")).where("value <> ''").write.text(path)


def manifest(counts: dict[str, Column], df: DataFrame, rule: dict) -> DataFrame:
    """One row with a JSON document: the rule and the counts."""
    one = df.agg(*[c.alias(n) for n, c in counts.items()])
    return one.select(F.to_json(F.struct(F.lit(json.dumps(rule, sort_keys=True)).alias("rule"), F.struct(*counts).alias("counts"))).alias("value"))


def report_rows(df: DataFrame, most: int) -> list:
    """All rows of a report; more than `most` are an error, as no report is cut."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report of more than {most} rows: write a table instead")
    return rows


def markdown(df: DataFrame, digits: int = 2, most: int = 10_000) -> str:
    """A small result as a markdown table."""
    rows = report_rows(df, most)
    show = lambda v: "" if v is None else f"{v:.{digits}f}" if isinstance(v, float) else str(v)
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join(show(v) for v in r) + " |" for r in rows]) + "\n"


def latex_escape(s: str) -> str:
    for c in "&%$#_{}":
        s = s.replace(c, "\\" + c)
    return s


def latex(df: DataFrame, digits: int = 2, most: int = 10_000) -> str:
    rows = report_rows(df, most)
    show = lambda v: "--" if v is None else f"{v:.{digits}f}" if isinstance(v, float) else latex_escape(str(v))
    body = [" & ".join(show(v) for v in r) + r" \\" for r in rows]
    head = " & ".join(latex_escape(c) for c in df.columns) + r" \\ \hline"
    return "\n".join([r"\begin{tabular}{" + "l" * len(df.columns) + "}", head, *body, r"\end{tabular}"]) + "\n"


def plain(df: DataFrame, digits: int = 2, most: int = 10_000) -> str:
    rows = [[str(c) for c in df.columns]] + [["" if v is None else f"{v:.{digits}f}" if isinstance(v, float) else str(v) for v in r] for r in report_rows(df, most)]
    wide = [max(len(r[k]) for r in rows) for k in range(len(df.columns))]
    return "\n".join("  ".join(x.ljust(w) for x, w in zip(r, wide)).rstrip() for r in rows) + "\n"


def kept(spark: SparkSession, folder: str, name: str, settings: dict, make: Callable[[], DataFrame]) -> DataFrame:
    """The table that these settings make, written once under a name with their fingerprint."""
    key = hashlib.sha1(json.dumps(settings, sort_keys=True, ensure_ascii=False).encode()).hexdigest()[:10]
    path = f"{folder}/{name}_{key}"
    jvm = spark.sparkContext._jvm
    done = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
