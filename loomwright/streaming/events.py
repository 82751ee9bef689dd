"""The engine's own extension to streams: the same cleaning and counting over files as they land."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwright.functions import text as T


def windowed_counts(events: DataFrame, time: str = "ts", key: str = "event_type", width: str = "1 day", late: str = "1 day", value: str = "value") -> DataFrame:
    """Counts and sums by tumbling window; the same for a batch and, with a watermark, for a stream."""
    rows = events.withWatermark(time, late) if events.isStreaming else events
    out = rows.groupBy(F.window(time, width).alias("w"), key).agg(F.count("*").alias("n"), F.round(F.sum(value), 4).alias("total"))
    return out.select(F.col("w.start").alias("start"), key, "n", "total")


def sessions(events: DataFrame, time: str = "ts", key: str = "user_id", gap: str = "30 minutes") -> DataFrame:
    rows = events.withWatermark(time, gap) if events.isStreaming else events
    return rows.groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), "n")


def run_available(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Everything that has landed, once, exactly once to parquet."""
    q = df.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def clean_landing(spark: SparkSession, landing: str, schema: str, path: str, checkpoint: str, text: str = "text") -> None:
    """Texts of a landing folder, cleaned, with their token counts."""
    rows = spark.readStream.schema(schema).parquet(landing)
    out = rows.withColumn(text, T.clean_artifacts(T.empty_if_null(F.col(text)), passes=1)).withColumn("n_tokens", T.token_count(F.col(text)))
    run_available(out, path, checkpoint)
