"""Incremental ingestion: a file stream of report pages, each content once, and page quality over it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import quality


def page_stream(spark: SparkSession, path: str, schema: str, late: str = "7 days") -> DataFrame:
    """Rows of parquet files as they arrive, repeated deliveries of a paragraph_id within the watermark dropped."""
    rows = spark.readStream.schema(schema).parquet(path).withColumn("ingested_at", F.col("ingested_at").cast("timestamp"))
    return rows.withWatermark("ingested_at", late).dropDuplicatesWithinWatermark(["paragraph_id"])


def quality_stream(stream: DataFrame, text_col: str, out: str, checkpoint: str):
    """Write page metrics of the stream until all that is there has been read."""
    measured = quality.metrics(stream, text_col).select("paragraph_id", "report_id", "word_count", "letters", "mojibake_count", "replacement_count", "text_sha256", "ingested_at")
    return measured.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
