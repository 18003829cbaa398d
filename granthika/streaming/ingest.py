"""Resumable ingestion: passages arriving as files, each distinct text written once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from granthika.functions.text import content_id
from granthika.sources.tables import not_blank, strip


def source_stream(spark: SparkSession, folder: str, schema: StructType, files_per_trigger: int = 8) -> DataFrame:
    """Rows of Parquet files as they arrive in ``folder``."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def distinct_passages(rows: DataFrame, delay: str | None = None, event_time: str = "loaded_at") -> DataFrame:
    """``doc_id, text, lang``: every passage text once, over all batches and restarts.

    With ``delay`` the ids of texts older than the watermark are forgotten, which bounds the state;
    without it every id is kept, as a full deduplication needs.
    """
    passages = extracted_with(rows, event_time)
    if delay is None:
        return passages.dropDuplicates(["doc_id"]).select("doc_id", "text", "lang")
    return passages.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(["doc_id"]).select("doc_id", "text", "lang")


def extracted_with(rows: DataFrame, event_time: str) -> DataFrame:
    """Passages with their content id and the row's event time (null times count as the epoch)."""
    at = F.coalesce(F.col(event_time).cast("timestamp"), F.timestamp_seconds(F.lit(0)))
    flat = rows.select("row_id", "lang", at.alias(event_time), F.explode("passages.Translated_passages").alias("_t"))
    return flat.where(not_blank(F.col("_t"))).select(event_time, "lang", strip(F.col("_t")).alias("text")).withColumn("doc_id", content_id(F.col("text")))


def run_once(stream: DataFrame, out: str, checkpoint: str) -> None:
    """Write all that has arrived and stop; a later call goes on where this one ended."""
    query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
