"""Pages and events as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodestone.functions import text as T

PAGES = "page_id long, document_id string, document_name string, source_path string, page int, text string, ingested_at timestamp_ntz"
EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def pages(spark: SparkSession, folder: str, files_each: int = 100) -> DataFrame:
    """Pages from the parquet files that arrive in a folder."""
    return spark.readStream.schema(PAGES).option("maxFilesPerTrigger", files_each).parquet(folder)


def once(stream: DataFrame, delay: str = "1 day") -> DataFrame:
    """Each page once, though delivered again within ``delay``; a later repetition than that passes."""
    return stream.withColumn("at", F.col("ingested_at").cast("timestamp")).withWatermark("at", delay).dropDuplicatesWithinWatermark(["page_id"]).drop("at")


def append_cleaned(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append cleaned pages with their headings and token counts to a table; stops when all that is there is done."""
    rows = stream.select("page_id", "document_id", "page", T.clean_page(F.col("text")).alias("text"), T.heading(F.col("text")).alias("heading"), T.token_count(F.col("text")).alias("tokens"))
    return rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def windows(events: DataFrame, width: str = "1 hour", delay: str = "2 hours") -> DataFrame:
    """Events and values by window and type; what comes later than ``delay`` is dropped."""
    timed = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", delay)
    return timed.groupBy(F.window("at", width), "event_type").agg(F.count("*").alias("events"), F.sum("value").alias("total"))
