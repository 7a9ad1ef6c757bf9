"""Live views of append-only event logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENT = "timestamp timestamp, job int, part string, stage string, detail string"


def tail_events(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """The events of all runs below a folder (batches/<run>/batch.jsonl) as a
    stream, with the run they belong to."""
    reader = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", files_per_trigger)
    events = reader.json(f"{folder}/*/")
    return events.withColumn("run", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+$", 1))


def latest_stages(events: DataFrame) -> DataFrame:
    """The last stage of every job of every run; works on streams in update
    mode and on tables. State is one row per job."""
    last = F.max_by(F.struct("stage", "detail"), F.struct("timestamp", "stage")).alias("last")
    return events.where("job is not null").groupBy("run", "job", "part").agg(last, F.max("timestamp").alias("timestamp")).select("run", "job", "part", "last.stage", "last.detail", "timestamp")


def counts_per_window(events: DataFrame, window: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Events per window and stage; rows later than the watermark are dropped
    by the stream and old state with them."""
    kept = events.withWatermark("timestamp", late)
    return kept.groupBy(F.window("timestamp", window), "stage").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), "stage", "n")


def new_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Files that arrive in a folder, as a stream of (path, content_hash)."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").load(folder)
    return files.where(F.endswith(F.lower("path"), F.lit(".pdf"))).select("path", F.sha2("content", 256).alias("content_hash"))
