"""Structured Streaming over read files and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.functions import dna

READS = "name string, seq string, qual string"


def read_stream(spark: SparkSession, path: str, files_per_trigger: int = 16) -> DataFrame:
    """Reads as Parquet files arrive in a folder; the option bounds a batch, which holds producers back."""
    return spark.readStream.schema(READS).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def normalised(reads: DataFrame) -> DataFrame:
    """Names cut, bases in upper case, with the reverse complement; stateless, for batches and streams alike."""
    return reads.select(dna.read_name(F.col("name")).alias("name"), dna.normalised(F.col("seq")).alias("seq"), "qual").withColumn("rseq", dna.reverse_complement(F.col("seq")))


def windowed(events: DataFrame, length: str = "1 hour", late: str = "2 hours", slide: str | None = None) -> DataFrame:
    """``start, event_type, n, total`` by tumbling or sliding windows; rows later than ``late`` are left out of streams."""
    window = F.window("ts", length, slide) if slide else F.window("ts", length)
    return events.withWatermark("ts", late).groupBy(window.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """``user_id, start, end, n``: runs of a user's events with no longer gap."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
