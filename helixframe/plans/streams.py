"""Queries over events in time, batch forms of the streaming operators, and one stream run to its end."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from helixframe.operators import synth
from helixframe.streaming import reads

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def windowed_events(spark, sf_dir):
    """Events by hour and type."""
    rows = reads.windowed(synth.table(spark, sf_dir, "events"))
    return rows.select(synth.since_epoch("start").alias("start"), "event_type", "n")


def event_sessions(spark, sf_dir):
    """Runs of a user's events with gaps under half an hour."""
    rows = reads.sessions(synth.table(spark, sf_dir, "events"))
    return rows.select("user_id", synth.since_epoch("start", "MICROSECOND").alias("start"), synth.since_epoch("`end`", "MICROSECOND").alias("end"), "n")


def read_stream_normalised(spark, sf_dir):
    """Reads streamed from Parquet in the shared folder through normalisation into a table."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.sql.warehouse.dir")
    top = f"{root.rstrip('/')}/stream-{uuid.uuid4().hex}"
    synth.reads(spark, sf_dir).select(F.concat(F.lit("@"), F.col("name"), F.lit(" lane/1")).alias("name"), F.lower("seq").alias("seq"), F.repeat(F.lit("I"), F.lit(100)).alias("qual")).write.parquet(f"{top}/in")
    stream = reads.normalised(reads.read_stream(spark, f"{top}/in"))
    stream.writeStream.format("parquet").option("path", f"{top}/out").option("checkpointLocation", f"{top}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("name string, seq string, qual string, rseq string").parquet(f"{top}/out").select("name", "seq", "rseq")


QUERIES = {f.__name__: f for f in (windowed_events, event_sessions, read_stream_normalised)}
ORACLES = {
    "windowed_events": "SELECT epoch(date_trunc('hour', ts))::BIGINT AS start, event_type, count(*) AS n FROM events GROUP BY ALL",
    "event_sessions": """WITH s AS (SELECT user_id, epoch_us(ts) AS t, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) < 1800000000 THEN 0 ELSE 1 END AS fresh FROM events),
    g AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS session FROM s)
    SELECT user_id, min(t) AS start, max(t) + 1800000000 AS "end", count(*) AS n FROM g GROUP BY user_id, session""",
    "read_stream_normalised": f"WITH {synth.READS_SQL} SELECT name, seq, reverse(translate(seq, 'ACGT', 'TGCA')) AS rseq FROM reads",
}
