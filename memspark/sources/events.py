"""Event logs and the event envelope."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memspark.streaming.stateful import drain

# Fixed values.
EVENT_TYPES = (
    "memory.created", "memory.updated", "memory.deleted", "memory.conflict", "knowledge.merged", "emotion.changed", "dream.finished",
)
LOG_SCHEMA = "data struct<action:string, memory_id:string, source:string, timestamp:string>"
EVENT_SCHEMA = "event_type string, payload map<string,string>, source string, timestamp string"


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """The log files of a folder as a stream of lines; the checkpoint of the query remembers what was read."""
    return spark.readStream.format("text").load(path)


def load_log(spark: SparkSession, path: str, out: str, checkpoint: str) -> DataFrame:
    """Take the lines that came since the last call, and give all entries taken so far, each once.

    The checkpoint is the cursor: it remembers the files read, so a call after a lost job goes on where that one stopped.
    A log grows by files; lines added to a file that was already read are not seen.
    """
    return drain(parse_log(read_log(spark, path)), out, checkpoint)


def parse_log(lines: DataFrame) -> DataFrame:
    """Columns of the log entries in ``value``; malformed lines are dropped."""
    entry = F.from_json("value", LOG_SCHEMA)
    return lines.select(entry.alias("e")).filter("e.data is not null").select("e.data.*")


def stored_elsewhere(entries: DataFrame, own_source: str) -> DataFrame:
    """Entries that store a row and come from another component; a missing source counts as another."""
    return entries.filter((F.col("action") == "store") & ~F.col("source").eqNullSafe(F.lit(own_source)))


def encode_events(events: DataFrame) -> DataFrame:
    """Events (event_type, payload, source, timestamp) as one JSON text each."""
    return events.select(F.to_json(F.struct("event_type", "payload", "source", "timestamp")).alias("value"))


def decode_events(lines: DataFrame) -> DataFrame:
    """JSON texts back to events; rows that are no JSON or of an unknown type are dropped."""
    e = lines.select(F.from_json("value", EVENT_SCHEMA).alias("e")).select("e.*")
    return e.filter(F.col("event_type").isin(*EVENT_TYPES))
