"""Structured Streaming runs of the change-capture operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import changes


def exactly(path: str) -> str:
    """A pattern that only the path itself matches: a stream reads a single file by a pattern alone."""
    return f"{path[:-1]}[{path[-1]}]"


def run_once(spark: SparkSession, rows: DataFrame, folder: str) -> DataFrame:
    """One run of a stream over all that is there now, and all that its runs in ``folder`` have written so far.

    The checkpoint in the folder moves only with a finished batch, so a later run
    goes on where the last one that succeeded has ended.
    """
    place = folder.rstrip("/")
    run = rows.writeStream.outputMode("append").trigger(availableNow=True).option("checkpointLocation", f"{place}/checkpoint").option("path", f"{place}/rows").format("parquet").start()
    run.awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{place}/rows")


def settled_stream(spark: SparkSession, events_path: str, folder: str, late: str = "0 seconds", quiet: str = "1 hour") -> DataFrame:
    """Settled bursts of the events at ``events_path`` (a file or a folder), by one streaming run; see ``run_once``.

    A burst is written once the watermark (``late`` behind the newest event) has
    passed its end, and its state is dropped then. Bursts that are still open aren't written.
    """
    schema = spark.read.parquet(events_path).schema
    events = changes.watch_events(spark.readStream.schema(schema).parquet(exactly(events_path)))
    events = events.withColumn("ts", events["ts"].cast("timestamp")).withWatermark("ts", late)  # a watermark needs a time with a zone
    bursts = run_once(spark, changes.settled(events, quiet), folder)
    return bursts.withColumn("started", bursts["started"].cast(schema["ts"].dataType))
