"""Change capture: settle windows, throughput, and what a path's changes come to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def settled(events: DataFrame, quiet: str = "1 hour") -> DataFrame:
    """Bursts of one path with no gap of over ``quiet``: their bounds, size and last action. Works on a stream after a watermark."""
    return (
        events.groupBy("path", F.session_window("ts", quiet).alias("w"))
        .agg(F.count(F.lit(1)).alias("n_events"), F.max_by("action", F.struct("ts", "event_id")).alias("last_action"))
        .select("path", F.col("w.start").alias("started"), "n_events", "last_action")
    )


def throughput(events: DataFrame, width: str = "1 day") -> DataFrame:
    return events.groupBy(F.window("ts", width).alias("w"), "action").agg(F.count(F.lit(1)).alias("n_events")).select(F.col("w.start").alias("started"), "action", "n_events")


def action_of(event_type: Column) -> Column:
    """The events table's types as actions on a path."""
    return F.when(event_type == "signup", "added").when(event_type == "error", "removed").when(event_type == "purchase", "renamed").otherwise("modified")


def watch_events(events: DataFrame) -> DataFrame:
    return events.select("event_id", "ts", F.concat(F.lit("/watched/"), F.col("user_id").cast("string")).alias("path"), action_of(F.col("event_type")).alias("action"))


def streaks(events: DataFrame, action: str, least: int) -> DataFrame:
    """Runs of at least so many consecutive events of one action on a path."""
    order = Window.partitionBy("path").orderBy("ts", "event_id")
    marked = events.withColumn("island", F.row_number().over(order) - F.row_number().over(Window.partitionBy("path", "action").orderBy("ts", "event_id")))
    runs = marked.filter(F.col("action") == action).groupBy("path", "island").agg(F.min("ts").alias("started"), F.count(F.lit(1)).alias("n_events"))
    return runs.filter(F.col("n_events") >= least).select("path", "started", "n_events")
