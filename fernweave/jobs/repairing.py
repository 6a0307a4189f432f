"""Registered queries: streams with lost reports, sliding rates, pauses."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.corpus import shared_dir, table
from ..streaming import changes, repair
from .queries import query

_NUMBERED = "s AS (SELECT event_id, ts, '/watched/' || user_id AS root, '/watched/' || user_id || '/' || event_id % 5 AS path, CASE event_type WHEN 'signup' THEN 'added' WHEN 'error' THEN 'removed' WHEN 'purchase' THEN 'renamed' ELSE 'modified' END AS action, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq FROM events)"


def _numbered(spark, sf_dir) -> DataFrame:
    """The events as reports of 150 roots, each numbered from 1 as its source would do it."""
    root = F.concat(F.lit("/watched/"), F.col("user_id").cast("string"))
    seq = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long")
    rows = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), root.alias("root"), F.concat(root, F.lit("/"), F.col("event_id") % 5).alias("path"), changes.action_of(F.col("event_type")).alias("action"), seq.alias("seq"))
    return rows


@query(f"WITH {_NUMBERED} SELECT path, last(action ORDER BY seq) AS last_action, count(*) AS n_events, (SELECT count(*) FROM s l WHERE l.root = any_value(s.root) AND l.event_id % 401 = 0) > 0 AS mended FROM s GROUP BY path")
def lost_events_mended(spark, sf_dir):
    """Every 401st report is lost, every 19th comes twice: the stream finds the holes, and what is lost is mended from a snapshot."""
    snapshot = _numbered(spark, sf_dir)
    place = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    came = snapshot.filter("event_id % 401 <> 0")
    came.unionByName(came.filter("event_id % 19 = 0")).drop("event_id").write.parquet(f"{place}/delivered")
    log = repair.log_stream(spark, f"{place}/delivered", f"{place}/log")
    return repair.mended(log, snapshot.drop("event_id", "ts")).select("path", "last_action", "n_events", "mended")


@query("""WITH w AS (SELECT time_bucket(INTERVAL 10 MINUTE, ts) - to_minutes((10 * unnest(range(0, 6)))::INTEGER) AS started FROM events)
SELECT epoch_us(started) AS started, count(*) AS n_events FROM w WHERE started + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) GROUP BY started""")
def sliding_rate_stream(spark, sf_dir):
    """Events of each hour, one every ten minutes, as a stream that drops the state of windows it has written."""
    found = repair.rates_stream(spark, f"{sf_dir}/events.parquet", f"{shared_dir(spark)}/{uuid.uuid4().hex}", "1 hour", "10 minutes")
    return found.select(F.unix_micros("started").alias("started"), "n_events")


def _answers(events: DataFrame) -> DataFrame:
    return events.select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").cast("string").alias("source"), F.col("event_type").isin("click", "view").alias("is_empty"))


@query("""WITH RECURSIVE e AS (SELECT user_id::VARCHAR AS source, epoch_us(ts) AS us, event_type IN ('click', 'view') AS hollow, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
r AS (SELECT source, 0::BIGINT AS i, 0 AS n, 0::BIGINT AS until, false AS paused, 0::BIGINT AS us FROM (SELECT DISTINCT source FROM e)
 UNION ALL SELECT r.source, e.i, CASE WHEN e.us < r.until THEN r.n WHEN NOT hollow THEN 0 WHEN r.n = 2 THEN 0 ELSE r.n + 1 END, CASE WHEN e.us >= r.until AND hollow AND r.n = 2 THEN e.us + 21600000000 ELSE r.until END, e.us >= r.until AND hollow AND r.n = 2, e.us
 FROM r JOIN e ON e.source = r.source AND e.i = r.i + 1)
SELECT source, us AS paused_at, until FROM r WHERE paused""")
def pauses_stream(spark, sf_dir):
    """Sources rest for six hours after three empty answers in a row, which clicks and views stand for here."""
    found = repair.pauses_stream(spark, f"{sf_dir}/events.parquet", f"{shared_dir(spark)}/{uuid.uuid4().hex}", _answers, 3, pd.Timedelta(hours=6))
    return found.select("source", F.unix_micros("paused_at").alias("paused_at"), F.unix_micros("until").alias("until"))
