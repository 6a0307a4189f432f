"""Streams that notice what they have lost, sliding rates, and pauses after empty answers.

Reports of a root are numbered from 1. A stream keeps the next number of each
root and the holes below it. A report that fills a hole closes it, one that was
seen before is dropped; a hole that is still open when its time is up, by the
root's own later reports or by the watermark, is written as lost. What is lost
is mended from a snapshot: the paths of a root with a hole, and of a root whose
last number the snapshot has and the stream hasn't, are taken from there.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .live import exactly, run_once

LOG = "kind string, root string, path string, action string, seq long, last_seq long, ts timestamp"


class Holes:
    """The numbers of one root that are missing: stretches (first, last, time at which they count as lost, in milliseconds)."""

    def __init__(self, following: int = 1, open_: list[list[int]] | None = None):
        self.following, self.open = following, open_ or []

    def take(self, seq: int, due: int) -> bool:
        """Take a number in; whether it is new. The numbers left out before it are missing from now on."""
        if seq >= self.following:
            if seq > self.following:
                self.open.append([self.following, seq - 1, due])
            self.following = seq + 1
            return True
        for k, (a, b, until) in enumerate(self.open):
            if a <= seq <= b:
                self.open[k : k + 1] = [h for h in ([a, seq - 1, until], [seq + 1, b, until]) if h[0] <= h[1]]
                return True
        return False

    def lost(self, now: int) -> list[list[int]]:
        """The holes whose time is up; they are no longer waited for."""
        gone = [h for h in self.open if h[2] <= now]
        self.open = [h for h in self.open if h[2] > now]
        return gone


def log_stream(spark: SparkSession, reports_path: str, folder: str, patience: pd.Timedelta = pd.Timedelta(0), late: str = "0 seconds") -> DataFrame:
    """New reports and holes (see LOG; a hole's numbers are seq to last_seq) of the numbered reports at ``reports_path``, by one run; see ``run_once``."""
    schema = spark.read.parquet(reports_path).schema
    reports = spark.readStream.schema(schema).parquet(exactly(reports_path)).withWatermark("ts", late)
    wait = int(patience.total_seconds() * 1000)

    def watch(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held = Holes(*json.loads(state.get[0])) if state.exists else Holes()
        out, now = [], state.getCurrentWatermarkMs()
        if not state.hasTimedOut:
            for r in pd.concat(list(batches)).sort_values(["ts", "seq"]).itertuples(index=False):
                at = int(r.ts.timestamp() * 1000)
                now = max(now, at)
                if held.take(int(r.seq), at + wait):
                    out.append(("report", key[0], r.path, r.action, r.seq, r.seq, r.ts))
        out += [("hole", key[0], None, None, a, b, pd.Timestamp(until, unit="ms")) for a, b, until in held.lost(now)]
        state.update((json.dumps([held.following, held.open]),))
        if held.open:
            state.setTimeoutTimestamp(max(min(h[2] for h in held.open), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["kind", "root", "path", "action", "seq", "last_seq", "ts"])

    return run_once(spark, reports.groupBy("root").applyInPandasWithState(watch, LOG, "held string", "append", "EventTimeTimeout"), folder)


def folded(reports: DataFrame) -> DataFrame:
    """Each path's last action and how many reports it had."""
    return reports.groupBy("root", "path").agg(F.max_by("action", "seq").alias("last_action"), F.count(F.lit(1)).alias("n_events"))


def broken_roots(log: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Roots with a hole, and those whose last number in ``snapshot`` (root, seq) the log hasn't reached."""
    reached = log.filter("kind = 'report'").groupBy("root").agg(F.max("seq").alias("reached"))
    behind = snapshot.groupBy("root").agg(F.max("seq").alias("newest")).join(reached, "root", "left").filter(F.coalesce("reached", F.lit(0)) < F.col("newest"))
    return log.filter("kind = 'hole'").select("root").unionByName(behind.select("root")).distinct()


def mended(log: DataFrame, snapshot: DataFrame) -> DataFrame:
    """root, path, last_action, n_events and mended: the log's reports, and for broken roots what ``snapshot`` (root, path, action, seq) has."""
    broken = broken_roots(log, snapshot)
    whole = folded(log.filter("kind = 'report'").join(broken, "root", "left_anti")).withColumn("mended", F.lit(False))
    return whole.unionByName(folded(snapshot.join(broken, "root", "left_semi")).withColumn("mended", F.lit(True)))


def rates(events: DataFrame, width: str, slide: str) -> DataFrame:
    """started and n_events of each window of so wide a time, one every ``slide``. On a stream, windows that the watermark has passed; their state goes then."""
    counted = events.groupBy(F.window("ts", width, slide).alias("w")).agg(F.count(F.lit(1)).alias("n_events"))
    return counted.select(F.col("w.start").alias("started"), "n_events")


def rates_stream(spark: SparkSession, events_path: str, folder: str, width: str, slide: str, late: str = "0 seconds") -> DataFrame:
    schema = spark.read.parquet(events_path).schema
    events = spark.readStream.schema(schema).parquet(exactly(events_path))
    return run_once(spark, rates(events.select(F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", late), width, slide), folder)


def pauses_stream(spark: SparkSession, answers_path: str, folder: str, empty, after: int, pause: pd.Timedelta, late: str = "0 seconds") -> DataFrame:
    """source, paused_at and until: a source rests for ``pause`` when ``after`` answers in a row were empty; answers while it rests say nothing.

    ``empty`` makes rows (event_id, ts, source, is_empty) of the table at
    ``answers_path``. The state of a source goes when its rest is over, by the
    watermark, and when it has answered.
    """
    schema = spark.read.parquet(answers_path).schema
    answers = empty(spark.readStream.schema(schema).parquet(exactly(answers_path))).withWatermark("ts", late)

    def judge(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        out = []
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame(out, columns=["source", "paused_at", "until"])
            return
        row, until = state.get if state.exists else (0, None)
        until = None if until is None else pd.Timestamp(until)
        for r in pd.concat(list(batches)).sort_values(["ts", "event_id"]).itertuples(index=False):
            if until is not None and r.ts < until:
                continue
            until, row = None, row + 1 if r.is_empty else 0
            if row == after:
                until, row = r.ts + pause, 0
                out.append((key[0], r.ts, until))
        if row or until is not None:
            state.update((row, until))
            # a run of empty answers is kept however long it takes, a rest until it is over
            if not row:
                state.setTimeoutTimestamp(max(int(until.timestamp() * 1000), state.getCurrentWatermarkMs() + 1))
        else:
            state.remove()
        yield pd.DataFrame(out, columns=["source", "paused_at", "until"])

    found = answers.groupBy("source").applyInPandasWithState(judge, "source string, paused_at timestamp, until timestamp", "row long, until timestamp", "append", "EventTimeTimeout")
    return run_once(spark, found, folder)
