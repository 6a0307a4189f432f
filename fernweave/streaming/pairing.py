"""Changes as a file system reports them: renames put together, and each path's changes settled, in one pass or as a stream with state.

A report of a new name belongs to the last old name that its root reported and
no other new name has taken; an old name alone says nothing. Changes of a path
with no more than ``quiet`` between them are one burst: its action is the last
one's, but what comes back right after it was removed counts as added, and the
last old path is kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .live import exactly, run_once

#: Microseconds of a root's reports that are put in order together.
SLICE = 3_600_000_000
#: The actions of a rename, and renames that a worker gives back at a time.
HALVES, AT_ONCE = pd.CategoricalDtype(["renamed_old", "renamed_new"]), 100_000
BURST = "path string, action string, old_path string, started timestamp, n_events long"


def reported(events: DataFrame) -> DataFrame:
    """The events table as reports (event_id, ts, root, path, action); purchases are the two halves of renames."""
    kind = F.col("event_type")
    half = F.when(F.col("event_id") % 2 == 0, "renamed_old").otherwise("renamed_new")
    action = F.when(kind == "signup", "added").when(kind == "error", "removed").when(kind == "purchase", half).otherwise("modified")
    root = F.concat(F.lit("/watched/r"), (F.col("user_id") % 7).cast("string"))
    return events.select("event_id", F.col("ts").cast("timestamp").alias("ts"), root.alias("root"), F.concat(root, F.lit("/"), F.col("user_id").cast("string")).alias("path"), action.alias("action"))


def paired(reports: DataFrame) -> DataFrame:
    """event_id, ts, path, action and old_path: the two halves of a rename as one change.

    Only renames are put in order, those of a root and an hour in one task; the
    last one of an hour is handed on to the root's next hour that has any.
    """
    renames = reports.filter(F.col("action").isin("renamed_old", "renamed_new")).withColumn("slice", F.floor(F.unix_micros("ts") / SLICE))
    last = renames.groupBy("root", "slice").agg(F.max_by(F.struct("action", "path"), F.struct("ts", "event_id")).alias("last"))
    # a row for each hour of a root
    handed = last.select("root", "slice", F.lag("last").over(Window.partitionBy("root").orderBy("slice")).alias("handed"))
    order = Window.partitionBy("root", "slice").orderBy("ts", "event_id")
    before = F.coalesce(F.lag(F.struct("action", "path")).over(order), F.col("handed"))
    renames = renames.join(handed, ["root", "slice"]).withColumn("before", before).filter("action = 'renamed_new'")
    renames = renames.withColumn("old_path", F.when(F.col("before.action") == "renamed_old", F.col("before.path")))
    others = reports.filter(~F.col("action").isin("renamed_old", "renamed_new"))
    none = F.lit(None).cast("string")
    return others.select("event_id", "ts", "path", "action", none.alias("old_path")).unionByName(renames.select("event_id", "ts", "path", F.lit("renamed").alias("action"), "old_path"))


def coalesced(changes: DataFrame, quiet: str = "1 hour") -> DataFrame:
    """path, action, old_path, started and n_events of each burst of ``changes`` (event_id, ts, path, action, old_path)."""
    before = Window.partitionBy("path").orderBy("ts", "event_id")
    again = F.col("action").isin("modified", "added") & (F.lag("action").over(before) == "removed") & (F.lag("ts").over(before) + F.expr(f"interval {quiet}") >= F.col("ts"))
    at = F.struct("ts", "event_id")
    marked = changes.withColumn("action", F.when(again, "added").otherwise(F.col("action")))
    bursts = marked.groupBy("path", F.session_window("ts", quiet).alias("w")).agg(F.max_by("action", at).alias("action"), F.max_by("old_path", F.when(F.col("old_path").isNotNull(), at)).alias("old_path"), F.count(F.lit(1)).alias("n_events"))
    return bursts.select("path", "action", "old_path", F.col("w.start").alias("started"), "n_events")


def coalesced_stream(spark: SparkSession, reports_path: str, folder: str, quiet: pd.Timedelta = pd.Timedelta(hours=1), late: str = "0 seconds") -> DataFrame:
    """``coalesced(paired(...))`` of the events at ``reports_path`` as a stream; bursts whose end the watermark hasn't passed aren't written.

    Three queries: the first two write paired changes and all others, which need
    no state and so pass through no worker; the last, with a state by path, reads
    both. ``folder`` keeps the checkpoints: a later run goes on from there, and one
    that fails has not moved them.
    """
    place = folder.rstrip("/")
    schema = spark.read.parquet(reports_path).schema
    reports = reported(spark.readStream.schema(schema).parquet(exactly(reports_path)))

    def pair(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        """One root's renames of a batch, as columns; the state is the old name that waits for its new one."""
        waits = state.get[0] if state.exists else None
        rows = pd.concat([b[["event_id", "ts", "path", "action"]].astype({"action": HALVES}) for b in batches], ignore_index=True).sort_values(["ts", "event_id"], ignore_index=True)
        olds = rows["action"] == "renamed_old"
        rows["old_path"] = rows["path"].where(olds).shift(fill_value=waits)  # of the report just before, where that is an old name
        state.update((rows["path"].iloc[-1] if olds.iloc[-1] else None,))
        rows["action"] = "renamed"
        for at in range(0, len(rows), AT_ONCE):
            yield rows.iloc[at : at + AT_ONCE][~olds.iloc[at : at + AT_ONCE]].astype({"old_path": object}).replace({"old_path": {float("nan"): None}})

    shape = "event_id long, ts timestamp, path string, action string, old_path string"
    halves = F.col("action").isin(*HALVES.categories)
    run_once(spark, reports.filter(halves).groupBy("root").applyInPandasWithState(pair, shape, "old string", "append", "NoTimeout"), f"{place}/changes")
    run_once(spark, reports.filter(~halves).select("event_id", "ts", "path", "action", F.lit(None).cast("string").alias("old_path")), f"{place}/others")
    written = [spark.readStream.schema(shape).parquet(f"{place}/{name}/rows") for name in ("changes", "others")]
    changes = written[0].unionByName(written[1]).withWatermark("ts", late)

    def settle(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        """One path's open burst (action, old_path, started, last, n) and its changes of a batch."""
        held, done = state.get if state.exists else None, []
        if state.hasTimedOut:
            done.append((key[0], *held[:3], held[4]))
            held = None
        else:
            for r in pd.concat(list(batches)).sort_values(["ts", "event_id"]).itertuples(index=False):
                if held and r.ts - pd.Timestamp(held[3]) > quiet:
                    done.append((key[0], *held[:3], held[4]))
                    held = None
                back = held and held[0] == "removed" and r.action in ("modified", "added")
                old = r.old_path if isinstance(r.old_path, str) else held[1] if held else None
                held = ("added" if back else r.action, old, held[2] if held else r.ts, r.ts, held[4] + 1 if held else 1)
        if held:
            state.update(held)
            state.setTimeoutTimestamp(max(int((pd.Timestamp(held[3]) + quiet).timestamp() * 1000), state.getCurrentWatermarkMs() + 1))
        else:
            state.remove()
        yield pd.DataFrame(done, columns=["path", "action", "old_path", "started", "n_events"])

    bursts = changes.groupBy("path").applyInPandasWithState(settle, BURST, "action string, old_path string, started timestamp, last timestamp, n long", "append", "EventTimeTimeout")
    return run_once(spark, bursts, f"{place}/bursts")
