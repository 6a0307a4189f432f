"""Numbered reports with losses, late ones and repeats; sliding rates and pauses over several runs."""

import random
from datetime import datetime, timedelta

import pandas as pd
from pyspark.sql import functions as F

from fernweave.streaming import repair

SHAPE = "root string, path string, action string, seq long, ts timestamp"
START = datetime(2024, 1, 1)


def test_holes():
    """Whatever the order, what was neither taken nor given up is open, and nothing is new twice."""
    rng = random.Random(1)
    for _ in range(300):
        held, seen, lost = repair.Holes(), set(), set()
        for now in range(rng.randint(0, 40)):
            seq = rng.randint(1, 25)
            fresh = held.take(seq, now + 5)
            assert fresh == (seq not in seen and seq not in lost)
            if fresh:
                seen.add(seq)
            for a, b, due in held.lost(now):
                assert due <= now
                lost |= set(range(a, b + 1))
            missing = {s for a, b, _ in held.open for s in range(a, b + 1)}
            assert missing == set(range(1, held.following)) - seen - lost


def reports(rows):
    return [(root, f"{root}/{seq % 2}", "removed" if seq % 3 == 0 else "modified", seq, START + timedelta(minutes=minute)) for root, seq, minute in rows]


def test_lost_and_late(spark, tmp_path):
    """A hole is waited for, filled by a later run or given up, and mended from the snapshot; the end of a root is mended too."""
    source, folder = f"{tmp_path}/in", f"{tmp_path}/log"
    whole = reports([(r, s, 10 * s) for r in "abcd" for s in range(1, 13)])
    runs = [
        [("a", s, 10 * s) for s in (1, 2, 3)] + [("b", s, 10 * s) for s in (1, 3, 3)] + [("c", s, 10 * s) for s in range(1, 11)] + [("d", 1, 10)],
        [("b", 2, 20)] + [("a", s, 10 * s) for s in (4, 6, 7)] + [("d", s, 10 * s) for s in range(2, 13)],
        [("a", s, 10 * s) for s in (7, 8, 9, 10, 11, 12)] + [("b", s, 10 * s) for s in range(4, 13)],
        [("a", 5, 50)],
    ]
    for rows in runs:
        spark.createDataFrame(reports(rows), SHAPE).coalesce(1).write.mode("append").parquet(source)
        log = repair.log_stream(spark, source, folder, pd.Timedelta(minutes=40), "3 hours")
    rows = log.collect()
    assert [(r.root, r.seq, r.last_seq) for r in rows if r.kind == "hole"] == [("a", 5, 5)]
    assert sorted((r.root, r.seq) for r in rows if r.kind == "report" and r.root in "bd") == [(r, s) for r in "bd" for s in range(1, 13)]
    snapshot = spark.createDataFrame(whole, SHAPE)
    found = {(r.path, r.last_action, r.n_events): r.mended for r in repair.mended(log, snapshot).collect()}
    assert set(found) == {(r.path, r.last_action, r.n_events) for r in repair.folded(snapshot).collect()}
    assert {p[0] for (p, _, _), m in found.items() if m} == {"a", "c"}


def test_rates(spark, tmp_path):
    df = spark.createDataFrame([(START + timedelta(minutes=m),) for m in (0, 5, 12, 31, 300)], "ts timestamp")
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    streamed = {tuple(r) for r in repair.rates_stream(spark, f"{tmp_path}/in", f"{tmp_path}/out", "30 minutes", "10 minutes").collect()}
    assert streamed == {tuple(r) for r in repair.rates(df, "30 minutes", "10 minutes").collect() if r.started < (START + timedelta(minutes=271))} and len(streamed) == 6


def test_pauses_over_several_runs(spark, tmp_path):
    """Empty answers are counted across runs; those during a rest say nothing, one that isn't empty begins anew."""
    source, folder = f"{tmp_path}/in", f"{tmp_path}/out"
    for rows in ([(1, 0, True), (2, 1, True)], [(3, 2, True), (4, 3, True), (5, 30, False)], [(6, 70, True), (7, 71, True), (8, 72, False), (9, 73, True), (10, 74, True), (11, 75, True)]):
        spark.createDataFrame([(e, START + timedelta(minutes=m), "s", x) for e, m, x in rows], "event_id long, ts timestamp, source string, is_empty boolean").coalesce(1).write.mode("append").parquet(source)
        found = repair.pauses_stream(spark, source, folder, lambda df: df, 3, pd.Timedelta(hours=1))
    minutes = sorted((r.paused_at - START).total_seconds() / 60 for r in found.select(F.col("paused_at")).collect())
    assert minutes == [2, 75]
