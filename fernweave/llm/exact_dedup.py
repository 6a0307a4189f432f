"""Operator 2: exact dedup through a minimal perfect hash over historical digests.

Texts are equal when they are identical after lower-casing A-Z. The history is
a set of distinct digests, each with its winner locator (the largest doc_id so
far) and its number of rows: what earlier loads held, or, for a table by itself,
its earlier half by doc_id. The digests are dealt into buckets; each bucket is
compiled into a minimal perfect hash (levels of bit arrays, rank gives the slot)
whose slots hold the full digest, the winner and the number. A row's digest goes
to its bucket, is hashed to a slot, and counts as a member only if all 32 bytes
agree. New members are counted by slot and may take the slot's place as winner;
nonmembers are grouped among themselves.

Skew: winners and numbers are pre-aggregated before they are shuffled, a bucket
holds a bounded number of distinct digests, and a bucket with many rows to look
up is dealt over several copies of its slots, each smaller than the rows that it
answers. What is joined back to the rows is a written table, so that adaptive
execution may split a large group.

Results for odd input: null counts as the empty text; rows with one doc_id
count one by one; a null doc_id is part of the earlier half and never wins
unless its group has no other; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, id_text_columns, side

#: Distinct digests a bucket holds on average, and rows one copy of a bucket answers.
BUCKET_DIGESTS = 4_000
BUCKET_ROWS = 8_000
GAMMA = 2.0


def digest_rows(docs: DataFrame) -> DataFrame:
    """doc_id and the SHA-256 digest of each text with A-Z in lower case."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.binary())
            # bytes.lower() touches A-Z alone
            digests = [hashlib.sha256((x.as_py() or b"").lower()).digest() for x in texts]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(digests, pa.binary())], ["doc_id", "digest"])

    return id_text_columns(docs).mapInArrow(run, "doc_id long, digest binary")


def history_of(rows: DataFrame) -> DataFrame:
    """Distinct digests with winner and size, aggregated before the shuffle."""
    return rows.groupBy("digest").agg(F.max("doc_id").alias("winner"), F.count(F.lit(1)).alias("size"))


def bucket_of(digest: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(digest), F.lit(buckets)).cast("int")


class PerfectHash:
    """Minimal perfect hash of n distinct 32-byte digests: a level keeps the digests that were alone in their cell."""

    def __init__(self, digests: np.ndarray):
        if len(np.unique(np.ascontiguousarray(digests).view("V32"))) < len(digests):
            raise ValueError("a digest stands more than once; such digests are never alone in a cell")
        words = digests.view("<u8").reshape(-1, 4)
        left = np.arange(len(words))
        self.levels: list[np.ndarray] = []
        while len(left):
            size = max(64, int(GAMMA * len(left)))
            cell = self.cell(words[left], len(self.levels), size)
            alone = np.bincount(cell, minlength=size) == 1
            self.levels.append(alone)
            left = left[~alone[cell]]
        self.starts = np.cumsum([0, *(int(x.sum()) for x in self.levels)])
        self.ranks = [np.cumsum(x) - x for x in self.levels]

    @staticmethod
    def cell(words: np.ndarray, level: int, size: int) -> np.ndarray:
        """A digest's cell on a level: its words mixed with the level's seed."""
        with np.errstate(over="ignore"):
            x = words[:, level % 4] ^ (np.uint64(level + 1) * np.uint64(0x9E3779B97F4A7C15))
            x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            return ((x ^ (x >> np.uint64(31))) % np.uint64(size)).astype(np.int64)

    def slots(self, digests: np.ndarray) -> np.ndarray:
        """Each digest's slot; -1 or any slot for one that is no member, so the caller compares bytes."""
        words = digests.view("<u8").reshape(-1, 4)
        out = np.full(len(words), -1)
        left = np.arange(len(words))
        for level, alone in enumerate(self.levels):
            if not len(left):
                break
            cell = self.cell(words[left], level, len(alone))
            found = alone[cell]
            out[left[found]] = self.starts[level] + self.ranks[level][cell[found]]
            left = left[~found]
        return out


def _as_bytes(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, 32)


def build_index(history: DataFrame, buckets: int, copies: DataFrame) -> DataFrame:
    """One row for each copy of each bucket: slots in the order of the bucket's perfect hash (digests, winners, sizes).

    ``copies`` has (bucket, n_copies). A bucket holds about BUCKET_DIGESTS digests, whatever the input's size.
    """

    def build(key: tuple, table: pa.Table) -> pa.Table:
        digests = _as_bytes(table.column("digest").combine_chunks())
        order = np.argsort(PerfectHash(digests).slots(digests))
        winners = table.column("winner").combine_chunks().take(pa.array(order))
        sizes = table.column("size").to_numpy()[order]
        return pa.table({"bucket": pa.array([key[0].as_py()], pa.int32()), "digests": pa.array([digests[order].tobytes()], pa.binary()), "winners": pa.array([winners.to_pylist()], pa.list_(pa.int64())), "sizes": pa.array([sizes], pa.list_(pa.int64()))})

    slots = history.withColumn("bucket", bucket_of(F.col("digest"), buckets)).groupBy("bucket").applyInArrow(build, "bucket int, digests binary, winners array<long>, sizes array<long>")
    return slots.join(copies, "bucket").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("n_copies") - 1))).drop("n_copies")


def look_up(rows: DataFrame, index: DataFrame, copies: DataFrame, buckets: int) -> DataFrame:
    """doc_id, digest, fresh, bucket, and the slot with its winner and size (all three null where the digest is no member)."""
    # no hint: the crowded buckets are broadcast only while Spark finds them small enough
    probes = rows.withColumn("bucket", bucket_of(F.col("digest"), buckets)).join(copies.filter("n_copies > 1"), "bucket", "left")
    probes = probes.select("bucket", F.pmod(F.xxhash64(F.coalesce("doc_id", "row"), F.lit(7)), F.coalesce("n_copies", F.lit(1))).cast("int").alias("copy"), "doc_id", "digest", "fresh")
    nulls = {"digests": "binary", "winners": "array<long>", "sizes": "array<long>"}
    slots = index.select("bucket", "copy", *(F.lit(None).cast(t).alias(k) for k, t in {"doc_id": "long", "digest": "binary", "fresh": "boolean"}.items()), *nulls)
    both = probes.select("*", *(F.lit(None).cast(t).alias(k) for k, t in nulls.items())).unionByName(slots)
    both = both.repartition("bucket", "copy").sortWithinPartitions("bucket", "copy", F.col("digests").isNull())

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, hash_, slots, winners, sizes = None, None, None, None, None
        for batch in batches:
            bucket, copy = (np.array(batch.column(c), np.int64) for c in ("bucket", "copy"))
            is_slots = np.array(batch.column("digests").is_valid())
            edges = np.flatnonzero((np.diff(bucket) != 0) | (np.diff(copy) != 0) | is_slots[1:] | is_slots[:-1]) + 1
            cuts = [0, *edges.tolist(), len(bucket)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                part = batch.slice(a, b - a)
                if is_slots[a]:
                    held = bucket[a], copy[a]
                    slots = np.frombuffer(part.column("digests")[0].as_py(), np.uint8).reshape(-1, 32)
                    hash_, winners, sizes = PerfectHash(slots), part.column("winners")[0].values, part.column("sizes")[0].values
                    continue
                slot = pa.nulls(b - a, pa.int64())
                winner, size = slot, slot
                if held == (bucket[a], copy[a]):
                    digests = _as_bytes(part.column("digest"))
                    at = hash_.slots(digests)
                    member = (at >= 0) & (slots[at] == digests).all(1)
                    slot = pa.array(at, mask=~member)
                    winner, size = winners.take(slot), sizes.take(slot)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("doc_id", "digest", "fresh", "bucket")), slot, winner, size], ["doc_id", "digest", "fresh", "bucket", "slot", "winner", "size"])

    return both.mapInArrow(probe, "doc_id long, digest binary, fresh boolean, bucket int, slot long, winner long, size long")


def exact_dedup(docs: DataFrame, history: DataFrame | None = None) -> DataFrame:
    """Per row of ``docs``: doc_id, digest, keep_id (the row that stays), group_size and kept.

    ``history`` (digest, winner, size) is what earlier loads held: its rows count
    and may win, and all of ``docs`` is new; a digest that several loads held may
    stand in it several times. Without it the rows up to the median
    doc_id are the history of the others.
    """
    # the number of a row spreads rows without a doc_id
    rows = cut(digest_rows(docs).withColumn("row", F.monotonically_increasing_id()))
    if history is None:
        median = rows.agg(F.percentile_approx("doc_id", 0.5)).first()[0]
        rows = rows.withColumn("fresh", F.coalesce(F.col("doc_id") > F.lit(median), F.lit(False)))
        history = history_of(rows.filter("not fresh"))
    else:
        rows = rows.withColumn("fresh", F.lit(True))
        history = cut(history.groupBy("digest").agg(F.max("winner").alias("winner"), F.sum("size").alias("size")))
    buckets = max(1, -(-history.count() // BUCKET_DIGESTS))
    load = rows.groupBy(bucket_of(F.col("digest"), buckets).alias("bucket")).agg(F.count(F.lit(1)).alias("rows"))
    copies = cut(load.select("bucket", F.greatest(F.lit(1), F.ceil(F.col("rows") / BUCKET_ROWS)).cast("int").alias("n_copies")))
    found = cut(look_up(rows, build_index(history, buckets, copies), copies, buckets))
    news = found.filter("slot is not null and fresh").groupBy("bucket", "slot").agg(F.max("doc_id").alias("newest"), F.count(F.lit(1)).alias("more"))
    members = found.filter("slot is not null").join(side(news), ["bucket", "slot"], "left")
    members = members.select("doc_id", "digest", F.greatest("winner", "newest").alias("keep_id"), (F.col("size") + F.coalesce("more", F.lit(0))).alias("group_size"))
    alone = found.filter("slot is null").select("doc_id", "digest")
    others = alone.join(side(history_of(alone)), "digest").select("doc_id", "digest", F.col("winner").alias("keep_id"), F.col("size").alias("group_size"))
    return members.unionByName(others).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("keep_id"), F.col("keep_id").isNull()))
