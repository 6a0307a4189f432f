"""Keeping an index: snapshot differences, moves, tombstones, reuse, guards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GRACE_SECONDS = 600.0
MTIME_TOLERANCE = 1e-6


def difference(old: DataFrame, new: DataFrame) -> DataFrame:
    """path and change (added, changed, vanished, unchanged) between two inventories (path, size, mtime)."""
    both = old.select("path", F.col("size").alias("s0"), F.col("mtime").alias("m0")).join(new.select("path", F.col("size").alias("s1"), F.col("mtime").alias("m1")), "path", "full_outer")
    same = (F.col("s0") == F.col("s1")) & (F.abs(F.col("m0") - F.col("m1")) < MTIME_TOLERANCE)
    change = F.when(F.col("m0").isNull(), "added").when(F.col("m1").isNull(), "vanished").when(same, "unchanged").otherwise("changed")
    return both.select("path", change.alias("change"))


def moves(old: DataFrame, new: DataFrame) -> DataFrame:
    """old_path and new_path where a file's id and content are at a path that is new while the old one is gone; the smallest old path counts."""
    gone = old.join(new, "path", "left_anti").select(F.col("path").alias("old_path"), "file_id", "content_hash")
    fresh = new.join(old, "path", "left_anti").select(F.col("path").alias("new_path"), "file_id", "content_hash")
    return fresh.join(gone, ["file_id", "content_hash"]).groupBy("new_path").agg(F.min("old_path").alias("old_path"))


def deletion_allowed(known: int, seen: int, least_share: float = 0.5) -> bool:
    """No mass deletion: over 100 documents are known and fewer than the share were seen."""
    return not (known > 100 and seen < least_share * known)


def vanished(old: DataFrame, new: DataFrame, least_share: float = 0.5) -> DataFrame:
    """Paths of ``old`` that are gone in ``new``; none at all where the guard takes it for a failed listing."""
    met = old.select("path").join(new.select("path", F.lit(1).alias("there")), "path", "left")
    known, seen = met.agg(F.count(F.lit(1)), F.count("there")).first()
    gone = met.filter("there is null").select("path")
    return gone if deletion_allowed(known, seen, least_share) else gone.limit(0)


def bound(vectors: DataFrame, model: str, width: int, may_reset: bool) -> tuple[str, DataFrame]:
    """A store's vectors (vec_id, model, embedding) as they may be used with a model: ``created`` where there are none, ``ok``, or ``reset`` and none.

    Vectors of another model or width are an error unless they may be dropped.
    """
    row = vectors.agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("model").eqNullSafe(model) | (F.size("embedding") != width)).alias("other")).first()
    if not row["n"]:
        return "created", vectors
    if not row["other"]:
        return "ok", vectors
    if not may_reset:
        raise ValueError(f"{row['other']} of {row['n']} vectors aren't of {model} with {width} numbers")
    return "reset", vectors.limit(0)


def unchanged(size: Column, mtime: Column, was_size: Column, was_mtime: Column, status: Column, tried: Column, now: float, retry: float = 86_400.0) -> Column:
    """Whether a file need not be read again: same size and time, and an outcome that is final or an error younger than ``retry`` seconds."""
    same = (size == was_size) & (F.abs(mtime - was_mtime) < MTIME_TOLERANCE)
    final = F.when(status == "missing", False).when(status.isin("error", "denied"), tried > now - retry).otherwise(True)
    return F.coalesce(same & final, F.lit(False))


def purgeable(docs: DataFrame, now: float, grace: float = GRACE_SECONDS) -> DataFrame:
    return docs.filter((F.col("status") == "missing") & (F.col("missing_since") <= now - grace))


def reuse_vectors(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """Each chunk with the vector of the smallest vec_id whose text hash it shares, or null."""
    first = vectors.groupBy("text_hash").agg(F.min("vec_id").alias("vec_id"))
    return chunks.join(first, "text_hash", "left")


def orphans(vectors: DataFrame, chunks: DataFrame) -> DataFrame:
    return vectors.join(chunks, "text_hash", "left_anti")


def newest(rows: DataFrame, key: str | None, order: str, keep: int) -> DataFrame:
    """The newest ``keep`` rows of each key, or of all without one, which takes no task that sees all rows."""
    if key is None:
        return rows.orderBy(F.desc(order), "event_id").limit(keep)
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order), "event_id"))
    return rows.withColumn("__n", place).filter(F.col("__n") <= keep).drop("__n")


def outcomes(old: DataFrame, new: DataFrame, rejected: Column, secret: Column, blank: Column, most_size: int) -> DataFrame:
    """path and result of an index pass over inventory ``new``, given the index ``old`` (also status).

    A file that is not read has a result by its place, size or times; one that
    is read by its content. Paths of ``old`` that are gone are ``missing``.
    """
    was = old.select("path", F.col("size").alias("s0"), F.col("mtime").alias("m0"), F.col("content_hash").alias("h0"), F.col("status").alias("was"))
    moved = moves(old, new).select(F.col("new_path").alias("path"), "old_path")
    same = (F.col("s0") == F.col("size")) & (F.abs(F.col("m0") - F.col("mtime")) < MTIME_TOLERANCE)
    result = (
        F.when(rejected, "rejected")
        .when(F.col("size") > most_size, "too_large")
        .when(same & (F.col("was") == "missing"), "restored")
        .when(same, "unchanged")
        .when(F.col("h0") == F.col("content_hash"), "touched")
        .when(F.col("old_path").isNotNull(), "moved")
        .when(secret, "secret_suspected")
        .when(blank, "empty")
        .otherwise("indexed")
    )
    found = new.join(was, "path", "left").join(moved, "path", "left").select("path", result.alias("result"))
    return found.unionByName(old.join(new, "path", "left_anti").select("path", F.lit("missing").alias("result")))


def fresh_vectors(computed: DataFrame, chunks: DataFrame) -> DataFrame:
    """Of vectors computed for (doc_id, ordinal, text_hash) those of documents whose chunks are still the same.

    One chunk that is gone or has another text makes all of its document's vectors stale.
    """
    now = chunks.select("doc_id", "ordinal", F.col("text_hash").alias("__now"))
    met = computed.join(now, ["doc_id", "ordinal"], "left")
    stale = met.filter(~F.col("text_hash").eqNullSafe(F.col("__now"))).select("doc_id").distinct()
    return computed.join(stale, "doc_id", "left_anti")


def quarantined(docs: DataFrame, secret: Column) -> DataFrame:
    """The documents with text and content hash of those under suspicion taken out, and their status set."""
    taken = docs.withColumn("__secret", F.coalesce(secret, F.lit(False)))
    none = F.lit(None).cast("string")
    taken = taken.withColumns({"text": F.when(~F.col("__secret"), F.col("text")).otherwise(none), "content_hash": F.when(~F.col("__secret"), F.col("content_hash")).otherwise(none), "status": F.when(F.col("__secret"), "secret_suspected").otherwise(F.col("status"))})
    return taken.drop("__secret")
