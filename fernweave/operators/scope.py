"""What belongs to an index: scope sweeps, coverage, inventories put together, jobs of changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import filters


def folders(path: Column) -> Column:
    """All folders that hold the path, from the outermost."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(2), F.greatest(F.size(parts) - 1, F.lit(2))), lambda i: F.array_join(F.slice(parts, 1, i), "/"))


def wanted(path: Column, extension: Column, size: Column, extensions: list[str], globs: list[str], most_size: int) -> Column:
    return filters.has_extension(extension, extensions) & ~filters.excluded(path, globs) & (size <= most_size)


def policy_reason(path: Column, extension: Column, extensions: list[str], globs: list[str]) -> Column:
    """Why the policy refuses a file, the first reason that holds; null if it doesn't. It holds for every way in which a file comes up."""
    listed = filters.has_extension(extension, extensions)
    none = F.coalesce(F.nullif(extension, F.lit("")), F.lit("(none)"))
    return F.when(filters.excluded(path, globs), "excluded").when(~F.coalesce(listed, F.lit(False)), F.concat(F.lit("extension "), none, F.lit(" isn't listed")))


def reject_reason(path: Column, roots: list[str], is_link: Column, follow_links: bool, target: Column, is_folder: Column, is_offline: Column) -> Column:
    """Why a path isn't indexed, the first reason that holds; null if it is. A followed link must lead into a root."""
    outside = ~filters.under_any(path, roots)
    link = F.when(is_link & ~filters.under_any(target, roots), "link leads outside") if follow_links else F.when(is_link, "link")
    return F.coalesce(F.when(outside, "outside roots"), link, F.when(is_folder, "folder"), F.when(is_offline, "offline"))


def allowed(status: Column, path: Column, filename: Column, extension: Column, roots: list[str], globs: list[str], within: list[str] | None = None, extensions: list[str] | None = None) -> Column:
    """What a hit must still be when it is shown: there, in the index's roots, not excluded, and inside the query's own filters. Without roots nothing is.

    Exclusions go by the whole path; ``filename`` is its last part and adds nothing.
    """
    out = (status != "missing") & filters.under_any(path, roots) & ~filters.excluded(path, globs)
    if within:
        out = out & filters.under_any(path, within)
    if extensions:
        out = out & filters.has_extension(extension, extensions)
    return out


def sampled(files: DataFrame, patterns: dict[str, str], each: int, most_size: int, names: str) -> DataFrame:
    """pattern and path: the first ``each`` paths of each name pattern, without files over the size or whose names match ``names``.

    A file counts for every pattern that it matches.
    """
    fits = F.array_compact(F.array(*(F.when(F.col("filename").rlike(filters.glob_pattern(g)), F.lit(p)) for p, g in patterns.items())))
    rows = files.filter((F.col("size") <= most_size) & ~F.col("filename").rlike(names)).select("path", F.explode(fits).alias("pattern"))
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy("pattern").orderBy("path"))).filter(F.col("nth") <= each).select("pattern", "path")


def out_of_scope(docs: DataFrame, roots: list[str], globs: list[str]) -> DataFrame:
    """Documents outside all roots or excluded. Without roots nothing is out of scope: an empty list is never a call to delete."""
    if not roots:
        return docs.limit(0)
    return docs.filter(~filters.under_any(F.col("path"), roots) | filters.excluded(F.col("path"), globs))


def merged(first: DataFrame, second: DataFrame) -> DataFrame:
    """Two inventories as one; of a path in both, the first one's row stays."""
    return first.unionByName(second.join(first.select("path"), "path", "left_anti"))


def upserted(base: DataFrame, updates: DataFrame, fields: list[str]) -> DataFrame:
    """``base`` with the updates' rows put in by path; a null in an update leaves what was there."""
    new = updates.select("path", *(F.col(c).alias(f"__{c}") for c in fields))
    return base.select("path", *fields).join(new, "path", "full_outer").select("path", *(F.coalesce(f"__{c}", c).alias(c) for c in fields))


def outermost(roots: DataFrame) -> DataFrame:
    """The distinct roots that no other root holds."""
    distinct = roots.select("root").distinct()
    above = distinct.select("root", F.explode(folders(F.col("root"))).alias("above")).filter("above <> root")
    inside = above.join(distinct.select(F.col("root").alias("above")), "above", "left_semi").select("root")
    return distinct.join(inside, "root", "left_anti")


def changed_since(docs: DataFrame, checkpoints: DataFrame, overlap: float = 5.0) -> DataFrame:
    """Files of each root (mtime) from ``overlap`` seconds before its checkpoint on; all where there is none."""
    return docs.join(checkpoints, "root", "left").filter(F.col("checkpoint").isNull() | (F.col("mtime") >= F.col("checkpoint") - overlap)).drop("checkpoint")


def coverage_affected(truncated: Column, chars: Column, n_chunks: Column, extension: Column, old: tuple[int, int, int, list[str]], new: tuple[int, list[str]]) -> Column:
    """Whether new limits change what is indexed of a document.

    ``old``: most characters, most chunks, embedded chunks of data files, data extensions; ``new``: the last two.
    """
    most_chars, most_chunks, embedded, data = old
    longer = n_chunks > min(embedded, new[0])
    out = truncated | (chars >= most_chars) | (n_chunks >= most_chunks)
    switched = sorted(set(data) ^ set(new[1]))
    if switched:
        out = out | (extension.isin(switched) & longer)
    if embedded != new[0] and new[1]:
        out = out | (extension.isin(sorted(new[1])) & longer)
    return out


def rescan(docs: DataFrame, secret: Column, exempt: Column) -> DataFrame:
    """path and action after a change of the exemptions: quarantine what is suspected now, requeue what was and is exempt."""
    action = F.when(secret & ~exempt & (F.col("status") == "ok"), "quarantine").when(exempt & (F.col("status") == "secret_suspected"), "requeue")
    return docs.select("path", action.alias("action")).filter("action is not null")


def jobs_of_changes(changes: DataFrame, known: DataFrame, indexable: Column, priority: int = 2) -> DataFrame:
    """Jobs (path, op, priority, n_requests) of changes (path, action, old_path) with the paths ``known`` to the index.

    What is removed or renamed away vanishes, a rename with one priority less; if
    the path isn't known it is taken for a folder, and all known paths in it vanish.
    Known paths meet folders by equality with each of their own folders.
    """
    away = F.when(F.col("old_path").isNotNull(), F.col("old_path")).when(F.col("action") == "removed", F.col("path"))
    late = F.when(F.col("old_path").isNotNull(), priority + 1).otherwise(priority)
    gone = changes.select(away.alias("target"), late.alias("priority")).filter("target is not null").groupBy("target", "priority").agg(F.count(F.lit(1)).alias("n"))
    paths = known.select(F.col("path").alias("target"))
    single = gone.join(paths, "target", "left_semi").select(F.col("target").alias("path"), "priority", "n")
    inside = known.select("path", F.explode(folders(F.col("path"))).alias("target"))
    spread = gone.join(paths, "target", "left_anti").join(inside, "target").select("path", "priority", "n")
    vanish = single.unionByName(spread).withColumn("op", F.lit("vanish"))
    index = changes.filter((F.col("action") != "removed") & indexable).groupBy("path").agg(F.count(F.lit(1)).alias("n")).withColumns({"priority": F.lit(priority), "op": F.lit("index")})
    return vanish.unionByName(index).groupBy("path", "op").agg(F.min("priority").alias("priority"), F.sum("n").alias("n_requests"))


def rolling_rate(events: DataFrame, width: int) -> DataFrame:
    """event_id with n_events of the last ``width`` seconds and their rate a second since the oldest of them (a second at least).

    Each event asks how many events there were up to it, and how many before its
    window began. Both are running counts in slices of a sixtieth of the width,
    plus the slices' totals before, so the work is a sort, however dense an hour is.
    """
    micros, slice_ = width * 1_000_000, max(1, width * 1_000_000 // 60)
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = events.select("event_id", at.alias("at")).select("event_id", "at", F.explode(F.array(F.lit(0), F.lit(1))).alias("is_event"))
    rows = rows.withColumn("place", F.col("at") - F.when(F.col("is_event") == 0, F.lit(micros)).otherwise(F.lit(0))).withColumn("slice", F.floor(F.col("place") / slice_))
    # one row for each slice in which anything happened
    totals = rows.groupBy("slice").agg(F.sum("is_event").alias("n"), F.min(F.when(F.col("is_event") == 1, F.col("at"))).alias("first"))
    every = Window.orderBy("slice")
    totals = totals.select("slice", F.coalesce(F.sum("n").over(every.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.min("first").over(Window.orderBy(F.desc("slice")).rowsBetween(Window.unboundedPreceding, -1)).alias("next"))
    inside = Window.partitionBy("slice")
    upto = F.sum("is_event").over(inside.orderBy("place", "is_event"))
    following = F.min(F.when(F.col("is_event") == 1, F.col("at"))).over(inside.orderBy(F.desc("place"), F.desc("is_event")))
    known = rows.withColumns({"upto": upto, "following": following}).join(totals, "slice")
    known = known.select("event_id", "at", "is_event", (F.col("upto") + F.col("before")).alias("count"), F.coalesce("following", "next").alias("oldest"))
    ends, begins = known.filter("is_event = 1"), known.filter("is_event = 0")
    both = ends.select("event_id", "at", F.col("count").alias("upto")).join(begins.select("event_id", F.col("count").alias("before"), "oldest"), "event_id")
    n, span = F.col("upto") - F.col("before"), F.greatest((F.col("at") - F.col("oldest")) / 1e6, F.lit(1.0))
    return both.select("event_id", n.alias("n_events"), F.round(n / span, 6).alias("per_second"))


def ranked_values(rows: DataFrame, key: str, value: str, shares: list[float]) -> DataFrame:
    """(key, share, value): the value at place floor(share * n) of the key's sorted values, counted from 0, the last at most.

    Two passes: approximate percentiles fence each place in, then only values
    between the fences are counted and put in order. Nulls have no place.
    """
    margin, accuracy = 0.001, 10_000
    rows = rows.select(F.col(key).alias("key"), F.col(value).alias("v")).filter("v is not null")
    fence = lambda s: F.percentile_approx("v", F.array(F.lit(max(s - margin, 0.0)), F.lit(min(s + margin, 1.0))), F.lit(accuracy))
    places = F.array(*(F.struct(F.lit(s).alias("share"), fence(s).alias("f")) for s in shares))
    fences = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), places.alias("p")).select("key", "n", F.explode("p").alias("p"))
    fences = fences.select("key", "p.share", F.least(F.floor(F.col("n") * F.col("p.share")), F.col("n") - 1).alias("at"), F.element_at("p.f", 1).alias("lo"), F.element_at("p.f", 2).alias("hi"))
    counted = rows.groupBy("key", "v").agg(F.count(F.lit(1)).alias("c")).join(fences, "key")
    under = F.col("v") < F.col("lo")
    bucket = counted.filter(F.col("v") <= F.col("hi")).groupBy("key", "share", "at", F.when(~under, F.col("v")).alias("v")).agg(F.sum("c").alias("c"))
    upto = F.sum("c").over(Window.partitionBy("key", "share").orderBy(F.col("v").asc_nulls_first()))
    reached = bucket.withColumn("upto", upto).filter(F.col("v").isNotNull() & (F.col("upto") > F.col("at")))
    return reached.groupBy("key", "share").agg(F.min("v").alias(value))
