"""Text of a file by the first extractor that yields some, and text collected up to a budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .text import html_text, strip_controls


def chain(extractors: list[tuple[str, Column]], refused: Column | None = None) -> Column:
    """Struct of text, status, extractor and attempts (extractor and status of each one tried).

    ``extractors`` are names with the text that each finds: null where it failed,
    blank where there is none. The first text that isn't blank wins and later
    ones aren't tried; without one, status and extractor are the last one's.
    ``refused`` (``missing`` or ``denied``) is the end before any is tried.
    """
    tried = F.lit(True)
    attempts, results = [], []
    for name, found in extractors:
        status = F.when(found.isNull(), "error").when(found.rlike("\\S"), "ok").otherwise("empty")
        result = F.struct(F.lit(name).alias("extractor"), status.alias("status"))
        attempts.append(F.when(tried, result))
        results.append(F.when(status == "ok", F.struct(strip_controls(found).alias("text"), status.alias("status"), F.lit(name).alias("extractor"))))
        tried = tried & (status != "ok")
    last = F.struct(F.lit("").alias("text"), status.alias("status"), F.lit(extractors[-1][0]).alias("extractor"))
    best = F.coalesce(*results, last)
    made = F.array_compact(F.array(*attempts))
    whole = F.struct(best["text"].alias("text"), best["status"].alias("status"), best["extractor"].alias("extractor"), made.alias("attempts"))
    if refused is None:
        return whole
    none = F.struct(F.lit("").alias("text"), refused.alias("status"), F.lit("none").alias("extractor"), F.slice(made, 1, 0).alias("attempts"))
    return F.when(refused.isNotNull(), none).otherwise(whole)


def article(html: Column) -> Column:
    """Visible text of a page's article; null where it has none."""
    inside = F.regexp_extract(html, "(?is)<article[^>]*>(.*)</article>", 1)
    return F.when(html.rlike("(?i)<article"), html_text(inside))


def collected(parts: DataFrame, most: int, between: str = "\n\n") -> DataFrame:
    """doc_id, text and truncated: the parts (doc_id, ordinal, text) in order up to ``most`` characters.

    Separators don't count while parts are taken, and the joined text is cut once
    more at the end. Only parts within the budget reach the list of a document.
    """
    before = F.coalesce(F.sum(F.length("text")).over(Window.partitionBy("doc_id").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = parts.select("doc_id", "ordinal", "text", before.alias("before"))
    over = (F.col("before") >= most) | (F.col("before") + F.length("text") > most)
    piece = F.when(F.col("before") < most, F.struct("ordinal", F.substring("text", F.lit(1), (most - F.col("before")).cast("int")).alias("text")))
    taken = placed.groupBy("doc_id").agg(F.array_sort(F.collect_list(piece)).alias("pieces"), F.max(over).alias("truncated"))
    joined = F.array_join(F.transform("pieces", lambda p: p["text"]), between)
    return taken.select("doc_id", F.substring(joined, 1, most).alias("text"), "truncated")
