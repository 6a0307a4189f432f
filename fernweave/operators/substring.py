"""Which values hold a string, in any case: postings of three-character pieces, intersected, then verified.

Every place of a value begins a piece of three characters (the last two are
filled up), so a needle of three and more stands only in values that have all
its pieces; its rarest two name the candidates. A shorter one is the beginning
of a piece. Candidates are checked on the values themselves.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PIECE = 3
#: Pieces of a needle whose postings are read, the rarest ones.
RAREST = 2
_FILL = "\x00" * (PIECE - 1)


def pieces(values: DataFrame) -> DataFrame:
    """(piece, doc_id) of values (doc_id, value), in order; null and empty values have none."""
    text = F.concat(F.lower("value"), F.lit(_FILL))
    places = F.when(F.char_length("value") > 0, F.sequence(F.lit(1), F.char_length(text) - (PIECE - 1)))
    found = values.select("doc_id", F.explode(F.array_distinct(F.transform(places, lambda i: F.substring(text, i, F.lit(PIECE))))).alias("piece"))
    return found.select("piece", "doc_id").repartitionByRange("piece", "doc_id").sortWithinPartitions("piece", "doc_id")


def containing(postings: DataFrame, values: DataFrame, needles: DataFrame) -> DataFrame:
    """(needle_id, doc_id) where the value (doc_id, value) holds the needle (needle_id, needle), whatever the case; an empty needle is held by none."""
    wanted = needles.select("needle_id", F.lower("needle").alias("needle")).filter("needle <> ''").distinct()
    long = wanted.filter(F.char_length("needle") >= PIECE)
    places = F.sequence(F.lit(1), F.char_length("needle") - (PIECE - 1))
    asked = long.select("needle_id", "needle", F.explode(F.array_distinct(F.transform(places, lambda i: F.substring("needle", i, F.lit(PIECE))))).alias("piece"))
    counts = postings.join(asked.select("piece").distinct(), "piece", "left_semi").groupBy("piece").agg(F.count(F.lit(1)).alias("n"))
    # of one needle's pieces; one that no value has rules the needle out
    order = Window.partitionBy("needle_id", "needle").orderBy("n", "piece")
    chosen = asked.join(counts, "piece", "left").withColumn("n", F.coalesce("n", F.lit(0))).withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= RAREST)
    sizes = chosen.groupBy("needle_id", "needle").agg(F.count(F.lit(1)).alias("of"))
    met = chosen.join(postings, "piece").groupBy("needle_id", "needle", "doc_id").agg(F.count(F.lit(1)).alias("n")).join(sizes, ["needle_id", "needle"]).filter("n = of")
    heads = F.array(*(F.substring("piece", 1, k) for k in range(1, PIECE)))
    begun = postings.select("doc_id", F.explode(heads).alias("needle")).join(wanted.filter(F.char_length("needle") < PIECE), "needle").select("needle_id", "needle", "doc_id").distinct()
    candidates = met.select("needle_id", "needle", "doc_id").unionByName(begun)
    held = candidates.join(values.select("doc_id", F.lower("value").alias("value")), "doc_id").filter(F.contains("value", "needle"))
    return held.select("needle_id", "doc_id").distinct()
