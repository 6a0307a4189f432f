"""Search for many queries at once: BM25 over the postings of the terms that they ask for, fusion with vectors, evaluation by mode."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import STOP_WORDS, tokens
from . import fusion
from .index import Index
from .lexical import gain

MOST_TERMS = 32


def meaningful(words: Column) -> Column:
    """Words that aren't stop words or single characters, or all if none is left; 32 at most, as a query language sets it."""
    kept = F.filter(words, lambda w: ~w.isin(*STOP_WORDS) & (F.length(w) > 1))
    return F.slice(F.when(F.size(kept) > 0, kept).otherwise(words), 1, MOST_TERMS)


def query_terms(queries: DataFrame) -> DataFrame:
    """(query_id, term, qtf) of ``queries`` (query_id, text)."""
    words = queries.select("query_id", F.explode(meaningful(tokens(F.col("text")))).alias("term"))
    return words.groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qtf"))


def search_all(index: Index, queries: DataFrame, k: int = 10) -> DataFrame:
    """query_id, doc_id, score and rank of the k best documents of each query, from the postings of the terms asked for.

    A frequent term's postings are one join key: adaptive execution splits it,
    and scores are summed map-side before the shuffle by query and document.
    """
    wanted = query_terms(queries)
    hits = index.postings.select("term", "doc_id", "dl", "tf").join(wanted.select("term").distinct(), "term", "left_semi")
    df = hits.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log((F.lit(index.n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighted = wanted.join(df, "term").select("query_id", "term", (F.col("qtf") * F.when(idf > 0, idf).otherwise(1e-6)).alias("weight"))
    part = gain(F.col("weight"), F.col("tf"), F.col("dl"), index.average)
    scored = hits.join(weighted, "term").groupBy("query_id", "doc_id").agg(F.round(F.sum(part), 6).alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def evaluate(ranked: DataFrame, labels: DataFrame, kinds: DataFrame, depth: int = 5) -> DataFrame:
    """Top-1, recall at ``depth`` and mean reciprocal rank by kind, with a row ``all``.

    ``ranked`` (query_id, doc_id, rank), ``labels`` (query_id, doc_id), ``kinds`` (query_id, kind);
    queries without a label don't count.
    """
    right = labels.join(ranked, ["query_id", "doc_id"], "left")
    per_query = right.groupBy("query_id").agg(
        F.min("rank").alias("first"), (F.count_if(F.col("rank") <= depth) / F.least(F.count(F.lit(1)), F.lit(depth))).alias("recall")
    )
    scored = per_query.join(kinds, "query_id").rollup("kind").agg(
        F.count(F.lit(1)).alias("n_queries"),
        F.round(F.avg(F.coalesce((F.col("first") == 1).cast("int"), F.lit(0))), 6).alias("top1"),
        F.round(F.avg("recall"), 6).alias("recall"),
        F.round(F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0))), 6).alias("mrr"),
    )
    return scored.withColumn("kind", F.coalesce("kind", F.lit("all")))


def candidates(lexical: DataFrame, semantic: DataFrame) -> DataFrame:
    """(query_id, doc_id, lexical, semantic) of two pools (query_id, doc_id, score); a component is null where it has none. One shuffle of both."""
    none = F.lit(None).cast("double")
    a = lexical.select("query_id", "doc_id", F.col("score").alias("lexical"), none.alias("semantic"))
    b = semantic.select("query_id", "doc_id", none.alias("lexical"), F.col("score").alias("semantic"))
    return a.unionByName(b).groupBy("query_id", "doc_id").agg(F.max("lexical").alias("lexical"), F.max("semantic").alias("semantic"))


def by_mode(fused: DataFrame, k: int = 10) -> DataFrame:
    """(mode, query_id, doc_id, score, rank) of the k best of every query by words alone (literal), vectors alone (semantic) and both (hybrid).

    ``fused`` are candidates as ``fusion.fuse`` leaves them; a mode ranks those that have its component.
    """
    modes = F.map_from_arrays(F.array(F.lit("literal"), F.lit("semantic"), F.lit("hybrid")), F.array("lexical", "semantic", "convex"))
    rows = fused.select("query_id", "doc_id", F.explode(modes).alias("mode", "score")).filter("score is not null")
    order = Window.partitionBy("mode", "query_id").orderBy(F.desc("score"), "doc_id")
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("mode", "query_id", "doc_id", "score", "rank")


def hybrid_all(index: Index, queries: DataFrame, near: DataFrame, pool: int = 300) -> DataFrame:
    """Fused candidates of every query: its ``pool`` best texts and the vectors ``near`` it (query_id, doc_id, score)."""
    return fusion.fuse(candidates(search_all(index, queries, pool), near), ("query_id",))


def evaluate_modes(ranked: DataFrame, labels: DataFrame, kinds: DataFrame, depth: int = 5) -> DataFrame:
    """Top-1, recall at ``depth`` and mean reciprocal rank by mode and kind, and of each mode over all kinds (kind ``all``).

    A labelled query counts in every mode that ranked anything, with or without hits of its own.
    """
    modes = ranked.select("mode").distinct()  # three at most
    right = labels.join(F.broadcast(modes)).join(ranked, ["mode", "query_id", "doc_id"], "left")
    per_query = right.groupBy("mode", "query_id").agg(F.min("rank").alias("first"), (F.count_if(F.col("rank") <= depth) / F.least(F.count(F.lit(1)), F.lit(depth))).alias("recall"))
    scored = per_query.join(kinds, "query_id").groupingSets([["mode", "kind"], ["mode"]], "mode", "kind").agg(
        F.count(F.lit(1)).alias("n_queries"),
        F.round(F.avg(F.coalesce((F.col("first") == 1).cast("int"), F.lit(0))), 6).alias("top1"),
        F.round(F.avg("recall"), 6).alias("recall"),
        F.round(F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0))), 6).alias("mrr"),
    )
    return scored.withColumn("kind", F.coalesce("kind", F.lit("all")))
