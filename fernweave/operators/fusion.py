"""Fusing lexical, semantic and file-name components into one ranking."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEMANTIC, LEXICAL, RRF_K = 0.6, 0.4, 60
#: A file name's part of the lexical weight in reciprocal ranks, and what a partial match adds to the convex score.
NAME, NAME_GAIN = 0.5, 0.25


def assemble(lexical: DataFrame, semantic: DataFrame) -> DataFrame:
    """One row a candidate: (doc_id, lexical, semantic), a component null where it has none. One shuffle of both."""
    a = lexical.select("doc_id", F.col("score").alias("lexical"), F.lit(None).cast("double").alias("semantic"))
    b = semantic.select("doc_id", F.lit(None).cast("double").alias("lexical"), F.col("score").alias("semantic"))
    return a.unionByName(b).groupBy("doc_id").agg(F.max("lexical").alias("lexical"), F.max("semantic").alias("semantic"))


def _scaled(c: str, by: tuple[str, ...]) -> Column:
    """Min-max over the candidates (of one query) that have the component; all equal is 1, none is 0."""
    everything = Window.partitionBy(*by)  # of candidates, a bounded pool a query
    lo, hi = F.min(c).over(everything), F.max(c).over(everything)
    return F.coalesce(F.when(hi == lo, F.lit(1.0)).otherwise((F.col(c) - lo) / (hi - lo)), F.lit(0.0))


def fuse(candidates: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Adds ranks by component, the convex score, the reciprocal-rank score and what kind of match it is.

    A column ``filename`` (0 to 1, or null) lifts both scores: a name that holds
    all terms goes to 0.9 at least, one that holds some gains a share. Ranks that
    the candidates have already, from before some were left out, are kept.
    ``by`` names the columns that tell queries apart, where there are several.
    """
    name = F.coalesce("filename", F.lit(0.0)) if "filename" in candidates.columns else F.lit(0.0)
    rank = lambda c: F.when(F.col(c).isNotNull(), F.row_number().over(Window.partitionBy(*by).orderBy(F.desc_nulls_last(c), "doc_id")))
    ranked = candidates if "lexical_rank" in candidates.columns else candidates.withColumns({"lexical_rank": rank("lexical"), "semantic_rank": rank("semantic")})
    part = lambda w, c: F.coalesce(F.lit(w) / (RRF_K + F.col(c)), F.lit(0.0))
    rrf = (part(SEMANTIC, "semantic_rank") + part(LEXICAL, "lexical_rank") + name * (NAME * LEXICAL / (RRF_K + 1))) / ((SEMANTIC + LEXICAL + NAME * LEXICAL) / (RRF_K + 1))
    named = F.when(name > 0, "filename").otherwise("lexical")
    kind = F.when(F.col("lexical").isNotNull() & F.col("semantic").isNotNull(), "both").when(F.col("semantic").isNotNull(), "semantic")
    kind = kind.when(F.col("scored"), "lexical").otherwise(named) if "scored" in candidates.columns else kind.otherwise("lexical")
    convex = SEMANTIC * _scaled("semantic", by) + LEXICAL * _scaled("lexical", by)
    lifted = F.when(name >= 1, F.greatest(convex, 0.9 + 0.1 * _scaled("lexical", by))).when(name > 0, convex + NAME_GAIN * LEXICAL * name).otherwise(convex)
    return ranked.withColumns({"convex": F.round(F.least(lifted, F.lit(1.0)), 6), "rrf": F.round(rrf, 6), "match_type": kind})


def with_names(best: DataFrame, names: DataFrame, semantic: DataFrame) -> DataFrame:
    """Candidates of three components: BM25 scores as shares of the best, name fractions (which vouch for half their value as lexical), cosines.

    ``scored`` is whether the text itself matched.
    """
    share = F.col("score") / F.max("score").over(Window.partitionBy())  # of candidates, a bounded pool
    none = F.lit(None).cast("double")
    a = best.select("doc_id", share.alias("lexical"), none.alias("filename"), none.alias("semantic"), F.lit(True).alias("scored"))
    b = names.select("doc_id", (F.col("fraction") * 0.5).alias("lexical"), F.col("fraction").alias("filename"), none.alias("semantic"), F.lit(False).alias("scored"))
    c = semantic.select("doc_id", none.alias("lexical"), none.alias("filename"), F.col("score").alias("semantic"), F.lit(False).alias("scored"))
    return a.unionByName(b).unionByName(c).groupBy("doc_id").agg(*(F.max(x).alias(x) for x in ("lexical", "filename", "semantic", "scored")))


def literal(best: DataFrame, names: DataFrame, external: DataFrame) -> DataFrame:
    """doc_id and score of a search without vectors: the best of BM25's share, half the name's fraction and 0.8 of an outside rank (0 to 1000).

    A name that matches gives 0.6 and up to 0.4 more by its fraction.
    """
    share = F.col("score") / F.max("score").over(Window.partitionBy())  # of candidates, a bounded pool
    none = F.lit(None).cast("double")
    rows = best.select("doc_id", share.alias("lexical"), none.alias("filename"))
    rows = rows.unionByName(names.select("doc_id", (F.col("fraction") * 0.5).alias("lexical"), F.col("fraction").alias("filename")))
    rows = rows.unionByName(external.select("doc_id", (F.col("rank") / 1000.0 * 0.8).alias("lexical"), none.alias("filename")))
    score = F.greatest(F.max("lexical"), F.max(0.6 + 0.4 * F.col("filename")))
    return rows.groupBy("doc_id").agg(F.round(F.least(score, F.lit(1.0)), 4).alias("score"))


def three_places(x: Column) -> Column:
    n = F.floor(x * 1000 + 0.5)
    return F.concat(F.floor(n / 1000).cast("string"), F.lit("."), F.lpad((n % 1000).cast("string"), 3, "0"))


def over_chunks(lexical: DataFrame, chunks: DataFrame) -> DataFrame:
    """Candidates of the best pieces of text (doc_id, ordinal, score) and of chunk vectors (the same): shares of the best BM25, cosines, and the piece of each component."""
    share = F.col("score") / F.max("score").over(Window.partitionBy())  # of candidates, a bounded pool
    best = chunks.groupBy("doc_id").agg(F.max_by(F.struct("score", "ordinal"), F.struct("score", -F.col("ordinal"))).alias("b"))
    a = lexical.select("doc_id", share.alias("lexical"), F.col("ordinal").alias("lexical_ordinal"))
    return a.join(best.select("doc_id", F.col("b.score").alias("semantic"), F.col("b.ordinal").alias("semantic_ordinal")), "doc_id", "full_outer")


def shown(candidates: DataFrame, units: DataFrame, texts: DataFrame | Callable[[DataFrame], DataFrame], k: int, width: int) -> DataFrame:
    """doc_id, path, score, ordinal and the first ``width`` characters of what is shown of the k best candidates that ``units`` (doc_id, path) knows.

    The piece of the stronger component is shown, of equal ones the nearest chunk;
    ``texts`` are pieces (doc_id, ordinal, text), or gives those of the documents that
    it is asked for; a piece that is gone shows nothing.
    """
    ordinal = F.when(F.col("semantic").isNotNull() & (F.col("semantic") >= F.coalesce("lexical", F.lit(0.0))), F.col("semantic_ordinal")).otherwise(F.coalesce("lexical_ordinal", "semantic_ordinal"))
    hits = fuse(candidates).select("doc_id", F.col("convex").alias("score"), ordinal.alias("ordinal")).join(units.select("doc_id", "path"), "doc_id")
    best = hits.orderBy(F.desc("score"), "doc_id").limit(k)
    found = texts(best.select("doc_id")) if callable(texts) else texts
    pieces = found.select("doc_id", "ordinal", F.substring("text", 1, width).alias("shown"))
    return best.join(pieces, ["doc_id", "ordinal"], "left").select("doc_id", "path", "score", "ordinal", "shown").orderBy(F.desc("score"), "doc_id")


def reasons(semantic: Column, semantic_rank: Column, lexical: Column, lexical_rank: Column, name: Column | None = None, outside: Column | None = None) -> Column:
    """Why a document was found, one phrase a component that it has; ``name`` and ``outside`` are shares from 0 to 1."""
    place = lambda what, value, rank: F.concat(F.lit(f"{what} "), three_places(value), F.lit(", place "), rank.cast("string"))
    parts = [place("meaning", semantic, semantic_rank), place("words", lexical, lexical_rank)]
    if name is not None:
        parts.append(F.when(name > 0, F.concat(F.lit("name "), F.round(name * 100).cast("int").cast("string"), F.lit(" %"))))
    if outside is not None:
        parts.append(F.concat(F.lit("outside rank "), three_places(outside)))
    return F.array_compact(F.array(*parts))


def clamped(similarity: Column) -> Column:
    return F.least(F.greatest(similarity, F.lit(0.0)), F.lit(1.0))


def collapse(hits: DataFrame, key: str) -> DataFrame:
    """The best hit of each non-empty key stays, with the doc_ids of the others, best first, and their number; hits without a key stay.

    ``hits`` are a ranked pool of bounded size, and so is each key's list.
    """
    same = F.coalesce(F.nullif(F.col(key), F.lit("")), F.concat(F.lit("row "), F.col("doc_id").cast("string")))
    listed = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("order"), "doc_id")))
    best = hits.groupBy(same.alias("__same")).agg(F.max_by(F.struct(*hits.columns), F.struct("score", -F.col("doc_id"))).alias("hit"), listed.alias("l"))
    others = F.transform(F.slice("l", 2, F.greatest(F.size("l") - 1, F.lit(1))), lambda x: x["doc_id"])
    return best.select("hit.*", others.alias("duplicates"), (F.size("l") - 1).cast("long").alias("n_duplicates"))
