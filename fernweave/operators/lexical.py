"""BM25 over a persisted index: a query reads the postings of its own terms."""

from __future__ import annotations

import math
from bisect import bisect_right
from collections import Counter
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .index import Index, block_of

K1, B = 1.2, 0.75
#: A term in more than this share of the units is common.
COMMON = 0.03


def idf(n: int, df: int) -> float:
    value = math.log((n - df + 0.5) / (df + 0.5))
    return value if value > 0 else 1e-6


def gain(weight: Column, tf: Column, dl: Column, average: float) -> Column:
    return weight * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / F.lit(average)))


def hits(index: Index, terms: list[str]) -> DataFrame:
    """Postings of the terms; the filter reaches the files' pages."""
    return index.postings.filter(F.col("term").isin(sorted(set(terms))))


def frequencies(index: Index, terms: list[str]) -> dict[str, int]:
    """Live units that have each term: sums of the blocks' numbers, which only deleted documents make wrong."""
    if not index.n_gone:
        found = index.blocks.filter(F.col("term").isin(sorted(set(terms)))).groupBy("term").agg(F.sum("n").alias("df")).collect()  # a row a query term
        return dict.fromkeys(terms, 0) | {r["term"]: r["df"] for r in found}
    found = hits(index, terms).groupBy("term").agg(F.count(F.lit(1)).alias("df")).collect()  # a row a query term
    return dict.fromkeys(terms, 0) | {r["term"]: r["df"] for r in found}


def without_common(df: dict[str, int], n: int, terms: list[str]) -> list[str]:
    """The terms without the common ones, of which two, the rarest, stay where there is nothing else; terms of no unit stay only by themselves."""
    ladder = sorted((count, t) for t, count in df.items() if count and t in set(terms))
    # the rungs up to the common ones
    rungs = bisect_right(ladder, COMMON * n, key=lambda rung: rung[0])
    if not rungs:
        return [t for _, t in ladder[:2]] or terms
    chosen = {t for _, t in ladder[:rungs]}
    return [t for t in terms if t in chosen]


def top(rows: DataFrame, k: int) -> DataFrame:
    return rows.orderBy(F.desc("score"), "doc_id").limit(k)


def scores(index: Index, terms: list[str], mode: str = "or", prune: bool = False, where: Column | None = None) -> DataFrame:
    """(doc_id, ordinal, score) of all units that match. ``mode``: or, and, or auto (and, but or if nothing has all terms).

    A term that the query repeats counts as often. Statistics are those of all
    units; ``where``, on the units' columns, narrows what is scored. ``prune``
    leaves common terms out of an OR query, in a corpus of any size. Without
    terms there are no hits.
    """
    if mode not in ("or", "and", "auto"):
        raise ValueError(f"mode must be or, and or auto, not {mode!r}")
    if not terms:
        return index.units.select("doc_id", "ordinal", F.lit(0.0).alias("score")).limit(0)
    df = frequencies(index, terms)
    unique = list(dict.fromkeys(terms))
    every = mode == "and"
    if mode == "auto" and len(terms) > 1 and all(df.values()):
        having = hits(index, unique).groupBy("doc_id", "ordinal").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == len(unique))
        every = not having.isEmpty()
    used = terms if every or not prune or len(unique) < 2 else without_common(df, index.n, terms)
    weights = {t: c * idf(index.n, df[t]) for t, c in Counter(used).items()}
    weight = F.coalesce(*(F.when(F.col("term") == t, F.lit(w)) for t, w in weights.items()))
    found = hits(index, used)
    if where is not None:
        found = found.join(index.units.filter(where).select("doc_id", "ordinal"), ["doc_id", "ordinal"], "left_semi")
    summed = found.groupBy("doc_id", "ordinal").agg(F.round(F.sum(gain(weight, F.col("tf"), F.col("dl"), index.average)), 6).alias("score"), F.count(F.lit(1)).alias("n"))
    return (summed.filter(F.col("n") == len(unique)) if every else summed).drop("n")


def search(index: Index, terms: list[str], mode: str = "or", k: int = 10, where: Column | None = None, prune: bool = False) -> DataFrame:
    """The k best (doc_id, score); see ``scores``."""
    return top(scores(index, terms, mode, prune, where).select("doc_id", "score"), k)


def _weights(index: Index, terms: list[str]) -> Column:
    """Each term's weight in a query; a term that it repeats counts as often."""
    df = frequencies(index, terms)
    return F.coalesce(*(F.when(F.col("term") == t, F.lit(c * idf(index.n, df[t]))) for t, c in Counter(terms).items()))


#: Blocks whose postings are read in the first rounds of a bounded search.
ROUNDS = (16, 128)


class BoundedSearch:
    """The k best units of an OR query, reading only the blocks of doc_ids that can still hold one.

    A block's bound is what a unit would score that has each term as often as
    any in the block and is as short as any. The blocks of the highest bounds
    are scored first; the k-th score that they give is a threshold for all
    others, and rises from round to round. The last round takes all blocks that
    reach it, however many there are. ``n_blocks`` and ``n_read`` tell how many
    have a term and how many were read.
    """

    def __init__(self, index: Index, terms: list[str], k: int = 10, where: Column | None = None):
        self.index, self.terms, self.k, self.where = index, terms, k, where
        self.weight = _weights(index, terms)
        bound = gain(self.weight, F.col("tf"), F.col("dl"), index.average)
        self.bounds = index.blocks.filter(F.col("term").isin(sorted(set(terms)))).groupBy("block").agg(F.sum(bound).alias("bound"))
        self.n_blocks, self.n_read = self.bounds.count(), 0

    def _scored(self, found: DataFrame) -> DataFrame:
        if self.where is not None:
            found = found.join(self.index.units.filter(self.where).select("doc_id", "ordinal"), ["doc_id", "ordinal"], "left_semi")
        return found.groupBy("doc_id", "ordinal").agg(F.round(F.sum(gain(self.weight, F.col("tf"), F.col("dl"), self.index.average)), 6).alias("score"))

    def result(self) -> DataFrame:
        """(doc_id, score), best first, as ``search`` gives it."""
        rows, done, least = [], [], None  # of k rows a round, a list of blocks that ROUNDS bounds, the threshold
        for most in ROUNDS:
            left = self.bounds.filter(~F.col("block").isin(*done)) if done else self.bounds
            left = left if least is None else left.filter(F.col("bound") >= least - 1e-6)
            some = [r["block"] for r in left.orderBy(F.desc("bound"), "block").limit(most).collect()]
            if not some:
                return self._final(rows)
            done += some
            best = top(self._scored(hits(self.index, self.terms).filter(block_of(F.col("doc_id")).isin(*some))).select("doc_id", "score"), self.k).collect()
            rows = sorted([*rows, *(tuple(r) for r in best)], key=lambda r: (-r[1], r[0]))[: self.k]
            least = rows[-1][1] if len(rows) == self.k else None
        self.n_read = len(done)
        last = self.bounds.filter(~F.col("block").isin(*done))
        last = last if least is None else last.filter(F.col("bound") >= least - 1e-6)
        self.n_read += last.count()
        chosen = last.select("block")
        found = hits(self.index, self.terms).withColumn("block", block_of(F.col("doc_id"))).join(chosen, "block", "left_semi")
        rest = self._scored(found).select("doc_id", "score")
        return top(self._held(rows).unionByName(rest), self.k)

    def _held(self, rows: list[tuple]) -> DataFrame:
        kind = self.index.units.schema["doc_id"].dataType.simpleString()
        return self.index.spark.createDataFrame(rows, f"doc_id {kind}, score double")

    def _final(self, rows: list[tuple]) -> DataFrame:
        return top(self._held(rows), self.k)


def best_units(index: Index, terms: list[str], prune: bool = False, where: Column | None = None) -> DataFrame:
    """doc_id with the ordinal and score of its best unit, the earliest of equal ones."""
    best = scores(index, terms, prune=prune, where=where).groupBy("doc_id").agg(F.max_by(F.struct("ordinal", "score"), F.struct("score", -F.col("ordinal"))).alias("b"))
    return best.select("doc_id", "b.*")


def _earlier(by: int) -> Callable[[Column], Column]:
    return lambda place: place - by


def _places(words: list[str]) -> Column:
    """Where a unit has the words next to each other, from the terms' positions (a map)."""
    of = lambda w: F.coalesce(F.element_at("positions", w), F.array().cast("array<int>"))
    places = of(words[0])
    for k, w in enumerate(words[1:], 1):
        places = F.array_intersect(places, F.transform(of(w), _earlier(k)))
    return places


def phrases(index: Index, wanted: list[list[str]], k: int = 10) -> DataFrame:
    """The k best documents by BM25 of any of the phrases; a phrase has its own frequencies, one word is a phrase too."""
    met = hits(index, [w for p in wanted for w in p]).groupBy("doc_id", "ordinal").agg(F.first("dl").alias("dl"), F.map_from_entries(F.collect_list(F.struct("term", "positions"))).alias("positions"))
    rows = met.select("doc_id", "dl", *(F.size(_places(p)).alias(f"tf_{k}") for k, p in enumerate(wanted)))
    df = rows.agg(*(F.count_if(F.col(f"tf_{k}") > 0) for k in range(len(wanted)))).first()
    total = sum((gain(F.lit(idf(index.n, df[k])), F.col(f"tf_{k}"), F.col("dl"), index.average) for k in range(len(wanted))), F.lit(0.0))
    some = F.greatest(*(F.col(f"tf_{k}") for k in range(len(wanted))), F.lit(0)) > 0
    return top(rows.filter(some).select("doc_id", F.round(total, 6).alias("score")), k)


def document_frequencies(index: Index) -> DataFrame:
    """term and df of all units; two columns of the postings are read, and counts are made before the shuffle."""
    return index.postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
