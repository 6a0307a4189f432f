"""Operator 13: ranked lexical search in buckets of impact vectors by their length.

A document's impact vector has, for each term, the term's weight times its
saturated frequency, as integers; a query is the vector of its terms'
occurrences, and a score the inner product of both. Vectors are kept for the
queries' terms alone and ordered by their Euclidean length, longest first, in
partitions and within them in buckets. For a query whose best results so far
end at score s

* a bucket is left out where the query's length times that of its longest
  vector is below s (Cauchy-Schwarz);
* so is one where the query times the greatest value of each coordinate is;
* inside, a vector's values at the query's heaviest coordinates are summed, and
  for the others there is left at most the product of the remaining lengths, or
  the greatest values; vectors that can't reach s go;
* survivors are scored exactly, in 64-bit integers.

s is known before: the partition of the longest vectors is searched first, for
all queries, and its last places are where the others begin. Bounds that equal s
don't prune, so that ties are kept for the order of ids.

Statistics cover all documents. Queries' terms are looked for in blocks of
TERM_BYTES, queries are dealt out in blocks of QUERY_TERMS terms; both are what
is broadcast, whatever the size of either table. Results are merged in two
steps, so that no task has more than its share of any query's candidates.

Results for odd input: a null or empty text or query has no terms and no
results; rows with equal doc_id are ranked one by one, of equal scores a null
doc_id comes last; rows with equal item_id and text are one query, those with
equal item_id and other texts are ranked apart; without documents there is no
result; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, id_text_columns, list_array, side, small_batches

#: Bytes of query terms that are looked for in one pass over the texts, and terms of the queries that are searched together.
TERM_BYTES, QUERY_TERMS = 4 << 20, 200_000
#: Vectors in a bucket, heaviest coordinates that are summed first, parts of the vectors (by length) of which the first is searched first.
BUCKET, FOCUS, PARTS = 512, 4, 64
#: Saturation of frequencies and share of the document's length, in thousandths and hundredths.
SCALE, K1, B = 1_000_000_000, 12, 25
#: Bytes to themselves or to lower case where they are part of a term, else to a space.
TERM_BYTE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))
PIECE = 1 << 20


def term_counts(text: bytes) -> Counter:
    """How often each term stands in the text, which is split piece by piece."""
    text = text.translate(TERM_BYTE)
    if len(text) <= PIECE:
        return Counter(text.split())
    counts: Counter = Counter()
    at = 0
    while at < len(text):
        end = text.find(b" ", at + PIECE)
        end = len(text) if end < 0 else end
        counts.update(text[at:end].split())
        at = end
    return counts


def query_terms(items: DataFrame) -> DataFrame:
    """item_id, query (a number), term and qtf: the terms of each distinct item and how often they stand in it."""
    distinct = items.select("item_id", F.col("text").cast("string").alias("text")).filter("text is not null").distinct()
    numbered = cut(distinct.withColumn("query", F.monotonically_increasing_id()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            for k, text in enumerate(batch.column("text").cast(pa.binary())):
                counts = term_counts(text.as_py())
                yield pa.RecordBatch.from_arrays([pa.array([batch.column("query")[k].as_py()] * len(counts), pa.int64()), pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["query", "term", "qtf"])

    terms = numbered.select("query", "text").mapInArrow(run, "query long, term binary, qtf long")
    return cut(numbered.select("item_id", "query").join(side(terms), "query"))


def _vocabulary(terms: DataFrame) -> tuple[DataFrame, int]:
    """term, its number and the block in which it is looked for; and the number of blocks."""
    distinct = terms.select("term").distinct()
    size = distinct.agg(F.sum(F.octet_length("term") + 8)).first()[0] or 0
    blocks = max(1, -(-size // TERM_BYTES))
    return cut(distinct.select("term", F.monotonically_increasing_id().alias("t"), F.pmod(F.xxhash64("term"), F.lit(blocks)).cast("int").alias("block"))), blocks


def _occurrences(docs: DataFrame, vocabulary: DataFrame, block: int) -> DataFrame:
    """Per row with a term: row, doc_id, n (its terms with repeats), and the block's terms in it with their counts."""
    held = {bytes(r["term"]): r["t"] for r in vocabulary.filter(F.col("block") == block).toLocalIterator()}  # about TERM_BYTES
    shared = docs.sparkSession.sparkContext.broadcast(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in small_batches(batches, "text"):
            n, sizes, terms, tfs = [], [], [], []
            for text in batch.column("text").cast(pa.binary()):
                counts = term_counts(text.as_py() or b"")
                found = counts.keys() & known.keys()
                n.append(counts.total())
                sizes.append(len(found))
                terms += [known[t] for t in found]
                tfs += [counts[t] for t in found]
            lengths = np.array(sizes, np.int64)
            out = pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), pa.array(n, pa.int64()), list_array(np.array(terms, np.int64), lengths, pa.int64()), list_array(np.array(tfs, np.int64), lengths, pa.int64())], ["row", "doc_id", "n", "terms", "tfs"])
            yield out.filter(pa.array(np.array(n) > 0))

    return docs.mapInArrow(run, "row long, doc_id long, n long, terms array<long>, tfs array<long>")


def impacts(docs: DataFrame, vocabulary: DataFrame, blocks: int) -> DataFrame | None:
    """Per row with terms of the vocabulary: row, doc_id, terms, values (its impact vector) and norm, the vector's length. None where no document has a term."""
    rows = id_text_columns(docs).withColumn("row", F.monotonically_increasing_id())
    rows = rows if blocks == 1 else cut(rows)
    parts = [cut(_occurrences(rows, vocabulary, k)) for k in range(blocks)]
    # each part has all rows with a term, so one tells the corpus's statistics
    many, total = parts[0].agg(F.count(F.lit(1)), F.sum("n")).first()
    if not many:
        return None
    union = reduce(DataFrame.unionByName, parts).filter(F.size("terms") > 0)
    held = union.select("row", "doc_id", "n", F.explode(F.arrays_zip("terms", "tfs")).alias("x")).select("row", "doc_id", "n", F.col("x.terms").alias("t"), F.col("x.tfs").alias("tf"))
    df = held.groupBy("t").agg(F.count(F.lit(1)).alias("df"))
    weights = cut(df.select("t", F.floor(F.log((2.0 * many + 2.0) / (2.0 * F.col("df") + 1.0)) * 1000.0).cast("long").alias("w")))
    return _weighted(union, weights, blocks, many, total)


def _weighted(rows: DataFrame, weights: DataFrame, blocks: int, many: int, total: int) -> DataFrame:
    """The impact vectors of rows of counts: the weights of a block's terms are as many as its terms."""
    spark = rows.sparkSession
    if blocks == 1:
        known = [(r["t"], r["w"]) for r in weights.toLocalIterator()]
        ids = np.array([t for t, _ in known], np.int64)
        order = np.argsort(ids)
        shared = spark.sparkContext.broadcast((ids[order], np.array([w for _, w in known], np.int64)[order]))
    else:
        zipped = rows.select("row", "doc_id", "n", F.explode(F.arrays_zip("terms", "tfs")).alias("x")).select("row", "doc_id", "n", F.col("x.terms").alias("t"), F.col("x.tfs").alias("tf"))
        # common terms are hot keys of this join; both sides are plain shuffles, which can be split
        rows = zipped.join(side(weights), "t").groupBy("row", "doc_id", "n").agg(F.collect_list("t").alias("terms"), F.collect_list("tf").alias("tfs"), F.collect_list("w").alias("ws"))
        shared = None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("terms")
            sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            terms, tfs = (batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("terms", "tfs"))
            if shared is None:
                ws = batch.column("ws").flatten().to_numpy(zero_copy_only=False)
            else:
                ws = shared.value[1][np.searchsorted(shared.value[0], terms)]
            # of Python integers: 25 * n * N may have over 64 bits on the way
            m = np.array([100 - B + (B * n * many) // total for n in batch.column("n").to_pylist()], np.int64)
            values = ws * ((SCALE * tfs) // (1000 * tfs + K1 * np.repeat(m, sizes)))
            at = np.repeat(np.arange(len(sizes)), sizes)
            norm = np.sqrt(np.bincount(at, values.astype(np.float64) ** 2, len(sizes)))
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), list_array(terms, sizes, pa.int64()), list_array(values, sizes, pa.int64()), pa.array(norm)], ["row", "doc_id", "terms", "values", "norm"])

    return rows.mapInArrow(run, "row long, doc_id long, terms array<long>, values array<long>, norm double")


class Queries:
    """Query vectors with dense coordinates, each query's heaviest last, and the score that each one has to reach."""

    def __init__(self, queries: list[int], rows: list[tuple[int, int, int]], floors: dict[int, int]):
        at = {q: k for k, q in enumerate(queries)}
        query, terms, qtf = (np.array(x, np.int64) for x in zip(*((at[q], t, f) for q, t, f in rows), strict=True))
        order = np.lexsort((terms, query))
        self.numbers, self.qtf = np.array(queries, np.int64), qtf[order]
        self.terms, self.dense = np.unique(terms[order], return_inverse=True)
        self.cuts = np.concatenate(([0], np.cumsum(np.bincount(query, minlength=len(queries)))))
        self.norms = np.sqrt(np.add.reduceat(self.qtf.astype(np.float64) ** 2, self.cuts[:-1]))
        self.floors = np.array([floors.get(q, 1) for q in queries], np.int64)


class Bucket:
    """Vectors of about one length, by coordinate: which vectors have it, and their values."""

    def __init__(self, queries: Queries, terms: np.ndarray, values: np.ndarray, sizes: np.ndarray, norms: np.ndarray):
        at = np.searchsorted(queries.terms, terms)
        at[at == len(queries.terms)] = 0
        known = queries.terms[at] == terms
        owner = np.repeat(np.arange(len(sizes)), sizes)[known]
        order = np.argsort(at[known], kind="stable")
        self.owner, self.values = owner[order], values[known][order]
        self.cuts = np.searchsorted(at[known][order], np.arange(len(queries.terms) + 1))
        self.most = np.zeros(len(queries.terms), np.int64)
        filled = np.flatnonzero(np.diff(self.cuts))
        if len(filled):
            self.most[filled] = np.maximum.reduceat(self.values, self.cuts[filled])
        self.squares, self.longest = norms**2, float(norms.max())
        self.norms = norms

    def column(self, term: int) -> tuple[np.ndarray, np.ndarray]:
        a, b = self.cuts[term], self.cuts[term + 1]
        return self.owner[a:b], self.values[a:b]

    def scores(self, terms: np.ndarray, qtf: np.ndarray, norm: float, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Vectors that may score ``least`` and more, and their exact scores."""
        share = qtf * self.most[terms]
        have = np.flatnonzero(share)
        have = have[np.argsort(-share[have], kind="stable")]
        terms, qtf, share = terms[have], qtf[have], share[have]
        n = len(self.norms)
        sums, seen = np.zeros(n, np.int64), np.zeros(n)
        for t, f in zip(terms[:FOCUS].tolist(), qtf[:FOCUS].tolist(), strict=True):
            owner, values = self.column(t)
            sums[owner] += f * values
            seen[owner] += values.astype(np.float64) ** 2
        rest = float(np.sqrt(np.sum(qtf[FOCUS:].astype(np.float64) ** 2))) * np.sqrt(np.maximum(self.squares - seen, 0)) * (1 + 1e-9) + 1
        some = sums + np.minimum(rest, float(share[FOCUS:].sum())) >= least
        if not some.any():
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        for t, f in zip(terms[FOCUS:].tolist(), qtf[FOCUS:].tolist(), strict=True):
            owner, values = self.column(t)
            kept = some[owner]
            sums[owner[kept]] += f * values[kept]
        found = np.flatnonzero(some & (sums >= least))
        return found, sums[found]


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best, ties by ascending id."""
    return np.lexsort((ids, -scores))[:k]


def _searched(vectors: DataFrame, queries: Queries, k: int) -> DataFrame:
    """query, doc_id, score: of each partition the k best of every query among those that reach its floor."""
    shared = vectors.sparkSession.sparkContext.broadcast(queries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = shared.value
        floors = q.floors.copy()
        best: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(q.numbers)
        for batch in batches:
            # a null id after all others
            ids = batch.column("doc_id").fill_null(np.iinfo(np.int64).max).to_numpy()
            norms = batch.column("norm").to_numpy()
            for a in range(0, batch.num_rows, BUCKET):
                part = batch.slice(a, BUCKET)
                sizes = part.column("terms").value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
                bucket = Bucket(q, *(part.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("terms", "values")), sizes, norms[a : a + BUCKET])
                # bounds of whole buckets for all queries at once, lengths first
                reach = np.minimum(q.norms * bucket.longest * (1 + 1e-9) + 1, np.add.reduceat(q.qtf * bucket.most[q.dense], q.cuts[:-1]))
                for i in np.flatnonzero(reach >= floors).tolist():
                    x, y = q.cuts[i], q.cuts[i + 1]
                    found, scores = bucket.scores(q.dense[x:y], q.qtf[x:y], q.norms[i], int(floors[i]))
                    if len(found):
                        scores, held = np.concatenate((best[i][0], scores)), np.concatenate((best[i][1], ids[a + found]))
                        top = _best(scores, held, k)
                        best[i] = scores[top], held[top]
                        if len(top) == k:
                            floors[i] = max(floors[i], int(scores[top[-1]]))
        counts = np.array([len(s) for s, _ in best], np.int64)
        if counts.sum():
            ids = np.concatenate([d for _, d in best])
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(q.numbers, counts)), pa.array(ids, mask=ids == np.iinfo(np.int64).max), pa.array(np.concatenate([s for s, _ in best]))], ["query", "doc_id", "score"])

    return vectors.select("doc_id", "terms", "values", "norm").mapInArrow(run, "query long, doc_id long, score long")


def _merged(found: DataFrame, k: int) -> DataFrame:
    """The k best rows of each query with their ranks, first within parts of its rows."""
    order = (F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    part = F.pmod(F.xxhash64("doc_id", "score"), F.lit(64))
    some = found.withColumn("part", part).withColumn("rank", F.row_number().over(Window.partitionBy("query", "part").orderBy(*order))).filter(F.col("rank") <= k)
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(*order))).filter(F.col("rank") <= k).select("query", "rank", "doc_id", "score")


def _query_blocks(terms: DataFrame) -> Iterator[tuple[list[int], list[tuple[int, int, int]]]]:
    """Queries and their (query, term, occurrences), QUERY_TERMS of them or one query at a time."""
    numbers: list[int] = []
    rows: list[tuple[int, int, int]] = []
    for r in terms.orderBy("query").toLocalIterator():
        if not numbers or numbers[-1] != r["query"]:
            if len(rows) >= QUERY_TERMS:
                yield numbers, rows
                numbers, rows = [], []
            numbers.append(r["query"])
        rows.append((r["query"], r["t"], r["qtf"]))
    if numbers:
        yield numbers, rows


def search(docs: DataFrame, items: DataFrame, k: int = 20) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: for each item its k documents of the highest score above 0, ties by ascending doc_id."""
    terms = query_terms(items)
    vocabulary, blocks = _vocabulary(terms)
    vectors = impacts(docs, vocabulary, blocks)
    out = [docs.sparkSession.createDataFrame([], "query long, rank int, doc_id long, score long")]
    if vectors is not None:
        order = (F.col("norm").desc(), F.col("row"))
        vectors = cut(vectors.repartitionByRange(*order).sortWithinPartitions(*order))
        parts = max(1, min(PARTS, vectors.count() // BUCKET))
        border = vectors.agg(F.percentile_approx("norm", 1 - 1 / parts)).first()[0] or 0.0
        # the files are in the order of lengths, so each filter reads its own
        longest, others = vectors.filter(F.col("norm") >= border), vectors.filter(F.col("norm") < border)
        numbered = terms.join(side(vocabulary, lambda v: v), "term").select("query", "t", "qtf")
        for numbers, rows in _query_blocks(numbered):
            first = cut(_merged(_searched(longest, Queries(numbers, rows, {}), k), k))
            floors = {r["query"]: r["score"] for r in first.filter(F.col("rank") == k).collect()}  # a row for each query of the block
            rest = _searched(others, Queries(numbers, rows, floors), k)
            out.append(cut(_merged(rest.unionByName(first.drop("rank")), k)))
    found = reduce(DataFrame.unionByName, out)
    return terms.select("item_id", "query").distinct().join(found, "query").select("item_id", "rank", "doc_id", "score")
