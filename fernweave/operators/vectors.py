"""Exact nearest neighbours: a stated query set against all vectors, block by block."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokens

#: Queries that are multiplied with all vectors in one pass.
BLOCK = 4096


def cosine(v: Column, q: list[float]) -> Column:
    """Dot product with a unit vector, in double."""
    return F.aggregate(F.zip_with(v, F.array(*(F.lit(float(x)) for x in q)), lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, x: s + x)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """query_id, vec_id, similarity and rank of the k nearest vectors of each query.

    Queries come in blocks of BLOCK. Each task multiplies its batches with the
    block and keeps its k best a query, so the shuffle holds k rows a query and
    task. Null vectors are left out, on both sides; vectors of another length
    than the queries' are an error.
    """
    vectors, queries = (x.filter("embedding is not null") for x in (vectors, queries))
    n = max(1, -(-queries.count() // BLOCK))
    parts = []
    for block in range(n):
        rows = queries.filter(F.pmod(F.xxhash64("vec_id"), F.lit(n)) == block).select("vec_id", "embedding").collect()  # of a stated query set, a block at a time
        if len({len(r["embedding"]) for r in rows}) > 1:
            raise ValueError("all queries must have vectors of one length")
        if rows:
            parts.append(_block(vectors, [r["vec_id"] for r in rows], np.array([r["embedding"] for r in rows], np.float64), k))
    if not parts:
        return vectors.sparkSession.createDataFrame([], "query_id long, vec_id long, similarity double, rank int")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "vec_id")
    return out.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _block(vectors: DataFrame, ids: list[int], q: np.ndarray, k: int) -> DataFrame:
    shared = vectors.sparkSession.sparkContext.broadcast((ids, q))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q = shared.value
        held = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)  # query's number, vec_id, similarity
        for batch in batches:
            if not batch.num_rows:
                continue
            if (np.array(pc.list_value_length(batch.column("embedding"))) != q.shape[1]).any():
                raise ValueError(f"all vectors must have {q.shape[1]} numbers, as the queries do")
            sims = np.round(batch.column("embedding").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1).astype(np.float64) @ q.T, 6)
            # whatever reaches the batch's k-th best, equal ones included
            least = np.partition(sims, -k, axis=0)[-k] if k < batch.num_rows else np.full(len(ids), -np.inf)
            row, of = np.nonzero(sims >= least)
            new = of, np.array(batch.column("vec_id"), np.int64)[row], sims[row, of]
            of, vec, sim = (np.concatenate(x) for x in zip(held, new, strict=True))
            order = np.lexsort((vec, -sim, of))
            of, vec, sim = of[order], vec[order], sim[order]
            best = np.arange(len(of)) - np.searchsorted(of, of) < k
            held = of[best], vec[best], sim[best]
        yield pa.RecordBatch.from_arrays([pa.array(np.array(ids, np.int64)[held[0]]), pa.array(held[1]), pa.array(held[2])], ["query_id", "vec_id", "similarity"])

    return vectors.select("vec_id", "embedding").mapInArrow(run, "query_id long, vec_id long, similarity double")


def hashed_embedding(docs: DataFrame, width: int = 64) -> DataFrame:
    """doc_id, bucket, weight: signed token counts by MD5, scaled to unit length."""
    words = docs.select("doc_id", F.explode(tokens(F.col("text"))).alias("t")).groupBy("doc_id", "t").agg(F.count(F.lit(1)).alias("n"))
    digest = F.md5(F.col("t").cast("binary"))
    bucket = F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("long"), F.lit(width))
    sign = F.when(F.conv(F.substring(digest, 9, 1), 16, 10).cast("int") < 8, 1).otherwise(-1)
    summed = words.groupBy("doc_id", bucket.alias("bucket")).agg(F.sum(F.col("n") * sign).alias("w"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("doc_id")))
    return summed.select("doc_id", "bucket", F.round(F.when(norm > 0, F.col("w") / norm).otherwise(0.0), 6).alias("weight"))
