"""Exact nearest neighbours without a look at every vector: clusters around pivots, with bounds from the triangle inequality.

An index has a bounded number of pivots, and every vector v with the nearest
pivot p, its distance r from it and its squared length, sorted by pivot and
distance. For a query q with |q - p| = d no vector of the cluster is nearer to q
than |d - r|, so its dot product is at most (|q|^2 + |v|^2 - (d - r)^2) / 2. That
holds for vectors of any length. The clusters next to each query are searched
first; the k-th similarity found there is what others must be able to reach, by
the cluster's bounds, which choose what is read, and then by each vector's own.

Null vectors are left out, on both sides; vectors of another length than the
pivots' are an error.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Pivots of an index at most, queries that are searched together, bytes of a row group, and what rounding can hide.
PIVOTS, BLOCK, GROUP_BYTES, SLACK = 256, 2048, 4 << 20, 1e-5


@dataclass
class Pivots:
    vectors: DataFrame
    #: The pivots; of each cluster the number of vectors, the bounds of their distances and the greatest squared length.
    pivots: np.ndarray
    sizes: np.ndarray
    near: np.ndarray
    far: np.ndarray
    longest: np.ndarray


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    if len(column) and (np.array(pc.list_value_length(column)) != width).any():
        raise ValueError(f"all vectors must have {width} numbers, as the pivots do")
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), width)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of each row of a from each row of b."""
    return np.sqrt(np.maximum((a**2).sum(1)[:, None] + (b**2).sum(1)[None] - 2 * a @ b.T, 0))


def build(vectors: DataFrame, target: str, pivots: int = PIVOTS) -> None:
    """Write an index of ``vectors`` (vec_id, embedding) to a new folder; the pivots are those whose hashes come first."""
    spark = vectors.sparkSession
    rows = vectors.select("vec_id", "embedding").filter("embedding is not null")
    n = rows.count()
    chosen = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(max(1, min(pivots, round(n**0.5)))).collect()  # PIVOTS at most
    held = np.array([r["embedding"] for r in chosen], np.float64)
    shared = spark.sparkContext.broadcast(held)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = _matrix(batch.column("embedding"), shared.value.shape[1])
            d = _distances(v, shared.value)
            own = d.argmin(1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own.astype(np.int32)), pa.array(d[np.arange(len(v)), own]), pa.array((v**2).sum(1))], ["vec_id", "embedding", "cluster", "r", "square"])

    kind = f"vec_id {rows.schema['vec_id'].dataType.simpleString()}, embedding {rows.schema['embedding'].dataType.simpleString()}, cluster int, r double, square double"
    placed = rows.mapInArrow(assign, kind) if n else spark.createDataFrame([], kind)
    placed.repartitionByRange("cluster", "r", "vec_id").sortWithinPartitions("cluster", "r").write.option("parquet.block.size", GROUP_BYTES).parquet(f"{target}/vectors")
    bounds = spark.read.parquet(f"{target}/vectors").groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.min("r").alias("near"), F.max("r").alias("far"), F.max("square").alias("longest"))
    points = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(held)], "cluster int, pivot array<double>")
    points.join(bounds, "cluster").coalesce(1).write.parquet(f"{target}/clusters")


def load(spark: SparkSession, target: str) -> Pivots | None:
    """The index in the folder; None where none was finished."""
    try:
        rows = spark.read.parquet(f"{target}/clusters").orderBy("cluster").collect()  # PIVOTS at most
    except AnalysisException:
        return None
    # clusters without vectors aren't listed, so the number of the last one tells how many there are
    n = max((r["cluster"] for r in rows), default=-1) + 1
    width = len(rows[0]["pivot"]) if rows else 0
    out = Pivots(spark.read.parquet(f"{target}/vectors"), np.full((n, width), np.inf), np.zeros(n, np.int64), np.zeros(n), np.zeros(n), np.zeros(n))
    for r in rows:
        k = r["cluster"]
        out.pivots[k], out.sizes[k], out.near[k], out.far[k], out.longest[k] = r["pivot"], r["n"], r["near"], r["far"], r["longest"]
    return out


class _Asked:
    """A block of queries: their vectors, distances from the pivots, what they must reach, and the clusters that each one wants."""

    def __init__(self, index: Pivots, ids: np.ndarray, q: np.ndarray):
        self.ids, self.q, self.square = ids, q, (q**2).sum(1)
        self.sizes, full = index.sizes, index.sizes > 0
        self.d = np.full((len(q), len(full)), np.inf)
        self.d[:, full] = _distances(q, index.pivots[full])
        self.floor = np.full(len(q), -np.inf)
        gap = np.maximum(np.maximum(index.near - self.d, self.d - index.far), 0)
        self.bound = np.where(full, (self.square[:, None] + index.longest - gap**2) / 2, -np.inf)
        self.wants = np.zeros(self.d.shape, bool)

    def next_to(self, k: int) -> None:
        """Want the nearest clusters that have k vectors together."""
        order = np.argsort(self.d, axis=1)
        before = np.cumsum(self.sizes[order], axis=1) - self.sizes[order]
        np.put_along_axis(self.wants, order, (before < k) & (self.sizes[order] > 0), axis=1)

    def others(self) -> None:
        """Want the clusters that weren't searched and can reach the floor."""
        self.wants = ~self.wants & (self.bound >= self.floor[:, None] - SLACK)


def _search(rows: DataFrame, asked: _Asked, k: int) -> DataFrame:
    """query_id, vec_id, similarity of each task's k best of every query that reach its floor, and seen, the products that the task took for it."""
    clusters = np.flatnonzero(asked.wants.any(0)).tolist()
    shared = rows.sparkSession.sparkContext.broadcast(asked)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = shared.value
        best: list[list[np.ndarray]] = [[np.zeros(0, np.int64), np.zeros(0)] for _ in a.ids]
        seen = np.zeros(len(a.ids), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            v = _matrix(batch.column("embedding"), a.q.shape[1])
            cluster, r, square = (batch.column(c).to_numpy() for c in ("cluster", "r", "square"))
            ids = np.array(batch.column("vec_id"), np.int64)
            for c in np.unique(cluster).tolist():
                some = np.flatnonzero(cluster == c)
                queries = np.flatnonzero(a.wants[:, c])
                may = (a.square[queries][:, None] + square[some] - (a.d[queries, c][:, None] - r[some]) ** 2) / 2 >= a.floor[queries][:, None] - SLACK
                queries, may = queries[may.any(1)], may[may.any(1)]
                if not len(queries):
                    continue
                some, may = some[may.any(0)], may[:, may.any(0)]
                sims = np.round(a.q[queries] @ v[some].T, 6)
                for i, q in enumerate(queries.tolist()):
                    seen[q] += int(may[i].sum())
                    good = may[i] & (sims[i] >= a.floor[q])
                    found = np.concatenate((best[q][0], ids[some[good]])), np.concatenate((best[q][1], sims[i][good]))
                    top = np.lexsort((found[0], -found[1]))[:k]
                    best[q] = [found[0][top], found[1][top]]
        n = np.array([len(b[0]) for b in best], np.int64)
        # a row without a vector carries what a task saw for a query
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate((np.repeat(a.ids, n), a.ids))), pa.array([*np.concatenate([b[0] for b in best]).tolist(), *[None] * len(n)], pa.int64()), pa.array(np.concatenate([*(b[1] for b in best), np.zeros(len(n))])), pa.array(np.concatenate((np.zeros(int(n.sum()), np.int64), seen)))],
            ["query_id", "vec_id", "similarity", "seen"],
        )

    return rows.filter(F.col("cluster").isin(*clusters)).mapInArrow(run, "query_id long, vec_id long, similarity double, seen long")


def nearest(index: Pivots, queries: DataFrame, k: int = 10, allowed: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """query_id, vec_id, similarity and rank of the k nearest vectors of each query (vec_id, embedding), and query_id with n_seen, the vectors compared for it.

    ``allowed`` (vec_id) narrows the vectors before any is ranked. Queries come in blocks of BLOCK.
    """
    spark = index.vectors.sparkSession
    rows = index.vectors if allowed is None else index.vectors.join(allowed.select("vec_id").distinct(), "vec_id", "left_semi")
    queries = queries.select("vec_id", "embedding").filter("embedding is not null")
    n = max(1, -(-queries.count() // BLOCK))
    place = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "vec_id")
    out = spark.createDataFrame([], "query_id long, vec_id long, similarity double, seen long")
    for block in range(n):
        some = queries.filter(F.pmod(F.xxhash64("vec_id"), F.lit(n)) == block).collect()  # of a stated query set, a block at a time
        if not some or not len(index.sizes):
            continue
        asked = _Asked(index, np.array([r["vec_id"] for r in some], np.int64), np.array([r["embedding"] for r in some], np.float64))
        asked.next_to(k)
        first = _search(rows, asked, k).collect()  # k rows a query and task of the few clusters next to it
        found: dict[int, list[float]] = {}
        for r in first:
            if r["vec_id"] is not None:
                found.setdefault(r["query_id"], []).append(r["similarity"])
        for i, q in enumerate(asked.ids.tolist()):
            sims = sorted(found.get(q, []), reverse=True)
            if len(sims) >= k:
                asked.floor[i] = sims[k - 1]
        asked.others()
        out = out.unionByName(spark.createDataFrame(first, out.schema))
        if asked.wants.any():
            out = out.unionByName(_search(rows, asked, k))
    best = out.filter("vec_id is not null").withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= k).drop("seen")
    return best, out.groupBy("query_id").agg(F.sum("seen").alias("n_seen"))
