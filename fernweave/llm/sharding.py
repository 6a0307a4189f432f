"""Operator 12: sharding by a k-d tree over documents' metadata.

Each group of equal texts is a point with a weight, the bytes of its rows, and
coordinates, the metadata of its first row: size, language, source and doc_id.
Starting with one cell that is to become so many leaves, every cell is split
along its widest dimension (its extent as a share of the whole table's) at the
weighted median, or at a weighted quantile where its number of leaves is odd,
until each cell is one leaf of about the target bytes.

A level of the tree takes a few passes over the points, each a grouped sum
before the shuffle: bytes by cell and slice of the dimension, then by slice of
the slice in which the median lies, until that slice is thin or holds one
coordinate alone; points of one coordinate are split by a hash in the same way.
No row is moved for a split. The driver holds the tree, a few numbers for each
of at most MOST_LEAVES leaves, which is also the bound of what is broadcast.

Groups: rows of equal texts share a shard. One heavier than SHARE of a leaf is
dealt by doc_id into pieces of about that weight at most, else no cut could
make the shards equal. Leaves differ from the target by
one point and by the thickness of the last slice for each level.

Results for odd input: null and empty texts are equal and weigh one byte a row;
rows of a null doc_id come first in their shard; null metadata is a coordinate
below all others; rows with equal doc_id are separate rows; a table of fewer
points than shards leaves shards empty; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from math import inf

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, side

#: Leaves of a tree at most; share of a leaf over which a group of equal texts is dealt into pieces.
MOST_LEAVES, SHARE = 16_384, 1 / 16
#: Slices of a cell in one pass, passes for one split at most, and how much of a leaf the last slice may weigh.
SLICES, PASSES, THIN = 256, 12, 1 / 128


def ordered(text: Column) -> Column:
    """A number that orders strings by their first six bytes (null below all)."""
    return F.coalesce(F.conv(F.rpad(F.hex(F.substring(text.cast("binary"), 1, 6)), 12, "0"), 16, 10).cast("double"), F.lit(-1.0))


def dimensions(docs: DataFrame) -> dict[str, Column]:
    """Coordinates that documents have by default: size (as a logarithm), language, source and doc_id, as far as the table has them."""
    out = {"size": F.log2(F.coalesce(F.octet_length("text"), F.lit(0)) + 1.0)}
    out |= {c: ordered(F.col(c).cast("string")) for c in ("lang", "source") if c in docs.columns}
    return out | {"doc_id": F.coalesce(F.col("doc_id").cast("double"), F.lit(-1.0))}


@dataclass
class Cell:
    """A node: ``leaves`` to be made of it from number ``first`` on; once split, a point goes left if its (coordinate, tie) is below (value, tie)."""

    first: int
    leaves: int
    dim: int = 0
    value: float = -inf
    tie: float = 0.0


def _weigh(docs: DataFrame, dims: Sequence[Column]) -> DataFrame:
    """doc_id, size, text_crc32, the text's digest, the row's coordinates and a number of its own."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.unhex(F.md5(text.cast("binary"))).alias("digest"), F.array(*(d.cast("double") for d in dims)).alias("at"))
    return cut(rows.withColumn("row", F.monotonically_increasing_id()))


def _pieces(rows: DataFrame, most: float) -> DataFrame:
    """The rows with the piece of their group that they belong to; groups of up to ``most`` bytes are one piece."""
    # their bytes are over ``most`` each, so there are no more than total / most of them
    heavy = rows.groupBy("digest").agg(F.sum("size").alias("bytes")).filter(F.col("bytes") > most).select("digest", F.ceil(F.col("bytes") / most).alias("pieces"))
    spread = F.pmod(F.xxhash64(F.coalesce("doc_id", "row")), F.coalesce("pieces", F.lit(1)))
    return rows.join(F.broadcast(heavy), "digest", "left").withColumn("piece", spread.cast("int")).drop("pieces")


def _points(rows: DataFrame) -> DataFrame:
    """One row for each piece: bytes, coordinates of its first row, and a hash that breaks ties of coordinates."""
    points = rows.groupBy("digest", "piece").agg(F.sum("size").alias("bytes"), F.min(F.struct(F.col("doc_id"), F.col("at"))).alias("least"))
    return points.select("digest", "piece", "bytes", F.col("least.at").alias("at"), (F.xxhash64("digest", "piece") / F.lit(2.0**63)).alias("tie"))


def _placed(points: DataFrame, tree: list[dict[int, Cell]], name: str = "cell") -> DataFrame:
    """The points with the number of the first leaf of the cell in which they lie after the tree's levels."""
    out = points.withColumn(name, F.lit(0))
    for level in tree:
        split = {k: c for k, c in level.items() if c.leaves > 1}
        if not split:
            continue
        rule = F.broadcast(points.sparkSession.createDataFrame([(k, c.dim, c.value, c.tie, c.first + c.leaves // 2) for k, c in split.items()], "__cell int, __dim int, __value double, __tie double, __right int"))
        along = F.get("at", F.col("__dim"))
        right = (along > F.col("__value")) | ((along == F.col("__value")) & (F.col("tie") >= F.col("__tie")))
        out = out.join(rule, out[name] == rule["__cell"], "left").withColumn(name, F.when(right, F.col("__right")).otherwise(F.col(name))).select(*points.columns, name)
    return out


class _Search:
    """The weighted quantile of each cell along its dimension, narrowed down slice by slice."""

    def __init__(self, placed: DataFrame, cells: dict[int, Cell], extent: dict[int, tuple[list[float], list[float]]], weight: dict[int, int], thin: float):
        self.placed, self.cells, self.thin = placed, cells, thin
        #: Bounds of what is still looked at: coordinate, then hash once a single coordinate is left; bytes to find in it.
        self.low = {k: extent[k][0][c.dim] for k, c in cells.items()}
        self.high = {k: extent[k][1][c.dim] for k, c in cells.items()}
        self.want = {k: weight[k] * (c.leaves // 2) / c.leaves for k, c in cells.items()}
        self.tied: set[int] = {k for k in cells if self.low[k] == self.high[k]}
        for k in self.tied:
            self._to_ties(k)

    def _to_ties(self, k: int) -> None:
        self.cells[k].value = self.low[k]
        self.low[k], self.high[k] = -1.0, 1.0
        self.tied.add(k)

    def run(self) -> None:
        open_ = set(self.cells)
        for _ in range(PASSES):
            if not open_:
                return
            open_ = self._pass(open_)
        for k in open_:
            self._settle(k, self.low[k])

    def _pass(self, open_: set[int]) -> set[int]:
        cells = {k: self.cells[k] for k in open_}
        spark = self.placed.sparkSession
        rows = [(k, c.dim, k in self.tied, c.value if k in self.tied else 0.0, self.low[k], self.high[k]) for k, c in cells.items()]
        rule = F.broadcast(spark.createDataFrame(rows, "__cell int, __dim int, __tied boolean, __value double, __low double, __high double"))
        along = F.get("at", F.col("__dim"))
        near = self.placed.join(rule, self.placed["cell"] == rule["__cell"]).filter(~F.col("__tied") | (along == F.col("__value")))
        near = near.withColumn("x", F.when(F.col("__tied"), F.col("tie")).otherwise(along)).filter((F.col("x") >= F.col("__low")) & (F.col("x") <= F.col("__high")))
        width = F.col("__high") - F.col("__low")
        near = near.withColumn("slice", F.least(F.lit(SLICES - 1), F.floor((F.col("x") - F.col("__low")) / width * SLICES)).cast("int"))
        sums = near.groupBy("cell", "slice").agg(F.sum("bytes").alias("bytes"), F.min("x").alias("least"), F.max("x").alias("most"))
        by_cell: dict[int, list] = {k: [] for k in open_}
        for r in sums.collect():  # at most SLICES rows for a cell
            by_cell[r["cell"]].append(r)
        again = set()
        for k, slices in by_cell.items():
            before = 0
            for r in sorted(slices, key=lambda r: r["slice"]):
                if before + r["bytes"] > self.want[k]:
                    self.low[k], self.high[k], self.want[k] = r["least"], r["most"], self.want[k] - before
                    # the nearer border of a thin slice will do
                    if r["bytes"] <= self.thin:
                        self._settle(k, r["least"] if self.want[k] < r["bytes"] / 2 else float(np.nextafter(r["most"], inf)))
                    elif r["least"] == r["most"]:
                        if k in self.tied:
                            self._settle(k, r["least"] if self.want[k] < r["bytes"] / 2 else float(np.nextafter(r["most"], inf)))
                        else:
                            self._to_ties(k)
                            again.add(k)
                    else:
                        again.add(k)
                    break
                before += r["bytes"]
            else:
                self._settle(k, self.high[k])
        return again

    def _settle(self, k: int, border: float) -> None:
        if k in self.tied:
            self.cells[k].tie = border
        else:
            self.cells[k].value, self.cells[k].tie = border, -1.0


def _check(leaves: int) -> None:
    if not 1 <= leaves <= MOST_LEAVES:
        raise ValueError(f"a tree has 1 to {MOST_LEAVES} leaves, not {leaves}; take larger shards")


def grow(points: DataFrame, n: int, leaves: int) -> list[dict[int, Cell]]:
    """The tree's levels over n dimensions: cells by the number of their first leaf. Splits divide the bytes in the ratio of the leaves to either side."""
    _check(leaves)
    tree: list[dict[int, Cell]] = []
    level = {0: Cell(0, leaves)}
    whole = None
    while any(c.leaves > 1 for c in level.values()):
        placed = _placed(points, tree)
        bounds = [f(F.get("at", F.lit(d))).alias(f"{name}{d}") for d in range(n) for name, f in (("lo", F.min), ("hi", F.max))]
        found = {r["cell"]: r for r in placed.groupBy("cell").agg(F.sum("bytes").alias("bytes"), *bounds).collect()}  # a row for each cell
        extent = {k: ([r[f"lo{d}"] for d in range(n)], [r[f"hi{d}"] for d in range(n)]) for k, r in found.items()}
        whole = whole or extent.get(0)
        split = {}
        for k, cell in level.items():
            if cell.leaves > 1 and k in found:
                low, high = extent[k]
                cell.dim = max(range(n), key=lambda d: (high[d] - low[d]) / ((whole[1][d] - whole[0][d]) or inf))
                split[k] = cell
        total = sum(r["bytes"] for r in found.values())
        _Search(placed, split, extent, {k: found[k]["bytes"] for k in split}, THIN * total / leaves).run()
        tree.append(level)
        below = {}
        for cell in level.values():
            half = cell.leaves // 2
            if half:
                below[cell.first] = Cell(cell.first, half)
            below[cell.first + half] = Cell(cell.first + half, cell.leaves - half)
        level = below
    return tree


def shard(docs: DataFrame, shards: int | None = None, target_bytes: int | None = None, dims: dict[str, Column] | None = None) -> DataFrame:
    """Per row: doc_id, size, text_crc32, shard and slot (its place in its shard, by doc_id).

    Either the number of ``shards`` is given or the bytes that a shard is to
    have; ``dims`` are the coordinates, numbers that aren't null.
    """
    if (shards is None) == (target_bytes is None):
        raise ValueError("give either the number of shards or their target bytes")
    dims = dims or dimensions(docs)
    rows = _weigh(docs, list(dims.values()))
    total = rows.agg(F.sum("size")).first()[0] or 0
    leaves = shards if shards is not None else max(1, -(-total // target_bytes))
    _check(leaves)
    rows = cut(_pieces(rows, max(1.0, SHARE * total / leaves)))
    points = cut(_points(rows))
    homes = _placed(points, grow(points, len(dims), leaves), "shard").select("digest", "piece", "shard")
    return numbered(rows.drop("at").join(side(homes), ["digest", "piece"]).select("doc_id", "size", "text_crc32", "shard", "row"))


def numbered(rows: DataFrame) -> DataFrame:
    """The rows (doc_id, size, text_crc32, shard, row) with their places in their shards: ranges of (shard, doc_id) are counted, then rows within them."""
    order = (F.col("shard"), F.col("doc_id").asc_nulls_first(), F.col("text_crc32"), F.col("row"))
    names = ["doc_id", "size", "text_crc32", "shard"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, int] = {}
        for batch in batches:
            shards = np.array(batch.column("shard"), np.int64)
            starts = np.concatenate(([0], np.flatnonzero(np.diff(shards)) + 1, [len(shards)]))
            place = np.zeros(len(shards), np.int64)
            for a, b in zip(starts.tolist(), starts[1:].tolist(), strict=False):
                if b > a:
                    k = int(shards[a])
                    place[a:b] = np.arange(b - a) + seen.get(k, 0)
                    seen[k] = seen.get(k, 0) + b - a
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), batch.column("part"), pa.array(place)], [*names, "part", "place"])

    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    placed = cut(ranged.drop("row").mapInArrow(count, "doc_id long, size long, text_crc32 long, shard int, part int, place long"))
    # a row for each range, and one more for each shard
    parts = placed.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = parts.select("shard", "part", before.alias("start"))
    return placed.join(side(starts), ["shard", "part"]).select(*names, (F.col("start") + F.col("place")).alias("slot"))


def write(docs: DataFrame, sharded: DataFrame, target: str) -> None:
    """Write the documents as Parquet folders shard=0, 1 and so on, each in the order of its slots. doc_ids must be given and unique."""
    placed = docs.join(side(sharded.select("doc_id", "shard", "slot")), "doc_id")
    placed.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(target)
