"""Helpers that the operators share: scratch tables, bounded memos, Arrow columns."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch_dir(spark: SparkSession) -> str:
    """A new place in the shared folder that spark.checkpoint.dir names; only a local master may do without the setting."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="fernweave-")
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


def beside(docs: DataFrame, known: tuple[str, ...], work: Callable[[DataFrame], DataFrame], added: tuple[str, ...] = ()) -> DataFrame:
    """What ``work`` makes of ``docs`` while all columns but the ``known`` have names that no operator uses; then the columns as they were, and the ``added``."""
    names = {c: c if c in known else f"__own_{k}" for k, c in enumerate(docs.columns) if c not in added}
    aside = docs.select(*(F.col(f"`{old}`").alias(new) for old, new in names.items()))
    return work(aside).select(*(F.col(new).alias(old) for old, new in names.items()), *added)


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: the lineage ends there and survives lost executors."""
    path = scratch_dir(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut_free(df: DataFrame) -> DataFrame:
    """``cut``, after which the driver drops the shuffles that made the table; else they take disk until it happens to collect its garbage."""
    out = cut(df)
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()
    return out


def side(df: DataFrame, write: Callable[[DataFrame], DataFrame] = cut) -> DataFrame:
    """A written table to be joined to rows that a hot key may hold many of.

    It grows with the input, so it is merged at every size and never broadcast;
    as both sides of the join are plain shuffles, adaptive execution can split the key.
    """
    return write(df).hint("merge")


class Memo(dict):
    """A dict that computes missing values and holds at most two generations of ``limit`` entries."""

    def __init__(self, compute: Callable, limit: int):
        super().__init__()
        self.compute, self.limit, self.old = compute, limit, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.compute(key)
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value

    def take_in(self, values: dict) -> None:
        if len(self) + len(values) > self.limit:
            self.old = dict(self)
            self.clear()
        self.update(values)


def texts_of(column: pa.Array) -> Iterator[str]:
    """Python strings one after another, null as empty; only one is held at a time."""
    for value in column:
        yield value.as_py() or ""


def byte_view(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column as one array, and n + 1 offsets into it. Null is empty."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[ends[0] : ends[-1]], ends - ends[0]


def list_array(values: np.ndarray, lengths: np.ndarray, kind: pa.DataType) -> pa.Array:
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))


def binary_array(raw: bytes, cuts: np.ndarray) -> pa.Array:
    """The values of ``raw`` between n + 1 cuts. It holds ``raw`` itself; pyarrow never frees what memoryviews given to pa.array view."""
    return pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.array(cuts, pa.int32()).buffers()[1], pa.py_buffer(raw)])


def coded_parts(parts: pa.ListArray, code: Callable[[list[str]], list[bytes]], own: list[bytes], kind: np.dtype | type) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all lists of strings one after another, and how many each list has; every distinct string is coded once.

    ``code`` gives strings' ids as bytes; the first string of list k is ``own[k]``, coded already.
    """
    offsets = parts.offsets.to_numpy().astype(np.int64)
    flat = parts.values.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode()
    offsets -= offsets[0]
    coded = [*code(flat.dictionary.to_numpy(zero_copy_only=False).tolist()), *own]
    at = flat.indices.to_numpy().astype(np.int64)
    at[offsets[:-1]] = len(flat.dictionary) + np.arange(len(own))
    sizes = np.array([len(c) for c in coded], np.int64) // np.dtype(kind).itemsize
    ids = np.frombuffer(b"".join(coded), kind)
    n, first = sizes[at], (np.cumsum(sizes) - sizes)[at]
    ends = np.cumsum(n)
    take = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(first - (ends - n), n)
    return ids[take], np.diff(np.concatenate((np.zeros(1, np.int64), ends))[offsets])


def stretches(lengths: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Bounds of runs of rows whose lengths sum to about ``most`` (a longer row is a run of its own)."""
    group = np.cumsum(lengths) // most
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(lengths)]
    yield from ((a, b) for a, b in zip(cuts, cuts[1:], strict=False) if b > a)


def small_batches(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``most_bytes`` of ``column`` (a longer text is a batch of its own)."""
    for batch in batches:
        values = batch.column(column)
        if len(values) == 0:
            continue
        sizes = np.array([0 if x is None else x for x in pc.binary_length(values).to_pylist()], np.int64)
        for a, b in stretches(sizes, most_bytes):
            yield batch.slice(a, b - a)


def id_text_columns(docs: DataFrame) -> DataFrame:
    """Just doc_id and text, whatever else the table has."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


#: ASCII upper case to lower case, every other byte to itself.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit integers (a bijection)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def powers(n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(np.concatenate(([np.uint64(1)], np.full(max(n - 1, 0), _BASE))))


def spans_of(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of ``inside``, cut at the texts' ends."""
    if not len(inside):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.zeros(len(inside) + 1, bool)
    edge[1:-1] = inside[1:] != inside[:-1]
    edge[offsets] = True
    edge[-1] = True
    cuts = np.flatnonzero(edge)
    if cuts[0] != 0:
        cuts = np.concatenate(([0], cuts))
    keep = inside[cuts[:-1]]
    return cuts[:-1][keep], cuts[1:][keep]


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each of the spans of bytes (ascending, not overlapping, not empty)."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    first = np.cumsum(lengths) - lengths
    at = np.arange(int(lengths.sum())) - np.repeat(first, lengths)
    taken = raw[at + np.repeat(starts, lengths)]
    with np.errstate(over="ignore"):
        sums = np.add.reduceat((taken.astype(np.uint64) + np.uint64(1)) * powers(int(lengths.max()))[at], first)
        return mix(sums + lengths.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
