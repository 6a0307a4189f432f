"""Operator 10: SimHash near-dedup with pigeonring filtering.

Each text gets a 64-bit fingerprint: a bit is 1 if it is set in over half of
the hashes of its word shingles. For at most t differing bits the fingerprint
is cut into t + 1 segments on a ring. By the pigeonring principle two
fingerprints within t bits have a segment from which every chain of l
consecutive segments holds at most floor(l t / (t + 1)) differences. The first
segment is then equal and the next has at most one difference, so one of its
halves is equal too: both together are the join key. A pair that shares a key
is dropped as soon as a longer chain breaks its budget; what is left is a full
Hamming check.

Skew: only distinct fingerprints are joined. A key that more than HOT
fingerprints share is not paired out: its members meet at the points halfway
between them, each linked to the smallest member there, which keeps exactly the
same components with rows linear in the group. Components come from large-star
and small-star rounds over tables in the shared folder; what is joined back to
the links is a table too, so that adaptive execution may split a hub's rows.

Results for odd input: a null, empty or blank text has fingerprint zero and is
linked like any other; fewer words than a shingle are one shingle; repeated
rows and equal texts share a component; a null doc_id is never the smallest
unless its component has no other; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import cut, id_text_columns, side

#: A key with more distinct fingerprints than this is linked through halfway points.
HOT = 128
BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)
BYTE_AT = np.arange(8, dtype=np.int64) * 256


def shingle_hashes(text: bytes, words: int) -> np.ndarray:
    """Hashes of the text's shingles of so many words, as often as they occur."""
    tokens = text.lower().split()  # of bytes: A-Z and ASCII white space alone
    if not tokens:
        return np.zeros(0, np.uint64)
    joined = b" ".join(tokens)
    ends = np.cumsum([len(t) + 1 for t in tokens]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(words, len(tokens))
    spans = zip(starts[: len(tokens) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)
    return np.array([xxh64_intdigest(joined[a:b], 42) for a, b in spans], np.uint64)


def fingerprint_of(hashes: np.ndarray) -> int:
    """SimHash of shingle hashes, as an unsigned integer."""
    # how often each byte value occurs at each of the 8 places, then each bit's count
    seen = np.bincount((hashes.astype(">u8").view(np.uint8).reshape(-1, 8) + BYTE_AT).ravel(), minlength=2048).reshape(8, 256)
    return int.from_bytes(np.packbits((seen @ BITS) * 2 > len(hashes)).tobytes(), "big")


def fingerprint(text: bytes, words: int) -> int:
    """SimHash of the text's shingles of so many words, as an unsigned integer."""
    return fingerprint_of(shingle_hashes(text, words))


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """doc_id and its fingerprint (the 64 bits as a long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(x.as_py() or b"", words) for x in batch.column("text").cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.array(found, np.uint64).view(np.int64))], ["doc_id", "fp"])

    return id_text_columns(docs).mapInArrow(run, "doc_id long, fp long")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


class Ring:
    """Segments of 64 bits on a ring for at most ``most`` differences, and the budgets of chains of them."""

    def __init__(self, most: int):
        self.most, self.n = most, most + 1
        edges = [64 * i // self.n for i in range(self.n + 1)]
        self.spans = list(zip(edges, edges[1:], strict=False))

    def mask(self, first: int, length: int) -> int:
        return reduce(lambda x, y: x | y, (((1 << b) - (1 << a)) for a, b in (self.spans[(first + j) % self.n] for j in range(length))))

    def budget(self, length: int) -> int:
        return length * self.most // self.n

    def keys(self, fp: Column) -> Column:
        """An array of (chain's start, key): the first segment together with either half of the next."""
        out = []
        for i, (a, b) in enumerate(self.spans):
            c, d = self.spans[(i + 1) % self.n]
            for lo, hi in ((c, (c + d) // 2), ((c + d) // 2, d)):
                mask = ((1 << b) - (1 << a)) | ((1 << hi) - (1 << lo))
                out.append(F.struct(F.lit(i).alias("start"), F.lit(_signed(mask)).alias("mask"), fp.bitwiseAND(F.lit(_signed(mask))).alias("key")))
        return F.array(*out)

    def chains_hold(self, x: Column, start: Column) -> Column:
        """Whether every chain from the start stays within its budget; the last chain is the whole ring, the Hamming check."""
        tests = []
        for length in range(1, self.n + 1):
            masks = F.array(*(F.lit(_signed(self.mask(i, length))) for i in range(self.n)))
            tests.append(F.bit_count(x.bitwiseAND(F.element_at(masks, start + 1))) <= self.budget(length))
        return reduce(lambda p, q: p & q, tests)


def _flips(fp: Column, radius: int) -> Column:
    """The fingerprint with every set of at most ``radius`` bits turned over."""
    masks = [_signed(sum(1 << i for i in c)) for r in range(radius + 1) for c in combinations(range(64), r)]
    return F.transform(F.array(*(F.lit(m) for m in masks)), lambda m: fp.bitwiseXOR(m))


def links(fps: DataFrame, most: int) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column fp) whose components are those of "at most ``most`` bits differ"."""
    if not 1 <= most <= 4:
        raise ValueError("the number of differing bits must be from 1 to 4")
    ring = Ring(most)
    keyed = fps.select("fp", F.explode(ring.keys(F.col("fp"))).alias("k")).select("fp", "k.*")
    shared = keyed.groupBy("start", "mask", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    keyed = cut(keyed.join(side(shared), ["start", "mask", "key"]))
    cold = keyed.filter(F.col("n") <= HOT)
    a = cold.select("start", "mask", "key", F.col("fp").alias("a"))
    b = cold.select("start", "mask", "key", F.col("fp").alias("b"))
    near = a.join(b, ["start", "mask", "key"]).filter((F.col("a") < F.col("b")) & ring.chains_hold(F.col("a").bitwiseXOR(F.col("b")), F.col("start"))).select("a", "b")
    hot = keyed.filter(F.col("n") > HOT).select("fp").distinct()
    # of two fingerprints within t bits, one is within t // 2 of a point that is within the rest of the other
    inner, outer = most // 2, most - most // 2
    points = hot.select("fp", F.explode(_flips(F.col("fp"), outer)).alias("point"))
    # a point has one member for each way to reach it, a number that doesn't grow with the group
    if inner == outer:
        hubs = points.groupBy("point").agg(F.min("fp").alias("hub"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("point", "hub")
        met = points.join(hubs, "point").select(F.col("fp").alias("a"), F.col("hub").alias("b"))
    else:
        centres = hot.select(F.col("fp").alias("b"), F.explode(_flips(F.col("fp"), inner)).alias("point"))
        met = points.join(centres, "point").select(F.col("fp").alias("a"), "b")
    return near.unionByName(met.filter("a <> b"))


def components(edges: DataFrame) -> DataFrame:
    """Columns node and root (the smallest node reachable) for every node of the links (a, b)."""
    stars = cut(edges.filter("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct())
    before = None
    while True:
        mark = stars.agg(F.count(F.lit(1)), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if mark == before or mark[0] == 0:
            return stars.select(F.col("hi").alias("node"), F.col("lo").alias("root")).unionByName(stars.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct())
        before = mark
        both = stars.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(stars.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = side(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")))
        large = cut(both.join(least, "u").filter("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct())
        least = side(large.groupBy("hi").agg(F.min("lo").alias("m")))
        small = large.join(least, "hi").select(F.explode(F.array(F.struct("hi", "m"), F.struct(F.col("lo").alias("hi"), "m"))).alias("e")).select(F.col("e.hi").alias("hi"), F.col("e.m").alias("lo"))
        stars = cut(small.filter("hi <> lo").distinct())


def near_dedup(docs: DataFrame, words: int = 3, most: int = 2) -> DataFrame:
    """Per row of ``docs``: doc_id, fp and component_id, the smallest doc_id that links of at most ``most`` bits reach."""
    fps = cut(fingerprints(docs, words))
    distinct = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    roots = components(links(distinct.select("fp"), most))
    known = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = known.groupBy("root").agg(F.min("first_id").alias("component_id"))
    # every empty text shares one fingerprint
    return fps.join(side(known.join(least, "root").select("fp", "component_id")), "fp")
