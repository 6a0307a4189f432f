"""Near duplicates by the Jaccard similarity of word shingles: SimHash and min-hash candidates, verified.

Rows with equal sets of shingles are one node. Candidates are nodes whose
SimHashes lie within a few bits (pigeonring) and nodes that share one of BANDS
keys of ROWS min-hashes; a pair of similarity 0.8 shares one with a probability
of 1 - (1 - 0.8**4)**20, over 0.9999. Every candidate is verified on the sets
of both, and groups are the components of the verified links.

Skew: a key that more than HOT nodes share is not paired out. The nodes of such
keys are joined by their rarest shingles instead, which is exact: two sets of
that similarity share one of the first n - ceil(0.8 n) + 1 shingles of both in
any order that all nodes keep, here by how many of the nodes hold them (counted
in a fixed number of cells, so that two shingles may share a count), and the
places of the first shared one bound how many they can share at all. What a copy has alone
comes first in that order, so copies that are too far from all others drop out
at once, however large their group is. Where more than HOT nodes share a rare
shingle too, each is verified against the key's two heads; then the nodes that
aren't in the key's largest component go against all others of the key, under
the same bounds. Pairs within one component add nothing and are the only ones
left out, so no link between components is lost, and no number of partners is
capped.

Results for odd input: null, empty and blank texts have the empty set and are
equal; fewer words than a shingle are one shingle; every row is judged by
itself, even if doc_ids repeat or are null; other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_128_digest

from .common import beside, cut, mix, side, small_batches
from .simhash import components, fingerprint_of, links, shingle_hashes

#: Least Jaccard similarity, in hundredths.
PERCENT = 80
ROWS, BANDS = 4, 20
#: A key with more nodes than this is not paired out.
HOT = 16
BLOCK = 4096
#: Cells by whose counts shingles are ordered, a byte each, and how many of them one task puts together.
CELLS, PAGE = 1 << 22, 1 << 17
ODD = np.uint64(0x9E3779B97F4A7C15)


def band_keys(hashes: np.ndarray, rows: int, bands: int) -> np.ndarray:
    """A key for each band of min-hashes of the distinct shingle hashes; none for the empty set."""
    if not len(hashes):
        return np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        salts = mix(np.arange(1, rows * bands + 1, dtype=np.uint64) * ODD + np.uint64(rows))
        least = np.full(rows * bands, np.iinfo(np.uint64).max, np.uint64)
        for a in range(0, len(hashes), BLOCK):
            least = np.minimum(least, ((hashes[a : a + BLOCK, None] ^ salts) * (salts | np.uint64(1))).min(0))
        key = np.arange(bands, dtype=np.uint64) + np.uint64(rows << 32)
        for column in least.reshape(bands, rows).T:
            key = mix(key * ODD + column)
    return key.view(np.int64)


def signatures(rows: DataFrame, words: int) -> DataFrame:
    """row, doc_id, fp, digest of the set, its size n and its bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text", 4 << 20):
            fps, digests, sizes, keys = [], [], [], []
            for x in batch.column("text").cast(pa.binary()):
                hashes = shingle_hashes(x.as_py() or b"", words)
                some = np.unique(hashes)
                fps.append(fingerprint_of(hashes))
                digests.append(xxh3_128_digest(some.tobytes()))
                sizes.append(len(some))
                keys.append(band_keys(some, ROWS, BANDS))
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(digests, pa.binary()), pa.array(sizes, pa.int32()), pa.array(keys, pa.list_(pa.int64()))], ["row", "doc_id", "fp", "digest", "n", "bands"])

    return rows.mapInArrow(run, "row long, doc_id long, fp long, digest binary, n int, bands array<long>")


def _sets(rows: DataFrame, nodes: DataFrame, words: int) -> DataFrame:
    """node and its set of shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text", 2 << 20):
            values = [np.unique(shingle_hashes(x.as_py() or b"", words)).view(np.int64) for x in batch.column("text").cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(values, pa.list_(pa.int64()))], ["node", "of"])

    return rows.join(nodes, rows["row"] == nodes["node"], "left_semi").select("row", "text").mapInArrow(run, "node long, of array<long>")


def _shared(keyed: DataFrame) -> DataFrame:
    """The rows whose key two and more nodes have, with that number."""
    counts = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("many")).filter("many > 1")
    return cut(keyed.join(side(counts), "key"))


def _fits() -> Column:
    """Whether nodes (n_a, after_a) and (n_b, after_b) can share enough: ``after`` shingles follow a first shared one."""
    return (100 + PERCENT) * (1 + F.least("after_a", "after_b")) >= PERCENT * (F.col("n_a") + F.col("n_b"))


def _side(rows: DataFrame, x: str, *more: str) -> DataFrame:
    return rows.select("key", *(F.col(c).alias(f"{c}_{x}") for c in ("node", "n", "after", *more)))


def _paired(shared: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes of each key that isn't hot, under the bound."""
    cold = shared.filter(F.col("many") <= HOT)
    return _side(cold, "a").join(_side(cold, "b"), "key").filter((F.col("node_a") < F.col("node_b")) & _fits()).select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))


def _counters(sets: DataFrame) -> np.ndarray:
    """In how many sets the shingles of each of CELLS cells stand, up to 255; a shingle's own number is no greater than its cell's."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells, n = np.unique(_cell(batch.column("of").flatten().to_numpy()), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array((cells // PAGE).astype(np.int32)), pa.array((cells % PAGE).astype(np.int32)), pa.array(n)], ["page", "cell", "n"])

    def page(key: tuple, table: pa.Table) -> pa.Table:
        total = np.bincount(table.column("cell").to_numpy(), table.column("n").to_numpy(), PAGE)
        return pa.table({"page": pa.array([key[0].as_py()], pa.int32()), "counts": pa.array([np.minimum(total, 255).astype(np.uint8).tobytes()], pa.binary())})

    pages = sets.select("of").mapInArrow(count, "page int, cell int, n long").groupBy("page").applyInArrow(page, "page int, counts binary")
    out = np.zeros(CELLS, np.uint8)
    for r in pages.collect():  # CELLS bytes together
        out[r["page"] * PAGE : (r["page"] + 1) * PAGE] = np.frombuffer(r["counts"], np.uint8)
    return out


def _cell(shingles: np.ndarray) -> np.ndarray:
    return (mix(shingles.view(np.uint64)) % np.uint64(CELLS)).astype(np.int64)


def _rare(sets: DataFrame) -> DataFrame:
    """node, n, key, after: the shingles one of which a partner shares, rarest first; those of one node alone only move the others' places.

    Any order that is the same for all nodes will do, so rarity is told by the cells' counts.
    """
    shared = sets.sparkSession.sparkContext.broadcast(_counters(sets))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, sizes, keys, places = [], [], [], []
            for node, of in zip(batch.column("node").to_pylist(), batch.column("of"), strict=True):
                hashes = of.values.to_numpy()
                counts = shared.value[_cell(hashes)]
                n, some = len(hashes), counts > 1
                ordered = hashes[some][np.lexsort((hashes[some], counts[some]))]
                first = max(0, len(ordered) - (PERCENT * n + 99) // 100 + 1)
                nodes += [node] * first
                sizes += [n] * first
                keys.append(ordered[:first])
                places.append(len(ordered) - 1 - np.arange(first))
            flat = lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(sizes, pa.int32()), pa.array(flat(keys), pa.int64()), pa.array(flat(places), pa.int64())], ["node", "n", "key", "after"])

    return sets.mapInArrow(run, "node long, n int, key long, after long")


def _starred(crowded: DataFrame) -> DataFrame:
    """Each node of a hot key with the key's heads: the node with the fewest shingles before the key, and one by hash."""
    me = F.struct("node", "n", "after")
    heads = crowded.groupBy("key").agg(F.array(F.min_by(me, F.struct(F.col("n") - F.col("after"), "node")), F.min_by(me, F.struct(F.xxhash64("node", "key"), "node"))).alias("heads"))
    heads = heads.select("key", F.explode(F.array_distinct("heads")).alias("h")).select("key", "h.*")
    # the pairs of a node's keys are mostly the same ones
    return _side(crowded, "a").join(_side(heads, "b"), "key").filter(F.expr("node_a <> node_b") & _fits()).select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b")).distinct()


def _outside(crowded: DataFrame, found: DataFrame) -> DataFrame:
    """Pairs of the nodes of each hot key that aren't in its largest component with its nodes of other components."""
    known = cut(crowded.join(components(found), "node", "left").select("key", "node", "n", "after", F.coalesce("root", "node").alias("root")))
    sizes = known.groupBy("key", "root").agg(F.count(F.lit(1)).alias("size"), F.min("n").alias("least"))
    core = sizes.groupBy("key").agg(F.max(F.struct("size", "root")).alias("core"), F.min("least").alias("least")).select("key", F.col("core.root").alias("core"), "least")
    able = (100 + PERCENT) * (1 + F.col("after")) >= PERCENT * (F.col("n") + F.col("least"))
    others = cut(known.join(side(core), "key").filter(F.expr("root <> core") & able).select("key", "node", "n", "after", "root"))
    pairs = _side(known, "a", "root").join(_side(others, "b", "root"), "key").filter(F.expr("root_a <> root_b") & _fits())
    return pairs.select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b")).distinct()


def _near_fingerprints(nodes: DataFrame, most: int) -> DataFrame:
    """Pairs of nodes by SimHash: those of one fingerprint with its first, and the first ones of linked fingerprints."""
    first = cut(nodes.groupBy("fp").agg(F.min("node").alias("first")))
    same = nodes.join(first, "fp").filter("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b"))
    near = links(first.select("fp"), most)
    ends = [first.select(F.col("fp").alias(x), F.col("first").alias(f"n_{x}")) for x in "ab"]
    near = near.join(ends[0], "a").join(ends[1], "b").select(F.least("n_a", "n_b").alias("a"), F.greatest("n_a", "n_b").alias("b"))
    return same.unionByName(near)


def verified(rows: DataFrame, pairs: DataFrame, words: int) -> DataFrame:
    """The pairs (a, b) whose sets have the similarity."""
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    sets = cut(_sets(rows, nodes, words))
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("of").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("of").alias("y")), "b")
    common = F.size(F.array_intersect("x", "y"))
    return both.withColumn("common", common).filter(100 * F.col("common") >= PERCENT * (F.size("x") + F.size("y") - F.col("common"))).select("a", "b")


def groups(rows: DataFrame, words: int, most: int) -> DataFrame:
    """row, doc_id and head (the row of the group with the smallest doc_id, null last) of a table of row, doc_id and text that doesn't change."""
    signed = cut(signatures(rows, words))
    nodes = cut(signed.groupBy("digest").agg(F.min("row").alias("node"), F.min("fp").alias("fp"), F.first("n").alias("n"), F.first("bands").alias("bands")))
    # a band says nothing about places: all shingles may follow
    shared = _shared(nodes.select("node", "n", (F.col("n") - 1).alias("after"), F.explode("bands").alias("key")))
    pairs = _near_fingerprints(nodes.select("node", "fp"), most).unionByName(_paired(shared))
    hot = cut(shared.filter(F.col("many") > HOT).select("node").distinct())
    crowded = None
    if not hot.isEmpty():
        rare = _shared(_rare(cut(_sets(rows, hot, words))))
        crowded = rare.filter(F.col("many") > HOT)
        pairs = pairs.unionByName(_paired(rare)).unionByName(_starred(crowded))
    found = cut(verified(rows, cut(pairs.distinct()), words))
    if crowded is not None and not crowded.isEmpty():
        found = found.unionByName(verified(rows, cut(_outside(crowded, found)), words))
    roots = components(found)
    known = nodes.select("digest", "node").join(roots, "node", "left").select("digest", F.coalesce("root", "node").alias("root"))
    member = cut(signed.select("row", "doc_id", "digest").join(known, "digest"))
    heads = side(member.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row")).alias("head")))
    return member.join(heads, "root").select("row", "doc_id", F.col("head.row").alias("head"))


def one_of_each(docs: DataFrame, words: int, most: int) -> DataFrame:
    """The row with the smallest doc_id of each group of near duplicates, with its columns."""
    def work(docs: DataFrame) -> DataFrame:
        kept = cut(docs.withColumn("__row", F.monotonically_increasing_id()))
        rows = kept.select(F.col("__row").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        heads = groups(rows, words, most).filter("row = head").select(F.col("row").alias("__row"))
        return kept.join(heads, "__row", "left_semi")

    return beside(docs, ("doc_id", "text"), work)
