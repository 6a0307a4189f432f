"""A persisted full-text index that changes in place: immutable segments, tombstones, generations.

A unit is a document, or one of its pieces (doc_id, ordinal). A segment is a
folder of Parquet tables that is never written again: ``units`` (every column
but the text, and dl), ``postings`` (term, doc_id, ordinal, dl, tf, positions),
``blocks`` (by term and BLOCK neighbouring doc_ids: the largest tf, the least dl
and the number of postings; a block that goes over files has a row in each), ``docs``
(each document's mark, by which a change is seen), and side tables that go with the
documents. Postings are sorted by term and then document over the files of a slice,
MOST_SLICES at most, so a query reads the pages of its own terms, and those of a very
common term are spread over several files. A unit's postings are made where its text
is read, and of a large segment one slice after another is shuffled, so that no more
than the shuffles of two slices take disk beside the index.

An update writes a segment of the new and changed documents alone, and a table
of tombstones (segment, doc_id) for what was changed or deleted before; both
hold for units, postings and side tables alike. ``merge`` puts segments together
without looking at a text again. What is valid is told by a generation, one row
that is written last under the next number: readers take the newest that is
whole and go on with its files, whatever is written beside. Of two updates at
once one counts; what the other did is found missing by the next ``sync``.
"""

from __future__ import annotations

import gc
import time
import uuid
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..sources import folders

#: Bytes of a row group of postings: small, so that a term's rows are most of what is read for it.
GROUP_BYTES = 4 << 20
#: Words that a worker makes postings of at a time.
AT_ONCE = 500_000
#: Words of a slice of a segment, slices at most, and words of a file of postings.
SLICE_WORDS, MOST_SLICES, FILE_WORDS = 25_000_000, 4, 1_000_000
#: Words by whose places the files' bounds are chosen, and as many for each file at least.
SEEN_WORDS, SEEN_FOR_A_FILE = 50_000, 100
#: Neighbouring doc_ids whose postings share bounds.
BLOCK = 64
#: Changes with what segments hold; an index of another format is not read.
FORMAT = 3
#: Segments, and tombstones as a share of the units, from which a merge is due.
MOST_SEGMENTS, MOST_GONE = 8, 0.2
MANIFEST = "format int, version string, segments array<struct<path:string,units:long>>, gone array<string>, n long, words long, n_gone long, n_read long"

Words = Callable[[Column], Column]


@dataclass
class Index:
    """What one generation holds; ``tables`` reads a side table."""

    spark: SparkSession
    target: str
    generation: int
    version: str
    segments: dict[str, int]
    gone: list[str]
    n: int
    words: int
    n_gone: int
    #: Units whose texts were read for this generation.
    n_read: int

    @property
    def average(self) -> float:
        return self.words / self.n if self.words else 1.0

    def tombstones(self) -> DataFrame:
        return self.spark.read.parquet(*self.gone).select(F.col("segment").alias("__segment"), F.col("doc_id").alias("__doc"))

    def tables(self, name: str, segments: list[str] | None = None) -> DataFrame:
        """The live rows of a table of the segments; without tombstones just the files."""
        rows = self.spark.read.parquet(*(f"{s}/{name}" for s in segments or self.segments))
        if self.gone and self.n_gone:
            dead = self.tombstones()
            rows = rows.join(dead, (rows["segment"] == dead["__segment"]) & rows["doc_id"].eqNullSafe(dead["__doc"]), "left_anti")
        return rows

    def alive(self, segment: str, name: str) -> DataFrame:
        """The live rows of one segment's table, in the order of its files; the segment's dead doc_ids go to every executor, about 16 bytes each."""
        rows = self.spark.read.parquet(f"{segment}/{name}").drop("segment")
        if not (self.gone and self.n_gone):
            return rows
        dead = self.tombstones().filter(F.col("__segment") == segment).select(F.col("__doc").alias("doc_id"))
        if not dead.filter("doc_id is null").isEmpty():
            rows = rows.filter("doc_id is not null")
        return rows.join(F.broadcast(dead.filter("doc_id is not null").distinct()), "doc_id", "left_anti").select(*rows.columns)

    @property
    def units(self) -> DataFrame:
        return self.tables("units").drop("segment")

    @property
    def postings(self) -> DataFrame:
        return self.tables("postings").drop("segment")

    @property
    def blocks(self) -> DataFrame:
        """Bounds of blocks; those of deleted documents only make them looser."""
        return self.spark.read.parquet(*(f"{s}/blocks" for s in self.segments)).drop("segment")


def block_of(doc_id: Column) -> Column:
    return F.floor(F.coalesce(doc_id, F.lit(-1)) / BLOCK).cast("long")


def _name(target: str) -> str:
    return f"{target}/segments/{uuid.uuid4().hex}"


def _marks(docs: DataFrame) -> DataFrame:
    """doc_id with a mark of all its columns; rows of one doc_id have one mark."""
    hashed = docs.select("doc_id", F.xxhash64(*docs.columns).alias("h"))
    return hashed.groupBy("doc_id").agg(F.bit_xor("h").alias("mark"), F.count(F.lit(1)).alias("n_rows"))


def _write(rows: DataFrame, segment: str, name: str, group: int | None = None, mode: str = "error") -> None:
    writer = rows.withColumn("segment", F.lit(segment)).write.mode(mode).option("compression", "zstd")
    (writer.option("parquet.block.size", group) if group else writer).parquet(f"{segment}/{name}")


def _freed(spark: SparkSession) -> None:
    """Have the driver drop the shuffles that no plan needs any more; else they take disk until it happens to collect its garbage."""
    gc.collect()
    time.sleep(1.2)  # py4j lets go of what Python has let go once a second
    spark.sparkContext._jvm.System.gc()


def _whole(doc_ids: pa.Array) -> np.ndarray:
    return doc_ids.cast(pa.int64()).fill_null(-1).to_numpy(zero_copy_only=False)


class Postings:
    """Makes (term, doc_id, ordinal, dl, tf, positions, place) of batches of units, in order of terms; place is the number of the file.

    ``bounds`` are the first (term, doc_id) of all files but the first; ``words``
    makes lists of words of texts, where the units don't come with theirs.
    """

    def __init__(self, bounds: list[tuple[str, int]], words: Callable[[pa.Array], pa.Array] | None):
        self.terms, self.docs, self.words = [t for t, _ in bounds], np.array([d for _, d in bounds], np.int64), words

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # texts are put into words some at a time, as lists of words take several times their room
            for part in _parts(batch, AT_ONCE * 4) if self.words else [batch]:
                lists = self.words(part.column("t")) if self.words else part.column("t")
                ends = lists.offsets.to_numpy()
                begin = 0
                while begin < part.num_rows:
                    end = max(begin + 1, int(np.searchsorted(ends, ends[begin] + AT_ONCE, "right")) - 1)
                    if ends[end] > ends[begin]:
                        yield self.made(part.slice(begin, end - begin), lists.values.slice(ends[begin], ends[end] - ends[begin]), np.diff(ends[begin : end + 1]))
                    begin = end

    def made(self, units: pa.RecordBatch, words: pa.Array, sizes: np.ndarray) -> pa.RecordBatch:
        coded = words.dictionary_encode()
        code = coded.indices.to_numpy().astype(np.int64)
        ranks = np.argsort(np.array(coded.dictionary.to_pylist(), object), kind="stable")
        rank = np.empty(len(ranks), np.int64)
        rank[ranks] = np.arange(len(ranks))
        unit = np.repeat(np.arange(len(sizes)), sizes)
        at = np.arange(len(unit)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        order = np.argsort(key := rank[code] * len(sizes) + unit, kind="stable")
        first = np.flatnonzero(np.diff(key[order], prepend=-1))
        rows, codes = unit[order[first]], code[order[first]]
        tf = np.diff(first, append=len(order))
        positions = pa.ListArray.from_arrays(pa.array(np.append(first, len(order)).astype(np.int32)), pa.array(at[order].astype(np.int32)))
        doc_ids = units.column("doc_id").take(pa.array(rows))
        columns = {"term": coded.dictionary.take(pa.array(codes)), "doc_id": doc_ids, "ordinal": units.column("ordinal").take(pa.array(rows)), "dl": pa.array(sizes[rows].astype(np.int32)), "tf": pa.array(tf.astype(np.int32)), "positions": positions}
        return pa.RecordBatch.from_pydict(columns | {"place": pa.array(self.places(coded.dictionary, codes, doc_ids).astype(np.int32))})

    def places(self, terms: pa.Array, codes: np.ndarray, doc_ids: pa.Array) -> np.ndarray:
        """Which file each posting goes to."""
        terms = terms.to_pylist()
        out = np.array([bisect_left(self.terms, t) for t in terms], np.int64)[codes]
        shared = {t: bisect_right(self.terms, t) for t in set(self.terms)}
        for k, t in enumerate(terms):
            if t in shared:  # a bound is inside this term
                low, mine = bisect_left(self.terms, t), np.flatnonzero(codes == k)
                out[mine] += np.searchsorted(self.docs[low : shared[t]], _whole(doc_ids.take(pa.array(mine))), "right")
        return out


def _parts(batch: pa.RecordBatch, most: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about so many bytes of text."""
    ends = np.cumsum([len(x.as_buffer() or b"") if x.is_valid else 0 for x in batch.column("t")])
    begin = 0
    while begin < batch.num_rows:
        end = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + most, "right")))
        yield batch.slice(begin, end - begin)
        begin = end


def _bounds(units: DataFrame, list_of: Callable[[Column], Column], n: int, total: int) -> list[tuple[str, int]]:
    """Where files begin: what splits the words of some units evenly."""
    if n < 2:
        return []
    share = min(1.0, max(SEEN_WORDS, n * SEEN_FOR_A_FILE) / total)
    some = units.sample(share, 0) if share < 1 else units
    # about so many words as are asked for, whatever the size of the segment
    seen = some.select("doc_id", F.explode(F.array_distinct(list_of(F.col("t")))).alias("term")).select("term", F.coalesce("doc_id", F.lit(-1)).cast("long").alias("doc_id")).toArrow()
    rows = sorted(zip(seen["term"].to_pylist(), seen["doc_id"].to_pylist(), strict=True))
    return sorted({rows[len(rows) * k // n] for k in range(1, n)}) if rows else []


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, block, tf, dl, n) of postings in their order; a block that goes over batches has a row of each."""
    for batch in batches:
        if not batch.num_rows:
            continue
        term, block = batch.column("term"), np.floor_divide(_whole(batch.column("doc_id")), BLOCK)
        code = term.dictionary_encode().indices.to_numpy()
        first = np.flatnonzero(np.append(True, (code[1:] != code[:-1]) | (block[1:] != block[:-1])))
        number = lambda name, f: pa.array(f.reduceat(batch.column(name).to_numpy(), first))
        columns = {"term": term.take(pa.array(first)), "block": pa.array(block[first]), "tf": number("tf", np.maximum), "dl": number("dl", np.minimum), "n": pa.array(np.diff(first, append=len(block)))}
        yield pa.RecordBatch.from_pydict(columns)


def _write_blocks(spark: SparkSession, segment: str) -> None:
    """The bounds of blocks of a segment's postings, in the postings' order."""
    written = spark.read.parquet(f"{segment}/postings").select("term", "doc_id", "tf", "dl")
    _write(written.mapInArrow(_blocks, "term string, block long, tf int, dl int, n long"), segment, "blocks", GROUP_BYTES)


def _write_postings(units: DataFrame, segment: str, words: Words) -> None:
    """Postings of ``units`` (doc_id, ordinal, text), a slice of them after another."""
    spark = units.sparkSession
    n, total = spark.read.parquet(f"{segment}/units").agg(F.count(F.lit(1)), F.coalesce(F.sum("dl"), F.lit(0))).first()
    slices = min(MOST_SLICES, max(1, -(-total // SLICE_WORDS)))
    files = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // (slices * FILE_WORDS))))
    in_python = getattr(words, "of_arrow", None)
    plain = lambda c: F.coalesce(words(c), F.array().cast("array<string>"))
    bounds = _bounds(units.select("doc_id", F.col("text").alias("t")), plain, files, max(1, total))
    kind = units.schema["doc_id"].dataType.simpleString()
    shape = f"term string, doc_id {kind}, ordinal int, dl int, tf int, positions array<int>, place int"
    key = ["term", "doc_id", "ordinal", "dl"]
    twice = spark.read.parquet(f"{segment}/docs").filter("n_rows > 1").select("doc_id")
    for k in range(slices):
        some = units.filter(F.pmod(F.xxhash64(block_of(F.col("doc_id"))), F.lit(slices)) == k) if slices > 1 else units
        some = some.select("doc_id", "ordinal", (F.col("text") if in_python else plain(F.col("text"))).alias("t"))
        rows = some.mapInArrow(Postings(bounds, in_python), shape)
        if k == 0:
            repeated = not twice.isEmpty()
        if repeated:  # units of one doc_id and length are one
            same = _semi(rows, twice).groupBy(*key).agg(F.array_sort(F.flatten(F.collect_list("positions"))).alias("positions"), F.first("place").alias("place"))
            rows = _semi(rows, twice, "left_anti").unionByName(same.withColumn("tf", F.size("positions")))
        ordered = rows.repartitionById(files, F.col("place")).drop("place").sortWithinPartitions("term", "doc_id", "ordinal")
        _write(ordered, segment, "postings", GROUP_BYTES, "append")
        del some, rows, ordered
        if slices > 1:
            _freed(spark)


def _segment(docs: DataFrame, target: str, split: Callable[[DataFrame], DataFrame], words: Words, sides: dict[str, Callable[[DataFrame], DataFrame]], keep_texts: bool) -> tuple[str, int]:
    """Write a segment of the documents; returns its folder and how many units were read."""
    spark, segment = docs.sparkSession, _name(target)
    _write(_marks(docs), segment, "docs")
    units = split(docs)
    if "ordinal" not in units.columns:
        units = units.withColumn("ordinal", F.lit(0))
    if keep_texts:
        _write(units, segment, "texts")
        units = spark.read.parquet(f"{segment}/texts").drop("segment")
    rest = [c for c in units.columns if c != "text"]
    number = getattr(words, "number", lambda text: F.size(words(text)))
    _write(units.select(*rest, F.coalesce(F.when(F.col("text").isNotNull(), number(F.col("text"))), F.lit(0)).alias("dl")), segment, "units")
    _write_postings(units.select("doc_id", F.col("ordinal").cast("int"), "text"), segment, words)
    _write_blocks(spark, segment)
    for name, make in sides.items():
        _write(make(docs), segment, name)
    return segment, spark.read.parquet(f"{segment}/units").count()


def _publish(spark: SparkSession, target: str, after: int, version: str, segments: dict[str, int], gone: list[str], n_read: int) -> Index:
    """Write the next generation."""
    draft = Index(spark, target, after + 1, version, segments, gone, 0, 0, 1 if gone else 0, n_read)
    if segments:
        draft.n, draft.words = draft.tables("units").agg(F.count(F.lit(1)), F.coalesce(F.sum("dl"), F.lit(0))).first()
    draft.n_gone = draft.tombstones().count() if gone else 0
    row = (FORMAT, version, [tuple(x) for x in segments.items()], gone, draft.n, draft.words, draft.n_gone, n_read)
    number = after + 1
    while True:
        try:
            spark.createDataFrame([row], MANIFEST).coalesce(1).write.parquet(f"{target}/generations/gen={number}")
            draft.generation = number
            return draft
        except AnalysisException:  # taken by another update, or left by one that was lost
            number += 1
            if number > after + 100:
                raise


def load(spark: SparkSession, target: str) -> Index | None:
    """The newest generation; None where none was finished."""
    try:
        rows = spark.read.parquet(f"{target}/generations").collect()  # a row a generation
    except AnalysisException:
        return None
    rows = [r for r in rows if r["format"] == FORMAT]
    if not rows:
        return None
    r = max(rows, key=lambda r: (r["gen"], r["version"]))
    return Index(spark, target, r["gen"], r["version"], {s["path"]: s["units"] for s in r["segments"]}, list(r["gone"]), r["n"], r["words"], r["n_gone"], r["n_read"])


def sync(docs: DataFrame, target: str, version: str = "", split: Callable[[DataFrame], DataFrame] = lambda docs: docs, words: Words = tokens, sides: dict[str, Callable[[DataFrame], DataFrame]] | None = None, keep_texts: bool = False) -> Index:
    """Bring the index up to ``docs`` (doc_id, text and any columns); only new and changed documents are split into units and words.

    ``split`` makes units of documents, ``words`` a text's tokens; ``sides`` make
    side tables (with doc_id) from the documents of a segment. Null texts are units
    without words; rows of one doc_id are one document.
    """
    spark, sides = docs.sparkSession, sides or {}
    held = load(spark, target)
    if held is None:
        segment, n = _segment(docs, target, split, words, sides, keep_texts)
        return _publish(spark, target, 0, version, {segment: n}, [], n)
    new, old = _marks(docs).alias("new"), held.tables("docs").alias("old")
    both = old.join(new, F.col("old.doc_id").eqNullSafe(F.col("new.doc_id")), "full_outer")
    same = (F.col("old.mark") == F.col("new.mark")) & (F.col("old.n_rows") == F.col("new.n_rows"))
    changes = both.filter(~F.coalesce(same, F.lit(False))).select(F.when(F.col("old.segment").isNotNull(), F.struct("old.segment", "old.doc_id")).alias("dead"), F.when(F.col("new.n_rows").isNotNull(), F.struct("new.doc_id")).alias("fresh"))
    return _changed(held, changes, lambda fresh: _semi(docs, fresh), version, split, words, sides, keep_texts)


def _semi(docs: DataFrame, ids: DataFrame, how: str = "left_semi") -> DataFrame:
    wanted = ids.select(F.col("doc_id").alias("__doc"))
    return docs.join(wanted, docs["doc_id"].eqNullSafe(wanted["__doc"]), how)


def _changed(held: Index, changes: DataFrame, fresh_docs: Callable[[DataFrame], DataFrame], version: str, split: Callable, words: Words, sides: dict, keep_texts: bool) -> Index:
    """The next generation after ``changes`` (dead: segment and doc_id, or null; fresh: doc_id, or null)."""
    spark, target = held.spark, held.target
    place = f"{target}/changes/{uuid.uuid4().hex}"
    changes.write.parquet(place)
    changes = spark.read.parquet(place)
    n_dead, n_fresh = changes.agg(F.count("dead"), F.count("fresh")).first()
    segments, gone, n = dict(held.segments), list(held.gone), 0
    if n_dead:
        changes.filter("dead is not null").select("dead.*").write.parquet(f"{place}-gone")
        gone.append(f"{place}-gone")
    if n_fresh:
        segment, n = _segment(fresh_docs(changes.filter("fresh is not null").select("fresh.doc_id")), target, split, words, sides, keep_texts)
        segments[segment] = n
    out = _publish(spark, target, held.generation, version, segments, gone, n)
    return merge(out, _small(out), n) if len(segments) > MOST_SEGMENTS or out.n_gone > MOST_GONE * max(1, out.n) else out


def upsert(held: Index, docs: DataFrame, split: Callable[[DataFrame], DataFrame] = lambda docs: docs, words: Words = tokens, sides: dict[str, Callable[[DataFrame], DataFrame]] | None = None, keep_texts: bool = False) -> Index:
    """Put documents in, in the place of those with the same doc_id."""
    ids = docs.select("doc_id").distinct().alias("new")
    old = held.tables("docs").alias("old")
    both = ids.join(old, F.col("old.doc_id").eqNullSafe(F.col("new.doc_id")), "left")
    changes = both.select(F.when(F.col("old.segment").isNotNull(), F.struct("old.segment", "old.doc_id")).alias("dead"), F.struct("new.doc_id").alias("fresh"))
    return _changed(held, changes, lambda _: docs, held.version, split, words, sides or {}, keep_texts)


def delete(held: Index, ids: DataFrame) -> Index:
    """Take documents (doc_id) out of units, postings and side tables at once."""
    dead = _semi(held.tables("docs"), ids).select(F.struct("segment", "doc_id").alias("dead"))
    return _changed(held, dead.withColumn("fresh", F.lit(None).cast("struct<doc_id:bigint>")), lambda fresh: fresh, held.version, lambda docs: docs, tokens, {}, False)


def delete_where(held: Index, condition: Column) -> Index:
    """Take out the documents of the units that meet a condition, such as a folder's."""
    return delete(held, held.units.filter(condition).select("doc_id").distinct())


def _small(held: Index) -> list[str]:
    """The segments to put together: all but those that are larger than all smaller ones in one; with many tombstones all."""
    if held.n_gone > MOST_GONE * max(1, held.n):
        return list(held.segments)
    by_size = sorted(held.segments, key=held.segments.get)
    total, take = 0, 1
    for k, s in enumerate(by_size):
        if held.segments[s] <= max(total, 1) * 2 or k == 0:
            take = k + 1
        total += held.segments[s]
    return by_size[: max(2, take)]


def merge(held: Index, segments: list[str] | None = None, n_read: int = 0) -> Index:
    """Put segments (all by default) together as one without their dead rows; no text is read but the ``n_read`` of the update before."""
    segments = segments or list(held.segments)
    spark, segment = held.spark, _name(held.target)
    names = {p.rstrip("/").rsplit("/", 1)[-1] for s in segments for p, _, _ in folders.children(spark, s)}
    for name in sorted(names - {"postings", "blocks"}):
        _write(held.tables(name, segments).drop("segment"), segment, name)
    for s in segments:
        # each file's rows keep their order, so nothing is shuffled
        _write(held.alive(s, "postings").sortWithinPartitions("term", "doc_id", "ordinal"), segment, "postings", GROUP_BYTES, "append")
    _write_blocks(spark, segment)
    rest = {s: n for s, n in held.segments.items() if s not in segments}
    rest[segment] = spark.read.parquet(f"{segment}/units").count()
    gone = []
    if held.gone and len(rest) > 1:
        left = held.tombstones().filter(F.col("__segment").isin(*[s for s in rest if s != segment]))
        if not left.isEmpty():
            gone = [f"{held.target}/changes/{uuid.uuid4().hex}-gone"]
            left.select(F.col("__segment").alias("segment"), F.col("__doc").alias("doc_id")).write.parquet(gone[0])
    return _publish(spark, held.target, held.generation, held.version, rest, gone, n_read)


def fork(held: Index, target: str) -> Index:
    """An index of its own at another place that begins with the same segments."""
    return _publish(held.spark, target, 0, held.version, held.segments, held.gone, 0)


def vacuum(spark: SparkSession, target: str, keep: int = 2) -> list[str]:
    """Take away the segments, tombstones and generations that the newest ``keep`` generations don't name; returns what went.

    Readers of older generations and forks that still use these files lose them.
    """
    rows = sorted(spark.read.parquet(f"{target}/generations").collect(), key=lambda r: r["gen"])
    kept = [r for r in rows if r["format"] == FORMAT][-keep:]
    used = {s["path"].rsplit("/", 1)[-1] for r in kept for s in r["segments"]} | {g.rsplit("/", 1)[-1] for r in kept for g in r["gone"]} | {f"gen={r['gen']}" for r in kept}
    newest = {f"gen={r['gen']}" for r in rows if not kept or r["gen"] > kept[-1]["gen"]}
    gone = [p for part in ("segments", "changes", "generations") for p, _, _ in folders.children(spark, f"{target}/{part}") if p.rsplit("/", 1)[-1] not in used | newest and not p.rsplit("/", 1)[-1].startswith("_")]
    for path in gone:
        folders.remove(spark, path)
    return gone


def build(units: DataFrame, target: str, words: Words = tokens) -> Index:
    """Write the index of ``units`` (doc_id, text, with or without ordinal, and any other columns) to the folder ``target``."""
    return sync(units, target, words=words)
