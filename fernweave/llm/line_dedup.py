"""Operator 6: line dedup by a deletion-neighbourhood join.

A line is a sequence of words (lower-cased A-Z, split at ASCII white space).
Lines are duplicates when their words are equal or, from NEAR_WORDS words on,
when one edit (a word put in, left out or exchanged) makes them equal. A line
goes if a duplicate of it stands earlier, by doc_id and then line number; the
earliest stays. Lines without words always stay.

Only distinct lines are joined. One edit leaves the first or the last half of a
line as it was, so only lines that share a half with another line go on. For
these all variants with one word left out are emitted as hashed keys with their
places. Lines that share a variant and its place differ by an exchanged word; a
line that equals another's variant by a word put in. Each key needs only its
earliest line, so a group of n lines gives n candidates and no pairs. The edit
distance of each candidate and its earlier line is verified on their words.
Equal lines are told by 128 bits of two hashes of their words.

Skew: lines are counted before they are shuffled by their hash, and what is
joined back to all lines is a written table, so that adaptive execution may
split the task of a very common line.

Rows are told apart by doc_id and, where a doc_id is null or repeated, by a hash
of the text as well, which any scan of the table gives again. Of rows that are
equal in both one is the first, and the others lose all lines with words.

Results for odd input: null and empty texts have no lines to lose and stay;
rows of one doc_id are in the order of their texts' hashes; a null doc_id comes
after all others; other columns pass through, and those that the operator adds
are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, beside, byte_view, cut, cut_free, list_array, mix, side, small_batches, span_hashes, spans_of

NEAR_WORDS = 8
LAST = (1 << 63) - 1
#: Doc_ids are dealt into so many bins; all rows of a bin with a repeated doc_id count as repeated. Numbers of bins are all that tasks are told.
AGAIN_BINS = 1 << 18
ADDED = {"n_lines": "long", "n_removed": "long"}
BLANK = " \t\n\v\f\r"
SPACE = np.zeros(256, bool)
SPACE[9:14] = SPACE[32] = True
BASE, OTHER_BASE = 0x5851F42D4C957F2D, 0x2545F4914F6CDD1D
LENGTH = np.uint64(0xD6E8FEB86659FD93)


def _powers(base: int, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(np.concatenate(([np.uint64(1)], np.full(max(n, 0), np.uint64(base)))))


class Lines:
    """The lines of some texts as word hashes, with the sums that give the hash of any part of a line at once."""

    def __init__(self, column: pa.Array):
        raw, offsets = byte_view(column)
        low = LOWER[raw]
        breaks = np.flatnonzero(raw == 10)
        text_of = np.repeat(np.arange(len(column)), 1 + np.bincount(np.searchsorted(offsets, breaks, "right") - 1, minlength=len(column)))
        self.text_of = text_of
        self.line_no = np.arange(len(text_of)) - np.searchsorted(text_of, text_of)
        starts, ends = spans_of(~SPACE[low], offsets)
        self.words = span_hashes(low, starts, ends)
        # a line's number: breaks before it plus texts before it
        line = np.searchsorted(breaks, starts) + np.searchsorted(offsets, starts, "right") - 1
        self.first = np.searchsorted(line, np.arange(len(text_of)))
        self.n = np.searchsorted(line, np.arange(len(text_of)), "right") - self.first
        most = int(self.n.max(initial=0))
        self.up, self.down = _powers(BASE, most), _powers(pow(BASE, -1, 1 << 64), most)
        inner = np.arange(len(self.words)) - self.first[line] if len(line) else np.zeros(0, np.int64)
        with np.errstate(over="ignore"):
            self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(self.words * self.up[inner], dtype=np.uint64)))
            self.other_sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(self.words) * _powers(OTHER_BASE, most)[inner], dtype=np.uint64)))

    def head(self, k: np.ndarray, length: np.ndarray) -> np.ndarray:
        return self.sums[self.first[k] + length] - self.sums[self.first[k]]

    def tail(self, k: np.ndarray, length: np.ndarray) -> np.ndarray:
        end = self.first[k] + self.n[k]
        with np.errstate(over="ignore"):
            return (self.sums[end] - self.sums[end - length]) * self.down[self.n[k] - length]

    def hashes(self, k: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix(self.head(k, self.n[k]) + self.n[k].astype(np.uint64) * LENGTH)

    def identities(self, k: np.ndarray) -> pa.Array:
        """Each line's hash with a second, independent one: 16 bytes."""
        second = mix(self.other_sums[self.first[k] + self.n[k]] - self.other_sums[self.first[k]])
        both = np.ascontiguousarray(np.stack((self.hashes(k), second), 1))
        return pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(k), [None, pa.py_buffer(both)]).cast(pa.binary())

    def halves(self, k: np.ndarray) -> np.ndarray:
        """Four keys a line: both halves as it is cut when the shorter of a pair has its length, or one word less."""
        out = []
        with np.errstate(over="ignore"):
            for shorter in (self.n[k], self.n[k] - 1):
                half = shorter // 2
                tag = shorter.astype(np.uint64) * LENGTH
                out += [mix(self.head(k, half) + tag), mix(self.tail(k, shorter - half) + ~tag)]
        return np.stack(out, 1)

    def variants(self, k: int) -> np.ndarray:
        """The line's hashes with each word left out in turn."""
        a, n = int(self.first[k]), int(self.n[k])
        with np.errstate(over="ignore"):
            before = self.sums[a : a + n] - self.sums[a]
            after = (self.sums[a + n] - self.sums[a + 1 : a + n + 1]) * self.down[1]
            return mix(before + after + np.uint64(n - 1) * LENGTH)


def line_table(docs: DataFrame) -> DataFrame:
    """place, part (see keyed), line_no, id (16 bytes), h (the line's hash) and, for long lines, the keys of its halves; lines without words are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text", 2 << 20):
            lines = Lines(batch.column("text"))
            k = np.flatnonzero(lines.n)
            place, part = (np.array(batch.column(c), np.int64)[lines.text_of[k]] for c in ("place", "part"))
            long = k[lines.n[k] >= NEAR_WORDS]
            keys = list_array(lines.halves(long).view(np.int64).ravel(), np.where(lines.n[k] >= NEAR_WORDS, 4, 0), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(part), pa.array(lines.line_no[k], pa.int32()), lines.identities(k), pa.array(lines.hashes(k).view(np.int64)), keys], ["place", "part", "line_no", "id", "h", "halves"])

    return docs.select("__place", "__part", F.col("text").cast("string").alias("text")).toDF("place", "part", "text").mapInArrow(run, "place long, part long, line_no int, id binary, h long, halves array<long>")


def keyed(docs: DataFrame) -> tuple[DataFrame, bool]:
    """The rows with __place (doc_id, null last), __again (whether the place may be repeated) and __part (then the text's hash, else 0); and whether any is."""
    place = F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST))
    bin_of = F.pmod(F.xxhash64("__place"), F.lit(AGAIN_BINS)).alias("__bin")
    # a row that only shares its bin with a repeated place is told apart by its text too, with the same result
    again = cut(docs.select(place.alias("__place")).groupBy("__place").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(bin_of).distinct())
    some = not again.isEmpty()
    rows = docs.withColumn("__place", place)
    if some:
        rows = rows.withColumn("__bin", bin_of).join(F.broadcast(again.withColumn("__again", F.lit(True))), "__bin", "left").drop("__bin").withColumn("__again", F.coalesce("__again", F.lit(False)))
    else:
        rows = rows.withColumn("__again", F.lit(False))
    return rows.withColumn("__part", F.when(F.col("__again"), F.xxhash64(F.col("text").cast("string"))).otherwise(F.lit(0).cast("long"))), some


def _neighbourhood(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """id, h, words and variants of the wanted lines (place, part, line_no)."""
    by_text = wanted.groupBy("place", "part").agg(F.collect_set("line_no").alias("line_nos"))  # of one document

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text", 2 << 20):
            chosen, of = [], []
            for k, (text, numbers) in enumerate(zip(batch.column("text").cast(pa.binary()), batch.column("line_nos").to_pylist(), strict=True)):
                split = (text.as_py() or b"").split(b"\n")
                for j in sorted(numbers):
                    if j < len(split):
                        chosen.append(split[j].decode())
                        of.append((k, j))
            lines = Lines(pa.array(chosen, pa.string()))
            good = np.flatnonzero(lines.n >= NEAR_WORDS)
            if not len(good):
                continue
            place, part = (np.array(batch.column(c), np.int64) for c in ("place", "part"))
            words = list_array(np.concatenate([lines.words[lines.first[k] : lines.first[k] + lines.n[k]] for k in good]).view(np.int64), lines.n[good], pa.int64())
            variants = list_array(np.concatenate([lines.variants(k) for k in good]).view(np.int64), lines.n[good], pa.int64())
            yield pa.RecordBatch.from_arrays([*(pa.array([x[of[k][0]] for k in good], pa.int64()) for x in (place, part)), pa.array([of[k][1] for k in good], pa.int32()), lines.identities(good), pa.array(lines.hashes(good).view(np.int64)), words, variants], ["place", "part", "line_no", "id", "h", "words", "variants"])

    texts = docs.select("__place", "__part", F.col("text").cast("string").alias("text")).toDF("place", "part", "text")
    return texts.join(by_text.hint("merge"), ["place", "part"]).mapInArrow(run, "place long, part long, line_no int, id binary, h long, words array<long>, variants array<long>")


def within_one(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether one word put in, left out or exchanged makes the sequences equal."""
    if abs(len(a) - len(b)) > 1:
        return False
    n = min(len(a), len(b))
    head = int(np.argmin(np.append(a[:n] == b[:n], False)))
    tail = int(np.argmin(np.append(a[::-1][:n] == b[::-1][:n], False)))
    return head + tail >= max(len(a), len(b)) - 1


def _verified(pairs: DataFrame, words: DataFrame) -> DataFrame:
    """The id of pairs (id, other) whose lines are within one edit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column("words"), batch.column("other_words")
            keep = [within_one(x.values.to_numpy(zero_copy_only=False), y.values.to_numpy(zero_copy_only=False)) for x, y in zip(a, b, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("id").filter(pa.array(keep, pa.bool_()))], ["id"])

    both = pairs.join(words, "id").join(words.select(F.col("id").alias("other"), F.col("words").alias("other_words")), "other")
    return both.select("id", "words", "other_words").mapInArrow(run, "id binary").distinct()


def near_lines(docs: DataFrame, distinct: DataFrame) -> DataFrame:
    """id of the distinct lines (h, first = struct(place, part, line_no), halves) that have an earlier line within one edit."""
    keys = distinct.select("h", F.explode("halves").alias("key"))
    shared = side(keys.groupBy("key").agg(F.min("h").alias("least"), F.max("h").alias("most")).filter("least <> most").select("key"), cut_free)
    going_on = side(keys.join(shared, "key").select("h").distinct(), cut_free)
    wanted = distinct.join(going_on, "h").select("first.place", "first.part", "first.line_no")
    found = cut_free(_neighbourhood(docs, wanted).dropDuplicates(["id"]))
    variants = found.select(F.struct("place", "part", "line_no", "id").alias("me"), "h", F.posexplode("variants").alias("at", "key"))
    groups = variants.groupBy("key", "at").agg(F.min("me").alias("first"), F.max("me").alias("last")).filter("first <> last").select("key", "at", "first")
    exchanged = variants.join(side(groups), ["key", "at"]).filter("me <> first").select("me.id", F.col("first.id").alias("other"))
    lines = found.select(F.col("h").alias("key"), F.struct("place", "part", "line_no", "id").alias("line"))
    put_in = variants.join(lines, "key").filter("me.id <> line.id").select(F.greatest("me", "line").alias("a"), F.least("me", "line").alias("b")).select("a.id", F.col("b.id").alias("other"))
    return _verified(exchanged.unionByName(put_in).distinct(), found.select("id", "words"))


def removals(docs: DataFrame) -> DataFrame:
    """place, part and the numbers of the lines that go, one row a text of keyed rows that loses any."""
    lines = cut(line_table(docs))
    distinct = cut_free(lines.groupBy("id").agg(F.min(F.struct("place", "part", "line_no")).alias("first"), F.count(F.lit(1)).alias("n"), F.first("h").alias("h"), F.first("halves").alias("halves")))
    near = near_lines(docs, distinct.filter(F.size("halves") > 0).select("h", "first", "halves"))
    judged = side(distinct.select("id", "first", "n").join(near.withColumn("near", F.lit(True)), "id", "left").filter("near or n > 1").select("id", "first", "near"), cut_free)
    gone = lines.select("place", "part", "line_no", "id").join(judged, "id").filter(F.expr("coalesce(near, false) or place <> first.place or part <> first.part or line_no <> first.line_no"))
    return side(gone.groupBy("place", "part").agg(F.collect_set("line_no").alias("gone")), cut_free)


def dedup_lines(docs: DataFrame) -> DataFrame:
    """The documents with their duplicate lines left out of ``text``, and n_lines, n_removed (long). n_chars follows the text."""
    return beside(docs, ("doc_id", "text", "n_chars"), _deduped, tuple(ADDED))


def _deduped(docs: DataFrame) -> DataFrame:
    added, names = ADDED, docs.columns
    source, some_again = keyed(docs)
    gone = removals(source).toDF("__place", "__part", "__gone")
    rows = source.join(gone, ["__place", "__part"], "left").withColumn("__copy", F.lit(False))
    if some_again:
        once, again = rows.filter("not __again"), rows.filter("__again")
        # equal rows stand together; all but one are copies
        order = Window.partitionBy("__place", "__part").orderBy(F.col("doc_id").isNull())
        rows = once.unionByName(again.withColumn("__copy", F.row_number().over(order) > 1))
    rows = rows.select(*names, "__gone", "__copy")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text", 2 << 20):
            texts, sizes, lost = batch.column("text").to_pylist(), [], []
            for k, (gone, copy) in enumerate(zip(batch.column("__gone").to_pylist(), batch.column("__copy").to_pylist(), strict=True)):
                lines = (texts[k] or "").split("\n")
                if copy:
                    gone = [j for j, x in enumerate(lines) if x.strip(BLANK)]
                sizes.append(len(lines) if texts[k] else 0)
                lost.append(len(gone or ()))
                if gone:
                    gone = set(gone)
                    texts[k] = "\n".join(x for j, x in enumerate(lines) if j not in gone)
            cols = {n: batch.column(n) for n in names}
            cols["text"] = pa.array(texts, batch.column("text").type)
            if "n_chars" in cols:
                cols["n_chars"] = pa.array([len(t) if m and t is not None and n is not None else n for t, m, n in zip(texts, lost, batch.column("n_chars").to_pylist(), strict=True)], batch.column("n_chars").type)
            yield pa.RecordBatch.from_arrays([*cols.values(), pa.array(sizes, pa.int64()), pa.array(lost, pa.int64())], names=[*cols, *added])

    schema = rows.drop("__gone", "__copy").schema
    for name, kind in added.items():
        schema = schema.add(name, kind)
    return rows.mapInArrow(run, schema)
