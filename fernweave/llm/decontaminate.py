"""Operator 3: benchmark decontamination with an FM-index per shard.

A shard is some megabytes of whole documents. Its words that occur in no test
phrase can't be part of a match, so they stand as breaks; the runs of words
between breaks are the strings of the index. The shard's suffixes are sorted,
the Burrows-Wheeler transform goes into a wavelet matrix, and every 16th
position of a run is sampled. All test phrases are searched backwards at once
through wavelet ranks, their occurrences are located by walking to a sampled
position, and overlapping spans are merged into removal spans.

Documents never move: the phrases, a stated query set, come to the shards as a
broadcast of at most BLOCK_BYTES of text. A larger benchmark is searched block
by block, each released before the next is built, a long item in overlapping pieces;
only the rows that a block
hits are written, and the blocks' spans are merged per row. What follows from
the spans is the same code however many blocks there are.

Results for odd input: null and wordless texts have no words and no hits; an
item without words has no window; equal texts of different items are both
reported, rows of one item_id as one item, and an item without id as the empty
string; rows with one doc_id are searched row by row; an empty benchmark hits
nothing; other columns pass through ``scrub``, whatever their names, and are
left out of ``report``.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import LOWER, beside, byte_view, cut, id_text_columns, small_batches, span_hashes, spans_of

WINDOW = 10
#: Text of the benchmark that is searched in one pass.
BLOCK_BYTES = 4 << 20
#: Items over so many bytes are dealt out in pieces of so many words.
PIECE_BYTES, PIECE_WORDS = 1 << 20, 100_000
SHARD_BYTES = 4 << 20
SAMPLE = 16
#: Bytes of words after lower-casing: digits, a-z, and all of a character beyond ASCII.
WORD = np.zeros(256, bool)
WORD[48:58] = WORD[97:123] = WORD[128:] = True
SPAN = "array<struct<start_word:int,end_word:int,start:int,end:int>>"


def words_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, text offsets, and each word's start, end and hash."""
    raw, offsets = byte_view(column)
    low = LOWER[raw]
    starts, ends = spans_of(WORD[low], offsets)
    return raw, offsets, starts, ends, span_hashes(low, starts, ends)


class Phrases:
    """The benchmark's windows as numbers: the alphabet, the windows' symbols, and the items of each window."""

    def __init__(self, items: list[tuple[object, str | None]]):
        self.item_ids = sorted({"" if i is None else str(i) for i, _ in items})
        number = {i: k for k, i in enumerate(self.item_ids)}
        own = [number["" if i is None else str(i)] for i, _ in items]
        column = pa.array([t for _, t in items], pa.large_string())
        _, offsets, starts, _, hashes = words_of(column)
        self.alphabet, symbols = np.unique(hashes, return_inverse=True)
        symbols = symbols + 1
        cuts = np.searchsorted(starts, offsets)
        many = np.diff(cuts)
        # an item of n words has n - 9 windows, or one of all its words
        windows_of = np.where(many > WINDOW, many - WINDOW + 1, np.minimum(many, 1))
        owner = np.repeat(np.arange(len(items)), windows_of)
        first = cuts[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(windows_of) - windows_of, windows_of)
        lengths = np.minimum(many[owner], WINDOW)
        padded = np.concatenate((symbols, np.zeros(WINDOW, np.int64))).astype(np.int32)
        rows = np.zeros((len(owner), WINDOW), np.int32)  # aligned to the right
        for j in range(WINDOW):
            rows[:, WINDOW - 1 - j] = np.where(lengths > j, padded[first + lengths - 1 - j], 0)
        # windows in order, equal ones together
        order = np.lexsort(rows.T[::-1])
        rows = rows[order]
        new = np.concatenate(([True], (rows[1:] != rows[:-1]).any(1))) if len(rows) else np.zeros(0, bool)
        number_of = np.cumsum(new) - 1
        self.windows, self.lengths = rows[new], lengths[order][new]
        pairs = np.unique(number_of * len(self.item_ids) + np.array(own, np.int64)[owner[order]]) if len(rows) else np.zeros(0, np.int64)
        self.item_of = pairs % max(1, len(self.item_ids))
        self.item_at = np.searchsorted(pairs // max(1, len(self.item_ids)), np.arange(len(self.windows) + 1))
        self.likely = np.zeros(1 << 20, bool)
        self.likely[(self.alphabet >> np.uint64(44)).astype(np.int64)] = True

    def symbols_of(self, hashes: np.ndarray) -> np.ndarray:
        """Each word's symbol from 1 on; 0 for a word of no phrase."""
        out = np.zeros(len(hashes), np.int64)
        if len(self.alphabet):
            maybe = np.flatnonzero(self.likely[(hashes >> np.uint64(44)).astype(np.int64)])
            at = np.minimum(np.searchsorted(self.alphabet, hashes[maybe]), len(self.alphabet) - 1)
            same = self.alphabet[at] == hashes[maybe]
            out[maybe[same]] = at[same] + 1
        return out


def sort_suffixes(s: np.ndarray, left: np.ndarray, bits: int) -> np.ndarray:
    """Positions of ``s`` in the order of their suffixes up to the run's end, which is below every symbol and unlike all other ends (earlier ends first).

    ``left``: symbols from a position to its run's end. Several symbols are
    packed for the first sort; what ties after that is sorted by doubling.
    """
    n, step = len(s), max(1, 62 // bits)
    key = np.zeros(n, np.int64)
    for j in range(step):
        key <<= bits
        m = max(0, n - j)
        key[:m] |= np.where(left[:m] > j, s[j:], 0)
    order = np.argsort(key, kind="stable")
    ordered = key[order]
    new = np.concatenate(([True], ordered[1:] != ordered[:-1])) if n else np.zeros(0, bool)
    new |= left[order] < step  # ended: ties are in the order of positions, as they should be
    while n:
        first = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        rank = np.empty(n, np.int64)
        rank[order] = first
        tied = ~new
        tied[:-1] |= ~new[1:]
        rows = np.flatnonzero(tied)
        if not len(rows):
            break
        at = order[rows]
        more = left[at] > step
        follow = np.where(more, rank[np.minimum(at + step, n - 1)], -1)
        again = np.lexsort((follow, first[rows]))
        at, follow, more, group = at[again], follow[again], more[again], first[rows][again]
        order[rows] = at
        new[rows] = np.concatenate(([True], (group[1:] != group[:-1]) | (follow[1:] != follow[:-1]))) | ~more
        step *= 2
    return order


class Wavelet:
    """Wavelet matrix: rank and access over symbols of so many bits."""

    def __init__(self, values: np.ndarray, bits: int):
        self.bits, self.levels, cur = bits, [], values
        for level in range(bits):
            bit = ((cur >> (bits - 1 - level)) & 1).astype(bool)
            packed = np.packbits(np.concatenate((bit, np.zeros(64 + (-len(bit)) % 64, bool))), bitorder="little").view(np.uint64)
            counts = np.bitwise_count(packed).astype(np.int64)
            zeros = np.flatnonzero(~bit)
            self.levels.append((packed, np.cumsum(counts) - counts, len(zeros)))
            cur = np.concatenate((cur[zeros], cur[bit]))

    @staticmethod
    def _ones(level: tuple, at: np.ndarray) -> np.ndarray:
        packed, before, _ = level
        word = at >> 6
        return before[word] + np.bitwise_count(packed[word] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)))

    def place(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where the symbol's occurrences before ``at`` end on the last level; the difference of two places is a rank."""
        for k, level in enumerate(self.levels):
            ones = self._ones(level, at)
            at = np.where((symbol >> (self.bits - 1 - k)) & 1, level[2] + ones, at - ones)
        return at

    def access(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols at those rows, and their places."""
        symbol = np.zeros(len(at), np.int64)
        for level in self.levels:
            ones = self._ones(level, at)
            bit = (level[0][at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)
            symbol = symbol << 1 | bit.astype(np.int64)
            at = np.where(bit, level[2] + ones, at - ones)
        return symbol, at


class FmIndex:
    """FM-index of runs of symbols: ``s`` are all runs one after another, ``run_start`` says where runs begin."""

    def __init__(self, s: np.ndarray, run_start: np.ndarray, alphabet: int):
        n = len(s)
        bits = max(1, int(alphabet).bit_length())
        heads = np.flatnonzero(run_start)
        tails = np.append(heads[1:], n)
        lengths = tails - heads
        inner = np.arange(n) - np.repeat(heads, lengths)
        order = sort_suffixes(s, np.repeat(lengths, lengths) - inner, bits)
        # the rows of the run ends come first; the symbol before a run's first is 0
        before = np.where(run_start[order], 0, s[order - 1])
        self.wavelet = Wavelet(np.concatenate((s[tails - 1], before)), bits)
        self.first = len(heads) + np.concatenate(([0, 0], np.cumsum(np.bincount(s, minlength=alphabet + 1)[1:])))
        symbols = np.arange(alphabet + 1)
        self.origin = self.wavelet.place(symbols, np.zeros(alphabet + 1, np.int64))
        sampled = inner[order] % SAMPLE == 0
        self.at_sample = np.concatenate((np.zeros(len(heads), bool), sampled))
        self.sample_rank = np.cumsum(self.at_sample) - 1
        self.samples = order[sampled]

    def search(self, windows: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The range of rows that begin with each window (aligned to the right)."""
        last = windows[:, -1]
        lo, hi = self.first[last].copy(), self.first[last + 1].copy()
        for j in range(1, windows.shape[1]):
            live = np.flatnonzero((hi > lo) & (lengths > j))
            c = windows[live, -1 - j]
            base = self.first[c] - self.origin[c]
            lo[live] = base + self.wavelet.place(c, lo[live])
            hi[live] = base + self.wavelet.place(c, hi[live])
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The positions of those rows: step back to a sampled one."""
        steps = np.zeros(len(rows), np.int64)
        rows = rows.copy()
        far = np.flatnonzero(~self.at_sample[rows])
        while len(far):
            c, place = self.wavelet.access(rows[far])
            rows[far] = self.first[c] + place - self.origin[c]
            steps[far] += 1
            far = far[~self.at_sample[rows[far]]]
        return self.samples[self.sample_rank[rows]] + steps


class Findings:
    """What the phrases hit in one shard."""

    def __init__(self, column: pa.Array, phrases: Phrases):
        self.raw, self.offsets, self.starts, self.ends, hashes = words_of(column)
        self.cuts = np.searchsorted(self.starts, self.offsets)
        n = len(self.starts)
        text_of = np.repeat(np.arange(len(column)), np.diff(self.cuts))
        symbols = phrases.symbols_of(hashes)
        kept = np.flatnonzero(symbols)
        depth = np.zeros(n + 1, np.int64)
        pairs = np.zeros(0, np.int64)
        width = max(1, len(phrases.item_ids))
        if len(kept) and len(phrases.windows):
            run_start = np.concatenate(([True], (np.diff(kept) != 1) | (np.diff(text_of[kept]) != 0)))
            index = FmIndex(symbols[kept], run_start, len(phrases.alphabet))
            lo, hi = index.search(phrases.windows, phrases.lengths)
            hits = np.maximum(hi - lo, 0)
            window = np.repeat(np.arange(len(hits)), hits)
            rows = np.arange(len(window)) - np.repeat(np.cumsum(hits) - hits, hits) + np.repeat(lo, hits)
            at = kept[index.locate(rows)]
            np.add.at(depth, at, 1)
            np.add.at(depth, at + phrases.lengths[window], -1)
            found = np.unique(text_of[at] * len(hits) + window)
            texts, window = found // len(hits), found % len(hits)
            many = np.diff(phrases.item_at)[window]
            take = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many) + np.repeat(phrases.item_at[window], many)
            pairs = np.unique(np.repeat(texts, many) * width + phrases.item_of[take])
        self.hit = np.cumsum(depth)[:n] > 0
        self.items: dict[int, list[str]] = {}
        for p in pairs.tolist():
            self.items.setdefault(p // width, []).append(phrases.item_ids[p % width])

    def spans(self, k: int) -> list[dict]:
        """Merged spans of text k in words and in characters (ends exclusive)."""
        a, b = self.cuts[k], self.cuts[k + 1]
        begin, end = spans_of(self.hit[a:b], np.zeros(1, np.int64))
        text = self.raw[self.offsets[k] : self.offsets[k + 1]]
        lead = np.cumsum((text & 0xC0) != 0x80)  # characters up to and with a byte
        out = []
        for x, y in zip(begin.tolist(), end.tolist(), strict=True):
            s, e = self.starts[a + x] - self.offsets[k], self.ends[a + y - 1] - self.offsets[k]
            out.append({"start_word": x, "end_word": y, "start": int(lead[s]) - 1, "end": int(lead[e - 1])})
        return out


def _pieces(items: DataFrame) -> DataFrame:
    """The items, each that is longer than PIECE_BYTES as texts of PIECE_WORDS words and nine more, which hold the same windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                column = batch.column("text").slice(k, 1)
                raw, _, starts, ends, _ = words_of(column)
                if len(raw) <= PIECE_BYTES:
                    yield batch.slice(k, 1)
                    continue
                for a in range(0, max(1, len(starts) - WINDOW + 1), PIECE_WORDS):
                    z = min(len(starts), a + PIECE_WORDS + WINDOW - 1)
                    text = raw[starts[a] : ends[z - 1]].tobytes() if len(starts) else b""
                    yield pa.RecordBatch.from_arrays([batch.column("item_id").slice(k, 1), pa.array([text.decode()], batch.column("text").type)], ["item_id", "text"])

    return items.mapInArrow(run, items.schema)


def _blocks(benchmark: DataFrame) -> list[DataFrame]:
    """The benchmark's distinct items and pieces of items in parts of about BLOCK_BYTES."""
    items = cut(_pieces(benchmark.select(F.col("item_id"), F.col("text").cast("string").alias("text")).filter("text is not null").distinct()))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-size // BLOCK_BYTES))
    return [items] if n == 1 else [items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k) for k in range(n)]


def _phrases(block: DataFrame):
    return block.sparkSession.sparkContext.broadcast(Phrases([(r["item_id"], r["text"]) for r in block.collect()]))


def _search(rows: DataFrame, block: DataFrame) -> tuple[DataFrame, Broadcast]:
    """The rows with __n_words, __items (sorted ids) and __spans of what the block's phrases hit in ``text``; and what to release after use."""
    phrases = _phrases(block)
    names = rows.columns
    kind = pa.list_(pa.struct([(c, pa.int32()) for c in ("start_word", "end_word", "start", "end")]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text", SHARD_BYTES):
            found = Findings(batch.column("text"), phrases.value)
            items = [found.items.get(k, []) for k in range(batch.num_rows)]
            spans = [found.spans(k) if items[k] else [] for k in range(batch.num_rows)]
            cols = [pa.array(np.diff(found.cuts), pa.int64()), pa.array(items, pa.list_(pa.string())), pa.array(spans, kind)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *cols], [*names, "__n_words", "__items", "__spans"])

    added = StructType.fromDDL(f"__n_words long, __items array<string>, __spans {SPAN}")
    return rows.mapInArrow(run, StructType([*rows.schema.fields, *added.fields])), phrases


def _joined(rows: DataFrame) -> DataFrame:
    """The rows with their __spans, of several blocks, as disjoint ones in order."""
    kind = pa.list_(pa.struct([(c, pa.int32()) for c in ("start_word", "end_word", "start", "end")]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for spans in batch.column("__spans").to_pylist():
                done: list[dict] = []
                for s in sorted(spans or [], key=lambda s: (s["start_word"], s["end_word"])):
                    if done and done[-1]["end_word"] >= s["start_word"]:
                        done[-1]["end_word"], done[-1]["end"] = max(done[-1]["end_word"], s["end_word"]), max(done[-1]["end"], s["end"])
                    else:
                        done.append(s)
                out.append(done)
            at = batch.schema.get_field_index("__spans")
            yield batch.set_column(at, "__spans", pa.array(out, kind))

    return rows.mapInArrow(run, rows.schema)


def found_in(rows: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows (a column ``text``, all others apart from it by private names) with __n_words, __items and __spans."""
    blocks = _blocks(benchmark)
    if len(blocks) == 1:
        return _search(rows, blocks[0])[0]
    rows = cut(rows.withColumn("__row", F.monotonically_increasing_id()))
    parts = []
    for k, block in enumerate(blocks):
        part, phrases = _search(rows.select("__row", "text"), block)
        # every row once, for its number of words; then those with hits alone
        parts.append(cut((part if k == 0 else part.filter(F.size("__items") > 0)).drop("text")))
        phrases.destroy()
    union = reduce(DataFrame.unionByName, parts)
    merged = union.groupBy("__row").agg(F.max("__n_words").alias("__n_words"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("__items")))).alias("__items"), F.flatten(F.collect_list("__spans")).alias("__spans"))
    return rows.join(_joined(merged), "__row").drop("__row")


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per row: doc_id, n_words, items (ids with an occurring window, sorted as strings) and merged spans."""
    found = found_in(id_text_columns(docs), benchmark)
    return found.select("doc_id", *(F.col(f"__{c}").alias(c) for c in ("n_words", "items", "spans")))


def _without(text: Column, spans: Column) -> Column:
    """The text without those spans of characters."""
    ends = F.concat(F.array(F.lit(0)), F.transform(spans, lambda s: s["end"]))
    starts = F.concat(F.transform(spans, lambda s: s["start"]), F.array(F.char_length(text)))
    return F.array_join(F.zip_with(ends, starts, lambda a, b: F.substring(text, a + 1, b - a)), "")


def scrub(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents with the removal spans cut out of their texts; one of which no word is left goes. n_chars follows the text where it changed."""
    def work(rows: DataFrame) -> DataFrame:
        hit = F.size("__spans") > 0
        changed = {"text": F.when(hit, _without(F.col("text"), F.col("__spans"))).otherwise(F.col("text"))}
        if "n_chars" in rows.columns:
            left = F.aggregate("__spans", F.char_length("text"), lambda n, s: n - (s["end"] - s["start"]))
            changed["n_chars"] = F.when(hit & F.col("n_chars").isNotNull(), left.cast(rows.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
        words_hit = F.aggregate("__spans", F.lit(0).cast("long"), lambda n, s: n + s["end_word"] - s["start_word"])
        return found_in(rows, benchmark).filter(~hit | (words_hit < F.col("__n_words"))).withColumns(changed)

    return beside(docs.withColumn("text", F.col("text").cast("string")), ("text", "n_chars"), work)
