"""Operator 4: token ids as length-limited canonical Huffman code.

Ids are encoded with the tokenizers library, an end id is appended to each
document, and the counts of all ids give one canonical code with at most
MAX_BITS bits (package-merge). The store is a folder of Parquet files in
ascending doc_id order. A row is a block that can be decoded by itself: the
documents' ids and sizes, the coded bits, and the bit offset of every
CHECKPOINT-th id of a document. A block is decoded from all its checkpoints at
once, a table look-up for each id.

File format. Folder ``code``: (id, bits), the code's lengths; codes are
canonical, by length and then id, sent from the highest bit on. Folder
``blocks``: part (its documents' place in the order of parts), block (within
the part), doc_ids, sizes (ids a document, with the end id), payload (bits from
the highest of each byte on; documents begin at whole bytes) and checkpoints
(64-bit bit offsets, one for each started CHECKPOINT ids of each document in
turn). Between tasks ids take 16 bits where the vocabulary allows it, else 32.

Skew: parts are ranges of doc_id, the ids' checksum and the row's place in the
coded table, so a doc_id with very many rows, or none, is dealt over parts too;
their number follows bytes as well as rows.

Results for odd input: null and empty texts are the end id alone; rows of one
doc_id follow each other in the order of their ids' checksum; rows with a null doc_id come
first; an empty table gives an empty store; other columns are ignored.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import byte_letters
from .common import Memo, binary_array, coded_parts, cut, id_text_columns, list_array, scratch_dir, small_batches

MAX_BITS = 18
CHECKPOINT = 64
#: Ids of one block; a longer document is a block of its own.
BLOCK_IDS = 200_000
#: Documents and bytes of ids of one part (file) on average, at most.
PART_ROWS, PART_BYTES = 20_000, 64 << 20
#: Characters of a part that the memo keeps; texts without white space are one long part each, and hardly come again.
KEPT_CHARS = 64
#: Fixed value: what a word of the vocabulary is, of lower-case text in NFC.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordEncoder:
    """Ids of texts by the library, with a bounded memo of what stands between ASCII white space.

    White space ends every piece, so such parts are encoded by themselves. The
    simple parts of a batch that the memo doesn't hold are cut into their pieces
    in one go, and each new piece is given to the library's model; its last token
    is marked as the end of a word, which tells the pieces' ids apart. Any other
    part goes through the whole library.
    """

    def __init__(self, path: str, memo: int = 450_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.kind = id_kind(path)
        self.letter = {b: c for c, b in byte_letters().items() if b != 10}
        self.special = [x.content for x in self.whole.get_added_tokens_decoder().values()]
        self.pieces = regex.compile(rf"\n|{WORDS}")
        # characters that NFC leaves alone and that have one plain lower-case form
        self.simple = regex.compile(r"[!-~¡-¬®-ÿĀ-įıĲ-ſ]+")
        vocab = self.whole.get_vocab()
        self.ends = np.zeros(max(vocab.values(), default=0) + 1, bool)
        self.ends[[i for token, i in vocab.items() if token.endswith("</w>")]] = True
        self.by_part = Memo(self._part, memo)
        # hashes of parts that the memo didn't hold; most never come again
        self.met, self.marks = np.zeros(1 << 22, bool), 0

    def _part(self, text: str) -> bytes:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, self.kind).tobytes()

    def _pieces(self, pieces: list[str]) -> list[bytes]:
        """The ids of lower-case pieces of simple characters."""
        letters = "\n".join(pieces).encode().decode("latin-1").translate(self.letter).split("\n")
        token = self.model.tokenize
        ids = np.array([t.id for x in letters for t in token(x)], np.int64)
        width = np.dtype(self.kind).itemsize
        cuts = ((np.flatnonzero(self.ends[ids]) + 1) * width).tolist()
        if len(cuts) != len(pieces):  # not a model that marks ends
            return [self._part(x) for x in pieces]
        raw = ids.astype(self.kind).tobytes()
        return [raw[a:b] for a, b in zip([0, *cuts], cuts, strict=False)]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, and how many each has; each distinct part of the batch is encoded once."""
        # a first part of its own for each text, which has no ids
        parts = pc.ascii_split_whitespace(pc.binary_join_element_wise("- ", texts.fill_null(""), ""))
        return coded_parts(parts, self._parts, [b""] * len(texts), np.dtype(self.kind))

    def _parts(self, found: list[str]) -> list[bytes]:
        out, old = list(map(self.by_part.get, found)), self.by_part.old.get
        for k in [k for k, ids in enumerate(out) if ids is None]:
            out[k] = old(found[k])
        missing = [k for k, ids in enumerate(out) if ids is None]
        if missing:
            new = self._missing([found[k] for k in missing])
            for k in missing:
                out[k] = new[found[k]]
            self.by_part.take_in(self._kept(new))
        return out

    def _kept(self, new: dict[str, bytes]) -> dict[str, bytes]:
        """Those of newly coded parts that the memo takes: short ones, and once it has been full only such as were met before."""
        names = list(new)
        if self.by_part.old:
            at = np.fromiter(map(hash, names), np.int64, len(names)) & (len(self.met) - 1)
            again = self.met[at]
            self.met[at] = True
            self.marks += len(names) - int(again.sum())
            if self.marks > len(self.met) // 4:
                self.met[:], self.marks = False, 0
            names = compress(names, again.tolist())
        return {x: new[x] for x in names if len(x) <= KEPT_CHARS}

    def _missing(self, parts: list[str]) -> dict[str, bytes]:
        """The ids of parts that the memo doesn't hold, and of their pieces that it doesn't hold."""
        fits, special = self.simple.fullmatch, self.special
        words, others, new = [], [], {}
        for x in parts:
            if not ((x.isascii() and x.isprintable() and x) or fits(x)) or ("<" in x and any(s in x for s in special)):
                new[x] = self._part(x) if x else b""
            elif x.islower() and x.isalpha():
                words.append(x)
            else:
                others.append(x)
        new.update(zip(words, self._pieces(words), strict=True))
        if others:
            pieces = self.pieces.findall("\n".join(others).lower())
            known = {x: new.get(x) or self.by_part.get(x) or self.by_part.old.get(x) for x in set(pieces)}
            known["\n"] = b""
            unknown = [x for x, ids in known.items() if ids is None]
            first = dict(zip(unknown, self._pieces(unknown), strict=True))
            known.update(first)
            new.update(first)
            # the pieces' ids one after another, cut where a part ends
            coded = [known[x] for x in pieces]
            ends = np.cumsum(np.fromiter(map(len, coded), np.int64, len(coded)))
            cuts = [*ends[[k for k, x in enumerate(pieces) if x == "\n"]].tolist(), int(ends[-1])]
            raw = b"".join(coded)
            new.update((x, raw[a:b]) for x, a, b in zip(others, [0, *cuts], cuts, strict=False))
        return new


@lru_cache(maxsize=1)
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


@lru_cache(maxsize=4)
def id_kind(path: str) -> str:
    """Unsigned integers that hold every id of the vocabulary and the end id."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    most = max([*spec["model"]["vocab"].values(), *(x["id"] for x in spec.get("added_tokens") or [])])
    return "<u2" if most < 1 << 16 else "<u4"


def code_lengths(counts: np.ndarray, most: int = MAX_BITS) -> np.ndarray:
    """Optimal code lengths of at most ``most`` bits (package-merge); 0 for ids that don't occur."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.int64)
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    order = used[np.argsort(counts[used], kind="stable")]
    weights, n = counts[order].astype(np.float64), len(order)
    most = max(most, int(n - 1).bit_length())
    # a level's list merges the leaves with pairs of the level below; remember which are leaves
    leaf_flags, level = [], weights
    for _ in range(most - 1):
        pairs = level[: len(level) // 2 * 2].reshape(-1, 2).sum(1)
        both = np.concatenate((weights, pairs))
        at = np.argsort(both, kind="stable")
        leaf_flags.append(at < n)
        level = both[at]
    take = 2 * n - 2
    for flags in reversed(leaf_flags):
        leaves = int(flags[:take].sum())
        lengths[order[:leaves]] += 1
        take = 2 * (take - leaves)
    lengths[order[:take]] += 1
    return lengths


class Code:
    """Canonical code of given lengths: code words, and the table that decodes MAX_BITS bits at once."""

    def __init__(self, lengths: np.ndarray):
        self.lengths = lengths
        order = np.lexsort((np.arange(len(lengths)), lengths))
        order = order[lengths[order] > 0]
        self.width = int(lengths.max(initial=1))
        size = np.int64(1) << (self.width - lengths[order])
        first = np.cumsum(size) - size
        self.words = np.zeros(len(lengths), np.uint64)
        self.words[order] = (first >> (self.width - lengths[order])).astype(np.uint64)
        table_ids = np.repeat(order, size)
        self.table = np.zeros(1 << self.width, np.uint32)
        self.table[: len(table_ids)] = (table_ids << 6 | np.repeat(lengths[order], size)).astype(np.uint32)

    def pack(self, ids: np.ndarray, sizes: np.ndarray) -> tuple[bytes, np.ndarray]:
        """Coded documents, each from a whole byte on, and their checkpoints."""
        bits = self.lengths[ids]
        first = np.cumsum(sizes) - sizes
        total = np.add.reduceat(bits, first)
        room = (total + 7) // 8 * 8
        begin = np.cumsum(room) - room
        run = np.cumsum(bits) - bits
        at = run + np.repeat(begin - run[first], sizes)
        inner = np.arange(len(ids)) - np.repeat(first, sizes)
        out = np.zeros(int(room.sum()) // 64 + 2, np.uint64)
        word, shift = at >> 6, 64 - (at & 63) - bits  # below 0: the code goes on in the next word
        codes = self.words[ids]
        over = shift < 0
        high = np.where(over, codes >> np.maximum(-shift, 0).astype(np.uint64), codes << np.maximum(shift, 0).astype(np.uint64))
        edges = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
        out[word[edges]] |= np.bitwise_or.reduceat(high, edges)
        k = np.flatnonzero(over)
        out[word[k] + 1] |= codes[k] << (64 + shift[k]).astype(np.uint64)
        return out.astype(">u8").tobytes()[: int(room.sum()) // 8], at[inner % CHECKPOINT == 0]

    def unpack(self, payload: bytes, checkpoints: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The ids of a block: all stretches between checkpoints advance together, one look-up each."""
        raw = np.frombuffer(payload + bytes(8), np.uint8).astype(np.uint32)
        # 32 bits from each byte on
        four = raw[:-3] << np.uint32(24) | raw[1:-2] << np.uint32(16) | raw[2:-1] << np.uint32(8) | raw[3:]
        stretches = (sizes + CHECKPOINT - 1) // CHECKPOINT
        left = np.full(int(stretches.sum()), CHECKPOINT)
        left[np.cumsum(stretches) - 1] = sizes - (stretches - 1) * CHECKPOINT
        order = np.argsort(-left, kind="stable")
        live = np.searchsorted(-left[order], -np.arange(1, CHECKPOINT + 1), "right")
        at = checkpoints[order].copy()
        out = np.zeros((CHECKPOINT, len(left)), np.uint32)
        drop = np.uint32(32 - self.width)
        for step in range(CHECKPOINT):
            n = int(live[step])
            if not n:
                break
            here = at[:n]
            hit = self.table[(four[here >> 3] << (here & 7).astype(np.uint32)) >> drop]
            out[step, :n] = hit >> np.uint32(6)
            at[:n] = here + (hit & np.uint32(63))
        back = np.empty(len(left), np.int64)
        back[order] = np.arange(len(left))
        grid = out.T[back]
        return grid[np.arange(CHECKPOINT) < left[:, None]]


def coded_batch(code: WordEncoder, batch: pa.RecordBatch, end_id: int) -> pa.RecordBatch:
    """The rows that ``encode`` makes of a batch's doc_id and text."""
    ids, lengths = code.encode(batch.column("text"))
    ends = np.cumsum(lengths)
    ids = np.insert(ids, ends, end_id)
    seen = np.bincount(ids)
    some = np.flatnonzero(seen)
    raw = ids.tobytes()
    cuts = np.concatenate(([0], (ends + np.arange(1, len(ends) + 1)) * ids.itemsize))
    view, at = memoryview(raw), cuts.tolist()
    sums = [zlib.crc32(view[a:b]) for a, b in zip(at, at[1:], strict=False)]
    tally = [np.concatenate((some, seen[some])).astype("<u4").tobytes()] + [None] * (len(sums) - 1)
    return pa.RecordBatch.from_arrays([batch.column("doc_id"), binary_array(raw, cuts), pa.array(sums, pa.int64()), pa.array(tally, pa.binary())], ["doc_id", "ids", "sum", "tally"])


def encode(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """doc_id, its ids with the end id, as little-endian integers of ``id_kind``, their CRC-32 ``sum``, and ``tally``.

    One row of a batch has the counts of all its ids: the ids that occur, then
    how often each does, 32 bits each. So counting reads this column alone.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(path)
        for batch in small_batches(batches, "text", 4 << 20):
            yield coded_batch(code, batch, end_id)

    return id_text_columns(docs).mapInArrow(run, "doc_id long, ids binary, sum long, tally binary")


def _counts(coded: DataFrame) -> DataFrame:
    """(id, n): the batches' counts, summed in each task and then over all; at most one row for each id of the vocabulary and task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << 16, np.int64)
        for batch in batches:
            for tally in batch.column("tally"):
                some, n = np.frombuffer(tally.as_py(), "<u4").reshape(2, -1)
                if some[-1] >= len(total):
                    total = np.concatenate((total, np.zeros(int(some[-1]) + 1 - len(total), np.int64)))
                total[some] += n
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some])], ["id", "n"])

    return coded.select("tally").filter("tally is not null").mapInArrow(run, "id int, n long").groupBy("id").agg(F.sum("n").alias("n"))


def _by_id(rows: list, value: str) -> np.ndarray:
    """Values of rows (id, value) as an array by id."""
    out = np.zeros(max([r["id"] for r in rows], default=0) + 1, np.int64)
    for r in rows:
        out[r["id"]] = r[value]
    return out


def write(docs: DataFrame, target: str, path: str | None = None, end_id: int = 1) -> None:
    """Write the store of all ``docs`` to the folder ``target``."""
    spark = docs.sparkSession
    path = path or default_path()
    kind = id_kind(path)
    width = np.dtype(kind).itemsize
    coded = cut(encode(docs, path, end_id))
    counts = _by_id(_counts(coded).collect(), "n")  # one row for each id of the vocabulary
    lengths = code_lengths(counts)
    code = Code(lengths)
    some = np.flatnonzero(lengths).tolist()
    spark.createDataFrame([(i, int(lengths[i])) for i in some], "id int, bits int").coalesce(1).write.parquet(f"{target}/code")
    shared = spark.sparkContext.broadcast(code)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, names = shared.value, ["part", "block", "doc_ids", "sizes", "payload", "checkpoints"]
        part = TaskContext.get().partitionId()
        held: list[tuple[int, bytes]] = []
        state = {"block": 0, "ids": 0}

        def flush() -> pa.RecordBatch:
            sizes = np.array([len(x) // width for _, x in held])
            payload, marks = code.pack(np.frombuffer(b"".join(x for _, x in held), kind).astype(np.int64), sizes)
            one = lambda x, kind: pa.array([x], kind)
            out = pa.RecordBatch.from_arrays([one(part, pa.int32()), one(state["block"], pa.int32()), one([d for d, _ in held], pa.list_(pa.int64())), one(sizes, pa.list_(pa.int32())), one(payload, pa.binary()), one(marks, pa.list_(pa.int64()))], names)
            held.clear()
            state["block"] += 1
            state["ids"] = 0
            return out

        for batch in batches:
            for doc, ids in zip(batch.column("doc_id").to_pylist(), batch.column("ids"), strict=True):
                ids = ids.as_py()
                if held and state["ids"] + len(ids) // width > BLOCK_IDS:
                    yield flush()
                held.append((doc, ids))
                state["ids"] += len(ids) // width
        if held:
            yield flush()

    # ranges, so that parts follow each other
    parts = max(1, -(-coded.count() // PART_ROWS), -(-int(counts.sum()) * width // PART_BYTES))
    order = (F.col("doc_id").asc_nulls_first(), F.col("sum"), F.col("at"))
    ordered = coded.select("doc_id", "ids", "sum", F.monotonically_increasing_id().alias("at")).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    ordered.select("doc_id", "ids").mapInArrow(run, "part int, block int, doc_ids array<long>, sizes array<int>, payload binary, checkpoints array<long>").write.option("compression", "none").parquet(f"{target}/blocks")


def read_code(spark: SparkSession, target: str) -> Code:
    return Code(_by_id(spark.read.parquet(f"{target}/code").collect(), "bits"))  # one row for each id of the vocabulary


def read_blocks(spark: SparkSession, target: str) -> DataFrame:
    """The blocks with ``before``, the number of ids in all blocks before (sums of parts first, then within a part)."""
    blocks = spark.read.parquet(f"{target}/blocks").withColumn("n_ids", F.aggregate("sizes", F.lit(0).cast("long"), lambda n, x: n + x))
    by_part = blocks.groupBy("part").agg(F.sum("n_ids").alias("n"))
    # one row for each part of PART_ROWS documents
    starts = by_part.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("part_start"))
    within = blocks.select("part", "block", F.coalesce(F.sum("n_ids").over(Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("inner"))
    before = within.join(starts, "part").select("part", "block", (F.col("part_start") + F.col("inner")).alias("before"))
    return blocks.join(before, ["part", "block"])


def _decoded(spark: SparkSession, target: str, emit: Callable, schema: str) -> DataFrame:
    """What ``emit`` makes of each block's doc_ids, starts, sizes and ids."""
    shared = spark.sparkContext.broadcast(read_code(spark, target))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                sizes = batch.column("sizes")[k].values.to_numpy(zero_copy_only=False).astype(np.int64)
                ids = shared.value.unpack(batch.column("payload")[k].as_py(), batch.column("checkpoints")[k].values.to_numpy(zero_copy_only=False).astype(np.int64), sizes)
                start = batch.column("before")[k].as_py() + np.cumsum(sizes) - sizes
                yield emit(batch.column("doc_ids")[k].values, start, sizes, ids)

    return read_blocks(spark, target).select("before", "doc_ids", "sizes", "payload", "checkpoints").mapInArrow(run, schema)


def read_documents(spark: SparkSession, target: str) -> DataFrame:
    """doc_id, start (ids of all documents before) and ids, decoded from the store's files."""

    def emit(doc_ids: pa.Array, start: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([doc_ids, pa.array(start), list_array(ids.view(np.int32), sizes, pa.int32())], ["doc_id", "start", "ids"])

    return _decoded(spark, target, emit, "doc_id long, start long, ids array<int>")


def read_checksums(spark: SparkSession, target: str) -> DataFrame:
    """doc_id, start, n_tokens and the CRC-32 of the decoded ids as little-endian 32-bit integers."""

    def emit(doc_ids: pa.Array, start: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
        ends, raw = np.cumsum(sizes), ids.astype("<u4")
        crc = [zlib.crc32(raw[b - n : b]) for b, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
        return pa.RecordBatch.from_arrays([doc_ids, pa.array(start), pa.array(sizes), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return _decoded(spark, target, emit, "doc_id long, start long, n_tokens long, ids_crc32 long")


def store(docs: DataFrame) -> str:
    """Write a store to the shared folder and return where it is."""
    target = scratch_dir(docs.sparkSession)
    write(docs, target)
    return target
