"""Operator 1: BPE encoding and decoding with an automaton over tokens.

The merge list is compiled, rule by rule, into a deterministic automaton whose
arcs are tokens and whose states are "what was read last". It starts with one
arc a byte. The gadget of rule ``u v -> t`` takes the arc ``v`` away from the
state after ``u``, adds the arc ``t`` wherever ``u`` and then ``v`` could be
read, and lets ``t`` end in a copy of the state after ``v`` as it is at that
moment. Copies are kept as (original, time of copying), so the automaton takes
memory in proportion to the merge list. Each byte string is spelled by exactly
one path, which is its BPE encoding; decoding emits the labels of the arcs.

Encoding reads all pieces of a batch side by side, byte by byte, over tables
compiled from that automaton: ``step`` (a row a prefix of a label, a column a
byte) leads on, ``longest`` and ``shorter`` name the arcs that end here, and
``follows`` is the automaton's transition from the state at an arc's beginning,
worked out when it is first met. At each byte the arcs that end there are tried,
longest first; just one has a beginning that lets it follow, as the path of every
prefix is unique, so nothing is taken back. Pieces over LONG bytes are read one
by one in the same way, since there are too few to read side by side.

Results for odd input: a null or empty text has no tokens and decodes to "";
special strings of the tokenizer file become their own ids as in the library;
rows with equal doc_id are encoded row by row; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, coded_parts, id_text_columns, list_array, mix, small_batches, stretches

#: Fixed value: how byte-level BPE cuts a text into pieces before the merges.
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


#: Transitions that are held at once, and bytes of pieces that are read side by side.
SLOTS, CELLS = 1 << 20, 1 << 20
#: Bytes over which a piece is read by itself.
LONG = 256
#: Two characters of white space in a row, as RE2 has it.
SPACES = r"[\s\x0B\x1C-\x1F\x{85}\p{Z}]{2}"


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary file: printable Latin-1 for itself, the rest from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class MergeAutomaton:
    """Deterministic token automaton of a merge list.

    ``labels[t]`` are the bytes that arc ``t`` spells. ``gadgets[u, v]`` is the
    time at which the state after ``u`` lost its arc ``v``.
    """

    def __init__(self, labels: dict[int, bytes], merges: list[tuple[int, int, int]]):
        self.labels = labels
        self.left: dict[int, int] = {}
        self.right: dict[int, int] = {}
        self.made: dict[int, int] = {}
        self.gadgets: dict[tuple[int, int], int] = {}
        made_of = {t for _, _, t in merges}
        self.arcs = {labels[t]: t for t in labels if t not in made_of}
        for time, (u, v, t) in enumerate(merges):
            self._gadget(time, u, v, t)
        self._compile()

    def _gadget(self, time: int, u: int, v: int, t: int) -> None:
        """Splice rule ``u v -> t``: void where no state lets ``v`` follow ``u`` any more."""
        reachable = self.labels[u] in self.arcs and self.labels[v] in self.arcs and self.arcs[self.labels[u]] == u and self.arcs[self.labels[v]] == v
        if not reachable or not self._has_arc(u, v):
            return
        self.gadgets[u, v] = time
        if self.labels[t] not in self.arcs:
            self.left[t], self.right[t], self.made[t] = u, v, time
            self.arcs[self.labels[t]] = t

    def _lost(self, state: int, arc: int, before: int) -> bool:
        """Whether the state had lost the arc before that time; a copied state carries what its original had lost by then."""
        while True:
            time = self.gadgets.get((state, arc))
            if time is not None and time < before:
                return True
            if state not in self.right:
                return False
            before = min(before, self.made[state])
            state = self.right[state]

    def _has_arc(self, state: int, arc: int) -> bool:
        """Whether the state has the arc: it must have had each first part when the whole was made (rules run from the left, so at that time included)."""
        before = 1 << 62
        while not self._lost(state, arc, before):
            if arc not in self.left:
                return True
            before = min(before, self.made[arc] + 1)
            arc = self.left[arc]
        return False

    def _compile(self) -> None:
        """Tables over bytes. ``step`` is complete: where no label goes on, it leads to the longest suffix that does."""
        children: list[dict[int, int]] = [{}]
        home: dict[int, int] = {}
        for label, t in self.arcs.items():
            node = 0
            for byte in label:
                if byte not in children[node]:
                    children[node][byte] = len(children)
                    children.append({})
                node = children[node][byte]
            home[t] = node
        top = max(self.arcs.values()) + 1
        self.step = np.zeros((len(children), 256), np.int32)
        self.longest, back = np.full(len(children), -1, np.int32), np.zeros(len(children), np.int32)
        for t, node in home.items():
            self.longest[node] = t
        level = [0]
        while level:
            below = []
            for node in level:
                row = self.step[back[node]].copy() if node else self.step[0]
                for byte, child in children[node].items():
                    back[child] = row[byte] if node else 0
                    row[byte] = child
                    below.append(child)
                self.step[node] = row
            for node in below:
                if self.longest[node] < 0:
                    self.longest[node] = self.longest[back[node]]
            level = below
        self.shorter, self.size = np.full(top, -1, np.int32), np.zeros(top, np.int32)
        for label, t in self.arcs.items():
            self.shorter[t] = self.longest[back[home[t]]]
            self.size[t] = len(label)
        # numbers of the tables one by one, for long pieces
        self.flat_step, self.flat_longest, self.flat_shorter, self.flat_size = (memoryview(np.ascontiguousarray(x).reshape(-1)) for x in (self.step, self.longest, self.shorter, self.size))
        self.arc_after = Memo(lambda pair: self._has_arc(pair >> 32, pair & 0xFFFFFFFF), SLOTS)
        self.known = np.full(SLOTS, -1, np.int64)
        self.holds = np.zeros(SLOTS, bool)

    def follows(self, states: np.ndarray, arcs: np.ndarray) -> np.ndarray:
        """Whether each state has the arc; transitions are worked out when they are first met and kept in a table of fixed size."""
        pairs = states.astype(np.int64) << 32 | arcs
        slot = (mix(pairs.view(np.uint64)) & np.uint64(SLOTS - 1)).astype(np.int64)
        out = self.holds[slot]
        new = np.flatnonzero(self.known[slot] != pairs)
        if len(new):
            some, back = np.unique(pairs[new], return_inverse=True)
            found = np.array([self._has_arc(p >> 32, p & 0xFFFFFFFF) for p in some.tolist()], bool)[back]
            out[new] = found
            # of pairs that share a slot one is kept
            _, last = np.unique(slot[new], return_index=True)
            self.known[slot[new[last]]], self.holds[slot[new[last]]] = pairs[new[last]], found[last]
        return out

    def encode(self, pieces: list[bytes]) -> list[bytes]:
        """For each piece the arcs of the only path that spells it, as 32-bit integers."""
        out: list[bytes] = [b""] * len(pieces)
        lengths = np.array([len(p) for p in pieces], np.int64)
        order = np.argsort(-lengths, kind="stable")
        order = order[lengths[order] > 0]
        n_long = int(np.searchsorted(-lengths[order], -LONG, "left"))
        for k in order[:n_long].tolist():
            out[k] = self._path(pieces[k])
        order = order[n_long:]
        # pieces of about one length go together, so that the table of states stays small
        at = 0
        while at < len(order):
            room = max(1, CELLS // int(lengths[order[at]]))
            some = order[at : at + room]
            for k, path in zip(some.tolist(), self._paths([pieces[k] for k in some.tolist()], lengths[some]), strict=True):
                out[k] = path
            at += room
        return out

    def _path(self, piece: bytes) -> bytes:
        """``encode`` of one long piece."""
        step, longest, shorter, size, arc_after = self.flat_step, self.flat_longest, self.flat_shorter, self.flat_size, self.arc_after
        arcs = array("i", bytes(4 * (len(piece) + 1)))
        node = 0
        for end, byte in enumerate(piece, 1):
            node = step[node << 8 | byte]
            arc = longest[node]
            while arc >= 0:
                begin = end - size[arc]
                if begin == 0 or arc_after[arcs[begin] << 32 | arc]:
                    break
                arc = shorter[arc]
            else:
                raise ValueError(f"no path spells {piece[:100]!r}")
            arcs[end] = arc
        path = array("i")
        end = len(piece)
        while end:
            path.append(arcs[end])
            end -= size[arcs[end]]
        path.reverse()
        return path.tobytes()

    def _paths(self, pieces: list[bytes], lengths: np.ndarray) -> list[bytes]:
        """``encode`` of pieces that aren't empty, longest first."""
        raw = np.frombuffer(b"".join(pieces), np.uint8)
        first = np.cumsum(lengths) - lengths
        states = np.full((int(lengths[0]) + 1, len(pieces)), -1, np.int32)
        node = np.zeros(len(pieces), np.int32)
        for end in range(1, len(states)):
            n = int(np.searchsorted(-lengths, -end, "right"))
            node[:n] = self.step[node[:n], raw[first[:n] + end - 1]]
            arc = self.longest[node[:n]]
            open_ = np.arange(n)
            while len(open_):
                if (arc[open_] < 0).any():
                    raise ValueError(f"no path spells {pieces[int(open_[arc[open_] < 0][0])]!r}")
                begin = end - self.size[arc[open_]]
                fits = begin == 0
                inner = np.flatnonzero(~fits)
                fits[inner] = self.follows(states[begin[inner], open_[inner]], arc[open_[inner]])
                open_ = open_[~fits]
                arc[open_] = self.shorter[arc[open_]]
            states[end, :n] = arc
        end, who = lengths.copy(), np.arange(len(pieces))
        back, whose = [], []
        while len(who):
            arc = states[end[who], who]
            back.append(arc)
            whose.append(who)
            end[who] -= self.size[arc]
            who = who[end[who] > 0]
        whose, back = np.concatenate(whose), np.concatenate(back)
        # steps back of one piece stand in order; turned round they are its path
        turned = np.argsort(whose[::-1], kind="stable")
        ids = back[::-1][turned].astype(np.int32).tobytes()
        cuts = (np.cumsum(np.bincount(whose, minlength=len(pieces))) * 4).tolist()
        return [ids[a:b] for a, b in zip([0, *cuts], cuts, strict=False)]


class ByteBpe:
    """Encoder and decoder of a byte-level BPE file: pieces, automaton, special strings."""

    def __init__(self, path: str, memo: int = 150_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        vocab: dict[str, int] = spec["model"]["vocab"]
        labels = {i: bytes(letters[c] for c in token) for token, i in vocab.items()}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.automaton = MergeAutomaton(labels, [(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs])
        self.special = {x["content"]: x["id"] for x in spec.get("added_tokens") or []}
        self.special_pattern = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        size = max([*labels, *self.special.values()]) + 1
        self.label = [labels.get(i, b"") for i in range(size)]
        for text, i in self.special.items():
            self.label[i] = text.encode()
        self.labels, self.decimals = pa.array(self.label, pa.binary()), pa.array([str(i) for i in range(size)], pa.string())
        self.pieces = regex.compile(PIECES)
        self.chunks = regex.compile(r"\s*\S+|\s+")
        self.by_chunk = Memo(self._chunk, memo)

    def _cut(self, chunk: str) -> list[str]:
        """A chunk's pieces. One that begins with a space is mostly a word, or a word and a sign."""
        word, last = chunk[1:-1], chunk[-1]
        if chunk[0] == " " and word.isalpha():
            if last.isalpha():
                return [chunk]
            if not last.isalnum() and not last.isspace() and last.isprintable():
                return [chunk[:-1], last]
        return self.pieces.findall(chunk)

    def _chunk(self, chunk: str) -> bytes:
        return b"".join(self.automaton.encode([p.encode() for p in self.pieces.findall(chunk)]))

    def encode_chunks(self, chunks: list[str]) -> list[bytes]:
        """Ids of chunks, those that the memo doesn't hold all together."""
        new = [c for c in chunks if c not in self.by_chunk and c not in self.by_chunk.old]
        cuts = [self._cut(c) for c in new]
        pieces = list({p: None for cut in cuts for p in cut})
        ids = dict(zip(pieces, self.automaton.encode([p.encode() for p in pieces]), strict=True))
        fresh = {c: ids[cut[0]] if len(cut) == 1 else b"".join([ids[p] for p in cut]) for c, cut in zip(new, cuts, strict=True)}
        out = [fresh[c] if c in fresh else self.by_chunk[c] for c in chunks]
        self.by_chunk.take_in(fresh)
        return out

    def _plain(self, text: str) -> bytes:
        """No piece reaches from a character that isn't white space to one that is, so such chunks are encoded by themselves."""
        return b"".join(self.encode_chunks(self.chunks.findall(text)))

    def encode_text(self, text: str) -> bytes:
        """A text's ids, any special strings in it included."""
        if self.special_pattern is None or not any(s in text for s in self.special):
            return self._plain(text)
        parts = self.special_pattern.split(text)
        return b"".join(np.int32(self.special[p]).tobytes() if k % 2 else self._plain(p) for k, p in enumerate(parts))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, and how many each has.

        Where white space never stands twice in a row, a text is cut at its
        spaces and each distinct chunk of the batch is encoded once.
        """
        texts = texts.fill_null("")
        odd = pc.match_substring_regex(texts, SPACES)
        for special in self.special:
            odd = pc.or_(odd, pc.match_substring(texts, special))
        parts = pc.split_pattern(pc.if_else(odd, "", texts), " ")
        heads = pc.list_element(parts, 0).to_pylist() if len(parts) else []
        own = self.encode_chunks([h or "\n" for h in heads])
        own = [self.encode_text(texts[k].as_py()) if strange else ids if head else b"" for k, (strange, head, ids) in enumerate(zip(odd.to_pylist(), heads, own, strict=True))]
        return coded_parts(parts, lambda chunks: self.encode_chunks([" " + c for c in chunks]), own, np.int32)

    def decode_bytes(self, ids: list[int]) -> bytes:
        return b"".join(map(self.label.__getitem__, ids))


@lru_cache(maxsize=2)
def tokenizer(path: str) -> ByteBpe:
    """One automaton a Python worker."""
    return ByteBpe(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and token_ids (array of int) of every whole text."""
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = tokenizer(path)
        for batch in small_batches(batches, "text", 4 << 20):
            ids, lengths = coder.encode(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), list_array(ids, lengths, pa.int32())], ["doc_id", "token_ids"])

    return id_text_columns(docs).mapInArrow(run, "doc_id long, token_ids array<int>")


def _joined(column: pa.ListArray, names: pa.Array, between: str | bytes) -> Iterator[bytes]:
    """Per list of ids their names, joined, as bytes; a null list is empty."""
    column = column.fill_null([])
    for a, b in stretches(pc.list_value_length(column).to_numpy(), 1 << 20):
        part = column.slice(a, b - a)
        offsets = part.offsets.to_numpy()
        named = pa.LargeListArray.from_arrays(pa.array(offsets - offsets[0], pa.int64()), names.take(part.flatten()))
        for text in pc.binary_join(named, between):
            yield text.as_buffer().to_pybytes()


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and text: the labels of the arcs one after another; bytes that aren't UTF-8 become U+FFFD. Null ids are an empty text."""
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = tokenizer(path)
        for batch in batches:
            texts = [x.decode("utf-8", "replace") for x in _joined(batch.column("token_ids"), coder.labels, b"")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "token_ids").mapInArrow(run, "doc_id long, text string")


def digests(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """Per row of ``encode``: its token count, and SHA-256 of the decimal ids and of the decoded text."""
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = tokenizer(path)
        for batch in batches:
            ids = batch.column("token_ids")
            sizes = pc.fill_null(pc.list_value_length(ids), 0).cast(pa.int64())
            ids_sha = [hashlib.sha256(x).hexdigest() for x in _joined(ids, coder.decimals, ",")]
            text_sha = [hashlib.sha256(x.decode("utf-8", "replace").encode()).hexdigest() for x in _joined(ids, coder.labels, b"")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), sizes, pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return encoded.select("doc_id", F.col("token_ids")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
