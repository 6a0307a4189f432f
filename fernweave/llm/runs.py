"""Operator 11: periodic runs of words through a suffix automaton with link-cut access.

A run is a stretch of consecutive words with smallest period q, of at least
``least`` words and ``times`` periods, that no neighbouring word extends.

The words of a stretch are appended to a suffix automaton. Its suffix links
form a tree in which the prefix that ends at word i is a node, and the path
from there to the root holds all substrings that end at i. Every node carries
the place where its substrings ended last. Access to prefix i walks that path
in segments of one such place p and recolours them to i. If i - p is at most
the length of the segment's longest substring, the last i - p words stand
twice, side by side: a square with period i - p, which is the smallest one,
since a smaller would have given a later place. Each square is extended to the
left and to the right to its run, once a run.

The tree is kept in solid paths (each node with its larger subtree). As access
always recolours a path's upper part, the segments of a solid path are a stack,
the uppermost on top: access cuts the segments above off and pushes one. A path
to the root meets log n solid paths, and what is taken off was put there once,
so n words take O(n log n).

Stretches: all words of a run after its first period have repeated the words
one period before. Only where enough consecutive word n-grams stand in the text
before, a run can be; to either side it reaches no further than a bound that
follows from their number. Other words aren't given to the automaton; no run is
lost, whatever its length or period.

Results for odd input: a null, empty or blank text has no words and no runs;
rows are judged one by one, whatever their doc_id; words are told apart by
their bytes; other columns are ignored. A text is one task's work, with memory
in proportion to its words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import id_text_columns, mix, small_batches

#: Words of a run and repeats of its period at least.
LEAST, TIMES = 24, 3
#: Bytes of text whose words are compared at once.
BATCH_BYTES = 4 << 20


class SuffixAutomaton:
    """Suffix automaton of a list of words (numbers from 0), as its links and lengths.

    Most states lead on by one word alone, so that one stands in two lists and
    only further ones in a dict.
    """

    def __init__(self, words: list[int]):
        self.link, self.length = [-1], [0]
        self.word, self.to = [-1], [0]
        self.more: dict[int, dict[int, int]] = {}
        #: The state of the prefix that ends with each word.
        self.prefixes: list[int] = []
        last = 0
        for w in words:
            last = self._append(last, w)
            self.prefixes.append(last)

    def _state(self, length: int, link: int, word: int, to: int) -> int:
        self.length.append(length)
        self.link.append(link)
        self.word.append(word)
        self.to.append(to)
        return len(self.length) - 1

    def _append(self, last: int, w: int) -> int:
        link, length, word, to, more = self.link, self.length, self.word, self.to, self.more
        new = self._state(length[last] + 1, 0, -1, 0)
        state = last
        while state >= 0:
            if word[state] < 0:
                word[state], to[state] = w, new
            elif word[state] == w:
                break
            elif state not in more:
                more[state] = {w: new}
            elif w in more[state]:
                break
            else:
                more[state][w] = new
            state = link[state]
        if state < 0:
            return new
        target = to[state] if word[state] == w else more[state][w]
        if length[target] == length[state] + 1:
            link[new] = target
            return new
        twin = self._state(length[state] + 1, link[target], word[target], to[target])
        if target in more:
            more[twin] = dict(more[target])
        link[target] = link[new] = twin
        while state >= 0:
            if word[state] == w:
                if to[state] != target:
                    break
                to[state] = twin
            else:
                if more[state].get(w) != target:
                    break
                more[state][w] = twin
            state = link[state]
        return new


class Access:
    """Access to the automaton's prefixes one after another over solid paths of its links."""

    def __init__(self, automaton: SuffixAutomaton):
        self.link, self.length = link, length = automaton.link, automaton.length
        order = np.argsort(np.array(length), kind="stable").tolist()
        size = [1] * len(length)
        for state in reversed(order[1:]):
            size[link[state]] += size[state]
        solid = [-1] * len(length)
        for state in order[1:]:
            above = link[state]
            if solid[above] < 0 or size[solid[above]] < size[state]:
                solid[above] = state
        #: The uppermost state of each state's solid path, and for that one the path's segments (lowest length, place), uppermost last.
        self.top = top = list(range(len(length)))
        for state in order[1:]:
            if solid[link[state]] == state:
                top[state] = top[link[state]]
        self.segments: dict[int, list[tuple[int, int]]] = {}

    def recolour(self, state: int, place: int) -> list[tuple[int, int]]:
        """Colour the path from the state to the root; returns (period, length) of the squares that end at ``place``."""
        link, length, top, segments = self.link, self.length, self.top, self.segments
        squares = []
        while state >= 0:
            head, low = top[state], length[state]
            path = segments.get(head)
            if path is None:
                segments[head] = [(low, place)]
            else:
                reach = -1
                while path and path[-1][0] <= low:
                    reach, old = path.pop()
                    if place - old <= reach:
                        squares.append((place - old, reach))
                if path and reach < low and place - path[-1][1] <= low:
                    squares.append((place - path[-1][1], low))
                path.append((low, place))
            state = link[head]
        return squares


def _stretches(words: np.ndarray, text_of: np.ndarray, cuts: np.ndarray, least: int, times: int) -> list[tuple[int, int]]:
    """Stretches of the words of many texts (ascending, disjoint, each within its text) outside which no run can be."""
    size = max(1, least // times)
    spots = len(words) - size + 1
    if spots < 1:
        return []
    with np.errstate(over="ignore"):
        grams = mix(text_of[:spots].astype(np.uint64))
        for k in range(size):
            grams = (grams ^ words[k : k + spots].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            grams ^= grams >> np.uint64(29)
    order = np.argsort(grams, kind="stable")
    again = np.zeros(spots + 1, bool)
    again[order[1:]] = grams[order[1:]] == grams[order[:-1]]
    again[:spots] &= text_of[:spots] == text_of[size - 1 :]
    # where texts meet, n-grams over the border are no repeats, so that no stretch crosses it
    edges = np.flatnonzero(np.diff(np.concatenate(([False], again)).astype(np.int8)))
    begin, end = edges[::2], edges[1::2]
    many = end - begin
    # a run of length l and period q has l - q - size + 1 repeated n-grams in a row, l >= max(least, times * q)
    kept = many >= max(1, least - least // times - size + 1)
    begin, end, many = begin[kept], end[kept], many[kept]
    first = cuts[text_of[begin]]
    begin = np.maximum(first, begin - (many + size - 1) // (times - 1))
    end = end + size - 1
    out: list[tuple[int, int]] = []
    for a, b in sorted(zip(begin.tolist(), end.tolist(), strict=True)):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def runs_in(words: list[int], least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of the words, by start and period."""
    automaton = SuffixAutomaton(words)
    access = Access(automaton)
    n, known, out = len(words), {}, []
    for i, state in enumerate(automaton.prefixes):
        for period, length in access.recolour(state, i):
            if known.get(period, -1) >= i:
                continue
            start, end = i - period - length + 1, i + 1
            while start > 0 and words[start - 1] == words[start - 1 + period]:
                start -= 1
            while end < n and words[end] == words[end - period]:
                end += 1
            known[period] = end - 1
            if end - start >= max(least, times * period):
                out.append((start, end - start, period))
    return sorted(out, key=lambda run: (run[0], run[2]))


def _kept(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of n words stay: those that no run contains after its first period."""
    gone = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        gone[start + period] += 1
        gone[start + length] -= 1
    return np.cumsum(gone[:n]) == 0


def find_runs(docs: DataFrame, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """Per row: doc_id, n_words, runs (start, length, period; by start and period) and collapsed, the words left with one period of each run, joined by spaces."""
    if times < 2 or least < times:
        raise ValueError("a run has two periods and as many words as periods at least")
    kind = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text", BATCH_BYTES):
            # of bytes: split() knows ASCII white space alone
            texts = [(x.as_py() or b"").split() for x in batch.column("text").cast(pa.binary())]
            counts = np.array([len(t) for t in texts], np.int64)
            cuts = np.concatenate(([0], np.cumsum(counts)))
            text_of = np.repeat(np.arange(len(texts)), counts)
            words = pa.array([w for t in texts for w in t], pa.binary()).dictionary_encode().indices.to_numpy()
            found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
            for a, b in _stretches(words, text_of, cuts, least, times):
                k = int(text_of[a])
                found[k] += [(start + a - int(cuts[k]), length, period) for start, length, period in runs_in(words[a:b].tolist(), least, times)]
            left = []
            for text, runs in zip(texts, found, strict=True):
                if runs:
                    text = [text[j] for j in np.flatnonzero(_kept(len(text), runs)).tolist()]
                left.append(b" ".join(text).decode())
            rows = [[{"start": s, "length": n, "period": q} for s, n, q in runs] for runs in found]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts), pa.array(rows, kind), pa.array(left, pa.string())], ["doc_id", "n_words", "runs", "collapsed"])

    return id_text_columns(docs).mapInArrow(run, "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")
