"""Supervised subword embeddings: hashed features, averaged vectors, softmax, numpy SGD.

A document is the mean of its features' vectors; a linear softmax sits on top.
For prediction vectors and output weights are multiplied out, so a feature is a
row of class scores and a document the mean of rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import LOWER, byte_view, mix, small_batches, span_hashes, spans_of

#: Features of a batch: hashed ids and, for each, its text's number.
Features = Callable[[np.ndarray, np.ndarray], list[tuple[np.ndarray, np.ndarray]]]


def grams(codes: np.ndarray, offsets: np.ndarray, size: int, buckets: int, inside: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of bytes that lie within one text (and whose inner bytes are ``inside``): ids and starts."""
    n = len(codes) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    word = np.zeros(n, np.uint64)
    for j in range(size):
        word |= codes[j : n + j].astype(np.uint64) << np.uint64(8 * j)
    good = np.ones(n, bool)
    for edge in range(1, size):
        cross = offsets[1:-1] - edge
        good[cross[(cross >= 0) & (cross < n)]] = False
    if inside is not None:
        for j in range(1, size - 1):
            good &= inside[j : n + j]
        if size == 2:
            good &= inside[:n] | inside[1 : n + 1]
    at = np.flatnonzero(good)
    with np.errstate(over="ignore"):
        mixed = (word[at] + np.uint64(size)) * np.uint64(0x9E3779B97F4A7C15)
    return ((mixed >> np.uint64(40)) % np.uint64(buckets)).astype(np.int64), at


def letter_features(buckets: int) -> Features:
    """Byte 3- and 4-grams of words with their boundaries; what is no letter is a boundary."""
    letters = np.zeros(256, bool)
    letters[97:123] = letters[128:] = True

    def features(raw: np.ndarray, offsets: np.ndarray):
        codes = LOWER[raw]
        inside = letters[codes]
        codes[~inside] = 32
        return [grams(codes, offsets, n, buckets, inside) for n in (3, 4)]

    return features


def text_features(buckets: int) -> Features:
    """Whole words, pairs of words and byte 3- and 4-grams of everything, punctuation and digits included.

    A pair is hashed by its words' difference, so all pairs of twice the same word are one feature.
    """
    digits = LOWER.copy()
    digits[48:58] = 48

    def features(raw: np.ndarray, offsets: np.ndarray):
        codes = digits[raw]
        starts, ends = spans_of(codes > 32, offsets)
        hashes = span_hashes(codes, starts, ends)
        text_of = np.searchsorted(offsets, starts, "right")
        out = [((hashes % np.uint64(buckets)).astype(np.int64), starts)]
        for apart in (1, 2):
            if len(starts) > apart:
                together = np.flatnonzero(text_of[apart:] == text_of[:-apart])
                pairs = mix(hashes[together + apart] - hashes[together] + np.uint64(apart))
                out.append(((pairs % np.uint64(buckets)).astype(np.int64), starts[together]))
        return [*out, *(grams(codes, offsets, n, buckets) for n in (3, 4))]

    return features


@dataclass
class Classifier:
    """Class names, a score for each class and feature, the classes' biases, and the temperature that calibrates.

    ``seen`` tells the features that were learned from (None: all); ``least`` and
    ``least_seen`` are the confidence and the share of such features below which
    a text is none of the classes.
    """

    classes: list
    scores: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    least: float = 0.0
    seen: np.ndarray | None = None
    least_seen: float = 0.0

    def probabilities(self, logits: np.ndarray) -> np.ndarray:
        z = logits / self.temperature
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)

    def logits(self, raw: np.ndarray, offsets: np.ndarray, features: Features) -> np.ndarray:
        """Mean class scores of each text's features, plus the bias; every byte of every text counts."""
        return self.means(raw, offsets, features, self.scores)[0] + self.bias

    def means(self, raw: np.ndarray, offsets: np.ndarray, features: Features, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Mean of each row of ``scores`` over each text's features, and their number."""
        n = len(offsets) - 1
        total, count = np.zeros((n, len(scores))), np.zeros(n)
        for ids, at in features(raw, offsets):
            cuts = np.searchsorted(at, offsets)
            some = np.flatnonzero(np.diff(cuts))
            if len(some):
                for c in range(len(scores)):
                    total[some, c] += np.add.reduceat(scores[c][ids], cuts[some], dtype=np.float64)
                count[some] += np.diff(cuts)[some]
        return total / np.maximum(count, 1)[:, None], count


def collect_features(rows: DataFrame, features: Callable[[], Features], label: str) -> list[tuple[object, np.ndarray, np.ndarray]]:
    """(label, ids, shares) of a bounded number of rows (doc_id, text, label), in a fixed order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = features()
        for batch in small_batches(batches, "text", 1 << 20):
            ids, counts = [], []
            for k in range(batch.num_rows):
                raw, offsets = byte_view(batch.column("text").slice(k, 1))
                found = [f for f, _ in get(raw, offsets)]
                values, n = np.unique(np.concatenate(found) if found else np.zeros(0, np.int64), return_counts=True)
                ids.append(values.astype("<i4").tobytes())
                counts.append((n / max(n.sum(), 1)).astype("<f4").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array(ids, pa.binary()), pa.array(counts, pa.binary())], ["doc_id", "label", "ids", "shares"])

    kind = rows.schema[label].dataType.simpleString()
    got = rows.selectExpr("doc_id", "text", f"{label} as label").mapInArrow(run, f"doc_id long, label {kind}, ids binary, shares binary").collect()
    got.sort(key=lambda r: (r["doc_id"], bytes(r["ids"])))
    return [(r["label"], np.frombuffer(r["ids"], "<i4"), np.frombuffer(r["shares"], "<f4")) for r in got]


def fit(rows: list[tuple[object, np.ndarray, np.ndarray]], buckets: int, width: int = 16, epochs: int = 8, rate: float = 0.5, seed: int = 7, reject_share: float = 0.001, most_reject: float = 0.5) -> Classifier:
    """Train on four fifths of the rows; the rest sets the temperature, the confidence that only ``reject_share`` of them fall below (at most ``most_reject``), and four fifths of the least share of features known that one of them has."""
    classes = sorted({y for y, _, _ in rows})
    if not classes:
        return Classifier([], np.zeros((0, buckets), np.float32), np.zeros(0))
    number = {y: k for k, y in enumerate(classes)}
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(rows))
    held = order[: len(rows) // 5] if len(rows) >= 50 else order[:0]
    train = order[len(held) :]
    vectors = rng.uniform(-1, 1, (buckets, width)).astype(np.float32)
    weights, bias = np.zeros((width, len(classes)), np.float32), np.zeros(len(classes), np.float32)
    steps, done = epochs * len(train), 0
    for _ in range(epochs):
        for k in rng.permutation(train):
            y, ids, shares = rows[k]
            step = rate * (1 - done / steps)
            done += 1
            if not len(ids):
                continue
            mean = shares @ vectors[ids]
            z = mean @ weights + bias
            z = np.exp(z - z.max())
            error = z / z.sum()
            error[number[y]] -= 1
            back = weights @ error
            weights -= step * np.outer(mean, error)
            bias -= step * error
            # a feature's share is small, so its vector takes a step as large as the mean's
            vectors[ids] -= (step * 20 * shares)[:, None] * back
    seen = np.zeros(buckets, bool)
    for k in train:
        seen[rows[k][1]] = True
    model = Classifier(classes, np.ascontiguousarray((vectors @ weights).T), bias.astype(np.float64), seen=seen)
    if len(held):
        logits = np.array([(model.scores[:, ids] @ shares if len(ids) else 0) + model.bias for _, ids, shares in (rows[k] for k in held)])
        truth = np.array([number[rows[k][0]] for k in held])

        def loss(t: float) -> float:
            model.temperature = t
            return -np.log(np.maximum(model.probabilities(logits)[np.arange(len(truth)), truth], 1e-12)).mean()

        model.temperature = min(np.geomspace(0.05, 20, 60), key=loss)
        best = model.probabilities(logits).max(1)
        model.least = float(min(most_reject, np.quantile(best, reject_share)))
        model.least_seen = 0.8 * min(float(shares @ seen[ids]) for _, ids, shares in (rows[k] for k in held) if len(ids))
    return model
