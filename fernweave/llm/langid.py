"""Operator 5: language ID with averaged hashed subword embeddings.

A linear softmax over the mean of hashed letter n-gram vectors is trained by
stochastic gradient descent on a bounded sample of labelled rows, calibrated by
a temperature on a fifth of them, and rejects what it isn't sure of or what has
too many n-grams that it hasn't learned from.

The sample takes of each language the rows whose hashes of doc_id and text are
smallest: ROWS_PER_LANGUAGE, or fewer if MOST_ROWS shared over all languages are
fewer, and no more than have a language's share of MOST_BYTES of text together,
but one at least. Equal rows count once, each with its whole text. More than
MOST_LANGUAGES labels are an error, as sample and model would grow with them.

Results for odd input: a null text and one without a letter are ``und`` with
score 0 and rejected; without any labelled row everything is ``und``; a null
doc_id is predicted, not held out and not learned from; other columns pass
through ``identify``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import byte_view, cut, small_batches
from .subwords import Classifier, collect_features, fit, letter_features

BUCKETS = 1 << 16
ROWS_PER_LANGUAGE = 1000
MOST_ROWS, MOST_BYTES = 8000, 64 << 20
#: Languages that one model may have: it holds BUCKETS numbers for each.
MOST_LANGUAGES = 256
LETTER = regex.compile(r"\p{L}")
ASCII_LETTER = np.zeros(256, bool)
ASCII_LETTER[65:91] = ASCII_LETTER[97:123] = True


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of doc_id as text, modulo n."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def train(docs: DataFrame, held_out: int = 2, folds: int = 4, rows_per_language: int = ROWS_PER_LANGUAGE, most_rows: int = MOST_ROWS, most_bytes: int = MOST_BYTES) -> Classifier:
    """Fit on rows with a language and a text whose fold isn't the held-out one."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    rows = rows.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold(F.col("doc_id"), folds) != held_out))
    rows = rows.withColumn("__hash", F.xxhash64("doc_id", "text", F.lit("language")))
    hashes = rows.select("lang", "__hash", F.octet_length("text").alias("bytes")).distinct()
    counts = cut(hashes.groupBy("lang").count())  # of labels, not of rows
    n = counts.count()
    if not n:
        return fit([], BUCKETS)
    if n > MOST_LANGUAGES:
        raise ValueError(f"{n} languages are labelled, over {MOST_LANGUAGES}: merge or filter the labels first")
    each = max(1, min(rows_per_language, most_rows // n))
    # over twice as many as are wanted are ranked, so that no language's hashes all meet in one task
    ranked = hashes.join(F.broadcast(counts), "lang").filter(F.pmod("__hash", F.lit(1 << 40)) < F.lit(2 * each + 64) / F.col("count") * (1 << 40))
    order = Window.partitionBy("lang").orderBy(F.pmod("__hash", F.lit(1 << 40)), "__hash")
    upto = F.sum("bytes").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ranked = ranked.withColumns({"nth": F.row_number().over(order), "upto": upto}).filter((F.col("nth") == 1) | (F.col("nth") <= each) & (F.col("upto") <= most_bytes // n))
    drawn = cut(ranked.select("lang", "__hash"))
    sample = rows.join(F.broadcast(drawn), ["lang", "__hash"], "left_semi").dropDuplicates(["lang", "__hash"])
    return fit(collect_features(sample, lambda: letter_features(BUCKETS), "lang"), BUCKETS)


def predict(column: pa.Array, model: Classifier) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, calibrated score and rejection of each text."""
    raw, offsets = byte_view(column)
    n = len(offsets) - 1
    some = np.diff(np.concatenate(([0], np.cumsum(ASCII_LETTER[raw])))[offsets]) > 0
    for k in np.flatnonzero(~some):
        some[k] = LETTER.search(raw[offsets[k] : offsets[k + 1]].tobytes().decode("utf-8", "replace")) is not None
    if not model.classes:
        return ["und"] * n, np.zeros(n), np.ones(n, bool)
    # the share of known features is one more mean beside the classes'
    means, count = model.means(raw, offsets, letter_features(len(model.scores[0])), np.vstack((model.scores, np.ones_like(model.scores[:1]) if model.seen is None else model.seen.astype(np.float32))))
    p = model.probabilities(means[:, :-1] + model.bias)
    best = p.argmax(1)
    score = np.where(some, p[np.arange(n), best], 0.0)
    langs = [model.classes[b] if s else "und" for b, s in zip(best.tolist(), some.tolist(), strict=True)]
    return langs, score, ~some | (score < model.least) | (count > 0) & (means[:, -1] < model.least_seen)


def identify(docs: DataFrame, model: Classifier, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (all by default) with lang_pred, score and rejected; columns of these names are replaced."""
    added = {"lang_pred": "string", "score": "double", "rejected": "boolean"}
    names = [c for c in (docs.columns if keep is None else keep) if c not in added]
    rows = docs.select(*names, F.col("text").cast("string").alias("__text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "__text", 1 << 20):
            langs, score, rejected = predict(batch.column("__text"), shared.value)
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(langs, pa.string()), pa.array(score), pa.array(rejected)], names=[*names, *added])

    schema = rows.drop("__text").schema
    for name, kind in added.items():
        schema = schema.add(name, kind)
    return rows.mapInArrow(run, schema)
