"""Operator 7: quality classifier with supervised subword embeddings.

Hashed word and character n-gram vectors are learned, averaged per document and
given to a softmax, all by numpy stochastic gradient descent on a bounded
sample of labelled rows: at most MOST_ROWS, by a hash of doc_id, of which those
are learned from, in that order, whose texts together have MOST_BYTES at most
(whole texts; the first always).

Results for odd input: null and empty texts get the score of a text without
features; any label over 0 counts as 1; repeated labels of one doc_id count as
their largest, and of its texts the smallest is learned from; without any label
every score is 0.5; with one class alone its label decides; a null doc_id is
scored and not learned from; other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import byte_view, cut, id_text_columns, small_batches
from .langid import fold
from .subwords import Classifier, collect_features, fit, text_features

BUCKETS = 1 << 17
MOST_ROWS, MOST_BYTES = 3000, 64 << 20


def train(docs: DataFrame, labels: DataFrame, held_out: int = 1, folds: int = 3, most_rows: int = MOST_ROWS, most_bytes: int = MOST_BYTES) -> Classifier:
    """Fit on labelled rows whose fold isn't the held-out one."""
    known = labels.filter(F.col("quality").isNotNull() & (fold(F.col("doc_id"), folds) != held_out))
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.col("quality") > 0).cast("int")).alias("quality"))
    drawn = known.orderBy(F.xxhash64("doc_id", F.lit("quality")), "doc_id").limit(most_rows)
    # at most MOST_ROWS pairs of integers
    rows = id_text_columns(docs).filter("text is not null").join(F.broadcast(drawn), "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text"))
    order = Window.orderBy(F.xxhash64("doc_id", F.lit("quality")), "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sizes = cut(rows.select("doc_id", F.octet_length("text").alias("bytes")))
    fits = sizes.select("doc_id", F.sum("bytes").over(order).alias("upto"), "bytes").filter((F.col("upto") <= most_bytes) | (F.col("upto") == F.col("bytes"))).select("doc_id")
    return fit(collect_features(rows.join(F.broadcast(fits), "doc_id"), lambda: text_features(BUCKETS), "quality"), BUCKETS, epochs=10)


def score(docs: DataFrame, model: Classifier) -> DataFrame:
    """doc_id and score (0 to 1) of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text", 1 << 20):
            model = shared.value
            raw, offsets = byte_view(batch.column("text"))
            n = len(offsets) - 1
            p = np.full(n, 0.5)
            if model.classes == [0, 1]:
                p = model.probabilities(model.logits(raw, offsets, text_features(len(model.scores[0]))))[:, 1]
            elif model.classes:
                p = np.full(n, float(model.classes[0]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(p)], ["doc_id", "score"])

    return id_text_columns(docs).mapInArrow(run, "doc_id long, score double")
