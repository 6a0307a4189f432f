"""Indexes of the given tables in the shared folder: built when first asked for, brought up to date when the files have changed."""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import stem
from ..operators import chunking, index, pivots, substring
from ..sources import folders
from ..sources.corpus import corpus, shared_dir, table

#: Change with what a kind of index makes of its documents.
RULES = {"documents": "1", "stems": "1", "lines": "1", "chunks": chunking.identity().replace(":", "_")}


def _version(spark: SparkSession, sf_dir: str) -> str:
    """A name for the documents' files as they are now: their paths, sizes and times."""
    files = [folders.children(spark, f"{sf_dir}/{name}.parquet") for name in ("documents", "embeddings")]
    return hashlib.sha256(repr(files).encode()).hexdigest()[:32]


def _of(spark: SparkSession, sf_dir: str, kind: str, docs, **how) -> index.Index:
    target = f"{shared_dir(spark).rstrip('/')}/index-{kind}-{RULES[kind]}-{hashlib.sha256(sf_dir.encode()).hexdigest()[:16]}"
    version = _version(spark, sf_dir)
    found = index.load(spark, target)
    return found if found is not None and found.version == version else index.sync(docs(), target, version, **how)


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hashed(corpus(spark, sf_dir))


def hashed(docs: DataFrame) -> DataFrame:
    return docs.withColumn("content_hash", F.md5(F.col("text").cast("binary")))


def vectors_of(spark: SparkSession, sf_dir: str):
    """The side table of documents' vectors: those whose vec_id is the doc_id; none where the folder has no vectors."""
    if not folders.children(spark, f"{sf_dir}/embeddings.parquet"):
        return lambda docs: docs.select("doc_id").limit(0)
    vecs = table(spark, sf_dir, "embeddings").withColumn("doc_id", F.col("vec_id"))
    return lambda docs: vecs.join(docs.select("doc_id").distinct(), "doc_id", "left_semi")


def document_sides(spark: SparkSession, sf_dir: str) -> dict:
    """What is kept beside documents: their vectors, and the pieces of their paths."""
    return {"vectors": vectors_of(spark, sf_dir), "path_pieces": lambda docs: substring.pieces(docs.select("doc_id", F.col("path").alias("value")))}


def document_index(spark: SparkSession, sf_dir: str) -> index.Index:
    """Whole documents, with the corpus's columns, and their vectors and pieces of paths beside them."""
    return _of(spark, sf_dir, "documents", lambda: _documents(spark, sf_dir), sides=document_sides(spark, sf_dir))


def stemmed_index(spark: SparkSession, sf_dir: str) -> index.Index:
    """Whole documents by folded and stemmed words."""
    return _of(spark, sf_dir, "stems", lambda: _documents(spark, sf_dir), words=stem.index_words)


def _lines(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("ordinal", "text"))


def line_index(spark: SparkSession, sf_dir: str) -> index.Index:
    """Lines of the documents, each a unit."""
    return _of(spark, sf_dir, "lines", lambda: table(spark, sf_dir, "documents").select("doc_id", "text"), split=_lines)


def chunk_index(spark: SparkSession, sf_dir: str) -> index.Index:
    """Chunks of the documents; their units keep where a chunk stands, and their texts are in ``texts``."""
    return _of(spark, sf_dir, "chunks", lambda: corpus(spark, sf_dir).select("doc_id", "text", "extension"), split=chunking.chunked, keep_texts=True)


def scratch_fork(spark: SparkSession, held: index.Index) -> index.Index:
    """A fork of an index at a new place in the shared folder."""
    return index.fork(held, f"{shared_dir(spark).rstrip('/')}/fork-{uuid.uuid4().hex}")


def kept(rows: DataFrame) -> DataFrame:
    """The rows as a table in the shared folder, for what is read more than once: it is made once, and its shuffles can go."""
    place = f"{shared_dir(rows.sparkSession).rstrip('/')}/kept-{uuid.uuid4().hex}"
    rows.write.option("compression", "zstd").parquet(place)
    return rows.sparkSession.read.schema(rows.schema).parquet(place)


def vector_index(spark: SparkSession, sf_dir: str) -> pivots.Pivots:
    """The embeddings around pivots. Of two jobs that build it at once, both find what they need, as each writes a folder of its own first."""
    root = f"{shared_dir(spark).rstrip('/')}/vectors-1-{_version(spark, sf_dir)}"
    for place, _, _ in folders.children(spark, root):
        if (found := pivots.load(spark, place)) is not None:
            return found
    place = f"{root}/{uuid.uuid4().hex}"
    pivots.build(table(spark, sf_dir, "embeddings"), place)
    return pivots.load(spark, place)
