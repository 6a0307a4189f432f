"""A corpus pipeline: five stages, each a table of documents that the next one reads.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it
as Parquet in the shared folder and rereads it for the next stage.

Results for odd input: null and empty texts have no language and go in the
first stage; rows of a null or repeated doc_id are judged by row; of equal rows
one stays; other columns pass through all stages but the last with their values,
whatever their names; an empty table stays empty. The last stage has doc_id,
token_ids and n_tokens alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fernweave.llm import bpe, decontaminate, langid, line_dedup, near_sets
from fernweave.llm.common import beside, cut

#: SQL has neither the trained classifier nor BPE; tests/llm/test_pipeline.py holds the stages and their chain against plain loops.
ORACLE_SQL = None
#: Words of a shingle, and bits of 64 in which SimHash candidates may differ; all are verified, as are those by min-hashes.
SHINGLE_WORDS = 5
MOST_BITS = 3


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the classifier is sure of."""
    return beside(docs, ("doc_id", "text", "lang"), lambda rows: langid.identify(rows, langid.train(rows)).filter("not rejected"))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that stand earlier; one that loses all its words goes."""
    some_left = (F.col("n_removed") == 0) | F.col("text").rlike("[^\\x20\\x09-\\x0D]")
    return beside(docs, ("doc_id", "text", "n_chars"), lambda rows: line_dedup.dedup_lines(rows).filter(some_left))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates (Jaccard similarity of 0.8 and more): that with the smallest doc_id."""
    return near_sets.one_of_each(docs, SHINGLE_WORDS, MOST_BITS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the benchmark's passages cut out."""
    return decontaminate.scrub(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def bpe_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, token_ids and their number."""
    return bpe.encode(docs).withColumn("n_tokens", F.size("token_ids").cast("long"))


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup_stage),
    ("simhash_near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("bpe", bpe_tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir))
    return docs
