"""Tables as a document store sees them."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EXTENSIONS = [".md", ".txt", ".py", ".json", ".csv"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as files, see ``as_files``."""
    return as_files(table(spark, sf_dir, "documents"))


def as_files(docs: DataFrame) -> DataFrame:
    """The documents with root, path, filename, extension, size and mtime, all made from the row itself."""
    ext = F.element_at(F.array(*(F.lit(e) for e in EXTENSIONS)), (F.pmod("doc_id", F.lit(len(EXTENSIONS))) + 1).cast("int"))
    docs = docs.withColumns({"extension": ext, "root": F.concat(F.lit("/corpus/"), "source"), "size": F.col("n_chars"), "mtime": F.lit(1.7e9) + F.col("doc_id")})
    docs = docs.withColumn("filename", F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), "extension"))
    return docs.withColumn("path", F.concat_ws("/", "root", "lang", "filename"))


_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a local one, the same for a session, only where none is named and the master is local."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _LOCAL.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="fernweave-"))
