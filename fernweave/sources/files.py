"""Files below a root as an inventory, with Spark's binary file source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import filters


def inventory(spark: SparkSession, root: str, globs: list[str] | None = None, since: str | None = None, content: bool = False) -> DataFrame:
    """path, filename, extension, size and mtime (epoch seconds) of all files below the root that no glob excludes.

    ``since`` (a timestamp, UTC in a UTC session) leaves out older files while
    the folder is listed. Without ``content`` no file is read. The source doesn't
    list empty files, nor hidden ones (names that begin with a dot or underscore).
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if since:
        reader = reader.option("modifiedAfter", since)
    files = reader.load(root)
    path = F.regexp_replace("path", "^file:/+", "/")
    name = F.element_at(F.split(path, "/"), -1)
    mtime = F.unix_micros("modificationTime") / 1e6
    columns = [path.alias("path"), name.alias("filename"), T.file_extension(name).alias("extension"), F.col("length").alias("size"), mtime.alias("mtime")]
    found = files.select(*columns, *(["content"] if content else []))
    return found.filter(~filters.excluded(F.col("path"), globs)) if globs else found


def covers(docs: DataFrame, root: str) -> bool:
    """Whether the inventory holds the root or anything below it."""
    return not docs.filter(filters.under(F.col("path"), root)).isEmpty()
