"""Files of a folder by the file system that Spark itself reads with: listing, removal."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    """The path and its file system. Both are the driver's, so a plain session is needed, not a remote one."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def children(spark: SparkSession, path: str) -> list[tuple[str, int, int]]:
    """(path, bytes, time of change) of what a folder holds, or of the file itself; nothing where there is nothing."""
    place, system = _at(spark, path)
    if not system.exists(place):
        return []
    return sorted((x.getPath().toString(), x.getLen(), x.getModificationTime()) for x in system.listStatus(place))


def remove(spark: SparkSession, path: str) -> bool:
    """Take a folder away with all that is in it."""
    place, system = _at(spark, path)
    return system.delete(place, True)
