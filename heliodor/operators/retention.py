"""Raw archives and resets: housekeeping over file metadata, on whatever file system the folder is."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def listing(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(path, length) of a folder's files, from metadata only."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path", "length")


def usage(files: DataFrame) -> DataFrame:
    return files.agg(F.count("*").alias("files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))


def _at(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def prune(spark: SparkSession, folder: str, dry_run: bool = False) -> dict[str, int]:
    """Delete the files of a folder, not its folders; the number and bytes of what went, or would go. A missing folder has none."""
    path, system = _at(spark, folder)
    files = size = 0
    found = system.listStatusIterator(path) if system.exists(path) else None
    while found is not None and found.hasNext():
        one = found.next()
        if one.isFile():
            files, size = files + 1, size + one.getLen()
            if not dry_run:
                system.delete(one.getPath(), False)
    return {"files": files, "bytes": size}


def reset(spark: SparkSession, folder: str, confirmed: bool) -> bool:
    """Delete a folder of tables and all that is in it, if that is confirmed; whether it was. A missing folder is no error."""
    path, system = _at(spark, folder)
    if confirmed and system.exists(path):
        system.delete(path, True)
    return confirmed
