"""Where counts and results of runs go to, and how complete ones are told from broken ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def write_stats(stats: DataFrame, path: str) -> None:
    """Add the counts of a run to a folder of JSON lines; Spark's committer shows a run whole or not at all."""
    stats.write.mode("append").json(path)


def hadoop_path(spark: SparkSession, path: str):
    """(file system, path) as Hadoop knows them."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def complete(spark: SparkSession, pattern: str) -> list[str]:
    """The folders of a pattern that Spark's committer has marked as written whole."""
    fs, at = hadoop_path(spark, f"{pattern}/_SUCCESS")
    return sorted(f.getPath().getParent().toString() for f in fs.globStatus(at) or [])


def remove(spark: SparkSession, paths: list[str]) -> None:
    for p in paths:
        fs, at = hadoop_path(spark, p)
        fs.delete(at, True)
