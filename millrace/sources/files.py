"""Names below a folder, on whatever file system its path names."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _folder(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def names(spark: SparkSession, path: str) -> list[str]:
    """Names directly below ``path``; none if it is not there."""
    system, place = _folder(spark, path)
    return sorted(s.getPath().getName() for s in system.listStatus(place)) if system.exists(place) else []


def numbers(spark: SparkSession, path: str, key: str) -> list[int]:
    """Numbers of the partition folders ``key=<number>`` directly below ``path``."""
    return sorted(int(n.partition("=")[2]) for n in names(spark, path) if n.startswith(f"{key}="))


def remove(spark: SparkSession, path: str) -> None:
    system, place = _folder(spark, path)
    system.delete(place, True)
