"""The few file operations that tables do not offer, on whatever store a path names."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    system, where = _at(spark, path)
    return system.exists(where)


def names(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder, none if it is not there."""
    system, where = _at(spark, folder)
    if not system.exists(where):
        return []
    return sorted(s.getPath().getName() for s in system.listStatus(where))


def put_new(spark: SparkSession, path: str, text: str) -> bool:
    """Create the file unless there is one; whether this call created it."""
    system, where = _at(spark, path)
    try:
        out = system.create(where, False)
    except Py4JJavaError as error:
        if "AlreadyExists" in error.java_exception.getClass().getName():
            return False
        raise
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    return True


def remove(spark: SparkSession, path: str) -> None:
    system, where = _at(spark, path)
    system.delete(where, True)
