"""Calls to the file system that holds a lake."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from itertools import islice

from pyspark.sql import SparkSession

# Calls to the file system at a time, and paths held for them.
PARALLEL_CALLS = 32
_CHUNK = 4_096


def in_parallel(call: Callable[[str], object], paths: Iterable[str]) -> int:
    """Apply a file system call to every path, many at a time; returns how many there were."""
    count = 0
    rest = iter(paths)
    with ThreadPoolExecutor(PARALLEL_CALLS) as pool:
        while chunk := list(islice(rest, _CHUNK)):
            for _ in pool.map(call, chunk):
                count += 1
    return count


def path_exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return file_system(spark, path).exists(target)


def file_system(spark: SparkSession, path: str):
    """The Hadoop file system that holds ``path``."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def path_of(spark: SparkSession, path: str, exists: bool = False):
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return file_system(spark, path).exists(found) if exists else found
