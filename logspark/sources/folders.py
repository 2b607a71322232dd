"""Folders of a lake: who owns them, and one run at a time."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

from logspark.sources.files import file_system, path_of

def refuse_sink(spark: SparkSession, root: str, task: str) -> None:
    """Raise for the folder of a file sink: its own log names the files it has."""
    if path_of(spark, f"{root}/_spark_metadata", exists=True):
        raise ValueError(f"a file sink owns this folder; {task} a lake of write_stream instead")


@contextmanager
def only_run(spark: SparkSession, marker: str, takeover: bool) -> Iterator[None]:
    """Hold a marker file for one run; a second run raises, unless it takes over a dead one's."""
    files = file_system(spark, marker)
    path = path_of(spark, marker)
    if takeover:
        files.delete(path, False)
    try:
        files.create(path, False).close()
    except Exception as error:
        raise RuntimeError(f"another run holds {marker}; take over if it is dead") from error
    try:
        yield
    finally:
        files.delete(path, False)
