"""Session settings the library relies on."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator, Mapping
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def prepare(spark: SparkSession) -> SparkSession:
    """Put the session on UTC: times without a zone are UTC times."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def require_utc(spark: SparkSession) -> None:
    """Raise unless the session is on UTC, where times without a zone are read."""
    zone = spark.conf.get("spark.sql.session.timeZone")
    if zone not in ("UTC", "Etc/UTC", "Z", "GMT", "+00:00"):
        raise ValueError(f"the session's time zone is {zone}; call prepare(spark) first")


@contextmanager
def session_conf(spark: SparkSession, settings: Mapping[str, str]) -> Iterator[None]:
    """Apply SQL settings for one action and put the old ones back."""
    before = {key: spark.conf.get(key, None) for key in settings}
    try:
        for key, value in settings.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the checkpoint folder named by the session.

    Results and intermediate tables go there, so it must be a folder that driver
    and executors share; without one this raises.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None and context._jsc.sc().getCheckpointDir().isDefined():
        return context._jsc.sc().getCheckpointDir().get()
    if folder is None:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(folder)
    return folder


def own_checkpoint_dir(spark: SparkSession) -> None:
    """For tests and trials in local mode: name a fresh folder if the session names none.

    Elsewhere a folder of one machine would be of no use, and nothing is named.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    local = context.master == "local" or context.master.startswith("local[")
    if named is None and local and not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(tempfile.mkdtemp(prefix="logspark-checkpoint-"))


def cut_lineage(frame: DataFrame) -> DataFrame:
    """Materialise a frame in the shared checkpoint folder."""
    ensure_checkpoint_dir(frame.sparkSession)
    return frame.checkpoint()
