"""Live view and live tail on top of a row stream."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from logspark.operators.entries import tail_json
from logspark.operators.sessions import session_view
from logspark.sources.lake import read_lake

REFRESH_INTERVAL = "3 seconds"
WINDOW = dt.timedelta(hours=1)


def live_view(
    ticks: DataFrame,
    root: str,
    members: DataFrame,
    session: str,
    show: Callable[[DataFrame], None],
    checkpoint: str,
    view: str = "all",
    now: Callable[[], dt.datetime] = lambda: dt.datetime.now(dt.timezone.utc),
    interval: str | None = REFRESH_INTERVAL,
) -> StreamingQuery:
    """Recompute a session's list from the lake's last hour at every tick.

    ``ticks`` is any stream, usually the ingested rows themselves; the list is
    at most 100 rows, so ``show`` may collect it.
    """

    def refresh(batch: DataFrame, batch_id: int) -> None:
        at = now()
        lake = read_lake(batch.sparkSession, root, at - WINDOW, at)
        show(session_view(lake, members, session, at, view, window=WINDOW))

    writer = ticks.writeStream.foreachBatch(refresh).option("checkpointLocation", checkpoint)
    if interval is None:
        return writer.trigger(availableNow=True).start()
    return writer.trigger(processingTime=interval).start()


def tail_stream(
    rows: DataFrame, path: str, checkpoint: str, interval: str | None = REFRESH_INTERVAL
) -> StreamingQuery:
    """Every row as one JSON line under ``path``."""
    writer = (
        tail_json(rows)
        .writeStream.format("text")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
    )
    if interval is None:
        return writer.trigger(availableNow=True).start()
    return writer.trigger(processingTime=interval).start()
