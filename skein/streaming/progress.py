"""Progress of a stream as rows: a listener that writes one for each batch, and one for its end."""

from __future__ import annotations

import json
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.listener import QueryIdleEvent, QueryProgressEvent, QueryStartedEvent, QueryTerminatedEvent, StreamingQueryListener

ROW = "run string, kind string, batch long, at string, completed long, total long, duration_ms long, message string"


class ProgressRows(StreamingQueryListener):
    """Appends a row (run, kind, batch, at, completed, ...) to a table at each batch. completed: rows so far; total: given, or null.

    Events come one after another, so the count needs no lock; a listener that cannot write does not stop the stream.
    """

    def __init__(self, spark: SparkSession, table: str, total: int | None = None) -> None:
        self.spark, self.table, self.total, self.done = spark, table, total, {}
        spark.createDataFrame([], ROW).write.mode("append").parquet(table)

    def told(self, run: str, kind: str, batch: int | None, at: str | None, ms: int | None, message: str | None = None) -> None:
        row = (run, kind, batch, at, self.done.get(run, 0), self.total, ms, message)
        self.spark.createDataFrame([row], ROW).coalesce(1).write.mode("append").option("compression", "none").parquet(self.table)

    def onQueryStarted(self, event: QueryStartedEvent) -> None:
        self.told(str(event.runId), "started", None, event.timestamp, None)

    def onQueryProgress(self, event: QueryProgressEvent) -> None:
        p = event.progress
        run = str(p.runId)
        self.done[run] = self.done.get(run, 0) + int(p.numInputRows)
        self.told(run, "batch", p.batchId, p.timestamp, int(p.batchDuration), json.dumps({k: v for k, v in p.durationMs.items()}, sort_keys=True))

    def onQueryIdle(self, event: QueryIdleEvent) -> None:
        pass

    def onQueryTerminated(self, event: QueryTerminatedEvent) -> None:
        self.told(str(event.runId), "failed" if event.exception else "ended", None, None, None, event.exception)


def listen(spark: SparkSession, folder: str, total: int | None = None) -> ProgressRows:
    """Starts to gather progress rows in a new table below ``folder``; ``rows`` reads them, ``spark.streams.removeListener`` ends it."""
    out = ProgressRows(spark, f"{folder.rstrip('/')}/progress-{uuid4()}", total)
    spark.streams.addListener(out)
    return out


def rows(listener: ProgressRows) -> DataFrame:
    return listener.spark.read.schema(ROW).parquet(listener.table)
