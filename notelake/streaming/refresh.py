"""Incremental refresh as a stream: a trigger re-scans the folder, the snapshot diff finds what changed.

Spark's file source shows neither edits nor deletions, so the stream only ticks; state lives in the
snapshot store. A batch that runs twice finds nothing left to do.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.vault import Vault
from ..sources.vault import git_head


def watch(vault: Vault, checkpoint: str, every: str = "2 seconds", once: bool = False, done: Callable[[dict[str, int]], None] | None = None) -> StreamingQuery:
    """Refresh the vault on every tick; with ``once`` absorb what is there and stop."""
    ticks = vault.spark.readStream.format("rate-micro-batch").option("rowsPerBatch", 1).load()

    def refresh(batch: DataFrame, batch_id: int) -> None:
        counts = vault.reindex()
        if done:
            done(counts)

    writer = ticks.writeStream.foreachBatch(refresh).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()


def reconcile_head(vault: Vault, recorded: str | None) -> str | None:
    """Refresh if the repository's head isn't the recorded one; returns what to record, which advances only on success."""
    head = git_head(vault.root)
    if head != recorded:
        vault.reindex()
    return head


def event_windows(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums per window and type of an event stream (ts, event_type, value), with a watermark for late rows."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def publish_tokens(vault: Vault, candidates: DataFrame) -> DataFrame:
    """Vectors of a late writer: those whose expected token still holds are published, the others come back as conflicts."""
    return vault.store.replace_vectors(candidates)[1]
