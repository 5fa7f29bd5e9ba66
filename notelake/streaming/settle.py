"""Changes of files once they have been quiet for a while, as keyed state with timers.

Observations (path, mtime, size, seen_at) come in any number and from anywhere: a sweep that compares
times, a notification log, a retry. State is kept by path: what was last passed on, and the burst
of observations that is going on. A burst ends when its path has been quiet for a while; then one
row goes on, whatever the number of observations, and a restart from the checkpoint goes on with the
timers that were set.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..plans.vault import Vault
from ..sources import vault as source

OBSERVED = "path string, mtime double, size long, seen_at timestamp"
SETTLED = "path string, change string, mtime double, size long, observations long, first_at timestamp, last_at timestamp"
#: What the processor gives; times are milliseconds, which no session's time zone shifts.
_PASSED = "path string, change string, mtime double, size long, observations long, first_ms long, last_ms long"
#: The state store that keyed state with timers needs.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Settle(StatefulProcessor):
    """Passes a path's burst on once it is over; ``quiet`` in milliseconds."""

    def __init__(self, quiet: int, event_time: bool) -> None:
        self.quiet, self.event_time = quiet, event_time

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.burst = handle.getValueState("burst", "mtime double, size long, observations long, first_ms long, last_ms long, timer_ms long")
        self.passed = handle.getValueState("passed", "mtime double, size long")

    @staticmethod
    def _over(path: str, burst: tuple, before: tuple | None) -> Row:
        """The row of a burst that is over, after the state ``before`` that was passed on last."""
        mtime, size, n, first, last, _ = burst
        change = "deleted" if size is None else "added" if before is None else "same" if before == (mtime, size) else "modified"
        return Row(path=path, change=change, mtime=mtime, size=size, observations=n, first_ms=first, last_ms=last)

    def _last(self) -> tuple | None:
        before = self.passed.get()
        return tuple(before) if before else None

    def _pass(self, burst: tuple) -> None:
        """Remember the state of a burst as passed on."""
        if burst[1] is None:
            self.passed.clear()
        else:
            self.passed.update(burst[:2])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        """Asks for a key's state once and writes it once, as each call goes to the JVM and back; between, bursts are local."""
        seen = sorted(rows, key=lambda r: (r.seen_ms, r.seen_at))
        now = None if self.event_time else timerValues.getCurrentProcessingTimeInMs()
        burst = tuple(found) if (found := self.burst.get()) else None
        timer = burst[5] if burst else None
        ended = None
        for row in seen:
            ms = row.seen_ms if now is None else now
            state = (None if row.mtime is None or row.mtime != row.mtime else row.mtime, row.size)
            if burst and ms - burst[4] > self.quiet:
                before = (None if ended[1] is None else ended[:2]) if ended else self._last()
                yield self._over(key[0], burst, before)
                ended, burst = burst, None
            if burst is None:
                burst = (*state, 1, ms, ms, 0)
            else:  # an observation that comes late tells nothing of the present state
                newest = state if ms >= burst[4] else burst[:2]
                burst = (*newest, burst[2] + 1, min(burst[3], ms), max(burst[4], ms), 0)
        if ended:
            self._pass(ended)
        due = burst[4] + self.quiet
        if timer != due:
            if timer is not None:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(due)
        self.burst.update((*burst[:5], due))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        found = self.burst.get()
        if found:
            burst = tuple(found)
            self.burst.clear()
            yield self._over(key[0], burst, self._last())
            self._pass(burst)

    def close(self) -> None:
        pass


@contextmanager
def _keyed_state(spark: SparkSession) -> Iterator[None]:
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, STORE)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def settled(observations: DataFrame, quiet_ms: int = 2000, late: str | None = None) -> DataFrame:
    """Rows (path, change, mtime, size, observations, first_at, last_at), one a burst, of a stream of observations.

    A missing size says that the file is gone. ``change`` compares with what was passed on before: added,
    modified, deleted, or same. With ``late`` bursts go by ``seen_at``, with a watermark that far
    behind; without, by the time of arrival. Start the stream with ``start``.
    """
    own = observations.select("path", "mtime", "size", "seen_at", F.unix_millis("seen_at").alias("seen_ms"))
    if late is not None:
        own = own.withWatermark("seen_at", late)
    processor = Settle(quiet_ms, late is not None)
    passed = own.groupBy("path").transformWithState(processor, _PASSED, "Append", "EventTime" if late is not None else "ProcessingTime")
    return passed.select("path", "change", "mtime", "size", "observations", *(F.timestamp_millis(f"{k}_ms").alias(f"{k}_at") for k in ("first", "last")))


def start(stream: DataFrame, checkpoint: str, into: str | Callable[[DataFrame, int], None], every: str | None = None) -> StreamingQuery:
    """Run a settled stream into a Parquet folder or a function; all that is there and stop, or a batch ``every`` so often."""
    with _keyed_state(stream.sparkSession):
        writer = stream.writeStream.option("checkpointLocation", checkpoint)
        writer = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
        return writer.foreachBatch(into).start() if callable(into) else writer.format("parquet").option("path", into).start()


def sweep(vault: Vault, feed: str) -> int:
    """Append to a feed (a Parquet folder of observations) the notes whose time or size isn't the stored one, and those missing; their number.

    Executors list the folder and compare; nothing is read.
    """
    with vault.store.job() as keep:
        files = source.listing(vault.spark, vault.root, ".md", vault.options.excludes, keep)
        stored = vault.documents.select("path", "modified_at", F.col("size").alias("_size"))
        both = files.join(stored, "path", "full_outer").filter(~(F.col("mtime").eqNullSafe(F.col("modified_at")) & F.col("size").eqNullSafe(F.col("_size"))))
        found = keep(both.select("path", "mtime", "size", F.current_timestamp().alias("seen_at")))
        found.write.mode("append").parquet(feed)
        return found.count()


def apply_settled(vault: Vault, retries: str) -> Callable[[DataFrame, int], None]:
    """A sink that takes settled changes into the index, and asks again for those it couldn't.

    Each path is probed first: present ones are read, absent ones leave the index, and for
    those that can't be told now (a mount that is away) and all of a refresh that failed an
    observation is appended to the feed ``retries``, so that they settle again.
    """

    def take(batch: DataFrame, batch_id: int) -> None:
        with vault.store.job() as keep:
            asked = keep(source.probed(batch.filter("change <> 'same'").select("path").distinct(), vault.root))
            known, away = asked.filter("status <> 'unavailable'"), asked.filter("status = 'unavailable'")
            again = lambda df: df.select("path", F.lit(None).cast("double").alias("mtime"), F.lit(None).cast("long").alias("size"), F.current_timestamp().alias("seen_at")).write.mode("append").parquet(retries)
            if not away.isEmpty():
                again(away)
            if known.isEmpty():
                return
            try:
                vault.reindex(known.select("path"))
            except Exception:  # told by the vault's status; the changes aren't lost
                again(known)

    return take


def watch_settled(vault: Vault, feed: str, checkpoint: str, quiet_ms: int = 2000, every: str | None = None) -> StreamingQuery:
    """Refresh the vault from a feed of observations, one refresh for each burst of changes; failed paths come again."""
    spark, retries = vault.spark, f"{checkpoint}/retries"
    nothing = spark.createDataFrame([], OBSERVED)
    for folder in (feed, retries):  # a stream needs its folder to be there
        nothing.write.mode("append").parquet(folder)
    read = lambda folder: spark.readStream.schema(OBSERVED).parquet(folder)
    return start(settled(read(feed).unionByName(read(retries)), quiet_ms), f"{checkpoint}/state", apply_settled(vault, retries), every)
