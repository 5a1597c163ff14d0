"""Retries of model calls as keyed stream state with timers.

Events are (task_id, attempt, outcome, at): an attempt was `asked`, answered with `success`, or ended in `error`.  An
attempt that is asked and stays silent past a timeout has failed, like one that ends in error; timers on event
time see to that.  A task with a success is Success; one with MAX_ATTEMPTS failed attempts is Failed; one whose
attempts so far have all failed is Retry, with the number of them; one that was asked and may yet be answered is Waiting.

The state of a task follows from the set of its events: order does not count, a repeated event changes nothing, and an
answer after the timeout still counts.  Each change of a task is a row, numbered by `change`; the log keeps them by
micro-batch, and readers take the last.  State goes when a task has had no event for `keep`; events older than
the watermark are dropped by Spark.  Rows with a null task, attempt or time, or another outcome, are left out.
"""

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from codewarden.operators.tables import latest_per_key
from codewarden.sources.store import read_table, write_partitions

MAX_ATTEMPTS, TIMEOUT_MS, KEEP_MS = 3, 600_000, 86_400_000
RANKS = {"asked": 0, "silent": 1, "error": 2, "success": 3}
COLUMNS = "task_id long, status string, failed int, change int"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Attempts(StatefulProcessor):
    """State of a task: what became of each attempt, what was last said of it, and when it was last heard of.

    All of it is one value: each call to the state store is a message to the JVM, and a task has few attempts.
    """

    def __init__(self, max_attempts: int, timeout: int, keep: int):
        self.max_attempts, self.timeout, self.keep = max_attempts, timeout, max(keep, 2 * timeout)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.task = handle.getValueState("task", "attempts array<int>, ranks array<int>, asked array<long>, status string, failed int, change int, heard long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        before = self.task.get()
        numbers, ranks, times, *said, heard = before or ([], [], [], None, 0, 0, -1)
        attempts, timers, last = dict(zip(numbers, zip(ranks, times))), set(), heard
        for row in rows:
            heard = max(heard, row.millis)
            known = attempts.get(row.attempt, (-1, 0))
            rank = RANKS[row.outcome]
            if rank > known[0] or rank == 0 == known[0] and row.millis > known[1]:
                attempts[row.attempt] = (rank, row.millis)
                if rank == 0:
                    timers.add(row.millis + self.timeout)
        if heard > last:
            timers.add(heard + self.keep)
        for timer in sorted(timers):
            self.handle.registerTimer(timer)
        yield from self._tell(key, attempts, said, heard, before)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        before = self.task.get()
        if before is None:
            return
        now = expiredTimerInfo.getExpiryTimeInMs()
        numbers, ranks, times, *said, heard = before
        if heard + self.keep <= now:
            self.task.clear()
            return
        attempts = {attempt: (RANKS["silent"] if rank == 0 and asked + self.timeout <= now else rank, asked)
                    for attempt, rank, asked in zip(numbers, ranks, times)}
        yield from self._tell(key, attempts, said, heard, before)

    def _tell(self, key, attempts, said, heard, before) -> Iterator[Row]:
        status, failed, change = said
        ranks = [rank for rank, _ in attempts.values()]
        lost = sum(rank in (RANKS["silent"], RANKS["error"]) for rank in ranks)
        if RANKS["success"] in ranks:
            now = "Success"
        elif lost >= self.max_attempts:
            now = "Failed"
        else:
            now = "Waiting" if RANKS["asked"] in ranks else "Retry"
        if (now, lost) != (status, failed):
            status, failed, change = now, lost, change + 1
            yield Row(task_id=key[0], status=now, failed=lost, change=change)
        after = (list(attempts), ranks, [asked for _, asked in attempts.values()], status, failed, change, heard)
        if before is None or after != tuple(before):
            self.task.update(after)

    def close(self) -> None:
        pass


def follow_attempts(events: DataFrame, delay: str = "1 hour", max_attempts: int = MAX_ATTEMPTS, timeout_ms: int = TIMEOUT_MS,
                    keep_ms: int = KEEP_MS) -> DataFrame:
    """The changes of each task, as a stream; `delay` is how late an event may be."""
    known = events.withColumn("at", F.col("at").cast("timestamp")).where(
        F.col("outcome").isin("asked", "error", "success") & F.col("at").isNotNull())
    rows = known.select(F.col("task_id").cast("long").alias("task_id"), F.col("attempt").cast("int").alias("attempt"), "outcome", "at",
                        F.unix_millis("at").alias("millis")).dropna(subset=["task_id", "attempt"])
    return rows.withWatermark("at", delay).groupBy("task_id").transformWithState(
        Attempts(max_attempts, timeout_ms, keep_ms), COLUMNS, "Update", "EventTime")


def start_attempts(events: DataFrame, log: str, checkpoint: str, drain: bool = False, interval: str = "3 seconds",
                   **settings) -> StreamingQuery:
    """Write the changes to a log, one partition for a micro-batch, so that a batch that comes again replaces its own."""

    def sink(batch: DataFrame, batch_id: int) -> None:
        write_partitions(batch.withColumn("batch_id", F.lit(batch_id)), log, "batch_id")

    spark, name = events.sparkSession, "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, ROCKS)  # timers need it; a query keeps the settings it was started with
    try:
        writer = follow_attempts(events, **settings).writeStream.outputMode("update").foreachBatch(sink).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if drain else writer.trigger(processingTime=interval)).start()
    finally:
        spark.conf.set(name, before)


def task_states(spark: SparkSession, log: str) -> DataFrame:
    """(task_id, status, failed): the last change of each task."""
    rows = read_table(spark, log, f"{COLUMNS}, batch_id int").withColumn("_at", F.struct("batch_id", "change"))
    return latest_per_key(rows, "task_id", "_at").select("task_id", "status", "failed")
