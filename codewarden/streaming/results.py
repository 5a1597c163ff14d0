"""Streaming ingestion of results, and streaming progress.

A micro-batch becomes one partition of an append-only log, keyed by batch id: writing a batch twice
replaces it, so a restart from the checkpoint leaves no duplicates.  Readers take the latest row per
key; `fold_log` brings the log into the keyed tables.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from codewarden.operators.tables import latest_per_key, progress, write_results
from codewarden.sources.store import read_table, write_partitions


def result_stream(spark: SparkSession, folder: str, schema: str, files_per_trigger: int = 200) -> DataFrame:
    """JSON files dropped into a folder; the limit per trigger is the back-pressure."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).json(folder)


def remove_folder(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def write_batch(log: str, dead_letters: str):
    """Sink function in two phases: the batch is evaluated once, into a staged table, and both targets are fed from that.

    If staging fails, the query stops and the same batch comes again: nothing is lost or half written.  If the log
    can't be written, the staged successful rows become JSON dead letters.  A batch that comes again replaces its
    partition of the log and, if the log takes it now, its dead letters go: each row is kept once.
    """

    def sink(batch: DataFrame, batch_id: int) -> None:
        spark, staged, letters = batch.sparkSession, f"{log}.staged/batch_id={batch_id}", f"{dead_letters}/batch_id={batch_id}"
        batch.write.mode("overwrite").parquet(staged)
        rows = spark.read.schema(batch.schema).parquet(staged).withColumn("batch_id", F.lit(batch_id))
        try:
            write_partitions(rows, log, "batch_id")
        except Exception:  # noqa: BLE001 - any failed write goes to the dead letters
            kept = rows.where(F.col("outcome") == "success")
            kept.write.mode("overwrite").option("ignoreNullFields", "false").json(letters)
        else:
            remove_folder(spark, letters)
        remove_folder(spark, staged)

    return sink


def start_writer(results: DataFrame, log: str, dead_letters: str, checkpoint: str, interval: str = "3 seconds",
                 drain: bool = False) -> StreamingQuery:
    """Run the sink on a timer, or once over all that is there with `drain`."""
    writer = results.writeStream.foreachBatch(write_batch(log, dead_letters)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if drain else writer.trigger(processingTime=interval)).start()


def latest_outcomes(log: DataFrame) -> DataFrame:
    """Latest row per task of the log; order within a batch is by `seq`."""
    rows = log.withColumn("_at", F.struct("batch_id", "seq"))
    return latest_per_key(rows, "vuln_id", "_at").drop("_at")


def current_results(spark: SparkSession, log: str) -> DataFrame:
    """Results as the log has them now: a task whose last outcome is a failure has none."""
    return latest_outcomes(read_table(spark, log)).where(F.col("outcome") == "success")


def fold_log(tasks: DataFrame, results: DataFrame, log: DataFrame, payload: list[str]) -> tuple[DataFrame, DataFrame]:
    """Task and result tables with the log folded in; folding the same log again changes nothing."""
    return write_results(tasks, results, latest_outcomes(log), payload)


def start_progress(events: DataFrame, log: str, checkpoint: str, drain: bool = False,
                   interval: str = "2 seconds") -> StreamingQuery:
    """Follow (task_id, split, status, ts) events; each micro-batch keeps one row per task."""

    def sink(batch: DataFrame, batch_id: int) -> None:
        rows = latest_per_key(batch, "task_id", "ts").withColumn("batch_id", F.lit(batch_id))
        write_partitions(rows, log, "batch_id")

    writer = events.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if drain else writer.trigger(processingTime=interval)).start()


def progress_view(spark: SparkSession, log: str) -> DataFrame:
    """Total and completed tasks per split, by the latest status of each task."""
    return progress(latest_per_key(read_table(spark, log).drop("batch_id"), "task_id", "ts"))
