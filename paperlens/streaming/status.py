"""Streams over tables in a folder: the status of jobs, arriving files without copies, and jobs that stand still."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def arriving(spark: SparkSession, path: str, most_files: int = 3) -> DataFrame:
    """A stream of a Parquet table's files. The schema is read once from the table; columns are nullable."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rpartition("/")
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", most_files)
    return reader.option("pathGlobFilter", "*.parquet").parquet(path) if _is_folder(spark, path) else reader.option("pathGlobFilter", name).parquet(folder)


def _is_folder(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


def drained(stream: DataFrame, path: str, checkpoint: str, mode: str = "append", each: Callable[[DataFrame, int], None] | None = None) -> DataFrame:
    """Run a stream over what is there (availableNow) into a Parquet table, one folder a batch, and read it back.

    A batch that is run again after a failure overwrites its own folder, so no row counts twice.
    """

    def sink(batch: DataFrame, number: int) -> None:
        (each or (lambda b, n: None))(batch, number)
        batch.withColumn("batch_id", F.lit(number)).write.mode("overwrite").parquet(f"{path}/batch={number}")

    query = stream.writeStream.foreachBatch(sink).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    schema = stream.withColumn("batch_id", F.lit(0)).schema
    return stream.sparkSession.read.schema(schema).option("recursiveFileLookup", "true").parquet(path)


def new_keys(stream: DataFrame, key: str) -> DataFrame:
    """The stream without rows whose key has come before: keys are kept in the state store, no earlier batch is read again."""
    return stream.dropDuplicates([key])


def latest_status(log: DataFrame, keys: list[str], order: list[str], fields: list[str]) -> DataFrame:
    """A stream of each key's last state (update mode)."""
    last = F.max_by(F.struct(*order, *[f for f in fields if f not in order]), F.struct(*order))
    return log.groupBy(*keys).agg(last.alias("last")).select(*keys, *(F.col(f"last.{c}").alias(c) for c in dict.fromkeys([*order, *fields])))


def stalled(log: DataFrame, key: str, at: str, stage: str, terminal: tuple[str, ...], idle_ms: int, late: str = "1 hour") -> DataFrame:
    """A stream with a row (key, stage, failed) for each job at each change; failed once its event time stands still for idle_ms.
    Of events at one time the one with the largest stage counts."""
    schema = f"{key} {dict(log.dtypes)[key]}, stage string, failed boolean"

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            (last, _) = state.get
            state.remove()
            yield pd.DataFrame({key: [k[0]], "stage": [last], "failed": [last not in terminal]})
            return
        last, newest = state.get if state.exists else (None, -1)
        for frame in frames:
            i = frame.sort_values([at, stage]).index[-1]
            ms = int(frame[at][i].timestamp() * 1000)
            if (ms, frame[stage][i]) >= (newest, last or ""):
                last, newest = frame[stage][i], ms
        state.update((last, newest))
        state.setTimeoutTimestamp(max(newest + idle_ms, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({key: [k[0]], "stage": [last], "failed": [False]})

    return log.withWatermark(at, late).groupBy(key).applyInPandasWithState(step, schema, "last string, newest long", "update", GroupStateTimeout.EventTimeTimeout)
