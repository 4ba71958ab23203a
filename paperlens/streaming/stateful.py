"""Streams with state a key: a queue with a cap, the progress of a run, and status frames that end with a job's last state.

State lives in the RocksDB store of the executors, keyed and checkpointed by Spark: a batch reads and writes the state of its own
keys and no earlier batch, and a query that starts again goes on from its last committed batch. Events of a key count in the order of their
batches, within a batch by the given columns.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceStreamWriter, WriterCommitMessage
from pyspark.sql.streaming import StatefulProcessor

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocks(spark: SparkSession):
    """The state store that keyed state needs, for queries that start inside; the session's own setting afterwards."""
    before = spark.conf.get(STORE, None)
    spark.conf.set(STORE, ROCKS)
    try:
        yield
    finally:
        spark.conf.unset(STORE) if before is None else spark.conf.set(STORE, before)


def _fields(**kinds: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, k) for n, k in kinds.items()])


class Queue(StatefulProcessor):
    """First in, first out: a paper that waits or runs does not join again; at most cap run at once."""

    def __init__(self, cap: int):
        self.cap = cap

    def init(self, handle) -> None:
        self.ends = handle.getValueState("ends", _fields(first=T.LongType(), next=T.LongType(), running=T.LongType(), started=T.LongType()))
        self.line = handle.getMapState("line", _fields(place=T.LongType()), _fields(paper=T.LongType()))
        self.known = handle.getMapState("known", _fields(paper=T.LongType()), _fields(runs=T.BooleanType()))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        first, next_, running, started = self.ends.get() if self.ends.exists() else (0, 0, 0, 0)
        for r in sorted(rows, key=lambda r: (r.ts, r.event_id)):
            there = self.known.containsKey((r.paper,))
            if r.step == "enqueue" and not there:
                self.line.updateValue((next_,), (r.paper,))
                self.known.updateValue((r.paper,), (False,))
                next_ += 1
            elif r.step == "done" and there and self.known.getValue((r.paper,))[0]:
                self.known.removeKey((r.paper,))
                running -= 1
            while running < self.cap and first < next_:
                paper = self.line.getValue((first,))[0]
                self.line.removeKey((first,))
                self.known.updateValue((paper,), (True,))
                first, running, started = first + 1, running + 1, started + 1
                yield Row(lane=key[0], started=started, paper=paper, event_id=r.event_id)
        self.ends.update((first, next_, running, started))

    def close(self) -> None:
        pass


def started(log: DataFrame, cap: int) -> DataFrame:
    """A stream of lane, started (running number), paper, event_id (which made it start). log: lane, paper, ts, event_id, step."""
    return log.groupBy("lane").transformWithState(Queue(cap), "lane long, started long, paper long, event_id long", outputMode="Append", timeMode="None")


class Progress(StatefulProcessor):
    """A run's state: start sets it anew with a total, update sets how much is done, finish and fail end it."""

    def init(self, handle) -> None:
        self.state = handle.getValueState("state", _fields(status=T.StringType(), total=T.DoubleType(), completed=T.DoubleType(), changes=T.LongType()))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        status, total, completed, changes = self.state.get() if self.state.exists() else ("idle", 0.0, 0.0, 0)
        for r in sorted(rows, key=lambda r: (r.ts, r.event_id)):
            match r.step:
                case "start":
                    status, total, completed = "running", r.value, 0.0
                case "update":
                    completed = r.value
                case "finish":
                    status, completed = "finished", total
                case "fail":
                    status = "failed"
            changes += 1
        self.state.update((status, total, completed, changes))
        yield Row(paper_id=key[0], status=status, total=total, completed=completed, changes=changes)

    def close(self) -> None:
        pass


def run_states(log: DataFrame) -> DataFrame:
    """A stream of paper_id, status, total, completed, changes, once a batch in which a run changes. log: paper_id, ts, event_id, step, value."""
    return log.groupBy("paper_id").transformWithState(Progress(), "paper_id long, status string, total double, completed double, changes long", outputMode="Update", timeMode="None")


class Statuses(StatefulProcessor):
    """Statuses of a job up to the first terminal one; what comes later finds the stream closed."""

    def __init__(self, terminal: tuple[str, ...]):
        self.terminal = terminal

    def init(self, handle) -> None:
        self.sent = handle.getValueState("sent", _fields(n=T.LongType(), closed=T.BooleanType()))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        n, closed = self.sent.get() if self.sent.exists() else (0, False)
        if closed:
            return
        for r in sorted(rows, key=lambda r: (r.ts, r.event_id)):
            n += 1
            closed = r.status in self.terminal
            yield Row(paper_id=key[0], number=n, status=r.status, progress=r.progress)
            if closed:
                break
        self.sent.update((n, closed))

    def close(self) -> None:
        pass


def until_terminal(log: DataFrame, terminal: tuple[str, ...]) -> DataFrame:
    """A stream of paper_id, number, status, progress. log: paper_id, ts, event_id, status, progress."""
    return log.groupBy("paper_id").transformWithState(Statuses(terminal), "paper_id long, number long, status string, progress double", outputMode="Append", timeMode="None")


@dataclass
class Written(WriterCommitMessage):
    file: str | None


class FrameWriter(DataSourceStreamWriter):
    """Frames `event: <event>` and `data: <data>`, a file a task and a note of each batch's files. A batch that runs again replaces its
    note, so that files of a lost attempt are never read."""

    def __init__(self, options: dict):
        self.path = options["path"]

    def _place(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.path if "://" in self.path or self.path.startswith("file:") else f"file://{self.path}")

    def write(self, iterator) -> Written:
        store, base = self._place()
        out, name = None, f"{uuid.uuid4().hex}.txt"
        for event, data in iterator:
            if out is None:
                store.create_dir(f"{base}/frames", recursive=True)
                out = store.open_output_stream(f"{base}/frames/{name}")
            out.write(f"event: {event}\ndata: {data}\n\n".encode())
        if out is None:
            return Written(None)
        out.close()
        return Written(name)

    def commit(self, messages, batchId: int) -> None:
        store, base = self._place()
        store.create_dir(f"{base}/batches", recursive=True)
        with store.open_output_stream(f"{base}/batches/{batchId:010d}.json") as out:
            out.write("".join(json.dumps({"batch": batchId, "file": m.file}) + "\n" for m in messages if m is not None and m.file).encode())

    def abort(self, messages, batchId: int) -> None:
        store, base = self._place()
        for m in messages:
            if m is not None and m.file:
                store.delete_file(f"{base}/frames/{m.file}")


class Frames(DataSource):
    """stream.writeStream.format("event-frames") for rows (event, data)."""

    @classmethod
    def name(cls) -> str:
        return "event-frames"

    def streamWriter(self, schema, overwrite) -> FrameWriter:
        return FrameWriter(self.options)


def send_frames(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Write a stream of (event, data) as frames, for what is there."""
    stream.sparkSession.dataSource.register(Frames)
    query = stream.select("event", "data").writeStream.format("event-frames").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()


def read_frames(spark: SparkSession, path: str) -> DataFrame:
    """batch, event, data of the frames in committed files; one line without its break is one frame."""
    files = spark.read.schema("batch long, file string").json(f"{path}/batches")
    frames = spark.read.option("lineSep", "\n\n").text(f"{path}/frames").select("value", F.col("_metadata.file_name").alias("file"))
    whole = r"\Aevent: ([^\n]*)\ndata: ([\s\S]*)\z"
    return frames.join(files, "file").select("batch", F.regexp_extract("value", whole, 1).alias("event"), F.regexp_extract("value", whole, 2).alias("data"))
