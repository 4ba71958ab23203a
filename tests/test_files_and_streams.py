import datetime
import random
import time

from pyspark.sql import functions as F

from paperlens.sources import files as S
from paperlens.streaming import stateful, status


class Halves:
    def pages(self, content):
        if content == b"broken":
            raise ValueError("no pages")
        yield from content.decode().split("|")


class Reader:
    def recognise(self, content, page_number):
        return f"ocr {page_number}", 0.5


def test_scan_and_ocr(spark):
    good = "a readable page of english text that is the one with enough words in it to be kept as it was and is not to be read again by any other engine"
    files = spark.createDataFrame([(1, f"{good}|x".encode()), (2, b"broken"), (3, None)], "file_id long, content binary")
    pages = S.extracted(files, Halves())
    got = {(r.file_id, r.page_number): (r.source, r.ocr_text, r.error) for r in S.recognised(pages, files, Reader).collect()}
    assert got[(1, 1)] == ("PDF_TEXT", None, None) and got[(1, 2)] == ("MIXED", "ocr 2", None)
    assert got[(2, 0)][2] == "ValueError: no pages" and got[(3, 1)][0] == "OCR"


def test_csv(spark, tmp_path):
    S.write_csv(spark.createDataFrame([('say "hi"', "b,c")], "word string, note string").coalesce(1), str(tmp_path / "out"))
    text = next((tmp_path / "out").glob("part-*.csv")).read_text(encoding="utf-8")
    assert text == '﻿"word","note"\n"say ""hi""","b,c"\n'.replace('﻿"word"', '"﻿word"')


def test_partition_overwrite(spark, tmp_path):
    path = str(tmp_path / "t")
    S.overwrite_partitions(spark.createDataFrame([(1, "a"), (2, "b")], "v int, k string"), path, "k")
    S.overwrite_partitions(spark.createDataFrame([(9, "b")], "v int, k string"), path, "k")
    assert sorted(map(tuple, spark.read.parquet(path).select("k", "v").collect())) == [("a", 1), ("b", 9)]


def test_stalled_jobs_time_out(spark, tmp_path):
    day = datetime.datetime(2024, 1, 1)
    log = lambda rows: spark.createDataFrame([(j, day + datetime.timedelta(minutes=m), s) for j, m, s in rows], "job long, ts timestamp, stage string").coalesce(1)
    path = str(tmp_path / "log")
    log([(1, 0, "click"), (2, 0, "purchase")]).write.parquet(path)
    log([(3, 300, "click")]).write.mode("append").parquet(path)
    log([(3, 301, "click")]).write.mode("append").parquet(path)
    stream = status.arriving(spark, path, most_files=1)
    out = status.drained(status.stalled(stream, "job", "ts", "stage", ("purchase",), 600_000), str(tmp_path / "out"), str(tmp_path / "state"), "update")
    assert {r.job for r in out.where("failed").collect()} == {1}


def test_ingest_takes_each_text_once(spark, tmp_path):
    path = str(tmp_path / "docs")
    for _ in range(3):
        spark.range(5).select(F.concat(F.lit("t"), "id").alias("hash")).coalesce(1).write.mode("append").parquet(path)
    with stateful.rocks(spark):
        out = status.drained(status.new_keys(status.arriving(spark, path, 1), "hash"), str(tmp_path / "out"), str(tmp_path / "state"))
    assert sorted(r.hash for r in out.collect()) == [f"t{i}" for i in range(5)]


def events(n, seed=6):
    rng = random.Random(seed)
    return [(rng.randrange(12), datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=i), i, rng.choice(["a", "a", "b", "c", "d"]), float(rng.randrange(100))) for i in range(n)]


def in_batches(spark, path, rows):
    for i in range(0, len(rows), 20):
        spark.createDataFrame(rows[i : i + 20], "paper long, ts timestamp, event_id long, kind string, value double").coalesce(1).write.mode("append").parquet(path)
        time.sleep(0.02)  # the stream takes files by their time


def test_state_goes_on_after_a_restart(spark, tmp_path):
    """Queue, progress and frames over batches of one file each, stopped and started in between, against plain Python."""
    rows, path = events(120), str(tmp_path / "log")
    step = lambda **names: F.create_map(*(F.lit(x) for kv in names.items() for x in kv))[F.col("kind")].alias("step")

    def run():
        log = status.arriving(spark, path, 1)
        with stateful.rocks(spark):
            queue = stateful.started(log.select((F.col("paper") % 2).alias("lane"), "paper", "ts", "event_id", step(a="enqueue", b="done")).where("step IS NOT NULL"), 2)
            queue = status.drained(queue, str(tmp_path / "queue"), str(tmp_path / "queue state"))
            runs = stateful.run_states(log.select(F.col("paper").alias("paper_id"), "ts", "event_id", step(a="start", b="update", c="finish", d="fail"), "value"))
            runs = status.drained(runs, str(tmp_path / "runs"), str(tmp_path / "runs state"), "update")
            sent = stateful.until_terminal(log.select(F.col("paper").alias("paper_id"), "ts", "event_id", F.col("kind").alias("status"), F.col("value").alias("progress")), ("c",))
            stateful.send_frames(sent.select(F.lit("status").alias("event"), F.concat_ws(" ", "paper_id", "number", "status").alias("data")), str(tmp_path / "sent"), str(tmp_path / "sent state"))
        return queue, runs, stateful.read_frames(spark, str(tmp_path / "sent"))

    in_batches(spark, path, rows[:60])
    run()
    in_batches(spark, path, rows[60:])
    run()
    queue, runs, frames = run()

    waiting, running, begun = {0: [], 1: []}, {0: [], 1: []}, []
    state, count, closed, lines = {}, {}, set(), []
    for paper, _, i, kind, value in rows:
        w, r = waiting[paper % 2], running[paper % 2]
        if kind == "a" and paper not in w + r:
            w.append(paper)
        elif kind == "b" and paper in r:
            r.remove(paper)
        while kind in "ab" and len(r) < 2 and w:
            r.append(w.pop(0))
            begun.append((paper % 2, r[-1], i))
        status_, total, done = state.get(paper, ("idle", 0.0, 0.0))
        state[paper] = {"a": ("running", value, 0.0), "b": (status_, total, value), "c": ("finished", total, total), "d": ("failed", total, done)}[kind]
        if paper not in closed:
            count[paper] = count.get(paper, 0) + 1
            lines.append(f"{paper} {count[paper]} {kind}")
            closed |= {paper} if kind == "c" else set()
    assert sorted((r.lane, r.paper, r.event_id) for r in queue.collect()) == sorted(begun)
    last = {}
    for r in sorted(runs.collect(), key=lambda r: r.changes):
        last[r.paper_id] = (r.status, r.total, r.completed)
    assert last == state
    assert sorted(r.data for r in frames.collect()) == sorted(lines)


def test_frames_of_lost_attempts_are_not_read(spark, tmp_path):
    writer = stateful.FrameWriter({"path": str(tmp_path)})
    lost = writer.write(iter([("status", "{}")]))
    kept = writer.write(iter([("status", '{"a": "x"}'), ("error", "two\nlines")]))
    writer.commit([lost, None], 0)
    writer.commit([kept, writer.write(iter([]))], 0)  # the batch again
    assert sorted((r.batch, r.event, r.data) for r in stateful.read_frames(spark, str(tmp_path)).collect()) == [(0, "error", "two\nlines"), (0, "status", '{"a": "x"}')]
    writer.abort([kept], 1)
    assert stateful.read_frames(spark, str(tmp_path)).count() == 0


def test_extracted_pages_leave_in_small_batches():
    """A worker holds few pages at a time, however many a batch of files has."""
    import pyarrow as pa

    fields = pa.schema([("file_id", pa.int64()), ("page_number", pa.int32()), ("raw_text", pa.string()), ("error", pa.string())])
    rows = [(i, 1, "x" * 100_000, None) for i in range(100)] + [(100, 0, None, "broken")]
    made = list(S.batches_of(iter(rows), fields, 2))
    assert max(b.nbytes for b in made) < 2 << 20 and [tuple(r.values()) for b in made for r in b.to_pylist()] == rows
