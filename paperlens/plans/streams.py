"""Queries that run streams over the driver's tables, each into a table that is read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperlens.functions import text as T
from paperlens.operators import relational as R
from paperlens.plans.registry import query
from paperlens.sources import scratch
from paperlens.streaming import stateful, status


@query("SELECT user_id, arg_max(event_type, (ts, event_id)) AS stage, count(*) AS updates FROM events GROUP BY 1")
def q_stream_status(spark: SparkSession, d: str) -> DataFrame:
    """The status log as a stream; each batch's last states are folded into the table of last states."""
    folder = scratch.folder(spark, "stream")
    log = status.arriving(spark, f"{d}/events.parquet").select("user_id", "ts", "event_id", "event_type")
    last = log.groupBy("user_id").agg(F.max_by(F.struct("ts", "event_id", "event_type"), F.struct("ts", "event_id")).alias("last"), F.count("*").alias("updates"))
    changes = status.drained(last.select("user_id", "last.event_type", "updates"), f"{folder}/out", f"{folder}/state", "update")
    return R.latest(changes, ["user_id"], ["batch_id", "updates"]).select("user_id", F.col("event_type").alias("stage"), "updates")


@query("SELECT count(*) AS files, CAST(sum(n) AS BIGINT) AS arrivals FROM (SELECT sha256(lower(trim(regexp_replace(text, '\\s+', ' ', 'g')))) AS h, count(*) AS n FROM documents GROUP BY 1)")
def q_stream_ingest(spark: SparkSession, d: str) -> DataFrame:
    """Documents as arriving files; a text that came before is not taken again."""
    folder = scratch.folder(spark, "stream")
    arrivals = status.arriving(spark, f"{d}/documents.parquet").select(T.text_hash(F.col("text")).alias("hash"))
    with stateful.rocks(spark):
        taken = status.drained(status.new_keys(arrivals, "hash"), f"{folder}/out", f"{folder}/state")
    total = spark.read.parquet(f"{d}/documents.parquet").agg(F.count("*").alias("arrivals"))
    return taken.agg(F.count("hash").alias("files")).crossJoin(F.broadcast(total))  # one row each


@query(
    """SELECT user_id, arg_max(event_type, (ts, event_type)) AS stage, arg_max(event_type, (ts, event_type)) NOT IN ('error', 'purchase') AND max(ts) + INTERVAL 10 MINUTE < (SELECT max(ts) FROM events) - INTERVAL 1 HOUR AS failed
    FROM events GROUP BY 1"""
)
def q_stream_timeout(spark: SparkSession, d: str) -> DataFrame:
    """Jobs of the log with state per job; a job without news for ten minutes of event time times out."""
    folder = scratch.folder(spark, "stream")
    log = status.arriving(spark, f"{d}/events.parquet").select("user_id", F.col("ts").cast("timestamp").alias("ts"), "event_type")
    changes = status.stalled(log, "user_id", "ts", "event_type", ("error", "purchase"), 10 * 60 * 1000)
    out = status.drained(changes, f"{folder}/out", f"{folder}/state", "update")
    return R.latest(out, ["user_id"], ["batch_id", "failed"]).select("user_id", "stage", "failed")


_STEP = "CASE event_type WHEN 'signup' THEN 'enqueue' WHEN 'click' THEN 'enqueue' WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'done' END"
LANES, CAP = 100, 2


@query(
    f"""WITH RECURSIVE e AS (SELECT user_id % {LANES} AS lane, user_id AS paper, event_id, {_STEP} AS step, row_number() OVER (PARTITION BY user_id % {LANES} ORDER BY ts, event_id) AS n FROM events WHERE {_STEP} IS NOT NULL),
    q(lane, n, waiting, running, event_id, begun, so_far) AS (
      SELECT DISTINCT lane, CAST(0 AS BIGINT), CAST([] AS BIGINT[]), CAST([] AS BIGINT[]), CAST(NULL AS BIGINT), CAST([] AS BIGINT[]), CAST(0 AS BIGINT) FROM e
      UNION ALL SELECT lane, n, w[k + 1:], list_concat(r, w[:k]), event_id, w[:k], so_far + k FROM (SELECT *, greatest(0, least(len(w), {CAP} - len(r))) AS k FROM (
        SELECT q.lane, e.n, e.event_id, q.so_far, CASE WHEN step = 'enqueue' AND NOT list_contains(waiting, paper) AND NOT list_contains(running, paper) THEN list_append(waiting, paper) ELSE waiting END AS w,
          CASE WHEN step = 'done' THEN list_filter(running, lambda x: x <> paper) ELSE running END AS r FROM q JOIN e ON e.lane = q.lane AND e.n = q.n + 1)))
    SELECT lane, CAST(so_far - len(begun) + i AS BIGINT) AS started, begun[i] AS paper, event_id FROM (SELECT *, unnest(range(1, len(begun) + 1)) AS i FROM q)"""
)
def q_stream_queue(spark: SparkSession, d: str) -> DataFrame:
    """Jobs of the log through queues, in order, without copies, two at a time a queue."""
    folder = scratch.folder(spark, "stream")
    log = status.arriving(spark, f"{d}/events.parquet").select((F.col("user_id") % LANES).alias("lane"), F.col("user_id").alias("paper"), "ts", "event_id", F.expr(_STEP).alias("step"))
    with stateful.rocks(spark):
        return status.drained(stateful.started(log.where("step IS NOT NULL"), CAP), f"{folder}/out", f"{folder}/state").drop("batch_id")


@query(
    """WITH o AS (SELECT user_id, event_type AS t, value AS v, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS o FROM events),
    s AS (SELECT user_id, coalesce(arg_max(v, o) FILTER (t = 'signup'), 0) AS total, arg_max(t, o) FILTER (t IN ('signup', 'click', 'purchase')) AS moved, arg_max(v, o) FILTER (t IN ('signup', 'click', 'purchase')) AS v,
      arg_max(t, o) FILTER (t IN ('signup', 'purchase', 'error')) AS turned, count(*) AS changes FROM o GROUP BY 1)
    SELECT user_id AS paper_id, CASE turned WHEN 'signup' THEN 'running' WHEN 'purchase' THEN 'finished' WHEN 'error' THEN 'failed' ELSE 'idle' END AS status, total, CASE moved WHEN 'click' THEN v WHEN 'purchase' THEN total ELSE 0 END AS completed, changes FROM s"""
)
def q_stream_progress(spark: SparkSession, d: str) -> DataFrame:
    """The state machine of runs over a stream: the last state that each run has reached."""
    folder = scratch.folder(spark, "stream")
    step = F.when(F.col("event_type") == "signup", "start").when(F.col("event_type") == "click", "update").when(F.col("event_type") == "purchase", "finish").when(F.col("event_type") == "error", "fail")
    log = status.arriving(spark, f"{d}/events.parquet").select(F.col("user_id").alias("paper_id"), "ts", "event_id", step.alias("step"), "value")
    with stateful.rocks(spark):
        changes = status.drained(stateful.run_states(log), f"{folder}/out", f"{folder}/state", "update")
    return R.latest(changes, ["paper_id"], ["changes"]).select("paper_id", "status", "total", "completed", "changes")


@query(
    """WITH o AS (SELECT user_id, event_type, value, row_number() OVER w AS n, coalesce(max(CASE WHEN event_type IN ('purchase', 'error') THEN 1 ELSE 0 END) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS closed
      FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
    SELECT user_id AS paper_id, CAST(n AS BIGINT) AS number, 'status' AS event, event_type AS status, CAST(floor(value) AS BIGINT) AS progress FROM o WHERE closed = 0"""
)
def q_stream_frames(spark: SparkSession, d: str) -> DataFrame:
    """Status frames written by a stream and read back; a job's frames end with its first terminal status."""
    folder = scratch.folder(spark, "stream")
    log = status.arriving(spark, f"{d}/events.parquet").select(F.col("user_id").alias("paper_id"), "ts", "event_id", F.col("event_type").alias("status"), F.col("value").cast("double").alias("progress"))
    with stateful.rocks(spark):
        rows = stateful.until_terminal(log, ("purchase", "error"))
        data = F.to_json(F.struct(F.col("paper_id").alias("id"), "number", "status", F.floor("progress").alias("progress")))
        stateful.send_frames(rows.select(F.lit("status").alias("event"), data.alias("data")), f"{folder}/sent", f"{folder}/state")
    frames = stateful.read_frames(spark, f"{folder}/sent").select("event", F.from_json("data", "id long, number long, status string, progress long").alias("x"))
    return frames.select(F.col("x.id").alias("paper_id"), "x.number", "event", "x.status", "x.progress")
