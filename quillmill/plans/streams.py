"""Queries that replay a table as a file stream, and their batch twins."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmill.functions.urls import domain_of
from quillmill.operators.tasks import lifecycle
from quillmill.plans import sequences
from quillmill.plans.pages import HOST
from quillmill.plans.registry import Registry, derived, same, table
from quillmill.sources.parts import EVENTS, event_stream, write_parts
from quillmill.sources.shared import shared_folder
from quillmill.streaming import ordered as O
from quillmill.streaming.live import emit_parts, fresh_messages

registry = Registry()
query = registry.add

#: Users as tabs; a task hears from its user some times a day.
TTL = 24 * 3600 * 1000
KINDS = "CASE event_type WHEN 'signup' THEN 'start' WHEN 'view' THEN 'step' WHEN 'click' THEN CASE WHEN event_id % 2 = 0 THEN 'pause' ELSE 'step' END WHEN 'error' THEN CASE event_id % 4 WHEN 0 THEN 'cancel' WHEN 1 THEN 'fail' ELSE 'resume' END ELSE CASE event_id % 3 WHEN 0 THEN 'done' ELSE 'resume' END END"
#: A message names the task it is for, here by two days; now and then one that is over.
TASK = "CAST(floor(ms / 172800000) AS BIGINT) - CASE WHEN kind <> 'start' AND seq % 11 = 0 THEN 1 ELSE 0 END"
MESSAGES = f"SELECT *, {TASK} AS task FROM (SELECT user_id AS tab, {{ms}} AS ms, event_id AS seq, {KINDS} AS kind FROM {{events}})"


def stream_messages(events: DataFrame) -> DataFrame:
    rows = events.selectExpr("user_id AS tab", "ts", "unix_millis(ts) AS ms", "event_id AS seq", f"{KINDS} AS kind")
    return rows.selectExpr("tab", "ts", "seq", "kind", f"{TASK} AS task")


def _messages(spark, sf_dir) -> DataFrame:
    return derived(spark, sf_dir, MESSAGES.replace("{ms}", "unix_millis(cast(ts AS timestamp))"))


#: The state machine message by message.
LIVES = f"""
    RECURSIVE m AS (SELECT *, row_number() OVER (PARTITION BY tab ORDER BY ms, seq) AS i FROM ({same(MESSAGES.replace('{ms}', '(epoch_us(ts) // 1000)'))})),
    walk AS (SELECT tab, 0::BIGINT AS i, 0 AS run, 0::BIGINT AS cur, 'none' AS status, 0::BIGINT AS started, 0::BIGINT AS last, 0::BIGINT AS halted, 0::BIGINT AS paused, 0::BIGINT AS steps, 0::BIGINT AS ended FROM (SELECT DISTINCT tab FROM m) UNION ALL
      SELECT tab, i, run + CASE WHEN kind = 'start' THEN 1 ELSE 0 END, CASE WHEN kind = 'start' THEN task ELSE cur END,
        CASE WHEN kind = 'start' THEN 'running' WHEN idle THEN status WHEN lost THEN 'expired' WHEN kind = 'done' THEN 'success' WHEN kind = 'fail' THEN 'failed' WHEN kind = 'cancel' THEN 'cancelled' WHEN kind = 'resume' THEN 'running'
          WHEN kind = 'pause' AND status = 'running' THEN 'pause_requested' WHEN kind = 'step' AND status = 'pause_requested' THEN 'paused' ELSE status END,
        CASE WHEN kind = 'start' THEN ms ELSE started END, CASE WHEN kind = 'start' OR NOT (idle OR lost) THEN ms ELSE last END,
        CASE WHEN kind = 'step' AND NOT idle AND NOT lost AND status = 'pause_requested' THEN ms ELSE halted END,
        CASE WHEN kind = 'start' THEN 0 WHEN idle OR status <> 'paused' THEN paused WHEN lost THEN paused + last + {TTL} - halted WHEN kind IN ('done', 'fail', 'cancel', 'resume') THEN paused + ms - halted ELSE paused END,
        CASE WHEN kind = 'start' THEN 0 WHEN kind = 'step' AND NOT idle AND NOT lost AND status = 'running' THEN steps + 1 ELSE steps END,
        CASE WHEN kind = 'start' THEN 0 WHEN idle THEN ended WHEN lost THEN last + {TTL} WHEN kind IN ('done', 'fail', 'cancel') THEN ms ELSE ended END
      FROM (SELECT m.tab, m.i, m.ms, m.kind, m.task, w.run, w.cur, w.status, w.started, w.last, w.halted, w.paused, w.steps, w.ended, w.run = 0 OR m.task <> w.cur OR w.status NOT IN ('running', 'pause_requested', 'paused') AS idle, m.ms - w.last > {TTL} AS lost
        FROM walk w JOIN m ON m.tab = w.tab AND m.i = w.i + 1)),
    final AS (SELECT *, lead(started) OVER (PARTITION BY tab ORDER BY run) AS nxt FROM (SELECT * FROM walk WHERE run > 0 QUALIFY row_number() OVER (PARTITION BY tab, run ORDER BY i DESC) = 1)),
    closed AS (SELECT *, status IN ('running', 'pause_requested', 'paused') AS open, coalesce(nxt - last <= {TTL}, false) AS replaced FROM final),
    ends AS (SELECT *, CASE WHEN NOT open THEN ended WHEN replaced THEN nxt ELSE last + {TTL} END AS stop FROM closed)
    SELECT tab, cur AS task, started, stop AS ended, CASE WHEN NOT open THEN status WHEN replaced THEN 'cancelled' ELSE 'expired' END AS outcome, steps, CAST(paused + CASE WHEN status = 'paused' THEN stop - halted ELSE 0 END AS BIGINT) AS paused_ms FROM ends"""


@query("task_lifecycle", f"WITH {LIVES}")
def task_lifecycle(spark, sf_dir):
    return lifecycle(_messages(spark, sf_dir), TTL)


def replayed(spark, sf_dir: str, job, files_at_once: int | None = None) -> DataFrame:
    """What a stream job makes of the event table, which it reads as a file stream, up to the end of time.

    A second folder of the stream is empty at first. When all events are through, one event of the far future (user -1) comes
    in there and the stream goes on from its checkpoint, so that the watermark passes whatever still waits. The table's path is
    a pattern, as a stream reads a lone file only by one.
    """
    folder = shared_folder(spark, "replay")
    ends = f"{folder}/end"
    spark.createDataFrame([], EVENTS).write.parquet(ends)

    def run() -> None:
        stream = job(event_stream(spark, f"{sf_dir}/events.parque[t]", files_at_once).unionByName(event_stream(spark, ends, files_at_once)))
        writer = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint")
        writer.outputMode("append").trigger(availableNow=True).start().awaitTermination()

    run()
    spark.createDataFrame([(-1, datetime(2200, 1, 1), -1, "view", 0.0, "{}")], EVENTS).coalesce(1).write.mode("append").parquet(ends)
    run()
    return spark.read.parquet(f"{folder}/out")


@query("throttle_stream", sequences.registry.sql["leading_throttle"])
def throttle_stream(spark, sf_dir):
    job = lambda events: O.throttle_stream(events.select("user_id", "ts", F.col("event_id").alias("seq")), "user_id", 36_000_000, "1 hour")
    return replayed(spark, sf_dir, job)


@query("task_stream", f"WITH {LIVES}")
def task_stream(spark, sf_dir):
    return replayed(spark, sf_dir, lambda events: O.lifecycle_stream(stream_messages(events), TTL, "1 hour"))


@query("event_source", "SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, epoch_us(max(ts)) AS last_at FROM events GROUP BY event_type")
def event_source(spark, sf_dir):
    rows = replayed(spark, sf_dir, lambda events: events).where("event_id >= 0")
    return rows.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("users"), F.max(F.unix_micros("ts")).alias("last_at"))


@query("fresh_message_stream", "SELECT event_id, user_id FROM events")
def fresh_message_stream(spark, sf_dir):
    """Each event comes in twice; the stream passes it on once."""
    twice = lambda events: fresh_messages(events.unionByName(events)).select("event_id", "user_id")
    return replayed(spark, sf_dir, twice).where("event_id >= 0")


STATE_KINDS = "CASE event_type WHEN 'signup' THEN 'init' WHEN 'view' THEN 'progress' WHEN 'click' THEN CASE WHEN event_id % 5 = 0 THEN 'paused' ELSE 'progress' END WHEN 'error' THEN CASE event_id % 4 WHEN 0 THEN 'cancelled' WHEN 1 THEN 'clear' ELSE 'failed' END ELSE 'success' END"
NUMBERS = "CASE WHEN event_id % 4 <> 0 THEN event_id % 7 END AS done, CASE WHEN event_id % 3 = 0 THEN 8 + event_id % 2 END AS total"
STATES = f"SELECT *, {TASK} AS task FROM (SELECT user_id AS tab, {{ms}} AS ms, event_id AS seq, {STATE_KINDS.replace("'init'", "'start'")} AS kind, {NUMBERS} FROM {{events}})"


@query("task_state", f"""
    WITH RECURSIVE m AS (SELECT *, row_number() OVER (PARTITION BY tab ORDER BY ms, seq) AS i FROM ({same(STATES.replace('{ms}', '(epoch_us(ts) // 1000)'))})),
    walk AS (SELECT tab, 0::BIGINT AS i, 0::BIGINT AS task, 'none' AS status, 0::BIGINT AS done, 0::BIGINT AS total, 0::BIGINT AS last, 0::BIGINT AS message, false AS shown FROM (SELECT DISTINCT tab FROM m) UNION ALL
      SELECT tab, i, CASE WHEN kind = 'start' THEN mine ELSE task END, CASE WHEN kind = 'start' OR (counts AND kind = 'progress') THEN 'processing' WHEN counts THEN CASE kind WHEN 'clear' THEN 'none' ELSE kind END WHEN lost THEN 'none' ELSE status END,
        CASE WHEN kind = 'start' THEN 0 WHEN counts AND kind IN ('progress', 'paused') THEN coalesce(new_done, done) ELSE done END, CASE WHEN kind = 'start' THEN 0 WHEN counts AND kind IN ('progress', 'paused') THEN coalesce(new_total, total) ELSE total END,
        CASE WHEN kind = 'start' OR counts THEN ms ELSE last END, CASE WHEN kind = 'start' OR counts THEN seq ELSE message END, kind = 'start' OR (counts AND kind <> 'clear')
      FROM (SELECT *, status <> 'none' AND mine = task AND NOT lost AS counts FROM (SELECT m.tab, m.i, m.ms, m.seq, m.kind, m.task AS mine, m.done AS new_done, m.total AS new_total, w.task, w.status, w.done, w.total, w.last, w.message,
        w.status <> 'none' AND m.ms - w.last > {TTL} AS lost FROM walk w JOIN m ON m.tab = w.tab AND m.i = w.i + 1)))
    SELECT tab, task, status, done, total, message FROM walk WHERE shown""")  # fmt: skip
def task_state(spark, sf_dir):
    def job(events: DataFrame) -> DataFrame:
        rows = events.selectExpr("user_id AS tab", "ts", "unix_millis(ts) AS ms", "event_id AS seq", f"{STATE_KINDS.replace("'init'", "'start'")} AS kind", *NUMBERS.split(", "), "event_id AS message")
        rows = rows.selectExpr("tab", "ts", "seq", f"{TASK} AS task", "CASE kind WHEN 'start' THEN 'init' ELSE kind END AS kind", "done", "total", "message")
        return O.task_states(rows, TTL, "1 hour")

    return replayed(spark, sf_dir, job)


PARTS = f"SELECT page_id AS clip_id, {HOST} AS domain, CAST(length(html) AS BIGINT) AS chars FROM pages"


@query("parts_sink", PARTS)
def parts_sink(spark, sf_dir):
    """The parts that the sink has written, as they are read back from its folders."""
    folder = shared_folder(spark, "parts")
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("clip_id"), domain_of(F.col("url")).alias("domain"), F.length("html").cast("long").alias("chars"))
    write_parts(pages, folder)
    return spark.read.schema("clip_id long, chars long, domain string").parquet(folder)


@query("part_emit", PARTS)
def part_emit(spark, sf_dir):
    """The parts that a stream of pages has emitted, one folder for each micro-batch."""
    folder = shared_folder(spark, "emit")
    pages = spark.readStream.schema("page_id long, url string, html string").parquet(f"{sf_dir}/pages.parque[t]")
    job = lambda batch: batch.select(F.col("page_id").alias("clip_id"), domain_of(F.col("url")).alias("domain"), F.length("html").cast("long").alias("chars"))
    emit_parts(pages, job, f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    return spark.read.schema("clip_id long, domain string, chars long").parquet(f"{folder}/out").drop("batch")
