"""Streams give what the same rules give over tables."""

from __future__ import annotations

import random
import time
from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from quillmill.operators.sequences import throttle
from quillmill.operators.tasks import lifecycle
from quillmill.sources.parts import event_stream
from quillmill.streaming import live as L
from quillmill.streaming import ordered as O


def test_sessions_stream_equals_batch(spark, tmp_path):
    start = datetime(2024, 1, 1)
    rows = [(i, start + timedelta(hours=7 * i + (40 if i > 5 else 0)), i % 2, "click", 0.0, "{}") for i in range(12)]
    rows.append((99, start + timedelta(days=60), 9, "click", 0.0, "{}"))  # moves the watermark past all notes
    from quillmill.sources.parts import EVENTS

    spark.createDataFrame(rows, EVENTS).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = event_stream(spark, str(tmp_path / "in")).select("ts", "user_id", F.col("event_id").cast("string").alias("text"))
    query = L.highlight_sessions(stream, "user_id").writeStream.format("memory").queryName("notes").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = {tuple(r) for r in spark.table("notes").collect()}
    table = spark.read.parquet(str(tmp_path / "in")).select(F.col("ts").cast("timestamp").alias("ts"), "user_id", F.col("event_id").cast("string").alias("text"))
    expected = {tuple(r) for r in L.highlight_sessions(table, "user_id", stream=False).where("user_id <> 9").collect()}
    assert got == expected and len(expected) == 4


def replay(spark, tmp_path, name, batches, schema, job):
    """The rows of a stream that gets each batch as a file of its own, the last one in the far future."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(1.1 if i else 0)  # files are read in the order of their times
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    run = job(stream).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    run.awaitTermination(300)
    return sorted(tuple(r) for r in spark.table(name).collect())


START = datetime(2024, 1, 1, tzinfo=timezone.utc)


def at(second: int) -> datetime:
    return START + timedelta(seconds=second)


def test_task_states(spark, tmp_path):
    rows = [(1, 10, 0, "init", None, None), (1, 10, 60, "progress", 2, 4), (1, 11, 120, "progress", 3, 4), (2, 20, 0, "init", None, None), (2, 20, 2400, "success", None, None), (3, 30, 0, "init", None, None)]
    rows += [(3, 30, 50, "success", None, None), (1, 10, 90, "progress", None, 5), (1, 10, 100, "clear", None, None), (1, 10, 110, "progress", 1, 1)]
    batches = [[(tab, task, at(s), i, kind, done, total, i) for i, (tab, task, s, kind, done, total) in enumerate(rows) if i % 3 == b] for b in (2, 0, 1)] + [[(9, 9, at(10**7), 99, "progress", 0, 0, 99)]]
    schema = "tab long, task long, ts timestamp, seq long, kind string, done long, total long, message long"
    got = replay(spark, tmp_path, "states", batches, schema, lambda s: O.task_states(s, 30 * 60_000, "2 days"))
    expected = [(1, 10, "processing", 0, 0, 0), (1, 10, "processing", 2, 4, 1), (1, 10, "processing", 2, 5, 7), (2, 20, "processing", 0, 0, 3), (3, 30, "processing", 0, 0, 5), (3, 30, "success", 0, 0, 6)]
    assert got == expected


def test_streams_equal_batches_however_they_are_cut(spark, tmp_path):
    dice = random.Random(8)
    kinds = ["start", "step", "step", "pause", "resume", "cancel", "done", "fail"]
    rows = [(dice.randrange(4), dice.randrange(2), at(dice.randrange(4000)), i, dice.choice(kinds)) for i in range(160)]
    parts = [rows[i::5] for i in range(5)]  # late by up to an hour against each other
    schema = "tab long, task long, ts timestamp, seq long, kind string"
    end = [(-1, 0, at(10**7), 999, "step")]
    table = spark.createDataFrame(rows, schema).withColumn("ms", F.unix_millis("ts"))
    lives = replay(spark, tmp_path / "a", "lives", [*parts, end], schema, lambda s: O.lifecycle_stream(s, 300_000, "2 hours"))
    assert lives == sorted(tuple(r) for r in lifecycle(table, 300_000).collect()) and len({r[4] for r in lives}) >= 3 and any(r[6] for r in lives)
    fired = replay(spark, tmp_path / "b", "fired", [*parts, end], schema, lambda s: O.throttle_stream(s.select("tab", "ts", "seq"), "tab", 90_000, "2 hours"))
    assert fired == sorted(tuple(r) for r in throttle(table, "tab", "ms", "seq", 90_000).collect())


def test_keys_share_state_rows_and_keep_whole_longs(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(O, "BUCKETS", 2)
    far = 2**53 + 1  # not a double
    schema = "tab long, task long, ts timestamp, seq long, kind string, done long, total long, message long"
    rows = [(tab, far, at(tab), tab, kind, n, None, 2 * tab + i) for tab in range(40) for i, (kind, n) in enumerate((("init", None), ("progress", far)))]
    rows = [(tab, task, t, seq + i % 2, *rest) for i, (tab, task, t, seq, *rest) in enumerate(rows)]
    spark.createDataFrame([*rows, (0, None, at(50), 90, "progress", 1, None, 99)], schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = O.task_states(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), 30 * 60_000, "1 second")
    run = stream.writeStream.format("memory").queryName("shared").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    run.awaitTermination(300)
    assert max(op["numRowsTotal"] for p in run.recentProgress for op in p["stateOperators"]) <= 2
    expected = [(tab, far, "processing", n, 0, 2 * tab + i) for tab in range(40) for i, n in enumerate((0, far))]
    assert sorted(tuple(r) for r in spark.table("shared").collect()) == expected


def test_parts_are_written_once(spark, tmp_path):
    spark.createDataFrame([(i, "x" * i) for i in range(20)], "clip_id long, html string").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("clip_id long, html string").parquet(str(tmp_path / "in"))
    job = lambda df: df.select("clip_id", F.lit(0).alias("part_index"), F.length("html").alias("chars"))
    for _ in range(2):
        L.emit_parts(stream, job, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 20


def test_progress(spark):
    rows = spark.createDataFrame([(1, 2, 0, 3), (0, 0, 1, 2), (2, 2, 3, 3)], "i int, it int, p int, pt int")
    assert [r[0] for r in rows.select(L.progress_percent(F.col("i"), F.col("it"), F.col("p"), F.col("pt"))).collect()] == [25, 50, 100]
