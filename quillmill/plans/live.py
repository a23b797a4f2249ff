"""Queries of the stream rules, run over the whole event table as batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmill.plans.registry import Registry, table
from quillmill.streaming import live as L

registry = Registry()
query = registry.add


@query("highlight_sessions", """
    WITH e AS (SELECT user_id, event_id, event_type, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS b FROM events WHERE event_type IN ('click', 'view')),
    s AS (SELECT *, sum(CASE WHEN b IS NULL OR ts - b > INTERVAL 24 HOURS THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM e)
    SELECT user_id, epoch_us(min(ts)) AS first_at, epoch_us(max(ts)) AS last_at, count(*) AS highlights, string_agg(CAST(event_id AS VARCHAR), chr(10) ORDER BY ts, CAST(event_id AS VARCHAR)) AS body FROM s GROUP BY user_id, s""")  # fmt: skip
def highlight_sessions(spark, sf_dir):
    rows = table(spark, sf_dir, "events").where("event_type in ('click', 'view')").select("user_id", F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").cast("string").alias("text"))
    out = L.highlight_sessions(rows, "user_id", stream=False)
    return out.select("user_id", F.unix_micros("first_at").alias("first_at"), F.unix_micros("last_at").alias("last_at"), "highlights", "body")


@query("progress_percent", """
    WITH e AS (SELECT event_id, event_id % 7 AS i, event_id % 3 * 4 AS it, event_id % 5 AS p, event_id % 6 AS pt FROM events)
    SELECT event_id, CAST(least(100, greatest(0, floor(CASE WHEN it > 0 THEN i / it * 50 + CASE WHEN pt > 0 THEN p / pt ELSE 0 END * 50 ELSE CASE WHEN pt > 0 THEN p / pt ELSE 0 END * 100 END))) AS INT) AS percent FROM e""")  # fmt: skip
def progress_percent(spark, sf_dir):
    rows = table(spark, sf_dir, "events").selectExpr("event_id", "event_id % 7 AS i", "event_id % 3 * 4 AS it", "event_id % 5 AS p", "event_id % 6 AS pt")
    return rows.select("event_id", L.progress_percent(F.col("i"), F.col("it"), F.col("p"), F.col("pt")).alias("percent"))


@query("stale_message_filter", """
    WITH e AS (SELECT event_id, user_id % 50 AS tab, epoch_us(ts) // 3600000000 - CASE WHEN event_id % 9 = 0 THEN 1 ELSE 0 END AS task, epoch_us(ts) AS t FROM events), c AS (SELECT *, max(task) OVER (PARTITION BY tab ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS cur FROM e)
    SELECT event_id, tab FROM c WHERE task = cur""")  # fmt: skip
def stale_message_filter(spark, sf_dir):
    from pyspark.sql import Window

    rows = table(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 50).alias("tab"), F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    rows = rows.withColumn("task", F.floor(F.col("t") / 3_600_000_000) - F.when(F.col("event_id") % 9 == 0, 1).otherwise(0))
    current = F.max("task").over(Window.partitionBy("tab").orderBy("t", "event_id").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("cur", current).where("task = cur").select("event_id", "tab")
