"""Lives of save tasks, by windows over their messages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: How a message ends a task. Fixed values.
ENDS = {"cancel": "cancelled", "done": "success", "fail": "failed"}


def lifecycle(messages: DataFrame, ttl: int) -> DataFrame:
    """(tab, task, started, ended, outcome, steps, paused_ms): each task of each tab, times in ms.

    ``messages``: tab, ms (time), seq (orders equal times), task, kind (start, step, pause, resume, cancel, done, fail). A start
    ends the tab's task before it (cancelled). Messages for another task than the tab's last are stale and count for nothing. A
    pause takes effect at the next step, which is a safe point; until a resume nothing runs then, and that time is paused_ms.
    steps are those that ran. A task that hears nothing for longer than ``ttl`` is forgotten at that time (expired), whatever
    comes later; so is one with no more messages at all. A null tab is left out; messages before any start count for nothing.

    A tab's stretch from one start to the next is one task; the blocks between its starts and resumes hold one pause at most
    that counts. So all is counted by windows and one grouping, and no state is folded.
    """
    tab = Window.partitionBy("tab").orderBy("ms", "seq")
    rows = messages.where(F.col("tab").isNotNull()).select("tab", "ms", "seq", "task", "kind")
    rows = rows.withColumn("run", F.count(F.when(F.col("kind") == "start", 1)).over(tab)).where("run > 0")
    own = Window.partitionBy("tab", "run").orderBy("ms", "seq")
    before = own.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("current", F.first("task").over(own)).where(F.col("task").eqNullSafe(F.col("current")))
    rows = rows.withColumn("late", F.coalesce(F.col("ms") - F.lag("ms").over(own) > ttl, F.lit(False)))
    rows = rows.withColumn("over", F.coalesce(F.max(F.col("kind").isin(list(ENDS))).over(before), F.lit(False)) | F.max("late").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.where(~F.col("over"))
    rows = rows.withColumn("block", F.count(F.when(F.col("kind").isin("start", "resume"), 1)).over(own)).withColumn("n", F.row_number().over(own))
    # in each block: the first pause, and the first step after it
    block = Window.partitionBy("tab", "run", "block")
    rows = rows.withColumn("asked", F.min(F.when(F.col("kind") == "pause", F.col("n"))).over(block))
    rows = rows.withColumn("halt", F.coalesce((F.col("kind") == "step") & (F.col("n") > F.col("asked")), F.lit(False)))
    parts = rows.groupBy("tab", "run", "block").agg(
        F.first("current").alias("task"),
        F.min("ms").alias("began"),
        F.max("ms").alias("last"),
        F.min(F.when(F.col("halt"), F.col("ms"))).alias("halted"),
        F.count_if((F.col("kind") == "step") & ~F.col("halt")).alias("steps"),
        F.max(F.when(F.col("kind").isin(list(ENDS)), F.struct("ms", "kind"))).alias("end"),
    )
    # a run's end: its own, or the next start, or nothing for too long
    starts = Window.partitionBy("tab").orderBy("run", "block")
    nxt = Window.partitionBy("tab", "run").orderBy("block")
    parts = parts.withColumn("resumed", F.lead("began").over(nxt)).withColumn("following", F.lead(F.struct("run", "began")).over(starts))
    lost = F.col("following").isNull() | (F.col("following.began") - F.col("last") > ttl)
    ended = F.when(F.col("end").isNotNull(), F.col("end.ms")).when(lost, F.col("last") + ttl).otherwise(F.col("following.began"))
    outcome = F.when(F.col("end.kind") == "done", ENDS["done"]).when(F.col("end.kind") == "fail", ENDS["fail"]).when(F.col("end").isNotNull() | ~lost, ENDS["cancel"]).otherwise("expired")
    parts = parts.withColumn("ended", F.when(F.col("resumed").isNull(), ended)).withColumn("outcome", F.when(F.col("resumed").isNull(), outcome))
    paused = F.coalesce(F.coalesce("resumed", "ended") - F.col("halted"), F.lit(0))
    out = parts.groupBy("tab", "run").agg(
        F.first("task").alias("task"),
        F.min("began").alias("started"),
        F.max("ended").alias("ended"),
        F.max("outcome").alias("outcome"),
        F.sum("steps").alias("steps"),
        F.sum(paused).alias("paused_ms"),
    )
    return out.drop("run")
