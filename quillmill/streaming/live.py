"""Streams of highlights, messages and pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: For how long a note takes further highlights.
NOTE_HOURS = 24


def highlight_sessions(highlights: DataFrame, key: str, hours: int = NOTE_HOURS, stream: bool = True) -> DataFrame:
    """(key, first_at, last_at, highlights, body): one note for highlights of a key that come within ``hours`` of each other.

    Each highlight extends the note's life, which is a session window. The same code runs on a table; a stream emits a
    note once the watermark has passed its end. Needs ts (timestamp) and text.
    """
    rows = highlights.withWatermark("ts", f"{hours} hours") if stream else highlights
    window = F.session_window("ts", f"{hours} hours").alias("w")
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ts", "text"))), lambda x: x["text"]), "\n")
    out = rows.groupBy(window, key).agg(F.min("ts").alias("first_at"), F.max("ts").alias("last_at"), F.count(F.lit(1)).alias("highlights"), body.alias("body"))
    return out.drop("w")


def fresh_messages(messages: DataFrame, hours: int = 1) -> DataFrame:
    """Each message once: repeats of an id within the watermark are dropped."""
    return messages.withWatermark("ts", f"{hours} hours").dropDuplicatesWithinWatermark(["event_id"])


def progress_percent(images: Column, images_total: Column, parts: Column, parts_total: Column) -> Column:
    """With images the first half is theirs and the second the parts'; without, all is the parts'; from 0 to 100."""
    share = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    value = F.when(images_total > 0, share(images, images_total) * 50 + share(parts, parts_total) * 50).otherwise(share(parts, parts_total) * 100)
    return F.least(F.lit(100), F.greatest(F.lit(0), F.floor(value))).cast("int")


def emit_parts(pages: DataFrame, job, path: str, checkpoint: str):
    """Runs ``job`` (pages to parts with clip_id and part_index) on each micro-batch and writes its parts once.

    A batch goes to a folder of its own number and replaces it, so a batch that is run again leaves no second copy.
    """

    def write(batch: DataFrame, number: int) -> None:
        job(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return pages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
