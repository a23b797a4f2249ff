"""Rules over ordered rows: first occurrences, islands, packing, slots and retries."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmill.sources.shared import shared_folder


def first_of_each(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in order."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_n", n).where("_n = 1").drop("_n")


def islands(rows: DataFrame, key: str, order: list[str], group: str, size: str, limit: int) -> DataFrame:
    """Adds island, island_size and atomic: consecutive rows of one group are a unit that stays whole if it fits the limit."""
    w = Window.partitionBy(key).orderBy(*order)
    new = F.lag(group).over(w).isNull() | (F.lag(group).over(w) != F.col(group))
    rows = rows.withColumn("_new", new.cast("int")).withColumn("island", F.sum("_new").over(w)).drop("_new")
    rows = rows.withColumn("island_size", F.sum(F.greatest(F.col(size), F.lit(1))).over(Window.partitionBy(key, "island")))
    return rows.withColumn("atomic", F.col("island_size") <= limit)


#: Rows of a key that are followed through in one array.
STRETCH = 1024


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _exits(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Of each row of a stretch, where the pointers from there leave it (0: nowhere)."""
    for first, pointers in batches:
        found = []
        for begin, to in zip(first, pointers, strict=True):
            out = [0] * len(to)
            for i in range(len(to) - 1, -1, -1):
                inside = to[i] - begin
                out[i] = out[inside] if to[i] and inside < len(to) else to[i]
            found.append(out)
        yield pd.Series(found, index=first.index, dtype=object)


@F.pandas_udf(T.ArrayType(T.BooleanType()))
def _walked(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Which rows of a stretch the pointers reach from its entry (null: none)."""
    for first, pointers, entry in batches:
        found = []
        for begin, to, at in zip(first, pointers, entry, strict=True):
            out = [False] * len(to)
            at = 0 if pd.isna(at) else int(at)
            while at and at - begin < len(to):
                out[at - begin] = True
                at = to[at - begin]
            found.append(out)
        yield pd.Series(found, index=first.index, dtype=object)


def reached(rows: DataFrame, key: str, at: str, to: str, source: DataFrame) -> DataFrame:
    """Adds opens: whether a row is reached from its key's first row by pointers to later rows.

    ``at`` numbers the rows of a key from 1 without gaps; ``to`` is the number a row points to (null: none). A key is followed
    in stretches of 1024 rows, none of which depends on another: of each row of a stretch it is known where the pointers leave
    it. Keys of more than one stretch go through these exits by pointer doubling, as many joins as their number of stretches has
    binary digits; where all keys are shorter there is none. So no key is ever one row or one array. Keys are not null.
    ``source`` has the same keys as often, without what the rows were given by windows, and so counts them at little cost.
    """
    others = [c for c in rows.columns if c != key]
    rows = rows.withColumn(to, F.coalesce(to, F.lit(0)).cast("int")).withColumn(at, F.col(at).cast("int"))
    block = lambda c: F.floor((F.col(c) - 1) / STRETCH)
    steps = F.array_sort(F.collect_list(F.struct(at, *[c for c in others if c != at])))
    blocks = rows.groupBy(key, block(at).alias("_block")).agg(steps.alias("_steps"))
    blocks = blocks.select(key, "_block", "_steps", F.col("_steps")[0][at].alias("_first"), F.transform("_steps", lambda s: s[to]).alias("_to"))
    long = source.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > STRETCH).select(key)
    if long.isEmpty():
        blocks = blocks.withColumn("_entry", F.lit(1))
    else:
        shared_folder(rows.sparkSession, "reached")  # checkpoints go there
        exits = blocks.join(long, key, "left_semi").select(key, "_first", F.posexplode(_exits("_first", "_to")).alias("_i", "_then"))
        jumps = exits.where("_then > 0").select(key, (F.col("_first") + F.col("_i")).alias("_at"), "_then").checkpoint()
        entries = long.select(key, F.lit(1).alias("_at")).checkpoint()
        while not jumps.isEmpty():
            entries = entries.unionByName(entries.join(jumps, [key, "_at"]).select(key, F.col("_then").alias("_at"))).checkpoint()
            further = jumps.select(key, F.col("_at").alias("_then"), F.col("_then").alias("_beyond"))
            jumps = jumps.join(further, [key, "_then"]).select(key, "_at", F.col("_beyond").alias("_then")).checkpoint()
        entries = entries.select(key, block("_at").alias("_block"), F.col("_at").alias("_entry"))
        blocks = blocks.join(entries, [key, "_block"], "left")
        blocks = blocks.withColumn("_entry", F.when(F.col("_block") == 0, 1).otherwise(F.col("_entry")))
    out = blocks.select(key, F.explode(F.arrays_zip("_steps", _walked("_first", "_to", F.col("_entry").cast("int")).alias("_opens"))).alias("_x"))
    return out.select(key, *[F.col(f"_x._steps.{c}").alias(c) for c in others], F.col("_x._opens").alias("opens"))


def pack(rows: DataFrame, key: str, order: list[str], size: str, limit: int) -> DataFrame:
    """(key, order..., size, part): first fit in order; a row that no longer fits opens the next part. Empty rows count as 1.

    The sum starts anew with each part, so it is no running sum. But a part that starts at a row ends where the sum of all
    rows before has grown by more than the limit, which a window over these sums finds for each row; parts are the rows
    reached by these pointers.
    """
    w = Window.partitionBy(key).orderBy(*order)
    source = rows.select(key)
    rows = rows.select(key, *order, size, F.greatest(F.col(size), F.lit(1)).cast("long").alias("_size"), F.row_number().over(w).alias("_at"))
    rows = rows.withColumn("_before", F.sum("_size").over(w) - F.col("_size"))
    near = Window.partitionBy(key).orderBy("_before").rangeBetween(Window.unboundedPreceding, limit)
    rows = rows.withColumn("_last", F.count(F.lit(1)).over(near)).withColumn("_end", F.last(F.col("_before") + F.col("_size")).over(near))
    # the last row that starts within the limit ends beyond it, or there is no more
    rows = rows.withColumn("_to", F.when(F.col("_end") > F.col("_before") + limit, F.greatest("_last", F.col("_at") + 1)))
    more = F.lead("_at").over(w).isNull() & (F.col("_to") > F.col("_at"))
    rows = rows.withColumn("_to", F.when(~more, F.col("_to"))).drop("_before", "_last", "_end", "_size")
    out = reached(rows, key, "_at", "_to", source)
    part = F.sum(F.col("opens").cast("int")).over(Window.partitionBy(key).orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)) - 1
    return out.select(key, *order, size, part.cast("int").alias("part"))


def slots(rows: DataFrame, order: list[str], arrival: str, gap: int, block: int) -> DataFrame:
    """Adds start: the time at which each row may go if rows are at least ``gap`` apart.

    start of row i = max over j <= i of (arrival of j + (i - j) * gap). One sequence holds all rows, so it is scanned in blocks
    of time: each block knows its rows and its own maximum, a scan over the blocks carries both on, and rows are ordered only
    within their block. ``order`` begins with ``arrival``; ``block`` is in the same unit.
    """
    rows = rows.withColumn("_block", F.floor(F.col(arrival) / block))
    own = Window.partitionBy("_block").orderBy(*order)
    rows = rows.withColumn("_i", F.row_number().over(own))
    rows = rows.withColumn("_most", F.max(F.col(arrival) - F.col("_i") * gap).over(own.rowsBetween(Window.unboundedPreceding, 0)))
    blocks = rows.groupBy("_block").agg(F.count(F.lit(1)).alias("_n"), F.max(F.col(arrival) - F.col("_i") * gap).alias("_top"))
    earlier = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)  # one row for each block of time
    blocks = blocks.withColumn("_offset", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    blocks = blocks.select(F.col("_block").alias("_of"), "_offset", F.max(F.col("_top") - F.col("_offset") * gap).over(earlier).alias("_carry"))
    rows = rows.join(blocks, F.col("_block") == F.col("_of"))
    start = F.greatest("_carry", F.col("_most") - F.col("_offset") * gap) + (F.col("_i") + F.col("_offset")) * gap
    return rows.withColumn("start", start).drop("_block", "_of", "_i", "_most", "_offset", "_carry")


def retries(rows: DataFrame, key: list[str], order: list[str], outcome: str, most: int, final: list[str], wait: int) -> DataFrame:
    """(key..., attempts, waited, outcome) of attempts in order: stops at success, at a final failure, or after ``most``."""
    w = Window.partitionBy(*key).orderBy(*order)
    stop = F.col(outcome).isin(["SUCCESS", *final])
    rows = rows.withColumn("_n", F.row_number().over(w)).withColumn("_stopped", F.coalesce(F.max(stop.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rows = rows.where((F.col("_n") <= most) & (F.col("_stopped") == 0))
    waits = F.sum(F.when(~stop & (F.col("_n") < most), F.col("_n") * wait).otherwise(0))
    return rows.groupBy(*key).agg(F.count(F.lit(1)).alias("attempts"), waits.alias("waited"), F.max_by(outcome, "_n").alias("outcome"))


def throttle(rows: DataFrame, key: str, time: str, order: str, window: int) -> DataFrame:
    """(key, opened, fires, absorbed): the first row of a key opens a window; rows inside it are absorbed; it fires at its end.

    Whether a row opens a window depends on the window before it. Each row points to the first one beyond the window it would
    open; those reached from the first row are the ones that do.
    """
    w = Window.partitionBy(key).orderBy(time, order)
    source = rows.select(key)
    rows = rows.select(key, time, order, F.row_number().over(w).alias("_at"))
    inside = F.count(F.lit(1)).over(Window.partitionBy(key).orderBy(time).rangeBetween(Window.unboundedPreceding, window))
    total = F.count(F.lit(1)).over(Window.partitionBy(key))
    rows = rows.withColumn("_next", inside + 1).withColumn("_to", F.when(F.col("_next") <= total, F.col("_next"))).drop("_next")
    out = reached(rows, key, "_at", "_to", source)
    opened = F.last(F.when(F.col("opens"), F.col(time)), ignorenulls=True).over(Window.partitionBy(key).orderBy("_at").rowsBetween(Window.unboundedPreceding, 0))
    out = out.withColumn("opened", opened).groupBy(key, "opened").agg(F.count_if(~F.col("opens")).alias("absorbed"))
    return out.select(key, "opened", (F.col("opened") + window).alias("fires"), "absorbed")


def sessions(rows: DataFrame, key: str, time: str, order: list[str], gap: int) -> DataFrame:
    """Adds session: a row joins the session of its key's row before it if no more than ``gap`` has passed, else opens the next."""
    w = Window.partitionBy(key).orderBy(time, *order)
    new = F.lag(time).over(w).isNull() | (F.col(time) - F.lag(time).over(w) > gap)
    return rows.withColumn("_new", new.cast("int")).withColumn("session", F.sum("_new").over(w)).drop("_new")


def image_limit(asked: Column, most: int = 200) -> Column:
    """How many images are kept: whole, from 0 to ``most``; what is no number or negative is 0."""
    return F.when(asked.isNull() | F.isnan(asked) | (asked < 0), 0).otherwise(F.floor(F.least(asked, F.lit(float(most))))).cast("int")
