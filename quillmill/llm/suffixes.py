"""Removal of repeated byte strings by distributed prefix doubling over sampled positions.

Positions get names: equal names mean equal strings from there on. In a task, names of 1, 2, 4, 8, 16, 32 bytes come
from pairs of names at growing offsets, as in prefix doubling, with 64-bit hashes in the place of dense ranks. Between
tasks, Spark sorts positions by name twice, and positions whose name is unique drop out.

* At GRAM bytes only sampled positions are sorted. Every string of ``span`` bytes is charged to the least name of GRAM
  bytes in it; consecutive strings with one least name form a run, and a run is one row. Equal strings have the same
  least name, so a run whose name is in no other document is settled, and most are.
* At ``span`` bytes, the pair of names at offsets 0 and span - 32, what is left is sorted string by string. Runs that
  are byte for byte the same wherever their name occurs need no second look: all their strings repeat.
"""

from __future__ import annotations

import gc
import time
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmill.llm._util import forget, stored

#: Bytes of the first name, from WHOLE to 2 * WHOLE: longer names are rarer by chance, shorter ones need fewer samples.
GRAM, WHOLE = 24, 16
#: Bytes that are named at a time.
BYTES_AT_ONCE = 1 << 20
_NAMES = np.random.default_rng(5).integers(1, 1 << 63, 256, dtype=np.uint64)
LARGEST = np.uint64(0xFFFFFFFFFFFFFFFF)


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The name of two names in this order."""
    x = a * np.uint64(0x9E3779B97F4A7C15) + b
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return x


def _longer(names: np.ndarray, offset: int) -> np.ndarray:
    """Names of pairs at an offset; ``offset`` fewer than there were."""
    return _pair(names[: len(names) - offset], names[offset:])


def names_of(data: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The names of GRAM and of ``size`` bytes (more than GRAM) from each place on."""
    names = _NAMES[data]
    length = 1
    while length < WHOLE:
        names, length = _longer(names, length), 2 * length
    gram = _longer(names, GRAM - WHOLE)
    while 2 * length <= size:
        names, length = _longer(names, length), 2 * length
    return gram, _longer(names, size - length) if size > length else names


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each ``width`` consecutive values."""
    size = 1
    while 2 * size <= width:
        values, size = np.minimum(values[: len(values) - size], values[size:]), 2 * size
    rest = width - size
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def runs_of(texts: list[bytes], span: int) -> tuple[np.ndarray, ...]:
    """Of each run: its text, first string, strings, least name, and the name of all its bytes."""
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    lengths = np.array([len(t) for t in texts])
    begin = np.cumsum(lengths) - lengths
    none = tuple(np.zeros(0, dtype=t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    if len(data) < span:
        return none
    text = np.repeat(np.arange(len(texts)), lengths)
    gram, whole = names_of(data, span)
    least = _least(gram, span - GRAM + 1)  # strings that cross texts are left out below
    n = len(whole)
    inside = text[:n] == text[span - 1 : span - 1 + n]
    fresh = inside.copy()
    fresh[1:] &= (least[1:n] != least[: n - 1]) | (text[1:n] != text[: n - 1])
    first = np.flatnonzero(fresh)
    if not len(first):
        return none
    at = np.flatnonzero(inside)
    count = np.diff(np.append(np.searchsorted(at, first), len(at)))
    place = np.arange(len(at)) - np.repeat(np.searchsorted(at, first), count)
    unit = np.add.reduceat(_pair(whole[at], (place.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)), np.searchsorted(at, first))
    owner = text[first]
    return owner, first - begin[owner], count, least[first], _pair(unit, count.astype(np.uint64))


def _portions(texts: list[bytes]) -> Iterator[tuple[int, list[bytes]]]:
    """Consecutive texts of about BYTES_AT_ONCE at most, or one text, with the number of the first."""
    at = 0
    while at < len(texts):
        to, size = at + 1, len(texts[at])
        while to < len(texts) and size + len(texts[to]) <= BYTES_AT_ONCE:
            size += len(texts[to])
            to += 1
        yield at, texts[at:to]
        at = to


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _meeting(rows: DataFrame, span: int) -> DataFrame:
    """(doc, part, run, unit, same): runs whose least name is in other documents too.

    rows: doc, part and data (the bytes). A document is (doc, part). A run is first string << 32 | strings. If same, the
    run is byte for byte the same wherever its name is, and a smaller document has it.
    """

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, part = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            with np.errstate(over="ignore"):
                for at, texts in _portions(batch.column(2).to_pylist()):
                    owner, first, count, name, unit = runs_of(texts, span)
                    run = (first << 32) | count
                    yield pa.RecordBatch.from_arrays([pa.array(doc[at + owner]), pa.array(part[at + owner]), pa.array(run), _signed(name), _signed(unit)], ["doc", "part", "run", "name", "unit"])

    # Names are counted and looked up on one exchange: Spark shares it between the two sides of the join if both ask for
    # the same columns of it, so the sides name them all, in conditions that always hold.
    sampled = rows.mapInArrow(sample, "doc long, part long, run long, name long, unit long").where(" and ".join(f"{c} is not null" for c in ("doc", "part", "run", "name", "unit"))).repartition("name")
    classes = sampled.groupBy("name").agg(F.min("doc").alias("first"), F.max("doc").alias("last"), F.min("unit").alias("unit_a"), F.max("unit").alias("unit_b"), F.max("run").alias("r"), F.max("part").alias("p"))
    classes = classes.where("first < last and r is not null and p is not null").select(F.col("name").alias("of_name"), "first", "unit_a", (F.col("unit_a") == F.col("unit_b")).alias("same"))
    return sampled.join(classes, F.expr("name = of_name and (not same or doc > first) and unit >= unit_a")).select("doc", "part", "run", "unit", "same")


def _lists(meeting: DataFrame) -> DataFrame:
    """(doc, part, settled, open) of meeting runs: a run that is also in a smaller document, byte for byte, is settled as well."""
    units = meeting.where("not same").groupBy("unit").agg(F.min("doc").alias("first")).select(F.col("unit").alias("of_unit"), "first")
    known = meeting.where("not same").join(units, F.col("unit") == F.col("of_unit")).select("doc", "part", "run", (F.col("doc") > F.col("first")).alias("same"))
    rows = known.unionByName(meeting.where("same").select("doc", "part", "run", "same"))
    return rows.groupBy("doc", "part").agg(F.collect_list(F.when(F.col("same"), F.col("run"))).alias("settled"), F.collect_list(F.when(~F.col("same"), F.col("run"))).alias("open"))


def _covered(rows: DataFrame, lists: DataFrame, span: int) -> DataFrame:
    """(c_doc, c_part, runs): the strings of each document that also start in a document of smaller ``doc``."""

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, part = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            wanted = batch.column(3).to_pylist()
            with np.errstate(over="ignore"):
                for at, texts in _portions(batch.column(2).to_pylist()):
                    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
                    lengths = np.array([len(t) for t in texts])
                    begin = np.cumsum(lengths) - lengths
                    runs = [np.array(wanted[at + i], dtype=np.int64) for i in range(len(texts))]
                    owner = np.repeat(np.arange(len(texts)), [len(r) for r in runs])
                    flat = np.concatenate(runs)
                    first, count = flat >> 32, flat & 0xFFFFFFFF
                    place = np.repeat(first, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                    of = np.repeat(owner, count)
                    name = names_of(data, span)[1][begin[of] + place]
                    yield pa.RecordBatch.from_arrays([pa.array(doc[at + of]), pa.array(part[at + of]), pa.array(place), _signed(name)], ["doc", "part", "start", "name"])

    still = lists.where(F.size("open") > 0).select(F.col("doc").alias("o_doc"), F.col("part").alias("o_part"), "open")
    ours = (F.col("doc") == F.col("o_doc")) & (F.col("part") == F.col("o_part"))
    single = rows.join(still, ours).select("doc", "part", "data", "open").mapInArrow(strings, "doc long, part long, start long, name long").where(" and ".join(f"{c} is not null" for c in ("doc", "part", "start", "name"))).repartition("name")
    firsts = single.groupBy("name").agg(F.min("doc").alias("first"), F.max("doc").alias("last"), F.max("start").alias("s"), F.max("part").alias("p"))
    firsts = firsts.where("first < last and s is not null and p is not null").select(F.col("name").alias("of_name"), "first")
    again = single.join(firsts, F.expr("name = of_name and doc > first")).select("doc", "part", F.shiftleft("start", 32).bitwiseOR(F.lit(1)).alias("run"))
    more = again.groupBy("doc", "part").agg(F.collect_list("run").alias("more")).select(F.col("doc").alias("m_doc"), F.col("part").alias("m_part"), "more")
    found = lists.select("doc", "part", "settled").join(more, (F.col("doc") == F.col("m_doc")) & (F.col("part") == F.col("m_part")), "left")
    return found.select(F.col("doc").alias("c_doc"), F.col("part").alias("c_part"), F.concat("settled", F.coalesce("more", F.array().cast("array<long>"))).alias("runs")).where(F.size("runs") > 0)


def _step(df: DataFrame) -> tuple[DataFrame, str]:
    """``stored``, after which Spark is asked to delete the shuffle files of what went before.

    Spark does that when the driver's JVM collects garbage, at least every half hour; here it does so at once, after
    Python has told the JVM which frames it no longer holds (which it does a moment later).
    """
    spark, out = df.sparkSession, stored(df)
    del df
    gc.collect()
    time.sleep(1)
    spark.sparkContext._jvm.System.gc()
    time.sleep(1)
    return out


def remove_repeats(docs: DataFrame, span: int = 50) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept (binary) of every document.

    A byte is removed if a string of ``span`` bytes that covers it also starts in a document of smaller doc_id. All
    strings are judged on the input; overlaps count; nothing crosses documents. n_spans counts maximal removed stretches;
    kept holds the bytes that stay, in order.

    Texts are UTF-8 bytes; null is empty. Rows without a doc_id come after all others and remove nothing from each
    other; rows that repeat a doc_id don't either, and each is judged by its own text. An empty table gives no rows, and
    other columns are ignored. Names are 64-bit hashes, so two unequal strings count as equal about once in 10**19 pairs.

    Cost: one row of 40 bytes for about 15 bytes of text is sorted first; the texts are shuffled twice, next to the
    lists of what is open and of what is removed. Hot names are pre-aggregated or split as skewed joins.
    """
    if not 2 * WHOLE <= span <= 4 * WHOLE:
        raise ValueError(f"span must be {2 * WHOLE} to {4 * WHOLE}")
    text = F.coalesce(F.col("text"), F.lit(""))
    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1))
    repeated = docs.groupBy(doc.alias("doc")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count() > 0
    part = F.xxhash64(text) if repeated else F.lit(0).cast("long")
    rows = docs.select(doc.alias("doc"), part.alias("part"), text.cast("binary").alias("data"))
    long_enough = rows.where(F.octet_length("data") >= span)
    # each step is written as a table, so that its shuffle files can go before the next makes its own
    meeting, first = _step(_meeting(long_enough, span))
    lists, second = _step(_lists(meeting))
    forget(docs.sparkSession, first)
    covered, _ = _step(_covered(long_enough, lists, span))
    forget(docs.sparkSession, second)

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for data, runs in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                edges = np.zeros(len(data) + 1, dtype=np.int64)
                flat = np.array(runs or [], dtype=np.int64)
                np.add.at(edges, flat >> 32, 1)
                np.add.at(edges, (flat >> 32) + (flat & 0xFFFFFFFF) - 1 + span, -1)
                gone = np.cumsum(edges)[:-1] > 0
                spans = int(np.count_nonzero(np.diff(gone.astype(np.int8), prepend=np.int8(0)) == 1))
                kept = np.frombuffer(data, dtype=np.uint8)[~gone].tobytes() if spans else data
                out.append((len(data), int(gone.sum()), spans, kept))
            columns = list(zip(*out, strict=True)) if out else [[], [], [], []]
            types = [pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    ours = (F.col("doc") == F.col("c_doc")) & (F.col("part") == F.col("c_part"))
    joined = docs.select(F.col("doc_id").cast("long").alias("doc_id"), doc.alias("doc"), part.alias("part"), text.cast("binary").alias("data")).join(covered, ours, "left")
    return joined.select("doc_id", "data", "runs").mapInArrow(cut_out, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
