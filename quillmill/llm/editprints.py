"""Document fingerprints by a randomised edit embedding.

A walk reads a text: at each step it emits the character under it and, as a random bit of (step, character) says, stays or
goes on. All texts share the bits. Equal stretches are read in step until an edit; past one, walks that fell out of step meet
again by chance, so that the number of steps at which two walks emit different characters grows with the edit distance and
not with the length. Past its end a text emits a character of its own.

A fingerprint samples this: of the steps [2^k - 1, 2^(k + 1) - 1) it takes ``SAMPLES`` for each k (all, where there are no
more), and of each character one bit by a function of that step. So it covers the whole walk, grows with the logarithm of the
text, and texts of any lengths compare: samples stand for equally many steps each, and the share of equal bits gives back the
share of steps that agree (1/2 of the bits agree by chance).

``near_pairs`` bands these bits: texts that agree in all bits of a band are compared by fingerprint, and what is like enough is
verified by its edit distance.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmill.llm._util import forget, stored

#: Steps after which the random bits of the walk repeat.
STEPS = 1 << 12
#: Bits of a fingerprint for each doubling of the walk.
SAMPLES = 128
#: Doublings that are ever needed: texts of 2^46 characters.
SCALES = 48
#: Characters are told apart up to so many; the first half is ASCII. The one after them stands for the end.
CLASSES = 256
#: Rows of a block when large bands are compared block by block.
BLOCK = 256
SEED = 11


def _bits(shape: tuple[int, ...], stream: int) -> np.ndarray:
    n = int(np.prod(shape))
    raw = np.random.Philox(key=[SEED, stream]).random_raw((n + 63) // 64)
    return np.unpackbits(raw.view(np.uint8))[:n].reshape(shape)


@cache
def _stays() -> list[bytes]:
    """For each step and character, for how many steps the walk emits it from there on."""
    goes = _bits((STEPS, CLASSES), 0)
    stay = np.zeros((STEPS, CLASSES), dtype=np.uint8)
    ahead = np.full(CLASSES, 255, dtype=np.int64)
    for step in [*range(STEPS - 1, -1, -1)] * 2:  # twice, as the bits repeat
        ahead = np.where(goes[step] == 1, 1, np.minimum(ahead + 1, 255))
        stay[step] = ahead
    return [row.tobytes() for row in stay]


@cache
def _sampled() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sampled steps, scale by scale and ascending; the bit of each character at each; where each scale's samples start."""
    steps = []
    for k in range(SCALES):
        first, width = (1 << k) - 1, 1 << k
        if width <= SAMPLES:
            steps.append(np.arange(first, first + width))
        else:
            steps.append(first + np.sort((np.random.Philox(key=[SEED, 2 + k]).random_raw(SAMPLES) % np.uint64(width)).astype(np.int64)))
    return np.concatenate(steps), _bits((sum(map(len, steps)), CLASSES + 1), 1), np.cumsum([0, *map(len, steps)])


def _codes(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
    return np.where(points < 128, points, 128 + (points * np.uint32(2654435761) >> np.uint32(25))).astype(np.uint8)


class Print:
    """The walk over a text, and its fingerprint: the steps of the walk and the sampled bits."""

    __slots__ = ("bits", "codes", "end", "starts")

    def __init__(self, codes: np.ndarray, begun: Print | None = None, kept: int = 0) -> None:
        """``begun`` has walked the first ``kept`` characters already."""
        stays, mask = _stays(), STEPS - 1
        step = 0 if begun is None else int(begun.starts[kept]) if kept < len(begun.starts) else begun.end
        starts = []
        note = starts.append
        for c in codes[kept:].tobytes():
            note(step)
            step += stays[step & mask][c]
        own = np.array(starts, dtype=np.int64)
        self.codes, self.end = codes, step
        self.starts = own if begun is None else np.concatenate([begun.starts[:kept], own])
        steps, table, begin = _sampled()
        n = int(begin[step.bit_length()])
        seen = np.full(n, CLASSES, dtype=np.int64)
        inside = int(np.searchsorted(steps[:n], step))
        if inside:
            seen[:inside] = codes[np.searchsorted(self.starts, steps[:inside], side="right") - 1]
        self.bits = table[np.arange(n), seen]

    def packed(self) -> bytes:
        return np.array([self.end], dtype=">i8").tobytes() + np.packbits(self.bits).tobytes()


def unpacked(print_: bytes) -> tuple[int, np.ndarray]:
    end = int.from_bytes(print_[:8], "big")
    return end, np.unpackbits(np.frombuffer(print_[8:], dtype=np.uint8))[: int(_sampled()[2][end.bit_length()])]


@cache
def _weights(end: int) -> np.ndarray:
    """The steps below ``end`` that each sample stands for, as a share."""
    steps, _, begin = _sampled()
    out = np.zeros(int(begin[end.bit_length()]))
    for k in range(end.bit_length()):
        a, b = int(begin[k]), int(begin[k + 1])
        n = int(np.searchsorted(steps[a:b], end))
        if n:
            out[a : a + n] = (min((2 << k) - 1, end) - ((1 << k) - 1)) / n
    return out / max(1.0, out.sum())


def likeness(end_a: int, a: np.ndarray, end_b: int, b: np.ndarray) -> float:
    """0 to 1: the share of steps, of the longer walk, at which two walks emit the same, corrected for bits equal by chance."""
    if end_a == end_b and np.array_equal(a, b):
        return 1.0
    if end_a < end_b:
        end_a, a, end_b, b = end_b, b, end_a, a
    table = _sampled()[1]
    b = np.concatenate([b, table[len(b) : len(a), CLASSES]])
    return float(min(1.0, max(0.0, 2 * (_weights_of(end_a) @ (a == b)) - 1)))


def _weights_of(end: int) -> np.ndarray:
    if _weights.cache_info().currsize > 4096:
        _weights.cache_clear()
    return _weights(end)


def _compared(doc_id: int | None, text: str, own: Print, following: str, other: Print) -> tuple:
    n, third = len(text), len(text) // 3
    codes = np.concatenate([own.codes[: n - third], other.codes[:third]])
    edited = Print(codes, own, n - third)
    digest = hashlib.sha256((text[: n - third] + following[:third]).encode()).digest()
    near = [likeness(own.end, own.bits, x.end, x.bits) for x in (edited, other)]
    return doc_id, n, digest, own.packed(), edited.packed(), *near


_FIELDS = [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited", pa.binary()), ("print", pa.binary()), ("edited_print", pa.binary()), ("near_edited", pa.float64()), ("near_next", pa.float64())]
_SCHEMA = "doc_id long, n_chars long, edited binary, print binary, edited_print binary, near_edited double, near_next double"


def _batch(rows: list[tuple], more: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    fields = [*_FIELDS, *more]
    columns = zip(*rows, strict=True) if rows else [[]] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(list(c), type=t) for c, (_, t) in zip(columns, fields, strict=True)], [name for name, _ in fields])


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row of a sorted partition with the next one; its first row and its last come out with their texts instead."""
    part = TaskContext.get().partitionId()
    more = [("part", pa.int64()), ("role", pa.string()), ("text", pa.string())]
    last: tuple | None = None
    for batch in batches:
        rows: list[tuple] = []
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            text = text.as_py()
            own = Print(_codes(text))
            if last is None:
                rows.append((doc_id, *[None] * 6, part, "first", text))
            else:
                rows.append((*_compared(*last, text, own), part, "done", None))
            last = doc_id, text, own
        yield _batch(rows, more)
    if last is not None:
        yield _batch([(last[0], *[None] * 6, part, "last", last[1])], more)


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, text and the next text of rows whose next one is in another partition."""
    for batch in batches:
        rows = []
        for doc_id, text, following in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            rows.append(_compared(doc_id, text, Print(_codes(text)), following, Print(_codes(following))))
        yield _batch(rows, [])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars and ``print`` of every ``text`` (binary; for ``likeness`` by way of ``unpacked``), without a shuffle.

    Null text is empty; rows that repeat stay; equal texts have equal prints; other columns are ignored.
    """

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.as_py() for t in batch.column(1)]
            prints = [Print(_codes(t)).packed() for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(t) for t in texts], type=pa.int64()), pa.array(prints, type=pa.binary())], ["doc_id", "n_chars", "print"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return rows.mapInArrow(made, "doc_id long, n_chars long, print binary")


def against_next(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likenesses.

    Rows follow each other by descending doc_id (null last; equal ones by a hash of the text); after the last comes the first.
    The edited text has its last third (floor of code points) replaced by as many first code points, or all, of the next text.
    Returns doc_id, n_chars, edited (SHA-256 of the edited text), print, edited_print, near_edited and near_next: the likeness
    of a text's print to that of its edited text and to that of the next text. Null text is empty; two empty texts are alike
    (1). Rows that repeat are rows of their own; a lone row is its own next; other columns are ignored; no rows give none.

    Texts are dealt by ranges of doc_id once. What is left over are two rows of each partition, which are joined by the
    partition's number; only these numbers, as many as there are partitions, pass through one task.
    """
    order = [F.desc_nulls_last("doc_id"), F.asc("hash"), F.asc("row")]  # the row's number deals out rows that repeat
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    rows = rows.select("doc_id", "text", F.xxhash64("text").alias("hash"), F.monotonically_increasing_id().alias("row"))
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    table, path = stored(rows.mapInArrow(_neighbours, f"{_SCHEMA}, part long, role string, text string"))
    names = [name for name, _ in _FIELDS]
    firsts = table.where("role = 'first'").select(F.col("part").alias("at"), F.col("text").alias("following"))
    ring = firsts.select("at")
    ring = ring.select("at", F.coalesce(F.lead("at").over(Window.orderBy("at")), F.min("at").over(Window.partitionBy())).alias("then"))
    lasts = table.where("role = 'last'").select("doc_id", "text", "part")
    lasts = lasts.join(ring, lasts.part == ring["at"]).select("doc_id", "text", "then")
    across = lasts.join(firsts, lasts.then == firsts["at"]).select("doc_id", "text", "following")
    out, _ = stored(table.where("role = 'done'").select(*names).unionByName(across.mapInArrow(_across, _SCHEMA)))
    forget(docs.sparkSession, path)
    return out


def edit_distance(a: str, b: str) -> int:
    """Edit distance by bit-parallel columns, in Python's long integers."""
    if len(a) < len(b):
        a, b = b, a
    if not b:
        return len(a)
    seen: dict[str, int] = {}
    for i, c in enumerate(b):
        seen[c] = seen.get(c, 0) | 1 << i
    mask, high = (1 << len(b)) - 1, 1 << len(b) - 1
    up, down, score = mask, 0, len(b)
    for c in a:
        equal = seen.get(c, 0)
        across = (((equal & up) + up) ^ up) | equal
        plus, minus = down | ~(across | up) & mask, up & across
        score += bool(plus & high) - bool(minus & high)
        plus = (plus << 1 | 1) & mask
        minus = minus << 1 & mask
        equal |= down
        up, down = minus | ~(equal | plus) & mask, plus & equal
    return score


@cache
def _bands(level: int, bands: int, bits: int) -> np.ndarray:
    """Samples of each band at a level: drawn like steps below 2^level - 1."""
    steps, _, begin = _sampled()
    dice = np.random.Generator(np.random.Philox(key=[SEED, 1000 + level]))
    scale = np.minimum(level - 1, (np.log2(dice.integers(1, 1 << level, (bands, bits)))).astype(int))
    return begin[scale] + (dice.random((bands, bits)) * (begin[scale + 1] - begin[scale])).astype(int)


def near_pairs(docs: DataFrame, least: float = 0.8, bands: int = 48, bits: int = 8, alike: float = 0.15) -> DataFrame:
    """Pairs of different texts whose edit distance is at most 1 - ``least`` of the longer one's length, as banding finds them.

    ``docs``: doc_id (of one text each) and text, not null. Returns a, b (the smallest doc_id of each text, a < b) and distance. A pair meets with a
    probability of 1 - (1 - p^bits)^bands, where p is its share of equal bits; those whose prints are ``alike`` are verified by
    their edit distance, so no pair is wrong, but pairs are missed whose walks stay out of step for long after an edit. Equal texts are one. Levels of two lengths a text are banded, so that lengths on both
    sides of a power of two meet. Bands of many texts are cut into blocks, which are compared two by two.
    """
    texts = docs.groupBy("text").agg(F.min("doc_id").alias("doc_id"))
    table, path = stored(fingerprints(texts).join(texts, "doc_id").select("doc_id", "text", "print"))

    def banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = [], []
            for doc_id, print_ in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                end, own = unpacked(print_)
                for level in range(max(1, end.bit_length() - 2), max(2, end.bit_length())):
                    if (1 << level) - 1 <= end:
                        for i, key in enumerate(np.packbits(own[_bands(level, bands, bits)], axis=1)):
                            ids.append(doc_id)
                            keys.append(f"{level}.{i}." + key.tobytes().hex())
            yield pa.RecordBatch.from_arrays([pa.array(ids, type=pa.int64()), pa.array(keys, type=pa.string())], ["doc_id", "key"])

    rows = table.select("doc_id", "print").mapInArrow(banded, "doc_id long, key string")
    sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    rows = rows.join(sizes, "key").withColumn("own", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("key", "doc_id", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("top"), "own")
    rows = rows.join(table.select("doc_id", "print"), "doc_id")

    def met(key: tuple, group: pa.Table) -> pa.Table:
        ids, prints, own = group["doc_id"].to_pylist(), [unpacked(p) for p in group["print"].to_pylist()], group["own"].to_pylist()
        found = [
            (min(ids[i], ids[j]), max(ids[i], ids[j]))
            for i in range(len(ids))
            for j in range(i)
            if (own[i] != own[j] or key[1] == key[2]) and likeness(*prints[i], *prints[j]) >= alike
        ]
        return pa.table({"a": pa.array([x for x, _ in found], type=pa.int64()), "b": pa.array([y for _, y in found], type=pa.int64())})

    pairs = rows.groupBy("key", "low", "top").applyInArrow(met, "a long, b long").distinct()
    a, b = (table.select(F.col("doc_id").alias(c), F.col("text").alias(f"text_{c}")) for c in ("a", "b"))

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [(x, y, d) for x, y, s, t in zip(*(c.to_pylist() for c in batch.columns), strict=True) if (d := edit_distance(s, t)) <= (1 - least) * max(len(s), len(t)) + 1e-9]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in kept], type=pa.int64()) for i in range(3)], ["a", "b", "distance"])

    out, _ = stored(pairs.join(a, "a").join(b, "b").select("a", "b", "text_a", "text_b").mapInArrow(verified, "a long, b long, distance long"))
    forget(docs.sparkSession, path)
    return out
