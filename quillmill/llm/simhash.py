"""SimHash near-duplicates by covering locality-sensitive hashing."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmill.llm._util import apart, cut
from quillmill.llm.components import components

#: A-Z to a-z.
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
#: Fingerprints of a bucket that are compared each with each at most.
BUCKET = 64
#: Shingles whose bits are unpacked at a time (64 bytes each).
SHINGLES_AT_ONCE = 1 << 18


def shingle_hashes(text: str | None, words: int) -> list[int]:
    """XXH64 (seed 42) of each run of ``words`` words, of the whole sequence if there are fewer, of nothing if none."""
    parts = (text or "").encode().translate(LOWER).split()  # bytes split at 0x20 and 0x09 to 0x0D
    if not parts:
        return []
    line = b" ".join(parts)
    if len(parts) <= words:
        return [xxhash.xxh64_intdigest(line, 42)]
    ends = np.cumsum([len(p) + 1 for p in parts]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest = xxhash.xxh64_intdigest
    return [digest(line[a:b], 42) for a, b in zip(starts[: len(parts) - words + 1].tolist(), ends[words - 1 :].tolist(), strict=True)]


def majority(hashes: np.ndarray) -> np.uint64:
    """The bits that are set in over half of the hashes; 0 without any."""
    bits = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), SHINGLES_AT_ONCE):
        part = hashes[at : at + SHINGLES_AT_ONCE]
        bits += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(bits * 2 > len(hashes), bitorder="little").view(np.uint64)[0]


def fingerprint_texts(texts: list[str | None], words: int) -> np.ndarray:
    """The 64-bit fingerprint of each text: bits that are set in over half the shingles' hashes; 0 without words."""
    return np.array([majority(np.array(shingle_hashes(text, words), dtype=np.uint64)) for text in texts], dtype=np.uint64)


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long) of every document."""

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = fingerprint_texts(batch.column(1).to_pylist(), words)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text")).mapInArrow(marked, "doc_id long, fp long")


def covering_masks(radius: int) -> list[int]:
    """2 ** (radius + 1) - 1 bit masks of which, for any ``radius`` bits, at least one keeps none of them.

    Bit i carries a vector of radius + 1 bits other than zero; the mask of a vector v keeps the bits whose vectors have
    odd inner product with v. Radius vectors never span the space, so some v is orthogonal to all of them (Pagh, 2016).
    """
    size = 1 << (radius + 1)
    carried = [i % (size - 1) + 1 for i in range(64)]
    masks = [sum(1 << i for i in range(64) if (carried[i] & v).bit_count() & 1) for v in range(1, size)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def ball(radius: int) -> list[int]:
    """All bit patterns of at most ``radius`` set bits, as signed longs."""
    patterns = [sum(1 << i for i in bits) for n in range(radius + 1) for bits in combinations(range(64), n)]
    return [p - (1 << 64) if p >> 63 else p for p in patterns]


def links(prints: DataFrame, radius: int = 2) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (``fp``) that join exactly what pairs at most ``radius`` apart join.

    Covering hashing: each fingerprint goes to one bucket of every table, under its masked bits, and every pair within the
    radius meets in a bucket. In a bucket of up to BUCKET fingerprints each is compared with each, so a fingerprint makes
    BUCKET comparisons a table at most. The members of larger buckets are split by further masks instead: each goes to all
    centres at most half the radius away (a mask for every few bits left out, and exactly those within the radius share
    one), and all of a centre are linked to the least of them, without listing pairs. A centre has no more such members
    than there are patterns of so few bits, whatever the data are.
    """
    if radius not in (2, 4):
        raise ValueError("radius must be 2 or 4")
    spots = prints.select("fp", F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for t, m in enumerate(covering_masks(radius))])).alias("spot")).select("fp", "spot.t", "spot.key")
    sizes = spots.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("t").alias("of_t"), F.col("key").alias("of_key"), "n")
    meeting = cut(spots.join(sizes, F.expr("t = of_t and key = of_key")).select("fp", "t", "key", (F.col("n") > BUCKET).alias("large")))
    few = meeting.where("not large").select("fp", "t", "key")
    one, other = (few.toDF(f"{x}", f"{x}_t", f"{x}_key") for x in "ab")
    near = one.join(other, F.expr(f"a_t = b_t and a_key = b_key and a > b and bit_count(a ^ b) <= {radius}")).select("a", "b")
    many = meeting.where("large").select("fp").distinct()
    spread = many.select("fp", F.explode(F.array(*[F.lit(p) for p in ball(radius // 2)])).alias("step")).select("fp", F.col("fp").bitwiseXOR(F.col("step")).alias("centre"))
    groups = spread.groupBy("centre").agg(F.collect_set("fp").alias("members")).where(F.size("members") > 1)
    stars = groups.select(F.explode("members").alias("a"), F.array_min("members").alias("b")).where("a != b")
    return near.union(stars).distinct()


def near_duplicates(docs: DataFrame, words: int = 3, radius: int = 2) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every document.

    Documents whose fingerprints differ in at most ``radius`` bits are linked; component_id is the smallest doc_id that
    links reach. Equal fingerprints are one node, so any number of copies costs one row each and no pairs.

    Null and empty texts, and texts without words, have fingerprint zero and are linked like any other. Rows without a
    doc_id belong to components but don't name them (null if no other member does). Repeated rows come out as often as
    they came in; an empty table gives no rows; other columns are ignored.
    """
    out = grouped(cut(fingerprints(docs, words)), lambda nodes: links(nodes.select("fp"), radius))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def grouped(prints: DataFrame, link: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """doc_id, fp and component_id of the rows of ``prints``; ``link`` gives the edges between the distinct ``fp``.

    Other columns of ``prints`` follow from fp, and ``link`` has them too. ``prints`` is read several times.
    """
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("least_id"), *[F.min(c).alias(c) for c in prints.columns if c not in ("doc_id", "fp")])
    roots = components(link(nodes))
    named = roots.join(nodes, roots["node"] == nodes["fp"]).select("node", "root", "least_id")
    least = named.groupBy("root").agg(F.min("least_id").alias("root_id"))
    linked = named.join(least, "root").select(F.col("node"), "root_id")
    known = nodes.join(linked, nodes["fp"] == linked["node"], "left").select(F.col("fp").alias("of_fp"), F.coalesce("root_id", "least_id").alias("component_id"))
    return prints.join(known, prints["fp"] == known["of_fp"]).select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, words: int = 5, radius: int = 2) -> DataFrame:
    """The rows of ``docs`` (all columns) that ``near_duplicates`` names: of each component the one of smallest doc_id.

    Rows that repeat a doc_id with the same text count as one document, and one of them stays. Components in which no
    row has a doc_id keep their rows.
    """
    return keep_least(docs, near_duplicates(docs, words, radius))


def keep_least(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id is the component_id that ``found`` gives them, as in ``keep_one``."""
    stays = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("stays"))
    counted = cut(stays.groupBy("stays").agg(F.count(F.lit(1)).alias("n")))
    rows, of, back = apart(docs)
    out = rows.join(counted.select("stays"), of("doc_id").eqNullSafe(F.col("stays")), "left_semi")
    if counted.where("n > 1 and stays is not null").limit(1).count():
        # rows without a doc_id are no repeats of each other
        key = F.when(of("doc_id").isNull(), F.monotonically_increasing_id())
        out = out.withColumns({"of_id": of("doc_id"), "of_text": of("text"), "of_row": key}).dropDuplicates(["of_id", "of_text", "of_row"])
    return out.select(*back)
