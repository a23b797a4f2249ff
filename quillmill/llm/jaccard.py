"""Near-duplicates by the SimHash fingerprints of word shingles, checked and completed by exact Jaccard similarity (prefix filters)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmill.llm._util import cut, forget, pieces, stored, tidy
from quillmill.llm.components import components
from quillmill.llm.simhash import LOWER, grouped, keep_least, links, majority

#: Which shingles are frequent is estimated from one in so many documents; it decides the order of shingles, never which pairs are found.
ORDER_SAMPLE = 32
#: A shingle is frequent if so many sampled documents have it; at most so many of the most frequent are told to all tasks.
FREQUENT, MOST_FREQUENT = 8, 100_000
#: Turns of hubs at most, and the pairs for each row under which the rest is compared at once.
HUBS, PAIRS_A_ROW = 2, 8
#: Min-hashes that tell which hubs are worth a look, how many must agree, and the hubs that a set is held against in a turn.
SKETCH, AGREE, TRIES = 8, 5, 2
_TURNS = np.random.default_rng(3).integers(1, 1 << 63, SKETCH, dtype=np.uint64) | np.uint64(1)
#: Bits in which fingerprints differ at most that name a pair at once.
RADIUS = 2
#: Words whose hashes a worker remembers.
WORDS_AT_ONCE = 1 << 16
_MIX = np.uint64(0xD6E8FEB86659FD93)
#: Longs of the parity bits of a set.
PARITIES = 8
#: Ids that are broadcast at most.
IDS_AT_ONCE = 1 << 20
#: Names of sets that a task remembers as told.
ROWS_AT_ONCE = 1 << 17


class _Words(dict):
    """XXH64 of words, remembered unless they are long."""

    def __missing__(self, word: bytes) -> int:
        digest = xxhash.xxh64_intdigest(word, 42)
        if len(word) <= 32:
            self[word] = digest
        return digest


_words = _Words()


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """The distinct 64-bit hashes, ascending, of each run of ``words`` words, of the whole sequence if there are fewer; none without words.

    Words are those of ``simhash.shingle_hashes``; a run's hash mixes those of its words in order.
    """
    parts = (text or "").encode().translate(LOWER).split()
    if len(_words) > WORDS_AT_ONCE:
        _words.clear()
    single = np.fromiter(map(_words.__getitem__, parts), np.uint64, len(parts))
    runs = max(len(parts) - words + 1, min(len(parts), 1))
    mixed = np.zeros(runs, dtype=np.uint64)
    for i in range(min(words, len(parts))):
        mixed += single[i : i + runs]
        mixed = (mixed ^ (mixed >> np.uint64(32))) * _MIX
    return np.unique(mixed ^ (mixed >> np.uint64(29)))


def set_name(hashes: np.ndarray) -> int:
    """XXH64 of a set as a signed long, so that equal sets are one node."""
    name = xxhash.xxh64_intdigest(hashes.tobytes(), 42)
    return name - (1 << 64) if name >> 63 else name


def prefix_length(n: int, similarity: tuple[int, int]) -> int:
    """How many first elements of a set of n, in any fixed order, must meet those of each set at least so similar."""
    num, den = similarity
    return n - -(-num * n // den) + 1 if n else 0


def sketch(hashes: np.ndarray) -> np.ndarray:
    """The least of a set in each of SKETCH orders (min-hashes, 32 bits of each): like sets agree in most."""
    out = np.zeros(SKETCH, dtype=np.int32)
    if not len(hashes):
        return out
    for i, turn in enumerate(_TURNS):
        x = hashes * turn
        out[i] = (x ^ (x >> np.uint64(32))).min() & np.uint64(0x7FFFFFFF)
    return out


def parities(hashes: np.ndarray) -> np.ndarray:
    """For each value of a hash's low bits whether an odd number of the set have it: two sets differ in no fewer members than bits."""
    odd = np.bincount((hashes % np.uint64(64 * PARITIES)).astype(np.int64), minlength=64 * PARITIES) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))


def frequent(docs: DataFrame, words: int) -> np.ndarray:
    """The shingles that many sampled documents have, rarest first. A bounded list, whatever the table is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in batch.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(shingle_set(t.as_py(), words).view(np.int64))], ["key"])

    sampled = docs.select("text").where(F.pmod(F.xxhash64("text"), F.lit(ORDER_SAMPLE)) == 0)
    counts = sampled.mapInArrow(run, "key long").groupBy("key").count().where(F.col("count") >= FREQUENT)
    rows = counts.orderBy(F.desc("count"), "key").limit(MOST_FREQUENT).collect()
    return np.array([r["key"] for r in reversed(rows)], dtype=np.int64).view(np.uint64)


def described(docs: DataFrame, words: int, similarity: tuple[int, int], last: np.ndarray) -> DataFrame:
    """doc_id, fp, sim, sk, bits, n and first of every document: name, SimHash, sketch, parities and size of its shingle set, and the shingles that come
    first in an order with ``last`` after all others. Copies of a set that a task has told already have no ``first``."""
    values, rank = np.sort(last), np.argsort(last, kind="stable")

    def lists(arrays: list[np.ndarray], kind: type) -> pa.ListArray:
        ends = np.cumsum([0, *[len(x) for x in arrays]]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, dtype=kind), *arrays])))

    def first_of(hashes: np.ndarray) -> np.ndarray:
        size = prefix_length(len(hashes), similarity)
        if not len(values):
            return hashes[:size].view(np.int64)
        spot = np.minimum(np.searchsorted(values, hashes), len(values) - 1)
        place = np.where(values[spot] == hashes, rank[spot] + 1, 0)
        return hashes[np.argsort(place, kind="stable")[:size]].view(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told: set[int] = set()
        none = np.zeros(0, dtype=np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                names, sims, sketches, bits, sizes, firsts = [], [], [], [], [], []
                for text in part.column(1):
                    hashes = shingle_set(text.as_py(), words)
                    name = set_name(hashes)
                    names.append(name)
                    sims.append(majority(hashes))
                    sizes.append(len(hashes))
                    sketches.append(sketch(hashes))
                    bits.append(parities(hashes))
                    firsts.append(none if name in told else first_of(hashes))
                    if len(told) < ROWS_AT_ONCE:
                        told.add(name)
                columns = [part.column(0), pa.array(names, pa.int64()), pa.array(np.array(sims, dtype=np.uint64).view(np.int64)), lists(sketches, np.int32), lists(bits, np.int64), pa.array(sizes, pa.int32()), lists(firsts, np.int64)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "fp", "sim", "sk", "bits", "n", "first"])

    return _texts(docs).mapInArrow(run, "doc_id long, fp long, sim long, sk array<int>, bits array<long>, n int, first array<long>")


def sets_of(docs: DataFrame, words: int) -> DataFrame:
    """fp and hashes of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                found = [shingle_set(t.as_py(), words) for t in batch.column(0).slice(at, 256)]
                ends = np.cumsum([0, *[len(x) for x in found]]).astype(np.int32)
                flat = pa.array(np.concatenate(found).view(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array([set_name(x) for x in found], pa.int64()), pa.ListArray.from_arrays(pa.array(ends), flat)], ["fp", "hashes"])

    return docs.select("text").mapInArrow(run, "fp long, hashes array<long>")


#: The bits in which the parities of sets a and b differ.
APART = " + ".join(f"bit_count(a_bits[{i}] ^ b_bits[{i}])" for i in range(PARITIES))


def alike(similarity: tuple[int, int]) -> str:
    """Whether sets a and b may be so similar, by the bits in which their parities differ."""
    num, den = similarity
    return f"(a_n + b_n - ({APART})) * {num + den} >= (a_n + b_n) * {2 * num}"


def by_fingerprint(nodes: DataFrame, similarity: tuple[int, int], radius: int = RADIUS) -> DataFrame:
    """Pairs (a, b) of sets whose SimHash fingerprints are at most ``radius`` apart, by the covering hashing of ``simhash.links``.

    ``nodes``: fp, sim, n and bits, one row a set. The least set of a fingerprint stands for it: the others of it are paired with it, and
    it with those of near fingerprints. Pairs that sizes or parities rule out go; of the rest each set has its TRIES likest.
    """
    num, den = similarity
    faces = nodes.groupBy("sim").agg(F.min("fp").alias("face"))
    same = nodes.select("fp", "sim").join(faces, "sim").where("fp != face").select(F.col("fp").alias("a"), F.col("face").alias("b"))
    a, b = (faces.select(F.col("sim").alias(f"{x}_sim"), F.col("face").alias(x)) for x in "ab")
    close = links(faces.select(F.col("sim").alias("fp")), radius).toDF("a_sim", "b_sim")
    pairs = same.union(close.join(a, "a_sim").join(b, "b_sim").select("a", "b"))
    a, b = (nodes.select(F.col("fp").alias(x), F.col("n").alias(f"{x}_n"), F.col("bits").alias(f"{x}_bits")) for x in "ab")
    fit = pairs.join(a, "a").join(b, "b").where(F.expr(f"a_n * {den} >= b_n * {num} and b_n * {den} >= a_n * {num} and {alike(similarity)}"))
    likest = fit.groupBy("a").agg(F.slice(F.sort_array(F.collect_set(F.struct(F.expr(APART).alias("d"), "b"))), 1, TRIES).alias("found"))
    return likest.select("a", F.explode("found.b").alias("b"))


def keep_one(docs: DataFrame, words: int = 5, similarity: tuple[int, int] = (4, 5)) -> DataFrame:
    """The rows of ``docs`` (all columns) that ``similar`` names: of each component the one of smallest doc_id.

    Rows that repeat a doc_id and components without one are as in ``simhash.keep_one``.
    """
    return keep_least(docs, similar(docs, words, similarity))


def similar(docs: DataFrame, words: int = 5, similarity: tuple[int, int] = (4, 5)) -> DataFrame:
    """doc_id, fp (the name of its shingle set) and component_id of every document.

    Documents whose sets of ``words``-word shingles have a Jaccard similarity of at least ``similarity`` (numerator and
    denominator) are linked; component_id is the smallest doc_id that links reach. Equal sets are one node; texts
    without words have the empty set. Shingles are their 64-bit hashes.

    First the sets whose SimHash fingerprints are at most RADIUS bits apart are paired by covering hashing (``simhash.links``), and those that
    whole sets confirm are joined. Fingerprints can't promise a similarity, so the links between what they left apart are found exactly:
    two sets so similar share one of their first few shingles in any fixed order (Chaudhuri et al., 2006), so every such
    pair meets under a key; frequent shingles come last in the order, and so are seldom keys. Each set that meets another one apart is
    held against hubs: under each key the set whose min-hashes most others share, as far as sketches tell that it is like
    it. That joins a group of near copies without listing its pairs; hubs picked by a hash follow if many pairs would be left. Then all pairs
    that meet and aren't joined yet are compared, if the places and the number of their common keys and the parity bits in which
    they differ leave room for the similarity. Every link
    is verified by the intersection of whole sets.
    """
    num, den = similarity
    if not 0 < num < den:
        raise ValueError("similarity must be over 0 and under 1")

    spark = docs.sparkSession
    told, told_path = stored(described(docs, words, similarity, frequent(docs, words)))
    # what has a few short rows a document takes no more tasks than that needs
    few = pieces(TRIES * told.count())

    def link(nodes: DataFrame) -> DataFrame:
        nodes, nodes_path = stored(nodes.coalesce(few))
        paths = [nodes_path]
        group = Window.partitionBy("key")
        spots = told.select("fp", "n", F.posexplode("first").alias("at", "key")).repartition("key")
        shared = spots.withColumns({"least": F.min("fp").over(group), "most": F.max("fp").over(group)}).where("least != most")
        met = shared.select("key", "fp", "n", "at").dropDuplicates(["key", "fp"])
        # the middle of a group of near copies shares the most min-hashes with others
        faces = met.select("fp").distinct().join(nodes.select("fp", "sk"), "fp").select("fp", F.posexplode("sk").alias("i", "v"))
        common = faces.groupBy("i", "v").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select(F.col("i").alias("of_i"), F.col("v").alias("of_v"), "m")
        known = faces.join(common, F.expr("i = of_i and v = of_v")).groupBy("fp").agg(F.sum("m").alias("known"))
        meeting, path = stored(met.join(nodes.select("fp", "sk"), "fp").join(known, "fp", "left").fillna(0, ["known"]))
        paths.append(path)
        tidy(spark)

        def fits(a: str, b: str) -> Column:
            # what lies before and after a shared shingle bounds the shingles that both sets have
            most = f"least({a}_at, {b}_at) + least({a}_n - {a}_at, {b}_n - {b}_at)"
            return F.expr(f"{a}_n * {den} >= {b}_n * {num} and {b}_n * {den} >= {a}_n * {num} and ({most}) * {num + den} >= ({a}_n + {b}_n) * {num}")

        def verified(pairs: DataFrame) -> DataFrame:
            pairs = cut(pairs.coalesce(few))
            named = cut(nodes.join(pairs.select(F.explode(F.array("a", "b")).alias("fp")), "fp", "left_semi").select("fp", F.col("least_id").alias("of_id")).coalesce(few))
            ids = named.select("of_id").distinct()
            small = F.broadcast if named.count() <= IDS_AT_ONCE else lambda df: df
            held = _texts(docs).join(small(ids), F.col("doc_id").eqNullSafe(F.col("of_id")), "left_semi")
            sets, sets_path = stored(sets_of(held, words).join(small(named.select("fp")), "fp", "left_semi").dropDuplicates(["fp"]))
            a, b = (sets.select(F.col("fp").alias(f"{x}_fp"), F.col("hashes").alias(f"{x}_hashes")) for x in "ab")
            both = pairs.join(a, F.col("a") == F.col("a_fp")).join(b, F.col("b") == F.col("b_fp"))
            enough = F.size(F.array_intersect("a_hashes", "b_hashes")) * (num + den) >= (F.size("a_hashes") + F.size("b_hashes")) * num
            similar_ones = cut(both.where(enough).select("a", "b"))
            forget(spark, sets_path)
            tidy(spark)
            return similar_ones

        def apart(roots: DataFrame) -> tuple[DataFrame, str]:
            """What meets under keys with several components, as a table."""
            rest = meeting.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
            return stored(rest.withColumns({"least": F.min("root").over(group), "most": F.max("root").over(group)}).where("least != most").drop("least", "most"))

        linked = verified(by_fingerprint(nodes, similarity))
        rest, path = apart(components(linked).withColumnRenamed("node", "fp"))
        paths.append(path)
        for turn in range(HUBS):
            best = F.xxhash64("fp", "key", F.lit(turn)) if turn else F.struct(-F.col("known"), "fp")
            hub = F.min_by(F.struct("fp", "n", "root", "sk"), best).over(group)
            tried = rest.withColumn("h", hub).where(F.expr(f"root != h.root and n * {den} >= h.n * {num} and h.n * {den} >= n * {num}"))
            agree = F.aggregate(F.zip_with("sk", "h.sk", lambda x, y: (x == y).cast("int")), F.lit(0), lambda t, x: t + x)
            tried = tried.select(F.col("fp").alias("a"), F.col("h.fp").alias("b"), agree.alias("c")).where(F.col("c") >= AGREE)
            tried = tried.groupBy("a").agg(F.slice(F.sort_array(F.collect_set(F.struct("c", "b")), asc=False), 1, TRIES).alias("hubs"))
            linked = linked.union(verified(tried.select("a", F.explode("hubs.b").alias("b"))))
            rest, path = apart(components(linked).withColumnRenamed("node", "fp"))
            paths.append(path)
            # pairs left under all keys: those of all rows less those of one component
            left = rest.groupBy("key", "root").agg(F.count(F.lit(1)).alias("m")).groupBy("key").agg(((F.sum("m") ** 2 - F.sum(F.col("m") ** 2)) / 2).alias("p"))
            if (left.agg(F.sum("p")).first()[0] or 0) <= PAIRS_A_ROW * rest.count():
                break
        rest, path = stored(rest.select("key", "fp", "n", "at", "root").join(nodes.select("fp", "bits"), "fp"))
        paths.append(path)
        a, b = (rest.select(F.col("key").alias(f"{x}_key"), F.col("fp").alias(x), *[F.col(c).alias(f"{x}_{c}") for c in ("n", "at", "root", "bits")]) for x in "ab")
        met = a.join(b, (F.col("a_key") == F.col("b_key")) & F.expr("a < b and a_root != b_root") & fits("a", "b") & F.expr(alike(similarity)))
        # both prefixes hold all common shingles up to where the first of them ends, and one set has no more than its rest beyond
        beyond = [f"({n} * {num} + {den - 1}) div {den} - 1" for n in ("a_n", "b_n")]
        met = met.groupBy("a", "b", "a_n", "b_n").agg(F.count(F.lit(1)).alias("c"))
        far = verified(met.where(F.expr(f"(c + greatest({beyond[0]}, {beyond[1]})) * {num + den} >= (a_n + b_n) * {num}")).select("a", "b"))
        for path in paths:
            forget(spark, path)
        return linked.union(far)

    out = cut(grouped(told.select("doc_id", "fp", "sim", "sk", "bits", "n"), link))
    forget(spark, told_path)
    return out
