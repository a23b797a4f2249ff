"""Approximate nearest neighbours by cross-polytope hashing.

A hash function turns a unit vector by a fast pseudo-rotation and takes its nearest signed axis. A table joins several
functions, more of them the more rows there are, so that its cells stay small. A row is stored in one cell of each table;
a query looks into all cells that are nearly as near to it as the nearest one. How near is fitted on a bounded sample of
queries, whose real neighbours are found first, so that the wanted share of neighbours is met whatever the data are.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmill.llm._util import cut, tidy

#: Norms that differ by a smaller share than this count as equal.
SAME_NORM = 1e-3
#: Norms under 2 ** -MOST_BANDS of the largest share one band.
MOST_BANDS = 64
#: Queries whose real neighbours are found to fit how far to probe, and rows that give each query a first bound.
SAMPLE_QUERIES, SAMPLE_ROWS = 96, 2048
#: Rows for each wanted neighbour that a query's nearest cells hand on, over all tables, to bound what the rest hands on.
FIRST_LOOK = 6
#: Up to so many dimensions a rotation is applied as a matrix.
MATRIX = 256
#: Pairs that are scored at a time.
PAIRS_AT_ONCE = 1 << 18


def rotate(x: np.ndarray, signs: np.ndarray) -> np.ndarray:
    """A pseudo-rotation of the rows of x: for each row of ``signs`` random sign flips and a fast Hadamard transform."""
    n, size = len(x), x.shape[1]
    for flip in signs:
        x = x * flip
        step = 1
        while step < size:
            pairs = x.reshape(n, size // (2 * step), 2, step)
            x = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(n, size)
            step *= 2
        x = x / np.sqrt(size)
    return x


@dataclass(frozen=True)
class Tables:
    """``tables`` tables of ``functions`` functions each. Axis i has code 2 * i, its opposite 2 * i + 1; a cell is the code of
    the first function and the codes of the others as one number."""

    size: int
    tables: int
    functions: int
    seed: int

    def turned(self, x: np.ndarray) -> Iterator[list[np.ndarray]]:
        """For each table the products of the rows of x with all signed axes of each function."""
        random = np.random.default_rng(self.seed)
        for _ in range(self.tables):
            out = []
            for _ in range(self.functions):
                signs = random.choice([-1.0, 1.0], (3, self.size))
                # few dimensions: the transform of the axes makes a matrix, which turns all rows at once
                y = x @ rotate(np.eye(self.size), signs) if self.size <= MATRIX else rotate(x, signs)
                out.append(np.stack([y, -y], axis=2).reshape(len(x), 2 * self.size))
            yield out

    def cells(self, x: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each table the cell of each row: the first code, and the others as one number."""
        for turned in self.turned(x):
            first, *others = [y.argmax(axis=1) for y in turned]
            rest = np.zeros(len(x), dtype=np.int64)
            for code in others:
                rest = rest * 2 * self.size + code
            yield first, rest

    def gaps(self, queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """How much farther than the nearest cell the cell of rows[i] is from queries[i], in the table where that is least."""
        least = np.full(len(queries), np.inf)
        for asked, stored in zip(self.turned(queries), self.turned(rows), strict=True):
            gap = sum(a.max(axis=1) - a[np.arange(len(a)), s.argmax(axis=1)] for a, s in zip(asked, stored, strict=True))
            least = np.minimum(least, gap)
        return least

    def probes(self, x: np.ndarray, reach: float, near: bool = False) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """For each table: its number; the rows and the first codes to look under; and the other codes of each, with offsets.

        Every cell is given whose gap is at most ``reach``; of ``near`` ones only those under the nearest first code.
        """
        for t, turned in enumerate(self.turned(x)):
            gaps = [y.max(axis=1, keepdims=True) - y for y in turned]
            row, first = np.nonzero(gaps[0] <= (0 if near else reach))
            rests, counts = [], []
            ends = np.searchsorted(row, np.arange(len(x) + 1))
            for i in range(len(x)):
                sums, codes = np.zeros(1), np.zeros(1, dtype=np.int64)
                for gap in gaps[1:]:
                    order = np.flatnonzero(gap[i] <= reach)
                    total = (sums[:, None] + gap[i][order]).ravel()
                    code = (codes[:, None] * 2 * self.size + order).ravel()
                    sums, codes = total[total <= reach], code[total <= reach]
                order = np.argsort(sums, kind="stable")
                sums, codes = sums[order], codes[order]
                found = np.searchsorted(sums, reach - gaps[0][i, first[ends[i] : ends[i + 1]]], side="right").tolist()
                rests.extend(codes[:n] for n in found)
                counts.extend(found)
            yield t, row, first, np.concatenate(rests) if rests else np.zeros(0, dtype=np.int64), np.cumsum([0, *counts])


def _exact(q: np.ndarray, c: np.ndarray, row: np.ndarray, col: np.ndarray) -> np.ndarray:
    """Inner products of q[row] and c[col], summed in order in double precision."""
    score = np.zeros(len(row))
    for d in range(q.shape[1]):
        score += q[row, d] * c[col, d]
    return score


def _first(row: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Which pairs are among the k best of their row, ties by smaller id."""
    order = np.lexsort((ids, -score, row))
    ordered = row[order]
    return order[np.arange(len(order)) - np.searchsorted(ordered, ordered) < k]


def best_of(q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, pairs: Iterator[tuple[np.ndarray, np.ndarray]], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the pairs (query, candidate) the k best of each query: query, candidate's id, exact score."""
    rows, cols = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
    for row, col in pairs:
        rows.append(row)
        cols.append(col)
    row, col = np.concatenate(rows), np.concatenate(cols)
    score = _exact(q, c, row, col)
    kept = _first(row, c_ids[col], score, k)
    return row[kept], c_ids[col[kept]], score[kept]


def _slack(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """By how much a product may be off that isn't summed in order."""
    return 1e-12 * np.linalg.norm(q, axis=1) * max(1e-300, float(np.linalg.norm(c, axis=1).max(initial=0)))


def _met(q: np.ndarray, least: np.ndarray, c: np.ndarray, rest: np.ndarray, wanted: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (query, candidate) that reach the query's bound, of the candidates in the cells that each query wants; cell by cell."""
    by_cell = np.argsort(rest, kind="stable")
    sorted_c, ordered = c[by_cell], rest[by_cell]
    cells, begins = np.unique(ordered, return_index=True)
    ends = np.append(begins[1:], len(ordered))
    query = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    spot = np.minimum(np.searchsorted(cells, wanted), len(cells) - 1)
    there = cells[spot] == wanted
    spot, query = spot[there], query[there]
    if not len(spot):
        return
    order = np.argsort(spot, kind="stable")
    spot, query = spot[order], query[order]
    bound = least - _slack(q, c)
    used, firsts = np.unique(spot, return_index=True)
    for cell, at, to in zip(used.tolist(), firsts.tolist(), [*firsts[1:].tolist(), len(spot)], strict=True):
        low, high = begins[cell], ends[cell]
        block = sorted_c[low:high]
        step = max(1, PAIRS_AT_ONCE // len(block))
        for first in range(at, to, step):
            asked = query[first : min(first + step, to)]
            row, col = np.nonzero(q[asked] @ block.T >= bound[asked][:, None])
            if len(row):
                yield asked[row], by_cell[low + col]


def _all(q: np.ndarray, c: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of every query with its k best rows of c, and what may be as good."""
    slack = _slack(q, c)
    step = max(1, PAIRS_AT_ONCE // max(1, len(c)))
    for at in range(0, len(q), step):
        rough = q[at : at + step] @ c.T
        bound = np.partition(rough, -k, axis=1)[:, -k] - slack[at : at + step] if len(c) > k else np.full(len(rough), -np.inf)
        row, col = np.nonzero(rough >= bound[:, None])
        yield at + row, col


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, tables: int = 16, functions: int | None = None, recall: float = 0.95, seed: int = 11, block_rows: int = 4096) -> DataFrame:
    """query_id, rank, vec_id and score of the ``k`` nearest rows of ``vectors`` found for each row of ``queries``.

    Both have vec_id and embedding; nearest means the largest inner product, and a row is no neighbour of its own vec_id.
    Every row goes to one cell of each table. A table has ``functions`` functions, by default as many as make about as
    many cells as there are rows. A query looks into all cells within a reach; what it finds is ranked by exact inner
    products of the original vectors, ties by smaller vec_id. If norms differ, vectors are hashed by bands of norms (each
    within a factor of two) in tables of their own, and one more coordinate makes all vectors of a band equally long,
    which turns the largest inner product into the smallest angle. A query probes the tables of every band.

    The reach is fitted: for SAMPLE_QUERIES queries the real neighbours are found by scoring all rows, and the reach is
    the least that finds a share of ``recall`` of them. All rows are in the tables; the sample only sets the reach.
    SAMPLE_ROWS rows give each query a bound that all its neighbours reach, so what is below it is never handed on. That bound gets weaker as rows
    grow, so queries look twice: first only under their nearest first code in each table, whose best few rows (FIRST_LOOK times k over all
    tables) give a bound that grows with the rows; then into all cells within reach, which hand on what reaches it. What is found doesn't change by that.

    Equal vectors are told apart only by vec_id, so of each vector the k + 1 least ids are stored, equal queries are asked
    once, and a vector that a third of the rows share makes no quadratic work. A query that finds fewer than k rows is
    answered by its exact inner products with all rows, in blocks. Rows and queries that share a table and a first code
    meet in one task; more than ``block_rows`` of either are cut into blocks by a hash of the id, and every block of the
    queries meets every block of the rows. The sizes of these groups are what is broadcast (tables x 2 x dimensions rows).

    Null, zero and non-finite vectors, those with null components, and those whose length isn't the most frequent one (they
    have no inner product with the others) take no part, as rows or as queries; nor do rows without an id. Rows that repeat a vec_id with other
    vectors count at their best; queries that repeat one are answered once. Empty tables give no rows.
    """
    kind = T.DoubleType() if isinstance(vectors.schema["embedding"].dataType.elementType, T.DoubleType) else T.FloatType()
    dtype = np.float64 if isinstance(kind, T.DoubleType) else np.float32

    def proper(df: DataFrame) -> DataFrame:
        df = df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(T.ArrayType(kind)).alias("embedding"))
        finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
        return df.where("vec_id is not null and embedding is not null and size(embedding) > 0").where(finite & F.exists("embedding", lambda x: x != 0))

    rows, asked = proper(vectors), proper(queries).dropDuplicates(["vec_id"])
    spark = vectors.sparkSession
    length = rows.groupBy(F.size("embedding").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").first()
    schema = "query_id long, rank int, vec_id long, score double"
    if length is None:
        return spark.createDataFrame([], schema)
    dims = length["d"]
    rows, asked = rows.where(F.size("embedding") == dims), asked.where(F.size("embedding") == dims)
    # of equal vectors only the least ids can be among the nearest
    place = F.row_number().over(Window.partitionBy("embedding").orderBy("vec_id"))
    rows = cut(rows.withColumn("place", place).where(F.col("place") <= k + 1).drop("place"))
    asked = asked.select("vec_id", F.col("embedding").alias("asked"))
    classes = cut(asked.groupBy("asked").agg(F.min("vec_id").alias("vec_id"))).select("vec_id", F.col("asked").alias("embedding"))

    square = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    most, least, n_rows = rows.agg(F.sqrt(F.max(square)), F.sqrt(F.min(square)), F.count(F.lit(1))).first()
    equal = least >= most * (1 - SAME_NORM)
    size = 1 << max(1, (dims + (not equal) - 1).bit_length())
    index = Tables(size, tables, functions or max(1, round(math.log(max(2, n_rows)) / math.log(2 * size))), seed)
    band = F.lit(0) if equal else F.coalesce(F.least(F.floor(F.log2(F.lit(most) / F.sqrt(square))), F.lit(MOST_BANDS)), F.lit(0)).cast("int")
    rows = rows.withColumn("band", band)
    tops = {0: most} if equal else {r["band"]: r["top"] for r in rows.groupBy("band").agg(F.sqrt(F.max(square)).alias("top")).collect()}

    def matrix(column: pa.Array) -> np.ndarray:
        return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims).astype(np.float64)

    def longer(x: np.ndarray, bands: np.ndarray | None = None) -> np.ndarray:
        """Rows of the tables' size: stored ones all as long as the largest of their band; queries of length 1."""
        out = np.zeros((len(x), size))
        out[:, :dims] = x
        if bands is None:
            return out / np.linalg.norm(out, axis=1, keepdims=True)
        if not equal:
            top = np.array([tops[b] for b in bands])
            out[:, dims] = np.sqrt(np.maximum(0, top**2 - (x**2).sum(axis=1)))
        return out

    # the reach, and the sample that bounds what is handed on
    by_hash = F.xxhash64("vec_id", F.lit("sample"))
    tried = classes.orderBy(by_hash, "vec_id").limit(SAMPLE_QUERIES).collect()
    sampled = rows.orderBy(by_hash, "vec_id").limit(SAMPLE_ROWS).collect()
    tried_x = np.array([r["embedding"] for r in tried], dtype=np.float64).reshape(-1, dims)
    shared = spark.sparkContext.broadcast((tried_x, np.array([r["embedding"] for r in sampled], dtype=np.float64).reshape(-1, dims)))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = shared.value[0]
        for batch in batches:
            c = matrix(batch.column(1))
            score = q @ c.T
            row, col = np.nonzero(score >= np.partition(score, -min(k + 1, len(c)), axis=1)[:, -min(k + 1, len(c))][:, None]) if len(c) and len(q) else (np.zeros(0, dtype=int),) * 2
            yield pa.RecordBatch.from_arrays([pa.array(row.astype(np.int32)), batch.column(0).take(pa.array(col)), batch.column(1).take(pa.array(col)), batch.column(2).take(pa.array(col)), pa.array(score[row, col] if len(row) else [], pa.float64())], ["q", "vec_id", "embedding", "band", "score"])

    top = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "vec_id"))
    real = rows.select("vec_id", "embedding", "band").mapInArrow(scored, f"q int, vec_id long, embedding array<{kind.simpleString()}>, band int, score double")
    real = [r for r in real.withColumn("top", top).where(F.col("top") <= k + 1).collect() if r["vec_id"] != tried[r["q"]]["vec_id"]]
    reach = 0.0
    if real and recall > 0:
        asked_x = longer(tried_x[[r["q"] for r in real]])
        gaps = np.sort(index.gaps(asked_x, longer(np.array([r["embedding"] for r in real], dtype=np.float64), np.array([r["band"] for r in real]))))
        reach = float(gaps[min(len(gaps) - 1, math.ceil(recall * len(gaps)) - 1)]) + 1e-9

    blob = lambda x: pa.array([v.tobytes() for v in x.astype(dtype)], pa.binary())

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, bands = matrix(batch.column(1)), batch.column(2).to_numpy()
                for t, (first, rest) in enumerate(index.cells(longer(x, bands))):
                    yield pa.RecordBatch.from_arrays([pa.array((bands * tables + t).astype(np.int32)), pa.array(first.astype(np.int32)), pa.array(rest), batch.column(0), blob(x)], ["t", "code", "rest", "vec_id", "v"])

    def probing(near: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, 512):
                    part = batch.slice(at, 512)
                    x = matrix(part.column(1))
                    bound = x @ shared.value[1].T
                    bound = np.partition(bound, -k - 1, axis=1)[:, -k - 1] if bound.shape[1] > k else np.full(len(x), -np.inf)
                    bound = np.maximum(bound - _slack(x, shared.value[1]), part.column(2).to_numpy(zero_copy_only=False))
                    blobs = blob(x)
                    for t, row, first, rests, offsets in index.probes(longer(x), reach, near):
                        lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(rests))
                        for b in tops:
                            taken = pa.array(row)
                            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(row), b * tables + t, dtype=np.int32)), pa.array(first.astype(np.int32)), lists, part.column(0).take(taken), blobs.take(taken), pa.array(bound[row])], ["t", "code", "rests", "vec_id", "v", "least"])

        return run

    def counted(parts: Iterator[tuple[int, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        for t, codes in parts:
            code, n = np.unique(codes, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(code), t, dtype=np.int32)), pa.array(code.astype(np.int32)), pa.array(n)], ["t", "code", "n"])

    def count_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                bands = batch.column(2).to_numpy()
                for t, (first, _) in enumerate(index.cells(longer(matrix(batch.column(1)), bands))):
                    yield from counted((b * tables + t, first[bands == b]) for b in np.unique(bands))

    def count_probes(near: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    for t, turned in enumerate(index.turned(longer(matrix(batch.column(1))))):
                        first = np.nonzero(turned[0].max(axis=1, keepdims=True) - turned[0] <= (0 if near else reach))[1]
                        yield from counted((b * tables + t, first) for b in tops)

        return run

    def sizes(df: DataFrame, name: str) -> DataFrame:
        count = df.groupBy("t", "code").agg(F.ceil(F.sum("n") / block_rows).cast("int").alias(name))
        return count.select(F.col("t").alias(f"{name}_t"), F.col("code").alias(f"{name}_code"), name)

    candidates = rows.mapInArrow(placed, "t int, code int, rest long, vec_id long, v binary")
    shape = "t int, code int, n long"
    c_sizes = cut(sizes(rows.mapInArrow(count_rows, shape), "c_blocks"))
    here = F.expr("t = g_t and code = g_code")
    block = lambda n, salt: F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    def meeting(asking: DataFrame, near: bool) -> tuple[DataFrame, DataFrame]:
        """Rows and queries (vec_id, embedding and the bound ``least``) by the groups that they meet in. ``most``: what a group hands on for a query."""
        wanted = asking.mapInArrow(probing(near), "t int, code int, rests array<long>, vec_id long, v binary, least double")
        grid = c_sizes.join(sizes(asking.mapInArrow(count_probes(near), shape), "q_blocks"), F.expr("c_blocks_t = q_blocks_t and c_blocks_code = q_blocks_code"))
        grid = F.broadcast(grid.select(F.col("c_blocks_t").alias("g_t"), F.col("c_blocks_code").alias("g_code"), "c_blocks", "q_blocks"))
        c = candidates.join(grid, here).select("t", "code", block("c_blocks", "c").alias("cb"), every("q_blocks").alias("qb"), "rest", "vec_id", "v")
        most = F.ceil(F.lit(-(-FIRST_LOOK * (k + 1) // tables)) / F.col("c_blocks")) if near else F.lit(k + 1)
        q = wanted.join(grid, here).select("t", "code", every("c_blocks").alias("cb"), block("q_blocks", "q").alias("qb"), "rests", "vec_id", "v", "least", most.cast("int").alias("most"))
        return c, q

    def ranked(left: pa.Table, right: pa.Table) -> pa.Table:
        names, types = ["query_id", "vec_id", "score"], [pa.int64(), pa.int64(), pa.float64()]
        if not left.num_rows or not right.num_rows:
            return pa.Table.from_arrays([pa.array([], t) for t in types], names)
        (c_ids, c), (q_ids, q) = [(t["vec_id"].to_numpy(), np.frombuffer(b"".join(t["v"].to_pylist()), dtype=dtype).reshape(-1, dims).astype(np.float64)) for t in (left, right)]
        most = k + 1
        if "rest" in left.column_names:
            most = right["most"][0].as_py()
            lists = right["rests"].combine_chunks()
            pairs = _met(q, right["least"].to_numpy(), c, left["rest"].to_numpy(), lists.flatten().to_numpy(), np.cumsum([0, *lists.value_lengths().to_numpy()]))
        else:
            pairs = _all(q, c, k + 1)
        row, ids, score = best_of(q, c_ids, c, pairs, most)
        return pa.Table.from_arrays([pa.array(q_ids[row]), pa.array(ids), pa.array(score)], names)

    def best(c: DataFrame, q: DataFrame, key: list[str]) -> DataFrame:
        found = c.groupBy(*key).cogroup(q.groupBy(*key)).applyInArrow(ranked, "query_id long, vec_id long, score double")
        once = found.repartition("query_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
        return once.withColumn("rank", rank).where(F.col("rank") <= k + 1)

    group = ["t", "code", "cb", "qb"]
    first = best(*meeting(classes.withColumn("least", F.lit(float("-inf"))), near=True), group)
    bounds = cut(first.where(F.col("rank") == k + 1).select(F.col("query_id").alias("of_id"), F.col("score").alias("least")))
    tidy(spark)
    bounded = classes.join(bounds, F.col("vec_id") == F.col("of_id"), "left").select("vec_id", "embedding", F.coalesce("least", F.lit(float("-inf"))).alias("least"))
    found = cut(best(*meeting(cut(bounded), near=False), group))
    full = found.where(F.col("rank") == min(k + 1, n_rows)).select(F.col("query_id").alias("full_id"))
    short = cut(classes.join(full, F.col("vec_id") == F.col("full_id"), "left_anti"))
    n_short = short.count()
    if n_short:
        pack = F.pandas_udf(lambda e: e.map(lambda v: np.asarray(v, dtype=dtype).tobytes()), "binary")
        c_blocks, q_blocks = F.lit(-(-n_rows // block_rows)), F.lit(-(-n_short // block_rows))
        all_c = rows.withColumns({"c_blocks": c_blocks, "q_blocks": q_blocks}).select(block("c_blocks", "c").alias("cb"), every("q_blocks").alias("qb"), "vec_id", pack("embedding").alias("v"))
        all_q = short.withColumns({"c_blocks": c_blocks, "q_blocks": q_blocks}).select(every("c_blocks").alias("cb"), block("q_blocks", "q").alias("qb"), "vec_id", pack("embedding").alias("v"))
        kept = found.join(short.select(F.col("vec_id").alias("short_id")), F.col("query_id") == F.col("short_id"), "left_anti")
        found = kept.unionByName(best(all_c, all_q, ["cb", "qb"]))
    # what a class has found, without the query itself; at most k + 1 rows a class
    lists = found.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "vec_id", "score"))).alias("found"))
    lists = lists.join(classes.select(F.col("vec_id").alias("class_id"), F.col("embedding").alias("of")), F.col("query_id") == F.col("class_id")).select("of", "found")
    own = asked.join(lists, F.col("asked") == F.col("of")).select(F.col("vec_id").alias("query_id"), "found")
    others = F.slice(F.filter("found", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    out = own.select("query_id", F.posexplode(others).alias("at", "x"))
    return out.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), "x.vec_id", "x.score")
