from __future__ import annotations

import itertools

import numpy as np

from quillmill.llm import neighbours
from quillmill.llm.neighbours import Tables, nearest, rotate

SCHEMA = "vec_id long, embedding array<float>, label int, score double, t int"


def table(spark, vectors):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 1, 0.5, 7) for i, v in vectors], SCHEMA)


def brute(vectors, queries, k):
    out = {}
    data = {i: np.array(v, dtype=np.float32).astype(np.float64) for i, v in vectors}
    for q in queries:
        scores = sorted((-float((data[q] * v).sum()), i) for i, v in data.items() if i != q)[:k]
        out[q] = [i for _, i in scores]
    return out


def test_rotation_keeps_lengths():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(20, 16))
    y = rotate(x, rng.choice([-1.0, 1.0], (3, 16)))
    assert np.allclose(x @ x.T, y @ y.T)


def test_probes_are_all_cells_within_reach():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(5, 4))
    for functions in (1, 2, 3):
        index = Tables(4, 2, functions, 5)
        for (t, row, first, rests, offsets), turned in zip(index.probes(x, 0.9), index.turned(x), strict=True):
            got = {(int(row[i]), int(first[i]), int(r)) for i in range(len(row)) for r in rests[offsets[i] : offsets[i + 1]]}
            real = set()
            for i in range(len(x)):
                for cell in itertools.product(range(8), repeat=functions):
                    if sum(y[i].max() - y[i][c] for y, c in zip(turned, cell, strict=True)) <= 0.9:
                        rest = 0
                        for c in cell[1:]:
                            rest = rest * 8 + c
                        real.add((i, cell[0], rest))
            assert got == real and t in (0, 1)
        cells = list(index.cells(x))
        assert all((f, r) in {(int(a), int(b)) for a, b in zip(*c, strict=True)} for c in cells for f, r in zip(*c, strict=True))


def test_recall_and_exact_scores(spark):
    rng = np.random.default_rng(2)
    vectors = [(i, v) for i, v in enumerate(rng.normal(size=(1500, 32)) * rng.uniform(0.5, 2, (1500, 1)))]
    df = table(spark, vectors)
    rows = nearest(df, df.where("vec_id % 20 = 0"), k=10).collect()
    real = brute(vectors, range(0, 1500, 20), 10)
    got = {q: [r["vec_id"] for r in sorted((r for r in rows if r["query_id"] == q), key=lambda r: r["rank"])] for q in real}
    assert sum(len(set(got[q]) & set(real[q])) for q in real) >= 0.9 * 10 * len(real)
    data = {i: np.array(v, dtype=np.float32).astype(np.float64) for i, v in vectors}
    assert all(abs(r["score"] - float((data[r["query_id"]] * data[r["vec_id"]]).sum())) < 1e-12 for r in rows)


def test_hot_bucket_in_blocks(spark):
    vectors = [(i, [1.0, 2.0, 3.0, 4.0]) for i in range(300)] + [(i, [4.0, -1.0, 0.5, i / 100]) for i in range(300, 360)]
    df = table(spark, vectors)
    rows = nearest(df, df.where("vec_id % 20 = 0"), k=5, tables=4, recall=1.0, block_rows=32).collect()
    got = {}
    for r in sorted(rows, key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    assert got == brute(vectors, range(0, 360, 20), 5)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    odd = [(0, [1, 0, 0]), (1, [0.9, 0.1, 0]), (2, None), (3, [0, 0, 0]), (4, [nan, 1, 1]), (5, [inf, 1, 1]), (6, [None, 1, 1]), (7, [1, 2]), (None, [1, 1, 1]), (20, [1, 0, 0]), (20, [1, 0, 0]), (40, None)]
    df = table(spark, odd)
    rows = nearest(df, df.where("vec_id % 20 = 0"), k=3, tables=4).collect()
    assert {(r["query_id"], r["rank"], r["vec_id"]) for r in rows} == {(0, 1, 20), (0, 2, 1), (20, 1, 0), (20, 2, 1)}
    assert nearest(df.limit(0), df.limit(0)).count() == 0


def test_a_few_long_vectors(spark):
    rng = np.random.default_rng(4)
    rows = rng.normal(size=(40, 32))[rng.integers(0, 40, 1500)] + 0.5 * rng.normal(size=(1500, 32))
    rows /= np.linalg.norm(rows, axis=1, keepdims=True)
    rows[[7, 500, 901]] *= 40
    df = table(spark, list(enumerate(rows)))
    found = nearest(df, df.where("vec_id % 20 = 0"), k=10).collect()
    real = brute(list(enumerate(rows)), range(0, 1500, 20), 10)
    got = {q: {r["vec_id"] for r in found if r["query_id"] == q} for q in real}
    assert all(len(x) == 10 for x in got.values())
    assert sum(len(got[q] & set(real[q])) for q in real) >= 0.9 * 10 * len(real)


def test_too_few_in_the_buckets(spark):
    rng = np.random.default_rng(5)
    vectors = [(i, v) for i, v in enumerate(rng.normal(size=(200, 32)))]
    df = table(spark, vectors)
    rows = nearest(df, df.where("vec_id % 20 = 0"), k=30, tables=1, recall=0.0, block_rows=64).collect()
    got = {}
    for r in sorted(rows, key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    assert got == brute(vectors, range(0, 200, 20), 30)


def test_equal_vectors_and_queries(spark):
    vectors = [(i, [1.0, 1.0, 0.0]) for i in range(100)] + [(i, [1.0, i / 50, 0.5]) for i in range(100, 140)]
    df = table(spark, vectors)
    rows = nearest(df, df.where("vec_id % 20 = 0"), k=6, tables=4, recall=1.0).collect()
    got = {}
    for r in sorted(rows, key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    assert got == brute(vectors, range(0, 140, 20), 6)


def test_scored_share_falls_as_rows_grow():
    """The share of rows in the probed cells, at a reach that finds 95 of 100 real neighbours."""
    shares = []
    for n in (2_000, 10_000, 50_000):
        rng = np.random.default_rng(9)
        x = rng.normal(size=(n, 64))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        q = x[:60]
        score = q @ x.T
        score[np.arange(60), np.arange(60)] = -9
        real = np.argsort(-score, axis=1)[:, :20]
        index = Tables(64, 16, 2, 11)
        gaps = np.sort(index.gaps(np.repeat(q[:30], 20, axis=0), x[real[:30].ravel()]))
        reach = gaps[int(0.95 * len(gaps))]
        found = np.zeros((60, n), dtype=bool)
        for asked, (first, rest) in zip(index.turned(q), index.cells(x), strict=True):
            far = sum(a.max(axis=1, keepdims=True) - a[:, code] for a, code in zip(asked, (first, rest), strict=True))
            found |= far <= reach
        recall = np.take_along_axis(found[30:], real[30:], axis=1).mean()
        shares.append(found.mean())
        print(n, round(recall, 3), round(found.mean(), 3))
        assert recall >= 0.9
    assert shares[0] > 1.3 * shares[1] > 1.3**2 * shares[2]


def test_no_cell_is_met():
    from quillmill.llm.neighbours import _met

    q, c = np.ones((2, 3)), np.ones((4, 3))
    assert list(_met(q, np.zeros(2), c, np.array([1, 1, 5, 5]), np.array([2, 3, 7]), np.array([0, 2, 3]))) == []


def handed_on(spark, since):
    """Rows that co-grouped tasks have made in the queries from number ``since`` on."""
    store = spark._jsparkSession.sharedState().statusStore()
    spark._jsc.sc().listenerBus().waitUntilEmpty()
    made, of, executions = 0, since - 1, store.executionsList()
    for i in range(executions.size()):
        of = executions.apply(i).executionId()
        if of < since:
            continue
        values, nodes = store.executionMetrics(of), store.planGraph(of).allNodes()
        for j in range(nodes.size()):
            if "CoGroup" in nodes.apply(j).name():
                metrics = nodes.apply(j).metrics()
                for m in (metrics.apply(x) for x in range(metrics.size())):
                    if m.name() == "number of output rows" and values.contains(m.accumulatorId()):
                        made += int(values.apply(m.accumulatorId()).replace(",", ""))
    return made, of


def test_what_is_handed_on_grows_with_the_rows(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "SAMPLE_ROWS", 64)  # a weak bound, as of a large table
    made = []
    for n in (1000, 5000):
        x = np.random.default_rng(7).normal(size=(n, 32))
        df = table(spark, list(enumerate(x / np.linalg.norm(x, axis=1, keepdims=True))))
        since = handed_on(spark, 0)[1] + 1
        assert nearest(df, df.where("vec_id % 20 = 0"), k=5, tables=8, functions=2).count() == n // 20 * 5
        made.append(handed_on(spark, since)[0])
    print(made)
    assert 0 < made[1] <= 7 * made[0]
