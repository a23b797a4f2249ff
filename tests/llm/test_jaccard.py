from __future__ import annotations

import collections
import random

import numpy as np

import corpus_pipeline
from quillmill.llm import jaccard, simhash
from quillmill.llm.components import components
from quillmill.llm.jaccard import PARITIES, keep_one, parities, prefix_length, shingle_set, similar
from tests.llm.cases import documents


def planted(seed=3):
    """Texts, copies with a few words changed, added or dropped, and a passage that many share."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    passage = rng.choices(words, k=40)
    texts = []
    for i in range(60):
        base = rng.choices(words, k=rng.randint(4, 260)) + (passage if i % 3 else [])
        texts.append(base)
        for _ in range(rng.randint(0, 4)):
            copy = list(base)
            for _ in range(rng.randint(1, max(1, len(base) // 22))):
                at = rng.randrange(len(copy))
                copy[at : at + rng.randint(0, 1)] = [rng.choice(words)] * rng.randint(0, 2)
            texts.append(copy)
    rng.shuffle(texts)
    return [(i, " ".join(t), "en", "a") for i, t in enumerate(texts)]


def brute(rows):
    """The least id that links of Jaccard 0.8 reach, and how many links there are."""
    sets = {i: set(shingle_set(t, 5).tolist()) for i, t, *_ in rows}
    root, n = {i: i for i in sets}, 0

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and (not sets[i] | sets[j] or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])):
                n += 1
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets}, n


def test_every_similar_pair_is_linked(spark, monkeypatch):
    rows = planted()
    real, n = brute(rows)
    assert n > 50
    docs = documents(spark, rows)
    stage = dict(corpus_pipeline.STAGES)["SimHash near-dedup"]
    assert {r["doc_id"] for r in stage(spark, docs, "").collect()} == set(real.values())
    monkeypatch.setattr(jaccard, "ORDER_SAMPLE", 1)  # now the shared passage comes last
    assert {r["doc_id"]: r["component_id"] for r in similar(docs).collect()} == real


def test_prefix_lengths_are_enough():
    for n in range(1, 200):
        for m in range(n, 5 * n // 4 + 1):
            common = -(-4 * (n + m) // 9)  # the least intersection of 0.8
            if common <= n:
                assert n - prefix_length(n, (4, 5)) < common and m - prefix_length(m, (4, 5)) < common


def test_odd_rows(spark):
    docs = documents(spark)
    kept = sorted(str(r["doc_id"]) for r in keep_one(docs).collect())
    assert kept == sorted(["1", "3", "5", "6", "7", "11", "None"])
    assert set(keep_one(docs).columns) == set(docs.columns) and keep_one(docs.limit(0)).count() == 0


def test_parities_never_exceed_the_difference():
    rng = np.random.default_rng(5)
    pool = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
    for size in (0, 1, 5, 100, 2000):
        a, b = (np.unique(rng.choice(pool, size)) if size else pool[:0] for _ in range(2))
        bits = sum(int(x).bit_count() for x in (parities(a) ^ parities(b)).view(np.uint64))
        assert len(parities(a)) == PARITIES and bits <= len(np.setxor1d(a, b))


def test_shingles_are_those_of_words():
    assert list(shingle_set("A b\tc", 5)) == list(shingle_set(" a B  C ", 5)) and len(shingle_set("a b c", 5)) == 1
    assert len(shingle_set("a b c d e f", 5)) == 2 and not len(shingle_set(" \n", 5)) and not len(shingle_set(None, 5))
    assert list(shingle_set("a b c d e", 5)) != list(shingle_set("b a c d e", 5))


def test_fingerprints_pair_first(spark, monkeypatch):
    rows = planted()
    named = {jaccard.set_name(shingle_set(t, 5)): simhash.majority(shingle_set(t, 5)) for _, t, *_ in rows}
    calls = []

    def recorded(nodes, similarity):
        pairs = jaccard.cut(real(nodes, similarity))
        calls.extend((r["a"], r["b"]) for r in pairs.collect())
        return pairs

    real = jaccard.by_fingerprint
    monkeypatch.setattr(jaccard, "by_fingerprint", recorded)
    stage = dict(corpus_pipeline.STAGES)["SimHash near-dedup"]
    assert {r["doc_id"] for r in stage(spark, documents(spark, rows), "").collect()} == set(brute(rows)[0].values())
    assert calls and all(a != b and int(named[a] ^ named[b]).bit_count() <= jaccard.RADIUS for a, b in calls)
    # a set has a pair for every near fingerprint, as far as sizes and parities allow; here two of them at most are kept
    assert max(collections.Counter(a for a, _ in calls).values()) <= jaccard.TRIES


def test_small_tables_take_few_tasks(spark):
    """However many shuffle partitions there are, a round over a few edges has a few tasks, and so leaves a few files."""
    edges = spark.createDataFrame([(i, i // 2) for i in range(1, 200)], "a long, b long").coalesce(1)
    held = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        spark.sparkContext.setJobGroup("few tasks", "")
        roots = {(r["node"], r["root"]) for r in components(edges).collect()}
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        for k, v in before.items():
            spark.conf.set(k, v)
    assert roots == {(i, 0) for i in range(200)}
    tracker = spark.sparkContext.statusTracker()
    stages = {s for j in tracker.getJobIdsForGroup("few tasks") for s in tracker.getJobInfo(j).stageIds}
    sizes = [x.numCompletedTasks for s in stages if (x := tracker.getStageInfo(s))]
    assert sizes and sum(sizes) <= 16 * len(sizes)
