from __future__ import annotations

import random
import re
from collections import defaultdict
from itertools import combinations

import pytest
import xxhash

from quillmill.llm.components import components
from quillmill.llm import simhash
from quillmill.llm.simhash import covering_masks, keep_one, links, near_duplicates

from .cases import documents


def brute(text, n=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] or ([" ".join(words)] if words else [])
    counts = [0] * 64
    for g in grams:
        h = xxhash.xxh64_intdigest(g.encode(), 42)
        for i in range(64):
            counts[i] += h >> i & 1
    return sum(1 << i for i in range(64) if counts[i] * 2 > len(grams))


def reach(nodes, edges):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("radius", [2, 4])
def test_masks_cover(radius):
    masks = covering_masks(radius)
    rng = random.Random(1)
    for _ in range(3000):
        bits = sum(1 << i for i in rng.sample(range(64), radius))
        assert any(m & bits == 0 for m in masks)


def test_links_are_exactly_the_near_pairs(spark):
    rng = random.Random(2)
    prints = {rng.getrandbits(64) for _ in range(120)}
    for p in list(prints)[:60]:
        for n in (1, 2, 2, 3):
            prints.add(p ^ sum(1 << i for i in rng.sample(range(64), n)))
    signed = sorted(p - (1 << 64) if p >> 63 else p for p in prints)
    edges = [(r["a"], r["b"]) for r in links(spark.createDataFrame([(p,) for p in signed], "fp long"), 2).collect()]
    near = [(a, b) for a, b in combinations(signed, 2) if ((a ^ b) & (1 << 64) - 1).bit_count() <= 2]
    assert reach(signed, edges) == reach(signed, near)


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(0, 40)] + [(100 + rng.randrange(60), 100 + rng.randrange(60)) for _ in range(40)] + [(5, 5), (7, None)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    real = [(a, b) for a, b in edges if b is not None and a != b]
    assert got == reach({x for e in real for x in e}, real)


def test_documents(spark):
    docs = documents(spark)
    rows = near_duplicates(docs).collect()
    assert len(rows) == docs.count()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert all(r["fingerprint"] == f"{brute(texts[r['doc_id']]):016x}" for r in rows)
    by_component = defaultdict(set)
    for r in rows:
        by_component[r["component_id"]].add(r["doc_id"])
    assert {1, 2} in by_component.values() and {3, 4, 10} in by_component.values()
    assert near_duplicates(docs.limit(0)).count() == 0


def test_one_of_each_stays(spark):
    docs = documents(spark)
    kept = [r["doc_id"] for r in keep_one(docs, words=5).select("doc_id").collect()]
    assert sorted(x for x in kept if x is not None and x != 9) == [1, 3, 5, 6, 7, 11]
    assert set(keep_one(docs).columns) == set(docs.columns)


def test_large_buckets_give_the_same_components(spark, monkeypatch):
    rng = random.Random(12)
    base = [rng.getrandbits(64) for _ in range(6)]
    near = {b ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for b in base for _ in range(60)} | set(base)
    prints = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in near], "fp long")
    roots = lambda: {(r["node"], r["root"]) for r in simhash.components(simhash.links(prints)).collect()}
    small = roots()
    for bucket in (1, 8):
        monkeypatch.setattr(simhash, "BUCKET", bucket)
        assert roots() == small
