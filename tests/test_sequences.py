"""Packing, throttling and slots against plain loops, with keys of many stretches and blocks."""

from __future__ import annotations

import random

import pytest

import quillmill.operators.sequences as S


@pytest.fixture(params=[2, 1024])
def stretch(request, monkeypatch):
    monkeypatch.setattr(S, "STRETCH", request.param)


def test_pack(spark, stretch):
    dice = random.Random(3)
    docs = {k: [dice.choice([0, 1, 2, 5, 9, 30]) for _ in range(n)] for k, n in (("a", 1), ("b", 2), ("c", 70), ("d", 17), ("e", 3))}
    docs["e"] = [30, 30, 30]
    expected = set()
    for k, sizes in docs.items():
        part = used = 0
        for i, size in enumerate(sizes):
            size = max(size, 1)
            if used and used + size > 10:
                part, used = part + 1, 0
            used += size
            expected.add((k, i, part))
    rows = spark.createDataFrame([(k, i, n) for k, sizes in docs.items() for i, n in enumerate(sizes)], "doc string, pos int, n int")
    assert {(r["doc"], r["pos"], r["part"]) for r in S.pack(rows, "doc", ["pos"], "n", 10).collect()} == expected


def test_throttle(spark, stretch):
    dice = random.Random(4)
    events = {k: sorted(dice.randrange(n * 3) for _ in range(n)) for k, n in (("a", 1), ("b", 2), ("c", 90), ("d", 40))}
    expected = set()
    for k, times in events.items():
        opened, absorbed = times[0], -1
        for t in times:
            if t > opened + 7:
                expected.add((k, opened, opened + 7, absorbed))
                opened, absorbed = t, -1
            absorbed += 1
        expected.add((k, opened, opened + 7, absorbed))
    rows = spark.createDataFrame([(k, t, i) for k, times in events.items() for i, t in enumerate(times)], "page string, ms long, id int")
    assert {tuple(r) for r in S.throttle(rows, "page", "ms", "id", 7).collect()} == expected


def test_slots(spark):
    dice = random.Random(5)
    arrivals = sorted(dice.randrange(1000) for _ in range(120))
    expected, free = [], -10**9
    for i, t in enumerate(arrivals):
        free = max(t, free + 11)
        expected.append((i, free))
    rows = spark.createDataFrame(list(enumerate(arrivals)), "id int, ms long").repartition(5)
    for block in (10, 100, 5000):
        assert sorted((r["id"], r["start"]) for r in S.slots(rows, ["ms", "id"], "ms", 11, block).collect()) == expected
