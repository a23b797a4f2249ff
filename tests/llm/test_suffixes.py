from __future__ import annotations

import random

import pytest

from quillmill.llm.suffixes import remove_repeats

from .cases import documents


def brute(rows, span=50):
    """What is left of each (doc_id, text)."""
    datas = [(d, (t or "").encode()) for d, t in rows]
    first = {}
    for d, b in datas:
        key = d if d is not None else float("inf")
        for i in range(len(b) - span + 1):
            s = b[i : i + span]
            first[s] = min(first.get(s, key), key)
    out = []
    for d, b in datas:
        key = d if d is not None else float("inf")
        gone = bytearray(len(b))
        for i in range(len(b) - span + 1):
            if first[b[i : i + span]] < key:
                gone[i : i + span] = b"\1" * span
        spans = sum(1 for i in range(len(b)) if gone[i] and not (i and gone[i - 1]))
        out.append((d, len(b), sum(gone), spans, bytes(x for x, g in zip(b, gone, strict=True) if not g)))
    return sorted(map(str, out))


def check(spark, docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    got = [(r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in remove_repeats(docs).collect()]
    assert sorted(map(str, got)) == brute(rows)


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    passages = ["".join(rng.choices("abcdé ", k=rng.choice([48, 49, 50, 51, 120, 400]))) for _ in range(12)] + ["ab" * 60, "a" * 90, "a" * 55]
    rows = []
    for d in range(60):
        parts = [rng.choice(passages) if rng.random() < 0.5 else "".join(rng.choices("abcdef ", k=rng.randrange(1, 80))) for _ in range(rng.randrange(0, 6))]
        rows.append((d, "".join(parts), "en", "s"))
    check(spark, documents(spark, rows))


def test_odd_rows(spark):
    check(spark, documents(spark))
    assert remove_repeats(documents(spark).limit(0)).count() == 0


def test_equal_ids_remove_nothing_from_each_other(spark):
    long = "A passage that is quite a bit longer than fifty bytes, so that it counts. "
    check(spark, documents(spark, [(5, long, "en", "a"), (5, long + "x", "en", "a"), (None, long, "en", "a"), (None, long, "en", "a"), (2, "short", "en", "a")]))
