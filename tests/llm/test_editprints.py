from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import quillmill.llm.editprints as module
from quillmill.llm.editprints import CLASSES, Print, against_next, edit_distance, fingerprints, likeness, near_pairs, unpacked
from quillmill.llm.queries import op11_fingerprints

from .cases import documents


def walked(text: str) -> list[int]:
    """The embedding itself, step by step: the class emitted at each step until the text ends."""
    codes, goes = module._codes(text), module._bits((module.STEPS, CLASSES), 0)
    out, i = [], 0
    while i < len(codes):
        c = int(codes[i])
        i += int(goes[len(out) % module.STEPS, c])
        out.append(c)
    return out


def plain(text: str) -> tuple[int, list[int]]:
    """The fingerprint from the embedding."""
    emitted = walked(text)
    steps, table, begin = module._sampled()
    n = int(begin[len(emitted).bit_length()])
    return len(emitted), [int(table[i, emitted[s] if s < len(emitted) else CLASSES]) for i, s in enumerate(steps[:n].tolist())]


def distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=300).filter(lambda t: t.isprintable() or True).map(lambda t: t.encode("utf-8", "ignore").decode()))
def test_print_equals_the_embedding(text):
    own = Print(module._codes(text))
    assert (own.end, own.bits.tolist()) == plain(text)
    end, bits = unpacked(own.packed())
    assert (end, bits.tolist()) == plain(text)


@given(st.text(alphabet="abc", max_size=40), st.text(alphabet="abc", max_size=40), st.integers(0, 40))
def test_walks_go_on_from_a_prefix(a, b, kept):
    own = Print(module._codes(a))
    kept = min(kept, len(a))
    both = Print(module._codes(a[:kept] + b), own, kept)
    assert (both.end, both.bits.tolist()) == plain(a[:kept] + b)


@given(st.text(alphabet="abcd", max_size=70), st.text(alphabet="abcd", max_size=70))
def test_edit_distance(a, b):
    assert edit_distance(a, b) == distance(a, b)


def test_likeness_follows_edits():
    dice = random.Random(5)
    prose = lambda n: "".join(dice.choice("etaoin shrdlu  ") for _ in range(n))
    near, far = [], []
    for n in (200, 900, 4000, 20000):
        text = prose(n)
        at = 3 * n // 4
        edited = text[:at] + dice.choice(["", "x", text[at] + "y"]) + text[at + 1 :]  # walks may be out of step from there on
        a, b, c = (Print(module._codes(t)) for t in (text, edited, prose(n)))
        near.append(likeness(a.end, a.bits, b.end, b.bits))
        far.append(likeness(a.end, a.bits, c.end, c.bits))
        assert likeness(a.end, a.bits, b.end, b.bits) == likeness(b.end, b.bits, a.end, a.bits)
        assert likeness(a.end, a.bits, a.end, a.bits) == 1
    assert min(near) > 0.6 and max(far) < 0.3


def expected(rows: list[tuple]) -> list[tuple]:
    """By plain walks over all rows in order."""
    out = []
    for k, (doc_id, text) in enumerate(rows):
        text, following = text or "", rows[(k + 1) % len(rows)][1] or ""
        third = len(text) // 3
        edited = text[: len(text) - third] + following[:third]
        prints = [plain(t) for t in (text, edited, following)]
        near = [likeness(prints[0][0], np.array(prints[0][1]), e, np.array(b)) for e, b in prints[1:]]
        out.append((doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), *[f"{e:016x}" + np.packbits(np.array(b, dtype=np.uint8)).tobytes().hex() for e, b in prints[:2]], *near))
    return out


@pytest.mark.parametrize("parts", [1, 12])
def test_query_equals_plain_walks(spark, tmp_path, parts):
    dice = random.Random(parts)
    rows = [(3 * i + 1, None if i % 13 == 5 else "" if i % 13 == 6 else "".join(dice.choice("abcdé 漢🙂") for _ in range(dice.randrange(90)))) for i in range(31)]
    spark.createDataFrame(dice.sample(rows, len(rows)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = [tuple(r) for r in op11_fingerprints(spark, str(tmp_path)).collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted(got) == sorted(expected(sorted(rows, reverse=True)))


def test_awkward_rows(spark):
    docs = documents(spark)
    got = against_next(docs).collect()
    assert sorted((r["doc_id"] or -1, r["n_chars"]) for r in got) == sorted((r["doc_id"] or -1, len(r["text"] or "")) for r in docs.collect())
    by_text = {r["text"] or "": bytes(r["print"]) for r in fingerprints(docs).join(docs.select("doc_id", "text"), "doc_id").collect()}
    assert all(unpacked(p)[1].tolist() == plain(t)[1] for t, p in by_text.items() if len(t) < 1000)
    assert against_next(docs.limit(0)).count() == 0
    alone = against_next(docs.where("doc_id = 1")).collect()
    assert len(alone) == 1 and alone[0]["near_next"] == 1


@pytest.mark.parametrize("block", [3, 256])
def test_near_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(module, "BLOCK", block)
    dice = random.Random(2)
    texts = []
    for _ in range(12):
        base = "".join(dice.choice("etaoin shrdlu  ") for _ in range(dice.randrange(100, 400)))
        texts += [base, base, base[:50] + "zq" + base[52:], base[:20] + base[23:]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    first = {t: i for i, t in reversed(list(enumerate(texts)))}
    ids = sorted(first.values())
    truth = {(a, b): d for a in ids for b in ids if a < b and (d := distance(texts[a], texts[b])) <= 0.2 * max(len(texts[a]), len(texts[b]))}
    got = {(r["a"], r["b"]): r["distance"] for r in near_pairs(docs).collect()}
    assert got.items() <= truth.items() and len(truth) == 36 and len(got) >= 24
