from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import quillmill.llm.runs as module
from quillmill.llm.queries import op12_runs
from quillmill.llm.runs import collapse_runs, runs_of

from .cases import documents


def brute(words: list) -> list[tuple[int, int, int]]:
    """start, length, smallest period, by stretches of words that equal the word q later, for each q."""
    found = set()
    ids = np.unique(np.array(words, dtype=object if words and isinstance(words[0], str) else np.int64), return_inverse=True)[1] if words else np.zeros(0)
    for q in range(1, len(words) // 4 + 1):
        turns = np.diff(np.concatenate([[0], (ids[:-q] == ids[q:]).astype(np.int8), [0]]))
        for i, j in zip(np.flatnonzero(turns == 1).tolist(), np.flatnonzero(turns == -1).tolist(), strict=True):
            length = j - i + q
            if length >= max(6, 4 * q) and not any(s <= i and i + length <= s + m and q % p == 0 for s, m, p in found):
                found.add((i, length, q))
    return sorted(found)


def collapsed(words: list, runs) -> list:
    gone = {k for s, n, q in runs for k in range(s + q, s + n)}
    return [w for k, w in enumerate(words) if k not in gone]


def ours(texts: list[list[int]]) -> list[list[tuple[int, int, int]]]:
    bounds = np.cumsum([0, *map(len, texts)])
    start, end, period = runs_of(np.array([x for t in texts for x in t], dtype=np.int64), bounds)
    out = [[] for _ in texts]
    for s, e, p in zip(start.tolist(), end.tolist(), period.tolist(), strict=True):
        d = int(np.searchsorted(bounds, s, side="right")) - 1
        out[d].append((s - int(bounds[d]), e - s, p))
    return out


word = st.integers(0, 2)
piece = st.one_of(st.lists(word, max_size=8), st.tuples(st.lists(word, min_size=1, max_size=6), st.integers(3, 9)).map(lambda x: x[0] * x[1]))
text = st.lists(piece, max_size=7).map(lambda x: sum(x, []))


@settings(max_examples=1000, deadline=None)
@given(st.lists(text, min_size=1, max_size=6), st.sampled_from([1, 2, 256]), st.sampled_from([3, 1 << 21]))
def test_runs_equal_brute_force(texts, hardly, tried):
    module.HARDLY, module.TRIED = hardly, tried
    try:
        assert ours(texts) == [brute(t) for t in texts]
    finally:
        module.HARDLY, module.TRIED = 256, 1 << 21


@pytest.mark.parametrize("seed", range(4))
def test_longer_texts(seed):
    dice = np.random.default_rng(seed)
    texts = []
    for _ in range(12):
        base = dice.integers(0, 3 if seed % 2 else 200, dice.integers(1, 400)).tolist()
        p = int(dice.integers(1, 90))
        at = int(dice.integers(0, len(base)))
        texts.append(base[:at] + (base[at : at + p] * 9)[: int(dice.integers(1, 700))] + base[at:])
    texts += texts[:3] + [[7] * 3000, [1, 2] * 900 + [1], []]
    assert ours(texts) == [brute(t) for t in texts]


def test_one_word_over_and_over_is_quick():
    n = 300_000
    assert ours([[5] * n]) == [[(0, n, 1)]]


def test_awkward_rows(spark, monkeypatch):
    monkeypatch.setattr(module, "PORTION", 40)
    docs = documents(spark).selectExpr("*", "'mine' as Runs").unionByName(
        spark.createDataFrame([(50, "a b " * 9 + "c\x1cc\xa0 a\x0bb" + "\n x" * 6)], "doc_id long, text string"), allowMissingColumns=True
    )
    out = collapse_runs(docs)
    assert out.columns == [*docs.columns[:-1], "runs", "n_words", "collapsed"]
    for r in out.collect():
        words = re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")
        assert [tuple(x) for x in r["runs"]] == brute(words)
        assert (r["n_words"], r["collapsed"]) == (len(words), " ".join(collapsed(words, brute(words))))
    assert out.count() == docs.count()
    assert collapse_runs(docs.limit(0)).count() == 0


def test_query_equals_brute_force(spark, tmp_path):
    rows = [(i, " ".join(f"w{(i * j * j) % (3 + i % 11)}" for j in range(i % 70)) if i % 31 else None) for i in range(160)]
    docs = spark.createDataFrame([*rows, (None, "no id " * 8), (7, "x " * 12)], "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    expected, tails = [], 0
    for doc_id, string in docs.collect():
        words = re.findall(r"[^\x20\x09-\x0D]+", string or "")
        h, n = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1, len(words)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words, tails = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)], tails + 1
        runs = brute(words)
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        milli = best[1] and 1000 * best[1] // best[2]
        expected.append((doc_id, len(runs), *best, milli, sha("".join(f"{s},{m},{q}\n" for s, m, q in sorted(runs, key=lambda r: (r[0], r[2])))), sha(" ".join(collapsed(words, runs)))))
    assert tails > 5
    out = op12_runs(spark, str(tmp_path)).select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")
    order = lambda x: (x[0] is None, x[0] or 0, x[7])
    assert sorted(map(tuple, out.collect()), key=order) == sorted(expected, key=order)
    assert {t for _, t in out.dtypes[1:6]} == {"bigint"}
