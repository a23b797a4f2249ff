from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pyarrow as pa

from quillmill.llm import decontaminate
from quillmill.llm.decontaminate import keep_clean, mark, winnow

from .cases import documents

PATTERN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return PATTERN.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(text, items, size=10):
    doc = words(text)
    hit, found = set(), set()
    for item, t in items:
        w = words(t)
        n = min(size, len(w))
        for s in range(len(w) - n + 1) if n else ():
            for d in range(len(doc) - n + 1):
                if doc[d : d + n] == w[s : s + n]:
                    hit.update(range(d, d + n))
                    found.add(str(item))
    ids = sorted(found)
    return len(doc), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)


def test_every_window_keeps_a_fingerprint():
    rng = np.random.default_rng(1)
    grams = rng.integers(0, 50, 300).astype(np.uint64)
    valid = np.ones(300, dtype=bool)
    kept = set(winnow(grams, valid, 6).tolist())
    for i in range(295):
        assert kept & {i + int(np.argmin(grams[i : i + 6]))}


def check(spark, docs, items, **kwargs):
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = mark(docs.select("doc_id", "text"), bench, **kwargs).collect()
    assert len(rows) == docs.count()
    real = [(i, t) for i, t in items if i is not None]
    for r in rows:
        assert (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) == brute(r["text"], real)


def cases(spark):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(30)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([1, 3, 5, 9, 10, 11, 25])))) for i in range(20)]
    items += [(3, "Seven, more; words for an item again"), (50, None), (51, " .. "), (None, "w1 w2"), (60, items[2][1]), (7, "word1 and1")]
    rows = []
    for d in range(60):
        text = rng.choices(vocabulary, k=rng.randrange(0, 40))
        if d % 3 == 0:
            w = words(items[rng.randrange(20)][1])
            at = rng.randrange(len(text) + 1)
            text[at:at] = [x.upper() if rng.random() < 0.3 else x for x in w]
        rows.append((d, ", ".join(text) if d % 2 else " ".join(text), "en", "s"))
    return documents(spark, rows), items


def test_equals_brute_force(spark):
    check(spark, *cases(spark))


def test_joined_by_all_names(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "NAMES_AT_ONCE", 0)
    monkeypatch.setattr(decontaminate, "ROWS_AT_ONCE", 0)
    check(spark, *cases(spark))


def test_long_texts_in_pieces(monkeypatch):
    monkeypatch.setattr(decontaminate, "BYTES_AT_ONCE", 64)
    rng = random.Random(6)
    for _ in range(50):
        text = "".join(rng.choice(["ab", "cde", "Straße", "x" * 90, " ", ", ", "\n"]) + rng.choice([" ", "-", ""]) for _ in range(rng.randrange(120)))
        whole = words(text)
        seen = set()
        for first, data in decontaminate.pieces(text.encode(), 4):
            part = words(data.decode())
            assert whole[first : first + len(part)] == part
            seen.update(range(first, first + len(part) - 3))
        assert seen >= set(range(len(whole) - 3))


def test_words_are_counted_in_arrow(spark, monkeypatch):
    """Counting by a regular expression in the JVM took over half of the query's CPU seconds."""
    rng = random.Random(8)
    texts = ["".join(rng.choice(["ab", "X9", "Straße", "漢", " ", ", ", "\x7f", "\n", "\0"]) for _ in range(rng.randrange(30))) for _ in range(200)]
    texts += [None, "", "a", " ", None, "Z" * 100, "a b", "b"]
    for size in (1, 7, 64, 1 << 20):
        monkeypatch.setattr(decontaminate, "BYTES_AT_ONCE", size)
        assert decontaminate.count_words(pa.array(texts)).to_pylist() == [len(words(t)) for t in texts]
        assert decontaminate.count_words(pa.array(texts).slice(3, 90)).to_pylist() == [len(words(t)) for t in texts[3:93]]
    assert decontaminate.count_words(pa.array([], pa.string())).to_pylist() == []
    docs = spark.createDataFrame([(1, "one Two")], "doc_id long, text string")
    plan = mark(docs, spark.createDataFrame([(1, "x")], "item_id long, text string"))._jdf.queryExecution().executedPlan().toString()
    assert "regexp" not in plan and "ArrowEvalPython" in plan


def test_clean_rows_keep_all_columns(spark):
    docs, items = cases(spark)
    bench = spark.createDataFrame(items, "item_id long, text string")
    clean = {r["doc_id"] for r in mark(docs, bench).where("not contaminated").collect()}
    odd = docs.withColumnsRenamed({"score": "n_words", "shard": "k1"})
    kept = keep_clean(odd, bench)
    assert kept.columns == odd.columns and kept.subtract(odd).count() == 0
    assert {r["doc_id"] for r in kept.collect()} == clean


def test_odd_rows(spark):
    docs = documents(spark)
    check(spark, docs, [(1, "runs away from it all"), (2, "漢字"), (3, "l’accent and 'quotes'"), (4, "word1 and1 word2 and2 word3 and3 word4 and4 word5 and5 word6")])
    assert set(mark(docs, spark.createDataFrame([(1, "x")], "item_id long, text string")).columns) == {*docs.columns, "n_words", "n_hit", "n_items", "items_sha256", "contaminated"}
    assert mark(docs.limit(0), spark.createDataFrame([(1, "x")], "item_id long, text string")).count() == 0
    empty = spark.createDataFrame([], "item_id long, text string")
    assert not any(r["contaminated"] for r in mark(docs, empty).collect())
