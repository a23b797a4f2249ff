from __future__ import annotations

import hashlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import quillmill.llm.alignment as module
from quillmill.llm import _util, queries
from quillmill.llm.alignment import Aligner, align, pair_counts, terminals, units_of
from quillmill.llm.tokens import byte_alphabet

from .cases import documents

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
FIRST = Tokenizer.from_file(A)
FIRST.encode_special_tokens = True
SECOND = sentencepiece.SentencePieceProcessor(model_file=B)
LETTERS = byte_alphabet()
PIECES = ["a", "'", "s", "re", "'ll", " ", "  ", "\n", "\t", "é", "1", "2024", "!", "..", "<|endoftext|>", "<s>", "<0x41>", "漢", "　", "\xa0", "🙂", "don't", "\r\n", "the", "tion", " the", "\x1c", "▁", "|"]


def plain(text: str | None) -> tuple[list[int], list[int], list[tuple[list[int], list[int]]]]:
    """Tokens of the whole text at once, and its groups by walking over both token lists."""
    if not text:
        return [], [], []
    data = (" " + text).encode()
    a, b = FIRST.encode(" " + text, add_special_tokens=False).ids, SECOND.encode(text)
    in_a = [bytes(LETTERS[c] for c in FIRST.id_to_token(i)) for i in a]
    in_b = [bytes((int(SECOND.id_to_piece(i)[3:5], 16),)) if SECOND.is_byte(i) else SECOND.id_to_piece(i).replace("▁", " ").encode() for i in b]
    if b"".join(in_a) != data or b"".join(in_b) != data:
        return [], [], []
    ends = [set(np.cumsum([len(t) for t in x]).tolist()) for x in (in_a, in_b)]
    groups, of_a, of_b, i, j = [], [], [], 0, 0
    at_a = at_b = 0
    for end in sorted(ends[0] & ends[1]):
        while at_a < end:
            of_a.append(a[i])
            at_a += len(in_a[i])
            i += 1
        while at_b < end:
            of_b.append(b[j])
            at_b += len(in_b[j])
            j += 1
        groups.append((of_a, of_b))
        of_a, of_b = [], []
    return a, b, groups


def spelled(groups) -> str:
    return ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)


def brute(texts: list[str | None]) -> list[tuple]:
    found = [plain(t) for t in texts]
    links = [[(x, y) for xs, ys in groups for x in xs for y in ys] for _, _, groups in found]
    docs = Counter(pair for of in links for pair in set(of))
    best: dict[int, int] = defaultdict(int)
    for (x, _), n in docs.items():
        best[x] = max(best[x], n)
    return [
        (len(a), len(b), len(groups), len(of), sum(docs[p] == best[p[0]] for p in of), sum(docs[p] for p in of), hashlib.sha256(spelled(groups).encode()).hexdigest() if a else "")
        for (a, b, groups), of in zip(found, links, strict=True)
    ]


BOTH = Aligner(A, B)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PIECES), max_size=14).map("".join), min_size=1, max_size=6))
def test_units_align_as_whole_texts(texts):
    block = module._block(0, list(range(len(texts))), texts, BOTH, whole=True)
    for i, text in enumerate(texts):
        a, b, groups = plain(text)
        assert (block["n_a"][i], block["n_b"][i], block["n_groups"][i], block["groups"][i]) == (len(a), len(b), len(groups), spelled(groups))


@given(st.lists(st.integers(1, 4), min_size=1, max_size=40), st.lists(st.integers(1, 4), min_size=1, max_size=40))
def test_terminals(a, b):
    a, b = np.cumsum(a), np.cumsum(b)
    last = max(a[-1], b[-1])
    a, b = (np.append(x, last) if x[-1] < last else x for x in (a, b))
    got = terminals(a, b)
    common = np.intersect1d(a, b)
    group = np.concatenate([np.searchsorted(common, a), np.searchsorted(common, b)])
    assert all((got[i] == got[j]) == (group[i] == group[j]) for i in range(len(got)) for j in range(len(got)))


def test_cuts_keep_the_text():
    for text in ("a b", " a", "a  b", "a \n b", "", "  ", "x　 y z ", "\n"):
        assert "".join(units_of(text)) == " " + text


@pytest.mark.parametrize("block", [50, 1 << 21])
def test_table_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(module, "BLOCK_CHARS", block)
    texts = ["the cat sat on the mat", "the cat sat on the mat", None, "", "▁ no", "internationalisation of things 12345 🙂", "thé the the  the\n\nthe", "the " * 50, "0123456789abcdef" * 40, " ", "\n"]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, block string").repartition(3)
    got = {r["doc_id"]: tuple(r)[1:] for r in align(docs, A, B).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts)
    docs_of = Counter(pair for t in texts for pair in {(x, y) for xs, ys in plain(t)[2] for x in xs for y in ys})
    assert {(r["a"], r["b"]): r["docs"] for r in pair_counts(docs, A, B).collect()} == docs_of


def test_awkward_rows(spark):
    docs = documents(spark)
    rows = docs.collect()
    expected = sorted(zip([r["doc_id"] or -1 for r in rows], brute([r["text"] for r in rows]), strict=True))
    assert sorted((r["doc_id"] or -1, tuple(r)[1:]) for r in align(docs, A, B).collect()) == expected
    assert align(docs.limit(0), A, B).count() == 0


def test_wide_groups(monkeypatch):
    text = "0123456789abcdef" * 300 + "漢字" * 200 + "\nlast words"
    made = []
    for most in (1, 1 << 40):
        monkeypatch.setattr(module, "WIDE", most)
        made.append(module._block(0, [1], [text], Aligner(A, B), whole=False))
    assert all(np.array_equal(made[0][name], made[1][name]) for name in made[0])


def test_units_can_be_forgotten(monkeypatch):
    both = Aligner(A, B)
    for most in (module.KNOWN, 1):
        monkeypatch.setattr(module, "KNOWN", most)
        assert [module._block(0, [1], ["some words here\nand there"], both, whole=True)["groups"] for _ in range(3)] == [[spelled(plain("some words here\nand there")[2])]] * 3


def test_long_rows_are_stored_in_small_row_groups(spark, monkeypatch):
    """Else a task unpacks the arrays of all its blocks at once."""
    stored = []
    monkeypatch.setattr(module, "BLOCK_CHARS", 1000)
    monkeypatch.setattr(_util, "LONG_ROWS", 1 << 14, raising=False)
    monkeypatch.setattr(module, "forget", lambda spark, path: stored.append(path.removeprefix("file:")))
    texts = [" ".join(f"word{i * 7 % 101}x{j}" for j in range(200)) for i in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    assert sorted((r["doc_id"], tuple(r)[1:]) for r in align(docs, A, B).collect()) == list(enumerate(brute(texts)))
    (file,) = Path(stored[0]).glob("*.parquet")
    found = pq.ParquetFile(file).metadata
    assert found.num_rows == 40
    assert max(found.row_group(i).num_rows for i in range(found.num_row_groups)) <= 8


def test_blocks_are_cut_by_bytes(spark, monkeypatch):
    monkeypatch.setattr(module, "BLOCK_CHARS", 300)
    docs = spark.createDataFrame([(i, "漢字" * 60) for i in range(6)], "doc_id long, text string").coalesce(1)
    assert [len(r["doc_id"]) for r in module._blocks(docs, A, B, whole=False).collect()] == [1] * 6


def test_what_is_known_is_bounded_by_links(monkeypatch):
    both = Aligner(A, B)
    monkeypatch.setattr(module, "KNOWN_PAIRS", 5000, raising=False)
    monkeypatch.setattr(module, "LEARN_CHARS", 500, raising=False)
    for i in range(6):
        texts = ["".join(chr(0x4E00 + (i * 997 + j * 31) % 9000) for j in range(k, k + 300)) for k in (0, 300, 600)]
        assert module._block(0, [1, 2, 3], texts, both, whole=True)["groups"] == [spelled(plain(t)[2]) for t in texts]
        assert len(both.groups) <= 6


def test_long_rows_go_to_python_in_small_batches(spark, monkeypatch):
    said = []
    monkeypatch.setattr(module, "align", lambda docs, *paths: said.append(spark.conf.get(_util.BATCH_SETTING)) or docs.withColumn("groups", F.lit("")))
    spark.conf.unset(_util.BATCH_SETTING)
    try:
        queries.op13_alignment(spark, "/root/testdata/sf0.001")
        assert said == [str(_util.BYTES_A_BATCH)]
    finally:
        spark.conf.unset(_util.BATCH_SETTING)
