from __future__ import annotations

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quillmill.llm.tokens import count_texts, count_tokens, transducer

from .cases import documents

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
PIECES = ["a", "'", "s", "t", "re", "'ll", " ", "  ", "\n", "\t", "é", "1", "!", "..", "<|endoftext|>", "漢", " ", "🙂", "don't", "\r\n", "the", "tion", "\x85", "　", "S"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PIECES), max_size=12).map("".join), min_size=1, max_size=20))
def test_counts_equal_the_library(texts):
    expected = [len(e.ids) for e in LIBRARY.encode_batch(texts, add_special_tokens=False)]
    assert count_texts(texts, transducer(PATH)).tolist() == expected


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(max_size=60), min_size=1, max_size=10))
def test_any_text(texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    expected = [len(e.ids) for e in LIBRARY.encode_batch(texts, add_special_tokens=False)]
    assert count_texts(texts, transducer(PATH)).tolist() == expected


@pytest.mark.parametrize("most", [50, 1000])
def test_cuts_of_long_texts(monkeypatch, most):
    import quillmill.llm.tokens as module

    monkeypatch.setattr(module, "CHARS_AT_ONCE", most)
    text = "Some words, it's 2024 -- they'll go on  and on\n" * 90
    assert count_texts([text], transducer(PATH))[0] == len(LIBRARY.encode(text, add_special_tokens=False).ids)


def test_states_can_be_dropped(monkeypatch):
    import quillmill.llm.tokens as module

    words = module.WordTransducer(PATH)
    monkeypatch.setattr(module, "MOST_STATES", 3)
    for text in ("internationalization of things", "internationalization of things", "other"):
        assert count_texts([text], words)[0] == len(LIBRARY.encode(text, add_special_tokens=False).ids)


def test_table(spark):
    docs = documents(spark)
    out = {(r["doc_id"], r["n_bytes"]): r for r in count_tokens(docs, PATH, limit=10).collect()}
    for r in docs.collect():
        text = r["text"] or ""
        got = out[r["doc_id"], len(text.encode())]
        n = len(LIBRARY.encode(text, add_special_tokens=False).ids)
        assert (got["n_tokens"], got["over_limit"]) == (n, n > 10)
    assert count_tokens(docs.limit(0), PATH).count() == 0
