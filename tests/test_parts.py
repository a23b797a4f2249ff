"""Splitting and merging: what was cut joins again to what it was."""

from __future__ import annotations

from hypothesis import given, settings
from hypothesis import strategies as st

from quillmill.operators import parts as P

TEXTS = ["", "short", "One. Two. Three. Four.", "a b c d e f g h", "line one\nline two\nline three", "x" * 50, "句子一。 句子二。 句子三。"]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab .\n。!x", max_size=80), st.integers(3, 20))
def test_cut_places(text, limit):
    ends = P.cut_places(text, limit)
    starts = [0, *ends][: len(ends)]
    assert "".join(text[a:b] for a, b in zip(starts, ends, strict=True)) == text
    assert all(0 < b - a <= limit for a, b in zip(starts, ends, strict=True))


def test_split_text(spark):
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "id int, text string")
    got = {}
    for r in P.split_text(rows, "id", "text", 12).orderBy("id", "part").collect():
        got.setdefault(r["id"], []).append(r["text"])
    assert {i: "".join(x) for i, x in got.items()} == dict(enumerate(TEXTS))
    assert got[2] == ["One. Two. ", "Three. Four."] and all(len(x) <= 12 for parts in got.values() for x in parts)


def test_split_code(spark):
    rows = spark.createDataFrame([(1, "aa\nbb\ncc\n" + "z" * 12 + "\ndd")], "id int, text string")
    assert [r["text"] for r in P.split_code(rows, "id", "text", 6).orderBy("chunk").collect()] == ["aa\nbb\n", "cc\n", "z" * 6, "z" * 6, "\n", "dd"]


def test_continued_segments(spark):
    rows = spark.createDataFrame(
        [(1, 0, "this sentence goes on and on"), (1, 1, "until it ends here!"), (1, 2, "Another one starts"), (1, 3, "• a list item here"), (2, 0, "中文句子没有结束但是还有很多字在这里"), (2, 1, "继续写下去"), (2, 2, " ")], "doc int, pos int, text string"
    )
    got = [tuple(r) for r in P.merge_continued(rows).orderBy("doc", "part").collect()]
    assert got == [(1, 0, "this sentence goes on and on until it ends here!"), (1, 1, "Another one starts"), (1, 2, "• a list item here"), (2, 0, "中文句子没有结束但是还有很多字在这里继续写下去")]
