"""Whole elements by simple selectors, and goldens of code languages, links, quotes and units."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quillmill.functions import code as C
from quillmill.functions.urls import absolute
from quillmill.operators import blocks as B
from quillmill.operators import elements as E

LONG = "word " * 60


def one(spark, job, html, **how):
    return job(spark.createDataFrame([(1, html)], "page_id int, html string"), "page_id", "html", **how).first()


@pytest.mark.parametrize(
    ("html", "kept", "removed"),
    [
        ("<div class='ads'><div>in</div>out</div>rest", "rest", 1),
        ("<p>a<p class='banner'>b</p>c", "<p>ac", 1),
        ("<div class='ads'>never closed", "never closed", 1),
        ("<div class='x'><iframe src='https://a.example'></iframe>t</div>", "<div class='x'>t</div>", 1),
        ("<div id='comments'><div class='ads'>x</div></div>", "", 2),
        ("<div class='adsense'>kept</div><script>'<div class=ads>'</script>", "<div class='adsense'>kept</div>", 0),
        ("<a class='anchor' href='#'>#</a><b class='anchor'>b</b>", "<b class='anchor'>b</b>", 1),
        (None, "", 0),
        ("", "", 0),
    ],
)
def test_remove(spark, html, kept, removed):
    assert tuple(one(spark, E.remove, html))[1:] == (kept, removed)


@pytest.mark.parametrize(
    ("html", "rank", "region"),
    [
        (f"<main>{LONG}</main><article><div>{LONG}</div></article>", 2, f"<article><div>{LONG}</div></article>"),
        (f"<article>short</article><main>{LONG}</main>", 8, f"<main>{LONG}</main>"),
        ("<article>short</article>", None, "<article>short</article>"),
        ("<b>a</b><div class='article'>short</div>", 11, "<div class='article'>short</div>"),
        (f"<div class='content'>s<div class='content'>{LONG}</div></div>x", 7, f"<div class='content'>s<div class='content'>{LONG}</div></div>"),
    ],
)
def test_region(spark, html, rank, region):
    assert tuple(one(spark, E.main_region, html))[1:] == (rank, region)


def test_selectors_that_are_not_simple():
    with pytest.raises(ValueError):
        E.matches("div > p", F.lit(""), F.lit(""))


def test_code_languages(spark):
    texts = {
        'FROM node:20\nWORKDIR /app\nRUN npm ci\nCMD ["npm", "start"]': "docker",
        "# build\n  FROM alpine\n  RUN make": "docker",
        'resource "aws_s3_bucket" "assets" {\n  bucket = "demo"\n}': "terraform",
        "[tool.ruff]\nline-length = 100": "toml",
        'using System;\nConsole.WriteLine("hi");': "csharp",
        "./image.png\n../assets/a.jpg\n/Users/example/demo.png": "shellscript",
        "C:\\\\Users\\\\demo\\\\a.jpg": "powershell",
    }
    rows = spark.createDataFrame(list(texts.items()), "text string, language string")
    assert all(r[0] == r[1] for r in rows.select("language", C.inferred(F.col("text"))).collect())
    names = {"python3": "python", "terminal": "shellsession", "postgresql": "sql", "obj-c": "objective-c", "Rust": "rust", "nothing": None}
    rows = spark.createDataFrame([(f'class="language-{k}"', v) for k, v in names.items()], "attributes string, expected string")
    out = C.named(rows, C.alias_rows(spark), C.language_rows(spark)).collect()
    assert len(out) == len(names) and all(r["language"] == r["expected"] for r in out)


def test_links(spark):
    base = "https://example.com/a/b.html?q=1"
    cases = {"//h/x": "https://h/x", "/x": "https://example.com/x", "x": "https://example.com/a/x", "../x": "https://example.com/x", "./": "https://example.com/a/", "..": "https://example.com/", "?p": "https://example.com/a/b.html?p", "#t": f"{base}#t", "": base, "data:x": "data:x", "http://o": "http://o"}
    rows = spark.createDataFrame(list(cases.items()), "href string, expected string").withColumn("base", F.lit(base))
    assert [r[0] for r in rows.select(absolute(F.col("href"), F.col("base"))).collect()] == list(cases.values())


def test_quote_runs(spark):
    ref, gap = ("paragraph", "🔗 引用文章：here", None), ("paragraph", "", None)
    quote = lambda t, g=None: ("quote", t, g)
    rows = [ref, gap, quote("a"), quote(""), gap, quote("b", "g"), quote("c"), gap, gap, quote("d"), ("paragraph", "p", None), quote("e"), ref, quote(""), ("image", "i", None)]
    table = spark.createDataFrame([("d", i, *r) for i, r in enumerate(rows)], 'doc string, pos int, kind string, text string, `group` string')
    out = sorted(tuple(r)[1:] for r in B.merge_quote_runs(table, "doc", ["pos"]).collect())
    assert [(pos, text, group, n) for pos, kind, text, group, n in out if kind == "quote"] == [(2, "a\n\nb\nc", "g", 5), (9, "d", None, 1), (11, "e", None, 1)]
    assert [pos for pos, *_ in out] == [0, 1, 2, 7, 8, 9, 10, 11, 12, 14]


def test_marker_units(spark):
    cases = {"": [], "  ": [], "plain - text": ["plain - text"], "Do: 1. one 2. two": ["Do:", "1. one", "2. two"], "- a - b": ["- a", "- b"], "x! • y a) z": ["x!", "• y", "a) z"], "1. - x": ["1.", "- x"]}
    rows = spark.createDataFrame([*((k, v) for k, v in cases.items()), (None, [])], "line string, units array<string>")
    assert all((r[1] or []) == r[0] for r in rows.select("units", B.marker_units(F.col("line"))).collect())
