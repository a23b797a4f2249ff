"""Single cases of the rules that tables don't hold."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quillmill.functions import text as T
from quillmill.functions import urls as U
from quillmill.operators import notes as N
from quillmill.operators import sequences as S


def values(spark, expression, *inputs):
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], "i int, x string")
    return [r["y"] for r in rows.select("i", expression(F.col("x")).alias("y")).orderBy("i").collect()]


def test_entities_are_decoded_once(spark):
    assert values(spark, T.strip_html, "<p>a &amp;lt; b</p>", "<script>x</script> y ") == ["a &lt; b", "y"]


def test_titles(spark):
    assert values(spark, T.title_valid, "ab", "abc", "Untitled", "x" * 51, None) == [False, True, False, False, False]
    assert values(spark, T.title_from_text, "One. Two", "", "x" * 40)[0]["title"] == "One."
    assert values(spark, T.title_by_language, "A heading that is much longer than thirty characters") == ["A heading that is much..."]


def test_language(spark):
    assert values(spark, T.language, "你好世界", "two words", "x", None) == ["chinese", "english", "other", "other"]


@pytest.mark.parametrize(("url", "ok"), [("https://example.com/a", True), ("http://10.1.2.3/", False), ("https://u:p@example.com/", False), ("https://172.15.0.1/", True), ("ftp://example.com", False), ("https://a.local/", False), (None, False)])
def test_public(spark, url, ok):
    assert values(spark, U.public, url) == [ok]


def test_image_addresses_are_stable(spark):
    once = values(spark, U.image_url, "https://a.imgix.net/p.jpg?w=1&v=2&h=3", "https://a.imgix.net/p.jpg?w=1", "//x.example.com/a.png")
    assert once == ["https://a.imgix.net/p.jpg?v=2", "https://a.imgix.net/p.jpg", "https://x.example.com/a.png"]
    assert values(spark, U.image_url, *once) == once


def test_srcset_with_commas_in_addresses(spark):
    assert values(spark, U.srcset_best, "https://i/a,b.jpg 300w, https://i/c,d.jpg 900w", "https://i/x.jpg 2x, https://i/y.jpg 2x", "https://i/z.jpg") == ["https://i/c,d.jpg", "https://i/x.jpg", "https://i/z.jpg"]


def test_packing_is_greedy(spark):
    rows = spark.createDataFrame([(1, i, n) for i, n in enumerate([10, 10, 10, 25, 5, 5, 30, 1, 0])], "d int, p int, n int")
    parts = [r["part"] for r in S.pack(rows, "d", ["p"], "n", 30).orderBy("p").collect()]
    assert parts == [0, 0, 0, 1, 1, 2, 3, 4, 4]


def test_slots_keep_their_distance(spark):
    rows = spark.createDataFrame([(1, i, a) for i, a in enumerate([0, 100, 5000, 5001, 5002])], "k int, i int, at long")
    assert [r["start"] for r in S.slots(rows, ["at", "i"], "at", 1100, block=1000).orderBy("i").collect()] == [0, 1100, 5000, 6100, 7200]


def test_throttle(spark):
    rows = spark.createDataFrame([(1, i, a) for i, a in enumerate([0, 100, 1500, 1501, 9000])], "k int, i int, at long")
    out = [tuple(r) for r in S.throttle(rows, "k", "at", "i", 1500).orderBy("opened").collect()]
    assert out == [(1, 0, 1500, 2), (1, 1501, 3001, 0), (1, 9000, 10500, 0)]


def test_merge_keeps_what_says_something(spark):
    rows = spark.createDataFrame([("a", 1, "First", "d", False, False), ("a", 2, N.NO_TITLE, "", True, False)], "uuid string, ord int, title string, digest string, is_top boolean, is_collection boolean")
    assert tuple(N.merge_fields(rows).first()) == ("a", "First", "d", True, False, 1)


def test_blocklist_prefixes(spark):
    from quillmill.operators.rules import not_blocked

    rows = spark.createDataFrame([(1, "https://a.example/x/1"), (2, "https://b.example/"), (3, "https://c.example/")], "id int, url string")
    hosts, prefixes = spark.createDataFrame([("b.example",)], "host string"), spark.createDataFrame([("https://a.example/x",), (None,)], "prefix string")
    assert [r["id"] for r in not_blocked(rows, hosts, prefixes).collect()] == [3]


def test_code_languages_need_one_sort(spark):
    from quillmill.operators.paragraphs import inherit_code_language

    rows = [("code", "sql"), ("code", ""), ("text", "x"), ("code", None), ("code", "py"), ("code", None), ("text", None), ("code", "")]
    blocks = spark.createDataFrame([(1, i, kind, lang) for i, (kind, lang) in enumerate(rows)] + [(2, 0, "code", "")], "doc int, pos int, kind string, lang string")
    out = inherit_code_language(blocks)
    assert [r["lang"] for r in sorted(out.collect(), key=lambda r: (r["doc"], r["pos"]))] == ["sql", "sql", "x", "", "py", "py", None, "", ""]
    out = inherit_code_language(blocks)
    assert out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan")[0].count(" Sort [") == 1
