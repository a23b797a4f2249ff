from __future__ import annotations

import random
import time

import pytest

from quillmill.llm.wrapper import align, content, extract, parse, walk


def text(html):
    return content(parse(html))


@pytest.mark.parametrize(
    ("html", "expected"),
    [
        ("", ""),
        ("plain &amp; simple", "plain & simple"),
        ("<p>one<p>two <b>bold</b>\n text<br>more", "one\ntwo bold text more"),
        ("<nav>menu</nav><article><h1>T</h1><p>a&nbsp;b</p></article><footer>f</footer>", "T\na b"),
        ("<body><div class='ad'>buy</div><div class='content'>keep</div><div id='comments'>no</div></body>", "keep"),
        ("<script>var a='<p>x</p>';</script><p>y</p><!-- <p>z</p> -->", "y"),
        ("<article><p>cut off <b", "cut off"),
        ("<article><p>a</p><form><p>b</p></form><aside>c</aside></article>", "a"),
        ("<ul><li>one<li>two</ul><table><tr><td>c1<td>c2</table>", "one\ntwo\nc1\nc2"),
        ("<p>a < b and 1 > 0</p>", "a < b and 1 > 0"),
        ("<div role='navigation'>m</div><div role=main>keep</div>", "keep"),
        ("<title>t</title></b></p><p>x</i></p>", "x"),
    ],
)
def test_text(html, expected):
    assert text(html) == expected


def sizes(a, b):
    """Simple tree matching as it is defined."""
    if a.tag != b.tag:
        return 0
    rows = [[0] * (len(b.kids) + 1) for _ in range(len(a.kids) + 1)]
    for i, x in enumerate(a.kids, 1):
        for j, y in enumerate(b.kids, 1):
            rows[i][j] = max(rows[i - 1][j], rows[i][j - 1], rows[i - 1][j - 1] + sizes(x, y))
    return rows[-1][-1] + 1


@pytest.mark.parametrize(
    ("a", "b"),
    [
        ("<div><p>a</p><ul><li>x<li>y</ul></div><p>z", "<div><h1>t</h1><p>a</p><ul><li>x</ul><p>q</div>"),
        ("<p>1<p>2<p>3", "<p>1<p>3"),
        ("<div><div><p>a</div></div>", "<div><p>b</div><div><div><p>a</div></div>"),
        ("<section><h2>a</h2><p>b</section><section><p>c</section>", "<section><p>c</section><section><h2>a</h2><p>b</section>"),
    ],
)
def test_alignment_is_largest(a, b):
    x, y = parse(a), parse(b)
    pairs = align(x, y)
    assert len(pairs) == sizes(x, y)
    assert len({id(p) for p, _ in pairs}) == len(pairs) and all(p.tag == q.tag for p, q in pairs)


def test_template_texts_go(spark):
    page = lambda i: f"<body><div>Welcome to the site</div><div><p>Body number {i} with its own words {i * 7}</p><p>Second {i}</p></div><div>All rights kept</div></body>"
    rows = [(i, f"https://h.example.com/{i}", page(i)) for i in range(8)] + [(50, "https://other.example.com/", page(50)), (51, None, None), (52, "no url", "<p>x"), (51, None, None)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, text string, n_chars int")
    out = sorted((r["page_id"], r["text"], r["n_chars"]) for r in extract(df).collect())
    assert len(out) == 12
    got = {i: t for i, t, _ in out}
    assert all(got[i] == f"Body number {i} with its own words {i * 7}\nSecond {i}" for i in range(8))
    assert got[50].startswith("Welcome") and got[51] == "" and got[52] == "x"
    assert all(n == len(t) for _, t, n in out)
    assert extract(df.limit(0)).count() == 0


def test_joined_references(spark):
    df = spark.createDataFrame([(i, f"https://h{i % 3}.example.com/{i}", f"<p>same</p><p>own {i} {i * i}</p>") for i in range(30)], "page_id long, url string, html string")
    key = lambda d: sorted(map(str, d.collect()))
    assert key(extract(df)) == key(extract(df, broadcast_bytes=0))
    assert {r["text"] for r in extract(df).where("page_id = 4").collect()} == {"own 4 16"}


def test_copies_of_the_reference_have_no_vote(spark):
    df = spark.createDataFrame([(i, "https://h.example.com/", "<article><h1>One</h1><p>The text of the page</p></article>") for i in range(20)], "page_id long, url string, html string")
    assert {r["text"] for r in extract(df).collect()} == {"One\nThe text of the page"}


def test_numbers_are_in_page_order():
    assert [n.number for n in walk(parse("<div><p>a</p></div><p>b"))] == list(range(6))


@pytest.mark.parametrize(
    ("html", "expected"),
    [
        ("<div class='layout has-sidebar'><article>a</article></div>", "a"),
        ("<div id='menu-open'><main>a</main></div>", "a"),
        ("<div class='no-comments'><p>a</p></div>", "a"),
        ("<form><nav>m</nav><div class='sidebar'><article>a</article></div></form>", "a"),
        ("<form><p>the whole page is in here</p></form><p>c</p>", "the whole page is in here\nc"),
        ("<article><p>a</p><div class='share-of-market'>b</div><div class='related-work'>c</div></article>", "a\nb\nc"),
        ("<article>a</article><div class='related'><article>teaser</article></div>", "a"),
        ("<aside><article>teaser</article></aside><p>a</p>", "a"),
        ("<p>a</p><div class='site-footer'>f</div><div class='cookie-banner-box'>k</div>", "a"),
    ],
)
def test_marks_around_the_article(html, expected):
    assert text(html) == expected


def generated(spark, layouts, pages=40, seed=3):
    """Pages of one host each, without article elements or telling names, and their main texts."""
    random.seed(seed)
    word = lambda: "".join(random.choice("abcdefghijklmnop") for _ in range(random.randint(2, 9)))
    line = lambda n: " ".join(word() for _ in range(n))
    rows, expected = [], {}
    for h, wrap in enumerate(layouts):
        legal = line(60)
        for i in range(pages):
            body = [line(random.randint(10, 60)) for _ in range(random.randint(2, 9))]
            menu = "".join(f"<li><a href='/{w}'>{w}</a>" for w in (word() for _ in range(random.randint(3, 8))))
            head, advert = line(4), line(6)
            text = f"<h1>{head}</h1>" + "".join(f"<p>{b}</p>" for b in body)
            html = wrap.format(menu=f"<ul>{menu}</ul>", advert=advert, text=text, legal=legal)
            rows.append((h * 1000 + i, f"https://h{h}.example.com/{i}", html))
            expected[h * 1000 + i] = "\n".join([head, *body])
    return spark.createDataFrame(rows, "page_id long, url string, html string"), expected


LAYOUTS = [
    "<html><body><div class=a>{menu}</div><div class=b>{advert}</div><div class=c>{text}</div><div class=d><p>{legal}</p></div></body></html>",
    "<html><body><table><tr><td>{menu}<td>{text}<td>{advert}</table><div>{legal}</div></body></html>",
    "<html><body><div><div>{menu}</div><div><div>{text}<div>{menu}</div><p>Read this too</p></div><div>{advert}</div></div></div><p>{legal}</p></body></html>",
]


def test_the_region_is_learned_from_structure(spark):
    df, expected = generated(spark, LAYOUTS)
    got = {r["page_id"]: r["text"] for r in extract(df).collect()}
    assert got == expected
    marks_only = {r["page_id"]: r["text"] for r in extract(df, induce=False).collect()}
    assert all(marks_only[i] != expected[i] for i in expected)


def test_two_pages_suffice_and_one_does_not(spark):
    df, expected = generated(spark, LAYOUTS[:1], pages=3)
    assert {r["page_id"]: r["text"] for r in extract(df).collect()} == expected
    alone = df.where("page_id = 0")
    assert {r["text"] for r in extract(alone).collect()} == {r["text"] for r in extract(alone, induce=False).collect()}


def test_a_teaser_is_not_the_article(spark):
    df, expected = generated(spark, [LAYOUTS[0].replace("{advert}", "<article>{advert}</article>")])
    assert {r["page_id"]: r["text"] for r in extract(df).collect()} == expected


def test_near_copies_keep_their_texts(spark):
    """Most pages of a host are near copies of one article: their common paragraphs are no template."""
    df, expected = generated(spark, LAYOUTS[:1], pages=1)
    first = df.first()["html"]
    words = expected[0].split("\n")[1].split()
    rows = [(i, f"https://h0.example.com/{i}", first.replace(words[3], f"other{i}", 1)) for i in range(30)]
    got = {r["page_id"]: r["text"] for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(set(expected[0].replace(words[3], f"other{i}", 1).split("\n")) <= set(got[i].split("\n")) for i in got)


def test_random_trees_align_largest():
    random.seed(5)

    def some(depth):
        return "".join(f"<{t}>{some(depth - 1) if depth else random.choice('xyz')}</{t}>" for t in random.choices(["div", "section", "ul"], k=random.randint(0, 3)))

    for _ in range(150):
        x, y = parse(some(3)), parse(some(3))
        pairs = align(x, y)
        assert len(pairs) == sizes(x, y)
        place = {id(n): i for i, n in enumerate(walk(y))}
        order = {id(n): i for i, n in enumerate(walk(x))}
        inside = {id(p): id(q) for p, q in pairs}
        assert len(inside) == len(pairs) == len(set(inside.values()))
        by_x = sorted(pairs, key=lambda pq: order[id(pq[0])])
        assert [place[id(q)] for _, q in by_x] == sorted(place[id(q)] for _, q in pairs)


def test_long_lists_are_halved(monkeypatch):
    from quillmill.llm import wrapper

    random.seed(8)
    some = lambda: parse("<ul>" + "".join(random.choice(["<li><p>a", "<li><p>a<p>b", "<li>x", "<div>d</div>"]) for _ in range(random.randint(5, 30))) + "</ul>")
    for _ in range(20):
        x, y = some(), some()
        monkeypatch.setattr(wrapper, "CELLS", 1 << 18)
        whole = len(align(x, y))
        monkeypatch.setattr(wrapper, "CELLS", 4)
        assert len(align(x, y)) == whole


def test_deep_and_long_pages(spark):
    deep = lambda n, t: "<div>" * n + t + "</div>" * n
    wide = lambda n, k: "<ul>" + "".join(f"<li><p>a{i}" + "<p>b" * (1 + i % k) for i in range(n)) + "</ul>"
    html = [deep(5000, "one two"), deep(4990, "three four"), deep(5000, "five"), wide(10000, 2), wide(9500, 3), wide(10000, 2)]
    df = spark.createDataFrame([(i, f"https://h{i // 3}.example.com/{i}", h) for i, h in enumerate(html)], "page_id long, url string, html string")
    began = time.time()
    got = {r["page_id"]: r["text"] for r in extract(df).collect()}
    assert time.time() - began < 120
    assert got[0] == "one two" and got[1] == "three four" and len(got) == 6


def test_headings_that_every_article_repeats_stay(spark):
    """Induction never loses a block of a marked article that marks alone keep."""
    words = random.Random(3)
    pages = []
    for i in range(12):
        part = lambda: " ".join(words.choice("flour butter sugar bake stir rest serve pour chop grind".split()) for _ in range(30))
        body = f"<article><h1>Cake {i}</h1><h2>Ingredients</h2><p>{part()}</p><h2>Method</h2><p>{part()}</p><p>As seen in our column.</p></article>"
        pages.append((i, f"https://cakes.example.com/{i}", f"<html><body><div>All cakes</div>{body}<div>Imprint and terms</div></body></html>"))
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"].split("\n") for r in extract(df).collect()}
    plain = {r["page_id"]: r["text"].split("\n") for r in extract(df, induce=False).collect()}
    for i in range(12):
        assert {"Ingredients", "Method", "As seen in our column."} <= set(got[i])
        assert [b for b in plain[i] if b not in ("All cakes", "Imprint and terms")] == got[i]
