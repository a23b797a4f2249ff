"""Queries over whole elements of pages."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from quillmill.operators import elements as E
from quillmill.plans.registry import Registry, derived, same

registry = Registry()
query = registry.add

#: Pages inside layouts of several kinds: nested elements, a region that is too short, none at all, one that is never closed.
LAYOUT = """SELECT page_id, concat('<div class="ads wide"><div>in</div> ad</div><p data-testid="share">s</p>', CASE page_id % 7 WHEN 0 THEN concat('<div class="post-content"><div class="user-comment-list">c<div>d</div></div>', html, '</div>')
  WHEN 1 THEN concat('<div id="content"><section role="main">short</section>', html, '</div>') WHEN 2 THEN concat('<article>tiny</article><main>', html, '</main>') WHEN 3 THEN '<article>tiny</article>' WHEN 4 THEN '<div class="article">x <b>y</b></div><div class="content">short</div>'
  WHEN 5 THEN concat('<a class="header-anchor" href="#">#</a><DIV CLASS="post available-content"><div class="inner">', html, '</div><video src="v"></video></DIV>') ELSE html END, '<iframe src="https://a.example.com/x"></iframe><iframe src="https://mp.weixin.example.com/"></iframe><div class="unclosed ads">rest') AS html FROM {pages}"""


def attribute(name: str) -> str:
    return f"regexp_extract(token, '(?i)\\s{name}\\s*=\\s*[\"'']([^\"'']*)[\"'']', 1)"


def test(selector: str) -> str:
    """SQL of one selector on a tag."""
    out: list[str] = []
    positive, _, negative = selector.partition(":not(")
    if tag := re.match("[a-z]*", positive)[0]:
        out.append(f"name = '{tag}'")
    for source, no in ((positive, ""), (negative, "NOT ")):
        for found in re.finditer(r"\.([\w-]+)|#([\w-]+)|\[([\w-]+)(\*?)=\"([^\"]*)\"\]", source):
            cls, id_, attr, part, value = found.groups()
            if selector == "time[datetime]":
                continue
            if cls:
                out.append(f"list_contains(regexp_split_to_array({attribute('class')}, '\\s+'), '{cls}')")
            elif id_:
                out.append(f"{attribute('id')} = '{id_}'")
            else:
                out.append(no + (f"contains({attribute(attr)}, '{value}')" if part else f"{attribute(attr)} = '{value}'"))
    if selector == "time[datetime]":
        out.append("regexp_matches(token, '(?i)\\sdatetime\\b')")
    return " AND ".join(out)


def tokens_sql(pages: str) -> str:
    return f"""p AS ({same(pages)}), a AS (SELECT page_id, regexp_extract_all(regexp_replace(html, '(?is)<!--.*?-->|<script\\b.*?</script\\s*>|<style\\b.*?</style\\s*>', '', 'g'), '<[^<>]*>|[^<]+|<') AS a FROM p),
    u AS (SELECT page_id, unnest(a) AS token, unnest(generate_series(0, len(a) - 1)) AS pos FROM a),
    t AS (SELECT *, lower(regexp_extract(token, '^<(/?)([A-Za-z][A-Za-z0-9:-]*)', 2)) AS name, regexp_extract(token, '^<(/?)([A-Za-z][A-Za-z0-9:-]*)', 1) = '/' AS closing FROM u),
    d AS (SELECT *, sum(CASE WHEN closing THEN -1 ELSE 1 END) OVER (PARTITION BY page_id, name ORDER BY pos) AS d FROM t WHERE name <> ''),
    e AS (SELECT o.page_id, o.pos, o.token, o.name, coalesce(min(c.pos), o.pos) AS until FROM d o LEFT JOIN d c ON c.page_id = o.page_id AND c.name = o.name AND c.closing AND c.pos > o.pos AND c.d = o.d - 1 WHERE NOT o.closing GROUP BY o.page_id, o.pos, o.token, o.name)"""


TOKENS = tokens_sql(LAYOUT)


@query("junk_elements", f"""
    WITH {TOKENS}, hit AS (SELECT page_id, pos, until FROM e WHERE {' OR '.join(f'({test(s)})' for s in E.JUNK)}),
    kept AS (SELECT page_id, string_agg(token, '' ORDER BY pos) AS html FROM t WHERE NOT EXISTS (SELECT 1 FROM hit h WHERE h.page_id = t.page_id AND t.pos BETWEEN h.pos AND h.until) GROUP BY page_id)
    SELECT page_id, md5(coalesce(kept.html, '')) AS html_md5, (SELECT count(*) FROM hit h WHERE h.page_id = p.page_id) AS removed FROM p LEFT JOIN kept USING (page_id)""")  # fmt: skip
def junk_elements(spark, sf_dir):
    return E.remove(derived(spark, sf_dir, LAYOUT), "page_id", "html").select("page_id", F.md5("html").alias("html_md5"), "removed")


@query("article_region", f"""
    WITH {TOKENS}, s AS ({' UNION ALL '.join(f"SELECT page_id, {i} AS rank, pos, until FROM e WHERE {test(s)}" for i, s in enumerate(E.ARTICLE))}),
    f AS (SELECT page_id, rank, min(pos) AS pos, arg_min(until, pos) AS until FROM s GROUP BY page_id, rank),
    n AS (SELECT f.page_id, rank, f.pos, until, sum(CASE WHEN t.name = '' THEN length(t.token) ELSE 0 END) AS chars FROM f JOIN t ON t.page_id = f.page_id AND t.pos BETWEEN f.pos AND f.until GROUP BY ALL),
    c AS (SELECT page_id, min(rank) AS rank, arg_min(pos, rank) AS pos, arg_min(until, rank) AS until FROM n WHERE chars > {E.ENOUGH} OR rank = {len(E.ARTICLE) - 1} GROUP BY page_id),
    r AS (SELECT t.page_id, min(c.rank) AS rank, string_agg(token, '' ORDER BY t.pos) AS html FROM t LEFT JOIN c USING (page_id) WHERE c.pos IS NULL OR t.pos BETWEEN c.pos AND c.until GROUP BY t.page_id)
    SELECT page_id, rank, md5(coalesce(r.html, '')) AS region_md5 FROM p LEFT JOIN r USING (page_id)""")  # fmt: skip
def article_region(spark, sf_dir):
    return E.main_region(derived(spark, sf_dir, LAYOUT), "page_id", "html").select("page_id", "rank", F.md5("html").alias("region_md5"))


#: Pages after bylines of every kind, with attributes in any order and elements inside.
SIGNED = """SELECT page_id, concat(CASE page_id % 11 WHEN 0 THEN '<a href="/u" rel="author"> Ann <b>Lee</b></a>' WHEN 1 THEN '<span id="a" class="big author">Bob</span>' WHEN 2 THEN '<div class="byline"><div>by</div> Cy</div>' WHEN 3 THEN '<i itemprop="author">Di</i>' WHEN 4 THEN '<p class="post-author">Ed</p>'
  WHEN 5 THEN '<a rel="author"></a><u class="author">Flo</u>' WHEN 6 THEN '<u class="author"></u><u class="author">second</u>' ELSE '' END, CASE page_id % 7 WHEN 0 THEN '<time class="x" datetime="2024-01-02">yesterday</time>' WHEN 1 THEN '<time>no</time><b itemprop="datePublished" datetime="2023-05-06">x</b>' WHEN 2 THEN '<div class="published">on <i>May 5</i></div>'
  WHEN 3 THEN '<span class="post-date"> June </span>' WHEN 4 THEN '<span class="date">July</span>' WHEN 5 THEN '<span class="published"></span><span class="date">August</span>' ELSE '' END, html) AS html FROM {pages}"""


@query("byline_pick", f"""
    WITH {tokens_sql(SIGNED)}, s AS ({' UNION ALL '.join(f"SELECT page_id, {i} AS rank, pos, until, token FROM e WHERE {test(s)}" for i, s in enumerate([*E.AUTHORS, *E.TIMES]))}),
    f AS (SELECT page_id, rank, min(pos) AS pos, arg_min(until, pos) AS until, arg_min(token, pos) AS token FROM s GROUP BY page_id, rank),
    x AS (SELECT f.page_id, rank, min(f.token) AS token, trim(coalesce(string_agg(t.token, '' ORDER BY t.pos), '')) AS text FROM f LEFT JOIN t ON t.page_id = f.page_id AND t.name = '' AND t.pos BETWEEN f.pos AND f.until GROUP BY f.page_id, rank),
    who AS (SELECT page_id, arg_min(text, rank) AS author FROM x WHERE rank < {len(E.AUTHORS)} AND text <> '' GROUP BY page_id),
    times AS (SELECT page_id, arg_min(coalesce(nullif({attribute('datetime')}, ''), text), rank) AS published FROM x WHERE rank >= {len(E.AUTHORS)} GROUP BY page_id)
    SELECT page_id, coalesce(author, '') AS author, coalesce(published, '') AS published FROM p LEFT JOIN who USING (page_id) LEFT JOIN times USING (page_id)""")  # fmt: skip
def byline_pick(spark, sf_dir):
    return E.author_and_time(derived(spark, sf_dir, SIGNED), "page_id", "html")


#: Pages after marks inside marks, by tags and by styles.
STYLED = """SELECT page_id, concat('<p>plain <b>bold <i>both</i> <strong>once</strong></b> tail <a href="u"><code>x = ', CAST(page_id AS STRING), '</code></a>', CASE page_id % 3 WHEN 0 THEN '<span style="color:red; font-weight: 700">heavy <em>slanted</em></span>'
  WHEN 1 THEN '<span style="FONT-STYLE:italic;font-weight:bold">two <mark>lit</mark></span><span style="font-weight: 400">normal</span>' ELSE '<b> </b><i>never closed' END, '</p>', html) AS html FROM {pages}"""
_MARKED = " UNION ALL ".join(
    [f"SELECT page_id, pos, until, '{mark}' AS mark FROM e WHERE name = '{tag}'" for tag, mark in E.MARKS.items()]
    + [f"SELECT page_id, pos, until, '{mark}' FROM e WHERE regexp_matches({attribute('style')}, '{pattern}')" for mark, pattern in E.STYLES.items()]
)


@query("styled_spans", f"""
    WITH {tokens_sql(STYLED)}, m AS ({_MARKED}), d2 AS (SELECT DISTINCT t.page_id, t.pos, t.token, m.mark FROM t JOIN m ON m.page_id = t.page_id AND t.pos BETWEEN m.pos AND m.until WHERE t.name = '' AND trim(t.token) <> '')
    SELECT page_id, pos, token AS text, string_agg(mark, ',' ORDER BY mark) AS marks FROM d2 GROUP BY page_id, pos, token""")  # fmt: skip
def styled_spans(spark, sf_dir):
    return E.mark_spans(derived(spark, sf_dir, STYLED), "page_id", "html").select("page_id", "pos", "text", F.array_join("marks", ",").alias("marks"))
