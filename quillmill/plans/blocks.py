"""Queries over blocks of pages and lines of documents."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillmill.operators import blocks as B
from quillmill.plans.registry import Registry, derived, same, table
from quillmill.plans.texts import ws

registry = Registry()
query = registry.add

CUTS = ", ".join(f"'{t}'" for t in B.BLOCK_TAGS)
BLOCKS = f"""
    src AS (SELECT page_id, url, regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\\b.*?</script>', '', 'g'), '(?is)<style\\b.*?</style>', '', 'g'), '(?s)<!--.*?-->', '', 'g') AS h FROM pages),
    arr AS (SELECT page_id, regexp_extract_all(h, '<[^>]+>|[^<]+') AS a FROM src),
    tok AS (SELECT page_id, unnest(a) AS tok, unnest(generate_series(1, len(a))) AS pos FROM arr),
    named AS (SELECT *, lower(regexp_extract(tok, '^</?([a-zA-Z][a-zA-Z0-9]*)', 1)) AS name FROM tok),
    numbered AS (SELECT *, CAST(sum(CASE WHEN name IN ({CUTS}) THEN 1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY pos) AS BIGINT) AS block FROM named),
    raw AS (SELECT page_id, block, coalesce(max(CASE WHEN name IN ({CUTS}) AND NOT prefix(tok, '</') THEN name END), '') AS tag,
      string_agg(CASE WHEN name = 'br' THEN chr(10) WHEN prefix(tok, '<') THEN '' ELSE tok END, '' ORDER BY pos) AS raw FROM numbered GROUP BY page_id, block),
    blocks AS (SELECT page_id, block, tag, CASE WHEN regexp_matches(tag, '^h[1-6]$') THEN CAST(substring(tag, 2, 1) AS INT) ELSE 0 END AS level,
      {ws("regexp_replace(raw, '[ \\t\\r\\n]+', ' ', 'g')")} AS text FROM raw)"""
TYPE = """CASE WHEN regexp_matches(tag, '^h[1-6]$') THEN 'heading' WHEN tag = 'p' THEN 'paragraph' WHEN tag IN ('ul', 'ol', 'li') THEN 'list'
    WHEN tag = 'blockquote' THEN 'quote' WHEN tag IN ('pre', 'code') THEN 'code' ELSE 'other' END"""


@query("block_table", f"WITH {BLOCKS} SELECT * FROM blocks")
def block_table(spark, sf_dir):
    return B.block_table(table(spark, sf_dir, "pages"))


@query("block_type", f"WITH {BLOCKS} SELECT page_id, block, {TYPE} AS kind FROM blocks")
def block_type(spark, sf_dir):
    return B.block_table(table(spark, sf_dir, "pages")).select("page_id", "block", B.block_type(F.col("tag")).alias("kind"))


@query("structure_profile", f"""
    WITH {BLOCKS}, t AS (SELECT page_id, block, text, {TYPE} AS kind FROM blocks)
    SELECT page_id, count_if(text = '') AS empty_blocks, count(*) AS blocks, array_to_string(list(kind ORDER BY block)[1:20], ',') AS first_kinds FROM t GROUP BY page_id""")  # fmt: skip
def structure_profile(spark, sf_dir):
    rows = B.block_table(table(spark, sf_dir, "pages"))
    kinds = F.transform(F.slice(F.array_sort(F.collect_list(F.struct(F.col("block"), B.block_type(F.col("tag")).alias("kind")))), 1, 20), lambda x: x["kind"])
    return rows.groupBy("page_id").agg(F.count_if(F.col("text") == "").alias("empty_blocks"), F.count(F.lit(1)).alias("blocks"), F.array_join(kinds, ",").alias("first_kinds"))


@query("blank_run_collapse", f"""
    WITH {BLOCKS}, w AS (SELECT *, lag(text = '') OVER (PARTITION BY page_id ORDER BY block) AS was,
      min(CASE WHEN text <> '' THEN block END) OVER (PARTITION BY page_id) AS lo, max(CASE WHEN text <> '' THEN block END) OVER (PARTITION BY page_id) AS hi FROM blocks)
    SELECT page_id, block, tag, level, text FROM w WHERE block BETWEEN lo AND hi AND NOT (text = '' AND coalesce(was, false))""")  # fmt: skip
def blank_run_collapse(spark, sf_dir):
    return B.collapse_blank(B.block_table(table(spark, sf_dir, "pages")), "page_id", "block", "text")


@query("spacer_insert", f"""
    WITH {BLOCKS}, w AS (SELECT page_id, block, text, lag(text) OVER (PARTITION BY page_id ORDER BY block) AS b FROM blocks)
    SELECT page_id, block, 1 AS half, text FROM w UNION ALL
    SELECT page_id, block, 0 AS half, '' AS text FROM w WHERE b <> '' AND text <> '' AND NOT (regexp_matches(b, '^(•|\\d+[.、)])\\s*') AND regexp_matches(text, '^(•|\\d+[.、)])\\s*'))""")  # fmt: skip
def spacer_insert(spark, sf_dir):
    return B.insert_spacers(B.block_table(table(spark, sf_dir, "pages")), "page_id", "block", "text")


KEY = r"lower(regexp_replace(coalesce({}, ''), '[\x{{200b}}\x{{200c}}\x{{200d}}\x{{2060}}\x{{feff}}\s.,;:!?。，；：！？、]', '', 'g'))"


@query("leading_title_drop", f"""
    WITH {BLOCKS}, t AS (SELECT page_id, {ws("regexp_replace(regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1), '<[^>]+>', '', 'g')")} AS title FROM pages),
    w AS (SELECT b.*, title, min(CASE WHEN {KEY.format('text')} = {KEY.format('title')} OR text = '' THEN 1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY block) AS lead FROM blocks b JOIN t USING (page_id))
    SELECT page_id, block, text FROM w WHERE lead = 0""")  # fmt: skip
def leading_title_drop(spark, sf_dir):
    from quillmill.functions.text import trimmed

    pages = table(spark, sf_dir, "pages")
    titles = pages.select(F.col("page_id").alias("_id"), trimmed(F.regexp_replace(F.regexp_extract("html", r"(?is)<h1[^>]*>(.*?)</h1>", 1), r"<[^>]+>", "")).alias("title"))
    rows = B.block_table(pages).join(titles, F.col("page_id") == F.col("_id"))
    return B.drop_leading_title(rows, "page_id", "block", "text", "title").select("page_id", "block", "text")


@query("list_to_paragraphs", f"""
    WITH l AS (SELECT page_id, regexp_extract_all(regexp_replace(html, '(?is)<script\\b.*?</script>', '', 'g'), '(?is)<[uo]l\\b.*?</[uo]l>') AS ls FROM pages),
    e AS (SELECT page_id, unnest(ls) AS src, unnest(generate_series(0, len(ls) - 1)) AS list FROM l),
    i AS (SELECT page_id, list, lower(substring(src, 2, 2)) AS kind, regexp_extract_all(src, '(?is)<li\\b[^>]*>(.*?)</li>', 1) AS its FROM e),
    x AS (SELECT page_id, list, kind, unnest(its) AS item, unnest(generate_series(0, len(its) - 1)) AS pos FROM i),
    c AS (SELECT page_id, list, kind, pos, {ws("regexp_replace(item, '<[^>]+>', '', 'g')")} AS item FROM x),
    n AS (SELECT *, row_number() OVER (PARTITION BY page_id, list ORDER BY pos) AS n FROM c WHERE item <> '')
    SELECT page_id, list, n, concat(CASE WHEN kind = 'ol' THEN concat(n, '. ') ELSE '• ' END, item) AS text FROM n""")  # fmt: skip
def list_to_paragraphs(spark, sf_dir):
    return B.list_paragraphs(table(spark, sf_dir, "pages"))


#: The pages with links of every form after their own.
LINKING = """SELECT page_id, url, concat(html, '<a href="', CASE page_id % 12 WHEN 0 THEN '//cdn.example.com/a?b#c' WHEN 1 THEN '../up/x.html' WHEN 2 THEN 'next' WHEN 3 THEN '?page=2' WHEN 4 THEN '#top' WHEN 5 THEN '' WHEN 6 THEN 'mailto:a@example.com'
  WHEN 7 THEN 'https://example.com/./x/../y' WHEN 8 THEN '/a/./b/../c/..' WHEN 9 THEN './here/../there/?q=../x' WHEN 10 THEN ' /spaced ' ELSE '../../../../far/.' END, '">x</a>') AS html FROM {pages}"""


@query("anchor_table", rf"""
    WITH p AS ({same(LINKING)}), l AS (SELECT page_id, url, regexp_extract_all(html, '(?i)<a\b[^>]*?href="([^"]*)"', 1) AS hs FROM p),
    e AS (SELECT page_id, url, unnest(hs) AS href, unnest(generate_series(0, len(hs) - 1)) AS ord FROM l),
    s AS (SELECT page_id, ord, trim(href) AS h, regexp_extract(url, '^(https?://[^/?#]+)', 1) AS origin, regexp_extract(url, '^(https?:)', 1) AS scheme, regexp_extract(url, '^[^?#]*(\?[^#]*)', 1) AS query,
      CASE regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) WHEN '' THEN '/' ELSE regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) END AS path FROM e),
    w AS (SELECT *, regexp_extract(h, '^[^?#]*(.*)$', 1) AS tail, concat(CASE WHEN prefix(h, '/') THEN '' ELSE regexp_extract(path, '^(.*/)', 1) END, regexp_extract(h, '^([^?#]*)', 1)) AS target FROM s),
    f AS (SELECT *, CASE WHEN regexp_matches(target, '/\.\.?(/|$)') THEN concat(list_reduce(list_prepend('', string_split(substr(target, 2), '/')), lambda a, x: CASE x WHEN '..' THEN regexp_replace(a, '/[^/]*$', '') WHEN '.' THEN a ELSE concat(a, '/', x) END),
      CASE WHEN regexp_matches(target, '/\.\.?$') THEN '/' ELSE '' END) ELSE target END AS flat FROM w)
    SELECT page_id, ord, CASE WHEN regexp_matches(h, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN h WHEN prefix(h, '//') THEN concat(scheme, h) WHEN h = '' OR prefix(h, '#') THEN concat(origin, path, query, h)
      WHEN prefix(h, '?') THEN concat(origin, path, h) ELSE concat(origin, flat, tail) END AS url FROM f""")  # fmt: skip
def anchor_table(spark, sf_dir):
    return B.anchors(derived(spark, sf_dir, LINKING))


LINES = "l AS (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents), lines AS (SELECT doc_id, unnest(a) AS line, unnest(generate_series(0, len(a) - 1)) AS line_no FROM l)"


@query("md_line_blocks", f"""
    WITH {LINES}, f AS (SELECT *, CASE WHEN regexp_matches(line, '^\\s*```') THEN 1 ELSE 0 END AS f FROM lines),
    o AS (SELECT *, coalesce(sum(f) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) % 2 = 1 AS open FROM f),
    k AS (SELECT *, CASE WHEN open OR f = 1 THEN 'code' WHEN regexp_matches(line, '^\\s*$') THEN 'blank' WHEN regexp_matches(line, '^#{{1,6}}\\s') THEN 'heading'
      WHEN regexp_matches(line, '^>') THEN 'quote' WHEN regexp_matches(line, '^\\s*([-*+]|\\d+[.)])\\s') THEN 'list' WHEN contains(line, ' | ') THEN 'table' ELSE 'paragraph' END AS kind FROM o),
    p AS (SELECT *, lag(kind) OVER (PARTITION BY doc_id ORDER BY line_no) AS b FROM k),
    n AS (SELECT *, CAST(sum(CASE WHEN b IS NULL OR b <> kind OR kind = 'heading' OR (kind = 'code' AND f = 1 AND NOT open) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS BIGINT) AS block FROM p)
    SELECT doc_id, block, kind, count(*) AS n_lines, string_agg(line, chr(10) ORDER BY line_no) AS text FROM n WHERE kind <> 'blank' GROUP BY doc_id, block, kind""")  # fmt: skip
def md_line_blocks(spark, sf_dir):
    return B.markdown_blocks(table(spark, sf_dir, "documents"))


@query("ordered_dedup", f"""
    WITH {LINES}, r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, line ORDER BY line_no) AS n FROM lines) SELECT doc_id, line_no, line FROM r WHERE n = 1""")  # fmt: skip
def ordered_dedup(spark, sf_dir):
    from quillmill.operators.sequences import first_of_each

    return first_of_each(B.lines(table(spark, sf_dir, "documents")), ["doc_id", "line"], ["line_no"])


TWO_PARTS = "SELECT conv_id, turn, concat(role, chr(10), '  ', chr(10), text, chr(10), chr(10), chr(10), ' ', CAST(turn AS STRING)) AS text FROM {conversations}"


@query("paragraph_split", f"""
    WITH s AS (SELECT conv_id, turn, regexp_split_to_array(text, '\\n\\s*\\n+') AS a FROM ({same(TWO_PARTS)})),
    e AS (SELECT conv_id, turn, unnest(a) AS p, unnest(generate_series(0, len(a) - 1)) AS pos FROM s)
    SELECT conv_id, turn, pos, {ws('p')} AS paragraph FROM e WHERE {ws('p')} <> ''""")  # fmt: skip
def paragraph_split(spark, sf_dir):
    from quillmill.functions.text import trimmed

    parts = derived(spark, sf_dir, TWO_PARTS).select("conv_id", "turn", F.posexplode(F.split("text", r"\n\s*\n+")).alias("pos", "p"))
    return parts.select("conv_id", "turn", "pos", trimmed(F.col("p")).alias("paragraph")).where("paragraph <> ''")


PROMPTS = "SELECT page_id, concat('Intro ', CAST(page_id AS STRING), ' 提示词：draw a cat 适用：all models') AS line FROM {pages}"


@query("keyword_split", f"""
    WITH s AS (SELECT page_id, string_split(regexp_replace(line, '(提示词：|适用：)', chr(1) || '\\1', 'g'), chr(1)) AS a FROM ({same(PROMPTS)})),
    e AS (SELECT page_id, unnest(a) AS p, unnest(generate_series(0, len(a) - 1)) AS pos FROM s) SELECT page_id, pos, {ws('p')} AS part FROM e WHERE {ws('p')} <> ''""")  # fmt: skip
def keyword_split(spark, sf_dir):
    from quillmill.functions.text import trimmed

    parts = derived(spark, sf_dir, PROMPTS).select("page_id", F.posexplode(F.split(F.regexp_replace("line", r"(提示词：|适用：)", "\x01$1"), "\x01")).alias("pos", "p"))
    return parts.select("page_id", "pos", trimmed(F.col("p")).alias("part")).where("part <> ''")


LINKED = """SELECT page_id, concat('See ', url, ' and (https://example.com/a?b=', CAST(page_id AS STRING), ') or <A class="l" href="', url, '">', url, ' <b>b</b></a>', CASE page_id % 3 WHEN 0 THEN ' <a href="x">https://in.example.com' WHEN 1 THEN '<abbr>https://abbr.example.com</abbr>' ELSE '' END, url, '.') AS line FROM {pages}"""


@query("inline_links", f"""
    WITH s AS (SELECT page_id, regexp_extract_all(regexp_replace(line, '(?is)<a(?:\\s[^>]*)?>.*?</a>', ' ', 'g'), 'https?://[^\\s<>"'')\\]]+') AS a FROM ({same(LINKED)}))
    SELECT page_id, unnest(generate_series(0, len(a) - 1)) AS ord, unnest(a) AS url FROM s""")  # fmt: skip
def inline_links(spark, sf_dir):
    """Addresses in a text, but for those inside links."""
    free = F.regexp_replace("line", r"(?is)<a(?:\s[^>]*)?>.*?</a>", " ")
    return derived(spark, sf_dir, LINKED).select("page_id", F.posexplode(F.regexp_extract_all(free, F.lit(r"(https?://[^\s<>\"')\]]+)"), F.lit(1))).alias("ord", "url"))


FRONT = """SELECT page_id, concat('---', chr(10), 'title: Page ', CAST(page_id AS STRING), chr(10), 'tags: a, b', chr(10), CASE WHEN page_id % 2 = 0 THEN concat('draft: yes', chr(10)) ELSE '' END,
  'date: 2024-01-01', chr(10), '---', chr(10), 'body') AS md FROM {pages}"""


@query("front_matter", f"""
    WITH h AS (SELECT page_id, regexp_extract(md, '(?s)^---\\n(.*?)\\n---', 1) AS head FROM ({same(FRONT)})), l AS (SELECT page_id, unnest(string_split(head, chr(10))) AS line FROM h),
    k AS (SELECT page_id, regexp_extract(line, '^([A-Za-z_]+):\\s*(.*)$', 1) AS k, regexp_extract(line, '^([A-Za-z_]+):\\s*(.*)$', 2) AS v FROM l)
    SELECT page_id, max(CASE WHEN k = 'title' THEN v END) AS title, max(CASE WHEN k = 'tags' THEN v END) AS tags, max(CASE WHEN k = 'date' THEN v END) AS date,
      count_if(k <> '' AND k NOT IN ('title', 'tags', 'date')) AS ignored FROM k GROUP BY page_id""")  # fmt: skip
def front_matter(spark, sf_dir):
    head = F.regexp_extract("md", r"(?s)^---\n(.*?)\n---", 1)
    rows = derived(spark, sf_dir, FRONT).select("page_id", F.explode(F.split(head, "\n")).alias("line"))
    rows = rows.select("page_id", F.regexp_extract("line", r"^([A-Za-z_]+):\s*(.*)$", 1).alias("k"), F.regexp_extract("line", r"^([A-Za-z_]+):\s*(.*)$", 2).alias("v"))
    used = [F.max(F.when(F.col("k") == k, F.col("v"))).alias(k) for k in ("title", "tags", "date")]
    return rows.groupBy("page_id").agg(*used, F.count_if((F.col("k") != "") & ~F.col("k").isin("title", "tags", "date")).alias("ignored"))


#: Documents as Markdown files with what each warning is about, and how often each has it.
IMPORTED = """SELECT doc_id, CASE doc_id % 9 WHEN 0 THEN concat('![a](img/', CAST(doc_id AS STRING), '.png) ![b](https://example.com/b.png) ', text) WHEN 1 THEN concat('![c](data:image/png;base64,AA) ![d](../d.png) ', text) WHEN 2 THEN concat(text, ' [x](javascript:void) [y](https://example.com)')
  WHEN 3 THEN concat('---', chr(10), 'title: T', chr(10), 'draft: yes', chr(10), 'layout: z', chr(10), '---', chr(10), text) WHEN 4 THEN concat('| a | b |', chr(10), '| --- | --- |', chr(10), '| 1 | 2 |', chr(10), text) WHEN 5 THEN concat('<script>x</script><iframe src="a"></iframe>', text)
  WHEN 6 THEN concat('[^1] and [TOC] ', text) WHEN 7 THEN '   ' ELSE text END AS md FROM {documents}"""
_ONE = "len(regexp_extract_all(md, '{}'))"
_COUNTED = {
    "unsupported_syntax": r"CAST(regexp_matches(md, '(?i)```\s*mermaid\b') AS INT) + CAST(regexp_matches(md, '\[\^[^\]]+\]') AS INT) + CAST(regexp_matches(md, '(?i)(^|\n)\[\[?toc\]?\](\n|$)') AS INT)",
    "local_image_degraded": _ONE.format(r"!\[[^\]]*\]\(") + " - " + _ONE.format(r"!\[[^\]]*\]\((?:https?:|data:)"),
    "data_image_degraded": _ONE.format(r"!\[[^\]]*\]\(data:"),
    "table_fallback_text": _ONE.format(r"(?m)^\s*\|?(?:\s*:?-{3,}:?\s*\|)+\s*(?::?-{3,}:?\s*\|?)?\s*$"),
    "invalid_link": _ONE.format(r"\]\((?:javascript|vbscript|file):"),
    "html_sanitized": _ONE.format(r"(?i)<(?:script|iframe|object|embed|style)\b"),
}


@query("warning_rollup", f"""
    WITH m AS ({same(IMPORTED)}), h AS (SELECT doc_id, md, string_split(regexp_extract(md, '(?s)^---\\n(.*?)\\n---', 1), chr(10)) AS head FROM m),
    c AS (SELECT doc_id, CAST(trim(md) = '' AS INT) AS empty_content, {', '.join(f"{sql} AS {name}" for name, sql in _COUNTED.items())},
      len(list_filter(head, lambda x: regexp_matches(x, '^[A-Za-z_]+:') AND regexp_extract(x, '^([A-Za-z_]+):', 1) NOT IN ('title', 'tags', 'date'))) AS front_matter_ignored, CAST(strlen(md) > 2097152 AS INT) AS large_file FROM h),
    w AS ({' UNION ALL '.join(f"SELECT doc_id, {i} AS ord, '{code}' AS code, '{level}' AS level, CAST({code.lower()} AS BIGINT) AS n FROM c" for i, (code, level) in enumerate(B.WARNINGS) if code != 'TABLE_RENDER_FAILED')})
    SELECT doc_id, ord, code, level, n FROM w WHERE n > 0""")  # fmt: skip
def warning_rollup(spark, sf_dir):
    return B.warnings(B.import_counts(derived(spark, sf_dir, IMPORTED), "md"), "doc_id")


#: A document's lines as entries: links to quoted articles, quotes, blanks and others.
ENTRIES = f"""{LINES}, e AS (SELECT doc_id, line_no, CASE WHEN (line_no * 7 + doc_id) % 5 = 0 THEN 1 ELSE (line_no + doc_id) % 9 END AS k, line FROM lines),
    r AS (SELECT doc_id, line_no, CASE WHEN k IN (2, 4, 5, 7) THEN 'quote' WHEN k = 8 THEN 'image' ELSE 'paragraph' END AS kind, CASE k WHEN 0 THEN concat(' 🔗 引用文章：', line) WHEN 1 THEN ' ' WHEN 7 THEN CASE WHEN doc_id % 2 = 0 THEN '' ELSE line END ELSE line END AS text,
      CASE WHEN line_no % 3 = 1 THEN concat('g', line_no) END AS "group" FROM e)"""


@query("quote_run_merge", f"""
    WITH RECURSIVE {ENTRIES}, f AS (SELECT *, kind = 'paragraph' AND trim(text) = '' AS blank, kind = 'paragraph' AND regexp_matches(trim(text), '^🔗\\s*引用文章：') AS ref, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS i FROM r),
    n AS (SELECT *, coalesce(lead(kind) OVER w = 'quote', false) AS then_quote, coalesce(lag(ref) OVER w, false) OR (coalesce(lag(blank) OVER w, false) AND coalesce(lag(ref, 2) OVER w, false)) AS led FROM f WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
    walk AS (SELECT doc_id, 0::BIGINT AS i, 0::BIGINT AS head, false AS was_quote FROM (SELECT DISTINCT doc_id FROM n) UNION ALL
      SELECT n.doc_id, n.i, CASE WHEN n.kind = 'quote' THEN CASE WHEN w.head > 0 THEN w.head WHEN n.led AND NOT w.was_quote THEN n.i ELSE 0 END WHEN n.blank AND n.then_quote AND w.was_quote THEN w.head ELSE 0 END, n.kind = 'quote' OR (w.head = 0 AND n.blank AND n.then_quote AND w.was_quote)
      FROM walk w JOIN n ON n.doc_id = w.doc_id AND n.i = w.i + 1),
    j AS (SELECT n.*, w.head FROM n JOIN walk w USING (doc_id, i)),
    said AS (SELECT *, sum(CASE WHEN blank THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, head ORDER BY i) AS b FROM j WHERE head > 0),
    joint AS (SELECT *, lag(b) OVER (PARTITION BY doc_id, head ORDER BY i) AS p FROM said WHERE kind = 'quote' AND text <> ''),
    texts AS (SELECT doc_id, head, string_agg(concat(CASE WHEN p IS NULL THEN '' WHEN b > p THEN chr(10) || chr(10) ELSE chr(10) END, text), '' ORDER BY i) AS text FROM joint GROUP BY doc_id, head),
    groups AS (SELECT doc_id, head, count(*) AS merged, min_by("group", i) FILTER (WHERE "group" IS NOT NULL) AS g FROM said GROUP BY doc_id, head)
    SELECT doc_id, line_no, kind, text, "group", 1::BIGINT AS merged FROM j WHERE head = 0 UNION ALL
    SELECT j.doc_id, j.line_no, 'quote', t.text, g.g, g.merged FROM texts t JOIN groups g USING (doc_id, head) JOIN j ON j.doc_id = t.doc_id AND j.i = t.head""")  # fmt: skip
def quote_run_merge(spark, sf_dir):
    rows = B.lines(table(spark, sf_dir, "documents")).withColumn("k", F.when((F.col("line_no") * 7 + F.col("doc_id")) % 5 == 0, 1).otherwise((F.col("line_no") + F.col("doc_id")) % 9))
    kind = F.when(F.col("k").isin(2, 4, 5, 7), "quote").when(F.col("k") == 8, "image").otherwise("paragraph")
    text = F.when(F.col("k") == 0, F.concat(F.lit(" 🔗 引用文章："), "line")).when(F.col("k") == 1, " ").when((F.col("k") == 7) & (F.col("doc_id") % 2 == 0), "").otherwise(F.col("line"))
    group = F.when(F.col("line_no") % 3 == 1, F.concat(F.lit("g"), F.col("line_no").cast("string")))
    return B.merge_quote_runs(rows.select("doc_id", "line_no", kind.alias("kind"), text.alias("text"), group.alias("group")), "doc_id", ["line_no"])


MARKED = """SELECT conv_id, turn, CASE (conv_id + turn) % 8 WHEN 0 THEN concat('Steps: 1. ', text, ' 2. then this 3) and that') WHEN 1 THEN concat('- ', text, ' - next item • another') WHEN 2 THEN concat(text, ' - not a list - at all')
  WHEN 3 THEN concat('说明：→ ', text, '。 ➜ 第二步 a) 第三步') WHEN 4 THEN text WHEN 5 THEN concat('x1. ', text, '!- tight 5 - six') WHEN 6 THEN '  ' ELSE concat('1. - ', role, ' end. 2: last; B. ') END AS line FROM {conversations}"""


@query("marker_units", f"""
    WITH RECURSIVE l AS (SELECT conv_id, turn, {ws('line')} AS t FROM ({same(MARKED)})),
    p AS (SELECT conv_id, turn, t, string_split(regexp_replace(t, '((?:[→➜•\\-–—*]|\\d+\\s*[-.:：)]|[A-Za-z]\\)|[A-Za-z]\\.)\\s+)', chr(1) || '\\1', 'g'), chr(1)) AS parts, regexp_matches(t, '^(?:[→➜•\\-–—*]|\\d+\\s*[-.:：)]|[A-Za-z]\\)|[A-Za-z]\\.)') AS listed FROM l WHERE t <> ''),
    walk AS (SELECT conv_id, turn, parts, listed, 1 AS k, parts[1] AS sofar, parts[1] AS unit, 0 AS n, NULL::VARCHAR AS done FROM p UNION ALL
      SELECT conv_id, turn, parts, listed OR cut, k + 1, concat(sofar, parts[k + 1]), CASE WHEN cut THEN parts[k + 1] ELSE concat(unit, parts[k + 1]) END, CASE WHEN cut THEN n + 1 ELSE n END, CASE WHEN cut THEN unit END
      FROM (SELECT *, sofar <> '' AND (regexp_matches(sofar, '[。！？!?；;:：]\\s*$') OR (listed AND regexp_matches(sofar, '\\s$'))) AS cut FROM walk WHERE k < len(parts)))
    SELECT conv_id, turn, n - 1 AS pos, {ws('done')} AS unit FROM walk WHERE done IS NOT NULL UNION ALL SELECT conv_id, turn, n, {ws('unit')} FROM walk WHERE k = len(parts)""")  # fmt: skip
def marker_units(spark, sf_dir):
    return derived(spark, sf_dir, MARKED).select("conv_id", "turn", F.posexplode(B.marker_units(F.col("line"))).alias("pos", "unit"))
