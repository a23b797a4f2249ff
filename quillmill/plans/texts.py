"""Queries of the text rules, over documents, pages and rows derived from them."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmill.functions import text as T
from quillmill.plans.registry import Registry, derived, same, table

registry = Registry()
query = registry.add


def ws(x: str) -> str:
    """SQL of a trimmed text."""
    return rf"regexp_replace({x}, '^[\s\x{{a0}}\x{{3000}}\x{{feff}}]+|[\s\x{{a0}}\x{{3000}}\x{{feff}}]+$', '', 'g')"


HAN, LATIN = "[\\x{4e00}-\\x{9fff}]", "[A-Za-z]+(?:['’][A-Za-z]+)*"


def count(x: str, pattern: str) -> str:
    quoted = pattern.replace("'", "''")
    return f"len(regexp_extract_all({x}, '{quoted}'))"


def kind(t: str) -> str:
    """SQL of the language of a trimmed text."""
    han, latin = count(t, HAN), count(t, LATIN)
    return f"""CASE WHEN {han} >= 2 AND ({latin} = 0 OR {han} >= {latin} OR {han} >= 6) THEN 'chinese'
        WHEN {latin} >= 2 AND ({han} = 0 OR ({han} <= 2 AND regexp_matches({t}, '^[^\\x{{4e00}}-\\x{{9fff}}]*[A-Za-z]'))) THEN 'english' ELSE 'other' END"""


#: English, Chinese and mixed lines, one for each page.
MIXED = """
SELECT page_id, CASE page_id % 8
  WHEN 0 THEN concat('使用 Spark 处理数据', CAST(page_id AS STRING))
  WHEN 1 THEN 'Getting Started with Large Tables'
  WHEN 2 THEN '第一章：数据管道，入门'
  WHEN 3 THEN concat('  "A quoted line ', CAST(page_id AS STRING), '"  ')
  WHEN 4 THEN '你好 Hello World this is a longer mixed sentence'
  WHEN 5 THEN 'Ends hard.'
  WHEN 6 THEN concat('Some fairly long English heading that goes beyond thirty characters ', CAST(page_id AS STRING))
  ELSE '' END AS line FROM {pages}"""

#: Lines as page tools, bylines and social widgets leave them.
BYLINES = """
SELECT page_id, CASE page_id % 14
  WHEN 0 THEN 'Written by ' WHEN 1 THEN 'Last updated May 3, 2024' WHEN 2 THEN 'Expert Verified'
  WHEN 3 THEN 'Published on 2026-01-11' WHEN 4 THEN '作者：张三' WHEN 5 THEN 'Edit this page'
  WHEN 6 THEN 'Subscribe' WHEN 7 THEN 'Click here to subscribe now' WHEN 8 THEN '3. '
  WHEN 9 THEN concat('Written by A and Reviewed by B ', CAST(page_id AS STRING))
  WHEN 10 THEN 'Share this post' WHEN 11 THEN 'Try it for free or learn more'
  WHEN 12 THEN 'Blogs / Guides' ELSE concat('A plain sentence number ', CAST(page_id AS STRING)) END AS line FROM {pages}"""

#: Captions of images.
CAPTIONS = """
SELECT page_id, CASE page_id % 8
  WHEN 0 THEN 'Image' WHEN 1 THEN '图：张三' WHEN 2 THEN 'Click to view' WHEN 3 THEN 'x'
  WHEN 4 THEN 'Source: view of the city' WHEN 5 THEN '点击查看大图' WHEN 6 THEN repeat('long ', 20)
  ELSE concat('A caption ', CAST(page_id AS STRING)) END AS caption FROM {pages}"""

#: Titles and digests of notes.
NOTES = """
SELECT o_orderkey AS note_id, CASE o_orderkey % 7 WHEN 0 THEN '旅行合集' WHEN 1 THEN '【读书合辑】' WHEN 2 THEN 'Plain note'
  WHEN 3 THEN '合集介绍' ELSE concat('Note ', CAST(o_orderkey AS STRING)) END AS title,
  CASE o_orderkey % 5 WHEN 0 THEN '本合集收录' WHEN 1 THEN '已自动拆分为 3 篇' WHEN 2 THEN '' ELSE o_orderpriority END AS digest,
  o_orderkey % 11 = 0 AS is_collection FROM {orders}"""

#: Markdown with syntax that has no counterpart.
SYNTAX = """
SELECT page_id, CASE page_id % 7
  WHEN 0 THEN concat('```mermaid', chr(10), 'graph', chr(10), '```') WHEN 1 THEN concat('a', chr(10), '$$', chr(10), 'x', chr(10), '$$')
  WHEN 2 THEN 'price $x+y$ here' WHEN 3 THEN 'note[^1]' WHEN 4 THEN concat('[toc]', chr(10), 'text') WHEN 5 THEN 'costs $5 only'
  ELSE 'plain text' END AS md FROM {pages}"""

#: Messages of failed calls.
MESSAGES = """
SELECT event_id, CASE event_id % 8 WHEN 0 THEN 'HTTP 401' WHEN 1 THEN 'Rate limit reached' WHEN 2 THEN 'Network down'
  WHEN 3 THEN 'request TIMEOUT' WHEN 4 THEN 'Text too long' WHEN 5 THEN '字数超限' WHEN 6 THEN 'invalid key' ELSE event_type END AS message,
  CASE event_id % 13 WHEN 0 THEN 401 WHEN 1 THEN 429 WHEN 2 THEN 0 WHEN 3 THEN 503 WHEN 4 THEN 403 WHEN 5 THEN 413 WHEN 6 THEN 500 END AS status,
  CASE event_id % 11 WHEN 0 THEN 'Unauthorized' WHEN 1 THEN 'rate_exceeded' WHEN 2 THEN 'SERVICE_DOWN' WHEN 3 THEN 'no_perm' WHEN 4 THEN 'too large' ELSE '' END AS code,
  event_id % 17 = 0 AS aborted FROM {events}"""


@query("strip_html", f"""
    WITH t AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\\b.*?</script>', '', 'g'), '(?is)<style\\b.*?</style>', '', 'g'), '<[^>]+>', '', 'g') AS x FROM pages)
    SELECT page_id, {ws("replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(x,'&lt;','<'),'&gt;','>'),'&quot;','\"'),'&#39;',''''),'&apos;',''''),'&nbsp;',' '),'&copy;','©'),'&reg;','®'),'&euro;','€'),'&pound;','£'),'&yen;','¥'),'&cent;','¢'),'&amp;','&')")} AS body FROM t""")  # fmt: skip
def strip_html(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.strip_html(F.col("html")).alias("body"))


TITLE = "trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1))"


@query("title_valid", f"""
    SELECT page_id, length({ws(TITLE)}) BETWEEN 3 AND 50 AND lower({ws(TITLE)}) NOT IN ('untitled','无标题','新建标签页','new tab','loading','加载中','undefined','null') AS title_ok FROM pages""")  # fmt: skip
def title_valid(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.title_valid(F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1)).alias("title_ok"))


@query("title_from_text", f"""
    WITH t AS (SELECT doc_id, {ws("text")} AS t FROM documents),
    p AS (SELECT doc_id, t, length(regexp_extract(t, '^[^。.!！?？\\n]*')) + 1 AS pos, regexp_matches(t, '[。.!！?？\\n]') AS ends FROM t)
    SELECT doc_id,
      CASE WHEN t = '' THEN '' WHEN ends AND pos <= 30 THEN {ws("substring(t, 1, pos)")} WHEN length(t) <= 30 THEN t ELSE concat({ws("substring(t, 1, 30)")}, '...') END AS title,
      CASE WHEN t = '' THEN '' WHEN ends AND pos <= 30 THEN {ws("substring(t, pos + 1)")} WHEN length(t) <= 30 THEN '' ELSE {ws("substring(t, 31)")} END AS remaining
    FROM p""")  # fmt: skip
def title_from_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.title_from_text(F.col("text")).alias("t")).select("doc_id", "t.title", "t.remaining")


@query("truncate_text", "SELECT doc_id, CASE WHEN length(text) <= 100 THEN text ELSE concat(substring(text, 1, 97), '...') END AS short FROM documents")
def truncate_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.truncated(F.col("text"), 100).alias("short"))


def candidate(x: str) -> str:
    return ws(f"""regexp_replace(regexp_replace({ws(x)}, '^["''“”‘’]+|["''“”‘’]+$', '', 'g'), '\\s+', ' ', 'g')""")


def by_language(x: str, source: str, key: str) -> str:
    return f"""
    WITH t AS (SELECT {key}, {candidate(x)} AS t FROM {source}), k AS (SELECT *, substring(t, 1, 27) AS c, {kind("t")} AS kind FROM t),
    s AS (SELECT *, length(c) - instr(reverse(c), ' ') AS sp FROM k)
    SELECT {key}, CASE WHEN length(t) <= 30 THEN t
      ELSE concat({ws("CASE WHEN kind = 'english' AND instr(c, ' ') > 0 AND sp >= 16 THEN substring(c, 1, sp) ELSE c END")}, '...') END AS title FROM s"""


@query("title_truncate_lang", by_language("text", "documents", "doc_id"))
def title_truncate_lang(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.title_by_language(F.col("text")).alias("title"))


@query("title_candidate_clean", f"SELECT page_id, {candidate('line')} AS candidate FROM ({same(MIXED)})")
def title_candidate_clean(spark, sf_dir):
    return derived(spark, sf_dir, MIXED).select("page_id", T.title_candidate(F.col("line")).alias("candidate"))


@query("title_key", r"SELECT doc_id, lower(regexp_replace(text, '[\x{200b}\x{200c}\x{200d}\x{2060}\x{feff}\s.,;:!?。，；：！？、]', '', 'g')) AS title_key FROM documents")
def title_key(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.title_key(F.col("text")).alias("title_key"))


SITE_TITLES = """SELECT page_id, CASE page_id % 5 WHEN 0 THEN '(3+) Some words / X' WHEN 1 THEN 'Somebody on Twitter' WHEN 2 THEN '"Quoted" / Twitter'
  WHEN 3 THEN concat('(12) Post ', CAST(page_id AS STRING)) ELSE 'A / B' END AS title FROM {pages}"""


@query("page_title_clean", f"""
    SELECT page_id, {ws("regexp_replace(regexp_replace(regexp_replace(regexp_replace(title, '(?i)[[:space:]]*/[[:space:]]*(X|Twitter)$', ''), '(?i)[[:space:]]+on[[:space:]]+(X|Twitter)$', ''), '^[(][0-9]+[+]?[)][[:space:]]*', ''), '^\"|\"$', '', 'g')")} AS title
    FROM ({same(SITE_TITLES)})""")  # fmt: skip
def page_title_clean(spark, sf_dir):
    return derived(spark, sf_dir, SITE_TITLES).select("page_id", T.page_title(F.col("title")).alias("title"))


@query("script_counts", f"SELECT doc_id, {count('text', HAN)} AS han, {count('text', LATIN)} AS latin FROM documents")
def script_counts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.han_chars(F.col("text")).cast("long").alias("han"), T.latin_words(F.col("text")).cast("long").alias("latin"))


@query("segment_language", f"WITH t AS (SELECT page_id, {ws('line')} AS t FROM ({same(MIXED)})) SELECT page_id, {kind('t')} AS kind FROM t")
def segment_language(spark, sf_dir):
    return derived(spark, sf_dir, MIXED).select("page_id", T.language(F.col("line")).alias("kind"))


@query("heading_like", f"""
    WITH t AS (SELECT page_id, {ws('line')} AS t FROM ({same(MIXED)})), k AS (SELECT *, {kind('t')} AS kind FROM t)
    SELECT page_id, t <> '' AND NOT regexp_matches(t, '[。！？!?；;:：]$') AND (
      (kind = 'english' AND {count('t', LATIN)} BETWEEN 1 AND 8 AND regexp_matches(t, '^[A-Z0-9]'))
      OR (kind = 'chinese' AND {count('t', HAN)} BETWEEN 1 AND 10 AND NOT regexp_matches(t, '[，,]'))) AS heading FROM k""")  # fmt: skip
def heading_like(spark, sf_dir):
    lines = derived(spark, sf_dir, MIXED)
    return lines.select("page_id", T.heading_like(F.col("line"), T.language(F.col("line"))).alias("heading"))


@query("log_redact", f"""
    SELECT doc_id, substring({ws("regexp_replace(regexp_replace(regexp_replace(text, '(?i)https?://[^[:space:]]+', '[url]', 'g'), '(?i)\\b[a-f0-9]{24,}\\b', '[id]', 'g'), '[[:space:]]+', ' ', 'g')")}, 1, 160) AS line FROM documents""")  # fmt: skip
def log_redact(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.redacted(F.col("text")).alias("line"))


@query("error_code", f"""
    WITH m AS (SELECT event_id, CASE WHEN aborted THEN concat('ABORTED ', message) ELSE message END AS message, status, upper(code) AS code FROM ({same(MESSAGES)}))
    SELECT event_id, CASE WHEN status = 401 OR contains(code, 'UNAUTHORIZED') THEN 'UNAUTHORIZED' WHEN status = 429 OR contains(code, 'RATE') THEN 'RATE_LIMIT'
      WHEN status IS NOT NULL AND contains(message, 'ABORTED') THEN 'CANCELLED' WHEN status = 0 AND contains(message, 'TIMEOUT') THEN 'AMBIGUOUS_CREATE'
      WHEN status = 503 OR contains(code, 'SERVICE') THEN 'SERVICE_UNAVAILABLE' WHEN status = 403 OR contains(code, 'PERM') THEN 'PERMISSION_DENIED' WHEN status = 413 OR contains(code, 'TOO LARGE') THEN 'CONTENT_TOO_LONG'
      WHEN regexp_matches(lower(message), '401|unauthorized|invalid key') THEN 'UNAUTHORIZED' WHEN regexp_matches(lower(message), '429|rate|limit') THEN 'RATE_LIMIT'
      WHEN regexp_matches(lower(message), 'network|fetch|timeout') THEN 'NETWORK' WHEN regexp_matches(lower(message), 'too long|字数|超') THEN 'CONTENT_TOO_LONG' ELSE 'UNKNOWN' END AS code FROM m""")  # fmt: skip
def error_code(spark, sf_dir):
    rows = derived(spark, sf_dir, MESSAGES).withColumn("message", F.when(F.col("aborted"), F.concat(F.lit("ABORTED "), "message")).otherwise(F.col("message")))
    return rows.select("event_id", T.error_code(F.col("message"), F.col("status"), F.col("code")).alias("code"))


@query("clean_invisible", rf"SELECT page_id, regexp_replace(line, '[\x{{200b}}\x{{200c}}\x{{200d}}\x{{2060}}\x{{feff}}]', '', 'g') AS line FROM (SELECT page_id, concat('a', CASE page_id % 3 WHEN 0 THEN chr(8203) WHEN 1 THEN chr(8288) ELSE '-' END, 'b', CAST(page_id AS VARCHAR)) AS line FROM pages)")
def clean_invisible(spark, sf_dir):
    # Spark's chr() stops at 255
    line = F.expr("concat('a', CASE page_id % 3 WHEN 0 THEN decode(unhex('E2808B'), 'UTF-8') WHEN 1 THEN decode(unhex('E281A0'), 'UTF-8') ELSE '-' END, 'b', CAST(page_id AS STRING))")
    return table(spark, sf_dir, "pages").select("page_id", T.visible(line).alias("line"))


@query("note_search", "SELECT doc_id FROM documents WHERE contains(lower(substring(text, 1, 60)), 'the') OR contains(lower(text), 'token')")
def note_search(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.where(F.lower(F.substring("text", 1, 60)).contains("the") | F.lower("text").contains("token")).select("doc_id")


@query("metadata_text_filter", rf"""
    SELECT page_id, line FROM ({same(BYLINES)}) WHERE NOT (length({ws('line')}) BETWEEN 1 AND 99 AND regexp_matches({ws('line')},
      '(?i)^(?:{"|".join(T.METADATA_TEXTS).replace("(?:", "(")})$'))""")  # fmt: skip
def metadata_text_filter(spark, sf_dir):
    return derived(spark, sf_dir, BYLINES).where(~T.metadata_text(F.col("line")))


@query("social_noise_filter", rf"""
    SELECT page_id, line FROM ({same(BYLINES)})
    WHERE NOT regexp_matches({ws('line')}, '^(?:订阅|点击\s*订阅\s*到.*|(?i:subscribe)|(?i:click.*subscribe.*)|(?i:follow)|\d+\.\s*)$')""")  # fmt: skip
def social_noise_filter(spark, sf_dir):
    return derived(spark, sf_dir, BYLINES).where(~T.social_text(F.col("line")))


@query("byline_card_filter", f"""
    SELECT page_id, line FROM (SELECT page_id, line, {ws('line')} AS t FROM ({same(BYLINES)})) WHERE NOT (
      (contains(t, 'Written by') AND contains(t, 'Reviewed by') AND length(t) < 500)
      OR ((contains(t, 'Article by') OR contains(t, 'Share this post')) AND length(t) < 300)
      OR (contains(lower(t), 'try it for free') AND contains(lower(t), 'learn more') AND length(t) < 300)
      OR (contains(lower(t), 'blogs / guides') AND length(t) < 50))""")  # fmt: skip
def byline_card_filter(spark, sf_dir):
    return derived(spark, sf_dir, BYLINES).where(~T.byline_card(F.col("line")))


@query("caption_valid", f"""
    SELECT page_id, length(caption) BETWEEN 2 AND 80 AND lower({ws('caption')}) NOT IN ({", ".join(f"'{w}'" for w in T.EMPTY_CAPTIONS)})
      AND NOT (regexp_matches(lower(caption), '{"|".join(T.BUTTON_WORDS)}') AND NOT regexp_matches(lower(caption), '^(图|来源|source|credit|by|©)')
        AND regexp_matches(lower(caption), 'click|view|read|share|like|icon')) AS caption_ok FROM ({same(CAPTIONS)})""")  # fmt: skip
def caption_valid(spark, sf_dir):
    return derived(spark, sf_dir, CAPTIONS).select("page_id", T.caption_valid(F.col("caption")).alias("caption_ok"))


@query("collection_candidate", rf"""
    SELECT note_id FROM ({same(NOTES)}) WHERE NOT is_collection AND (
      regexp_matches(regexp_replace(title, '[\s\x{{a0}}\x{{200b}}\x{{feff}}]', '', 'g'), '(合集|合辑)[）)\]】」』”"’'']*$')
      OR regexp_matches({ws('digest')}, '^(此合集|本合集|该合集)') OR contains(digest, '已自动拆分为'))""")  # fmt: skip
def collection_candidate(spark, sf_dir):
    return derived(spark, sf_dir, NOTES).where(T.collection_candidate(F.col("title"), F.col("digest"), F.col("is_collection"))).select("note_id")


@query("unsupported_syntax", rf"""
    SELECT page_id, CAST(regexp_matches(md, '(?i)```\s*mermaid\b') AS INT) + CAST(regexp_matches(md, '(^|\n)\$\$(?s:.*?)\$\$(\n|$)|(^|[^$])\$[^$\n](?:.*?[^$])?\$([^$]|$)') AS INT) * 2
      + CAST(regexp_matches(md, '\[\^[^\]]+\]') AS INT) * 4 + CAST(regexp_matches(md, '(?i)(^|\n)\[\[?toc\]?\](\n|$)') AS INT) * 8 AS flags
    FROM ({same(SYNTAX)})""")  # fmt: skip
def unsupported_syntax(spark, sf_dir):
    md = F.col("md")
    flags = [
        md.rlike(r"(?i)```\s*mermaid\b"),
        md.rlike(r"(^|\n)\$\$[\s\S]*?\$\$(\n|$)") | md.rlike(r"(^|[^$])\$(?!\$).+?\$(?!\$)"),
        md.rlike(r"\[\^[^\]]+\]"),
        md.rlike(r"(?i)(^|\n)\[\[?toc\]?\](\n|$)"),
    ]
    bits = sum((f.cast("int") * (1 << i) for i, f in enumerate(flags)), F.lit(0))
    return derived(spark, sf_dir, SYNTAX).select("page_id", bits.alias("flags"))


@query("dominant_language", f"""
    WITH t AS (SELECT conv_id, {ws('text')} AS t FROM conversations), k AS (SELECT conv_id, {kind('t')} AS kind FROM t)
    SELECT conv_id, CASE WHEN count_if(kind = 'english') = 0 AND count_if(kind = 'chinese') = 0 THEN 'other'
      WHEN count_if(kind = 'english') >= count_if(kind = 'chinese') THEN 'english' ELSE 'chinese' END AS kind FROM k GROUP BY conv_id""")  # fmt: skip
def dominant_language(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", T.language(F.col("text")).alias("kind"))
    english, chinese = F.count_if(F.col("kind") == "english"), F.count_if(F.col("kind") == "chinese")
    return turns.groupBy("conv_id").agg(F.when((english == 0) & (chinese == 0), "other").when(english >= chinese, "english").otherwise("chinese").alias("kind"))
