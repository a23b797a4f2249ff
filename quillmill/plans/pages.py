"""Queries over pages and their addresses."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmill.functions import urls as U
from quillmill.operators import clips as C
from quillmill.plans.registry import Registry, derived, same, table
from quillmill.plans.texts import ws

registry = Registry()
query = registry.add

HOST = "regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)"
ROUTE = f"""CASE WHEN contains(url, 'mp.weixin.qq.com') THEN 'weixin' WHEN regexp_matches(lower({HOST}), '(^|\\.)weibo\\.(com|cn)$') THEN 'weibo'
    WHEN regexp_matches(lower({HOST}), '^(www\\.)?(x|twitter)\\.com$') THEN 'twitter' ELSE 'web' END"""

#: Addresses of all kinds of sources, some of which must not be fetched.
GUARD_URLS = """
SELECT page_id, CASE page_id % 16
  WHEN 0 THEN 'http://localhost/a' WHEN 1 THEN 'https://10.0.0.8/x' WHEN 2 THEN 'https://172.20.1.1/' WHEN 3 THEN 'https://172.32.1.1/'
  WHEN 4 THEN 'https://user:pw@example.com/' WHEN 5 THEN 'ftp://example.com/f' WHEN 6 THEN 'http://printer.local/' WHEN 7 THEN 'http://192.168.1.4:8080/x'
  WHEN 8 THEN 'https://mp.weixin.qq.com/s/abc' WHEN 9 THEN 'https://m.weibo.cn/detail/1' WHEN 10 THEN 'https://x.com/a/status/1/photo/2?' WHEN 11 THEN 'https://www.twitter.com/b'
  WHEN 12 THEN 'javascript:alert(1)' WHEN 13 THEN 'mailto:a@example.com' ELSE url END AS url FROM {pages}"""

CLEAN = "regexp_replace(regexp_replace(html, '(?is)<script\\b.*?</script>', '', 'g'), '(?is)<style\\b.*?</style>', '', 'g')"


def stripped(x: str) -> str:
    """SQL of a page's text, without entities that the given pages don't have."""
    t = f"regexp_replace(regexp_replace(regexp_replace({x}, '(?is)<script\\b.*?</script>', '', 'g'), '(?is)<style\\b.*?</style>', '', 'g'), '<[^>]+>', '', 'g')"
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&apos;", "''"), ("&nbsp;", " "), ("&copy;", "©"), ("&reg;", "®"), ("&euro;", "€"), ("&pound;", "£"), ("&yen;", "¥"), ("&cent;", "¢"), ("&amp;", "&")):
        t = f"replace({t}, '{a}', '{b}')"
    return ws(t)


@query("clip_stats", f"""
    WITH c AS (SELECT page_id, {HOST} AS domain, {ws("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")} AS title, length({stripped('html')}) AS chars,
      len(regexp_extract_all(html, '(?i)<img\\b')) AS images, len(regexp_extract_all(html, '(?i)<table\\b')) AS tables FROM pages)
    SELECT *, CAST(greatest(1, ceil(chars / 19000.0)) AS BIGINT) AS parts FROM c""")  # fmt: skip
def clip_stats(spark, sf_dir):
    return C.clip_stats(table(spark, sf_dir, "pages"))


@query("page_scan", f"SELECT page_id AS clip_id, url AS source_url, {HOST} AS domain, {ROUTE} AS source_kind, length(html) AS html_chars FROM pages")
def page_scan(spark, sf_dir):
    return C.page_scan(table(spark, sf_dir, "pages"))


@query("markdown_scan", f"""
    WITH t AS (SELECT doc_id, {ws("replace(text, chr(13) || chr(10), chr(10))")} AS markdown FROM documents)
    SELECT doc_id, markdown, octet_length(encode(markdown)) AS bytes, octet_length(encode(markdown)) > 2097152 AS large FROM t""")  # fmt: skip
def markdown_scan(spark, sf_dir):
    return C.markdown_scan(table(spark, sf_dir, "documents"))


@query("source_route", f"SELECT page_id, {ROUTE} AS kind FROM ({same(GUARD_URLS)})")
def source_route(spark, sf_dir):
    return derived(spark, sf_dir, GUARD_URLS).select("page_id", U.source_route(F.col("url")).alias("kind"))


@query("domain_of", f"SELECT page_id, {HOST} AS domain FROM ({same(GUARD_URLS)})")
def domain_of(spark, sf_dir):
    return derived(spark, sf_dir, GUARD_URLS).select("page_id", U.domain_of(F.col("url")).alias("domain"))


@query("page_key", """
    WITH p AS (SELECT page_id, url, regexp_replace(url, '[?#].*$', '') AS k FROM pages)
    SELECT page_id, CASE WHEN NOT regexp_matches(url, '^https?://[^/?#]+') THEN url WHEN regexp_matches(k, '^https?://[^/]+$') THEN k || '/' ELSE k END AS page_key FROM p""")  # fmt: skip
def page_key(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", U.page_key(F.col("url")).alias("page_key"))


@query("public_url_filter", f"""
    WITH h AS (SELECT page_id, url, lower(regexp_extract(url, '^(?i:https?)://(\\[[^\\]]*\\]|[^/?#:@]*)(?::\\d+)?(?:[/?#]|$)', 1)) AS host FROM ({same(GUARD_URLS)}))
    SELECT page_id, url FROM h WHERE host <> '' AND host NOT IN ('localhost', '0.0.0.0', '::1', '[::1]') AND NOT suffix(host, '.local')
      AND NOT regexp_matches(host, '^(127\\.\\d{{1,3}}|10\\.\\d{{1,3}}|192\\.168|169\\.254|172\\.(1[6-9]|2\\d|3[01]))\\.\\d{{1,3}}\\.\\d{{1,3}}$')""")  # fmt: skip
def public_url_filter(spark, sf_dir):
    return derived(spark, sf_dir, GUARD_URLS).where(U.public(F.col("url")))


@query("safe_link_split", f"SELECT page_id, url, lower(regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.-]*):', 1)) IN ('http', 'https', 'mailto') AS safe FROM ({same(GUARD_URLS)})")
def safe_link_split(spark, sf_dir):
    return derived(spark, sf_dir, GUARD_URLS).select("page_id", "url", U.safe_link(F.col("url")).alias("safe"))


@query("quote_url_clean", f"SELECT page_id, regexp_replace(regexp_replace(url, '/(photo|video)/\\d+', '', 'g'), '[?#]+$', '') AS url FROM ({same(GUARD_URLS)})")
def quote_url_clean(spark, sf_dir):
    return derived(spark, sf_dir, GUARD_URLS).select("page_id", U.quote_url(F.col("url")).alias("url"))


@query("content_gate", "SELECT page_id, length(html) >= 200 AND len(regexp_extract_all(html, '(?i)<(p|div|li|h[1-6])\\b')) >= 3 AS article FROM pages")
def content_gate(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", C.content_gate(F.col("html")).alias("article"))


@query("main_region", f"""
    WITH r AS (SELECT page_id, html, regexp_extract(html, '(?is)<article\\b[^>]*>(.*?)</article>', 1) AS a, regexp_extract(html, '(?is)<main\\b[^>]*>(.*?)</main>', 1) AS m FROM pages),
    g AS (SELECT *, a <> '' AND length({stripped('a')}) > 200 AS good FROM r)
    SELECT page_id, md5(CASE WHEN good THEN a WHEN m <> '' THEN m ELSE html END) AS region_md5 FROM g""")  # fmt: skip
def main_region(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.md5(C.main_region(F.col("html"))).alias("region_md5"))


def _strip_sql(x: str) -> str:
    for tag in [*C.NOISE_TAGS, *C.STRUCTURE_TAGS]:
        x = f"regexp_replace({x}, '(?is)<{tag}\\b.*?</{tag}>', '', 'g')"
    return x


@query("structural_strip", f"SELECT page_id, {_strip_sql('html')} AS html FROM pages")
def structural_strip(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", C.without_structure(F.col("html")).alias("html"))


@query("capture_blocklist", f"""
    WITH hosts AS (SELECT DISTINCT {HOST} AS h FROM pages WHERE page_id % 120 = 1), prefixes AS (SELECT DISTINCT url AS p FROM pages WHERE page_id % 90 = 2)
    SELECT page_id, url FROM pages WHERE {HOST} NOT IN (SELECT h FROM hosts) AND NOT EXISTS (SELECT 1 FROM prefixes WHERE prefix(url, p))""")  # fmt: skip
def capture_blocklist(spark, sf_dir):
    from quillmill.operators.rules import not_blocked

    pages = table(spark, sf_dir, "pages")
    hosts = pages.where("page_id % 120 = 1").select(U.domain_of(F.col("url")).alias("host")).distinct()
    prefixes = pages.where("page_id % 90 = 2").select(F.col("url").alias("prefix")).distinct()
    return not_blocked(pages.select("page_id", "url"), hosts, prefixes)


TABLE_LINES = """
    WITH cells AS (SELECT r_regionkey AS table_id, n_nationkey AS ord, concat_ws(' | ', n_name, CAST(n_nationkey AS STRING)) AS line FROM {nation} JOIN {region} ON n_regionkey = r_regionkey)
    SELECT table_id, ord, line FROM cells"""


@query("table_fallback_text", f"""
    SELECT table_id, concat('name | key', chr(10), '--- | ---', chr(10), string_agg(line, chr(10) ORDER BY ord)) AS body FROM ({same(TABLE_LINES)}) GROUP BY table_id""")  # fmt: skip
def table_fallback_text(spark, sf_dir):
    from quillmill.operators.rules import table_text

    return table_text(derived(spark, sf_dir, TABLE_LINES), ["name", "key"])
