"""Queries of splitting, merging and rewriting."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmill.functions import text as T
from quillmill.operators import paragraphs as G
from quillmill.operators import parts as P
from quillmill.plans.registry import Registry, derived, same, table
from quillmill.plans.texts import HAN, LATIN, count, kind, ws

registry = Registry()
query = registry.add


TEXT_LIMIT = 19000


@query("split_oversize_text", f"""
    WITH RECURSIVE b AS (SELECT doc_id, text, length(text) AS n, string_split(text, '') AS c FROM documents WHERE length(text) > {TEXT_LIMIT}),
    p AS (SELECT doc_id, n, c, list_filter(generate_series(1, n), lambda i: c[i] = chr(10)) AS line_ends, list_transform(list_filter(generate_series(1, n - 1), lambda i: contains('{P.STOPS}', c[i]) AND regexp_matches(c[i + 1], '\\s')), lambda i: i + 1) AS stops,
      list_filter(generate_series(1, n), lambda i: regexp_matches(c[i], '\\s') AND (i = 1 OR NOT regexp_matches(c[i - 1], '\\s'))) AS blanks FROM b),
    walk AS (SELECT doc_id, 0 AS part, 0::BIGINT AS start, 0::BIGINT AS stop FROM b UNION ALL
      SELECT doc_id, part + 1, stop, CASE WHEN n - stop <= {TEXT_LIMIT} THEN n ELSE coalesce(list_max(list_filter(line_ends, lambda i: i > stop + 1 AND i <= stop + {TEXT_LIMIT})), CASE WHEN contains('{P.STOPS}', c[stop + {TEXT_LIMIT}]) THEN stop + {TEXT_LIMIT} END,
        list_max(list_filter(stops, lambda i: i > stop + 1 AND i <= stop + {TEXT_LIMIT})), nullif(greatest(list_max(list_filter(blanks, lambda i: i <= stop + {TEXT_LIMIT})), stop + 1), stop + 1), stop + {TEXT_LIMIT}) END FROM walk JOIN p USING (doc_id) WHERE stop < n)
    SELECT doc_id, part - 1 AS part, substring(text, start + 1, stop - start) AS text FROM walk JOIN b USING (doc_id) WHERE part > 0
    UNION ALL SELECT doc_id, 0, text FROM documents WHERE length(text) <= {TEXT_LIMIT}""")  # fmt: skip
def split_oversize_text(spark, sf_dir):
    return P.split_text(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text", TEXT_LIMIT)


CODE_LIMIT = 300


@query("split_oversize_code", f"""
    WITH RECURSIVE l AS (SELECT doc_id, regexp_extract_all(text, '[^\\n]*\\n|[^\\n]+') AS a FROM documents), lines AS (SELECT doc_id, unnest(a) AS line, unnest(generate_series(1, len(a))) AS pos FROM l),
    s AS (SELECT doc_id, pos, length(line) > {CODE_LIMIT} AS big, line, unnest(generate_series(0, (length(line) - 1) // {CODE_LIMIT})) AS sub FROM lines),
    p AS (SELECT doc_id, big, substring(line, sub * {CODE_LIMIT} + 1, {CODE_LIMIT}) AS piece, row_number() OVER (PARTITION BY doc_id ORDER BY pos, sub) AS i FROM s),
    w AS (SELECT doc_id, i, piece, 0 AS chunk, length(piece) AS used, big AS closed FROM p WHERE i = 1 UNION ALL
      SELECT p.doc_id, p.i, p.piece, CASE WHEN p.big OR w.closed OR w.used + length(p.piece) > {CODE_LIMIT} THEN w.chunk + 1 ELSE w.chunk END,
        CASE WHEN p.big OR w.closed OR w.used + length(p.piece) > {CODE_LIMIT} THEN length(p.piece) ELSE w.used + length(p.piece) END, p.big FROM w JOIN p ON p.doc_id = w.doc_id AND p.i = w.i + 1)
    SELECT doc_id, chunk, string_agg(piece, '' ORDER BY i) AS text FROM w GROUP BY doc_id, chunk""")  # fmt: skip
def split_oversize_code(spark, sf_dir):
    return P.split_code(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text", CODE_LIMIT)


SEGMENTS = """SELECT conv_id AS doc, turn AS pos, CASE (conv_id + turn) % 9 WHEN 0 THEN concat('- ', text) WHEN 1 THEN '中文句子没有结束但是还有很多字在这里' WHEN 2 THEN '继续写下去，' WHEN 3 THEN concat(text, '!') WHEN 4 THEN 'A Heading Here' WHEN 5 THEN ' ' ELSE text END AS text FROM {conversations}"""


def _continued_sql() -> str:
    heading = f"""((kb = 'english' AND {count('cur', LATIN)} BETWEEN 1 AND 8 AND regexp_matches(cur, '^[A-Z0-9]')) OR (kb = 'chinese' AND {count('cur', HAN)} BETWEEN 1 AND 10 AND NOT regexp_matches(cur, '[，,]')))"""
    hard = "regexp_matches(cur, '[。！？!?；;:：]$')"
    return f"""
    WITH RECURSIVE t AS (SELECT doc, pos, {ws('text')} AS text FROM ({same(SEGMENTS)})), s AS (SELECT doc, text, row_number() OVER (PARTITION BY doc ORDER BY pos, text) AS i FROM t WHERE text <> ''),
    walk AS (SELECT doc, i, 0 AS part, text AS cur FROM s WHERE i = 1 UNION ALL
      SELECT doc, i, CASE WHEN goes THEN part ELSE part + 1 END, CASE WHEN goes THEN concat(cur, CASE WHEN kb = 'english' OR (regexp_matches(cur, '[A-Za-z0-9]$') AND regexp_matches(text, '^[A-Za-z0-9]')) THEN ' ' ELSE '' END, text) ELSE text END
      FROM (SELECT *, kb <> 'other' AND kb = {kind('text')} AND NOT {hard} AND NOT regexp_matches(text, '^([→➜•\\-–—*]|\\d+\\s*[-.:：)]|[A-Za-z]\\)|[A-Za-z]\\.)') AND NOT {heading} AS goes
        FROM (SELECT s.doc, s.i, s.text, w.part, w.cur, {kind('w.cur')} AS kb FROM walk w JOIN s ON s.doc = w.doc AND s.i = w.i + 1)))
    SELECT doc, part, arg_max(cur, i) AS text FROM walk GROUP BY doc, part"""


@query("continuation_merge", _continued_sql())
def continuation_merge(spark, sf_dir):
    return P.merge_continued(derived(spark, sf_dir, SEGMENTS))


TAGS = """SELECT page_id, ord, image_id, CASE k % 4 WHEN 0 THEN concat(host, '/', CAST(k AS STRING), '.jpg', query) WHEN 1 THEN concat('https://i.example.com/a/', CAST(k AS STRING), '/640', query) WHEN 2 THEN concat(host, '/v2/resize/1*', CAST(k AS STRING), 'xyz.png')
  ELSE concat(host, '/a-photo-of-something-', CAST(k AS STRING), '/y.png', query) END AS url FROM (SELECT o_custkey AS page_id, o_orderkey AS ord, CASE WHEN o_orderkey % 5 = 0 THEN concat('i', CAST(o_orderkey % 25000 AS STRING)) END AS image_id, o_orderkey % 30000 AS k,
  CASE WHEN o_orderkey % 3 = 0 THEN 'https://j.example.com' ELSE 'https://i.example.com' END AS host, CASE WHEN o_orderkey % 2 = 0 THEN '?w=1#x' ELSE '' END AS query FROM {orders})"""
RESULTS = """SELECT p_partkey % 3 AS rank, concat('i', CAST(p_partkey AS STRING)) AS image_id, CASE k % 4 WHEN 0 THEN concat('https://i.example.com/', CAST(k AS STRING), '.jpg') WHEN 1 THEN concat('https://i.example.com/a/', CAST(k AS STRING), '/320') WHEN 2 THEN concat('https://i.example.com/v2/1*', CAST(k AS STRING), 'xyz.png')
  ELSE concat('https://i.example.com/a-photo-of-something-', CAST(k AS STRING), '/x.png') END AS url, concat('u', CAST(p_partkey AS STRING)) AS uid FROM (SELECT p_partkey, p_partkey - p_partkey % 9 % 2 AS k FROM {part})"""


def _keys(rows: str, url: str, columns: str) -> str:
    bare, path = f"regexp_replace({url}, '[?#].*$', '')", f"regexp_extract({url}, '^https?://[^/?#]*([^?#]*)', 1)"
    star, last = f"regexp_extract({path}, '(\\d\\*[A-Za-z0-9_-]+)', 1)", f"string_split({bare}, '/')[-1]"
    long = f"list_reduce(list_prepend('', string_split({path}, '/')), lambda a, x: CASE WHEN length(x) > 10 AND length(x) > length(a) THEN x ELSE a END)"
    keys = [url, bare, f"regexp_replace({bare}, '/\\d{{1,4}}$', '')", star, long, f"CASE WHEN length({last}) > 5 THEN {last} ELSE '' END"]
    return " UNION ALL ".join(f"SELECT {columns}, {i} AS tier, {k} AS key FROM {rows}" for i, k in enumerate(keys))


@query("image_result_join", f"""
    WITH t AS ({same(TAGS)}), r AS ({same(RESULTS)}), rk AS ({_keys('r', 'url', 'rank, image_id, url, uid')}), tk AS ({_keys('(SELECT * FROM t WHERE image_id IS NULL)', 'url', 'page_id, ord')}),
    m AS (SELECT t.page_id, t.ord, r.rank, r.image_id, r.url, r.uid FROM t JOIN r ON t.image_id = r.image_id UNION ALL SELECT tk.page_id, tk.ord, rk.rank, rk.image_id, rk.url, rk.uid FROM tk JOIN rk ON tk.tier = rk.tier AND tk.key = rk.key AND tk.key <> ''),
    b AS (SELECT *, row_number() OVER (PARTITION BY page_id, ord ORDER BY rank, image_id) AS n FROM m)
    SELECT t.page_id, t.ord, CASE WHEN b.rank IS NULL THEN 'keep' WHEN b.rank = 0 THEN 'inject' ELSE 'link' END AS action, coalesce(CASE WHEN b.rank = 0 THEN b.uid END, b.url, t.url) AS target
    FROM t LEFT JOIN (SELECT * FROM b WHERE n = 1) b ON t.page_id = b.page_id AND t.ord = b.ord""")  # fmt: skip
def image_result_join(spark, sf_dir):
    return P.image_actions(derived(spark, sf_dir, TAGS), derived(spark, sf_dir, RESULTS))


MARKUP = """SELECT page_id, concat('<div class="x" id="y" onclick="go()"><a href="javascript:go()" target="_blank" data-x="1">', CAST(page_id AS STRING), '</a><img src="a.png" class="big" alt="An image"/><script>bad()</script></div>') AS html FROM {pages}"""


@query("html_safe_subset", f"""
    SELECT page_id, regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\\b[^>]*>.*?</script>', '', 'g'), '(?i)javascript:', '', 'g'), '(?i)\\s+on\\w+\\s*=', ' data-removed=', 'g') AS html FROM ({same(MARKUP)})""")  # fmt: skip
def html_safe_subset(spark, sf_dir):
    return derived(spark, sf_dir, MARKUP).select("page_id", P.safe_html(F.col("html")).alias("html"))


#: Whole pages after markup with attributes of every kind.
PRUNABLE = """SELECT page_id, concat('<div class="x" id="y" data-own-uid="u', CAST(page_id AS STRING), '"><img src="a.png" class="big" data-own-caption="c" alt="An image"/><pre class="p" id="q"><code class="language-js" data-lang="js" translate="no" data-x="1">x</code></pre><codex class="n"></codex></div>', html) AS html FROM {pages}"""


@query("attr_prune", f"""
    WITH p AS ({same(PRUNABLE)}), t AS (SELECT page_id, regexp_extract_all(html, '<[^>]+>|[^<]+') AS a FROM p), x AS (SELECT page_id, unnest(a) AS t, unnest(generate_series(1, len(a))) AS i FROM t),
    k AS (SELECT *, regexp_matches(t, '(?i)^<(pre|code)\\b') AS code FROM x),
    o AS (SELECT page_id, string_agg(CASE WHEN regexp_matches(t, '^<[a-zA-Z]') THEN concat(regexp_extract(t, '^<[a-zA-Z][a-zA-Z0-9]*'), array_to_string(list_transform(list_filter(regexp_extract_all(t, '[a-zA-Z][a-zA-Z0-9-]*="[^"]*"'),
        lambda k: regexp_matches(k, '^({"|".join([*P.KEPT_ATTRIBUTES, P.OWN + "-uid", P.OWN + "-caption"])})=') OR (code AND regexp_matches(k, '^({"|".join(P.CODE_ATTRIBUTES)})='))), lambda k: ' ' || k), ''), CASE WHEN suffix(t, '/>') THEN '/>' ELSE '>' END) ELSE t END, '' ORDER BY i) AS html FROM k GROUP BY page_id)
    SELECT page_id, md5(o.html) AS html_md5, CAST(strlen(p.html) - strlen(o.html) AS BIGINT) AS bytes_saved FROM p JOIN o USING (page_id)""")  # fmt: skip
def attr_prune(spark, sf_dir):
    rows = derived(spark, sf_dir, PRUNABLE).withColumn("pruned", P.prune_attributes(F.col("html")))
    return rows.select("page_id", F.md5("pruned").alias("html_md5"), (F.octet_length("html") - F.octet_length("pruned")).cast("long").alias("bytes_saved"))


CLASSED = "SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'ads wide' WHEN 1 THEN 'body text' WHEN 2 THEN 'user-comment-list' WHEN 3 THEN 'ad' WHEN 4 THEN 'banner' ELSE 'adsense' END AS classes FROM {pages}"


@query("junk_class_filter", f"""
    SELECT page_id, classes FROM ({same(CLASSED)}) WHERE NOT (list_has_any(string_split(lower(classes), ' '), {P.JUNK_CLASSES}) OR regexp_matches(lower(classes), '{"|".join(P.JUNK_PARTS)}'))""")  # fmt: skip
def junk_class_filter(spark, sf_dir):
    return derived(spark, sf_dir, CLASSED).where(~P.junk_class(F.col("classes")))


AUTHORS = """SELECT page_id, concat(CASE WHEN page_id % 2 = 0 THEN '<a rel="author">Ann</a>' ELSE '' END, CASE WHEN page_id % 3 = 0 THEN '<span class="author">Bob</span>' ELSE '' END,
  CASE WHEN page_id % 5 = 0 THEN '<div class="byline">Cy</div>' ELSE '' END, CASE page_id % 4 WHEN 0 THEN '<time datetime="2024-01-02">yesterday</time>' WHEN 1 THEN '<span class="date">May 5</span>' ELSE '' END) AS html FROM {pages}"""


@query("author_time_pick", f"""
    SELECT page_id, coalesce(nullif(regexp_extract(html, 'rel="author"[^>]*>([^<]+)', 1), ''), nullif(regexp_extract(html, 'class="author"[^>]*>([^<]+)', 1), ''), nullif(regexp_extract(html, 'class="byline"[^>]*>([^<]+)', 1), ''), '') AS author,
      coalesce(nullif(regexp_extract(html, '<time[^>]*datetime="([^"]*)"', 1), ''), nullif(regexp_extract(html, 'class="(?:published|post-date|date)"[^>]*>([^<]+)', 1), ''), '') AS published FROM ({same(AUTHORS)})""")  # fmt: skip
def author_time_pick(spark, sf_dir):
    first = lambda *patterns: F.coalesce(*[F.nullif(F.regexp_extract("html", p, 1), F.lit("")) for p in patterns], F.lit(""))
    author = first(r"rel=\"author\"[^>]*>([^<]+)", r"class=\"author\"[^>]*>([^<]+)", r"class=\"byline\"[^>]*>([^<]+)")
    published = first(r"<time[^>]*datetime=\"([^\"]*)\"", r"class=\"(?:published|post-date|date)\"[^>]*>([^<]+)")
    return derived(spark, sf_dir, AUTHORS).select("page_id", author.alias("author"), published.alias("published"))


PICTURES = """SELECT page_id, concat('window.list = [', CASE WHEN page_id % 2 = 0 THEN concat('{{ width: ''', CAST(page_id AS STRING), ''' * 1, height: ''80'' * 1, cdn_url: ''https://p.example.com/', CAST(page_id AS STRING), ''' }},') ELSE '' END,
  '{{ width: ''5'' * 1, height: ''6'' * 1, cdn_url: JsDecode("https://q.example.com/x") }}].slice(0)') AS script FROM {pages}"""


@query("weixin_picture_list", f"""
    WITH a AS (SELECT page_id, regexp_extract_all(script, '\\{{\\s*width:\\s*''\\d+''\\s*\\*\\s*1,\\s*height:\\s*''\\d+''\\s*\\*\\s*1,\\s*cdn_url:\\s*(?:JsDecode\\()?[''"][^''"]+[''"]') AS xs FROM ({same(PICTURES)})),
    x AS (SELECT page_id, unnest(xs) AS x, unnest(generate_series(0, len(xs) - 1)) AS ord FROM a)
    SELECT page_id, ord, CAST(regexp_extract(x, 'width:\\s*''(\\d+)''', 1) AS INT) AS width, CAST(regexp_extract(x, 'height:\\s*''(\\d+)''', 1) AS INT) AS height, regexp_extract(x, 'cdn_url:\\s*(?:JsDecode\\()?[''"]([^''"]+)', 1) AS url FROM x""")  # fmt: skip
def weixin_picture_list(spark, sf_dir):
    return P.picture_list(derived(spark, sf_dir, PICTURES), "page_id", "script")


ANNOTATED = "SELECT o_custkey AS doc, o_orderkey AS pos, CASE WHEN o_orderkey % 4 > 0 OR o_custkey % 3 = 0 THEN concat('[高亮/yellow] item ', CAST(o_orderkey AS STRING)) ELSE 'plain' END AS text FROM {orders}"


@query("highlight_annotation", f"""
    WITH s AS (SELECT doc, pos, regexp_matches(text, '(?i)^\\s*\\[(?:(?:高亮|highlight)(?:[/／][^\\]]+)?)\\]\\s*') AS m, trim(regexp_replace(text, '(?i)^\\s*\\[(?:(?:高亮|highlight)(?:[/／][^\\]]+)?)\\]\\s*', '')) AS t FROM ({same(ANNOTATED)})),
    n AS (SELECT *, bool_and(m) OVER (PARTITION BY doc) AS every, row_number() OVER (PARTITION BY doc ORDER BY pos) AS n FROM s)
    SELECT doc, pos, concat(CASE WHEN every THEN concat(n, '、') ELSE '' END, CASE WHEN m THEN concat('<mark>', t, '</mark>') ELSE t END) AS text FROM n""")  # fmt: skip
def highlight_annotation(spark, sf_dir):
    from pyspark.sql import Window

    rows = derived(spark, sf_dir, ANNOTATED).withColumn("t", G.without_annotation(F.col("text"))).withColumn("m", F.col("t") != T.trimmed(F.col("text")))
    rows = rows.withColumn("every", F.bool_and("m").over(Window.partitionBy("doc"))).withColumn("n", F.row_number().over(Window.partitionBy("doc").orderBy("pos")))
    number = F.when(F.col("every"), F.concat(F.col("n").cast("string"), F.lit("、"))).otherwise("")
    return rows.select("doc", "pos", F.concat(number, F.when(F.col("m"), F.concat(F.lit("<mark>"), "t", F.lit("</mark>"))).otherwise(F.col("t"))).alias("text"))


@query("title_resolve", """
    SELECT page_id, coalesce(nullif(CASE WHEN page_id % 3 = 0 THEN concat('Front ', page_id) ELSE '' END, ''), nullif(trim(regexp_extract(html, '(?is)<h1[^>]*>([^<]*)', 1)), ''), 'Untitled') AS title FROM pages""")  # fmt: skip
def title_resolve(spark, sf_dir):
    front = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("Front "), F.col("page_id").cast("string"))).otherwise("")
    candidates = [front, F.trim(F.regexp_extract("html", r"(?is)<h1[^>]*>([^<]*)", 1))]
    return table(spark, sf_dir, "pages").select("page_id", F.coalesce(*[F.nullif(c, F.lit("")) for c in candidates], F.lit("Untitled")).alias("title"))


IMPORTABLE = """SELECT page_id, CASE page_id % 4 WHEN 3 THEN concat('<p class="plain">plain ', CAST(page_id AS STRING), '</p>') ELSE concat('<DIV class="x" id="y" ONCLICK="go()" data-own-id=7><a href="javascript:go()" target="_blank" data-x="1">l</a><a href=''https://example.com'' rel="r">m</a><section><p style="color:red" title=t>1 < 2</p></section><input disabled value="v"/></DIV><style>p {{ }}</style>', html) END AS html FROM {pages}"""
_SAFE = "regexp_replace(" * len(P.UNSAFE) + "html" + "".join(", '{}', '', 'g')".format(p.replace("'", "''")) for p in P.UNSAFE)
_ATTRIBUTE = P.ATTRIBUTE.replace("'", "''")


@query("html_allow_list", f"""
    WITH p AS ({same(IMPORTABLE)}), a AS (SELECT page_id, regexp_extract_all({_SAFE}, '</?[A-Za-z0-9-]+(?:\\s[^>]*)?>|<|[^<]+') AS a FROM p), u AS (SELECT page_id, unnest(a) AS t, unnest(generate_series(1, len(a))) AS i FROM a),
    n AS (SELECT *, CASE WHEN prefix(t, '<') THEN lower(regexp_extract(t, '^</?([A-Za-z0-9-]+)', 1)) ELSE '' END AS name FROM u),
    k AS (SELECT page_id, i, CASE WHEN name = '' THEN t WHEN name NOT IN ({', '.join(f"'{t}'" for t in P.SAFE_TAGS)}) THEN '' WHEN prefix(t, '</') THEN concat('</', name, '>')
      ELSE list_reduce(list_prepend(t, list_filter(regexp_extract_all(t, '{_ATTRIBUTE}', 0), lambda m: lower(regexp_extract(m, '^\\s([A-Za-z:-]+)', 1)) NOT IN ({', '.join(f"'{t}'" for t in [*P.SAFE_ATTRIBUTES, P.OWN + '-caption', P.OWN + '-id'])}))), lambda x, m: replace(x, m, '')) END AS t FROM n),
    o AS (SELECT page_id, string_agg(t, '' ORDER BY i) AS safe FROM k GROUP BY page_id) SELECT page_id, md5(safe) AS html_md5, safe <> html AS sanitized FROM p JOIN o USING (page_id)""")  # fmt: skip
def html_allow_list(spark, sf_dir):
    rows = derived(spark, sf_dir, IMPORTABLE).withColumn("safe", P.allowed_html(F.col("html")))
    return rows.select("page_id", F.md5("safe").alias("html_md5"), (F.col("safe") != F.col("html")).alias("sanitized"))
