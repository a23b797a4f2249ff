"""Queries over neighbouring blocks, derived from line items, documents and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmill.functions import text as T
from quillmill.operators import paragraphs as P
from quillmill.plans.blocks import KEY
from quillmill.plans.registry import Registry, derived, same, table
from quillmill.plans.sequences import ITEM_ORDER
from quillmill.plans.texts import MIXED, candidate, ws

registry = Registry()
query = registry.add

#: Line items as blocks: some empty, some list items or bullets, images, code and quotes.
SEQ = f"""
SELECT l_orderkey AS doc, row_number() OVER (PARTITION BY l_orderkey ORDER BY {ITEM_ORDER}) AS pos,
  CASE l_suppkey % 7 WHEN 0 THEN 'quote' WHEN 1 THEN 'code' WHEN 2 THEN 'image' WHEN 3 THEN 'code' ELSE 'paragraph' END AS kind,
  CASE l_partkey % 9 WHEN 0 THEN '' WHEN 1 THEN '' WHEN 2 THEN '•' WHEN 3 THEN '• item' WHEN 4 THEN '1. first' WHEN 5 THEN 'A view' WHEN 6 THEN 'Author：Bob' WHEN 7 THEN '一、标题' ELSE concat('Words of ', CAST(l_partkey AS STRING)) END AS text,
  CASE WHEN l_suppkey % 2 = 0 THEN 'a view of it' ELSE '' END AS alt, CASE l_partkey % 4 WHEN 0 THEN 'python' WHEN 1 THEN 'sql' ELSE '' END AS lang FROM {{lineitem}}"""
LIST = "regexp_matches({}, '^(?:[•·▪◦●○]\\s+|\\d+[.)、]\\s*)')"


@query("blank_near_structural_drop", f"""
    WITH s AS (SELECT *, CASE WHEN text <> '' THEN kind IN ('quote', 'code', 'image', 'note', 'file') OR {LIST.format('text')} END AS apart FROM ({same(SEQ)})),
    w AS (SELECT *, last_value(apart IGNORE NULLS) OVER (PARTITION BY doc ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b,
      first_value(apart IGNORE NULLS) OVER (PARTITION BY doc ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS a FROM s)
    SELECT doc, pos, kind, text FROM w WHERE NOT (text = '' AND (coalesce(b, false) OR coalesce(a, false)))""")  # fmt: skip
def blank_near_structural_drop(spark, sf_dir):
    return P.drop_blank_near_structure(derived(spark, sf_dir, SEQ)).select("doc", "pos", "kind", "text")


@query("bullet_merge", f"""
    WITH w AS (SELECT *, lag(text) OVER (PARTITION BY doc ORDER BY pos) AS p FROM ({same(SEQ)}))
    SELECT doc, pos, CASE WHEN p = '•' AND text <> '•' THEN '• ' || text ELSE text END AS text FROM w WHERE text <> '•'""")  # fmt: skip
def bullet_merge(spark, sf_dir):
    return P.merge_bullets(derived(spark, sf_dir, SEQ)).select("doc", "pos", "text")


@query("caption_dedup", f"""
    WITH w AS (SELECT *, lag(kind) OVER (PARTITION BY doc ORDER BY pos) AS pk, lag(alt) OVER (PARTITION BY doc ORDER BY pos) AS pa FROM ({same(SEQ)})), k AS (SELECT *, {KEY.format('text')} AS tk, {KEY.format('pa')} AS ak FROM w)
    SELECT doc, pos, kind, text FROM k WHERE NOT coalesce(pk = 'image' AND kind = 'paragraph' AND tk <> '' AND ak <> '' AND (contains(tk, ak) OR contains(ak, tk)), false)""")  # fmt: skip
def caption_dedup(spark, sf_dir):
    return P.drop_repeated_captions(derived(spark, sf_dir, SEQ)).select("doc", "pos", "kind", "text")


@query("code_lang_inherit", f"""
    WITH w AS (SELECT *, lag(kind) OVER (PARTITION BY doc ORDER BY pos) AS pk FROM ({same(SEQ)})),
    r AS (SELECT *, sum(CASE WHEN kind <> 'code' OR coalesce(pk <> 'code', true) THEN 1 ELSE 0 END) OVER (PARTITION BY doc ORDER BY pos ROWS UNBOUNDED PRECEDING) AS run FROM w)
    SELECT doc, pos, CASE WHEN kind = 'code' THEN coalesce(last_value(nullif(lang, '') IGNORE NULLS) OVER (PARTITION BY doc, run ORDER BY pos ROWS UNBOUNDED PRECEDING), '') ELSE lang END AS lang FROM r""")  # fmt: skip
def code_lang_inherit(spark, sf_dir):
    return P.inherit_code_language(derived(spark, sf_dir, SEQ)).select("doc", "pos", "lang")


@query("leading_meta_prune", f"""
    WITH w AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY pos) AS n, regexp_replace(text, '\\s+', '', 'g') AS t FROM ({same(SEQ)}))
    SELECT doc, pos, text FROM w WHERE NOT (n <= 4 AND length(t) BETWEEN 1 AND 80
      AND regexp_replace(regexp_replace(replace(replace(replace(t, 'Author', ''), 'item', ''), 'Bob', ''), '发布于|发表于|原创|作者|公众号|来自|中国', '', 'g'), '[年月日时分秒:：,，.—|·•()（）-]', '', 'g') = '')""")  # fmt: skip
def leading_meta_prune(spark, sf_dir):
    return P.prune_leading_metadata(derived(spark, sf_dir, SEQ), ["Author", "item", "Bob"]).select("doc", "pos", "text")


@query("list_like", f"""
    SELECT doc, pos, {LIST.format('text')} AS list_item, NOT {LIST.format('text')} AND length(text) BETWEEN 1 AND 60
      AND regexp_matches(text, '^[A-Za-z0-9\\x{{4e00}}-\\x{{9fff}}_()\\[\\]【】《》<>·•、/+.-]{{1,18}}[：:]\\s*\\S+') AS metadata, kind IN ('quote', 'code', 'image', 'note', 'file') AS self_spaced FROM ({same(SEQ)})""")  # fmt: skip
def list_like(spark, sf_dir):
    rows = derived(spark, sf_dir, SEQ)
    return rows.select("doc", "pos", P.list_like(F.col("text")).alias("list_item"), P.metadata_like(F.col("text")).alias("metadata"), F.col("kind").isin(P.SELF_SPACED).alias("self_spaced"))


@query("numbered_heading_bold", f"""
    SELECT doc, pos, NOT {LIST.format('text')} AND (regexp_matches(text, '^(一|二|三|四|五|六|七|八|九|十|\\d+)(\\.|、|\\s)') OR (length(text) < 30 AND regexp_matches(text, '^(提示词|适用|核心问题)'))) AS bold FROM ({same(SEQ)})""")  # fmt: skip
def numbered_heading_bold(spark, sf_dir):
    return derived(spark, sf_dir, SEQ).select("doc", "pos", P.numbered_heading(F.col("text")).alias("bold"))


TECHNICAL = """
SELECT o_orderkey, o_custkey AS doc, o_orderkey AS pos, CASE o_orderkey % (CASE WHEN o_custkey % 3 = 0 THEN 7 ELSE 9 END) WHEN 0 THEN 'npm install x' WHEN 1 THEN './run/me' WHEN 2 THEN 'src/app/main.ts' WHEN 3 THEN 'name = value' WHEN 4 THEN concat('{{"a": ', CAST(o_orderkey AS STRING), '}}')
  WHEN 5 THEN '[highlight] git status' WHEN 6 THEN 'file.txt' WHEN 7 THEN 'plain words here' ELSE concat('$ docker run ', CAST(o_orderkey AS STRING)) END AS text FROM {orders}"""
LANGUAGE = f"""CASE WHEN t = '' THEN NULL WHEN regexp_matches(t, '(?i)^(?:[$#]\\s*)?(?:{"|".join(P.COMMANDS)})\\b') OR regexp_matches(t, '^(?:\\.{{1,2}}/|~/|/)\\S+$') OR regexp_matches(t, '^(?:[@A-Za-z0-9_.-]+/)+[@A-Za-z0-9_.-]+(?:\\.[A-Za-z0-9]+)?$')
      OR regexp_matches(t, '^[A-Za-z0-9_.-]+\\.[A-Za-z0-9]{{1,8}}$') THEN 'shellscript' WHEN regexp_matches(t, '^[A-Za-z_][\\w.-]*\\s*[:=]\\s*.+$') THEN 'ini'
      WHEN regexp_matches(t, '^(?:\\{{.*\\}}|\\[.*\\]|".*"\\s*:\\s*.+)$') THEN 'json' END"""
LINES = f"l AS (SELECT doc, pos, {LANGUAGE} AS lang FROM (SELECT doc, pos, trim(regexp_replace(text, '(?i)^\\s*\\[(?:(?:高亮|highlight)(?:[/／][^\\]]+)?)\\]\\s*', '')) AS t FROM ({same(TECHNICAL)})))"


@query("technical_line", f"WITH {LINES} SELECT doc, pos, lang IS NOT NULL AS technical FROM l")
def technical_line(spark, sf_dir):
    return derived(spark, sf_dir, TECHNICAL).select("doc", "pos", P.line_language(F.col("text")).isNotNull().alias("technical"))


VOTES = f"""WITH {LINES}, c AS (SELECT doc, lang, count(*) AS n, min(pos) AS at_pos FROM l WHERE lang IS NOT NULL GROUP BY doc, lang),
    b AS (SELECT doc, first(lang ORDER BY n DESC, at_pos) AS top, count(*) AS k, bool_or(lang = 'shellscript') AS sh FROM c GROUP BY doc), f AS (SELECT doc, bool_and(lang IS NOT NULL) AS technical FROM l GROUP BY doc)"""


@query("list_language_vote", f"{VOTES} SELECT doc, coalesce(CASE WHEN k = 1 THEN top WHEN sh THEN 'shellscript' ELSE top END, 'text') AS language FROM f LEFT JOIN b USING (doc)")
def list_language_vote(spark, sf_dir):
    return P.list_votes(derived(spark, sf_dir, TECHNICAL)).select("doc", "language")


@query("list_is_technical", f"{VOTES} SELECT doc, technical FROM f")
def list_is_technical(spark, sf_dir):
    return P.list_votes(derived(spark, sf_dir, TECHNICAL)).select("doc", "technical")


@query("longform_class", f"""
    WITH t AS (SELECT conv_id AS doc, CASE WHEN (conv_id + turn) % 6 = 0 THEN 'spacer' ELSE role END AS role, text, conv_id % 7 = 3 AND turn % 2 = 1 AS draft FROM conversations), k AS (SELECT *, role <> 'spacer' AND {ws('text')} <> '' AS said FROM t),
    c AS (SELECT doc, count_if(said) AS n, count_if(said AND length({candidate('text')}) >= 40) AS long, sum(CASE WHEN said THEN length(text) + 2 ELSE 0 END) - 2 AS chars, count(DISTINCT CASE WHEN said THEN role END) AS roles, bool_or(draft) AS draft FROM k GROUP BY doc)
    SELECT doc, CASE WHEN draft THEN 'x-article' WHEN n >= 4 AND long >= 4 AND (roles >= 2 OR chars >= 500 OR long >= 6) THEN 'tweet-longform' ELSE 'tweet' END AS kind FROM c""")  # fmt: skip
def longform_class(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").withColumn("role", F.when((F.col("conv_id") + F.col("turn")) % 6 == 0, "spacer").otherwise(F.col("role")))
    draft = (F.col("conv_id") % 7 == 3) & (F.col("turn") % 2 == 1)
    return P.longform(rows.select(F.col("conv_id").alias("doc"), F.col("turn").alias("pos"), "role", "text", draft.alias("draft")))


@query("han_latin_spacing", f"""
    SELECT page_id, regexp_replace(regexp_replace(line, '([\\x{{4e00}}-\\x{{9fff}}])[ \\t]*([A-Za-z])', '\\1 ' || chr(8288) || '\\2', 'g'),
      '([A-Za-z0-9.,!?;:)\\]''"“”‘’_-])[ \\t]*([\\x{{4e00}}-\\x{{9fff}}])', '\\1 ' || chr(8288) || '\\2', 'g') AS line FROM ({same(MIXED)})""")  # fmt: skip
def han_latin_spacing(spark, sf_dir):
    return derived(spark, sf_dir, MIXED).select("page_id", T.spaced(F.col("line")).alias("line"))


@query("leading_script", f"""
    WITH t AS (SELECT page_id, {candidate('line')} AS t FROM ({same(MIXED)})),
    k AS (SELECT page_id, t, regexp_extract(t, '[\\x{{4e00}}-\\x{{9fff}}A-Za-z]') AS f FROM t),
    c AS (SELECT page_id, t, f, CASE WHEN f = '' THEN t WHEN regexp_matches(f, '[A-Za-z]') THEN regexp_extract(t, '[A-Za-z][^\\x{{4e00}}-\\x{{9fff}}]*') ELSE regexp_extract(t, '[\\x{{4e00}}-\\x{{9fff}}][^A-Za-z]*') END AS c FROM k),
    n AS (SELECT page_id, f, {candidate('c')} AS c FROM c)
    SELECT page_id, CASE WHEN f = '' THEN c WHEN regexp_matches(f, '[A-Za-z]') THEN coalesce(nullif(regexp_replace(c, '[\\s–—:：|/.,;!?-]+$', ''), ''), c) ELSE coalesce(nullif(regexp_replace(c, '[\\s–—:：|/-]+$', ''), ''), c) END AS script FROM n""")  # fmt: skip
def leading_script(spark, sf_dir):
    return derived(spark, sf_dir, MIXED).select("page_id", T.leading_script(F.col("line")).alias("script"))


EXCERPTS = "SELECT doc_id, concat('![pic](http://x/y) # ', substring(text, 1, 20), ' [link text](http://x) *', substring(text, 21), '*') AS md FROM {documents}"


@query("md_excerpt_title", f"""
    WITH n AS (SELECT doc_id, {ws("regexp_replace(regexp_replace(regexp_replace(regexp_replace(md, '!\\[([^\\]]*)\\]\\([^)]+\\)', '\\1', 'g'), '\\[([^\\]]+)\\]\\([^)]+\\)', '\\1', 'g'), '[`*_>#-]', ' ', 'g'), '\\s+', ' ', 'g')")} AS t FROM ({same(EXCERPTS)})),
    e AS (SELECT doc_id, t, substring(t, 1, 30) AS e, instr(reverse(substring(t, 1, 30)), ' ') AS s FROM n)
    SELECT doc_id, CASE WHEN length(t) <= 30 THEN t WHEN substring(t, 31, 1) <> ' ' AND s > 0 THEN substring(e, 1, 31 - s) ELSE e END AS title FROM e""")  # fmt: skip
def md_excerpt_title(spark, sf_dir):
    return derived(spark, sf_dir, EXCERPTS).select("doc_id", T.excerpt_title(F.col("md")).alias("title"))


@query("safe_file_name", f"""
    WITH b AS (SELECT p_partkey, CASE WHEN n = '' THEN '导出笔记' ELSE n END AS base FROM (SELECT p_partkey, substring({ws("regexp_replace(regexp_replace(p_type || '/' || p_brand || ': ' || CAST(p_size % 5 AS VARCHAR), '[\\\\/:*?\"<>|]', '_', 'g'), '\\s+', ' ', 'g')")}, 1, 100) AS n FROM part)),
    k AS (SELECT p_partkey, base, row_number() OVER (PARTITION BY base ORDER BY p_partkey) - 1 AS k FROM b) SELECT p_partkey, CASE WHEN k > 0 THEN base || ' (' || k || ')' ELSE base END AS name FROM k""")  # fmt: skip
def safe_file_name(spark, sf_dir):
    from pyspark.sql import Window

    rows = table(spark, sf_dir, "part").select("p_partkey", T.file_base(F.concat("p_type", F.lit("/"), "p_brand", F.lit(": "), (F.col("p_size") % 5).cast("string"))).alias("base"))
    k = F.row_number().over(Window.partitionBy("base").orderBy("p_partkey")) - 1
    return rows.withColumn("k", k).select("p_partkey", F.when(F.col("k") > 0, F.concat("base", F.lit(" ("), F.col("k").cast("string"), F.lit(")"))).otherwise(F.col("base")).alias("name"))


@query("stale_extract_filter", """
    SELECT page_id, NOT (snapshot >= 80 AND NOT has_text AND words < least(120, floor(0.6 * snapshot))) AS reuse
    FROM (SELECT page_id, page_id * 7 % 300 AS snapshot, page_id % 3 = 0 AS has_text, page_id * 11 % 200 AS words FROM pages)""")  # fmt: skip
def stale_extract_filter(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").selectExpr("page_id", "page_id * 7 % 300 AS snapshot", "page_id % 3 = 0 AS has_text", "page_id * 11 % 200 AS words")
    return rows.select("page_id", ((F.col("snapshot") < 80) | F.col("has_text") | (F.col("words") >= F.least(F.lit(120), F.floor(F.col("snapshot") * 0.6)))).alias("reuse"))


SEGMENTS = """SELECT conv_id AS doc, turn AS pos, CASE turn % 5 WHEN 0 THEN 'original' WHEN 1 THEN 'translation' WHEN 2 THEN 'spacer' ELSE 'normal' END AS role, (turn - turn % 2) AS grp, role AS text FROM {conversations}"""


@query("structured_spacers", f"""
    WITH s AS (SELECT *, lead(grp) OVER (PARTITION BY doc ORDER BY pos) AS a FROM ({same(SEGMENTS)}) WHERE role <> 'spacer')
    SELECT doc, pos, 0 AS half, role, text FROM s UNION ALL SELECT doc, pos, 1, 'spacer', '' FROM s WHERE a IS NOT NULL AND a IS DISTINCT FROM grp""")  # fmt: skip
def structured_spacers(spark, sf_dir):
    return P.space_groups(derived(spark, sf_dir, SEGMENTS))


REFERENCES = f"""SELECT l_orderkey AS doc, row_number() OVER (PARTITION BY l_orderkey ORDER BY {ITEM_ORDER}) AS pos, CASE l_suppkey % 5 WHEN 0 THEN 'reference' ELSE 'paragraph' END AS kind,
  CASE WHEN l_partkey % 3 = 0 AND l_suppkey % 5 > 0 THEN '' ELSE concat('t', CAST(l_partkey AS STRING)) END AS text FROM {{lineitem}}"""


@query("reference_padding", f"""
    WITH s AS (SELECT *, CASE WHEN text <> '' THEN kind END AS solid FROM ({same(REFERENCES)})),
    w AS (SELECT *, last_value(solid IGNORE NULLS) OVER (PARTITION BY doc ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b,
      first_value(solid IGNORE NULLS) OVER (PARTITION BY doc ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS a FROM s),
    k AS (SELECT * FROM w WHERE NOT (text = '' AND (coalesce(b = 'reference', false) OR coalesce(a = 'reference', false))))
    SELECT doc, pos, 1 AS half, kind, text FROM k UNION ALL SELECT doc, pos, 0, 'paragraph', '' FROM k WHERE b IS NOT NULL AND (kind = 'reference' OR b = 'reference') AND text <> ''""")  # fmt: skip
def reference_padding(spark, sf_dir):
    return P.pad_references(derived(spark, sf_dir, REFERENCES))


ATTACHED = "SELECT o_custkey AS note, o_orderkey % 2 AS rank, o_orderkey AS ord, concat('im', CAST(o_orderkey % 7 AS STRING)) AS image FROM {orders}"
BODY = "SELECT c_custkey AS note, concat('im', CAST(c_custkey % 7 AS STRING)) AS image FROM {customer}"


@query("gallery_expand", f"""
    WITH n AS (SELECT *, row_number() OVER (PARTITION BY note, image ORDER BY rank, ord) AS n FROM ({same(ATTACHED)}))
    SELECT note, image, rank, ord FROM n WHERE n = 1 AND (note, image) NOT IN (SELECT note, image FROM ({same(BODY)}))""")  # fmt: skip
def gallery_expand(spark, sf_dir):
    return P.galleries(derived(spark, sf_dir, ATTACHED), derived(spark, sf_dir, BODY))


def _depth(names: str) -> str:
    return f"sum(CASE WHEN name IN ({names}) THEN CASE WHEN prefix(tok, '</') THEN -1 ELSE 1 END ELSE 0 END) OVER (PARTITION BY page_id, block ORDER BY pos ROWS UNBOUNDED PRECEDING) > 0"


@query("mark_spans", f"""
    WITH c AS (SELECT page_id, regexp_extract_all(regexp_replace(regexp_replace(html, '(?is)<script\\b.*?</script>', '', 'g'), '(?is)<style\\b.*?</style>', '', 'g'), '<[^>]+>|[^<]+') AS a FROM pages),
    t AS (SELECT page_id, unnest(a) AS tok, unnest(generate_series(0, len(a) - 1)) AS pos FROM c), n AS (SELECT *, lower(regexp_extract(tok, '^</?([a-zA-Z][a-zA-Z0-9]*)', 1)) AS name FROM t),
    b AS (SELECT *, sum(CASE WHEN name IN ('p', 'div', 'li', 'h1', 'article', 'footer', 'nav', 'title') THEN 1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS block FROM n),
    m AS (SELECT page_id, pos, tok, {_depth("'b', 'strong'")} AS bold, {_depth("'i', 'em'")} AS italic, {_depth("'code'")} AS code, {_depth("'a'")} AS link FROM b)
    SELECT page_id, pos, bold, italic, code, link, {ws('tok')} AS text FROM m WHERE NOT prefix(tok, '<') AND {ws('tok')} <> ''""")  # fmt: skip
def mark_spans(spark, sf_dir):
    return P.mark_spans(table(spark, sf_dir, "pages"))
