"""Queries over texts in two languages."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmill.functions.scripts import MOST_CUTS, script_cuts
from quillmill.operators import bilingual as B
from quillmill.operators.blocks import lines
from quillmill.plans.blocks import LINES
from quillmill.plans.registry import Registry, derived, same, table
from quillmill.plans.texts import HAN, LATIN, kind

registry = Registry()
query = registry.add

#: White space and fillers as RE2 takes them.
WS = "\\s\\x{0b}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}\\x{feff}"
FILL = WS + "\\x{2060},，.。!！?？;；:：、\\-–—>→()（）\\[\\]【】\"“”''‘’/"
FILL_TAIL = FILL.replace(":：", "")


def edged(x: str) -> str:
    return f"regexp_replace({x}, '^[{WS}]+|[{WS}]+$', '', 'g')"


def n_of(x: str, pattern: str) -> str:
    quoted = pattern.replace("'", "''")
    return f"len(regexp_extract_all({x}, '{quoted}'))"


def cuts_sql() -> str:
    """CTEs from src (id, text) to cuts (id, k, cut): a round of each cut over the places where scripts meet."""
    english = f"""{n_of('substr(t, r, 24)', HAN)} = 0 AND ({n_of('substr(t, r, 80)', LATIN)} >= 3 OR ({n_of('substr(t, r, 40)', LATIN)} >= 2
        AND regexp_matches(substr(t, r, 40), '^[A-Za-z][A-Za-z{WS}''’-]{{1,40}}[:：]')))"""
    chinese = f"{n_of('substr(t, r, 40)', HAN)} >= 6 AND {n_of('substr(t, r, 24)', LATIN)} <= 1"
    bare = edged(f"regexp_replace(regexp_replace(pre, '^[{FILL}]+', ''), '[{FILL_TAIL}]+$', '')")
    label = f"""(length(bare) BETWEEN 1 AND 24 AND NOT regexp_matches(bare, '[。！？!?；;]') AND regexp_matches(bare, '[{WS}]|[:：]$')
        AND CASE WHEN han THEN {n_of('bare', LATIN)} >= 2 AND {n_of('bare', HAN)} = 0 ELSE {n_of('bare', HAN)} BETWEEN 2 AND 10 AND {n_of('bare', LATIN)} = 0 END)"""
    long = f"""(regexp_matches(gap, '[>→\\-–—:：]') AND CASE WHEN han THEN {n_of('pre', LATIN)} >= 3 AND regexp_matches(pre, '[A-Za-z0-9][{WS}]+[A-Za-z]') ELSE {n_of('pre', HAN)} >= 6 END)"""
    rounds = "".join(
        f""", cut{k} AS (SELECT id, min_by(place, r) AS cut FROM (SELECT *, {bare} AS bare FROM (SELECT p.*, substr(t, cut + 1, r - 1 - cut) AS pre FROM cut{k - 1} JOIN places p USING (id) WHERE l > cut))
        WHERE {long} OR {label} GROUP BY id)"""
        for k in range(1, MOST_CUTS + 1)
    )
    every = " UNION ALL ".join(f"SELECT id, {k} AS k, cut FROM cut{k}" for k in range(1, MOST_CUTS + 1))
    return f"""body AS (SELECT id, regexp_replace(text, '[{WS}]+$', '') AS t FROM src),
    chars AS (SELECT id, unnest(string_split(t, '')) AS c, unnest(generate_series(1, length(t))) AS p FROM body WHERE regexp_matches(t, '{HAN}') AND regexp_matches(t, '[A-Za-z]')),
    scripts AS (SELECT id, p, regexp_matches(c, '{HAN}') AS han FROM chars WHERE regexp_matches(c, '[\\x{{4e00}}-\\x{{9fff}}A-Za-z]')),
    pairs AS (SELECT id, lag(p) OVER w AS l, p AS r, lag(han) OVER w <> han AS meet, han FROM scripts WINDOW w AS (PARTITION BY id ORDER BY p)),
    places AS (SELECT id, t, l, r, han, gap, CASE WHEN regexp_matches(gap, '[>→\\-–—]') THEN l + length(regexp_extract(gap, '^[^>→\\-–—]*')) ELSE r - 1 END AS place
      FROM (SELECT *, substr(t, l + 1, r - l - 1) AS gap FROM pairs JOIN body USING (id) WHERE meet)
      WHERE regexp_matches(gap, '^[{FILL}]*$') AND CASE WHEN han THEN {chinese} ELSE {english} END),
    cut0 AS (SELECT id, length(regexp_extract(t, '^[{WS}]*')) AS cut FROM body){rounds}, cuts AS ({every})"""


MIXED = """
SELECT conv_id, turn, conv_id * 1000 + turn AS id, CASE (conv_id + turn) % 10 WHEN 0 THEN concat('完整解析：', text) WHEN 1 THEN concat('  ', text, ': 以下是这段话的完整中文翻译和说明')
  WHEN 2 THEN concat('这一段介绍长期记忆的研究背景 → ', text, ' – 研究人员继续讨论同样的问题与方法 — ', text) WHEN 3 THEN concat(role, ' writes a note 为什么大型语言模型的长期记忆问题仍未解决') WHEN 4 THEN text
  WHEN 5 THEN concat('中文', role, '混排 Spark 任务', text) WHEN 6 THEN concat('tmux-cli-driver-x-y: 这是一个命令行工具的说明文字 ', text) WHEN 7 THEN '只有中文，没有别的文字'
  WHEN 8 THEN concat('Data Ingest: ', '所有数据都要先经过清洗和转换。Next Step: ', text, '：接下来的步骤需要更多的说明文字') ELSE concat('一 二三', chr(9), text, chr(160)) END AS text FROM {conversations}"""


@query("mixed_script_split", f"""
    WITH m AS ({same(MIXED)}), src AS (SELECT id, text FROM m), {cuts_sql()}, listed AS (SELECT id, string_agg(CAST(cut AS VARCHAR), ',' ORDER BY k) AS cuts, count(*) AS n FROM cuts GROUP BY id)
    SELECT conv_id, turn, coalesce(n, 0) AS n_cuts, coalesce(cuts, '') AS cuts FROM m LEFT JOIN listed USING (id)""")  # fmt: skip
def mixed_script_split(spark, sf_dir):
    rows = derived(spark, sf_dir, MIXED).select("conv_id", "turn", script_cuts(F.col("text")).alias("cuts"))
    return rows.select("conv_id", "turn", F.size("cuts").cast("long").alias("n_cuts"), F.array_join(F.col("cuts").cast("array<string>"), ",").alias("cuts"))


#: A document's lines and its whole text as the two sides, in six ways.
SIDES = f"""{LINES}, whole AS (SELECT doc_id AS doc, text FROM documents), d AS (SELECT doc_id AS doc, line_no AS pos, line AS text, line AS html FROM lines),
    r AS (SELECT doc, 'original' AS side, pos, text, html FROM d WHERE doc % 6 <> 2 UNION ALL SELECT doc, 'original', 0, replace(text, chr(10), ' '), text FROM whole WHERE doc % 6 = 2
      UNION ALL SELECT doc, 'translation', pos, text, html FROM d WHERE doc % 6 IN (2, 4) OR (doc % 6 = 5 AND pos > 0)
      UNION ALL SELECT doc, 'translation', 0, replace(text, chr(10), CASE doc % 6 WHEN 0 THEN concat(chr(10), ' ', chr(10)) ELSE ' ' END), CASE doc % 6 WHEN 3 THEN concat('<a href="#">', text, '</a>') ELSE text END FROM whole WHERE doc % 6 IN (0, 1, 3))"""


def _sides(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), "text")
    rows = lines(table(spark, sf_dir, "documents")).select(F.col("doc_id").alias("doc"), F.col("line_no").alias("pos"), F.col("line").alias("text"), F.col("line").alias("html"))
    way = F.col("doc") % 6
    side = lambda df, name, where: df.where(where).withColumn("side", F.lit(name))
    lone = docs.select("doc", F.lit(0).alias("pos"), F.replace("text", F.lit("\n"), F.when(way == 0, "\n \n").otherwise(" ")).alias("text"), F.when(way == 3, F.concat(F.lit('<a href="#">'), "text", F.lit("</a>"))).otherwise(F.col("text")).alias("html"))
    parts = [side(rows, "original", way != 2), side(lone, "original", way == 2), side(rows, "translation", way.isin(2, 4) | ((way == 5) & (F.col("pos") > 0))), side(lone, "translation", way.isin(0, 1, 3))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def _break_sql() -> str:
    """The break nearest to tg in body, with low, high, first and last around it."""
    kinds = [("\\n$", "\\n"), (f"[。！？!?；;:：][{WS}]*$", f"[{WS}]"), (f"[,，][{WS}]*$", f"[{WS}]"), (f"[{WS}]$", f"[{WS}]")]
    tests = [f"regexp_matches(substr(body, first + 1, b - first), '{end}') AND (b = last OR NOT regexp_matches(substr(body, b + 1, 1), '{more}'))" for end, more in kinds]
    pick = [f"list_min(list_transform(list_filter(generate_series(greatest(low, first) + 1, least(high - 1, last)), lambda b: {t}), lambda b: {{'d': abs(b - tg), 'b': b}})).b" for t in tests]
    return f"CASE WHEN low >= high THEN target ELSE coalesce({', '.join(pick)}, tg) END"


ALIGNED = f"""
    {SIDES}, c AS (SELECT *, row_number() OVER (PARTITION BY doc, side ORDER BY pos, text, html) - 1 AS p, count(*) OVER (PARTITION BY doc, side) AS n, count(*) OVER (PARTITION BY doc) - count(*) OVER (PARTITION BY doc, side) AS m FROM r),
    diff AS (SELECT * FROM c WHERE m > 0 AND n <> m),
    lone AS (SELECT doc, side, m, {edged('text')} AS body FROM diff WHERE n = 1 AND m > 1 AND NOT regexp_matches(html, '(?i)<(a|strong|em|code)\\b') AND {edged('text')} <> ''),
    bylines AS (SELECT doc, side, list_filter(list_transform(regexp_split_to_array(body, '\\n\\s*\\n+'), lambda x: {edged('x')}), lambda x: x <> '') AS parts, m FROM lone),
    heavy AS (SELECT l.doc, l.side, l.body, l.m, d.p, sum(length(regexp_replace(d.text, '[{WS}]+', '', 'g'))) OVER (PARTITION BY l.doc ORDER BY d.p) AS cum, sum(length(regexp_replace(d.text, '[{WS}]+', '', 'g'))) OVER (PARTITION BY l.doc) AS total
      FROM lone l JOIN bylines b ON b.doc = l.doc AND len(b.parts) <> b.m JOIN diff d ON d.doc = l.doc AND d.side <> l.side),
    targets AS (SELECT *, CAST((2 * length(body) * cum + total) // (2 * total) AS BIGINT) AS target, greatest(6, least(28, CAST(floor(length(body) * 0.12) AS BIGINT))) AS reach FROM heavy WHERE total > 0 AND p < m - 1),
    walk AS (SELECT doc, -1::BIGINT AS p, 0::BIGINT AS start FROM (SELECT DISTINCT doc FROM targets) UNION ALL
      SELECT doc, p, {_break_sql()} FROM (SELECT *, greatest(low, tg - reach) AS first, least(high, tg + reach) AS last FROM (SELECT *, least(greatest(target, low), high) AS tg FROM
        (SELECT t.*, w.start + 1 AS low, length(t.body) - (t.m - t.p - 1) AS high FROM walk w JOIN targets t ON t.doc = w.doc AND t.p = w.p + 1)))),
    stops AS (SELECT w.doc, l.side, l.body, l.m, w.p + 1 AS p, w.start, coalesce(lead(w.start) OVER (PARTITION BY w.doc ORDER BY w.p), length(l.body)) AS stop FROM walk w JOIN lone l USING (doc)),
    byweight AS (SELECT doc, side, p, {edged('substr(body, start + 1, stop - start)')} AS text FROM stops),
    made AS (SELECT doc, side, unnest(generate_series(0, len(parts) - 1)) AS p, unnest(parts) AS text FROM bylines WHERE len(parts) = m
      UNION ALL SELECT doc, side, p, text FROM byweight WHERE doc NOT IN (SELECT doc FROM byweight WHERE text = '')),
    filled AS (SELECT doc, side, p, {edged('text')} AS text, {edged('html')} AS html FROM diff WHERE doc NOT IN (SELECT doc FROM made) AND {edged('text')} <> '' AND {edged('html')} <> ''),
    joinable AS (SELECT doc FROM filled GROUP BY doc HAVING count(DISTINCT side) = 2)
    SELECT doc, side, p AS pos, text, html FROM c WHERE m = 0 OR n = m
    UNION ALL SELECT doc, side, p, text, replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;') FROM made
    UNION ALL SELECT doc, side, p, text, html FROM diff WHERE doc NOT IN (SELECT doc FROM joinable) AND (doc, side) NOT IN (SELECT (doc, side) FROM made)
    UNION ALL SELECT doc, side, 0, string_agg(text, chr(10) || chr(10) ORDER BY p), string_agg(html, '<br><br>' ORDER BY p) FROM filled WHERE doc IN (SELECT doc FROM joinable) GROUP BY doc, side"""


@query("bilingual_align", f"WITH RECURSIVE {ALIGNED}")
def bilingual_align(spark, sf_dir):
    return B.align_runs(_sides(spark, sf_dir)).select("doc", "side", F.col("pos").cast("long").alias("pos"), "text", "html")


CARDS = """
SELECT conv_id AS doc, turn AS line, 0 AS seg, CASE (conv_id * 7 + turn) % 11 WHEN 8 THEN 'original' WHEN 9 THEN NULL WHEN 10 THEN 'spacer' ELSE 'normal' END AS role,
  CASE (conv_id * 7 + turn) % 11 WHEN 0 THEN text WHEN 1 THEN repeat('这是一段中文说明。', CAST(1 + floor(length(text) / 40) AS INT)) WHEN 2 THEN CASE WHEN turn % 2 = 0 THEN 'https://example.com/a' ELSE 'example.com/b' END WHEN 3 THEN concat('- Item ', role)
  WHEN 4 THEN '- 项目纪念品' WHEN 5 THEN concat(role, ' writes a note: 为什么大型语言模型的长期记忆问题仍未解决') WHEN 6 THEN '本周论文' WHEN 7 THEN 'Weekly Papers' WHEN 8 THEN text WHEN 9 THEN concat('  ', text) ELSE '' END AS text FROM {conversations}
UNION ALL SELECT conv_id, turn, 1, CASE (conv_id * 7 + turn) % 11 WHEN 8 THEN 'translation' ELSE 'normal' END, CASE (conv_id * 7 + turn) % 11 WHEN 0 THEN 'And one more sentence here' ELSE '还有一句话' END FROM {conversations} WHERE (conv_id * 7 + turn) % 11 IN (0, 1, 8)"""


def _pairing_sql() -> str:
    both = edged("text")
    parts = "list_filter(list_transform(list_transform(generate_series(0, len(cuts)), lambda k: substr(t, CASE WHEN k = 0 THEN 1 ELSE cuts[k] + 1 END, CASE WHEN k = len(cuts) THEN length(t) ELSE cuts[k + 1] END - CASE WHEN k = 0 THEN 0 ELSE cuts[k] END)), lambda x: {0}), lambda x: x <> '')".format(edged("x"))
    heading = f"""(NOT regexp_matches(every, '[。！？!?；;:：]$') AND every <> '' AND ((kind = 'english' AND {n_of('every', LATIN)} BETWEEN 1 AND 8 AND regexp_matches(every, '^[A-Z0-9]'))
      OR (kind = 'chinese' AND {n_of('every', HAN)} BETWEEN 1 AND 10 AND NOT regexp_matches(every, '[，,]'))))"""
    return f"""s AS ({same(CARDS)}), g AS (SELECT doc, line, count(*) AS k, min(role) AS role, min(text) AS text FROM s GROUP BY doc, line),
    src AS (SELECT doc * 1000 + line AS id, doc, line, {both} AS text FROM g WHERE k = 1 AND coalesce(role, 'normal') = 'normal' AND {both} <> '' AND NOT regexp_matches(text, '<[^>]+>')),
    {cuts_sql()}, listed AS (SELECT id, list(cut ORDER BY k) AS cuts FROM cuts GROUP BY id),
    parted AS (SELECT doc, line, {parts} AS parts FROM (SELECT doc, line, text AS t, cuts FROM src JOIN listed USING (id))),
    kinds AS (SELECT doc, line, parts, {kind('parts[1]')} AS k1, {kind('parts[2]')} AS k2 FROM parted WHERE len(parts) = 2),
    two AS (SELECT doc, line, CASE WHEN k1 = 'english' THEN parts[1] ELSE parts[2] END AS a, CASE WHEN k1 = 'english' THEN parts[2] ELSE parts[1] END AS b FROM kinds WHERE k1 <> 'other' AND k2 <> 'other' AND k1 <> k2),
    segs AS (SELECT * FROM s WHERE (doc, line) NOT IN (SELECT (doc, line) FROM two) UNION ALL SELECT doc, line, 0, 'original', a FROM two UNION ALL SELECT doc, line, 1, 'translation', b FROM two),
    kept AS (SELECT *, {kind('tt')} AS kd FROM (SELECT *, {both} AS tt FROM segs) WHERE coalesce(role, 'normal') <> 'spacer' AND tt <> '' AND NOT regexp_matches(tt, '(?i)^https?://\\S+$') AND NOT regexp_matches(tt, '(?i)^(?:[a-z0-9-]+\\.)+[a-z]{{2,}}(?:/[^\\s]*)?$')),
    grp AS (SELECT doc, line, count(*) AS n, count_if(kd = 'english') AS en, count_if(kd = 'chinese') AS zh, string_agg(tt, ' ' ORDER BY seg) AS every, bool_or(coalesce(role, '') IN ('original', 'translation')) AS roled FROM kept GROUP BY doc, line),
    named AS (SELECT *, CASE WHEN en > 0 AND en >= zh THEN 'english' WHEN zh > 0 THEN 'chinese' WHEN regexp_matches(every, '{HAN}') THEN 'chinese' WHEN regexp_matches(every, '[A-Za-z]') THEN 'english' ELSE 'other' END AS kind,
      regexp_matches(every, '^([→➜•\\-–—*]|\\d+\\s*[-.:：)]|[A-Za-z]\\)|[A-Za-z]\\.)') AS mark, length(regexp_replace(every, '\\s+', '', 'g')) AS chars, row_number() OVER (PARTITION BY doc ORDER BY line) AS i, count(*) OVER (PARTITION BY doc) AS of FROM grp),
    headed AS (SELECT *, {heading} AS heading FROM named),
    bonds AS (SELECT a.doc, a.i, a.line, a.of, a.kind, coalesce(NOT a.roled AND NOT b.roled AND a.kind <> 'other' AND b.kind <> 'other' AND a.kind <> b.kind AND a.mark = b.mark AND (a.mark OR a.heading = b.heading) AND abs(a.n - b.n) <= 1
      AND least(a.chars, b.chars) >= 0.2 * greatest(a.chars, b.chars), false) AS bond FROM headed a LEFT JOIN headed b ON b.doc = a.doc AND b.i = a.i + 1),
    walk AS (SELECT doc, i, line, of, kind, bond AS opens, false AS closes, 0 AS unit FROM bonds WHERE i = 1 UNION ALL
      SELECT b.doc, b.i, b.line, b.of, b.kind, b.bond AND NOT w.opens, w.opens, CASE WHEN w.opens THEN w.unit ELSE w.unit + 1 END FROM walk w JOIN bonds b ON b.doc = w.doc AND b.i = w.i + 1),
    rolled AS (SELECT w.doc, w.unit, k.line, k.seg, CASE WHEN opens OR closes THEN CASE WHEN kind = 'english' THEN 'original' ELSE 'translation' END ELSE coalesce(k.role, 'normal') END AS role, k.text,
        CASE WHEN (opens OR closes) AND kind <> 'english' THEN 1 ELSE 0 END AS half FROM walk w JOIN kept k ON k.doc = w.doc AND k.line = w.line
      UNION ALL SELECT doc, unit, line, 0, 'spacer', '', 2 FROM walk WHERE NOT opens AND i < of)
    SELECT doc, unit, row_number() OVER (PARTITION BY doc, unit ORDER BY half, line, seg) - 1 AS pos, role, text FROM rolled"""


@query("card_pairing", f"WITH RECURSIVE {_pairing_sql()}")
def card_pairing(spark, sf_dir):
    rows = derived(spark, sf_dir, CARDS).withColumn("html", F.col("text"))
    return B.pair_cards(rows).select("doc", F.col("unit").cast("long").alias("unit"), F.col("pos").cast("long").alias("pos"), "role", "text")
