"""Queries over note catalogs, merges and look-ups."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmill.operators import notes as N
from quillmill.plans.registry import Registry, derived, same, table
from quillmill.plans.texts import ws

registry = Registry()
query = registry.add

CATALOG_JSON = """
SELECT c_custkey, concat('{{"noteIds":["n', CAST(c_custkey AS STRING), '-1","n', CAST(c_custkey AS STRING), '-2"],"topNoteIds":["n', CAST(c_custkey AS STRING), '-2"],"notes":{{"n', CAST(c_custkey AS STRING), '-1":{{"title":"',
  CASE c_custkey % 3 WHEN 0 THEN '' ELSE c_name END, '","digest":"d1","tags":["', c_mktsegment, '",""]}},"n', CAST(c_custkey AS STRING), '-2":{{"title":"Second","tags":[]}}}}}}') AS body FROM {customer}"""


@query("catalog_ingest", """
    SELECT c_custkey, concat('n', c_custkey, '-1') AS uuid, CASE WHEN c_custkey % 3 = 0 THEN '无标题' ELSE c_name END AS title, 'd1' AS digest, c_mktsegment AS tags, false AS is_top FROM customer
    UNION ALL SELECT c_custkey, concat('n', c_custkey, '-2'), 'Second', '', '', true FROM customer""")  # fmt: skip
def catalog_ingest(spark, sf_dir):
    return N.catalog(derived(spark, sf_dir, CATALOG_JSON), "c_custkey", "body")


def _edges(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("parent"), F.col("o_custkey").alias("child"), (F.col("o_orderkey") % 10).alias("ord"))


@query("children_with_fallback", """
    WITH b AS (SELECT c_custkey AS id, c_name AS t FROM customer WHERE c_custkey % 2 = 0), d AS (SELECT c_custkey AS id, concat('detail ', c_name) AS t FROM customer WHERE c_custkey % 3 = 0)
    SELECT o_orderkey AS parent, o_custkey AS child, o_orderkey % 10 AS ord, coalesce(b.t, d.t) AS title FROM orders LEFT JOIN b ON o_custkey = b.id LEFT JOIN d ON o_custkey = d.id WHERE coalesce(b.t, d.t) IS NOT NULL""")  # fmt: skip
def children_with_fallback(spark, sf_dir):
    customers = table(spark, sf_dir, "customer")
    bulk = customers.where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("title"))
    detail = customers.where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("id"), F.concat(F.lit("detail "), "c_name").alias("title"))
    return N.children(_edges(spark, sf_dir), bulk, detail)


@query("supplemental_ids", "SELECT c_custkey AS id FROM customer WHERE c_acctbal > 0 AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 4 = 0)")
def supplemental_ids(spark, sf_dir):
    listed = table(spark, sf_dir, "orders").where("o_orderkey % 4 = 0").select("o_custkey").distinct()
    return table(spark, sf_dir, "customer").where("c_acctbal > 0").join(listed, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select(F.col("c_custkey").alias("id"))


@query("missing_ids", "SELECT DISTINCT o_custkey AS id FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 5 <> 0)")
def missing_ids(spark, sf_dir):
    found = table(spark, sf_dir, "customer").where("c_custkey % 5 <> 0").select("c_custkey")
    return table(spark, sf_dir, "orders").join(found, F.col("o_custkey") == F.col("c_custkey"), "left_anti").select(F.col("o_custkey").alias("id")).distinct()


@query("ref_info_lookup", """
    WITH l AS (SELECT o_orderkey, coalesce(c_name, '无标题') AS title, coalesce(c_mktsegment, '') AS digest FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 2 = 1) ON o_custkey = c_custkey)
    SELECT * FROM l WHERE NOT (title = '无标题' AND digest = '')""")  # fmt: skip
def ref_info_lookup(spark, sf_dir):
    known = table(spark, sf_dir, "customer").where("c_custkey % 2 = 1").select("c_custkey", "c_name", "c_mktsegment")
    out = table(spark, sf_dir, "orders").join(known, F.col("o_custkey") == F.col("c_custkey"), "left")
    out = out.select("o_orderkey", F.coalesce("c_name", F.lit(N.NO_TITLE)).alias("title"), F.coalesce("c_mktsegment", F.lit("")).alias("digest"))
    return out.where((F.col("title") != N.NO_TITLE) | (F.col("digest") != ""))


ID_LISTS = ["SELECT o_orderkey AS ord, concat(' c', CAST(o_custkey AS STRING), ' ') AS id FROM {orders} WHERE o_orderkey % 7 {k}".replace("{k}", k) for k in ("= 0", "= 1", "= 2", "> 2")]  # each order in one of four lists


@query("priority_union_ids", f"""
    WITH u AS ({" UNION ALL ".join(f"SELECT {i} AS rank, ord, {ws('id')} AS id FROM ({same(sql)})" for i, sql in enumerate(ID_LISTS))}),
    n AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY rank, ord) AS n FROM u WHERE id <> '') SELECT rank, ord, id FROM n WHERE n = 1""")  # fmt: skip
def priority_union_ids(spark, sf_dir):
    return N.union_ids([derived(spark, sf_dir, sql) for sql in ID_LISTS])


@query("map_merge_precedence", """
    WITH orders_of AS (SELECT o_custkey AS key, max(o_orderpriority) AS value FROM orders GROUP BY o_custkey)
    SELECT coalesce(key, c_custkey) AS key, CASE WHEN key IS NOT NULL THEN value ELSE c_name END AS value FROM customer FULL OUTER JOIN orders_of ON c_custkey = key""")  # fmt: skip
def map_merge_precedence(spark, sf_dir):
    """Every customer's name, over which goes what the customer's orders say."""
    first = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("value"))
    second = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("key")).agg(F.max("o_orderpriority").alias("value"))
    return N.merge_maps(first, second)


ARRIVALS = """
SELECT o_custkey AS uuid, o_orderkey AS ord, CASE o_orderkey % 3 WHEN 0 THEN '无标题' WHEN 1 THEN concat('Title ', CAST(o_orderkey AS STRING)) ELSE '' END AS title,
  CASE o_orderkey % 4 WHEN 0 THEN '' ELSE o_orderpriority END AS digest, o_orderkey % 10 = 0 AS is_top, o_orderstatus = 'F' AS is_collection FROM {orders}"""


@query("note_field_merge", f"""
    SELECT uuid, coalesce(max_by(title, ord) FILTER (WHERE title NOT IN ('', '无标题')), '无标题') AS title, coalesce(max_by(digest, ord) FILTER (WHERE digest <> ''), '') AS digest,
      bool_or(is_top) AS is_top, bool_or(is_collection) AS is_collection, min(ord) AS first_ord FROM ({same(ARRIVALS)}) GROUP BY uuid""")  # fmt: skip
def note_field_merge(spark, sf_dir):
    return N.merge_fields(derived(spark, sf_dir, ARRIVALS))


@query("collection_status", f"SELECT uuid, bool_or(is_collection) AS is_collection, bool_or(is_collection OR is_top) AS can_expand FROM ({same(ARRIVALS)}) GROUP BY uuid")
def collection_status(spark, sf_dir):
    return derived(spark, sf_dir, ARRIVALS).groupBy("uuid").agg(F.bool_or("is_collection").alias("is_collection"), F.bool_or(F.col("is_collection") | F.col("is_top")).alias("can_expand"))


DIGESTS = """
SELECT o_orderkey, concat('Note ', CAST(o_orderkey % 50 AS STRING), 'x') AS title, CASE o_orderkey % 6 WHEN 0 THEN concat('Note ', CAST(o_orderkey % 50 AS STRING), 'x') WHEN 1 THEN concat('「Note ', CAST(o_orderkey % 50 AS STRING), 'x」：  body')
  WHEN 2 THEN concat('Note ', CAST(o_orderkey % 50 AS STRING), 'x - body') WHEN 3 THEN '' WHEN 4 THEN concat('【Note ', CAST(o_orderkey % 50 AS STRING), 'x】rest') ELSE 'Other text' END AS digest FROM {orders}"""


def _digest_sql() -> str:
    cases = ""
    for a, b in (("", ""), ("「", "」"), ("『", "』"), ("“", "”"), ('"', '"'), ("【", "】")):
        form = f"concat('{a}', t, '{b}')"
        tail = f"regexp_replace(substring(d, length({form}) + 1), '^[\\s\\x{{a0}}\\x{{200b}}—–:：|｜·•,.，。!！?？、-]+', '')"
        cases += f" WHEN prefix(d, {form}) THEN {ws(tail)}"
    return f"WITH x AS (SELECT o_orderkey, {ws('title')} AS t, {ws('digest')} AS d FROM ({same(DIGESTS)})) SELECT o_orderkey, CASE WHEN t = '' OR d = '' THEN d WHEN d = t THEN ''{cases} ELSE d END AS digest FROM x"


@query("digest_trim", _digest_sql())
def digest_trim(spark, sf_dir):
    return derived(spark, sf_dir, DIGESTS).select("o_orderkey", N.digest_trimmed(F.col("title"), F.col("digest")).alias("digest"))


DATES = """SELECT event_id, CASE event_id % 5 WHEN 0 THEN CAST(1700000000 + event_id AS STRING) WHEN 1 THEN CAST(1700000000123 + event_id AS STRING) WHEN 2 THEN '2024-03-05 06:07:08' WHEN 3 THEN 'soon' ELSE '' END AS raw FROM {events}"""


@query("parse_created_at", f"""
    SELECT event_id, coalesce(strftime(CASE WHEN regexp_matches(raw, '^\\d{{10}}$') THEN make_timestamp(CAST(raw AS BIGINT) * 1000000) WHEN regexp_matches(raw, '^\\d{{13}}$') THEN make_timestamp(CAST(raw AS BIGINT) * 1000)
      ELSE TRY_CAST(raw AS TIMESTAMP) END, '%Y-%m-%d %H:%M:%S'), '') AS created FROM ({same(DATES)})""")  # fmt: skip
def parse_created_at(spark, sf_dir):
    return derived(spark, sf_dir, DATES).select("event_id", F.coalesce(F.date_format(N.created_at(F.col("raw")), "yyyy-MM-dd HH:mm:ss"), F.lit("")).alias("created"))


@query("bilingual_zip", """
    WITH r AS (SELECT conv_id AS doc, role, text, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn, text) AS pos FROM conversations),
    p AS (SELECT coalesce(a.doc, b.doc) AS doc, coalesce(a.pos, b.pos) AS pos, a.text AS l, b.text AS r FROM (SELECT * FROM r WHERE role = 'user') a FULL OUTER JOIN (SELECT * FROM r WHERE role = 'assistant') b ON a.doc = b.doc AND a.pos = b.pos),
    n AS (SELECT *, lead(pos) OVER (PARTITION BY doc ORDER BY pos) IS NOT NULL AS more FROM p)
    SELECT doc, pos, 'original' AS role, l AS text FROM n WHERE l IS NOT NULL UNION ALL SELECT doc, pos, 'translation', r FROM n WHERE r IS NOT NULL UNION ALL SELECT doc, pos, 'spacer', '' FROM n WHERE more""")  # fmt: skip
def bilingual_zip(spark, sf_dir):
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("conv_id", "role").orderBy("turn", "text"))
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc"), "role", "text", n.alias("pos"))
    return N.zip_languages(rows.where("role = 'user'"), rows.where("role = 'assistant'"))


@query("quote_candidate_pick", """
    WITH l AS (SELECT conv_id, turn, string_split(text, chr(10)) AS a FROM conversations), b AS (SELECT conv_id, turn, unnest(a) AS text, unnest(generate_series(0, len(a) - 1)) AS pos FROM l),
    k AS (SELECT *, CASE WHEN pos % 4 = 3 THEN 'image' ELSE 'paragraph' END AS kind, CASE (conv_id + 3 * turn + pos) % 7 WHEN 0 THEN 'original' WHEN 1 THEN 'spacer' WHEN 2 THEN 'translation' WHEN 3 THEN NULL ELSE 'normal' END AS role FROM b),
    c AS (SELECT conv_id AS doc, turn AS candidate, count_if(kind <> 'image' AND trim(text) <> '') AS said, coalesce(bool_or(role IN ('original', 'translation')), false) AS two, coalesce(bool_or(role = 'spacer'), false) AS spaced, sum(length(regexp_replace(text, '\\s+', '', 'g'))) AS chars FROM k GROUP BY conv_id, turn),
    s AS (SELECT *, CAST(CASE WHEN said > 0 THEN 10000 ELSE 0 END + CASE WHEN said > 1 THEN 5000 ELSE 0 END + CASE WHEN two THEN 2000 ELSE 0 END + CASE WHEN spaced THEN 1000 ELSE 0 END + said * 50 + chars * 10 + candidate % 5 * 100 AS BIGINT) AS score FROM c)
    SELECT doc, candidate, score FROM s QUALIFY row_number() OVER (PARTITION BY doc ORDER BY score DESC, candidate) = 1""")  # fmt: skip
def quote_candidate_pick(spark, sf_dir):
    """The turns of a conversation as candidates, their lines as blocks."""
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc"), F.col("turn").alias("candidate"), F.posexplode(F.split("text", "\n")).alias("pos", "text"))
    at = (F.col("doc") + 3 * F.col("candidate") + F.col("pos")) % 7
    role = F.when(at == 0, "original").when(at == 1, "spacer").when(at == 2, "translation").when(at != 3, "normal")
    kind = F.when(F.col("pos") % 4 == 3, "image").otherwise("paragraph")
    return N.best_candidates(rows.select("doc", "candidate", (F.col("candidate") % 5 * 100).alias("priority"), kind.alias("kind"), role.alias("role"), "text"))


ASSETS = """SELECT s_suppkey AS asset, concat('k', CAST(s_suppkey AS STRING)) AS map_key, concat('f', CAST(s_suppkey % 40 AS STRING)) AS file_uuid, concat('u', CAST(s_suppkey AS STRING)) AS uuid,
  CASE s_suppkey % 3 WHEN 0 THEN concat('https://a.example.com/', CAST(s_suppkey AS STRING)) WHEN 1 THEN 'ftp://a.example.com/x' ELSE '' END AS url, CASE s_suppkey % 4 WHEN 0 THEN concat('http://w.example.com/', CAST(s_suppkey AS STRING)) WHEN 1 THEN 'relative.png' END AS wide FROM {supplier}"""
WANTED = "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN concat('k', CAST(p_partkey % 150 AS STRING)) WHEN 1 THEN concat('f', CAST(p_partkey % 60 AS STRING)) WHEN 2 THEN concat('u', CAST(p_partkey % 130 AS STRING)) ELSE 'none' END AS ref FROM {part}"


@query("asset_resolve", f"""
    WITH a AS ({same(ASSETS)}), k AS (SELECT map_key AS key, 0 AS rank, * FROM a UNION ALL SELECT file_uuid, 1, * FROM a UNION ALL SELECT uuid, 2, * FROM a),
    n AS (SELECT p_partkey, asset, url, wide, row_number() OVER (PARTITION BY p_partkey ORDER BY rank, asset) AS n FROM ({same(WANTED)}) JOIN k ON ref = key)
    SELECT p_partkey, asset, CASE WHEN regexp_matches(wide, '^https?://') THEN wide WHEN regexp_matches(url, '^https?://') THEN url ELSE concat('https://assets.example.com/', asset) END AS url FROM n WHERE n = 1""")  # fmt: skip
def asset_resolve(spark, sf_dir):
    return N.resolve_assets(derived(spark, sf_dir, WANTED), derived(spark, sf_dir, ASSETS), "https://assets.example.com/")


NODES = """SELECT o_orderkey AS note, concat('<q cite="https://notes.example.com/detail/cite', CAST(o_orderkey % 100 AS STRING), '?a" uuid="quote', CAST(o_custkey AS STRING), '"></q><p data-note-uuid="data-', CAST(o_orderkey AS STRING), '"></p><note id="1" uuid="abc', CAST(o_orderkey AS STRING), '"></note>',
    CASE o_orderkey % 3 WHEN 0 THEN '<note uuid="a!"></note><note uuid="short"></note>' WHEN 1 THEN concat('<b data-own-note-uuid="tree', CAST(o_custkey AS STRING), '"></b><blockquote cite="/detail/local', CAST(o_custkey AS STRING), '"></blockquote>') ELSE '' END) AS html,
  CASE o_orderkey % 4 WHEN 0 THEN concat('{{"type":"doc","content":[{{"type":"note","attrs":{{"uuid":"tree', CAST(o_custkey AS STRING), '"}}}},{{"type":"text"}},{{"attrs":{{"k":1,"uuid":"after', CAST(o_orderkey AS STRING), '"}},"type":"note"}}]}}') WHEN 1 THEN '{{"type":"doc"}}' END AS tree FROM {orders}"""
_NODE = "\"type\"\\s*:\\s*\"note\"\\s*,\\s*\"attrs\"\\s*:\\s*\\{[^{}]*\"uuid\"\\s*:\\s*\"([^\"]*)\"|\"attrs\"\\s*:\\s*\\{[^{}]*\"uuid\"\\s*:\\s*\"([^\"]*)\"[^{}]*\\}\\s*,\\s*\"type\"\\s*:\\s*\"note\""


@query("child_note_ids", f"""
    WITH n AS ({same(NODES)}), t AS (SELECT note, html, regexp_extract_all(coalesce(tree, ''), '{_NODE}', 1) AS a, regexp_extract_all(coalesce(tree, ''), '{_NODE}', 2) AS b FROM n),
    l AS (SELECT note, list_concat(list_transform(list_zip(a, b), lambda x: concat(x[1], x[2])), {', '.join(f"regexp_extract_all(html, '{p}', 1)" for p in N.NOTE_REFERENCES)}) AS ids FROM t),
    e AS (SELECT note, unnest(ids) AS id, unnest(generate_series(1, len(ids))) AS at_pos FROM l), f AS (SELECT note, id, min(at_pos) AS at_pos FROM e WHERE regexp_matches(id, '^[A-Za-z0-9_-]{{6,}}$') GROUP BY note, id)
    SELECT note, row_number() OVER (PARTITION BY note ORDER BY at_pos) - 1 AS pos, id FROM f""")  # fmt: skip
def child_note_ids(spark, sf_dir):
    return derived(spark, sf_dir, NODES).select("note", F.posexplode(N.child_ids(F.col("html"), F.col("tree"))).alias("pos", "id"))
