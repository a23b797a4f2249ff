"""Queries over ordered rows: packing, slots, retries, tops and roll-ups of saving and highlighting."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmill.operators import sequences as S
from quillmill.operators.blocks import lines
from quillmill.plans.blocks import LINES
from quillmill.plans.registry import Registry, derived, same, table

registry = Registry()
query = registry.add

LIMIT = 400
#: lineitem as blocks of documents; all columns order it, as line numbers repeat.
ITEM_ORDER = "l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate, l_returnflag, l_linestatus"


def _items(spark, sf_dir):
    return table(spark, sf_dir, "lineitem")


@query("group_islands", f"""
    WITH w AS (SELECT *, lag(l_returnflag) OVER (PARTITION BY l_orderkey ORDER BY {ITEM_ORDER}) AS b FROM lineitem),
    i AS (SELECT *, CAST(sum(CASE WHEN b IS NULL OR b <> l_returnflag THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey ORDER BY {ITEM_ORDER} ROWS UNBOUNDED PRECEDING) AS BIGINT) AS island FROM w)
    SELECT l_orderkey, island, count(*) AS n, sum(greatest(l_quantity, 1)) AS island_size, sum(greatest(l_quantity, 1)) <= 60 AS atomic FROM i GROUP BY l_orderkey, island""")  # fmt: skip
def group_islands(spark, sf_dir):
    rows = S.islands(_items(spark, sf_dir), "l_orderkey", ITEM_ORDER.split(", "), "l_returnflag", "l_quantity", 60)
    return rows.groupBy("l_orderkey", "island").agg(F.count(F.lit(1)).alias("n"), F.max("island_size").alias("island_size"), F.bool_and("atomic").alias("atomic"))


PACKED = f"""
    RECURSIVE {LINES}, sized AS (SELECT doc_id, line_no, greatest(length(line), 1) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS i FROM lines),
    walk AS (SELECT doc_id, line_no, i, 0 AS part, CAST(n AS BIGINT) AS used FROM sized WHERE i = 1 UNION ALL
      SELECT s.doc_id, s.line_no, s.i, CASE WHEN w.used + s.n > {LIMIT} THEN w.part + 1 ELSE w.part END, CASE WHEN w.used + s.n > {LIMIT} THEN s.n ELSE w.used + s.n END
      FROM walk w JOIN sized s ON s.doc_id = w.doc_id AND s.i = w.i + 1)"""


def _packed(spark, sf_dir):
    sized = lines(table(spark, sf_dir, "documents")).select("doc_id", "line_no", F.length("line").alias("n"))
    return S.pack(sized, "doc_id", ["line_no"], "n", LIMIT)


@query("pack_parts", f"WITH {PACKED} SELECT doc_id, line_no, part FROM walk")
def pack_parts(spark, sf_dir):
    return _packed(spark, sf_dir).select("doc_id", "line_no", "part")


@query("part_titles", f"""
    WITH {PACKED}, p AS (SELECT DISTINCT doc_id, part FROM walk)
    SELECT doc_id, part, CASE WHEN part = 0 THEN concat('Document ', doc_id) ELSE concat('Document ', doc_id, ' (', part + 1, ')') END AS title, count(*) OVER (PARTITION BY doc_id) AS total FROM p""")  # fmt: skip
def part_titles(spark, sf_dir):
    from pyspark.sql import Window

    parts = _packed(spark, sf_dir).select("doc_id", "part").distinct()
    title = F.concat(F.lit("Document "), F.col("doc_id").cast("string"), F.when(F.col("part") == 0, "").otherwise(F.concat(F.lit(" ("), (F.col("part") + 1).cast("string"), F.lit(")"))))
    return parts.select("doc_id", "part", title.alias("title"), F.count(F.lit(1)).over(Window.partitionBy("doc_id")).alias("total"))


@query("index_note", f"""
    WITH {PACKED}, p AS (SELECT DISTINCT doc_id, part FROM walk) SELECT doc_id, count(*) AS parts, string_agg(concat('part-', doc_id, '-', part), ',' ORDER BY part) AS part_ids FROM p GROUP BY doc_id HAVING count(*) > 1""")  # fmt: skip
def index_note(spark, sf_dir):
    parts = _packed(spark, sf_dir).select("doc_id", "part").distinct()
    ids = F.transform(F.array_sort(F.collect_list(F.struct("part", F.concat_ws("-", F.lit("part"), "doc_id", "part").alias("id")))), lambda x: x["id"])
    return parts.groupBy("doc_id").agg(F.count(F.lit(1)).alias("parts"), F.array_join(ids, ",").alias("part_ids")).where("parts > 1")




def _events(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    return events.withColumn("ms", F.unix_millis(F.col("ts").cast("timestamp")))


SLOT = 25_000


@query("min_interval_slots", f"""
    WITH e AS (SELECT event_id, (epoch_us(ts) // 1000) AS ms FROM events), i AS (SELECT *, row_number() OVER (ORDER BY ms, event_id) AS i FROM e)
    SELECT event_id, max(ms - i * {SLOT}) OVER (ORDER BY ms, event_id ROWS UNBOUNDED PRECEDING) + i * {SLOT} AS start FROM i""")  # fmt: skip
def min_interval_slots(spark, sf_dir):
    rows = _events(spark, sf_dir).select("event_id", "ms")
    return S.slots(rows, ["ms", "event_id"], "ms", SLOT, block=3_600_000).select("event_id", "start")


ATTEMPTS = """
SELECT o_custkey, o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN 'SUCCESS' WHEN 1 THEN 'PERMISSION_DENIED' WHEN 2 THEN 'CANCELLED' ELSE 'NETWORK' END AS outcome FROM {orders}"""


@query("retry_outcome", f"""
    WITH n AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n, outcome IN ('SUCCESS', 'PERMISSION_DENIED', 'AMBIGUOUS_CREATE', 'CANCELLED') AS stop FROM ({same(ATTEMPTS)})),
    s AS (SELECT *, coalesce(bool_or(stop) OVER (PARTITION BY o_custkey ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS stopped FROM n)
    SELECT o_custkey, count(*) AS attempts, CAST(sum(CASE WHEN NOT stop AND n < 3 THEN n * 1000 ELSE 0 END) AS BIGINT) AS waited, max_by(outcome, n) AS outcome FROM s WHERE n <= 3 AND NOT stopped GROUP BY o_custkey""")  # fmt: skip
def retry_outcome(spark, sf_dir):
    return S.retries(derived(spark, sf_dir, ATTEMPTS), ["o_custkey"], ["o_orderkey"], "outcome", 3, ["PERMISSION_DENIED", "AMBIGUOUS_CREATE", "CANCELLED"], 1000)


@query("leading_throttle", """
    WITH RECURSIVE e AS (SELECT user_id, (epoch_us(ts) // 1000) AS ms, event_id, row_number() OVER (PARTITION BY user_id ORDER BY (epoch_us(ts) // 1000), event_id) AS i FROM events),
    w AS (SELECT user_id, i, ms AS opened, true AS new FROM e WHERE i = 1 UNION ALL
      SELECT e.user_id, e.i, CASE WHEN e.ms > w.opened + 36000000 THEN e.ms ELSE w.opened END, e.ms > w.opened + 36000000 FROM w JOIN e ON e.user_id = w.user_id AND e.i = w.i + 1)
    SELECT user_id, opened, opened + 36000000 AS fires, count_if(NOT new) AS absorbed FROM w GROUP BY user_id, opened""")  # fmt: skip
def leading_throttle(spark, sf_dir):
    return S.throttle(_events(spark, sf_dir).select("user_id", "ms", "event_id"), "user_id", "ms", "event_id", 36_000_000)


DAY = 24 * 3600 * 1000
SESSIONS = f"""
    WITH e AS (SELECT event_id, user_id, (epoch_us(ts) // 1000) AS ms FROM events WHERE event_type = 'click'),
    l AS (SELECT *, lag(ms) OVER (PARTITION BY user_id ORDER BY ms, event_id) AS b FROM e),
    s AS (SELECT *, CAST(sum(CASE WHEN b IS NULL OR ms - b > {DAY} THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ms, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session FROM l)"""


def _highlights(spark, sf_dir):
    rows = _events(spark, sf_dir).where("event_type = 'click'").select("event_id", "user_id", "ms")
    return S.sessions(rows, "user_id", "ms", ["event_id"], DAY)


@query("highlight_asof", f"{SESSIONS} SELECT event_id, user_id, session FROM s")
def highlight_asof(spark, sf_dir):
    return _highlights(spark, sf_dir).select("event_id", "user_id", "session")


@query("highlight_count", f"{SESSIONS} SELECT user_id, session, count(*) AS highlights, max(ms) AS last_at FROM s GROUP BY user_id, session")
def highlight_count(spark, sf_dir):
    return _highlights(spark, sf_dir).groupBy("user_id", "session").agg(F.count(F.lit(1)).alias("highlights"), F.max("ms").alias("last_at"))


@query("task_guard_join", """
    WITH e AS (SELECT event_id, user_id % 50 AS tab, CAST(floor((epoch_us(ts) // 1000) / 3600000) AS BIGINT) AS task FROM events), m AS (SELECT tab, max(task) AS task FROM e GROUP BY tab)
    SELECT event_id, tab, task FROM e JOIN m USING (tab, task)""")  # fmt: skip
def task_guard_join(spark, sf_dir):
    rows = _events(spark, sf_dir).select("event_id", (F.col("user_id") % 50).alias("tab"), F.floor(F.col("ms") / 3_600_000).alias("task"))
    latest = rows.groupBy("tab").agg(F.max("task").alias("task"))
    return rows.join(latest, ["tab", "task"]).select("event_id", "tab", "task")


@query("image_outcome", """
    WITH e AS (SELECT user_id, CASE event_type WHEN 'error' THEN 'TIMEOUT_OR_NET' WHEN 'click' THEN 'CORS_OR_BLOCKED' WHEN 'purchase' THEN 'UNKNOWN' ELSE 'OK' END AS r FROM events)
    SELECT user_id, count_if(r = 'OK') AS ok, count_if(r = 'TIMEOUT_OR_NET') AS timeout_or_net, count_if(r = 'CORS_OR_BLOCKED') AS cors_or_blocked, count_if(r = 'UNKNOWN') AS unknown FROM e GROUP BY user_id""")  # fmt: skip
def image_outcome(spark, sf_dir):
    reason = F.when(F.col("event_type") == "error", "timeout_or_net").when(F.col("event_type") == "click", "cors_or_blocked").when(F.col("event_type") == "purchase", "unknown").otherwise("ok")
    names = ["ok", "timeout_or_net", "cors_or_blocked", "unknown"]
    wide = table(spark, sf_dir, "events").select("user_id", reason.alias("r")).groupBy("user_id").pivot("r", names).count()
    return wide.select("user_id", *[F.coalesce(n, F.lit(0)).alias(n) for n in names])


@query("save_outcome", """
    WITH e AS (SELECT user_id % 50 AS tab, CAST(floor((epoch_us(ts) // 1000) / 86400000) AS BIGINT) AS task, event_type FROM events)
    SELECT tab, task, count_if(event_type = 'purchase') AS created, CASE WHEN count_if(event_type = 'error') > 3 THEN 'cancelled' WHEN count_if(event_type = 'purchase') = 0 THEN 'failed' ELSE 'success' END AS status
    FROM e GROUP BY tab, task""")  # fmt: skip
def save_outcome(spark, sf_dir):
    rows = _events(spark, sf_dir).select((F.col("user_id") % 50).alias("tab"), F.floor(F.col("ms") / 86_400_000).alias("task"), "event_type")
    created, errors = F.count_if(F.col("event_type") == "purchase"), F.count_if(F.col("event_type") == "error")
    return rows.groupBy("tab", "task").agg(created.alias("created"), F.when(errors > 3, "cancelled").when(created == 0, "failed").otherwise("success").alias("status"))


@query("export_summary", """
    SELECT user_id AS batch, count_if(event_type <> 'error') AS exported, count_if(event_type = 'error') AS failed,
      coalesce(string_agg(CASE WHEN event_type = 'error' THEN CAST(event_id AS VARCHAR) END, ',' ORDER BY event_id), '') AS failed_titles FROM events GROUP BY user_id""")  # fmt: skip
def export_summary(spark, sf_dir):
    bad = F.col("event_type") == "error"
    titles = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(bad, F.col("event_id")))), lambda x: x.cast("string")), ",")
    return table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("batch")).agg(F.count_if(~bad).alias("exported"), F.count_if(bad).alias("failed"), titles.alias("failed_titles"))


@query("change_significant", """
    SELECT event_id FROM (SELECT event_id, repeat(event_type, CAST(event_id % 20 AS INT)) AS body, event_id % 7 AS children, CASE event_id % 5 WHEN 0 THEN 'script' ELSE 'div' END AS tag FROM events)
    WHERE (length(body) > 50 OR children > 0) AND tag NOT IN ('script', 'style', 'iframe')""")  # fmt: skip
def change_significant(spark, sf_dir):
    rows = table(spark, sf_dir, "events").selectExpr("event_id", "repeat(event_type, cast(event_id % 20 as int)) AS body", "event_id % 7 AS children", "CASE event_id % 5 WHEN 0 THEN 'script' ELSE 'div' END AS tag")
    return rows.where("(length(body) > 50 OR children > 0) AND tag NOT IN ('script', 'style', 'iframe')").select("event_id")


@query("image_cap", f"""SELECT l_orderkey, l_linenumber, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY {ITEM_ORDER})
      <= CASE l_orderkey % 5 WHEN 0 THEN 3 WHEN 1 THEN 0 WHEN 2 THEN 0 WHEN 3 THEN 200 ELSE 2 END AS kept FROM lineitem""")
def image_cap(spark, sf_dir):
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*ITEM_ORDER.split(", ")))
    asked = F.expr("CASE l_orderkey % 5 WHEN 0 THEN 3.7D WHEN 1 THEN -2D WHEN 2 THEN double('NaN') WHEN 3 THEN 500D ELSE 2D END")
    return _items(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_partkey", (n <= S.image_limit(asked)).alias("kept"))


@query("select_top_n", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderpriority LIKE '1%' ORDER BY o_orderkey LIMIT 10")
def select_top_n(spark, sf_dir):
    return table(spark, sf_dir, "orders").where("o_orderpriority LIKE '1%'").orderBy("o_orderkey").limit(10).select("o_orderkey", "o_totalprice")


@query("keyset_page", """
    WITH f AS (SELECT doc_id, lang FROM documents WHERE doc_id > 100 ORDER BY doc_id LIMIT 21), t AS (SELECT count(*) AS total FROM documents)
    SELECT doc_id, lang, (SELECT max(doc_id) FROM (SELECT doc_id FROM f ORDER BY doc_id LIMIT 20)) AS next_cursor, total FROM (SELECT * FROM f ORDER BY doc_id LIMIT 20), t""")  # fmt: skip
def keyset_page(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    page = docs.where("doc_id > 100").select("doc_id", "lang").orderBy("doc_id").limit(20)
    cursor = page.agg(F.max("doc_id").alias("next_cursor"))
    total = docs.agg(F.count(F.lit(1)).alias("total"))
    return page.join(F.broadcast(cursor), F.lit(True)).join(F.broadcast(total), F.lit(True))


@query("part_order", f"""
    WITH {PACKED}, p AS (SELECT DISTINCT doc_id, part FROM walk), a AS (SELECT doc_id, part FROM p UNION ALL SELECT doc_id, -1 FROM p GROUP BY doc_id HAVING count(*) > 1)
    SELECT doc_id, string_agg(CAST(part AS VARCHAR), ',' ORDER BY part) AS in_order FROM a GROUP BY doc_id""")  # fmt: skip
def part_order(spark, sf_dir):
    parts = _packed(spark, sf_dir).select("doc_id", "part").distinct()
    index = parts.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id", F.lit(-1).alias("part"))
    return parts.union(index).groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("part")), lambda x: x.cast("string")), ",").alias("in_order"))
