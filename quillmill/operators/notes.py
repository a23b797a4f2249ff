"""Note catalogs: ingest, merges, look-ups with fallbacks, and ordered unions of ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmill.functions.text import trimmed
from quillmill.operators.sequences import first_of_each

#: The title of a note that has none.
NO_TITLE = "无标题"

CATALOG = T.StructType(
    [
        T.StructField("noteIds", T.ArrayType(T.StringType())),
        T.StructField("topNoteIds", T.ArrayType(T.StringType())),
        T.StructField("notes", T.MapType(T.StringType(), T.StructType([T.StructField("title", T.StringType()), T.StructField("digest", T.StringType()), T.StructField("tags", T.ArrayType(T.StringType()))]))),
    ]
)


def catalog(rows: DataFrame, key: str, json: str) -> DataFrame:
    """(key, uuid, title, digest, tags, is_top): one row for each note of a catalog response, empty titles and tags replaced."""
    read = rows.select(key, F.from_json(json, CATALOG).alias("c"))
    notes = read.select(key, F.col("c.topNoteIds").alias("top"), F.explode(F.map_entries("c.notes")).alias("n"))
    title = F.when(F.coalesce(F.col("n.value.title"), F.lit("")) == "", NO_TITLE).otherwise(F.col("n.value.title"))
    tags = F.filter(F.coalesce(F.col("n.value.tags"), F.array().cast("array<string>")), lambda t: t != "")
    return notes.select(key, F.col("n.key").alias("uuid"), title.alias("title"), F.coalesce("n.value.digest", F.lit("")).alias("digest"), F.array_join(tags, ",").alias("tags"), F.coalesce(F.array_contains("top", F.col("n.key")), F.lit(False)).alias("is_top"))


def children(edges: DataFrame, bulk: DataFrame, detail: DataFrame) -> DataFrame:
    """(parent, child, ord, title): children in order with the title of the bulk table, else of the detail table; others go.

    bulk and detail: (id, title). Both are joined at once; what is missing from the first is not looked up by row.
    """
    b = bulk.select(F.col("id").alias("_b"), F.col("title").alias("_bt"))
    d = detail.select(F.col("id").alias("_d"), F.col("title").alias("_dt"))
    out = edges.join(b, F.col("child") == F.col("_b"), "left").join(d, F.col("child") == F.col("_d"), "left")
    return out.withColumn("title", F.coalesce("_bt", "_dt")).where("title is not null").select("parent", "child", "ord", "title")


def union_ids(lists: list[DataFrame]) -> DataFrame:
    """(rank, ord, id): ids of several lists (ord, id) in order of the lists, each once, trimmed and not empty."""
    out = None
    for i, ids in enumerate(lists):
        part = ids.select(F.lit(i).alias("rank"), "ord", trimmed(F.col("id")).alias("id"))
        out = part if out is None else out.unionByName(part)
    return first_of_each(out.where("id <> ''"), ["id"], ["rank", "ord"])


def merge_maps(first: DataFrame, second: DataFrame) -> DataFrame:
    """(key, value) of both; the second wins."""
    both = first.select("key", "value", F.lit(1).alias("rank")).unionByName(second.select("key", "value", F.lit(0).alias("rank")))
    return first_of_each(both, ["key"], ["rank"]).drop("rank")


def merge_fields(notes: DataFrame) -> DataFrame:
    """One row for each uuid of (uuid, ord, title, digest, is_top, is_collection), field by field in order of arrival.

    The latest title that says something, the latest digest that isn't empty, flags by or, place by first arrival.
    """
    latest = lambda c, good: F.max_by(F.when(good, F.col(c)), F.when(good, F.col("ord")))
    title = F.coalesce(latest("title", ~F.col("title").isin("", NO_TITLE)), F.lit(NO_TITLE))
    return notes.groupBy("uuid").agg(
        title.alias("title"), F.coalesce(latest("digest", F.col("digest") != ""), F.lit("")).alias("digest"), F.bool_or("is_top").alias("is_top"), F.bool_or("is_collection").alias("is_collection"), F.min("ord").alias("first_ord")
    )


def digest_trimmed(title: Column, digest: Column) -> Column:
    """A digest without a leading copy of the title, bare or quoted, and the separators after it."""
    t, d = trimmed(title), trimmed(digest)
    forms = [t, F.concat(F.lit("「"), t, F.lit("」")), F.concat(F.lit("『"), t, F.lit("』")), F.concat(F.lit("“"), t, F.lit("”")), F.concat(F.lit('"'), t, F.lit('"')), F.concat(F.lit("【"), t, F.lit("】"))]
    out = d
    for form in reversed(forms):
        rest = F.regexp_replace(F.substring(d, F.length(form) + 1, F.length(d)), r"^[\s\u00a0\u200b\-—–:：|｜·•,.，。!！?？、]+", "")
        out = F.when(F.startswith(d, form), trimmed(rest)).otherwise(out)
    return F.when((t == "") | (d == ""), d).when(d == t, "").otherwise(out)


def created_at(value: Column) -> Column:
    """Epoch seconds (10 digits), milliseconds (13 digits) or ISO text as a timestamp; null if it is none of them."""
    v = trimmed(value)
    return F.when(v.rlike(r"^\d{10}$"), F.timestamp_seconds(v.try_cast("long"))).when(v.rlike(r"^\d{13}$"), F.timestamp_millis(v.try_cast("long"))).otherwise(F.try_to_timestamp(v))


def zip_languages(left: DataFrame, right: DataFrame) -> DataFrame:
    """(doc, pos, role, text): two lists (doc, pos, text) side by side, original before translation, a spacer between pairs."""
    a = left.select("doc", "pos", F.col("text").alias("_l"))
    b = right.select("doc", "pos", F.col("text").alias("_r"))
    pairs = a.join(b, ["doc", "pos"], "full_outer")
    pairs = pairs.withColumn("_more", F.lead("pos").over(Window.partitionBy("doc").orderBy("pos")).isNotNull())
    row = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("text"))
    rows = F.array(F.when(F.col("_l").isNotNull(), row("original", F.col("_l"))), F.when(F.col("_r").isNotNull(), row("translation", F.col("_r"))), F.when(F.col("_more"), row("spacer", F.lit(""))))
    return pairs.select("doc", "pos", F.explode(F.filter(rows, lambda x: x.isNotNull())).alias("x")).select("doc", "pos", "x.role", "x.text")


#: Where a note's html names other notes, in this order. Fixed values.
NOTE_REFERENCES = [r'<note\b[^>]*uuid="([^"]+)"', r'data-note-uuid="([^"]+)"', r'data-[a-z]+-note-uuid="([^"]+)"', r'<q\b[^>]*uuid="([^"]+)"', r'\bcite="(?:https?://[^/"?#]+)?/detail/([^"?#/]+)"']
#: Note nodes in a note's tree as JSON: an object that has the type and, right after or before it, its attributes.
NOTE_NODES = r'"type"\s*:\s*"note"\s*,\s*"attrs"\s*:\s*\{[^{}]*"uuid"\s*:\s*"([^"]*)"|"attrs"\s*:\s*\{[^{}]*"uuid"\s*:\s*"([^"]*)"[^{}]*\}\s*,\s*"type"\s*:\s*"note"'


def child_ids(html: Column, tree: Column) -> Column:
    """array<string>: the notes that a note refers to, each once, in order: its tree's note nodes, then its html by form.

    An id has six letters, digits, _ or - at least. Null html or tree names none.
    """
    found = [F.regexp_extract_all(tree, F.lit(NOTE_NODES), F.lit(i)) for i in (1, 2)]
    nodes = F.zip_with(*found, lambda a, b: F.concat(a, b))
    every = F.concat(*[F.coalesce(c, F.array().cast("array<string>")) for c in (nodes, *[F.regexp_extract_all(html, F.lit(p), F.lit(1)) for p in NOTE_REFERENCES])])
    return F.array_distinct(F.filter(F.transform(every, lambda i: F.trim(i)), lambda i: i.rlike(r"^[A-Za-z0-9_-]{6,}$")))


def best_candidates(blocks: DataFrame) -> DataFrame:
    """(doc, candidate, score): of each document's candidates for a quoted article the one of highest score, the earliest on a tie.

    ``blocks``: doc, candidate (their order), priority, kind, role, text. A candidate counts 10000 if a block other than an image
    has text, 5000 more if several have, 2000 if any block is an original or a translation, 1000 if any is a spacer, 50 for each
    block with text, 10 for each visible character, and its priority. Null text is ''.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    said = F.count_if((F.col("kind") != "image") & (trimmed(text) != ""))
    role = lambda *names: F.coalesce(F.max(F.col("role").isin(*names)), F.lit(False))
    worth = lambda c, n: F.when(c, n).otherwise(0)
    chars = F.sum(F.length(F.regexp_replace(text, r"\s+", "")))
    score = worth(said > 0, 10_000) + worth(said > 1, 5_000) + worth(role("original", "translation"), 2_000) + worth(role("spacer"), 1_000) + said * 50 + chars * 10 + F.max("priority")
    scored = blocks.groupBy("doc", "candidate").agg(score.alias("score"))
    best = F.max_by(F.struct("candidate", "score"), F.struct("score", -F.col("candidate"))).alias("b")
    return scored.groupBy("doc").agg(best).select("doc", "b.candidate", F.col("b.score").cast("long").alias("score"))


def resolve_assets(wanted: DataFrame, assets: DataFrame, base: str) -> DataFrame:
    """The rows of ``wanted`` (ref, ...) whose ref is an asset's, with asset and url instead of ref.

    ``assets``: asset, map_key, file_uuid, uuid, url, wide. A ref is looked up as a map key, else a file's, else an asset's own
    id, smaller assets first. The wide form's address is taken if it is one of the web, else the plain one's, else ``base`` and
    the asset. Of the assets of one key only the first is joined, so a key that many share makes no more rows.
    """
    keys = assets.select("asset", "url", "wide", F.posexplode(F.array("map_key", "file_uuid", "uuid")).alias("rank", "key")).where("key is not null")
    keys = first_of_each(keys, ["key"], ["rank", "asset"])
    web = lambda c: F.when(F.col(c).rlike("^https?://"), F.col(c))
    found = wanted.join(keys, F.col("ref") == F.col("key"))
    return found.select(*[c for c in wanted.columns if c != "ref"], "asset", F.coalesce(web("wide"), web("url"), F.concat(F.lit(base), F.col("asset").cast("string"))).alias("url"))
