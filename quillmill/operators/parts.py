"""Splitting of oversize blocks, merging of continued ones, and rewriting of images and markup."""

from __future__ import annotations

import re
from bisect import bisect_right

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmill.functions.text import hard_end, heading_like, language, trimmed
from quillmill.functions.urls import match_keys
from quillmill.operators.sequences import first_of_each

#: Attributes that markup keeps, and those that code keeps besides. Fixed values.
KEPT_ATTRIBUTES = ["href", "src", "alt", "width", "height", "target", "rel", "srcset", "data-src", "data-original", "style"]
CODE_ATTRIBUTES = ["class", "data-language", "data-lang", "translate"]
#: What an application names its own attributes with: data-own-uid, data-own-caption and data-own-id are kept with this one.
OWN = "data-own"
#: Class names of adverts, comments, sharing, players and page tools. Fixed values.
JUNK_CLASSES = (
    "advertisement ads social-share comments related-posts post-ufi like-button-container share-dialog subscription-widget-wrap post-header banner post-footer comment-section"
    " page-edit page-nav page-meta last-updated pagination header-anchor video-player video-container gitalk giscus utterances vssue"
).split()
#: Parts of class names of the same. Fixed values.
JUNK_PARTS = ["comment", "engagement-bar", "reactions-bar", "like-count", "share-count", "view-count", "subscribe", "follow", "video-controls"]


#: Characters that end a sentence if white space or the end of what fits follows. Fixed value.
STOPS = "。！？!?；;."


def cut_places(text: str, limit: int) -> list[int]:
    """Ends of the parts of a text: after the last line end that fits, else a sentence end, else white space, else the limit.

    The places of each class are listed once, in one pass each; a part then takes the last one that fits by bisection. A part
    is never only the white space that it starts with.
    """
    classes = [
        [m.end() for m in re.finditer("\n", text)],
        [m.end() for m in re.finditer(rf"[{STOPS}]\s", text)],
        [m.start() + 1 for m in re.finditer(r"\s+", text)],
    ]
    ends, start = [], 0
    while len(text) - start > limit:
        full = start + limit
        last = [places[at - 1] if (at := bisect_right(places, full)) else 0 for places in classes]
        if text[full - 1] in STOPS:
            last[1] = full
        start = next((place for place in last if place > start + 1), full)
        ends.append(start)
    return [*ends, len(text)] if start < len(text) else ends


def split_text(rows: DataFrame, key: str, text: str, limit: int) -> DataFrame:
    """(key, part, text): texts longer than ``limit`` in parts that joined again give the text; only those go through Python."""

    @F.pandas_udf("array<int>")
    def places(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: cut_places(t, limit))

    short = rows.where(F.length(text) <= limit).select(key, F.lit(0).alias("part"), F.col(text).alias("text"))
    long = rows.where(F.length(text) > limit).select(key, text, places(F.col(text)).alias("ends"))
    spans = F.transform(F.col("ends"), lambda e, i: F.struct(F.when(i == 0, 0).otherwise(F.get("ends", i - 1)).alias("a"), e.alias("b")))
    cut = long.select(key, text, F.posexplode(spans).alias("part", "s"))
    return short.unionByName(cut.select(key, "part", F.substring(F.col(text), F.col("s.a") + 1, F.col("s.b") - F.col("s.a")).alias("text")))


def split_code(rows: DataFrame, key: str, text: str, limit: int) -> DataFrame:
    """(key, chunk, text): whole lines packed up to ``limit``; a longer line is sliced, and each slice is a chunk of its own."""
    lines = rows.select(key, F.posexplode(F.filter(F.regexp_extract_all(F.col(text), F.lit(r"([^\n]*\n?)"), F.lit(1)), lambda x: x != "")).alias("pos", "line"))
    at = F.sequence(F.lit(1), F.length("line"), F.lit(limit))
    slices = lines.select(key, "pos", "line", (F.length("line") > limit).alias("big"), F.posexplode(at).alias("sub", "at"))
    slices = slices.select(key, "pos", "sub", "big", F.substring(F.col("line"), F.col("at"), F.lit(limit)).alias("piece"))
    items = F.array_sort(F.collect_list(F.struct("pos", "sub", "big", "piece")))
    fold = F.expr(
        f"""aggregate(items, named_struct('chunk', 0, 'used', 0, 'closed', false, 'chunks', cast(array() as array<int>)), (a, x) -> transform(
              array(a.used > 0 and (x.big or a.closed or a.used + length(x.piece) > {limit})),
              new -> named_struct('chunk', a.chunk + cast(new as int), 'used', if(new, length(x.piece), a.used + length(x.piece)), 'closed', x.big, 'chunks', concat(a.chunks, array(a.chunk + cast(new as int)))))[0], a -> a.chunks)"""
    )
    placed = slices.groupBy(key).agg(items.alias("items")).withColumn("chunks", fold).select(key, F.explode(F.arrays_zip("items", "chunks")).alias("x"))
    texts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x.items.pos", "x.items.sub", "x.items.piece"))), lambda s: s["piece"]), "")
    return placed.groupBy(key, F.col("x.chunks").alias("chunk")).agg(texts.alias("text"))


def merge_continued(segments: DataFrame) -> DataFrame:
    """(doc, part, text) of segments (doc, pos, text): a segment goes on from the merged one before it if the language is
    the same, that one has no hard end and is no heading, and this one doesn't begin with a list mark."""
    marker = r"^([→➜•\-–—*]|\d+\s*[-.:：)]|[A-Za-z]\)|[A-Za-z]\.)\s*"

    def step(done: Column, text: Column) -> Column:
        before = F.try_element_at(done, F.lit(-1))
        kind = language(before)
        goes_on = before.isNotNull() & (kind != "other") & (kind == language(text)) & ~hard_end(before) & ~text.rlike(marker) & ~heading_like(before, kind)
        joiner = F.when(before.rlike(r"[A-Za-z0-9]$") & text.rlike(r"^[A-Za-z0-9]") | (kind == "english"), " ").otherwise("")
        return F.when(F.coalesce(goes_on, F.lit(False)), F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(F.concat(before, joiner, text)))).otherwise(F.concat(done, F.array(text)))

    rows = segments.withColumn("text", trimmed(F.col("text"))).where("text <> ''")
    texts = F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"])
    merged = F.aggregate("texts", F.array().cast("array<string>"), step)
    return rows.groupBy("doc").agg(texts.alias("texts")).select("doc", F.posexplode(merged).alias("part", "text"))


def image_actions(tags: DataFrame, results: DataFrame) -> DataFrame:
    """(page_id, ord, action, target) for tags (page_id, ord, image_id, url) and results (rank, image_id, url, uid).

    A tag with an id takes the result of that id; another takes the first result that matches its address in any way of
    ``match_keys``. Successes (rank 0) come before failures (1) and extras (2), then smaller ids. A tag without a match stays.
    Of the results of one key only the first can be taken, so each key keeps one before the join: a file name that many
    images share makes no more rows than there are tags.
    """
    r = results.select("rank", F.col("image_id").alias("r_id"), F.col("url").alias("r_url"), "uid")
    by_id = r.select(F.lit(-1).alias("r_tier"), F.col("r_id").alias("r_key"), "rank", "r_id", "r_url", "uid")
    by_url = r.select(F.inline(match_keys(F.col("r_url"))).alias("r_tier", "r_key"), "rank", "r_id", "r_url", "uid")
    firsts = first_of_each(by_id.unionByName(by_url), ["r_tier", "r_key"], ["rank", "r_id"])
    own = F.array(F.struct(F.lit(-1).alias("tier"), F.col("image_id").alias("key")))
    asked = tags.select("page_id", "ord", F.inline(F.when(F.col("image_id").isNotNull(), own).otherwise(match_keys(F.col("url")))))
    found = asked.join(firsts, (F.col("tier") == F.col("r_tier")) & (F.col("key") == F.col("r_key")))
    best = found.groupBy(F.col("page_id").alias("_p"), F.col("ord").alias("_o")).agg(F.min(F.struct("rank", "r_id", "r_url", "uid")).alias("b"))
    out = tags.join(best, (F.col("page_id") == F.col("_p")) & (F.col("ord") == F.col("_o")), "left")
    action = F.when(F.col("b").isNull(), "keep").when(F.col("b.rank") == 0, "inject").otherwise("link")
    return out.select("page_id", "ord", action.alias("action"), F.coalesce(F.when(F.col("b.rank") == 0, F.col("b.uid")), "b.r_url", F.col("url")).alias("target"))


def safe_html(c: Column) -> Column:
    c = F.regexp_replace(c, r"(?is)<script\b[^>]*>.*?</script>", "")
    return F.regexp_replace(F.regexp_replace(c, r"(?i)javascript:", ""), r"(?i)\s+on\w+\s*=", " data-removed=")


#: Tags and attributes that imported html may have. Fixed values.
SAFE_TAGS = (
    "a blockquote br code del div em figcaption figure h1 h2 h3 h4 h5 h6 hr img li ol p pre mark span strong sub sup ul"
).split()
SAFE_ATTRIBUTES = ["alt", "class", "href", "rel", "src", "target", "title"]
#: What goes with all that is in it or to it, and how an attribute looks. Fixed values.
UNSAFE = [r"(?is)<script\b.*?</script>|<style\b.*?</style>", r"(?i)\son[a-z]+\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s>]+)", r"(?i)\s(?:href|src)\s*=\s*(?:\"\s*javascript:[^\"]*\"|'\s*javascript:[^']*')"]
ATTRIBUTE = r"\s([A-Za-z:-]+)\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s>]+)"


def allowed_html(c: Column, own: str = OWN) -> Column:
    """Html with the tags and attributes of an import alone: scripts and styles go whole, other tags leave their content.

    ``own`` caption and id are allowed besides.
    """
    for pattern in UNSAFE:
        c = F.regexp_replace(c, pattern, "")
    others = rf"(?i)(?!\s(?:{'|'.join([*SAFE_ATTRIBUTES, f'{own}-caption', f'{own}-id'])})\s*=){ATTRIBUTE}"

    def kept(token: Column) -> Column:
        name = F.lower(F.regexp_extract(token, r"^</?([A-Za-z0-9-]+)", 1))
        closing = F.concat(F.lit("</"), name, F.lit(">"))
        return F.when(name == "", token).when(~name.isin(SAFE_TAGS), "").when(token.startswith("</"), closing).otherwise(F.regexp_replace(token, others, ""))

    return F.array_join(F.transform(F.regexp_extract_all(c, F.lit(r"(</?[A-Za-z0-9-]+(?:\s[^>]*)?>|<|[^<]+)"), F.lit(1)), lambda t: F.when(t.startswith("<"), kept(t)).otherwise(t)), "")


def prune_attributes(c: Column, own: str = OWN) -> Column:
    """Markup without attributes but those that are kept, more of them on pre and code, and ``own`` uid and caption; what counts is name=\"value\" inside tags."""
    tags = F.regexp_extract_all(c, F.lit(r"(<[^>]+>|[^<]+)"), F.lit(1))
    kept = [*KEPT_ATTRIBUTES, f"{own}-uid", f"{own}-caption"]
    keep, on_code = rf"^({'|'.join(kept)})=", rf"^({'|'.join([*kept, *CODE_ATTRIBUTES])})="
    pruned = F.transform(
        tags,
        lambda t: F.when(
            t.rlike(r"^<[a-zA-Z]"),
            F.concat(
                F.regexp_extract(t, r"^(<[a-zA-Z][a-zA-Z0-9]*)", 1),
                F.array_join(F.transform(F.filter(F.regexp_extract_all(t, F.lit(r"([a-zA-Z][a-zA-Z0-9-]*=\"[^\"]*\")"), F.lit(1)), lambda a: F.when(t.rlike(r"(?i)^<(pre|code)\b"), a.rlike(on_code)).otherwise(a.rlike(keep))), lambda a: F.concat(F.lit(" "), a)), ""),
                F.when(t.endswith("/>"), "/>").otherwise(">"),
            ),
        ).otherwise(t),
    )
    return F.array_join(pruned, "")


def junk_class(classes: Column) -> Column:
    """Whether one of a block's classes is on the list, or has a part that is."""
    names = F.split(F.lower(classes), r"\s+")
    return F.arrays_overlap(names, F.array(*map(F.lit, JUNK_CLASSES))) | F.lower(classes).rlike("|".join(JUNK_PARTS))


def picture_list(rows: DataFrame, key: str, script: str) -> DataFrame:
    """(key, ord, width, height, url): pictures listed in a page's script."""
    items = F.regexp_extract_all(F.col(script), F.lit(r"(\{\s*width:\s*'\d+'\s*\*\s*1,\s*height:\s*'\d+'\s*\*\s*1,\s*cdn_url:\s*(?:JsDecode\()?['\"][^'\"]+['\"])"), F.lit(1))
    item = rows.select(key, F.posexplode(items).alias("ord", "x"))
    number = lambda name: F.regexp_extract("x", rf"{name}:\s*'(\d+)'", 1).cast("int")
    return item.select(key, "ord", number("width").alias("width"), number("height").alias("height"), F.regexp_extract("x", r"cdn_url:\s*(?:JsDecode\()?['\"]([^'\"]+)", 1).alias("url"))
