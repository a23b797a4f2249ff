"""Rules over neighbouring blocks of a document: blanks, bullets, captions, code languages, lists and long posts.

Blocks are rows (doc, pos, kind, text, ...). Every rule partitions by doc.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from quillmill.functions.text import title_candidate, title_key, trimmed, visible

#: Kinds of blocks that stand apart by themselves. Fixed values.
SELF_SPACED = ["quote", "code", "image", "note", "file"]
#: First words of commands. Fixed values.
COMMANDS = (
    "npm pnpm yarn bun npx pnpx git docker kubectl helm curl wget chmod mkdir rm cp mv ls cd cat grep sed awk node python python3 pip pip3 pytest go java javac mvn gradle uv cargo rustc make cmake".split()
)


def by_doc() -> WindowSpec:
    return Window.partitionBy("doc").orderBy("pos")


def list_like(text: Column) -> Column:
    return trimmed(visible(text)).rlike(r"^(?:[•·▪◦●○]\s+|\d+[.)、]\s*)")


def metadata_like(text: Column) -> Column:
    """A short line of a label, a colon and a value."""
    t = trimmed(visible(text))
    return ~list_like(text) & F.length(t).between(1, 60) & t.rlike(r"^[A-Za-z0-9一-鿿_()\[\]【】《》<>·•、/+\-.]{1,18}[：:]\s*\S+")


def numbered_heading(text: Column) -> Column:
    t = trimmed(text)
    return ~list_like(text) & (t.rlike(r"^(一|二|三|四|五|六|七|八|九|十|\d+)(\.|、|\s)") | ((F.length(t) < 30) & t.rlike(r"^(提示词|适用|核心问题)")))


def without_annotation(text: Column) -> Column:
    """Without a leading [highlight] tag."""
    return trimmed(F.regexp_replace(text, r"(?i)^\s*\[(?:(?:高亮|highlight)(?:[/／][^\]]+)?)\]\s*", ""))


def line_language(text: Column) -> Column:
    """The language of a command, path, configuration or JSON line; null for prose."""
    t = without_annotation(text)
    command = t.rlike(rf"(?i)^(?:[$#]\s*)?(?:{'|'.join(COMMANDS)})\b")
    windows = t.rlike(r"^(?:[A-Za-z]:\\|\\\\)\S+$")
    path = t.rlike(r"^(?:\.{1,2}/|~/|/)\S+$") | t.rlike(r"^(?:[@A-Za-z0-9_.-]+/)+[@A-Za-z0-9_.-]+(?:\.[A-Za-z0-9]+)?$") | t.rlike(r"^[A-Za-z0-9_.-]+\.[A-Za-z0-9]{1,8}$")
    return (
        F.when(t == "", None)
        .when(windows, "powershell")
        .when(command | path, "shellscript")
        .when(t.rlike(r"^[A-Za-z_][\w.-]*\s*[:=]\s*.+$"), "ini")
        .when(t.rlike(r"^(?:\{.*\}|\[.*\]|\".*\"\s*:\s*.+)$"), "json")
    )


def drop_blank_near_structure(blocks: DataFrame) -> DataFrame:
    """Without empty blocks whose nearest block with text before or after stands apart by itself or is a list item."""
    blank = F.col("text") == ""
    apart = F.when(~blank, F.col("kind").isin(SELF_SPACED) | list_like(F.col("text")))
    before = F.last(apart, ignorenulls=True).over(by_doc().rowsBetween(Window.unboundedPreceding, -1))
    after = F.first(apart, ignorenulls=True).over(by_doc().rowsBetween(1, Window.unboundedFollowing))
    return blocks.withColumn("_b", before).withColumn("_a", after).where(~(blank & (F.coalesce("_b", F.lit(False)) | F.coalesce("_a", F.lit(False))))).drop("_b", "_a")


def merge_bullets(blocks: DataFrame) -> DataFrame:
    """A paragraph that is only a bullet goes and stands before the text of the next block."""
    only = lambda c: trimmed(c).rlike(r"^[•·–—-]\s*$")
    rows = blocks.withColumn("_p", F.lag("text").over(by_doc()))
    joined = F.when(only(F.col("_p")) & ~only(F.col("text")), F.concat(trimmed(F.col("_p")), F.lit(" "), F.col("text"))).otherwise(F.col("text"))
    return rows.where(~only(F.col("text"))).withColumn("text", joined).drop("_p")


def drop_repeated_captions(blocks: DataFrame) -> DataFrame:
    """Without the paragraph after an image that says what the image's alt says, or contains it, or is part of it."""
    before = F.lag(F.struct("kind", "alt")).over(by_doc())
    rows = blocks.withColumn("_p", before)
    key, alt = title_key(F.col("text")), title_key(F.col("_p.alt"))
    same = (F.col("_p.kind") == "image") & (F.col("kind") == "paragraph") & (key != "") & (alt != "") & (key.contains(alt) | alt.contains(key))
    return rows.where(~F.coalesce(same, F.lit(False))).drop("_p")


def inherit_code_language(blocks: DataFrame) -> DataFrame:
    """A code block without a language has that of the code block right before it, through any number of them."""
    new = (F.col("kind") != "code") | F.coalesce(F.lag("kind").over(by_doc()) != "code", F.lit(True))
    # the start of a run tells '' at least, so nothing from before it is seen, and one order serves both windows
    rows = blocks.withColumn("_told", F.when(F.col("lang") != "", F.col("lang")).when(new, ""))
    known = F.last("_told", ignorenulls=True).over(by_doc().rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("lang", F.when(F.col("kind") == "code", F.coalesce(known, F.lit(""))).otherwise(F.col("lang"))).drop("_told")


def prune_leading_metadata(blocks: DataFrame, tokens: list[str]) -> DataFrame:
    """Among the first four blocks, without short ones in which nothing is left but known names, labels and punctuation."""
    rest = F.regexp_replace("text", r"[\s ]+", "")
    short = F.length(rest).between(1, 80)
    for token in sorted(tokens, key=len, reverse=True):
        rest = F.replace(rest, F.lit(token), F.lit(""))
    rest = F.regexp_replace(F.regexp_replace(rest, "发布于|发表于|原创|作者|公众号|来自|中国", ""), r"[年月日时分秒:：,，.\-—|·•()（）]", "")
    return blocks.withColumn("_n", F.row_number().over(by_doc())).where(~((F.col("_n") <= 4) & short & (rest == ""))).drop("_n")


def list_votes(items: DataFrame) -> DataFrame:
    """(doc, technical, language) of lists (doc, pos, text): whether all items are technical, and the language they vote for."""
    lines = items.withColumn("lang", line_language(F.col("text")))
    counted = lines.where("lang is not null").groupBy("doc", "lang").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("at"))
    best = counted.groupBy("doc").agg(F.max_by("lang", F.struct(F.col("n"), -F.col("at"))).alias("top"), F.collect_set("lang").alias("langs"))
    language = F.when(F.size("langs") == 1, F.col("top")).when(F.array_contains("langs", "shellscript"), "shellscript").when(F.array_contains("langs", "powershell"), "powershell").otherwise(F.col("top"))
    flags = lines.groupBy("doc").agg(F.bool_and(F.col("lang").isNotNull()).alias("technical"))
    return flags.join(best.select(F.col("doc").alias("_d"), language.alias("language")), F.col("doc") == F.col("_d"), "left").select("doc", "technical", F.coalesce("language", F.lit("text")).alias("language"))


def longform(segments: DataFrame) -> DataFrame:
    """(doc, kind) of posts (doc, pos, role, text, draft): x-article if any row says that it is a draft of one, else
    tweet-longform or tweet by what isn't blank or a spacer. Without a column draft no post is one."""
    draft = F.coalesce(F.max("draft"), F.lit(False)) if "draft" in segments.columns else F.lit(False)
    said = F.coalesce((F.col("role") != "spacer") & (trimmed(F.col("text")) != ""), F.lit(False))
    long = said & (F.length(title_candidate(F.col("text"))) >= 40)
    counted = segments.groupBy("doc").agg(
        F.count_if(said).alias("n"), F.count_if(long).alias("long"), F.sum(F.when(said, F.length("text") + 2)).alias("chars"), F.countDistinct(F.when(said, F.col("role"))).alias("roles"), draft.alias("draft")
    )
    shape = (F.col("n") >= 4) & (F.col("long") >= 4) & ((F.col("roles") >= 2) | (F.col("chars") - 2 >= 500) | (F.col("long") >= 6))
    return counted.select("doc", F.when(F.col("draft"), "x-article").when(shape, "tweet-longform").otherwise("tweet").alias("kind"))


def space_groups(segments: DataFrame) -> DataFrame:
    """(doc, pos, half, role, text) of segments (doc, pos, role, grp, text): old spacers go, and one comes between groups.

    None comes between an original and its translation, which share a group.
    """
    rows = segments.where("role <> 'spacer'")
    after = F.lead("grp").over(by_doc())
    rows = rows.withColumn("_gap", after.isNotNull() & ~after.eqNullSafe(F.col("grp")))
    row = lambda half, role, text: F.struct(F.lit(half).alias("half"), role.alias("role"), text.alias("text"))
    own = row(0, F.col("role"), F.col("text"))
    out = F.when(F.col("_gap"), F.array(own, row(1, F.lit("spacer"), F.lit("")))).otherwise(F.array(own))
    return rows.select("doc", "pos", F.explode(out).alias("x")).select("doc", "pos", "x.half", "x.role", "x.text")


def pad_references(blocks: DataFrame) -> DataFrame:
    """(doc, pos, half, kind, text): exactly one empty block on either side of each reference; empty blocks elsewhere stay.

    Nothing is put before the first block or after the last.
    """
    blank, reference = F.col("text") == "", F.col("kind") == "reference"
    near = lambda c: F.coalesce(c == "reference", F.lit(False))
    rows = blocks.withColumn("_solid", F.when(~blank, F.col("kind")))
    before = F.last("_solid", ignorenulls=True).over(by_doc().rowsBetween(Window.unboundedPreceding, -1))
    after = F.first("_solid", ignorenulls=True).over(by_doc().rowsBetween(1, Window.unboundedFollowing))
    rows = rows.withColumn("_b", before).withColumn("_a", after)
    rows = rows.where(~(blank & (near(F.col("_b")) | near(F.col("_a")))))
    pad = F.col("_b").isNotNull() & (reference | near(F.col("_b"))) & ~blank
    row = lambda half, kind, text: F.struct(F.lit(half).alias("half"), kind.alias("kind"), text.alias("text"))
    own = row(1, F.col("kind"), F.col("text"))
    out = F.when(pad, F.array(row(0, F.lit("paragraph"), F.lit("")), own)).otherwise(F.array(own))
    return rows.select("doc", "pos", F.explode(out).alias("x")).select("doc", "pos", "x.half", "x.kind", "x.text")


def galleries(attachments: DataFrame, body: DataFrame) -> DataFrame:
    """(note, image, rank, ord) of attached images (note, rank, ord, image): each once, in order, without those in the body (note, image)."""
    n = F.row_number().over(Window.partitionBy("note", "image").orderBy("rank", "ord"))
    once = attachments.withColumn("_n", n).where("_n = 1").drop("_n")
    there = body.select(F.col("note").alias("_b"), F.col("image").alias("_i")).distinct()
    return once.join(there, (F.col("note") == F.col("_b")) & (F.col("image") == F.col("_i")), "left_anti").select("note", "image", "rank", "ord")


def mark_spans(pages: DataFrame) -> DataFrame:
    """(page_id, pos, bold, italic, code, link, text): texts of a page with the inline marks that are open around them.

    A mark is open while more of its tags were opened than closed since the last block tag, which closes what was left open.
    """
    clean = F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1>", "")
    tokens = pages.select("page_id", F.posexplode(F.regexp_extract_all(clean, F.lit(r"(<[^>]+>|[^<]+)"), F.lit(1))).alias("pos", "tok"))
    tokens = tokens.withColumn("name", F.lower(F.regexp_extract("tok", r"^</?([a-zA-Z][a-zA-Z0-9]*)", 1))).withColumn("shut", F.col("tok").startswith("</"))
    order = Window.partitionBy("page_id").orderBy("pos")
    tokens = tokens.withColumn("block", F.sum(F.col("name").isin("p", "div", "li", "h1", "article", "footer", "nav", "title").cast("int")).over(order))
    inside = Window.partitionBy("page_id", "block").orderBy("pos")
    depth = lambda *names: F.sum(F.when(F.col("name").isin(*names), F.when(F.col("shut"), -1).otherwise(1)).otherwise(0)).over(inside) > 0
    marked = tokens.select("page_id", "pos", "tok", depth("b", "strong").alias("bold"), depth("i", "em").alias("italic"), depth("code").alias("code"), depth("a").alias("link"))
    return marked.where(~F.col("tok").startswith("<") & (trimmed(F.col("tok")) != "")).select("page_id", "pos", "bold", "italic", "code", "link", trimmed(F.col("tok")).alias("text"))
