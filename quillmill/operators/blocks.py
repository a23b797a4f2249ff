"""Pages and texts as ordered blocks, and rules over the order of blocks.

Every table of blocks carries its document's key and ``pos``. All window rules partition by the key first, so that one
shuffle by it serves a whole chain of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmill.functions.text import title_key, trimmed
from quillmill.functions.urls import absolute, then

#: Tags at which a block begins or ends. Fixed values.
BLOCK_TAGS = "p div section article main aside header footer figure figcaption tr td th ul ol li blockquote pre h1 h2 h3 h4 h5 h6 hr".split()


def block_table(pages: DataFrame) -> DataFrame:
    """(page_id, block, tag, level, text) of every page, in order; level is 0 but for headings; blocks without text are there too.

    Scripts, styles and comments go first, as they may hold tags in quotes. Pages are cut at opening and at closing
    tags, because paragraphs are often left open. tag is the opening tag that begins the block ("" after a closing one);
    a br is a line break.
    """
    clean = F.regexp_replace(F.regexp_replace(F.regexp_replace("html", r"(?is)<script\b.*?</script>", ""), r"(?is)<style\b.*?</style>", ""), r"(?s)<!--.*?-->", "")
    tokens = pages.select("page_id", F.posexplode(F.regexp_extract_all(clean, F.lit(r"(<[^>]+>|[^<]+)"), F.lit(1))).alias("pos", "tok"))
    tokens = tokens.withColumn("name", F.lower(F.regexp_extract("tok", r"^</?([a-zA-Z][a-zA-Z0-9]*)", 1))).withColumn("cut", F.col("name").isin(BLOCK_TAGS))
    order = Window.partitionBy("page_id").orderBy("pos")
    tokens = tokens.withColumn("block", F.sum(F.col("cut").cast("long")).over(order))
    piece = F.when(F.col("name") == "br", "\n").when(F.col("tok").startswith("<"), "").otherwise(F.col("tok"))
    opened = F.when(F.col("cut") & ~F.col("tok").startswith("</"), F.col("name"))
    blocks = tokens.groupBy("page_id", "block").agg(
        F.coalesce(F.max(opened), F.lit("")).alias("tag"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col("pos"), piece.alias("piece")))), lambda x: x["piece"]), "").alias("raw"),
    )
    return blocks.select("page_id", "block", "tag", F.when(F.col("tag").rlike("^h[1-6]$"), F.substring("tag", 2, 1).cast("int")).otherwise(0).alias("level"), trimmed(F.regexp_replace("raw", r"[ \t\r\n]+", " ")).alias("text"))


def block_type(tag: Column) -> Column:
    return (
        F.when(tag.rlike("^h[1-6]$"), "heading").when(tag == "p", "paragraph").when(tag.isin("ul", "ol", "li"), "list").when(tag == "blockquote", "quote").when(tag.isin("pre", "code"), "code").otherwise("other")
    )


def collapse_blank(blocks: DataFrame, key: str, pos: str, text: str) -> DataFrame:
    """Runs of empty blocks become one, and none stays at head or tail."""
    order = Window.partitionBy(key).orderBy(pos)
    whole = Window.partitionBy(key)
    blank = F.col(text) == ""
    out = blocks.withColumn("_was", F.lag(blank).over(order)).withColumn("_lo", F.min(F.when(~blank, F.col(pos))).over(whole)).withColumn("_hi", F.max(F.when(~blank, F.col(pos))).over(whole))
    return out.where(F.col(pos).between(F.col("_lo"), F.col("_hi")) & ~(blank & F.coalesce("_was", F.lit(False)))).drop("_was", "_lo", "_hi")


def insert_spacers(blocks: DataFrame, key: str, pos: str, text: str) -> DataFrame:
    """(key, pos, half, text): an empty block (half 0) before each text block (half 1) that follows another; not between two list items."""
    order = Window.partitionBy(key).orderBy(pos)
    item = lambda c: c.rlike(r"^(•|\d+[.、)])\s*")
    before = F.lag(text).over(order)
    gap = before.isNotNull() & (before != "") & (F.col(text) != "") & ~(item(before) & item(F.col(text)))
    rows = blocks.withColumn("_gap", F.coalesce(gap, F.lit(False)))
    own = F.struct(F.lit(1).alias("half"), F.col(text).alias("text"))
    return rows.select(key, pos, F.explode(F.when(F.col("_gap"), F.array(F.struct(F.lit(0).alias("half"), F.lit("").alias("text")), own)).otherwise(F.array(own))).alias("_x")).select(key, pos, "_x.*")


def drop_leading_title(blocks: DataFrame, key: str, pos: str, text: str, title: str) -> DataFrame:
    """Leaves out the leading blocks that repeat the title: the non-empty blocks from the first on, while their keys are the title's."""
    order = Window.partitionBy(key).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    match = (title_key(F.col(text)) == title_key(F.col(title))) | (F.col(text) == "")
    return blocks.withColumn("_lead", F.min(match.cast("int")).over(order)).where("_lead = 0").drop("_lead")


def list_paragraphs(pages: DataFrame) -> DataFrame:
    """(page_id, list, item, text): non-empty items of each list as paragraphs with a bullet or their number."""
    clean = F.regexp_replace("html", r"(?is)<script\b.*?</script>", "")
    lists = pages.select("page_id", F.posexplode(F.regexp_extract_all(clean, F.lit(r"(?is)(<[uo]l\b.*?</[uo]l>)"), F.lit(1))).alias("list", "src"))
    items = lists.select("page_id", "list", F.lower(F.substring("src", 2, 2)).alias("kind"), F.posexplode(F.regexp_extract_all("src", F.lit(r"(?is)<li\b[^>]*>(.*?)</li>"), F.lit(1))).alias("pos", "item"))
    items = items.withColumn("item", trimmed(F.regexp_replace("item", r"<[^>]+>", ""))).where("item <> ''")
    number = F.row_number().over(Window.partitionBy("page_id", "list").orderBy("pos"))
    return items.withColumn("n", number).select("page_id", "list", "n", F.concat(F.when(F.col("kind") == "ol", F.concat(F.col("n").cast("string"), F.lit(". "))).otherwise("• "), F.col("item")).alias("text"))


def anchors(pages: DataFrame) -> DataFrame:
    """(page_id, ord, url): links of a page, made absolute."""
    found = pages.select("page_id", "url", F.posexplode(F.regexp_extract_all("html", F.lit(r"(?i)<a\b[^>]*?href=\"([^\"]*)\""), F.lit(1))).alias("ord", "href"))
    return found.select("page_id", "ord", absolute(F.col("href"), F.col("url")).alias("url"))


def lines(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, line): the lines of texts."""
    return docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


def markdown_blocks(docs: DataFrame) -> DataFrame:
    """(doc_id, block, kind, n_lines, text): runs of lines of one kind; fences hold whatever is in them; blank lines part paragraphs."""
    order = Window.partitionBy("doc_id").orderBy("line_no")
    rows = lines(docs)
    fence = F.col("line").rlike(r"^\s*```")
    rows = rows.withColumn("_f", fence.cast("int")).withColumn("_open", F.coalesce(F.sum("_f").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) % 2 == 1)
    kind = (
        F.when(F.col("_open") | (F.col("_f") == 1), "code")
        .when(F.col("line").rlike(r"^\s*$"), "blank")
        .when(F.col("line").rlike(r"^#{1,6}\s"), "heading")
        .when(F.col("line").rlike(r"^>"), "quote")
        .when(F.col("line").rlike(r"^\s*([-*+]|\d+[.)])\s"), "list")
        .when(F.col("line").contains(" | "), "table")
        .otherwise("paragraph")
    )
    rows = rows.withColumn("kind", kind)
    new = (F.lag("kind").over(order).isNull()) | (F.lag("kind").over(order) != F.col("kind")) | (F.col("kind") == "heading") | ((F.col("kind") == "code") & (F.col("_f") == 1) & ~F.col("_open"))
    rows = rows.withColumn("_new", new.cast("int")).withColumn("block", F.sum("_new").over(order))
    texts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n")
    return rows.groupBy("doc_id", "block", "kind").agg(F.count(F.lit(1)).alias("n_lines"), texts.alias("text")).where("kind <> 'blank'")


#: What a paragraph that leads to a quoted article starts with. Fixed value.
REFERENCE = r"^🔗\s*引用文章："
#: Marks that start a unit inside a line. Fixed value.
INLINE_MARKER = r"(?:[→➜•\-–—*]|\d+\s*[-.:：)]|[A-Za-z]\)|[A-Za-z]\.)"
#: What a unit ends with for the next one to start without white space before it. Fixed value.
HARD_STOP = r"[。！？!?；;:：]\s*$"


def merge_quote_runs(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """(key, order..., kind, text, group, merged): quotes that follow a reference paragraph as one quote.

    ``rows``: key, order, kind (paragraph, quote, ...), text, group. A run is quotes one after another, single blank paragraphs
    between two of them included; it counts if a reference paragraph comes right before it, or before one blank. It takes its
    first row's place; texts that aren't empty are joined by a line break, or two where a blank is between, and its group is
    the first one that is named. A run without any text goes. merged is the number of rows in it (1 for other rows). Null text
    is ''. Runs are islands of a window, guarded by the row before them.
    """
    w = Window.partitionBy(key).orderBy(*order)
    rows = rows.select(key, *order, "kind", F.coalesce("text", F.lit("")).alias("text"), "group")
    quote, blank = F.col("kind") == "quote", (F.col("kind") == "paragraph") & (trimmed(F.col("text")) == "")
    rows = rows.withColumn("_quote", quote).withColumn("_blank", blank)
    rows = rows.withColumn("_ref", (F.col("kind") == "paragraph") & trimmed(F.regexp_replace("text", "[\u2060\u200b]", "")).rlike(REFERENCE))
    near = lambda c, n: F.coalesce((F.lag if n > 0 else F.lead)(c, abs(n)).over(w), F.lit(False))
    rows = rows.withColumn("_in", F.col("_quote") | (F.col("_blank") & near("_quote", 1) & near("_quote", -1)))
    rows = rows.withColumn("_after", near("_ref", 1) | (near("_blank", 1) & near("_ref", 2)))
    rows = rows.withColumn("_new", ~F.col("_in") | ~near("_in", 1))
    rows = rows.withColumn("_island", F.sum(F.col("_new").cast("int")).over(w))
    island = Window.partitionBy(key, "_island").orderBy(*order)
    rows = rows.withColumn("_run", F.first(F.col("_in") & F.col("_after")).over(island))
    rows = rows.withColumn("_blanks", F.count(F.when(F.col("_blank"), 1)).over(island))
    said = F.col("_quote") & (F.col("text") != "")
    before = F.last(F.when(said, F.col("_blanks")), ignorenulls=True).over(island.rowsBetween(Window.unboundedPreceding, -1))
    joint = F.when(before.isNull(), "").when(F.col("_blanks") > before, "\n\n").otherwise("\n")
    rows = rows.withColumn("_piece", F.when(said, F.concat(joint, F.col("text"))).otherwise(""))
    at = F.struct(*order)
    runs = rows.where("_run").groupBy(key, "_island").agg(
        F.min(at).alias("_at"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(at.alias("at"), "_piece"))), lambda x: x["_piece"]), "").alias("text"),
        F.min_by("group", F.when(F.col("group").isNotNull(), at)).alias("group"),
        F.count(F.lit(1)).alias("merged"),
    )
    runs = runs.where("text <> ''").select(key, *[F.col(f"_at.{c}").alias(c) for c in order], F.lit("quote").alias("kind"), "text", "group", "merged")
    return rows.where("NOT _run").select(key, *order, "kind", "text", "group", F.lit(1).cast("long").alias("merged")).unionByName(runs)


def marker_units(text: Column) -> Column:
    """array<string>: a line cut before the list marks inside it, each unit trimmed.

    A mark (bullet, arrow, dash, number, letter) with white space after it starts a unit if the last visible character before it
    is a hard stop; in a line that starts with a mark, or that was cut before, white space before the mark is enough. Null and
    blank lines have no units. The first cut of a line is always one after a hard stop, so no place waits for another: all marks
    are set off at once, and those places stay that qualify.
    """
    line = trimmed(text)
    split = F.split(F.regexp_replace(line, f"{INLINE_MARKER}\\s+", "\x01$0"), "\x01")
    hard = lambda parts: F.transform(parts, lambda p, i: (i < F.size(parts) - 1) & (p != "") & p.rlike(HARD_STOP))
    # from which place on white space is enough: from the start, or after the first cut
    first = lambda stops: F.when(line.rlike(f"^{INLINE_MARKER}"), 0).otherwise(F.nullif(F.array_position(stops, True), F.lit(0)))

    def units(parts: Column, stops: Column, listed: Column) -> Column:
        opens = lambda i: F.get(stops, i - 1) | F.coalesce((i > listed) & F.get(parts, i - 1).rlike(r"\s$"), F.lit(False))
        marked = F.transform(parts, lambda p, i: F.concat(F.when((i > 0) & opens(i), "\x02").otherwise(""), p))
        return F.split(F.array_join(marked, ""), "\x02")

    cut = then(split, lambda parts: then(hard(parts), lambda stops: then(first(stops), lambda listed: units(parts, stops, listed))))
    return F.filter(F.transform(cut, trimmed), lambda u: u != "")


#: Warnings of an import in the order they are told, with their levels. Fixed values.
WARNINGS = [
    ("EMPTY_CONTENT", "error"), ("UNSUPPORTED_SYNTAX", "warning"), ("LOCAL_IMAGE_DEGRADED", "warning"), ("DATA_IMAGE_DEGRADED", "warning"), ("TABLE_RENDER_FAILED", "warning"),
    ("TABLE_FALLBACK_TEXT", "info"), ("INVALID_LINK", "warning"), ("FRONT_MATTER_IGNORED", "info"), ("HTML_SANITIZED", "info"), ("LARGE_FILE", "info"),
]
#: Bytes from which a file is large; front matter that is used. Fixed values.
LARGE, FRONT_MATTER = 2 * 1024 * 1024, ["title", "tags", "date"]


def import_counts(files: DataFrame, md: str) -> DataFrame:
    """``files`` with a column for each warning that their Markdown gives rise to: how often it does. Null Markdown is empty."""
    text = F.coalesce(F.col(md), F.lit(""))
    n = lambda p: F.regexp_count(text, F.lit(p)).cast("long")
    one = lambda c: c.cast("long")
    image = r"!\[[^\]]*\]\("
    keys = F.transform(F.split(F.regexp_extract(text, r"(?s)^---\n(.*?)\n---", 1), "\n"), lambda x: F.regexp_extract(x, r"^([A-Za-z_]+):", 1))
    syntax = [r"(?i)```\s*mermaid\b", r"\[\^[^\]]+\]", r"(?i)(^|\n)\[\[?toc\]?\](\n|$)"]
    counts = {
        "empty_content": one(F.trim(text) == ""),
        "unsupported_syntax": sum((one(text.rlike(p)) for p in syntax), F.lit(0).cast("long")),
        "local_image_degraded": n(image) - n(image + "(?:https?:|data:)"),
        "data_image_degraded": n(image + "data:"),
        "table_fallback_text": n(r"(?m)^\s*\|?(?:\s*:?-{3,}:?\s*\|)+\s*(?::?-{3,}:?\s*\|?)?\s*$"),
        "invalid_link": n(r"\]\((?:javascript|vbscript|file):"),
        "front_matter_ignored": F.size(F.filter(keys, lambda k: (k != "") & ~k.isin(FRONT_MATTER))).cast("long"),
        "html_sanitized": n(r"(?i)<(?:script|iframe|object|embed|style)\b"),
        "large_file": one(F.octet_length(text) > LARGE),
    }
    return files.withColumns(counts)


def warnings(files: DataFrame, key: str) -> DataFrame:
    """(key, ord, code, level, n): the warnings of each file in the fixed order, those that occur; from a column for each code.

    Codes without a column (tables that failed to render are known only to whoever renders them) don't occur.
    """
    told = [(i, code, level) for i, (code, level) in enumerate(WARNINGS) if code.lower() in files.columns]
    rows = F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(code).alias("code"), F.lit(level).alias("level"), F.col(code.lower()).cast("long").alias("n")) for i, code, level in told])
    return files.select(key, F.inline(F.filter(rows, lambda w: w["n"] > 0)))
