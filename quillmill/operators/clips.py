"""Pages as rows: scans, routing, gates and main regions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmill.functions.text import strip_html, trimmed
from quillmill.functions.urls import domain_of, source_route

#: Characters that one part holds at most.
PART_CHARS = 19000
#: Bytes from which a Markdown file counts as large.
LARGE_BYTES = 2 * 1024 * 1024
#: Tags that go in any case, and those that structure a page around its text. Fixed values.
NOISE_TAGS = ["script", "style", "noscript", "iframe", "svg", "canvas", "button", "select", "textarea"]
STRUCTURE_TAGS = ["nav", "header", "footer", "aside"]


def page_scan(pages: DataFrame) -> DataFrame:
    """Clip skeletons of a page corpus."""
    return pages.select(F.col("page_id").alias("clip_id"), F.col("url").alias("source_url"), domain_of(F.col("url")).alias("domain"), source_route(F.col("url")).alias("source_kind"), F.length("html").alias("html_chars"))


def markdown_scan(docs: DataFrame) -> DataFrame:
    """Markdown with one kind of line end, trimmed; its bytes, and whether the file is large."""
    text = trimmed(F.regexp_replace(F.coalesce(F.col("text"), F.lit("")), "\r\n", "\n"))
    return docs.select("doc_id", text.alias("markdown")).select("doc_id", "markdown", F.octet_length("markdown").alias("bytes"), (F.octet_length("markdown") > LARGE_BYTES).alias("large"))


def without_structure(html: Column) -> Column:
    for tag in [*NOISE_TAGS, *STRUCTURE_TAGS]:
        html = F.regexp_replace(html, rf"(?is)<{tag}\b.*?</{tag}>", "")
    return html


def content_gate(html: Column) -> Column:
    """Whether content is long enough and has enough blocks to be taken as an article."""
    return (F.length(html) >= 200) & (F.regexp_count(html, F.lit(r"(?i)<(p|div|li|h[1-6])\b")) >= 3)


def main_region(html: Column) -> Column:
    """The region that region rules choose, as they are applied one after another.

    Each rule that matches replaces the choice; a match of more than 200 characters ends the search. A match that is too
    short is overwritten by the next rule's miss, so that the whole page comes out.
    """
    rules = [r"(?is)<article\b[^>]*>(.*?)</article>", r"(?is)<main\b[^>]*>(.*?)</main>"]
    choice, done = html, F.lit(False)
    for rule in rules:
        found = F.regexp_extract(html, rule, 1)
        good = (found != "") & (F.length(strip_html(found)) > 200)
        choice = F.when(done, choice).when(found != "", found).otherwise(html)
        done = done | good
    return choice


def clip_stats(pages: DataFrame) -> DataFrame:
    """Of every page: title, domain, characters of text, images, tables, and the parts it will need."""
    html = F.col("html")
    body = pages.select(
        "page_id",
        domain_of(F.col("url")).alias("domain"),
        trimmed(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)).alias("title"),
        F.length(strip_html(html)).cast("long").alias("chars"),
        F.regexp_count(html, F.lit(r"(?i)<img\b")).cast("long").alias("images"),
        F.regexp_count(html, F.lit(r"(?i)<table\b")).cast("long").alias("tables"),
    )
    return body.withColumn("parts", F.greatest(F.lit(1), F.ceil(F.col("chars") / PART_CHARS)).cast("long"))
