"""Elements of pages with their whole extents, and rules that choose or remove them by tag, class, id or attribute.

A page is a sequence of tokens: tags and the text between them. An element reaches from its tag to the closing tag of the same
name at the same depth of that name; one that is never closed is its tag alone. Depths are running sums, and the closing tag is
the next token of that name at that depth, so extents come from windows over a page's tokens and need no parser. Scripts, styles
and comments are taken out first.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Where an article may be, best first. Fixed values.
ARTICLE = [
    ".available-content", ".newsletter-post", "article", '[role="main"]', ".post-content", ".article-content", ".entry-content", ".content", "main",
    "#content", ".post", ".article",
]
#: Adverts, sharing, comments, players, bylines and page tools. Fixed values.
JUNK = [
    ".advertisement", ".ads", ".social-share", ".comments", ".related-posts", '[aria-hidden="true"]', 'iframe[src*="ads"]', ".post-ufi",
    ".like-button-container", ".share-dialog", ".subscription-widget-wrap", ".substack-post-footer", ".post-header", ".post-ufi-button",
    ".pencraft.style-button", ".portable-archive-header", ".banner", ".post-footer", ".profile-hover-card", ".user-hover-card", ".pencraft", ".vssue",
    ".vssue-container", ".gitalk-container", ".gitalk", ".giscus", ".giscus-frame", ".utterances", ".disqus_thread", "#disqus_thread",
    ".comment-section", "#comments", '[class*="comment"]', ".page-edit", ".page-nav", ".page-meta", ".last-updated", ".runtime", ".pagination",
    ".pagination-item", ".pagination-item-label", ".pagination-item-title", ".docsify-pagination-container", "a.header-anchor", "a.heading-anchor",
    "a.anchor", ".header-anchor", '[data-testid="User-Name"]', '[data-testid="UserName"]', '[data-testid="User-Names"]', '[data-testid="subscribe"]',
    '[data-testid="reply"]', '[data-testid="retweet"]', '[data-testid="like"]', '[data-testid="bookmark"]', '[data-testid="share"]',
    '[data-testid="analyticsButton"]', '[data-testid="app-text-transition-container"]', '[class*="engagement-bar"]', '[class*="reactions-bar"]',
    '[class*="like-count"]', '[class*="retweet-count"]', '[class*="reply-count"]', '[class*="share-count"]', '[class*="view-count"]',
    '[class*="subscribe-button"]', '[class*="follow-button"]', '[data-testid="authorPhoto"]', 'img[data-testid="authorPhoto"]',
    '[data-testid="storyPublishDate"]', 'button[aria-label="responses"]', 'button[data-testid="headerClapButton"]', 'svg[aria-label="clap"]',
    '[data-testid="headerSocialShareButton"]', '[data-testid="audioPlayButton"]', ".speechify-ignore", 'a[href*="/@"][rel="noopener follow"]',
    "video", ".video-player", ".video-container", ".video_iframe", ".video_card", '[class*="video-player"]', '[class*="video-controls"]',
    '[class*="video-bar"]', ".js_tx_video_container", ".js_video_channel_video", ".video_channel_card_container", ".video_card_container",
    ".mpvideosnap_container", ".video_info_wrap", ".video_desc", ".video_channel", ".video_player_container", ".js_video_container", ".wx-video",
    '[class*="video_channel"]', '[class*="mpvideo"]', '[class*="wxvideo"]', ".video_play_btn", ".video_progress", ".video_time", ".video_fullscreen",
    ".video_speed", ".video_share", ".video_replay", ".video_attention", ".profile_info_area", ".profile_meta", ".wx_follow_btn", ".js_share_content",
    '[class*="follow"]', '[class*="subscribe"]', 'iframe:not([src*="mp.weixin"])',
]
#: Who wrote a page, and when; best first.
#: Fixed values.
AUTHORS = ['[rel="author"]', ".author", ".byline", '[itemprop="author"]', ".post-author"]
TIMES = ["time[datetime]", '[itemprop="datePublished"]', ".published", ".post-date", ".date"]
#: Inline marks by tag, and by what a style says. Fixed values.
MARKS = {"strong": "bold", "b": "bold", "em": "italic", "i": "italic", "mark": "highlight", "a": "link", "code": "code"}
STYLES = {"bold": r"(?i)font-weight\s*:\s*(bold|[7-9]00)", "italic": r"(?i)font-style\s*:\s*italic"}
#: Text from which a region is taken for the article. Fixed value.
ENOUGH = 200

RAW = r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>"
TOKEN = r"(<[^<>]*>|[^<]+|<)"
_SELECTOR = re.compile(r"^([a-z]*)((?:[.#][\w-]+|\[[^\]]+\])*)((?::not\(\[[^\]]+\]\))?)$")
_TEST = re.compile(r"\.([\w-]+)|#([\w-]+)|\[([\w-]+)(\*?=)?(?:\"([^\"]*)\")?\]")


def tokens(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, pos, token, name, closing): the tags of each page (name '' for text) in order, which joined give the page's html."""
    clean = F.regexp_replace(F.coalesce(F.col(html), F.lit("")), RAW, "")
    rows = pages.select(key, F.posexplode(F.regexp_extract_all(clean, F.lit(TOKEN), F.lit(1))).alias("pos", "token"))
    tag = r"^<(/?)([A-Za-z][A-Za-z0-9:-]*)"
    return rows.select(key, "pos", "token", F.lower(F.regexp_extract("token", tag, 2)).alias("name"), (F.regexp_extract("token", tag, 1) == "/").alias("closing"))


def elements(rows: DataFrame, key: str) -> DataFrame:
    """``tokens`` with until: of each opening tag, the place of the token that ends its element (its own, if nothing closes it)."""
    w = Window.partitionBy(key, "name").orderBy("pos")
    step = F.when(F.col("name") == "", 0).when(F.col("closing"), -1).otherwise(1)
    rows = rows.withColumn("depth", F.sum(step).over(w) + F.when(F.col("closing"), 1).otherwise(0))
    level = Window.partitionBy(key, "name", "depth").orderBy("pos")
    following = F.when(F.lead("closing").over(level), F.lead("pos").over(level))
    return rows.withColumn("until", F.when((F.col("name") != "") & ~F.col("closing"), F.coalesce(following, F.col("pos")))).drop("depth")


def attribute(token: Column, name: str) -> Column:
    """What an opening tag gives as an attribute, '' if it has none."""
    return F.regexp_extract(token, rf"(?i)\s{name}\s*=\s*[\"']([^\"']*)[\"']", 1)


def matches(selector: str, token: Column, name: Column) -> Column:
    """Whether an opening tag is what a selector names: a tag, classes, ids, attributes (there, equal, containing), or not one."""
    parsed = _SELECTOR.match(selector)
    if not parsed:
        raise ValueError(f"not a simple selector: {selector}")
    tag, tests, no = parsed.groups()

    def holds(found: tuple[str, ...]) -> Column:
        cls, id_, attr, op, value = found
        if cls:
            return F.array_contains(F.split(attribute(token, "class"), r"\s+"), cls)
        if id_:
            return attribute(token, "id") == id_
        if not op:
            return token.rlike(rf"(?i)\s{attr}\b")
        return attribute(token, attr).contains(value) if op == "*=" else attribute(token, attr) == value

    out = name == tag if tag else F.lit(True)
    for found in _TEST.findall(tests):
        out = out & holds(found)
    for found in _TEST.findall(no):
        out = out & ~holds(found)
    return out


def any_of(selectors: list[str], token: Column, name: Column) -> Column:
    """Whether any selector holds; lone classes and parts of classes, which most rules are, by one test for all of them."""
    classes = [s[1:] for s in selectors if re.fullmatch(r"\.[\w-]+", s)]
    parts = [m[1] for s in selectors if (m := re.fullmatch(r'\[class\*="([^"]*)"\]', s))]
    own = attribute(token, "class")
    out = F.arrays_overlap(F.split(own, r"\s+"), F.array(*map(F.lit, classes))) if classes else F.lit(False)
    if parts:
        out = out | own.rlike("|".join(map(re.escape, parts)))
    for s in selectors:
        if not re.fullmatch(r"\.[\w-]+|\[class\*=.*", s):
            out = out | matches(s, token, name)
    return out


def _html(token: str = "token") -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", token))), lambda x: x[token]), "")


def remove(pages: DataFrame, key: str, html: str, selectors: list[str] | None = None) -> DataFrame:
    """(key, html, removed): pages without the elements that any of ``selectors`` names (by default ``JUNK``), whole, with all
    that is in them; how many were named. Scripts, styles and comments are gone. A page of nothing else is ''."""
    rows = elements(tokens(pages, key, html), key)
    opening = (F.col("name") != "") & ~F.col("closing")
    rows = rows.withColumn("hit", opening & any_of(selectors or JUNK, F.col("token"), F.col("name")))
    w = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("inside", F.coalesce(F.max(F.when(F.col("hit"), F.col("until"))).over(w) >= F.col("pos"), F.lit(False)))
    kept = rows.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~F.col("inside"), F.struct("pos", "token")))), lambda x: x["token"]), "").alias("html"), F.count_if("hit").alias("removed"))
    return pages.select(key).join(kept, key, "left").select(key, F.coalesce("html", F.lit("")).alias("html"), F.coalesce("removed", F.lit(0)).alias("removed"))


def main_region(pages: DataFrame, key: str, html: str, selectors: list[str] | None = None, enough: int = ENOUGH) -> DataFrame:
    """(key, rank, html): the element that holds a page's article: the first of the first selector (by default ``ARTICLE``) whose
    text has more than ``enough`` characters. If there is none, what the last selector finds, else the whole page (rank null)."""
    selectors = selectors or ARTICLE
    rows = elements(tokens(pages, key, html), key)
    opening = (F.col("name") != "") & ~F.col("closing")
    ranks = F.array_compact(F.array(*[F.when(matches(s, F.col("token"), F.col("name")), F.lit(i)) for i, s in enumerate(selectors)]))
    chars = F.sum(F.when(F.col("name") == "", F.length("token")).otherwise(0)).over(Window.partitionBy(key).orderBy("pos"))
    rows = rows.withColumn("chars", chars)
    found = rows.where(opening).withColumn("rank", F.explode(ranks)).groupBy(key, "rank").agg(F.min_by(F.struct("pos", "until", "chars"), "pos").alias("e"))
    ends = rows.select(F.col(key).alias("of"), F.col("pos").alias("end"), F.col("chars").alias("chars_to"))
    found = found.join(ends, (F.col(key) == F.col("of")) & (F.col("e.until") == F.col("end")))
    good = (F.col("chars_to") - F.col("e.chars") > enough) | (F.col("rank") == len(selectors) - 1)
    chosen = found.where(good).groupBy(F.col(key).alias("of")).agg(F.min_by(F.struct("rank", "e.pos", "e.until"), "rank").alias("c"))
    rows = rows.join(chosen, F.col(key) == F.col("of"), "left").where(F.col("c").isNull() | F.col("pos").between(F.col("c.pos"), F.col("c.until")))
    region = rows.groupBy(key).agg(F.first("c.rank").alias("rank"), _html().alias("html"))
    return pages.select(key).join(region, key, "left").select(key, "rank", F.coalesce("html", F.lit("")).alias("html"))


def first_elements(pages: DataFrame, key: str, html: str, selectors: list[str]) -> DataFrame:
    """(key, rank, tag, text): the first element of each selector that a page has one of, with its trimmed text."""
    rows = elements(tokens(pages, key, html), key)
    opening = (F.col("name") != "") & ~F.col("closing")
    ranks = F.array_compact(F.array(*[F.when(matches(s, F.col("token"), F.col("name")), F.lit(i)) for i, s in enumerate(selectors)]))
    found = rows.where(opening).withColumn("rank", F.explode(ranks)).groupBy(key, "rank").agg(F.min_by(F.struct("pos", "until", "token"), "pos").alias("e"))
    texts = rows.where("name = ''").select(F.col(key).alias("of"), "pos", "token")
    inside = found.join(texts, (F.col(key) == F.col("of")) & F.col("pos").between(F.col("e.pos"), F.col("e.until")), "left")
    out = inside.groupBy(key, "rank").agg(F.first("e.token").alias("tag"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "token"))), lambda x: F.coalesce(x["token"], F.lit(""))), "").alias("text"))
    return out.withColumn("text", F.regexp_replace("text", r"^\s+|\s+$", ""))


def author_and_time(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, author, published): the text of the first of ``AUTHORS`` that has any; of the first of ``TIMES`` that there is, its
    datetime, else its text. '' if there is none."""
    found = first_elements(pages, key, html, [*AUTHORS, *TIMES])
    n = len(AUTHORS)
    said = F.coalesce(F.nullif(attribute(F.col("tag"), "datetime"), F.lit("")), F.col("text"))
    picked = found.groupBy(key).agg(
        F.min_by("text", F.when((F.col("rank") < n) & (F.col("text") != ""), F.col("rank"))).alias("author"),
        F.min_by(said, F.when(F.col("rank") >= n, F.col("rank"))).alias("published"),
    )
    return pages.select(key).join(picked, key, "left").select(key, F.coalesce("author", F.lit("")).alias("author"), F.coalesce("published", F.lit("")).alias("published"))


def mark_spans(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, pos, text, marks): texts of a page that have inline marks, with each mark once, sorted.

    A text has the marks of all elements that it is in: those of their tags and of their styles. Blank texts are left out.
    """
    rows = elements(tokens(pages, key, html), key)
    of_tag = F.coalesce(*[F.when(F.col("name") == tag, F.lit(mark)) for tag, mark in MARKS.items()])
    styled = [F.when(attribute(F.col("token"), "style").rlike(pattern), F.lit(mark)) for mark, pattern in STYLES.items()]
    marked = rows.where((F.col("name") != "") & ~F.col("closing")).select(F.col(key).alias("of"), F.col("pos").alias("begin"), "until", F.explode(F.array_compact(F.array(of_tag, *styled))).alias("mark"))
    texts = rows.where("name = '' AND trim(token) <> ''").select(key, "pos", F.col("token").alias("text"))
    found = texts.join(marked, (F.col(key) == F.col("of")) & F.col("pos").between(F.col("begin"), F.col("until")))
    return found.groupBy(key, "pos").agg(F.first("text").alias("text"), F.array_sort(F.collect_set("mark")).alias("marks"))
