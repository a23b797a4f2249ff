"""Text rules as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Named references that text extraction decodes, in one pass; &amp; comes last so that &amp;lt; gives &lt;. Fixed values.
ENTITIES = {
    "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&nbsp;": " ", "&copy;": "©", "&reg;": "®",
    "&euro;": "€", "&pound;": "£", "&yen;": "¥", "&cent;": "¢", "&amp;": "&",
}
#: Titles that say nothing. Fixed values.
EMPTY_TITLES = ["untitled", "无标题", "新建标签页", "new tab", "loading", "加载中", "undefined", "null"]
#: Captions that say nothing. Fixed values.
EMPTY_CAPTIONS = ["图片", "image", "picture", "photo", "img", "视频", "video", "动图", "gif", "点击查看大图", "点击放大"]
#: Words of buttons and adverts in captions. Fixed values.
BUTTON_WORDS = ["点击", "click", "查看", "view", "更多", "more", "广告", "adv", "sponsor", "分享", "share", "赞", "like", "comment", "来源", "source"]
#: Whole texts of bylines, dates and page tools. Fixed values.
METADATA_TEXTS = [
    r"(written by|reviewed by|edited by|posted by)\s*",
    r"(last edited|last updated|published on)\s*\w+\s+\d+,?\s*\d*",
    r"expert verified",
    r"(blogs?|guides?|articles?)\s*[/|]\s*(blogs?|guides?|articles?)?",
    r"published\s+(on\s+)?\d{4}[-/.]\d{1,2}[-/.]\d{1,2}",
    r"作者[：:].*",
    r"作者/公众号[：:].*",
    r"(📝\s*)?编辑本文",
    r"edit this (page|doc(?:ument)?|article)",
    r"gitalk\s*(加载中|loading)\s*\.{0,3}",
    r"[\w\s.-]+已运行\s+\d+\s+天\s+\d+\s+小时\s+\d+\s+分\s+\d+\s+秒",
]
#: Whole texts of follow and subscribe lines. Fixed values.
SOCIAL_TEXTS = [r"订阅", r"点击\s*订阅\s*到.*", r"(?i)subscribe", r"(?i)click.*subscribe.*", r"(?i)follow", r"\d+\.\s*"]


def trimmed(c: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(c, r"^[\s\u00a0\u3000\ufeff]+|[\s\u00a0\u3000\ufeff]+$", "")


def strip_html(c: Column) -> Column:
    """Text of a page: no scripts, styles or tags; entities decoded once; trimmed."""
    c = F.regexp_replace(c, r"(?is)<script\b.*?</script>", "")
    c = F.regexp_replace(c, r"(?is)<style\b.*?</style>", "")
    c = F.regexp_replace(c, r"<[^>]+>", "")
    for name, char in ENTITIES.items():
        c = F.replace(c, F.lit(name), F.lit(char))
    return trimmed(c)


def title_valid(c: Column) -> Column:
    t = trimmed(F.coalesce(c, F.lit("")))
    return F.length(t).between(3, 50) & ~F.lower(t).isin(EMPTY_TITLES)


def title_from_text(c: Column, most: int = 30) -> Column:
    """struct(title, remaining): the first sentence if it ends within ``most`` characters, else a cut with dots."""
    t = trimmed(F.coalesce(c, F.lit("")))
    at = F.regexp_instr(t, F.lit(r"[。.!！?？\n]"))
    ends = (at > 0) & (at <= most)
    title = F.when(t == "", "").when(ends, trimmed(F.substring(t, F.lit(1), at))).when(F.length(t) <= most, t).otherwise(F.concat(trimmed(F.substring(t, 1, most)), F.lit("...")))
    rest = F.when(t == "", "").when(ends, trimmed(F.substring(t, at + 1, F.length(t)))).when(F.length(t) <= most, "").otherwise(trimmed(F.substring(t, F.lit(most + 1), F.length(t))))
    return F.struct(title.alias("title"), rest.alias("remaining"))


def truncated(c: Column, most: int) -> Column:
    return F.when(F.length(c) <= most, c).otherwise(F.concat(F.substring(c, 1, most - 3), F.lit("...")))


def han_chars(c: Column) -> Column:
    return F.regexp_count(c, F.lit(r"[一-鿿]"))


def latin_words(c: Column) -> Column:
    return F.regexp_count(c, F.lit(r"[A-Za-z]+(?:['’][A-Za-z]+)*"))


def language(c: Column) -> Column:
    """chinese, english or other, by counts of Han characters and Latin words."""
    t = trimmed(F.coalesce(c, F.lit("")))
    han, latin = han_chars(t), latin_words(t)
    chinese = (han >= 2) & ((latin == 0) | (han >= latin) | (han >= 6))
    english = (latin >= 2) & ((han == 0) | ((han <= 2) & t.rlike(r"^[^一-鿿]*[A-Za-z]")))
    return F.when(chinese, "chinese").when(english, "english").otherwise("other")


def hard_end(c: Column) -> Column:
    return trimmed(c).rlike(r"[。！？!?；;:：]$")


def heading_like(c: Column, kind: Column) -> Column:
    t = trimmed(F.coalesce(c, F.lit("")))
    english = (kind == "english") & latin_words(t).between(1, 8) & t.rlike(r"^[A-Z0-9]")
    chinese = (kind == "chinese") & han_chars(t).between(1, 10) & ~t.rlike(r"[，,]")
    return (t != "") & ~hard_end(t) & (english | chinese)


def title_candidate(c: Column) -> Column:
    """Trimmed, without quotes around it, white space as single spaces."""
    t = F.regexp_replace(trimmed(F.coalesce(c, F.lit(""))), r"^[\"'“”‘’]+|[\"'“”‘’]+$", "")
    return trimmed(F.regexp_replace(t, r"\s+", " "))


def title_by_language(c: Column, most: int = 30) -> Column:
    """At most ``most`` characters with dots; English breaks at a late space."""
    t = title_candidate(c)
    hard = most - 3
    cut = F.substring(t, 1, hard)
    space = F.length(cut) - F.instr(F.reverse(cut), " ")  # what stands before the last space
    base = F.when((language(t) == "english") & (F.instr(cut, " ") > 0) & (space >= int(hard * 0.6)), F.substring(cut, F.lit(1), space)).otherwise(cut)
    return F.when(F.length(t) <= most, t).otherwise(F.concat(trimmed(base), F.lit("...")))


def title_key(c: Column) -> Column:
    """What titles are compared by."""
    return F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), r"[\u200b\u200c\u200d\u2060\ufeff\s.,;:!?。，；：！？、]", ""))


def page_title(c: Column) -> Column:
    c = F.regexp_replace(c, r"(?i)\s*/\s*(X|Twitter)$", "")
    c = F.regexp_replace(c, r"(?i)\s+on\s+(X|Twitter)$", "")
    c = F.regexp_replace(c, r"^\(\d+\+?\)\s*", "")
    return trimmed(F.regexp_replace(c, r"^\"|\"$", ""))


def caption_valid(c: Column) -> Column:
    t, low = trimmed(c), F.lower(c)
    stop = low.rlike("|".join(BUTTON_WORDS))
    credit = low.rlike(r"^(图|来源|source|credit|by|©)")
    button = low.rlike(r"click|view|read|share|like|icon")
    return F.coalesce(F.length(c).between(2, 80) & ~F.lower(t).isin(EMPTY_CAPTIONS) & ~(stop & ~credit & button), F.lit(False))


def metadata_text(c: Column, below: int = 100) -> Column:
    t = trimmed(c)
    return (F.length(t) > 0) & (F.length(t) < below) & t.rlike("(?i)^(?:" + "|".join(METADATA_TEXTS) + ")$")


def social_text(c: Column) -> Column:
    return trimmed(c).rlike("^(?:" + "|".join(SOCIAL_TEXTS) + ")$")


def byline_card(c: Column) -> Column:
    t, low, n = trimmed(c), F.lower(trimmed(c)), F.length(trimmed(c))
    byline = t.contains("Written by") & t.contains("Reviewed by") & (n < 500)
    card = (t.contains("Article by") | t.contains("Share this post")) & (n < 300)
    promo = low.contains("try it for free") & low.contains("learn more") & (n < 300)
    crumbs = low.contains("blogs / guides") & (n < 50)
    return byline | card | promo | crumbs


def redacted(c: Column, most: int = 160) -> Column:
    c = F.regexp_replace(c, r"(?i)https?://\S+", "[url]")
    c = F.regexp_replace(c, r"(?i)\b[a-f0-9]{24,}\b", "[id]")
    return F.substring(trimmed(F.regexp_replace(c, r"\s+", " ")), 1, most)


#: Codes of failed calls by status, part of the code and part of the message; the first that fits counts. Fixed values.
CALL_ERRORS = [
    ("UNAUTHORIZED", 401, "UNAUTHORIZED", None),
    ("RATE_LIMIT", 429, "RATE", None),
    ("CANCELLED", None, None, "ABORTED"),
    ("AMBIGUOUS_CREATE", 0, None, "TIMEOUT"),
    ("SERVICE_UNAVAILABLE", 503, "SERVICE", None),
    ("PERMISSION_DENIED", 403, "PERM", "仅限 Pro 会员"),
    ("CONTENT_TOO_LONG", 413, "TOO LARGE", None),
]
#: Codes by what the message says. Fixed values.
MESSAGE_ERRORS = [("UNAUTHORIZED", "401|unauthorized|invalid key"), ("RATE_LIMIT", "429|rate|limit"), ("NETWORK", "network|fetch|timeout"), ("CONTENT_TOO_LONG", "too long|字数|超")]


def error_code(message: Column, status: Column | None = None, code: Column | None = None) -> Column:
    """The kind of an error: of a failed call by its status and code, of anything else by its message."""
    kind = F.when(F.lit(False), "")
    if status is not None:
        upper = F.upper(F.coalesce(code if code is not None else F.lit(""), F.lit("")))
        for name, number, part, said in CALL_ERRORS:
            if number == 0:  # no answer: only with what the message says
                fits = (status == 0) & message.contains(said)
            else:
                fits = F.lit(False)
                fits = fits | (status == number) if number is not None else fits
                fits = fits | upper.contains(part) if part else fits
                fits = fits | (status.isNotNull() & message.contains(said)) if said else fits
            kind = kind.when(fits, name)
    for name, pattern in MESSAGE_ERRORS:
        kind = kind.when(F.lower(message).rlike(pattern), name)
    return kind.otherwise("UNKNOWN")


def visible(c: Column) -> Column:
    return F.regexp_replace(c, r"[\u200b\u200c\u200d\u2060\ufeff]", "")


def collection_candidate(title: Column, digest: Column, is_collection: Column) -> Column:
    name = F.regexp_replace(title, r"[\s\u00a0\u200b\ufeff]", "")
    return ~is_collection & (name.rlike(r"(合集|合辑)[）)\]】」』”\"’']*$") | trimmed(digest).rlike(r"^(此合集|本合集|该合集)") | digest.contains("已自动拆分为"))


def spaced(c: Column) -> Column:
    """One space and a word joiner where Han and Latin letters meet."""
    c = F.regexp_replace(c, r"(?<=[一-鿿])[ \t\u00a0\u2060]*(?=[A-Za-z])", " \u2060")
    return F.regexp_replace(c, r"(?<=[A-Za-z0-9.,!?;:)\]'\"“”‘’_-])[ \t\u00a0\u2060]*(?=[一-鿿])", " \u2060")


def leading_script(c: Column) -> Column:
    """From the first letter on as long as the script stays the same, without punctuation at the end."""
    t = title_candidate(c)
    first = F.regexp_extract(t, r"([一-鿿A-Za-z])", 1)
    latin = first.rlike("[A-Za-z]")
    run = F.when(first == "", t).when(latin, F.regexp_extract(t, r"([A-Za-z][^一-鿿]*)", 1)).otherwise(F.regexp_extract(t, r"([一-鿿][^A-Za-z]*)", 1))
    run = title_candidate(run)
    bare = F.when(latin, F.regexp_replace(run, r"[\s\-–—:：|/.,;!?]+$", "")).otherwise(F.regexp_replace(run, r"[\s\-–—:：|/]+$", ""))
    return F.when((first == "") | (bare == ""), run).otherwise(bare)


def excerpt_title(c: Column, most: int = 30) -> Column:
    """The beginning of Markdown as a title: whole words where there is a space, which stays at the end."""
    t = F.regexp_replace(F.regexp_replace(c, r"!\[([^\]]*)\]\([^)]+\)", "$1"), r"\[([^\]]+)\]\([^)]+\)", "$1")
    t = trimmed(F.regexp_replace(F.regexp_replace(t, r"[`*_>#-]", " "), r"\s+", " "))
    cut = F.substring(t, 1, most)
    back = F.instr(F.reverse(cut), " ")
    return F.when(F.length(t) <= most, t).when((F.substring(t, most + 1, 1) != " ") & (back > 0), F.substring(cut, F.lit(1), F.lit(most + 1) - back)).otherwise(cut)


def file_base(c: Column, most: int = 100, empty: str = "导出笔记") -> Column:
    """A title as a file name."""
    name = F.substring(trimmed(F.regexp_replace(F.regexp_replace(c, r"[\\/:*?\"<>|]", "_"), r"\s+", " ")), 1, most)
    return F.when(name == "", empty).otherwise(name)
