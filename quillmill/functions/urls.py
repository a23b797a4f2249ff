"""URL and page-source rules as native column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillmill.functions.text import trimmed

#: Hosts that are never public. Fixed values.
LOCAL_HOSTS = ["localhost", "0.0.0.0", "::1", "[::1]"]
#: Address ranges that are never public. Fixed values.
PRIVATE = r"^(127\.\d{1,3}|10\.\d{1,3}|192\.168|169\.254|172\.(1[6-9]|2\d|3[01]))\.\d{1,3}\.\d{1,3}$"


def domain_of(url: Column) -> Column:
    return F.coalesce(F.try_parse_url(url, F.lit("HOST")), F.lit(""))


def source_route(url: Column) -> Column:
    """weixin, weibo, twitter or web."""
    host = F.lower(domain_of(url))
    return (
        F.when(url.contains("mp.weixin.qq.com"), "weixin")
        .when(host.rlike(r"(^|\.)weibo\.(com|cn)$"), "weibo")
        .when(host.rlike(r"^(www\.)?(x|twitter)\.com$"), "twitter")
        .otherwise("web")
    )


def page_key(url: Column) -> Column:
    """Origin and path; what is no URL stays as it is."""
    plain = F.regexp_replace(url, r"[?#].*$", "")
    return F.when(~url.rlike(r"^https?://[^/?#]+"), url).when(plain.rlike(r"^https?://[^/]+$"), F.concat(plain, F.lit("/"))).otherwise(plain)


def public(url: Column) -> Column:
    """http or https, no user, and a host that is neither local nor in a private range."""
    host = F.lower(F.regexp_extract(url, r"^(?i:https?)://(\[[^\]]*\]|[^/?#:@]*)(?::\d+)?(?:[/?#]|$)", 1))
    return F.coalesce((host != "") & ~host.isin(LOCAL_HOSTS) & ~host.endswith(".local") & ~host.rlike(PRIVATE), F.lit(False))


def safe_link(url: Column) -> Column:
    return F.lower(F.regexp_extract(trimmed(url), r"^([a-zA-Z][a-zA-Z0-9+.-]*):", 1)).isin("http", "https", "mailto")


def quote_url(url: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(url, r"/(photo|video)/\d+", ""), r"[?#]+$", "")


def file_name(url: Column, mime: Column) -> Column:
    """The path's last part if it has a dot, else a name by the type."""
    last = F.element_at(F.split(F.regexp_replace(F.regexp_replace(url, r"[?#].*$", ""), r"^[a-z]+://[^/]*", ""), "/"), -1)
    ending = F.when(mime == "image/png", "png").when(mime == "image/gif", "gif").when(mime == "image/webp", "webp").otherwise("jpg")
    return F.when(last.contains("."), last).otherwise(F.concat(F.lit("image."), ending))


def then(value: Column, step: Callable[[Column], Column]) -> Column:
    """``step`` of a value that is worked out once, however often the step looks at it."""
    return F.element_at(F.transform(F.array(value), step), 1)


def without_params(url: Column, names: list[str]) -> Column:
    """Without these query parameters, and without what separators they leave behind."""
    url = F.regexp_replace(url, rf"([?&])(?:{'|'.join(names)})=[^&#]*", "$1")
    url = F.regexp_replace(F.regexp_replace(url, r"&{2,}", "&"), r"\?&+", "?")
    return F.regexp_replace(url, r"[?&]+(#|$)", "$1")


def _origin(url: Column) -> Column:
    return F.regexp_extract(url, r"^(https?://[^/?#]+)", 1)


def _substack(u: Column) -> Column:
    inner = F.try_url_decode(F.regexp_extract(u, r"(?i)/image/fetch/[^/]+/(https?%3A%2F%2F[^?#]+)", 1))
    plain = F.regexp_extract(u, r"(?i)/image/fetch/[^/]+/(https?://[^?#]+)", 1)
    return F.when(u.contains("substackcdn.com/image/fetch"), F.coalesce(F.nullif(inner, F.lit("")), F.nullif(plain, F.lit("")), u)).otherwise(u)


def _twimg(u: Column) -> Column:
    small = u.contains("pbs.twimg.com") & ~F.regexp_extract(u, r"[?&]name=([^&#]*)", 1).isin("", "orig", "large")
    return F.when(small, F.regexp_replace(u, r"([?&])name=[^&#]*", "$1name=large")).otherwise(u)


def _next_image(u: Column) -> Column:
    asked = F.coalesce(F.try_url_decode(F.regexp_extract(u, r"[?&]url=([^&#]+)", 1)), F.lit(""))
    return F.when(u.contains("_next/image") & (asked != ""), F.when(asked.startswith("http"), asked).otherwise(F.concat(_origin(u), asked))).otherwise(u)


def _cdn_cgi(u: Column) -> Column:
    real = F.regexp_extract(u, r"/cdn-cgi/image/[^/]+/([^?#]+)", 1)
    found = F.when(real.startswith("http"), F.coalesce(F.try_url_decode(real), real)).otherwise(F.concat(_origin(u), F.lit("/"), real))
    return F.when(u.contains("/cdn-cgi/image/") & (real != ""), found).otherwise(u)


def _imgix(u: Column) -> Column:
    return F.when(u.contains(".imgix.net") | u.contains("imgix.com"), without_params(u, ["w", "h", "fit", "crop", "auto", "q", "dpr", "blur"])).otherwise(u)


def _uploads(u: Column) -> Column:
    return F.when(u.contains("/uploads/") | u.contains("wp-content/uploads"), F.regexp_replace(u, r"-\d+x\d+(\.[a-zA-Z]+)$", "$1")).otherwise(u)


def _medium(u: Column) -> Column:
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(u, r"/resize:[^/]+", ""), r"/format:[^/]+", ""), r"/v2/+", "/v2/")
    return F.when(u.contains("miro.medium.com"), plain).otherwise(u)


def _shopify(u: Column) -> Column:
    plain = F.regexp_replace(without_params(u, ["width", "height", "crop"]), r"_\d+x(?:\d+)?(\.[a-zA-Z]+)($|[?#])", "$1$2")
    return F.when(u.contains("cdn.shopify.com") | u.contains("shopify.com/s/files"), plain).otherwise(u)


def image_url(url: Column) -> Column:
    """One address for each image: wrappers of known delivery networks come off and sizes go, one network after another."""
    url = F.when(url.startswith("//"), F.concat(F.lit("https:"), url)).otherwise(url)
    for step in (_substack, _twimg, _next_image, _cdn_cgi, _imgix, _uploads, _medium, _shopify):
        url = then(url, step)
    return url


def srcset_best(srcset: Column) -> Column:
    """The address of the largest descriptor, the first of equals; without descriptors the first address."""
    parts = F.split(trimmed(srcset), r"(?<=\d[wx])\s*,\s*")
    sized = F.transform(
        parts,
        lambda p, i: F.struct(
            F.coalesce(F.regexp_extract(p, r"\s(\d+(?:\.\d+)?)[wx]$", 1).try_cast("double"), F.lit(0.0)).alias("w"), (-i).alias("o"), F.regexp_replace(trimmed(p), r"\s+\d+(\.\d+)?[wx]$", "").alias("url")
        ),
    )
    return F.array_max(sized)["url"]


def weibo_image(url: Column, width: Column, height: Column) -> Column:
    """Pictures of the wx and ww hosts, at least 80 pixels a side where known, that are no placeholders."""
    host = F.lower(domain_of(url))
    large = (F.coalesce(width, F.lit(80)) >= 80) & (F.coalesce(height, F.lit(80)) >= 80)
    return host.rlike(r"^(wx|ww)[^.]*\.sinaimg\.cn$") & large & ~url.rlike(r"(?i)/images/default_[^/]+\.(gif|png|jpe?g)(?:[#?].*)?$|default_w_")


#: Sizes of a picture from the best to the least, before and after the one that is there. Fixed values.
LARGE_SIZES, SMALL_SIZES = ["large", "mw2000", "orj1080", "mw1024", "mw690"], ["orj480", "orj360", "bmiddle", "thumbnail"]


def size_candidates(url: Column) -> Column:
    """Addresses of all sizes of a picture, in order of preference."""
    parts = [F.regexp_extract(url, r"^(https?://[^/]+)/([^/?#]+)/([^?#]+)(.*)$", i) for i in range(1, 5)]
    sizes = F.array_distinct(F.concat(F.array(*map(F.lit, LARGE_SIZES)), F.array(parts[1]), F.array(*map(F.lit, SMALL_SIZES))))
    return F.when(parts[1] == "", F.array(url)).otherwise(F.transform(sizes, lambda s: F.concat(parts[0], F.lit("/"), s, F.lit("/"), parts[2], parts[3])))


def card_metadata(text: Column) -> Column:
    """Empty, a bare address or a bare domain."""
    t = trimmed(text)
    return (t == "") | t.rlike(r"(?i)^https?://\S+$") | t.rlike(r"(?i)^(?:[a-z0-9-]+\.)+[a-z]{2,}(?:/\S*)?$")


def absolute(href: Column, base: Column) -> Column:
    """``href`` as a whole address, seen from the page at ``base`` (http or https).

    What names a scheme stays; ``//host`` takes the page's scheme, ``/path`` its host, ``?query`` and ``#part`` its path, and
    anything else starts in its folder; ``.`` and ``..`` go. Nothing else is changed. An empty one is the page itself.
    """
    h = F.regexp_replace(href, r"^\s+|\s+$", "")
    part = lambda c, p: F.regexp_extract(c, p, 1)
    origin, path = part(base, r"^(https?://[^/?#]+)"), part(base, r"^https?://[^/?#]+([^?#]*)")
    path = F.when(path == "", "/").otherwise(path)
    own, tail = part(h, r"^([^?#]*)"), part(h, r"^[^?#]*(.*)$")
    whole = F.when(own.startswith("/"), own).otherwise(F.concat(part(path, r"^(.*/)"), own))
    step = lambda done, s: F.when(s == "..", F.regexp_replace(done, "/[^/]*$", "")).when(s == ".", done).otherwise(F.concat(done, F.lit("/"), s))
    dots = whole.rlike(r"/\.\.?(/|$)")
    flat = F.concat(F.aggregate(F.split(F.substring(whole, F.lit(2), F.length(whole)), "/"), F.lit(""), step), F.when(whole.rlike(r"/\.\.?$"), "/").otherwise(""))
    whole = F.when(dots, flat).otherwise(whole)
    query = part(base, r"^[^?#]*(\?[^#]*)")
    return (
        F.when(h.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), h)
        .when(h.startswith("//"), F.concat(part(base, r"^(https?:)"), h))
        .when((h == "") | h.startswith("#"), F.concat(origin, path, query, h))
        .when(h.startswith("?"), F.concat(origin, path, h))
        .otherwise(F.concat(origin, whole, tail))
    )


#: Attributes from which images are loaded late, first ones first. Fixed values.
LAZY = ["data-src", "data-original", "data-url", "data-lazy", "data-actualsrc", "data-hires", "data-lazy-src"]


def image_source(tag: Column) -> Column:
    """struct(url, kind): the one address of an img tag: lazy attributes, src, the largest of srcset, that of data-srcset.

    Inline data is never taken. kind is lazy, img or srcset; '' and none if there is nothing.
    """
    own = lambda name: F.regexp_extract(tag, rf"(?i)\s{name}\s*=\s*[\"']([^\"']*)[\"']", 1)
    real = lambda c: F.when((c != "") & ~c.startswith("data:"), c)
    lazy, src = F.coalesce(*[real(own(name)) for name in LAZY]), real(own("src"))
    sets = F.coalesce(*[real(F.when(own(name) != "", srcset_best(own(name)))) for name in ("srcset", "data-srcset")])
    kind = F.when(lazy.isNotNull(), "lazy").when(src.isNotNull(), "img").when(sets.isNotNull(), "srcset").otherwise("none")
    return F.struct(F.coalesce(lazy, src, sets, F.lit("")).alias("url"), kind.alias("kind"))


def match_keys(url: Column) -> Column:
    """array<struct(tier, key)>: what two addresses of one image may have in common; any equal key of one tier makes them match.

    The address, that without query and part, that without a width at its end, an id with a star, the longest part of the path
    of over ten characters (the first of equally long ones), the file name of over five.
    """
    bare, path = F.regexp_replace(url, r"[?#].*$", ""), F.regexp_extract(url, r"^https?://[^/?#]*([^?#]*)", 1)
    star = F.regexp_extract(path, r"(\d\*[A-Za-z0-9_-]+)", 1)
    long = F.aggregate(F.split(path, "/"), F.lit(""), lambda a, s: F.when((F.length(s) > 10) & (F.length(s) > F.length(a)), s).otherwise(a))
    last = F.element_at(F.split(bare, "/"), -1)
    keys = [url, bare, F.regexp_replace(bare, r"/\d{1,4}$", ""), star, long, F.when(F.length(last) > 5, last)]
    return F.filter(F.array(*[F.struct(F.lit(i).alias("tier"), F.nullif(k, F.lit("")).alias("key")) for i, k in enumerate(keys)]), lambda k: k["key"].isNotNull())
