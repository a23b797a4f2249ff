"""Queries over image addresses, image tags and cards, derived from pages."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillmill.functions import urls as U
from quillmill.plans.registry import Registry, derived, same
from quillmill.plans.texts import ws

registry = Registry()
query = registry.add

#: Addresses of images as delivery networks write them.
IMG_URLS = """
SELECT page_id, CASE page_id % 14
  WHEN 0 THEN concat('https://cdn.example.com/wp-content/uploads/a', CAST(page_id AS STRING), '-300x200.jpg')
  WHEN 1 THEN concat('https://substackcdn.com/image/fetch/w_1456,c_limit/https%3A%2F%2Fbucket.example.com%2Fimg%2F', CAST(page_id AS STRING), '.png')
  WHEN 2 THEN concat('https://pbs.twimg.com/media/X', CAST(page_id AS STRING), '?format=jpg&name=small')
  WHEN 3 THEN concat('https://site.example.com/_next/image?url=%2Fpics%2F', CAST(page_id AS STRING), '.jpg&w=640')
  WHEN 4 THEN concat('https://img.example.com/cdn-cgi/image/width=80,format=auto/pics/', CAST(page_id AS STRING), '.jpg')
  WHEN 5 THEN concat('https://a.imgix.net/p', CAST(page_id AS STRING), '.jpg?w=400&h=300&v=2&fit=crop')
  WHEN 6 THEN concat('https://miro.medium.com/v2/resize:fit:720/format:webp/1*', CAST(page_id AS STRING), '.png')
  WHEN 7 THEN concat('https://cdn.shopify.com/s/files/p', CAST(page_id AS STRING), '_500x.jpg?width=5&v=1')
  WHEN 8 THEN concat('//static.example.com/i/', CAST(page_id AS STRING), '.gif')
  WHEN 9 THEN concat('https://wx1.sinaimg.cn/mw690/abc', CAST(page_id AS STRING), '.jpg')
  WHEN 10 THEN 'https://ww2.sinaimg.cn/images/default_s_large.gif'
  WHEN 11 THEN concat('https://tvax1.sinaimg.cn/large/', CAST(page_id AS STRING), '.jpg')
  WHEN 12 THEN concat('https://site.example.com/_next/image?url=https%3A%2F%2Fo.example.com%2F', CAST(page_id AS STRING), '.jpg&w=64')
  ELSE concat('https://plain.example.com/image/', CAST(page_id AS STRING)) END AS url,
  page_id % 300 AS width, CASE page_id % 6 WHEN 0 THEN 'image/png' WHEN 1 THEN 'image/gif' WHEN 2 THEN 'image/webp' ELSE 'image/jpeg' END AS mime FROM {pages}"""

ORIGIN = "regexp_extract({0}, '^(https?://[^/?#]+)', 1)"


def without(x: str, names: list[str]) -> str:
    x = f"regexp_replace({x}, '([?&])(?:{'|'.join(names)})=[^&#]*', '\\1', 'g')"
    x = f"regexp_replace(regexp_replace({x}, '&{{2,}}', '&', 'g'), '\\?&+', '?', 'g')"
    return f"regexp_replace({x}, '[?&]+(#|$)', '\\1', 'g')"


STEPS = [
    "CASE WHEN prefix(u, '//') THEN 'https:' || u ELSE u END",
    "CASE WHEN contains(u, 'substackcdn.com/image/fetch') THEN coalesce(nullif(url_decode(regexp_extract(u, '(?i)/image/fetch/[^/]+/(https?%3A%2F%2F[^?#]+)', 1)), ''), nullif(regexp_extract(u, '(?i)/image/fetch/[^/]+/(https?://[^?#]+)', 1), ''), u) ELSE u END",
    "CASE WHEN contains(u, 'pbs.twimg.com') AND regexp_extract(u, '[?&]name=([^&#]*)', 1) NOT IN ('', 'orig', 'large') THEN regexp_replace(u, '([?&])name=[^&#]*', '\\1name=large') ELSE u END",
    f"CASE WHEN contains(u, '_next/image') AND regexp_extract(u, '[?&]url=([^&#]+)', 1) <> '' THEN CASE WHEN prefix(url_decode(regexp_extract(u, '[?&]url=([^&#]+)', 1)), 'http') THEN url_decode(regexp_extract(u, '[?&]url=([^&#]+)', 1)) ELSE {ORIGIN.format('u')} || url_decode(regexp_extract(u, '[?&]url=([^&#]+)', 1)) END ELSE u END",
    f"CASE WHEN contains(u, '/cdn-cgi/image/') THEN CASE WHEN prefix(regexp_extract(u, '/cdn-cgi/image/[^/]+/([^?#]+)', 1), 'http') THEN url_decode(regexp_extract(u, '/cdn-cgi/image/[^/]+/([^?#]+)', 1)) ELSE {ORIGIN.format('u')} || '/' || regexp_extract(u, '/cdn-cgi/image/[^/]+/([^?#]+)', 1) END ELSE u END",
    f"CASE WHEN contains(u, '.imgix.net') OR contains(u, 'imgix.com') THEN {without('u', ['w', 'h', 'fit', 'crop', 'auto', 'q', 'dpr', 'blur'])} ELSE u END",
    "CASE WHEN contains(u, '/uploads/') THEN regexp_replace(u, '-\\d+x\\d+(\\.[a-zA-Z]+)$', '\\1') ELSE u END",
    "CASE WHEN contains(u, 'miro.medium.com') THEN regexp_replace(regexp_replace(regexp_replace(u, '/resize:[^/]+', '', 'g'), '/format:[^/]+', '', 'g'), '/v2/+', '/v2/', 'g') ELSE u END",
    f"CASE WHEN contains(u, 'cdn.shopify.com') THEN regexp_replace({without('u', ['width', 'height', 'crop'])}, '_\\d+x(?:\\d+)?(\\.[a-zA-Z]+)($|[?#])', '\\1\\2') ELSE u END",
]
NORMAL = f"s0 AS (SELECT page_id, width, mime, url, url AS u FROM ({same(IMG_URLS)}))" + "".join(f", s{i + 1} AS (SELECT page_id, width, mime, url, {step} AS u FROM s{i})" for i, step in enumerate(STEPS))
LAST = f"s{len(STEPS)}"


@query("image_url_normalize", f"WITH {NORMAL} SELECT page_id, u AS url FROM {LAST}")
def image_url_normalize(spark, sf_dir):
    return derived(spark, sf_dir, IMG_URLS).select("page_id", U.image_url(F.col("url")).alias("url"))


@query("file_name", f"""
    WITH l AS (SELECT page_id, mime, string_split(regexp_replace(regexp_replace(url, '[?#].*$', ''), '^[a-z]+://[^/]*', ''), '/')[-1] AS f FROM ({same(IMG_URLS)}))
    SELECT page_id, CASE WHEN contains(f, '.') THEN f ELSE 'image.' || CASE mime WHEN 'image/png' THEN 'png' WHEN 'image/gif' THEN 'gif' WHEN 'image/webp' THEN 'webp' ELSE 'jpg' END END AS name FROM l""")  # fmt: skip
def file_name(spark, sf_dir):
    return derived(spark, sf_dir, IMG_URLS).select("page_id", U.file_name(F.col("url"), F.col("mime")).alias("name"))


@query("weibo_image_filter", f"""
    SELECT page_id, url FROM ({same(IMG_URLS)}) WHERE regexp_matches(lower(regexp_extract(url, '^https?://([^/?#:]*)', 1)), '^(wx|ww)[^.]*\\.sinaimg\\.cn$') AND width >= 80
      AND NOT regexp_matches(url, '(?i)/images/default_[^/]+\\.(gif|png|jpe?g)(?:[#?].*)?$|default_w_')""")  # fmt: skip
def weibo_image_filter(spark, sf_dir):
    return derived(spark, sf_dir, IMG_URLS).where(U.weibo_image(F.col("url"), F.col("width"), F.lit(None).cast("int"))).select("page_id", "url")


SIZES = ["large", "mw2000", "orj1080", "mw1024", "mw690", "orj480", "orj360", "bmiddle", "thumbnail"]


@query("weibo_size_candidates", f"""
    WITH w AS (SELECT page_id, regexp_extract(url, '^(https?://[^/]+)/([^/?#]+)/([^?#]+)(.*)$', ['host', 'size', 'file', 'rest']) AS p FROM ({same(IMG_URLS)}) WHERE contains(url, 'sinaimg.cn')),
    c AS (SELECT page_id, p, unnest({SIZES}) AS size, unnest([0, 1, 2, 3, 4, 6, 7, 8, 9]) AS o FROM w UNION ALL SELECT page_id, p, p.size, 5 FROM w WHERE p.size NOT IN ({", ".join(f"'{s}'" for s in SIZES)}))
    SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY o) - 1 AS ord, concat(p.host, '/', size, '/', p.file, p.rest) AS url FROM c""")  # fmt: skip
def weibo_size_candidates(spark, sf_dir):
    rows = derived(spark, sf_dir, IMG_URLS).where(F.col("url").contains("sinaimg.cn"))
    return rows.select("page_id", F.posexplode(U.size_candidates(F.col("url"))).alias("ord", "url"))


#: Image tags with lazy attributes, sets of sources, classes and sizes.
IMG_TAGS = """
SELECT page_id, page_id % 4 AS ord, CASE page_id % 5 WHEN 0 THEN concat('https://l.example.com/', CAST(page_id AS STRING), '.jpg') ELSE '' END AS data_src,
  CASE page_id % 3 WHEN 0 THEN 'data:image/gif;base64,R0' WHEN 1 THEN concat('https://s.example.com/', CAST(page_id AS STRING), '.jpg') ELSE '' END AS src,
  CASE page_id % 4 WHEN 0 THEN '' WHEN 1 THEN 'https://i.example.com/a,b.jpg 300w, https://i.example.com/c,d.jpg 1200w' WHEN 2 THEN 'https://i.example.com/e.jpg 1x, https://i.example.com/f.jpg 2x' ELSE 'https://i.example.com/only.jpg' END AS srcset,
  CASE page_id % 7 WHEN 0 THEN 'avatar round' WHEN 1 THEN 'user-icon' WHEN 2 THEN 'hero' ELSE '' END AS class,
  CASE page_id % 6 WHEN 0 THEN 'Author photo' WHEN 1 THEN 'decorative line' WHEN 2 THEN 'A view' ELSE '' END AS alt,
  CASE page_id % 8 WHEN 0 THEN 40 WHEN 5 THEN 0 WHEN 6 THEN 300 ELSE 640 END AS width, CASE page_id % 8 WHEN 0 THEN 40 WHEN 5 THEN NULL ELSE 480 END AS height FROM {pages}"""

BEST = """
    parts AS (SELECT page_id, regexp_extract_all(srcset, '\\S+(?:\\s+\\d+(?:\\.\\d+)?[wx])?') AS a FROM ({tags}) WHERE srcset <> ''),
    one AS (SELECT page_id, unnest(a) AS p, unnest(generate_series(0, len(a) - 1)) AS i FROM parts),
    sized AS (SELECT page_id, i, regexp_replace(regexp_replace(p, '^,', ''), '\\s+\\d+(\\.\\d+)?[wx]$', '') AS url, coalesce(TRY_CAST(regexp_extract(p, '\\s(\\d+(?:\\.\\d+)?)[wx]$', 1) AS DOUBLE), 0) AS w FROM one),
    best AS (SELECT page_id, first(url ORDER BY w DESC, i) AS best FROM sized WHERE url <> '' GROUP BY page_id)""".replace("{tags}", same(IMG_TAGS))  # fmt: skip


@query("srcset_best", f"WITH {BEST} SELECT page_id, best AS url FROM best")
def srcset_best(spark, sf_dir):
    return derived(spark, sf_dir, IMG_TAGS).where("srcset <> ''").select("page_id", U.srcset_best(F.col("srcset")).alias("url"))


@query("image_src_pick", f"""
    WITH {BEST} SELECT page_id, CASE WHEN data_src <> '' THEN data_src WHEN src <> '' AND NOT prefix(src, 'data:') THEN src ELSE coalesce(best, '') END AS url,
      CASE WHEN data_src <> '' THEN 'lazy' WHEN src <> '' AND NOT prefix(src, 'data:') THEN 'img' WHEN best IS NOT NULL THEN 'srcset' ELSE 'none' END AS kind
    FROM ({same(IMG_TAGS)}) LEFT JOIN best USING (page_id)""")  # fmt: skip
def image_src_pick(spark, sf_dir):
    real = lambda c: F.when((F.col(c) != "") & ~F.col(c).startswith("data:"), F.col(c))
    best = F.when(F.col("srcset") != "", U.srcset_best(F.col("srcset")))
    rows = derived(spark, sf_dir, IMG_TAGS)
    url = F.coalesce(real("data_src"), real("src"), best, F.lit(""))
    kind = F.when(real("data_src").isNotNull(), "lazy").when(real("src").isNotNull(), "img").when(best.isNotNull(), "srcset").otherwise("none")
    return rows.select("page_id", url.alias("url"), kind.alias("kind"))


#: Tags that name an image in each way, and in several.
_LAZY = " ".join(f"WHEN {i} THEN concat(' {name}=\"https://l.example.com/', CAST(page_id AS STRING), '.jpg\"')" for i, name in enumerate(U.LAZY))
TAGGED = f"""SELECT page_id, concat('<img', CASE page_id % 13 {_LAZY} WHEN 7 THEN ' data-src="data:image/gif;base64,AA" data-hires="https://h.example.com/x.png"' ELSE '' END, CASE page_id % 4 WHEN 0 THEN ' src="data:image/png;base64,AA"' WHEN 1 THEN concat(' src="', url, '"') ELSE '' END,
  CASE page_id % 3 WHEN 0 THEN ' srcset="https://s.example.com/1.jpg 100w, https://s.example.com/2.jpg 300w"' WHEN 1 THEN ' data-srcset="https://d.example.com/9.jpg 2x"' ELSE '' END, ' alt="x">') AS tag FROM {{pages}}"""


def _own(name: str) -> str:
    return f"regexp_extract(tag, '(?i)\\s{name}\\s*=\\s*[\"'']([^\"'']*)[\"'']', 1)"


_REAL = lambda x: f"CASE WHEN {x} <> '' AND NOT prefix({x}, 'data:') THEN {x} END"


@query("image_tag_source", f"""
    WITH t AS (SELECT page_id, tag, coalesce({', '.join(_REAL(_own(n)) for n in U.LAZY)}) AS lazy, {_REAL(_own('src'))} AS src, {_own('srcset')} AS a, {_own('data-srcset')} AS b FROM ({same(TAGGED)})),
    s AS (SELECT *, CASE WHEN a <> '' THEN 'https://s.example.com/2.jpg' WHEN b <> '' THEN 'https://d.example.com/9.jpg' END AS sets FROM t)
    SELECT page_id, coalesce(lazy, src, sets, '') AS url, CASE WHEN lazy IS NOT NULL THEN 'lazy' WHEN src IS NOT NULL THEN 'img' WHEN sets IS NOT NULL THEN 'srcset' ELSE 'none' END AS kind FROM s""")  # fmt: skip
def image_tag_source(spark, sf_dir):
    return derived(spark, sf_dir, TAGGED).select("page_id", U.image_source(F.col("tag")).alias("s")).select("page_id", "s.url", "s.kind")


AVATAR = r"(?i)\bavatar\b|\bheadshot\b|\bportrait\b|\bprofile\s*(pic|photo|image|picture)\b|\bauthor\s*(photo|image|picture)\b"
DECOR = r"(?i)\bbackground\b|\bsidecta\b|\bdecorative\b|\bbg[-_]?image\b|\bcta[-_]?(bg|background)\b"
CLASSES = r"(?i)avatar|profile-pic|author-img|headshot|portrait|author|bio|user-icon|profile"


@query("image_attr_filter", f"""
    SELECT page_id FROM ({same(IMG_TAGS)}) WHERE NOT regexp_matches(alt, '{AVATAR}') AND NOT regexp_matches(alt, '{DECOR}') AND NOT regexp_matches(class, '{CLASSES}') AND NOT coalesce(width <= 50 AND height <= 50, false)""")  # fmt: skip
def image_attr_filter(spark, sf_dir):
    rows = derived(spark, sf_dir, IMG_TAGS)
    return rows.where(~F.col("alt").rlike(AVATAR) & ~F.col("alt").rlike(DECOR) & ~F.col("class").rlike(CLASSES) & ~F.coalesce((F.col("width") <= 50) & (F.col("height") <= 50), F.lit(False))).select("page_id")


@query("image_after_title", f"""
    WITH t AS (SELECT page_id // 4 AS clip, page_id, ord, src, class, width, height FROM ({same(IMG_TAGS)})),
    n AS (SELECT *, row_number() OVER (PARTITION BY clip ORDER BY ord) AS n FROM t WHERE ord > 0 AND (width > 300 AND height > 150 OR coalesce(width, 0) = 0 AND coalesce(height, 0) = 0) AND NOT regexp_matches(lower(class), 'avatar|icon|author'))
    SELECT clip, page_id, src FROM n WHERE n = 1""")  # fmt: skip
def image_after_title(spark, sf_dir):
    rows = derived(spark, sf_dir, IMG_TAGS).withColumn("clip", F.floor(F.col("page_id") / 4)).where("ord > 0 and (width > 300 and height > 150 or coalesce(width, 0) = 0 and coalesce(height, 0) = 0)").where(~F.lower("class").rlike("avatar|icon|author"))
    n = F.row_number().over(Window.partitionBy("clip").orderBy("ord"))
    return rows.withColumn("n", n).where("n = 1").select("clip", "page_id", "src")


@query("missing_image_anti", f"""
    WITH {NORMAL} SELECT a.page_id, a.u AS url FROM {LAST} a WHERE a.u NOT IN (SELECT u FROM {LAST} WHERE page_id % 3 = 0)""")  # fmt: skip
def missing_image_anti(spark, sf_dir):
    rows = derived(spark, sf_dir, IMG_URLS).select("page_id", U.image_url(F.col("url")).alias("url"))
    there = rows.where("page_id % 3 = 0").select(F.col("url").alias("known")).distinct()
    return rows.join(there, F.col("url") == F.col("known"), "left_anti")


@query("retained_images", f"""
    WITH {NORMAL}, k AS (SELECT DISTINCT u FROM {LAST} WHERE page_id % 2 = 0), n AS (SELECT page_id, u, row_number() OVER (PARTITION BY u ORDER BY page_id) AS n FROM {LAST})
    SELECT page_id, u AS url FROM n WHERE n = 1 AND u IN (SELECT u FROM k)""")  # fmt: skip
def retained_images(spark, sf_dir):
    from quillmill.operators.sequences import first_of_each

    rows = derived(spark, sf_dir, IMG_URLS).select("page_id", U.image_url(F.col("url")).alias("url"))
    edited = rows.where("page_id % 2 = 0").select(F.col("url").alias("kept")).distinct()
    return first_of_each(rows, ["url"], ["page_id"]).join(edited, F.col("url") == F.col("kept"), "left_semi")


CARDS = """SELECT page_id, CASE page_id % 5 WHEN 0 THEN '' WHEN 1 THEN url WHEN 2 THEN 'sub.example.com' WHEN 3 THEN 'example.com/path' ELSE concat('Card row ', CAST(page_id AS STRING)) END AS line FROM {pages}"""


@query("card_meta_filter", f"""
    SELECT page_id, line FROM ({same(CARDS)}) WHERE NOT ({ws('line')} = '' OR regexp_matches({ws('line')}, '(?i)^https?://\\S+$') OR regexp_matches({ws('line')}, '(?i)^(?:[a-z0-9-]+\\.)+[a-z]{{2,}}(?:/\\S*)?$'))""")  # fmt: skip
def card_meta_filter(spark, sf_dir):
    return derived(spark, sf_dir, CARDS).where(~U.card_metadata(F.col("line")))


@query("image_match_keys", f"""
    WITH b AS (SELECT page_id, url, regexp_replace(url, '[?#].*$', '') AS bare FROM ({same(IMG_URLS)}))
    SELECT page_id, 0 AS tier, url AS key FROM b UNION ALL SELECT page_id, 1, bare FROM b UNION ALL SELECT page_id, 2, regexp_replace(bare, '/\\d{{1,4}}$', '') FROM b
    UNION ALL SELECT page_id, 3, regexp_extract(url, '(\\d\\*\\w+)', 1) FROM b WHERE regexp_matches(url, '\\d\\*\\w+')
    UNION ALL SELECT page_id, 4, string_split(bare, '/')[-1] FROM b WHERE length(string_split(bare, '/')[-1]) > 5""")  # fmt: skip
def image_match_keys(spark, sf_dir):
    bare = F.regexp_replace("url", r"[?#].*$", "")
    last = F.element_at(F.split(bare, "/"), -1)
    star = F.regexp_extract("url", r"(\d\*\w+)", 1)
    keys = [F.col("url"), bare, F.regexp_replace(bare, r"/\d{1,4}$", ""), F.when(star != "", star), F.when(F.length(last) > 5, last)]
    rows = derived(spark, sf_dir, IMG_URLS).select("page_id", F.posexplode(F.array(*keys)).alias("tier", "key"))
    return rows.where("key is not null")
