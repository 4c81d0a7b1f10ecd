"""Queries of the page parser, the platform hints and the robots test.

The pages table has no HTML; a page is written as HTML from its columns by native expressions and parsed back.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import hints
from ..functions import text as X
from ..operators import html as H
from ..sources.tables import spread, table


def _escape(c):
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), "&", "&amp;"), "<", "&lt;"), '"', "&quot;")


def as_html(pages):
    """HTML of each page: head with title, description, language and date, furniture around, one paragraph per line."""
    paragraphs = F.array_join(F.transform(F.split(_escape(F.col("content")), "\n"), lambda x: F.concat(F.lit("<p>"), x, F.lit("</p>"))), "\n")
    body = F.concat(
        F.lit('<html lang="'), _escape(F.col("language")), F.lit('"><head><title>'), _escape(F.col("title")), F.lit('</title><meta name="description" content="'), _escape(F.col("description")),
        F.lit('"><meta property="article:published_time" content="'), F.coalesce(F.date_format("published_at", "yyyy-MM-dd HH:mm:ss"), F.lit("")), F.lit('"><link rel="canonical" href="'), _escape(F.col("url")),
        F.lit('"></head><body><nav><a href="/about">x</a><a href="/login">in</a><a href="#top">t</a></nav><main><h1>'), _escape(F.col("h1")), F.lit("</h1><article>"), paragraphs, F.lit('</article></main><footer><img src="/pic.png" alt="a"><img src="data:x"></footer></body></html>'),
    )
    return pages.select("page_id", "url", body.alias("html"))


def _parsed(spark, root):
    rows = as_html(table(spark, root, "pages")).withColumn("url", F.concat("url", F.lit("#"), "page_id"))
    return H.parse_pages(spread(rows)).withColumn("page_id", F.regexp_extract("url", "#([0-9]+)$", 1).cast("long"))


def ex1_parse(spark, root):
    p = _parsed(spark, root)
    return p.select("page_id", "title", "description", F.date_format("published_at", "yyyy-MM-dd HH:mm:ss").alias("published"), F.array_join(F.transform("links", lambda x: F.regexp_extract(x["url"], "/([a-z]+)$", 1)), ",").alias("links"), F.size("images").alias("images"))


def ex8_main_text(spark, root):
    """Words of the parsed main text; the furniture of the document is gone, every paragraph is there."""
    return _parsed(spark, root).select("page_id", F.length(F.regexp_replace("content", r"\s+", "")).alias("chars"))


def ex3_description(spark, root):
    return _parsed(spark, root).select("page_id", "description", "title")


def ex11_headings(spark, root):
    return _parsed(spark, root).select("page_id", "h1")


def ex13_links(spark, root):
    """Crawlable links: the one to a login and the one to a place on the page are left out."""
    return _parsed(spark, root).select("page_id", F.explode("links").alias("l")).select("page_id", F.col("l.url").alias("link"))


def _varied(spark, root):
    """HTML of each page in one of several markups, by its id: structured data alone, in a graph, in a list, or broken;
    dates, languages, images and canonical addresses in different places."""
    pages = table(spark, root, "pages")
    day = F.date_format("published_at", "yyyy-MM-dd")
    own = F.struct(F.lit("NewsArticle").alias("@type"), F.col("title").alias("headline"), F.struct(F.col("schema_author").alias("name")).alias("author"), F.array(F.struct(F.lit("/img/a.png").alias("url"))).alias("image"))
    crumb = F.lit('{"@type":"BreadcrumbList","name":"no"}')
    v = F.col("page_id") % 4
    data = F.when(v == 0, F.to_json(own)).when(v == 1, F.concat(F.lit('{"@graph":['), crumb, F.lit(","), F.to_json(own), F.lit("]}"))).when(v == 2, F.concat(F.lit("["), crumb, F.lit(","), F.to_json(own), F.lit("]"))).otherwise(F.lit('{"@type": broken'))
    w = F.col("page_id") % 5
    when = F.coalesce(
        F.when(w == 0, F.concat(F.lit('<meta name="date" content="'), day, F.lit('">'))).when(w == 1, F.concat(F.lit('<time itemprop="datePublished" datetime="1999-01-02">x</time><time itemprop="datePublished" datetime="'), day, F.lit('">y</time>')))
        .when(w == 2, F.concat(F.lit('<meta property="article:modified_time" content="1995-01-01"><meta itemprop="datePublished" content="'), F.date_format("published_at", "MMMM d, yyyy"), F.lit('">'))).when(w == 3, F.concat(F.lit('<p><time class="x entry-date">'), F.date_format("published_at", "dd/MM/yyyy"), F.lit("</time>"))),
        F.lit('<meta name="date" content="no day">'),
    )
    tag = F.coalesce(F.nullif(F.lower("language"), F.lit("")), F.lit("xx"))
    lang = F.when(v == 0, F.concat(F.lit('<html lang="'), tag, F.lit('">'))).when(v == 1, F.concat(F.lit('<html><meta http-equiv="Content-Language" content="'), tag, F.lit('">'))).when(v == 2, F.concat(F.lit('<html lang="x-long-tag"><meta name="language" content="'), tag, F.lit('">'))).otherwise(F.lit("<html>"))
    body = F.concat(
        lang, F.lit("<head><script type='application/ld+json'>"), data, F.lit("</script>"), when, F.lit('<link rel="canonical" href="/c/'), F.col("page_id").cast("string"), F.lit('"><link rel="canonical" href="mailto:x"><link rel="stylesheet" href="/s.css#top"><script src="//cdn.example/x.js"></script>'),
        F.when(v == 1, F.lit('<meta property="og:image" content="/og.jpg"><meta property="og:title" content="ignored">')).otherwise(F.lit("")), F.lit("<title>"), _escape(F.col("title")),
        F.lit("</title></head><body><p>open<div>text <img src='/a.png' alt=' pic ' width=640 height=480><img src='/a.png'><img src='/tiny.png' width=1 height=1><img src='data:image/png;base64,x'><img src='/doc.pdf'><iframe src='/frame'></iframe><b>unclosed"),
    )
    rows = pages.select("page_id", F.concat(F.lit("https://h.example/p?i="), "page_id").alias("url"), body.alias("html"))
    return H.parse_pages(spread(rows)).withColumn("page_id", F.regexp_extract("url", "=([0-9]+)$", 1).cast("long"))


def ex4_canonical(spark, root):
    """The last canonical address that is one."""
    return _varied(spark, root).select("page_id", "canonical")


def ex5_language(spark, root):
    return _varied(spark, root).select("page_id", "language")


def ex14_resources(spark, root):
    return _varied(spark, root).select("page_id", F.array_join("resources", " ").alias("resources"))


def ex16_images(spark, root):
    return _varied(spark, root).select("page_id", F.posexplode("images").alias("pos", "i")).select("page_id", "pos", "i.url", "i.alt", "i.width")


def ex17_dates(spark, root):
    return _varied(spark, root).select("page_id", F.to_date("published_at").alias("day"))


def ex21_structured(spark, root):
    return _varied(spark, root).select("page_id", "schema_type", "schema_title", "schema_author", "schema_image")


def ex20_dates(spark, root):
    """Publication dates written in several ways and read back."""
    t = F.col("published_at")
    forms = F.array(F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss"), F.date_format(t, "MMMM d, yyyy"), F.date_format(t, "d MMM yyyy"), F.date_format(t, "dd/MM/yyyy"), F.date_format(t, "yyyy/M/d"))
    rows = table(spark, root, "pages").where("published_at is not null and year(published_at) between 1990 and 2100").select("page_id", F.explode(forms).alias("s"))
    return rows.groupBy("page_id").agg(F.min(F.to_date(X.parse_date(F.col("s")))).alias("first"), F.max(F.to_date(X.parse_date(F.col("s")))).alias("last"))


def ex23_resources(spark, root):
    css = F.concat(F.lit("a { background: url('"), "url", F.lit("') } @import ('/x.css')"))
    rows = table(spark, root, "pages").select("page_id", F.explode(H.resource_links(css, F.lit("text/css"))).alias("link"))
    return rows.select("page_id", "link")


def url15_hints(spark, root):
    cases = ["https://www.reddit.com/r/Warframe", "https://reddit.com/r/Warframe/comments/abc/x", "https://github.com/nicbarker/clay", "https://github.com/explore", "https://github.com/a/b/releases/tag/1", "https://www.youtube.com/@name", "https://en.wikipedia.org/wiki/Article", "https://en.wikipedia.org/wiki/Special:Random", "https://stackoverflow.com/questions/1/x", "https://www.npmjs.com/package/@a/b", "https://pypi.org/project/x/1.0", "https://www.amazon.com/dp/B01"]
    extra = spark.createDataFrame([(c,) for c in cases], "url string")
    rows = table(spark, root, "pages").select("url").unionByName(extra).select(hints.classify(F.col("url")).alias("h"))
    return rows.groupBy("h.platform", "h.hub").agg(F.count("*").alias("n"), F.sum("h.boost").alias("boost"), F.sum("h.penalty").alias("penalty"))


def url19_robots(spark, root):
    rows = table(spark, root, "crawl_queue").join(table(spark, root, "domains").select("domain", "robots_txt"), "domain", "left")
    return rows.groupBy(H.robots_allowed("robots_txt", "url", F.lit("webloom")).alias("allowed")).agg(F.count("*").alias("n"))


#: The Cyrillic letters lie in windows-1251 where these letters lie in the Latin encoding.
_CYRILLIC, _AS_BYTES = ("".join(map(chr, range(a, a + 64))) for a in (0x410, 0xC0))


def src9_decoded(spark, root):
    """Titles as bytes in the first old encoding that can write them, decoded by the declared one."""
    t = F.coalesce("title", F.lit(""))
    # Bytes that happen to be sound UTF-8 are read as such, whatever is declared; such titles are written in UTF-8.
    latin, cyrillic = ~t.rlike("[^\\x00-\\x7f\\xa0-\\xff]|[\\xc2-\\xf4][\\x80-\\xbf]"), ~t.rlike("[^\\x00-\\x7f\u0410-\u044f]")
    raw = F.when(latin, F.encode(t, "ISO-8859-1")).when(cyrillic, F.encode(F.translate(t, _CYRILLIC, _AS_BYTES), "ISO-8859-1")).otherwise(F.encode(t, "UTF-8"))
    name = F.when(latin, "iso-8859-1").when(cyrillic, "windows-1251").otherwise("utf-8")
    return table(spark, root, "pages").select("page_id", H.decoded(raw, F.concat(F.lit("text/html; charset="), name)).alias("title"))


QUERIES = {f.__name__: f for f in (ex1_parse, ex8_main_text, ex3_description, ex11_headings, ex13_links, ex4_canonical, ex5_language, ex14_resources, ex16_images, ex17_dates, ex21_structured, ex20_dates, ex23_resources, url15_hints, url19_robots, src9_decoded)}

_WS = r"[\s\x{a0}\x{85}\x1c-\x1f\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
_ESC = "replace(replace(replace(coalesce({x}, ''), '&', '&amp;'), '<', '&lt;'), '\"', '&quot;')"
_SQUEEZED = "trim(regexp_replace(coalesce({x}, ''), '" + _WS + "', ' ', 'g'))"
ORACLES = {
    "ex1_parse": f"""SELECT page_id, {_SQUEEZED.replace('{x}', 'title')} AS title, {_SQUEEZED.replace('{x}', 'description')} AS description, strftime(published_at, '%Y-%m-%d %H:%M:%S') AS published, 'about' AS links, CAST(1 AS INTEGER) AS images FROM pages""",
    "ex8_main_text": rf"""SELECT page_id, CAST(length(regexp_replace(coalesce(content, ''), '{_WS}', '', 'g')) AS INTEGER) + CASE WHEN strlen({_SQUEEZED.replace('{x}', 'content')}) <= 100 THEN length(regexp_replace(coalesce(h1, ''), '{_WS}', '', 'g')) ELSE 0 END AS chars FROM pages""",
    "ex3_description": f"SELECT page_id, {_SQUEEZED.replace('{x}', 'description')} AS description, {_SQUEEZED.replace('{x}', 'title')} AS title FROM pages",
    "ex11_headings": f"SELECT page_id, CASE WHEN {_SQUEEZED.replace('{x}', 'h1')} <> '' OR strlen({_SQUEEZED.replace('{x}', 'content')}) <= 100 THEN {_SQUEEZED.replace('{x}', 'h1')} ELSE {_SQUEEZED.replace('{x}', 'title')} END AS h1 FROM pages",
    "ex13_links": "SELECT page_id, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) || '://' || regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1) || '/about' AS link FROM pages",
    "ex4_canonical": "SELECT page_id, 'https://h.example/c/' || page_id AS canonical FROM pages",
    "ex5_language": """SELECT page_id, CASE WHEN page_id % 4 = 3 THEN '' ELSE CASE WHEN strlen(t) BETWEEN 2 AND 3 THEN t ELSE '' END END AS language FROM (SELECT page_id, trim(regexp_extract(coalesce(nullif(lower(language), ''), 'xx'), '^([^-_]*)', 1)) AS t FROM pages)""",
    "ex14_resources": "SELECT page_id, 'https://cdn.example/x.js https://h.example/c/' || page_id || ' https://h.example/s.css https://h.example/frame' AS resources FROM pages",
    "ex16_images": f"""SELECT page_id, CAST(CASE WHEN page_id % 4 = 1 THEN k ELSE k - 1 END AS INTEGER) AS pos, CASE k WHEN 0 THEN 'https://h.example/og.jpg' ELSE 'https://h.example/a.png' END AS url, CASE k WHEN 0 THEN {_SQUEEZED.replace('{x}', 'title')} ELSE 'pic' END AS alt, CASE k WHEN 0 THEN 0 ELSE 640 END AS width
        FROM pages, (VALUES (0), (1)) t(k) WHERE k = 1 OR page_id % 4 = 1""",
    "ex17_dates": "SELECT page_id, CASE WHEN page_id % 5 < 4 AND year(published_at) BETWEEN 1990 AND 2100 THEN CAST(published_at AS DATE) END AS day FROM pages",
    "ex21_structured": """SELECT page_id, CASE WHEN v < 3 THEN 'NewsArticle' ELSE '' END AS schema_type, CASE WHEN v < 3 THEN trim(coalesce(title, ''), ' 	
') ELSE '' END AS schema_title, CASE WHEN v < 3 THEN trim(coalesce(schema_author, '')) ELSE '' END AS schema_author,
        CASE WHEN v < 3 THEN 'https://h.example/img/a.png' ELSE '' END AS schema_image FROM (SELECT *, page_id % 4 AS v FROM pages)""",
    "src9_decoded": "SELECT page_id, coalesce(title, '') AS title FROM pages",
    "ex20_dates": "SELECT page_id, CAST(published_at AS DATE) AS first, CAST(published_at AS DATE) AS last FROM pages WHERE published_at IS NOT NULL AND year(published_at) BETWEEN 1990 AND 2100",
    "ex23_resources": "SELECT page_id, unnest([trim(url), '/x.css']) AS link FROM pages",
    "url15_hints": """SELECT * FROM (VALUES ('', false, (SELECT count(*) FROM pages), 0.0::DOUBLE, 0.0::DOUBLE), ('reddit', true, 1, 6000, 0), ('reddit', false, 1, 0, 2500), ('github', true, 1, 6000, 0), ('github', false, 2, 0, 4000), ('youtube', true, 1, 6000, 0),
        ('wikipedia', true, 1, 4000, 0), ('wikipedia', false, 1, 0, 4000), ('stackoverflow', true, 1, 4000, 0), ('npm', true, 1, 6000, 0), ('pypi', false, 1, 0, 2500), ('amazon', true, 1, 4000, 0)) t(platform, hub, n, boost, penalty)""",
}
