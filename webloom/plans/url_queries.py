"""Queries on addresses: projection and filter operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import urls as U
from ..sources import table

_HOST = "lower(regexp_replace(regexp_replace(regexp_extract({u}, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1), '^[^@]*@', ''), ':[0-9]*$', ''))"
_SQL_PATH = "regexp_extract({u}, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)"
_SQL_QUERY = "regexp_extract({u}, '^[^?#]*[?]([^#]*)', 1)"
HOST, PATH, QUERY = (x.format(u="url") for x in (_HOST, _SQL_PATH, _SQL_QUERY))
EXT = f"lower(regexp_extract({PATH}, '([.][^./]*)$', 1))"
_list = lambda xs: ", ".join(f"'{x}'" for x in xs)
DROP = f"(k = '' OR regexp_matches(k, '^(utm_|_hs|mkt_|x-amz-)|token|session|signature') OR k IN ({_list(U.TRACKING + U.VIEW_STATE)}))"


def _pages(spark, root):
    return table(spark, root, "pages")


def url1_canonical(spark, root):
    u = F.col("url")
    return _pages(spark, root).select("page_id", U.canonical(u).alias("canonical"), U.domain(u).alias("site"))


def url2_params(spark, root):
    pairs = _pages(spark, root).select(F.explode(F.split(U.query(F.col("url")), "&")).alias("p")).where("p <> ''")
    keys = pairs.select(F.regexp_extract("p", "^([^=]*)", 1).alias("key"))
    return keys.groupBy("key").agg(F.count("*").alias("n")).select("key", "n", U.drop_param(F.col("key")).alias("dropped"), U.drop_param_cosmetic(F.col("key")).alias("cosmetic"))


def url5_fingerprint(spark, root):
    return _pages(spark, root).select("page_id", U.fingerprint(F.col("url")).alias("fingerprint"))


def url6_hash(spark, root):
    return _pages(spark, root).select("page_id", U.fnv1a(F.col("url")).alias("h"))


def url7_extensions(spark, root):
    u = F.col("url")
    rows = _pages(spark, root).select(U.extension(u).alias("ext"), U.is_binary(u).alias("binary"), U.is_asset(u).alias("asset"), U.is_image(u).alias("image"), U.non_indexable(u).alias("skip"))
    return rows.groupBy("ext", "binary", "asset", "image", "skip").agg(F.count("*").alias("n"))


def url8_disallowed(spark, root):
    return _pages(spark, root).select("page_id", U.disallowed_path(U.path(F.col("url"))).alias("disallowed"))


def url10_blocked(spark, root):
    """Pages of sites in a block list, by the site or any parent: a join on the exploded parents."""
    block = spark.createDataFrame([("gallebury-wiki.example",), ("norley-shop.example",), ("halsaness.example",)], "blocked string")
    rows = _pages(spark, root).where("domain <> ''").select("page_id", F.explode(U.parents(F.col("domain"))).alias("blocked"))
    return rows.join(F.broadcast(block), "blocked", "left_semi").select("page_id").distinct()


def url11_serp(spark, root):
    cases = ["https://www.google.com/search?q=a", "https://google.de/imgres?x=1", "https://bing.com/search?q=b", "https://bing.com/maps", "https://duckduckgo.com/?q=z", "https://duckduckgo.com/about", "https://search.yahoo.com/search?p=1",
             "https://yandex.ru/search?text=1", "https://baidu.com/s?wd=1", "https://metager.org/meta/meta.ger3", "https://my-searx.org/search?q=1", "https://x.org/search?q=1&categories=a", "https://x.org/?q=1&tbm=isch", "https://x.org/?q=1", "https://www.startpage.com/sp/search"]
    extra = spark.createDataFrame([(c,) for c in cases], "url string")
    return _pages(spark, root).select("url").unionByName(extra).groupBy(U.search_results_page(F.col("url")).alias("serp")).agg(F.count("*").alias("n"))


def url12_homepages(spark, root):
    u = F.col("url")
    return _pages(spark, root).groupBy(U.is_homepage(u).alias("homepage"), U.registered_domain(U.domain(u)).alias("registered"), U.root_label(U.domain(u)).alias("label")).agg(F.count("*").alias("n"))


def url16_types(spark, root):
    ct = F.col("content_type")
    return table(spark, root, "fetch_log").groupBy("content_type").agg(F.count("*").alias("n")).select("content_type", "n", U.html_type(ct).alias("html"), U.discovery_type(ct).alias("discovery"), U.asset_kind(ct).alias("kind"))


def url17_fresh(spark, root):
    """Addresses of the queue that were not crawled in the day before the latest crawl."""
    pages = _pages(spark, root)
    last = pages.agg(F.max("crawled_at").alias("now"))
    fresh = pages.crossJoin(F.broadcast(last)).where(F.expr("crawled_at >= now - interval 24 hours")).select("url")
    return table(spark, root, "crawl_queue").join(fresh, "url", "left_anti").select("queue_id")


def url18_existing(spark, root):
    return table(spark, root, "crawl_queue").select("queue_id", "url").join(_pages(spark, root).select("url").distinct(), "url", "left_semi").select("queue_id")


def ex6_language_tags(spark, root):
    return _pages(spark, root).groupBy("language").agg(F.count("*").alias("n")).select("language", "n", U.language_tag(F.col("language")).alias("tag"))


def ex7_url_language(spark, root):
    return _pages(spark, root).groupBy(U.language_of_url(F.col("url")).alias("lang")).agg(F.count("*").alias("n"))


def ex19_url_dates(spark, root):
    """Dates in addresses; the pages' addresses with their crawl date put in front of the last part."""
    u = F.concat(F.col("url"), F.date_format("crawled_at", "/yyyy/MM/dd/"), F.lit("x"))
    return _pages(spark, root).where("crawled_at is not null and instr(url, '?') = 0").select("page_id", U.date_of_url(u).alias("d"))


def ex26_region(spark, root):
    return _pages(spark, root).groupBy("domain").agg(F.count("*").alias("n")).select("domain", U.region(F.concat("domain", F.lit(".uy"))).alias("region"), U.region(F.col("domain")).alias("plain"))


def hp16_blocked_patterns(spark, root):
    rows = [(p, n) for n, images in (("without_images", False), ("with_images", True)) for p in U.blocked_patterns(images)]
    return spark.createDataFrame(rows, "pattern string, kind string").groupBy("kind").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (url1_canonical, url2_params, url5_fingerprint, url6_hash, url7_extensions, url8_disallowed, url10_blocked, url11_serp, url12_homepages, url16_types, url17_fresh, url18_existing, ex6_language_tags, ex7_url_language, ex19_url_dates, ex26_region, hp16_blocked_patterns)}

_CANON = f"""CASE WHEN lower(regexp_extract(trim(url), '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) IN ('http', 'https') THEN
  lower(regexp_extract(trim(url), '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) || '://' || {HOST}
  || CASE WHEN regexp_replace({PATH}, '/+$', '') = '' THEN '/' ELSE regexp_replace({PATH}, '/+$', '') END
  || coalesce('?' || nullif((SELECT string_agg(p || CASE WHEN p LIKE '%=%' THEN '' ELSE '=' END, '&' ORDER BY regexp_extract(p, '^([^=]*)', 1), p)
      FROM (SELECT unnest(string_split({QUERY}, '&')) AS p) s, LATERAL (SELECT lower(trim(regexp_extract(p, '^([^=]*)', 1))) AS k) z WHERE p <> '' AND NOT {DROP}), ''), '') END"""
_SEG = r"""CASE WHEN regexp_full_match(x, '[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}') THEN '{uuid}'
  WHEN regexp_full_match(x, '[0-9a-fA-F]{64}') AND regexp_matches(x, '[a-fA-F]') THEN '{sha256}' WHEN regexp_full_match(x, '[0-9a-fA-F]{40}') AND regexp_matches(x, '[a-fA-F]') THEN '{sha1}'
  WHEN regexp_full_match(x, '[0-9a-fA-F]{32}') AND regexp_matches(x, '[a-fA-F]') THEN '{md5}' WHEN regexp_full_match(x, '[0-9a-fA-F]{24}') AND regexp_matches(x, '[a-fA-F]') THEN '{oid}'
  WHEN regexp_full_match(x, '[0-9a-fA-F]{8,}') AND regexp_matches(x, '[a-fA-F]') THEN '{hex}' WHEN regexp_full_match(x, '[0-9]{4}-[0-9]{2}-[0-9]{2}') THEN '{date}'
  WHEN regexp_full_match(x, '[0-9]{10}([0-9]{3})?') THEN '{ts}' WHEN regexp_full_match(x, '[0-9]+') THEN '{num}' ELSE x END"""
_INNER = f"regexp_replace({PATH}, '^/+|/+$', '', 'g')"

ORACLES = {
    "url1_canonical": f"SELECT page_id, {_CANON} AS canonical, regexp_replace({HOST}, '^www[.]', '') AS site FROM pages",
    "url2_params": f"""WITH p AS (SELECT regexp_extract(p, '^([^=]*)', 1) AS key FROM (SELECT unnest(string_split({QUERY}, '&')) AS p FROM pages) WHERE p <> '')
        SELECT key, CAST(count(*) AS BIGINT) AS n, any_value({DROP}) AS dropped, any_value(k = '' OR regexp_matches(k, '^(utm_|_hs|mkt_|x-amz-)|token|session|signature') OR k IN ({_list(U.TRACKING)})) AS cosmetic
        FROM (SELECT key, lower(trim(key)) AS k FROM p) GROUP BY key""",
    "url5_fingerprint": f"""SELECT page_id, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) || '://' || regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)
        || CASE WHEN {_INNER} = '' THEN {PATH} ELSE '/' || array_to_string(list_transform(string_split({_INNER}, '/'), lambda x: {_SEG}), '/') || CASE WHEN {PATH} LIKE '%/' THEN '/' ELSE '' END END
        || coalesce('?' || nullif(array_to_string(list_sort(list_distinct(list_transform(list_filter(string_split({QUERY}, '&'), lambda x: x <> ''), lambda x: regexp_extract(x, '^([^=]*)', 1)))), '&'), ''), '') AS fingerprint FROM pages""",
    "url6_hash": "SELECT page_id, url_hash AS h FROM pages",
    "url7_extensions": f"""WITH e AS (SELECT {EXT} AS ext, {PATH} AS path FROM pages), c AS (SELECT ext, ext IN ({_list(U.BINARY)}) AS "binary", ext IN ({_list(U.ASSET)}) AS asset, ext = '' OR ext IN ({_list(U.IMAGE)}) AS image,
        regexp_matches(lower(path), '^({"|".join(U.NO_CONTENT)})') OR regexp_matches(lower(path), '{"|".join(U.CHALLENGE)}') AS bad FROM e)
        SELECT ext, "binary", asset, image, "binary" OR asset OR bad AS skip, CAST(count(*) AS BIGINT) AS n FROM c GROUP BY ALL""",
    "url8_disallowed": f"SELECT page_id, regexp_matches(lower({PATH}), '^({'|'.join(U.NO_CONTENT)})') OR regexp_matches(lower({PATH}), '{'|'.join(U.CHALLENGE)}') AS disallowed FROM pages",
    "url10_blocked": """SELECT DISTINCT page_id FROM pages, (VALUES ('gallebury-wiki.example'), ('norley-shop.example'), ('halsaness.example')) b(x) WHERE domain <> '' AND (domain = x OR domain LIKE '%.' || x)""",
    "url11_serp": "SELECT * FROM (VALUES (true, CAST(12 AS BIGINT)), (false, (SELECT count(*) FROM pages) + 3)) t(serp, n)",
    "url12_homepages": f"""WITH h AS (SELECT regexp_replace({HOST}, '^www[.]', '') AS d, {_INNER} AS p, {QUERY} AS q, regexp_extract(url, '#(.*)$', 1) AS f FROM pages)
        SELECT q = '' AND f = '' AND (p = '' OR regexp_full_match(p, '[a-z]{{2}}(-[a-zA-Z0-9]{{2,4}})?')) AS homepage, regexp_extract(d, '([^.]*[.][^.]*)$', 1) AS registered, regexp_extract(d, '([^.]*)[.][^.]*$', 1) AS label, CAST(count(*) AS BIGINT) AS n FROM h GROUP BY ALL""",
    "url16_types": """WITH c AS (SELECT content_type, lower(coalesce(content_type, '')) AS l, CAST(count(*) AS BIGINT) AS n FROM fetch_log GROUP BY 1)
        SELECT content_type, n, l LIKE '%text/html%' OR l LIKE '%application/xhtml+xml%' AS html, regexp_matches(l, 'text/html|application/xhtml[+]xml|text/css|(application|text)/javascript|application/(x-javascript|ecmascript|json|ld[+]json|xml|rss[+]xml|atom[+]xml)|text/xml') AS discovery,
        CASE WHEN l LIKE '%text/css%' THEN 'css' WHEN l LIKE '%javascript%' OR l LIKE '%ecmascript%' THEN 'js' WHEN l LIKE '%json%' THEN 'json' WHEN l LIKE '%rss%' THEN 'rss' WHEN l LIKE '%atom%' THEN 'atom' WHEN l LIKE '%xml%' THEN 'xml' ELSE 'other' END AS kind FROM c""",
    "url17_fresh": "SELECT queue_id FROM crawl_queue q WHERE NOT EXISTS (SELECT 1 FROM pages p WHERE p.url = q.url AND p.crawled_at >= (SELECT max(crawled_at) FROM pages) - INTERVAL 24 HOUR)",
    "url18_existing": "SELECT queue_id FROM crawl_queue WHERE url IN (SELECT url FROM pages)",
    "ex6_language_tags": """SELECT language, CAST(count(*) AS BIGINT) AS n, CASE WHEN language IS NULL THEN '' WHEN strlen(regexp_extract(lower(trim(language)), '^([^-_]*)', 1)) BETWEEN 2 AND 3 THEN regexp_extract(lower(trim(language)), '^([^-_]*)', 1) ELSE '' END AS tag FROM pages GROUP BY language""",
    "ex7_url_language": f"""WITH s AS (SELECT regexp_extract(lower(split_part({_INNER}, '/', 1)), '^([^-_]*)', 1) AS a, CASE WHEN {HOST} LIKE '%.%' THEN regexp_extract(split_part({HOST}, '.', 1), '^([^-_]*)', 1) ELSE '' END AS b FROM pages)
        SELECT CASE WHEN regexp_full_match(a, '[a-z]{{2,3}}') THEN a WHEN b IN ('www', 'm') THEN '' WHEN regexp_full_match(b, '[a-z]{{2,3}}') THEN b ELSE '' END AS lang, CAST(count(*) AS BIGINT) AS n FROM s GROUP BY 1""",
    "ex19_url_dates": "SELECT page_id, CAST(crawled_at AS DATE) AS d FROM pages WHERE crawled_at IS NOT NULL AND url NOT LIKE '%?%'",
    "ex26_region": "SELECT domain, CASE WHEN domain IS NULL THEN '' ELSE 'uy' END AS region, '' AS plain FROM pages GROUP BY domain",
    "hp16_blocked_patterns": "SELECT * FROM (VALUES ('without_images', CAST(180 AS BIGINT)), ('with_images', CAST(236 AS BIGINT))) t(kind, n)",
}
