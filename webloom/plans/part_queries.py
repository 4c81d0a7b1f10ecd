"""Queries of the smaller operators: helpers, parts of scores, joins that update, writes of batches."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..api import Engine
from ..functions import text as X
from ..functions import urls as U
from ..operators import frontier as R
from ..operators import graph as G
from ..operators import profile as P
from ..operators import search as S
from ..operators import storage as W
from ..sources import table
from .search_queries import INDEX, index_of, plain_sql
from .url_queries import HOST, PATH

AS_OF = datetime(2024, 12, 1)
S_NOW = datetime(2024, 6, 1)
WORDS = ["river", "museum", "maps"]
PLATFORMS, SITE_TYPES = frozenset({"reddit", "github"}), frozenset({"noticias", "news", "blog"})


def _t(spark, root, name):
    return table(spark, root, name)


def _images(spark, root):
    """Image rows as the parser would give them: one for each page, by the page's url."""
    return _t(spark, root, "pages").select(F.concat("url", F.lit("#img")).alias("url"), F.col("page_id").alias("source_id"), F.col("title").alias("alt_text"), F.col("description").alias("context"), F.coalesce("crawled_at", F.lit("1970-01-01").cast("timestamp_ntz")).alias("at"))


def snk3_flush(spark, root):
    """A batch of pages and links in one go: upserted pages, ids resolved, their links replaced in the table; rows of each target."""
    pages, links = _t(spark, root, "pages"), _t(spark, root, "links")
    new = W.upsert_pages(pages.select("page_id", "url", "title", "published_at", "crawled_at", "fetch_mode", "ingest_hits", "last_seen_at"))
    ids = pages.select("page_id", "url").join(new.select("url", F.col("page_id").alias("kept")), "url").select(F.col("page_id").alias("source_id"), "kept")
    moved = links.join(ids, "source_id").select(F.col("kept").alias("source_id"), "target_hash", "anchor_text", "created_at")
    out = W.replace_links(links, moved.select("source_id", "target_hash", "anchor_text", "created_at"))
    return new.select(F.lit("pages").alias("what")).unionAll(out.select(F.lit("links"))).groupBy("what").agg(F.count("*").alias("n"))


def snk4_images(spark, root):
    return W.last_write_wins(_images(spark, root), ["url"], [F.col("at"), F.col("source_id")]).select("url", "source_id", "alt_text")


def snk7_resources(spark, root):
    return W.discovered_resources(_t(spark, root, "fetch_log")).select("url", "kind", "status", "last_crawled")


def src2_resources(spark, root):
    """Addresses and shapes of pages and of other resources."""
    return W.known_addresses(_t(spark, root, "pages"), W.discovered_resources(_t(spark, root, "fetch_log")))


def snk6_outlinks(spark, root):
    """Outlinks pushed with a page: http addresses with a host, three at most, as link rows."""
    rows = _t(spark, root, "pages").select("page_id", F.array(F.col("url"), F.lit("ftp://x"), F.lit("https://"), F.concat(F.lit("https://"), "domain"), F.lit("http://a.example/1"), F.lit("http://a.example/2")).alias("out"))
    kept = F.slice(F.filter("out", lambda x: x.rlike("^https?://[^/]+")), 1, 3)
    return rows.select("page_id", F.posexplode(kept).alias("pos", "target")).select("page_id", "pos", "target")


def snk13_index_update(spark, root):
    """Postings after the pages of a year were indexed anew: old postings of their ids go, new ones come."""
    pages = _t(spark, root, "pages")
    changed = pages.where(F.year("crawled_at") == 2024)
    old = index_of(spark, root).postings
    new = old.join(changed.select(F.col("page_id").alias("id")), "id", "left_anti").unionByName(S.build(changed, stem=False).postings)
    return new.groupBy("term").agg(F.count("*").alias("doc"))


def ex12_cut(spark, root):
    return _t(spark, root, "pages").select("page_id", F.octet_length(X.truncated(F.col("content"), 1000)).between(0, 1000).alias("fits"), F.length(X.truncated(F.col("title"), 20)).alias("chars"))


def ex25_persisted(spark, root):
    u = F.col("url")
    return _t(spark, root, "pages").select("page_id", F.sha2(F.coalesce("content", F.lit("")), 256).alias("content_hash"), U.region(U.domain(u)).alias("region"), F.left("title", F.lit(500)).alias("title"))


def url4_domains(spark, root):
    return _t(spark, root, "pages").groupBy(U.domain(F.col("url")).alias("site")).agg(F.count("*").alias("n"))


def url9_indexable(spark, root):
    return _t(spark, root, "crawl_queue").where(~U.non_indexable(F.col("url"))).select("queue_id")


def fd2_retries(spark, root):
    return R.retried(_t(spark, root, "crawl_queue"))


def fd5_backlog(spark, root):
    return R.render_backlog(_t(spark, root, "pages"))


def j7_update(spark, root):
    """Pages with their referring domains set anew; 0 where none link to them."""
    pages = _t(spark, root, "pages")
    ref = G.referring_domains(_t(spark, root, "links"), pages)
    return pages.join(ref, pages["url_hash"] == ref["node"], "left").select("page_id", F.coalesce("referring", F.lit(0)).alias("referring_domains"))


def j8_images(spark, root):
    images = _images(spark, root)
    return images.join(_t(spark, root, "pages").select(F.col("page_id").alias("source_id"), F.col("url").alias("page")), "source_id").groupBy("page").agg(F.count("*").alias("images"))


def j9_lookup(spark, root):
    """Ids of the clicked urls: a semi-join of two tables in place of batched lists."""
    return _t(spark, root, "pages").select("page_id", "url").join(_t(spark, root, "click_log").select("url").distinct(), "url", "left_semi").select("page_id")


def a7_corpus(spark, root):
    return _t(spark, root, "pages").agg(F.max("page_id").alias("max_id"), F.count("*").alias("n"))


def a15_frequencies(spark, root):
    """Counts of a title's words, each cut at four."""
    toks = X.tokens(F.col("title"))
    counted = F.transform(F.array_distinct(toks), lambda w: F.struct(w.alias("word"), F.least(F.size(F.filter(toks, lambda x: x == w)), F.lit(4)).alias("n")))
    return _t(spark, root, "pages").select("page_id", F.explode(counted).alias("c")).select("page_id", "c.word", "c.n")


def w6_first(spark, root):
    return _t(spark, root, "pages").select("page_id", F.array_join(X.first_occurrences(X.tokens(F.col("title"))), " ").alias("words"))


def t1_boosted(spark, root):
    pages = _t(spark, root, "pages")
    found = S.bm25(index_of(spark, root), WORDS, need=1).withColumn("score", F.round("score", 6))
    return S._ordered(found, pages, S.Query("", "", WORDS, WORDS, domain="gallebury-wiki.example"), 40, "page_id")


def t2_order(spark, root):
    rows = _t(spark, root, "pages").select(F.col("page_id").alias("id"), "url", "crawled_at", F.round("pagerank", 1).alias("rank"), U.is_homepage(F.col("url")).alias("homepage"))
    return rows.orderBy(*S.final_order()).limit(50).select(F.col("id").alias("page_id"))


def t10_outlinks(spark, root):
    return Engine(spark, root).outlinks(1).select("source_id", "target", "created_at")


def ft11_domain_tokens(spark, root):
    """Pages whose domain holds at least two of the words."""
    hits = sum((F.lower("domain").contains(w).cast("int") for w in ("wiki", "bury", "gal", "nor")), F.lit(0))
    return _t(spark, root, "pages").where(hits >= 2).select("page_id", hits.alias("hits"))


def ft15_stems(spark, root):
    return _t(spark, root, "pages").select("page_id", F.array_join(X.stems(X.tokens(F.col("title"))), " ").alias("stems"))


def _asked(spark, root):
    """Clicked queries, and some with every kind of intent, parsed by the engine."""
    more = ["reddit warframe", "warframe reddit", "noticias uruguay", "uruguay news today", "example.com", "https://www.shop.example.org/a?b", "elections 2024", "report 12/05/2023", "marzo lluvias", "the", "from serie tv", "river museum maps"]
    q = _t(spark, root, "click_log").select("query").where("query is not null").unionByName(spark.createDataFrame([(x,) for x in more], "query string")).distinct()
    return S.parsed(q, PLATFORMS, SITE_TYPES)


def qp1_tokens(spark, root):
    """Words for retrieval and for phrases, without a platform or site-type word at either end."""
    return _asked(spark, root).select("query", F.array_join("tokens", " ").alias("tokens"), F.array_join("phrase", " ").alias("phrase"))


def qp4_intents(spark, root):
    """Freshness and date intents."""
    return _asked(spark, root).select("query", "fresh", "dated")


def qp6_edges(spark, root):
    """Platform and site-type words count at either end only."""
    return _asked(spark, root).select("query", "platform", "site_type", "domain")


def qp7_classes(spark, root):
    return _asked(spark, root).select("query", F.when(F.col("navigational"), "navigational").otherwise("informational").alias("intent"))


def qp8_domains(spark, root):
    """Neighbouring words of queries that together name a known domain."""
    toks = X.tokens(F.col("query"))
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.size(toks) - 1, F.lit(1))), lambda i: F.concat(F.coalesce(F.try_element_at(toks, i), F.lit("")), F.coalesce(F.try_element_at(toks, i + 1), F.lit(""))))
    names = _t(spark, root, "click_log").select(F.explode(F.concat(toks, pairs)).alias("label")).distinct()
    known = _t(spark, root, "domains").select("domain", U.root_label(F.col("domain")).alias("label"))
    return known.join(names, "label", "left_semi").groupBy("label").agg(F.min("domain").alias("domain"))


def rk8_user(spark, root):
    return P.click_counts(_t(spark, root, "click_log")).select("query", "url", F.round(S.user_points(F.col("clicks") * S.CLICK), 6).alias("points"))


IDF = {"river": 2.0, "museum": 0.5, "maps": 0.0}


def rk12_coverage(spark, root):
    """Mean similarity of the query words to those of a title, share matched and exact matches, weighted by idf."""
    return S.field_scores(_t(spark, root, "pages"), WORDS, IDF).select("page_id", F.round("coverage.mean", 6).alias("avg"), F.round("coverage.share", 6).alias("share"), F.col("coverage.exact").alias("exact"))


def rk13_similarity(spark, root):
    """Similarity of each word of a title to one query word."""
    words = _t(spark, root, "pages").select(F.explode(X.tokens(F.col("title"))).alias("word")).distinct()
    return words.select("word", F.round(X.token_similarity_udf(F.lit("museum"), F.col("word")), 6).alias("similarity"))


def rk15_edits(spark, root):
    """Similarity of the title and the headline."""
    return _t(spark, root, "pages").select("page_id", F.round(X.edit_similarity_udf(F.coalesce("title", F.lit("")), F.coalesce("h1", F.lit(""))), 6).alias("similarity"))


def rk16_frequency(spark, root):
    return S.field_scores(_t(spark, root, "pages"), WORDS, IDF).select("page_id", F.round("tf", 6).alias("tf"))


def _candidates(spark, root, query, n=200):
    """Pages that hold a word of a query, as the ranker sees them."""
    pages = _t(spark, root, "pages")
    q = S.parse(query, PLATFORMS, SITE_TYPES)
    found = S.bm25(index_of(spark, root), q.tokens, need=1).select("id", F.round("score", 6).alias("score")).orderBy(F.col("score").desc(), "id").limit(n).withColumn("mode", F.lit("exact"))
    return found, pages, q


def rk5_address(spark, root):
    """Signals of the address: query words in its parts, depth, brand."""
    found, pages, q = _candidates(spark, root, "harbour garden river")
    return S.rank_parts(found, pages, q, S_NOW).select("id", F.round("address", 6).alias("points"))


def rk9_navigational(spark, root):
    """Boosts of a query that asks for a site."""
    found, pages, q = _candidates(spark, root, "norwick")
    flat = pages.select(F.col("page_id").alias("id"), F.lit(1.0).alias("score"), F.lit("navigational").alias("mode"))
    return S.rank_parts(flat, pages, S.parse("farnnomoor-blog.test"), S_NOW).select("id", F.round("navigational", 6).alias("points"))


def rk17_bonus(spark, root):
    """Bonus of the plan, and the user's signal, for each candidate."""
    found, pages, q = _candidates(spark, root, "harbour garden river")
    modes = F.element_at(F.array(*[F.lit(m) for m in S.MODE_BONUS]), (F.col("id") % len(S.MODE_BONUS) + 1).cast("int"))
    return S.rank_parts(found.withColumn("mode", modes), pages, q, S_NOW).select("id", "bonus", F.round("user", 6).alias("user"))


def rk18_filtered(spark, root):
    pages = _t(spark, root, "pages")
    return S.filtered(pages.select(F.col("page_id").alias("id"), "domain"), pages, "TulRiley.test", "ARTICLE").select(F.col("id").alias("page_id"))


def rk19_bodies(spark, root):
    top = _t(spark, root, "pages").orderBy(F.col("pagerank").desc(), "page_id").limit(20).select("page_id")
    return S.bodies(_t(spark, root, "pages")).withColumnRenamed("id", "page_id").join(top, "page_id", "left_semi").select("page_id", "body", "snippet")


def sp3_levenshtein(spark, root):
    """Distance of a page's host and its domain."""
    return _t(spark, root, "pages").where("domain is not null").select("page_id", F.levenshtein(U.host(F.col("url")), F.col("domain")).alias("distance"))


def pr1_unseen(spark, root):
    """Queue rows of a shape that no page has: exact in place of a Bloom filter."""
    q = _t(spark, root, "crawl_queue").select("queue_id", U.fingerprint(F.col("url")).alias("shape"))
    return q.join(_t(spark, root, "pages").select(U.fingerprint(F.col("url")).alias("shape")).distinct(), "shape", "left_anti").select("queue_id")


def fr5_assets(spark, root):
    """Fetched assets: links to their own site only."""
    log = _t(spark, root, "fetch_log").where("domain <> ''").where(U.discovery_type(F.col("content_type")) & (U.domain(F.col("url")) == F.col("domain")))
    return log.groupBy("domain").agg(F.countDistinct("url").alias("urls"))


def fr9_profile(spark, root):
    clicks = _t(spark, root, "click_log")
    return P.profile(P.interest_terms(clicks.select("query"), clicks))


def fr10_manual(spark, root):
    """Manual interests replace their former weight and can be removed."""
    clicks = _t(spark, root, "click_log")
    manual = clicks.where("query <> ''").select(F.lower("query").alias("term"), F.length("query").cast("double").alias("weight"), "ts")
    terms = P.interest_terms(clicks.select("query"), clicks, manual)
    return terms.where("source = 'manual' and term <> 'forum'").select("term", "weight")


def fr13_enqueue(spark, root):
    q = _t(spark, root, "crawl_queue").select("queue_id", U.canonical(F.col("url")).alias("url"))
    fresh = _t(spark, root, "pages").where(F.col("crawled_at") >= F.lit(AS_OF).cast("timestamp_ntz")).select(U.canonical(F.col("url")).alias("url")).distinct()
    return q.join(fresh, "url", "left_anti").select("queue_id", R.static_score(F.lit(100.0), F.lit(2)).alias("score"))


def hp3_times(spark, root):
    """Times written as texts and read back."""
    s = F.date_format("crawled_at", "yyyy-MM-dd HH:mm:ss")
    return _t(spark, root, "pages").select("page_id", X.parse_time(s).cast("timestamp_ntz").alias("t"))


def hp6_extensions(spark, root):
    return _t(spark, root, "crawl_queue").groupBy(U.extension(F.col("url")).alias("ext")).agg(F.count("*").alias("n"))


def hp7_client(spark, root):
    """Client address: first forwarded, then real, then peer."""
    rows = _t(spark, root, "pages").select("page_id", F.concat_ws(", ", F.nullif("domain", F.lit("")), F.lit("10.0.0.1")).alias("xff"), F.coalesce("region", F.lit("")).alias("real"))
    return rows.select("page_id", U.client_address(F.col("xff"), F.col("real"), F.lit("peer")).alias("client"))


def hp8_seeds(spark, root):
    return Engine(spark, root).seeds().select("seed_id", "url")


def hp9_marked(spark, root):
    """Seeds of stale domains marked as enqueued now."""
    seeds = _t(spark, root, "seed_urls")
    due = R.stale_seeds(seeds, AS_OF, 20).select("seed_id", F.lit(True).alias("due"))
    return seeds.join(due, "seed_id", "left").select("seed_id", F.when(F.col("due"), F.lit(AS_OF).cast("timestamp_ntz")).otherwise(F.col("last_enqueued")).alias("last_enqueued"))


def ap7_stats(spark, root):
    return Engine(spark, root).stats()


def ap14_rank(spark, root):
    return Engine(spark, root).rank().select("node", F.round("rank", 6).alias("rank"), "referring")


def st9_current_terms(spark, root):
    """Terms of the profile that occur in titles: the static side is read anew at each run."""
    terms = P.profile(P.interest_terms(_t(spark, root, "click_log").select("query"), _t(spark, root, "click_log")))
    words = _t(spark, root, "pages").select(F.explode(F.array_distinct(X.interest_tokens(F.col("title")))).alias("term"))
    return words.join(terms, "term").groupBy("term").agg(F.count("*").alias("pages"), F.first("weight").alias("weight"))


QUERIES = {k: v for k, v in globals().items() if callable(v) and getattr(v, "__module__", "") == __name__ and k[0] != "_"}
QUERIES.pop("plain_sql", None)

_NOW = "TIMESTAMP '2024-12-01 00:00:00'"
_HOME = f"regexp_extract(url, '^[^?#]*[?]([^#]*)', 1) = '' AND regexp_extract(url, '#(.*)$', 1) = '' AND regexp_full_match(regexp_replace({PATH}, '^/+|/+$', '', 'g'), '([a-z]{{2}}(-[a-zA-Z0-9]{{2,4}})?)?')"
_ESC = "replace(replace(replace(coalesce({x}, ''), '&', '&amp;'), '<', '&lt;'), '\"', '&quot;')"
_LANG_URL = f"""(SELECT CASE WHEN regexp_full_match(a, '[a-z]{{2,3}}') THEN a WHEN b IN ('www', 'm') THEN '' WHEN regexp_full_match(b, '[a-z]{{2,3}}') THEN b ELSE '' END
    FROM (SELECT regexp_extract(lower(split_part(regexp_replace({PATH}, '^/+|/+$', '', 'g'), '/', 1)), '^([^-_]*)', 1) AS a, CASE WHEN {HOST} LIKE '%.%' THEN regexp_extract(split_part({HOST}, '.', 1), '^([^-_]*)', 1) ELSE '' END AS b))"""
_TITLE = f"list_filter(string_split(coalesce({plain_sql('title')}, ''), ' '), lambda x: x <> '')"
_W = lambda c: f"list_filter(string_split(coalesce({plain_sql(c)}, ''), ' '), lambda x: x <> '')"
_SIM1 = """CASE WHEN {t} = '{q}' THEN 1.0 WHEN starts_with({t}, '{q}') OR starts_with('{q}', {t}) THEN 0.94 WHEN contains({t}, '{q}') OR contains('{q}', {t}) THEN 0.88 WHEN least(length({t}), length('{q}')) < 4 OR abs(length({t}) - length('{q}')) > 0.3 * greatest(length({t}), length('{q}')) THEN 0.0
    WHEN 1 - damerau_levenshtein({t}, '{q}')::DOUBLE / greatest(length({t}), length('{q}')) >= 0.72 THEN 1 - damerau_levenshtein({t}, '{q}')::DOUBLE / greatest(length({t}), length('{q}')) ELSE 0.0 END"""
_SIM = "coalesce(list_max(list_transform(ws, lambda t: " + _SIM1.format(q="{q}", t="t") + ")), 0.0)"
_HAS = lambda ws: "list_has_any(ws, [" + ", ".join(f"'{w}'" for w in sorted(ws)) + "])"
_STOP = lambda ws: "[" + ", ".join(f"'{w}'" for w in sorted(ws)) + "]"
_ASK = ["reddit warframe", "warframe reddit", "noticias uruguay", "uruguay news today", "example.com", "https://www.shop.example.org/a?b", "elections 2024", "report 12/05/2023", "marzo lluvias", "the", "from serie tv", "river museum maps"]
_KEPT = f"""CASE WHEN {_HAS(X.MEDIA_WORDS)} THEN list_filter(ws, lambda x: NOT list_contains({_STOP(X.STOPWORDS - X.TITLE_WORDS)}, x)) ELSE list_filter(ws, lambda x: NOT list_contains({_STOP(X.STOPWORDS)}, x)) END"""
_DOMAIN = r"""(SELECT CASE WHEN contains(d, '.') THEN trim(d, './ ') ELSE '' END FROM (SELECT regexp_replace(CASE WHEN contains(l, '://') THEN regexp_replace(l, '^[a-z][a-z0-9+.-]*://(?:[^@/?#]*@)?([^/?#:]*).*$', '\1') WHEN contains(l, '.') AND NOT contains(l, ' ') THEN regexp_extract(l, '^([^/?#:]*)', 1) ELSE l END, '^www[.]', '') AS d FROM (SELECT trim(lower(query)) AS l)))"""
_ASKED = f"""q AS (SELECT DISTINCT query FROM (SELECT query FROM click_log WHERE query IS NOT NULL UNION ALL SELECT unnest([{", ".join(f"'{x}'" for x in _ASK)}]))), a AS (SELECT query, {_W('query')} AS ws FROM q),
    b AS (SELECT *, list_filter([ws[1], CASE WHEN len(ws) > 1 THEN ws[-1] END], lambda x: x IN ('reddit', 'github')) AS ps, list_filter([ws[1], CASE WHEN len(ws) > 1 THEN ws[-1] END], lambda x: x IN ('noticias', 'news', 'blog')) AS ts, {_KEPT} AS kept FROM a),
    c AS (SELECT query, ws, CASE WHEN len(ps) = 1 THEN ps[1] ELSE '' END AS platform, CASE WHEN len(ts) = 1 AND len(ps) <> 1 THEN ts[1] ELSE '' END AS site_type, CASE WHEN len(ws) <= 1 OR len(kept) = 0 THEN ws ELSE kept END AS sharp FROM b),
    asked AS (SELECT query, ws, platform, site_type, {_DOMAIN} AS domain, CASE WHEN len(list_filter(sharp, lambda x: x NOT IN (platform, site_type))) = 0 THEN sharp ELSE list_filter(sharp, lambda x: x NOT IN (platform, site_type)) END AS tokens,
    CASE WHEN len(list_filter(ws, lambda x: x NOT IN (platform, site_type))) = 0 THEN ws ELSE list_filter(ws, lambda x: x NOT IN (platform, site_type)) END AS phrase FROM c)"""
_ITOK = r"regexp_split_to_array(lower({x}), '[^\p{L}\p{Nd}]+')"
_PROFILE = f"SELECT term, CAST(2 * count(*) AS DOUBLE) AS weight FROM (SELECT unnest({_ITOK.replace('{x}', 'query')}) AS term FROM click_log) WHERE strlen(term) > 2 GROUP BY term"
from .table_queries import _GRAPH, ORACLES as _TABLE  # noqa: E402
from .search_queries import _terms, bm25_sql  # noqa: E402
from .url_queries import ORACLES as _URL, _CANON  # noqa: E402

_SHAPE = _URL["url5_fingerprint"].replace("SELECT page_id, ", "").replace(" AS fingerprint FROM pages", "")
_RESOURCES = """SELECT url, CASE WHEN contains(c, 'text/css') THEN 'css' WHEN regexp_matches(c, 'javascript|ecmascript') THEN 'js' WHEN contains(c, 'json') THEN 'json' WHEN contains(c, 'rss') THEN 'rss' WHEN contains(c, 'atom') THEN 'atom' WHEN contains(c, 'xml') THEN 'xml' ELSE 'other' END AS kind, status, ts AS last_crawled
    FROM (SELECT *, lower(coalesce(content_type, '')) AS c, row_number() OVER (PARTITION BY url ORDER BY ts DESC, fetch_id DESC) AS k FROM fetch_log WHERE url IS NOT NULL AND NOT regexp_matches(lower(coalesce(content_type, '')), 'text/html|application/xhtml[+]xml')
    AND regexp_matches(lower(coalesce(content_type, '')), 'text/css|(application|text)/javascript|application/(x-javascript|ecmascript|json|ld[+]json|xml|rss[+]xml|atom[+]xml)|text/xml')) WHERE k = 1"""
ORACLES = {
    "snk3_flush": """WITH k AS (SELECT url, arg_max(page_id, struct_pack(c := coalesce(crawled_at, TIMESTAMP '1970-01-01'), p := page_id)) AS kept FROM pages GROUP BY url),
        m AS (SELECT DISTINCT kept, target_hash FROM links JOIN pages p ON p.page_id = source_id JOIN k ON k.url = p.url)
        SELECT 'pages' AS what, CAST(count(*) AS BIGINT) AS n FROM k UNION ALL SELECT 'links', (SELECT count(*) FROM m) + (SELECT count(*) FROM links WHERE source_id NOT IN (SELECT kept FROM m))""",
    "ex12_cut": """SELECT page_id, CASE WHEN content IS NOT NULL THEN true END AS fits, CAST(CASE WHEN title IS NOT NULL THEN list_max(list_filter(range(0, 21), lambda k: strlen(left(title, k)) <= 20 AND k <= length(title))) END AS INTEGER) AS chars FROM pages""",
    "snk4_images": "SELECT url || '#img' AS url, page_id AS source_id, title AS alt_text FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY coalesce(crawled_at, TIMESTAMP '1970-01-01') DESC, page_id DESC) AS k FROM pages) WHERE k = 1",
    "snk7_resources": f"WITH r AS ({_RESOURCES}) SELECT url, kind, status, last_crawled FROM r",
    "src2_resources": f"WITH r AS ({_RESOURCES}) SELECT url, url_fingerprint FROM pages UNION ALL SELECT url, {_SHAPE} FROM r",
    "snk6_outlinks": """WITH o AS (SELECT page_id, list_filter([url, 'ftp://x', 'https://', 'https://' || domain, 'http://a.example/1', 'http://a.example/2'], lambda x: regexp_matches(x, '^https?://[^/]+'))[1:3] AS o FROM pages) SELECT page_id, CAST(i AS INTEGER) AS pos, o[i + 1] AS target FROM o, LATERAL (SELECT unnest(range(0, len(o))) AS i) r""",
    "snk13_index_update": f"WITH {INDEX} SELECT term, CAST(count(*) AS BIGINT) AS doc FROM post GROUP BY term",
    "ex25_persisted": "SELECT page_id, sha256(coalesce(content, '')) AS content_hash, '' AS region, left(title, 500) AS title FROM pages",
    "url4_domains": f"SELECT regexp_replace({HOST}, '^www[.]', '') AS site, CAST(count(*) AS BIGINT) AS n FROM pages GROUP BY 1",
    "url9_indexable": f"""SELECT queue_id FROM crawl_queue WHERE NOT (lower(regexp_extract({PATH}, '([.][^./]*)$', 1)) IN ({", ".join(f"'{x}'" for x in U.BINARY + U.ASSET)}) OR regexp_matches(lower({PATH}), '^({"|".join(U.NO_CONTENT)})') OR regexp_matches(lower({PATH}), '{"|".join(U.CHALLENGE)}'))""",
    "fd2_retries": "SELECT queue_id, CASE WHEN retries < 3 THEN retries + 1 ELSE retries END AS retries, retries < 3 AS again FROM crawl_queue WHERE status = 'failed'",
    "fd5_backlog": "SELECT url_fingerprint, render_reason, min(page_id) AS page_id FROM pages WHERE render_reason <> '' GROUP BY 1, 2",
    "j7_update": f"WITH ref AS ({_TABLE['a3_referring_domains'].replace('WITH ' + _GRAPH, 'WITH ' + _GRAPH)}) SELECT page_id, coalesce(referring, 0) AS referring_domains FROM pages LEFT JOIN ref ON node = url_hash",
    "j8_images": "SELECT url AS page, CAST(count(*) AS BIGINT) AS images FROM pages GROUP BY url",
    "j9_lookup": "SELECT page_id FROM pages WHERE url IN (SELECT url FROM click_log)",
    "a7_corpus": "SELECT max(page_id) AS max_id, CAST(count(*) AS BIGINT) AS n FROM pages",
    "a15_frequencies": f"SELECT page_id, word, CAST(least(count(*), 4) AS INTEGER) AS n FROM (SELECT page_id, unnest({_TITLE}) AS word FROM pages) GROUP BY page_id, word",
    "w6_first": f"SELECT page_id, coalesce(string_agg(w, ' ' ORDER BY i), '') AS words FROM (SELECT page_id, w, min(i) AS i FROM (SELECT page_id, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS i FROM (SELECT page_id, {_TITLE} AS ws FROM pages)) GROUP BY page_id, w) GROUP BY page_id UNION ALL SELECT page_id, '' FROM pages WHERE len({_TITLE}) = 0",
    "t1_boosted": f"""WITH {INDEX}, {bm25_sql(_terms(WORDS))} SELECT s.id, round(score, 6) AS score FROM s JOIN pages ON page_id = s.id ORDER BY round(score, 6) + CASE WHEN lower(domain) = 'gallebury-wiki.example' THEN 30 ELSE 0 END DESC, s.id LIMIT 40""",
    "t2_order": f"""SELECT page_id FROM pages ORDER BY round(pagerank, 1) DESC NULLS LAST, {_HOME} DESC, crawled_at DESC NULLS LAST, url, page_id LIMIT 50""",
    "t10_outlinks": f"WITH {_GRAPH} SELECT source_id, coalesce(n.r.u, 'hash:' || target_hash) AS target, created_at FROM links LEFT JOIN nodes n ON n.node = target_hash WHERE source_id = 1 ORDER BY created_at DESC, target LIMIT 50",
    "ft11_domain_tokens": "SELECT page_id, h AS hits FROM (SELECT page_id, " + " + ".join(f"CAST(contains(lower(domain), '{w}') AS INTEGER)" for w in ("wiki", "bury", "gal", "nor")) + " AS h FROM pages) WHERE h >= 2",
    "qp4_intents": rf"""WITH {_ASKED} SELECT query, {_HAS(S.FRESH)} OR site_type IN ('noticias', 'news') AS fresh, regexp_matches(query, '\b(199[0-9]|20[0-9]{{2}}|2100)\b') OR regexp_matches(query, '\b[0-9]{{1,2}}[-/][0-9]{{1,2}}[-/][0-9]{{2,4}}\b|\b[0-9]{{4}}[-/][0-9]{{1,2}}[-/][0-9]{{1,2}}\b') OR {_HAS(S.MONTHS)} AS dated FROM asked""",
    "qp6_edges": f"WITH {_ASKED} SELECT query, platform, site_type, domain FROM asked",
    "qp1_tokens": f"WITH {_ASKED} SELECT query, array_to_string(tokens, ' ') AS tokens, array_to_string(phrase, ' ') AS phrase FROM asked",
    "qp7_classes": rf"""WITH {_ASKED} SELECT query, CASE WHEN (site_type <> '' AND platform = '' AND domain = '') OR (({_HAS(S.FRESH)} OR site_type IN ('noticias', 'news')) AND platform = '') THEN 'informational'
        WHEN domain <> '' OR platform <> '' OR len(tokens) = 1 THEN 'navigational' ELSE 'informational' END AS intent FROM asked""",
    "qp8_domains": f"""WITH w AS (SELECT {_W('query')} AS ws FROM click_log), n AS (SELECT unnest(ws) AS l FROM w UNION SELECT ws[i] || ws[i + 1] FROM w, LATERAL (SELECT unnest(range(1, len(ws))) AS i) r), d AS (SELECT domain, regexp_extract(domain, '([^.]*)[.][^.]*$', 1) AS label FROM domains)
        SELECT label, min(domain) AS domain FROM d WHERE label IN (SELECT l FROM n) GROUP BY label""",
    "rk8_user": f"SELECT query, url, round(least(50.0 * count(*), 500) * 0.1, 6)::DOUBLE AS points FROM (SELECT {plain_sql('query')} AS query, url FROM click_log) WHERE query <> '' GROUP BY query, url",
    "rk12_coverage": f"""WITH w AS (SELECT page_id, {_TITLE} AS ws FROM pages), s AS (SELECT page_id, len(ws) = 0 AS none, {", ".join(f"{_SIM.format(q=q)} AS s{i}" for i, q in enumerate(WORDS))} FROM w)
        SELECT page_id, round((2.0 * s0 + 0.5 * s1 + 1.0 * s2)::DOUBLE / 3.5, 6) AS avg, round((CASE WHEN s0 >= 0.72 THEN 2.0 ELSE 0 END + CASE WHEN s1 >= 0.72 THEN 0.5 ELSE 0 END + CASE WHEN s2 >= 0.72 THEN 1.0 ELSE 0 END)::DOUBLE / 3.5, 6) AS share,
        CAST(s0 = 1 AS INTEGER) + CAST(s1 = 1 AS INTEGER) + CAST(s2 = 1 AS INTEGER) AS exact FROM s""",
    "rk13_similarity": f"SELECT word, round(coalesce({_SIM1.format(q='museum', t='word')}, 0)::DOUBLE, 6) AS similarity FROM (SELECT DISTINCT unnest({_TITLE}) AS word FROM pages)",
    "rk16_frequency": f"""WITH w AS (SELECT page_id, {_W('title')} AS t, {_W('h1')} AS h, {_W('description')} AS d FROM pages) SELECT page_id, round(CAST({" + ".join(f"{IDF[q] or 1.0} * (3 * least(len(list_filter(t, lambda x: x = '{q}')), 4) + 2 * least(len(list_filter(h, lambda x: x = '{q}')), 5) + 2 * least(len(list_filter(d, lambda x: x = '{q}')), 5))" for q in WORDS)} AS DOUBLE), 6) AS tf FROM w""",
    "rk5_address": f"""WITH {INDEX}, {bm25_sql(_terms(["harbour", "garden", "river"]))}, c AS (SELECT id FROM s ORDER BY round(score, 6) DESC, id LIMIT 200), p AS (SELECT id, list_filter(regexp_split_to_array(trim(lower(url), '/'), '[/\\-_.?=&]'), lambda x: true) AS parts, length(url) - length(replace(url, '/', '')) - 2 AS depth,
        regexp_extract(regexp_replace({HOST}, '^www[.]', ''), '([^.]*)[.][^.]*$', 1) AS label FROM c JOIN pages ON page_id = id),
        k AS (SELECT id, depth, {" + ".join(f"CAST(len(list_filter(parts, lambda x: contains(x, '{w}') OR (x <> '' AND contains('{w}', x)))) > 0 AS INTEGER)" for w in ("harbour", "garden", "river"))} AS hit, {" + ".join(f"CAST(contains(label, '{w}') AND {len(w)} * 100 // length(label) >= 40 AS INTEGER)" for w in ("harbour", "garden", "river"))} AS brand FROM p)
        SELECT id, CAST(200 * hit + CASE WHEN hit = 3 THEN 300 ELSE 0 END + CASE WHEN depth <= 1 THEN 60 WHEN depth <= 2 THEN 30 ELSE 0 END + 400 * brand + CASE WHEN brand >= 2 THEN 800 ELSE 0 END AS DOUBLE) AS points FROM k""",
    "rk9_navigational": f"""SELECT page_id AS id, CAST(CASE WHEN regexp_matches(lower(url), '/(user|profile|u|people|member|author|accounts)/') OR coalesce(domain, '') <> 'farnnomoor-blog.test' THEN 0 WHEN {_HOME} THEN 29000 ELSE 8000 END AS DOUBLE) AS points FROM pages""",
    "rk17_bonus": f"""WITH {INDEX}, {bm25_sql(_terms(["harbour", "garden", "river"]))}, c AS (SELECT id, round(score, 6) AS score FROM s ORDER BY round(score, 6) DESC, id LIMIT 200)
        SELECT id, CAST(CASE id % 6 {" ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(S.MODE_BONUS.values()))} END AS DOUBLE) AS bonus, round(least(score, 500) * 0.1, 6) AS user FROM c""",
    "rk18_filtered": "SELECT page_id FROM pages WHERE lower(domain) = 'tulriley.test' AND lower(schema_type) = 'article'",
    "rk19_bodies": "WITH t AS (SELECT * FROM pages ORDER BY pagerank DESC NULLS LAST, page_id LIMIT 20) SELECT page_id, left(content, 4000) AS body, left(coalesce(nullif(description, ''), content), 240) AS snippet FROM t",
    "sp3_levenshtein": f"SELECT page_id, CAST(levenshtein({HOST}, domain) AS INTEGER) AS distance FROM pages WHERE domain IS NOT NULL",
    "pr1_unseen": f"WITH q AS (SELECT queue_id, {_SHAPE} AS shape FROM crawl_queue), p AS (SELECT {_SHAPE} AS shape FROM pages) SELECT queue_id FROM q WHERE shape NOT IN (SELECT shape FROM p)",
    "fr5_assets": f"""SELECT domain, CAST(count(DISTINCT url) AS BIGINT) AS urls FROM fetch_log WHERE domain <> '' AND regexp_matches(lower(coalesce(content_type, '')), 'text/html|application/xhtml[+]xml|text/css|(application|text)/javascript|application/(x-javascript|ecmascript|json|ld[+]json|xml|rss[+]xml|atom[+]xml)|text/xml') AND regexp_replace({HOST}, '^www[.]', '') = domain GROUP BY domain""",
    "fr9_profile": _PROFILE,
    "fr10_manual": "SELECT term, weight FROM (SELECT lower(query) AS term, CAST(length(query) AS DOUBLE) AS weight, row_number() OVER (PARTITION BY lower(query) ORDER BY ts DESC) AS k FROM click_log WHERE query <> '') WHERE k = 1 AND term <> 'forum'",
    "fr13_enqueue": f"WITH p AS (SELECT {_CANON} AS c FROM pages WHERE crawled_at >= {_NOW}) SELECT queue_id, 100 - 12 * ln(3) AS score FROM (SELECT queue_id, {_CANON} AS c FROM crawl_queue) WHERE c IS NULL OR c NOT IN (SELECT c FROM p WHERE c IS NOT NULL)",
    "hp3_times": "SELECT page_id, date_trunc('second', crawled_at) AS t FROM pages",
    "hp6_extensions": f"SELECT lower(regexp_extract({PATH}, '([.][^./]*)$', 1)) AS ext, CAST(count(*) AS BIGINT) AS n FROM crawl_queue GROUP BY 1",
    "hp7_client": "SELECT page_id, CASE WHEN coalesce(domain, '') = '' THEN '10.0.0.1' ELSE domain END AS client FROM pages",
    "hp8_seeds": "SELECT seed_id, url FROM seed_urls",
    "hp9_marked": f"WITH d AS (SELECT seed_id FROM seed_urls WHERE epoch({_NOW}) - epoch(coalesce(last_enqueued, TIMESTAMP '1970-01-01')) > recrawl_interval_seconds ORDER BY coalesce(last_enqueued, TIMESTAMP '1970-01-01'), seed_id LIMIT 20) SELECT seed_id, CASE WHEN seed_id IN (SELECT seed_id FROM d) THEN {_NOW} ELSE last_enqueued END AS last_enqueued FROM seed_urls",
    "ap7_stats": " UNION ALL ".join(f"SELECT '{x}' AS what, CAST(count(*) AS BIGINT) AS n FROM {x}" for x in ("pages", "domains", "seed_urls", "links", "crawl_queue")) + " UNION ALL SELECT 'queue_' || status, count(*) FROM crawl_queue GROUP BY status",
    "ap14_rank": f"SELECT a.node, a.rank, b.referring FROM ({_TABLE['a17_pagerank']}) a JOIN ({_TABLE['a3_referring_domains']}) b USING (node)",
    "st9_current_terms": f"WITH t AS ({_PROFILE}), w AS (SELECT unnest(list_distinct({_ITOK.replace('{x}', 'title')})) AS term FROM pages) SELECT term, CAST(count(*) AS BIGINT) AS pages, any_value(weight) AS weight FROM w JOIN t USING (term) GROUP BY term",
}
